import json
import zlib

import numpy as np
from tokenizers import Tokenizer

from ledgerlake.llm import token_files as tf
from ledgerlake.llm.common import shared_dir
from ledgerlake.llm.encoding import Encoder, vocabulary

TEXTS = [
    "The quick  brown\n fox's 12 \t jumps. ", " lead", "trail ", "", None, "a" * 5000 + " b" * 9000,
    "Élan naïve ÀÉ İstanbul ß ﬁ é don't WE'LL", "x y z　w", "\n\n", "a \n b", "<|endoftext|> 2", "a<|endoftext|>B <|startoftext|>", "< |endoftext|>", "😀 ok ‍ x",
]


def test_encoder_equals_library():
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        library = Tokenizer.from_file(vocabulary(name))
        own = Encoder(vocabulary(name))
        for text in [t for t in TEXTS if t]:
            assert np.frombuffer(own.ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_other_vocabularies_are_left_to_the_library(tmp_path):
    with open(vocabulary("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    spec["pre_tokenizer"]["add_prefix_space"] = True
    path = str(tmp_path / "other.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(spec, f)
    own, library = Encoder(path), Tokenizer.from_file(path)
    for text in [t for t in TEXTS if t]:
        assert np.frombuffer(own.ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    for top in (1, 2, 300, 50_257, 2**32 - 1):
        ids = np.minimum(rng.zipf(1.3, 5000), top).astype("<u4")
        ids[::97] = rng.integers(0, top, len(ids[::97]), endpoint=True)
        blocks = tf.encode_blocks(ids)
        starts = np.cumsum([0, *map(len, blocks)])[:-1]
        assert (tf.decode_blocks(b"".join(blocks), starts)[: len(ids)] == ids).all()


def test_files_hold_whole_texts_in_order(spark):
    rows = [(i if i != 3 else None, t, "extra") for i, t in enumerate(TEXTS)] + [(0, "again", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3)
    path = shared_dir(spark, "t")
    tf.write_tokens(docs, path, vocabulary("byte_bpe_50k.json"), 2)
    got = tf.read_tokens(spark, path).orderBy("start").collect()
    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at = 0
    for row, (doc_id, text, _) in zip(got, want, strict=True):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        assert (row.doc_id, row.start, row.n_tokens, zlib.crc32(row.ids_le32)) == (doc_id, at, len(ids) // 4, zlib.crc32(ids))
        at += row.n_tokens


def test_files_and_ranges_are_bounded(spark, monkeypatch):
    docs = spark.range(300).selectExpr("id AS doc_id", "repeat(concat('word ', id, ' '), 20) AS text")
    whole, cut = shared_dir(spark, "t"), shared_dir(spark, "t")
    tf.write_tokens(docs, whole, vocabulary("byte_bpe_50k.json"), 2)
    out = []
    monkeypatch.setattr(tf, "RANGE_IDS", 500)
    for texts in [["a b c"] * 700]:
        with open(f"{cut[7:]}.pfor", "wb") as f:
            builder = tf._FileBuilder(f)
            for i, t in enumerate(texts):
                builder.add(i, np.arange(len(t), dtype="<u4").tobytes())
            entry = builder.close()
        begins = [d for d, _ in entry["cuts"]]
        assert len(begins) == 7
        for b, c in zip(begins, [*begins[1:], len(texts)], strict=True):
            out += [(int(d), int(s)) for docs_, starts, _, _ in tf.read_file(f"{cut}.pfor", b, c) for d, s in zip(docs_, starts, strict=True)]
    assert out == [(i, 5 * i) for i in range(700)]
    assert tf.read_tokens(spark, whole).count() == 300


def test_empty_table(spark):
    path = shared_dir(spark, "t")
    tf.write_tokens(spark.createDataFrame([], "doc_id long, text string"), path, vocabulary("byte_bpe_50k.json"), 2)
    assert tf.read_tokens(spark, path).count() == 0
