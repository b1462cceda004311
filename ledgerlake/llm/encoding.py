"""Whole-text encoding with the tokenizers library, each distinct piece once per worker.

Both vocabularies used here decide ids inside pieces that never cross a space between two
characters that are not white space. So a text is cut at those spaces, the ids of a piece come from a table
that the worker keeps, and the library's model runs only on pieces it has not met. The result is the
one of Tokenizer.from_file(path).encode(text, add_special_tokens=False): a special string inside a text has the
special id, and such texts are left to the library whole. A vocabulary whose file describes other cutting or folding than
these two is encoded by the library alone.
"""

from __future__ import annotations

import os
import unicodedata
from array import array

#: Entries that a worker's table takes before they become its older half and the half before them goes.
TABLE_ROWS = 300_000
_STOPS = ".,;:!?*$#&%"

_BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: What a vocabulary file says of its normalizer and pre-tokenizer where the patterns above hold; fixed values of the file format.
_BYTE_CUTS = (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True})
_WORD_CUTS = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": _WORD_PATTERN}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
)


def _byte_alphabet() -> dict[int, str]:
    """The printable stand-ins of byte-level vocabularies: printable bytes stay, others follow from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


_ALPHABET = _byte_alphabet()


class _Table(dict):
    """Values by text, made where they are missing. Entries in use move on from the older half, the others go in time."""

    def __init__(self, make):
        self.make, self.older = make, {}

    def __missing__(self, text: str) -> bytes:
        value = self.older.get(text)
        if value is None:
            value = self.make(text)
        if len(self) >= TABLE_ROWS:
            self.older = dict(self)
            self.clear()
        self[text] = value
        return value


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        import json

        import regex
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        #: All ids are below it.
        self.size = max(self.tokenizer.get_vocab().values()) + 1
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cuts = (spec.get("normalizer"), spec.get("pre_tokenizer"))
        plain = all(not t["normalized"] and t["content"] for t in spec.get("added_tokens", []))
        #: Whether the cutting below is that of the file.
        self.known_cuts = plain and cuts in (_BYTE_CUTS, _WORD_CUTS)
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        #: Lower-casing vocabularies drop white space; the others keep it in their pieces.
        self.folds = cuts[0] is not None
        self.pieces = regex.compile(_WORD_PATTERN if self.folds else _BYTE_PATTERN).findall
        self.lead = "" if self.folds else " "
        self.known = _Table(self._model)
        self.parts = _Table(lambda part: self._part(part, self.lead))

    def _model(self, piece: str) -> bytes:
        if piece.isascii() and piece.isalnum():
            shown = piece
        elif piece[0] == " " and piece.isascii() and piece[1:].isalnum():
            shown = _ALPHABET[32] + piece[1:]
        else:
            shown = "".join([_ALPHABET[b] for b in piece.encode()])
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        return self.known[piece]

    def _fold(self, text: str) -> str:
        """Composed and lower-cased one character at a time, as the library does."""
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        return "".join([c.lower() for c in text]) if "Σ" in text else text.lower()  # only a sigma's lower case depends on what follows

    def _run(self, text: str) -> bytes:
        if self.folds:
            text = self._fold(text)
        return b"".join(map(self.known.__getitem__, self.pieces(text)))

    def _part(self, part: str, lead: str) -> bytes:
        """The ids of what stands between two spaces, with the space before it where that is kept.

        A word with plain punctuation behind it, and such words around one line break, need no pattern.
        """
        core = part.rstrip(_STOPS)
        stops = part[len(core) :]
        if core.isalpha():
            if self.folds and not (core := self._fold(core)).isalpha():
                return self._run(part)  # a letter whose lower case has a mark of its own
            word = self._piece(lead + core)
            return word + self._piece(stops) if stops else word
        a, found, b = part.partition("\n")
        if found and a and b and not a[-1].isspace() and not b[0].isspace():
            return self._part(a, lead) + (b"" if self.folds else self._piece("\n")) + self._part(b, "")
        return self._run(lead + part)

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.known_cuts or any(map(text.__contains__, self.added)):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        parts = text.split(" ")
        if self.folds:
            return b"".join(map(self.parts.__getitem__, parts))
        if "" in parts or any(p[0].isspace() or p[-1].isspace() for p in parts):
            return self._run(text)  # white space beside a space changes where pieces begin
        return self._part(parts[0], "") + b"".join(map(self.parts.__getitem__, parts[1:]))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def vocabulary(name: str) -> str:
    """The path of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)
