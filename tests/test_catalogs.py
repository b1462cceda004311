import json
import re

from ledgerlake.sources import catalogs as cat


def plain(tree):
    """(id, title, statement) of the tree's controls, by recursion."""
    out = []

    def lines(part, depth=0):
        label = next((p["value"].strip() for p in part.get("props", []) if p["name"] == "label"), "")
        prose = re.sub(r"\{\{\s*insert:\s*param,\s*([^}]+?)\s*\}\}", r"[assignment: \1]", part.get("prose", "").strip())
        own = ["  " * depth + (label + " " if label else "") + prose] if prose else []
        return own + [x for c in part.get("parts", []) for x in lines(c, depth + 1)]

    def walk(nodes):
        for n in nodes:
            if not n.get("id", "").strip():
                continue
            if not any(p["name"] == "status" and p["value"] == "withdrawn" for p in n.get("props", [])):
                first = next((p for p in n.get("parts", []) if p.get("name") == "statement"), None)
                out.append((n["id"], n.get("title", "").strip(), "\n".join(lines(first)).strip() if first else ""))
            walk(n.get("controls", []))

    walk(tree.get("controls", []))
    return sorted(out)


TREE = {
    "controls": [
        {
            "id": "ac-1", "title": " Policy ", "props": [{"name": "label", "value": "AC-1"}],
            "parts": [
                {"name": "guidance", "prose": "not this"},
                {"name": "statement", "prose": "Do {{ insert: param, ac-1_prm_1 }}:", "parts": [
                    {"name": "item", "props": [{"name": "label", "value": "a."}], "prose": "first", "parts": [{"prose": "deep {{insert: param, x}}"}, {"prose": " "}]},
                    {"name": "item", "prose": "second"},
                ]},
            ],
            "controls": [
                {"id": "ac-1.1", "title": "One", "controls": [{"id": "ac-1.1.7", "title": "Three levels", "parts": [{"name": "statement", "prose": "x"}]}]},
                {"id": "ac-1.2", "title": "Gone", "props": [{"name": "status", "value": "withdrawn"}], "controls": [{"id": "ac-1.3", "title": "Stays"}]},
                {"title": "no id", "controls": [{"id": "ac-9", "title": "hidden"}]},
            ],
        },
        {"id": "zz", "title": "odd id", "parts": []},
    ]
}


def test_trees_equal_recursion(spark):
    docs = [("t", json.dumps(TREE)), ("empty", "{}"), ("broken", "{"), ("null", None), ("list", "[]"), ("other", json.dumps({"controls": TREE["controls"][:1]}))]
    rows = cat.controls(spark.createDataFrame(docs, "doc string, text string"), "doc", "text").collect()
    for doc, tree in (("t", TREE), ("other", {"controls": TREE["controls"][:1]})):
        assert sorted((r.oscal_id, r.title, r.statement) for r in rows if r.doc == doc) == plain(tree)
    assert {r.doc for r in rows} == {"t", "other"}
    ids = {r.oscal_id: (r.control_id, r.place) for r in rows if r.doc == "t"}
    assert ids["ac-1"] == ("AC-01", [0]) and ids["ac-1.1"] == ("AC-01(01)", [0, 0]) and ids["ac-1.3"] == ("AC-01(03)", [0, 1, 0]) and ids["zz"][0] == "ZZ"
    none = cat.controls(spark.createDataFrame([], "doc string, text string"), "doc", "text")
    assert none.count() == 0 and none.columns == ["doc", "oscal_id", "control_id", "title", "statement", "place"]


def test_a_catalog_in_xml_is_many_files(spark, monkeypatch):
    from ledgerlake.plans import sources

    monkeypatch.setattr(sources, "ROWS", 25)
    found = sources.xccdf_catalog_source(spark, "/root/testdata/sf0.001")
    assert found.count() == spark.read.parquet("/root/testdata/sf0.001/part.parquet").count() <= 25 * len(found.inputFiles())
