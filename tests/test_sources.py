import json

from tarnline.sources import tables


def test_manifest_and_dataset_files(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"docs": [{"doc_id": "a", "ingest": True, "tier": 1}, {"doc_id": "b", "ingest": None}]}, indent=1))
    assert [(r.doc_id, r.ingest) for r in tables.read_manifest_json(spark, str(tmp_path / "m.json")).collect()] == [("a", True), ("b", None)]
    lines = [{"question": "q", "source_doc_id": "a", "source_page": 3}, {"question": "r", "source_doc_id": ["a", "b"], "source_page": [1, 2], "source_page_label": ["i", None]}]
    (tmp_path / "d.jsonl").write_text("\n\n".join(map(json.dumps, lines)))
    got = {r.question: (r.source_doc_id, r.source_page, r.source_page_label) for r in tables.read_eval_jsonl(spark, str(tmp_path / "d.jsonl")).collect()}
    assert got == {"q": (["a"], [3], None), "r": (["a", "b"], [1, 2], ["i", None])}


def test_page_dumps(spark, tmp_path):
    (tmp_path / "d.txt").write_text("===== pump guide PAGE 1/2 =====\nfirst\npage\n===== pump guide PAGE 2/2 =====\nsecond")
    got = {(r.doc_id, r.page): r.text for r in tables.read_page_dumps(spark, str(tmp_path)).collect()}
    assert got == {("pump guide", 1): "first\npage\n", ("pump guide", 2): "second"}


def test_markdown_and_newest_file(spark, tmp_path):
    (tmp_path / "a.md").write_text("x\ny")
    assert tables.read_markdown(spark, str(tmp_path / "*.md")).first().text == "x\ny"
    for i, name in enumerate(("b.json", "c.json")):
        (tmp_path / name).write_text("{}")
        import os

        os.utime(tmp_path / name, (1000 + i, 1000 + i))
    assert tables.newest_file(spark, str(tmp_path)).first().file.endswith("c.json")


def test_missing_paths(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.pdf").write_bytes(b"%PDF")
    docs = spark.createDataFrame([("a", "a.pdf"), ("b", "b.pdf")], "doc_id string, filename string")
    assert [r.doc_id for r in tables.missing_paths(docs, str(tmp_path)).collect()] == ["b"]
