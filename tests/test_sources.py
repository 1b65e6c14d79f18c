"""Reading and writing."""

import json

from pyspark.sql import functions as F

from sahifa.operators import evaluate
from sahifa.sinks import files
from sahifa.sources import html, pdf
from sahifa.sources import text as sources
from sahifa.streaming import blocks as streaming

PAGES = [{"pageNumber": 1, "blocks": [{"type": "paragraph", "content": {"ar": None, "en": "Sentence of words. " * 20}, "bbox": [0.0, 1.0, 2.0, 3.0], "chapter": "A", "section": None}]}]
CHUNKS = [{"chunk_id": "a", "content": {"ar": "x", "en": None}, "metadata": {"chunk_type": "narrative", "language": ["ar"]}}]


def test_json_pages_and_chunks(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "one.json").write_text(json.dumps(PAGES))
    got = sources.read_json_pages(spark, str(tmp_path / "p")).collect()
    assert [(r["page_number"], r["type"], r["y0"], r["chapter"]) for r in got] == [(1, "paragraph", 1.0, "A")]
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "bare.json").write_text(json.dumps(CHUNKS))
    (tmp_path / "c" / "named.json").write_text(json.dumps({"chunks": CHUNKS}))
    rows = sources.read_json_chunks(spark, str(tmp_path / "c")).collect()
    assert [(r["chunk_id"], r["ar"], r["chunk_type"], r["embedding_allowed"]) for r in rows] == [("a", "x", "narrative", None)] * 2


def test_page_marked_files(spark, tmp_path):
    (tmp_path / "t.txt").write_text("--- Page 1 ---\n\none\ntwo\n\n--- Page 3 ---\n\nthree\n")
    assert sorted((r["page_number"], r["text"]) for r in sources.read_page_marked(spark, str(tmp_path)).collect()) == [(1, "one\ntwo"), (3, "three")]


def test_html(spark):
    page = "<nav><ul><li><a>m</a></li></ul></nav><article><h1>T &amp; U</h1><p>a<br>b</p><p>c</article><footer>f</footer>"
    df = spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")
    assert [(r["type"], r["en"]) for r in html.html_blocks(df).orderBy("block_seq").collect()] == [("toc", "m"), ("header", "T & U"), ("paragraph", "a b"), ("paragraph", "c"), ("footer", "f")]


def test_scan_rows_to_blocks(spark):
    rows = [("d", 1, 800.0, "Chapter 1 : A\nplain words here", None, None, None, None, None), ("d", 2, 800.0, "", "نص عربي\nmixed نص", None, None, None, None), ("d", 2, 800.0, None, None, "lines", 0, [["h", "i"], ["1"]], None)]
    got = pdf.scanned_blocks(spark.createDataFrame(rows, pdf.SCAN_ROWS)).orderBy("page_number", "block_seq").collect()
    assert [(r["page_number"], r["type"], r["chapter"]) for r in got] == [(1, "paragraph", "A"), (2, "table", "A"), (2, "paragraph", "A"), (2, "paragraph", "A")]
    assert got[1]["ar"] == "| h | i |\n| --- | --- |\n| 1 |  |" and got[3]["ar"] == "mixed نص"


def test_text_rows_to_blocks(spark):
    base = ("d", 1, 1000.0, "page text")
    rows = [(*base, "text", 0, "  Head  ", None, 0.0, 10.0, 9.0, 20.0, None), (*base, "text", 1, "نص", None, 0.0, 500.0, 9.0, 510.0, None), (*base, "table", 0, None, [["a", None], ["b", "c"]], 0.0, 600.0, 9.0, 700.0, None)]
    got = pdf.text_layer_blocks(spark.createDataFrame(rows, pdf.TEXT_ROWS)).orderBy("block_seq").collect()
    assert [(r["type"], r["ar"], r["en"]) for r in got] == [("header", None, "Head"), ("paragraph", "نص", None), ("table", None, "a\t\nb\tc")]


def test_sinks(spark, tmp_path):
    rows = [("d", 0, "id", None, "text", "Book", 2024, "A", None, 1, 1, "narrative", ["en"], True)]
    chunks = spark.createDataFrame(rows, "doc_id string, chunk_seq int, chunk_id string, ar string, en string, document string, year int, chapter string, section string, page_start int, page_end int, chunk_type string, language array<string>, embedding_allowed boolean")
    files.write_chunks(chunks, str(tmp_path / "json"))
    back = spark.read.json(str(tmp_path / "json")).first()
    assert back["metadata"]["chapter"] == "A" and back["content"]["en"] == "text"
    files.write_report(chunks, str(tmp_path / "report"))
    shown = "\n".join(r[0] for r in spark.read.text(str(tmp_path / "report")).select("value").collect())
    assert "(No Arabic content)" in shown and "Chapter: A" in shown and "Section" not in shown and "Embedding Allowed: True" in shown
    assert chunks.select(files.report_name(F.col("document"), F.to_timestamp(F.lit("2024-01-02 03:04:05")))).first()[0] == "Book_20240102_030405.txt"


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.json").write_text(json.dumps(PAGES))
    query = streaming.stream_chunks(streaming.stream_pages(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"), once=True)
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() >= 1


def test_comparison(spark):
    df = spark.createDataFrame([("one two three", "one two three"), ("نص كامل وطويل", "abc"), ("x", None)], "a string, b string")
    got = [r[0] for r in df.select(evaluate.compare(F.col("a"), F.col("b"))).collect()]
    assert got[0]["similarity"] == 100 and got[0]["issues"] == [] and got[2]["similarity"] == 0 and got[2]["issues"] == []
    assert got[1]["issues"] == ["Significant length difference: 76.9%", "Arabic text missing in extraction"]
