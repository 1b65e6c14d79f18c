"""Operators on small tables, against hand-made results and against plain loops."""

import random

from pyspark.sql import functions as F

from sahifa.config import ChunkConfig
from sahifa.operators import chunking, headings, merging, pairing, quality
from sahifa.plans import services

BLOCK = "doc_id string, page_number int, block_seq int, type string, ar string, en string, chapter string, section string"
BOX = "doc_id string, page_number int, block_seq int, type string, ar string, en string, x0 double, y0 double, x1 double, y1 double"
CHUNK = "doc_id string, part int, page_number int, block_seq int, i int, chunk_id string, ar string, en string, chapter string, section string, page_start int, page_end int, chunk_type string, language array<string>, embedding_allowed boolean"


def blocks(spark, rows):
    return spark.createDataFrame([("d", *r) for r in rows], BLOCK)


def test_headings_carry_on_and_a_chapter_ends_its_section(spark):
    rows = [(1, 0, "header", None, "Chapter 1 : One", None, None), (1, 1, "header", None, "Section 1 : S", None, None), (1, 2, "paragraph", "x", None, None, None), (2, 0, "header", None, "Chapter 2 : Two", None, None), (2, 1, "paragraph", "y", None, None, None)]
    got = headings.fill_headings(blocks(spark, rows)).orderBy("page_number", "block_seq").select("chapter", "section").collect()
    assert [tuple(r) for r in got] == [("One", None), ("One", "S"), ("One", "S"), ("Two", None), ("Two", None)]


def test_tables_of_scanned_pages_have_the_headings_before(spark):
    pages = spark.createDataFrame([("d", 1, "Chapter 1 : A"), ("d", 2, "Chapter 2 : B")], "doc_id string, page_number int, text string")
    got = headings.fill_page_headings(pages).orderBy("page_number").select("chapter", "table_chapter").collect()
    assert [tuple(r) for r in got] == [("A", None), ("B", "A")]


def test_lines_merge(spark):
    df = spark.createDataFrame([("نص\nتابع.\nجديد\n1. بند",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(merging.merge_lines(F.col("t"))).collect()] == ["نص تابع.\nجديد\n1. بند", "", ""]


def test_pairs_are_greedy_in_order(spark):
    rows = [("d", 1, 0, "paragraph", "a1", None, 90.0, 0.0, 110.0, 10.0), ("d", 1, 1, "paragraph", "a2", None, 80.0, 5.0, 100.0, 10.0), ("d", 1, 2, "paragraph", None, "e1", 70.0, 0.0, 90.0, 10.0), ("d", 1, 3, "table", None, "t", 0.0, 0.0, 9.0, 9.0)]
    df = spark.createDataFrame(rows, BOX)
    assert [tuple(r) for r in pairing.greedy_pairs(pairing.aligned_pairs(df)).collect()] == [("d", 1, 0, 2)]
    got = pairing.pair_blocks(df).orderBy("rank", "block_seq").select("ar", "en", "x0", "x1").collect()
    assert [tuple(r) for r in got] == [("a1", "e1", 70.0, 110.0), ("a2", None, 80.0, 100.0), (None, "t", 0.0, 9.0)]


def test_alignment_touches_or_is_near(spark):
    def near(a, b):
        rows = [("d", 1, 0, "paragraph", "a", None, 0.0, float(a[0]), 1.0, float(a[1])), ("d", 1, 1, "paragraph", None, "e", 0.0, float(b[0]), 1.0, float(b[1]))]
        return pairing.aligned_pairs(spark.createDataFrame(rows, BOX)).count() == 1

    assert [near((0, 10), b) for b in ((10, 20), (11, 21), (12, 30))] == [True, False, False] and near((0, 2), (3, 5))


def test_fragments_join(spark):
    rows = [(1, 0, "paragraph", "نص غير مكتمل", None, None, None), (1, 1, "paragraph", "، تتمة", None, None, None), (1, 2, "paragraph", "انتهى.", None, None, None), (1, 3, "paragraph", "جديد", None, None, None)]
    got = merging.repair_fragments(blocks(spark, rows)).orderBy("block_seq").select("ar").collect()
    assert [r[0] for r in got] == ["نص غير مكتمل تتمة انتهى.", "جديد"]


def repaired(rows):
    """The repair as a loop: rows are (page, type, ar, en)."""
    out = []
    for page, kind, ar, en in rows:
        a, e = (ar or "").strip(), (en or "").strip()
        if out:
            last = out[-1]
            current = (last["ar"] or "").strip()
            ends = current[-1:] in (".", "!", "؟")
            marked = a[:1] in tuple(".،…:;")
            loose = not e and (len(a) < 30 or not ("؀" <= a[0] <= "ۿ" or "A" <= a[0] <= "Z") or a[0] in "و،ف") if a else False
            if last["page"] == page and last["kind"] == kind == "paragraph" and current and a and not ends and (marked or loose):
                rest = a[1:].lstrip() if marked else a
                last["parts"].append(rest)
                last["ar"] = " ".join(last["parts"])
                continue
        out.append({"page": page, "kind": kind, "ar": ar, "parts": [a]})
    return [(b["page"], b["kind"], b["ar"]) for b in out]


def test_fragments_equal_the_loop(spark):
    rng = random.Random(3)
    texts = [None, "", "،", ".", "، تتمة", "نص.", "نص", "و نص", "ab", "كلمات كثيرة جدا هنا في سطر طويل لا ينتهي أبدا أبدا", ":", "؟", " نص "]
    rows = [(1 + i // 40, rng.choice(["paragraph"] * 4 + ["table"]), rng.choice(texts), rng.choice([None, None, "en"])) for i in range(400)]
    df = blocks(spark, [(p, i, k, a, e, None, None) for i, (p, k, a, e) in enumerate(rows)])
    got = [tuple(r) for r in merging.repair_fragments(df).orderBy("block_seq").select("page_number", "type", "ar").collect()]
    assert got == repaired(rows)


def test_sections_merge(spark):
    rows = [(1, 0, "paragraph", "a", "x", "A", "s1"), (2, 0, "paragraph", None, "y", "A", "s1"), (2, 1, "table", "t", None, "A", "s1"), (2, 2, "paragraph", "b", None, "A", "s1"), (2, 3, "paragraph", "c", None, "B", None)]
    got = merging.merge_sections(blocks(spark, rows)).orderBy("page_number", "block_seq").select("type", "ar", "en", "page_end").collect()
    assert [tuple(r) for r in got] == [("paragraph", "a", "x\ny", 2), ("table", "t", None, None), ("paragraph", "b", None, None), ("paragraph", "c", None, None)]


def small_merged(rows, least=30):
    """The merge of small chunks as a loop: rows are (words, section, kind)."""
    out, skip = [], False
    for i, (n, section, kind) in enumerate(rows):
        if skip:
            skip = False
            continue
        if n >= least:
            out.append([[i], kind, section, True])
        elif out and out[-1][2] == section and out[-1][1] == "narrative":
            out[-1][0].append(i)
        elif i + 1 < len(rows) and rows[i + 1][1] == section:
            out.append([[i, i + 1], kind, section, True])
            skip = True
        else:
            out.append([[i], kind, section, False])
    return [(g[0], g[1], g[3]) for g in out]


def test_small_chunks_equal_the_loop(spark):
    rng = random.Random(5)
    rows = [(rng.choice([5, 5, 40]), rng.choice(["s", "t", None]), rng.choice(["narrative", "narrative", "table", "glossary"])) for _ in range(300)]
    text = lambda i, n: " ".join([f"w{i}"] * n)
    df = spark.createDataFrame([("d", 0, 1, i, 0, f"c{i}", text(i, n), None, "A", s, 1, 1, k, ["ar"], True) for i, (n, s, k) in enumerate(rows)], CHUNK)
    got = chunking.merge_small(df).orderBy("block_seq").select("ar", "chunk_type", "embedding_allowed").collect()
    assert [tuple(r) for r in got] == [("\n\n".join(text(i, rows[i][0]) for i in g), k, e) for g, k, e in small_merged(rows)]


def test_chunks_of_a_document(spark):
    long = "Sentence of words number one here. " * 12
    rows = [(1, 0, "header", None, "Chapter 1 : A", "A", None), (1, 1, "paragraph", None, long, "A", None), (1, 2, "table", "a\tb", None, "A", None), (2, 0, "toc", None, "x", "A", None)]
    got = chunking.chunk_blocks(blocks(spark, rows)).orderBy("chunk_seq").collect()
    # The rest of the text and the table are small, so both join the first chunk.
    assert [(r["chunk_id"], r["ar"], r["chunk_type"], r["document"]) for r in got] == [("yearbook2025_a_unknown_p1_merged", "a\tb", "narrative", ChunkConfig.document_name)]
    assert got[0]["en"].count("Sentence") == 12
    assert chunking.chunk_blocks(blocks(spark, [])).count() == 0


def test_issues(spark):
    rows = [("d", 0, "a", "same english text", "same english text", None, None, "narrative", True), ("d", 1, "a", None, " ".join(["w"] * 30), "A", None, "narrative", True), ("d", 2, "b", "اجل", None, "A", None, "toc", None)]
    df = spark.createDataFrame(rows, "doc_id string, chunk_seq int, chunk_id string, ar string, en string, chapter string, section string, chunk_type string, embedding_allowed boolean")
    got = sorted((r["chunk_seq"], r["issue"]) for r in quality.chunk_issues(df).collect())
    assert got == [(0, "fake_bilingual"), (0, "fake_bilingual"), (0, "low_information"), (0, "missing_metadata"), (1, "duplicate_ids"), (2, "broken_arabic"), (2, "missing_embedding_flag"), (2, "toc_leakage")]
    report = {r["issue"]: (r["n"], r["examples"], r["passed"]) for r in quality.issue_report(quality.chunk_issues(df)).collect()}
    assert report["fake_bilingual"] == (2, "a, a", False) and set(report) == set(quality.ISSUES)


def test_scanned_blocks_run_on(spark):
    rows = [(1, 0, "paragraph", "سطر", None, "A", None), (1, 1, "footer", "تابع.", None, "A", None), (1, 2, "paragraph", "عربي", "English", "A", None), (2, 0, "paragraph", "جديد", None, "A", None), (2, 1, "table", "t", "lost", "A", None)]
    got = merging.merge_scanned(blocks(spark, rows)).orderBy("page_number", "block_seq", "part").select("type", "ar", "en").collect()
    assert [tuple(r) for r in got] == [("footer", "سطر تابع.", None), ("paragraph", None, "English"), ("paragraph", "عربي", None), ("paragraph", "جديد", None), ("table", "t", None)]


def test_partitions_do_not_matter(spark, sf_dir):
    from sahifa.plans.views import Views

    seen = set()
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        rows = services.chunk(services.normalise(Views(spark, sf_dir).headed.drop("x0", "y0", "x1", "y1"))).collect()
        seen.add(tuple(sorted(map(repr, rows))))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(seen) == 1
