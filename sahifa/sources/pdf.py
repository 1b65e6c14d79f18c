"""PDF files as pages, by libraries that need not be installed: text layer (PyMuPDF), tables and recognition.

Everything row-wise in a page's reading order happens in Arrow workers, a file at a time; what follows (pairing,
headings, normalisation) is the operators' work. A page limit is applied inside the worker, as Spark can't push it
there, and only pages that have too little embedded text are rendered and recognised. A page that fails is a row
with its error, so one file doesn't end a job.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sahifa.cluster import expose
from sahifa.config import OcrConfig
from sahifa.functions.language import lines_by_language
from sahifa.functions.normalise import arabic_scanned, english_scanned_basic
from sahifa.functions.text import or_empty, present, strip, table_lines, table_markdown
from sahifa.operators.classify import by_position, by_text, is_toc_page
from sahifa.operators.headings import fill_page_headings
from sahifa.sources.text import as_blocks

TEXT_ROWS = "doc_id string, page_number int, height double, page_text string, kind string, i int, text string, cells array<array<string>>, x0 double, y0 double, x1 double, y1 double, error string"
SCAN_ROWS = "doc_id string, page_number int, height double, embedded string, recognised string, mode string, table_index int, cells array<array<string>>, error string"
#: How a page's image is prepared for recognition, and how the recogniser is called.
BILATERAL, ADAPTIVE, OPENING = (7, 35, 35), (35, 11), (2, 2)
LANGUAGES, ENGINE = "ara+eng", "--oem 1 --psm 6"


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """Files whose names end in .pdf, in any case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.filter(F.lower("path").endswith(".pdf")).select(F.col("path").alias("doc_id"), "content")


def text_rows(max_pages: int | None = None):
    """A worker that gives a row for each text block and table of each page, in reading order."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import fitz

        for frame in frames:
            for doc_id, content in zip(frame["doc_id"], frame["content"], strict=True):
                rows = []
                with fitz.open(stream=bytes(content), filetype="pdf") as doc:
                    for number, page in enumerate(doc, start=1):
                        if max_pages and number > max_pages:
                            break
                        base = {"doc_id": doc_id, "page_number": number, "height": float(page.rect.height), "page_text": page.get_text("text") or ""}
                        blocks = [b for b in page.get_text("blocks", sort=True) if len(b) >= 7 and b[6] == 0 and b[4].strip()]
                        rows += [base | {"kind": "text", "i": i, "text": b[4], **dict(zip(("x0", "y0", "x1", "y1"), map(float, b[:4]), strict=True))} for i, b in enumerate(blocks)]
                        try:
                            tables = page.find_tables().tables
                            for i, t in enumerate(tables):
                                rows.append(base | {"kind": "table", "i": i, "cells": t.extract(), **dict(zip(("x0", "y0", "x1", "y1"), map(float, t.bbox), strict=True))})
                        except Exception as failed:  # a page whose tables can't be read keeps its text
                            rows.append(base | {"kind": "error", "i": 0, "error": str(failed)})
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in TEXT_ROWS.split(", ")])

    return run


def text_layer_blocks(rows: DataFrame) -> DataFrame:
    """Rows of ``text_rows`` to blocks: typed by position, Arabic and mixed text as ``ar``, tables after texts."""
    toc = is_toc_page(F.col("page_text"))
    text = F.when(F.col("kind") == "table", F.coalesce(table_lines(F.col("cells")), F.lit(""))).otherwise(strip(or_empty(F.col("text"))))
    found = rows.filter("kind <> 'error'").withColumn("_text", text).filter("_text <> ''")
    kind = by_position(F.col("y0"), F.col("height"), toc, F.when(F.col("kind") == "table", "table").otherwise("paragraph"))
    is_english = F.col("_text").rlike("[A-Za-z]") & ~F.col("_text").rlike("[؀-ۿ]")
    seq = F.when(F.col("kind") == "table", F.lit(100_000)).otherwise(F.lit(0)) + F.col("i")
    return as_blocks(found.withColumn("type", kind).withColumn("block_seq", seq).withColumn("ar", F.when(~is_english, F.col("_text"))).withColumn("en", F.when(is_english, F.col("_text"))))


def prepared(image):
    """A page's image in black and white, without noise (OpenCV)."""
    import cv2
    import numpy as np

    grey = cv2.cvtColor(np.array(image.convert("RGB")), cv2.COLOR_RGB2GRAY)
    smooth = cv2.bilateralFilter(grey, *BILATERAL)
    binary = cv2.adaptiveThreshold(smooth, 255, cv2.ADAPTIVE_THRESH_GAUSSIAN_C, cv2.THRESH_BINARY, *ADAPTIVE)
    return cv2.morphologyEx(binary, cv2.MORPH_OPEN, np.ones(OPENING, np.uint8))


def recognise(image) -> str:
    """Text of an image; if the prepared image fails, of the image as it is."""
    import pytesseract

    try:
        return pytesseract.image_to_string(prepared(image), lang=LANGUAGES, config=ENGINE)
    except Exception:  # noqa: BLE001
        return pytesseract.image_to_string(image, lang=LANGUAGES, config=ENGINE)


def text_density(image) -> float:
    """Share of an image's points that are dark."""
    import numpy as np

    return float((np.array(image.convert("L")) <= 180).mean())


def scan_rows(config: OcrConfig, honour_threshold: bool = False):
    """A worker that gives each page's embedded or recognised text, and a row for each table by lines and by text."""
    threshold = config.threshold if honour_threshold else OcrConfig.threshold

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pdfplumber

        for frame in frames:
            for doc_id, content in zip(frame["doc_id"], frame["content"], strict=True):
                rows = []
                with pdfplumber.open(io.BytesIO(bytes(content))) as doc:
                    for page in doc.pages[: config.max_pages] if config.max_pages else doc.pages:
                        base = {"doc_id": doc_id, "page_number": page.page_number, "height": float(page.height or 792)}
                        embedded = (page.extract_text() or "").strip()
                        try:
                            found = None if len(embedded) >= threshold else recognise(page.to_image(resolution=config.dpi).original)
                            rows.append(base | {"embedded": embedded, "recognised": found})
                        except Exception as failed:  # noqa: BLE001
                            rows.append(base | {"embedded": embedded, "error": str(failed)})
                        for mode in ("lines", "text"):
                            try:
                                tables = page.extract_tables({"vertical_strategy": mode, "horizontal_strategy": mode})
                            except Exception:  # noqa: BLE001, S112
                                continue
                            for i, table in enumerate(tables):
                                rows.append(base | {"mode": mode, "table_index": i, "cells": [[(c or "").strip() for c in r] for r in table]})
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCAN_ROWS.split(", ")])

    return run


def page_texts(text: Column) -> Column:
    """A page's text as Arabic, English and mixed lines, the first two normalised."""
    parts = lines_by_language(text)
    join = lambda c: F.array_join(parts[c], "\n")
    return F.struct(arabic_scanned(join("ar")).alias("ar"), english_scanned_basic(join("en")).alias("en"), join("mixed").alias("mixed"))


def scanned_blocks(rows: DataFrame) -> DataFrame:
    """Rows of ``scan_rows`` to blocks: a page's tables, then its text, then its mixed lines, with headings carried on."""
    pages = rows.filter("mode IS NULL").withColumn("t", page_texts(F.coalesce("recognised", "embedded"))).select("doc_id", "page_number", "height", "t.*")
    pages = fill_page_headings(pages.withColumn("text", F.concat_ws(" ", "ar", "en", "mixed")))
    kind = by_text(F.col("text"), F.lit(False), F.lit(None).cast("double"), F.col("height"))
    body = pages.filter((F.col("ar") != "") | (F.col("en") != "")).select("doc_id", "page_number", F.lit(1_000_000).alias("block_seq"), kind.alias("type"), present(F.col("ar")).alias("ar"), present(F.col("en")).alias("en"), "chapter", "section")
    mixed = pages.filter("mixed <> ''").select("doc_id", "page_number", F.lit(1_000_001).alias("block_seq"), F.lit("paragraph").alias("type"), F.col("mixed").alias("ar"), F.lit(None).cast("string").alias("en"), "chapter", "section")
    heads = pages.select("doc_id", "page_number", F.col("table_chapter").alias("chapter"), F.col("table_section").alias("section"))
    order = F.when(F.col("mode") == "lines", 0).otherwise(100_000) + F.col("table_index")
    tables = rows.filter("mode IS NOT NULL").select("doc_id", "page_number", order.alias("block_seq"), F.lit("table").alias("type"), table_markdown(F.col("cells")).alias("ar"), F.lit(None).cast("string").alias("en")).join(heads, ["doc_id", "page_number"])
    return as_blocks(tables.unionByName(body).unionByName(mixed))


def read_text_layer(spark: SparkSession, path: str, max_pages: int | None = None) -> DataFrame:
    """Blocks of the text layer of PDF files; needs PyMuPDF on the workers."""
    expose(spark)
    return text_layer_blocks(pdf_files(spark, path).mapInPandas(text_rows(max_pages), TEXT_ROWS))


def read_scanned(spark: SparkSession, path: str, config: OcrConfig = OcrConfig(), honour_threshold: bool = False) -> DataFrame:
    """Blocks of scanned PDF files; needs pdfplumber, OpenCV and Tesseract on the workers."""
    expose(spark)
    return scanned_blocks(pdf_files(spark, path).mapInPandas(scan_rows(config, honour_threshold), SCAN_ROWS))
