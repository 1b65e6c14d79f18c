"""Blocks from simple HTML: menu, headings, paragraphs and footer by their tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sahifa.functions.text import or_empty
from sahifa.sources.text import as_blocks

ELEMENT = r"(?is)<(nav|h1|p|footer)(?:\s[^>]*)?>(.*?)(?=</\1>|<p>|</article>|\z)"
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def plain(html: Column) -> Column:
    """Text of a piece of HTML: tags are spaces, common entities are decoded, white space is single."""
    text = F.regexp_replace(html, "<[^>]*>", " ")
    for entity, character in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(character))
    return F.btrim(F.regexp_replace(text, r"\s+", " "))


def html_blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """A page as a document of one page; nav is contents, h1 header, footer footer, and the rest paragraphs."""
    found = F.regexp_extract_all(or_empty(F.col(html_col)), F.lit(ELEMENT), F.lit(0))
    rows = pages.select(F.col(id_col).cast("string").alias("doc_id"), F.posexplode(found).alias("block_seq", "piece"))
    tag = F.lower(F.regexp_extract("piece", r"^<(\w+)", 1))
    kind = F.when(tag == "nav", "toc").when(tag == "h1", "header").when(tag == "footer", "footer").otherwise("paragraph")
    return as_blocks(rows.withColumn("en", plain(F.col("piece"))).filter("en <> ''").withColumn("type", kind).withColumn("page_number", F.lit(1)))
