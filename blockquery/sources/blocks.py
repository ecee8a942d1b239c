"""Text, mark-up and table rows to typed layout blocks.

A block's place comes from its position in the split text, so no window and no
shuffle numbers it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockquery.functions.text import short_hash, trimmed


def text_parts(text: Column) -> Column:
    """Non-empty trimmed parts: by blank lines, or by lines if that gives at most one part."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n", "\n"), "\r", "\n")

    def kept(pattern: str) -> Column:
        return F.filter(F.transform(F.split(plain, pattern), trimmed), lambda p: p != "")

    paragraphs = kept("\n{2,}")
    return F.when(F.size(paragraphs) > 1, paragraphs).otherwise(kept("\n"))


def text_blocks(docs: DataFrame, *keep: str, page: int = 1) -> DataFrame:
    """(doc_id, kept columns, page, reading_order, text, block_id, confidence, block_type, section_label)."""
    parts = docs.select("doc_id", *keep, F.posexplode(text_parts(F.col("text"))).alias("at", "text"))
    order = (F.col("at") + 1).cast("int")
    return parts.select(
        "doc_id",
        *keep,
        F.lit(page).alias("page"),
        order.alias("reading_order"),
        "text",
        block_id(order, F.lit(page), F.col("text")).alias("block_id"),
        F.lit(0.98).alias("confidence"),
        F.lit("text").alias("block_type"),
    )


def block_id(order: Column, page: Column, text: Column) -> Column:
    """b0001-1a2b3c4d: order and a short hash of page, place and text."""
    place = F.when(F.length(order.cast("string")) < 4, F.lpad(order.cast("string"), 4, "0")).otherwise(order.cast("string"))
    return F.concat(F.lit("b"), place, F.lit("-"), short_hash(page.cast("string"), order.cast("string"), text))


def markdown_blocks(docs: DataFrame) -> DataFrame:
    """One block a line; heading, bullet and number prefixes go, table separators are dropped, pipes make cells."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\r?\n")).alias("line_no", "raw"))
    raw = trimmed(F.col("raw"))
    is_table = F.instr(raw, "|") > 0
    body = trimmed(F.regexp_replace(raw, r"^(#{1,6}\s+|[-*+]\s+|[0-9]+[.)]\s+)", ""))
    cells = F.filter(F.transform(F.split(raw, r"\|"), trimmed), lambda c: c != "")
    text = F.when(is_table, F.array_join(cells, " | ")).otherwise(body)
    kind = F.when(raw.rlike(r"^#{1,6}\s+"), "title").when(is_table, "table").otherwise("paragraph")
    return (
        lines.where(~raw.rlike(r"^[\s|:-]*$"))
        .select("doc_id", F.col("line_no").cast("int").alias("line_no"), text.alias("text"), kind.alias("block_type"), F.size(cells).alias("n_cells"))
        .where("text <> ''")
    )
