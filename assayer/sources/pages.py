"""Texts of pages: cleaning, dehyphenation, and chunks that keep their page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import segment


def _stamped(lines: Column) -> Column:
    """Lines without a stamp of more than five leading lines of one or two characters."""
    short = lambda x: (F.length(F.trim(x)) <= 2) & (F.trim(x) != "")
    first = F.array_position(F.transform(lines, short), False)
    lead = F.when(first > 0, first - 1).otherwise(F.size(lines)).cast("int")
    return F.when(lead > 5, F.slice(lines, lead + 1, F.greatest(F.size(lines) - lead, F.lit(0)))).otherwise(lines)


def _respaced(line: Column) -> Column:
    """Blanks between words that were run together: long lines with hardly any blank."""
    t = F.trim(line)
    solid = F.length(F.replace(t, F.lit(" "), F.lit("")))
    wide = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "([a-z])([A-Z])", "$1 $2"), r"([a-zA-Z])(\d)", "$1 $2"), r"(\d)([a-zA-Z])", "$1 $2")
    return F.when((solid > 40) & (F.length(t) - solid < solid * 0.05), wide).otherwise(t)


def clean(text: Column) -> Column:
    """Page text without stamps, run-together words, ligatures and surplus blanks; paragraphs stay."""
    lines = F.transform(_stamped(F.split(text, "\n")), _respaced)
    out = F.array_join(lines, "\n")
    for ligature, letters in (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff")):
        out = F.replace(out, F.lit(ligature), F.lit(letters))
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[^\S\n]+", " "), r"\n{3,}", "\n\n"))


def dehyphenated(text: Column) -> Column:
    return F.regexp_replace(text, r"-\s*\n\s*", "")


def ordered_blocks(blocks: DataFrame) -> DataFrame:
    """Text blocks (source_id, page, x0, y0, text) in reading order, dehyphenated, without empty ones."""
    text = F.trim(dehyphenated(F.col("text")))
    place = Window.partitionBy("source_id").orderBy("page", "y0", "x0", "text")
    return blocks.withColumn("text", text).where("text <> ''").withColumn("block", F.row_number().over(place) - 1)


def table_text(tables: DataFrame) -> DataFrame:
    """Tables (source_id, page, ord, rows of cells) as lines with bars; ids count per page."""
    place = Window.partitionBy("source_id", "page").orderBy("ord")
    text = F.array_join(F.transform("rows", lambda r: F.array_join(F.transform(r, lambda c: F.trim(F.coalesce(c, F.lit("")))), " | ")), "\n")
    table = F.concat_ws("_", F.lit("pdf_table"), "page", (F.row_number().over(place) - 1).cast("string"))
    return tables.withColumn("table_id", table).withColumn("text", text).drop("rows")


def paged_chunks(pages: DataFrame, size: int = 1000, overlap: int = 100) -> DataFrame:
    """Sentence chunks of pages (source_id, page, text): places within the page, numbers within the source."""
    chunks = segment.sentences(pages, "text", size, overlap)
    place = Window.partitionBy("source_id").orderBy("page", "sentence_index")
    numbered = chunks.withColumn("chunk_index", F.row_number().over(place) - 1)
    return numbered.select("source_id", "page", "chunk_index", F.concat("source_id", F.lit("_chunk_"), F.col("chunk_index").cast("string")).alias("chunk_id"), F.col("sentence").alias("text"), "start_char", "end_char")
