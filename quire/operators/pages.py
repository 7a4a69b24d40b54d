"""Reading order, page filters and plain-text output (SRC-6, WIN-1, WIN-2, FLT-1, FLT-2, SNK text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as X


def two_columns(blocks: DataFrame, width: Column | float, keys: tuple[str, ...] = ("doc_id", "pno")) -> DataFrame:
    """WIN-2: flag ``two_col``: no more than 0.15 narrow blocks across the middle, and over 0.6 of them on one side."""
    w = Window.partitionBy(*keys)
    width = width if isinstance(width, Column) else F.lit(float(width))
    mid = width / 2
    across = (F.col("x0") < mid - 10) & (F.col("x1") > mid + 10) & (F.col("x1") - F.col("x0") < width * 0.6)
    left = (F.col("x0") + F.col("x1")) / 2 < mid
    n, k, m = F.count("*").over(w), F.sum(across.cast("int")).over(w), F.sum(left.cast("int")).over(w)
    return blocks.withColumn("two_col", ~((k > 0) & (k > 0.15 * n)) & (F.greatest(m, n - m) > 0.6 * n))


def reading_order(blocks: DataFrame, width: Column | float, keys: tuple[str, ...] = ("doc_id", "pno"), tie: str = "ln") -> DataFrame:
    """WIN-1: ``ord`` from 1 in a page: by (y, x), in pages of two columns the left one first."""
    b = two_columns(blocks, width, keys)
    width = width if isinstance(width, Column) else F.lit(float(width))
    late = F.when(F.col("two_col") & ((F.col("x0") + F.col("x1")) / 2 >= width / 2), 1).otherwise(0)
    return b.withColumn("ord", F.row_number().over(Window.partitionBy(*keys).orderBy(late, "y0", "x0", tie)))


def plain_text(blocks: DataFrame, width: Column | float) -> DataFrame:
    """SRC-6: (doc_id, pages, chars, text): blocks in reading order, a blank line between, [PAGE n] before each page."""
    b = reading_order(blocks, width).withColumn("body", F.trim("line")).where(F.length("body") > 0)
    page = b.groupBy("doc_id", "pno").agg(F.sum(F.length("body")).alias("chars"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "body"))), lambda x: x["body"]), "\n\n").alias("text"))
    whole = page.groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum("chars").alias("chars"), F.array_sort(F.collect_list(F.struct("pno", "text"))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: F.concat(F.lit("[PAGE "), (x["pno"] + 1).cast("string"), F.lit("]\n\n"), x["text"])), "\n\n")
    return whole.select("doc_id", "pages", "chars", text.alias("text"))


def without_cover(pages: DataFrame) -> DataFrame:
    """FLT-1: first pages with a cover marker go."""
    cover = F.lit(False)
    for m in X.COVER_MARKERS:
        cover = cover | F.coalesce(F.contains("text", F.lit(m)), F.lit(False))
    return pages.where(~((F.col("pno") == 0) & cover))


def is_margin(y0: Column, y1: Column, t: Column, height: Column | float, margin: float = 45.0) -> Column:
    """FLT-2: a short block that lies in the upper or lower margin."""
    return ((y1 < margin) | (y0 > height - margin)) & (F.length(t) < 80)


def needs_ocr(pages: DataFrame) -> DataFrame:
    """SRC-7's choice: pages without text that hold an image."""
    return pages.where((F.trim(F.coalesce("text", F.lit(""))) == "") & (F.col("n_images") > 0))


def cjk_gate(paragraphs: DataFrame, first: int = 300, share: float = 0.2) -> DataFrame:
    """FLT-23: (doc_id, cjk, rejected) from the first paragraphs of each document."""
    w = Window.partitionBy("doc_id").orderBy("pno", "seq")
    head = paragraphs.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= first)
    s = X.solid(F.coalesce("text", F.lit("")))
    agg = head.groupBy("doc_id").agg(F.sum(X.count_of(s, X.CJK)).alias("wide"), F.sum(F.length(s)).alias("all"))
    return agg.select("doc_id", (F.col("wide") / F.greatest("all", F.lit(1))).alias("cjk"), (F.col("wide") > share * F.greatest("all", F.lit(1))).alias("rejected"))


def bibliography_pages(blocks: DataFrame, first: int = 120) -> DataFrame:
    """FLT-19: (doc_id, pno) of pages where max(3, a quarter) of the first blocks cite."""
    w = Window.partitionBy("doc_id", "pno").orderBy("ln")
    head = blocks.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= first)
    got = head.groupBy("doc_id", "pno").agg(F.count_if(X.cites(F.col("line"))).alias("hits"), F.count("*").alias("n"))
    return got.where(F.col("hits") >= F.greatest(F.lit(3), F.floor(0.25 * F.col("n")))).select("doc_id", "pno")


def pages_in(blocks: DataFrame, spec: Column, pages: Column, strict: bool = True) -> DataFrame:
    """SRC-2 with a spec and a number of pages in each row."""
    return blocks.where(F.array_contains(X.page_spec(spec, pages, strict), F.col("pno")))


def only_pages(blocks: DataFrame, spec: str, pages: int, strict: bool = True) -> DataFrame:
    """SRC-2 with one spec for all: a list of page numbers, which scans of Parquet and ``pdf_spans`` take as a filter."""
    wanted = blocks.sparkSession.range(1).select(X.page_spec(F.lit(spec), F.lit(pages), strict).alias("p")).first()["p"]
    return blocks.where(F.col("pno").isin(wanted))
