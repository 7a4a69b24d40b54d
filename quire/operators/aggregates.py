"""Document statistics, censuses, modes, order statistics and job summaries (AGG-1 to AGG-15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as X

# Names of fonts for mathematics, and of text fonts used in it.
MATH_FONTS = "(?i)CMMI|CMSY|CMSX|CMSL|MSMI|MSBM|NewTXMI|txsy|txmia|txexs|CambriaMath|DejaVuMath|LatinMath|MathItalic|XITSMath|stix2math|LatinModernMath|Symbol|Math|CMEX|MTMi|MTSy|MTEx|MSAM|Euclid|Rsfs|Wingding|MTFont|MTH"
TEXT_FONTS = "^(?:\\w{6}\\+)?(?:CM(?:R\\d*|BX|TI|SY|EX|MI|S\\d*)|CMS\\w+)$"


def doc_stats(paragraphs: DataFrame) -> DataFrame:
    """AGG-1: counts of a document's pages, paragraphs, translatable ones, formulas, references and skipped ones."""
    return paragraphs.groupBy("doc_id").agg(
        F.countDistinct("pno").alias("pages"), F.count("*").alias("paragraphs"), F.count_if("translatable").alias("translatable"),
        F.count_if("is_math").alias("math"), F.count_if("is_ref").alias("refs"), F.count_if("is_skip").alias("skipped"),
    )


def font_census(spans: DataFrame) -> DataFrame:
    """AGG-2: (doc_id, font, chars, dense, share, density, is_math) by the characters set in each font."""
    dense = X.count_of(F.col("text"), f"[\\p{{Sm}}\\p{{Co}}\\p{{Nd}}{X.MATH_CLASS}.,%()]")
    some = spans.where(F.length(X.solid(F.col("text"))) > 0)
    by = some.groupBy("doc_id", F.coalesce(F.nullif("font", F.lit("")), F.lit("?")).alias("font")).agg(F.sum(F.length("text")).alias("chars"), F.sum(dense).alias("dense"))
    by = by.withColumn("share", F.col("chars") / F.sum("chars").over(Window.partitionBy("doc_id"))).withColumn("density", F.col("dense") / F.col("chars"))
    rare = F.col("font").rlike(TEXT_FONTS) & (F.col("share") < 0.15)
    return by.withColumn("is_math", F.col("font").rlike(MATH_FONTS) | rare | (~F.col("font").rlike(TEXT_FONTS) & (F.col("share") < 0.06) & (F.col("density") > 0.75)))


def weighted_mode(rows: DataFrame, keys: list[str], value: Column, weight: Column, order: str) -> DataFrame:
    """AGG-3: per key the value of the largest total weight; of equal ones the one seen first."""
    by = rows.groupBy(*keys, value.alias("value")).agg(F.sum(weight).alias("weight"), F.min(order).alias("first"))
    top = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("weight"), "first"))
    return by.withColumn("_k", top).where("_k = 1").select(*keys, "value", "weight")


def body_size(mode: Column, shrink: Column) -> Column:
    """AGG-3's use: at least 6, 7 without any."""
    return F.coalesce(F.greatest(F.lit(6.0), mode - shrink), F.lit(7.0))


def floor_rank(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """AGG-4, AGG-5: exact order statistics v[min(floor(share * n), n - 1)] per key.

    Ranks come from counts per distinct value, so a key's rows are never gathered.
    """
    by = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*keys)
    by = by.withColumn("up", F.sum("c").over(w.orderBy(value))).withColumn("n", F.sum("c").over(w))
    at = lambda s: F.least(F.floor(F.col("n") * s), F.col("n") - 1)
    return by.groupBy(*keys).agg(F.max("n").alias("n"), *[F.min(F.when(F.col("up") > at(s), F.col(value))).alias(name) for name, s in shares.items()])


def line_style(spans: DataFrame) -> DataFrame:
    """AGG-14, AGG-15: per line the mean size weighted by length, and whether most characters are bold or italic."""
    n = F.greatest(F.length("text"), F.lit(1))
    return spans.groupBy("doc_id", "pno", "block_no", "line_no").agg(
        (F.sum(F.col("size") * n) / F.sum(n)).alias("size"),
        (F.sum(F.when(F.col("font").rlike("(?i)Bold|Medi|Bd\\b|Black|Bk\\b"), F.length("text")).otherwise(0)) > 0.5 * F.sum(F.length("text"))).alias("is_bold"),
        (F.sum(F.when(F.col("font").rlike("(?i)Ital"), F.length("text")).otherwise(0)) > 0.5 * F.sum(F.length("text"))).alias("is_italic"),
    )


def bounds(rows: DataFrame, keys: list[str]) -> DataFrame:
    """AGG-11."""
    return rows.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def ink(rows: DataFrame, keys: list[str], least: float = 0.06) -> DataFrame:
    """AGG-12: sum of areas over the common bounds' area, with ``dense`` from ``least`` on."""
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    by = rows.groupBy(*keys).agg(F.sum(area).alias("inked"), ((F.max("x1") - F.min("x0")) * (F.max("y1") - F.min("y0"))).alias("box"))
    return by.withColumn("ink", F.when(F.col("box") > 0, F.col("inked") / F.col("box")).otherwise(0.0)).withColumn("dense", F.col("ink") >= least)


def job_summary(jobs: DataFrame) -> DataFrame:
    """AGG-7, AGG-8: counts by status, mean progress, and the board's status."""
    by = jobs.agg(F.count_if(F.col("status") == "running").alias("running"), F.count_if(F.col("status") == "done").alias("done"), F.count_if(~F.col("status").isin("running", "done")).alias("failed"), F.coalesce(F.avg("progress"), F.lit(0.0)).alias("progress"))
    return by.withColumn("overall", F.when(F.col("running") > 0, "running").when(F.col("failed") > 0, "failed").when(F.col("done") > 0, "done").otherwise("idle"))


def mass_failures(translations: DataFrame, share: float = 0.7) -> DataFrame:
    """AGG-10: per document whether failed ones reach max(2, floor(share * all))."""
    by = translations.groupBy("doc_id").agg(F.count("*").alias("total"), F.count_if(F.coalesce(F.nullif("text", F.lit("")), F.lit(None)).isNull()).alias("failed"))
    return by.withColumn("mass_failure", F.col("failed") >= F.greatest(F.lit(2), F.floor(share * F.col("total"))))


def verify_totals(pages: DataFrame) -> DataFrame:
    """AGG-6: sums of the per-page defect counts, pages with any, and the strict verdict.

    ``pages`` has doc_id, pno, images_src, images_out and any number of further integer counters.
    """
    counters = [c for c in pages.columns if c not in {"doc_id", "pno", "images_src", "images_out"}]
    lost, new = F.greatest(F.col("images_src") - F.col("images_out"), F.lit(0)), F.greatest(F.col("images_out") - F.col("images_src"), F.lit(0))
    p = pages.withColumn("lost_images", lost).withColumn("new_images", new)
    bad = F.lit(False)
    for c in [*counters, "lost_images"]:
        bad = bad | (F.col(c) > 0)
    by = p.groupBy("doc_id").agg(*[F.sum(c).alias(c) for c in [*counters, "lost_images", "new_images"]], F.count_if(bad).alias("bad_pages"))
    return by.withColumn("strict_exit", F.when((F.col("bad_pages") > 0) | (F.col("new_images") > 0), 1).otherwise(0))


def keep_last(jobs: DataFrame, n: int = 200, order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """WIN-8, SNK-6: the n rows added last; a top-n, so no full sort."""
    return jobs.orderBy(*[F.desc(c) for c in order]).limit(n)


def recent(rows: DataFrame, path: str, ts: str, n: int = 4) -> DataFrame:
    """WIN-7: the n distinct paths used last."""
    return rows.groupBy(path).agg(F.max(ts).alias(ts)).orderBy(F.desc(ts), path).limit(n)
