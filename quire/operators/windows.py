"""Windows over a page's lines and blocks (WIN-3, WIN-4, WIN-9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = ["doc_id", "pno"]


def pitch_ratios(lines: DataFrame, least: float = 0.5, most: float = 60.0, overlap: float = 6.0) -> DataFrame:
    """WIN-3: per line its distance to the next one of the page over the smaller size (9 for size 0).

    Lines go by (base, x0, ln); neighbours that lie ``least`` or less or ``most`` or more apart, or that overlap
    by ``overlap`` or less, give no row.
    """
    w = Window.partitionBy(*PAGE).orderBy("base", "x0", "ln")
    after = {f"_{c}": F.lead(c).over(w) for c in ("base", "x0", "x1", "size")}
    pitch, size = F.col("_base") - F.col("base"), F.least("size", "_size")
    near = (pitch > least) & (pitch < most) & (F.least("x1", "_x1") - F.greatest("x0", "_x0") > overlap)
    return lines.withColumns(after).where(near).select(*PAGE, "ln", F.when(size == 0, 9.0).otherwise(pitch / F.nullif(size, F.lit(0.0))).alias("ratio"))


def gaps_above(blocks: DataFrame, is_text: Column) -> DataFrame:
    """WIN-4: for each text block of a page the distance to the text block before it, from -1 for the first."""
    w = Window.partitionBy(*PAGE).orderBy("ord")
    return blocks.where(is_text).withColumn("gap", F.col("y0") - F.coalesce(F.lag("y1").over(w), F.lit(-1.0)))


def first_rows(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """WIN-9: the first ``n`` rows of each key."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_k") <= n).drop("_k")
