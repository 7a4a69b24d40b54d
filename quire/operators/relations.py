"""The relations that operators work on, and the pseudo-layout that gives plain documents geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tagged members of a paragraph: text ('t') with its string, formula ('m') with its rectangle.
TOKEN = "struct<kind:string,text:string,rect:struct<x0:double,y0:double,x1:double,y1:double>>"
PAGE_WIDTH, PAGE_HEIGHT = 595.0, 842.0
LINES_PER_PAGE = 12


def text_lines(documents: DataFrame) -> DataFrame:
    """(doc_id, ln, line): the lines of each text, numbered from 0; null texts have none."""
    return documents.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("ln", "line"))


def pseudo_layout(documents: DataFrame) -> DataFrame:
    """Lines placed on pages of 595 x 842 by their number and length: twelve a page, every third length on the right."""
    n = F.length("line")
    t = text_lines(documents).withColumn("n", n).withColumn("pno", F.expr(f"cast(ln div {LINES_PER_PAGE} as int)")).withColumn("col", F.when(F.col("n") % 3 == 0, 1).otherwise(0))
    t = t.withColumn("x0", (48 + 264 * F.col("col")).cast("double")).withColumn("y0", (20 + 8 * (F.col("ln") % LINES_PER_PAGE) + F.col("n") % 7).cast("double"))
    t = t.withColumn("x1", F.col("x0") + F.least(F.lit(230), 5 * F.col("n"))).withColumn("y1", F.col("y0") + 12).withColumn("size", (9 + F.col("n") % 5).cast("double"))
    return t.withColumn("base", F.col("y0") + F.col("size"))


#: The same view for the SQL that results are held against.
LAYOUT_SQL = f"""t AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS ln, unnest(string_split(text, chr(10))) AS line FROM documents),
    p AS (SELECT doc_id, ln, line, length(line) AS n, ln // {LINES_PER_PAGE} AS pno, CASE WHEN length(line) % 3 = 0 THEN 1 ELSE 0 END AS col FROM t),
    lay AS (SELECT *, CAST(48 + 264 * col AS DOUBLE) AS x0, CAST(48 + 264 * col + least(230, 5 * n) AS DOUBLE) AS x1, CAST(20 + 8 * (ln % {LINES_PER_PAGE}) + n % 7 AS DOUBLE) AS y0,
        CAST(32 + 8 * (ln % {LINES_PER_PAGE}) + n % 7 AS DOUBLE) AS y1, CAST(9 + n % 5 AS DOUBLE) AS size, CAST(29 + 8 * (ln % {LINES_PER_PAGE}) + n % 7 + n % 5 AS DOUBLE) AS base FROM p)"""
