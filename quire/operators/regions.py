"""Tables, formulas, figures and output lines of a page (SRC-17, SRC-18, SRC-20, FLT-3, FLT-12, FLT-21, FLT-32, GEO-12, GEO-13, STR-5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import text as X
from quire.operators import joins as J
from quire.operators.aggregates import MATH_FONTS

PAGE = ["doc_id", "pno"]
BOX = [*PAGE, "x0", "y0", "x1", "y1"]


def fallback_tables(boxes: DataFrame, page_area: float) -> DataFrame:
    """FLT-21: tables of 2 x 2 or more; found ones from 0.5 % of the page on, ruled ones within 0.4 to 55 %."""
    share = G.area(G.rect()) / page_area
    fits = F.when(F.col("strategy") == "ruled", share.between(0.004, 0.55)).otherwise(share >= 0.005)
    return boxes.where((F.col("row_count") >= 2) & (F.col("col_count") >= 2) & fits).select(*BOX)


def page_tables(boxes: DataFrame, bibliography: DataFrame, numeric: DataFrame, page_area: float) -> DataFrame:
    """SRC-17: credible tables by ruled lines, then by aligned text, then numeric columns; none on bibliography pages.

    In this order a table stays unless one before it covers more than 0.9 of it (SET-2).
    """
    ok = J.table_credible(F.col("row_count"), F.col("col_count"), G.rect(), F.lit(page_area), F.col("strategy"), F.col("cells"))
    order = F.when(F.col("strategy") == "lines", 0).otherwise(1)
    found = boxes.where(ok).select(*BOX, order.alias("_o")).unionByName(numeric.select(*BOX).withColumn("_o", F.lit(2)))
    found = found.join(bibliography.select(*PAGE), PAGE, "left_anti")
    lists = found.groupBy(*PAGE).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", "y0", "x0", G.rect().alias("r")))), lambda t: t["r"]).alias("all"))
    return lists.select(*PAGE, F.explode(J.dedupe_rects(F.col("all"))).alias("r")).select(*PAGE, "r.*")


def formula_plausible(n_lines: Column, high: Column, t: Column) -> Column:
    """FLT-12: a formula box may claim a block of few, short words and little height."""
    words = F.filter(F.split(X.collapse(t), " "), lambda w: F.length(w) > 0)
    mean = F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w)) / F.greatest(F.size(words), F.lit(1))
    return (n_lines <= 10) & (high <= 105) & (F.size(words) < 40) & (mean <= 5.4)


def math_spans(spans: DataFrame, census: DataFrame, formulas: DataFrame) -> DataFrame:
    """FLT-32: spans in a font of the census, of private-use signs, or whose centre lies in a formula box.

    ``census`` is (doc_id, font, is_math) with a row for each font; ``formulas`` has r_x0 ... r_y1.
    """
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    lists = formulas.groupBy(*PAGE).agg(F.collect_list(F.struct("r_x0", "r_y0", "r_x1", "r_y1")).alias("_f"))
    inside = F.coalesce(F.exists("_f", lambda r: cx.between(r["r_x0"] + 0.5, r["r_x1"] - 0.5) & cy.between(r["r_y0"] + 0.5, r["r_y1"] - 0.5)), F.lit(False))
    fonts = census.where("is_math").select("doc_id", "font", F.lit(True).alias("_c"))
    s = spans.join(fonts, ["doc_id", "font"], "left").join(lists, PAGE, "left")
    return s.withColumn("is_math", F.coalesce("_c", F.lit(False)) | X.private_dominant(F.col("text")) | inside).drop("_c", "_f")


def line_math_chars(spans: DataFrame) -> DataFrame:
    """FLT-9's count: characters of a line in fonts named for mathematics."""
    named = F.sum(F.when(F.col("font").rlike(MATH_FONTS), F.length("text")).otherwise(0))
    return spans.groupBy(*PAGE, "block_no", "line_no").agg(named.alias("math_chars"))


def without_pictures(blocks: DataFrame, pictures: DataFrame) -> DataFrame:
    """FLT-3: blocks that a layout picture covers by 0.7 go."""
    return J.touching(blocks, pictures, J.covers(0.7), "left_anti")


def text_in_regions(blocks: DataFrame, regions: DataFrame) -> DataFrame:
    """FLT-8, GEO-12: blocks (text, n_lines) that are labels of a region (r_x0 ... r_y1, threshold, kind)."""
    label = X.figure_text(F.col("x1") - F.col("x0"), F.col("text"), F.col("n_lines"), F.col("kind"), F.col("r_x1") - F.col("r_x0"))
    reach = G.cover(G.rect(), G.rect("r_x0", "r_y0", "r_x1", "r_y1")) >= F.col("threshold")
    return J.touching(blocks, regions, reach & label, "left_semi")


def neutralized(drawings: DataFrame, regions: DataFrame) -> DataFrame:
    """GEO-13: delete operations for drawings that a region covers by 0.95."""
    return J.touching(drawings, regions, J.covers(0.95), "left_semi").select(*PAGE, F.lit("delete").alias("op"), "item")


def output_lines(spans: DataFrame, keep_zero: bool = False) -> DataFrame:
    """SRC-18: lines with text, largest size, the baseline of the first span with text, and the x-range of spans with text."""
    line = [*PAGE, "block_no", "line_no"]
    solid = F.length(X.solid(F.col("text"))) > 0
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_no", "text"))), lambda s: s["text"]), "")
    by = spans.groupBy(*line).agg(text.alias("line"), F.max("size").alias("size"), F.min_by("origin_y", F.when(solid, F.col("span_no"))).alias("base"), F.min(F.when(solid, F.col("x0"))).alias("x0"), F.max(F.when(solid, F.col("x1"))).alias("x1"))
    ok = (F.length(X.solid(F.col("line"))) > 0) & F.col("base").isNotNull()
    return by.where(ok if keep_zero else ok & (F.col("size") > 0))


def inline_math(spans: DataFrame, keys: list[str], most: int = 200) -> DataFrame:
    """STR-5: (keys, text) of formula spans in reading order, a space where the gap is over 1.2.

    Null where signs can't be decoded, nothing is left, or the text is longer than ``most``.
    """
    s = spans.withColumn("_t", F.trim(X.decode_symbols(F.col("text"))))
    parts = F.array_sort(F.collect_list(F.struct(F.round("y0", 1).alias("y"), "x0", "x1", F.col("_t").alias("t"))))
    by = s.groupBy(*keys).agg(parts.alias("p"), F.max(X.private_dominant(F.col("_t"))).alias("lost"))
    some = F.filter("p", lambda x: F.length(x["t"]) > 0)
    by = by.withColumn("p", some)
    pieces = F.transform("p", lambda x, i: F.concat(F.when((i > 0) & (x["x0"] - F.element_at("p", F.greatest(i, F.lit(1)))["x1"] > 1.2), F.lit(" ")).otherwise(F.lit("")), x["t"]))
    text = X.collapse(F.array_join(pieces, ""))
    return by.select(*keys, F.when(~F.col("lost") & (F.length(text) > 0) & (F.length(text) <= most), text).alias("text"))


def fonts_of(wanted: DataFrame, loadable: DataFrame) -> DataFrame:
    """SRC-20: per role the first font of its list (role, font, ord) that loads; a regular one must be there."""
    got = wanted.join(loadable.select("font").distinct(), "font", "left_semi").groupBy("role").agg(F.min_by("font", "ord").alias("font"))
    roles = wanted.select("role").distinct().join(got, "role", "left")
    fatal = (F.col("role") == "regular") & F.col("font").isNull()
    return roles.select("role", F.when(fatal, F.raise_error(F.lit("no regular font loads")).cast("string")).otherwise(F.col("font")).alias("font"))


def chosen_models(chosen: DataFrame, manual: DataFrame) -> DataFrame:
    """SET-6: chosen models and the manual ones that aren't among them."""
    return chosen.unionByName(manual.join(chosen, chosen.columns, "left_anti"))


def shortened(messages: Column, n: int = 3, chars: int = 200) -> Column:
    """SRT-4: the first messages, each cut."""
    return F.transform(F.slice(messages, 1, n), lambda m: F.substring(m, 1, chars))
