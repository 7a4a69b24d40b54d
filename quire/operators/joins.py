"""Joins by key, by place and by neighbourhood (JOIN-1 to JOIN-19).

Joins by place are equi-joins on (doc_id, pno), or on a grid cell, with the
geometry as a residual condition: no cross products, and a page's rows are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import text as X

KEY = ["doc_id", "pno", "seq"]
PAGE = ["doc_id", "pno"]


def present(t: Column) -> Column:
    """An empty string counts as missing."""
    return F.nullif(t, F.lit(""))


def with_translations(paragraphs: DataFrame, translations: DataFrame, default: Column | None = None, keys: list[str] = KEY) -> DataFrame:
    """JOIN-1, JOIN-3: left join with ``translated``, and where there is none the default or the marked source."""
    t = translations.select(*keys, F.col("text").alias("_t"))
    fall = default if default is not None else F.concat(F.lit(X.FAILED_MARK), F.col("text"))
    return paragraphs.join(t, keys, "left").withColumn("translated", F.coalesce(present(F.col("_t")), fall)).withColumn("missing", present(F.col("_t")).isNull()).drop("_t")


def dump(paragraphs: DataFrame, translations: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """JOIN-2, SNK-4: translated paragraphs alone, coordinates to a tenth."""
    t = translations.where(F.col("text").isNotNull()).select(*keys, F.col("text").alias("out"))
    places = [F.round(c, 1).alias(c) for c in ("x0", "y0", "x1", "y1") if c in paragraphs.columns]
    rest = [c for c in paragraphs.columns if c not in {*keys, "x0", "y0", "x1", "y1", "text"}]
    return paragraphs.join(t, keys).select(*keys, *rest, *places, F.col("text").alias("src"), F.col("out").alias("text"))


def remap(paragraphs: DataFrame, old: DataFrame, reach: float = 1.5) -> DataFrame:
    """JOIN-4: a page's old texts by equal source, the last of several; else from the nearest place.

    Distance is |dy0| + 0.25 |dx0|, at most ``reach``; of equal ones the first counts. Old rows without a
    source take no part. ``old`` has doc_id, pno, ord, src, text, x0 and y0.
    """
    o = old.where(present(F.col("src")).isNotNull())
    exact = o.groupBy(*PAGE, "src").agg(F.max_by("text", "ord").alias("by_text"))
    p = paragraphs.join(exact.withColumnRenamed("src", "_s"), [*(paragraphs[k] == exact[k] for k in PAGE), paragraphs["text"] == F.col("_s")], "left").select(*[paragraphs[c] for c in paragraphs.columns], "by_text")
    # places in bands of ``reach``: only the own band and its neighbours can hold a row near enough
    band = lambda c: F.floor(F.col(c) / reach)
    left = p.where(F.col("by_text").isNull()).select(*KEY, F.col("x0").alias("px"), F.col("y0").alias("py"), F.explode(F.array(band("y0") - 1, band("y0"), band("y0") + 1)).alias("band"))
    right = o.select(*PAGE, band("y0").alias("band"), "ord", F.col("text").alias("near"), "x0", "y0")
    d = F.abs(F.col("y0") - F.col("py")) + 0.25 * F.abs(F.col("x0") - F.col("px"))
    near = left.join(right, [*PAGE, "band"]).withColumn("d", d).where(F.col("d") <= reach).groupBy(*KEY).agg(F.min_by("near", F.struct("d", "ord")).alias("by_place"))
    return p.join(near, KEY, "left").withColumn("found", F.coalesce("by_text", "by_place")).withColumn("how", F.when(F.col("by_text").isNotNull(), "exact").when(F.col("by_place").isNotNull(), "nearest")).drop("by_text", "by_place")


def touching(blocks: DataFrame, regions: DataFrame, condition: Column, how: str) -> DataFrame:
    """JOIN-5, JOIN-7, JOIN-14: semi or anti join by place; regions' columns are r_x0 ... r_y1 and r_kind."""
    return blocks.join(regions, [*(blocks[k] == regions[k] for k in PAGE), condition], how)


def covers(share: float) -> Column:
    """The region covers a share of the block."""
    return G.cover(G.rect(), G.rect("r_x0", "r_y0", "r_x1", "r_y1")) >= share


def formula_union(blocks: DataFrame, formulas: DataFrame) -> DataFrame:
    """JOIN-6: bounds of all formula rectangles that belong to a block, null without any."""
    b, r = G.rect(), G.rect("r_x0", "r_y0", "r_x1", "r_y1")
    belongs = (G.cover(b, r) >= 0.55) | ((G.cover(r, b) >= 0.75) & (G.area(b) <= 2.2 * F.greatest(G.area(r), F.lit(1.0))))
    near = blocks.join(formulas, [*(blocks[k] == formulas[k] for k in PAGE), belongs], "left")
    return near.groupBy(*[blocks[c] for c in blocks.columns]).agg(F.min("r_x0").alias("f_x0"), F.min("r_y0").alias("f_y0"), F.max("r_x1").alias("f_x1"), F.max("r_y1").alias("f_y1"))


def touching_pairs(rects: DataFrame, gap: float = 1.0, cell: float = 48.0, large: float = 400.0, keys: tuple[str, ...] = ("doc_id", "pno")) -> DataFrame:
    """JOIN-8: pairs (a, b), a < b, of rectangles of a page that touch within ``gap``.

    Rectangles are dealt to the grid cells they cover and meet by cell. Those with a side beyond
    ``large`` meet only each other. ``rects`` has the keys, item and x0 ... y1.
    """
    wide = (F.col("x1") - F.col("x0") > large) | (F.col("y1") - F.col("y0") > large)
    r = rects.select(*keys, "item", "x0", "y0", "x1", "y1", wide.alias("wide"))
    span = lambda a, b: F.sequence(F.floor((F.col(a) - gap) / cell), F.floor((F.col(b) + gap) / cell))
    cells = r.withColumn("cx", F.explode(F.when(F.col("wide"), F.array(F.lit(0).cast("long"))).otherwise(span("x0", "x1")))).withColumn("cy", F.explode(F.when(F.col("wide"), F.array(F.lit(0).cast("long"))).otherwise(span("y0", "y1"))))
    a = cells.select(*keys, "wide", "cx", "cy", *[F.col(c).alias(f"a_{c}") for c in ("item", "x0", "y0", "x1", "y1")])
    b = cells.select(*keys, "wide", "cx", "cy", *[F.col(c).alias(f"b_{c}") for c in ("item", "x0", "y0", "x1", "y1")])
    meet = "a_item < b_item and a_x0 - {g} <= b_x1 and b_x0 - {g} <= a_x1 and a_y0 - {g} <= b_y1 and b_y0 - {g} <= a_y1".format(g=gap)
    return a.join(b, [*keys, "wide", "cx", "cy"]).where(meet).select(*keys, F.col("a_item").alias("a"), F.col("b_item").alias("b")).distinct()


def overlap_pairs(lines: DataFrame, least: float = 0.75, ahead: int = 7, stop: bool = True) -> DataFrame:
    """JOIN-9, and JOIN-10 with ``stop`` false: lines of a page that lie too close under each other.

    In the order of (base, x0) a line meets the next ``ahead`` ones up to a pitch of 60 that overlap it by
    more than 6; ratio is pitch over the smaller size, 9 if that is 0. With ``stop``, a line whose successor has a pitch
    of 0.5 or less meets none (pitches don't fall along the order, so only the first can end the scan);
    without, such neighbours are passed over, and all later lines count.
    """
    w = Window.partitionBy(*PAGE).orderBy("base", "x0", "ln")
    r = lines.select(*PAGE, "ln", "line", "base", "x0", "x1", "size").withColumn("rn", F.row_number().over(w)).withColumn("next", F.lead("base").over(w))
    a = r.select(*PAGE, *[F.col(c).alias(f"a_{c}") for c in ("ln", "line", "base", "x0", "x1", "size", "rn", "next")])
    b = r.select(*PAGE, *[F.col(c).alias(f"b_{c}") for c in ("ln", "line", "base", "x0", "x1", "size", "rn")])
    if stop:
        a = a.where("a_next - a_base > 0.5").withColumn("b_rn", F.explode(F.sequence(F.col("a_rn") + 1, F.col("a_rn") + ahead)))
        met = a.join(b, [*PAGE, "b_rn"])
    else:
        # lines within 60 lie in the same band of 60 or in the next one
        band = F.floor(F.col("base") / 60)
        near = r.select(*PAGE, "rn", F.explode(F.array(band, band + 1)).alias("band")).withColumnRenamed("rn", "a_rn")
        met = a.join(near, [*PAGE, "a_rn"]).join(b.withColumn("band", F.floor(F.col("b_base") / 60)), [*PAGE, "band"]).where("b_rn > a_rn and b_base - a_base > 0.5")
    met = met.where("b_base - a_base <= 60 and least(a_x1, b_x1) - greatest(a_x0, b_x0) > 6").withColumn("ratio", F.expr("if(least(a_size, b_size) = 0, 9.0D, (b_base - a_base) / nullif(least(a_size, b_size), 0))"))
    out = met.where(F.col("ratio") < least)
    return out.select(*PAGE, F.col("a_ln").alias("a"), F.col("b_ln").alias("b"), "ratio", F.substring("a_line", 1, 32).alias("p"), F.substring("b_line", 1, 32).alias("q"))


def new_pairs(out: DataFrame, src: DataFrame) -> DataFrame:
    """JOIN-11, SET-4: pairs of the output whose two 32-character heads aren't among the source's; duplicates stay."""
    return out.join(src.select(*PAGE, "p", "q").distinct(), [*PAGE, "p", "q"], "left_anti")


def without_ghosts(pairs: DataFrame, out_lines: DataFrame, fills: DataFrame, share: float = 0.6) -> DataFrame:
    """JOIN-13, GEO-10: drops pairs whose second line, the first with its head, is mostly under white fills."""
    w = Window.partitionBy(*PAGE, "q").orderBy("base", "x0", "ln")
    first = out_lines.withColumn("q", F.substring("line", 1, 32)).withColumn("_k", F.row_number().over(w)).where("_k = 1").select(*PAGE, "q", "x0", "y0", "x1", "y1")
    lists = fills.groupBy(*PAGE).agg(F.collect_list(G.rect()).alias("fills"))
    ghost = first.join(lists, PAGE).where(G.covered(G.rect(), F.col("fills"), share)).select(*PAGE, "q")
    return pairs.join(ghost, [*PAGE, "q"], "left_anti")


def new_tails(out: DataFrame, src: DataFrame, n: int = 30) -> DataFrame:
    """JOIN-12: texts beyond the page whose heads the source doesn't have."""
    head = lambda d: d.withColumn("head", F.substring("line", 1, n))
    return head(out).join(head(src).select(*PAGE, "head").distinct(), [*PAGE, "head"], "left_anti")


def first_existing(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """JOIN-15, SRC-8, SRT-6: per name the path in the first directory that has it.

    ``wanted`` has name, dir and ord; ``existing`` dir and name.
    """
    return wanted.join(existing.select("dir", "name").distinct(), ["dir", "name"]).groupBy("name").agg(F.min_by(F.concat_ws("/", "dir", "name"), "ord").alias("path"))


def sparse_figures(rects: DataFrame, texts: DataFrame, page_area: float, least_area: float = 9000.0, share: float = 0.35, most: int = 8) -> DataFrame:
    """JOIN-17: stroked rectangles of a page that enclose 1 to ``most`` texts, all of them short labels.

    ``rects`` has item, bounds and ``stroked``; ``texts`` bounds and text, trimmed; empty ones don't count. A text is
    enclosed if it is covered by 0.8 or more, and a label if it has at most 48 characters and no sentence end
    and is narrower than 0.72 of the rectangle. Returns doc_id, pno, item and r_x0 ... r_y1.
    """
    area = G.area(G.rect())
    r = rects.where(F.col("stroked") & (area >= least_area) & (area < share * page_area)).select(*PAGE, "item", *[F.col(c).alias(f"r_{c}") for c in ("x0", "y0", "x1", "y1")])
    t = texts.where(present(F.col("text")).isNotNull()).select(*PAGE, "text", "x0", "y0", "x1", "y1")
    met = r.join(t, PAGE).where(covers(0.8))
    label = (F.length("text") <= 48) & ~F.col("text").rlike(X.SENTENCE_END) & (F.col("x1") - F.col("x0") < 0.72 * (F.col("r_x1") - F.col("r_x0")))
    by = met.groupBy(*PAGE, "item", "r_x0", "r_y0", "r_x1", "r_y1").agg(F.count("*").alias("n"), F.bool_and(label).alias("labels"))
    return by.where((F.col("n") <= most) & F.col("labels")).drop("n", "labels")


#: Names and patterns of text that shouldn't be published.
SECRET_RULES = {
    "api_key": "sk-[A-Za-z0-9_-]{16,}",
    "bearer": "(?i)bearer\\s+[A-Za-z0-9._-]{16,}",
    "private_key": "-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "home_path": "/(?:home|Users)/[A-Za-z0-9._-]+/",
}


def scan_rules(rows: DataFrame, text: str = "text", rules: dict[str, str] = SECRET_RULES) -> DataFrame:
    """JOIN-16: one row for each rule a text matches; a pass over the rules in each row, no join."""
    hits = F.array(*[F.when(F.col(text).rlike(p), F.lit(name)) for name, p in rules.items()])
    return rows.withColumn("rule", F.explode(F.filter(hits, lambda x: x.isNotNull())))


def profile(wanted: DataFrame, user: DataFrame, merged: DataFrame) -> DataFrame:
    """JOIN-18: the user's entry of a provider, else the merged one; all have provider and endpoint."""
    u, m = user.select("provider", F.col("endpoint").alias("u")), merged.select("provider", F.col("endpoint").alias("m"))
    return wanted.join(u, "provider", "left").join(m, "provider", "left").withColumn("endpoint", F.coalesce("u", "m")).drop("u", "m")


def dedupe_rects(rects: Column, share: float = 0.9) -> Column:
    """SET-2: in order, a rectangle stays unless a kept one covers more than ``share`` of it."""
    return F.aggregate(rects, F.array().cast(f"array<{G.RECT}>"), lambda kept, r: F.when(F.exists(kept, lambda k: G.cover(r, k) > share), kept).otherwise(F.concat(kept, F.array(r))))


def first_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """SET-3: the first row of each key."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_k = 1").drop("_k")


def top_by_area(drawings: DataFrame, n: int = 6000) -> DataFrame:
    """SRT-3: the n largest drawings of each page."""
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return drawings.withColumn("_k", F.row_number().over(Window.partitionBy(*PAGE).orderBy(area.desc(), "item"))).where(F.col("_k") <= n).drop("_k")


def in_table(block: Column, tables: Column, captions: Column) -> Column:
    """FLT-4: inside a table by half, or in its rows' band and not a caption."""
    cx, cy = (block["x0"] + block["x1"]) / 2, (block["y0"] + block["y1"]) / 2

    def near(t: Column) -> Column:
        small = G.centre_in(block, t) & (G.area(block) < 0.2 * G.area(t))
        row = cy.between(t["y0"] - 6, t["y1"] + 3) & (G.height(block) < F.greatest(0.5 * G.height(t), F.lit(24.0))) & ~G.hit_any(block, captions, 0.5)
        return (G.cover(block, t) >= 0.5) | ((G.x_overlap(block, t) > 4) & (small | row) & cx.isNotNull())

    return F.coalesce(F.exists(tables, near), F.lit(False))


def line_in_tables(line: Column, tables: Column) -> Column:
    """FLT-5."""
    cy = (line["y0"] + line["y1"]) / 2
    return F.coalesce(F.exists(tables, lambda t: (G.x_overlap(line, t) > 4) & cy.between(t["y0"] - 6, t["y1"] + 3)), F.lit(False))


def light_fill(r: Column, fill: Column, stroke: Column) -> Column:
    """FLT-22: a large light area without a border."""
    return (G.area(r) >= 4000) & (F.size(F.coalesce(fill, F.array().cast("array<double>"))) >= 3) & stroke.isNull() & F.forall(F.slice(fill, 1, 3), lambda c: c > 0.90)


def white_fill(r: Column, fill: Column) -> Column:
    """FLT-27."""
    return (G.width(r) > 8) & (G.height(r) > 4) & F.coalesce(F.forall(F.slice(fill, 1, 3), lambda c: F.abs(c - 1) <= 0.04) & (F.size(fill) >= 3), F.lit(False))


def table_credible(rows: Column, cols: Column, r: Column, page_area: Column, strategy: Column, cells: Column) -> Column:
    """FLT-20: big enough; ruled ones within 0.4 to 55 % of the page, aligned ones filled and short-celled."""
    share = G.area(r) / page_area
    flat = F.flatten(cells)
    filled = F.filter(flat, lambda c: F.length(F.trim(F.coalesce(c, F.lit("")))) > 0)
    short = F.filter(filled, lambda c: F.length(X.collapse(c)) <= 42)
    aligned = (rows >= 3) & (cols >= 3) & share.between(0.01, 0.5) & (F.size(filled) >= 0.55 * F.size(flat)) & (F.size(short) >= 0.7 * F.size(filled)) & (F.size(filled) > 0)
    return (rows >= 2) & (cols >= 2) & F.when(strategy == "lines", share.between(0.004, 0.55)).otherwise(aligned)


def routable(models: DataFrame, allowed: Column) -> DataFrame:
    """FLT-29: providers with models that the list, if there is one, names."""
    return models.where((F.size("models") > 0) & ((F.size(allowed) == 0) | F.array_contains(allowed, F.col("id"))))


def already_running(wanted: DataFrame, jobs: DataFrame) -> DataFrame:
    """FLT-30: wanted paths that a running job has."""
    return wanted.join(jobs.where("status = 'running'").select("pdf_path").distinct(), "pdf_path", "left_semi")
