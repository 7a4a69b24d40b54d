"""Whole pipelines over the relations: preview, translation, re-layout and verification."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import text as X
from quire.functions.rewrite import normal_column
from quire.operators import aggregates as A
from quire.operators import folds as D
from quire.operators import joins as J
from quire.operators import layout as L
from quire.operators import pages as P
from quire.operators import regions as R
from quire.operators.relations import PAGE_HEIGHT, PAGE_WIDTH
from quire.sources import tables as T
from quire.sources import transport as M

PAGE, BOX = ["doc_id", "pno"], ["x0", "y0", "x1", "y1"]


def paragraphs_of(lines: DataFrame, width: float = PAGE_WIDTH, height: float = PAGE_HEIGHT) -> DataFrame:
    """Lines (doc_id, pno, ln, line, x0 ... y1, size) to paragraphs: margins out, reading order, column cuts, merges, folds."""
    body = lines.where(~P.is_margin(F.col("y0"), F.col("y1"), F.col("line"), height) & (F.length(F.trim("line")) > 0))
    ordered = P.reading_order(body, width)
    blocks = ordered.select("doc_id", "pno", "ord", "x0", "y0", "x1", "y1", "size", X.line_is_math(F.col("line"), F.lit(0)).alias("is_math"), F.array("line").alias("lines"))
    return D.assemble_paragraphs(D.merge_blocks(blocks, width / 2))


def with_flags(paragraphs: DataFrame, appendix: bool = False) -> DataFrame:
    """Reference zone over the document, and what is translatable."""
    p = paragraphs.withColumn("is_math", F.col("kind") == "m").withColumn("first", F.col("text")).withColumn("ord", F.col("seq"))
    p = D.reference_zone(p, appendix).withColumnRenamed("in_zone", "is_ref").drop("first", "ord", "kind")
    return p.withColumn("translatable", X.translatable(F.col("text"), F.col("is_math"), F.col("is_ref"), F.col("is_skip")))


@dataclass
class Translated:
    paragraphs: DataFrame
    results: DataFrame
    markdown: DataFrame
    bilingual: DataFrame
    dump: DataFrame
    stats: DataFrame


@dataclass
class Document:
    """What is known of documents before translation.

    paragraphs with flags; regions (doc_id, pno, x0 ... y1, threshold, kind) that nothing may be drawn on; lines of the
    source; scans, the pages that need OCR; gate (doc_id, cjk, rejected).
    """

    paragraphs: DataFrame
    regions: DataFrame
    lines: DataFrame
    scans: DataFrame
    gate: DataFrame


def source_lines(spans: DataFrame) -> DataFrame:
    """Spans to lines (doc_id, pno, block_no, line_no, line, size, base, x0 ... y1, is_bold, is_italic, is_math).

    The font census of the whole document says which fonts are mathematics.
    """
    key = [*PAGE, "block_no", "line_no"]
    census = A.font_census(spans).where("is_math").select("doc_id", "font", F.lit(True).alias("_m"))
    marked = spans.join(census, ["doc_id", "font"], "left")
    extra = marked.groupBy(*key).agg(F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.sum(F.when(F.col("_m"), F.length("text")).otherwise(0)).alias("math_chars"))
    rows = R.output_lines(spans).join(extra, key).join(A.line_style(spans).drop("size"), key)
    return rows.withColumn("is_math", X.line_is_math(F.col("line"), F.col("math_chars"))).drop("math_chars")


def figures(drawings: DataFrame, labels: DataFrame, width: float, height: float) -> DataFrame:
    """Vector regions (doc_id, pno, x0 ... y1): components of drawings with enough ink, and boxes around short labels.

    ``drawings`` has item, bounds and ``stroked``; ``labels`` bounds, text and n_chars.
    """
    top = J.top_by_area(drawings)
    parts = D.label_components(top, J.touching_pairs(top))
    dense = D.figure_regions(top.join(parts, [*PAGE, "item"]), labels, width)
    both = D.vector_regions(dense, J.sparse_figures(top, labels, width * height))
    return both.select(*PAGE, *[F.col(f"r_{c}").alias(c) for c in BOX])


def document(spans: DataFrame, pages: DataFrame, drawings: DataFrame, images: DataFrame, tables: DataFrame, layout: DataFrame, width: float = PAGE_WIDTH, height: float = PAGE_HEIGHT, appendix: bool = False, folder: str | None = None) -> Document:
    """From spans, drawings, images, table boxes and layout items to flagged paragraphs and protected regions.

    Covers go; lines of tables go and cut their block; blocks split at headings and columns; margins, pictures and
    labels of figures go; formula boxes widen what they belong to; blocks are ordered, merged and folded.
    ``pages`` has n_images, ``tables`` strategy, row_count, col_count and cells, ``layout`` label and bounds. Tables
    that several steps read are written under ``folder``, so that none is worked out twice.
    """
    folder = folder or new_folder(spans.sparkSession)
    text = spans.groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "line_no", "span_no", "text"))), lambda x: x["text"]), " ").alias("text"))
    known = pages.join(text, PAGE, "left").withColumn("text", F.coalesce("text", F.lit("")))
    lines = source_lines(spans.join(P.without_cover(known).select(*PAGE), PAGE, "left_semi"))
    lines = M.kept(lines.withColumn("ln", F.col("block_no").cast("long") * 10_000 + F.col("line_no")), f"{folder}/lines")

    # blocks of lines: cut at headings, then at tables and columns
    row = F.struct("line_no", F.struct(F.col("line").alias("text"), F.col("is_bold").alias("bold"), F.col("is_italic").alias("italic")).alias("x"))
    cut = lines.groupBy(*PAGE, "block_no").agg(F.array_sort(F.collect_list(row)).alias("all"))
    cut = cut.select(*PAGE, "block_no", F.inline(F.arrays_zip(F.transform("all", lambda x: x["line_no"]).alias("line_no"), D.heading_groups(F.transform("all", lambda x: x["x"])).alias("heading_part"))))
    bibliography = P.bibliography_pages(lines)
    block = [*PAGE, "block_no"]
    whole = lines.groupBy(*block).agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("all"), *[f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))])
    whole = whole.withColumn("lines", F.transform("all", lambda x: x["line"])).withColumn("text", F.array_join("lines", " "))
    numeric = D.numeric_columns(whole.where(X.numeric_table(F.col("text"), F.col("lines"))), width)
    tables = M.kept(R.page_tables(tables, bibliography, numeric, width * height), f"{folder}/tables")
    boxes = tables.groupBy(*PAGE).agg(F.collect_list(G.rect()).alias("_tables"))
    rows = lines.join(cut, [*block, "line_no"]).join(boxes, PAGE, "left")
    key, order = [*block, "heading_part"], ["line_no"]
    rows = D.split_at_bands(rows, J.line_in_tables(G.rect(), F.col("_tables")), key, order)
    rows = D.split_by_side(rows, width / 2, [*key, "piece"], order)
    parts = rows.groupBy(*key, "piece", "part").agg(
        F.min("ln").alias("ln"), F.array_sort(F.collect_list(F.struct("line_no", "line", "is_math"))).alias("all"), F.max("size").alias("size"),
        *[f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))],
    )
    parts = parts.withColumn("lines", F.transform("all", lambda x: x["line"])).withColumn("text", X.join_lines(F.col("lines")))
    parts = parts.withColumn("line", F.col("text")).withColumn("n_chars", F.length("text")).withColumn("n_lines", F.size("lines")).withColumn("is_math", X.block_is_math(F.transform("all", lambda x: x["is_math"]), F.col("text")))
    parts = M.kept(parts.drop("all"), f"{folder}/blocks")

    # regions, and the blocks that lie in them
    items = T.layout_boxes(layout).select(*PAGE, "label", *[F.col(c).alias(f"r_{c}") for c in BOX])
    vectors = figures(drawings, parts.select(*PAGE, *BOX, "text", "n_chars"), width, height)
    regions = M.kept(T.protected_regions(T.image_rects(images, 25), vectors, tables), f"{folder}/regions")
    body = parts.where(~P.is_margin(F.col("y0"), F.col("y1"), F.col("text"), height))
    body = R.without_pictures(body, items.where("label = 'picture'"))
    named = regions.select(*PAGE, *[F.col(c).alias(f"r_{c}") for c in BOX], "threshold", "kind")
    body = body.join(R.text_in_regions(body, named).select(*PAGE, "ln"), [*PAGE, "ln"], "left_anti")
    claims = J.formula_union(body.select(*PAGE, "ln", *BOX), items.where("label = 'formula'").drop("label")).where("f_x0 is not null").select(*PAGE, "ln", F.lit(True).alias("_formula"))
    plausible = R.formula_plausible(F.col("n_lines"), F.col("y1") - F.col("y0"), F.col("text"))
    body = body.join(claims, [*PAGE, "ln"], "left").withColumn("is_math", F.col("is_math") | (F.coalesce("_formula", F.lit(False)) & plausible))

    ordered = P.reading_order(body, width).select(*PAGE, "ord", *BOX, "size", "is_math", "lines")
    paragraphs = M.kept(with_flags(D.assemble_paragraphs(D.merge_blocks(ordered, width / 2)), appendix), f"{folder}/paragraphs")
    return Document(paragraphs, regions, lines, P.needs_ocr(known), P.cjk_gate(paragraphs.where("not is_math")))


def translate(lines: DataFrame, send: M.Transport = M.replay, appendix: bool = False, folder: str | None = None) -> Translated:
    """Lines alone to paragraphs, and these to ``translated``."""
    return translated(with_flags(paragraphs_of(lines), appendix), send, folder)


def translated(p: DataFrame, send: M.Transport = M.replay, folder: str | None = None) -> Translated:
    """Flagged paragraphs to batches, answers and sweeps over what failed, then the text outputs.

    Every batch is sent once (and once more in each sweep that it needs): answers are written under ``folder``, by
    default a new one beside the session's checkpoints, before anything reads them.
    """
    folder = folder or new_folder(p.sparkSession)
    # one number for each paragraph of a document, so that batches run over page ends
    p = p.withColumn("_no", F.col("pno").cast("long") * 100_000 + F.col("seq"))
    wanted = p.where("translatable").select("doc_id", F.col("_no").cast("int").alias("seq"), "text", "is_heading")
    batched = M.kept(D.batched(wanted), f"{folder}/batches")
    answers = M.kept(M.translate(M.as_batches(batched), send), f"{folder}/answers")
    results = M.kept(M.sweep(batched, answers, send, folder), f"{folder}/results")
    t = results.select("doc_id", F.col("seq").alias("_no"), normal_column(F.col("text")).alias("text"))
    joined = J.with_translations(p, t, keys=["doc_id", "_no"])
    dump = J.dump(p.withColumnRenamed("is_heading", "heading").select("doc_id", "pno", "seq", "_no", "x0", "y0", "x1", "y1", "heading", "text"), t, ["doc_id", "_no"])
    return Translated(p, results, T.markdown(joined), T.bilingual(joined), dump, A.doc_stats(p))


def new_folder(spark: SparkSession) -> str:
    """A new folder beside the session's checkpoints; on a local master without any, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir, or give a folder that the driver and all executors share")
    return f"{(base or tempfile.mkdtemp(prefix='quire-')).rstrip('/')}/document-{uuid.uuid4().hex}"


def drawn_lines(ops: DataFrame, source: DataFrame, erased: DataFrame) -> DataFrame:
    """Lines of the output: what is drawn, and the source's lines that aren't erased by 0.75."""
    width = L.width_of(F.col("text"), F.col("size"))
    new = ops.select(*PAGE, F.monotonically_increasing_id().alias("ln"), F.col("text").alias("line"), "size", F.col("y").alias("base"), F.col("x").alias("x0"), (F.col("y") - F.col("size")).alias("y0"), (F.col("x") + width).alias("x1"), (F.col("y") + 0.25 * F.col("size")).alias("y1"))
    lists = erased.groupBy(*PAGE).agg(F.collect_list(G.rect()).alias("gone"))
    left = source.join(lists, PAGE, "left").where(G.covered_share(G.rect(), F.coalesce("gone", F.array().cast(f"array<{G.RECT}>"))) < 0.75)
    cols = [*PAGE, "ln", "line", "size", "base", *BOX]
    return new.select(cols).unionByName(left.select(cols))


def relayout(paragraphs: DataFrame, translations: DataFrame, regions: DataFrame, height: float = PAGE_HEIGHT, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(plans, draw operations) of translated paragraphs around protected regions and what stays in the source language.

    Plans are written under ``folder``: their operations, warnings and counts don't solve the pages again.
    """
    folder = folder or new_folder(paragraphs.sparkSession)
    p = J.with_translations(paragraphs, translations)
    moves = p.where(~F.col("missing") & X.is_cjk(F.col("translated")))
    stays = p.where(F.col("missing") | ~X.is_cjk(F.col("translated")))
    cols = ["doc_id", "pno", "x0", "y0", "x1", "y1"]
    plans = M.kept(L.solve(moves.withColumn("text", F.col("translated")), regions.select(*cols).unionByName(stays.select(*cols)), height), f"{folder}/plans")
    return plans, L.draw_ops(plans.where("why is null"), moves)


def verify(out: DataFrame, src: DataFrame, fills: DataFrame, images: DataFrame) -> DataFrame:
    """Per document the defects of an output against its source, and the strict verdict.

    ``out`` and ``src`` are lines; ``fills`` white rectangles of the output; ``images`` counts (images_src,
    images_out) by page.
    """
    page = ["doc_id", "pno"]
    overlaps = J.without_ghosts(J.new_pairs(J.overlap_pairs(out), J.overlap_pairs(src)), out, fills).groupBy(*page).agg(F.count("*").alias("overlaps"))
    outside = J.new_tails(out.where(F.col("y1") > PAGE_HEIGHT), src.where(F.col("y1") > PAGE_HEIGHT)).groupBy(*page).agg(F.count("*").alias("outside"))
    leaks = out.where(X.english_sentence(F.col("line")) & ~X.is_cjk(F.col("line"))).groupBy(*page).agg(F.count("*").alias("untranslated"))
    pages = images.join(overlaps, page, "left").join(outside, page, "left").join(leaks, page, "left").na.fill(0, ["overlaps", "outside", "untranslated"])
    return A.verify_totals(pages.select(*page, "overlaps", "outside", "untranslated", "images_src", "images_out"))
