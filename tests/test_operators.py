"""Operators on small literal tables, invariants, pipelines and the stream."""

import json
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import rewrite as R
from quire.operators import aggregates as A
from quire.operators import folds as D
from quire.operators import intervals as I
from quire.operators import joins as J
from quire.operators import layout as L
from quire.operators import pages as P
from quire.operators.relations import pseudo_layout
from quire.plans import pipelines as Q
from quire.sources import adapters, tables
from quire.sources import transport as M
from quire.streaming import watcher as W

BOX = "doc_id long, pno int, item int, x0 double, y0 double, x1 double, y1 double"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---------------------------------------------------------------- pages
def test_reading_order(spark):
    lines = [(1, 0, 0, "r1", 320.0, 10.0, 500.0, 20.0)] + [(1, 0, k, f"l{k}", 48.0, 10.0 * k, 250.0, 10.0 * k + 9) for k in range(1, 4)]
    b = spark.createDataFrame(lines, "doc_id long, pno int, ln int, line string, x0 double, y0 double, x1 double, y1 double")
    got = P.plain_text(b, 595.0).first()
    assert got.text == "[PAGE 1]\n\nl1\n\nl2\n\nl3\n\nr1" and got.chars == 8
    two = b.union(b.withColumn("x0", F.lit(320.0)).withColumn("x1", F.lit(500.0)).where("ln in (1, 2)"))
    assert not P.two_columns(two, 595.0).first().two_col  # balanced pages count as single


def test_page_filters(spark):
    pages = spark.createDataFrame([(1, 0, "See discussions, stats, and author profiles at x", 1), (1, 1, "", 1), (1, 2, None, 0), (2, 0, "text", 2)], "doc_id long, pno int, text string, n_images int")
    assert rows(P.without_cover(pages).select("doc_id", "pno")) == [(1, 1), (1, 2), (2, 0)]
    assert rows(P.needs_ocr(pages).select("doc_id", "pno")) == [(1, 1)]
    scans = pages.withColumn("image", F.lit(b"abc"))
    assert [r.text for r in adapters.recognised(scans, lambda b: b.decode() * 2).orderBy("doc_id", "pno").collect()] == ["See discussions, stats, and author profiles at x", "abcabc", None, "text"]
    para = spark.createDataFrame([(1, 0, k, "中文字") for k in range(3)] + [(1, 0, 3, "english words")] + [(2, 0, 0, "english")], "doc_id long, pno int, seq int, text string")
    assert {r.doc_id: r.rejected for r in P.cjk_gate(para).collect()} == {1: True, 2: False}
    assert P.cjk_gate(para, first=0).count() == 0
    refs = spark.createDataFrame([(1, 0, k, f"Smith, A. and Lee, B. (Nature) {2000 + k}") for k in range(4)] + [(1, 1, 0, "text")], "doc_id long, pno int, ln int, line string")
    assert rows(P.bibliography_pages(refs)) == [(1, 0)]
    assert rows(P.pages_in(refs, F.lit("2"), F.lit(2)).select("pno")) == [(1,)]


# ---------------------------------------------------------------- aggregates
def test_aggregates(spark):
    spans = spark.createDataFrame([("a", "CMMI10", "x"), ("a", "Times", "words " * 30), ("a", "Odd", "∑∑"), ("b", None, "y")], "doc_id string, font string, text string")
    got = {(r.doc_id, r.font): r.is_math for r in A.font_census(spans).collect()}
    assert got == {("a", "CMMI10"): True, ("a", "Times"): False, ("a", "Odd"): True, ("b", "?"): False}
    t = spark.createDataFrame([("k", 9.0, 5, 2), ("k", 10.0, 5, 1), ("k", 11.0, 4, 0)], "k string, v double, w int, o int")
    assert A.weighted_mode(t, ["k"], F.col("v"), F.col("w"), "o").first().value == 10.0
    q = spark.createDataFrame([("k", float(v)) for v in (1, 2, 3, 4)], "k string, v double")
    assert tuple(A.floor_rank(q, ["k"], "v", {"lo": 0.0, "mid": 0.5, "hi": 1.0}).first()) == ("k", 4, 1.0, 3.0, 4.0)
    jobs = spark.createDataFrame([("a", "done", 1.0), ("b", "lost", 0.0), ("c", "running", 0.5)], "id string, status string, progress double")
    assert tuple(A.job_summary(jobs).first()) == (1, 1, 1, 0.5, "running") and A.job_summary(jobs.limit(0)).first().overall == "idle"
    tr = spark.createDataFrame([(1, None), (2, ""), (2, None), (2, "x"), (3, "x")], "doc_id long, text string")
    assert {r.doc_id: r.mass_failure for r in A.mass_failures(tr).collect()} == {1: False, 2: True, 3: False}
    style = spark.createDataFrame([(1, 0, 0, 0, "abc", "X-Bold", 10.0), (1, 0, 0, 0, "d", "X", 20.0)], "doc_id long, pno int, block_no int, line_no int, text string, font string, size double")
    r = A.line_style(style).first()
    assert (r.size, r.is_bold, r.is_italic) == (12.5, True, False)
    boxes = spark.createDataFrame([(1, 0, 0, 0.0, 0.0, 10.0, 10.0), (1, 0, 1, 90.0, 90.0, 100.0, 100.0)], BOX)
    assert tuple(A.bounds(boxes, ["doc_id"]).first()) == (1, 0.0, 0.0, 100.0, 100.0) and not A.ink(boxes, ["doc_id"]).first().dense


# ---------------------------------------------------------------- intervals
@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 12)), max_size=12))
def test_merge_and_complement(spark, spans):
    df = spark.createDataFrame([(1, float(a), float(a + n)) for a, n in spans], "k long, lo double, hi double").coalesce(1)
    merged = sorted((r.lo, r.hi) for r in I.merge(df, ["k"]).collect())
    held = np.zeros(800, bool)
    for a, n in spans:
        held[10 * a : 10 * (a + n)] = True
    mine = np.zeros(800, bool)
    for a, z in merged:
        mine[int(10 * a) : int(10 * z)] = True
    assert (held == mine).all() and all(x[1] < y[0] for x, y in zip(merged, merged[1:], strict=False))
    if spans:
        m = I.merge(df, ["k"]).withColumns({"a": F.lit(5.0), "z": F.lit(50.0)})
        free = np.zeros(800, bool)
        for r in I.complement(m, ["k"], "a", "z").collect():
            free[int(10 * r.lo) : int(10 * r.hi)] = True
        inside = any(a < 50 and a + n > 5 for a, n in spans)
        assert not inside or (free[50:500] == ~held[50:500]).all()


def test_pack_lines(spark):
    w = spark.createDataFrame([(1, 0.0, 25.0), (1, 40.0, 45.0), (1, 60.0, 80.0)], "k long, lo double, hi double")
    got = rows(I.pack_lines(w, ["k"], 10.0, spark.createDataFrame([(1, i) for i in range(6)], "k long, line int")))
    assert got == [(1, 0, 0, 0.0), (1, 1, 0, 10.0), (1, 2, 1, 60.0), (1, 3, 1, 70.0)]


# ---------------------------------------------------------------- joins
def test_translation_joins(spark):
    p = spark.createDataFrame([(1, 0, k, f"s{k}", 1.04, 2.06) for k in range(3)], "doc_id long, pno int, seq int, text string, x0 double, y0 double")
    t = spark.createDataFrame([(1, 0, 0, "t0"), (1, 0, 1, "")], "doc_id long, pno int, seq int, text string")
    assert [r.translated for r in J.with_translations(p, t).orderBy("seq").collect()] == ["t0", "[翻译失败] s1", "[翻译失败] s2"]
    assert [r.translated for r in J.with_translations(p, t, F.lit("syn")).orderBy("seq").collect()] == ["t0", "syn", "syn"]
    d = J.dump(p, t)
    assert [(r.seq, r.x0, r.y0, r.src, r.text) for r in d.orderBy("seq").collect()] == [(0, 1.0, 2.1, "s0", "t0"), (1, 1.0, 2.1, "s1", "")]
    assert json.loads(tables.dump_json(d).first().json)["pages"][0]["paragraphs"][0]["src"] == "s0"


def test_remap(spark):
    p = spark.createDataFrame([(1, 0, 0, "same", 0.0, 0.0), (1, 0, 1, "near", 0.0, 10.0), (1, 0, 2, "far", 0.0, 20.0), (1, 0, 3, "tie", 0.0, 30.0)], "doc_id long, pno int, seq int, text string, x0 double, y0 double")
    old = [(0, "same", "first", 0.0, 50.0), (1, "same", "last", 0.0, 60.0), (2, "a", "near1.5", 0.0, 11.5), (3, "b", "1.51", 0.0, 21.51), (4, "c", "tie1", 0.0, 31.0), (5, "d", "tie2", 0.0, 29.0), (6, "", "empty", 0.0, 20.0)]
    o = spark.createDataFrame([(1, 0, *r) for r in old], "doc_id long, pno int, ord int, src string, text string, x0 double, y0 double")
    assert [(r.found, r.how) for r in J.remap(p, o).orderBy("seq").collect()] == [("last", "exact"), ("near1.5", "nearest"), (None, None), ("tie1", "nearest")]


def test_place_joins(spark):
    b = spark.createDataFrame([(1, 0, 0, 0.0, 0.0, 10.0, 10.0), (1, 0, 1, 100.0, 0.0, 110.0, 10.0), (2, 0, 2, 0.0, 0.0, 10.0, 10.0)], BOX)
    reg = spark.createDataFrame([(1, 0, 0.0, 0.0, 12.0, 6.0)], "doc_id long, pno int, r_x0 double, r_y0 double, r_x1 double, r_y1 double")
    assert rows(J.touching(b, reg, J.covers(0.6), "left_semi").select("item")) == [(0,)] and rows(J.touching(b, reg, J.covers(0.7), "left_anti").select("item")) == [(0,), (1,), (2,)]
    assert {r.item: r.f_x1 for r in J.formula_union(b, reg).collect()} == {0: 12.0, 1: None, 2: None}
    rect = lambda *v: G.rect(*[F.lit(float(x)) for x in v])
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    no = F.array().cast(f"array<{G.RECT}>")
    assert one(J.in_table(rect(0, 0, 10, 10), F.array(rect(0, 0, 10, 6)), no)) and not one(J.in_table(rect(0, 0, 10, 10), F.array(rect(50, 0, 60, 6)), no))
    assert one(J.in_table(rect(0, -9, 10, 1), F.array(rect(0, 0, 100, 100)), no)) and not one(J.in_table(rect(0, -9, 10, 1), F.array(rect(0, 0, 100, 100)), F.array(rect(0, -9, 10, 1))))
    assert one(J.line_in_tables(rect(0, 0, 10, 2), F.array(rect(0, 6, 10, 9)))) and not one(J.line_in_tables(rect(0, 0, 3, 2), F.array(rect(0, 6, 10, 9))))
    kept = one(J.dedupe_rects(F.array(rect(0, 0, 10, 10), rect(1, 1, 9, 9), rect(20, 0, 30, 10))))
    assert [k.x0 for k in kept] == [0.0, 20.0]
    fill = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    assert one(J.light_fill(rect(0, 0, 80, 80), fill(0.95, 0.95, 0.95), F.lit(None).cast("array<double>"))) and not one(J.light_fill(rect(0, 0, 8, 8), fill(0.95, 0.95, 0.95), F.lit(None).cast("array<double>")))
    assert one(J.white_fill(rect(0, 0, 9, 5), fill(1, 0.97, 1))) and not one(J.white_fill(rect(0, 0, 9, 5), fill(1, 0.9, 1)))
    cells = F.array(*[F.array(F.lit("a"), F.lit("b"), F.lit("c")) for _ in range(3)])
    assert one(J.table_credible(F.lit(3), F.lit(3), rect(0, 0, 100, 100), F.lit(500_000.0), F.lit("text"), cells)) and not one(J.table_credible(F.lit(2), F.lit(1), rect(0, 0, 100, 100), F.lit(500_000.0), F.lit("lines"), cells))


def test_components_and_figures(spark):
    chain = [(1, 0, k, 40.0 * k, 0.0, 40.0 * k + 39.5, 30.0) for k in range(12)] + [(1, 0, 50, 0.0, 500.0, 10.0, 510.0), (1, 0, 60, 0.0, 0.0, 590.0, 5.0)]
    b = spark.createDataFrame(chain, BOX)
    pairs = J.touching_pairs(b)
    comp = {r.item: r.component for r in D.label_components(b, pairs).collect()}
    assert {comp[k] for k in range(12)} == {0} and comp[50] == 50 and comp[60] == 60  # wide ones meet only wide ones
    named = b.join(D.label_components(b, pairs), ["doc_id", "pno", "item"])
    label = spark.createDataFrame([(1, 0, 10.0, 5.0, 60.0, 15.0, 8)], "doc_id long, pno int, x0 double, y0 double, x1 double, y1 double, n_chars int")
    assert rows(D.figure_regions(named, label, 595.0).select("component")) == [(0,)] and D.figure_regions(named, label.where("n_chars > 48"), 595.0).count() == 0
    assert D.label_components(b.limit(0), pairs.limit(0)).count() == 0


def test_sparse_figures(spark):
    """JOIN-17 at its bounds: a page for each case, one rectangle of 100 by 100 on each."""
    box = lambda n, text="a", wide=50.0, x=10.0: [(x, 10.0 + k, x + wide, 20.0 + k, text) for k in range(n)]
    cases = [(box(1), 1), (box(8), 1), (box(9), 0), (box(0), 0), (box(1, "x" * 48), 1), (box(1, "x" * 49), 0), (box(2) + box(1, "End."), 0), (box(1, "a", 72.0), 0), (box(1, "a", 71.0), 1), (box(1, "a", 50.0, 60.0), 1), (box(1, "a", 50.0, 61.0), 0), (box(1, ""), 0)]
    texts = [(1, p, *t) for p, (ts, _) in enumerate(cases) for t in ts] + [(1, 100 + k, *box(1)[0]) for k in range(3)]
    t = spark.createDataFrame(texts, "doc_id long, pno int, x0 double, y0 double, x1 double, y1 double, text string")
    rects = [(1, p, 0, 0.0, 0.0, 100.0, 100.0, True) for p in range(len(cases))] + [(1, 100, 0, 0.0, 0.0, 89.0, 100.0, True), (1, 101, 0, 0.0, 0.0, 400.0, 500.0, True), (1, 102, 0, 0.0, 0.0, 100.0, 100.0, False)]
    r = spark.createDataFrame(rects, BOX + ", stroked boolean")
    got = J.sparse_figures(r, t, 595.0 * 842.0)
    assert {x.pno for x in got.collect()} == {p for p, (_, ok) in enumerate(cases) if ok}
    figures = spark.createDataFrame([(9, 0, 1.0, 1.0, 2.0, 2.0)], "doc_id long, pno int, r_x0 double, r_y0 double, r_x1 double, r_y1 double")
    assert D.vector_regions(figures, got).count() == 1 + got.count() and J.sparse_figures(r.limit(0), t, 1.0).count() == 0


def test_overlaps(spark):
    cols = "doc_id long, pno int, ln int, line string, base double, x0 double, x1 double, size double, y0 double, y1 double"
    mk = lambda k, base, text: (1, 0, k, text, base, 0.0, 100.0, 10.0, base - 8, base + 2)
    src = spark.createDataFrame([mk(0, 100.0, "a"), mk(1, 112.0, "b")], cols)
    out = spark.createDataFrame([mk(0, 100.0, "a"), mk(1, 105.0, "b"), mk(2, 105.2, "c")], cols)
    assert rows(J.overlap_pairs(out).select("a", "b")) == [(0, 1), (0, 2)]
    assert rows(J.overlap_pairs(spark.createDataFrame([mk(0, 100.0, "a"), mk(1, 100.4, "b"), mk(2, 105.0, "c")], cols)).select("a", "b")) == [(1, 2)]
    assert rows(J.overlap_pairs(spark.createDataFrame([mk(0, 100.0, "a"), mk(1, 100.4, "b"), mk(2, 105.0, "c")], cols), 0.98, stop=False).select("a", "b")) == [(0, 2), (1, 2)]
    new = J.new_pairs(J.overlap_pairs(out), J.overlap_pairs(src))
    fills = spark.createDataFrame([(1, 0, 0.0, 97.0, 100.0, 107.0)], "doc_id long, pno int, x0 double, y0 double, x1 double, y1 double")
    assert new.count() == 2 and J.without_ghosts(new, out, fills).count() == 0
    assert rows(J.new_tails(out, src).select("line")) == [("c",)]
    images = spark.createDataFrame([(1, 0, 1, 2)], "doc_id long, pno int, images_src int, images_out int")
    got = Q.verify(out, src, fills, images).first()
    assert (got.overlaps, got.new_images, got.bad_pages, got.strict_exit) == (0, 1, 0, 1)


def test_small_joins(spark):
    t = lambda data, schema: spark.createDataFrame(data, schema)
    assert rows(J.first_existing(t([("n", "d1", 1), ("n", "d2", 0)], "name string, dir string, ord int"), t([("d1", "n")], "dir string, name string"))) == [("n", "d1/n")]
    assert rows(J.profile(t([("a",), ("b",)], "provider string"), t([("a", "u")], "provider string, endpoint string"), t([("a", "m"), ("b", "m2")], "provider string, endpoint string"))) == [("a", "u"), ("b", "m2")]
    assert rows(J.scan_rules(t([("see sk-1234567890abcdefXYZ /home/me/x",), ("fine",)], "text string")).select("rule")) == [("api_key",), ("home_path",)]
    assert rows(J.routable(t([("a", ["m"]), ("b", []), ("c", ["m"])], "id string, models array<string>"), F.array(F.lit("a"))).select("id")) == [("a",)]
    assert rows(J.first_of(t([("a", 2), ("a", 1)], "k string, o int"), ["k"], "o")) == [("a", 1)]
    assert J.top_by_area(t([(1, 0, k, 0.0, 0.0, float(k), 1.0) for k in range(5)], BOX), 2).count() == 2


# ---------------------------------------------------------------- folds
def test_islands(spark):
    ln = spark.createDataFrame([(1, 0, k, 48.0 if s == "l" else 320.0 if s == "r" else 290.0, 0.0, 60.0 if s == "l" else 500.0 if s == "r" else 305.0, 9.0) for k, s in enumerate("llgrrl")], "doc_id long, pno int, ln int, x0 double, y0 double, x1 double, y1 double")
    assert [r.part for r in D.split_by_side(ln, 297.5, ["doc_id", "pno"], ["ln"]).orderBy("ln").collect()] == [0, 0, 0, 1, 1, 2]
    assert rows(D.split_at_bands(ln, F.col("ln").isin(2, 3), ["doc_id", "pno"], ["ln"]).select("ln", "piece")) == [(0, 0), (1, 0), (4, 2), (5, 2)]
    z = spark.createDataFrame([(1, 0, k, t, k == 3) for k, t in enumerate(["a", "References", "b", "Appendix A", "c"])], "doc_id long, pno int, ord int, first string, is_heading boolean")
    flags = lambda a: [r.in_zone for r in D.reference_zone(z, a).orderBy("ord").collect()]
    assert flags(False) == [False, True, True, True, True] and flags(True) == [False, True, True, False, False]
    sp = spark.createDataFrame([(1, 0, 0, 0, k, t, m, float(k), 0.0, k + 0.9, 5.0) for k, (t, m) in enumerate([("a", False), ("b", False), ("x", True), ("y", True), ("c", False)])] + [(1, 0, 0, 1, 0, "plain", False, 0.0, 0.0, 1.0, 1.0)], "doc_id long, pno int, block_no int, line_no int, span_no int, text string, is_math boolean, x0 double, y0 double, x1 double, y1 double")
    assert [(r.kind, r.text) for r in D.span_runs(sp).orderBy("run_no").collect()] == [("t", "ab"), ("m", "xy"), ("t", "c")]
    rects = spark.createDataFrame([(1, 0, 0, 0.0, 0.0, 10.0, 10.0), (1, 0, 1, 12.0, 1.0, 20.0, 11.0), (1, 0, 2, 30.0, 0.0, 40.0, 10.0)], BOX)
    assert rows(D.accumulate_rects(rects, ["doc_id"]).select("x0", "x1")) == [(0.0, 20.0), (30.0, 40.0)]
    assert D.numeric_columns(rects.withColumn("y1", F.lit(200.0)), 595.0).first().columns == 2


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(0, 5000)), min_size=1, max_size=40))
def test_batches_by_rule(items):
    """The rule in plain form, held against the expression's invariants below."""
    out, shut, k, c, b = [], True, 0, 0, -1
    for heading, n in items:
        if shut or heading or k >= 14 or (k and c + n > 3600):
            b, k, c = b + 1, 0, 0
        k, c, shut = k + 1, c + n, heading
        out.append(b)
    for g in set(out):
        part = [x for x, y in zip(items, out, strict=True) if y == g]
        assert len(part) <= 14 and (len(part) == 1 or (sum(n for _, n in part) <= 3600 and not any(h for h, _ in part)))


def test_batches(spark):
    items = [(k, "x" * n, h) for k, (n, h) in enumerate([(3000, False), (700, False), (10, True), *[(10, False)] * 16, (9000, False)])]
    df = spark.createDataFrame([(1, *i) for i in items], "doc_id long, seq int, text string, is_heading boolean")
    assert [r.batch_no for r in D.batched(df).orderBy("seq").collect()] == [0, 1, 2, *[3] * 14, 4, 4, 5]


def test_block_and_paragraph_folds(spark):
    blk = lambda k, y, text, math=False, x0=48.0: (1, 0, k, x0, y, x0 + 200, y + 10.0, 10.0, math, text)
    b = [blk(1, 0.0, ["T"]), blk(2, 1.0, ["he first para-"]), blk(3, 12.0, ["graph goes on"]), blk(4, 40.0, ["Abstract"]), blk(5, 60.0, ["A new one."]), blk(6, 100.0, ["x = y"], True), blk(7, 101.0, ["z"], True), blk(8, 130.0, ["1 2 3 4"])]
    df = spark.createDataFrame(b, D.BLOCK)
    merged = [(r.ord, list(r.lines)) for r in D.merge_blocks(df, 297.5).orderBy("ord").collect()]
    assert merged[0] == (1, ["T", "he first para-", "graph goes on"]) and len(merged) == 6
    p = D.assemble_paragraphs(D.merge_blocks(df, 297.5)).orderBy("seq").collect()
    assert [(r.kind, r.is_heading, r.is_skip, r.text) for r in p] == [("t", False, False, "T he first paragraph goes on"), ("t", True, False, "Abstract"), ("t", False, False, "A new one."), ("m", False, False, ""), ("t", False, True, "1 2 3 4")]
    line = lambda t, bold=False, italic=False: {"text": t, "bold": bold, "italic": italic}
    assert [len(g) for g in D.split_headings([line("a"), line("Title", True), line("b" * 40), line("IV. Next"), line("c")])] == [1, 1, 1, 2]
    toks = [{"kind": "t", "text": "a"}, {"kind": "t", "text": "b"}, {"kind": "m", "rect": (0, 0, 5, 5)}, {"kind": "t", "text": " , "}, {"kind": "m", "rect": (7, 0, 9, 5)}, {"kind": "t", "text": "^_{"}]
    got = D.compact_tokens(toks, lambda t: t == "^_{")
    assert [t["kind"] for t in got] == ["t", "m"] and got[0]["text"] == "a b" and got[1]["rect"] == (0, 0, 9, 5)


# ---------------------------------------------------------------- layout
def test_solver_invariants():
    rng = np.random.default_rng(3)
    for _ in range(25):
        paras, y = [], 40.0
        for _ in range(rng.integers(1, 8)):
            h = float(rng.integers(15, 90))
            paras.append({"x0": 48.0, "y0": y, "x1": 278.0, "y1": y + h, "size": 10.0, "text": "译文 word " * int(rng.integers(1, 40))})
            y += h + 5
        bands = [(100.0, 200.0, 300.0, 230.0)]
        ratio, plans = L.solve_page(paras, bands, 842.0)
        assert 0 <= ratio <= 1 and len(plans) == len(paras)
        for p, plan in zip(paras, plans, strict=True):
            assert plan.why or (plan.height >= plan.size and plan.size >= L.LEAST_FONT)
            for base, _ in plan.lines:
                top = base - plan.size
                assert not (top < 230 - 0.6 and base > 200 + 0.6 and p["x0"] < 300), "in the obstacle"


def test_fit_box_and_gaps():
    assert L.gaps(0, 100, 0, 100, [(0, 20, 50, 30), (0, 25, 50, 40), (0, 98, 50, 100)]) == [(0, 20), (40, 98)] and L.gaps(0, 1, 0, 0.5, []) == []
    plan = L.fit_box("words in a box of some size", 100, 40, 14, 4)
    assert plan.why is None and 4 <= plan.size <= 14 and len(plan.lines) * plan.height <= 40
    assert L.fit_box("long " * 500, 20, 5, 14, 10).why == "overflow"


def test_layout_tables(spark):
    cols = "doc_id long, pno int, x0 double, y0 double, x1 double, y1 double"
    seg = spark.createDataFrame([(1, 0, 10.0, 10.0, 50.0, 20.0)], cols)
    reg = spark.createDataFrame([(1, 0, 30.0, 0.0, 60.0, 40.0)], cols)
    assert [(r.op, r.x0, r.x1) for r in L.erase_rects(seg, reg).collect()] == [("erase", 9.5, 30.0)]
    assert L.obstacles(reg, seg, seg, seg.limit(0)).count() == 1 and L.obstacles(reg, seg, seg.limit(0), seg.limit(0)).count() == 2
    ops = spark.createDataFrame([(1, 0, 0, "text", 0.0, 100.0, 10.0, "hit", 50.0), (1, 0, 1, "text", 0.0, 300.0, 10.0, "free", 50.0)], "doc_id long, pno int, seq int, op string, x double, y double, size double, text string, width double")
    kept = spark.createDataFrame([(1, 0, 0.0, 90.0, 80.0, 101.0)], cols)
    assert rows(L.without_collisions(ops, kept).select("text")) == [("free",)]
    ls = spark.createDataFrame([(1, 0, 0, 0.0, 40.0, False, 50), (1, 0, 1, 0.0, 200.0, False, 50)], "doc_id long, pno int, seq int, x0 double, x1 double, is_math boolean, n_chars int")
    assert {r.seq: r.x1 for r in L.paragraph_span(ls).collect()} == {0: 200.0, 1: 200.0}
    glyphs = spark.createDataFrame([("a",), ("b",)], "cp string")
    text = spark.createDataFrame([(1, 0, 0, "ab✓ a")], "doc_id long, pno int, seq int, text string")
    assert rows(L.missing_glyphs(text, glyphs).select("op", "cp")) == [("crop", "✓")]


# ---------------------------------------------------------------- sources
def test_kept_sizes(spark):
    texts = ["⟨1⟩ a_i ⟨3⟩⟨2⟩", "⟨0⟩中", "", None, " ⟨12⟩ ", "plain words"]
    some = spark.createDataFrame([(t, n, f"{i}{n}") for i, t in enumerate(texts) for n in (None, -1, 0, 1, 3, 20)], "text string, formulas long, key string")
    by_list = some.withColumn("a", R.kept_marks(R.atoms_column(F.col("text")), F.coalesce("formulas", F.lit(0)))).select("key", F.size("a").alias("n"), F.size(F.filter("a", lambda a: a["kind"] == "math")).alias("marks"))
    got = L.kept_sizes(some)
    assert got.dtypes == by_list.dtypes and sorted(got.collect()) == sorted(by_list.collect())
    assert {r.key: (r.n, r.marks) for r in got.collect()}["01"] == (5, 1)


def test_tables(spark, tmp_path):
    (tmp_path / "dump.json").write_text(json.dumps({"pages": [{"pno": 1, "paragraphs": [{"pid": [1, 7], "src": "s", "text": "t", "x0": 1.0}]}]}))
    assert [(r.pno, r.seq, r.src, r.text) for r in tables.read_dump(spark, f"{tmp_path}/dump.json").collect()] == [(1, 7, "s", "t")]
    (tmp_path / "jobs.json").write_text(json.dumps({"version": 1, "jobs": [{"id": "a", "pdf_path": "p"}, {"id": None, "pdf_path": "q"}, {"id": "c", "pdf_path": "r", "odd": 1}]}))
    assert [r.id for r in tables.read_ledger(spark, f"{tmp_path}/jobs.json").collect()] == ["c", "a"]
    (tmp_path / "glossary.md").write_text("\n# word: 词\nplain\n`x`: y\n")
    assert tables.read_glossary(spark, f"{tmp_path}/glossary.md").first().terms == 1
    f = spark.createDataFrame([(0, "a b.pdf", bytearray(b"%PDF-1")), (1, "x/a b.pdf", bytearray(b"%PDF-2")), (2, "no.pdf", bytearray(b"GIF89"))], "ord int, name string, content binary")
    assert [r.stored for r in tables.uploads(f).orderBy("ord").collect()] == ["a b.pdf", "a b-1.pdf"]
    im = spark.createDataFrame([(1, 0, 0, 0.0, 0.0, 50.0, 50.0), (1, 0, 1, 0.2, 0.1, 50.1, 50.0), (1, 0, 2, 0.0, 0.0, 20.0, 50.0)], BOX)
    assert tables.image_rects(im, 25).count() == 2 and tables.image_rects(im, 40, True).count() == 1
    reg = tables.protected_regions(im.where("item = 0"), im.where("item = 1"), im.where("item = 0"))
    assert {r.kind for r in reg.collect()} == {"img", "table"}
    jobs = spark.createDataFrame([("a", ["/o/x.md"])], "id string, output_paths array<string>")
    assert rows(tables.whitelisted(spark.createDataFrame([("a", "/o/x.md"), ("a", "/etc/passwd")], "id string, path string"), jobs)) == [("a", "/o/x.md")]
    boxes = spark.createDataFrame([("title", 0.0, 0.0, 1.0, 1.0), ("odd", 0.0, 0.0, 1.0, 1.0), ("title", 1.0, 0.0, 1.0, 1.0)], "label string, x0 double, y0 double, x1 double, y1 double")
    assert tables.layout_boxes(boxes).count() == 1


def test_transport():
    calls = []

    def flaky(prompt):
        calls.append(prompt)
        return (503, "busy", "") if len(calls) < 3 else (200, "1. eins\n2) zwei\n2、drei", "stop")

    waits = []
    assert M.ask(["a", "b"], flaky, waits.append) == ({1: "eins", 2: "drei"}, None) and waits == [2, 5] and calls[0] == "1. a\n2. b"
    calls.clear()
    assert M.ask(["a"], lambda p: (calls.append(p), (401, "no", ""))[1], waits.append) == ({}, "HTTP 401") and len(calls) == 1
    got, error = M.ask(["a", "b"], lambda p: (200, "1. eins", "stop"), lambda s: None)
    assert got == {1: "eins"} and "missing" in error
    assert M.ask(["a"], lambda p: (200, "1. cut", "length"), lambda s: None)[1] == "truncated"
    assert M.content_of({"choices": [{"message": {"content": "x"}, "finish_reason": "stop"}]}) == ("x", "stop") and M.content_of({"content": [{"text": "a"}, {"text": "b"}], "stop_reason": "end"}, True) == ("ab", "end")
    assert "chat_template_kwargs" in M.request_body("Qwen-7B", "p", "s") and M.request_body("m", "p", "s", True)["max_tokens"] == 8192
    tick = iter(range(100))
    assert M.wait_until_serving(lambda p: (200 if next(tick) > 3 else 503, "", ""), clock=lambda: 0, wait=lambda s: None)


def test_translate_pipeline(spark, sf):
    lay = pseudo_layout(spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 6"))
    t = Q.translate(lay)
    stats = {r.doc_id: r.asDict() for r in t.stats.collect()}
    done = t.results.groupBy("doc_id").agg(F.count_if(F.col("text").isNotNull()).alias("n")).collect()
    assert done and all(r.n == stats[r.doc_id]["translatable"] for r in done)
    assert t.dump.count() == sum(r.n for r in done) and t.markdown.count() == len(stats) and t.bilingual.count() >= 1
    regions = spark.createDataFrame([(0, 0, 48.0, 300.0, 250.0, 400.0)], "doc_id long, pno int, x0 double, y0 double, x1 double, y1 double")
    tr = t.dump.select("doc_id", "pno", "seq", "text")
    plans, ops = Q.relayout(t.paragraphs.select("doc_id", "pno", "seq", "x0", "y0", "x1", "y1", "size", "text"), tr, regions)
    assert plans.count() == tr.count() and ops.count() == plans.agg(F.sum(F.when(F.col("why").isNull(), F.col("n_lines")).otherwise(0))).first()[0]
    assert L.warnings(plans).count() <= plans.count()


# ---------------------------------------------------------------- stream
REC = [
    ("a", 1000, 0, 10**9, True, "translate", 10, 20, None, None), ("a", 2000, 0, 10**9, True, None, None, None, True, None),
    ("b", 1000, 0, 10**9, True, None, None, None, False, "x" * 400), ("c", 5000, 0, 4000, True, "extract", None, None, None, None),
    ("d", 1000, 0, 10**9, False, "ocr", None, None, None, None),
]


def test_watcher_stream(spark, tmp_path):
    spark.createDataFrame(REC, W.RECORD).coalesce(1).write.json(f"{tmp_path}/in")
    q = W.watch(spark.readStream.schema(W.RECORD).json(f"{tmp_path}/in")).writeStream.format("memory").queryName("seen").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="200 milliseconds").start()
    try:  # with processing-time timers the stream never runs dry, so wait for the rows
        end = time.monotonic() + 60
        while spark.table("seen").count() < 5 and time.monotonic() < end:
            time.sleep(0.5)
        got = {(r.job_id, r.status): r for r in spark.table("seen").collect()}
    finally:
        q.stop()
    assert got["a", "running"].progress == pytest.approx(0.485) and got["a", "done"].progress == 1.0
    assert len(got["b", "failed"].error) == 300 and got["c", "failed"].reason == "timeout" and got["d", "running"].progress == 0.0
    assert W.next_share(0.5, "ocr", 1, 2) == 0.5 and W.next_share(0.02, "extract", None, None) == 0.03 and W.next_share(0.028, "extract", None, None) == 0.028


def test_batch_watcher(spark):
    records = spark.createDataFrame(REC, W.RECORD)
    jobs = spark.createDataFrame([(k, "running", 0, 4000 if k == "c" else 10**9, None, 0.0, None) for k in "abcde"], "id string, status string, created_at long, timeout_at long, ended_at long, progress double, error string")
    got = {r.id: (r.status, r.reason) for r in W.settle(jobs, records, F.lit(200_000)).collect()}
    assert got == {"a": ("done", "result"), "b": ("failed", "result"), "c": ("failed", "timeout"), "d": ("failed", "stale"), "e": ("failed", "never started")}
    ledger = W.apply_settled(jobs, W.settle(jobs, records, F.lit(200_000)), F.lit(200_000).cast("long"))
    assert {r.id: r.status for r in ledger.collect()} == {k: v[0] for k, v in got.items()} and W.cleared(ledger).count() == 0
    again = W.retried(ledger, "b", "b2", 7)
    assert {r.id: r.status for r in again.collect()}["b2"] == "running"
