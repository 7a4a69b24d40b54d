"""The whole plan on a small paper of two pages, and requests counted."""

import pytest
from pyspark.sql import functions as F

from quire.operators import layout as L
from quire.plans import pipelines as Q

BOX = "x0 double, y0 double, x1 double, y1 double"
SENTENCE = ["The method is tested on data of", "many kinds and works well there.", "We report what was found and what", "was not, with all the details."]


def spans_of(pno):
    """A title, fourteen paragraphs in two columns, a display formula and a figure with a label."""
    rows, block = [(0, pno, 0, 0, 0, f"A Study of Documents and their Pages, Part {pno}", "Times-Bold", 16.0, 48.0, 48.0, 420.0, 66.0, 62.0)], 1
    for x in (48.0, 312.0):
        for i in range(7):
            y = 90.0 + 62 * i
            for k, t in enumerate(SENTENCE):
                rows.append((0, pno, block, k, 0, t, "Times-Roman", 10.0, x, y + 12 * k, x + 200, y + 12 * k + 11, y + 12 * k + 9))
            block += 1
    rows.append((0, pno, block, 0, 0, "x = y + z     (1)", "CMMI10", 12.0, 48.0, 575.0, 180.0, 589.0, 586.0))
    rows.append((0, pno, block + 1, 0, 0, "input stage", "Times-Roman", 10.0, 335.0, 600.0, 395.0, 611.0, 609.0))
    return rows


@pytest.fixture(scope="module")
def paper(spark):
    spans = spark.createDataFrame([r for p in (0, 1) for r in spans_of(p)], f"doc_id long, pno int, block_no int, line_no int, span_no int, text string, font string, size double, {BOX}, origin_y double")
    pages = spark.createDataFrame([(0, 0, 1), (0, 1, 1), (1, 0, 1)], "doc_id long, pno int, n_images int")  # document 1 is a scan
    drawings = spark.createDataFrame([(0, p, 0, 315.0, 560.0, 530.0, 655.0, True) for p in (0, 1)], f"doc_id long, pno int, item int, {BOX}, stroked boolean")
    images = spark.createDataFrame([(0, p, 0, 48.0, 620.0, 220.0, 706.0) for p in (0, 1)], f"doc_id long, pno int, item int, {BOX}")
    tables = spark.createDataFrame([], f"doc_id long, pno int, {BOX}, strategy string, row_count int, col_count int, cells array<array<string>>")
    layout = spark.createDataFrame([], f"doc_id long, pno int, label string, {BOX}")
    return Q.document(spans, pages, drawings, images, tables, layout), images


def test_whole_paper(spark, paper, tmp_path):
    d, images = paper
    p = {(r.pno, r.seq): r for r in d.paragraphs.collect()}
    texts = [r.text for r in p.values()]
    assert not any("input stage" in t for t in texts) and sum(r.is_math for r in p.values()) == 2 and sum(t.startswith("The method is tested") for t in texts) >= 2
    assert {(r.kind, r.pno) for r in d.regions.collect()} == {("img", 0), ("img", 1), ("vec", 0), ("vec", 1)}
    assert [(r.doc_id, r.pno) for r in d.scans.collect()] == [(1, 0)] and [(r.doc_id, r.rejected) for r in d.gate.collect()] == [(0, False)]

    t = Q.translated(d.paragraphs, folder=f"{tmp_path}/a")
    moves = t.dump.select("doc_id", "pno", "seq", "text")
    plans, ops = Q.relayout(t.paragraphs.select("doc_id", "pno", "seq", *Q.BOX, "size", "text"), moves, d.regions)
    kept = plans.where("why is not null")
    assert kept.count() == 0
    erased = L.erase_rects(t.paragraphs.join(moves.select("doc_id", "pno", "seq"), ["doc_id", "pno", "seq"]), d.regions)
    out = Q.drawn_lines(ops, d.lines, erased)
    assert out.where("line = 'input stage'").count() == 2 and out.where("line like 'The method%'").count() == 0
    # nothing is drawn on a region
    hit = ops.join(d.regions.select("doc_id", "pno", *[F.col(c).alias(f"r_{c}") for c in Q.BOX]), ["doc_id", "pno"]).where("y - 0.8 * size < r_y1 and y > r_y0 + 0.5 and x < r_x1 - 4 and x + 100 > r_x0 + 4 and x >= r_x0 - 20")
    assert hit.count() == 0
    counts = images.groupBy("doc_id", "pno").agg(F.count("*").alias("images_src")).withColumn("images_out", F.col("images_src"))
    fills = erased.select("doc_id", "pno", *Q.BOX).limit(0)
    verdict = Q.verify(out, d.lines, fills, counts).collect()
    assert [(r.doc_id, r.strict_exit) for r in verdict] == [(0, 0)], verdict


def test_each_batch_is_sent_once(spark, tmp_path):
    """One request for a batch over all outputs, and one more in each sweep for one that lacks an answer."""
    log = f"{tmp_path}/calls"

    def send(prompt):
        with open(log, "a") as f:  # workers are other processes
            f.write("call\n")
        return 200, "\n".join(f"{x.split('.')[0]}. 答 {x.split('.')[0]}" for x in prompt.split("\n") if "never" not in x), "stop"

    calls = lambda: sum(1 for _ in open(log))
    cols = f"doc_id long, pno int, seq int, {BOX}, size double, is_heading boolean, is_skip boolean, n_lines int, text string, is_math boolean, is_ref boolean, translatable boolean"
    row = lambda k, t: (1, 0, k, 0.0, 20.0 * k, 100.0, 20.0 * k + 10, 10.0, False, False, 1, t, False, False, True)
    p = spark.createDataFrame([row(k, f"text {k}") for k in range(20)], cols)
    t = Q.translated(p, send, f"{tmp_path}/one")
    for df in (t.results, t.markdown, t.bilingual, t.dump, t.stats):
        df.collect()
    assert calls() == 2 and t.results.where("text is null").count() == 0

    from quire.sources import transport as M

    items = spark.createDataFrame([(1, 0, [(0, "ok"), (1, "never")])], "doc_id long, batch_no int, items array<struct<seq:int,text:string>>")
    flat = items.select("doc_id", "batch_no", F.inline("items"))
    first = M.kept(M.translate(items, send, wait=lambda s: None), f"{tmp_path}/first")
    before = calls()
    swept = M.sweep(flat, first, send, f"{tmp_path}/two")
    assert {r.seq: r.text for r in swept.collect()} == {0: "答 1", 1: None} and swept.count() == 2
    assert calls() - before == 2  # two rounds, one request each
    late = iter((0.0, 1000.0, 1000.0, 1000.0))
    M.sweep(flat, first, send, f"{tmp_path}/three", clock=lambda: next(late)).collect()
    assert calls() - before == 2
