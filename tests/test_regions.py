"""Tables, formulas, figures and output lines on small literal tables."""

import pytest
from pyspark.sql import functions as F

from quire.operators import regions as R

BOX = "doc_id long, pno int, item int, x0 double, y0 double, x1 double, y1 double"
REG = "doc_id long, pno int, r_x0 double, r_y0 double, r_x1 double, r_y1 double"


def test_tables(spark):
    cells = [["a", "b", "c"]] * 3
    rows = [(1, 0, "lines", 3, 3, 0.0, 0.0, 100.0, 100.0, cells), (1, 0, "text", 3, 3, 1.0, 1.0, 100.0, 100.0, cells), (1, 0, "text", 3, 3, 200.0, 0.0, 300.0, 100.0, cells), (1, 1, "lines", 3, 3, 0.0, 0.0, 100.0, 100.0, cells), (1, 0, "ruled", 1, 5, 0.0, 0.0, 100.0, 100.0, cells)]
    b = spark.createDataFrame(rows, "doc_id long, pno int, strategy string, row_count int, col_count int, x0 double, y0 double, x1 double, y1 double, cells array<array<string>>")
    bib = spark.createDataFrame([(1, 1)], "doc_id long, pno int")
    num = spark.createDataFrame([(1, 0, 400.0, 0.0, 450.0, 90.0)], "doc_id long, pno int, x0 double, y0 double, x1 double, y1 double")
    assert sorted(r.x0 for r in R.page_tables(b, bib, num, 500_000.0).collect()) == [0.0, 200.0, 400.0]
    assert R.fallback_tables(b, 500_000.0).count() == 4


def test_formulas(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert one(R.formula_plausible(F.lit(2), F.lit(40.0), F.lit("a + b = c"))) and not one(R.formula_plausible(F.lit(2), F.lit(40.0), F.lit("considerable explanations follow")))
    spans = spark.createDataFrame([(1, 0, "CM", "x", 0.0, 0.0, 5.0, 5.0), (1, 0, "T", "y", 20.0, 0.0, 25.0, 5.0), (1, 0, "T", "\uf0e5", 40.0, 0.0, 45.0, 5.0), (1, 0, "T", "z", 60.0, 0.0, 65.0, 5.0)], "doc_id long, pno int, font string, text string, x0 double, y0 double, x1 double, y1 double")
    census = spark.createDataFrame([(1, "CM", True), (1, "T", False)], "doc_id long, font string, is_math boolean")
    boxes = spark.createDataFrame([(1, 0, 18.0, -2.0, 27.0, 8.0)], REG)
    assert {r.text: r.is_math for r in R.math_spans(spans, census, boxes).collect()} == {"x": True, "y": True, "\uf0e5": True, "z": False}
    t = R.inline_math(spans, ["doc_id", "pno"]).first().text
    assert t == "x y ∑ z"
    assert R.inline_math(spans.withColumn("text", F.lit("\ue000")), ["doc_id"]).first().text is None and R.inline_math(spans, ["doc_id"], most=3).first().text is None


def test_figures(spark):
    b = spark.createDataFrame([(1, 0, 0, 0.0, 0.0, 40.0, 10.0), (1, 0, 1, 200.0, 0.0, 240.0, 10.0)], BOX)
    reg = spark.createDataFrame([(1, 0, 0.0, 0.0, 100.0, 100.0)], REG)
    assert [r.item for r in R.without_pictures(b, reg).collect()] == [1] and [r.item for r in R.neutralized(b, reg).collect()] == [0]
    texts = b.withColumn("text", F.lit("Axis")).withColumn("n_lines", F.lit(1))
    assert [r.item for r in R.text_in_regions(texts, reg.withColumns({"threshold": F.lit(0.8), "kind": F.lit("vec")})).collect()] == [0]


def test_lines_and_lists(spark):
    s = spark.createDataFrame([(1, 0, 0, 0, 0, " ", 9.0, 0.0, 4.0, 50.0), (1, 0, 0, 0, 1, "ab", 10.0, 4.0, 20.0, 52.0), (1, 0, 0, 1, 0, " ", 10.0, 0.0, 4.0, 70.0), (1, 0, 0, 2, 0, "z", 0.0, 0.0, 4.0, 90.0)], "doc_id long, pno int, block_no int, line_no int, span_no int, text string, size double, x0 double, x1 double, origin_y double")
    r = R.output_lines(s).collect()
    assert len(r) == 1 and (r[0].line, r[0].size, r[0].base, r[0].x0, r[0].x1) == (" ab", 10.0, 52.0, 4.0, 20.0) and R.output_lines(s, True).count() == 2
    want = spark.createDataFrame([("regular", "a", 0), ("regular", "b", 1), ("bold", "c", 0)], "role string, font string, ord int")
    assert {x.role: x.font for x in R.fonts_of(want, spark.createDataFrame([("b",)], "font string")).collect()} == {"regular": "b", "bold": None}
    with pytest.raises(Exception, match="no regular font"):
        R.fonts_of(want, spark.createDataFrame([("c",)], "font string")).collect()
    m = lambda *v: spark.createDataFrame([(x,) for x in v], "id string")
    assert sorted(x.id for x in R.chosen_models(m("a", "b"), m("b", "c")).collect()) == ["a", "b", "c"]
    assert spark.range(1).select(R.shortened(F.array(F.lit("abcdef"), F.lit("x")), 1, 3).alias("v")).first().v == ["abc"]


def test_page_pushdown(spark, tmp_path, monkeypatch):
    """Only the pages of a spec are opened, and a Parquet scan sees the filter."""
    import sys
    import types

    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, StringContains

    from quire.operators.pages import only_pages
    from quire.sources.adapters import _PdfReader

    opened = []

    class Doc(list):
        __enter__ = lambda self: self
        __exit__ = lambda self, *a: None

        def __getitem__(self, k):
            opened.append(k)
            span = {"text": f"p{k}", "font": "f", "size": 9, "bbox": (0, 0, 1, 1), "origin": (0, 1)}
            return types.SimpleNamespace(get_text=lambda kind: {"blocks": [{"type": 1}, {"type": 0, "lines": [{"spans": [span]}]}]})

    monkeypatch.setitem(sys.modules, "pymupdf", types.SimpleNamespace(open=lambda path: Doc(range(40))))
    reader = _PdfReader({"path": "x.pdf", "pagesPerTask": 2})
    other = [StringContains(("text",), "p"), EqualTo(("block_no",), 0)]
    assert list(reader.pushFilters([In(("pno",), (3, 5, 6, 39, 41)), GreaterThanOrEqual(("pno",), 5), *other])) == other
    got = [r for part in reader.partitions() for r in reader.read(part)]
    assert [(r[1], r[5]) for r in got] == [(5, "p5"), (6, "p6"), (39, "p39")] and opened == [5, 6, 39]

    spark.createDataFrame([(1, k) for k in range(9)], "doc_id long, pno int").write.parquet(f"{tmp_path}/blocks")
    some = only_pages(spark.read.parquet(f"{tmp_path}/blocks"), "2-3，9", 9)
    assert sorted(r.pno for r in some.collect()) == [1, 2, 8] and "PushedFilters: [In(pno" in some._jdf.queryExecution().toString()
