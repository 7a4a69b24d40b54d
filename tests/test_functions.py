"""Column functions on small literal rows."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import rewrite as R
from quire.functions import scalar as S
from quire.functions import text as X


def value(spark, column, **row):
    return spark.createDataFrame([tuple(row.values())], [*row]).select(column.alias("v")).first().v if row else spark.range(1).select(column.alias("v")).first().v


def r(*v):
    return G.rect(*[F.lit(float(x)) for x in v])


def test_rects(spark):
    one = lambda c: value(spark, c)
    assert one(G.cover(r(0, 0, 10, 10), r(5, 0, 20, 10))) == 0.5
    assert one(G.cover(r(0, 0, 0, 0), r(5, 0, 20, 10))) == 0.0
    assert one(G.hit_any(r(0, 0, 10, 10), F.array(r(50, 50, 60, 60), r(0, 0, 10, 6)), 0.6))
    assert one(G.same_line(r(0, 0, 5, 10), r(9, 4, 20, 14))) and not one(G.same_line(r(0, 0, 5, 10), r(9, 5, 20, 15)))
    assert one(G.x_aligned(r(0, 0, 10, 1), r(4, 0, 30, 1))) and not one(G.x_aligned(r(0, 0, 0, 1), r(0, 0, 30, 1)))
    assert one(G.covered_share(r(0, 0, 10, 10), F.array(r(0, 0, 10, 4), r(0, 0, 10, 4)))) == 1.0
    assert one(G.covered_share(r(0, 0, 10, 10), F.array(r(0, 0, 10, 4)))) == 0.4 and one(G.covered_share(r(0, 0, 0, 10), F.array(r(0, 0, 10, 4)))) == 1.0
    assert one(G.covered(r(0, 0, 10, 10), F.array(r(0, 0, 10, 6)))) and not one(G.covered(r(0, 0, 0, 10), F.array(r(0, 0, 10, 6))))
    parts = one(G.cut_out(r(0, 0, 10, 10), F.array(r(4, 4, 6, 6))))
    assert sum((p.x1 - p.x0) * (p.y1 - p.y0) for p in parts) == 96 and len(parts) == 4
    assert one(G.cut_out(r(0, 0, 10, 10), F.array(r(-1, -1, 11, 11)))) == []
    assert one(G.side(r(0, 0, 10, 1), F.lit(50.0))) == 0 and one(G.side(r(48, 0, 54, 1), F.lit(50.0))) is None


def test_text_predicates(spark):
    one = lambda f, t: value(spark, f(F.col("t")), t=t)
    assert one(X.collapse, " a  b\t") == "a b"
    assert one(X.math_density, "a∑≤ ") == pytest.approx(2 / 3) and one(X.math_density, "") == 0.0
    assert one(X.private_dominant, "\ue000a") and not one(X.private_dominant, "abc\ue000")
    assert one(X.is_skip, "12 34 5") and not one(X.is_skip, "12 字") and not one(X.is_skip, "words here")
    head = lambda t: value(spark, X.is_heading(F.col("t"), F.col("t")), t=t)
    assert all(map(head, ["IV. Results", "3.1. Method here", "A. Setup", "Abstract", "References"])) and not head("plain words") and not head("Abstract " + "x" * 120)
    assert one(X.english_sentence, "this is a proper English sentence") and not one(X.english_sentence, "a b c d e")
    assert one(X.math_debris, "\\begin") and one(X.math_debris, "^_{") and one(X.math_debris, "a_{ij}") and not one(X.math_debris, "word,") and not one(X.math_debris, "x_{12}")
    assert one(X.cjk_share, "中a") == 0.5
    lines = ["12.1 3.4 55", "1 2 3", "7.5 8 99", "12 13 14"]
    assert value(spark, X.numeric_table(F.lit(" ".join(lines)), F.array(*map(F.lit, lines))))
    assert not value(spark, X.numeric_table(F.lit("no numbers in here at all"), F.array(F.lit("no numbers"))))
    assert value(spark, X.figure_text(F.lit(50.0), F.lit("Axis label"), F.lit(1), F.lit("vec"), F.lit(300.0)))
    assert not value(spark, X.figure_text(F.lit(50.0), F.lit("This is a sentence that ends with a stop."), F.lit(1), F.lit("img"), F.lit(300.0)))
    assert one(X.cites, "Smith, J. et al., (Nature) 2019, 4") and one(X.cites, "see doi 10.1/x for the rest") and not one(X.cites, "2019, A")
    assert one(X.decode_symbols, "a\uf0a3\uf061\uf0e5") == "a≤α∑"


def test_rewrites(spark):
    join = lambda *x: value(spark, X.join_lines(F.array(*map(F.lit, x))))
    assert join("trans-", "late it", "Now-", "Then") == "translate it Now- Then"
    assert value(spark, X.parse_numbered(F.lit("1. a\n2) b\nlost\n2、c\nx 3. d\n 4 . e"))) == {1: "a", 2: "c", 4: "e"}
    assert value(spark, X.missing_numbers(X.parse_numbered(F.lit("1. a\n3. b")), F.lit(4))) == [2, 4]
    assert value(spark, X.numbered_prompt(F.array(F.lit("a"), F.lit("b")))) == "1. a\n2. b"
    red = value(spark, X.redacted(F.lit("k=hush sk-12345678abc Bearer tok123 https://u:p@h/?api_key=zz&x=1"), ("hush",)))
    assert all(s not in red for s in ("hush", "12345678", "tok123", "u:p", "zz")) and "x=1" in red
    assert value(spark, X.endpoint(F.lit("http://h/v1/"), F.lit("chat"))) == "http://h/v1/chat" and value(spark, X.endpoint(F.lit("http://h"), F.lit("chat"))) == "http://h/v1/chat"
    assert value(spark, X.slug(F.lit(" My Model! v2 "))) == "my-model-v2" and value(spark, X.credential_name(F.lit("my-api"))) == "MY_API_API_KEY"
    assert value(spark, X.safe_name(F.lit("a/b\\we?ird 中.pdf"))) == "we_ird 中.pdf" and value(spark, X.stem(F.lit("/x/Paper.PDF"))) == "Paper"
    assert value(spark, X.synthetic(F.lit("abc"))).startswith("本文提出一种") and len(value(spark, X.synthetic(F.lit("x" * 100)))) == 60
    toks = F.from_json(F.lit('[{"kind":"t","text":"a"},{"kind":"m"},{"kind":"t","text":"b"},{"kind":"m"}]'), "array<struct<kind:string,text:string>>")
    assert value(spark, X.marked_text(toks)) == "a ⟨1⟩ b ⟨2⟩" and value(spark, X.raw_text(toks)) == "a b"
    assert value(spark, X.glossary_term(F.lit("word: 词"))) and not value(spark, X.glossary_term(F.lit("中: x"))) and not value(spark, X.glossary_term(F.lit(":x")))
    assert value(spark, X.placeholders_to_mark(F.lit("a ⟨12⟩"))) == "a （式）"


def test_page_specs(spark):
    spec = lambda s, n, strict: value(spark, X.page_spec(F.lit(s), F.lit(n), strict))
    assert spec("3-5，1,4", 9, True) == [0, 2, 3, 4] and spec("2-99", 4, True) == [1, 2, 3]
    assert spec("0-2,9,x", 4, False) == [0, 1] and spec("", 3, False) == [0, 1, 2]
    for bad in ("0", "5-2", "a", "1-2-3"):
        with pytest.raises(Exception, match="invalid page spec"):
            spec(bad, 9, True)
    assert value(spark, X.valid_page_spec(F.lit(" 1-2, 4 "))) == "1-2,4" and value(spark, X.valid_page_spec(F.lit(" "))) is None
    with pytest.raises(Exception, match="invalid page spec"):
        value(spark, X.valid_page_spec(F.lit("1,,2")))


def test_errors_and_numbers(spark):
    one = lambda c: value(spark, c)
    assert one(X.is_permanent(F.lit(401))) and not one(X.is_transient(F.lit(401), F.lit("401"))) and one(X.is_transient(F.lit(503), F.lit("HTTP 503")))
    assert one(X.failure_kind(F.lit(True), F.lit("401 connection"))) == "auth" and one(X.failure_kind(F.lit(True), F.lit("connection refused"))) == "connection"
    assert [one(S.clamp_timeout(F.lit(v))) for v in (3.0, 99.5, 9999.0, None)] == [10, 100, 1440, 240]
    assert [one(S.clamp_shrink(F.lit(v))) for v in (-1.0, 1.3, 9.0, None)] == [0.0, 1.5, 3.0, 1.5]
    assert one(S.progress(F.lit("running"), F.lit(0.0), F.lit(60_000))) == 0.15 and one(S.progress(F.lit("running"), F.lit(0.999), F.lit(0))) == 0.98
    assert [one(S.elapsed_label(F.lit(v))) for v in (900, 61_000, 3_700_000)] == ["1s", "1m 1s", "1h 1m"]
    assert one(S.context_label(F.lit(131072))) == "128k" and one(S.context_label(F.lit(1048576))) == "1.0M"
    assert one(S.beijing(F.lit(0).cast("long"))) == "01/01 08:00"
    assert one(S.stage_share(F.lit("translate"), F.lit(1), F.lit(2), F.lit(0.0))) == pytest.approx(0.485) and one(S.stage_share(F.lit("ocr"), F.lit(1), F.lit(2), F.lit(0.3))) == 0.3


def test_scanners():
    assert R.expand_scripts("xᵀ tₖ a²") == "x^{T} t_{k} a^{2}" and R.expand_scripts("") == ""
    assert R.latex_to_text(r"$\mathcal{L}_{\text{x}} = \frac{a}{b} \times \hat{M} \foo \%$") == "L_{x} = a/b × M̂ \\foo %"
    assert R.latex_to_text("no commands & here") == "no commands & here"
    assert R.normal("𝑥 〈3》") == "x ⟨3⟩"
    assert R.split_scripts("R^{K×c}") == [("n", "R"), ("sup", "K×c")] and R.split_scripts("train_test_split") == [("n", "train_test_split")]
    assert R.split_scripts("10^-3") == [("n", "10"), ("sup", "-3")] and R.split_scripts("x_ij") == [("n", "x"), ("sub", "ij")]
    assert R.atoms("设⟨1》x_i  b") == [("w", "设", None), ("math", None, 1), ("w", "x", None), ("sub", "i", None), ("sp", None, None), ("w", "b", None)]
    assert R.keep_marks(R.atoms("⟨1⟩⟨3⟩"), 2) == [("math", None, 1)] and R.keep_marks(R.atoms("⟨1⟩a"), 0) == [("w", "a", None)]
    assert R.cjk_split("中文ab, c") == ["中", "文", "ab", ",", " ", "c"]


def test_atom_arrays_close_by_atoms():
    import pyarrow as pa

    texts = ["设⟨1》x_i  b", None, "", "a b", "c", ""]
    got = list(R.atom_arrays(iter([pa.array(texts[:4]), pa.array(texts[4:])]), 4))
    assert [len(x) for x in got] == [1, 3, 2]
    assert [[tuple(a.values()) for a in row] for x in got for row in x.to_pylist()] == [R.atoms(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab _^{}()中⟨1⟩-", max_size=40), st.floats(20, 200))
def test_wrap_keeps_atoms_and_width(text, width):
    row = R.atoms(text)
    lines = R.wrap(row, 10, width)
    assert [a for line in lines for a in line if a[0] != "sp"] == [a for a in row if a[0] != "sp"]
    for line in lines:
        assert line[0][0] != "sp" and line[-1][0] != "sp"
        assert len(line) == 1 or sum(R.atom_width(a, 10) for a in line) <= width + 0.5
