"""Every query with an SQL twin against DuckDB on the smallest tables."""

import decimal

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from quire.queries import ORACLES, QUERIES

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(sf):
    con = duckdb.connect()
    for t in NAMES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, sql, name):
    df = QUERIES[name](spark, sf)
    rows = df.collect()
    if name not in ORACLES:
        assert rows
        return
    r = sql.execute(ORACLES[name])
    cols = [c[0] for c in r.description]
    assert sorted(df.columns) == sorted(cols) and canon(rows, df.columns) == canon(r.fetchall(), cols)


def test_clamped_settings_of_large_keys(spark, tmp_path):
    """Labels of 999.9M and above, ties of a tenth among them, and of keys far beyond the tables'."""
    keys = [0, 255, 256, 320, 255_987, 255_988, 256_000, 256_064, 1_199_999, 10**9 + 64, 2**40 + 192]
    spark.createDataFrame([(k, 7, 900.5) for k in keys], "p_partkey long, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    r = con.execute(ORACLES["clamped_settings"])
    cols = [c[0] for c in r.description]
    df = QUERIES["clamped_settings"](spark, str(tmp_path))
    assert canon(df.collect(), df.columns) == canon(r.fetchall(), cols)
    assert "1000.0M" in {r.context for r in df.collect()}


LATE = "tail sk-zzzzzzzzzzzzzzzzzzzz http://u:p@h/y?key=v Bearer qqqqqqqqqqqqqqqqqqqq /home/someone/x end"


@pytest.fixture(scope="module")
def long_docs(spark, tmp_path_factory):
    """Documents with something to rewrite or find behind their first 5,000 characters alone."""
    d = tmp_path_factory.mktemp("long")
    rows = [(i, "word " * 1000 + LATE + " x² $\\alpha$") for i in range(3)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    return str(d)


def test_secrets_of_whole_texts(spark, long_docs):
    import re

    from quire.operators.joins import SECRET_RULES

    rules = [(r"(?i)bearer\s+[A-Za-z0-9._~+/=-]+", "Bearer [REDACTED]"), (r"sk-[A-Za-z0-9_-]{8,}", "[REDACTED]"), (r"(?i)(https?://)[^/@\s]+@", r"\1[REDACTED]@"), (r"(?i)([?&](?:api[_-]?key|key|token|access_token|secret)=)[^&\s]+", r"\1[REDACTED]")]
    got = {r.doc_id: r.text for r in QUERIES["redact_text"](spark, long_docs).collect()}
    for i, text in got.items():
        want = f"key sk-abcdefgh{i}ijklmnopqrstu https://user:pw@host/x?token=abc{i}&b=1 Bearer zzzzzzzzzzzzzzzzzzzz{i} " + "word " * 1000 + LATE + " x² $\\alpha$"
        found = {k for k, p in SECRET_RULES.items() if re.search(p, want)}
        for p, by in rules:
            want = re.sub(p, by, want)
        assert text == want and "home_path" in found
        assert {r.rule for r in QUERIES["secret_scan"](spark, long_docs).where(f"doc_id = {i}").collect()} == found
    assert len(got) == 3


def test_rewrites_of_whole_texts(spark, long_docs):
    for name, tail in (("nfkc_norm", "x^{2}"), ("latex_to_unicode", "α")):
        for r in QUERIES[name](spark, long_docs).collect():
            assert len(r.text) > 5000 and tail in r.text[5000:], name


@pytest.fixture(scope="module")
def many_atoms(spark, tmp_path_factory):
    """400 documents of 8,001 atoms in one task, whose Python worker gets 1,500 MB."""
    d = tmp_path_factory.mktemp("atoms")
    spark.range(0, 400, 1, 1).selectExpr("id as doc_id", "concat(repeat('ab ', 4000), '⟨2⟩') as text").write.parquet(f"{d}/documents.parquet")
    spark.sparkContext.setLocalProperty("resource.pyspark.memory", "1500")
    yield str(d)
    spark.sparkContext.setLocalProperty("resource.pyspark.memory", None)


def test_atom_tokens_in_little_memory(spark, many_atoms):
    rows = QUERIES["atom_tokens"](spark, many_atoms).groupBy("kind", "s", "n").agg(F.count("*"), F.max("i")).collect()
    assert sorted(map(tuple, rows), key=str) == sorted([("w", "ab", None, 1_600_000, 7998), ("sp", None, None, 1_600_000, 7999), ("math", None, 2, 400, 8000)], key=str)


def test_kept_atoms_in_little_memory(spark, many_atoms):
    # the query's own ⟨1⟩ and ⟨7⟩ come behind the text's ⟨2⟩
    for r in QUERIES["kept_atoms"](spark, many_atoms).collect():
        marks = (0, 1, 2)[r.doc_id % 3]
        assert (r.n, r.marks) == (8004 + marks, marks)


def test_kept_atoms_stay_in_the_worker(spark, many_atoms):
    df = QUERIES["kept_atoms"](spark, many_atoms)
    assert len(df.collect()) == 400
    sent, nodes = 0, [df._jdf.queryExecution().executedPlan()]
    for node in nodes:
        if (m := node.metrics().get("pythonDataReceived")).isDefined():
            sent += m.get().value()
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    assert 0 < sent < 100_000  # bytes for three numbers a document; the 3.2 million atoms take tens of MB


def test_entry(spark):
    assert E.entry(spark).count() == 200 and set(ORACLES) <= set(E.oracle_sql()) and set(E.oracle_sql()) <= set(E.queries())
