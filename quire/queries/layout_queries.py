"""Queries on layout, paragraphs and translations, with the SQL that they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import text as X
from quire.operators import aggregates as A
from quire.operators import folds as D
from quire.operators import intervals as I
from quire.operators import joins as J
from quire.operators import layout as L
from quire.operators import pages as P
from quire.operators import windows as W
from quire.operators.relations import LAYOUT_SQL, PAGE_HEIGHT, PAGE_WIDTH, pseudo_layout, text_lines
from quire.sources import tables as T

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _layout(spark, sf_dir) -> DataFrame:
    return pseudo_layout(table(spark, sf_dir, "documents"))


# ---------------------------------------------------------------- statistics
@query(f"""WITH {LAYOUT_SQL}, f AS (SELECT *, n % 11 = 0 AS is_math, n % 13 = 0 AS is_ref, NOT regexp_matches(line, '[一-鿿]') AND (length(line) - length(regexp_replace(line, '\\p{{L}}', '', 'g'))) / greatest(length(line), 1) < 0.6 AS is_skip FROM lay)
    SELECT doc_id, count(DISTINCT pno) AS pages, count(*) AS paragraphs, count(*) FILTER (NOT is_math AND NOT is_ref AND NOT is_skip) AS translatable, count(*) FILTER (is_math) AS math, count(*) FILTER (is_ref) AS refs, count(*) FILTER (is_skip) AS skipped FROM f GROUP BY doc_id""")
def doc_stats(spark, sf_dir):
    """AGG-1, FLT-16 over lines as paragraphs."""
    p = _layout(spark, sf_dir).withColumns({"is_math": F.col("n") % 11 == 0, "is_ref": F.col("n") % 13 == 0, "is_skip": X.is_skip(F.col("line"))})
    return A.doc_stats(p.withColumn("translatable", X.translatable(F.col("line"), F.col("is_math"), F.col("is_ref"), F.col("is_skip"))))


@query("""WITH d AS (SELECT lang AS doc_id, source AS font, sum(length(text)) AS chars, sum(length(text) - length(regexp_replace(text, '[\\p{Sm}\\p{Co}\\p{Nd}""" + X.MATH_CLASS + """.,%()]', '', 'g'))) AS dense FROM documents WHERE length(regexp_replace(text, '\\s+', '', 'g')) > 0 GROUP BY 1, 2),
    s AS (SELECT *, chars / sum(chars) OVER (PARTITION BY doc_id) AS share, dense / chars AS density FROM d)
    SELECT doc_id, font, CAST(chars AS BIGINT) AS chars, CAST(dense AS BIGINT) AS dense, share, density, share < 0.06 AND density > 0.75 AS is_math FROM s""")
def source_census(spark, sf_dir):
    """AGG-2 with languages as documents and sources as fonts."""
    return A.font_census(table(spark, sf_dir, "documents").select(F.col("lang").alias("doc_id"), F.col("source").alias("font"), "text"))


@query("""WITH g AS (SELECT p_brand, p_size AS value, sum(length(p_name)) AS weight, min(p_partkey) AS first FROM part GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY weight DESC, first) AS k FROM g)
    SELECT p_brand, value, CAST(weight AS BIGINT) AS weight, CAST(greatest(6.0, value - 1.5) AS DOUBLE) AS body FROM r WHERE k = 1""")
def weighted_mode_size(spark, sf_dir):
    """AGG-3 of sizes weighted by name lengths."""
    m = A.weighted_mode(table(spark, sf_dir, "part"), ["p_brand"], F.col("p_size"), F.length("p_name"), "p_partkey")
    return m.withColumn("body", A.body_size(F.col("value"), F.lit(1.5)))


_RANKS = {"p0": 0.0, "p5": 0.05, "p25": 0.25, "p50": 0.5, "p95": 0.95}


@query("WITH s AS (SELECT l_returnflag, list_sort(list(l_extendedprice)) AS v, count(*) AS n FROM lineitem GROUP BY 1) SELECT l_returnflag, n, " + ", ".join(f"v[CAST(least(floor(n * {v}::DOUBLE), n - 1) AS BIGINT) + 1] AS {k}" for k, v in _RANKS.items()) + " FROM s")
def floor_rank_quantiles(spark, sf_dir):
    """AGG-4, AGG-5: exact order statistics."""
    return A.floor_rank(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", _RANKS)


@query("""WITH t AS (SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN NULL WHEN l.quality = 1 THEN 'ok' ELSE '' END AS text, d.source FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
    SELECT source AS doc_id, count(*) AS total, count(*) FILTER (text IS NULL OR text = '') AS failed, count(*) FILTER (text IS NULL OR text = '') >= greatest(2, floor(0.7 * count(*))) AS mass_failure FROM t GROUP BY source""")
def mass_failure_gate(spark, sf_dir):
    """AGG-10 with sources as documents."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    text = F.when(F.col("toxic") == 1, F.lit(None).cast("string")).when(F.col("quality") == 1, "ok").otherwise("")
    return A.mass_failures(d.join(lab, "doc_id", "left").select(F.col("source").alias("doc_id"), text.alias("text")))


@query("""WITH t AS (SELECT doc_id, regexp_replace(text, '\\s+', '', 'g') AS s FROM documents) SELECT doc_id, (length(s) - length(regexp_replace(s, '[一-鿿]', '', 'g'))) / greatest(length(s), 1) AS cjk,
    (length(s) - length(regexp_replace(s, '[一-鿿]', '', 'g'))) > 0.2 * greatest(length(s), 1) AS rejected FROM t WHERE s IS NOT NULL""")
def cjk_document_gate(spark, sf_dir):
    """FLT-23 over documents of one paragraph."""
    return P.cjk_gate(table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("pno"), F.lit(0).alias("seq"), "text"))


# ---------------------------------------------------------------- translations
_TRANS = "CASE WHEN toxic = 1 THEN '' WHEN quality = 1 THEN 'T' || doc_id || ' ⟨1⟩' END"


def _translated(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("pno"), F.lit(1).alias("seq"), "text", F.lit(48.04).alias("x0"), F.lit(90.26).alias("y0"))
    t = table(spark, sf_dir, "labels").select("doc_id", F.lit(0).alias("pno"), F.lit(1).alias("seq"), F.when(F.col("toxic") == 1, "").when(F.col("quality") == 1, F.concat(F.lit("T"), F.col("doc_id").cast("string"), F.lit(" ⟨1⟩"))).alias("text"))
    return d, t


@query(f"""WITH t AS (SELECT doc_id, {_TRANS} AS text FROM labels) SELECT d.doc_id, coalesce(nullif(t.text, ''), '[翻译失败] ' || d.text) AS translated, nullif(t.text, '') IS NULL AS missing FROM documents d LEFT JOIN t ON d.doc_id = t.doc_id""")
def translation_left_join(spark, sf_dir):
    """JOIN-1, JOIN-19's status."""
    d, t = _translated(spark, sf_dir)
    return J.with_translations(d, t).select("doc_id", "translated", "missing")


@query(f"""WITH t AS (SELECT doc_id, {_TRANS} AS text FROM labels) SELECT d.doc_id, d.text AS src, t.text, 48.0::DOUBLE AS x0, 90.3::DOUBLE AS y0 FROM documents d JOIN t ON d.doc_id = t.doc_id WHERE t.text IS NOT NULL""")
def dump_inner_join(spark, sf_dir):
    """JOIN-2, SNK-4."""
    d, t = _translated(spark, sf_dir)
    return J.dump(d, t).select("doc_id", "src", "text", "x0", "y0")


def _paragraphs(spark, sf_dir) -> DataFrame:
    """Lines as paragraphs with flags and translations: every seventh fails."""
    p = _layout(spark, sf_dir).withColumns({"is_math": F.col("n") % 11 == 0, "is_ref": F.col("n") % 13 == 0, "is_skip": F.col("n") % 17 == 0, "is_heading": F.col("n") % 5 == 0})
    return p.withColumn("seq", F.col("ln")).withColumn("text", F.col("line")).withColumn("size", F.col("size") + 5).withColumn("translated", F.when(F.col("n") % 7 == 0, F.concat(F.lit(X.FAILED_MARK), F.col("line"))).otherwise(F.concat(F.lit("译"), F.col("n").cast("string"), F.lit(" ⟨1⟩"))))


_PARA_SQL = f"""{LAYOUT_SQL}, q AS (SELECT *, n % 11 = 0 AS is_math, n % 13 = 0 AS is_ref, n % 17 = 0 AS is_skip, n % 5 = 0 AS is_heading, CASE WHEN n % 7 = 0 THEN '[翻译失败] ' || line ELSE '译' || n || ' ⟨1⟩' END AS translated FROM lay)"""


@query(f"""WITH {_PARA_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, is_ref ORDER BY pno, ln) AS r FROM q),
    b AS (SELECT doc_id, pno, ln, CASE WHEN is_math THEN '（式）' WHEN is_ref THEN CASE WHEN r = 1 THEN '> 参考文献保持原文。' END WHEN is_skip THEN line WHEN is_heading THEN CASE WHEN size + 5 >= 17 THEN '# ' WHEN size + 5 >= 13 THEN '## ' ELSE '### ' END || regexp_replace(translated, '⟨\\d+⟩', '（式）', 'g') ELSE regexp_replace(translated, '⟨\\d+⟩', '（式）', 'g') END AS part FROM k)
    SELECT doc_id, string_agg(part, chr(10) || chr(10) ORDER BY pno, ln) AS markdown FROM b WHERE part IS NOT NULL GROUP BY doc_id""")
def markdown_doc(spark, sf_dir):
    """SNK-2, WIN-6, STR-20."""
    return T.markdown(_paragraphs(spark, sf_dir))


@query(f"""WITH {_PARA_SQL}, r AS (SELECT *, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS raw FROM q WHERE NOT is_math AND NOT is_ref AND NOT is_skip)
    SELECT doc_id, string_agg(raw || chr(10) || chr(10) || '> ' || regexp_replace(translated, '⟨\\d+⟩', '（式）', 'g'), chr(10) || chr(10) ORDER BY pno, ln) AS markdown FROM r WHERE length(raw) > 0 GROUP BY doc_id""")
def bilingual_md(spark, sf_dir):
    """SNK-3."""
    return T.bilingual(_paragraphs(spark, sf_dir))


@query(f"""WITH {LAYOUT_SQL}, o AS (SELECT doc_id, pno, ln AS ord, CASE WHEN ln % 3 = 0 THEN line || 'x' ELSE line END AS src, 'old' || ln AS text, x0, y0 + (ln % 2) * 0.9 AS y0 FROM lay WHERE length(CASE WHEN ln % 3 = 0 THEN line || 'x' ELSE line END) > 0),
    e AS (SELECT doc_id, pno, src, arg_max(text, ord) AS by_text FROM o GROUP BY 1, 2, 3), x AS (SELECT lay.doc_id, lay.pno, lay.ln, lay.x0, lay.y0, e.by_text FROM lay LEFT JOIN e ON lay.doc_id = e.doc_id AND lay.pno = e.pno AND lay.line = e.src),
    c AS (SELECT x.doc_id, x.pno, x.ln, o.text, o.ord, abs(o.y0 - x.y0) + 0.25 * abs(o.x0 - x.x0) AS d FROM x JOIN o ON x.doc_id = o.doc_id AND x.pno = o.pno WHERE x.by_text IS NULL),
    n AS (SELECT doc_id, pno, ln, text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, pno, ln ORDER BY d, ord) AS k FROM c WHERE d <= 1.5) WHERE k = 1)
    SELECT x.doc_id, x.pno, x.ln AS seq, coalesce(x.by_text, n.text) AS found, CASE WHEN x.by_text IS NOT NULL THEN 'exact' WHEN n.text IS NOT NULL THEN 'nearest' END AS how FROM x LEFT JOIN n ON x.doc_id = n.doc_id AND x.pno = n.pno AND x.ln = n.ln""")
def remap_exact_nearest(spark, sf_dir):
    """JOIN-4, SRT-5: a shifted copy of which every third source has changed."""
    lay = _layout(spark, sf_dir)
    p = lay.select("doc_id", "pno", F.col("ln").alias("seq"), F.col("line").alias("text"), "x0", "y0")
    o = lay.select("doc_id", "pno", F.col("ln").alias("ord"), F.when(F.col("ln") % 3 == 0, F.concat("line", F.lit("x"))).otherwise(F.col("line")).alias("src"), F.concat(F.lit("old"), F.col("ln").cast("string")).alias("text"), "x0", (F.col("y0") + (F.col("ln") % 2) * 0.9).alias("y0"))
    return J.remap(p, o).select("doc_id", "pno", "seq", "found", "how")


@query()
def batch_packing(spark, sf_dir):
    """AGG-F8 over the lines of each document, those of at most 40 characters as headings."""
    p = text_lines(table(spark, sf_dir, "documents")).select("doc_id", F.col("ln").alias("seq"), F.col("line").alias("text"), (F.length("line") <= 40).alias("is_heading"))
    return D.batched(p).select("doc_id", "seq", "batch_no")


ORACLES["batch_packing"] = """WITH RECURSIVE t AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS ln, unnest(string_split(text, chr(10))) AS line FROM documents),
    p AS (SELECT doc_id, ln, length(line) <= 40 AS heading, length(line) AS n FROM t),
    r AS (SELECT doc_id, ln, 0 AS b, 1 AS k, n AS c, heading AS shut FROM p WHERE ln = 0
        UNION ALL SELECT p.doc_id, p.ln, CASE WHEN r.shut OR p.heading OR r.k >= 14 OR (r.k > 0 AND r.c + p.n > 3600) THEN r.b + 1 ELSE r.b END,
            CASE WHEN r.shut OR p.heading OR r.k >= 14 OR (r.k > 0 AND r.c + p.n > 3600) THEN 1 ELSE r.k + 1 END,
            CASE WHEN r.shut OR p.heading OR r.k >= 14 OR (r.k > 0 AND r.c + p.n > 3600) THEN p.n ELSE r.c + p.n END, p.heading
        FROM r JOIN p ON p.doc_id = r.doc_id AND p.ln = r.ln + 1)
    SELECT doc_id, ln AS seq, b AS batch_no FROM r"""


# ---------------------------------------------------------------- geometry
_REGION = "CASE WHEN pno % 2 = 0 THEN 48.0 ELSE 312.0 END AS r_x0, 40.0 AS r_y0, CASE WHEN pno % 2 = 0 THEN 250.0 ELSE 545.0 END AS r_x1, 90.0 AS r_y1"
_COVER = "greatest(least(x1, r_x1) - greatest(x0, r_x0), 0) * greatest(least(y1, r_y1) - greatest(y0, r_y0), 0) / greatest((x1 - x0) * (y1 - y0), 1e-6)"


def _regions(lay: DataFrame) -> DataFrame:
    """One region a page: left on even ones, right on odd ones."""
    even = F.col("pno") % 2 == 0
    return lay.select("doc_id", "pno").distinct().select("doc_id", "pno", F.when(even, 48.0).otherwise(312.0).alias("r_x0"), F.lit(40.0).alias("r_y0"), F.when(even, 250.0).otherwise(545.0).alias("r_x1"), F.lit(90.0).alias("r_y1"))


@query(f"WITH {LAYOUT_SQL}, r AS (SELECT DISTINCT doc_id, pno, {_REGION} FROM lay) SELECT lay.doc_id, lay.ln FROM lay WHERE EXISTS (SELECT 1 FROM r WHERE r.doc_id = lay.doc_id AND r.pno = lay.pno AND {_COVER} >= 0.5)")
def region_semi(spark, sf_dir):
    """JOIN-5, GEO-1."""
    lay = _layout(spark, sf_dir)
    return J.touching(lay, _regions(lay), J.covers(0.5), "left_semi").select("doc_id", "ln")


@query(f"WITH {LAYOUT_SQL}, r AS (SELECT DISTINCT doc_id, pno, {_REGION} FROM lay) SELECT lay.doc_id, lay.ln FROM lay WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = lay.doc_id AND r.pno = lay.pno AND {_COVER} >= 0.6)")
def region_anti(spark, sf_dir):
    """JOIN-7."""
    lay = _layout(spark, sf_dir)
    return J.touching(lay, _regions(lay), J.covers(0.6), "left_anti").select("doc_id", "ln")


@query(f"""WITH {LAYOUT_SQL}, f AS (SELECT doc_id, pno, x0 - 2 AS r_x0, y0 - 1 AS r_y0, x1 + 3 AS r_x1, y1 + 2 AS r_y1 FROM lay WHERE n % 4 = 0 AND n > 0)
    SELECT lay.doc_id, lay.ln, min(r_x0) AS f_x0, min(r_y0) AS f_y0, max(r_x1) AS f_x1, max(r_y1) AS f_y1 FROM lay LEFT JOIN f ON f.doc_id = lay.doc_id AND f.pno = lay.pno AND ({_COVER} >= 0.55
        OR (greatest(least(x1, r_x1) - greatest(x0, r_x0), 0) * greatest(least(y1, r_y1) - greatest(y0, r_y0), 0) / greatest((r_x1 - r_x0) * (r_y1 - r_y0), 1e-6) >= 0.75 AND (x1 - x0) * (y1 - y0) <= 2.2 * greatest((r_x1 - r_x0) * (r_y1 - r_y0), 1.0))) GROUP BY lay.doc_id, lay.ln""")
def formula_union(spark, sf_dir):
    """JOIN-6, AGG-11, GEO-5."""
    lay = _layout(spark, sf_dir)
    f = lay.where("n % 4 = 0 and n > 0").select("doc_id", "pno", (F.col("x0") - 2).alias("r_x0"), (F.col("y0") - 1).alias("r_y0"), (F.col("x1") + 3).alias("r_x1"), (F.col("y1") + 2).alias("r_y1"))
    return J.formula_union(lay.select("doc_id", "pno", "ln", "x0", "y0", "x1", "y1"), f).select("doc_id", "ln", "f_x0", "f_y0", "f_x1", "f_y1")


_PAIRS_SQL = """r{s} AS (SELECT *, row_number() OVER w AS rn, lead(base) OVER w AS nxt FROM {src} WINDOW w AS (PARTITION BY doc_id, pno ORDER BY base, x0, ln)),
    o{s} AS (SELECT a.doc_id, a.pno, a.ln AS a, b.ln AS b, (b.base - a.base) / least(a.size, b.size) AS ratio, left(a.line, 32) AS p, left(b.line, 32) AS q FROM r{s} a JOIN r{s} b ON a.doc_id = b.doc_id AND a.pno = b.pno AND b.rn BETWEEN a.rn + 1 AND a.rn + 7
        WHERE a.nxt - a.base > 0.5 AND b.base - a.base <= 60 AND least(a.x1, b.x1) - greatest(a.x0, b.x0) > 6 AND (b.base - a.base) / least(a.size, b.size) < 0.75)"""


@query(f"WITH {LAYOUT_SQL}, {_PAIRS_SQL.format(s='', src='lay')} SELECT * FROM o")
def overlap_pairs(spark, sf_dir):
    """JOIN-9, SRT-2."""
    return J.overlap_pairs(_layout(spark, sf_dir))


@query(f"""WITH {LAYOUT_SQL}, r AS (SELECT * FROM lay) SELECT a.doc_id, a.pno, a.ln AS a, b.ln AS b, (b.base - a.base) / least(a.size, b.size) AS ratio FROM r a JOIN r b ON a.doc_id = b.doc_id AND a.pno = b.pno
    WHERE b.base - a.base > 0.5 AND b.base - a.base <= 60 AND least(a.x1, b.x1) - greatest(a.x0, b.x0) > 6 AND (b.base - a.base) / least(a.size, b.size) < 0.98""")
def overlap_scan(spark, sf_dir):
    """JOIN-10, the diagnostic that passes over equal baselines."""
    return J.overlap_pairs(_layout(spark, sf_dir), 0.98, stop=False).select("doc_id", "pno", "a", "b", "ratio")


@query(f"""WITH {LAYOUT_SQL}, src AS (SELECT * REPLACE (base + CASE WHEN ln % 4 = 0 THEN 9 ELSE 0 END AS base) FROM lay), {_PAIRS_SQL.format(s='1', src='lay')}, {_PAIRS_SQL.format(s='2', src='src')}
    SELECT doc_id, pno, a, b FROM o1 WHERE NOT EXISTS (SELECT 1 FROM o2 WHERE o1.doc_id = o2.doc_id AND o1.pno = o2.pno AND o1.p = o2.p AND o1.q = o2.q)""")
def new_overlaps(spark, sf_dir):
    """JOIN-11, SET-4: against a source whose every fourth line sits lower."""
    lay = _layout(spark, sf_dir)
    src = lay.withColumn("base", F.col("base") + F.when(F.col("ln") % 4 == 0, 9).otherwise(0))
    return J.new_pairs(J.overlap_pairs(lay), J.overlap_pairs(src)).select("doc_id", "pno", "a", "b")


def _rects(spark, sf_dir) -> DataFrame:
    """The lines of an order as rectangles on a page."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("p"), F.max("l_quantity").alias("q"))
    x0, y0 = F.col("p") % 400, F.col("p") % 97 * 7
    return li.select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("pno"), F.col("l_linenumber").alias("item"), x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), (x0 + 4 * F.col("q")).cast("double").alias("x1"), (y0 + 100).cast("double").alias("y1"))


_RECT_SQL = "g AS (SELECT l_orderkey AS doc_id, l_linenumber AS item, max(l_partkey) AS p, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2), re AS (SELECT doc_id, item, CAST(p % 400 AS DOUBLE) AS x0, CAST(p % 97 * 7 AS DOUBLE) AS y0, CAST(p % 400 + 4 * q AS DOUBLE) AS x1, CAST(p % 97 * 7 + 100 AS DOUBLE) AS y1 FROM g)"
_TOUCH = "e AS (SELECT a.doc_id, a.item AS a, b.item AS b FROM re a JOIN re b ON a.doc_id = b.doc_id AND a.item < b.item WHERE a.x0 - 1 <= b.x1 AND b.x0 - 1 <= a.x1 AND a.y0 - 1 <= b.y1 AND b.y0 - 1 <= a.y1 AND (greatest(a.x1 - a.x0, a.y1 - a.y0) > 400) = (greatest(b.x1 - b.x0, b.y1 - b.y0) > 400))"


@query(f"WITH {_RECT_SQL}, {_TOUCH} SELECT doc_id, a, b FROM e")
def touching_rects(spark, sf_dir):
    """JOIN-8."""
    return J.touching_pairs(_rects(spark, sf_dir)).select("doc_id", "a", "b")


@query(f"""WITH RECURSIVE {_RECT_SQL}, {_TOUCH}, l AS (SELECT doc_id, a, b FROM e UNION ALL SELECT doc_id, b, a FROM e), r AS (SELECT doc_id, item AS node, item AS low FROM re UNION SELECT l.doc_id, l.b, r.low FROM r JOIN l ON l.doc_id = r.doc_id AND l.a = r.node WHERE r.low < l.b)
    SELECT doc_id, node AS item, min(low) AS component FROM r GROUP BY doc_id, node""")
def rect_components(spark, sf_dir):
    """AGG-13."""
    r = _rects(spark, sf_dir)
    return D.label_components(r, J.touching_pairs(r)).select("doc_id", "item", "component")


@query(f"""WITH {_RECT_SQL}, t AS (SELECT doc_id, CASE WHEN item % 3 = 0 THEN 'An end.' ELSE 'label' END AS text, x0 + 5 AS x0, y0 + 5 AS y0, x0 + 45 AS x1, y0 + 15 AS y1 FROM re),
    m AS (SELECT r.doc_id, r.item, r.x0, r.y0, r.x1, r.y1, length(t.text) <= 48 AND NOT regexp_matches(t.text, '[.。！？!?；;:：]\\s*$') AND t.x1 - t.x0 < 0.72 * (r.x1 - r.x0) AS label FROM re r JOIN t ON t.doc_id = r.doc_id
        WHERE (r.x1 - r.x0) * (r.y1 - r.y0) >= 9000 AND (r.x1 - r.x0) * (r.y1 - r.y0) < 0.35 * {PAGE_WIDTH * PAGE_HEIGHT} AND greatest(least(t.x1, r.x1) - greatest(t.x0, r.x0), 0) * greatest(least(t.y1, r.y1) - greatest(t.y0, r.y0), 0) / greatest((t.x1 - t.x0) * (t.y1 - t.y0), 1e-6) >= 0.8)
    SELECT doc_id, 0 AS pno, item, x0 AS r_x0, y0 AS r_y0, x1 AS r_x1, y1 AS r_y1 FROM m GROUP BY ALL HAVING count(*) <= 8 AND bool_and(label)""")
def sparse_figures(spark, sf_dir):
    """JOIN-17: an order's rectangles around labels of every line, a third of which end like a sentence."""
    r = _rects(spark, sf_dir)
    t = r.select("doc_id", "pno", F.when(F.col("item") % 3 == 0, "An end.").otherwise("label").alias("text"), (F.col("x0") + 5).alias("x0"), (F.col("y0") + 5).alias("y0"), (F.col("x0") + 45).alias("x1"), (F.col("y0") + 15).alias("y1"))
    return J.sparse_figures(r.withColumn("stroked", F.lit(True)), t, PAGE_WIDTH * PAGE_HEIGHT)


_OVER = "greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0)"


@query(f"""WITH {_RECT_SQL} SELECT a.doc_id, a.item AS a, b.item AS b, {_OVER} / greatest((a.x1 - a.x0) * (a.y1 - a.y0), 1e-6) AS cover, least(a.y1, b.y1) - greatest(a.y0, b.y0) > 0.5 * least(a.y1 - a.y0, b.y1 - b.y0) AS same_line,
    CASE WHEN least(a.x1 - a.x0, b.x1 - b.x0) > 0 THEN (least(a.x1, b.x1) - greatest(a.x0, b.x0)) / least(a.x1 - a.x0, b.x1 - b.x0) > 0.55 ELSE false END AS aligned,
    (a.x0 + a.x1) / 2 BETWEEN b.x0 AND b.x1 AND (a.y0 + a.y1) / 2 BETWEEN b.y0 AND b.y1 AS inside, {_OVER} >= 0.5 AS hits FROM re a JOIN re b ON a.doc_id = b.doc_id AND b.item = a.item + 1""")
def rect_algebra(spark, sf_dir):
    """GEO-1, GEO-3, GEO-4, GEO-6, GEO-7 of neighbouring rectangles."""
    r = _rects(spark, sf_dir).select("doc_id", "item", G.rect().alias("r"))
    n = r.select("doc_id", (F.col("item") - 1).alias("item"), F.col("r").alias("s"))
    a, b = F.col("r"), F.col("s")
    return r.join(n, ["doc_id", "item"]).select("doc_id", F.col("item").alias("a"), (F.col("item") + 1).alias("b"), G.cover(a, b).alias("cover"), G.same_line(a, b).alias("same_line"), G.x_aligned(a, b).alias("aligned"), G.centre_in(a, b).alias("inside"), G.hits_regions(a, F.array(b)).alias("hits"))


@query(f"""WITH {_RECT_SQL}, s AS (SELECT a.doc_id, a.item, any_value((a.x1 - a.x0) * (a.y1 - a.y0)) AS area, sum(CASE WHEN b.item IS NULL THEN 0 ELSE {_OVER} END) AS total FROM re a LEFT JOIN re b ON a.doc_id = b.doc_id AND a.item <> b.item GROUP BY 1, 2)
    SELECT doc_id, item, CASE WHEN area <= 0 THEN 1.0 WHEN total / area >= 0.8 THEN 1.0 ELSE round(total / area, 9) END AS share, area > 0 AND total >= 0.6 * area AS covered FROM s""")
def covered_shares(spark, sf_dir):
    """GEO-9, GEO-10 of each rectangle under all others of its page."""
    r = _rects(spark, sf_dir).select("doc_id", "item", G.rect().alias("r"))
    lists = r.groupBy("doc_id").agg(F.collect_list(F.struct("item", "r")).alias("all"))
    others = F.transform(F.filter("all", lambda o: o["item"] != F.col("item")), lambda o: o["r"])
    return r.join(lists, "doc_id").select("doc_id", "item", F.round(G.covered_share(F.col("r"), others), 9).alias("share"), G.covered(F.col("r"), others).alias("covered"))


@query(f"""WITH {_RECT_SQL}, j AS (SELECT a.doc_id, a.item, a.x0, a.y0, a.x1, a.y1, greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) AS common, greatest(a.y0, b.y0) AS hy0, least(a.y1, b.y1) AS hy1, greatest(a.x0, b.x0) AS hx0, least(a.x1, b.x1) AS hx1 FROM re a JOIN re b ON b.doc_id = a.doc_id AND b.item = a.item - 1),
    c AS (SELECT doc_id, item, list_filter(CASE WHEN common < 0.5 THEN [{{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}}] ELSE list_filter([{{'x0': x0, 'y0': y0, 'x1': x1, 'y1': hy0}}, {{'x0': x0, 'y0': hy1, 'x1': x1, 'y1': y1}}, {{'x0': x0, 'y0': hy0, 'x1': hx0, 'y1': hy1}}, {{'x0': hx1, 'y0': hy0, 'x1': x1, 'y1': hy1}}], lambda q: q.x1 - q.x0 > 0.2 AND q.y1 - q.y0 > 0.2) END, lambda q: q.x1 - q.x0 >= 1 AND q.y1 - q.y0 >= 1) AS parts FROM j),
    u AS (SELECT doc_id, item, unnest(range(len(parts))) AS k, unnest(parts) AS r FROM c) SELECT doc_id, item, CAST(k AS INT) AS k, r.x0 AS x0, r.y0 AS y0, r.x1 AS x1, r.y1 AS y1 FROM u""")
def cut_out_rects(spark, sf_dir):
    """GEO-8: each rectangle without the one before it."""
    r = _rects(spark, sf_dir).select("doc_id", "item", G.rect().alias("r"))
    n = r.select("doc_id", (F.col("item") + 1).alias("item"), F.col("r").alias("s"))
    return r.join(n, ["doc_id", "item"]).select("doc_id", "item", F.posexplode(G.cut_out(F.col("r"), F.array("s"))).alias("k", "p")).select("doc_id", "item", "k", "p.*")


@query(f"WITH {LAYOUT_SQL} SELECT doc_id, ln FROM lay WHERE (y1 < 45 OR y0 > 842 - 45) AND n < 80")
def margin_blocks(spark, sf_dir):
    """FLT-2."""
    return _layout(spark, sf_dir).where(P.is_margin(F.col("y0"), F.col("y1"), F.col("line"), PAGE_HEIGHT)).select("doc_id", "ln")


_SIDE = f"CASE WHEN (x0 + x1) / 2 < {PAGE_WIDTH / 2} - 6 THEN 0 WHEN (x0 + x1) / 2 > {PAGE_WIDTH / 2} + 6 THEN 1 END"


@query(f"""WITH {LAYOUT_SQL}, s AS (SELECT doc_id, pno, ln, last_value({_SIDE} IGNORE NULLS) OVER (PARTITION BY doc_id, pno ORDER BY ln ROWS UNBOUNDED PRECEDING) AS side FROM lay),
    c AS (SELECT *, lag(side) OVER (PARTITION BY doc_id, pno ORDER BY ln) AS was FROM s) SELECT doc_id, ln, side, CAST(sum(CASE WHEN side <> was THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, pno ORDER BY ln ROWS UNBOUNDED PRECEDING) AS BIGINT) AS part FROM c""")
def column_split(spark, sf_dir):
    """AGG-F6, GEO-11."""
    return D.split_by_side(_layout(spark, sf_dir), PAGE_WIDTH / 2, ["doc_id", "pno"], ["ln"]).select("doc_id", "ln", "side", "part")


@query(f"""WITH {LAYOUT_SQL}, b AS (SELECT doc_id, pno, ln, least(x1, 300.0) - greatest(x0, 40.0) > 4 AND (y0 + y1) / 2 BETWEEN 54 AND 83 AS band FROM lay),
    i AS (SELECT *, sum(CASE WHEN band THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, pno ORDER BY ln ROWS UNBOUNDED PRECEDING) AS piece FROM b) SELECT doc_id, ln, CAST(piece AS BIGINT) AS piece FROM i WHERE NOT band""")
def table_split(spark, sf_dir):
    """AGG-F5, FLT-5 at a table from (40, 60) to (300, 80)."""
    tables = F.array(G.rect(F.lit(40.0), F.lit(60.0), F.lit(300.0), F.lit(80.0)))
    return D.split_at_bands(_layout(spark, sf_dir), J.line_in_tables(G.rect(), tables), ["doc_id", "pno"], ["ln"]).select("doc_id", "ln", "piece")


@query(f"""WITH {LAYOUT_SQL}, w AS (SELECT doc_id, pno, ln, y0 AS lo, y0 + 5 + n % 60 AS hi FROM lay WHERE ln % 3 = 0), c AS (SELECT *, CAST(floor((hi - lo) / 13.8 + 1e-6) AS INT) AS cap FROM w),
    u AS (SELECT *, sum(cap) OVER (PARTITION BY doc_id, pno ORDER BY lo ROWS UNBOUNDED PRECEDING) AS up, row_number() OVER (PARTITION BY doc_id, pno ORDER BY lo) - 1 AS win FROM c WHERE cap > 0),
    l AS (SELECT doc_id, pno, ln % {12} AS line FROM lay) SELECT l.doc_id, l.pno, l.line, win, lo + (l.line - (up - cap)) * 13.8 AS y FROM l JOIN u ON l.doc_id = u.doc_id AND l.pno = u.pno AND l.line >= up - cap AND l.line < up""")
def window_pack(spark, sf_dir):
    """LAY-7: a page's lines into windows that every third line opens."""
    lay = _layout(spark, sf_dir)
    w = lay.where("ln % 3 = 0").select("doc_id", "pno", F.col("y0").alias("lo"), (F.col("y0") + 5 + F.col("n") % 60).alias("hi"))
    return I.pack_lines(w, ["doc_id", "pno"], 13.8, lay.select("doc_id", "pno", (F.col("ln") % 12).alias("line")))


@query(f"""WITH {LAYOUT_SQL}, w AS (SELECT *, lead(base) OVER w - base AS pitch, lead(x0) OVER w AS nx0, lead(x1) OVER w AS nx1, lead(size) OVER w AS ns FROM lay WINDOW w AS (PARTITION BY doc_id, pno ORDER BY base, x0, ln))
    SELECT doc_id, ln, pitch / least(size, ns) AS ratio FROM w WHERE pitch > 0.5 AND pitch < 60 AND least(x1, nx1) - greatest(x0, nx0) > 6""")
def pitch_ratios(spark, sf_dir):
    """WIN-3."""
    return W.pitch_ratios(_layout(spark, sf_dir)).select("doc_id", "ln", "ratio")


@query(f"""WITH {LAYOUT_SQL}, m AS (SELECT doc_id, pno, CASE WHEN n = 0 THEN 0 ELSE 1 END AS k, n FROM lay), a AS (SELECT doc_id, pno, count(*) FILTER (n > 60 ) AS long_lines, count(*) FILTER (n % 9 = 0) AS odd_lines, count(*) FILTER (n % 10 < 3) AS images_src, count(*) FILTER (n % 10 < 2 OR n % 10 = 7) AS images_out FROM m GROUP BY 1, 2)
    SELECT doc_id, CAST(sum(long_lines) AS BIGINT) AS long_lines, CAST(sum(odd_lines) AS BIGINT) AS odd_lines, CAST(sum(greatest(images_src - images_out, 0)) AS BIGINT) AS lost_images, CAST(sum(greatest(images_out - images_src, 0)) AS BIGINT) AS new_images,
    count(*) FILTER (long_lines > 0 OR odd_lines > 0 OR images_src > images_out) AS bad_pages, CASE WHEN count(*) FILTER (long_lines > 0 OR odd_lines > 0 OR images_src > images_out) > 0 OR sum(greatest(images_out - images_src, 0)) > 0 THEN 1 ELSE 0 END AS strict_exit FROM a GROUP BY doc_id""")
def verify_totals(spark, sf_dir):
    """AGG-6 with counts of lines standing for defects and images."""
    n = F.col("n")
    a = _layout(spark, sf_dir).groupBy("doc_id", "pno").agg(F.count_if(n > 60).alias("long_lines"), F.count_if(n % 9 == 0).alias("odd_lines"), F.count_if(n % 10 < 3).alias("images_src"), F.count_if((n % 10 < 2) | (n % 10 == 7)).alias("images_out"))
    return A.verify_totals(a)


def _blocks(spark, sf_dir) -> DataFrame:
    b = P.reading_order(_layout(spark, sf_dir).where("n > 0"), PAGE_WIDTH)
    return b.select("doc_id", F.col("pno"), F.col("ord"), "x0", "y0", "x1", "y1", "size", (F.col("n") % 29 == 0).alias("is_math"), (F.col("n") % 31 == 0).alias("is_protected"), F.array(F.when(F.col("n") % 23 == 0, "T").otherwise(F.col("line"))).alias("lines"))


_FLAT = "trim(regexp_replace(array_to_string({l}, ' '), '\\s+', ' ', 'g'))"
_MERGE_SQL = f"""{LAYOUT_SQL}, sm AS (SELECT * FROM lay WHERE n > 0), oc AS (SELECT *, count(*) OVER w AS cnt, sum(CASE WHEN x0 < {PAGE_WIDTH / 2} - 10 AND x1 > {PAGE_WIDTH / 2} + 10 AND x1 - x0 < {PAGE_WIDTH} * 0.6 THEN 1 ELSE 0 END) OVER w AS straddle,
        sum(CASE WHEN (x0 + x1) / 2 < {PAGE_WIDTH / 2} THEN 1 ELSE 0 END) OVER w AS lefts FROM sm WINDOW w AS (PARTITION BY doc_id, pno)),
    od AS (SELECT *, NOT (straddle > 0 AND straddle > 0.15 * cnt) AND greatest(lefts, cnt - lefts) > 0.6 * cnt AS two_col FROM oc),
    bl AS (SELECT doc_id, pno, row_number() OVER (PARTITION BY doc_id, pno ORDER BY CASE WHEN two_col AND (x0 + x1) / 2 >= {PAGE_WIDTH / 2} THEN 1 ELSE 0 END, y0, x0, ln) AS k, x0, y0, x1, y1, size, n % 29 = 0 AS is_math, n % 31 = 0 AS held, [CASE WHEN n % 23 = 0 THEN 'T' ELSE line END] AS lines FROM od),
    tx AS (SELECT *, {_FLAT.format(l="lines")} AS t FROM bl),
    -- a capital joins the next block unless it has itself been taken by the one before
    cap AS (SELECT doc_id, pno, k, 0 AS role FROM tx WHERE k = 0 UNION ALL SELECT doc_id, pno, 0, 0 FROM (SELECT DISTINCT doc_id, pno FROM tx)
        UNION ALL SELECT c.doc_id, c.pno, tx.k, CASE WHEN c.role = 1 THEN 2 WHEN regexp_matches(tx.t, '^\\p{{Lu}}$') AND regexp_matches(nx.t, '^[\\p{{Lu}}\\p{{Ll}}]') THEN 1 ELSE 0 END FROM cap c JOIN tx ON tx.doc_id = c.doc_id AND tx.pno = c.pno AND tx.k = c.k + 1 LEFT JOIN tx nx ON nx.doc_id = tx.doc_id AND nx.pno = tx.pno AND nx.k = tx.k + 1),
    fs AS (SELECT b.doc_id, b.pno, b.k, CASE WHEN role = 2 THEN least(p.x0, b.x0) ELSE b.x0 END AS x0, CASE WHEN role = 2 THEN least(p.y0, b.y0) ELSE b.y0 END AS y0, b.x1, b.y1, CASE WHEN role = 2 THEN greatest(p.size, b.size) ELSE b.size END AS size, b.is_math, b.held OR (role = 2 AND p.held) AS held, CASE WHEN role = 2 THEN p.lines || b.lines ELSE b.lines END AS lines
        FROM cap c JOIN tx b ON b.doc_id = c.doc_id AND b.pno = c.pno AND b.k = c.k LEFT JOIN tx p ON p.doc_id = b.doc_id AND p.pno = b.pno AND p.k = b.k - 1 WHERE role <> 1),
    ft AS (SELECT * REPLACE (row_number() OVER (PARTITION BY doc_id, pno ORDER BY k) AS k), {_FLAT.format(l="lines")} AS t FROM fs),
    mg AS (SELECT doc_id, pno, k, 1 AS g, x0, y0, x1, y1, size, is_math, held, lines, t FROM ft WHERE k = 1
        UNION ALL SELECT j.doc_id, j.pno, j.k, CASE WHEN j.go THEN j.g ELSE j.g + 1 END, CASE WHEN j.go THEN j.cx0 ELSE j.x0 END, CASE WHEN j.go THEN j.cy0 ELSE j.y0 END, CASE WHEN j.go THEN j.cx1 ELSE j.x1 END, CASE WHEN j.go THEN greatest(j.cy1, j.y1) ELSE j.y1 END, CASE WHEN j.go THEN greatest(j.cs, j.size) ELSE j.size END, CASE WHEN j.go THEN j.cm ELSE j.is_math END, CASE WHEN j.go THEN j.ch ELSE j.held END, CASE WHEN j.go THEN j.cl || j.lines ELSE j.lines END, CASE WHEN j.go THEN trim(regexp_replace(array_to_string(j.cl || j.lines, ' '), '\\s+', ' ', 'g')) ELSE j.t END
        FROM (SELECT b.*, c.g, c.x0 AS cx0, c.y0 AS cy0, c.x1 AS cx1, c.y1 AS cy1, c.size AS cs, c.is_math AS cm, c.held AS ch, c.lines AS cl, ((c.x0 + c.x1) / 2 < {PAGE_WIDTH / 2}) = ((b.x0 + b.x1) / 2 < {PAGE_WIDTH / 2}) AND abs(c.size - b.size) < 1.5 AND b.y0 - c.y1 > -2 AND b.y0 - c.y1 < 0.9 * c.size AND (ends_with(c.t, '-') OR regexp_matches(b.t, '^\\p{{Ll}}') OR c.size > 18) AND NOT regexp_matches(c.t, '[.!?:;"'']\\s*$') AND NOT c.is_math AND NOT b.is_math AND NOT c.held AND NOT b.held AS go
            FROM mg c JOIN ft b ON b.doc_id = c.doc_id AND b.pno = c.pno AND b.k = c.k + 1) j),
    merged AS (SELECT doc_id, pno, CAST(g AS INT) AS ord, arg_max(x0, k) AS x0, arg_max(y0, k) AS y0, arg_max(x1, k) AS x1, arg_max(y1, k) AS y1, arg_max(size, k) AS size, arg_max(is_math, k) AS is_math, arg_max(lines, k) AS lines FROM mg GROUP BY doc_id, pno, g)"""


@query(f"WITH RECURSIVE {_MERGE_SQL} SELECT * REPLACE (array_to_string(lines, chr(10)) AS lines) FROM merged")
def block_merge(spark, sf_dir):
    """AGG-F2."""
    return D.merge_blocks(_blocks(spark, sf_dir), PAGE_WIDTH / 2).withColumn("lines", F.array_join("lines", "\n"))


_ALIGNED = "least(b.x1 - b.x0, c.x1 - c.x0) > 0 AND (least(b.x1, c.x1) - greatest(b.x0, c.x0)) / least(b.x1 - b.x0, c.x1 - c.x0) > 0.55"
_HIGH = "greatest(c.tall, 0.9 * b.size)"
_KEEP = ("x0", "y0", "x1", "y1", "size", "heading", "skip", "n", "tall", "low")
# What a block does to the paragraph or formula before it, and what that leaves: one row of state a block.
_FOLD_SQL = f"""{_MERGE_SQL}, jb AS (SELECT doc_id, pno, ord, x0, y0, x1, y1, size, is_math, trim(regexp_replace(list_reduce(lines, lambda a, x: CASE WHEN ends_with(a, '-') AND regexp_matches(x, '^\\p{{Ll}}') THEN left(a, length(a) - 1) || x ELSE a || ' ' || x END), '\\s+', ' ', 'g')) AS text, trim(lines[1]) AS first, len(lines) AS n FROM merged),
    fb AS (SELECT *, row_number() OVER (PARTITION BY doc_id, pno ORDER BY ord) AS k, (y1 - y0) / greatest(n, 1) AS tall, NOT regexp_matches(text, '[一-鿿]') AND (length(text) - length(regexp_replace(text, '\\p{{L}}', '', 'g'))) / greatest(length(text), 1) < 0.6 AS skip,
        (length(text) <= 110 AND (regexp_matches(first, '^(I{{1,3}}|IV|VI{{0,3}}|IX|XI{{0,3}})\\.\\s*[A-Z]') OR regexp_matches(first, '^\\d{{1,2}}(\\.\\d{{1,2}}){{0,2}}\\.\\s+[A-Z][a-z]') OR regexp_matches(first, '^[A-Z]\\.\\s+[A-Z]') OR regexp_matches(first, '(?i)^({X.HEADING_WORDS})\\b'))) OR regexp_matches(first, '(?i)^references?\\b') AS heading FROM jb WHERE length(text) > 0),
    pr AS (SELECT doc_id, pno, k, 1 AS g, CASE WHEN is_math THEN 'm' ELSE 't' END AS kind, x0, y0, x1, y1, size, NOT is_math AND heading AS heading, NOT is_math AND skip AS skip, CASE WHEN is_math THEN 1 ELSE n END AS n, CASE WHEN is_math THEN 0.0 ELSE tall END AS tall, CASE WHEN is_math THEN 0.0 ELSE y1 END AS low, CASE WHEN is_math THEN []::VARCHAR[] ELSE [text] END AS parts, CASE WHEN is_math THEN -1.0 ELSE y1 END AS bottom FROM fb WHERE k = 1
        UNION ALL SELECT doc_id, pno, k, CASE WHEN act IN ('inline', 'again', 'join') THEN g ELSE g + 1 END, CASE WHEN act IN ('again', 'formula') THEN 'm' ELSE 't' END,
            CASE WHEN act = 'inline' THEN cx0 WHEN act IN ('again', 'join') THEN least(cx0, x0) ELSE x0 END, CASE WHEN act IN ('inline', 'join') THEN cy0 WHEN act = 'again' THEN least(cy0, y0) ELSE y0 END,
            CASE WHEN act = 'inline' THEN cx1 WHEN act IN ('again', 'join') THEN greatest(cx1, x1) ELSE x1 END, CASE WHEN act IN ('inline', 'again', 'join') THEN greatest(cy1, y1) ELSE y1 END, CASE WHEN act IN ('inline', 'again', 'join') THEN csize ELSE size END,
            CASE act WHEN 'text' THEN heading WHEN 'formula' THEN false ELSE cheading END, CASE act WHEN 'text' THEN skip WHEN 'formula' THEN false WHEN 'join' THEN cskip AND skip ELSE cskip END, CASE act WHEN 'text' THEN n WHEN 'formula' THEN 1 WHEN 'join' THEN cn + n ELSE cn END,
            CASE act WHEN 'formula' THEN 0.0 WHEN 'text' THEN tall WHEN 'join' THEN tall ELSE ctall END, CASE act WHEN 'formula' THEN 0.0 WHEN 'text' THEN y1 WHEN 'join' THEN y1 ELSE clow END, CASE act WHEN 'formula' THEN []::VARCHAR[] WHEN 'text' THEN [text] WHEN 'again' THEN cparts ELSE list_append(cparts, text) END, CASE WHEN is_math THEN cbottom ELSE y1 END
        FROM (SELECT b.*, c.g, c.parts AS cparts, c.bottom AS cbottom, {", ".join(f"c.{f} AS c{f}" for f in _KEEP)},
            CASE WHEN b.is_math AND c.kind = 't' AND {_ALIGNED} AND b.y0 >= c.y0 - 2 AND b.y0 <= c.bottom + 0.6 * b.size AND b.y0 - c.y0 < 200 AND abs((b.y0 + b.y1) / 2 - (c.low - c.tall / 2)) <= 0.65 * {_HIGH} AND least(b.y1, c.low) - greatest(b.y0, c.low - c.tall) > 0.15 * {_HIGH} AND b.y1 - b.y0 <= 2.2 * {_HIGH} THEN 'inline'
                WHEN b.is_math AND c.kind = 'm' AND greatest(least(b.x1, c.x1) - greatest(b.x0, c.x0), 0) * greatest(least(b.y1, c.y1) - greatest(b.y0, c.y0), 0) >= 0.55 * least((b.x1 - b.x0) * (b.y1 - b.y0), (c.x1 - c.x0) * (c.y1 - c.y0)) THEN 'again' WHEN b.is_math THEN 'formula'
                WHEN c.kind = 't' AND {_ALIGNED} AND NOT b.heading AND b.y0 - c.bottom < 1.35 * b.size AND (NOT c.heading OR (b.y0 - c.bottom < b.size AND length(b.text) <= 60 AND regexp_matches(b.text, '^[A-Z0-9 \\-.():]+$'))) THEN 'join' ELSE 'text' END AS act
            FROM pr c JOIN fb b ON b.doc_id = c.doc_id AND b.pno = c.pno AND b.k = c.k + 1) j)"""


@query(f"""WITH RECURSIVE {_FOLD_SQL} SELECT doc_id, pno, g AS seq, arg_max(kind, k) AS kind, {", ".join(f"arg_max({c}, k) AS {c}" for c in ("x0", "y0", "x1", "y1", "size"))}, arg_max(heading, k) AS is_heading, arg_max(skip, k) AS is_skip, CAST(arg_max(n, k) AS INT) AS n_lines, array_to_string(arg_max(parts, k), ' ') AS text FROM pr GROUP BY doc_id, pno, g""")
def paragraph_fold(spark, sf_dir):
    """AGG-F3, AGG-16, FLT-13 to FLT-15 after AGG-F2."""
    return D.assemble_paragraphs(D.merge_blocks(_blocks(spark, sf_dir), PAGE_WIDTH / 2))


@query()
def page_solve(spark, sf_dir):
    """LAY-10: synthetic translations of each page's lines, around one region a page."""
    lay = _layout(spark, sf_dir).where("n > 0")
    p = lay.select("doc_id", "pno", F.col("ln").alias("seq"), "x0", "y0", "x1", F.col("y1"), "size", X.synthetic(F.col("line")).alias("text"))
    r = _regions(lay).select("doc_id", "pno", F.col("r_x0").alias("x0"), (F.col("r_y0") + 700).alias("y0"), F.col("r_x1").alias("x1"), (F.col("r_y1") + 700).alias("y1"))
    return L.solve(p, r, PAGE_HEIGHT).drop("lines")
