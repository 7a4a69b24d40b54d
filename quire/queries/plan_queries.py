"""Queries on spans, tokens, re-layout, files, requests and jobs, with the SQL that they are held against."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import rewrite as R
from quire.functions import text as X
from quire.operators import aggregates as A
from quire.operators import folds as D
from quire.operators import joins as J
from quire.operators import layout as L
from quire.operators import regions as E
from quire.operators import windows as W
from quire.operators.relations import LAYOUT_SQL, PAGE_HEIGHT, PAGE_WIDTH, pseudo_layout, text_lines
from quire.sources import tables as T
from quire.sources import transport as M
from quire.streaming import watcher as S

QUERIES: dict = {}
ORACLES: dict = {}
PAGE = ["doc_id", "pno"]


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


def _folder(spark) -> str:
    """A new folder for a query's files: beside the session's checkpoints, or a temporary one where they have none (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="quire-")
    return f"{base.rstrip('/')}/query-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- spans
_SPANS = f"""{LAYOUT_SQL}, sp AS (SELECT doc_id, pno, ln AS block_no, 0 AS line_no, s AS span_no, n, CASE s WHEN 0 THEN line WHEN 1 THEN CASE n % 3 WHEN 0 THEN '' WHEN 1 THEN ' = ' ELSE 'α' END ELSE 'tail ' || n END AS text,
    CASE (n + s) % 4 WHEN 0 THEN 'CMMI10' WHEN 1 THEN 'Times-Bold' WHEN 2 THEN 'Times-Italic' ELSE 'Arial' END AS font, size + s * 0.5 AS size, x0 + CASE s WHEN 0 THEN 0 WHEN 1 THEN 60 ELSE 71.5 END AS x0, y0, x0 + CASE s WHEN 0 THEN 59 WHEN 1 THEN 70 ELSE 90 END AS x1, y1, base + s AS origin_y FROM lay, (SELECT unnest([0, 1, 2]) AS s))"""


def _spans(spark, sf_dir) -> DataFrame:
    """Three spans a line: its text, a sign or nothing, and a tail, in four fonts."""
    lay = _layout(spark, sf_dir).withColumn("s", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    s, n = F.col("s"), F.col("n")
    text = F.when(s == 0, F.col("line")).when(s == 1, F.when(n % 3 == 0, "").when(n % 3 == 1, " = ").otherwise("α")).otherwise(F.concat(F.lit("tail "), n.cast("string")))
    font = F.when((n + s) % 4 == 0, "CMMI10").when((n + s) % 4 == 1, "Times-Bold").when((n + s) % 4 == 2, "Times-Italic").otherwise("Arial")
    x0, x1 = F.when(s == 0, 0.0).when(s == 1, 60.0).otherwise(71.5), F.when(s == 0, 59.0).when(s == 1, 70.0).otherwise(90.0)
    return lay.select("doc_id", "pno", F.col("ln").alias("block_no"), F.lit(0).alias("line_no"), s.alias("span_no"), "n", text.alias("text"), font.alias("font"), (F.col("size") + s * 0.5).alias("size"), (F.col("x0") + x0).alias("x0"), "y0", (F.col("x0") + x1).alias("x1"), "y1", (F.col("base") + s).alias("origin_y"))


@query(f"""WITH {_SPANS}, f AS (SELECT *, (n + span_no) % 3 = 0 AS m FROM sp WHERE (n + span_no) % 3 = 0 OR length(text) > 0), g AS (SELECT *, bool_or(m) OVER (PARTITION BY doc_id, pno, block_no) AS has_m, lag(m) OVER (PARTITION BY doc_id, pno, block_no ORDER BY span_no) AS was FROM f),
    i AS (SELECT *, sum(CASE WHEN was <> m THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, pno, block_no ORDER BY span_no ROWS UNBOUNDED PRECEDING) AS run FROM g WHERE has_m)
    SELECT doc_id, pno, block_no, line_no, CAST(run AS BIGINT) AS run_no, CASE WHEN bool_or(m) THEN 'm' ELSE 't' END AS kind, string_agg(text, '' ORDER BY span_no) AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM i GROUP BY ALL""")
def span_runs(spark, sf_dir):
    """AGG-F1."""
    return D.span_runs(_spans(spark, sf_dir).withColumn("is_math", (F.col("n") + F.col("span_no")) % 3 == 0))


@query(f"""WITH {_SPANS} SELECT doc_id, pno, block_no, line_no, round(sum(size * greatest(length(text), 1)) / sum(greatest(length(text), 1)), 9) AS size, sum(CASE WHEN font LIKE '%Bold%' THEN length(text) ELSE 0 END) > 0.5 * sum(length(text)) AS is_bold,
    sum(CASE WHEN font LIKE '%Ital%' THEN length(text) ELSE 0 END) > 0.5 * sum(length(text)) AS is_italic, CAST(sum(CASE WHEN font = 'CMMI10' THEN length(text) ELSE 0 END) AS BIGINT) AS math_chars FROM sp GROUP BY 1, 2, 3, 4""")
def line_styles(spark, sf_dir):
    """AGG-14, AGG-15, FLT-9's count."""
    s = _spans(spark, sf_dir)
    return A.line_style(s).withColumn("size", F.round("size", 9)).join(E.line_math_chars(s), [*PAGE, "block_no", "line_no"])


@query(f"""WITH {_SPANS}, s AS (SELECT *, length(regexp_replace(text, '\\s+', '', 'g')) > 0 AS solid FROM sp), l AS (SELECT doc_id, pno, block_no, line_no, string_agg(text, '' ORDER BY span_no) AS line, max(size) AS size, arg_min(origin_y, span_no) FILTER (solid) AS base, min(x0) FILTER (solid) AS x0, max(x1) FILTER (solid) AS x1 FROM s GROUP BY 1, 2, 3, 4)
    SELECT * FROM l WHERE length(regexp_replace(line, '\\s+', '', 'g')) > 0 AND base IS NOT NULL AND size > 0""")
def output_lines(spark, sf_dir):
    """SRC-18."""
    return E.output_lines(_spans(spark, sf_dir))


@query(f"""WITH {_SPANS} SELECT doc_id, block_no, span_no, font = 'CMMI10' OR ((x0 + x1) / 2 BETWEEN 100.5 AND 119.5 AND (y0 + y1) / 2 BETWEEN 30.5 AND 79.5) AS is_math FROM sp""")
def math_spans(spark, sf_dir):
    """FLT-32: a font of the census, or inside a formula box from (100, 30) to (120, 80)."""
    s = _spans(spark, sf_dir)
    census = s.select("doc_id", "font").distinct().withColumn("is_math", F.col("font") == "CMMI10")
    boxes = s.select(*PAGE).distinct().select(*PAGE, F.lit(100.0).alias("r_x0"), F.lit(30.0).alias("r_y0"), F.lit(120.0).alias("r_x1"), F.lit(80.0).alias("r_y1"))
    return E.math_spans(s, census, boxes).select("doc_id", "block_no", "span_no", "is_math")


@query(f"""WITH {_SPANS}, s AS (SELECT *, trim(text) AS t, row_number() OVER w AS k, lag(x1) OVER w AS px FROM sp WHERE length(trim(text)) > 0 WINDOW w AS (PARTITION BY doc_id, pno, block_no ORDER BY round(y0, 1), x0, x1)),
    j AS (SELECT doc_id, pno, block_no, trim(regexp_replace(string_agg(CASE WHEN k > 1 AND x0 - px > 1.2 THEN ' ' ELSE '' END || t, '' ORDER BY k), '\\s+', ' ', 'g')) AS text FROM s GROUP BY 1, 2, 3) SELECT doc_id, pno, block_no, CASE WHEN length(text) BETWEEN 1 AND 200 THEN text END AS text FROM j""")
def inline_math(spark, sf_dir):
    """STR-5 with all spans of a line as formula spans."""
    return E.inline_math(_spans(spark, sf_dir), [*PAGE, "block_no"])


_LINE_WORDS = f"{LAYOUT_SQL}, wd AS (SELECT doc_id, ln, unnest(range(len(string_split(line, ' ')))) AS i, unnest(string_split(line, ' ')) AS word FROM lay), k AS (SELECT *, length(word) % 4 = 0 AS m, sum(CASE WHEN length(word) % 4 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, ln ORDER BY i) AS c FROM wd)"


@query(f"""WITH {_LINE_WORDS} SELECT doc_id, ln, trim(regexp_replace(string_agg(CASE WHEN m THEN '⟨' || c || '⟩' ELSE word END, ' ' ORDER BY i), '\\s+', ' ', 'g')) AS marked, trim(regexp_replace(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT m), ''), '\\s+', ' ', 'g')) AS raw FROM k GROUP BY 1, 2""")
def marked_texts(spark, sf_dir):
    """STR-3, WIN-5: words of a fourth of all lengths stand for formulas."""
    tokens = F.transform(F.split("line", " ", -1), lambda w: F.struct(F.when(F.length(w) % 4 == 0, "m").otherwise("t").alias("kind"), w.alias("text")))
    return _layout(spark, sf_dir).select("doc_id", "ln", tokens.alias("tokens")).select("doc_id", "ln", X.marked_text(F.col("tokens")).alias("marked"), X.raw_text(F.col("tokens")).alias("raw"))


@query(f"""WITH RECURSIVE {LAYOUT_SQL}, h AS (SELECT doc_id, pno, ln % 12 AS k, CASE n % 9 WHEN 0 THEN 'IV. Next' WHEN 1 THEN '3) item' ELSE line END AS t, n % 7 = 0 AS bold, n % 5 = 0 AS italic FROM lay),
    r AS (SELECT doc_id, pno, k, 0 AS g, 1 AS c, t, bold, italic FROM h WHERE k = 0
        UNION ALL SELECT h.doc_id, h.pno, h.k, CASE WHEN x THEN r.g + 1 ELSE r.g END, CASE WHEN x THEN 1 ELSE r.c + 1 END, h.t, h.bold, h.italic
        FROM (SELECT h.doc_id, h.pno, h.k, h.t, h.bold, h.italic, r.g AS rg, r.c AS rc, (h.bold AND NOT r.bold) OR (NOT r.bold AND regexp_matches(trim(h.t), '^(I{{1,3}}|IV|VI{{0,3}}|IX|XI{{0,3}})\\.\\s*[A-Z]|^[A-Z]\\.\\s|^\\d{{1,2}}\\)\\s')) OR (r.c = 1 AND length(trim(h.t)) > 35 AND NOT h.bold AND (r.bold OR (r.italic AND NOT h.italic AND length(r.t) <= 60))) AS x FROM r JOIN h ON h.doc_id = r.doc_id AND h.pno = r.pno AND h.k = r.k + 1) h
        JOIN r ON r.doc_id = h.doc_id AND r.pno = h.pno AND r.k = h.k - 1)
    SELECT doc_id, pno, k, g AS part FROM r""")
def heading_splits(spark, sf_dir):
    """AGG-F7: a page's lines as a block, with numbered, bold and italic ones."""
    n = F.col("n")
    t = F.when(n % 9 == 0, "IV. Next").when(n % 9 == 1, "3) item").otherwise(F.col("line"))
    row = F.struct((F.col("ln") % 12).alias("k"), F.struct(t.alias("text"), (n % 7 == 0).alias("bold"), (n % 5 == 0).alias("italic")).alias("x"))
    by = _layout(spark, sf_dir).groupBy(*PAGE).agg(F.array_sort(F.collect_list(row)).alias("all"))
    return by.select(*PAGE, F.inline(F.arrays_zip(F.transform("all", lambda y: y["k"]).alias("k"), D.heading_groups(F.transform("all", lambda y: y["x"])).alias("part"))))


# ---------------------------------------------------------------- neighbours
@query(f"""WITH {LAYOUT_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, pno ORDER BY ln) AS k FROM lay WHERE n > 0 AND n % 11 <> 0) SELECT a.doc_id, a.ln, a.y0 - coalesce(p.y1, -1) AS gap FROM b a LEFT JOIN b p ON p.doc_id = a.doc_id AND p.pno = a.pno AND p.k = a.k - 1""")
def block_gaps(spark, sf_dir):
    """WIN-4: lines as blocks, every eleventh length a formula."""
    b = _layout(spark, sf_dir).withColumn("ord", F.col("ln"))
    return W.gaps_above(b, (F.col("n") > 0) & (F.col("n") % 11 != 0)).select("doc_id", "ln", "gap")


@query(f"WITH {LAYOUT_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pno, ln) AS k FROM lay) SELECT doc_id, ln FROM k WHERE k <= 48")
def first_rects(spark, sf_dir):
    """WIN-9: the first 48 rectangles of each document; the limit is the feature."""
    return W.first_rows(_layout(spark, sf_dir), ["doc_id"], ["pno", "ln"], 48).select("doc_id", "ln")


@query(f"WITH {LAYOUT_SQL}, s AS (SELECT doc_id, pno, left(line, 30) AS head FROM lay WHERE ln % 4 <> 0) SELECT doc_id, ln FROM lay WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.doc_id = lay.doc_id AND s.pno = lay.pno AND s.head = left(lay.line, 30))")
def new_tails(spark, sf_dir):
    """JOIN-12: against a source without every fourth line."""
    lay = _layout(spark, sf_dir)
    return J.new_tails(lay, lay.where("ln % 4 <> 0")).select("doc_id", "ln")


@query(f"""WITH {LAYOUT_SQL}, r AS (SELECT *, row_number() OVER w AS rn, lead(base) OVER w AS nxt FROM lay WINDOW w AS (PARTITION BY doc_id, pno ORDER BY base, x0, ln)),
    o AS (SELECT a.doc_id, a.pno, a.ln AS a, b.ln AS b, left(b.line, 32) AS q FROM r a JOIN r b ON a.doc_id = b.doc_id AND a.pno = b.pno AND b.rn BETWEEN a.rn + 1 AND a.rn + 7 WHERE a.nxt - a.base > 0.5 AND b.base - a.base <= 60 AND least(a.x1, b.x1) - greatest(a.x0, b.x0) > 6 AND (b.base - a.base) / least(a.size, b.size) < 0.75),
    h AS (SELECT doc_id, pno, left(line, 32) AS q, arg_min(ln, (base, x0, ln)) AS ln FROM lay GROUP BY 1, 2, 3), f AS (SELECT h.*, lay.x0, lay.y0, lay.x1, lay.y1 FROM h JOIN lay ON lay.doc_id = h.doc_id AND lay.ln = h.ln),
    w AS (SELECT doc_id, pno, x0 - 1 AS x0, y0 - 1 AS y0, x1 + 1 AS x1, y1 + 1 AS y1 FROM lay WHERE n % 5 = 0),
    c AS (SELECT f.doc_id, f.pno, f.q FROM f JOIN w ON w.doc_id = f.doc_id AND w.pno = f.pno WHERE (f.x1 - f.x0) * (f.y1 - f.y0) > 0 GROUP BY f.doc_id, f.pno, f.q, f.x0, f.y0, f.x1, f.y1 HAVING sum(greatest(least(f.x1, w.x1) - greatest(f.x0, w.x0), 0) * greatest(least(f.y1, w.y1) - greatest(f.y0, w.y0), 0)) >= 0.6 * (f.x1 - f.x0) * (f.y1 - f.y0))
    SELECT doc_id, pno, a, b FROM o WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = o.doc_id AND c.pno = o.pno AND c.q = o.q)""")
def ghost_pairs(spark, sf_dir):
    """JOIN-13: lines of every fifth length lie under white fills."""
    lay = _layout(spark, sf_dir)
    fills = lay.where("n % 5 = 0").select(*PAGE, (F.col("x0") - 1).alias("x0"), (F.col("y0") - 1).alias("y0"), (F.col("x1") + 1).alias("x1"), (F.col("y1") + 1).alias("y1"))
    return J.without_ghosts(J.overlap_pairs(lay), lay, fills).select(*PAGE, "a", "b")


@query(f"""WITH {LAYOUT_SQL}, q AS (SELECT doc_id, ln, x0, y0 + n % 9 AS y0, x1, y0 + 10 + n % 20 AS y1, size, y1 AS b1, 1.0 * (y1 - y0) / (1 + n % 3) AS tall FROM lay), h AS (SELECT *, greatest(tall, 0.9 * size) AS h FROM q)
    SELECT doc_id, ln, abs((y0 + y1) - (b1 - tall + b1)) / 2 <= 0.65 * h AND least(y1, b1) - greatest(y0, b1 - tall) > 0.15 * h AND y1 - y0 <= 2.2 * h AS inline FROM h""")
def inline_formulas(spark, sf_dir):
    """FLT-13: a shifted copy of each line as a formula, the line as a paragraph of one to three lines."""
    n = F.col("n")
    b = F.struct("x0", (F.col("y0") + n % 9).alias("y0"), "x1", (F.col("y0") + 10 + n % 20).alias("y1"), "size")
    p = F.struct(((F.col("y1") - F.col("y0")) / (1 + n % 3)).alias("tall"), F.col("y1").alias("low"))
    return _layout(spark, sf_dir).select("doc_id", "ln", b.alias("b"), p.alias("p")).select("doc_id", "ln", D.in_last_line(F.col("b"), F.col("p")).alias("inline"))


# ---------------------------------------------------------------- re-layout
@query(f"""WITH {LAYOUT_SQL}, pp AS (SELECT *, ln // 3 AS seq, n % 11 = 0 AS is_math FROM lay), s AS (SELECT doc_id, pno, seq, min(x0) AS x0, max(x1) AS x1, max(n) AS n_chars FROM pp WHERE x1 - x0 > 4 GROUP BY 1, 2, 3),
    ty AS (SELECT doc_id, pno, list_sort(list(x1 - x0)) AS w FROM pp WHERE NOT is_math AND x1 - x0 > 30 GROUP BY 1, 2), j AS (SELECT s.*, coalesce(w[len(w) // 2 + 1], 0.0) AS typical FROM s LEFT JOIN ty ON ty.doc_id = s.doc_id AND ty.pno = s.pno)
    SELECT doc_id, pno, seq, x0, CASE WHEN (x1 - x0 < 8 OR (x1 - x0 < 70 AND n_chars >= 12)) AND typical > 0 THEN greatest(x1, x0 + typical) ELSE x1 END AS x1, typical FROM j""")
def paragraph_spans(spark, sf_dir):
    """LAY-9: paragraphs of three lines."""
    p = _layout(spark, sf_dir).select(*PAGE, F.expr("ln div 3").alias("seq"), "x0", "x1", (F.col("n") % 11 == 0).alias("is_math"), F.col("n").alias("n_chars"))
    return L.paragraph_span(p).select(*PAGE, "seq", "x0", "x1", "typical")


_BAND = "rg AS (SELECT DISTINCT doc_id, pno, CASE WHEN pno % 2 = 0 THEN 48.0 ELSE 312.0 END AS a0, 40.0 AS b0, CASE WHEN pno % 2 = 0 THEN 250.0 ELSE 545.0 END AS a1, 90.0 AS b1 FROM lay)"
_CUT = """cu AS (SELECT *, greatest(least(x1, a1) - greatest(x0, a0), 0) * greatest(least(y1, b1) - greatest(y0, b0), 0) AS common, greatest(y0, b0) AS hy0, least(y1, b1) AS hy1, greatest(x0, a0) AS hx0, least(x1, a1) AS hx1 FROM gr),
    pc AS (SELECT doc_id, pno, ln, unnest(CASE WHEN common < 0.5 THEN [{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}] ELSE list_filter([{'x0': x0, 'y0': y0, 'x1': x1, 'y1': hy0}, {'x0': x0, 'y0': hy1, 'x1': x1, 'y1': y1}, {'x0': x0, 'y0': hy0, 'x1': hx0, 'y1': hy1}, {'x0': hx1, 'y0': hy0, 'x1': x1, 'y1': hy1}], lambda q: q.x1 - q.x0 > 0.2 AND q.y1 - q.y0 > 0.2) END) AS r FROM cu)"""


def _band(lay: DataFrame) -> DataFrame:
    even = F.col("pno") % 2 == 0
    return lay.select(*PAGE).distinct().select(*PAGE, F.when(even, 48.0).otherwise(312.0).alias("x0"), F.lit(40.0).alias("y0"), F.when(even, 250.0).otherwise(545.0).alias("x1"), F.lit(90.0).alias("y1"))


@query(f"""WITH {LAYOUT_SQL}, {_BAND}, gr AS (SELECT lay.doc_id, lay.pno, lay.ln, x0 - 0.5 AS x0, y0 - 0.6 AS y0, x1 + 0.5 AS x1, y1 + 0.6 AS y1, a0, b0, a1, b1 FROM lay JOIN rg ON rg.doc_id = lay.doc_id AND rg.pno = lay.pno), {_CUT}
    SELECT doc_id, pno, 'erase' AS op, r.x0 AS x0, r.y0 AS y0, r.x1 AS x1, r.y1 AS y1 FROM pc WHERE r.x1 - r.x0 >= 1 AND r.y1 - r.y0 >= 1""")
def erase_ops(spark, sf_dir):
    """LAY-11, SNK-9, GEO-8: a page's lines around one region."""
    lay = _layout(spark, sf_dir)
    return L.erase_rects(lay, _band(lay))


@query(f"""WITH {LAYOUT_SQL}, {_BAND}, e AS (SELECT doc_id, pno, x0 - 0.5 AS x0, y0 - 0.6 AS y0, x1 + 0.5 AS x1, y1 - 4 AS y1 FROM lay WHERE n % 2 = 0),
    c AS (SELECT a.doc_id, a.pno, a.ln, a.x0, a.y0, a.x1, a.y1, sum(CASE WHEN e.doc_id IS NULL THEN 0 ELSE greatest(least(a.x1, e.x1) - greatest(a.x0, e.x0), 0) * greatest(least(a.y1, e.y1) - greatest(a.y0, e.y0), 0) END) AS t FROM lay a LEFT JOIN e ON e.doc_id = a.doc_id AND e.pno = a.pno GROUP BY 1, 2, 3, 4, 5, 6, 7)
    SELECT doc_id, pno, a0 AS x0, b0 AS y0, a1 AS x1, b1 AS y1 FROM rg UNION SELECT doc_id, pno, x0, y0, x1, y1 FROM c WHERE (x1 - x0) * (y1 - y0) > 0 AND t / ((x1 - x0) * (y1 - y0)) < 0.75 UNION SELECT doc_id, pno, x0, y0, x1, y1 FROM lay WHERE n % 7 = 0""")
def layout_obstacles(spark, sf_dir):
    """LAY-12, JOIN-19: lines of even lengths are erased but for their lowest part, every seventh length stays."""
    lay = _layout(spark, sf_dir)
    erased = lay.where("n % 2 = 0").select(*PAGE, (F.col("x0") - 0.5).alias("x0"), (F.col("y0") - 0.6).alias("y0"), (F.col("x1") + 0.5).alias("x1"), (F.col("y1") - 4).alias("y1"))
    return L.obstacles(_band(lay), lay, erased, lay.where("n % 7 = 0"))


@query(f"""WITH {LAYOUT_SQL}, o AS (SELECT doc_id, pno, ln, x0 AS x, base + 30 AS y, size, x1 - x0 AS width FROM lay WHERE n % 2 = 0), k AS (SELECT * FROM lay WHERE n % 2 = 1)
    SELECT doc_id, ln FROM o WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.doc_id = o.doc_id AND k.pno = o.pno AND least(o.x + o.width, k.x1) - greatest(o.x, k.x0) > 6 AND least(o.y - 0.22 * o.size + 0.28 * o.size, k.y1) - greatest(o.y - 0.22 * o.size - 0.82 * o.size, k.y0) > 0.35 * o.size)""")
def free_draws(spark, sf_dir):
    """LAY-13: even lines drawn 30 lower among the odd ones."""
    lay = _layout(spark, sf_dir)
    ops = lay.where("n % 2 = 0").select(*PAGE, "ln", F.col("x0").alias("x"), (F.col("base") + 30).alias("y"), "size", (F.col("x1") - F.col("x0")).alias("width"))
    return L.without_collisions(ops, lay.where("n % 2 = 1")).select("doc_id", "ln")


@query(f"""WITH {LAYOUT_SQL} SELECT doc_id, pno, ln AS seq, 'text' AS op, x0 AS x, base + k * 12 AS y, size, line || k AS text FROM lay, (SELECT unnest([0, 1]) AS k) WHERE n % 6 <> 0""")
def draw_ops(spark, sf_dir):
    """LAY-14, SNK-1: plans of two lines each; those without lines draw nothing."""
    lay = _layout(spark, sf_dir)
    line = lambda k: F.struct((F.col("base") + k * 12).alias("y"), F.concat("line", F.lit(str(k))).alias("text"))
    some = F.when(F.col("n") % 6 != 0, F.array(line(0), line(1))).otherwise(F.array().cast("array<struct<y:double,text:string>>"))
    plans = lay.select(*PAGE, F.col("ln").alias("seq"), "size", some.alias("lines"))
    return L.draw_ops(plans, lay.select(*PAGE, F.col("ln").alias("seq"), "x0"))


@query(f"""WITH {LAYOUT_SQL}, w AS (SELECT doc_id, pno, ln AS seq, CASE WHEN n % 5 = 0 THEN 'kept in the source language: ' || CASE WHEN n % 2 = 0 THEN 'no_room' ELSE 'overflow' END WHEN size - 6 < 5 THEN 'font under 5 pt' END AS warning FROM lay) SELECT * FROM w WHERE warning IS NOT NULL""")
def layout_warnings(spark, sf_dir):
    """LAY-15."""
    why = F.when(F.col("n") % 5 == 0, F.when(F.col("n") % 2 == 0, "no_room").otherwise("overflow"))
    return L.warnings(_layout(spark, sf_dir).select(*PAGE, F.col("ln").alias("seq"), why.alias("why"), (F.col("size") - 6).alias("size")))


@query(f"WITH {LAYOUT_SQL}, c AS (SELECT DISTINCT doc_id, pno, ln AS seq, unnest(string_split(line, '')) AS cp FROM lay WHERE n > 0) SELECT doc_id, pno, seq, 'crop' AS op, cp FROM c WHERE length(trim(cp)) > 0 AND NOT regexp_matches(cp, '^[a-zA-Z.,]$')")
def undrawn_glyphs(spark, sf_dir):
    """SNK-8, LAY-5: fonts with letters of the Latin alphabet, full stops and commas."""
    glyphs = spark.createDataFrame([(c,) for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ.,"], "cp string")
    return L.missing_glyphs(_layout(spark, sf_dir).select(*PAGE, F.col("ln").alias("seq"), F.col("line").alias("text")), glyphs)


@query()
def boxed_texts(spark, sf_dir):
    """LAY-8, AGG-17: every line in a box as wide as the line and 30 high."""
    lay = _layout(spark, sf_dir).where("n > 0")
    return lay.select("doc_id", "ln", L.boxed(F.col("line"), F.col("x1") - F.col("x0"), F.lit(30.0), 12.0, 4.0).alias("b")).select("doc_id", "ln", "b.*")


@query()
def kept_atoms(spark, sf_dir):
    """LAY-4: placeholders up to the paragraph's number of formulas stay."""
    t = F.concat("text", F.lit(" ⟨1⟩ and ⟨7⟩"))
    return L.kept_sizes(table(spark, sf_dir, "documents").select("doc_id", t.alias("text"), (F.col("doc_id") % 3).alias("formulas")))


# ---------------------------------------------------------------- files
@query("""WITH t AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS ln, unnest(string_split(text, chr(10))) AS line FROM documents)
    SELECT doc_id, CAST(ln // 5 AS INT) AS pno, CAST(ln % 5 AS INT) AS ord, CAST(ln AS INT) AS seq, CAST(ln * 2 AS DOUBLE) AS y0, ln % 4 = 0 AS heading, line AS src, 'T' || ln AS text FROM t""")
def dump_round_trip(spark, sf_dir):
    """SNK-4, SRC-11, JSN-1: documents as dumps of five lines a page, written as JSON and read back."""
    ln = F.col("ln")
    rows = text_lines(table(spark, sf_dir, "documents")).select("doc_id", F.expr("cast(ln div 5 as int)").alias("pno"), ln.cast("int").alias("seq"), F.lit(0).alias("col"), (ln * 2).cast("double").alias("y0"), F.lit(0.0).alias("x0"), (ln % 4 == 0).alias("heading"), F.col("line").alias("src"), F.concat(F.lit("T"), ln.cast("string")).alias("text"))
    path = f"{_folder(spark)}/dumps"
    T.dump_json(rows).write.parquet(path)
    return T.parsed_dumps(spark.read.parquet(path), "json").select("doc_id", "pno", "ord", "seq", "y0", "heading", "src", "text")


@query("""WITH j AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS k, count(*) OVER () AS n, event_type, value FROM events) SELECT CAST(event_id AS VARCHAR) AS id, 'p' || event_id AS pdf_path, event_type AS status, value AS progress FROM j WHERE k > n - 200""")
def ledger_round_trip(spark, sf_dir):
    """SNK-6, SRC-13, WIN-8: events as jobs, written as a ledger and read back; the 200 are the feature."""
    e = table(spark, sf_dir, "events")
    jobs = e.select(F.col("event_id").alias("seq"), F.col("event_id").cast("string").alias("id"), F.concat(F.lit("p"), F.col("event_id").cast("string")).alias("pdf_path"), F.col("event_type").alias("status"), F.col("value").alias("progress"))
    path = f"{_folder(spark)}/jobs.json"
    T.write_ledger(jobs, path)
    return T.read_ledger(spark, path).select("id", "pdf_path", "status", "progress")


@query("""WITH t AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), g AS (SELECT doc_id, CASE WHEN length(line) % 4 = 0 THEN 'term: ' || line WHEN length(line) % 4 = 1 THEN '`c`: ' || line ELSE line END AS line FROM t)
    SELECT doc_id, count(*) FILTER (instr(line, ':') > 1 AND NOT regexp_matches(string_split(line, ':')[1], '[`一-鿿]')) AS terms FROM g GROUP BY doc_id""")
def glossary_terms(spark, sf_dir):
    """AGG-9, SRC-12's count: lines of a fourth of all lengths are terms."""
    lines = F.transform(F.split("text", "\n", -1), lambda x: F.when(F.length(x) % 4 == 0, F.concat(F.lit("term: "), x)).when(F.length(x) % 4 == 1, F.concat(F.lit("`c`: "), x)).otherwise(x))
    return table(spark, sf_dir, "documents").select("doc_id", T.term_count(F.array_join(lines, "\n")).cast("long").alias("terms"))


@query("""WITH f AS (SELECT page_id AS ord, 'd/f ' || (page_id % 7) || '.pdf' AS name, CASE WHEN page_id % 3 = 0 THEN 'GIF' ELSE '%PDF-' END || html AS content FROM pages), s AS (SELECT ord, 'f ' || (ord % 7) AS stem, row_number() OVER (PARTITION BY ord % 7 ORDER BY ord) - 1 AS k FROM f WHERE left(content, 5) = '%PDF-')
    SELECT ord, stem || CASE WHEN k > 0 THEN '-' || k ELSE '' END || '.pdf' AS stored FROM s""")
def stored_uploads(spark, sf_dir):
    """SRC-16: web pages as files of seven names, a third of them not PDF."""
    p = F.col("page_id")
    f = table(spark, sf_dir, "pages").select(p.alias("ord"), F.concat(F.lit("d/f "), (p % 7).cast("string"), F.lit(".pdf")).alias("name"), F.concat(F.when(p % 3 == 0, "GIF").otherwise("%PDF-"), "html").cast("binary").alias("content"))
    return T.uploads(f).select("ord", "stored")


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN '/out/' || c_custkey || '.md' ELSE '/out/' || c_custkey || '.pdf' END AS path FROM customer WHERE c_custkey % 3 <= 1""")
def output_files(spark, sf_dir):
    """SNK-7: requests for a job's Markdown, its PDF or a foreign path."""
    k = F.col("c_custkey")
    path = lambda end: F.concat(F.lit("/out/"), k.cast("string"), F.lit(end))
    c = table(spark, sf_dir, "customer")
    jobs = c.select(k.alias("id"), F.array(path(".md"), path(".pdf")).alias("output_paths"))
    wanted = c.select(k.alias("id"), F.when(k % 3 == 0, path(".md")).when(k % 3 == 1, path(".pdf")).otherwise("/etc/passwd").alias("path"))
    return T.whitelisted(wanted, jobs)


# ---------------------------------------------------------------- requests and jobs
def lengths_transport(prompt: str) -> tuple[int, str, str]:
    """A transport without network: each numbered line's length; lines of a length of five's multiples get no answer."""
    asked = [M._LINE.match(x) for x in prompt.split("\n")]
    return 200, "\n".join(f"{m[1]}. L{len(m[2])}" for m in asked if m and len(m[2]) % 5), "stop"


@query("""WITH t AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS seq, unnest(string_split(text, chr(10))) AS line FROM documents), c AS (SELECT doc_id, seq, regexp_replace(line, '\\s+$', '') AS line FROM t WHERE length(trim(line, ' \t\n\r\v\f')) > 0)
    SELECT doc_id, CAST(seq AS INT) AS seq, CASE WHEN length(regexp_replace(line, '^\\s+', '')) % 5 <> 0 THEN 'L' || length(regexp_replace(line, '^\\s+', '')) END AS text FROM c""")
def sent_batches(spark, sf_dir):
    """SRC-14's protocol, STM-6 and STM-7: lines go in batches to a transport that leaves a fifth unanswered, and are swept."""
    lines = text_lines(table(spark, sf_dir, "documents")).select("doc_id", F.col("ln").cast("int").alias("seq"), F.regexp_replace("line", "^\\s+|\\s+$", "").alias("text")).where("length(text) > 0")
    folder = _folder(spark)
    batched = M.kept(D.batched(lines.withColumn("is_heading", F.length("text") <= 20)), f"{folder}/batches")
    answers = M.kept(M.translate(M.as_batches(batched), lengths_transport, wait=_no_wait), f"{folder}/answers")
    return M.sweep(batched, answers, lengths_transport, folder).select("doc_id", "seq", "text")


def _no_wait(seconds: float) -> None:
    return None


@query("""SELECT CASE WHEN event_id = 5 AND event_type NOT IN ('view', 'click') THEN 'again' ELSE CAST(event_id AS VARCHAR) END AS id, CASE WHEN event_id = 5 OR event_type IN ('view', 'click') THEN 'running' ELSE 'failed' END AS status FROM events WHERE event_id = 5 OR event_type IN ('view', 'click')""")
def running_jobs(spark, sf_dir):
    """STM-5: job 5 is retried if it has ended, then ended ones are cleared."""
    e = table(spark, sf_dir, "events")
    jobs = e.select(F.col("event_id").cast("string").alias("id"), F.when(F.col("event_type").isin("view", "click"), "running").otherwise("failed").alias("status"), F.lit(1).cast("long").alias("created_at"), F.lit(2).cast("long").alias("ended_at"), F.lit(0.5).alias("progress"), F.lit("e").alias("error"))
    return S.cleared(S.retried(jobs, "5", "again", 7)).select("id", "status")
