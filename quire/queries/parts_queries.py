"""Queries on the parts that whole plans are made of, with the SQL that they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import rewrite as R
from quire.functions import text as X
from quire.operators import aggregates as A
from quire.operators import folds as D
from quire.operators import joins as J
from quire.operators import layout as L
from quire.operators import pages as P
from quire.operators import regions as E
from quire.operators import windows as W
from quire.operators.relations import LAYOUT_SQL, PAGE_HEIGHT, PAGE_WIDTH, pseudo_layout
from quire.sources import tables as T
from quire.streaming import watcher as S

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


def _count(t: str, chars: str) -> str:
    return f"(length({t}) - length(regexp_replace({t}, '{chars}', '', 'g')))"


# ---------------------------------------------------------------- predicates of words
_MATH = f"[\\p{{Sm}}\\p{{Co}}{X.MATH_CLASS}]"
_WORDS_SQL = """w AS (SELECT doc_id, unnest(range(len(string_split(text, ' ')))) AS i, unnest(string_split(text, ' ')) AS word FROM documents),
    t AS (SELECT doc_id, i, word || CASE i % 6 WHEN 0 THEN repeat('∑α', length(word) % 5) WHEN 1 THEN repeat('', length(word) % 9) WHEN 2 THEN '_{' || length(word) || '}' WHEN 3 THEN repeat('中', length(word) % 2) ELSE '' END AS t FROM w),
    s AS (SELECT *, regexp_replace(t, '\\s+', '', 'g') AS solid, trim(t, ' \t\n\r\v\f') AS cut FROM t)"""


def _words(spark, sf_dir) -> DataFrame:
    """Words of all texts, five of six with signs of formulas, private use or CJK behind them."""
    w = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", " ", -1)).alias("i", "word"))
    n = F.length("word")
    end = F.when(F.col("i") % 6 == 0, F.repeat(F.lit("∑α"), n % 5)).when(F.col("i") % 6 == 1, F.repeat(F.lit(""), n % 9)).when(F.col("i") % 6 == 2, F.concat(F.lit("_{"), n.cast("string"), F.lit("}"))).when(F.col("i") % 6 == 3, F.repeat(F.lit("中"), n % 2)).otherwise("")
    return w.select("doc_id", "i", F.concat("word", end).alias("t"))


@query(f"""WITH {_WORDS_SQL}, d AS (SELECT *, CASE WHEN length(solid) > 0 THEN {_count("solid", _MATH)} / length(solid) ELSE 0.0 END AS density FROM s)
    SELECT doc_id, i, density, (i % 7) / greatest(length(t), 1) > 0.5 OR density > 0.45 AS line_math, length(trim(regexp_replace(t, '\\s+', ' ', 'g'))) > 0 AND ((CASE WHEN i % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN i % 3 = 0 THEN 1 ELSE 0 END) * 2 > 2 OR density > 0.45) AS block_math,
        length(solid) > 0 AND {_count("solid", "\\p{Co}")} >= greatest(1, length(solid) // 2) AS private, {_count("solid", "[一-鿿]")} > 0.05 * length(solid) AND length(solid) > 0 AS cjk FROM d""")
def word_predicates(spark, sf_dir):
    """FLT-9, FLT-10, FLT-11, FLT-17, FLT-24."""
    t, i = F.col("t"), F.col("i")
    return _words(spark, sf_dir).select("doc_id", "i", X.math_density(t).alias("density"), X.line_is_math(t, i % 7).alias("line_math"), X.block_is_math(F.array(i % 2 == 0, i % 3 == 0), t).alias("block_math"), X.private_dominant(t).alias("private"), X.is_cjk(t).alias("cjk"))


_HARD = X.HARD_MATH.replace("'", "''")
_SIGNS = f"^[\\p{{Sm}}\\p{{Co}}{X.MATH_CLASS}\\\\{{}}^_\\[\\]|&<>~]+$"


@query(f"""WITH {_WORDS_SQL}, f AS (SELECT doc_id, i, cut, solid, regexp_matches(solid, '[{_HARD}]') AS hard, regexp_matches(solid, '{_SIGNS}') AS signs, {_count("solid", "\\p{L}")} <= greatest(1, length(solid) // 3) AS few,
        regexp_matches(cut, '^[(){{}}\\[\\]|&^_=+*/<>~.,;:!?''"`\\\\-]+$') OR regexp_matches(cut, '^[A-Za-z]{{1,3}}[_^]\\{{?[^}}]{{0,12}}\\}}?$') OR regexp_matches(cut, '^\\\\?[A-Za-z]{{1,2}}\\s+[A-Za-z]{{1,3}}\\s+[A-Za-z]{{1,3}}$') AS marks FROM s)
    SELECT doc_id, i, length(cut) > 0 AND length(cut) <= 40 AND (regexp_matches(cut, '\\\\[A-Za-z]') OR (hard AND CASE WHEN signs THEN few ELSE marks AND NOT regexp_matches(cut, '\\d{{2,}}') END)) AS debris FROM f""")
def math_debris(spark, sf_dir):
    """FLT-18."""
    return _words(spark, sf_dir).select("doc_id", "i", X.math_debris(F.col("t")).alias("debris"))


@query(f"WITH {_WORDS_SQL} SELECT doc_id, i, translate(t, chr(61537) || chr(61538) || chr(61616), 'αβ°') AS t FROM s")
def symbol_decode(spark, sf_dir):
    """STR-4 on words of which a sixth hold private-use letters."""
    return _words(spark, sf_dir).select("doc_id", "i", X.decode_symbols(F.col("t")).alias("t"))


@query("""WITH t AS (SELECT doc_id, regexp_extract_all(text || '，中文。x', '[一-鿿]|[，。；：？！“”‘’（）《》、—…·．,.;:?!()\\[\\]<>"''/\\\\]| |[^一-鿿，。；：？！“”‘’（）《》、—…·．,.;:?!()\\[\\]<>"''/\\\\ ]+') AS p FROM documents)
    SELECT doc_id, unnest(range(len(p))) AS i, unnest(p) AS piece FROM t""")
def cjk_pieces(spark, sf_dir):
    """STR-10."""
    t = F.concat("text", F.lit("，中文。x"))
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(R.cjk_pieces(t)).alias("i", "piece"))


# ---------------------------------------------------------------- predicates of lines, blocks and pages
@query(f"""WITH {LAYOUT_SQL}, b AS (SELECT doc_id, pno, list(line ORDER BY ln) AS lines, string_agg(line, chr(10) ORDER BY ln) AS t FROM lay GROUP BY 1, 2),
    f AS (SELECT *, regexp_replace(t, '\\s+', '', 'g') AS s, list_filter(string_split(trim(regexp_replace(t, '\\s+', ' ', 'g')), ' '), lambda w: length(w) > 0) AS words,
        len(list_filter(lines, lambda x: len(list_filter(string_split(trim(regexp_replace(x, '\\s+', ' ', 'g')), ' '), lambda w: length(w) > 0)) >= 3 AND length(x) - length(regexp_replace(x, '\\p{{Nd}}', '', 'g')) >= 2)) AS dense FROM b)
    SELECT doc_id, pno, length(s) >= 24 AND len(lines) >= 3 AND {_count("s", "[\\p{Nd}.,%–\\-−~()]")} / greatest(length(s), 1) >= 0.35 AND coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) / greatest(len(words), 1) <= 5.5 AND dense >= greatest(2, floor(0.6 * len(lines))) AS numeric FROM f""")
def numeric_pages(spark, sf_dir):
    """FLT-6 with a page's lines as a block."""
    by = _layout(spark, sf_dir).groupBy("doc_id", "pno").agg(F.transform(F.array_sort(F.collect_list(F.struct("ln", "line"))), lambda x: x["line"]).alias("lines"))
    return by.select("doc_id", "pno", X.numeric_table(F.array_join("lines", "\n"), F.col("lines")).alias("numeric"))


@query(f"""WITH {LAYOUT_SQL}, c AS (SELECT doc_id, pno, ln, CASE WHEN n % 3 = 0 THEN line || ', A 2019 doi' ELSE line END AS line FROM lay), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, pno ORDER BY ln) AS k FROM c)
    SELECT doc_id, pno FROM k WHERE k <= 120 GROUP BY 1, 2 HAVING count(*) FILTER (length(line) >= 20 AND ((regexp_matches(line, '\\b(19|20)\\d{{2}}\\b') AND regexp_matches(line, '[,(]\\s*[A-Z]')) OR regexp_matches(line, '(?i)doi|https?://|\\bvol\\.|\\bpp\\.'))) >= greatest(3, floor(0.25 * count(*)))""")
def bibliography_pages(spark, sf_dir):
    """FLT-19, WIN-9 with every third line's length marking a citation; the first 120 blocks are the rule's own."""
    lay = _layout(spark, sf_dir)
    return P.bibliography_pages(lay.withColumn("line", F.when(F.col("n") % 3 == 0, F.concat("line", F.lit(", A 2019 doi"))).otherwise(F.col("line"))))


_PAGE_SQL = f"{LAYOUT_SQL}, pg AS (SELECT doc_id, pno, string_agg(line, chr(10) ORDER BY ln) || CASE WHEN doc_id % 3 = 0 THEN ' The user has requested enhancement' WHEN doc_id % 5 = 0 THEN ' See discussions, stats, and author profiles' ELSE '' END AS text, doc_id % 2 AS n_images FROM lay GROUP BY 1, 2)"


def _pages(spark, sf_dir) -> DataFrame:
    by = _layout(spark, sf_dir).groupBy("doc_id", "pno").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ln", "line"))), lambda x: x["line"]), "\n").alias("text"))
    mark = F.when(F.col("doc_id") % 3 == 0, " The user has requested enhancement").when(F.col("doc_id") % 5 == 0, " See discussions, stats, and author profiles").otherwise("")
    return by.select("doc_id", "pno", F.concat("text", mark).alias("text"), (F.col("doc_id") % 2).alias("n_images"))


@query(f"WITH {_PAGE_SQL} SELECT doc_id, pno, length(text) AS n FROM pg WHERE NOT (pno = 0 AND (doc_id % 3 = 0 OR doc_id % 5 = 0))")
def cover_pages(spark, sf_dir):
    """FLT-1: covers are first pages with a marker, which two documents of three and five have."""
    return P.without_cover(_pages(spark, sf_dir)).select("doc_id", "pno", F.length("text").alias("n"))


@query(f"WITH {_PAGE_SQL}, o AS (SELECT doc_id, pno, CASE WHEN pno % 2 = 0 THEN '  ' ELSE text END AS text, n_images FROM pg) SELECT doc_id, pno FROM o WHERE trim(text) = '' AND n_images > 0")
def ocr_pages(spark, sf_dir):
    """SRC-7's choice, with every second page blank."""
    return P.needs_ocr(_pages(spark, sf_dir).withColumn("text", F.when(F.col("pno") % 2 == 0, "  ").otherwise(F.col("text")))).select("doc_id", "pno")


@query(f"WITH {LAYOUT_SQL}, m AS (SELECT doc_id, max(pno) + 1 AS pages FROM lay GROUP BY 1) SELECT lay.doc_id, lay.pno, lay.ln FROM lay JOIN m ON m.doc_id = lay.doc_id WHERE lay.pno = 0 OR lay.pno BETWEEN 2 AND least(7, pages) - 1")
def page_slice(spark, sf_dir):
    """SRC-2: pages 1 and 3 to 7."""
    lay = _layout(spark, sf_dir)
    m = lay.groupBy("doc_id").agg((F.max("pno") + 1).alias("pages"))
    return P.pages_in(lay.join(m, "doc_id"), F.lit("1,3-7"), F.col("pages")).select("doc_id", "pno", "ln")


@query(f"""WITH {LAYOUT_SQL}, b AS (SELECT *, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS s, string_split(trim(regexp_replace(line, '\\s+', ' ', 'g')), ' ') AS raw FROM lay), c AS (SELECT *, list_filter(raw, lambda w: length(w) > 0) AS words FROM b)
    SELECT doc_id, ln, n % 13 <= 10 AND y1 - y0 + n % 100 <= 105 AND len(words) < 40 AND coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) / greatest(len(words), 1) <= 5.4 AS plausible,
        regexp_matches(line, '^\\s*[^:]') AND instr(line, ':') > 1 AND NOT regexp_matches(string_split(line, ':')[1], '[`一-鿿]') AS term FROM c""")
def line_plausible(spark, sf_dir):
    """FLT-12, AGG-9's line test."""
    line = F.col("line")
    return _layout(spark, sf_dir).select("doc_id", "ln", E.formula_plausible(F.col("n") % 13, F.col("y1") - F.col("y0") + F.col("n") % 100, line).alias("plausible"), X.glossary_term(line).alias("term"))


# ---------------------------------------------------------------- errors, models and settings
_ERR = "SELECT event_id, 399 + event_id % 110 AS status, CASE event_id % 6 WHEN 0 THEN 'HTTP 429 Too Many' WHEN 1 THEN 'read timed out' WHEN 2 THEN 'Invalid API-key' WHEN 3 THEN 'connect refused' WHEN 4 THEN 'Unauthorised' ELSE props END AS message FROM events"


@query(f"""WITH e AS ({_ERR}), p AS (SELECT *, status IN (400, 401, 403, 404, 422) AS permanent FROM e)
    SELECT event_id, permanent, NOT permanent AND regexp_matches(message, '(?i)401|429|50[0234]|timeout|timed out|connection|temporarily') AS transient,
        CASE WHEN status >= 400 AND regexp_matches(message, '(?i)401|403|api.?key|unauthori[sz]ed|auth') THEN 'auth' WHEN status >= 400 AND regexp_matches(message, '(?i)connect|timeout|network|refused|unreachable') THEN 'connection' END AS kind FROM p""")
def error_kinds(spark, sf_dir):
    """FLT-28, FLT-31."""
    k = F.col("event_id") % 6
    e = table(spark, sf_dir, "events").select("event_id", (399 + F.col("event_id") % 110).alias("status"), F.when(k == 0, "HTTP 429 Too Many").when(k == 1, "read timed out").when(k == 2, "Invalid API-key").when(k == 3, "connect refused").when(k == 4, "Unauthorised").otherwise(F.col("props")).alias("message"))
    s, m = F.col("status"), F.col("message")
    return e.select("event_id", X.is_permanent(s).alias("permanent"), X.is_transient(s, m).alias("transient"), X.failure_kind(s >= 400, m).alias("kind"))


@query("""WITH m AS (SELECT p_brand AS provider, p_name AS model, p_partkey AS ord FROM part), k AS (SELECT *, row_number() OVER (PARTITION BY provider, model ORDER BY ord) AS k FROM m) SELECT provider, model, ord FROM k WHERE k = 1""")
def first_models(spark, sf_dir):
    """SET-3 with brands as providers."""
    m = table(spark, sf_dir, "part").select(F.col("p_brand").alias("provider"), F.col("p_name").alias("model"), F.col("p_partkey").alias("ord"))
    return J.first_of(m, ["provider", "model"], "ord")


@query("""SELECT p_brand AS provider, p_name AS model FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_brand, p_name FROM part a WHERE p_partkey % 3 = 0 AND NOT EXISTS (SELECT 1 FROM part b WHERE b.p_partkey % 2 = 0 AND a.p_brand = b.p_brand AND a.p_name = b.p_name)""")
def chosen_models(spark, sf_dir):
    """SET-6: even parts as chosen models, every third as one typed in."""
    p = table(spark, sf_dir, "part")
    cols = [F.col("p_brand").alias("provider"), F.col("p_name").alias("model")]
    return E.chosen_models(p.where("p_partkey % 2 = 0").select(*cols), p.where("p_partkey % 3 = 0").select(*cols))


@query("""SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 = 0 THEN 'user' || s_nationkey WHEN s_suppkey % 3 = 0 THEN 'both' || s_nationkey END AS endpoint FROM supplier""")
def provider_profiles(spark, sf_dir):
    """JOIN-18: the user's entry, else the merged one."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("provider"), F.col("s_nationkey").cast("string").alias("n"))
    user = s.where("provider % 4 = 0").select("provider", F.concat(F.lit("user"), "n").alias("endpoint"))
    merged = s.where("provider % 3 = 0").select("provider", F.concat(F.lit("both"), "n").alias("endpoint"))
    return J.profile(s.select("provider"), user, merged).select(F.col("provider").alias("id"), "endpoint")


@query("""WITH m AS (SELECT p_brand AS id, list_sort(list(DISTINCT p_size)) AS models FROM part WHERE p_size % 2 = 0 GROUP BY 1 UNION ALL SELECT DISTINCT p_type, []::INT[] FROM part) SELECT id, len(models) AS n FROM m WHERE len(models) > 0 AND list_contains(['Brand#11', 'Brand#12', 'Brand#23', 'Brand#55'], id)""")
def routable_providers(spark, sf_dir):
    """FLT-29: brands with models that the list names."""
    p = table(spark, sf_dir, "part")
    m = p.where("p_size % 2 = 0").groupBy(F.col("p_brand").alias("id")).agg(F.collect_set("p_size").alias("models")).unionByName(p.select(F.col("p_type").alias("id")).distinct().withColumn("models", F.array().cast("array<int>")))
    return J.routable(m, F.array(*[F.lit(b) for b in ("Brand#11", "Brand#12", "Brand#23", "Brand#55")])).select("id", F.size("models").cast("long").alias("n"))


@query("""WITH w AS (SELECT p_brand AS role, p_name AS font, p_partkey AS ord FROM part), l AS (SELECT DISTINCT p_name AS font FROM part WHERE p_size > 25) SELECT role, arg_min(font, ord) FILTER (font IN (SELECT font FROM l)) AS font FROM w GROUP BY role""")
def font_choice(spark, sf_dir):
    """SRC-20 with brands as roles and big parts as fonts that load."""
    p = table(spark, sf_dir, "part")
    return E.fonts_of(p.select(F.col("p_brand").alias("role"), F.col("p_name").alias("font"), F.col("p_partkey").alias("ord")), p.where("p_size > 25").select(F.col("p_name").alias("font")))


@query("""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)
    SELECT doc_id, array_to_string(list_transform(lines[1:3], lambda m: left(m, 200)), chr(10)) AS kept, array_to_string(list_transform(range(1, len(lines) + 1), lambda i: i || '. ' || lines[i]), chr(10)) AS asked FROM d""")
def messages_and_prompts(spark, sf_dir):
    """SRT-4, whose cuts are the feature, and STR-13 on whole texts."""
    lines = F.split("text", "\n", -1)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(E.shortened(lines), "\n").alias("kept"), X.numbered_prompt(lines).alias("asked"))


# ---------------------------------------------------------------- boxes
_RECT = "g AS (SELECT l_orderkey AS doc_id, l_linenumber AS item, max(l_partkey) AS p, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2), re AS (SELECT doc_id, 0 AS pno, item, p, q, CAST(p % 400 AS DOUBLE) AS x0, CAST(p % 97 * 7 AS DOUBLE) AS y0, CAST(p % 400 + 4 * q AS DOUBLE) AS x1, CAST(p % 97 * 7 + 100 AS DOUBLE) AS y1 FROM g)"


def _rects(spark, sf_dir) -> DataFrame:
    """The lines of an order as rectangles on a page."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("p"), F.max("l_quantity").alias("q"))
    x0, y0 = F.col("p") % 400, F.col("p") % 97 * 7
    return li.select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("pno"), F.col("l_linenumber").alias("item"), "p", "q", x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), (x0 + 4 * F.col("q")).cast("double").alias("x1"), (y0 + 100).cast("double").alias("y1"))


def _as_regions(r: DataFrame, grow: float = 30.0) -> DataFrame:
    return r.select("doc_id", "pno", (F.col("x0") - grow).alias("r_x0"), (F.col("y0") - grow).alias("r_y0"), (F.col("x1") + grow).alias("r_x1"), (F.col("y1") + grow).alias("r_y1"))


def _cover(a: str, b: str) -> str:
    return f"greatest(least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0), 0) * greatest(least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0), 0) / greatest(({a}.x1 - {a}.x0) * ({a}.y1 - {a}.y0), 1e-6)"


_EVEN = "o AS (SELECT doc_id, item, x0 - 30 AS x0, y0 - 30 AS y0, x1 + 30 AS x1, y1 + 30 AS y1 FROM re WHERE item % 2 = 0), s AS (SELECT * FROM re WHERE item % 2 = 1)"


@query(f"WITH {_RECT}, {_EVEN} SELECT doc_id, item FROM s WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.doc_id = s.doc_id AND {_cover('s', 'o')} >= 0.7)")
def picture_filter(spark, sf_dir):
    """FLT-3: odd lines of an order as blocks, even ones as pictures."""
    r = _rects(spark, sf_dir)
    return E.without_pictures(r.where("item % 2 = 1"), _as_regions(r.where("item % 2 = 0"))).select("doc_id", "item")


@query(f"WITH {_RECT}, {_EVEN} SELECT 'delete' AS op, doc_id, item FROM s WHERE EXISTS (SELECT 1 FROM o WHERE o.doc_id = s.doc_id AND {_cover('s', 'o')} >= 0.95)")
def neutral_drawings(spark, sf_dir):
    """GEO-13."""
    r = _rects(spark, sf_dir)
    return E.neutralized(r.where("item % 2 = 1"), _as_regions(r.where("item % 2 = 0"))).select("op", "doc_id", "item")


@query(f"""WITH {_RECT}, {_EVEN}, b AS (SELECT *, CASE WHEN p % 2 = 0 THEN 'Label ' || p ELSE repeat('word ', 1 + CAST(q AS INT) % 9) || 'it ends here.' END AS t, 1 + p % 4 AS n_lines FROM s), f AS (SELECT *, length(t) AS n, regexp_matches(t, '[.。！？!?；;:：]\\s*$') AND length(t) > 24 AS ends FROM b)
    SELECT doc_id, item FROM f WHERE EXISTS (SELECT 1 FROM o WHERE o.doc_id = f.doc_id AND {_cover('f', 'o')} >= 0.55 AND n > 0 AND CASE WHEN o.item % 4 = 0 THEN n <= 130 AND n_lines <= 8 AND NOT ends AND f.x1 - f.x0 <= greatest(240.0, 0.72 * (o.x1 - o.x0)) AND n / greatest(n_lines, 1) <= 34 ELSE n <= 64 AND n_lines <= 3 AND NOT ends END)""")
def region_labels(spark, sf_dir):
    """FLT-8, GEO-12: odd lines of an order as blocks, even ones as vector or picture regions."""
    r = _rects(spark, sf_dir)
    text = F.when(F.col("p") % 2 == 0, F.concat(F.lit("Label "), F.col("p").cast("string"))).otherwise(F.concat(F.repeat(F.lit("word "), 1 + F.col("q").cast("int") % 9), F.lit("it ends here.")))
    blocks = r.where("item % 2 = 1").withColumns({"text": text, "n_lines": (1 + F.col("p") % 4).cast("int")})
    even = r.where("item % 2 = 0")
    regions = even.select("doc_id", "pno", (F.col("x0") - 30).alias("r_x0"), (F.col("y0") - 30).alias("r_y0"), (F.col("x1") + 30).alias("r_x1"), (F.col("y1") + 30).alias("r_y1"), F.lit(0.55).alias("threshold"), F.when(F.col("item") % 4 == 0, "vec").otherwise("img").alias("kind"))
    return E.text_in_regions(blocks, regions).select("doc_id", "item")


@query(f"WITH {_RECT}, {_EVEN} SELECT s.doc_id, s.item AS block, o.item AS region FROM s JOIN o ON o.doc_id = s.doc_id AND (s.x0 + s.x1) / 2 BETWEEN o.x0 AND o.x1 AND (s.y0 + s.y1) / 2 BETWEEN o.y0 AND o.y1")
def point_in_rect(spark, sf_dir):
    """JOIN-14: centres of odd lines in even ones."""
    r = _rects(spark, sf_dir)
    regions = r.where("item % 2 = 0").select("doc_id", "pno", F.col("item").alias("region"), (F.col("x0") - 30).alias("r_x0"), (F.col("y0") - 30).alias("r_y0"), (F.col("x1") + 30).alias("r_x1"), (F.col("y1") + 30).alias("r_y1"))
    blocks = r.where("item % 2 = 1")
    return J.touching(blocks, regions, G.centre_in(G.rect(), G.rect("r_x0", "r_y0", "r_x1", "r_y1")), "inner").select(blocks["doc_id"], F.col("item").alias("block"), "region")


@query(f"""WITH {_RECT}, x AS (SELECT a.doc_id, a.item, coalesce(bool_or(b.item IS NOT NULL AND {_cover('a', 'b')} >= 0.5), false) AS hit FROM re a LEFT JOIN re b ON a.doc_id = b.doc_id AND b.item < a.item GROUP BY 1, 2) SELECT * FROM x""")
def hit_any(spark, sf_dir):
    """GEO-2: whether an earlier rectangle of the page covers half of one."""
    r = _rects(spark, sf_dir)
    before = r.alias("a").join(r.alias("b"), F.expr("a.doc_id = b.doc_id and b.item < a.item"), "left")
    lists = before.groupBy("a.doc_id", "a.item").agg(F.first(G.rect("a.x0", "a.y0", "a.x1", "a.y1")).alias("r"), F.collect_list(F.when(F.col("b.item").isNotNull(), G.rect("b.x0", "b.y0", "b.x1", "b.y1"))).alias("all"))
    return lists.select("doc_id", "item", G.hit_any(F.col("r"), F.col("all"), 0.5).alias("hit"))


@query(f"""WITH RECURSIVE {_RECT}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY item) AS k FROM re),
    r AS (SELECT doc_id, k, [{{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 'item': item}}] AS kept FROM k WHERE k = 1
        UNION ALL SELECT k.doc_id, k.k, CASE WHEN len(list_filter(r.kept, lambda b: greatest(least(k.x1, b.x1) - greatest(k.x0, b.x0), 0) * greatest(least(k.y1, b.y1) - greatest(k.y0, b.y0), 0) / greatest((k.x1 - k.x0) * (k.y1 - k.y0), 1e-6) > 0.9)) > 0 THEN r.kept ELSE list_append(r.kept, {{'x0': k.x0, 'y0': k.y0, 'x1': k.x1, 'y1': k.y1, 'item': k.item}}) END FROM r JOIN k ON k.doc_id = r.doc_id AND k.k = r.k + 1),
    z AS (SELECT doc_id, unnest(arg_max(kept, k)) AS b FROM r GROUP BY doc_id) SELECT doc_id, b.x0 AS x0, b.y0 AS y0, b.x1 AS x1, b.y1 AS y1 FROM z""")
def greedy_rects(spark, sf_dir):
    """SET-2: an order's rectangles in order, each unless one that stays covers 0.9 of it."""
    lists = _rects(spark, sf_dir).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("item", G.rect().alias("r")))), lambda x: x["r"]).alias("all"))
    return lists.select("doc_id", F.explode(J.dedupe_rects(F.col("all"))).alias("r")).select("doc_id", "r.*")


@query(f"WITH {_RECT}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY (x1 - x0) * (y1 - y0) DESC, item) AS k FROM re) SELECT doc_id, item FROM k WHERE k <= 3")
def top_drawings(spark, sf_dir):
    """SRT-3: the three largest drawings of a page; the limit is the feature."""
    return J.top_by_area(_rects(spark, sf_dir), 3).select("doc_id", "item")


_FILL = "f AS (SELECT *, CASE WHEN p % 3 = 0 THEN 1.0 WHEN p % 3 = 1 THEN 0.95 ELSE 0.5 END AS a, CASE WHEN p % 5 = 0 THEN 0.97 ELSE 0.92 END AS b, p % 4 = 0 AS bare FROM re)"


@query(f"""WITH {_RECT}, {_FILL} SELECT doc_id, item, (x1 - x0) * (y1 - y0) >= 4000 AND NOT bare AND p % 7 <> 0 AND a > 0.90 AND b > 0.90 AS light, x1 - x0 > 8 AND y1 - y0 > 4 AND NOT bare AND abs(a - 1) <= 0.04 AND abs(b - 1) <= 0.04 AS white FROM f""")
def fill_filters(spark, sf_dir):
    """FLT-22, FLT-27: fills of three shares, some missing, some with a border."""
    a = F.when(F.col("p") % 3 == 0, 1.0).when(F.col("p") % 3 == 1, 0.95).otherwise(0.5)
    b = F.when(F.col("p") % 5 == 0, 0.97).otherwise(0.92)
    r = _rects(spark, sf_dir).withColumn("fill", F.when(F.col("p") % 4 != 0, F.array(a, b, b))).withColumn("stroke", F.when(F.col("p") % 7 == 0, F.array(F.lit(0.0))))
    return r.select("doc_id", "item", F.coalesce(J.light_fill(G.rect(), F.col("fill"), F.col("stroke")), F.lit(False)).alias("light"), J.white_fill(G.rect(), F.col("fill")).alias("white"))


_AREA = PAGE_WIDTH * PAGE_HEIGHT
_TABLES = f"tb AS (SELECT *, 1 + p % 5 AS row_count, 1 + CAST(q AS INT) % 4 AS col_count, (x1 - x0) * (y1 - y0) / {_AREA} AS share, CASE WHEN p % 3 = 0 THEN 'lines' WHEN p % 3 = 1 THEN 'text' ELSE 'ruled' END AS strategy, p % 2 = 0 AS long_cell, p % 11 AS empty FROM re)"


def _tables(spark, sf_dir) -> DataFrame:
    strategy = F.when(F.col("p") % 3 == 0, "lines").when(F.col("p") % 3 == 1, "text").otherwise("ruled")
    cell = F.when(F.col("p") % 2 == 0, F.repeat(F.lit("x"), 50)).otherwise("1.5")
    # eleven cells, of which p % 11 are blank
    cells = F.transform(F.sequence(F.lit(0), F.lit(10)), lambda i: F.when(i < F.col("p") % 11, F.lit(" ")).otherwise(cell))
    return _rects(spark, sf_dir).withColumns({"row_count": 1 + F.col("p") % 5, "col_count": 1 + F.col("q").cast("int") % 4, "strategy": strategy, "cells": F.array(cells)})


@query(f"""WITH {_RECT}, {_TABLES} SELECT doc_id, item, row_count >= 2 AND col_count >= 2 AND CASE WHEN strategy = 'lines' THEN share BETWEEN 0.004 AND 0.55 ELSE row_count >= 3 AND col_count >= 3 AND share BETWEEN 0.01 AND 0.5 AND 11 - empty >= 0.55 * 11 AND NOT long_cell END AS credible,
    row_count >= 2 AND col_count >= 2 AND CASE WHEN strategy = 'ruled' THEN share BETWEEN 0.004 AND 0.55 ELSE share >= 0.005 END AS fallback FROM tb""")
def table_rules(spark, sf_dir):
    """FLT-20, FLT-21: tables of one to five rows and one to four columns, some with long or empty cells."""
    t = _tables(spark, sf_dir)
    ok = J.table_credible(F.col("row_count"), F.col("col_count"), G.rect(), F.lit(_AREA), F.col("strategy"), F.col("cells"))
    back = E.fallback_tables(t, _AREA).distinct().withColumn("fallback", F.lit(True))
    box = ["doc_id", "pno", "x0", "y0", "x1", "y1"]
    fits = (F.col("row_count") >= 2) & (F.col("col_count") >= 2)
    rows = t.select(*box, "item", ok.alias("credible"), "strategy", fits.alias("fits")).join(back, box, "left")
    share = G.area(G.rect()) / _AREA
    return rows.select("doc_id", "item", "credible", (F.coalesce("fallback", F.lit(False)) & F.col("fits") & F.when(F.col("strategy") == "ruled", share.between(0.004, 0.55)).otherwise(share >= 0.005)).alias("fallback"))


@query(f"""WITH {_RECT}, {_EVEN} SELECT s.doc_id, s.item, coalesce(bool_or(t.item IS NOT NULL AND ({_cover('s', 't')} >= 0.5 OR (least(s.x1, t.x1) - greatest(s.x0, t.x0) > 4 AND ((((s.x0 + s.x1) / 2 BETWEEN t.x0 AND t.x1 AND (s.y0 + s.y1) / 2 BETWEEN t.y0 AND t.y1) AND (s.x1 - s.x0) * (s.y1 - s.y0) < 0.2 * (t.x1 - t.x0) * (t.y1 - t.y0))
    OR ((s.y0 + s.y1) / 2 BETWEEN t.y0 - 6 AND t.y1 + 3 AND s.y1 - s.y0 < greatest(0.5 * (t.y1 - t.y0), 24.0) AND s.p % 2 <> 0))))), false) AS inside FROM (SELECT * REPLACE (y0 + 20 AS y0, y0 + 32 AS y1) FROM s) s LEFT JOIN o t ON s.doc_id = t.doc_id GROUP BY 1, 2""")
def in_table(spark, sf_dir):
    """FLT-4: low blocks of odd lines, the even ones as tables; blocks of even parts are captions."""
    r = _rects(spark, sf_dir)
    tables = r.where("item % 2 = 0").groupBy("doc_id").agg(F.collect_list(G.rect(F.col("x0") - 30, F.col("y0") - 30, F.col("x1") + 30, F.col("y1") + 30)).alias("tables"))
    b = r.where("item % 2 = 1").withColumns({"y0": F.col("y0") + 20, "y1": F.col("y0") + 32})
    captions = F.when(F.col("p") % 2 == 0, F.array(G.rect())).otherwise(F.array().cast(f"array<{G.RECT}>"))
    return b.join(tables, "doc_id", "left").select("doc_id", "item", J.in_table(G.rect(), F.col("tables"), captions).alias("inside"))


@query(f"""WITH {_RECT}, b AS (SELECT *, CASE WHEN p % 3 = 0 THEN 'lines' ELSE 'text' END AS strategy FROM re), c AS (SELECT *, (x1 - x0) * (y1 - y0) / {_AREA} AS share FROM b), k0 AS (SELECT doc_id, x0, y0, x1, y1, CASE WHEN strategy = 'lines' THEN 0 ELSE 1 END AS o FROM c WHERE doc_id % 6 <> 0 AND CASE WHEN strategy = 'lines' THEN share BETWEEN 0.004 AND 0.55 ELSE share BETWEEN 0.01 AND 0.5 END UNION ALL SELECT doc_id, 100.0, 600.0, 500.0, 800.0, 2 FROM (SELECT DISTINCT doc_id FROM re WHERE doc_id % 6 <> 0)),
    k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY o, y0, x0, x1, y1) AS k FROM k0),
    r AS (SELECT doc_id, k, [{{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}}] AS kept FROM k WHERE k = 1
        UNION ALL SELECT k.doc_id, k.k, CASE WHEN len(list_filter(r.kept, lambda b: greatest(least(k.x1, b.x1) - greatest(k.x0, b.x0), 0) * greatest(least(k.y1, b.y1) - greatest(k.y0, b.y0), 0) / greatest((k.x1 - k.x0) * (k.y1 - k.y0), 1e-6) > 0.9)) > 0 THEN r.kept ELSE list_append(r.kept, {{'x0': k.x0, 'y0': k.y0, 'x1': k.x1, 'y1': k.y1}}) END FROM r JOIN k ON k.doc_id = r.doc_id AND k.k = r.k + 1),
    z AS (SELECT doc_id, unnest(arg_max(kept, k)) AS b FROM r GROUP BY doc_id) SELECT doc_id, b.x0 AS x0, b.y0 AS y0, b.x1 AS x1, b.y1 AS y1 FROM z""".replace("WITH g AS", "WITH RECURSIVE g AS"))
def page_tables(spark, sf_dir):
    """SRC-17, FLT-20, SET-2: ruled, aligned and numeric tables; every sixth order is a bibliography."""
    r = _rects(spark, sf_dir)
    boxes = r.withColumns({"row_count": F.lit(3), "col_count": F.lit(3), "strategy": F.when(F.col("p") % 3 == 0, "lines").otherwise("text"), "cells": F.array(F.array(F.lit("1"), F.lit("2"), F.lit("3")))})
    pages = r.select("doc_id", "pno").distinct()
    numeric = pages.select("doc_id", "pno", F.lit(100.0).alias("x0"), F.lit(600.0).alias("y0"), F.lit(500.0).alias("x1"), F.lit(800.0).alias("y1"))
    return E.page_tables(boxes, pages.where("doc_id % 6 = 0"), numeric, _AREA).drop("pno")


@query(f"""WITH {_RECT}, v AS (SELECT a.doc_id, a.x0, a.y0, a.x1, a.y1, 0.80 AS threshold, 'vec' AS kind FROM re a WHERE a.item % 3 = 1 AND NOT EXISTS (SELECT 1 FROM re b WHERE b.item % 3 = 2 AND b.doc_id = a.doc_id AND {_cover('a', 'b')} >= 0.6))
    SELECT CAST(threshold AS DOUBLE) AS threshold, doc_id, x0, y0, x1, y1, kind FROM (SELECT doc_id, x0, y0, x1, y1, 0.92 AS threshold, 'img' AS kind FROM re WHERE item % 3 = 0 UNION ALL SELECT * FROM v UNION ALL SELECT doc_id, x0, y0, x1, y1, 0.55, 'table' FROM re WHERE item % 3 = 2)""")
def protected_regions(spark, sf_dir):
    """SRC-19, SET-5, JOIN-7: an order's rectangles in turn as images, drawings and tables."""
    r = _rects(spark, sf_dir)
    return T.protected_regions(r.where("item % 3 = 0"), r.where("item % 3 = 1"), r.where("item % 3 = 2")).drop("pno")


@query(f"""WITH {_RECT} SELECT doc_id, item, x1 - x0 > 25 AND y1 - y0 > 25 AS big, CASE p % 5 WHEN 0 THEN 'title' WHEN 1 THEN 'footer' WHEN 2 THEN 'aside' WHEN 3 THEN 'formula' ELSE 'Title' END AS label FROM re WHERE p % 5 IN (0, 1, 3) AND x1 > x0""")
def layout_items(spark, sf_dir):
    """SRC-9, SRC-10: boxes with known labels, and which of them would count as images."""
    label = F.when(F.col("p") % 5 == 0, "title").when(F.col("p") % 5 == 1, "footer").when(F.col("p") % 5 == 2, "aside").when(F.col("p") % 5 == 3, "formula").otherwise("Title")
    boxes = T.layout_boxes(_rects(spark, sf_dir).withColumn("label", label))
    big = T.image_rects(boxes, 25).select("doc_id", "item", F.lit(True).alias("big"))
    return boxes.join(big, ["doc_id", "item"], "left").select("doc_id", "item", F.coalesce("big", F.lit(False)).alias("big"), "label")


@query(f"WITH {_RECT} SELECT count(*) AS n, count(DISTINCT (doc_id, round(x0 / 50), round(x1 - x0))) AS places FROM (SELECT doc_id, round(x0 / 50) * 50 AS x0, 0 AS y0, round(x0 / 50) * 50 + x1 - x0 AS x1, 100 AS y1 FROM re) WHERE x1 - x0 > 40")
def image_places(spark, sf_dir):
    """SRC-10: images by rounded place and size."""
    x0 = F.round(F.col("x0") / 50) * 50
    r = _rects(spark, sf_dir).select("doc_id", "pno", x0.alias("x0"), F.lit(0.0).alias("y0"), (x0 + F.col("x1") - F.col("x0")).alias("x1"), F.lit(100.0).alias("y1"))
    return T.image_rects(r, 40).agg(F.count("*").alias("n")).crossJoin(T.image_rects(r, 40, True).agg(F.count("*").alias("places")))


@query(f"""WITH {_RECT}, b AS (SELECT doc_id, count(*) AS n, sum((x1 - x0) * (y1 - y0)) AS inked, (max(x1) - min(x0)) * (max(y1) - min(y0)) AS box FROM re GROUP BY doc_id) SELECT doc_id, CAST(inked AS DOUBLE) AS inked, box, CASE WHEN box > 0 THEN inked / box ELSE 0.0 END AS ink, CASE WHEN box > 0 THEN inked / box ELSE 0.0 END >= 0.06 AS dense FROM b""")
def ink_density(spark, sf_dir):
    """AGG-12."""
    return A.ink(_rects(spark, sf_dir), ["doc_id"])


@query(f"""WITH {_RECT}, n AS (SELECT doc_id, item, x0, greatest(y0, 0) AS y0, x0 + q AS x1, y1 FROM re WHERE q <= 0.45 * {PAGE_WIDTH}), w AS (SELECT *, max(x1) OVER (PARTITION BY doc_id ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM n),
    b AS (SELECT doc_id, count(*) AS n, sum(CASE WHEN reach IS NULL OR x0 > reach + 2 THEN 1 ELSE 0 END) AS columns, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM w GROUP BY doc_id) SELECT doc_id, n, CAST(columns AS BIGINT) AS columns, x0, CAST(y0 AS DOUBLE) AS y0, x1, y1 FROM b WHERE n >= 3 AND columns >= 2 AND (x1 - x0) * (y1 - y0) >= 2500""")
def numeric_columns(spark, sf_dir):
    """AGG-F12: narrow blocks as wide as a line's quantity."""
    return D.numeric_columns(_rects(spark, sf_dir).withColumn("x1", F.col("x0") + F.col("q").cast("double")), PAGE_WIDTH).drop("pno")


@query(f"""WITH {_RECT}, n AS (SELECT doc_id, item, x0 / 8 AS x0, y0 / 40 AS y0, x0 / 8 + 12 AS x1, y0 / 40 + 12 AS y1 FROM re), w AS (SELECT *, max(x1) OVER u AS px1, lag(y0) OVER v AS py0, lag(y1) OVER v AS py1 FROM n WINDOW u AS (PARTITION BY doc_id ORDER BY x0, item ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), v AS (PARTITION BY doc_id ORDER BY x0, item)),
    i AS (SELECT *, sum(CASE WHEN px1 IS NOT NULL AND (x0 - px1 > 2.5 OR NOT (least(y1, py1) - greatest(y0, py0) > 0.5 * least(y1 - y0, py1 - py0))) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY x0, item ROWS UNBOUNDED PRECEDING) AS island FROM w)
    SELECT doc_id, CAST(island AS BIGINT) AS island, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM i GROUP BY 1, 2""")
def joined_rects(spark, sf_dir):
    """AGG-F11."""
    r = _rects(spark, sf_dir).select("doc_id", "item", (F.col("x0") / 8).alias("x0"), (F.col("y0") / 40).alias("y0"), (F.col("x0") / 8 + 12).alias("x1"), (F.col("y0") / 40 + 12).alias("y1"))
    return D.accumulate_rects(r, ["doc_id"])
