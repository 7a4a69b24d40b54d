"""Queries on texts, with the SQL that they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import rewrite as R
from quire.functions import text as X
from quire.functions.constants import ACCENTS, FUNCTIONS, SIGNS, WRAPPERS
from quire.operators import joins as J
from quire.operators import pages as P
from quire.operators.relations import LAYOUT_SQL, PAGE_WIDTH, pseudo_layout, text_lines

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ORDER_SQL = f"""{LAYOUT_SQL},
    c AS (SELECT *, count(*) OVER w AS k, sum(CASE WHEN x0 < {PAGE_WIDTH / 2} - 10 AND x1 > {PAGE_WIDTH / 2} + 10 AND x1 - x0 < {PAGE_WIDTH} * 0.6 THEN 1 ELSE 0 END) OVER w AS straddle,
        sum(CASE WHEN (x0 + x1) / 2 < {PAGE_WIDTH / 2} THEN 1 ELSE 0 END) OVER w AS lefts FROM lay WINDOW w AS (PARTITION BY doc_id, pno)),
    d AS (SELECT *, NOT (straddle > 0 AND straddle > 0.15 * k) AND greatest(lefts, k - lefts) > 0.6 * k AS two_col FROM c),
    ordered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, pno ORDER BY CASE WHEN two_col AND (x0 + x1) / 2 >= {PAGE_WIDTH / 2} THEN 1 ELSE 0 END, y0, x0, ln) AS ord FROM d)"""


@query(f"""WITH {ORDER_SQL},
    b AS (SELECT doc_id, pno, ord, trim(line) AS body FROM ordered WHERE length(trim(line)) > 0),
    g AS (SELECT doc_id, pno, sum(length(body)) AS chars, string_agg(body, chr(10) || chr(10) ORDER BY ord) AS text FROM b GROUP BY doc_id, pno)
    SELECT doc_id, count(*) AS pages, CAST(sum(chars) AS BIGINT) AS chars, string_agg('[PAGE ' || (pno + 1) || ']' || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY pno) AS text FROM g GROUP BY doc_id""")
def preview_text(spark, sf_dir):
    """SRC-6, WIN-1, WIN-2."""
    return P.plain_text(pseudo_layout(table(spark, sf_dir, "documents")), PAGE_WIDTH)


@query(f"WITH {ORDER_SQL} SELECT doc_id, pno, ln, CAST(two_col AS BOOLEAN) AS two_col, ord FROM ordered")
def reading_order(spark, sf_dir):
    """WIN-1, WIN-2 line by line."""
    return P.reading_order(pseudo_layout(table(spark, sf_dir, "documents")), PAGE_WIDTH).select("doc_id", "pno", "ln", "two_col", "ord")


@query("""WITH s AS (SELECT n_nationkey AS k, 20 AS pages, [[n_nationkey, n_nationkey + 3], [n_regionkey + 1, n_regionkey + 1]] AS parts FROM nation),
    u AS (SELECT k, pages, unnest(parts) AS p FROM s)
    SELECT DISTINCT k AS n_nationkey, CAST(page - 1 AS INT) AS page FROM (SELECT k, pages, unnest(range(greatest(p[1], 1), least(p[2], pages) + 1)) AS page FROM u)""")
def page_spec_expand(spark, sf_dir):
    """SRC-4, SET-1: specs like 3-6,2 over 20 pages."""
    spec = F.concat(F.col("n_nationkey").cast("string"), F.lit("-"), (F.col("n_nationkey") + 3).cast("string"), F.lit(","), (F.col("n_regionkey") + 1).cast("string"))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.explode(X.page_spec(spec, F.lit(20), strict=False)).alias("page"))


@query("""WITH s AS (SELECT n_nationkey AS k, [[n_nationkey + 1, n_nationkey + 4], [n_regionkey + 1, n_regionkey + 1]] AS parts FROM nation),
    u AS (SELECT k, unnest(parts) AS p FROM s)
    SELECT DISTINCT k AS n_nationkey, CAST(page - 1 AS INT) AS page FROM (SELECT k, unnest(range(p[1], least(p[2], 20) + 1)) AS page FROM u)""")
def page_spec_strict(spark, sf_dir):
    """SRC-3, SRC-5: the same from page 1 on, with full-width commas, clamped ends and parts beyond the last page."""
    spec = F.concat((F.col("n_nationkey") + 1).cast("string"), F.lit("-"), (F.col("n_nationkey") + 4).cast("string"), F.lit("，"), (F.col("n_regionkey") + 1).cast("string"))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.explode(X.page_spec(spec, F.lit(20), strict=True)).alias("page"))


SOLID = "regexp_replace(line, '\\s+', '', 'g')"


def _count_sql(text: str, cls: str) -> str:
    return f"(length({text}) - length(regexp_replace({text}, '{cls}', '', 'g')))"


_WORDS = "list_filter(string_split(trim(regexp_replace(line, '\\s+', ' ', 'g')), ' '), lambda w: length(w) > 0)"


@query(f"""WITH t AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS ln, unnest(string_split(text, chr(10))) AS line FROM documents),
    s AS (SELECT *, {SOLID} AS solid, {_WORDS} AS words, regexp_extract_all(line, '[A-Za-z][A-Za-z\\-'']+') AS en FROM t),
    f AS (SELECT *, {_count_sql("solid", "[\\p{Nd}.,%±\\-–—~()<>+]")} AS digits, {_count_sql("solid", "\\p{L}")} AS letters, {_count_sql("line", "\\p{Nd}")} AS nd, list_sum(list_transform(words, lambda w: length(w))) AS wlen FROM s)
    SELECT doc_id, ln, length(solid) >= 6 AND digits / greatest(length(solid), 1) >= 0.30 AND coalesce(wlen, 0) / greatest(len(words), 1) <= 7.0 AND (CASE WHEN len(words) >= 2 AND nd >= 1 THEN 1 ELSE 0 END) >= 1 AS numeric,
        NOT regexp_matches(line, '[一-鿿]') AND {_count_sql("line", "\\p{L}")} / greatest(length(line), 1) < 0.6 AS skip,
        length(line) <= 110 AND (regexp_matches(trim(line), '^(I{{1,3}}|IV|VI{{0,3}}|IX|XI{{0,3}})\\.\\s*[A-Z]') OR regexp_matches(trim(line), '^\\d{{1,2}}(\\.\\d{{1,2}}){{0,2}}\\.\\s+[A-Z][a-z]') OR regexp_matches(trim(line), '^[A-Z]\\.\\s+[A-Z]') OR regexp_matches(trim(line), '(?i)^({X.HEADING_WORDS})\\b')) AS heading,
        len(en) >= 5 AND {_count_sql("line", "\\p{L}")} / greatest(length(line), 1) >= 0.6 AND len(list_filter(en, lambda w: length(w) >= 3)) > 0 AS english,
        CASE WHEN length(solid) > 0 THEN {_count_sql("solid", "[一-鿿]")} / length(solid) ELSE 0.0 END AS cjk FROM f""")
def line_features(spark, sf_dir):
    """FLT-7, FLT-14, FLT-15, FLT-25, FLT-26 of every line."""
    x = F.col("line")
    return text_lines(table(spark, sf_dir, "documents")).select("doc_id", "ln", X.numeric_table(x, F.array(x), strict=False).alias("numeric"), X.is_skip(x).alias("skip"), X.is_heading(x, F.trim(x)).alias("heading"), X.english_sentence(x).alias("english"), X.cjk_share(x).alias("cjk"))


@query("""WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
    u AS (SELECT doc_id, list_transform(range(1, len(lines) + 1), lambda i: lower(lines[i]) || CASE WHEN i % 2 = 0 THEN '-' ELSE '' END) AS lines FROM t),
    j AS (SELECT doc_id, list_reduce(lines, lambda a, x: CASE WHEN ends_with(a, '-') AND regexp_matches(x, '^\\p{Ll}') THEN left(a, length(a) - 1) || x ELSE a || ' ' || x END) AS joined FROM u)
    SELECT doc_id, trim(regexp_replace(joined, '\\s+', ' ', 'g')) AS joined FROM j""")
def join_lines_dehyphen(spark, sf_dir):
    """STR-1, STR-2 on lines in lower case of which every second ends in a hyphen."""
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.concat(F.lower(x), F.when(i % 2 == 1, F.lit("-")).otherwise(F.lit(""))))
    return table(spark, sf_dir, "documents").select("doc_id", X.join_lines(lines).alias("joined"))


_INJECT = "'key sk-abcdefgh' || doc_id || 'ijklmnopqrstu https://user:pw@host/x?token=abc' || doc_id || '&b=1 Bearer zzzzzzzzzzzzzzzzzzzz' || doc_id || ' ' || text"


def _injected(docs: DataFrame) -> DataFrame:
    d = F.col("doc_id").cast("string")
    return docs.select("doc_id", F.concat(F.lit("key sk-abcdefgh"), d, F.lit("ijklmnopqrstu https://user:pw@host/x?token=abc"), d, F.lit("&b=1 Bearer zzzzzzzzzzzzzzzzzzzz"), d, F.lit(" "), "text").alias("text"))


@query(f"""WITH t AS (SELECT doc_id, {_INJECT} AS text FROM documents)
    SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)bearer\\s+[A-Za-z0-9._~+/=-]+', 'Bearer [REDACTED]', 'g'), 'sk-[A-Za-z0-9_-]{{8,}}', '[REDACTED]', 'g'), '(?i)(https?://)[^/@\\s]+@', '\\1[REDACTED]@', 'g'),
        '(?i)([?&](?:api[_-]?key|key|token|access_token|secret)=)[^&\\s]+', '\\1[REDACTED]', 'g') AS text FROM t""")
def redact_text(spark, sf_dir):
    """STR-14, STR-15 on whole documents behind injected secrets."""
    return _injected(table(spark, sf_dir, "documents")).select("doc_id", X.redacted(F.col("text")).alias("text"))


@query(f"""WITH t AS (SELECT doc_id, {_INJECT} AS text FROM documents), r(rule, pattern) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in J.SECRET_RULES.items())})
    SELECT doc_id, rule FROM t, r WHERE regexp_matches(text, pattern)""")
def secret_scan(spark, sf_dir):
    """JOIN-16 on whole documents behind injected secrets."""
    return J.scan_rules(_injected(table(spark, sf_dir, "documents"))).select("doc_id", "rule")


_ANSWER = "'1. ' || left(role, 3) || chr(10) || '2) x' || turn || chr(10) || 'lost line' || chr(10) || '2、' || length(text) || chr(10) || ' 4 . end'"


@query(f"""WITH t AS (SELECT conv_id, turn, unnest(string_split({_ANSWER}, chr(10))) AS line, unnest(range(5)) AS i FROM conversations),
    p AS (SELECT conv_id, turn, i, CAST(regexp_extract(line, '^\\s*(\\d+)\\s*[.、)]\\s*(.+)$', 1) AS INT) AS k, trim(regexp_extract(line, '^\\s*(\\d+)\\s*[.、)]\\s*(.+)$', 2)) AS v FROM t WHERE regexp_matches(line, '^\\s*(\\d+)\\s*[.、)]\\s*(.+)$'))
    SELECT conv_id, turn, k, arg_max(v, i) AS v, CAST([3] AS VARCHAR) AS missing FROM p GROUP BY conv_id, turn, k""")
def parse_numbered(spark, sf_dir):
    """STR-11, STR-12 on built answers: a repeated number, a lost line and a missing number."""
    answer = F.concat(F.lit("1. "), F.substring("role", 1, 3), F.lit("\n2) x"), F.col("turn").cast("string"), F.lit("\nlost line\n2、"), F.length("text").cast("string"), F.lit("\n 4 . end"))
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", X.parse_numbered(answer).alias("m"))
    missing = F.concat(F.lit("["), F.array_join(X.missing_numbers(F.col("m"), F.lit(4)).cast("array<string>"), ", "), F.lit("]"))
    return t.select("conv_id", "turn", F.explode("m").alias("k", "v"), missing.alias("missing"))


@query("""SELECT page_id, regexp_replace(url, '/+$', '') || CASE WHEN ends_with(regexp_replace(url, '/+$', ''), '/v1') THEN '' ELSE '/v1' END || '/chat/completions' AS endpoint,
    left(regexp_replace(regexp_replace(lower(url), '[^a-z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g'), 41) AS slug, regexp_replace(upper(url), '[^A-Z0-9]+', '_', 'g') || '_API_KEY' AS credential,
    regexp_replace(regexp_replace(regexp_replace(url, '^.*[/\\\\]', ''), '[^A-Za-z0-9_ .\\-一-鿿]+', '_', 'g'), '^_+|_+$', '', 'g') AS safe, regexp_replace(regexp_replace(url || '.PDF', '^.*[/\\\\]', ''), '(?i)\\.pdf$', '') AS stem FROM pages""")
def names_and_urls(spark, sf_dir):
    """STR-16 to STR-19, STR-22."""
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", X.endpoint(u, F.lit("chat/completions")).alias("endpoint"), X.slug(u).alias("slug"), X.credential_name(u).alias("credential"), X.safe_name(u).alias("safe"), X.stem(F.concat(u, F.lit(".PDF"))).alias("stem"))


@query("""SELECT doc_id, left(repeat('本文提出一种新的方法并在多个数据集上验证其有效性。', CAST(greatest(6, floor(0.60 * length(regexp_replace(text, '\\s+', '', 'g')))) AS INT) // 24 + 1), CAST(greatest(6, floor(0.60 * length(regexp_replace(text, '\\s+', '', 'g')))) AS INT)) AS text FROM documents""")
def synthetic_translation(spark, sf_dir):
    """STR-21, JOIN-3's default."""
    return table(spark, sf_dir, "documents").select("doc_id", X.synthetic(F.col("text")).alias("text"))


def _latex_sql(t: str) -> str:
    """LaTeX step by step: each command by its own replacement (twice, as neighbours share the sign between them)."""
    q = lambda x: x.replace("'", "''")
    put = lambda p, new: f"regexp_replace({t}, '{q(p)}', '{q(new)}', 'g')"
    arg = r"\s*\{([^{}]*)\}"
    for _ in range(3):
        t = put(r"\\(?:" + "|".join(WRAPPERS) + ")" + arg, r"\1")
    t = put(r"\\[dt]?frac" + arg + arg, r"\1/\2")
    t = put(r"\\sqrt" + arg, r"√(\1)")
    for name, mark in ACCENTS.items():
        t = put(rf"\\{name}\s*\{{?([A-Za-z0-9])\}}?", rf"\1{mark}")
    t = put(r"\\(?:left|right|big|Big|bigg|Bigg)\s*", "")
    t = put(r"\\(?:begin|end)\s*\{[^{}]*\}", " ")
    t = put(r"\\\\", "；")
    t = put("&", "，")
    for name, sign in [*SIGNS.items(), *((f, f) for f in sorted(FUNCTIONS - set(SIGNS)))]:
        for _ in range(2):
            t = put(rf"\\{name}([^a-zA-Z]|$)", rf"{sign}\1")
    t = put(r"\\([%_#$~^{}])", r"\1")
    t = put(r"\$", "")
    return put(r"[ \t]{2,}", " ")


_TEX = r"$\mathcal{L} = \frac{a}{b} \times \hat{M}$ "


@query(f"""WITH t AS (SELECT doc_id, 'x^{{2}} t_{{k}} 10^{{−1}} xA ⟨3⟩ ' || nfc_normalize(text) AS t FROM documents) SELECT doc_id, CASE WHEN contains(t, '$') OR contains(t, '\\') THEN {_latex_sql("t")} ELSE t END AS text FROM t""")
def nfkc_norm(spark, sf_dir):
    """STR-6, STR-7, STR-9 on texts with raised, lowered and wide characters."""
    t = F.concat(F.lit("ｘ² tₖ 10⁻¹ 𝑥𝐴 〈3》 "), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", R.normal_column(t).alias("text"))


@query(f"""SELECT doc_id, {_latex_sql("t")} AS text FROM (SELECT doc_id, '{_TEX}' || text AS t FROM documents)""")
def latex_to_unicode(spark, sf_dir):
    """STR-8."""
    t = F.concat(F.lit(_TEX), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", R.latex_column(t).alias("text"))


@query()
def atom_tokens(spark, sf_dir):
    """LAY-2, LAY-3."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(R.atoms_column(F.col("text"))).alias("i", "a")).select("doc_id", "i", "a.*")


@query()
def wrap_lines(spark, sf_dir):
    """LAY-5, LAY-6 at 10 points and 230 wide."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(R.wrapped_column(F.col("text"), 10.0, 230.0)).alias("ln", "line"))
