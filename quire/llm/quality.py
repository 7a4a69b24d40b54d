"""Quality rules with thresholds that adapt to language and source, in DataFrame operations alone.

1. Counts of each text (``signals``), all from one pass over its words.
2. For every (lang, source) a quantile sketch of each metric: a histogram whose
   buckets keep the seven upper bits of a whole number, so that quantiles are
   exact below 128 and within 1/64 above. Sketches merge by adding counts: tasks
   pre-aggregate them, and those of a language or of everything are sums of
   those of its sources. A sketch has at most 128 + 64 * 56 buckets.
3. Fences from the sketch's quartiles take the place of fixed cutoffs; groups
   under ``least_docs`` documents use their language's, languages under it use
   those of all documents.
4. Documents join the fences of their group; one beyond a fence isn't kept.

Edge cases: null and wordless texts have counts of 0 and fail the base rules;
null languages and sources are groups of their own; repeated rows count each;
an empty table gives an empty table; extra columns don't matter, as the result
holds only its own columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import common as C

SYMBOLS = "#*$%&|<>"
SPACES = "\t\n\x0b\x0c\r"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def split_words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), "")


def repeated_words(words: Column, width: int = 3) -> Column:
    """How many words lie in windows of ``width`` words that the list holds twice or more."""

    def marked(hashes: Column) -> Column:
        def covered(places: Column) -> Column:
            step = F.transform(places, lambda p, k: F.when(k == 0, F.lit(width)).otherwise(F.least(F.lit(width), p - F.element_at(places, F.greatest(k, F.lit(1))))))
            return F.aggregate(step, F.lit(0).cast("int"), lambda a, x: a + x)

        def again(rows: Column) -> Column:
            def same(x: Column, k: Column) -> Column:
                return F.element_at(rows, k).getField("h") == x.getField("h")

            twice = F.transform(rows, lambda x, k: F.when((k > 0) & same(x, F.greatest(k, F.lit(1))), x.getField("i")).when((k < F.size(rows) - 1) & same(x, F.least(k + 2, F.size(rows))), x.getField("i")))
            return let(F.sort_array(F.filter(twice, lambda i: i.isNotNull())), covered)

        rows = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(rows, again))

    at = F.transform(F.slice(words, 1, F.greatest(F.size(words) - width + 1, F.lit(0))), lambda w, i: F.xxhash64(w, *[F.element_at(words, i + k) for k in range(2, width + 1)]))
    return F.when(F.size(words) < width, F.lit(0)).otherwise(let(at, marked))


def signals(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words"))

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))

    lines = F.filter(F.split(t, "\n", -1), lambda x: F.length(F.translate(x, SPACES + " ", "")) > 0)
    out = docs.withColumn("_w", let(split_words(t), of_words)).withColumn("_l", let(lines, of_lines))
    out = out.withColumns({"word_chars": F.length(F.translate(t, SPACES + " ", "")).cast("long"), "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long")})
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c != text], F.col("_w.n_words").alias("n_words"), "word_chars", "n_symbols", F.col("_l.n_lines").alias("n_lines"), F.col("_l.n_dup_lines").alias("n_dup_lines"), F.col("_w.n_repeat_words").alias("n_repeat_words"))


#: Per metric: its value as a whole number, and the least distance of a fence from its quartile.
#: A quartile range of 0 (most texts have no symbol at all) would else put the fence on the quartile.
METRICS = {
    "symbols": ("1000 * n_symbols div n_words", 100),
    "dup_lines": ("1000 * n_dup_lines div n_lines", 400),
    "repeats": ("1000 * n_repeat_words div n_words", 400),
    "mean_chars": ("100 * word_chars div n_words", 150),
}


def bucket(v: str) -> str:
    """The lower edge of the sketch bucket of a whole number: its seven upper bits."""
    shift = f"greatest(length(bin({v})) - 7, 0)"
    return f"shiftleft(shiftright({v}, {shift}), {shift})"


def sketches(counted: DataFrame, least_words: int = 50) -> DataFrame:
    """(level, lang, source, metric, bucket, n) of texts with ``least_words`` words; level 2 by source, 1 by language, 0 all."""
    pairs = ", ".join(f"named_struct('metric', '{m}', 'v', {v})" for m, (v, _) in METRICS.items())
    rows = counted.where(F.col("n_words") >= least_words).select("lang", "source", F.expr(f"inline(array({pairs}))"))
    by = rows.groupBy("lang", "source", "metric", F.expr(bucket("v")).alias("bucket")).agg(F.count("*").alias("n"))
    levels = []
    for level, keys in ((2, ["lang", "source"]), (1, ["lang"]), (0, [])):
        some = by.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
        levels.append(some.select(F.lit(level).alias("level"), *[(F.col(k) if k in keys else F.lit(None).cast("string")).alias(k) for k in ("lang", "source")], "metric", "bucket", "n"))
    return levels[0].unionByName(levels[1]).unionByName(levels[2])


def fences(sketch: DataFrame, times: float = 3.0, least_docs: int = 100) -> DataFrame:
    """(level, lang, source, docs, lo, hi): per group a map from each metric to the values it may take."""
    group = ["level", "lang", "source", "metric"]
    up = F.sum("n").over(Window.partitionBy(*group).orderBy("bucket"))
    ranked = sketch.withColumn("up", up).withColumn("all", F.sum("n").over(Window.partitionBy(*group)))
    q = ranked.groupBy(*group).agg(F.max("all").alias("docs"), *[F.min(F.when(F.col("up") * 4 >= F.col("all") * k, F.col("bucket"))).alias(f"q{k}") for k in (1, 3)])
    floor = F.create_map(*[x for m, (_, least) in METRICS.items() for x in (F.lit(m), F.lit(least))])[F.col("metric")]
    reach = F.greatest(F.lit(times) * (F.col("q3") - F.col("q1")), floor.cast("double"))
    q = q.withColumn("fence", F.struct("metric", (F.col("q1") - reach).alias("lo"), (F.col("q3") + reach).alias("hi")))
    rows = q.groupBy("level", "lang", "source").agg(F.max("docs").alias("docs"), *[F.max(F.when(F.col("metric") == m, F.struct("fence.lo", "fence.hi"))).alias(m) for m in METRICS])
    return rows.where((F.col("docs") >= least_docs) | (F.col("level") == 0))


def judge(docs: DataFrame, times: float = 3.0, least_docs: int = 100, least_words: int = 50, text: str = "text") -> DataFrame:
    """(doc_id, lang, source, the counts, base_failed, kept): base rules, then the fences of the text's group."""
    counted = C.written(signals(docs.select("doc_id", "lang", "source", text), text))
    table = C.written(fences(sketches(counted, least_words), times, least_docs))  # a row for each group
    inner = [F.struct(*METRICS).alias("f")]
    groups = counted.select("lang", "source").distinct()
    two = table.where("level = 2").select(F.col("lang").alias("l2"), F.col("source").alias("s2"), inner[0].alias("f2"))
    one = table.where("level = 1").select(F.col("lang").alias("l1"), inner[0].alias("f1"))
    none = table.where("level = 0").select(F.lit(True).alias("k0"), inner[0].alias("f0"))
    named = groups.join(two, F.col("lang").eqNullSafe(F.col("l2")) & F.col("source").eqNullSafe(F.col("s2")), "left").join(one, F.col("lang").eqNullSafe(F.col("l1")), "left")
    named = named.withColumn("k", F.lit(True)).join(none, F.col("k") == F.col("k0"), "left").select(F.col("lang").alias("gl"), F.col("source").alias("gs"), F.coalesce("f2", "f1", "f0").alias("f"))
    rows = counted.join(named, F.col("lang").eqNullSafe(F.col("gl")) & F.col("source").eqNullSafe(F.col("gs")), "left")
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    fits = F.lit(True)
    for m, (v, _) in METRICS.items():
        x = F.expr(v.replace("n_words", "greatest(n_words, 1)").replace("div n_lines", "div greatest(n_lines, 1)"))
        fits = fits & F.coalesce((x >= F.col(f"f.{m}.lo")) & (x <= F.col(f"f.{m}.hi")), F.lit(True))
    return rows.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & fits).alias("kept"))
