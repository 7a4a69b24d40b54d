"""Mixing sources to target weights, in DataFrame operations alone.

1. The words of a source, document after document, form one stream, packed into
   blocks of ``block`` words; the last block of a source holds what is left.
2. A source needs the least number of blocks that hold its target; the words of
   its last draw beyond the target stay out (``spare``), so that every source
   meets its target to the word.
3. Output slots are dealt into shards of ``shard_slots``. The slots of all sources
   go through one pseudorandom permutation, so the source counts of a shard are a
   multinomial draw by the target shares, conditioned on the totals over all shards
   (independent draws would miss the targets by the square root of their number).
4. The j-th draw of a source takes block perm(j mod n) of its n blocks; perm is
   a swap-or-not permutation of [0, n), another one for each pass.
5. Slots and blocks join by (source, block).

A source that holds most rows is never gathered: its stream offsets come from
sums per hash bucket of about ``bucket_rows`` rows, and all joins are by block or
by bucket. Tables with a row for each source (``source_plan``) are sorted in one
task, which is meant for thousands of sources, not for millions.

Rows of a source follow each other by bucket, id and text hash, whatever the
order of the input, so reruns agree; rows equal in id and text are alike.

Edge cases: null and wordless texts have size 0 and take nothing; null is a
source of its own, after all others; sources of size 0 have target 0; null ids
and repeated rows are rows like others; an empty table gives an empty table;
extra columns don't matter, as the results hold only their own columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import common as C

CELLS = 4096


def permuted(df: DataFrame, index: str, size: str, keys: list[str], rounds: int = 12) -> DataFrame:
    """Replace ``index`` in [0, size) by its place in a swap-or-not permutation chosen by ``keys``.

    In every round an index either swaps with (key - index) mod size or stays,
    by one hashed bit of the larger of both: a bijection for any size.
    """
    named = ", ".join(f"`{k}`" for k in keys)
    other = f"pmod(pmod(xxhash64(2 * r, {named}), `{size}`) - x, `{size}`)"
    round_ = f"if(xxhash64(2 * r + 1, greatest(x, {other}), {named}) % 2 = 0, {other}, x)"
    return df.withColumn(index, F.expr(f"aggregate(sequence(1, {rounds}), `{index}`, (x, r) -> {round_})"))


def permuted_inverse(df: DataFrame, index: str, size: str, keys: list[str], rounds: int = 12) -> DataFrame:
    """The place that ``permuted`` maps to ``index``: each round undoes itself, so they go backwards."""
    named = ", ".join(f"`{k}`" for k in keys)
    other = f"pmod(pmod(xxhash64(2 * r, {named}), `{size}`) - x, `{size}`)"
    round_ = f"if(xxhash64(2 * r + 1, greatest(x, {other}), {named}) % 2 = 0, {other}, x)"
    return df.withColumn(index, F.expr(f"if(`{size}` > 0, aggregate(sequence({rounds}, 1, -1), `{index}`, (x, r) -> {round_}), `{index}`)"))


def _before(x: str | Column, w) -> Column:
    c = F.col(x) if isinstance(x, str) else x
    return F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def source_plan(sized: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(sid, source, source_size, target), a row for each source in code-point order, null last.

    Weights repeat over the sources and share ``share`` of all sizes; targets stop at
    ``cap`` times the source's size and the excess is reshared by weight. In closed
    form: with sources by rising cap / weight, those are capped whose share of what the
    earlier ones leave would exceed their cap. The table has one row per source.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    s = by.withColumn("sid", rank.cast("int")).withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    w = Window.orderBy(F.col("most") / F.col("weight"), "sid")
    every = Window.partitionBy()
    s = s.withColumn("all", F.sum("source_size").over(every) * F.lit(float(share)))
    s = s.withColumn("left", F.sum("weight").over(every) - _before("weight", w)).withColumn("level", (F.col("all") - _before("most", w)) / F.col("left"))
    free = F.when(F.col("level") * F.col("weight") < F.col("most"), F.struct((F.col("most") / F.col("weight")).alias("r"), "sid", "level"))
    s = s.withColumn("free", F.min(free).over(every)["level"])
    return s.select("sid", "source", "source_size", F.coalesce(F.least("most", F.col("free") * F.col("weight")), F.col("most")).alias("target"))


@dataclass
class Mixture:
    """sources (sid, source, source_size, target, blocks, draws, spare); rows (every document with its text's hash
    ``h`` and its place ``start`` in its source's stream); slots (shard, slot, sid, block_id, words): what each
    slot takes from the start of its block; fragments (sid, block_id, doc_id, h, start, first, at, n): the words
    [first, first + n) of a document that a block holds from its own word ``at`` on."""

    sources: DataFrame
    rows: DataFrame
    slots: DataFrame
    fragments: DataFrame

    @property
    def draws(self) -> DataFrame:
        """(shard, sid, n): source counts per shard."""
        return self.slots.groupBy("shard", "sid").agg(F.count("*").alias("n"))

    def taken(self) -> DataFrame:
        """Fragments with ``uses`` > 0: how often the mixture takes them. One that a cut slot takes in part is two."""
        uses = self.slots.groupBy("sid", "block_id").agg(F.count("*").alias("uses"), F.min("words").alias("words"))
        met = self.fragments.join(uses, ["sid", "block_id"])
        head = F.greatest(F.lit(0), F.least(F.col("n"), F.col("words") - F.col("at")))
        parts = F.array(F.struct(F.col("first").alias("first"), head.alias("n"), F.col("uses").alias("uses")), F.struct((F.col("first") + head).alias("first"), (F.col("n") - head).alias("n"), (F.col("uses") - 1).alias("uses")))
        return met.select("sid", "block_id", "doc_id", "h", "start", F.inline(parts)).where("n > 0 and uses > 0")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, block: int = 32, shard_slots: int = 1024, seed: int = 7, bucket_rows: int = 1000, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> Mixture:
    """Draw a mixture of ``share`` times all words from all sources of ``docs``."""
    spark = docs.sparkSession
    words, h = C.word_count(F.col(text)), F.xxhash64(F.col(text).cast("string"))
    sized = C.written(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words.alias("size"), h.alias("h")))
    s = source_plan(sized, weights, share, cap).withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
    # the words of j draws: whole passes, and in the last pass a block each; the short block counts as one like the others
    want = F.least(F.round("target"), F.floor(F.col("source_size") * F.lit(float(cap)))).cast("long")
    s = s.withColumn("want", want).withColumn("turns", F.expr("if(source_size > 0, want div source_size, 0)"))
    s = s.withColumn("rest", F.expr("if(source_size > 0, want % source_size, 0)"))
    # where the pass's permutation puts the short block, which may lie among those drawn
    s = permuted_inverse(s.withColumn("short", F.greatest(F.col("blocks") - 1, F.lit(0))), "short", "blocks", ["sid", "turns"])
    s = s.withColumn("gap", F.col("blocks") * block - F.col("source_size"))
    s = s.withColumn("full", F.ceil(F.col("rest") / block).cast("long"))
    s = s.withColumn("more", F.when(F.col("short") < F.col("full"), F.ceil((F.col("rest") + F.col("gap")) / block)).otherwise(F.col("full")).cast("long"))
    held = F.col("more") * block - F.when(F.col("short") < F.col("more"), F.col("gap")).otherwise(0)
    s = s.withColumn("spare", F.when(F.col("rest") > 0, held - F.col("rest")).otherwise(0)).withColumn("draws", F.col("turns") * F.col("blocks") + F.col("more"))
    s = s.select("sid", "source", "source_size", "target", "blocks", "draws", "spare")
    s = C.written(s.withColumn("draws_before", _before("draws", Window.orderBy("sid")).cast("long")))
    total = int(s.agg(F.coalesce(F.sum("draws"), F.lit(0))).first()[0])

    # places in the source's stream: sums per bucket, then inside the bucket
    buckets = max(1, sized.count() // bucket_rows)
    keyed = sized.join(s.select("sid", F.col("source").alias("_s")), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    keyed = keyed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "h"), F.lit(buckets)).cast("int"))
    sums = keyed.groupBy("sid", "bucket").agg(F.sum("size").alias("n"))
    sums = sums.withColumn("base", _before("n", Window.partitionBy("sid").orderBy("bucket"))).select("sid", "bucket", "base")
    inner = _before("size", Window.partitionBy("sid", "bucket").orderBy("doc_id", "h"))
    rows = C.written(keyed.withColumn("inner", inner).join(sums, ["sid", "bucket"]).select("sid", "doc_id", "h", "size", (F.col("base") + F.col("inner")).cast("long").alias("start")))

    # every slot draws a source: its place in one permutation of all draws falls into a source's span
    slot = spark.range(total).select(F.col("id").alias("g"), F.col("id").alias("at"), F.lit(total).cast("long").alias("all"), F.lit(seed).alias("seed"))
    slot = permuted(slot, "at", "all", ["seed"]).select("g", "at", F.expr(f"at * {CELLS} div {max(1, total)}").alias("cell"))
    spans = s.where("draws > 0").select("sid", "blocks", "draws", "spare", "draws_before", F.explode(F.expr(f"sequence(draws_before * {CELLS} div {max(1, total)}, (draws_before + draws - 1) * {CELLS} div {max(1, total)})")).alias("cell"))
    drawn = slot.join(spans, "cell").where("at >= draws_before and at < draws_before + draws")
    drawn = drawn.withColumn("j", F.col("at") - F.col("draws_before")).withColumn("turn", F.expr("j div blocks")).withColumn("block_id", F.col("j") % F.col("blocks"))
    held = F.when(F.col("j") == F.col("draws") - 1, F.col("spare")).otherwise(0)
    drawn = permuted(drawn, "block_id", "blocks", ["sid", "turn"]).join(s.select("sid", "source_size"), "sid")
    in_block = F.least(F.lit(block).cast("long"), F.col("source_size") - F.col("block_id") * block)
    slots = drawn.select(F.expr(f"g div {shard_slots}").alias("shard"), (F.col("g") % shard_slots).alias("slot"), "sid", "block_id", (in_block - held).alias("words"))

    cut = rows.where("size > 0").withColumn("block_id", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")))
    first = F.greatest(F.col("start"), F.col("block_id") * block)
    last = F.least(F.col("start") + F.col("size"), (F.col("block_id") + 1) * block)
    fragments = cut.select("sid", "block_id", "doc_id", "h", "start", (first - F.col("start")).alias("first"), (first - F.col("block_id") * block).alias("at"), (last - first).alias("n"))
    return Mixture(s, rows, slots, fragments)


def taken_words(m: Mixture) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken), a row for each document."""
    used = m.taken().groupBy("sid", "start").agg(F.sum(F.col("n") * F.col("uses")).alias("taken"))
    full = m.rows.where("size > 0").join(used, ["sid", "start"], "left")
    rows = full.select("sid", "doc_id", "size", "taken").unionByName(m.rows.where("size = 0").select("sid", "doc_id", "size", F.lit(None).cast("long").alias("taken")))
    return rows.join(m.sources.select("sid", "source", "source_size", "target"), "sid").select("doc_id", "source", "size", F.col("source_size").cast("long").alias("source_size"), "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
