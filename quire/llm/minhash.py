"""Near duplicates by one-permutation MinHash.

1. Sketch: every text's distinct ``width``-word shingles are hashed once; the
   upper bits choose one of ``bins`` bins, each bin keeps its minimum, and empty
   bins borrow from a full one along a probe sequence that all texts share
   (optimal densification). ``bins / rows`` bands of ``rows`` bins are hashed.
2. Equal sets (128-bit sums over the hashed set) collapse into classes, one
   representative each, before any bucket is formed.
3. Buckets: members that meet inside a task are reported there, and one of them
   goes on for all; the rest meets by hash range. A hot bucket arrives
   pre-aggregated.
4. Stars: a bucket's members pair with its centre, the one whose buckets are
   largest in all, so m members make m - 1 pairs. Pairs are confirmed on the full
   shingle sets, in groups of at most ``group`` members of one centre, each group
   with one copy of the centre.
5. Members that don't link with their centre may still link with each other or
   with linked members. They are found exactly, by their differences from the
   centre (``through_centres``). No cap; no bucket is dropped.

With 512 bins in 64 bands of 8, two sets of similarity 0.85 share no bucket with
probability (1 - 0.85**8)**64 = 1.4e-9; at 0.8 it is 8e-6.

Edge cases: null or wordless texts have an empty set, link with nothing and are
their own component; texts with fewer words than ``width`` have one shingle, the
whole sequence; null ids count as one id before all others; rows that share an
id keep their rows; an empty table gives an empty table; clashing extra columns
don't matter, as the result holds only its own columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import common as C
from quire.llm.components import components

SKETCH = "doc long, n long, s1 long, s2 long, bands array<long>"
_EMPTY = np.uint64(2**64 - 1)
_U = np.uint64


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes text after text, and how many each text has."""
    w = C.Words(texts, lower=True)
    words = w.hashes()
    rolled = C.windows(words, width)
    n = np.where(w.counts >= width, w.counts - width + 1, 0)
    doc = np.repeat(np.arange(len(n)), n)
    h = rolled[np.repeat(w.first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] if n.sum() else np.zeros(0, _U)
    short = np.flatnonzero((w.counts > 0) & (w.counts < width))
    if len(short):  # the whole sequence; its length keeps it apart from full shingles
        whole = np.array([C.windows(words[w.first[i] : w.first[i] + w.counts[i]], int(w.counts[i]))[0] + _U(w.counts[i]) for i in short], _U)
        doc, h = np.append(doc, short), np.append(h, C.mix(whole))
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.bincount(doc[new], minlength=len(n))


_probes: dict[int, np.ndarray] = {}


def _probe_table(bins: int) -> np.ndarray:
    """probe[a, j]: the bin that empty bin j looks at in attempt a; every column is a permutation."""
    if bins not in _probes:
        a, j = np.meshgrid(np.arange(bins, dtype=_U), np.arange(bins, dtype=_U), indexing="ij")
        _probes[bins] = np.argsort(C.mix(C.mix(a + _U(1)) ^ (j * _U(0xC2B2AE3D27D4EB4F))), axis=0).astype(np.int32)
    return _probes[bins]


def signatures(h: np.ndarray, n: np.ndarray, bins: int) -> np.ndarray:
    """One row of densified minima per set; ``n`` is positive throughout."""
    bits = bins.bit_length() - 1
    doc = np.repeat(np.arange(len(n)), n)
    cell = doc * bins + (h >> _U(64 - bits)).astype(np.int64)
    at, _ = C.runs(cell)
    sig = np.full(len(n) * bins, _EMPTY, _U)
    sig[cell[at]] = h[at] << _U(bits)  # sets are sorted: the first of a bin is its minimum
    sig = sig.reshape(-1, bins)
    full = sig.copy()
    row, col = np.nonzero(sig == _EMPTY)
    probe = _probe_table(bins)
    for a in range(bins):
        if not len(row):
            break
        got = sig[row, probe[a, col]]
        ok = got != _EMPTY
        full[row[ok], col[ok]] = got[ok]
        row, col = row[~ok], col[~ok]
    return full


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    bands = sig.reshape(len(sig), -1, rows)
    out = np.zeros(bands.shape[:2], _U) + np.arange(1, bands.shape[1] + 1, dtype=_U)
    for k in range(rows):
        out = out * _U(0x9E3779B97F4A7C15) + C.mix(bands[:, :, k])
    return C.mix(out)


def _sketch(width: int, bins: int, rows: int):
    def run(batches):
        with np.errstate(over="ignore"):
            for whole in batches:
                for b in C.sliced(whole, "text"):
                    h, n = shingle_sets(b.column("text"), width)
                    ids = b.column("doc").to_numpy()
                    at = np.cumsum(n) - n
                    some = n > 0
                    sums = [np.zeros(len(n), _U) for _ in range(2)]
                    for k in range(2):
                        if len(h):
                            sums[k][some] = np.add.reduceat(C.mix(h + _U(k)), at[some])
                    keys = np.zeros((0, bins // rows), _U)
                    if some.any():
                        parts = np.array_split(np.flatnonzero(some), max(1, some.sum() // 1000))
                        keys = np.concatenate([band_keys(signatures(np.concatenate([h[at[i] : at[i] + n[i]] for i in p]), n[p], bins), rows) for p in parts if len(p)])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), C.ragged(keys.ravel().view(np.int64), np.where(some, bins // rows, 0), pa.int64())],
                        ["doc", "n", "s1", "s2", "bands"],
                    )

    return run


def _collect(buckets: int, flush: int = 1_500_000):
    """Rows (key, doc, n) of keys that meet inside a task, and packed firsts of all keys.

    Of a key with several members here only the first goes on, marked as already
    reported, so a bucket that a third of all texts share sends one entry per task.
    """
    names = ["bucket", "key", "doc", "n", "blob"]

    def run(batches):
        held, size = [], 0

        def out():
            key, doc, n = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((doc, key))
            key, doc, n = key[order], doc[order], n[order]
            at, count = C.runs(key)
            many = np.repeat(count > 1, count)
            if many.any():
                # these meet nothing any more, so they are dealt out by document, not by their hot key
                yield pa.RecordBatch.from_arrays([pa.array(C.id_bucket(doc[many], buckets), pa.int32()), pa.array(key[many].view(np.int64)), pa.array(doc[many]), pa.array(n[many]), pa.nulls(int(many.sum()), pa.binary())], names)
            key, doc, n, told = key[at], doc[at], n[at], (count > 1).astype(np.int64)
            to = C.bucket_of(key, buckets)
            order = np.lexsort((told, doc, to))
            to, key, doc, n, told = to[order], key[order], doc[order], n[order], told[order]
            at, count = C.runs(to)
            for lo in range(0, len(at), 256):
                part = list(range(lo, min(lo + 256, len(at))))
                blobs = [C.pack(key[s], doc[s], told[s], n[s]) for s in (slice(at[i], at[i] + count[i]) for i in part)]
                yield pa.RecordBatch.from_arrays([pa.array(to[at[part]], pa.int32()), *[pa.nulls(len(part), pa.int64())] * 3, pa.array(blobs, pa.binary())], names)

        for b in batches:
            bands = b.column("bands")
            key = bands.flatten().to_numpy().view(_U)
            if not len(key):
                continue
            per = np.diff(bands.offsets.to_numpy())
            held.append((key, np.repeat(b.column("doc").to_numpy(), per), np.repeat(b.column("n").to_numpy(), per)))
            size += len(key)
            if size >= flush:
                yield from out()
                held, size = [], 0
        if held:
            yield from out()

    return run


def _meet(batches):
    """Per hash range: members of keys that several tasks sent, beside what tasks reported."""
    held = []
    names = ["key", "doc", "n"]
    for b in batches:
        blob = b.column("blob")
        held += [C.unpack(x) for x in blob.drop_null().to_pylist()]
        done = b.filter(blob.is_null())
        if len(done):
            # keys are cut to the bits that blobs keep, so that both kinds name a bucket alike
            key = pa.array(done.column("key").to_numpy().view(_U) & _U(2**56 - 1)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([key, done.column("doc"), done.column("n")], names)
    if held:
        key, doc, told, n = (np.concatenate(x) for x in zip(*held, strict=True))
        del held
        order = np.argsort(key)
        _, size = C.runs(key[order])
        keep = order[np.repeat(size > 1, size)]
        keep = keep[told[keep] == 0]
        for lo in range(0, len(keep), 100_000):
            k = keep[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(key[k].view(np.int64)), pa.array(doc[k]), pa.array(n[k].astype(np.int64))], names)


def stars(members: DataFrame) -> DataFrame:
    """Distinct pairs (a, c) of bucket members with their bucket's centre, the member whose buckets are largest in all."""
    size = members.groupBy("key").agg(F.count("*").alias("m"))
    weight = members.join(size, "key").groupBy("doc").agg(F.sum("m").alias("w"))
    centre = members.join(weight, "doc").groupBy("key").agg(F.max(F.struct("w", F.bitwise_not("doc").alias("d")))["d"].alias("d"))
    return members.join(centre.select("key", F.bitwise_not("d").alias("c")), "key").where("doc <> c").select(F.col("doc").alias("a"), "c").distinct()


TESTED = "a long, c long, na long, nc long, linked boolean, delta array<long>"


def _confirm(width: int, num: int, den: int):
    """Rows sorted by (centre, part, member flag): the centre's text comes first, its members follow."""

    def run(batches):
        at, ours = None, None
        names = ["a", "c", "na", "nc", "linked", "delta"]
        with np.errstate(over="ignore"):
            for whole in batches:
                for b in C.sliced(whole, "text"):
                    h, n = shingle_sets(b.column("text"), width)
                    end = np.cumsum(n)
                    out, delta = [], []
                    for i, (centre, doc, part, alone) in enumerate(zip(*(b.column(x).to_pylist() for x in ("c", "doc", "part", "alone")), strict=True)):
                        mine = h[end[i] - n[i] : end[i]]
                        if doc == centre:
                            at, ours = (centre, part), mine
                            continue
                        if at != (centre, part):
                            raise RuntimeError("a group came without its centre")
                        other = np.setxor1d(ours, mine, assume_unique=True)
                        both = (len(ours) + len(mine) - len(other)) // 2
                        out.append((doc, centre, len(mine), len(ours), den * both >= num * (both + len(other))))
                        delta.append(other.view(np.int64) if not alone else other[:0].view(np.int64))
                    if out:
                        cols = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), [pa.int64()] * 4 + [pa.bool_()], strict=True)]
                        yield pa.RecordBatch.from_arrays([*cols, C.ragged(np.concatenate(delta), np.array([len(x) for x in delta]), pa.int64())], names)

    return run


def _by_centre(rows: DataFrame, centres: DataFrame, salts: int = 32) -> DataFrame:
    """Join of ``rows`` (a, c, ...) with the row of their centre, if it has one, dealt by (c, salt).

    A centre that a large share of all rows has is met in ``salts`` places; its row goes only where it is wanted.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("a"), F.lit(salts)).cast("int"))
    spread = salted.select("c", "_salt").distinct().join(centres, "c")
    return salted.join(spread, ["c", "_salt"]).drop("_salt")


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, num: int, den: int, group: int = 1000) -> DataFrame:
    """Every pair (a, c) with its set sizes, whether it links (den * intersection >= num * union), and the
    hashes in just one of both sets; ``texts`` is (doc, text), one row a doc. A centre with a single member
    needs no differences and gets none."""
    parts = pairs.groupBy("c").agg(F.ceil(F.count("*") / group).cast("int").alias("parts"), (F.count("*") == 1).alias("alone"))
    members = _by_centre(pairs, parts).select(F.col("a").alias("doc"), "c", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"), "alone")
    centres = parts.select(F.col("c").alias("doc"), "c", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), "alone")
    n = C.partitions(texts, 16)
    rows = members.unionByName(centres).join(texts.hint("merge"), "doc").select("c", "part", "alone", (F.col("doc") != F.col("c")).alias("member"), "doc", "text")
    rows = rows.repartition(n, "c", "part").sortWithinPartitions("c", "part", "member", "doc")
    return rows.mapInArrow(C.tidy(_confirm(width, num, den)), TESTED)


def through_centres(tested: DataFrame, labels: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) between members of one centre of which at least one isn't linked with it.

    Let D(x) be the hashes in just one of x and its centre c, and q = (den - num) / (den + num):
    x and y link if and only if |D(x) ^ D(y)| <= q (|x| + |y|). For x not linked with c,
    |D(x)| > q (|x| + |c|), from which follows |D(x) & D(y)| > (|D(y)| + q (|c| - |y|)) / 2
    for any y that links with x, and likewise for x if y isn't linked with c either. So by the
    prefix principle, with the hashes of every D in one order, rarest first, x and y share a hash
    among the first |D| - t + 1 of D(y), t being the least such overlap; if both are unlinked,
    among the first of both; and no more of them than follow the first one in both. Edits that no other text has come first and meet nothing, so the
    join stays near linear even where thousands of texts lie just below the bound.
    """
    from pyspark.sql import Window

    lab = labels.select(F.col("node").alias("a"), "label")
    lc = labels.select(F.col("node").alias("c"), F.col("label").alias("lc"))
    some = tested.where("size(delta) > 0")
    open_ = some.where("not linked").select("c").distinct().join(lc, "c", "left").select("c", F.coalesce("lc", "c").alias("lc"))
    t = C.written(_by_centre(some.join(lab, "a", "left").withColumn("label", F.coalesce("label", "a")), open_))
    least = f"floor((size(delta) + {den - num}D / {den + num} * (nc - na)) / 2 + 1 - 1e-9)"
    cut = t.select("c", "a", "label", "linked", "na", F.size("delta").alias("d"), F.expr(f"size(delta) - greatest(1, {least}) + 1").alias("prefix"), F.explode("delta").alias("e"))
    seen = cut.groupBy("c", "e").agg(F.count("*").alias("df"))
    rows = cut.join(seen, ["c", "e"]).withColumn("rank", F.row_number().over(Window.partitionBy("c", "a").orderBy("df", "e")))
    rows = C.written(rows.where("df > 1").select("c", "e", "a", "label", "linked", "na", "d", (F.col("d") - F.col("rank")).alias("after"), (F.col("rank") <= F.col("prefix")).alias("early")))
    x = rows.where("not linked").selectExpr("c", "e", "a as x", "label as lx", "early as ex", "na as nx", "d as dx", "after as ax")
    y = rows.where("early").selectExpr("c", "e", "a as y", "label as ly", "linked as yl", "na as ny", "d as dy", "after as ay")
    # at their first common hash x and y can share no more than what follows it in both
    enough = f"2 * (1 + least(ax, ay)) >= dx + dy - {den - num}D / {den + num} * (nx + ny) - 1e-6"
    pairs = x.join(y, ["c", "e"]).where(f"lx <> ly and (yl or (ex and x < y)) and {enough}").select("c", "x", "y").distinct()
    dx = t.select("c", F.col("a").alias("x"), F.col("na").alias("nx"), F.col("delta").alias("dx"))
    dy = t.select("c", F.col("a").alias("y"), F.col("na").alias("ny"), F.col("delta").alias("dy"))
    full = pairs.join(dx, ["c", "x"]).join(dy, ["c", "y"]).withColumn("far", F.expr("size(dx) + size(dy) - 2 * size(array_intersect(dx, dy))"))
    return full.where(f"{den} * (nx + ny - far) >= {num} * (nx + ny + far)").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 85, den: int = 100, bins: int = 512, rows: int = 8, text: str = "text", doc_id: str = "doc_id", ranges: int | None = None) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id, kept), a row for each row of ``docs``.

    class_id is the smallest id with the same shingle set, component_id the
    smallest id reachable over links of similarity >= num / den; kept marks the
    one document of a component that stays. ``ranges`` is the number of ranges that
    band keys are dealt into, by default one for each 8 MB of sketches.
    """
    source = docs.select(C.key_of(doc_id).alias("doc"), F.col(text).cast("string").alias("text"))
    sketches = C.written(source.mapInArrow(C.tidy(_sketch(width, bins, rows)), SKETCH))
    # a table of its own: a join beside the aggregation's own exchange couldn't be split where one class is hot
    classes = C.written(sketches.where("n > 0").groupBy("s1", "s2").agg(F.min("doc").alias("rep")))
    named = C.written(sketches.select("doc", "n", "s1", "s2").join(classes, ["s1", "s2"], "left").select("doc", "n", F.coalesce("rep", "doc").alias("rep")))
    reps = sketches.where("n > 0").join(classes.select(F.col("rep").alias("doc"), "s1", "s2"), ["s1", "s2", "doc"], "left_semi").select("doc", "n", "bands")
    n = ranges or C.partitions(sketches.select("bands"), 8)
    sent = reps.mapInArrow(C.tidy(_collect(n)), "bucket int, key long, doc long, n long, blob binary")
    members = C.written(sent.repartitionById(n, F.col("bucket")).mapInArrow(C.tidy(_meet), "key long, doc long, n long"))
    pairs = C.written(stars(members))
    texts = source.where("text is not null")
    if _repeated(sketches):  # of rows that share an id the first text in code-point order stands for it
        ids = pairs.selectExpr("a as doc").union(pairs.selectExpr("c")).distinct()
        texts = texts.join(ids, "doc", "left_semi").groupBy("doc").agg(F.min("text").alias("text"))
    tested = C.written(confirmed(pairs, texts, width, num, den))
    links = tested.where("linked").selectExpr("a", "c as b")
    labels = components(links)
    more = C.written(through_centres(tested, labels, num, den))
    if more.limit(1).count():
        labels = components(links.union(more))
    out = named.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").withColumn("component", F.coalesce("label", "rep"))
    return out.select(C.unkey("doc").cast(docs.schema[doc_id].dataType).alias("doc_id"), F.col("n").alias("n_shingles"), C.unkey("rep").alias("class_id"), C.unkey("component").alias("component_id"), (F.col("doc") == F.col("component")).alias("kept"))


def _repeated(sketches: DataFrame) -> bool:
    """Whether two rows share an id."""
    return bool(sketches.groupBy("doc").count().where("count > 1").limit(1).count())
