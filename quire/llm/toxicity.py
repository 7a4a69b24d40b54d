"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Terms are the stems of all words of a text: lower-cased runs of letters cut to
their first ``STEM`` letters. A stem's place in the vector is its CRC-32 modulo
``DIMS`` (the hashing trick), so that the table of document frequencies, which is
counted over all documents, has a fixed size whatever the corpus holds; no stem
is left out, and labels have no part in the choice of terms. Weights are
tf * ln((1 + documents) / (1 + df)), vectors have length one over the whole text.

Labelled examples form an inverted index. Examples lie in blocks of ``block``;
each term's postings are grouped by block, with the largest weight of each group.
A query adds the group maxima of its terms to an upper bound per block, reads the
blocks of the highest bounds first and then those whose bound still beats its
k-th best cosine, so that the k nearest are exact. Examples whose text equals the
query's (64-bit hash) have no vote, whatever their id, so a labelled text isn't
its own neighbour. Votes weigh by similarity and by how thinly the example's class was
sampled, beside one vote of the base rate at the mean weight. A logistic curve fitted to the
examples' own votes turns votes into scores.

Bounds (documented parameters): at most ``per_class`` labelled examples of each
class, chosen by a hash of their id, and of these the first whose stems add up to
half of ``most_postings``. The index (at most 48 bytes a posting, and where it is used 8
for each example and full column) and the 2**20 document frequencies are all that is
sent to executors. Everything
else reads all documents.

Edge cases: null texts, and texts without letters or without a neighbour, get the
base rate; null labels are ignored, labels without a document
count in the base rate alone; documents without a label are scored like
others; with no labelled example of either class every score is the base rate of
what there is (0.001 if nothing); null ids are never examples; repeated rows are
scored each, and count each in the frequencies; of several labels for one id the
largest counts, of several texts the one with the smallest hash; an empty table
gives an empty table; extra columns don't matter.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import common as C

STEM, DIMS = 4, 2**20
_STEMS = re.compile(rf"([^\W\d_]{{1,{STEM}}})[^\W\d_]*")


def place_of(stem: str) -> int:
    return zlib.crc32(stem.encode()) % DIMS


def terms_of(text: str | None) -> Counter:
    """Places of a text's stems, with counts."""
    out: Counter = Counter()
    for stem, n in Counter(_STEMS.findall((text or "").lower())).items():
        out[place_of(stem)] += n
    return out


def _counts(batches):
    places: dict[str, int] = {}
    for whole in batches:
        for b in C.sliced(whole, "text"):
            terms, freq, size = [], [], []
            for text in b.column("text").to_pylist():
                mine: dict[int, int] = {}
                for stem, n in Counter(_STEMS.findall((text or "").lower())).items():
                    at = places.get(stem)
                    if at is None:
                        if len(places) >= DIMS:
                            places.clear()
                        at = places[stem] = place_of(stem)
                    mine[at] = mine.get(at, 0) + n
                ordered = sorted(mine)
                terms += ordered
                freq += [mine[t] for t in ordered]
                size.append(len(ordered))
            size = np.array(size, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("same"), C.ragged(np.array(terms, np.int64), size, pa.int32()), C.ragged(np.array(freq, np.int64), size, pa.int32())], ["doc", "same", "terms", "freq"])


def _spans(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers start[i] ... start[i] + n[i] - 1 of all i, one after another."""
    total = np.cumsum(n)
    return np.repeat(start - (total - n), n) + np.arange(total[-1] if len(n) else 0)


class BlockMaxIndex:
    """Examples in blocks: per term its groups (one a block: largest weight, postings), per group its postings.

    The postings of terms that more than one example in sixteen has, at most ``columns`` terms, are laid out as
    full columns, so that a block's cosines over them are one matrix product for many queries.
    """

    def __init__(self, vectors, y: np.ndarray, weight: np.ndarray, names: np.ndarray, block: int = 64, same: np.ndarray | None = None, columns: int = 512):
        """``vectors``: (terms, weights) of each example, or a matrix with a row for each; ``same``: hashes of their texts."""
        if isinstance(vectors, np.ndarray):
            vectors = [(np.flatnonzero(v), v[np.flatnonzero(v)]) for v in vectors]
        terms, weights = (np.concatenate([np.zeros(0, kind), *(v[j] for v in vectors)]) for j, kind in ((0, np.int64), (1, np.float64)))
        size = np.array([len(v[0]) for v in vectors], np.int64)
        self.n, self.block, self.blocks = len(size), block, -(-len(size) // block)
        start = np.cumsum(size) - size
        heavy = np.array([terms[s + int(np.argmax(weights[s : s + k]))] if k else -1 for s, k in zip(start.tolist(), size.tolist(), strict=True)], np.int64)
        # neighbours in a block share their heaviest term or are alike in length, which keeps the maxima tight
        order = np.lexsort((names, size, heavy))
        self.y, self.weight, self.names = y[order], weight[order], names[order]
        same = (names if same is None else same)[order]
        self.by_same = np.argsort(same, kind="stable")
        self.same = same[self.by_same]
        row = np.repeat(np.arange(self.n), size[order])
        at = _spans(start[order], size[order])
        self.terms, term, count = np.unique(terms[at], return_inverse=True, return_counts=True)
        x = weights[at]
        often = np.argsort(-count, kind="stable")[:columns]
        often = often[count[often] * 16 > self.n]
        self.column = np.full(len(self.terms), -1)
        self.column[often] = np.arange(len(often))
        wide = self.column[term] >= 0
        self.wide = row[wide].astype(np.int32), self.column[term[wide]].astype(np.int32), x[wide], len(often)
        self.full = None
        row, term, x = row[~wide], term[~wide], x[~wide]
        by = np.lexsort((row, term))
        self.row, term, self.x = row[by], term[by], x[by]
        new = np.ones(len(term), bool)
        new[1:] = (term[1:] != term[:-1]) | (self.row[1:] // block != self.row[:-1] // block)
        self.group_at = np.flatnonzero(new)
        self.group_size = np.diff(np.append(self.group_at, len(term)))
        self.group_max = np.maximum.reduceat(self.x, self.group_at) if len(term) else self.x
        self.group_block = self.row[self.group_at] // block
        self.term_at, end = (np.searchsorted(term[self.group_at], np.arange(len(self.terms)), side) for side in ("left", "right"))
        self.term_size = end - self.term_at

    def _columns(self) -> tuple[np.ndarray, np.ndarray]:
        """The full columns and their maxima in each block; made where they are used, not sent."""
        if self.full is None:
            row, column, x, n = self.wide
            full = np.zeros((self.n, n))
            full[row, column] = x
            self.full = full, np.maximum.reduceat(full, np.arange(0, self.n, self.block), axis=0)
        return self.full

    def nearest_all(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int, sames: list[int | None], first: int = 4) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (terms, weights) the rows of its k nearest with a positive cosine, and the cosines; ties go
        to the smaller id. Examples whose text hash is the query's of ``sames`` don't count."""
        if not len(self.terms):
            return [(np.zeros(0, np.int64), np.zeros(0))] * len(vectors)
        full, top = self._columns()
        q, bound, parts, equal = np.zeros((len(vectors), full.shape[1])), np.zeros((len(vectors), self.blocks)), [], []
        for i, (terms, weights) in enumerate(vectors):
            at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
            known = self.terms[at] == terms
            at, weights = at[known], weights[known]
            column = self.column[at]
            q[i, column[column >= 0]] = weights[column >= 0]
            at, weights = at[column < 0], weights[column < 0]
            n = self.term_size[at]
            group, weight = _spans(self.term_at[at], n), np.repeat(weights, n)
            where = self.group_block[group]
            bound[i] = np.bincount(where, self.group_max[group] * weight, self.blocks)
            parts.append((group, weight, where))
            lo, hi = (0, 0) if sames[i] is None else np.searchsorted(self.same, [sames[i], sames[i] + 1])
            equal.append(self.by_same[lo:hi])
        bound += q @ top.T
        score = np.zeros((len(vectors), self.n))

        def read(wanted: np.ndarray) -> np.ndarray:
            """Add what the wanted blocks hold for each query; returns the k-th best cosines so far."""
            for b in np.flatnonzero(wanted.any(axis=0)).tolist():
                who, span = np.flatnonzero(wanted[:, b]), slice(b * self.block, (b + 1) * self.block)
                score[who, span] = q[who] @ full[span].T
            for i, (group, weight, where) in enumerate(parts):
                mine = wanted[i][where]
                g = group[mine]
                many = self.group_size[g]
                p = _spans(self.group_at[g], many)
                score[i] += np.bincount(self.row[p], self.x[p] * np.repeat(weight[mine], many), self.n)
                score[i, equal[i]] = 0.0
            return np.partition(score, -k, axis=1)[:, -k] if self.n >= k else np.zeros(len(vectors))

        head = np.zeros(bound.shape, bool)
        np.put_along_axis(head, np.argsort(-bound, axis=1, kind="stable")[:, :first], True, axis=1)
        least = read(head)
        least = read(~head & (bound >= least[:, None] - 1e-9) & (bound > 0))
        out = []
        for mine, low in zip(score, least, strict=True):
            rows = np.flatnonzero(mine >= max(low - 1e-12, 1e-300))
            rows = rows[np.lexsort((self.names[rows], -np.round(mine[rows], 12)))][:k]
            out.append((rows, mine[rows]))
        return out

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, same: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        return self.nearest_all([(terms, weights)], k, [same])[0]

    def vote(self, rows: np.ndarray, cosines: np.ndarray, base: float) -> float:
        w = cosines * self.weight[rows]
        return float((w @ self.y[rows] + w.mean() * base) / (w.sum() + w.mean()))


def weigh(terms: np.ndarray, freq: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vector of tf * idf: places and weights; terms of every document have no weight and fall out."""
    w = freq * idf[terms]
    terms, w = terms[w > 0], w[w > 0]
    return terms, w / math.sqrt(float(w @ w)) if len(w) else w


def platt(votes: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset of the logistic curve that turns the logit of a vote into a probability.

    A ridge of 1 towards the identity keeps few or separable examples from running away.
    """
    x = np.log(votes / (1 - votes))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g, h = weight * (p - y), weight * p * (1 - p)
        grad = np.array([g @ x + (a - 1), g.sum() + b])
        hess = np.array([[h @ (x * x) + 1, h @ x], [h @ x, h.sum() + 1]])
        da, db = np.linalg.solve(hess, grad)
        a, b = a - float(np.clip(da, -1, 1)), b - float(np.clip(db, -1, 1))
    return max(a, 0.1), b


def _vote(index: BlockMaxIndex, idf: np.ndarray, base: float, k: int, evidence: int, together: int = 128):
    """Vote (null without a neighbour), ids and cosines of the nearest; ``doc`` passes through."""

    def run(batches):
        known: dict[int, tuple] = {}
        for b in batches:
            if len(known) >= 50_000:
                known.clear()
            terms, freq, sames = b.column("terms"), b.column("freq"), b.column("same").to_pylist()
            (offs, flat), (other, many) = ((np.asarray(c.offsets).tolist(), np.asarray(c.values)) for c in (terms, freq))
            todo = list({s: i for i, s in enumerate(sames) if s not in known}.values())
            for at in range(0, len(todo), together):
                some = todo[at : at + together]
                vectors = [weigh(flat[offs[i] : offs[i + 1]], many[other[i] : other[i + 1]].astype(np.float64), idf) for i in some]
                for i, (rows, s) in zip(some, index.nearest_all(vectors, k, [sames[i] for i in some]), strict=True):
                    known[sames[i]] = (index.vote(rows, s, base), index.names[rows[:evidence]].tolist(), np.minimum(s[:evidence], 1.0).tolist()) if len(rows) else (None, [], [])
            votes, names, cosines = zip(*(known[s] for s in sames), strict=True) if sames else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(votes, pa.float64()), pa.array(names, pa.list_(pa.int64())), pa.array(cosines, pa.list_(pa.float64()))], ["doc", "vote", "evidence", "cosines"])

    return run


def crc_mod(doc_id: str, folds: int) -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(folds))


def score(docs: DataFrame, labels: DataFrame, folds: int = 5, held_fold: int = 0, per_class: int = 2500, most_postings: int = 2**22, k: int = 15, evidence: int = 5, text: str = "text", doc_id: str = "doc_id", label: str = "toxic") -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence, cosines), a row for each row of ``docs``.

    Labels of rows whose crc32(id as text) mod ``folds`` is ``held_fold`` are never
    read; evidence holds the ids of the nearest examples, cosines their similarities.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc"), F.col(text).cast("string").alias("text"))
    rows = rows.select("doc", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("same"))
    counted = C.written(rows.mapInArrow(C.tidy(_counts), f"doc {kind}, same long, terms array<int>, freq array<int>"))
    n_docs = counted.count()
    df = np.zeros(DIMS, np.int64)
    seen = counted.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).toArrow()
    df[np.asarray(seen["t"])] = np.asarray(seen["n"])
    idf = np.log((1 + n_docs) / (1 + df))

    known = labels.select(F.col(doc_id).alias("doc"), F.col(label).cast("int").alias("y")).where("doc is not null and y in (0, 1)").where(crc_mod("doc", folds) != held_fold).groupBy("doc").agg(F.max("y").alias("y"))
    totals = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("doc"), "doc").limit(per_class)
        chosen = part if chosen is None else chosen.union(part)
    chosen = C.written(chosen)  # at most 2 * per_class rows
    texts = counted.join(F.broadcast(chosen), "doc").groupBy("doc", "y").agg(F.min(F.struct("same", "terms", "freq")).alias("t")).select("doc", "y", "t.*")
    upto = F.sum(F.size("terms")).over(Window.partitionBy("y").orderBy(F.xxhash64("doc"), "doc"))
    found = C.written(texts.withColumn("upto", upto))
    examples = found.where(F.col("upto") <= most_postings // 2).drop("upto")
    got = examples.orderBy("doc").toArrow()
    size = {y: int((np.asarray(got["y"]) == y).sum()) for y in (0, 1)}
    base = min(max(totals.get(1, 0) / max(1, sum(totals.values())), 1e-3), 1 - 1e-3)
    with_text = {r["y"]: r["n"] for r in found.groupBy("y").agg(F.count("*").alias("n")).collect()}
    scale = {y: totals.get(y, 0) / max(1, min(per_class, totals.get(y, 0))) * with_text.get(y, 0) / max(1, size[y]) for y in (0, 1)}
    y = np.asarray(got["y"]).astype(np.float64)
    thin = np.where(y == 1, scale[1], scale[0]) / max(1e-9, *scale.values())
    vectors = [weigh(np.array(t, np.int64), np.array(f, np.float64), idf) for t, f in zip(got["terms"].to_pylist(), got["freq"].to_pylist(), strict=True)]
    index = BlockMaxIndex(vectors, y, thin, np.asarray(got["doc"]).astype(np.int64), same=np.asarray(got["same"]))

    voter, out = C.tidy(_vote(index, idf, base, k, evidence)), f"doc {kind}, vote double, evidence array<long>, cosines array<double>"
    curve = (1.0, 0.0)
    if size[0] and size[1]:  # the examples' own votes: each goes without its own text
        spread = examples.repartition(C.partitions(examples, 1))
        own = spread.mapInArrow(voter, out).where("vote is not null").orderBy("doc").select("doc", "vote").toArrow()
        place = np.searchsorted(np.asarray(got["doc"]), np.asarray(own["doc"]))
        if len(place):
            curve = platt(np.asarray(own["vote"]), y[place], thin[place])
    odds = F.log(F.col("vote") / (1 - F.col("vote"))) * F.lit(curve[0]) + F.lit(curve[1])
    scored = counted.repartition(C.partitions(counted, 4)).mapInArrow(voter, out)
    held = F.coalesce(crc_mod("doc", folds) == held_fold, F.lit(False))
    result = scored.select(F.col("doc").alias("doc_id"), held.alias("held_out"), F.coalesce(1 / (1 + F.exp(-odds)), F.lit(base)).alias("score"), "evidence", "cosines")
    return result.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence", "cosines")
