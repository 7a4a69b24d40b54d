"""Shared pieces: intermediate tables, vectorised words and hashes, packed blobs.

A *word* is a maximal run of bytes other than 0x20 and 0x09-0x0D everywhere in
this subpackage; ``bytes.split()`` splits on exactly these six bytes.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = "[^\\x20\\x09-\\x0D]+"
NULL_ID = -(2**63)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_M = np.uint64
_BASE = _M(0x9E3779B97F4A7C15 | 1)
_LETTER_BASE = _M(0xD6E8FEB86659FD93)


# ---------------------------------------------------------------- tables
_own: dict[str, str] = {}


def _base(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the folder the session's context has for checkpoints; on a local master
    alone (tests) a temporary one, which executors of a cluster wouldn't share."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own.get(sc.applicationId) or _own.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="quire-"))
    return base.rstrip("/")


def shared_dir(spark: SparkSession) -> str:
    """A new folder for one table, shared by the driver and all executors."""
    return f"{_base(spark)}/quire-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def written(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write a Parquet table in the shared folder and reread it: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cleanup(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; results that haven't been read out yet go with them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{_base(spark)}/quire-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(df: DataFrame, mb: float) -> int:
    """Partitions of about ``mb`` MB of ``df``'s estimated size, never fewer than spark.sql.shuffle.partitions.

    Estimates of joins multiply those of their sides, so the size counts as that of all tables read at most; a
    table of unknown size (rows from the driver or an RDD) counts by its partitions, of ``mb`` each.
    """
    plan, unknown = df._jdf.queryExecution().optimizedPlan(), 2**53
    sizes = [int(str(plan.stats().sizeInBytes()))]
    leaves = plan.collectLeaves()
    read = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    if any(x > unknown for x in read):
        sizes = [math.ceil(df.rdd.getNumPartitions() * mb * 2**20)]
    else:
        sizes.append(sum(read))
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(min(sizes) / (mb * 2**20)))


def key_of(c: str | Column) -> Column:
    """An id as long in which null has a place of its own, before all others."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(NULL_ID)).cast("long")


def unkey(c: str) -> Column:
    return F.when(F.col(c) != NULL_ID, F.col(c))


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null; no regular expression in the hot path."""
    plain = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    return F.coalesce(F.size(F.array_remove(F.split(plain, " "), "")), F.lit(0)).cast("long")


# ---------------------------------------------------------------- hashes
def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    x = x ^ (x >> _M(30))
    x *= _M(0xBF58476D1CE4E5B9)
    x ^= x >> _M(27)
    x *= _M(0x94D049BB133111EB)
    x ^= x >> _M(31)
    return x


with np.errstate(over="ignore"):
    _TABLE = mix(np.arange(1, 257, dtype=_M) * _BASE) | _M(1)
_TABLE[_SPACE] = 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = {}


def _powers_of(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        out = np.full(max(1024, 2 * n), base, _M)
        out[0] = 1
        have = _powers[int(base)] = np.multiply.accumulate(out)
    return have


class Words:
    """The words of a run of texts: byte spans, and which belong to which text."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = pc.fill_null(texts, "")
        kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        n = len(texts)
        offs = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offs[0] : offs[-1]] if raw is not None else np.zeros(0, np.uint8)
        offs = offs - offs[0]
        self.data = _LOWER[data] if lower else data
        inside = ~_SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offs] = True
        before = np.ones(len(data), bool)
        before[1:] = ~inside[:-1]
        after = np.ones(len(data), bool)
        after[:-1] = ~inside[1:]
        self.starts = np.flatnonzero(inside & (before | edge[:-1]))
        self.ends = np.flatnonzero(inside & (after | edge[1:])) + 1
        first = np.searchsorted(self.starts, offs)
        self.first, self.counts = first[:-1], np.diff(first)

    def hashes(self, block: int = 2**21) -> np.ndarray:
        """One 64-bit polynomial hash per word, in blocks of about ``block`` bytes."""
        out = np.zeros(len(self.starts), _M)
        at = 0
        while at < len(out):
            to = max(at + 1, int(np.searchsorted(self.starts, self.starts[at] + block)))
            lo, hi = self.starts[at], self.ends[to - 1]
            starts = self.starts[at:to] - lo
            gaps = np.diff(np.append(starts, hi - lo))
            longest = int((self.ends[at:to] - self.starts[at:to]).max())
            place = np.arange(hi - lo) - np.repeat(starts, gaps)
            np.minimum(place, longest - 1, out=place)
            value = _TABLE[self.data[lo:hi]]
            value *= _powers_of(_LETTER_BASE, longest)[place]
            out[at:to] = np.add.reduceat(value, starts)
            at = to
        return mix(out)


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hashes of all runs of ``width`` words, by doubling: log2(width) passes."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, _M)
    out, taken, part, span = np.zeros(n, _M), 0, h, 1
    power = [_M(1)]
    for _ in range(width):
        power.append(power[-1] * _BASE if power[-1] else power[-1])
    while span <= width:
        if width & span:
            out += power[taken] * part[taken : taken + n]
            taken += span
        if 2 * span <= width:
            part = part[: len(part) - span] + power[span] * part[span:]
        span *= 2
    return mix(out)


def sliced(batch: pa.RecordBatch, column: str, limit: int = 2**22) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``limit`` bytes of text each; one longer text is a part of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(sizes)
    at, base = 0, 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(total, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at, base = to, total[to - 1]


def tidy(run):
    """A mapInArrow function that gives freed memory back to the system at the end of each task.

    Python workers are reused; what a task leaves in their heaps would stay beside the next stage's.
    """

    def tidied(batches):
        import ctypes

        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
            if trim:
                trim(0)

    return tidied


# ---------------------------------------------------------------- blobs
def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    """0 <= bucket < n from the upper bits; what blobs keep are the lower 56 bits."""
    return ((h >> _M(40)) * _M(n) >> _M(24)).astype(np.int64)


def _planes(x: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers byte plane by byte plane, so that compression finds the zeros."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplanes(buf: memoryview, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(buf, np.uint8, 4 * n).reshape(4, n).T).view("<u4").ravel()


def pack(h: np.ndarray, doc: np.ndarray, place: np.ndarray, extra: np.ndarray) -> bytes:
    """Pack rows (hash, doc, place) sorted by (doc, place); ``extra`` is a number of the doc."""
    new = np.ones(len(doc), bool)
    new[1:] = doc[1:] != doc[:-1]
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(doc)))
    step = place.copy()
    step[1:] -= place[:-1]
    step[at] = place[at]
    low = np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7])
    return b"".join((np.array([len(at), len(h)], "<u8").tobytes(), doc[at].astype("<i8").tobytes(), _planes(count), _planes(extra[at]), _planes(step), low.tobytes()))


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n_docs, n = (int(x) for x in np.frombuffer(blob, "<u8", 2))
    view, at = memoryview(blob), 16
    docs = np.frombuffer(view, "<i8", n_docs, at)
    at += 8 * n_docs
    count = _unplanes(view[at:], n_docs)
    extra = _unplanes(view[at + 4 * n_docs :], n_docs)
    at += 8 * n_docs
    step = _unplanes(view[at:], n).astype(np.int64)
    at += 4 * n
    h = np.zeros((n, 8), np.uint8)
    h[:, :7] = np.frombuffer(view, np.uint8, 7 * n, at).reshape(n, 7)
    total = np.cumsum(step)
    head = np.cumsum(count) - count
    base = np.repeat(total[head] - step[head], count) if n else total
    return h.view("<u8").ravel(), np.repeat(docs, count), (total - base).astype(np.int64), np.repeat(extra, count)


_P, _A = 2**31 - 1, 48271


def id_bucket(doc: np.ndarray, n: int) -> np.ndarray:
    """0 <= bucket < n of ids, spread evenly for any step between them; id_bucket_col is its twin in SQL."""
    return doc % _P * _A % _P * n // _P


def id_bucket_col(doc: str, n: int) -> Column:
    return F.expr(f"cast((pmod({doc}, {_P}L) * {_A}L) % {_P}L * {n}L div {_P}L as int)")


def runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal neighbours."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1]))
    return at, np.diff(np.append(at, len(sorted_keys)))


def ragged(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offs = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(values, kind))
