"""Substring dedup: Rabin-Karp hashes of every window of ``width`` words, counted across all texts.

``remove_repeats`` removes each word covered by a window whose word sequence
also starts earlier (smaller id, or same id and earlier start). Windows are
judged on the input. The method:

1. One pass hashes every window. Each task keeps, per hash, the first place it
   has seen and marks the others at once, so a passage that a third of all
   documents share crosses the network once per task, not once per document.
2. First places are exchanged by hash range as packed blobs (about 9 bytes a
   window); per hash all places but the smallest are repeats.
3. Repeats go back by document id, where touching windows merge into maximal
   removal intervals that are cut from the text.

Windows are compared by 64-bit hashes (56 bits in the blob and the bucket's own
bits); for n windows a window is taken for a repeat by mistake with probability
about n / 2**62 at 64 buckets.

Edge cases: null text has no words (kept text: empty); texts under ``width``
words lose nothing; null ids count as one id before all others; rows that share
an id count as the same document, so equal rows don't remove each other and a
place repeated in one of them is removed in all; an empty table gives an empty
table; extra columns pass through.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import common as C

FLUSH = 1_500_000


def _local(h, doc, place):
    """Rows sorted by (doc, place): which are the first of their hash here, and which come after it."""
    order = np.argsort(h, kind="stable")
    at, n = C.runs(h[order])
    lead = np.repeat(order[at], n)
    late = (doc[order] != doc[lead]) | (place[order] != place[lead])
    first = np.zeros(len(h), bool)
    first[order[at]] = True
    again = np.zeros(len(h), bool)
    again[order[late]] = True
    return first, again


def _blobs(to, h, doc, place):
    """(bucket, blob) for each bucket in ``to``; rows of a bucket stay in their order."""
    order = np.argsort(to.astype(np.uint16) if to.max(initial=0) < 65536 else to, kind="stable")
    to, h, doc, place = to[order], h[order], doc[order], place[order]
    at, n = C.runs(to)
    none = np.zeros(len(h), np.int64)
    for i, k in zip(at.tolist(), n.tolist(), strict=True):
        yield int(to[i]), C.pack(h[i : i + k], doc[i : i + k], place[i : i + k], none[:k])


def _rows(pairs, kind):
    """Record batches (bucket, marks, blob) of bounded size."""
    pairs = list(pairs)
    for lo in range(0, len(pairs), 256):
        to, blobs = zip(*pairs[lo : lo + 256], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array([kind] * len(to), pa.bool_()), pa.array(blobs, pa.binary())], ["bucket", "marks", "blob"])


_NO_HASH = np.uint64(0)


def _marks(doc, place, buckets):
    """Marked places, dealt out by document."""
    return _rows(_blobs(C.id_bucket(doc, buckets), np.full(len(doc), _NO_HASH), doc, place), True)


def _scan(width: int, buckets: int):
    def run(batches):
        held, size = [], 0

        def flush():
            h, doc, place = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((place, doc))
            h, doc, place = h[order], doc[order], place[order]
            first, again = _local(h, doc, place)
            if again.any():
                yield from _marks(doc[again], place[again], buckets)
            h, doc, place = h[first], doc[first], place[first]
            yield from _rows(_blobs(C.bucket_of(h, buckets), h, doc, place), False)

        with np.errstate(over="ignore"):
            for whole in batches:
                for b in C.sliced(whole, "text"):
                    w = C.Words(b.column("text"))
                    h = C.windows(w.hashes(), width)
                    n = np.maximum(w.counts - width + 1, 0)
                    if not n.sum():
                        continue
                    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    ids = np.repeat(b.column("doc").to_numpy(), n)
                    held.append((h[np.repeat(w.first, n) + place], ids, place))
                    size += len(place)
                    if size >= FLUSH:
                        yield from flush()
                        held, size = [], 0
            if held:
                yield from flush()

    return run


def _judge(buckets: int):
    """All first places of some hash range: those after the smallest are repeats. Marks pass on."""

    def run(batches):
        held = []
        for b in batches:
            marks = b.column("marks")
            held += [C.unpack(x)[:3] for x in b.filter(pc.invert(marks)).column("blob").to_pylist()]
            done = b.filter(marks)
            if len(done):
                yield done.select(["bucket", "blob"])
        if not held:
            return
        h, doc, place = (np.concatenate(x) for x in zip(*held, strict=True))
        del held
        order = np.argsort(h)
        _, n = C.runs(h[order])
        rows = order[np.repeat(n > 1, n)]
        h, doc, place = h[rows], doc[rows], place[rows]
        order = np.lexsort((place, doc, h))
        h, doc, place = h[order], doc[order], place[order]
        at, n = C.runs(h)
        late = (doc != np.repeat(doc[at], n)) | (place != np.repeat(place[at], n))
        doc, place = doc[late], place[late]
        order = np.lexsort((place, doc))
        for b in _marks(doc[order], place[order], buckets):
            yield b.select(["bucket", "blob"])

    return run


def repeats(docs: DataFrame, n: int, width: int, text: str, doc_id: str) -> DataFrame:
    """(bucket, blob): packed starts of all windows that also start earlier, dealt into ``n`` buckets of documents."""
    rows = docs.select(C.key_of(doc_id).alias("doc"), F.col(text).cast("string").alias("text"))
    sent = rows.mapInArrow(C.tidy(_scan(width, n)), "bucket int, marks boolean, blob binary")
    return sent.repartitionById(n, F.col("bucket")).mapInArrow(C.tidy(_judge(n)), "bucket int, blob binary")


def intervals(starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal [from, to) word intervals covered by windows that begin at ``starts``."""
    s = np.unique(starts)
    if not len(s):
        return s, s
    new = np.append(True, s[1:] > s[:-1] + width)
    last = np.append(new[1:], True)
    return s[new], s[last] + width


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _cut(width: int, schema: T.StructType, spacing: bool):
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema)

    def run(batches):
        held, found = [], None
        for whole in batches:
            for b in C.sliced(whole, "_q_text", 2**23):
                blob = b.column("_q_blob")
                held += [C.unpack(x)[1:3] for x in blob.drop_null().to_pylist()]
                b = b.filter(blob.is_null())
                if not len(b):
                    continue
                if found is None:  # blobs sort before documents
                    doc, place = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.zeros(0, np.int64),) * 2
                    held = []
                    order = np.lexsort((place, doc))
                    doc, place = doc[order], place[order]
                    at, n = C.runs(doc)
                    found = {d: (i, i + k) for d, i, k in zip(doc[at].tolist(), at.tolist(), n.tolist(), strict=True)}
                kept, total, removed, spans = [], [], [], []
                for text, key in zip(b.column("_q_text"), b.column("_q_key").to_pylist(), strict=True):
                    raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                    words = raw.split()
                    total.append(len(words))
                    spans.append([])
                    if key in found:
                        lo, hi = intervals(place[slice(*found[key])], width)
                        cuts = [(a, min(z, len(words))) for a, z in zip(lo.tolist(), hi.tolist(), strict=True) if a < len(words)]
                        spans[-1] += [{"from": a, "to": z} for a, z in cuts]
                    stays = list(zip([0, *(s["to"] for s in spans[-1])], [*(s["from"] for s in spans[-1]), len(words)], strict=True))
                    stays = [(a, z) for a, z in stays if a < z]
                    removed.append(len(words) - sum(z - a for a, z in stays))
                    if not spacing:
                        kept.append(b" ".join(w for a, z in stays for w in words[a:z]))
                    elif not spans[-1]:
                        kept.append(raw)
                    else:
                        at = [m.span() for m in _WORD.finditer(raw)]
                        kept.append(b" ".join(raw[at[a][0] : at[z - 1][1]] for a, z in stays))
                new = {"kept_text": pa.array(kept, pa.binary()).cast(pa.string()), "n_words": pa.array(total, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "removed_spans": pa.array(spans, target.field("removed_spans").type)}
                yield pa.RecordBatch.from_arrays([new[f.name] if f.name in new else b.column(f.name).cast(f.type) for f in target], schema=target)

    return run


def remove_repeats(docs: DataFrame, width: int = 20, text: str = "text", doc_id: str = "doc_id", spacing: bool = False, ranges: int | None = None) -> DataFrame:
    """``docs`` without its text column, plus kept_text, n_words, n_removed and removed_spans.

    kept_text joins the kept words by one space; with ``spacing`` it keeps the text's own white
    space (all of it where nothing goes) and puts one space where words went. removed_spans are
    maximal word intervals [from, to). ``ranges`` is the number of hash ranges and of document
    buckets, by default one for each 8 MB of input. Columns of these four names in ``docs`` are replaced.
    """
    own = ["kept_text", "n_words", "n_removed", "removed_spans"]
    rest = [c for c in docs.columns if c not in {*own, text}]
    n = ranges or C.partitions(docs.select(text), 8)
    rows = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(text).cast("string").alias("_q_text"), C.key_of(doc_id).alias("_q_key"), F.lit(None).cast("binary").alias("_q_blob"))
    rows = rows.withColumn("_q_bucket", C.id_bucket_col("_q_key", n))
    marks = repeats(docs, n, width, text, doc_id).select(*[F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in rest], F.lit(None).cast("string").alias("_q_text"), F.lit(None).cast("long").alias("_q_key"), F.col("blob").alias("_q_blob"), F.col("bucket").alias("_q_bucket"))
    met = rows.union(marks).repartitionById(n, F.col("_q_bucket")).withColumn("_q_doc", F.col("_q_blob").isNull()).sortWithinPartitions("_q_doc").drop("_q_bucket", "_q_doc")
    schema = T.StructType([T.StructField(c, docs.schema[c].dataType) for c in rest] + list(T._parse_datatype_string("kept_text string, n_words long, n_removed long, removed_spans array<struct<`from`:int,`to`:int>>")))
    return met.mapInArrow(C.tidy(_cut(width, schema, spacing)), schema)
