"""Best-fit packing of token sequences by linear grouping.

Lengths lie between 1 and the capacity, so their histogram (one count per
length) is bounded whatever the number of documents, and the packing is solved
on it, on the driver:

1. Large lengths, sorted downwards, are cut into ``groups`` groups of equal
   cardinality; in each every length counts as the group's largest.
2. Configurations of these few sizes: the largest left, and beside it the subset
   that fills the sequence best (bounded subset sum), as often as it goes.
3. Actual documents take the places of their group, so sequences gain room.
4. What is left, small lengths mostly, goes downwards into the sequence with the
   least room that fits; new sequences open when none does.

Sequences with equal contents stay one run with a multiplicity, so steps 3 and 4
handle runs, not documents. Every document has a rank among those of its length
(counts per bucket, then prefix sums), and its rank leads to its place.

Edge cases: null and empty texts are the end token alone; only documents beyond
the capacity are cut; repeated rows are packed each; null ids are packed like
others; an empty table gives an empty table.
"""

from __future__ import annotations

import re
import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import common as C


# ---------------------------------------------------------------- tokens
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[[i for i in range(33, 127) if not chr(i).isalnum()]] = True


_PLAIN = re.compile("[a-zß-öø-ÿ]+")


def _byte_names() -> dict[str, int]:
    """Characters that byte-level vocabularies write bytes with: printable ones themselves, others from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class WordTokenizer:
    """Ids of a tokenizer that folds case, drops white space and never joins letters with marks.

    Texts are cut into units where that changes no id: at white space, and between an ASCII letter
    and the mark behind it. Units are looked up in a table; at ``most`` units the half that was used
    longest ago leaves it, which costs time, never results. Unknown units of plain lower-case letters
    go through the same merges as ranks of bytes, in which NUL stands for the end of a word; all
    others, and texts that hold the name of a special token in any case, through the tokenizer itself.
    """

    def __init__(self, path: str, end: int, most: int = 250_000):
        import tiktoken
        from tokenizers import Tokenizer

        self.model, self.end, self.most = Tokenizer.from_file(path), end, most
        names = _byte_names()
        vocab = self.model.get_vocab(with_added_tokens=False)
        ranks, self.closes = {}, np.zeros(max(vocab.values(), default=0) + 1, bool)
        for t, i in vocab.items():
            body = t.removesuffix("</w>")
            if all(c in names for c in body):
                ranks[bytes(names[c] for c in body) + b"\0" * (body != t)] = i
                self.closes[i] = body != t
        self.fast = tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})
        self.special = [t.content.encode().lower() for t in self.model.get_added_tokens_decoder().values()]
        self.at: dict[bytes, int] = {b"": 0}  # the empty unit stands for the end token
        self.flat, self.used, self.turn = np.full(1024, end, np.uint32), 1, 0
        self.start, self.size, self.last = (np.zeros(1024, np.int64) for _ in range(3))
        self.size[0] = 1

    def _forget(self) -> None:
        n = len(self.at)
        keep = self.last[:n] > np.median(self.last[1:n]) if n > 1 else np.ones(n, bool)
        keep[0] = True
        start, size = self.start[:n][keep], self.size[:n][keep]
        at = np.cumsum(size) - size
        self.flat = self.flat[np.repeat(start - at, size) + np.arange(size.sum())]
        self.used = len(self.flat)
        self.at = {w: i for i, w in enumerate(w for w, k in zip(self.at, keep.tolist(), strict=True) if k)}
        self.start[: len(at)], self.size[: len(at)], self.last[: len(at)] = at, size, self.last[:n][keep]

    def _learn(self, units: list[bytes]) -> None:
        plain: list[bytes] = []
        other: list[bytes] = []
        for w in units:
            (plain if _PLAIN.fullmatch(w.decode("utf-8", "replace")) else other).append(w)
        for lo in range(0, len(plain), 50_000):
            part = plain[lo : lo + 50_000]
            new = np.array(self.fast.encode_ordinary((b"\0".join(part) + b"\0").decode()), np.uint32)
            n = np.diff(np.append(-1, np.flatnonzero(self.closes[new])))
            if len(n) != len(part):
                raise RuntimeError("the vocabulary has no plain word ends")
            self._add(part, new, n)
        for lo in range(0, len(other), 10_000):
            part = other[lo : lo + 10_000]
            ids = [e.ids for e in self.model.encode_batch_fast([w.decode("utf-8", "replace") for w in part], add_special_tokens=False)]
            self._add(part, np.fromiter((x for i in ids for x in i), np.uint32), np.array([len(i) for i in ids]))

    def _add(self, part: list[bytes], new: np.ndarray, n: np.ndarray) -> None:
        k = len(self.at)
        if self.used + len(new) > len(self.flat):
            self.flat = np.append(self.flat[: self.used], np.zeros(self.used + len(new), np.uint32))
        if k + len(part) > len(self.start):
            self.start, self.size, self.last = (np.append(x, np.zeros(len(x) + len(part), np.int64)) for x in (self.start, self.size, self.last))
        self.flat[self.used : self.used + len(new)] = new
        self.start[k : k + len(part)] = self.used + np.cumsum(n) - n
        self.size[k : k + len(part)] = n
        self.used += len(new)
        self.at.update(zip(part, range(k, k + len(part)), strict=True))

    @staticmethod
    def _cut(text: bytes) -> list[bytes]:
        raw = np.frombuffer(text, np.uint8)
        at = np.flatnonzero(_LETTER[raw[:-1]] & _MARK[raw[1:]]) + 1
        if not len(at):
            return text.split()
        out = np.full(len(raw) + len(at), 32, np.uint8)
        out[np.arange(len(raw)) + np.repeat(np.arange(len(at) + 1), np.diff(np.concatenate(([0], at, [len(raw)]))))] = raw
        return out.tobytes().split()

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, each with its end token; the number of ids of each."""
        if len(self.at) > self.most:
            self._forget()
        self.turn += 1
        low = [t.lower() for t in texts]
        odd = {i for i, t in enumerate(low) if b"<|" in t and any(s in t for s in self.special)}
        units: list[bytes] = []
        last = []
        for i, t in enumerate(low):
            if i not in odd:
                units += self._cut(t)
            units.append(b"")
            last.append(len(units))
        k = np.fromiter(map(self.at.get, units, repeat(-1)), np.int64, len(units))
        lost = np.flatnonzero(k < 0)
        if len(lost):
            missing = [units[i] for i in lost.tolist()]
            self._learn(list(dict.fromkeys(missing)))
            k[lost] = np.fromiter(map(self.at.__getitem__, missing), np.int64, len(missing))
        self.last[k] = self.turn
        size = self.size[k]
        end = np.cumsum(size)
        ids = self.flat[np.repeat(self.start[k] - end + size, size) + np.arange(end[-1] if len(end) else 0)]
        n = np.diff(np.append(0, end[np.array(last, np.int64) - 1])) if last else np.zeros(0, np.int64)
        if odd:
            parts = np.split(ids, np.cumsum(n)[:-1])
            for i in odd:
                parts[i] = np.append(np.array(self.model.encode(texts[i].decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32), np.uint32(self.end))
            ids, n = np.concatenate(parts), np.array([len(x) for x in parts])
        return ids, n


def _pieces(path: str, end: int, capacity: int, keep_ids: bool):
    def run(batches):
        model = WordTokenizer(path, end)  # for this task alone: workers are reused, and its table is large
        for whole in batches:
            for b in C.sliced(whole, "text"):
                ids, n = model.encode([x.as_buffer().to_pybytes() if x.is_valid else b"" for x in b.column("text")])
                per = -(-n // capacity)
                row = np.repeat(np.arange(len(n)), per)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
                start = piece * capacity
                length = np.minimum(n[row] - start, capacity)
                lo = (np.cumsum(n) - n)[row] + start
                raw = np.ascontiguousarray(ids, "<u4")
                crc = [zlib.crc32(raw[a : a + k]) for a, k in zip(lo.tolist(), length.tolist(), strict=True)]
                out = [b.column("doc").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if keep_ids:
                    out.append(C.ragged(ids.astype(np.int64), length, pa.int32()))
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(out)])

    return run


def pieces(docs: DataFrame, tokenizer: str, end: int = 1, capacity: int = 4096, keep_ids: bool = False, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): a document's ids and the end token, cut at the capacity."""
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return docs.select(F.col(doc_id).alias("doc"), F.col(text).cast("string").alias("text")).mapInArrow(C.tidy(_pieces(tokenizer, end, capacity, keep_ids)), schema)


# ---------------------------------------------------------------- solver
def _fill(room: int, sizes: list[int], left: list[int]) -> list[int]:
    """Indices (with repeats) of the sizes whose sum comes nearest to ``room``, at most ``left`` of each."""
    by = np.full(room + 1, -1, np.int64)  # the size that reached a sum last
    by[0] = -2
    for i, size in enumerate(sizes):
        for _ in range(min(left[i], room // size if size else 0)):
            old = by[: room + 1 - size] != -1
            new = old & (by[size:] == -1)
            if not new.any():
                break
            by[size:][new] = i
            if by[room] != -1:
                break
        if by[room] != -1:
            break
    at, out = int(np.flatnonzero(by != -1)[-1]), []
    while at:
        out.append(int(by[at]))
        at -= sizes[by[at]]
    return out


def _grouped(count: np.ndarray, large: int, groups: int) -> list[list[list[int]]]:
    """Groups of equal cardinality, largest lengths first; a group is a list of [length, count]."""
    lengths = [[int(v), int(count[v])] for v in np.flatnonzero(count)[::-1] if v >= large]
    total = sum(n for _, n in lengths)
    size = max(1, -(-total // groups))
    out, room = [], 0
    for v, n in lengths:
        while n:
            if not room:
                out.append([])
                room = size
            k = min(n, room)
            out[-1].append([v, k])
            n, room = n - k, room - k
    return out


def _take(group: list[list[int]], n: int) -> list[tuple[int, int]]:
    """The first n lengths of a group, as runs; they leave the group."""
    out = []
    while n:
        k = min(n, group[0][1])
        out.append((group[0][0], k))
        group[0][1] -= k
        n -= k
        if not group[0][1]:
            group.pop(0)
    return out


def solve(count: np.ndarray, capacity: int, groups: int = 2000, large_share: int = 6) -> list[tuple[int, list[int]]]:
    """Runs (number of sequences, lengths in each) that hold exactly ``count[v]`` pieces of length v."""
    count = count.copy()
    done: list[tuple[int, list[int]]] = []
    if count[capacity]:
        done.append((int(count[capacity]), [capacity]))
        count[capacity] = 0
    large = max(2, capacity // large_share)
    grouped = _grouped(count, large, groups)
    sizes = [g[0][0] for g in grouped]
    left = [sum(n for _, n in g) for g in grouped]
    room: dict[int, list[tuple[int, list[int]]]] = {}

    def put(n: int, items: list[int]) -> None:
        r = capacity - sum(items)
        (room.setdefault(r, []) if r else done).append((n, items))

    first = 0
    while first < len(sizes):
        if not left[first]:
            first += 1
            continue
        left[first] -= 1
        use = [first, *_fill(capacity - sizes[first], sizes[first:], left[first:])]
        use = [use[0], *(i + first for i in use[1:])]
        left[first] += 1
        times = min(left[i] // use.count(i) for i in set(use))
        slots = []
        for k, i in enumerate(use):
            got = _take(grouped[i], times)
            left[i] -= times
            slots.append(got if k % 2 == 0 else got[::-1])
        at = [0] * len(slots)
        rest = [s[0][1] for s in slots]
        while times:  # cut the slots at each other's steps
            n = min(rest)
            put(n, [s[a][0] for s, a in zip(slots, at, strict=True)])
            times -= n
            for k in range(len(slots)):
                rest[k] -= n
                if not rest[k] and times:
                    at[k] += 1
                    rest[k] = slots[k][at[k]][1]
    for v in range(min(large, capacity) - 1, 0, -1):
        n = int(count[v])
        free = sorted(r for r in room if r >= v)
        while n and free:
            r = free[0]
            if not room.get(r):
                room.pop(r, None)
                free.pop(0)
                continue
            m, items = room[r].pop()
            k = min(m, n)
            if m > k:
                room[r].append((m - k, items))
            put(k, [*items, v])
            n -= k
            if r - v >= v and free[0] != r - v:
                free.insert(0, r - v)
        if n:
            per = capacity // v
            if n // per:
                put(n // per, [v] * per)
            if n % per:
                put(1, [v] * (n % per))
    return done + [x for runs in room.values() for x in runs]


def places(runs: list[tuple[int, list[int]]], capacity: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: first rank, first sequence and offset of each interval of ranks."""
    by: dict[int, list[tuple[int, int, int]]] = {}
    base = 0
    for n, items in runs:
        at = 0
        for v in items:
            by.setdefault(v, []).append((n, base, at))
            at += v
        base += n
    out = {}
    for v, rows in by.items():
        n, first, at = np.array(rows, np.int64).T
        out[v] = (np.cumsum(n) - n, first, at)
    return out


def _assign(table: dict):
    def run(batches):
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            at, n = C.runs(length[order])
            for i, k in zip(at, n, strict=True):
                rows = order[i : i + k]
                start, base, offset = table[int(length[rows[0]])]
                j = np.searchsorted(start, rank[rows], side="right") - 1
                seq[rows], off[rows] = base[j] + rank[rows] - start[j], offset[j]
            keep = [c for c in b.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(seq), pa.array(off)], [*keep, "sequence_id", "offset"])

    return run


def pack(parts: DataFrame, capacity: int = 4096, groups: int = 2000) -> DataFrame:
    """``parts`` (doc_id, piece, length and more; reread from a table) with sequence_id and offset."""
    rows = parts.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most ``capacity`` rows
    count = np.zeros(capacity + 1, np.int64)
    for r in rows:
        count[r["length"]] = r["n"]
    table = places(solve(count, capacity, groups), capacity)
    buckets = max(16, int(count.sum()) // 50_000)
    dealt = parts.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    sums = dealt.groupBy("bucket", "length").agg(F.count("*").alias("n"))
    before = sums.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).select("bucket", "length", F.coalesce("before", F.lit(0)).alias("before"))
    inner = F.row_number().over(Window.partitionBy("bucket", "length").orderBy("doc_id", "piece"))
    ranked = dealt.withColumn("inner", inner).join(before, ["bucket", "length"]).withColumn("rank", (F.col("before") + F.col("inner") - 1).cast("long"))
    ranked = ranked.select(*parts.columns, "rank")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(_assign(table), schema)


def pack_documents(docs: DataFrame, tokenizer: str, end: int = 1, capacity: int = 4096, keep_ids: bool = False, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Pieces of all documents with their sequence and their place in it, gapless from 0."""
    return pack(C.written(pieces(docs, tokenizer, end, capacity, keep_ids, text, doc_id)), capacity)
