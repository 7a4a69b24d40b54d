"""Audio fingerprints from chroma, and their alignment.

Fingerprint: a WAV (PCM, 8 or 16 bits, channels averaged) is cut into overlapping
windowed frames; the spectrum between 110 and 1760 Hz adds up by pitch class to
12 numbers a frame, smoothed and scaled to unit length (silent frames stay 0).
The integral image of frames by pitch classes gives any rectangle's sum in four
reads; 16 filters compare rectangles, each answer is quantised to two Gray-coded
bits, and a frame's 32 bits are one packed integer.

Alignment of two recordings: equal integers vote for an offset in a histogram;
at the fullest offset the share of unequal bits over the overlap is the bit
error. They link if it is at most ``most_error`` over ``least_overlap`` integers
or more. Candidates are all pairs with an equal integer other than 0 (frames
without sound carry no evidence): without one no offset gets a vote, so none
that the law links is left out.

Equal fingerprints collapse into classes first. Their representatives are dealt
into blocks by a hash of the id, and every two blocks meet in one group, which
finds its pairs with an equal integer and tests each. So all links are confirmed,
those inside a component too. Pairs grow with the square of the recordings. No cap.

Edge cases: null, empty, foreign or broken bytes have an empty fingerprint, as
have recordings shorter than the filters; they link with nothing; repeated rows
are equal recordings; null ids come before all others; an empty table gives an
empty table; extra columns don't matter, as results hold only their own columns.
"""

from __future__ import annotations

import io
import struct
import wave

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import common as C
from quire.llm.components import components

SPAN = 16  # frames under a filter at most


def read_wav(data: bytes | None) -> tuple[np.ndarray, int]:
    """Samples in [-1, 1] and their rate; nothing for what isn't PCM of 8 or 16 bits."""
    try:
        with wave.open(io.BytesIO(data or b"")) as w:
            raw, wide, n, rate = w.readframes(w.getnframes()), w.getsampwidth(), w.getnchannels(), w.getframerate()
    except (wave.Error, EOFError, ValueError, struct.error):
        return np.zeros(0), 1
    if wide not in (1, 2) or rate < 1:
        return np.zeros(0), 1
    x = np.frombuffer(raw[: len(raw) // wide * wide], np.uint8 if wide == 1 else "<i2").astype(float)
    x = (x - 128) / 128 if wide == 1 else x / 32768
    return x[: len(x) // n * n].reshape(-1, n).mean(axis=1), rate


def write_wav(samples: np.ndarray, rate: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


_maps: dict[tuple, tuple] = {}


def chroma(samples: np.ndarray, rate: int, seconds: float = 0.128, step: float = 0.064) -> np.ndarray:
    """Frames by 12 pitch classes, 0 being A."""
    size, hop = max(16, int(rate * seconds)), max(8, int(rate * step))
    if len(samples) < size:
        return np.zeros((0, 12))
    if (rate, size) not in _maps:
        hz = np.fft.rfftfreq(size, 1 / rate)
        ok = (hz >= 110) & (hz <= 1760)
        to = np.zeros((len(hz), 12))
        to[ok, np.round(12 * np.log2(hz[ok] / 110)).astype(int) % 12] = 1
        _maps[rate, size] = (np.hanning(size), to)
    window, to = _maps[rate, size]
    frames = np.lib.stride_tricks.sliding_window_view(samples, size)[::hop] * window
    power = (np.abs(np.fft.rfft(frames, axis=1)) ** 2) @ to
    if len(power) > 1:
        power[1:] = (power[1:] + power[:-1]) / 2
    norm = np.sqrt((power**2).sum(axis=1, keepdims=True))
    return np.where(norm > 1e-6, power / np.maximum(norm, 1e-6), 0.0)


def filters(n: int = 16) -> list[tuple[int, int, int, int]]:
    """(kind, first pitch class, height, width): by rule, kinds in turn over heights 3 to 12 and widths 2 to SPAN.

    Kinds compare a rectangle's halves in time (0), in pitch (1), its middle and outer thirds in time (2) or
    pitch (3), and the two diagonals of its quarters (4).
    """
    return [(k % 5, 5 * k % 10, min(12 - 5 * k % 10, 3 + 2 * k % 10), 2 + 2 * ((3 * k) % 8)) for k in range(n)]


def _answers(image: np.ndarray) -> np.ndarray:
    total = np.zeros((len(image) + 1, 13))
    np.cumsum(np.cumsum(image, axis=0), axis=1, out=total[1:, 1:])
    n = len(image) - SPAN + 1
    t = np.arange(n)

    def area(a, b, lo, hi):  # frames [t + a, t + b), classes [lo, hi)
        return total[t + b, hi] - total[t + a, hi] - total[t + b, lo] + total[t + a, lo]

    out = []
    for kind, y, high, wide in filters():
        top, mid, half = y + high, y + high // 2, wide // 2
        if kind == 0:
            a, b = area(0, half, y, top), area(half, wide, y, top)
        elif kind == 1:
            a, b = area(0, wide, y, mid), area(0, wide, mid, top)
        elif kind == 2:
            third = max(1, wide // 3)
            a = area(third, wide - third, y, top)
            b = area(0, third, y, top) + area(wide - third, wide, y, top)
        elif kind == 3:
            third = max(1, high // 3)
            a = area(0, wide, y + third, top - third)
            b = area(0, wide, y, y + third) + area(0, wide, top - third, top)
        else:
            a = area(0, half, y, mid) + area(half, wide, mid, top)
            b = area(0, half, mid, top) + area(half, wide, y, mid)
        out.append(np.log((1 + a) / (1 + b)))
    return np.array(out).T


def fingerprint(data: bytes | None, edges: tuple[float, float, float] = (-0.15, 0.0, 0.15)) -> np.ndarray:
    """Packed integers of a WAV, one a frame."""
    image = chroma(*read_wav(data))
    if len(image) < SPAN:
        return np.zeros(0, np.uint32)
    level = np.searchsorted(edges, _answers(image))
    code = (level ^ (level >> 1)).astype(np.uint64)  # neighbours differ in one bit
    out = (code << (2 * np.arange(code.shape[1], dtype=np.uint64))).sum(axis=1, dtype=np.uint64).astype(np.uint32)
    silent = np.convolve(image.sum(axis=1) == 0, np.ones(SPAN), "valid") == SPAN
    out[silent] = 0
    return out


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, float]:
    """Best offset of b in a, overlap there, and the share of unequal bits."""
    at, to = np.nonzero(np.equal.outer(a, b))
    if not len(at):
        return 0, 0, 1.0
    shift, votes = np.unique(at - to, return_counts=True)
    best = shift[np.lexsort((shift, np.abs(shift), -votes))[0]]
    lo, hi = max(0, best), min(len(a), len(b) + best)
    wrong = np.bitwise_count(a[lo:hi] ^ b[lo - best : hi - best]).sum()
    return int(best), int(hi - lo), float(wrong / (32 * max(1, hi - lo)))


def _small(batches, rows: int = 64):
    """Recordings are large: a few of a batch at a time."""
    for b in batches:
        for lo in range(0, len(b), rows):
            yield b.slice(lo, rows)


def _prints(batches):
    for b in _small(batches):
        got = [fingerprint(x) for x in b.column("audio").to_pylist()]
        flat = np.concatenate([*got, np.zeros(0, np.uint32)]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([b.column("id"), C.ragged(flat, np.array([len(x) for x in got], np.int64), pa.int64())], ["id", "print"])


def fingerprints(media: DataFrame, audio: str = "audio", media_id: str = "id") -> DataFrame:
    """(id, print): a list of 32-bit integers for each recording."""
    return media.select(C.key_of(media_id).alias("id"), F.col(audio).cast("binary").alias("audio")).mapInArrow(C.tidy(_prints), "id long, print array<long>")


def _spread(n: np.ndarray) -> np.ndarray:
    """0 ... n - 1 for each n in turn."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _offsets(x: np.ndarray, nx: np.ndarray, ids_x: np.ndarray, y: np.ndarray, ny: np.ndarray, ids_y: np.ndarray, chunk: int = 2**21):
    """(i, j, offset of y in x) of all pairs with an equal integer other than 0, as ``align`` has it for the
    smaller id and the larger one.

    Flat prints, their lengths and ids; pairs come in parts of about ``chunk`` equal integers.
    """
    rx, px, ry, py = np.repeat(np.arange(len(nx)), nx), _spread(nx), np.repeat(np.arange(len(ny)), ny), _spread(ny)
    order = np.argsort(y, kind="stable")
    first, last = (np.searchsorted(y[order], x, side) for side in ("left", "right"))
    met = np.where(x != 0, last - first, 0)
    by = np.bincount(rx, met, len(nx)).astype(np.int64)
    part = (np.cumsum(by) - by) // chunk
    zero_x, zero_y = np.bincount(rx[x == 0], minlength=len(nx)) > 0, np.bincount(ry[y == 0], minlength=len(ny)) > 0
    wide = int(max(nx.max(), ny.max())) + 1
    for k in np.unique(part[by > 0]):
        at = np.flatnonzero((part[rx] == k) & (met > 0))
        to = order[np.repeat(first[at], met[at]) + _spread(met[at])]
        at = np.repeat(at, met[at])
        key, votes = np.unique((rx[at] * len(ny) + ry[to]) * (2 * wide) + px[at] - py[to] + wide, return_counts=True)
        pair, shift = key // (2 * wide), key % (2 * wide) - wide
        sign = np.where(ids_x[pair // len(ny)] > ids_y[pair % len(ny)], -1, 1)  # ties between two offsets go by the ids alone
        best = np.lexsort((shift * sign, np.abs(shift), -votes, pair))
        best = best[np.append(True, np.diff(pair[best]) > 0)]
        i, j, shift = pair[best] // len(ny), pair[best] % len(ny), shift[best]
        for p in np.flatnonzero(zero_x[i] & zero_y[j]):  # zeros vote too
            one, two = x[rx == i[p]], y[ry == j[p]]
            shift[p] = -align(two, one)[0] if ids_x[i[p]] > ids_y[j[p]] else align(one, two)[0]
        yield i, j, shift


def links_between(x: np.ndarray, nx: np.ndarray, ids_x: np.ndarray, y: np.ndarray, ny: np.ndarray, ids_y: np.ndarray, most_error: float, least_overlap: int, chunk: int = 2**21):
    """(i, j, offset, overlap, bit_error) of the pairs that link; offset is y's in x."""
    x, y = x.astype(np.uint32), y.astype(np.uint32)
    sx, sy = np.cumsum(nx) - nx, np.cumsum(ny) - ny
    for i, j, shift in _offsets(x, nx, ids_x, y, ny, ids_y) if len(x) and len(y) else ():
        lo, hi = np.maximum(0, shift), np.minimum(nx[i], ny[j] + shift)
        n = np.maximum(hi - lo, 0)
        ok = n >= max(1, least_overlap)
        i, j, shift, lo, n = i[ok], j[ok], shift[ok], lo[ok], n[ok]
        part = (np.cumsum(n) - n) // chunk
        for k in np.unique(part):
            p = slice(*np.searchsorted(part, [k, k + 1]))
            step = _spread(n[p])
            bits = np.bitwise_count(x[np.repeat((sx[i] + lo)[p], n[p]) + step] ^ y[np.repeat((sy[j] + lo - shift)[p], n[p]) + step])
            error = np.add.reduceat(bits, np.cumsum(n[p]) - n[p], dtype=np.int64) / (32 * n[p])
            good = error <= most_error
            yield i[p][good], j[p][good], shift[p][good], n[p][good], error[good]


def _meet(most_error: float, least_overlap: int):
    """A group holds the recordings of two blocks, or of one."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("id")
        lo, hi = group.column("lo")[0].as_py(), group.column("hi")[0].as_py()
        sides = []
        for block in (lo, hi):
            rows = group.filter(pc.equal(group.column("block"), block))
            sides.append((rows.column("id").to_numpy(), pc.list_flatten(rows.column("print")).to_numpy(), pc.list_value_length(rows.column("print")).to_numpy().astype(np.int64)))
        (ids, x, nx), (other, y, ny) = sides
        cols = [[], [], [], [], []]
        for i, j, shift, n, error in links_between(x, nx, ids, y, ny, other, most_error, least_overlap):
            if lo == hi:  # each pair once
                keep = i < j
                i, j, shift, n, error = i[keep], j[keep], shift[keep], n[keep], error[keep]
            swap = ids[i] > other[j]  # the smaller id is the one aligned to
            for c, v in zip(cols, (np.maximum(ids[i], other[j]), np.minimum(ids[i], other[j]), np.where(swap, -shift, shift), n, error), strict=True):
                c.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64())
        return pa.table([pa.array(np.concatenate([*c, np.zeros(0, np.int64)]).astype(t.to_pandas_dtype()), t) for c, t in zip(cols, kinds, strict=True)], ["a", "c", "offset", "overlap", "bit_error"])

    return run


def links(reps: DataFrame, most_error: float = 0.15, least_overlap: int = 24, block_ints: int = 500_000) -> DataFrame:
    """(a, c, offset, overlap, bit_error): all links of recordings (id, print), each once."""
    blocks = -(-(reps.agg(F.sum(F.size("print"))).first()[0] or 1) // block_ints)
    dealt = reps.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.select("id", "print", "block", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"))
    return dealt.groupBy("lo", "hi").applyInArrow(_meet(most_error, least_overlap), "a long, c long, offset int, overlap int, bit_error double")


def aligned(prints: DataFrame, most_error: float = 0.15, least_overlap: int = 24) -> DataFrame:
    """(id, n_prints, class_id, component_id, n_links): a row for each recording.

    class_id is the smallest id with the same fingerprint, component_id the smallest reachable over
    links; n_links counts the links of the recording's class with other classes.
    """
    prints = C.written(prints)  # read twice below; recordings are rendered and fingerprinted once
    named = prints.withColumn("h", F.xxhash64("print")).withColumn("h2", F.hash("print"))
    classes = named.where("size(print) > 0").groupBy("h", "h2").agg(F.min("id").alias("rep"))
    full = C.written(named.join(classes, ["h", "h2"], "left").select("id", "print", F.coalesce("rep", "id").alias("rep")))
    reps = C.written(full.where("id = rep and size(print) > 0").select("id", "print").dropDuplicates(["id"]))
    found = C.written(links(reps, most_error, least_overlap))
    labels = components(found.selectExpr("a", "c as b"))
    degree = found.selectExpr("a as rep").union(found.selectExpr("c")).groupBy("rep").agg(F.count("*").alias("n_links"))
    out = full.join(labels.withColumnRenamed("node", "rep"), "rep", "left").join(degree, "rep", "left")
    return out.select(C.unkey("id").alias("id"), F.size("print").cast("long").alias("n_prints"), C.unkey("rep").alias("class_id"), F.when(F.coalesce("label", "rep") != C.NULL_ID, F.coalesce("label", "rep")).alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _tones(rate: int, note: float):
    size = int(rate * note)
    t = np.arange(size) / rate
    fade = np.minimum(1, np.minimum(np.arange(size), np.arange(size)[::-1]) / (size / 16))

    def run(batches):
        for b in _small(batches):
            out = []
            for v in b.column("v").to_pylist():
                v = np.array([x if x is not None and np.isfinite(x) else 0.0 for x in v or []])
                pitch = np.floor(np.abs(v) * 240) % 36
                out.append(write_wav((0.5 * fade * np.sin(2 * np.pi * 110 * 2 ** (pitch[:, None] / 12) * t)).ravel(), rate) if len(v) else b"")
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.binary())], ["id", "audio"])

    return run


def rendered(vectors: DataFrame, column: str, vector_id: str, rate: int = 4000, note: float = 0.1) -> DataFrame:
    """(id, audio): each vector played as a melody, a note for each number. Stands in for a media table."""
    return vectors.select(F.col(vector_id).alias("id"), F.col(column).alias("v")).mapInArrow(C.tidy(_tones(rate, note)), "id long, audio binary")
