"""Shards of nearly equal bytes by histogram sort, in DataFrame operations alone.

Rows have a sort key of two whole numbers of 63 bits: a hash of the group (equal
texts) and the id. Boundaries between shards are found before anything moves:

1. Count exact bytes and rows below evenly spaced probes over the whole key space.
2. Every boundary lies between two probes; lay new probes between them and count
   again, only rows in between, until the bytes there are within the slack of the
   boundary or the key has no bits left. A group larger than the slack is thus
   split by id; any other stays whole. The slack between two shards is
   ``tolerance`` of a shard's bytes (a quarter of a part's, if that is less), that
   between two parts of a shard ``tolerance`` of a part's.
3. Exchange once, by boundary number; a row's slot in its shard is the exact
   count of rows before its boundary, known from the histograms, and its rank
   after it: in the order of group hash and id, so slots don't depend on the order
   of the input.

Each shard is cut into ``parts`` ranges, so work doesn't stop at the number of
shards. The driver holds counts of at most 4096 + 512 * shards * parts probes a
round. Every round reads the narrow key table alone.

Edge cases: null texts are one group of their own; null ids come before all
others; rows equal in group and id can't be parted and stay together, in any order
among themselves; ids that differ in the last bit alone lie in one part; fewer rows
than shards leave shards empty; an empty table gives an empty table; columns
named like the key's are replaced, all others pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import common as C

BITS = 63
TOP, STEP = 12, 9


def _cells(rows: DataFrame, active: list[tuple[int, int]], column: str, shift: int, step: int) -> dict:
    """Bytes and rows per probe interval inside each active one; active: (group or -1, prefix)."""
    spark = rows.sparkSession
    prefix = F.shiftright(column, shift)
    if active[0][1] < 0:
        rows = rows.withColumn("g", F.lit(-1).cast("long"))
    else:  # at most one interval for each boundary
        wanted = spark.createDataFrame(active, "g long, p long")
        on = [prefix == F.col("p")] if active[0][0] < 0 else [prefix == F.col("p"), F.col("_h") == F.col("g")]
        rows = rows.join(F.broadcast(wanted), on)
    got = rows.groupBy("g", F.shiftright(column, shift - step).alias("cell")).agg(F.sum("_bytes").alias("b"), F.count("*").alias("n")).collect()
    out: dict = {}
    for r in got:
        out.setdefault((r["g"], -1 if active[0][1] < 0 else r["cell"] >> step), []).append((r["cell"], int(r["b"]), int(r["n"])))
    return {k: sorted(v) for k, v in out.items()}


def splitters(keys: DataFrame, n: int, tolerance: float, parts: int = 1) -> list[tuple[int, int, int, int]]:
    """n - 1 rising boundaries (h, e, bytes below, rows below): rows with a key >= (h, e) lie behind.

    ``keys`` has _h and _e (63 bits each) and _bytes. Every boundary lies within its slack of
    the even division, or within the bytes of one indivisible key; every ``parts``-th one
    is a boundary between shards, with more slack.
    """
    total = keys.agg(F.coalesce(F.sum("_bytes"), F.lit(0)).alias("b")).first()["b"]
    goals = [total * i // n for i in range(1, n)]
    inner, outer = tolerance * total / n, min(tolerance * total * parts / n, max(tolerance, 0.25) * total / n)
    slack = [int(outer if i % parts == 0 else inner) for i in range(1, n)]
    state = [(-1, -1, 0, 0)] * len(goals)  # group, prefix, bytes and rows below
    done: dict[int, tuple[int, int, int, int]] = {}
    shift, column = BITS, "_h"
    while len(done) < len(goals):
        step = min(TOP if shift == BITS else STEP, shift)
        open_ = [i for i in range(len(goals)) if i not in done]
        found = _cells(keys, sorted({state[i][:2] for i in open_}), column, shift, step)
        shift -= step
        for i in open_:
            g, p, below, rows = state[i]
            for cell, b, k in found.get((g, p), []):
                if below + b >= goals[i] or (cell, b, k) == found[g, p][-1]:
                    last = column == "_e" and shift == 0
                    if b <= slack[i] or last:
                        near = goals[i] - below > below + b - goals[i] and (cell + 1) << shift < 2**BITS
                        at = (cell + 1 if near else cell) << shift
                        key = (at, 0) if column == "_h" else (g, at)
                        done[i] = (*key, below + b * near, rows + k * near)
                    state[i] = (g, cell, below, rows)
                    break
                below, rows = below + b, rows + k
            else:  # no rows at all
                done[i] = (2**BITS - 1, 2**BITS - 1, below, rows)
        if shift == 0 and column == "_h" and len(done) < len(goals):
            # single groups beyond the tolerance: go on by id inside them
            state = [(s[1], -1, *s[2:]) for s in state]
            column, shift = "_e", BITS
            open_ = [i for i in range(len(goals)) if i not in done]
            groups = sorted({state[i][0] for i in open_})
            keys = keys.join(F.broadcast(keys.sparkSession.createDataFrame([(g,) for g in groups], "_h long")), "_h")
            found = {}
            top = keys.groupBy("_h", F.shiftright("_e", BITS - TOP).alias("cell")).agg(F.sum("_bytes").alias("b"), F.count("*").alias("n")).collect()
            for r in top:
                found.setdefault(r["_h"], []).append((r["cell"], int(r["b"]), int(r["n"])))
            shift -= TOP
            for i in open_:
                g, _, below, rows = state[i]
                for cell, b, k in sorted(found[g]):
                    if below + b >= goals[i] or (cell, b, k) == sorted(found[g])[-1]:
                        if b <= slack[i]:
                            near = goals[i] - below > below + b - goals[i] and (cell + 1) << shift < 2**BITS
                            done[i] = (g, (cell + near) << shift, below + b * near, rows + k * near)
                        state[i] = (g, cell, below, rows)
                        break
                    below, rows = below + b, rows + k
    return [done[i] for i in range(len(goals))]


def shard(df: DataFrame, size: Column, group: Column, doc_id: str = "doc_id", shards: int = 8, parts: int | None = None, tolerance: float = 0.002) -> DataFrame:
    """``df`` with shard (0 to shards - 1) and slot (gapless from 0), bytes nearly equal over the shards."""
    spark = df.sparkSession
    parts = parts or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")) // shards)
    h = F.shiftrightunsigned(F.xxhash64(group.isNull(), group), 1)
    e = F.shiftrightunsigned(C.key_of(doc_id).bitwiseXOR(F.lit(C.NULL_ID)), 1)
    keep = [c for c in df.columns if c not in {"_h", "_e", "_id", "_bytes", "shard", "slot"}]
    rows = C.written(df.select(*[F.col(f"`{c}`") for c in keep], h.alias("_h"), e.alias("_e"), C.key_of(doc_id).alias("_id"), size.cast("long").alias("_bytes")))
    bounds = splitters(rows.select("_h", "_e", "_bytes"), shards * parts, tolerance, parts)
    # boundary number: boundaries in earlier cells of the key space, and those passed in the row's own cell
    shift = BITS - TOP
    cells: dict[int, list[tuple[int, int]]] = {}
    for hb, eb, _, _ in bounds:
        cells.setdefault(hb >> shift, []).append((hb, eb))
    base, table = 0, []
    for c in range(2**TOP):
        table.append((c, base, cells.get(c, [])))
        base += len(cells.get(c, []))
    lookup = spark.createDataFrame(table, "_cell int, _base int, _at array<struct<h:long,e:long>>")  # 4096 rows
    starts = [(0, 0)] + [(b, r) for _, _, b, r in bounds]
    places = spark.createDataFrame([(i, i // parts, starts[i][1] - starts[i // parts * parts][1]) for i in range(shards * parts)], "_part int, shard int, _first long")
    dealt = rows.join(F.broadcast(lookup), F.shiftright("_h", shift).cast("int") == F.col("_cell"))
    dealt = dealt.withColumn("_part", F.expr("_base + size(filter(_at, x -> x.h < _h or (x.h = _h and x.e <= _e)))"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy("_h", "_e", "_id")) - 1
    out = dealt.withColumn("_rank", rank).join(F.broadcast(places), "_part")
    return out.select(*[F.col(f"`{c}`") for c in keep], "shard", (F.col("_first") + F.col("_rank")).cast("long").alias("slot"))
