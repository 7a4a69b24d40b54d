"""Operators on whole corpora and on conversations and recordings, and the pipeline."""

import random
import struct
import zlib

import numpy as np
import pytest

from tests.llm.test_texts import SCHEMA, brute_near, brute_repeats, odd_rows, prose, words

PATH = __import__("public_tokenizers").path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# ---------------------------------------------------------------- mixing
def brute_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    rest, free, out = share * sum(sizes.values()), {s for s in order if sizes[s]}, {s: 0.0 for s in order}
    while free:
        over = {s for s in free if rest * w[s] / sum(w[x] for x in free) > cap * sizes[s]}
        if not over:
            for s in free:
                out[s] = rest * w[s] / sum(w[x] for x in free)
            break
        for s in over:
            out[s] = cap * sizes[s]
            rest -= out[s]
        free -= over
    return out


def test_mixing(spark, odd, none):
    from quire.llm.mixing import mix, taken_words

    rng = random.Random(9)
    rows = odd_rows() + [(1000 + i, prose(rng, rng.randrange(0, 900)), "en", rng.choice(["a", "a", "a", "b", "é", "𝄞", "Z", None]), 1) for i in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = taken_words(mix(docs.withColumn("size", docs.doc_id), bucket_rows=40)).collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(words(r[1]))
    targets = brute_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - targets[r.source]) < 1e-6 and r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s, t in targets.items():
        assert abs(taken[s] - t) <= max(64, 0.01 * t)
    for s, t in targets.items():  # to the word
        assert abs(taken[s] - t) <= 0.5 + 1e-6
    from pyspark.sql import functions as F

    tied = docs.union(spark.createDataFrame([(r[0], f"{r[1]} more", *r[2:]) for r in rows[:40]], SCHEMA))  # ids that other texts have too
    key = lambda d: sorted((tuple(r) for r in taken_words(mix(d, bucket_rows=40)).collect()), key=repr)
    assert key(tied) == key(tied.repartition(5)) == key(tied.orderBy(F.rand(3)))
    assert taken_words(mix(none)).count() == 0


def test_mixture_shards(spark):
    from pyspark.sql import functions as F

    from quire.llm.mixing import mix

    rng = random.Random(10)
    m = mix(spark.createDataFrame([(i, prose(rng, 300), "en", "ab"[i % 2], 1) for i in range(200)], SCHEMA), shard_slots=64)
    assert m.slots.groupBy("shard", "slot").count().where("count > 1").count() == 0
    assert m.slots.count() == m.draws.agg(F.sum("n")).first()[0]
    spread = [r.n for r in m.draws.where("sid = 0").collect()]
    assert 3 < np.std(spread) < 60  # counts vary from shard to shard
    uses = m.slots.groupBy("sid", "block_id").count()
    assert uses.agg(F.max("count")).first()[0] <= 2


def test_permutation(spark):
    from quire.llm.mixing import permuted

    for n in (1, 2, 7, 1000):
        df = spark.range(n).selectExpr("id", f"{n}L as n", "3 as k")
        got = [r.id for r in permuted(df, "id", "n", ["k"]).collect()]
        assert sorted(got) == list(range(n)) and (n < 1000 or got != sorted(got))


# ---------------------------------------------------------------- packing
def test_packing_exact_ids(spark, odd, none):
    from tokenizers import Tokenizer

    from quire.llm.packing import pack_documents

    rng = random.Random(3)
    extra = [(2000 + i, t, "en", "a", 1) for i, t in enumerate(["It's <|EndOfText|> x", "<|endoftext|> y,'s 12ab ÅÅ é ß", "İstanbul ΣΑΣ ß ﬁ –—", "x" * 30_000, *[prose(rng, rng.randrange(1, 1500), 10**6) for _ in range(60)]])]
    docs = spark.createDataFrame(odd_rows() + extra, SCHEMA).withColumnRenamed("n_chars", "length")
    got = pack_documents(docs, PATH, keep_ids=True).collect()
    model = Tokenizer.from_file(PATH)
    texts = {r[0]: r[1] for r in odd_rows() + extra}
    by = {}
    for r in got:
        by.setdefault(r.doc_id, {})[r.piece] = r
        assert zlib.crc32(struct.pack(f"<{r.length}I", *r.ids)) == r.ids_crc32 and len(r.ids) == r.length
    assert set(by) == set(texts)
    for i, pieces in by.items():
        ids = model.encode(texts[i] or "", add_special_tokens=False).ids + [1]
        assert [x for k in sorted(pieces) for x in pieces[k].ids] == ids
        assert all(p.start == 4096 * k and (p.length == 4096 or k == max(pieces)) for k, p in pieces.items())
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= 4096
    assert pack_documents(none, PATH).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_solver(seed):
    from quire.llm.packing import solve

    rng = np.random.default_rng(seed)
    c = 512
    count = np.zeros(c + 1, np.int64)
    for v in np.minimum(c, np.maximum(1, rng.lognormal(4, 1.2, [10, 300, 5000][seed % 3]).astype(int))):
        count[v] += 1
    for groups in (4, 2000):
        held = np.zeros_like(count)
        runs = solve(count, c, groups)
        for n, items in runs:
            assert sum(items) <= c
            for v in items:
                held[v] += n
        assert (held == count).all()
    total = int((count * np.arange(c + 1)).sum())
    assert sum(n for n, _ in runs) <= max(-(-total // c) * 1.02 + 1, int(count[c // 2 + 1 :].sum()))


# ---------------------------------------------------------------- toxicity
def labelled(n=600, seed=1):
    rng = random.Random(seed)
    bad = ["trash", "moron", "idiot", "loser", "scum"]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 7 == 0
        w = prose(rng, rng.randrange(30, 200)).split()
        for _ in range(rng.randrange(3, 8) if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(bad) + rng.choice(["", "###", "."]))
        rows.append((i, " ".join(w), "en", "a", 1))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity(spark, odd, none):
    from quire.llm.toxicity import score

    rows, labels = labelled()
    docs = spark.createDataFrame(rows + [(r[0], *r[1:]) for r in odd_rows() if r[0] is None or r[0] < 0], SCHEMA)
    lab = spark.createDataFrame([*labels, (None, 1), (3, None), (7, 1)], "doc_id long, toxic int")
    got = score(docs.withColumn("toxic", docs.doc_id), lab).collect()
    truth = dict(labels)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None) and len(got) == docs.count()
    assert all((r.score >= 0.5) == bool(r.predicted) and 0 <= r.score <= 1 for r in got)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held if r.doc_id in truth]) > 0.98
    # held-out labels are never read
    flipped = spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels], "doc_id long, toxic int")
    plain = spark.createDataFrame(labels, "doc_id long, toxic int")
    key = lambda d: sorted((r.doc_id or -1, round(r.score, 9)) for r in d.collect())
    assert key(score(docs, flipped)) == key(score(docs, plain))
    assert score(none, lab).count() == 0 and score(docs, lab.limit(0)).agg({"score": "max"}).first()[0] <= 0.5


def test_block_max_is_exact():
    from quire.llm.toxicity import BlockMaxIndex

    rng = np.random.default_rng(0)
    v = rng.random((500, 40)) * (rng.random((500, 40)) < 0.1)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    index = BlockMaxIndex(v, rng.integers(0, 2, 500), np.ones(500), np.arange(500), block=16)
    for _ in range(60):
        q = rng.random(40) * (rng.random(40) < 0.15)
        t = np.flatnonzero(q)
        _, s = index.nearest(t, q[t], 7)
        best = np.sort(v @ q)[::-1][:7]
        assert np.allclose(s, best[best > 0][: len(s)]) and len(s) == min(7, (best > 0).sum())


def test_toxicity_against_brute_force(spark):
    """Neighbours, cosines and scores from all pairs of whole vectors in plain Python."""
    import math
    import re
    from collections import Counter

    from quire.llm.toxicity import platt, score

    rows, labels = labelled(160, 5)
    rng = random.Random(6)
    spelled = str.maketrans("0123456789", "abcdefghij")
    rows = [(i, t.translate(spelled) if i % 4 else t, *r) for i, t, *r in rows]  # a fourth has one stem beside the marked ones: many ties
    rows += [(500 + i, rows[i][1], "en", "a", 1) for i in range(0, 20, 3)] + [(600, None, None, None, None), (601, "12 34", "en", "a", 1), (602, "Wörtchen ÉTÉ été " + prose(rng, 3000).translate(spelled), "fr", "b", 1)]
    labels = [*labels, (500, 0), (501, 1), (602, 0)]
    k, texts, y = 7, {r[0]: r[1] or "" for r in rows}, {i: v for i, v in labels if zlib.crc32(str(i).encode()) % 5 and i in {r[0] for r in rows}}
    bags = {i: Counter(zlib.crc32(w[:4].encode()) % 2**20 for w in re.findall(r"[^\W\d_]+", t.lower())) for i, t in texts.items()}
    df = Counter(w for b in bags.values() for w in b)
    unit = {}
    for i, b in bags.items():
        v = {w: n * math.log((1 + len(texts)) / (1 + df[w])) for w, n in b.items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        unit[i] = {w: x / size for w, x in v.items() if x > 0}
    read = {i: v for i, v in labels if zlib.crc32(str(i).encode()) % 5}  # labels without a document count in the base rate
    base = sum(read.values()) / len(read)

    def near(i):
        cos = [(sum(x * unit[j][w] for w, x in unit[i].items() if w in unit[j]), j) for j in y if texts[j] != texts[i]]
        return sorted(((round(c, 12), j, c) for c, j in cos if c > 0), key=lambda t: (-t[0], t[1]))[:k]

    def vote(i):
        got = near(i)
        mean = sum(c for *_, c in got) / max(1, len(got))
        return (sum(c * y[j] for _, j, c in got) + mean * base) / (sum(c for *_, c in got) + mean) if got else None

    own = [(vote(j), y[j]) for j in sorted(y)]
    a, b = platt(np.array([v for v, _ in own]), np.array([t for _, t in own], float), np.ones(len(own)))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = {r.doc_id: r for r in score(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), k=k).collect()}
    assert set(got) == set(texts)
    for i, r in got.items():
        v = vote(i)
        assert abs(r.score - (base if v is None else 1 / (1 + math.exp(-(a * math.log(v / (1 - v)) + b))))) < 1e-9
        assert r.evidence == [j for _, j, _ in near(i)[:5]] and np.allclose(r.cosines, [c for *_, c in near(i)[:5]], rtol=0, atol=1e-9)


# ---------------------------------------------------------------- sharding
def test_sharding(spark, odd, none):
    from pyspark.sql import functions as F

    from quire.llm.sharding import shard

    rng = random.Random(4)
    hot = prose(rng, 60)
    rows = odd_rows()[:4] + [(100 + i, hot if i % 3 == 0 else f"{i} {prose(rng, rng.randrange(1, 120))}", "en", "a", 1) for i in range(3000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    got = shard(docs.withColumn("shard", F.lit("x")).withColumn("slot", F.lit("y")), size, F.col("text")).select("doc_id", "text", "shard", "slot").collect()
    assert len(got) == len(rows)
    load, slots, groups = [0] * 8, [[] for _ in range(8)], {}
    for r in got:
        load[r.shard] += len((r.text or "").encode()) + 1
        slots[r.shard].append(r.slot)
        groups.setdefault(r.text, set()).add(r.shard)
    assert max(load) / min(load) < 1.03
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    assert sum(len(s) > 1 for s in groups.values()) <= 1  # the hot group alone is split
    twice = docs.union(docs.where("doc_id % 5 = 0").withColumn("text", F.lit(hot)))  # ids and texts that repeat, and neighbours among the ids
    key = lambda d: sorted(((r.doc_id, r.text, r.shard, r.slot) for r in shard(d, size, F.col("text")).collect()), key=repr)
    assert key(twice) == key(twice.orderBy(F.rand(5))) == key(twice.repartition(3))
    few = shard(odd.limit(3), size, F.col("text")).collect()
    assert len(few) == 3 and shard(none, size, F.col("text")).count() == 0


def test_sharding_against_brute_force(spark):
    """Boundaries, shards and slots from all keys sorted in plain Python."""
    from pyspark.sql import functions as F

    from quire.llm import common as C
    from quire.llm.sharding import shard, splitters

    rng = random.Random(14)
    hot = prose(rng, 80)
    rows = [(i if i % 50 else None, hot if rng.random() < 0.3 else prose(rng, rng.randrange(0, 60), 50), "en", "a", 1) for i in range(2500)]
    docs = spark.createDataFrame(rows, SCHEMA)
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    h, e = F.shiftrightunsigned(F.xxhash64(F.col("text").isNull(), F.col("text")), 1), F.shiftrightunsigned(C.key_of("doc_id").bitwiseXOR(F.lit(C.NULL_ID)), 1)
    keys = docs.select(h.alias("_h"), e.alias("_e"), size.alias("_bytes"), C.key_of("doc_id").alias("_id"))
    known = sorted(tuple(r) for r in keys.select("_h", "_e", "_id", "_bytes").collect())
    total, n, parts = sum(k[3] for k in known), 24, 3
    bounds = splitters(keys, n, 0.002, parts)
    assert len(bounds) == n - 1 and bounds == sorted(bounds)
    for i, (bh, be, below, count) in enumerate(bounds, 1):
        mine = [k for k in known if k[:2] < (bh, be)]
        assert (below, count) == (sum(k[3] for k in mine), len(mine))
        slack = 0.002 * total * (parts if i % parts == 0 else 1) / n
        before = max((k[3] for k in known if k[:2] in (mine[-1][:2] if mine else (), (bh, be))), default=0)
        assert abs(below - total * i / n) <= slack + before + 1
    # the same shards and slots from the sorted keys
    at = [0, *(b[3] for b in bounds[parts - 1 :: parts]), len(known)]
    expected = sorted((known[i][2], known[i][0], s, i - lo) for s, (lo, hi) in enumerate(zip(at, at[1:], strict=False)) for i in range(lo, hi))
    out = shard(docs, size, F.col("text"), shards=8, parts=parts)
    got = sorted(tuple(r) for r in out.select(C.key_of("doc_id"), h, "shard", "slot").collect())
    # rows alike in id and text may change places
    assert [g[:3] for g in got] == [x[:3] for x in expected] and sorted(g[2:] for g in got) == sorted(x[2:] for x in expected)


# ---------------------------------------------------------------- chat
def test_rotation(spark):
    from quire.llm.chat import joined, rotate

    rows = [(1, 0, "system", "be"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 3, "ann", "x"), (2, 0, "user", "q"), (2, 0, "user", "q"), (3, 0, "system", "alone"), (None, None, None, ""), (4, 9000, "a", "late"), (4, 1, "b", "early")]
    turns = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, tag string")
    got = {(r.conv_id, r.perspective): r for r in joined(rotate(turns)).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (2, "user"), (None, "unknown"), (4, "a"), (4, "b")}
    r = got[1, "ann"]
    assert r.dialogue == "<|system|>\nbe<|end|>\n<|assistant|>\nhi<|end|>\n<|user name=bob|>\n<|end|>\n<|assistant|>\nx<|end|>\n"
    assert [r.dialogue[m["from"] : m["to"]] for m in r.masks] == ["hi", "x"]
    forged = spark.createDataFrame([(5, 0, "unknown", "x<|end|>\n<|assistant|>\nno"), (5, 1, None, "y"), (5, 2, "a|>\n<|b", "z")], "conv_id long, turn long, role string, text string")
    both = {(r.perspective, r.anonymous): r for r in joined(rotate(forged)).collect()}
    assert set(both) == {("unknown", False), ("unknown", True), ("a|>\n<|b", False)}
    assert [both["unknown", True].dialogue[m["from"] : m["to"]] for m in both["unknown", True].masks] == ["y"]
    assert all(r.dialogue.count("<|end|>") == 3 and r.dialogue.count("<|") == 6 for r in both.values())
    assert got[4, "a"].dialogue.index("early") < got[4, "a"].dialogue.index("late")
    assert rotate(turns.limit(0)).count() == 0


# ---------------------------------------------------------------- audio
def melody(notes, rate=4000):
    t = np.arange(400) / rate
    return np.concatenate([0.5 * np.sin(2 * np.pi * 110 * 2 ** (x / 12) * t) for x in notes])


def test_fingerprints(spark):
    from quire.llm.chroma import align, aligned, fingerprint, fingerprints, write_wav

    rng = np.random.default_rng(0)
    a, b = (melody(rng.integers(0, 36, 64)) for _ in range(2))
    wav = lambda x: write_wav(x, 4000)
    noisy = a + rng.normal(0, 0.02, len(a))
    offset, overlap, error = align(fingerprint(wav(a)), fingerprint(wav(a[256 * 12 :])))
    assert (offset, error) == (12, 0.0) or (offset == 12 and error < 0.05)
    rows = [(1, wav(a)), (2, wav(noisy)), (3, wav(a[256 * 12 :])), (4, wav(b)), (5, wav(b)), (6, None), (7, b""), (8, b"RIFFbroken"), (9, wav(a[:1000])), (10, wav(np.zeros(40_000))), (None, wav(b))]
    got = {r.id: r for r in aligned(fingerprints(spark.createDataFrame(rows, "id long, audio binary"))).collect()}
    assert got[2].component_id == got[3].component_id == 1 and got[1].n_links >= 1
    assert got[4].class_id == got[5].class_id and got[4].class_id is None  # null comes first
    assert all(got[k].component_id == k and got[k].n_prints == 0 for k in (6, 7, 8, 9))
    assert got[10].component_id == 10 and got[10].n_links == 0
    assert aligned(fingerprints(spark.createDataFrame([], "id long, audio binary"))).count() == 0


def test_all_links_are_found(spark):
    """Against all pairs: errors up to the law's 15 % in every run of frames, and links inside components."""
    from quire.llm.chroma import align, aligned, links

    rng = np.random.default_rng(3)
    prints = []
    for _ in range(6):
        base = rng.integers(1, 2**32, 90, dtype=np.uint32)
        for k in range(6):
            flips = (rng.random((90, 32)) < 0.15) @ (1 << np.arange(32, dtype=np.uint64))
            wrong = base ^ np.where(np.arange(90) % 3 == k % 3, flips.astype(np.uint32), 0 if k < 3 else np.where(np.arange(90) % 2, flips, 0).astype(np.uint32))
            wrong[:2] = 0
            prints.append(wrong[int(rng.integers(0, 70)) if k == 5 else 0 :])
    brute = {}
    for i, x in enumerate(prints):
        for j, y in enumerate(prints[:i]):
            off, over, err = align(y, x)
            if over >= 24 and err <= 0.15:
                brute[j, i] = (off, over, round(err, 9))
    df = spark.createDataFrame([(i, [int(v) for v in x]) for i, x in enumerate(prints)], "id long, print array<long>")
    for size in (500_000, 700):
        got = {}
        for r in links(df, block_ints=size).collect():
            got[r.c, r.a] = (r.offset, r.overlap, round(r.bit_error, 9))
        assert len(brute) > 60 and got == brute
    degree = {r.id: r.n_links for r in aligned(df).collect()}
    assert degree == {i: sum(i in p for p in brute) for i in range(len(prints))}


# ---------------------------------------------------------------- pipeline
def test_pipeline_stages(spark, tmp_path):
    """Each stage against brute force on what the one before it kept."""
    import corpus_pipeline as P
    from quire.llm import common as C

    rows, labels = labelled(200, 2)
    rng = random.Random(8)
    shared = prose(rng, 60, 10**6)
    rows = [(i, t + (f" {shared}" if i % 5 == 1 else ""), "en", "abc"[i % 3], 1) for i, t, *_ in rows] + [(500 + i, rows[i][1], "en", "a", 1) for i in range(1, 20)] + [(700, None, None, None, None), (701, "", "en", "a", 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = [spark.read.parquet(f"{tmp_path}/documents.parquet")]
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "mixing", "packing"]
    for _, stage in P.STAGES:
        kept.append(C.written(stage(spark, kept[-1], str(tmp_path))))
    assert all(d.columns == kept[0].columns for d in kept[:-1])
    texts = [{r.doc_id: r.text for r in d.collect()} for d in kept[:-1]]
    toxic = dict(labels)
    assert not [i for i in texts[1] if toxic.get(i)] and [i for i in texts[0] if i < 200 and not toxic[i] and i not in texts[1]] == []
    near = brute_near(list(texts[1].items()))
    assert set(texts[2]) == {i for i, (_, low) in near.items() if low == i}
    assert sorted((i, t) for i, t in texts[3].items()) == sorted((i, k) for i, _, _, k in brute_repeats(list(texts[2].items())))
    total = sum(len(words(t)) for t in texts[3].values())
    assert abs(sum(len(words(t)) for t in texts[4].values()) - 1.5 * total) < 0.02 * total
    for i, t in texts[4].items():
        assert set(words(t)) <= set(words(texts[3][i])) and len(words(t)) <= 2 * len(words(texts[3][i]))
    assert {r.doc_id for r in kept[5].select("doc_id").distinct().collect()} == set(texts[4])
    assert P.run(spark, str(tmp_path)).count() == kept[5].count()


def test_pipeline_near_bound(spark):
    """The stage links at 0.80: similarities 86 / 106 and 4 / 5 go, 85 / 107 stays."""
    import corpus_pipeline as P

    def edited(name, n, *at):
        w = [f"{name}{k}" for k in range(n)]
        return " ".join(w), " ".join(f"x{k}" if k in at else x for k, x in enumerate(w))

    a, b = edited("a", 100, 30, 60)
    c, _ = edited("c", 93, 0)  # 89 shingles
    d, e = edited("d", 100, 20, 50, 97)
    f = " ".join(f"f{k}" for k in range(9))
    rows = [(1, a), (2, b), (3, c), (4, d), (5, e), (6, f), (7, " ".join(f.split()[:8]))]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], SCHEMA)
    got = {r.doc_id for r in P.near_dedup(spark, docs, "").collect()}
    assert got == {i for i, (_, low) in brute_near(rows, 80).items() if low == i} == {1, 3, 4, 5, 6}


def test_pipeline_without_rows(spark, tmp_path):
    import corpus_pipeline as P

    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_cleanup(spark):
    from quire.llm import common as C

    kept = C.written(spark.range(3))
    assert kept.count() == 3
    C.cleanup(spark)
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist|FileNotFound"):
        kept.count()
