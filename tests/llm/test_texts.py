"""Operators on texts against brute force, and their edge cases."""

import collections
import hashlib
import random
import re

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return WORD.findall(t or "")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def odd_rows():
    """Nulls, empty texts, a very long one, repeated rows, ties."""
    rng = random.Random(5)
    shared = prose(rng, 40)
    return [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n\x0b ", "en", None, 4), (None, "null id " + shared, "en", "a", 9),
        (4, shared, "en", "a", 1), (5, "X " + shared + " y", "en", "a", 1), (6, shared, None, "b", 1), (6, shared, None, "b", 1),
        (7, prose(rng, 60_000, 5000), "de", "a", 1), (8, "one two three", "en", "b", 1), (9, "One  two x three", "en", "b", 1), (-3, shared.upper(), "en", "b", 1),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# ---------------------------------------------------------------- substring
def brute_repeats(rows, width=20):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - width + 1):
            first.setdefault(tuple(w[k : k + width]), (i, k))
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] != (i, k):
                gone.update(range(k, k + width))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def test_substring_against_brute_force(spark, odd):
    from quire.llm.substring import remove_repeats

    got = remove_repeats(odd).select("doc_id", "n_words", "n_removed", "kept_text").collect()
    assert sorted(map(tuple, got), key=repr) == brute_repeats([(r[0], r[1]) for r in odd_rows()])


def test_substring_random(spark):
    from quire.llm.substring import remove_repeats

    rng = random.Random(1)
    pieces = [prose(rng, rng.randrange(5, 40), 30) for _ in range(30)]
    rows = [(i, " ".join(rng.choices(pieces, k=rng.randrange(0, 6)))) for i in range(120)]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), width=6)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_words", "n_removed", "kept_text").collect()), key=repr) == brute_repeats(rows, 6)


def test_substring_columns(spark, odd, none):
    from quire.llm.substring import remove_repeats

    clash = odd.withColumn("n_words", odd.doc_id).withColumn("_q", odd.doc_id)
    out = remove_repeats(clash)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "_q", "kept_text", "n_words", "n_removed", "removed_spans"]
    r = out.where("doc_id = 5").first()
    assert r.removed_spans[0].asDict() == {"from": 1, "to": 41} and r.lang == "en"
    assert remove_repeats(none).count() == 0


# ---------------------------------------------------------------- minhash
def brute_near(rows, num=85, den=100):
    sets = {}
    for i, t in rows:
        w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in words(t)]
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    low = {i: i for i in sets}
    order = lambda i: (i is not None, i or 0)
    change = True
    ids = sorted(sets, key=order)
    near = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    while change:
        change = False
        for a, b in near:
            m = min(low[a], low[b], key=order)
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                change = True
    return {i: (len(sets[i]), low[i]) for i in sets}


def test_near_duplicates_edges(spark, odd, none):
    from quire.llm.minhash import near_duplicates

    got = near_duplicates(odd.withColumn("component_id", odd.doc_id)).collect()
    assert len(got) == len(odd_rows())
    expected = brute_near([(r[0], r[1]) for r in odd_rows()])
    for r in got:
        assert (r.n_shingles, r.component_id) == expected[r.doc_id]
        assert r.kept == (r.doc_id == r.component_id)
    assert near_duplicates(none).count() == 0


@pytest.mark.parametrize("edits", [(0, 1, 2, 3, 4, 6), (3, 4, 5)])
def test_near_duplicates_of_one_text(spark, edits):
    """Many copies around the bound: most link with the original alone, or with nothing."""
    from quire.llm.minhash import near_duplicates

    rng = random.Random(2)
    base = [f"b{k}" for k in range(150)]
    rows = [(500, " ".join(base))]
    for i in range(160):
        w = list(base)
        for _ in range(rng.choice(edits)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        if i % 9 == 0:
            w = w[1:]
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, prose(rng, 120)) for i in range(20)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == brute_near(rows)


def test_links_off_the_centre(spark):
    """Pairs that link with each other but not with their bucket's centre."""
    from pyspark.sql import functions as F

    from quire.llm import minhash as M

    rng = random.Random(4)
    base = [f"b{k}" for k in range(100)]
    far = list(base)
    for k in (5, 25, 45, 65):
        far[k] = f"x{k}"
    rows = [(1, " ".join(base)), (2, " ".join(far)), (3, " ".join([*far[:99], "z"])), (4, prose(rng, 100))]
    docs = spark.createDataFrame(rows, "doc long, text string")
    pairs = spark.createDataFrame([(2, 1), (3, 1)], "a long, c long")
    tested = M.confirmed(pairs, docs, 5, 85, 100)
    assert not tested.where("linked").count()
    labels = spark.createDataFrame([], "node long, label long")
    assert [tuple(sorted(r)) for r in M.through_centres(tested, labels, 85, 100).select(F.col("a"), F.col("b")).collect()] == [(2, 3)]


# ---------------------------------------------------------------- quality
def test_quality_counts(spark, odd, none):
    from quire.llm.quality import SYMBOLS, judge, signals

    rows = [(r[0], r[1]) for r in odd_rows()] + [(50 + i, t) for i, t in enumerate(["a b c a b c x", "l\nl\n\n \nl", "## a$ b%&|<>", "é ü\na b c d a b c"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in signals(docs.withColumn("t", docs.text)).withColumnRenamed("t", "text").collect():
        w = words(r.text)
        tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        n = collections.Counter(tri)
        cov = {k + j for k, g in enumerate(tri) if n[g] > 1 for j in range(3)}
        lines = [x for x in (r.text or "").split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum((r.text or "").count(s) for s in SYMBOLS), len(lines) - len(set(lines)), len(cov))
    got = judge(odd.withColumn("kept", odd.doc_id))
    assert got.count() == len(odd_rows()) and not got.where("kept and base_failed").count()
    assert judge(none).count() == 0


def test_quality_fences_adapt(spark):
    """In a source whose texts hold many symbols they are no outliers; elsewhere they are."""
    from quire.llm.quality import judge

    rng = random.Random(3)
    plain = lambda: prose(rng, 80, 3000)
    marked = lambda: " ".join(f"{w}##" for w in plain().split())
    rows = [(i, plain(), "en", "clean", 1) for i in range(150)] + [(200 + i, marked(), "en", "code", 1) for i in range(150)] + [(900, marked(), "en", "clean", 1)]
    got = {r.doc_id: r.kept for r in judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not got.pop(900) and all(got.values())


# ---------------------------------------------------------------- licences
def test_licences(spark, odd, none):
    from quire.llm.license import scan, scan_text

    names = lambda t: [f["name"] for f in scan_text(t)]
    mit = 'Copyright (c) 2020 X\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof it. The above copyright notice and this permission notice shall be included in all copies.\nTHE SOFTWARE IS PROVIDED "AS IS".'
    assert names(mit) == ["MIT"]
    assert names("text\nLicensed under CC BY-NC 4.0.\nmore") == ["CC-BY-NC-4.0"]
    assert names("This work is licensed under the GNU General Public License, version 3.") == ["GPL-3"]
    assert names("Licensed under the Apache License, Version 2.0. Released under the MIT License.") == ["Apache-2.0", "MIT"]
    assert names("Redistribution and use in source and binary forms, with or without modification, are permitted. Redistributions of source code must retain the above copyright notice. Redistributions in binary form must reproduce the above copyright notice. Neither the name of X.") == ["BSD-3-Clause"]
    assert names("We licensed under protest.") == ["UNKNOWN"] and names("plain text. nothing here") == [] and names(None) == []
    long = "word " * 200_000 + "\nLicensed under the MIT License.\n"
    assert names(long) == ["MIT"]
    assert scan(odd.withColumn("found", odd.doc_id)).where("n_found > 0").count() == 0 and scan(odd).count() == len(odd_rows())
    assert scan(none).count() == 0


def test_trigger_lets_every_pattern_pass():
    from quire.llm import license as L
    from quire.llm.license import SENTENCES, TRIGGER, scan_text, sentences

    alone = {
        "spdx": ["SPDX-License-Identifier: MIT"],
        "cc": ["Released under CC BY-SA 4.0.", "Available under a Creative Commons Attribution 4.0 grant", "Available under (CC_BY) 4.0"],
        "gpl_named": ["Distributed under the GPL v3 or later", "released under the AGPL", "Governed by the GNU\tGeneral Public License"],
        "mit_named": ["Released under the MIT License"],
        "apache_named": ["Distributed under the Apache Software License 2.0"],
        "mpl_named": ["Subject to the Mozilla Public License 2.0"],
        "bsd_named": ["Governed by a 3-clause BSD license"],
        "epl_named": ["Available under the Eclipse Public License 2.0"],
        "boost_named": ["Distributed under the Boost Software License, Version 1.0"],
        "isc_named": ["Licensed under the ISC license"],
        "zlib_named": ["Provided under the zlib/libpng License"],
        "isc_grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
        "zlib_grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications"],
        "zlib_origin": ["1. The origin of this software must not be misrepresented"],
        "boost_grant": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation"],
        "unlicense": ["This is free and unencumbered software released into the public domain"],
        "cc0_waiver": ["To the extent possible under law, X has waived all copyright and related or neighboring rights"],
        "mit_grant": ["Permission  is hereby granted, free of charge, to any person obtaining a copy"],
        "mit_notice": ["The above copyright notice and this permission notice shall be included in all copies"],
        "as_is": ["The software is provided AS-IS", "This software is provided by X 'as  is'"],
        "bsd_grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted"],
        "bsd_source": ["Redistributions of source code must retain the above copyright notice"],
        "bsd_binary": ["Redistributions in binary form must reproduce the above copyright notice"],
        "bsd_endorse": ["Neither the name of X"],
        "apache_comply": ["You may not use this file except in compliance with the License"],
        "apache_copy": ["You may obtain a copy of the License at"],
        "gpl_modify": ["you can redistribute it and/or modify it under the terms of the GNU General Public License"],
        "gpl_warranty": ["This program is distributed in the hope that it will be useful"],
        "reserved": ["All  rights reserved"],
        "copyright": ["Copyright (c) 2020"],
    }
    assert set(alone) == {name for name, _ in SENTENCES}
    for name, texts in alone.items():
        for t in texts:
            assert TRIGGER.search(t) and dict(L._PATTERNS)[name].search(sentences(t)[0][0]), t
    names = [[f["name"] for f in scan_text(t)] for t in (*alone["cc"][:2], *alone["gpl_named"][:2])]
    assert names == [["CC-BY-SA-4.0"], ["CC-BY-4.0"], ["GPL-3-or-later"], ["AGPL"]]


def test_named_licences():
    from quire.llm.license import scan_text

    for text, name in (
        ("Released under CC BY 4.0.", "CC-BY-4.0"), ("This dataset is released under Creative Commons Attribution 4.0.", "CC-BY-4.0"), ("Under a Creative Commons Attribution-NonCommercial-ShareAlike 3.0 licence", "CC-BY-NC-SA-3.0"),
        ("Available under CC0 1.0", "CC0-1.0"), ("This code is released under the GPL version 3 or later.", "GPL-3-or-later"), ("Distributed under the terms of GPL v2.", "GPL-2"), ("Available under the terms of the LGPL.", "LGPL"),
        ("Licensed under the GNU GPL v3.", "GPL-3"), ("under the GNU Library General Public License, version 2.1 or any later version", "LGPL-2.1-or-later"), ("Licensed under the 3-Clause BSD License", "BSD-3-Clause"), ("Licensed under the BSD 2-Clause License", "BSD-2-Clause"),
        ("Distributed under the Boost Software License, Version 1.0.", "BSL-1.0"), ("under the Eclipse Public License v2.0", "EPL-2.0"),
        ('Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that it stays.\n\nTHE SOFTWARE IS PROVIDED "AS IS".', "ISC"),
        ("This software is provided 'as-is'. In no event will the authors be liable. Permission is granted to anyone to use this software for any purpose, including commercial applications. 1. The origin of this software must not be misrepresented.", "Zlib"),
        ("This is free and unencumbered software released into the public domain.", "Unlicense"),
    ):
        assert [f["name"] for f in scan_text(f"Some text.\n\n{text}\n\nmore")] == [name], text


def test_licences_against_brute_force(spark):
    """Texts put together from known sentences: all rules tried at all places of the known identifiers."""
    from quire.llm.license import _WEAK, RULES, scan

    said = {
        "mit_grant": "Permission is hereby granted, free of charge, to any person obtaining a copy.", "mit_notice": "The above copyright notice and this permission notice shall be included in all copies.", "as_is": 'The software is provided "as is".',
        "bsd_grant": "Redistribution and use in source and binary forms, with or without modification, are permitted.", "bsd_source": "Redistributions of source code must retain the above copyright notice.",
        "bsd_binary": "Redistributions in binary form must reproduce the above copyright notice.", "bsd_endorse": "Neither the name of X.", "apache_comply": "You may not use this file except in compliance with the License.", "reserved": "All rights reserved.",
        "copyright": "Copyright (c) 2020 X.", "gpl_warranty": "This program is distributed in the hope that it will be useful.", "zlib_grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications.", None: "Plain words stand here.",
    }
    rng, rows, expected = random.Random(12), [], {}
    for i in range(300):
        ids = [rng.choice([*said, "mit_grant", "mit_notice", None]) for _ in range(rng.randrange(0, 9))]
        rows.append((i, " ".join(said[x] for x in ids)))
        out, at = [], 0
        while at < len(ids):
            fits = []
            for name, want in RULES:
                for skips in range(2 ** (len(want) - 1)):  # one unknown sentence or none before each but the first
                    line = [want[0]]
                    for k, w in enumerate(want[1:]):
                        line += [None, w] if skips >> k & 1 else [w]
                    if ids[at : at + len(line)] == line:
                        fits.append((len(want), len(line), name, want))
            if fits:
                _, n, name, want = max(fits, key=lambda f: f[0])
                out.append((name, list(want)))
                at += n
            else:
                out += [("UNKNOWN", [ids[at]])] if ids[at] is not None and ids[at] not in _WEAK else []
                at += 1
        expected[i] = out
    got = {r.doc_id: [(f["name"], f["sentences"]) for f in r.found] for r in scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == expected and sum(n != "UNKNOWN" for x in expected.values() for n, _ in x) > 80


def test_wrapped_licences():
    from quire.llm.license import scan_text

    names = lambda t: [f["name"] for f in scan_text(t)]
    mit = """MIT License

Copyright (c) 2020 X Y

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED.
"""
    bsd = """Copyright (c) 2020, X
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse products.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS
IS" AND ANY EXPRESS WARRANTIES ARE DISCLAIMED.
"""
    gpl = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY.
"""
    apache = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0
"""
    for text, name in ((mit, "MIT"), (bsd, "BSD-3-Clause"), (gpl, "GPL-3-or-later"), (apache, "Apache-2.0")):
        comment = "".join(f" * {line}\n" for line in text.split("\n"))
        for t in (text, comment, text.replace("\n", "\r\n")):
            assert names(f"before\n\n{t}\nafter") == [name]
    assert len(scan_text(apache)[0]["sentences"]) == 3
    assert names("SPDX-License-Identifier: MIT\nint x") == ["SPDX:mit"]
    lone = "Permission is hereby granted, free of charge, to any person\nobtaining a copy."
    assert scan_text(f"x.\n{lone}\n\ny") == [{"name": "UNKNOWN", "sentences": ["mit_grant"], "from": 3, "to": 3 + len(lone)}]
    assert names('The software is provided "as is".') == ["UNKNOWN"] and names("Copyright 2020 X") == []


def test_words_agree(spark):
    import numpy as np
    import pyarrow as pa

    from quire.llm import common as C

    texts = ["a bb\tccc", None, "", " lead and trail \n", "é x y\x1cz", "a"]
    w = C.Words(pa.array(texts))
    assert w.counts.tolist() == [len(words(t)) for t in texts]
    h = w.hashes(block=4)
    assert h[0] == h[-1] and len(set(h.tolist())) == len({x for t in texts for x in words(t)})
    x = np.arange(1, 60, dtype=np.uint64)
    with np.errstate(over="ignore"):
        assert len(C.windows(x, 20)) == 40 and C.windows(x, 60).size == 0
        assert (C.windows(np.tile(x, 2), 20)[:40] == C.windows(x, 20)).all()


def test_sha(spark):
    from quire.llm.queries import op2_substring_dedup

    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    kept = {i: k for i, _, _, k in brute_repeats(list(docs.items()))}
    got = {r.doc_id: r.kept_sha256 for r in op2_substring_dedup(spark, "/root/testdata/sf0.001").collect()}
    assert got == {i: hashlib.sha256(k.encode()).hexdigest() for i, k in kept.items()}


def test_substring_spacing(spark):
    from quire.llm.substring import remove_repeats

    rows = [(1, " a  b\tc d\ne "), (2, "x\n a b c  d  e \ny\tz"), (3, None), (4, "\n"), (5, "a b c d")]
    got = {r.doc_id: r.kept_text for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), width=4, spacing=True).collect()}
    assert got == {1: " a  b\tc d\ne ", 2: "x y\tz", 3: "", 4: "\n", 5: ""}
