"""Licence recognition by sentence rules.

A text is cut into pieces at line ends and at full stops, exclamation and
question marks that white space follows. Pieces are normalised (lower case, runs
of anything but letters, digits, dots and plus signs to one space), and those of
wrapped lines join to sentences again: a sentence ends at a stop, at a line without letters or
digits and behind an SPDX line; a list's number belongs to what follows it. Sentences
are searched for sentence patterns, each with an identifier; of overlapping
matches the longest counts. The identifiers of a text, in
order, are matched against licence rules, longest rule first, from left to right.
A rule is an ordered list of identifiers that must follow each other, with at
most ``gap`` unrecognised sentences between two of them. A recognised sentence that
no rule takes is reported as UNKNOWN unless it is a lone copyright notice or the start
'neither the name of', and so is one about licensing; all else is dropped. Places are those of whole pieces.

Only texts that hold one of a few trigger words are cut at all.

Edge cases: null and empty texts have no sentences and no licence; texts of any
length are read whole; repeated rows are judged each; null ids pass through; an
empty table gives an empty table; extra columns don't matter, as the result
holds only its own columns.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import common as C

_UNDER = r"\b(?:(?:licen[sc]ed|released|distributed|redistributed|available|provided|published|governed|covered) (?:under|by)|under|subject to)(?: the| a| an)?(?: terms(?: and conditions)? of)?(?: the| a| an)?"
_VERSION = r"(?: version| v)? ?(?P<version>\d(?:\.\d)?)?"
_LATER = r"(?P<later>\+| (?:and |or )?(?:at your option )?any later version| or (?:newer|later))?"
#: Sentence patterns over normalised sentences: identifier, regular expression (searched from the start of a word).
SENTENCES: Sequence[tuple[str, str]] = (
    ("spdx", r"\bspdx license identifier (?P<id>[a-z0-9.+ ]+)"),
    ("cc", _UNDER + r" (?:cc|creative commons) ?(?P<id>by(?: (?:nc|nd|sa))*|attribution(?: non ?commercial| no ?derivatives| no ?derivs| share ?alike)*|zero|0)(?: licen[sc]e)?(?: (?P<version>\d\.\d))?"),
    ("gpl_named", _UNDER + r" (?P<id>(?:gnu )?(?:lesser |library |affero )?general public license|(?:gnu )?(?:agpl|lgpl|gpl))(?: licen[sc]e)?(?: as published by the free software foundation)?(?: either)?" + _VERSION + r"(?: of the license)?" + _LATER),
    ("mit_named", _UNDER + r" (?:mit|expat)(?: x11)? licen[sc]e"),
    ("apache_named", _UNDER + r" apache(?: software)?(?: public)? licen[sc]e" + _VERSION),
    ("mpl_named", _UNDER + r" mozilla public licen[sc]e" + _VERSION),
    ("epl_named", _UNDER + r" eclipse public licen[sc]e" + _VERSION),
    ("boost_named", _UNDER + r" boost software licen[sc]e" + _VERSION),
    ("isc_named", _UNDER + r" isc licen[sc]e"),
    ("zlib_named", _UNDER + r" zlib(?: libpng)? licen[sc]e"),
    ("bsd_named", _UNDER + r" (?:(?P<version>[234]) ?clause )?(?:new |modified |simplified |revised )?bsd(?: (?P<clauses>[234]) ?clause)?(?: style)? licen[sc]e"),
    ("mit_grant", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit_notice", r"the above copyright notice and this permission notice shall be included in all copies"),
    ("as_is", r"(?:the|this) software is provided (?:by .*?)?as is"),
    ("isc_grant", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("zlib_grant", r"permission is granted to anyone to use this software for any purpose including commercial applications"),
    ("zlib_origin", r"(?:\d\.? )?the origin of this software must not be misrepresented"),
    ("boost_grant", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("unlicense", r"this is free and unencumbered software released into the public domain"),
    ("cc0_waiver", r"to the extent possible under law .{0,200}?waived all copyright and related or neighboring rights"),
    ("bsd_grant", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd_source", r"(?:\d\.? )?redistributions of source code must retain the above copyright notice"),
    ("bsd_binary", r"(?:\d\.? )?redistributions in binary form must reproduce the above copyright notice"),
    ("bsd_endorse", r"(?:\d\.? )?neither the name of"),
    ("apache_comply", r"you may not use this file except in compliance with the license"),
    ("apache_copy", r"you may obtain a copy of the license at"),
    ("gpl_modify", r"(?:this (?:program|library|software|file) is free software )?you can redistribute it and or modify it under the terms of the gnu (?P<id>lesser |library |affero )?general public license(?: as published by the free software foundation)?(?: either)?(?: version (?P<version>\d(?:\.\d)?))?(?: of the license)?(?P<later> or at your option any later version)?"),
    ("gpl_warranty", r"this (?:program|library|software|file) is distributed in the hope that it will be useful"),
    ("reserved", r"\ball rights reserved"),
    ("copyright", r"copyright(?: c)? \d{4}"),
)
#: Licence rules: name, identifiers in their order. Names may hold what a sentence's pattern found.
RULES: Sequence[tuple[str, tuple[str, ...]]] = (
    ("SPDX:{id}", ("spdx",)),
    ("CC-{id}-{version}", ("cc",)),
    ("GPL-{id}-{version}{later}", ("gpl_named", "gpl_warranty")),
    ("GPL-{id}-{version}{later}", ("gpl_named",)),
    ("GPL-{id}-{version}{later}", ("gpl_modify", "gpl_warranty")),
    ("GPL-{id}-{version}{later}", ("gpl_modify",)),
    ("MIT", ("mit_grant", "mit_notice", "as_is")),
    ("MIT", ("mit_grant", "mit_notice")),
    ("MIT", ("mit_named",)),
    ("Apache-{version}", ("apache_named", "apache_comply", "apache_copy")),
    ("Apache-{version}", ("apache_named", "apache_comply")),
    ("Apache-{version}", ("apache_named",)),
    ("MPL-{version}", ("mpl_named",)),
    ("EPL-{version}", ("epl_named",)),
    ("BSL-{version}", ("boost_named",)),
    ("BSL-1.0", ("boost_grant", "as_is")),
    ("BSL-1.0", ("boost_grant",)),
    ("ISC", ("isc_grant", "as_is")),
    ("ISC", ("isc_grant",)),
    ("ISC", ("isc_named",)),
    ("Zlib", ("as_is", "zlib_grant", "zlib_origin")),
    ("Zlib", ("zlib_grant", "zlib_origin")),
    ("Zlib", ("zlib_named",)),
    ("Unlicense", ("unlicense",)),
    ("CC0-1.0", ("cc0_waiver",)),
    *((name, (*before, *core, *after)) for name, core in (("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse")), ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary"))) for before in ((), ("reserved",), ("copyright", "reserved")) for after in ((), ("as_is",))),
    ("BSD-{version}-Clause", ("bsd_named",)),
    ("proprietary", ("copyright", "reserved")),
    ("proprietary", ("reserved",)),
)
#: Every sentence pattern, and _ABOUT, holds one of these, whatever stands between its words.
TRIGGER = re.compile(r"licen[sc]|copyright|spdx|redistribut|hereby|neither|gpl|gnu|creative|unencumbered|misrepresented|(?<![a-z0-9.+])cc(?:0|(?![a-z0-9.+]))|(?:all[^a-z0-9.+]+rights|as[^a-z0-9.+]+is|hope[^a-z0-9.+]+that|granted[^a-z0-9.+]+to[^a-z0-9.+]+anyone)", re.I)
_CUT = re.compile(r"\n|(?<=[.!?])\s+")
_SPLIT_WORDS = re.compile(r"[^a-z0-9.+]+")
_ABOUT = re.compile(r"\blicen[sc]ed? (?:under|by|to)\b|\ball rights\b")
_PATTERNS = [*((name, re.compile(p)) for name, p in SENTENCES), ("about", _ABOUT)]
_STOPS = {".", "!", "?"}
_NUMBER = re.compile(r"[0-9]{1,2}|[a-z]")
_LINE = "spdx license identifier"
_WEAK = {"copyright", "bsd_endorse"}  # alone they say nothing of a licence
_RULES = sorted(RULES, key=lambda r: -len(r[1]))


def pieces(text: str) -> list[tuple[str, int, int, bool]]:
    """Normalised pieces, their places in the text, and whether a sentence ends behind them.

    A piece without letters and digits is empty and ends a sentence.
    """
    out, at = [], 0
    for cut in [*_CUT.finditer(text), None]:
        end = cut.start() if cut else len(text)
        plain = _SPLIT_WORDS.sub(" ", text[at:end].lower()).strip(" .")
        stop = not plain or (text[at:end].rstrip()[-1:] in _STOPS and not _NUMBER.fullmatch(plain)) or _LINE in plain
        out.append((plain, at, end, stop))
        at = cut.end() if cut else end
    return out


def sentences(text: str) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Normalised sentences, each with its pieces: where they start in it, and their places in the text."""
    out, words, parts, size = [], [], [], 0
    for plain, at, end, stop in pieces(text):
        if plain:
            words.append(plain)
            parts.append((size, at, end))
            size += len(plain) + 1
        if stop and parts:
            out.append((" ".join(words), parts))
            words, parts, size = [], [], 0
    return out + [(" ".join(words), parts)] * bool(parts)


def recognise(plain: str) -> list[tuple[str, dict[str, str], int, int]]:
    """Identifiers in a normalised sentence, what their patterns found, and where; of overlapping matches the longest stays."""
    found = [(m.end() - m.start(), k, m, name) for k, (name, p) in enumerate(_PATTERNS) for m in p.finditer(plain)]
    taken = []
    for _, _, m, name in sorted(found, key=lambda f: (f[3] == "about", -f[0], f[1])):
        if all(m.end() <= lo or m.start() >= hi for _, _, lo, hi in taken):
            taken.append((name, {k: v or "" for k, v in m.groupdict().items()}, m.start(), m.end()))
    return sorted(taken, key=lambda t: t[2])


#: Names of families, in the form the rules print.
FAMILIES = {"": "GPL", "gpl": "GPL", "lesser": "LGPL", "library": "LGPL", "lgpl": "LGPL", "affero": "AGPL", "agpl": "AGPL"}
#: Words of Creative Commons names, in the form the rules print.
TERMS = {"attribution": "BY", "by": "BY", "noncommercial": "NC", "nc": "NC", "noderivatives": "ND", "noderivs": "ND", "nd": "ND", "sharealike": "SA", "sa": "SA", "zero": "0", "0": "0"}


def _name(rule: str, found: dict[str, str]) -> str:
    kind = found.get("id", "").strip()
    if rule.startswith("GPL-{id}"):
        kind = kind.removeprefix("gnu").strip().removesuffix("general public license").strip()
        rule, kind = rule.removeprefix("GPL-"), FAMILIES.get(kind, kind)
    elif rule.startswith("CC-"):
        words = re.sub(r"\b(non?|share) ", r"\1", kind).split()
        kind = "-".join(TERMS.get(w, w.upper()) for w in words)
        rule = "CC{id}-{version}" if kind == "0" else rule
    version = (found.get("version") or found.get("clauses") or "").strip()
    out = rule.format(id=kind, version=version, later="-or-later" if found.get("later") else "")
    return re.sub(r"-(?=-|$)", "", out.replace(" ", "-"))


def scan_text(text: str | None, gap: int = 1) -> list[dict]:
    """Licences of a text in order: name, identifiers, and the characters they cover."""
    if not text or not TRIGGER.search(text):
        return []
    seen = []  # identifier, what was found, from, to
    for plain, parts in sentences(text):
        starts = [p[0] for p in parts]
        hits = recognise(plain)
        for name, found, lo, hi in hits:
            seen.append((name, found, parts[bisect_right(starts, lo) - 1][1], parts[bisect_right(starts, hi - 1) - 1][2]))
        if not hits:
            seen.append((None, {}, parts[0][1], parts[-1][2]))
    out, at = [], 0
    while at < len(seen):
        if seen[at][0] in (None, "about"):
            if seen[at][0]:
                out.append({"name": "UNKNOWN", "sentences": [], "from": seen[at][2], "to": seen[at][3]})
            at += 1
            continue
        for rule, want in _RULES:
            k, missed, found = at, 0, {}
            took = []
            while k < len(seen) and len(took) < len(want) and missed <= gap:
                name = seen[k][0]
                if name == want[len(took)]:
                    took.append(k)
                    found = {**seen[k][1], **{n: v for n, v in found.items() if v}}
                    missed = 0
                elif name not in (None, "about"):
                    break
                else:
                    missed += 1
                k += 1
            if len(took) == len(want):
                out.append({"name": _name(rule, found), "sentences": list(want), "from": seen[at][2], "to": seen[took[-1]][3]})
                at = took[-1] + 1
                break
        else:
            if seen[at][0] not in _WEAK:
                out.append({"name": "UNKNOWN", "sentences": [seen[at][0]], "from": seen[at][2], "to": seen[at][3]})
            at += 1
    return out


FOUND = "array<struct<name:string,sentences:array<string>,`from`:int,`to`:int>>"


def _scan(gap: int):
    kind = pa.list_(pa.struct([("name", pa.string()), ("sentences", pa.list_(pa.string())), ("from", pa.int32()), ("to", pa.int32())]))

    def run(batches):
        for whole in batches:
            for b in C.sliced(whole, "text", 2**24):
                found = [scan_text(t, gap) for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, kind)], ["doc_id", "found"])

    return run


def scan(docs: DataFrame, gap: int = 1, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, found, licenses, n_found): matched rules in order, and their distinct names sorted."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = rows.mapInArrow(_scan(gap), f"doc_id {docs.schema[doc_id].dataType.simpleString()}, found {FOUND}")
    return found.withColumn("licenses", F.array_sort(F.array_distinct(F.transform("found", lambda x: x["name"])))).withColumn("n_found", F.size("found").cast("long"))
