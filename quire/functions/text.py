"""Text predicates and rewrites as column expressions.

Operator names of the design survey stand in the docstrings. Everything is built
in: no Python runs on rows here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.constants import SYMBOLS

# Character classes and word lists that results depend on.
MATH_CLASS = "Α-Ωα-ω⁰-₟℀-⅏←-⇿∀-⋿⌀-⏿⨀-⫿⬀-⯿±×·′″√∞≈≠≤≥∈∂∇∆Δ°∝∑∏⊕⊗⋯"
HARD_MATH = "\\\\^_{}|&<>~=+*/∑∏√≤≥≠≈×±∂∇⊂⊃⊆⊇∈∉∩∪∅⋅∝∞∫"
HEADING_WORDS = "abstract|index terms|keywords|introduction|conclusion(ary)?|method(ology)?|results?|references?|appendix|experiments?"
ROMAN_HEADING = "^(I{1,3}|IV|VI{0,3}|IX|XI{0,3})\\.\\s*[A-Z]"
NUMBER_HEADING = "^\\d{1,2}(\\.\\d{1,2}){0,2}\\.\\s+[A-Z][a-z]"
LETTER_HEADING = "^[A-Z]\\.\\s+[A-Z]"
SENTENCE_END = "[.。！？!?；;:：]\\s*$"
COVER_MARKERS = ("See discussions, stats, and author profiles", "The user has requested enhancement")
FAILED_MARK = "[翻译失败] "
FORMULA_MARK = "（式）"
CJK = "[一-鿿]"


def collapse(t: Column) -> Column:
    """STR-1: white space, Unicode's included, to one space; none at the ends."""
    return F.trim(F.regexp_replace(t, "(?U)\\s+", " "))


def solid(t: Column) -> Column:
    """The text without white space."""
    return F.regexp_replace(t, "(?U)\\s+", "")


def count_of(t: Column, chars: str) -> Column:
    """How many characters of t the class matches."""
    return F.length(t) - F.length(F.regexp_replace(t, chars, ""))


def share_of(t: Column, chars: str) -> Column:
    s = solid(t)
    return F.when(F.length(s) > 0, count_of(s, chars) / F.length(s)).otherwise(0.0)


def math_density(t: Column) -> Column:
    """FLT-10."""
    return share_of(t, f"[\\p{{Sm}}\\p{{Co}}{MATH_CLASS}]")


def line_is_math(t: Column, math_chars: Column) -> Column:
    """FLT-9: most characters are in math fonts, or the density is beyond 0.45."""
    return (math_chars / F.greatest(F.length(t), F.lit(1)) > 0.5) | (math_density(t) > 0.45)


def block_is_math(lines_math: Column, t: Column) -> Column:
    """FLT-11: most lines are math (list of flags), or the density is beyond 0.45; empty text is not."""
    most = F.size(F.filter(lines_math, lambda x: x)) * 2 > F.size(lines_math)
    return (F.length(collapse(t)) > 0) & (most | (math_density(t) > 0.45))


def private_dominant(t: Column) -> Column:
    """FLT-17: private-use characters are half of the text or more."""
    s = solid(t)
    return (F.length(s) > 0) & (count_of(s, "\\p{Co}") >= F.greatest(F.lit(1), F.floor(F.length(s) / 2)))


def is_skip(t: Column) -> Column:
    """FLT-14: no CJK and less than 0.6 letters."""
    return ~t.rlike(CJK) & (count_of(t, "\\p{L}") / F.greatest(F.length(t), F.lit(1)) < 0.6)


def is_heading(t: Column, first: Column) -> Column:
    """FLT-15: at most 110 characters, and the first line starts like a heading."""
    return (F.length(t) <= 110) & (first.rlike(ROMAN_HEADING) | first.rlike(NUMBER_HEADING) | first.rlike(LETTER_HEADING) | first.rlike(f"(?i)^({HEADING_WORDS})\\b"))


def translatable(t: Column, math: Column, ref: Column, skip: Column) -> Column:
    """FLT-16: private-use characters of at most 0.15; an empty text counts."""
    s = solid(t)
    return ~math & ~ref & ~skip & ((F.length(s) == 0) | (count_of(s, "\\p{Co}") / F.greatest(F.length(s), F.lit(1)) <= 0.15))


def math_debris(t: Column) -> Column:
    """FLT-18: a short piece of broken formula: a LaTeX command, or hard math characters with little else."""
    s, core = F.trim(F.regexp_replace(t, "(?U)^\\s+|\\s+$", "")), solid(t)
    hard = core.rlike(f"[{HARD_MATH}]")
    symbols = core.rlike(f"^[\\p{{Sm}}\\p{{Co}}{MATH_CLASS}\\\\{{}}^_\\[\\]|&<>~]+$")
    few = count_of(core, "\\p{L}") <= F.greatest(F.lit(1), F.floor(F.length(core) / 3))
    marks = s.rlike("^[(){}\\[\\]|&^_=+*/<>~.,;:!?'\"`\\\\-]+$") | s.rlike("^[A-Za-z]{1,3}[_^]\\{?[^}]{0,12}\\}?$") | s.rlike("^\\\\?[A-Za-z]{1,2}\\s+[A-Za-z]{1,3}\\s+[A-Za-z]{1,3}$")
    return (F.length(s) > 0) & (F.length(s) <= 40) & (s.rlike("\\\\[A-Za-z]") | (hard & F.when(symbols, few).otherwise(marks & ~s.rlike("\\d{2,}"))))


def numeric_table(t: Column, lines: Column, strict: bool = True) -> Column:
    """FLT-6 (strict) and FLT-7: dense lines of numbers. ``lines`` is the list of the block's lines."""
    least, rows, share, mean, words, digits, floor, marks = (24, 3, 0.35, 5.5, 3, 2, 2, ".,%–\\-−~()") if strict else (6, 1, 0.30, 7.0, 2, 1, 1, ".,%±\\-–—~()<>+")
    s = solid(t)
    parts = F.filter(F.split(collapse(t), " "), lambda w: F.length(w) > 0)
    size = F.aggregate(parts, F.lit(0), lambda a, w: a + F.length(w))
    dense = F.filter(lines, lambda x: (F.size(F.filter(F.split(collapse(x), " "), lambda w: F.length(w) > 0)) >= words) & (count_of(x, "\\p{Nd}") >= digits))
    return (F.length(s) >= least) & (F.size(lines) >= rows) & (count_of(s, f"[\\p{{Nd}}{marks}]") / F.greatest(F.length(s), F.lit(1)) >= share) & (size / F.greatest(F.size(parts), F.lit(1)) <= mean) & (F.size(dense) >= F.greatest(F.lit(floor), F.floor(0.6 * F.size(lines))))


def cjk_share(t: Column) -> Column:
    """FLT-26."""
    return share_of(t, CJK)


def is_cjk(t: Column) -> Column:
    """FLT-24."""
    return cjk_share(t) > 0.05


def english_sentence(t: Column) -> Column:
    """FLT-25: five words or more, letters of 0.6 of the whole length, white space included, and a word of three letters."""
    words = F.regexp_extract_all(t, F.lit("[A-Za-z][A-Za-z\\-']+"), F.lit(0))
    return (F.size(words) >= 5) & (count_of(t, "\\p{L}") / F.greatest(F.length(t), F.lit(1)) >= 0.6) & F.exists(words, lambda w: F.length(w) >= 3)


def cites(t: Column) -> Column:
    """FLT-19's line test: 20 characters or more, a year with an author list's comma or bracket, or a source's marks."""
    year = t.rlike("\\b(19|20)\\d{2}\\b") & t.rlike("[,(]\\s*[A-Z]")
    return (F.length(t) >= 20) & (year | t.rlike("(?i)doi|https?://|\\bvol\\.|\\bpp\\."))


def figure_text(r_width: Column, t: Column, n_lines: Column, kind: Column, region_width: Column) -> Column:
    """FLT-8 once the region covers the block: short enough for a label in a region of this kind."""
    s = collapse(t)
    ends = s.rlike(SENTENCE_END) & (F.length(s) > 24)
    vec = (F.length(s) <= 130) & (n_lines <= 8) & ~ends & (r_width <= F.greatest(F.lit(240.0), 0.72 * region_width)) & (F.length(s) / F.greatest(n_lines, F.lit(1)) <= 34)
    other = (F.length(s) <= 64) & (n_lines <= 3) & ~ends
    return (F.length(s) > 0) & F.when(kind == "vec", vec).otherwise(other)


def join_lines(lines: Column) -> Column:
    """STR-2: lines to one text; a hyphen before a lower-case start goes, with the line end. A null line is empty."""

    def part(x: Column, i: Column) -> Column:
        x, after = F.coalesce(x, F.lit("")), F.coalesce(F.get(lines, i + 1), F.lit(""))
        return F.when(x.endswith("-") & after.rlike("^\\p{Ll}"), F.substr(x, F.lit(1), F.length(x) - 1)).otherwise(F.concat(x, F.lit(" ")))

    return collapse(F.array_join(F.transform(lines, part), ""))


def marked_text(tokens: Column) -> Column:
    """STR-3, WIN-5: text tokens as they are, the k-th math token as ⟨k⟩."""
    numbered = F.transform(tokens, lambda x, i: F.when(x["kind"] == "m", F.concat(F.lit("⟨"), (F.size(F.filter(F.slice(tokens, 1, i + 1), lambda y: y["kind"] == "m"))).cast("string"), F.lit("⟩"))).otherwise(x["text"]))
    return collapse(F.array_join(numbered, " "))


def raw_text(tokens: Column) -> Column:
    """STR-3: text tokens alone."""
    return collapse(F.array_join(F.transform(F.filter(tokens, lambda x: x["kind"] == "t"), lambda x: x["text"]), " "))


def placeholders_to_mark(t: Column) -> Column:
    """STR-20."""
    return F.regexp_replace(t, "⟨\\d+⟩", FORMULA_MARK)


def normal_placeholders(t: Column) -> Column:
    return F.regexp_replace(t, "[⟨〈《【]\\s*(\\d{1,3})\\s*[⟩〉》】]", "⟨$1⟩")


def synthetic(t: Column, ratio: float = 0.60, sentence: str = "本文提出一种新的方法并在多个数据集上验证其有效性。") -> Column:
    """STR-21: max(6, floor(ratio * solid length)) characters of a repeated sentence."""
    n = F.greatest(F.lit(6), F.floor(F.lit(ratio) * F.length(solid(t)))).cast("int")
    return F.substr(F.repeat(F.lit(sentence), (n / len(sentence)).cast("int") + 1), F.lit(1), n)


def stem(path: Column) -> Column:
    """STR-22."""
    return F.regexp_replace(F.regexp_replace(path, "^.*[/\\\\]", ""), "(?i)\\.pdf$", "")


def endpoint(base: Column, path: Column) -> Column:
    """STR-19: base without its last slashes, /v1 unless it ends so, and the path."""
    clean = F.regexp_replace(base, "/+$", "")
    return F.concat(clean, F.when(clean.endswith("/v1"), F.lit("")).otherwise(F.lit("/v1")), F.lit("/"), path)


def slug(t: Column) -> Column:
    """STR-17."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(t), "[^a-z0-9_-]+", "-"), "^-+|-+$", ""), 1, 41)


def credential_name(t: Column) -> Column:
    """STR-18."""
    return F.concat(F.regexp_replace(F.upper(t), "[^A-Z0-9]+", "_"), F.lit("_API_KEY"))


def safe_name(t: Column) -> Column:
    """STR-16: the last path part, with odd characters as single underscores and none at the ends."""
    base = F.regexp_replace(t, "^.*[/\\\\]", "")
    return F.regexp_replace(F.regexp_replace(base, f"[^A-Za-z0-9_ .\\-{CJK[1:-1]}]+", "_"), "^_+|_+$", "")


def redacted(t: Column, secrets: tuple[str, ...] = (), bearer: bool = True) -> Column:
    """STR-14, and with ``bearer`` STR-15: known secrets, key-like tokens, URL users and secret parameters."""
    for s in secrets:
        if s:
            t = F.replace(t, F.lit(s), F.lit("[REDACTED]"))
    if bearer:
        t = F.regexp_replace(t, "(?i)bearer\\s+[A-Za-z0-9._~+/=-]+", "Bearer [REDACTED]")
    t = F.regexp_replace(t, "sk-[A-Za-z0-9_-]{8,}", "[REDACTED]")
    t = F.regexp_replace(t, "(?i)(https?://)[^/@\\s]+@", "$1[REDACTED]@")
    return F.regexp_replace(t, "(?i)([?&](?:api[_-]?key|key|token|access_token|secret)=)[^&\\s]+", "$1[REDACTED]")


def numbered_prompt(texts: Column) -> Column:
    """STR-13."""
    return F.array_join(F.transform(texts, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def parse_numbered(t: Column) -> Column:
    """STR-11: map from number to text; the last of a number wins, other lines are lost."""
    line = "^\\s*(\\d+)\\s*[.、)]\\s*(.+)$"
    rows = F.filter(F.split(t, "\n"), lambda x: x.rlike(line))
    pairs = F.transform(rows, lambda x: F.struct(F.regexp_extract(x, line, 1).cast("int").alias("k"), F.trim(F.regexp_extract(x, line, 2)).alias("v")))
    last = F.transform(F.array_distinct(F.transform(pairs, lambda p: p["k"])), lambda k: F.struct(k.alias("k"), F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"].alias("v")))
    return F.map_from_entries(last)


def missing_numbers(parsed: Column, n: Column) -> Column:
    """STR-12: the numbers 1 to n that an answer lacks."""
    return F.when(n > 0, F.array_except(F.sequence(F.lit(1), n.cast("int")), F.map_keys(parsed))).otherwise(F.array().cast("array<int>"))


def glossary_term(t: Column) -> Column:
    """AGG-9's line test: a first colon behind the start, and neither CJK nor a backtick before it."""
    at = F.instr(t, ":")
    return (at > 1) & ~F.substring_index(t, ":", 1).rlike("[`一-鿿]")


def decode_symbols(t: Column) -> Column:
    """STR-4."""
    return F.translate(t, "".join(SYMBOLS), "".join(SYMBOLS.values()))


# ---------------------------------------------------------------- page specs
def page_spec(spec: Column, pages: Column, strict: bool) -> Column:
    """SRC-3 (strict) and SRC-4: sorted distinct page indices from 0; full-width commas only if strict.

    Strict: parts that don't parse, start below 1 or run backwards are errors, ends are clamped.
    Lenient: whatever lies outside 1 to pages is left out; an empty spec means all pages.
    """
    s = F.regexp_replace(F.regexp_replace(spec, "，", ",") if strict else spec, "\\s+", "")
    parts = F.filter(F.split(s, ","), lambda p: F.length(p) > 0)
    lo = lambda p: F.substring_index(p, "-", 1).cast("int")
    hi = lambda p: F.substring_index(p, "-", -1).cast("int")
    fine = lambda p: p.rlike("^\\d{1,9}(-\\d{1,9})?$")
    if strict:
        bad = F.exists(parts, lambda p: ~fine(p) | F.when(fine(p), (lo(p) < 1) | (hi(p) < lo(p))).otherwise(False))
        some = F.filter(parts, lambda p: F.when(fine(p), lo(p) <= pages).otherwise(False))
        out = F.flatten(F.transform(some, lambda p: F.sequence(lo(p) - 1, F.least(hi(p), pages) - 1)))
        return F.when(bad, F.raise_error(F.concat(F.lit("invalid page spec: "), spec)).cast("array<int>")).otherwise(F.array_sort(F.array_distinct(out)))
    some = F.filter(parts, lambda p: F.when(fine(p), (F.least(hi(p), pages) >= F.greatest(lo(p), F.lit(1)))).otherwise(False))
    out = F.array_sort(F.array_distinct(F.flatten(F.transform(some, lambda p: F.sequence(F.greatest(lo(p), F.lit(1)) - 1, F.least(hi(p), pages) - 1)))))
    return F.when(F.length(F.coalesce(s, F.lit(""))) == 0, F.when(pages > 0, F.sequence(F.lit(0), pages - 1)).otherwise(F.array().cast("array<int>"))).otherwise(out)


def valid_page_spec(spec: Column) -> Column:
    """SRC-5: the spec without white space, null if empty, an error if malformed."""
    s = F.regexp_replace(spec, "\\s+", "")
    return F.when(F.length(F.coalesce(s, F.lit(""))) == 0, F.lit(None).cast("string")).when(s.rlike("^\\d+(-\\d+)?(,\\d+(-\\d+)?)*$"), s).otherwise(F.raise_error(F.lit("invalid page spec")).cast("string"))


# ---------------------------------------------------------------- errors
def is_permanent(status: Column) -> Column:
    """FLT-28."""
    return F.coalesce(status.isin(400, 401, 403, 404, 422), F.lit(False))


def is_transient(status: Column, message: Column) -> Column:
    """FLT-28: permanent statuses first; 401 in a message is transient only without one."""
    return ~is_permanent(status) & F.coalesce(message.rlike("(?i)401|429|50[0234]|timeout|timed out|connection|temporarily"), F.lit(False))


def failure_kind(failed: Column, message: Column) -> Column:
    """FLT-31: auth wins over connection."""
    auth = message.rlike("(?i)401|403|api.?key|unauthori[sz]ed|auth")
    net = message.rlike("(?i)connect|timeout|network|refused|unreachable")
    return F.when(failed & auth, "auth").when(failed & net, "connection")
