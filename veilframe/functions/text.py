"""Column expressions over text: spans, splicing, labels, checks, surrogates.

Everything here is a built-in expression on one row, so text jobs run without
a shuffle however large the collection is.
"""
from __future__ import annotations

import re
import re._constants as sre
import re._parser as sre_parse
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe import catalogue as C

SPAN = "struct<start:int,end:int,original:string,label:string>"
_CANDIDATE = "array<struct<start:int,neg_len:int,ord:int,end:int,label:string>>"
_MARK, _STAND_IN = "\u0001", "\u0002"


def regex(pattern: C.Pattern | str, ignore_case: bool = False) -> str:
    """The pattern with Unicode character classes (and folded case if asked)."""
    if isinstance(pattern, C.Pattern):
        pattern, ignore_case = pattern.regex, pattern.ignore_case
    return ("(?iU)" if ignore_case else "(?U)") + pattern


def full_regex(pattern: C.Pattern | str, ignore_case: bool = False) -> str:
    """The same, but it has to cover the whole string."""
    if isinstance(pattern, C.Pattern):
        pattern, ignore_case = pattern.regex, pattern.ignore_case
    return ("(?iU)" if ignore_case else "(?U)") + rf"\A(?:{pattern})\z"


def any_of(column: Column, patterns: list[C.Pattern], full: bool = False) -> Column:
    """True where one of the patterns occurs; one regular expression per case rule."""
    parts = []
    for folded in (False, True):
        bodies = [p.regex for p in patterns if p.ignore_case is folded]
        if bodies:
            # A shared leading boundary is tested once per position, not once per pattern.
            edge = r"\b" if len(bodies) > 1 and all(b.startswith(r"\b") for b in bodies) else ""
            body = edge + "(?:" + "|".join(f"(?:{b[len(edge):]})" for b in bodies) + ")"
            parts.append(column.rlike(full_regex(body, folded) if full else regex(body, folded)))
    return reduce(or_, parts)


# --- fixed values: characters that count as white space -------------------
WHITE = (
    "\t\n\u000b\u000c\r\u001c\u001d\u001e\u001f \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(column: Column) -> Column:
    """Remove white space of any kind on both sides."""
    return F.btrim(column, F.lit(WHITE))


def _pieces(text: Column, pattern: C.Pattern) -> Column:
    """Split so that every second element is a match; nothing else is lost."""
    safe = F.translate(text, _MARK, _STAND_IN)
    body = regex(f"({pattern.regex})", pattern.ignore_case)
    return F.split(F.regexp_replace(safe, body, f"{_MARK}$1{_MARK}"), _MARK, -1)


#: Texts are cut into blocks of this many characters, so that a piece anywhere
#: is found without walking through the text before it.
_BLOCK = 256


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: a lambda variable is not copied."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{_BLOCK}}}"), F.lit(0))


def cut(parts: Column, start: Column, size: Column) -> Column:
    """``size`` characters of a text given as blocks, from a 0-based place."""
    first = F.floor(start / _BLOCK).cast("int")
    last = F.floor((start + size + (_BLOCK - 1)) / _BLOCK).cast("int")
    near = F.array_join(F.slice(parts, first + 1, F.greatest(F.lit(0), last - first)), "")
    return F.substring(near, start - first * _BLOCK + 1, size)


def _sums_before(values: Column) -> Column:
    """For every number of an array the sum of those before it.

    Lists grow inside rows of 512 numbers only, so the work stays in
    proportion to the array.
    """
    wide = 512

    def running(numbers: Column) -> Column:
        begin = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("done"))
        return F.aggregate(numbers, begin, lambda state, x: F.struct(
            (state["sum"] + x).alias("sum"), F.concat(state["done"], F.array(state["sum"])).alias("done")))

    def whole(numbers: Column) -> Column:
        count = F.floor((F.size(numbers) + (wide - 1)) / wide).cast("int")
        rows = F.transform(F.sequence(F.lit(0), count - 1), lambda k: running(F.slice(numbers, k * wide + 1, F.lit(wide))))
        return let(rows, lambda rs: let(running(F.transform(rs, lambda r: r["sum"]))["done"], lambda carried: F.flatten(F.transform(
            rs, lambda r, k: F.transform(r["done"], lambda x: x + F.get(carried, k))))))

    return let(values, lambda v: F.when(F.size(v) == 0, v).otherwise(whole(v)))


_DIGIT = frozenset("0123456789")


def needs(pattern: C.Pattern) -> tuple[int, frozenset]:
    """What every match of a pattern holds: the length of a run of digits, and marks
    (no letters or digits). A text without them need not be searched."""
    def is_digit(kind, value) -> bool:
        if kind is sre.LITERAL:
            return chr(value) in _DIGIT
        if kind is sre.IN:
            return all(k is sre.CATEGORY and v is sre.CATEGORY_DIGIT or k is sre.LITERAL and chr(v) in _DIGIT
                       or k is sre.RANGE and {chr(v[0]), chr(v[1])} <= _DIGIT for k, v in value)
        return False

    def of(sequence) -> tuple[int, frozenset]:
        best, run, marks = 0, 0, frozenset()
        for kind, value in sequence:
            repeats, inner = 1, [(kind, value)]
            if kind in (sre.MAX_REPEAT, sre.MIN_REPEAT):
                repeats, inner = value[0], list(value[2])
            if len(inner) == 1 and is_digit(*inner[0]):
                run += repeats
            elif kind is not sre.AT:
                run = 0
                if kind is sre.BRANCH:
                    arms = [of(arm) for arm in value[1]]
                    found = min(a[0] for a in arms), frozenset.intersection(*[a[1] for a in arms])
                elif kind is sre.SUBPATTERN:
                    found = of(value[3])
                elif kind is sre.LITERAL:
                    found = 0, frozenset() if chr(value).isalnum() or chr(value) in _MARK + _STAND_IN else frozenset(chr(value))
                elif repeats and kind in (sre.MAX_REPEAT, sre.MIN_REPEAT):
                    found = of(inner)
                else:
                    found = 0, frozenset()
                best, marks = max(best, found[0]), marks | found[1]
            best = max(best, run)
        return best, marks

    try:
        return of(sre_parse.parse(pattern.regex))
    except (re.error, OverflowError):  # a form that only Java knows
        return 0, frozenset()


def _may_match(text: Column, run: Column, pattern: C.Pattern) -> Column:
    digits, marks = needs(pattern)
    tests = [run >= digits] if digits else []
    return reduce(and_, tests + [F.contains(text, F.lit(m)) for m in sorted(marks)], F.lit(True))


def _longest_run(text: Column, patterns: list[C.Pattern]) -> Column:
    """Length of the longest run of digits, 0 if it is shorter than any pattern needs."""
    least = min((n for n, _ in map(needs, patterns) if n), default=0)
    if not least:
        return F.lit(0)
    runs = F.regexp_extract_all(text, F.lit(rf"(?U)\d{{{least},}}"), F.lit(0))
    return F.coalesce(F.array_max(F.transform(runs, lambda r: F.length(r))), F.lit(0))


def _candidates(text: Column, pattern: C.Pattern, order: int, may_match: Column) -> Column:
    """All matches of one pattern with exact offsets, as sortable structs."""
    empty = F.from_json(F.lit("[]"), _CANDIDATE)

    def matches(sizes: Column) -> Column:
        spans = let(_sums_before(sizes), lambda starts: F.transform(sizes, lambda size, i: F.struct(
            F.get(starts, i).alias("start"), (-size).alias("neg_len"), F.lit(order).alias("ord"),
            (F.get(starts, i) + size).alias("end"), F.lit(pattern.name).alias("label"))))
        return F.filter(spans, lambda span, i: i % 2 == 1)

    found = let(F.transform(_pieces(text, pattern), lambda piece: F.length(piece)), matches)
    return F.when(may_match & text.rlike(regex(pattern)), found).otherwise(empty)


def _with_original(text: Column, spans: Column) -> Column:
    return let(blocks(text), lambda parts: F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"),
        cut(parts, s["start"], s["end"] - s["start"]).alias("original"), s["label"].alias("label"),
    )))


def find_spans(text: Column, patterns: list[C.Pattern]) -> Column:
    """Every match of every pattern, ordered by start, longer first, list order.

    One pass finds the runs of digits; a pattern is searched for only where
    what it needs occurs.
    """
    def found(run: Column) -> Column:
        parts = [_candidates(text, p, i, _may_match(text, run, p)) for i, p in enumerate(patterns)]
        return F.array_sort(F.concat(*parts))

    none = F.from_json(F.lit("[]"), f"array<{SPAN}>")
    every = let(_longest_run(text, patterns), lambda run: F.when(
        reduce(or_, [_may_match(text, run, p) for p in patterns]), found(run)))
    return let(every, lambda spans: F.when(F.size(spans) > 0, _with_original(text, spans)).when(text.isNotNull(), none))


def resolve_overlaps(spans: Column, text: Column | None = None) -> Column:
    """Join spans that overlap, so that whatever one of them covers stays covered.

    A joined span has the label of the first and, where ``text`` is given, the
    covered text as its original. Spans come in by start, longer first; ones
    that only touch stay apart, empty ones are dropped. A span begins a new
    group if as many spans have ended by its start as stand before it.
    """
    def joined(ordered: Column, ends: Column, parts: Column | None) -> Column:
        heads = F.filter(F.transform(ordered, lambda s, i: F.struct(s.alias("s"), i.alias("i"))),
                         lambda h: (h["i"] == 0) | (F.get(ends, h["i"] - 1) <= h["s"]["start"]))

        def group(h: Column, following: Column) -> Column:
            end = F.get(ends, F.coalesce(following, F.size(ordered)) - 1)
            original = h["s"]["original"]
            if parts is not None:
                original = F.when(end == h["s"]["end"], original).otherwise(cut(parts, h["s"]["start"], end - h["s"]["start"]))
            return F.struct(h["s"]["start"].alias("start"), end.alias("end"), original.alias("original"), h["s"]["label"].alias("label"))

        return let(heads, lambda hs: F.transform(hs, lambda h, k: group(h, F.get(hs, k + 1)["i"])))

    def resolved(ordered: Column) -> Column:
        ends = F.array_sort(F.transform(ordered, lambda s: s["end"]))
        if text is None:
            return let(ends, lambda es: joined(ordered, es, None))
        return let(ends, lambda es: let(blocks(text), lambda parts: joined(ordered, es, parts)))

    real = F.filter(spans, lambda s: s["end"] > s["start"])
    return let(real, lambda ordered: F.when(F.size(ordered) <= 1, ordered).otherwise(resolved(ordered)))


def last_labels(spans: Column) -> Column:
    """For each span the label of the last span with the same original.

    Spans are sorted by original, each run's last label is spread over the
    run by counting the runs before, and the order is restored.
    """
    item = F.transform(spans, lambda s, i: F.struct(s["original"].alias("original"), (-i).alias("back"), s["label"].alias("label")))

    def spread(ordered: Column) -> Column:
        fresh = F.transform(ordered, lambda x, k: F.when((k > 0) & (F.get(ordered, k - 1)["original"] == x["original"]), 0).otherwise(1))
        heads = F.filter(ordered, lambda x, k: (k == 0) | (F.get(ordered, k - 1)["original"] != x["original"]))
        return let(fresh, lambda f: let(_sums_before(f), lambda before: let(heads, lambda hs: F.transform(
            F.array_sort(F.transform(ordered, lambda x, k: F.struct(
                (-x["back"]).alias("i"), F.get(hs, F.get(before, k) + F.get(f, k) - 1)["label"].alias("label")))),
            lambda x: x["label"]))))

    return let(F.array_sort(item), spread)


def splice(text: Column, spans: Column, replacement) -> Column:
    """Replace disjoint ordered spans; ``replacement`` maps a span and its place to a column."""
    def body(parts: Column) -> Column:
        def piece(span: Column, i: Column) -> Column:
            before = F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1)["end"])
            return F.concat(cut(parts, before, span["start"] - before), replacement(span, i))

        last = F.element_at(spans, -1)["end"]
        return F.concat(F.array_join(F.transform(spans, piece), ""), F.substring(text, last + 1, F.length(text)))

    return F.when(F.size(spans) == 0, text).otherwise(let(blocks(text), body))


def pick(options: list[str], seed: Column) -> Column:
    """A reproducible choice from a list: the first 32 bits of an md5."""
    at = F.pmod(hash_number(seed), F.lit(len(options)))
    return F.element_at(F.array(*[F.lit(o) for o in options]), (at + 1).cast("int"))


def hash_number(seed: Column) -> Column:
    """The first eight hex digits of md5 as a number below 2**32."""
    return F.conv(F.substring(F.md5(seed.cast("binary")), 1, 8), 16, 10).cast("bigint")


def pseudonym(label: Column, original: Column, key: str) -> Column:
    """A replacement drawn by keyed hash, so equal originals look alike everywhere."""
    def seed(part: str) -> Column:
        return F.concat(F.lit(f"{key}|{part}|"), original)

    def digits(part: str, low: int, span: int, width: int) -> Column:
        return F.lpad((hash_number(seed(part)) % span + low).cast("string"), width, "0")

    first, last = pick(C.FIRST_NAMES, seed("first")), pick(C.LAST_NAMES, seed("last"))
    made = {
        "name": F.concat(first, F.lit(" "), last),
        "city": pick(C.CITIES, seed("city")),
        "date": F.concat_ws("-", digits("year", 1970, 50, 4), digits("month", 1, 12, 2), digits("day", 1, 28, 2)),
        "company": pick(C.COMPANIES, seed("company")),
        "email": F.concat(F.lower(first), F.lit("."), F.lower(last), F.lit("@example.org")),
        "phone": F.concat(F.lit("555-"), digits("exchange", 0, 1000, 3), F.lit("-"), digits("line", 0, 10000, 4)),
    }
    chain = F.lit(C.PLACEHOLDER)
    for kind, value in made.items():
        labels = [k for k, v in C.PSEUDONYM_KINDS.items() if v == kind]
        chain = F.when(label.isin(labels), value).otherwise(chain)
    return chain


def hash_tags(text: Column) -> Column:
    """Put ``[REDACTED_<8 hex>]`` over identifiers, one catalogue row after the other."""
    for pattern in C.HASH_TAG_PATTERNS:
        tagged = F.array_join(F.transform(
            _pieces(text, pattern),
            lambda p, i: F.when(
                i % 2 == 1,
                F.concat(F.lit("[REDACTED_"), F.substring(F.md5(p.cast("binary")), 1, 8), F.lit("]")),
            ).otherwise(p)), "")
        text = F.when(text.rlike(regex(pattern)), tagged).otherwise(text)
    return text


def region_class(text: Column) -> Column:
    """The first matching on-screen text class, or null."""
    return F.coalesce(*[F.when(text.rlike(regex(p)), F.lit(p.name)) for p in C.REGION_PATTERNS])


def title_start(text: Column, start: Column) -> Column:
    """Move a span start left over a directly preceding title."""
    moved = start
    for title in reversed(C.TITLES):
        n = len(title) + 1
        fits = (start >= n) & (F.substring(text, start - n + 1, F.lit(n)) == f"{title} ")
        moved = F.when(fits, start - n).otherwise(moved)
    return moved


def non_sensitive(text: Column) -> Column:
    """Headers, field labels and other words that are never personal data."""
    low = strip(F.lower(text))
    phrases = "|".join(rf"\Q{p}\E" for p in C.NON_SENSITIVE_PHRASES)
    return (F.length(low) < 2) | low.isin(C.IGNORE_WORDS) | F.lower(text).rlike(phrases)


# --- fixed values: substrings that decide a canonical label, in order ------
LABEL_RULES = {
    "v0": [("B-DOC", ["PAN", "AADHAAR", "AADHAR"]), ("B-PER", ["PER", "NAME"]),
           ("B-LOC", ["LOC", "CITY", "STATE", "ADDRESS"]), ("B-ORG", ["ORG"]),
           ("B-DOC", ["DOC", "PASSPORT", "ID"]), ("B-DATE", ["DATE", "DOB"])],
    "v1": [("B-DOC", ["PAN", "DOC", "PASSPORT", "ID", "SSN", "AADHAAR"]), ("B-PER", ["PER", "NAME", "PERSON"]),
           ("B-LOC", ["LOC", "CITY", "STATE", "ADDRESS", "POST", "PIN"]), ("B-ORG", ["ORG"]),
           ("B-DATE", ["DATE", "DOB"])],
    "v3": [("O", ["MISC", "ORG"]), ("B-DOC", ["PAN", "DOC", "PASSPORT", "ID", "SSN", "AADHAAR"]),
           ("B-PER", ["PER", "NAME", "PERSON"]), ("B-LOC", ["LOC", "CITY", "STATE", "ADDRESS"]),
           ("B-DATE", ["DATE", "DOB", "BIRTH"]), ("B-PHONE", ["PHONE", "MOBILE"]), ("B-EMAIL", ["EMAIL"])],
}
LABEL_DEFAULT = {"v0": "B-MISC", "v1": "B-MISC", "v3": "O"}


def canonical_label(label: Column, variant: str = "v3") -> Column:
    """Map a model's label to the closed vocabulary by substring rules."""
    up = F.upper(label)
    chain = F.lit(LABEL_DEFAULT[variant])
    for target, marks in reversed(LABEL_RULES[variant]):
        chain = F.when(reduce(or_, [up.contains(m) for m in marks]), F.lit(target)).otherwise(chain)
    return F.when(up.isin("O", "0"), F.lit("O")).otherwise(chain)


def verhoeff_ok(number: Column) -> Column:
    """Checksum of a 12-digit number; blanks and dashes are ignored."""
    times, power = C.verhoeff_tables()
    times_arr, power_arr = F.array(*map(F.lit, times)), F.array(*map(F.lit, power))
    digits = F.regexp_replace(number, "[ -]", "")
    check = F.aggregate(
        F.sequence(F.lit(0), F.lit(11)), F.lit(0),
        lambda c, i: F.get(times_arr, c * 10 + F.get(
            power_arr, (i % 8) * 10 + F.substring(digits, 12 - i, F.lit(1)).cast("int"))),
    )
    return F.when(digits.rlike(r"\A[0-9]{12}\z"), check == 0).otherwise(F.lit(False))


def pan_ok(number: Column) -> Column:
    """Ten characters whose fourth letter names a holder class."""
    return F.upper(strip(number)).rlike(r"\A[A-Z]{3}[PCHFATBLJG][A-Z][0-9]{4}[A-Z]\z")


def surrogate(token: Column, salt: str = "anon_salt") -> Column:
    """A stand-in of the same look: digits masked, names swapped, words cut."""
    seed = F.concat(F.lit(f"{salt}|"), token)
    name = pick(C.FIRST_NAMES, seed)
    cased = (F.when(is_title(token), name).when(is_upper(token), F.upper(name)).otherwise(F.lower(name)))
    cut = F.greatest(F.lit(3), F.least(F.lit(12), F.length(token)))
    return (
        F.when(token.isNull(), F.lit(""))
        .when(~token.rlike(r"[\p{L}\p{N}]"), token)
        .when(has_digit(token), F.regexp_replace(token, r"(?U)\d", "#"))
        .when((F.length(token) <= 12) & is_alpha(token), cased)
        .otherwise(F.substring(pick(C.FILLER_WORDS, seed), F.lit(1), cut))
    )


def is_upper(text: Column) -> Column:
    """At least one cased letter and none of them lower case."""
    return text.rlike(r"\p{Lu}") & ~text.rlike(r"[\p{Ll}\p{Lt}]")


def is_title(text: Column) -> Column:
    """Every letter run starts with one capital and goes on in lower case."""
    return text.rlike(r"[\p{Lu}\p{Lt}]") & ~text.rlike(
        r"(?:(?:\A|[^\p{L}])\p{Ll})|(?:[\p{Lu}\p{Lt}\p{Ll}][\p{Lu}\p{Lt}])")


def is_alpha(text: Column) -> Column:
    return text.rlike(r"\A\p{L}+\z")


def has_digit(text: Column) -> Column:
    return text.rlike(r"\p{Nd}")


def starts_upper(text: Column) -> Column:
    return text.rlike(r"\A[\p{Lu}]")


def mostly_letters(text: Column) -> Column:
    """At least 70 % of the characters are letters."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return letters >= F.length(text) * 0.7


def word_count(text: Column) -> Column:
    words = F.split(strip(text), r"(?U)\s+")
    return F.when(F.length(strip(text)) == 0, F.lit(0)).otherwise(F.size(words))


def language_codes(lang: Column) -> Column:
    """``en+hi`` style lists to OCR codes; empty means English."""
    table = F.create_map(*[F.lit(x) for kv in C.LANGUAGE_CODES.items() for x in kv])
    parts = F.filter(F.transform(F.split(lang, r"[+\s]"), lambda p: F.lower(strip(p))), lambda p: p != "")
    named = F.transform(parts, lambda p: F.coalesce(F.element_at(table, p), p))
    return F.when(lang.isNull() | (F.size(parts) == 0), F.lit("eng")).otherwise(F.array_join(named, "+"))


def keyword_hits(text: Column, low: Column, keywords: list[str], before: int, after: int) -> Column:
    """Every occurrence of every keyword with its surrounding snippet.

    ``low`` is the text in lower case, as a column of its own.

    No keyword in use overlaps itself, so cutting the text at a keyword finds
    all of its occurrences; two different keywords may overlap freely.
    """
    present = F.filter(F.array(*map(F.lit, keywords)), lambda word: low.contains(word))

    def hits(word: Column, parts: Column) -> Column:
        gaps = F.split(low, F.concat(F.lit(r"\Q"), word, F.lit(r"\E")), F.lit(-1))

        def places(sizes: Column) -> Column:
            # Characters and keywords before each gap's end.
            ends = let(_sums_before(sizes), lambda before: F.transform(
                sizes, lambda size, i: F.get(before, i) + size + i * F.length(word)))
            return F.slice(ends, F.lit(1), F.size(sizes) - 1)

        def snippet(at: Column) -> Column:
            begin = F.greatest(F.lit(0), at - before)
            return F.struct(at.alias("at"), word.alias("keyword"),
                            cut(parts, begin, F.length(word) + F.least(at, F.lit(before)) + after).alias("snippet"))

        return F.transform(let(F.transform(gaps, lambda g: F.length(g)), places), snippet)

    return let(blocks(text), lambda parts: F.flatten(F.transform(present, lambda word: hits(word, parts))))
