"""Text operators on edge cases, and invariants on all texts."""
import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from veilframe import catalogue as C
from veilframe.fixtures import view
from veilframe.functions import text as T
from veilframe.operators import align, text as ops


def texts(spark, *rows):
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "id int, text string")


def spans(df):
    return {r.id: [(s.start, s.end, s.original, s.label) for s in r.spans] for r in df.collect()}


def python_spans(text, patterns):
    found = []
    for order, p in enumerate(patterns):
        for m in re.finditer(p.regex, text, re.I if p.ignore_case else 0):
            found.append((m.start(), -(m.end() - m.start()), order, m.end(), m.group(), p.name))
    return [(s, e, o, n) for s, _, _, e, o, n in sorted(found)]


def python_redact(text, found):
    groups = []
    for start, end, _, _ in found:
        if groups and start < groups[-1][1]:
            groups[-1][1] = max(groups[-1][1], end)
        else:
            groups.append([start, end])
    out, last = [], 0
    for start, end in groups:
        out += [text[last:start], C.PLACEHOLDER]
        last = end
    return "".join(out) + text[last:]


EDGE = [
    "mail a.b@c.de and a.b@c.de twice", "née José@exämple.fr ok", "🙂 9876543210 🙂", "4111-1111-1111-1111 1234 5678 9012 3456",
    " +919876543210", " +91 9876543210", "x+919876543210", "9876543210", "\u0001 ABCPK1234Z \u0001\u0001 ABCPK1234Z", "", "nothing here",
    "ABCPK1234Z\nABCPK1234Z", "1234 5678 9012",
]


def test_spans_equal_python(spark):
    got = spans(ops.detect(texts(spark, *EDGE)))
    for i, text in enumerate(EDGE):
        assert got[i] == python_spans(text, C.TEXT_PATTERNS), text


def test_all_documents_equal_python(spark, folder):
    rows = ops.redact(ops.detect(view(spark, folder, "v_texts")), 1).select("text", "redacted").collect()
    assert all(r.redacted == python_redact(r.text, python_spans(r.text, C.TEXT_PATTERNS)) for r in rows)


def test_overlapping_tail_is_masked(spark):
    df = ops.detect(texts(spark, "call Ravi 9876543210 now"))
    ents = spark.createDataFrame([(0, 5, 15, "PERSON")], "id int, start int, end int, label string")
    mixed = ops.with_entities(df, ents, ["id"])
    assert ops.redact(mixed, 1).first().redacted == "call [REDACTED] now"
    swapped = ops.redact(mixed, 2).first().redacted
    assert "43210" not in swapped and swapped.startswith("call ") and swapped.endswith(" now")


def test_no_covered_character_is_left(spark):
    """Random spans of every overlap: what one covers never comes out."""
    rng = random.Random(3)
    rows = []
    for i in range(200):
        body = "".join(chr(0x4E00 + k) for k in range(rng.randrange(1, 700)))
        found = sorted((a, -(b - a), b) for a, b in ((rng.randrange(len(body)), rng.randrange(len(body) + 1)) for _ in range(rng.randrange(12))) if a <= b)
        rows.append((i, body, [(a, b, body[a:b], "PERSON" if a % 2 else "CITY") for a, _, b in found]))
    df = spark.createDataFrame(rows, f"id int, text string, spans array<{T.SPAN}>")
    for level in (1, 2):
        for r in ops.redact(df, level).collect():
            body, found = rows[r.id][1], rows[r.id][2]
            covered = {c for a, b, _, _ in found for c in body[a:b]}
            assert not covered & set(r.redacted)
            assert [c for c in r.redacted if c in set(body)] == [c for c in body if c not in covered]
            assert [s.original for s in r.spans] == [body[s.start:s.end] for s in r.spans]


def test_very_many_matches(spark):
    """A log of one hundred thousand matches in one row is no longer than the work it holds."""
    body = "".join(f"user{i}@example.com phone 98765{i:05d} | " for i in range(50_000))
    began = time.time()
    row = ops.redact(ops.detect(texts(spark, body)), 2).first()
    assert len(row.spans) >= 100_000 and "example.com" not in row.redacted
    assert time.time() - began < 60


def test_nothing_is_left_after_masking(spark, folder):
    done = ops.redact(ops.detect(view(spark, folder, "v_texts")), 1)
    assert done.where(T.any_of(F.col("redacted"), C.TEXT_PATTERNS)).count() == 0


def test_prefixed_phone_needs_its_own_pattern(spark):
    df = texts(spark, " +919876543210", " +91 9876543210", "a+919876543210")
    plain = [r.redacted for r in ops.redact(ops.detect(df), 1).orderBy("id").collect()]
    assert plain[0] == " +919876543210" and plain[1] == " +91 [REDACTED]"
    full = [r.redacted for r in ops.redact(ops.detect(df, e164=True), 1).orderBy("id").collect()]
    assert full[:2] == [" [REDACTED]", " [REDACTED]"]


def test_same_original_same_pseudonym(spark):
    df = texts(spark, "9876543210 then 9876543210", "again 9876543210")
    a, b = [r.redacted for r in ops.redact(ops.detect(df), 2).orderBy("id").collect()]
    assert len(set(re.findall(r"555-\d{3}-\d{4}", a + b))) == 1
    assert "[REDACTED]" in ops.redact(ops.detect(texts(spark, "ABCPK1234Z")), 2).first().redacted


def test_unknown_level_is_refused(spark):
    with pytest.raises(ValueError):
        ops.redact(ops.detect(texts(spark, "x")), 3)


def test_entities_join_with_titles(spark):
    df = ops.detect(texts(spark, "Dr. Asha Patil wrote to a@b.co from Pune"))
    ents = spark.createDataFrame([(0, 4, 14, "PERSON"), (0, 36, 40, "GPE"), (0, 0, 3, "MISC")], "id int, start int, end int, label string")
    row = ops.redact(ops.with_entities(df, ents, ["id"]), 1).first()
    assert row.redacted == "[REDACTED] wrote to [REDACTED] from [REDACTED]"


def test_hash_tag(spark):
    row = texts(spark, "id ABCPK1234Z and 123456789012.").select(T.hash_tags(F.col("text")).alias("t")).first()
    tag = lambda s: f"[REDACTED_{hashlib.md5(s.encode()).hexdigest()[:8]}]"
    assert row.t == f"id {tag('ABCPK1234Z')} and {tag('123456789012')}."


def test_checksums(spark):
    times, power = C.verhoeff_tables()

    def python(number):
        c = 0
        for i, d in enumerate(reversed(number)):
            c = times[c * 10 + power[(i % 8) * 10 + int(d)]]
        return c == 0

    numbers = [f"{(i * 7919007 + 13) % 10**12:012d}" for i in range(3000)]
    got = texts(spark, *numbers).select("text", T.verhoeff_ok(F.col("text")).alias("ok")).collect()
    assert all(r.ok == python(r.text) for r in got) and 200 < sum(r.ok for r in got) < 400
    odd = texts(spark, "1234", "12345678901x", "").select(T.verhoeff_ok(F.col("text")).alias("ok")).collect()
    assert not any(r.ok for r in odd)
    # Known check digit: 236 carries 3.
    assert python("2363")


def test_region_order(spark):
    cases = {"123456789012": "PHONE_NUMBER", "AB123456": "ID_NUMBER", "dr. john smith": "PERSON_NAME", "x@y.com": "EMAIL_ADDRESS",
             "MH12AB1234": "VEHICLE_PLATE", "12 park road": "LOCATION", "hello": None}
    got = texts(spark, *cases).select("text", T.region_class(F.col("text")).alias("c")).collect()
    assert {r.text: r.c for r in got} == cases


def test_company_counts_as_document(spark):
    got = texts(spark, "COMPANY", "ORG", "B-PER", "o").select(T.canonical_label(F.col("text")).alias("c")).collect()
    assert [r.c for r in got] == ["B-DOC", "O", "B-PER", "O"]


def test_surrogate_shapes(spark):
    got = [r.s for r in texts(spark, "C1234567", "12/03/1999", "/", "ASHA", "asha", "Asha", "supercalifragilistic").select(
        T.surrogate(F.col("text")).alias("s")).collect()]
    assert got[:3] == ["C#######", "##/##/####", "/"]
    assert got[3].isupper() and got[4].islower() and got[5].istitle() and 3 <= len(got[6]) <= 12


def test_keywords_overlap_each_other(spark):
    df = texts(spark, "Main Street near East Road, Navi Mumbai")
    hits = [(r.char_at, r.keyword) for r in ops.address_windows(df, ["id"]).collect()]
    low = "main street near east road, navi mumbai"
    want = [(i, k) for k in C.ADDRESS_KEYWORDS_V0 for i in range(len(low)) if low.startswith(k, i)]
    assert sorted(hits) == sorted(want)


def test_dictionary_model(spark):
    found = align.dictionary_entities(texts(spark, "Asha lives in Pune, not Punekar"), ["id"], {"Asha": "PERSON", "Pune": "GPE"})
    assert sorted((r.start, r.word, r.entity_group) for r in found.collect()) == [(0, "Asha", "PERSON"), (14, "Pune", "GPE")]


def test_failing_detector_does_not_stop_others(spark):
    def broken():
        raise RuntimeError("no weights")

    def good():
        return lambda batch: batch.assign(word=batch["text"].str[:3])[["id", "word"]]

    out = align.run_detectors(texts(spark, "abcdef"), [broken, good], "id int, word string, model long").collect()
    assert sorted((r.model, r.id, r.word, r.error) for r in out) == [(0, 0, None, "RuntimeError('no weights')"), (1, 0, "abc", None)]

    def halfway():
        def run(batch):
            raise ValueError("bad page")
        return run

    out = align.run_detectors(texts(spark, "a", "b"), [halfway], "id int, word string, model long").collect()
    assert sorted((r.id, r.error) for r in out) == [(0, "ValueError('bad page')"), (1, "ValueError('bad page')")]


def test_chunks_cover_the_whole_text(spark):
    bodies = ["", "x", "é" * 100, "".join(chr(97 + i % 26) for i in range(3333)), None]
    rows = ops.chunks(texts(spark, *bodies), size=100, overlap=30).collect()
    for i, body in enumerate(bodies):
        own = sorted((r.chunk_no, r.start, r.chunk) for r in rows if r.id == i)
        if body is None:
            assert not own
            continue
        assert all(body[start:start + 100] == chunk for _, start, chunk in own)
        assert own[0][1] == 0 and own[-1][1] + len(own[-1][2]) == len(body)
        # Anything as long as the overlap lies whole in some piece.
        assert all(any(s <= at and at + 30 <= s + len(c) for _, s, c in own) for at in range(len(body) - 29))


def test_what_patterns_need():
    """Every match holds the run of digits and the marks that the search is spared without."""
    assert T.needs(C.Pattern("X", r"\b(?:\+91[-\s]?)?[6-9]\d{9}\b")) == (10, frozenset())
    assert T.needs(C.Pattern("X", r"\d{3}-(?:\d{2}|\d{5})@?a+[0-9]?")) == (3, frozenset("-"))
    assert T.needs(C.Pattern("X", r"(?:#\d{4}|#\d{2}/)x*")) == (2, frozenset("#"))
    rng, seen = random.Random(6), 0
    every = [p for name in dir(C) if name.endswith("PATTERNS") or "PATTERNS_V" in name for p in getattr(C, name) if isinstance(p, C.Pattern)]
    for _ in range(4000):
        text = "".join(rng.choice(["1234", "56", "7890123", " ", "-", "/", "@", ".", "A", "ABCDE", "b", "+91", "9876543210", "com"]) for _ in range(8))
        for p in every:
            for m in re.finditer(p.regex, text, re.I if p.ignore_case else 0):
                digits, marks = T.needs(p)
                seen += 1
                assert max(map(len, re.findall(r"\d+", m.group())), default=0) >= digits and marks <= set(m.group()), (p, m)
    assert seen > 1000
