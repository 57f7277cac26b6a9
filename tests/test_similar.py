"""Similarity joins: no similar pair is lost; alignment and propagation equal plain loops over whole tables."""
import itertools
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from veilframe.fixtures import view
from veilframe.functions import fuzzy
from veilframe.operators import align, similar
from veilframe.operators import tokens as token_ops
from veilframe.plans import box_queries as Q
from veilframe.plans.registry import QUERIES

PAGE = ["doc_id", "page_no"]


@pytest.mark.parametrize("least", [60, 75, 88])
def test_no_pair_is_lost(spark, least):
    """Candidates hold every pair that reaches the score; the joins hold no other."""
    rng = random.Random(least)
    letters = "abcdee  rst-é1"
    texts = sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(1, 14))).strip() for _ in range(150)} | {"a", "aa", "aaa", "é", "a b", "b a", "😀a", "x" * 60})
    left, right = texts[::2] + ["same"], texts[1::2] + ["same"]
    make = lambda name, rows: spark.createDataFrame([(k, t) for k in (1, 2) for t in rows] + [(3, rows[0])], f"page int, {name} string")
    a, b = make("needle", left), make("word", right)
    for find, join, score in ((similar.ratio_candidates, similar.ratio_join, fuzzy.ratio), (similar.partial_candidates, similar.partial_join, fuzzy.partial_ratio),
                              (similar.token_set_candidates, similar.token_set_join, fuzzy.token_set_ratio)):
        want = {(k, x, y) for k in (1, 2) for x in left for y in right if score(x, y) >= least}
        want |= {(3, x, y) for x, y in [(left[0], right[0])] if score(x, y) >= least}
        met = [tuple(r)[:3] for r in find(a, b, ["page"], "needle", "word", least).collect()]
        assert len(met) == len(set(met)) and set(met) >= want, score.__name__
        assert {tuple(r)[:3] for r in join(a, b, ["page"], "needle", "word", least).collect()} == want
        assert len(met) < 2 * len(left) * len(right) * (0.7 if least < 80 else 0.4), score.__name__


def by_page(rows):
    out = defaultdict(list)
    for r in rows:
        out[r.doc_id, r.page_no].append(r)
    return out


@pytest.fixture(scope="module")
def pages(spark, folder):
    return {k: sorted(v, key=lambda t: t.idx) for k, v in by_page(Q.numbered(spark, folder).collect()).items()}


def box(run):
    return (min(t.left_x for t in run), min(t.top for t in run), max(t.left_x + t.width for t in run), max(t.top + t.height for t in run))


def row(run):
    return run[0].idx, len(run), " ".join(t.text for t in run), *box(run)


def first_window(needle, toks, widths):
    lows = [t.text.lower() for t in toks]
    for i in range(len(toks)):
        for w in widths:
            if fuzzy.partial_reaches(needle, " ".join(lows[i:i + w]), 70):
                return toks[i:i + w]
    return None


@pytest.mark.parametrize("name, widths", [("regex_align", [6]), ("regex_align_v1", range(1, 9))])
def test_hits_like_a_loop(spark, folder, pages, name, widths):
    hits = {(r.doc_id, r.page_no, r.word.strip().lower(), r.label) for r in Q._page_hits(spark, folder).collect()}
    want, known = [], {}
    for doc, page, needle, label in hits:
        if not needle:
            continue
        toks = pages[doc, page]
        same = next((t for t in toks if t.text.lower() == needle), None)
        if same is None and (doc, page, needle) not in known:
            known[doc, page, needle] = first_window(needle, toks, widths)
        run = [same] if same else known[doc, page, needle]
        if run:
            want.append((doc, page, needle, label, "token" if same else "window", *row(run)))
    got = [(r.doc_id, r.page_no, r.needle, r.label, r.how, r.idx, r.n_tokens, r.word, r.x0, r.y0, r.x1, r.y1) for r in QUERIES[name](spark, folder).collect()]
    assert sorted(got) == sorted(want) and {r[4] for r in want} == {"token", "window"}


def test_fuzzy_alignment_like_a_loop(spark, folder, pages):
    """Predictions of the given tables and misspelt ones."""
    preds = align.vote(view(spark, folder, "v_ner_preds"))
    rng, odd = random.Random(4), []
    for (doc, page), toks in pages.items():
        t = rng.choice(toks).text
        at = rng.randrange(len(t))
        odd.append((doc, page, t[:at] + rng.choice("xyz") + t[at + 1:] + rng.choice(["", " of", t[:2]]), "ODD", 0.5))
    extra = spark.createDataFrame(odd, "doc_id bigint, page_no int, word string, entity_group string, score double")
    preds = preds.select(*extra.columns).unionByName(extra.withColumn("page_no", F.col("page_no").cast(preds.schema["page_no"].dataType)))
    needles = {(r.doc_id, r.page_no, r.word.strip().lower()) for r in preds.collect()}
    want = []
    for doc, page, needle in needles:
        toks = pages.get((doc, page), [])
        lows = [t.text.lower() for t in toks]
        if not needle or needle in " ".join(lows):
            continue
        scores = [fuzzy.token_set_ratio(needle, x) for x in lows]
        best = max(scores, default=0)
        run = [toks[scores.index(best)]] if best >= 72 else first_window(needle, toks, [4])
        if run:
            want.append((doc, page, needle, "token" if best >= 72 else "window", *row(run)))
    got = {(r.doc_id, r.page_no, r.needle, r.how, r.idx, r.n_tokens, r.word, r.x0, r.y0, r.x1, r.y1)
           for r in align.align_fuzzy(preds, Q.numbered(spark, folder)).collect()}
    assert sorted(got) == sorted(want) and {r[3] for r in want} == {"token", "window"}


def test_names_like_a_loop(spark, folder, pages):
    toks = Q.numbered(spark, folder)
    people = Q._aligned(spark, folder, "v3").where("entity_group = 'PER'")
    lines = by_page(token_ops.number_tokens(token_ops.merge_lines(toks)).collect())
    known = by_page(people.collect())
    want = {}
    for key, found in known.items():
        names, taken = {p.word.lower() for p in found}, {(p.x0, p.y0, p.x1, p.y1) for p in found}
        like = [t for t in pages[key] if any(n == t.text.lower() or fuzzy.ratio(n, t.text.lower()) >= 88 or fuzzy.partial_ratio(n, t.text.lower()) >= 85 for n in names)]
        like += [t for t in lines[key] if any(fuzzy.partial_ratio(n, t.text.lower()) >= 75 for n in names)]
        for t in like:
            b = box([t])
            if b not in taken:
                want[(*key, *b)] = min(want.get((*key, *b), t.text), t.text)
    got = {(r.doc_id, r.page_no, r.x0, r.y0, r.x1, r.y1): r.word for r in align.propagate_names(people, toks, token_ops.number_tokens(token_ops.merge_lines(toks))).collect()}
    assert got == want and len(want) > 50


def test_occurrences_like_find(spark):
    """Needles that start and end inside tokens, repeat, overlap, or cross pages' ends, against ``str.find``."""
    rng = random.Random(12)
    rows, needles = [], []
    for page in range(12):
        words = ["".join(rng.choice("abé-") for _ in range(rng.randrange(0 if page == 3 else 1, 5))) for _ in range(60 if page else 1)]
        text, at = " ".join(words), 0
        for i, w in enumerate(words):
            rows.append((1, page, i, at, w.upper()))
            at += len(w) + 1
        for _ in range(60):
            start = rng.randrange(len(text) + 1)
            needle = text[start:start + rng.randrange(1, 14)] if rng.random() < 0.7 else "".join(rng.choice("abé- ") for _ in range(rng.randrange(1, 6)))
            if needle.strip() == needle and needle:
                needles.append((1, page, needle))
        needles += [(1, page, text.strip()), (1, page, text.strip() + " a")]
    toks = spark.createDataFrame(rows, "doc_id bigint, page_no int, idx bigint, char0 bigint, text string")
    asked = spark.createDataFrame(sorted(set(needles)), "doc_id bigint, page_no int, needle string")
    got = {(r.page_no, r.needle): (r.place, r.idx, r.inside) for r in align.occurrences(asked, toks).collect()}
    want = {}
    for _, page, needle in set(needles):
        own = [r for r in rows if r[1] == page]
        at = " ".join(r[4].lower() for r in own).find(needle)
        if at >= 0:
            tok = [r for r in own if r[3] <= at][-1]
            want[page, needle] = (at, tok[2], at - tok[3])
    assert got == want and 250 < len(want) < len(set(needles))


@pytest.mark.parametrize("join", [similar.ratio_join, similar.partial_join, similar.token_set_join])
def test_quiet_and_busy_pages_alike(spark, monkeypatch, join):
    """Pages with few texts meet by their number alone and are not indexed by character; the pairs are the same."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcé12") for _ in range(rng.randrange(0, 6))) for _ in range(40)]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(1, 3)))
    left = [(page, text()) for page in (1, 2, 3) for _ in range(20)]
    right = [(page, text()) for page, n in ((1, 60), (2, 10), (4, 60)) for _ in range(n)] + [(2, "😀 a"), (2, "")]
    a, b = spark.createDataFrame(left, "page int, needle string"), spark.createDataFrame(right * 2, "page int, word string")
    found = []
    for quiet in (0, 50, 1000):
        monkeypatch.setattr(similar, "QUIET", quiet)
        pairs = join(a, b, ["page"], "needle", "word", 75)
        assert ("explode" in pairs._jdf.queryExecution().executedPlan().toString()) == (quiet < 1000)
        found.append(sorted(map(tuple, pairs.collect())))
    assert found[0] == found[1] == found[2] and len(found[0]) == len(set(found[0])) > 10
