"""Phrase mining against DuckDB and plain counting."""
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import compare

from veilframe.llm import phrases
from veilframe.llm.registry import CHECKS, QUERIES

SCHEMA = "lang string, text string, phrase string, f string, rank string, doc_id string"


def pieces_of(text):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", text)]


def plain(rows, top, least):
    """All candidates scored and dropped by the definition, per language."""
    f = defaultdict(Counter)
    for lang, text in rows:
        for ws in pieces_of(text):
            for m in range(1, 5):
                f[lang or "und"].update(tuple(ws[i:i + m]) for i in range(len(ws) - m + 1))
    out = []
    for lang, c in f.items():
        cands = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside = defaultdict(int)
        for p, a in cands.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p):
                        inside[p[i:j]] = max(inside[p[i:j]], a)
        kept = []
        for p, a in cands.items():
            score, _, left, right = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            if 100 * inside[p] < 80 * a:
                kept.append((-score, -a, " ".join(p).encode(), left, right))
        n = sum(a for p, a in c.items() if len(p) == 1)
        out += [(lang, i, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


def mined(spark, rows):
    return sorted(map(tuple, phrases.mine(spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], SCHEMA).repartition(3)).collect()))


def corpus(rng, docs, vocabulary):
    passages = [[rng.choice(vocabulary) for _ in range(rng.randrange(2, 7))] for _ in range(30)]
    rows = []
    for _ in range(docs):
        words = []
        while len(words) < 80:
            words += rng.choice(passages) if rng.random() < 0.3 else [vocabulary[min(int(rng.expovariate(0.15)), len(vocabulary) - 1)]]
            words[-1] += rng.choice(["", "", "", "", ".", ",\n", "\t"])
        rows.append((rng.choice(["en", "en", "de", None, "und"]), " ".join(words)))
    return rows


def test_same_as_sql(spark, folder, duck):
    assert compare(spark, duck, folder, QUERIES["op11_collocations"], CHECKS["op11_collocations"]) is None


@pytest.mark.parametrize("top", [3, 40, 2000])
def test_like_plain_counting(spark, monkeypatch, top):
    """Batches of the frontier: few places need several, many open it all."""
    monkeypatch.setattr(phrases, "TOP", top)
    monkeypatch.setattr(phrases, "FIRST", 1)
    monkeypatch.setattr(phrases, "LEAST", 5)
    vocabulary = [f"W{i}" for i in range(30)] + ["é", "É", "a-b", "\x1c", "\xa0x", "x\x00y"]
    rows = corpus(random.Random(top), 150, vocabulary)
    assert mined(spark, rows) == plain(rows, top, 5)


def test_ties_at_the_last_place(spark, monkeypatch):
    """Equal scores go by count, then by bytes; all ties are known before any is cut."""
    monkeypatch.setattr(phrases, "TOP", 4)
    monkeypatch.setattr(phrases, "LEAST", 2)
    rows = [("x", f"{w}1 {w}2. " * 3) for w in ["é", "b", "z", "a", "c"]] + [("x", "q1 q2. " * 5), ("x", "u v w t. " * 4)]
    assert mined(spark, rows) == plain(rows, 4, 2)


def test_chunks_and_slices_lose_nothing(monkeypatch):
    """Small slices, chunks and vocabularies count like one pass."""
    monkeypatch.setattr(phrases, "SLICE", 40)
    monkeypatch.setattr(phrases, "CHUNK", 23)
    monkeypatch.setattr(phrases, "WORDS", 9)
    rows = corpus(random.Random(5), 20, ["Aa", "b", "c", "dd", "é"])
    everything = np.full(1 << (phrases.FILTER_BITS - 3), 255, np.uint8)
    for sizes in ((2,), (3,), (4,), (4, 3)):
        want, got = Counter(), Counter()
        state = phrases._Chunks("en", everything, dict.fromkeys(sizes))
        for _, text in rows:
            for ws in pieces_of(text):
                want.update(" ".join(ws[i:i + m]) for m in sizes for i in range(len(ws) - m + 1))
            for tokens in phrases.tokens_of(text.encode()):
                for found, n in state.add(tokens):
                    got.update(dict(zip(found.to_pylist(), n.to_pylist())))
            state.end()
        for found, n in state.counted():
            got.update(dict(zip(found.to_pylist(), n.to_pylist())))
        assert got == want


def test_defined_cases(spark, monkeypatch):
    monkeypatch.setattr(phrases, "LEAST", 2)
    rows = [("en", None), ("en", ""), ("en", " .\n"), (None, "Red car. red CAR"), ("und", "red car"), ("en", "Red car"), ("en", "red car"), ("en", "red car"),
            ("de", "eins"), ("fr", "mot " * 300_000)]
    assert mined(spark, rows) == plain(rows, 2000, 2)
    assert mined(spark, []) == [] and mined(spark, [("en", None)]) == []
