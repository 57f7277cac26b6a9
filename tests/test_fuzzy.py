"""String similarity against difflib itself."""
import difflib
import random

from veilframe.functions import fuzzy


def plain_partial(a, b):
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if short in long:
        return 100
    best = 0.0
    for block in difflib.SequenceMatcher(None, short, long).get_matching_blocks():
        begin = max(0, block.b - block.a)
        best = max(best, difflib.SequenceMatcher(None, short, long[begin:begin + len(short)]).ratio())
        if best > 0.995:
            return 100
    return round(100 * best)


def test_blocks_are_difflibs():
    rng = random.Random(3)
    for i in range(6000):
        letters = rng.choice(["ab", "abc 1", "name:ashptil019"])
        most = 260 if i % 100 == 0 else 14
        a, b = ("".join(rng.choices(letters, k=rng.randint(1, most))) for _ in range(2))
        match = difflib.SequenceMatcher(None, a, b)
        assert fuzzy.ratio(a, b) == (100 if a == b else round(100 * match.ratio()))
        assert fuzzy.partial_ratio(a, b) == plain_partial(a, b)
        if len(b) < 200:
            assert fuzzy._blocks(a, b) == [tuple(m) for m in match.get_matching_blocks()[:-1]]


def test_short_strings_need_no_table(monkeypatch):
    def refuse(*_):
        raise AssertionError("a table of all characters for two short strings")

    monkeypatch.setattr(fuzzy.difflib, "SequenceMatcher", refuse)
    assert fuzzy.ratio("asha-patil", "asha patel") == 80
    assert fuzzy.partial_ratio("patil", "asha pattil") == 80
    assert fuzzy.token_set_ratio("asha-patil", "patil-asha") == 100
