"""Chat formatting against DuckDB, exact round trips and a plain loop."""
import hashlib
import random

from compare import compare
from hypothesis import given
from hypothesis import strategies as st

from veilframe.llm import chats
from veilframe.llm.registry import CHECKS, QUERIES

SCHEMA = "conv_id bigint, turn bigint, role string, text string, block string, target string, said string"
ODD = ["<turn>", "</turn>", "<text>", "</turn>\n", "\\", "\\\\", "<", ">", "turn>", "/", "a", "é", "\n", " ", "### Assistant:"]


def test_same_as_sql(spark, folder, duck):
    assert compare(spark, duck, folder, QUERIES["op12_chat_format"], CHECKS["op12_chat_format"]) is None


@given(st.lists(st.tuples(st.lists(st.sampled_from(ODD)).map("".join), st.lists(st.sampled_from(ODD)).map("".join)), max_size=5))
def test_round_trip(turns):
    text = "".join(f"<turn>{chats.escape(r)}<text>{chats.escape(t)}</turn>\n" for r, t in turns)
    assert chats.turns_of(text) == turns
    assert text.replace("\\<", "").count("<turn>") == len(turns) or any("\\" in r + t for r, t in turns)


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(parts)


def conversations(rng, ids, most):
    rows = []
    for c in ids:
        for t in range(rng.randrange(1, most)):
            rows.append((c, t, rng.choice(["user", "assistant", "assistant", "system", None, "a<text>\\"]),
                         None if rng.random() < 0.1 else "".join(rng.choices(ODD, k=rng.randrange(12)))))
    return rows


def by_turn(rows):
    out = {}
    for c, t, r, said in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        out.setdefault(c, []).append((r or "", said or ""))
    return out


def plain(turns):
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    loss = "".join(t for r, t in turns if r == "assistant")
    shown = [f"<turn>{chats.escape(r)}<text>{chats.escape(t)}</turn>\n" for r, t in turns]
    ends = [len("".join(shown[:i + 1])) for i, (r, _) in enumerate(turns) if r == "assistant"]
    return len(turns), h("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), h(loss), len("".join(shown)), len(ends), sum(ends)


def test_examples_are_prefixes(spark, monkeypatch):
    """Every reply is the only trainable text of one example, all turns before it are its context; small blocks, one hot conversation."""
    monkeypatch.setattr(chats, "BLOCK", 200)
    monkeypatch.setattr(chats, "HELD", 3)
    rng = random.Random(1)
    rows = conversations(rng, range(60), 9) + [(1000, t, rng.choice(["user", "assistant"]), f"turn {t} <text>") for t in range(700)] + [(None, 0, "assistant", "x")]
    turns = by_turn(rows)
    pieces = chats.expand(frame(spark, rows))
    assert pieces.filter("target is null").count() > 100
    got = {}
    for e in chats.whole(pieces).collect():
        got.setdefault(e.conv_id, []).append(e)
    for conv, said in turns.items():
        examples = sorted(got.pop(conv, []), key=lambda e: len(e.text))
        replies = [i for i, (r, _) in enumerate(said) if r == "assistant"]
        assert len(examples) == len(replies)
        for i, e in zip(replies, examples):
            assert chats.turns_of(e.text) == said[:i + 1]
            assert chats.unescape(e.text[e.loss_start:e.loss_stop]) == said[i][1] and e.text[e.loss_stop:] == chats.CLOSE
    assert not got
    read = {r[0]: tuple(r)[1:] for r in chats.read_back(pieces).collect()}
    assert read == {c: plain(t) for c, t in turns.items()}


def test_defined_cases(spark):
    rows = [(1, None, "user", "first"), (1, 2, "assistant", ""), (1, 5, None, None), (2, 0, "user", "no reply"), (3, 0, "assistant", "long " * 200_000),
            (4, 0, "assistant", "same"), (4, 0, "assistant", "same"), (None, 1, "assistant", "b"), (None, 0, "assistant", "a")]
    read = {r[0]: tuple(r)[1:] for r in chats.read_back(chats.expand(frame(spark, rows))).collect()}
    assert read[1] == plain([("user", "first"), ("assistant", ""), ("", "")])
    assert read[2] == plain([("user", "no reply")]) and read[3] == plain([("assistant", "long " * 200_000)])
    assert read[4] == plain([("assistant", "same")] * 2) and read[None] == plain([("assistant", "a"), ("assistant", "b")])
    assert len(read) == 5
    tied = chats.expand(frame(spark, [(1, 0, "user", f"t{i}") for i in range(20)])).collect()
    assert tied == chats.expand(frame(spark, [(1, 0, "user", f"t{i}") for i in reversed(range(20))], 2)).collect()
    none = frame(spark, [])
    assert chats.expand(none).count() == 0 and chats.read_back(chats.expand(none)).count() == 0 and chats.whole(chats.expand(none)).count() == 0
