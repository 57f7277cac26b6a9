"""Chat formatting with prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are
context, its reply alone is trainable, nothing after it is seen. A conversation
is formatted once, turn by turn, as ``<turn>role<text>text</turn>`` and a line
break; a backslash goes before a backslash and before every control string
inside a role or text, which makes formatting reversible.

All examples of a conversation begin with the same text, and written out in full
they grow with the square of its length. So the formatted conversation is
cut after every turn that fills a block, and an example carries its own text from
the last cut on: the block's turns up to and including its reply. Turns before the
cut are the conversation's earlier blocks, which come out once, beside the examples;
a conversation of less than one block has all of its context in each example.
``whole`` puts the full texts together.

Turns are sorted over range partitions and streamed through their tasks, one
block at a time, so a conversation of any length is spread over tasks.

Defined results: null roles and texts are empty; turns of one number are ordered
by a hash of role and text, a null turn comes first; a null conv_id is a
conversation like others; repeated rows are repeated turns; a conversation without
assistant turns has blocks but no examples; an empty reply is an example with
nothing under the mask; an empty table gives an empty result; other columns are not read.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm.registry import query
from veilframe.session import checkpoint

#: Code points after which a block is closed at the end of a turn.
BLOCK = 1 << 15
TARGET = "assistant"
OPEN, MIDDLE, CLOSE = "<turn>", "<text>", "</turn>\n"
_CONTROL = re.compile(r"\\|</?turn>|<text>")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<turn>([^\\<]*(?:(?:\\.|<(?!text>))[^\\<]*)*)<text>([^\\<]*(?:(?:\\.|<(?!/turn>))[^\\<]*)*)</turn>\n", re.S)

PIECES = "conv_id bigint, block bigint, target bigint, text string, loss_start bigint, loss_stop bigint"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m.group(), text) if "\\" in text or "<" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def turns_of(text: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted text; an error if it is none."""
    out, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m.group(1)), unescape(m.group(2))))
        at = m.end()
    return out


def _streamed(rows: DataFrame, work, schema: str) -> DataFrame:
    """``work`` from the rows of a partition to output rows, in batches of a few megabytes."""
    import pyarrow as pa

    fields = [c.split() for c in schema.split(", ")]
    kinds = {"bigint": pa.int64(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(out):
            return pa.record_batch([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*out), fields)], names=[n for n, _ in fields])

        out, size = [], 0
        for row in work(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))):
            out.append(row)
            size += 200 + sum(len(v) for v in row if isinstance(v, str))
            if size >= 1 << 22:
                yield batch_of(out)
                out, size = [], 0
        if out:
            yield batch_of(out)

    return rows.mapInArrow(run, schema)


def arranged(turns: DataFrame) -> DataFrame:
    """Turns in order over range partitions."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), text("role"), text("text"))
    order = ["conv_id", "turn", "_tie"]
    return rows.withColumn("_tie", F.xxhash64("role", "text")).repartitionByRange(*order).sortWithinPartitions(*order, "role", "text").drop("turn", "_tie")


def expand(turns: DataFrame) -> DataFrame:
    """Formatted pieces of all conversations: conv_id, block, target, text and the span of the loss mask.

    ``turns`` has conv_id, turn, role and text. Rows with a null target are the
    blocks; they make up the conversation in order of ``block``. Every other row is
    one example: its context are the blocks with smaller numbers and what
    stands before ``loss_start`` in its text, code points of which from ``loss_start`` to
    ``loss_stop`` are trainable. Targets count assistant turns from 0 within a block.
    """
    def work(rows: Iterator[tuple]) -> Iterator[tuple]:
        from pyspark import TaskContext

        block, conv = TaskContext.get().partitionId() << 33, None  # ascends with the range
        shown, replies, size = [], [], 0

        def closed() -> Iterator[tuple]:
            """The block's row, then an example for each of its replies."""
            text = "".join(shown)
            yield conv, block, None, text, None, None
            for i, (begin, stop) in enumerate(replies):
                yield conv, block, i, text[:stop + len(CLOSE)], begin, stop

        for at, role, said in rows:
            if shown and (at != conv or size >= BLOCK):
                yield from closed()
                block, shown, replies, size = block + 1, [], [], 0
            conv = at
            head, body = f"{OPEN}{escape(role)}{MIDDLE}", escape(said)
            if role == TARGET:
                replies.append((size + len(head), size + len(head) + len(body)))
            shown.append(f"{head}{body}{CLOSE}")
            size += len(shown[-1])
        if shown:
            yield from closed()

    return _streamed(arranged(turns), work, PIECES)


def whole(pieces: DataFrame) -> DataFrame:
    """Examples with their full texts, for conversations whose texts fit a row: conv_id,
    block, target, text and the span of the loss mask in it."""
    blocks = pieces.filter("target is null").select(F.col("conv_id").alias("_conv"), F.col("block").alias("_block"), F.col("text").alias("_text"))
    earlier = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_block") < F.col("block"))
    met = pieces.filter("target is not null").join(blocks, earlier, "left")
    joined = met.groupBy("conv_id", "block", "target").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_block").isNotNull(), F.struct("_block", "_text")))), lambda b: b["_text"]), "").alias("_head"),
        F.first("text").alias("text"), F.first("loss_start").alias("a"), F.first("loss_stop").alias("b"))
    return joined.select("conv_id", "block", "target", F.concat("_head", "text").alias("text"), (F.length("_head") + F.col("a")).alias("loss_start"),
                         (F.length("_head") + F.col("b")).alias("loss_stop"))


class _Digest:
    """What is read back of one conversation, block by block."""

    def __init__(self):
        self.turns = self.loss_chars = self.chars = self.examples = self.example_chars = 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, block: tuple) -> None:
        _, turns, said, loss, chars, examples, example_chars = block
        self.all.update(said.encode())
        self.loss.update(loss.encode())
        self.turns += turns
        self.loss_chars += len(loss)
        self.examples += examples
        self.example_chars += examples * self.chars + example_chars  # earlier blocks are each example's context
        self.chars += chars

    def row(self) -> tuple:
        return self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.examples, self.example_chars


def _blocks_read(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(conv_id, (block, turns, all text, masked text, code points, examples, their code points)) of each block's pieces."""
    conv = now = None
    for at, block, target, text, start, stop in rows:
        if target is None:
            if now is not None:
                yield conv, now
            turns = turns_of(text)
            conv, now = at, (block, len(turns), "".join(f"{role}\n{said}\n" for role, said in turns), "", len(text), 0, 0)
        else:
            now = (*now[:3], now[3] + unescape(text[start:stop]), now[4], now[5] + 1, now[6] + len(text))
    if now is not None:
        yield conv, now


_READ = ("conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, "
         "n_examples bigint, example_chars bigint")
_PART = "block bigint, turns bigint, said string, loss string, chars bigint, examples bigint, lengths bigint"
#: Blocks of a conversation that a task holds while it may be the partition's last.
HELD = 64


def _digested(blocks: Iterator[tuple], edges: bool) -> Iterator[tuple]:
    """One row per conversation. With ``edges`` the first and the last, which may begin
    before or go on after, come out as their blocks instead, and so do very long ones."""
    state, conv, loose, held, none = None, None, False, [], (None,) * 7
    for at, block in blocks:
        if state is None or at != conv:
            if state is not None and not loose:
                yield conv, *state.row(), *none
            loose, held, conv, state = edges and state is None, [], at, _Digest()
        if loose:
            yield at, *none, *block
            continue
        state.add(block)
        if edges:
            held.append(block)
            if len(held) > HELD:
                yield from ((at, *none, *b) for b in held)
                loose = True
    if state is not None and not loose:
        yield from ((conv, *none, *b) for b in held) if edges else [(conv, *state.row(), *none)]


def read_back(pieces: DataFrame) -> DataFrame:
    """Per conversation what its pieces hold: turns, text, masked text and lengths, all parsed from the formatted texts.

    Pieces are read where they were made. Only conversations that cross two
    partitions are brought together, as a digest runs through a text from end to
    end; their blocks stream through the task.
    """
    read = checkpoint(_streamed(pieces.select(*[c.split()[0] for c in PIECES.split(", ")]), lambda rows: _digested(_blocks_read(rows), True), f"{_READ}, {_PART}"))
    done = [c.split()[0] for c in _READ.split(", ")]
    loose = read.filter("block is not null").select("conv_id", *[c.split()[0] for c in _PART.split(", ")])
    rest = _streamed(loose.repartition("conv_id").sortWithinPartitions("conv_id", "block"),
                     lambda rows: _digested(((r[0], r[1:]) for r in rows), False), f"{_READ}, {_PART}")
    return read.filter("block is null").select(*done).unionByName(rest.select(*done))


CHECK = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
e AS (SELECT *, length(regexp_replace(role, '\\|</?turn>|<text>', '\\\0', 'g')) AS role_size,
  length(regexp_replace(text, '\\|</?turn>|<text>', '\\\0', 'g')) AS text_size FROM c),
s AS (SELECT *, role_size + text_size + 20 AS size, sum(role_size + text_size + 20) OVER (PARTITION BY conv_id ORDER BY turn) AS stop FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn), '')) AS loss_sha256,
  sum(size)::BIGINT AS formatted_chars, count(*) FILTER (role = 'assistant') AS n_examples,
  coalesce(sum(stop) FILTER (role = 'assistant'), 0)::BIGINT AS example_chars
FROM s GROUP BY conv_id
"""


@query("op12_chat_format", CHECK)
def _chats(spark: SparkSession, folder: str) -> DataFrame:
    turns = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise(TARGET).alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))
    return read_back(expand(turns.unionByName(added)))
