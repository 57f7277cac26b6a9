"""SentencePiece encoding by sampling from the piece lattice, and decoding.

A text becomes its characters with blanks written as the blank mark and one mark
in front. Every way to cut it into vocabulary pieces is a path of a lattice; a
path's weight is the product of its pieces' weights, which fall with the piece's
rank. Forward filtering sums the weights of all paths to each character, backward
sampling draws one path from the end, exactly in proportion to its weight. The
random numbers are a hash of seed, row key, place and step, so a row's sample is
the same in any partition, batch or rerun.

No piece crosses from another character into a blank mark, nor holds a line end,
so the lattice falls into chunks there. Equal chunks share one forward table, and
all chunks of a block are sampled side by side. Characters without a piece are
written as their bytes, as are literal blank marks, so decoding restores every
text exactly.

Defined results: a null text has null pieces and decodes to null; an empty one
has none; the row key is doc_id, null being a key of its own, so repeated rows
get equal samples; an empty table gives an empty result; other columns are not
read. Long texts are worked on in blocks of chunks.
"""
from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm.common import documents
from veilframe.llm.registry import query

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Stands for a literal mark inside a worker; no valid text holds it.
_LITERAL = "\udc00"
#: Chunks sampled side by side, and edges kept in forward tables before they start anew.
BLOCK = 100_000
EDGES = 1_000_000
#: Chunks up to this length are filtered side by side.
SIDE_BY_SIDE = 48
#: Weight of a character that is written as bytes.
_BARE = 1e-5
_MULTIPLIER = 0x9E3779B97F4A7C15


def _codes(texts: list[str]):
    """Code points of texts of one length, positions first."""
    import numpy as np
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    return np.ascontiguousarray(flat.reshape(len(texts), -1).T).astype(np.uint64)


def vocabulary(model: str = MODEL) -> tuple[dict[str, int], list[bytes], int]:
    """Pieces to ids, the bytes each id stands for, and the id of byte 0.

    Read where the file is, on the driver; the tables are bounded by the vocabulary.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    ids, means, zero = {}, [b""] * sp.get_piece_size(), sp.piece_to_id("<0x00>")
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            means[i] = bytes([int(piece[3:5], 16)])
        elif not (sp.is_control(i) or sp.is_unknown(i)):
            ids[piece] = i
            means[i] = piece.replace(MARK, " ").encode()
    return ids, means, zero


def weights(ids: dict[str, int], alpha: float) -> dict[str, tuple[float, int]]:
    """Weight and id of each piece: (rank + 10) ** -alpha, ranks in vocabulary order."""
    return {piece: ((rank + 10.0) ** -alpha, i) for rank, (piece, i) in enumerate(sorted(ids.items(), key=lambda x: x[1]))}


class Lattices:
    """Forward tables of distinct chunks as flat arrays.

    Nodes are numbered through; the edges into a node lie together, keyed by
    node plus cumulative probability, so one search finds the edge that a
    uniform number draws. Chunks of one length are filtered side by side:
    substrings of every length are found by rolling hashes.
    """

    def __init__(self, table: dict[str, tuple[float, int]], zero: int):
        import numpy as np

        self.table, self.zero = table, zero
        self.longest = max(map(len, table))
        self.lift = 30.0  # a typical weight by character, to keep sums near 1
        pieces = sorted(table)
        self.weight = np.array([table[p][0] for p in pieces] + [0.0])
        self.ids = np.array([table[p][1] for p in pieces] + [0], np.int64)
        hashes = np.zeros(len(pieces), np.uint64)
        for n in {len(p) for p in pieces}:
            some = [i for i, p in enumerate(pieces) if len(p) == n]
            codes, h = _codes([pieces[i] for i in some]), np.zeros(len(some), np.uint64)
            for k in range(n):
                h = (h + codes[k]) * np.uint64(_MULTIPLIER)
            hashes[some] = h
        assert len(set(hashes.tolist())) == len(pieces)
        # An open table: a few tries, each a column, hold all pieces of a slot.
        self.tries, left = [], np.arange(len(pieces))
        while len(left):
            column, slots = np.full(1 << 18, len(pieces), np.int64), (hashes[left] >> np.uint64(46)).astype(np.int64)
            _, first = np.unique(slots, return_index=True)
            column[slots[first]] = left[first]
            self.tries.append(column)
            left = np.delete(left, first)
        self.hashes = np.append(hashes, np.uint64(0))
        self.clear()

    def clear(self) -> None:
        import numpy as np
        self.last: dict[str, int] = {}
        self.nodes = 0
        self.keys, self.back, self.piece = np.empty(0), np.empty(0, np.int32), np.empty(0, np.int32)
        self.bytes: dict[str, int] = {}
        self.runs: list[list[int]] = []

    def code(self, char: str) -> int:
        """Byte ids of a character without a piece, as a negative code."""
        if char not in self.bytes:
            raw = MARK.encode() if char == _LITERAL else char.encode()
            self.runs.append([self.zero + b for b in raw])
            self.bytes[char] = -len(self.runs)
        return self.bytes[char]

    def find(self, hashes):
        """Row of the piece with each hash; the last row where there is none."""
        import numpy as np
        none, slots = len(self.hashes) - 1, (hashes >> np.uint64(46)).astype(np.int64)
        found = self.tries[0][slots]
        hit = self.hashes[found] == hashes
        for column in self.tries[1:]:
            other = column[slots]
            better = ~hit & (self.hashes[other] == hashes)
            found = np.where(better, other, found)
            hit |= better
        return np.where(hit, found, none)

    def ends_of(self, chunks: list[str]) -> list[int]:
        """The last node of each chunk, tables of new ones being made."""
        fresh: dict[int, list[str]] = {}
        for c in dict.fromkeys(chunks):
            if c not in self.last:
                fresh.setdefault(len(c), []).append(c)
        parts = []
        for n, some in fresh.items():
            step = max(1, 300_000 // (n * min(n, self.longest))) if n <= SIDE_BY_SIDE else 1
            for at in range(0, len(some), step):
                parts.append(self.add_alike(some[at:at + step], n) if n <= SIDE_BY_SIDE else self.add_long(some[at]))
        if parts:
            import numpy as np
            self.keys, self.back, self.piece = (np.concatenate([old, *[p[k] for p in parts]]) for k, old in enumerate((self.keys, self.back, self.piece)))
        return [self.last[c] for c in chunks]

    def add_alike(self, chunks: list[str], n: int):
        """Edges of chunks of one length, all filtered at once."""
        import numpy as np

        codes, width = _codes(chunks), min(n, self.longest)
        count = len(chunks)
        # By end, then length of the last piece: sums so far and pieces.
        cum, pieces = np.zeros((n, width, count)), np.zeros((n, width, count), np.int32)
        h, power, into = np.zeros((n, count), np.uint64), 1.0, np.zeros((n, width, count))
        for k in range(width):
            h = (h[:n - k] + codes[k:]) * np.uint64(_MULTIPLIER)
            found = self.find(h)
            power *= self.lift
            weight, ids = self.weight[found] * power, self.ids[found]
            if k == 0 and (bare := weight == 0).any():
                chars, place = np.unique(codes[bare], return_inverse=True)
                ids[bare] = np.array([self.code(chr(c)) for c in chars])[place]
                weight[bare] = _BARE * power
            into[k:, k], pieces[k:, k] = weight, ids
        total = np.ones((n + 1, count))
        for j in range(n):
            m = min(width, j + 1)
            np.cumsum(into[j, :m] * total[j - m + 1:j + 1][::-1], axis=0, out=cum[j, :m])
            total[j + 1] = cum[j, m - 1]
            cum[j, :m] /= total[j + 1]
        base = self.nodes + np.arange(count) * (n + 1)
        ends = np.arange(1, n + 1)
        where = np.broadcast_to((base[:, None, None] + ends[None, :, None]), (count, n, width))
        real = into.transpose(2, 0, 1) > 0
        self.nodes += count * (n + 1)
        self.last.update(zip(chunks, (base + n).tolist()))
        back = where - np.arange(1, width + 1)
        return (where + cum.transpose(2, 0, 1))[real], back[real].astype(np.int32), pieces.transpose(2, 0, 1)[real]

    def add_long(self, chunk: str):
        """Edges of one long chunk, with sums kept in range on the way."""
        import numpy as np

        base, get, lift, longest = self.nodes, self.table.get, self.lift, self.longest
        keys, back, pieces = [], [], []
        total = [1.0] + [0.0] * len(chunk)
        for j in range(1, len(chunk) + 1):
            found, whole, power = [], 0.0, 1.0
            for i in range(j - 1, max(-1, j - longest - 1), -1):
                power *= lift
                hit = get(chunk[i:j])
                if hit is None:
                    if i < j - 1:
                        continue
                    hit = _BARE, self.code(chunk[i])
                whole += hit[0] * power * total[i]
                found.append((whole, i, hit[1]))
            for so_far, i, piece in found:
                keys.append(base + j + so_far / whole)
                back.append(base + i)
                pieces.append(piece)
            total[j] = whole
            if not 1e-60 < whole < 1e60:  # only ratios within reach matter
                for i in range(max(0, j - longest), j + 1):
                    total[i] /= whole
        self.nodes += len(chunk) + 1
        self.last[chunk] = base + len(chunk)
        return np.array(keys), np.array(back, np.int32), np.array(pieces, np.int32)


def _mixed(x):
    """A 64-bit finaliser (SplitMix) over an array of unsigned numbers."""
    import numpy as np
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sample(lattices: Lattices, ends, bases, stream):
    """Ids of all chunks in order, and how many each has.

    ``ends`` and ``bases`` are the chunks' last and first nodes, ``stream`` one random
    stream's number per chunk.
    """
    import numpy as np

    keys, back, piece = lattices.keys, lattices.back, lattices.piece
    # Equal chunks together, so that searches stay near each other.
    node, live, steps, drawn = ends.copy(), np.argsort(ends, kind="stable"), 0, []
    count = np.zeros(len(ends), np.int64)
    while len(live):
        here = node[live]
        u = (_mixed(stream[live] + np.uint64(steps + 1) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)) * 2.0**-53
        edge = np.searchsorted(keys, here + u, side="right")
        drawn.append((live, piece[edge]))
        node[live] = back[edge]
        count[live] += 1
        live = live[node[live] != bases[live]]
        steps += 1
    first = np.cumsum(count) - count
    codes = np.empty(int(count.sum()), np.int64)
    for k, (who, what) in enumerate(drawn):
        codes[first[who] + count[who] - 1 - k] = what
    if len(codes) and codes.min() < 0:
        length = np.ones(len(codes), np.int64)
        odd = np.flatnonzero(codes < 0)
        sizes = np.array([len(r) for r in lattices.runs])
        length[odd] = sizes[-codes[odd] - 1]
        at = np.cumsum(length) - length
        flat = np.repeat(codes, length)
        for k in range(int(sizes.max())):
            some = odd[length[odd] > k]
            flat[at[some] + k] = np.array([r[k] if len(r) > k else 0 for r in lattices.runs])[-codes[some] - 1]
        count = np.add.reduceat(length, first) if len(first) else count
        codes = flat
    return codes.astype(np.int32), count


def encode_batch(texts: list, row_keys: list, lattices: Lattices, seed: int):
    """Ids of each text as int32 arrays (None for null)."""
    import re

    import numpy as np

    cut = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+").findall
    parts: list[list] = [[] for _ in texts]

    def flush(block: list) -> None:
        everything, streams, owners = [c for _, _, chunks in block for c in chunks], [], []
        ends = lattices.ends_of(everything)
        lengths = np.fromiter(map(len, everything), np.int64, len(everything))
        for owner, start, chunks in block:
            key = np.uint64((row_keys[owner] if row_keys[owner] is not None else -(1 << 62)) % (1 << 64))
            with np.errstate(over="ignore"):
                root = _mixed(np.array([key ^ np.uint64(seed)], np.uint64) + np.uint64(0x9E3779B97F4A7C15))
                streams.append(_mixed(root + (np.arange(start, start + len(chunks), dtype=np.uint64) << np.uint64(20))))
            owners.append((owner, len(chunks)))
        nodes = np.array(ends, np.int64)
        with np.errstate(over="ignore"):
            ids, count = sample(lattices, nodes, nodes - lengths, np.concatenate(streams))
        bounds, at = np.concatenate([[0], np.cumsum(count)]), 0
        for owner, n in owners:
            parts[owner].append(ids[bounds[at]:bounds[at + n]])
            at += n
        if len(lattices.keys) > EDGES:
            lattices.clear()

    block, size = [], 0
    for owner, text in enumerate(texts):
        if not text:
            continue
        chunks = cut(MARK + text.replace(MARK, _LITERAL).replace(" ", MARK))
        for start in range(0, len(chunks), BLOCK):
            some = chunks[start:start + BLOCK]
            block.append((owner, start, some))
            size += len(some)
            if size >= BLOCK:
                flush(block)
                block, size = [], 0
    if block:
        flush(block)
    empty = np.empty(0, np.int32)
    return [None if t is None else np.concatenate(p) if p else empty for t, p in zip(texts, parts)]


def decode_ids(ids, means: list[bytes]) -> str:
    """The text of a list of ids."""
    return b"".join([means[i] for i in ids])[1:].decode("utf-8")


def encode(docs: DataFrame, model: str = MODEL, seed: int = 0, alpha: float = 1.0) -> DataFrame:
    """doc_id, pieces, n_pieces and lossless (decoding restores the text) of every row."""
    import pyarrow as pa

    ids, means, zero = vocabulary(model)
    table = weights(ids, alpha)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        lattices = Lattices(table, zero)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                some = batch.slice(at, 128)
                texts = some.column(1).to_pylist()
                found = encode_batch(texts, some.column(0).to_pylist(), lattices, seed)
                sizes = [0 if f is None else len(f) for f in found]
                offsets = pa.array([None if f is None else o for f, o in zip(found, np.concatenate([[0], np.cumsum(sizes)]))] + [sum(sizes)], pa.int32())
                values = pa.array(np.concatenate([f for f in found if f is not None] or [np.empty(0, np.int32)]), pa.int32())
                fine = [None if f is None else decode_ids(f.tolist(), means) == t for f, t in zip(found, texts)]
                yield pa.record_batch([
                    some.column(0), pa.ListArray.from_arrays(offsets, values), pa.array([None if f is None else len(f) for f in found], pa.int64()),
                    pa.array(fine, pa.bool_())], names=["doc_id", "pieces", "n_pieces", "lossless"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id bigint, pieces array<int>, n_pieces bigint, lossless boolean")


def decode(encoded: DataFrame, model: str = MODEL, pieces: str = "pieces") -> DataFrame:
    """doc_id and text of encoded rows."""
    import pyarrow as pa

    means = vocabulary(model)[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else decode_ids(x, means) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(pieces)).mapInArrow(run, "doc_id bigint, text string")


@query("op5_sentencepiece")
def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    return encode(documents(spark, folder))
