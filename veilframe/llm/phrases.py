"""Phrase mining by best-first branch-and-bound growth.

Phrases of two to four words are scored, per language, by how much of their
parts' occurrences they make up; the first ``TOP`` of those that no longer phrase
explains come out, with exact counts over the whole corpus.

Growth starts at words, then at pairs, which are all counted. A phrase grown from
a prefix p with first word w is no more frequent than p, so its score is at most
that of count f(p) against f(w) + f(p): the prefix's counts bound
all that can grow from it. The frontier is opened in order of that bound, in
batches: all nodes whose bound reaches a score tau are grown by one word, then those
of their children that reach it. Every candidate that scores tau or more is then
known, and so are the extensions that may explain it. A language is
settled once ``TOP`` phrases with tau or more survive; else tau falls to the score of
a four times lower rank, and only nodes between the two are opened. Ties at the last
place are settled too, as tau is reached inclusively.

Tasks count over slices of whole texts, in chunks, and shuffle (language, phrase,
count). What to count is told by bitmaps of a fixed size over hashes; a phrase that
meets a set bit by chance is counted exactly and then dropped, so they save work and
decide nothing.

Defined results: a null text is empty, a null lang is ``und``; equal rows count as often
as they come; languages of any number and size are spread over tasks; texts of
any length are read in slices without losing a phrase; an empty table gives an empty
result; other columns are not read.
"""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilframe.llm.common import BROADCAST_ROWS, documents
from veilframe.llm.registry import query
from veilframe.session import checkpoint

TOP, LEAST, LONGEST = 2000, 30, 4
#: The first batch takes pairs of as many times TOP ranks.
FIRST = 4
FULL = 2_000_000
#: Bits of a filter (4 MB), tokens to a chunk, bytes to a slice, words and languages a task remembers.
FILTER_BITS, CHUNK, SLICE, WORDS, LANGS = 25, 1 << 20, 1 << 22, 1 << 20, 64
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_ONE_BREAK = bytes.maketrans(_BREAKS, b"." * len(_BREAKS))
_EDGE = re.compile(rb"[\x20\t.,;:!?\n-\r]")
_COUNTED = "lang string, phrase string, f bigint"


def tokens_of(text: bytes) -> Iterator[list[bytes]]:
    """Lower-case words of a text, slice by slice, with ``.`` where a piece ends."""
    at = 0
    while at < len(text):
        stop = at + SLICE
        edge = _EDGE.search(text, stop) if stop < len(text) else None
        stop = edge.end() if edge else len(text)
        yield text[at:stop].lower().translate(_ONE_BREAK).replace(b".", b" . ").split()
        at = stop


def _word_hashes(lang: str, words: list[bytes]):
    import numpy as np
    import xxhash

    digest, head = xxhash.xxh64_intdigest, lang.encode() + b"\0"
    return np.fromiter((digest(head + w) for w in words), np.uint64, len(words))


def _bits(hashes: list):
    """Places in a filter of phrases, given the hashes of their first, second .. words."""
    import numpy as np

    with np.errstate(over="ignore"):
        mixed = reduce(lambda acc, h: acc * np.uint64(0x9E3779B97F4A7C15) + h, hashes)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def phrase_filter(phrases: DataFrame):
    """A broadcast bitmap of the places of (lang, phrase); 2**FILTER_BITS bits whatever their number."""
    import numpy as np
    import pyarrow as pa

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [int(_bits(list(_word_hashes(lang, phrase.encode().split(b" "))))) for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.record_batch([pa.array(out, pa.int64())], names=["bit"])

    bit = F.col("bit") + 1
    found = phrases.select("lang", "phrase").mapInArrow(placed, "bit bigint").groupBy(F.bitmap_bucket_number(bit).alias("no")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
    bitmap = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for row in found:
        bits = np.frombuffer(row["bits"], np.uint8)[:len(bitmap)]
        bitmap[(row["no"] - 1) * 4096:(row["no"] - 1) * 4096 + len(bits)] = bits
    return phrases.sparkSession.sparkContext.broadcast(bitmap)


def _holds(bitmap, bits):
    return (bitmap[bits >> 3] >> (bits & 7).astype("u1")) & 1 != 0


class _Vocabulary(dict):
    """Numbers a task's words; 0 is the end of a piece. What is known of a word is looked up in bulk."""

    def __init__(self, lang: str, common):
        import numpy as np

        super().__init__({b".": 0})
        self.lang, self.common, self.words = lang, common, [b"."]
        self.hashes, self.usual = np.zeros(1, np.uint64), np.zeros(1, bool)

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.words)
        self.words.append(word)
        return number

    def learn(self) -> None:
        """Hashes of the words that came in, and whether they are common."""
        import numpy as np

        fresh = self.words[len(self.hashes):]
        hashes = _word_hashes(self.lang, fresh)
        self.hashes = np.concatenate([self.hashes, hashes])
        self.usual = np.concatenate([self.usual, _holds(self.common, _bits([hashes]))])


class _Chunks:
    """The token stream of one language in a task, counted chunk by chunk.

    ``wanted`` has, per size of phrase, the filters of what a phrase may begin with
    and end with; None lets every phrase of common words pass.
    """

    def __init__(self, lang: str, common, wanted: dict):
        self.lang, self.common, self.wanted = lang, common, wanted
        self.numbers, self.waiting, self.held = _Vocabulary(lang, common), [], 0
        self.kept = max(wanted) - 1

    def add(self, tokens: list[bytes]) -> Iterator[tuple]:
        import numpy as np

        self.waiting.append(np.fromiter(map(self.numbers.__getitem__, tokens), np.int64, len(tokens)))
        self.held += len(tokens)
        if self.held >= CHUNK or len(self.numbers) > WORDS:
            yield from self.counted()

    def end(self) -> None:
        """No phrase goes on into the next text."""
        import numpy as np

        self.waiting.append(np.zeros(self.kept, np.int64))

    def counted(self) -> Iterator[tuple]:
        """Phrases of the waiting tokens and their counts, as Arrow arrays; the last few tokens wait on."""
        import numpy as np
        import pyarrow as pa

        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.int64)
        words, tail = self.numbers.words, ids[-self.kept:]
        self.numbers.learn()
        usual, named = self.numbers.usual[ids], pa.array(words, pa.binary())
        for m, filters in self.wanted.items():
            # Of shorter phrases those that lie in the last tokens are counted with what follows.
            span = max(0, len(ids) - self.kept)
            yield self._of_size(ids, usual, named, span, m, filters)
        if len(self.numbers) > WORDS:
            self.numbers = _Vocabulary(self.lang, self.common)
            tail = np.fromiter((self.numbers[words[i]] for i in tail.tolist()), np.int64, len(tail))
        self.waiting, self.held = [tail], len(tail)

    def _of_size(self, ids, usual, named, span: int, m: int, filters) -> tuple:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        hashes = self.numbers.hashes
        at = np.flatnonzero(reduce(np.logical_and, [usual[k:k + span] for k in range(m)]))
        if filters is not None:
            before, after = filters
            pass_ = np.zeros(len(at), bool)
            for kept, first in ((before, 0), (after, 1)):
                if kept is not None:
                    pass_ |= _holds(kept, _bits([hashes[ids[at + first + k]] for k in range(m - 1)]))
            at = at[pass_]
        # A phrase's number: that of all words but the last, in order, then the last word's.
        key = ids[at]
        for k in range(1, m):
            key = (np.unique(key, return_inverse=True)[1] if k > 1 else key) << 32 | ids[at + k]
        _, index, n = np.unique(key, return_index=True, return_counts=True)
        columns = [named.take(pa.array(ids[at[index] + k])) for k in range(m)]
        return pc.binary_join_element_wise(*columns, b" ").cast(pa.string()), pa.array(n, pa.int64())


def counts(docs: DataFrame, common=None, wanted: dict | None = None) -> DataFrame:
    """lang, phrase and f of phrases with LEAST occurrences or more.

    Without ``wanted``, of single words, with a row of null phrase that counts all
    words. Else of phrases of ``common`` words of the wanted sizes, whose value is a pair of
    filters, of what a phrase begins with and of what it ends with; one of them
    must hold. None takes every phrase.
    """
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = lambda b: None if b is None else b.value
        told = wanted and {m: f and tuple(map(value, f)) for m, f in wanted.items()}
        by_lang: dict = {}

        def out(lang, phrases, numbers):
            return pa.record_batch([pa.repeat(pa.scalar(lang, pa.string()), len(phrases)), phrases, numbers], names=["lang", "phrase", "f"])

        def words_out(lang, c):
            del c[b"."]
            return out(lang, pa.array([*c, None], pa.binary()).cast(pa.string()), pa.array([*c.values(), sum(c.values())], pa.int64()))

        def all_out():
            while by_lang:
                lang, state = by_lang.popitem()
                if told:
                    state.end()
                    yield from (out(lang, *found) for found in state.counted())
                else:
                    yield words_out(lang, state)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for tokens in tokens_of(text.as_buffer().to_pybytes()):
                    if not told:
                        c = by_lang.setdefault(lang, Counter())
                        c.update(tokens)
                        if len(c) > WORDS // 2:
                            yield words_out(lang, by_lang.pop(lang))
                        continue
                    if lang not in by_lang:
                        by_lang[lang] = _Chunks(lang, value(common), told)
                    yield from (out(lang, *found) for found in by_lang[lang].add(tokens))
                if told and lang in by_lang:
                    by_lang[lang].end()
                if len(by_lang) > LANGS:
                    yield from all_out()
        yield from all_out()

    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    summed = rows.mapInArrow(run, _COUNTED).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    return checkpoint(summed.filter((F.col("f") >= LEAST) | F.col("phrase").isNull()))


def _words(phrase: Column, k: int) -> Column:
    return F.substring_index(phrase, " ", k)


def _score(a: Column, parts: Column) -> Column:
    """floor(FULL * a / parts), in decimals wide enough for any count."""
    wide = a.cast("decimal(20,0)") * F.lit(FULL).cast("decimal(8,0)")
    return F.call_function("div", wide, parts.cast("decimal(21,0)"))


def scored(found: DataFrame, size: int, known: DataFrame) -> DataFrame:
    """Candidates with l, r and score of their lowest-scoring cut, and the bound on
    what grows from them. ``known`` has the counts of all their parts; a candidate
    of which one is missing is left out."""
    out = found.filter("phrase is not null").withColumnRenamed("f", "a")
    table = known.filter("phrase is not null")
    cuts = []
    for k in range(1, size):
        for side, part in (("l", _words(F.col("phrase"), k)), ("r", _words(F.col("phrase"), k - size))):
            out = out.withColumn("_part", part).join(
                table.select("lang", F.col("phrase").alias("_part"), F.col("f").alias(f"{side}{k}")), ["lang", "_part"]).drop("_part")
        l, r = F.col(f"l{k}"), F.col(f"r{k}")
        cuts.append(F.struct(_score(F.col("a"), l + r).alias("score"), F.lit(k).alias("k"), l.alias("l"), r.alias("r")))
    return out.select("lang", "phrase", "a", F.array_min(F.array(*cuts)).alias("_c"), _score(F.col("a"), F.col("l1") + F.col("a")).alias("bound")).select(
        "lang", "phrase", "a", "_c.l", "_c.r", "_c.score", "bound")


def _at_rank(rows: DataFrame, rank: int) -> DataFrame:
    """Per language the score of that rank, 0 if it has fewer rows. Scores are whole
    numbers up to FULL / 2, so a language has so many counts at most."""
    by_score = rows.groupBy("lang", "score").agg(F.count("*").alias("n"))
    down = by_score.withColumn("above", F.sum("n").over(Window.partitionBy("lang").orderBy(F.col("score").desc())))
    return down.groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("above") >= rank, F.col("score"))), F.lit(0)).alias("tau"))


def _with(rows: DataFrame, by_lang: DataFrame, how: str = "inner") -> DataFrame:
    """Join to a table of one row per language, by broadcast if they are few enough."""
    return rows.join(F.broadcast(by_lang) if by_lang.count() <= BROADCAST_ROWS else by_lang, "lang", how)


def _between(rows: DataFrame, taus: DataFrame, what: str) -> DataFrame:
    """Rows whose value reaches tau for the first time."""
    return _with(rows, taus).filter((F.col(what) >= F.col("tau")) & (F.col(what) < F.col("before"))).select(*rows.columns)


def _unexplained(rows: DataFrame, size: int, longer: DataFrame) -> DataFrame:
    """Candidates without an extension by one word of 80 % of their count or more.

    A phrase of two more words that explains one does so through one of one
    more word, which is at least as frequent.
    """
    phrase = F.col("phrase")
    sides = longer.filter("phrase is not null").select("lang", F.explode(F.array(_words(phrase, size), _words(phrase, -size))).alias("phrase"), "f")
    most = sides.groupBy("lang", "phrase").agg(F.max("f").alias("_most"))
    return rows.join(most, ["lang", "phrase"], "left").filter(
        F.col("_most").isNull() | (100 * F.col("_most").cast("decimal(20,0)") < 80 * F.col("a").cast("decimal(20,0)"))).drop("_most")


def _joined(old: DataFrame | None, more: DataFrame) -> DataFrame:
    """Counts of old and new phrases, each once; a phrase counted twice has the same count."""
    return more if old is None else checkpoint(old.unionByName(more).distinct())


def mine(docs: DataFrame) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first phrases."""
    spark = docs.sparkSession
    docs = docs.select("lang", "text")
    words = counts(docs)
    common = phrase_filter(words.filter("phrase is not null"))
    pairs = counts(docs, common, {2: None})
    two = checkpoint(scored(pairs, 2, words))
    known = words.unionByName(pairs)
    open_langs = two.select("lang").distinct().withColumn("before", F.lit(FULL).cast("bigint"))
    threes = fours = None
    settled, rank = [], FIRST * TOP
    while True:
        taus = checkpoint(_at_rank(two, rank).join(open_langs, "lang"))
        if taus.isEmpty():
            break
        # Pairs are grown where their bound, and looked behind where their score, reaches tau.
        grown, likely = _between(two, taus, "bound"), _between(two, taus, "score")
        threes = _joined(threes, counts(docs, common, {3: (phrase_filter(grown), phrase_filter(likely))}))
        three = checkpoint(scored(threes, 3, known))
        grown, likely = checkpoint(_between(three, taus, "bound")), _between(three, taus, "score")
        # What a grown phrase ends with may end a longer one, and so has its own count taken.
        ends = phrase_filter(grown.select("lang", _words(F.col("phrase"), -2).alias("phrase")).distinct())
        more = counts(docs, common, {4: (phrase_filter(grown), phrase_filter(likely)), 3: (ends, None)})
        blanks = F.length("phrase") - F.length(F.replace("phrase", F.lit(" "), F.lit("")))
        fours, threes = _joined(fours, more.filter(blanks == 3)), _joined(threes, more.filter(blanks == 2))
        parents = _with(three, taus).filter("bound >= tau").select("lang", F.col("phrase").alias("_p"))
        near = fours.withColumn("_p", _words(F.col("phrase"), 3)).join(parents, ["lang", "_p"], "left_semi").drop("_p")
        four = scored(near, 4, known.unionByName(threes))
        reached = _unexplained(two, 2, threes).unionByName(_unexplained(three, 3, fours)).unionByName(four)
        reached = checkpoint(_with(reached, taus).filter("score >= tau"))
        left = reached.groupBy("lang").agg(F.count("*").alias("n")).join(taus, "lang", "right")
        left = checkpoint(left.withColumn("done", (F.coalesce("n", F.lit(0)) >= TOP) | (F.col("tau") == 0)))
        settled.append(_with(reached, left.filter("done").select("lang"), "left_semi"))
        open_langs, rank = left.filter("not done").select("lang", F.col("tau").alias("before")), 4 * rank
    if not settled:
        return spark.createDataFrame([], "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint")
    along = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    best = reduce(DataFrame.unionByName, settled).withColumn("rank", F.row_number().over(along).cast("bigint")).filter(F.col("rank") <= TOP)
    totals = words.filter("phrase is null").select("lang", F.col("f").alias("n"))
    return _with(best, totals).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _check() -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    grams = "\n  UNION ALL ".join(
        f"SELECT lang, {m} AS m, unnest(list_transform(range(1, len(ws) - {m - 2}), lambda i: array_to_string(ws[i:i + {m - 1}], ' '))) AS phrase FROM w"
        for m in range(1, LONGEST + 1))
    return f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{upper}', '{upper.lower()}') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') AS ws FROM p),
f AS (SELECT lang, m, phrase, count(*) AS f FROM ({grams}) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE m > 1 AND f >= {LEAST}),
k AS (SELECT lang, m, phrase, f AS a, ws, unnest(range(1, m)) AS k FROM c),
x AS (SELECT k.lang, k.m, k.phrase, a, k, l.f AS l, r.f AS r, ({FULL}::HUGEINT * a // (l.f + r.f))::BIGINT AS score FROM k
  JOIN f l ON l.lang = k.lang AND l.m = k AND l.phrase = array_to_string(ws[1:k], ' ')
  JOIN f r ON r.lang = k.lang AND r.m = k.m - k AND r.phrase = array_to_string(ws[k + 1:], ' ')),
s AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, f, ws, m, unnest(range(2, m)) AS size FROM c),
j AS (SELECT lang, f, ws, size, unnest(range(1, m - size + 2)) AS i FROM i),
e AS (SELECT lang, array_to_string(ws[i:i + size - 1], ' ') AS phrase, max(f) AS most FROM j GROUP BY ALL),
v AS (SELECT s.* FROM s LEFT JOIN e USING (lang, phrase) WHERE e.most IS NULL OR 100::HUGEINT * e.most < 80::HUGEINT * s.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM v) JOIN n USING (lang) WHERE rank <= {TOP}
"""


CHECK = _check()


@query("op11_collocations", CHECK)
def _collocations(spark: SparkSession, folder: str) -> DataFrame:
    return mine(documents(spark, folder))
