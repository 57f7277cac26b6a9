"""Quality rules against plain loops, and learning on planted cases."""
import re
from collections import defaultdict

from veilframe.llm import quality

SCHEMA = "doc_id bigint, text string, kept string, _stats string"


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, covered = defaultdict(list), set()
    for i in range(len(words) - 7):
        seen[tuple(words[i:i + 8])].append(i)
    for at in seen.values():
        if len(at) > 1:
            covered.update(j for i in at for j in range(i, i + 8))
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


TEXTS = [
    None, "", " \t\n\x0b\x0c\r ", "one", "a b c d e f g h", "a b c d e f g h a b c d e f g h", "x " * 500, "A B   c",
    "same\nsame\n same\n\n\n \n", "\n".join(["| a | b |"] * 7), "é ü 😀 # $ % \x1c \x85 end", "a b c d e f g h i " * 3 + "tail " + "a b c d e f g h",
    " ".join(f"w{i}" for i in range(3000)), "y" * 50_000, "\r\nfoo\r\nfoo\r\n",
]


def test_base_statistics(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate(TEXTS)] + [(None, "null id", None, None), (5, TEXTS[5], "x", "y")]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    got = quality.judge(docs, labels).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for i, t in enumerate(TEXTS):
        n, chars, symbols, lines, repeats = plain(t)
        r = by_id[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeats), i
        assert r.base_failed == (n < 20 or 100 * repeats > 30 * n)
        assert r.kept == (not r.base_failed)


def test_all_documents_match(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = dict(docs.select("doc_id", "text").collect())
    for r in quality.judge(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain(texts[r.doc_id])


def test_learns_planted_conjunction(spark):
    """Bad means many symbols in a short text; long texts with symbols are good."""
    words = lambda i, n: [f"w{i}x{k}" for k in range(n)]
    rows, labels = [], []
    for i in range(1200):
        short, marked = i % 2 == 0, i % 3 == 0
        text = " ".join(w + "#$" if marked else w for w in words(i, 25 + i % 7 if short else 80 + i % 9))
        rows.append((i, text, None, None))
        labels.append((i, 0 if short and marked else 1))
    labels += [(5000, None), (None, 0), (0, 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    truth = spark.createDataFrame(labels, "doc_id bigint, quality int")
    rules = quality.learn(docs, truth)
    assert rules and all(1 <= len(r) <= quality.MAX_CONDITIONS for r in rules)
    got = {r.doc_id: r.kept for r in quality.judge(docs, truth).collect()}
    assert sum(got[i] == bool(q) for i, q in labels[:1200]) >= 1190
    kept = quality.keep_good(docs, truth)
    assert kept.columns == docs.columns and kept.count() == sum(got.values())


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    assert quality.judge(none, labels).count() == 0
    assert quality.learn(none, spark.createDataFrame([(1, 0), (2, 1)], "doc_id bigint, quality int")) == []
