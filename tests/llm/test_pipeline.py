"""Every stage of the pipeline against a brute-force version on its own input."""
import re
from collections import Counter, defaultdict

import corpus_pipeline
from test_mixing import fill
from test_quality import plain as plain_statistics
from test_simhash import plain_fingerprint, plain_groups

from veilframe.llm import mixing, pieces, quality


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_stages(spark, folder, tmp_path):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, results = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(str(tmp_path / name))
        # Files of a table come back in any order; training order is that of the rows.
        results[name] = (docs.collect(), (out if name == "mix_sources" else spark.read.parquet(str(tmp_path / name))).collect())
        docs = spark.read.parquet(str(tmp_path / name))
        assert name == "encode" or docs.columns == columns

    before, after = results["quality_rules"]
    good = {r.doc_id for r in labels.filter("quality = 1").collect()}
    kept = {r.doc_id for r in after}
    for r in before:
        n, _, _, _, repeats = plain_statistics(r.text)
        if n < 20 or 100 * repeats > 30 * n:
            assert r.doc_id not in kept
        elif r.doc_id in good:
            assert r.doc_id in kept
    rules = quality.learn(spark.read.parquet(f"{folder}/documents.parquet"), labels)
    judged = {r.doc_id for r in quality.judge(spark.read.parquet(f"{folder}/documents.parquet"), labels).filter("kept").collect()}
    assert kept == judged and isinstance(rules, list)

    before, after = results["exact_dedup"]
    groups = defaultdict(list)
    for r in before:
        groups[(r.text or "").encode().lower()].append(r.doc_id)
    assert sorted(r.doc_id for r in after) == sorted(map(max, groups.values()))

    before, after = results["near_dedup"]
    least = plain_groups({r.doc_id: plain_fingerprint(r.text) for r in before})
    assert sorted(r.doc_id for r in after) == sorted(set(least.values()))

    before, after = results["mix_sources"]
    sizes, longest, took = Counter(), Counter(), Counter()
    for r in before:
        sizes[r.source] += len(words(r.text))
        longest[r.source] = max(longest[r.source], len(words(r.text)))
    turns = Counter(r.doc_id for r in after)
    for r in after:
        took[r.source] += len(words(r.text))
    assert max(turns.values()) <= 2 and {tuple(r) for r in after} <= {tuple(r) for r in before}
    for source, target in fill(sizes).items():
        assert abs(took[source] - target) <= longest[source] / 2 + 1
    position = {r.doc_id: r.positions for r in mixing.mix(spark.createDataFrame(before, docs_schema(spark, folder))).collect()}
    order = [position[r.doc_id] for r in after]
    firsts = [min(p) for p, r in zip(order, after) if turns[r.doc_id] == 1]
    assert firsts == sorted(firsts)

    before, after = results["encode"]
    texts = defaultdict(list)
    for r in before:
        texts[r.doc_id].append(r.text)
    means = pieces.vocabulary()[1]
    assert Counter(r.doc_id for r in after) == turns
    assert all(r.lossless and pieces.decode_ids(r.pieces, means) in texts[r.doc_id] for r in after)
    run = corpus_pipeline.run(spark, folder).collect()
    assert sorted(map(repr, run)) == sorted(map(repr, after))


def docs_schema(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet").schema


def test_stages_on_nothing(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert docs.count() == 0
