"""Joins of tables that views and generators make large: no side is collected by the driver."""
import random
import re

import pytest
from pyspark.sql import functions as F

import veilframe.plans  # noqa: F401
from veilframe import catalogue as C
from veilframe.functions import fuzzy, geometry, greedy
from veilframe.operators import align, boxes, tokens
from veilframe.plans.registry import QUERIES

LARGE = ["anon_examples", "dedup_tokens", "ner_align", "ner_align_v0", "ner_align_fuzzy", "token_labels", "all_detections", "anti_overlap",
         "name_propagate", "regex_align", "regex_align_v1", "regex_align_exact", "token_windows", "health_patterns", "field_values", "fuzz_scores"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LARGE)
def test_no_side_is_broadcast(spark, folder, name):
    # The smallest tables, which Spark would broadcast unless told otherwise.
    assert "BroadcastHashJoin" not in plan_of(QUERIES[name](spark, folder))



def test_first_fit_is_the_first_of_all_runs():
    rng = random.Random(7)
    for _ in range(400):
        lows = ["".join(rng.choices("ab12-", k=rng.randint(1, 5))) for _ in range(rng.randint(1, 14))]
        needle = " ".join("".join(rng.choices("ab12-", k=rng.randint(1, 4))) for _ in range(rng.randint(1, 3)))
        own, widths = rng.randint(1, len(lows)), rng.choice([[4], [6], list(range(1, 9))])
        want = next(((at, w) for at in range(own) for w in widths if fuzzy.partial_reaches(needle, " ".join(lows[at:at + w]), 70)), None)
        assert align._first_fit(needle, lows, own, widths, 70) == want
        assert want is None or want == next((at, w) for at in range(own) for w in widths if fuzzy.partial_ratio(needle, " ".join(lows[at:at + w])) >= 70)


def test_many_needles_meet_a_long_page(spark):
    page = spark.range(1500).selectExpr("id div 100000 doc_id", "cast(id div 100000 as int) page_no", "id idx", "id * 8 char0", "concat('w', lpad(cast(id as string), 6, '0')) text")
    needles = spark.range(0, 1500, 2).selectExpr("id div 100000 doc_id", "cast(id div 100000 as int) page_no", "concat('w', lpad(cast(id as string), 6, '0')) needle")
    found = align._first_window(needles, page, [4], 100)
    # A run of tokens is not a row: nothing but page segments and blocks of needles is joined.
    assert plan_of(found).count("SortMergeJoin") == 1
    rows = found.collect()
    assert len(rows) == 750 and all(r.idx == max(0, int(r.needle[1:]) - 3) for r in rows)


def test_only_asked_pieces_are_dealt(spark, monkeypatch):
    page = spark.range(2000).selectExpr("1L doc_id", "1 page_no", "id idx", "id * 9 char0", "concat('w', lpad(cast(id * 7919 % 100000 as string), 7, '0')) text")
    needles = spark.createDataFrame([(1, 1, "w0007919 w0015838"), (1, 1, "38")], "doc_id long, page_no int, needle string")
    dealt = []
    unfold = align.unfold
    monkeypatch.setattr(align, "unfold", lambda *args: dealt.append(unfold(*args)) or dealt[-1])
    found = {(r.needle, r.idx, r.inside) for r in align.occurrences(needles, page).collect()}
    assert found == {("w0007919 w0015838", 1, 0), ("38", 2, 6)}
    # Of some 26000 pieces of two and three characters, those that a needle begins with.
    assert 2000 <= dealt[0].count() < 3000


@pytest.mark.parametrize("name", ["ner_align", "ner_align_v0", "ner_align_fuzzy", "name_propagate"])
def test_tokens_are_numbered_once(spark, folder, name):
    # Joins read written tokens; none of them numbers and shuffles the tokens of its own.
    assert "_seg#" not in plan_of(QUERIES[name](spark, folder))


@pytest.mark.parametrize("name", ["all_detections", "anti_overlap"])
def test_tokens_are_made_once(spark, folder, name):
    assert "posexplode" not in plan_of(QUERIES[name](spark, folder))


def test_names_of_numbered_tokens(spark):
    rng = random.Random(11)
    words = ["ASHA", "PATIL", "RAO", "and", "12", "PAN", None, "MEERA"]
    rows = [(doc, 1, at, rng.choice(words), at % 9 * 100, at // 9 * 30, 40, 20) for doc in range(6) for at in range(0, 140, 2 if doc else 1)]
    page = spark.createDataFrame(rows, "doc_id long, page_no int, pos long, text string, left_x int, top int, width int, height int")
    plain, again = [sorted(map(tuple, tokens.upper_names(t).collect())) for t in (page, tokens.number_tokens(page))]
    assert plain == again and len(plain) > 20
    # Only tokens that may belong to a name are counted and shuffled a second time.
    read = re.findall(r"_in_(\w+)#", plan_of(tokens.upper_names(tokens.number_tokens(page))))
    assert "gaps" not in read


def counted(df, seen):
    """The same rows; ``seen`` counts how many were made."""
    def run(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch
    return df.mapInPandas(run, df.schema)


def test_inputs_are_made_once(spark):
    seen = spark.sparkContext.accumulator(0)
    dets = spark.range(300).selectExpr("id % 7 doc_id", "1 page_no", "id det_no", "'w' word", "cast(id % 50 * 40 as int) x0", "cast(id % 30 * 60 as int) y0",
                                       "cast(id % 50 * 40 + 30 as int) x1", "cast(id % 30 * 60 + 20 as int) y1", "'B-PER' label", "'X' pattern", "75 priority", "0.5D score")
    assert boxes.merge_by_priority(counted(dets, seen)).count() > 100
    assert seen.value == 300
    left = boxes.without_overlap(counted(dets, seen), dets.where("det_no < 100"), "det_no")
    assert left.count() == 200 and seen.value == 600


def test_rivals_are_numbers_from_one_shuffle(spark, monkeypatch):
    dets = spark.range(200).selectExpr("id % 3 doc_id", "1 page_no", "id det_no", "'w' word", "cast(id div 2 * 40 + id % 2 as int) x0", "10 y0",
                                       "cast(id div 2 * 40 + id % 2 + 30 as int) x1", "30 y1", "75 priority")
    pairs = geometry.similar_pairs(dets, ["page_no"], 0.5)
    assert plan_of(pairs).count("Exchange") == 1 and "SortMergeJoin" not in plan_of(pairs)
    assert pairs.where("a_det_no < b_det_no").count() == 100
    edges = []
    monkeypatch.setattr(boxes, "dropped_rows", lambda found: edges.append(found) or greedy.dropped_rows(found))
    assert boxes.drop_similar(dets, ["page_no"], -F.col("priority"), "det_no", 0.5, 80).count() == 100
    assert edges[0].dtypes == [("lo", "bigint"), ("hi", "bigint")]


def test_both_redactions_in_one_pass(spark, folder):
    # Texts are joined with their entities, not a second time with themselves.
    plan = plan_of(QUERIES["redact_text_entities"](spark, folder))
    assert plan.count("SortMergeJoin") <= 2 and "BroadcastHashJoin" not in plan


@pytest.mark.parametrize("patterns", [C.ID_PATTERNS, C.HEALTH_PATTERNS])
def test_windows_equal_a_plain_loop(spark, patterns):
    rng = random.Random(5)
    words = ["12", "1234", "5678", "MG", "Road", "user@ex", ".com", "ABCPK", "1234X", "MRN:", "MRN", "Blood", "HI", "V", "9", "98765432", "03/", "1984", "Patient", "ID", "-", "x"]
    texts = [rng.choice(words) for _ in range(600)]
    rows = [(1, 1, i, t, 60 + i % 8 * 40, 40, 30, 20) for i, t in enumerate(texts)]
    page = spark.createDataFrame(rows, "doc_id long, page_no int, idx long, text string, left_x int, top int, width int, height int")
    found = tokens.match_windows(page, patterns, segment=50)
    # Texts of runs are put together and tested as rows, not inside lambda functions.
    assert "array_join" not in plan_of(found)
    got = {(r.idx, r.n_tokens, r.pno): r.word for r in found.collect()}
    want = {}
    for at in range(len(texts)):
        for n in range(2, min(10, len(texts) - at) + 1):
            for i, p in enumerate(patterns):
                joined = [sep.join(texts[at:at + n]) for sep in ("", " ", "-")]
                fits = [w for w in joined if re.fullmatch(p.regex, w, re.I if p.ignore_case else 0)]
                if fits:
                    want[at, n, i] = fits[0]
    assert want and got == want
