"""Readers, sinks, feedback loop pieces and alignment on small inputs."""
import json
import random

import pytest
from pyspark.sql import functions as F

from veilframe import catalogue as C
from veilframe.functions import fuzzy, geometry as G
from veilframe.operators import align, boxes, feedback as fb, gate, report, tokens, video
from veilframe.sources import readers, sinks


def test_text_and_media_scans(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    (tmp_path / "b.WAV").write_bytes(b"123")
    (tmp_path / "c.flac").write_bytes(b"1")
    (tmp_path / "d.pdf").write_bytes(b"12")
    assert [r.text for r in readers.texts(spark, f"{tmp_path}/*.txt").collect()] == ["one\ntwo"]
    audio = readers.media(spark, str(tmp_path), "audio")
    assert sorted((r.path.rsplit("/", 1)[1], r.size) for r in audio.collect()) == [("b.WAV", 3), ("c.flac", 1)]
    assert readers.media(spark, str(tmp_path), "pdf").count() == 1


def test_labelled_examples_skip_empty(spark, tmp_path):
    lines = [{"words": ["a"], "boxes": [[1, 2, 3, 4]], "labels": ["O"]}, {"words": [], "labels": []}]
    (tmp_path / "x.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\nnot json\n")
    rows = readers.labelled_examples(spark, str(tmp_path)).collect()
    assert [(r.words, r.boxes) for r in rows] == [(["a"], [[1, 2, 3, 4]])]


def test_feedback_skips_bad_files(spark, tmp_path):
    good = [{"label": "B-PER", "pattern": "X", "score": 0, "timestamp": 1.5, "features": {"score": 0.5, "priority": 92}},
            {"label": "B-DOC", "user_feedback": True, "missed_detection": False}]
    (tmp_path / "feedback_1.json").write_text(json.dumps(good))
    (tmp_path / "feedback_2.json").write_text("[{broken")
    rows = readers.feedback(spark, str(tmp_path)).orderBy("label").collect()
    assert [(r.label, r.user_feedback) for r in rows] == [("B-DOC", True), ("B-PER", None)]
    assert rows[1].features.priority == 92


def test_calibration_file(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"K": [{"score": 0.0, "correct": True, "correction": 1.0, "timestamp": 1771251373.5}] * 2}))
    rows = readers.calibration(spark, str(tmp_path)).collect()
    assert [(r.key, r.pos, r.correction) for r in rows] == [("K", 0, 1.0), ("K", 1, 1.0)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a\nb",), ("c",)], "redacted string")
    sinks.write_texts(df, f"{tmp_path}/t")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/t").collect()) == ["a\\nb", "c"]
    fed = spark.sql("SELECT 'B-PER' label, TIMESTAMP '2024-01-05 10:00:00' ts")
    sinks.append_feedback(fed, f"{tmp_path}/f")
    sinks.append_feedback(fed, f"{tmp_path}/f")
    assert spark.read.parquet(f"{tmp_path}/f").where("dt = DATE '2024-01-05'").count() == 2


HISTORY = "key string, event_id int, ts timestamp, score double, correct boolean, correction double"


@pytest.mark.parametrize("n, moved", [(10, False), (11, True)])
def test_calibration_needs_history(spark, n, moved):
    history = spark.range(n).selectExpr("'B-PER' key", "cast(id as int) event_id", "timestamp_seconds(id) ts", "0.5D score", "true correct", "0.5D correction")
    det = spark.createDataFrame([("B-PER", None, 0.4), ("B-PER", None, None)], "label string, pattern string, score double")
    got = [r.calibrated for r in fb.calibrate(det, history).collect()]
    assert sorted(g for g in got if g is not None) == pytest.approx([0.55 if moved else 0.4]) and None in got


def test_history_keeps_newest(spark):
    history = spark.range(201).selectExpr("concat('k', id div 1000) key", "cast(id as int) event_id", "timestamp_seconds(id) ts")
    kept = fb.last_per_key(history, C.CALIBRATION_KEEP)
    assert kept.count() == 200 and kept.agg(F.min("event_id")).first()[0] == 1
    plan = kept._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_retention_switch(spark):
    rows = spark.sql("SELECT TIMESTAMP '2024-01-01' ts UNION ALL SELECT TIMESTAMP '2024-01-20'")
    now = F.expr("TIMESTAMP '2024-01-21'")
    assert fb.retain(rows, now).count() == 1 and fb.retain(rows, now, enabled=False).count() == 2


@pytest.mark.parametrize("box, want", [
    ((50, 60, 10, 20), (10, 20, 50, 60)), ((-5, -5, 30, 30), (0, 0, 30, 30)), ((10, 10, 17, 40), None), ((10, 10, 811, 40), None),
    ((10, 10, 258, 18), None), ((10, 10, 250, 18), (10, 10, 250, 18)), ((9000, 10, 9100, 60), None)])
def test_valid_box(spark, box, want):
    row = spark.range(1).select(G.valid_box(*map(F.lit, box), F.lit(2550), F.lit(3300)).alias("b")).first()
    assert (tuple(row.b) if row.b else None) == want


def test_report_score_is_capped(spark):
    dets = spark.range(249).selectExpr("1L video_id", "cast(id as int) frame_no", "'face' type")
    row = video.report(dets, 24).first()
    assert (row.faces_redacted, row.privacy_risk_score, row.video_duration_sec) == (249, 50, 249 / 24)
    assert json.loads(video.report_json(video.report(dets, 0)).first().report)["video_duration_sec"] == 0


def test_text_report(spark):
    dets = spark.createDataFrame([(1, 1, i, f"w{i}", "B-DOC", "PAN" if i < 5 else None) for i in range(6)],
                                 "doc_id int, page_no int, det_no int, word string, label string, pattern string")
    bar = dets.limit(1).withColumn("word", F.lit("a | b"))
    assert "    - a | b" in [r.text for r in report.lines(bar).collect()]
    lines = [r.text for r in report.lines(dets).orderBy("line").collect()]
    assert lines == [*report.HEADER, "Total Pages: 1", *report.OVERALL, "Total Redactions: 6", "", "Redactions by Type:",
                     "  PAN                 :   5", "  B-DOC               :   1", *report.BY_PAGE, "", "Page 1: 6 redactions",
                     "  B-DOC:", "    - w5", "  PAN:", "    - w0", "    - w1", "    - w2", "    ... and 2 more"]
    pages = spark.createDataFrame([(1, 2), (7, 1)], "doc_id int, pages int")
    empty = [r.text for r in report.lines(dets, pages).where("doc_id = 7").orderBy("line").collect()]
    assert empty[3] == "Total Pages: 1" and empty[-1] == "Page 1: 0 redactions" and "Total Redactions: 0" in empty


def test_identity_spreads_and_matches(spark, monkeypatch):
    import random
    rng = random.Random(1)
    vectors = [[rng.gauss(0, .3) for _ in range(8)] for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id int, embedding array<float>")
    refs = df.where("vec_id < 20")
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b)) ** .5
    want = {i for i, v in enumerate(vectors) if min(dist(v, r) for r in vectors[:20]) < .5}
    for block in (1024, 3):
        monkeypatch.setattr(video, "MATCH_BLOCK", block)
        got = [r.vec_id for r in video.match_identities(df, refs).collect()]
        assert set(got) == want and len(got) == len(want) > 20
    none = df.limit(0)
    assert video.match_identities(df, none).count() == 0 and video.match_identities(none, refs).count() == 0


def test_many_identities_meet_few_blocks(spark):
    """A hundred thousand vectors against ten thousand references in clusters: right, and most pairs never meet."""
    import numpy as np
    from veilframe.session import checkpoint
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16)) * 2
    make = lambda n, spread: centres[rng.integers(0, 40, n)] + rng.normal(size=(n, 16)) * spread
    refs, vectors = make(10_000, 0.05), make(100_000, 0.14)
    pd = __import__("pandas")
    frame = lambda m: spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(m)), "embedding": list(m)})).repartition(8)
    df, known = frame(vectors), frame(refs)
    want, pairs = set(), 0
    for at in range(0, 100_000, 5000):
        gaps = (vectors[at:at + 5000]**2).sum(1)[:, None] + (refs**2).sum(1) - 2 * vectors[at:at + 5000] @ refs.T
        want |= set((at + np.flatnonzero(gaps.min(1) < 0.25)).tolist())
    got = [r.vec_id for r in video.match_identities(df, known, limit=0.5).collect()]
    assert len(got) == len(set(got)) and set(got) == want and 1000 < len(want) < 99_000
    row = lambda d: d.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    pairs = video._blocks(checkpoint(row(df)), checkpoint(row(known).select("v")), 0.5).selectExpr("sum(cast(size(ids) as bigint) * size(refs))").first()[0]
    assert pairs < 0.3 * len(vectors) * len(refs)


def test_report_counts_frames_without_boxes(spark):
    dets = spark.range(3).selectExpr("1L video_id", "cast(id as int) frame_no", "'face' type")
    videos = spark.createDataFrame([(1, 48), (2, 24)], "video_id bigint, frames int")
    rows = {r.video_id: r for r in video.report(dets, 24, videos).collect()}
    assert rows[1].video_duration_sec == 2 and rows[2].video_duration_sec == 1
    assert (rows[2].faces_redacted, rows[2].privacy_risk_score, rows[2].pii_detected) == (0, 0, {})


def test_cap_ranks_rows_with_holes(spark):
    from veilframe.operators import generate
    rows = spark.createDataFrame([(7 + 1000 * i, 0) for i in range(100)] + [(3 + 900 * i, 1) for i in range(9)], "i bigint, grp int")
    kept = generate.capped(rows, spark.range(5), least=50, ratio=3).collect()
    assert sorted(r.place for r in kept) == list(range(50)) and {r.i for r in kept} == {7 + 1000 * i for i in range(50)}
    assert len(generate.capped(rows, spark.range(35), least=50, ratio=3).collect()) == 105


def test_gate_trains_and_keeps(spark):
    rows = [(i, "AB12" if i % 2 else "xyz", 10, 10, 60, 30, "B-DOC", 90, None, 1000, 1000, bool(i % 2)) for i in range(60)]
    dets = boxes.features(spark.createDataFrame(
        rows, "det_no int, word string, x0 int, y0 int, x1 int, y1 int, label string, priority int, score double, page_w int, page_h int, user_feedback boolean"))
    model = gate.train(dets)
    assert {r.det_no % 2 for r in gate.apply(dets, model).collect()} == {1}
    assert gate.train(dets.limit(10)) is None and gate.apply(dets, None).count() == 60


TOK = "doc_id bigint, page_no int, pos bigint, text string, left_x int, top int, width int, height int, conf int"


@pytest.fixture(scope="module")
def page(spark):
    text = "Dear Ravi Kumar of Broadway near the old Road please call Ravi Kumaar now".split()
    rows = [(1, 1, i, w, 60 + 100 * (i % 6), 40 + 30 * (i // 6), 8 * len(w), 20, 90) for i, w in enumerate(text)]
    return tokens.number_tokens(spark.createDataFrame(rows, TOK))


def preds(spark, *words):
    return spark.createDataFrame([(1, 1, w, "PER", .9) for w in words], "doc_id bigint, page_no int, word string, entity_group string, score double")


def test_align_needs_token_start(spark, page):
    got = {r.word: (r.idx, r.n_tokens) for r in align.align(preds(spark, "ravi kumar", "road", "zzz"), page).collect()}
    # "road" first occurs inside "Broadway", so the strict rule finds no run.
    assert got == {"Ravi Kumar": (1, 2)}
    got = {r.word: r.idx for r in align.align(preds(spark, "ravi kumar", "road"), page, "v0").collect()}
    assert got == {"Ravi Kumar": 1, "Broadway": 4}


def test_quiet_foot(spark, page):
    low = preds(spark, "ravi kumar").withColumn("score", F.lit(.7))
    assert align.align(low, page, size=(2550, 60), quiet_foot=True).count() == 1
    assert align.align(low, page, size=(2550, 52), quiet_foot=True).count() == 0
    assert align.align(low, page, size=(2550, 52)).count() == 1


def test_windows_split_by_segments(spark):
    # Runs that cross a segment border are found like any other.
    words = "x 12 MG Road and 1234 5678 9012 ok a@ b.com".split()
    rows = [(1, 1, i, w, 60 + 90 * i, 40, 8 * len(w), 20, 90) for i, w in enumerate(words)]
    page = tokens.number_tokens(spark.createDataFrame(rows, TOK))
    want = {(r.idx, r.n_tokens, r.word, r.pattern) for r in tokens.match_windows(page, C.ID_PATTERNS).collect()}
    with pytest.raises(ValueError):
        tokens.match_windows(page, C.ID_PATTERNS, segment=5)
    got = {(r.idx, r.n_tokens, r.word, r.pattern) for r in tokens.match_windows(page, C.ID_PATTERNS, segment=9).collect()}
    assert got == want and (1, 3, "12 MG Road", "ADDRESS") in want and (5, 3, "123456789012", "AADHAAR") in want


def test_align_across_segments(spark, monkeypatch, page):
    monkeypatch.setattr(align, "SEGMENT_TOKENS", 2)
    monkeypatch.setattr(align._segments, "__defaults__", (2,))
    got = {r.word: (r.idx, r.n_tokens) for r in align.align(preds(spark, "kumar of", "ravi kumar"), page).collect()}
    assert got == {"Kumar of": (2, 2), "Ravi Kumar": (1, 2)}


def test_fuzzy_alignment(spark, page):
    got = {r.needle: (r.how, r.idx) for r in align.align_fuzzy(preds(spark, "Kumarr", "brodway", "qqqq"), page).collect()}
    assert got == {"kumarr": ("token", 2), "brodway": ("token", 4)}


def test_hits_to_tokens(spark, page):
    hits = spark.createDataFrame([(1, 1, "ROAD", "B-LOC"), (1, 1, "old Raod please", "B-LOC")], "doc_id bigint, page_no int, word string, label string")
    got = {r.needle: r.how for r in align.align_hits(hits, page).collect()}
    assert got == {"road": "token", "old raod please": "window"}


def test_names_spread_over_the_page(spark, page):
    people = align.align(preds(spark, "Kumar"), page).select("doc_id", "page_no", "word", "x0", "y0", "x1", "y1")
    lines = tokens.number_tokens(tokens.merge_lines(page))
    words = {r.word for r in align.propagate_names(people, page, lines).collect()}
    assert "Kumaar" in words


def test_similarity_scores():
    assert fuzzy.ratio("asha", "asha") == 100 and fuzzy.ratio("", "a") == 0 and fuzzy.ratio("abcd", "abce") == 75
    assert fuzzy.partial_ratio("patil", "asha patil") == 100
    assert fuzzy.token_set_ratio("patil asha", "asha k patil") == 100
    import itertools
    import random
    rng = random.Random(2)
    words = ["".join(rng.choice("abcd ") for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    for a, b in itertools.product(words, words):
        assert fuzzy.reaches(a, b, 70) == (fuzzy.ratio(a, b) >= 70)
        assert fuzzy.partial_reaches(a, b, 70) == (fuzzy.partial_ratio(a, b) >= 70)


def test_needles_of_any_length_are_found(spark):
    words = [f"w{i}" for i in range(1400)]
    starts = [sum(len(w) + 1 for w in words[:i]) for i in range(len(words))]
    tokens_ = spark.createDataFrame([(1, 1, i, s, w) for i, (w, s) in enumerate(zip(words, starts))], "doc_id bigint, page_no int, idx bigint, char0 bigint, text string")
    wanted = {at: " ".join(words[at:at + 600]) for at in (0, 500, 511, 800)}
    needles = spark.createDataFrame([(1, 1, n) for n in [*wanted.values(), " ".join(words), "w5 w7"]], "doc_id bigint, page_no int, needle string")
    got = {r.needle: r.idx for r in align.occurrences(needles, tokens_).collect()}
    assert got == {**{n: at for at, n in wanted.items()}, " ".join(words): 0}


def test_numbers_run_on_through_pages(spark):
    rows = [(d, p, n) for d in (1, 2) for p in (1, 2, 3) for n in range(p * 3)]
    got = boxes.number_detections(spark.createDataFrame(rows[::-1], "doc_id int, page_no int, det_no int")).collect()
    assert sorted((r.doc_id, r.page_no, r.det_no, r.number) for r in got) == [
        (d, p, n, i + 1) for d in (1, 2) for i, (p, n) in enumerate([(p, n) for p in (1, 2, 3) for n in range(p * 3)])]


def test_similar_pairs_are_all_found(spark):
    """Random and nested boxes, at every threshold in use."""
    import random
    rng = random.Random(8)
    rows = []
    for i in range(400):
        x, y = rng.randrange(60), rng.randrange(60)
        rows.append((1, i, x, y, x + rng.choice([0, 1, 2, 4, 8, 16, 31, 32, 33]), y + rng.choice([1, 2, 3, 8, 16, 17])))
    df = spark.createDataFrame(rows, "page int, i int, x0 int, y0 int, x1 int, y1 int")

    def share(a, b):
        w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
        both = w * h if w > 0 and h > 0 else 0
        whole = (a[4] - a[2]) * (a[5] - a[3]) + (b[4] - b[2]) * (b[5] - b[3]) - both
        return both / whole if whole else 0

    for least in (0.5, 0.7, 0.85):
        want = {(a[1], b[1]) for a in rows for b in rows if share(a, b) > least}
        for quiet in (10, 1000):
            got = [(r.a_i, r.b_i) for r in G.similar_pairs(df, ["page"], least, quiet=quiet).collect()]
            assert len(got) == len(set(got)) and set(got) == want and len(want) > 300


def test_busy_page_makes_few_pairs(spark):
    """Two hundred thousand distinct boxes on one page: candidates stay near the matches."""
    rows = spark.range(200_000).selectExpr("1 page", "id i", "cast(id % 500 * 5 as int) x0", "cast(id div 500 * 8 as int) y0")
    df = rows.withColumn("x1", F.col("x0") + 60).withColumn("y1", F.col("y0") + 20)
    assert G.similar_pairs(df, ["page"], 0.85).count() >= 200_000


def test_quiet_pages_meet_by_centres(spark):
    """A pair meets once, and only boxes with near centres meet: long ones that cross are no rows of every cell."""
    rng = random.Random(3)
    sides = (1, 2, 40, 127, 128, 700, 4000)
    rows = []
    for i in range(240):
        x, y, w, h = rng.randrange(-300, 900), rng.randrange(-300, 900), rng.choice(sides), rng.choice(sides)
        rows += [(i % 3, 2 * i, x, y, x + w, y + h), (i % 3, 2 * i + 1, x + rng.randrange(3), y, x + w + rng.randrange(4), y + h + rng.randrange(3))]
    rows += [(0, 900, 5, 5, 5, 9), (0, 901, 9, 9, 5, 5)]
    df = spark.createDataFrame(rows, "page int, i int, x0 int, y0 int, x1 int, y1 int")

    def share(a, b):
        shared = max(0, min(a[4], b[4]) - max(a[2], b[2])) * max(0, min(a[5], b[5]) - max(a[3], b[3]))
        return shared / ((a[4] - a[2]) * (a[5] - a[3]) + (b[4] - b[2]) * (b[5] - b[3]) - shared)

    solid = [r for r in rows if r[4] > r[2] and r[5] > r[3]]
    for least in (0.3, 0.5, 0.85):
        got = sorted((r.a_i, r.b_i) for r in G.similar_pairs(df, ["page"], least).collect())
        assert got == sorted((a[1], b[1]) for a in solid for b in solid if a[0] == b[0] and share(a, b) > least)
    plan = G.similar_pairs(df, ["page"], 0.5)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan and plan.count("Generate") == 2  # one side has a single cell a box


def test_exact_hits_share_a_large_page_out(spark, monkeypatch):
    """What a task sorts does not grow with the table: more rows are dealt among more tasks."""
    from veilframe.functions import scan
    monkeypatch.setattr(scan, "TASK_ROWS", 100)
    rows = [(1, 1, i, f"W{i % 300}", 0, 0, 9, 9, 90) for i in range(2000)]
    toks = spark.createDataFrame(rows, "doc_id bigint, page_no int, pos bigint, text string, left_x int, top int, width int, height int, conf int")
    hits = spark.createDataFrame([(1, 1, f"w{i} ", "B-DOC") for i in range(250, 350)], "doc_id bigint, page_no int, word string, label string")
    tasks = scan.tasks_for(toks)
    assert tasks == 20 and scan.tasks_for(toks.limit(300)) is None
    found = align.exact_hits(hits, tokens.number_tokens(toks, tasks=tasks), tasks)
    assert sorted((r.needle, r.idx) for r in found.collect()) == sorted((f"w{i}", i) for i in range(250, 300))
    assert found.rdd.getNumPartitions() == tasks
