"""Registered queries: reports, feedback loop, generators."""
from __future__ import annotations

from pyspark.sql import functions as F

from veilframe import catalogue as C
from veilframe.fixtures import view
from veilframe.functions import text as T
from veilframe.operators import feedback as fb, generate as gen, report, selftrain
from veilframe.plans import duck as D
from veilframe.plans.registry import query

PAGE = ["doc_id", "page_no"]
NOW = "TIMESTAMP '2024-01-31 00:00:00'"


def dets(spark, folder):
    return view(spark, folder, "v_dets")


def rated(spark, folder):
    return view(spark, folder, "v_feedback")


@query("page_risk", "SELECT doc_id, page_no, CAST(sum(priority) AS BIGINT) AS risk FROM v_dets GROUP BY 1, 2")
def page_risk(spark, folder):
    return report.page_risk(dets(spark, folder))


@query("top_risk_pages", "SELECT doc_id, page_no, CAST(sum(priority) AS BIGINT) AS risk FROM v_dets GROUP BY 1, 2 ORDER BY risk DESC, doc_id, page_no LIMIT 100")
def top_risk_pages(spark, folder):
    return report.top_pages(dets(spark, folder), 100)


_KIND = "coalesce(pattern, label, 'UNKNOWN')"


@query("pdf_report_overall", f"SELECT {_KIND} AS kind, count(*) AS n FROM v_dets GROUP BY 1")
def pdf_report_overall(spark, folder):
    return report.overall(dets(spark, folder))


@query("pdf_report_rollup", f"""SELECT doc_id, page_no, kind, count(*) AS n FROM (SELECT *, {_KIND} AS kind FROM v_dets)
GROUP BY GROUPING SETS ((doc_id, page_no, kind), (doc_id, page_no), (doc_id))""")
def pdf_report_rollup(spark, folder):
    return report.breakdown(dets(spark, folder))


@query("pdf_report_preview", f"""WITH k AS (SELECT doc_id, page_no, {_KIND} AS kind, det_no, substr(word, 1, 30) AS word,
  row_number() OVER (PARTITION BY doc_id, page_no, {_KIND} ORDER BY det_no) AS rn FROM v_dets)
SELECT doc_id, page_no, kind, string_agg(word, ' | ' ORDER BY rn) FILTER (rn <= 3) AS words, greatest(0, count(*) - 3) AS more FROM k GROUP BY 1, 2, 3""")
def pdf_report_preview(spark, folder):
    return report.preview(dets(spark, folder))


_LIST = lambda texts: ", ".join(t if t.startswith("printf(") else D.lit(t) for t in texts)
_OPENING = _LIST([*report.HEADER, "printf('Total Pages: %d', pages)", *report.OVERALL, "printf('Total Redactions: %d', n)", "", "Redactions by Type:"])


@query("pdf_report_text", f"""WITH k AS (SELECT doc_id, page_no, {_KIND} AS kind, substr(word, 1, 30) AS word,
  row_number() OVER (PARTITION BY doc_id, page_no, {_KIND} ORDER BY det_no) AS rn FROM v_dets),
p AS (SELECT c_custkey AS doc_id, CAST(6 AS INT) AS pages FROM customer),
t AS (SELECT doc_id, pages, count(k.kind) AS n FROM p LEFT JOIN k USING (doc_id) GROUP BY 1, 2),
e AS (SELECT doc_id, page_no, count(k.kind) AS n FROM (SELECT doc_id, CAST(unnest(range(1, pages + 1)) AS INT) AS page_no FROM p) LEFT JOIN k USING (doc_id, page_no) GROUP BY 1, 2),
g AS (SELECT doc_id, page_no, lpad(CAST(page_no AS VARCHAR), 9, '0') AS pg, kind, count(*) AS n FROM k GROUP BY 1, 2, 3, 4)
SELECT doc_id, ['0', CAST(i AS VARCHAR)] AS line, text FROM (SELECT doc_id, unnest(range(0, 10)) AS i, unnest([{_OPENING}]) AS text FROM t)
UNION ALL SELECT doc_id, ['1', lpad(CAST(1000000000000 - sum(n) AS VARCHAR), 13, '0'), kind], printf('  %-20s: %3d', kind, CAST(sum(n) AS BIGINT)) FROM g GROUP BY doc_id, kind
UNION ALL SELECT doc_id, ['2', CAST(i AS VARCHAR)], text FROM (SELECT doc_id, unnest(range(0, 3)) AS i, unnest([{_LIST(report.BY_PAGE)}]) AS text FROM t)
UNION ALL SELECT doc_id, ['3', lpad(CAST(page_no AS VARCHAR), 9, '0')], '' FROM e
UNION ALL SELECT doc_id, ['3', lpad(CAST(page_no AS VARCHAR), 9, '0'), ''], printf('Page %d: %d redactions', page_no, n) FROM e
UNION ALL SELECT doc_id, ['3', pg, kind], printf('  %s:', kind) FROM g
UNION ALL SELECT doc_id, ['3', lpad(CAST(page_no AS VARCHAR), 9, '0'), kind, CAST(rn - 1 AS VARCHAR)], printf('    - %s', word) FROM k WHERE rn <= 3
UNION ALL SELECT doc_id, ['3', pg, kind, '9'], printf('    ... and %d more', n - 3) FROM g WHERE n > 3""")
def pdf_report_text(spark, folder):
    pages = view(spark, folder, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit(6).alias("pages"))
    return report.lines(dets(spark, folder), pages)


@query("best_rotation", """WITH a AS (SELECT page_id, rotation, CASE WHEN count(*) FILTER (conf <> -1) = 0 THEN 0
  ELSE CAST(sum(conf) FILTER (conf <> -1) AS DOUBLE) / count(*) FILTER (conf <> -1) END AS mean_conf FROM v_ocr_conf GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY mean_conf DESC, rotation) AS rn FROM a)
SELECT page_id, CASE WHEN mean_conf > 0 THEN rotation ELSE 0 END AS rotation, mean_conf FROM b WHERE rn = 1""")
def best_rotation(spark, folder):
    from veilframe.operators import pages
    return pages.best_rotation(view(spark, folder, "v_ocr_conf"))


_COUNTS = """nm AS (SELECT 'label' AS scope, label AS name, user_feedback, missed_detection FROM v_feedback
  UNION ALL SELECT 'pattern', coalesce(pattern, 'UNKNOWN'), user_feedback, missed_detection FROM v_feedback),
ct AS (SELECT scope, name, count(*) FILTER (user_feedback) AS tp, count(*) FILTER (NOT user_feedback) AS fp, count(*) FILTER (missed_detection) AS fn,
  count(user_feedback) AS rated FROM nm GROUP BY 1, 2)"""


@query("feedback_metrics", f"""WITH {_COUNTS} SELECT scope, name, tp, fp, fn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
  CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall, CASE WHEN rated > 0 THEN tp / rated ELSE 0.0 END AS accuracy FROM ct WHERE tp + fp + fn > 0""")
def feedback_metrics(spark, folder):
    return fb.quality(rated(spark, folder))


def _stored(spark, folder):
    """Patterns switched off earlier: in the fixture, all brands of one family."""
    return view(spark, folder, "part").where("p_brand LIKE '%1'").select(F.col("p_brand").alias("pattern"))


@query("disabled_patterns", f"""WITH {_COUNTS} SELECT name AS pattern FROM ct WHERE scope = 'pattern' AND tp + fp >= 5 AND tp / (tp + fp) < 0.40
UNION SELECT p_brand FROM part WHERE p_brand LIKE '%1'""")
def disabled_patterns(spark, folder):
    return fb.disabled_patterns(rated(spark, folder), _stored(spark, folder))


@query("adaptive_thresholds", f"""WITH {_COUNTS}, fresh AS (SELECT name AS label, CAST(0.30 AS DOUBLE) AS shift FROM ct WHERE scope = 'label' AND name = 'B-LOC'
  AND CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END < 0.40),
old AS (SELECT DISTINCT label, CAST(0.10 AS DOUBLE) AS shift FROM v_dets)
SELECT label, shift FROM old WHERE label NOT IN (SELECT label FROM fresh) UNION ALL SELECT * FROM fresh""")
def adaptive_thresholds(spark, folder):
    stored = dets(spark, folder).select("label").distinct().withColumn("shift", F.lit(0.10))
    return fb.threshold_shifts(rated(spark, folder), stored)


@query("feedback_join", """SELECT doc_id, page_no, det_no, label, pattern, score, word, label <> 'B-LOC' AS user_feedback, false AS missed_detection FROM v_dets
UNION ALL SELECT c_custkey, NULL, NULL, 'B-SENSITIVE', 'MISSED_ENTITY', NULL, c_name, NULL, true FROM customer""")
def feedback_join(spark, folder):
    every = dets(spark, folder)
    wrong = every.where("label = 'B-LOC'").select("det_no")
    missed = view(spark, folder, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_name").alias("word"))
    return fb.join_feedback(every, wrong, missed, ["doc_id", "page_no", "det_no"])


_HISTORY = """hi AS (SELECT CASE WHEN pattern IS NOT NULL THEN label || '_' || pattern ELSE label END AS key, event_id, ts, score, user_feedback AS correct,
  CASE WHEN user_feedback THEN 1 - score ELSE -score END AS correction FROM v_feedback WHERE user_feedback IS NOT NULL),
rk AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, event_id DESC) AS rn FROM hi)"""


@query("calib_retain", f"WITH {_HISTORY} SELECT key, event_id, score, correct, correction FROM rk WHERE rn <= 200")
def calib_retain(spark, folder):
    kept = fb.last_per_key(fb.corrections(rated(spark, folder)), C.CALIBRATION_KEEP)
    return kept.select("key", "event_id", "score", "correct", "correction")


@query("calibrate", f"""WITH {_HISTORY},
mn AS (SELECT key, CAST(sum(CAST(correction AS DECIMAL(18, 6))) FILTER (rn <= 50) AS DOUBLE) / count(*) FILTER (rn <= 50) AS shift FROM rk GROUP BY 1 HAVING count(*) > 10),
d AS (SELECT event_id, score, CASE WHEN pattern IS NOT NULL THEN label || '_' || pattern ELSE label END AS key FROM v_feedback)
SELECT event_id, key, score, CASE WHEN shift IS NULL THEN score ELSE greatest(0.0, least(1.0, score + shift * CAST(0.3 AS DOUBLE))) END AS calibrated FROM d LEFT JOIN mn USING (key)""")
def calibrate(spark, folder):
    every = rated(spark, folder)
    return fb.calibrate(every, fb.corrections(every)).select("event_id", "key", "score", "calibrated")


@query("laplace_noise", f"""WITH u AS (SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN score END AS score,
  ({D.hash_number("'noise|' || event_id")} + CAST(0.5 AS DOUBLE)) / CAST(4294967296.0 AS DOUBLE) - CAST(0.5 AS DOUBLE) AS u FROM v_feedback)
SELECT event_id, round(CASE WHEN score IS NOT NULL THEN greatest(0.0, least(1.0, score - sign(u) * ln(1 - 2 * abs(u)))) END, 6) AS noisy FROM u""")
def laplace_noise(spark, folder):
    scored = rated(spark, folder).withColumn("score", F.when(F.col("event_id") % 11 != 0, F.col("score")))
    seed = F.concat(F.lit("noise|"), F.col("event_id").cast("string"))
    return fb.noisy_scores(scored, seed).select("event_id", F.round("noisy", 6).alias("noisy"))


@query("retention", f"SELECT event_id FROM v_feedback WHERE ts >= {NOW} - INTERVAL 7 DAYS")
def retention(spark, folder):
    return fb.retain(rated(spark, folder), F.expr(NOW.replace("TIMESTAMP", "TIMESTAMP_NTZ"))).select("event_id")


@query("issue_log", """SELECT 'issue_' || strftime(ts, '%Y%m%d_%H%M%S') || '_' || event_id AS issue_id, event_id AS frame_number,
  [user_id, user_id + 1, user_id + 2, user_id + 3] AS bounding_box, CASE event_type WHEN 'error' THEN 'missed_detection' WHEN 'view' THEN 'false_positive' ELSE 'incorrect_redaction' END AS issue_type,
  'unknown' AS model_type, strftime(ts, '%Y%m%d_%H%M%S') AS timestamp FROM events""")
def issue_log(spark, folder):
    events = view(spark, folder, "events")
    for i in range(4):
        events = events.withColumn(f"b{i}", F.col("user_id") + i)
    kind = F.when(F.col("event_type") == "error", "missed_detection").when(F.col("event_type") == "view", "false_positive").otherwise("incorrect_redaction")
    return fb.issues(events, "event_id", ["b0", "b1", "b2", "b3"], kind, F.lit("unknown"), F.col("ts"))


@query("session_ids", "SELECT event_id, substr(sha256(strftime(ts, '%Y-%m-%d %H:%M:%S.%f')), 1, 16) AS session_id FROM events")
def session_ids(spark, folder):
    return view(spark, folder, "events").select("event_id", fb.session_id(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("session_id"))


@query("pii_rate_hourly", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def pii_rate_hourly(spark, folder):
    return report.hourly_rate(view(spark, folder, "events"))


def seeds(spark, folder):
    return view(spark, folder, "documents").select(F.col("doc_id").alias("i"))


def _digest(kind: str) -> str:
    return f"md5('veil|{kind}|' || doc_id)"


def _byte(kind: str, j: int) -> str:
    return f"CAST('0x' || substr({_digest(kind)}, {2 * j + 1}, 2) AS INT)"


def _chars(kind: str, at, letters: bool) -> str:
    return " || ".join(f"chr({_byte(kind, j)} % 26 + 65)" if letters else f"CAST({_byte(kind, j)} % 10 AS VARCHAR)" for j in at)


_IDS = f"""ids AS (SELECT doc_id AS i, {_chars('pan', range(5), True)} || {_chars('pan', range(5, 9), False)} || {_chars('pan', [9], True)} AS pan,
  CASE WHEN {_byte('aadhaar', 12)} % 10 < 6 THEN {_chars('aadhaar', range(4), False)} || ' ' || {_chars('aadhaar', range(4, 8), False)} || ' ' || {_chars('aadhaar', range(8, 12), False)}
    ELSE {_chars('aadhaar', range(12), False)} END AS aadhaar,
  {_chars('passport', [0], True)} || {_chars('passport', range(1, 8), False)} AS passport,
  lpad(CAST({_byte('dob', 0)} % 28 + 1 AS VARCHAR), 2, '0') || '/' || lpad(CAST({_byte('dob', 1)} % 12 + 1 AS VARCHAR), 2, '0') || '/' || ({_byte('dob', 2)} % 41 + 1970) AS dob
  FROM documents)"""


@query("gen_ids", f"WITH {_IDS} SELECT * FROM ids")
def gen_ids(spark, folder):
    return gen.identifiers(seeds(spark, folder))


def _template(templates: list[str], kind: str, value: str) -> str:
    return f"replace({D.pick(templates, f'{D.lit(f'veil|{kind}-template|')} || i')}, '{{}}', {value})"


_ID_SENT = f"""st AS (SELECT i, 'pan' AS kind, {_template(C.PAN_TEMPLATES, 'pan', 'pan')} AS text, pan AS value FROM ids
  UNION ALL SELECT i, 'aadhaar', {_template(C.AADHAAR_TEMPLATES, 'aadhaar', 'aadhaar')}, aadhaar FROM ids),
isn AS (SELECT i, kind, text, string_split(text, ' ') AS words, list_transform(string_split(text, ' '), lambda w:
  CASE WHEN (kind = 'pan' AND w = value) OR (kind = 'aadhaar' AND contains(w, replace(value, ' ', ''))) THEN 'B-DOC' ELSE 'O' END) AS labels FROM st)"""


@query("gen_id_sentences", f"WITH {_IDS}, {_ID_SENT} SELECT * FROM isn")
def gen_id_sentences(spark, folder):
    return gen.id_sentences(seeds(spark, folder))


def _seed(part: str) -> str:
    return f"'veil|{part}|' || i"


_SENT = f"""pe AS (SELECT i, dob, passport, {D.pick(C.FIRST_NAMES, _seed('first'))} AS first_, {D.pick(C.LAST_NAMES, _seed('last'))} AS last_,
  CASE WHEN {D.hash_number(_seed('has-middle'))} % 10 < 4 THEN {D.pick(C.FIRST_NAMES, _seed('middle'))} ELSE '' END AS middle,
  {D.pick(C.CITIES, _seed('city'))} AS city, {D.pick(C.SYNTHETIC_PINCODES, _seed('pin'))} AS pin, {D.hash_number(_seed('house'))} % 300 + 1 AS house FROM ids),
pt AS (SELECT i, first_, middle, last_, 'Name: ' || first_ || CASE WHEN middle = '' THEN '' ELSE ' ' || middle END || ' ' || last_ || ' DOB: ' || dob || ' Passport: ' || passport
  || ' Address: ' || house || ' {C.SYNTHETIC_STREET}, ' || city || ', {C.SYNTHETIC_REGION} ' || pin AS text FROM pe),
ps AS (SELECT i, 'person' AS kind, text, string_split(text, ' ') AS words, list_transform(list_transform(string_split(text, ' '), lambda w: trim(w, ',:-')), lambda b:
  CASE WHEN b <> '' AND b IN (first_, middle, last_) THEN 'B-PER' WHEN regexp_full_match(b, '[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}') THEN 'B-DATE'
    WHEN regexp_full_match(b, '[A-Z][0-9]{{7}}') THEN 'B-DOC' WHEN regexp_full_match(b, '[0-9]{{6}}') THEN 'B-LOC' ELSE 'O' END) AS labels FROM pt),
sn AS (SELECT *, 0 AS grp FROM ps UNION ALL SELECT *, CASE kind WHEN 'pan' THEN 1 ELSE 2 END FROM isn WHERE i % 4 = 0)"""


@query("gen_sentences", f"WITH {_IDS}, {_ID_SENT}, {_SENT} SELECT i, kind, text, words, labels FROM sn")
def gen_sentences(spark, folder):
    return gen.sentences(seeds(spark, folder)).drop("grp")


_REAL = """rw AS (SELECT doc_id AS i, string_split(text, ' ') AS words FROM v_notes),
re AS (SELECT i, words, list_transform(list_transform(words, lambda w: trim(w, ',:-')), lambda b: CASE WHEN b IN ('ASHA', 'PATIL') THEN 'B-PER'
  WHEN regexp_full_match(b, '[0-9]{2}/[0-9]{2}/[0-9]{4}') THEN 'B-DATE' WHEN regexp_full_match(b, '[A-Z][0-9]{7}') THEN 'B-DOC'
  WHEN regexp_full_match(b, '[0-9]{6}') THEN 'B-LOC' ELSE 'O' END) AS labels FROM rw)"""


def real_examples(spark, folder):
    names = F.array(F.lit("ASHA"), F.lit("PATIL"))
    words = view(spark, folder, "v_notes").select(F.col("doc_id").alias("i"), F.split("text", " ").alias("words"))
    return words.withColumn("labels", F.transform("words", lambda w: gen.word_label(w, names)))


@query("synth_label", f"WITH {_REAL} SELECT i, words, labels FROM re")
def synth_label(spark, folder):
    return real_examples(spark, folder)


_PLACED = """pl AS (SELECT *, row_number() OVER (ORDER BY grp, i) - 1 AS place FROM sn)"""


@query("synth_cap", f"""WITH {_IDS}, {_ID_SENT}, {_SENT}, {_PLACED}
SELECT kind, text, place FROM pl WHERE place < greatest(50, least((SELECT count(*) FROM sn), 3 * (SELECT greatest(1, count(*)) FROM benchmark)))""")
def synth_cap(spark, folder):
    return gen.capped(gen.sentences(seeds(spark, folder)), view(spark, folder, "benchmark")).select("kind", "text", "place")


@query("train_set", f"""WITH {_IDS}, {_ID_SENT}, {_SENT}, {_PLACED}, {_REAL}
SELECT words, labels, 'real' AS origin, i AS place FROM re
UNION ALL SELECT list_transform(words, lambda w: {D.surrogate('w')}), labels, 'synthetic', place FROM pl
WHERE len(list_filter(labels, lambda l: l <> 'O')) > 0 AND place < greatest(50, least((SELECT count(*) FROM sn), 3 * (SELECT greatest(1, count(*)) FROM re)))""")
def train_set(spark, folder):
    return gen.training_set(real_examples(spark, folder), gen.sentences(seeds(spark, folder)))


@query("label_vocab", f"""WITH {_REAL}, u AS (SELECT DISTINCT unnest(labels) AS label FROM re)
SELECT label, CAST(row_number() OVER (ORDER BY label) AS INT) AS label_id FROM u WHERE label <> 'O' UNION ALL SELECT 'O', 0""")
def label_vocab(spark, folder):
    return gen.label_vocabulary(real_examples(spark, folder))


def rated_boxes(spark, folder):
    """Detections with the ratings stored under their numbers."""
    return selftrain.rate(dets(spark, folder), view(spark, folder, "v_ratings"))


@query("gate")
def gate(spark, folder):
    lessons = selftrain.learn(rated_boxes(spark, folder))
    return selftrain.through_gate(dets(spark, folder), lessons).select("doc_id", "page_no", "det_no", "label", "pattern")


_LESSONS = """rt AS (SELECT d.*, r.event_id, r.ts, r.user_feedback FROM v_dets d LEFT JOIN v_ratings r USING (det_no)),
off AS (SELECT coalesce(pattern, 'UNKNOWN') AS pattern FROM rt GROUP BY 1
  HAVING count(user_feedback) >= 5 AND count(*) FILTER (user_feedback) / count(user_feedback) < 0.40),
shifts AS (SELECT label, 0.30 AS shift FROM rt WHERE label = 'B-LOC' GROUP BY 1
  HAVING count(user_feedback) > 0 AND count(*) FILTER (user_feedback) / count(user_feedback) < 0.40),
hi AS (SELECT CASE WHEN pattern IS NOT NULL THEN label || '_' || pattern ELSE label END AS key,
  CASE WHEN user_feedback THEN 1 - score ELSE -score END AS correction, event_id, ts FROM rt WHERE score IS NOT NULL AND user_feedback IS NOT NULL),
rk AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, event_id DESC) AS rn FROM hi),
mn AS (SELECT key, CAST(sum(CAST(correction AS DECIMAL(18, 6))) FILTER (rn <= 50) AS DOUBLE) / count(*) FILTER (rn <= 50) AS shift FROM rk GROUP BY 1 HAVING count(*) > 10)"""


@query("feedback_next_run", f"""WITH {_LESSONS},
n AS (SELECT doc_id, page_no, trim(word) AS word, score, {D.canonical("entity_group", "v3", T.LABEL_RULES, T.LABEL_DEFAULT)} AS label FROM v_ner_preds),
ev AS (SELECT 'pattern' AS origin, doc_id, page_no, det_no, word, label, pattern, score FROM v_dets
    WHERE pattern IS NULL OR pattern NOT IN (SELECT pattern FROM off)
  UNION ALL SELECT 'model', doc_id, page_no, NULL, word, label, NULL, score FROM n LEFT JOIN shifts USING (label)
    WHERE length(word) > 2 AND NOT regexp_matches(word, '\\d') AND NOT {D.non_sensitive('word')} AND label <> 'O'
    AND score >= greatest(0.2, least(0.95, CASE label WHEN 'B-PER' THEN 0.60 WHEN 'B-LOC' THEN 0.82 WHEN 'B-DATE' THEN 0.75 ELSE 0.70 END + coalesce(shift, 0)))
    AND NOT (label = 'B-LOC' AND (lower(word) IN {D.in_list(C.IGNORE_WORDS)} OR (NOT contains(word, ' ') AND length(word) < 5))))
SELECT ev.*, CASE WHEN shift IS NULL THEN score ELSE greatest(0.0, least(1.0, score + shift * CAST(0.3 AS DOUBLE))) END AS calibrated
FROM ev LEFT JOIN mn ON mn.key = CASE WHEN pattern IS NOT NULL THEN label || '_' || pattern ELSE label END""")
def feedback_next_run(spark, folder):
    """From stored ratings to the next run: counts, patterns off, shifts, corrections, all taking effect."""
    lessons = selftrain.learn(rated_boxes(spark, folder), gated=False)
    return selftrain.next_run(dets(spark, folder), view(spark, folder, "v_ner_preds"), lessons)
