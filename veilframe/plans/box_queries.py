"""Registered queries over page detections and model predictions."""
from __future__ import annotations

from pyspark.sql import functions as F

from veilframe import catalogue as C
from veilframe.fixtures import view
from veilframe.functions import text as T
from veilframe.functions.scan import bind, dealt, tasks_for
from veilframe.operators import align, boxes as ops
from veilframe.operators import feedback as feedback_ops
from veilframe.operators import gate as gate_ops
from veilframe.operators import selftrain
from veilframe.operators import report
from veilframe.operators import text as text_ops
from veilframe.operators import tokens as token_ops
from veilframe.plans import duck as D
from veilframe.plans.page_queries import NUMBERED, numbered, numbered_once, tokens
from veilframe.plans.registry import query
from veilframe.session import written

PAGE = ["doc_id", "page_no"]
BOX = ["x0", "y0", "x1", "y1"]
_B = "CAST(b.x0 AS INT) AS x0, CAST(b.y0 AS INT) AS y0, CAST(b.x1 AS INT) AS x1, CAST(b.y1 AS INT) AS y1"
VALID = f"valid AS (SELECT v.* EXCLUDE (x0, y0, x1, y1, b), {_B} FROM (SELECT *, {D.valid_box('x0', 'y0', 'x1', 'y1', 'page_w', 'page_h')} AS b FROM v_dets) v WHERE b IS NOT NULL)"


def dets(spark, folder):
    return view(spark, folder, "v_dets")


def _grown(pad: int, source: str) -> str:
    return (f"SELECT * EXCLUDE (x0, y0, x1, y1), greatest(0, x0 - {pad}) AS x0, greatest(0, y0 - {pad}) AS y0, "
            f"least(page_w, x1 + {pad}) AS x1, least(page_h, y1 + {pad}) AS y1 FROM {source}")


@query("bbox_validate", f"WITH {VALID} SELECT doc_id, page_no, det_no, x0, y0, x1, y1 FROM valid")
def bbox_validate(spark, folder):
    return ops.validate(dets(spark, folder)).select(*PAGE, "det_no", *BOX)


@query("bbox_expand", f"WITH {VALID}, " + ", ".join(f"g_{k} AS ({_grown(v, 'valid')})" for k, v in C.BOX_PADDING.items()) + " "
       + " UNION ALL ".join(f"SELECT {D.lit(k)} AS kind, doc_id, page_no, det_no, x0, y0, x1, y1 FROM g_{k}" for k in C.BOX_PADDING))
def bbox_expand(spark, folder):
    valid = ops.validate(dets(spark, folder))
    parts = [ops.expand(valid, k).select(F.lit(k).alias("kind"), *PAGE, "det_no", *BOX) for k in C.BOX_PADDING]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


_ACTION = ("CASE WHEN level = 4 THEN 'inpaint' WHEN label IN ('B-HEALTH', 'B-DOC') THEN 'mask' WHEN level = 1 THEN 'blur' "
           "WHEN level = 2 THEN 'mask' ELSE 'synth' END")


@query("redact_instructions", f"""WITH {VALID}, g AS ({_grown(5, 'valid')}),
a AS (SELECT *, {_ACTION} AS action FROM (SELECT g.*, unnest([1, 2, 3, 4]) AS level FROM g) WHERE x1 > x0 AND y1 > y0)
SELECT doc_id, page_no, det_no, CAST(level AS INT) AS level, x0, y0, x1, y1, action,
  CASE action WHEN 'mask' THEN '0,0,0' WHEN 'synth' THEN '255,255,255' END AS fill,
  CASE WHEN action = 'synth' THEN repeat('█', CAST(least(8, floor((x1 - x0) / 8)) AS INT)) END AS text FROM a""")
def redact_instructions(spark, folder):
    levelled = dets(spark, folder).withColumn("each", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3, 4)])))
    return ops.instructions(levelled, F.col("each")).select(*PAGE, "det_no", "level", *BOX, "action", "fill", "text")


@query("number_detections", """SELECT doc_id, page_no, det_no, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, det_no) AS number FROM v_dets""")
def number_detections(spark, folder):
    return ops.number_detections(dets(spark, folder)).select(*PAGE, "det_no", "number")


_MODES = {"mask": ("'0,0,0'", "CAST(NULL AS VARCHAR)"), "synth": ("'255,255,255'", D.surrogate("word")), "inpaint": ("CAST(NULL AS VARCHAR)", "CAST(NULL AS VARCHAR)")}
_CORNERS = "(SELECT doc_id, page_no, det_no, word, page_w, page_h, least(x0, x1) AS x0, least(y0, y1) AS y0, greatest(x0, x1) AS x1, greatest(y0, y1) AS y1 FROM v_dets)"


@query("instructions_named", f"WITH g AS ({_grown(C.BOX_PADDING['v1'], _CORNERS)}) " + " UNION ALL ".join(
    f"SELECT doc_id, page_no, det_no, '{m}' AS action, x0, y0, x1, y1, {fill} AS fill, {text} AS text FROM g WHERE x1 - x0 >= 6 AND y1 - y0 >= 6"
    for m, (fill, text) in _MODES.items()))
def instructions_named(spark, folder):
    modes = [ops.instructions_named(dets(spark, folder), m) for m in _MODES]
    every = modes[0].unionByName(modes[1]).unionByName(modes[2])
    return every.select(*PAGE, "det_no", "action", *BOX, "fill", "text")


@query("overlay_labels", f"""SELECT doc_id, page_no, det_no, x0, y0, x1, y1,
  CAST(row_number() OVER (PARTITION BY doc_id, page_no ORDER BY det_no) AS VARCHAR) || ':' || coalesce(pattern, label) AS caption,
  CASE label {' '.join(f"WHEN {D.lit(k)} THEN {D.lit(v)}" for k, v in C.OVERLAY_COLOURS.items())} ELSE {D.lit(C.OVERLAY_DEFAULT)} END AS colour,
  greatest(0, y0 - 15) AS caption_y FROM v_dets""")
def overlay_labels(spark, folder):
    return ops.overlay(dets(spark, folder))


@query("det_features", f"""SELECT det_no, coalesce(score, 0.5) AS f_score, priority AS f_priority, x0 / page_w AS rel_x, y0 / page_h AS rel_y,
  (x1 - x0) / page_w AS rel_width, (y1 - y0) / page_h AS rel_height, CAST(length(word) AS INT) AS word_len, CAST({D.is_upper('word')} AS INT) AS is_upper,
  CAST(regexp_matches(word, '\\p{{Nd}}') AS INT) AS has_digit, CAST(1 AS INT) AS num_tokens,
  CAST({D.hash_number('label')} % 1000 AS INT) AS label_id FROM v_dets""")
def det_features(spark, folder):
    return ops.features(dets(spark, folder)).select(
        "det_no", "f_score", "f_priority", "rel_x", "rel_y", "rel_width", "rel_height", "word_len", "is_upper", "has_digit", "num_tokens", "label_id")


@query("det_distinct", """SELECT doc_id, page_no, x0, y0, x1, y1, label, min(det_no) AS det_no, arg_min(word, det_no) AS word
FROM (SELECT doc_id, page_no, x0 // 600 AS x0, y0 // 600 AS y0, x1 // 600 AS x1, y1 // 600 AS y1, label, det_no, word FROM v_dets) GROUP BY ALL""")
def det_distinct(spark, folder):
    # Coarse coordinates make equal boxes common enough to matter.
    coarse = dets(spark, folder).select(*PAGE, *[F.expr(f"CAST({c} DIV 600 AS INT)").alias(c) for c in BOX], "label", "det_no", "word")
    return ops.first_of_equal(coarse, [*PAGE, *BOX, "label"])


def _detectors(spark, folder):
    toks = numbered_once(spark, folder)
    named = _aligned(spark, folder, "v3", toks).withColumn("label", T.canonical_label(F.col("entity_group"), "v3")).select(
        *PAGE, "idx", "n_tokens", "word", *BOX, "label", F.lit(None).cast("string").alias("pattern"), F.lit(C.NER_PRIORITY).alias("priority"), "score")
    return {
        "ner": named, "name": token_ops.upper_names(toks),
        "pattern": token_ops.find_patterns(toks, C.ID_PATTERNS), "health": token_ops.find_patterns(toks, C.HEALTH_PATTERNS),
        "field": token_ops.field_values(toks), "context": token_ops.name_context(toks), "mrz": token_ops.machine_readable(toks),
        "given": ops.validate(dets(spark, folder)).select(*PAGE, "word", *BOX, "label", "pattern", "priority", "score"),
    }


def _check_sql(key: str) -> str:
    """The check SQL of another query as a sub-select."""
    from veilframe.plans.registry import CHECKS
    return f"({CHECKS[key]})"


@query("token_labels", f"""WITH {VALID},
t AS (SELECT v_tokens.doc_id, v_tokens.page_no, v_tokens.pos, arg_max(v.label, v.det_no) AS label FROM v_tokens JOIN valid v
  ON v.doc_id = v_tokens.doc_id AND 1 + v.det_no % 5 = v.page_no AND v_tokens.left_x < v.x1 AND v_tokens.left_x + v_tokens.width > v.x0
  AND v_tokens.top < v.y1 AND v_tokens.top + v_tokens.height > v.y0 GROUP BY ALL)
SELECT doc_id, page_no, pos, coalesce(label, 'O') AS label FROM v_tokens LEFT JOIN t USING (doc_id, page_no, pos)""")
def token_labels(spark, folder):
    # The fixture's detections sit on pages 1 to 5, its tokens on page 1: fold the pages together.
    given = ops.validate(dets(spark, folder)).withColumn("page_no", F.lit(1))
    return ops.label_tokens(tokens(spark, folder), given).select(*PAGE, "pos", "label")


@query("iou_pairs", """WITH p AS (SELECT a.video_id, a.frame_no, a.det_id AS a_id, b.det_id AS b_id,
  CAST((least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS DOUBLE) AS shared,
  CAST((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS DOUBLE) AS both_
  FROM v_frame_dets a JOIN v_frame_dets b ON a.video_id = b.video_id AND a.frame_no = b.frame_no AND a.det_id < b.det_id
  AND a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2)
SELECT video_id, frame_no, a_id, b_id, shared / (both_ - shared) AS iou FROM p""")
def iou_pairs(spark, folder):
    pairs = ops.pairs_with_iou(view(spark, folder, "v_frame_dets"), ["video_id", "frame_no"], ("x1", "y1", "x2", "y2"), "det_id")
    return pairs.select("video_id", "frame_no", F.col("a_det_id").alias("a_id"), F.col("b_det_id").alias("b_id"), "iou")


_VOTED = """voted AS (SELECT doc_id, page_no, trim(word) AS word, entity_group, count(*) AS votes, max(score) AS top_score,
  CAST(sum(CAST(score AS DECIMAL(18, 6))) AS DOUBLE) / count(*) AS score FROM v_ner_preds GROUP BY 1, 2, 3, 4
  HAVING count(*) >= 2 OR max(score) > 0.85)"""


@query("ner_vote", f"WITH {_VOTED} SELECT * FROM voted")
def ner_vote(spark, folder):
    return align.vote(view(spark, folder, "v_ner_preds"))


_SHIFTS = """shifts AS (SELECT label, 0.30 AS shift FROM (SELECT label, count(*) FILTER (user_feedback) AS tp, count(*) FILTER (NOT user_feedback) AS fp
  FROM v_feedback GROUP BY label) WHERE label = 'B-LOC' AND CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END < 0.40)"""
_CANON = D.canonical("entity_group", "v3", T.LABEL_RULES, T.LABEL_DEFAULT)


@query("ner_accept", f"""WITH {_SHIFTS},
n AS (SELECT doc_id, page_no, model, trim(word) AS word, entity_group, score, {_CANON} AS label FROM v_ner_preds)
SELECT doc_id, page_no, model, word, entity_group, score, label FROM n LEFT JOIN shifts USING (label)
WHERE length(word) > 2 AND NOT regexp_matches(word, '\\d') AND NOT {D.non_sensitive('word')} AND label <> 'O'
  AND score >= greatest(0.2, least(0.95, CASE label WHEN 'B-PER' THEN 0.60 WHEN 'B-LOC' THEN 0.82 WHEN 'B-DATE' THEN 0.75 ELSE 0.70 END + coalesce(shift, 0)))
  AND NOT (label = 'B-LOC' AND (lower(word) IN {D.in_list(C.IGNORE_WORDS)} OR (NOT contains(word, ' ') AND length(word) < 5)))""")
def ner_accept(spark, folder):
    shifts = feedback_ops.threshold_shifts(view(spark, folder, "v_feedback"))
    return align.accept(view(spark, folder, "v_ner_preds"), shifts).select(*PAGE, "model", "word", "entity_group", "score", "label")


def _align_sql(rule: str) -> str:
    ends = ("inside = 0 AND gone + length(text) >= need" if rule == "v3" else "2 * gone + length(text) >= inside + need")
    box = D.valid_box("x0", "y0", "x1", "y1", "2550", "3300") if rule == "v3" else "{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}"
    return f"""WITH {NUMBERED}, {_VOTED},
ct AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id, page_no ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c0 FROM tok),
pg AS (SELECT doc_id, page_no, lower(string_agg(text, ' ' ORDER BY pos)) AS body FROM v_tokens GROUP BY 1, 2),
hit AS (SELECT v.*, lower(v.word) AS needle, instr(body, lower(v.word)) - 1 AS place FROM voted v JOIN pg USING (doc_id, page_no) WHERE contains(body, lower(v.word))),
st AS (SELECT h.doc_id, h.page_no, h.word, entity_group, votes, score, place, length(needle) AS need, arg_max(t.idx, t.idx) AS first_, max(t.c0) AS s0
  FROM hit h JOIN ct t ON t.doc_id = h.doc_id AND t.page_no = h.page_no AND t.c0 <= h.place GROUP BY ALL),
nx AS (SELECT st.*, place - s0 AS inside, t.idx, t.text, t.c0 - s0 AS gone FROM st JOIN ct t ON t.doc_id = st.doc_id AND t.page_no = st.page_no AND t.idx >= first_),
en AS (SELECT doc_id, page_no, word, entity_group, votes, score, first_, min(idx) AS last_ FROM nx WHERE {ends} GROUP BY ALL),
g AS (SELECT en.doc_id, en.page_no, entity_group, votes, score, first_ AS idx, count(*) AS n, string_agg(t.text, ' ' ORDER BY t.idx) AS word,
  min(t.left_x) AS x0, min(t.top) AS y0, max(t.left_x + t.width) AS x1, max(t.top + t.height) AS y1
  FROM en JOIN tok t ON t.doc_id = en.doc_id AND t.page_no = en.page_no AND t.idx BETWEEN first_ AND last_ GROUP BY en.doc_id, en.page_no, en.word, entity_group, votes, score, first_),
m AS (SELECT *, {box} AS b FROM g)
SELECT doc_id, page_no, entity_group, votes, score, idx, CAST(n AS INT) AS n_tokens, word, {_B} FROM m WHERE b IS NOT NULL"""


def _aligned(spark, folder, rule, toks=None):
    voted = align.vote(view(spark, folder, "v_ner_preds"))
    return align.align(voted, toks or numbered_once(spark, folder), rule).select(
        *PAGE, "entity_group", "votes", "score", "idx", "n_tokens", "word", *BOX)


@query("ner_align", _align_sql("v3"))
def ner_align(spark, folder):
    return _aligned(spark, folder, "v3")


@query("ner_align_v0", _align_sql("v0"))
def ner_align_v0(spark, folder):
    return _aligned(spark, folder, "v0")


def _all_detections_sql() -> str:
    """Every detector's check, once those further down are registered."""
    return f"WITH {VALID} " + " UNION ALL ".join([
    *[f"SELECT {D.lit(d)} AS detector, doc_id, page_no, idx, n_tokens, word, x0, y0, x1, y1, label, pattern, priority, CAST(NULL AS DOUBLE) AS score FROM {_check_sql(k)}"
      for d, k in (("pattern", "id_patterns"), ("pattern", "token_windows"), ("health", "health_patterns"), ("name", "upper_names"),
                   ("field", "field_values"), ("context", "name_context"), ("mrz", "mrz"))],
    f"SELECT 'ner', doc_id, page_no, idx, n_tokens, word, x0, y0, x1, y1, {_CANON}, CAST(NULL AS VARCHAR), CAST({C.NER_PRIORITY} AS INT), score FROM {_check_sql('ner_align')}",
    "SELECT 'given', doc_id, page_no, CAST(NULL AS BIGINT), CAST(NULL AS INT), word, x0, y0, x1, y1, label, pattern, priority, score FROM valid"])


@query("all_detections", _all_detections_sql())
def all_detections(spark, folder):
    cols = ["detector", *PAGE, "idx", "n_tokens", "word", *BOX, "label", "pattern", "priority", "score"]
    return ops.union_all(_detectors(spark, folder)).select(*cols)


def merged_pages(spark, folder):
    """Pages' detections of all detectors without disabled patterns and wrong checksums, merged."""
    rated = view(spark, folder, "v_feedback")
    found = all_detections(spark, folder).drop("detector")
    live = feedback_ops.drop_disabled(found, feedback_ops.disabled_patterns(rated))
    checked = ops.valid_identifiers(live).withColumn("det_no", F.xxhash64(*PAGE, "idx", "n_tokens", "pattern", "label", *BOX))
    return ops.merge_by_priority(checked)


def page_gate(spark, folder):
    """The gate's model, learned from the ratings stored under detections' numbers."""
    return selftrain.learn(written(selftrain.rate(dets(spark, folder), view(spark, folder, "v_ratings")), "rated")).model


def gated_pages(merged, history, model):
    """Merged detections with calibrated scores, those the gate believes in, and the risk of their page."""
    sized = merged.withColumn("page_w", F.lit(2550)).withColumn("page_h", F.lit(3300))
    scored = feedback_ops.calibrate(sized, history).withColumn("score", F.col("calibrated")).drop("calibrated", "key")
    kept = written(gate_ops.apply(ops.features(scored), model).drop(*(c for c in gate_ops.INPUTS)), "kept")
    return kept.join(dealt(report.page_risk(kept)), PAGE)


@query("redact_pages")
def redact_pages(spark, folder):
    """The whole run over pages: all detectors, disabled patterns, checksums, merge,
    calibration, gate, page risk, and what a renderer has to draw."""
    history = feedback_ops.corrections(view(spark, folder, "v_feedback"))
    kept = gated_pages(merged_pages(spark, folder), history, page_gate(spark, folder))
    if "gate" not in kept.columns:
        kept = kept.withColumn("gate", F.lit(None).cast("double"))
    return ops.instructions(kept, F.lit(2)).select(
        *PAGE, "word", *BOX, "label", "pattern", "priority", "score", "gate", "risk", "n_merged", "action", "fill")


@query("anti_overlap", f"""SELECT h.* FROM {_check_sql('id_patterns')} h WHERE NOT EXISTS (SELECT 1 FROM {_check_sql('ner_align')} a
  WHERE a.doc_id = h.doc_id AND a.page_no = h.page_no AND a.x0 < h.x1 AND h.x0 < a.x1 AND a.y0 < h.y1 AND h.y0 < a.y1)
UNION ALL SELECT h.* FROM {_check_sql('field_values')} h WHERE NOT EXISTS (SELECT 1 FROM {_check_sql('ner_align')} a
  WHERE a.doc_id = h.doc_id AND a.page_no = h.page_no AND a.x0 < h.x1 AND h.x0 < a.x1 AND a.y0 < h.y1 AND h.y0 < a.y1)""")
def anti_overlap(spark, folder):
    toks = numbered_once(spark, folder)
    extra = token_ops.match_tokens(toks, C.ID_PATTERNS).drop("pno").unionByName(token_ops.field_values(toks))
    keyed = extra.withColumn("hit", F.struct("idx", "pattern", "priority", "n_tokens"))
    return ops.without_overlap(keyed, _aligned(spark, folder, "v3", toks), "hit").drop("hit")


def _hits_of(toks):
    pages = token_ops.page_text(toks)
    found = text_ops.explode_spans(text_ops.detect(pages, C.ID_PATTERNS_V0), PAGE)
    labels = F.create_map(*[F.lit(x) for p in C.ID_PATTERNS_V0 for x in (p.name, p.label)])
    return found.select(*PAGE, F.col("original").alias("word"), labels[F.col("label")].alias("label"))


def _page_hits(spark, folder):
    return _hits_of(tokens(spark, folder))


_HITS = " UNION ALL ".join(
    f"SELECT doc_id, page_no, unnest(regexp_extract_all(body, {D.rx(p)})) AS hit, {D.lit(p.label)} AS label FROM pg" for p in C.ID_PATTERNS_V0)


@query("regex_align_exact", f"""WITH {NUMBERED}, pg AS (SELECT doc_id, page_no, string_agg(text, ' ' ORDER BY pos) AS body FROM v_tokens GROUP BY 1, 2),
hits AS (SELECT DISTINCT doc_id, page_no, lower(hit) AS needle, label FROM ({_HITS}))
SELECT h.doc_id, h.page_no, h.needle, h.label, min(t.idx) AS idx FROM hits h
JOIN tok t ON t.doc_id = h.doc_id AND t.page_no = h.page_no AND lower(t.text) = h.needle GROUP BY ALL""")
def regex_align_exact(spark, folder):
    toks = tokens(spark, folder)
    tasks = tasks_for(toks)
    if tasks:
        # Where all pages have one number it would be left out of the keys of joins and windows,
        # which would then not be those that rows were dealt by.
        toks = bind(toks.withColumnRenamed("page_no", "_page"), page_no=F.col("_page")).drop("_page")
    return align.exact_hits(_hits_of(toks), token_ops.number_tokens(toks, tasks=tasks), tasks)


@query("regex_align")
def regex_align(spark, folder):
    return align.align_hits(_page_hits(spark, folder), numbered_once(spark, folder))


@query("regex_align_v1")
def regex_align_v1(spark, folder):
    return align.align_hits(_page_hits(spark, folder), numbered_once(spark, folder), variant="v1")


@query("ner_align_fuzzy")
def ner_align_fuzzy(spark, folder):
    return align.align_fuzzy(align.vote(view(spark, folder, "v_ner_preds")), numbered_once(spark, folder))


@query("name_propagate")
def name_propagate(spark, folder):
    toks = numbered_once(spark, folder)
    people = _aligned(spark, folder, "v3", toks).where("entity_group = 'PER'")
    lines = written(token_ops.merge_lines(toks), "lines")
    return align.propagate_names(people, toks, lines)


@query("fuzz_scores")
def fuzz_scores(spark, folder):
    from veilframe.functions import fuzzy
    # Every token against the next one of its page.
    toks = numbered(spark, folder).select(*PAGE, "idx", F.lower("text").alias("a"))
    after = toks.select(*PAGE, (F.col("idx") - 1).alias("idx"), F.col("a").alias("b"))
    pairs = toks.join(dealt(after), PAGE + ["idx"])
    return pairs.select(*PAGE, "idx", "a", "b", fuzzy.ratio_udf("a", "b").alias("ratio"),
                        fuzzy.partial_ratio_udf("a", "b").alias("partial"), fuzzy.token_set_ratio_udf("a", "b").alias("token_set"))


@query("dedup_strict")
def dedup_strict(spark, folder):
    # Repeating the detections a pixel further right gives near duplicates to drop.
    given = ops.validate(dets(spark, folder))
    moved = given.withColumn("x0", F.col("x0") + 1).withColumn("x1", F.col("x1") + 1).withColumn("det_no", -F.col("det_no") - 1)
    return ops.drop_similar_strict(given.unionByName(moved)).select(*PAGE, "det_no", "word", *BOX, "label", "priority")


@query("dedup_tokens")
def dedup_tokens(spark, folder):
    first = tokens(spark, folder)
    second = first.withColumn("left_x", F.col("left_x") + 1).withColumn("pos", F.col("pos") + 1000000).withColumn("conf", F.col("conf") - 1)
    return ops.drop_similar_tokens(first.unionByName(second)).select(*PAGE, "pos", "text", "conf")


@query("dedup_priority")
def dedup_priority(spark, folder):
    return ops.merge_by_priority(ops.validate(dets(spark, folder)))


_MEETS = "(least(w.x1, t.x1) > greatest(w.x0, t.x0) AND least(w.y1, t.y1) > greatest(w.y0, t.y0))"
_GROWN = ", ".join(f"CASE WHEN {_MEETS} THEN {f}(w.{c}, t.{c}) ELSE t.{c} END" for c, f in
                   (("x0", "least"), ("y0", "least"), ("x1", "greatest"), ("y1", "greatest")))


@query("box_chain_merge", f"""WITH RECURSIVE {VALID},
t AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY y0, x0, det_no) AS rk FROM valid),
w AS (SELECT doc_id, page_no, rk, det_no AS head, x0, y0, x1, y1 FROM t WHERE rk = 1
  UNION ALL SELECT t.doc_id, t.page_no, t.rk, CASE WHEN {_MEETS} THEN w.head ELSE t.det_no END, {_GROWN}
  FROM w JOIN t ON t.doc_id = w.doc_id AND t.page_no = w.page_no AND t.rk = w.rk + 1)
SELECT w.doc_id, w.page_no, head AS det_no, string_agg(t.word, ' ' ORDER BY t.rk) AS word, min(t.x0) AS x0, min(t.y0) AS y0, max(t.x1) AS x1,
  max(t.y1) AS y1, arg_min(t.label, t.rk) AS label, CAST(count(*) AS INT) AS n_merged
FROM w JOIN t ON t.doc_id = w.doc_id AND t.page_no = w.page_no AND t.rk = w.rk GROUP BY w.doc_id, w.page_no, head""")
def box_chain_merge(spark, folder):
    return ops.merge_chain(ops.validate(dets(spark, folder)))


@query("anon_examples", f"""WITH l AS ({_check_sql('token_labels')})
SELECT doc_id, page_no, pos // 65536 AS part, list({D.surrogate('text')} ORDER BY pos) AS words,
  list([left_x, top, left_x + width, top + height] ORDER BY pos) AS boxes, list(label ORDER BY pos) AS labels
FROM v_tokens JOIN l USING (doc_id, page_no, pos) GROUP BY 1, 2, 3""")
def anon_examples(spark, folder):
    given = ops.validate(dets(spark, folder)).withColumn("page_no", F.lit(1))
    labelled = ops.label_tokens(tokens(spark, folder), given)
    from veilframe.sources import sinks
    return sinks.examples(labelled)


_NAMES = {"ASHA PATIL": "PERSON", "MG Road": "LOC", "Maharashtra": "GPE"}


@query("dict_ner", "WITH " + D.spans([C.Pattern(label, rf"\b(?:{word})\b") for word, label in _NAMES.items()])
       + ' SELECT src, id, "start", "end", original AS word, label AS entity_group FROM found')
def dict_ner(spark, folder):
    return align.dictionary_entities(view(spark, folder, "v_texts"), ["src", "id"], _NAMES)
