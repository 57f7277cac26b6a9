"""Registered queries over transcripts and video detections."""
from __future__ import annotations

from pyspark.sql import functions as F

from veilframe import catalogue as C
from veilframe.fixtures import view
from veilframe.functions.scan import dealt
from veilframe.operators import audio, video
from veilframe.plans import duck as D
from veilframe.plans.registry import query
from veilframe.sources import readers

FRAME = ["video_id", "frame_no"]
BOX = ["x1", "y1", "x2", "y2"]

_OFFSETS = """wo AS (SELECT *, CAST(coalesce(sum(length(word) + 1) OVER (PARTITION BY audio_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_char FROM v_words),
wd AS (SELECT *, start_char + length(word) + 1 AS end_char FROM wo)"""
_HITS = f"""{_OFFSETS},
std_a AS (SELECT audio_id, {D.STD.format('text')} AS std FROM (SELECT audio_id, string_agg(word, ' ' ORDER BY pos) AS text FROM v_words GROUP BY 1)),
pc AS (SELECT audio_id, unnest(range(1, len(ps) + 1)) AS i, unnest(ps) AS piece FROM (SELECT audio_id, string_split(regexp_replace(std, {D.lit('(' + C.TRANSCRIPT_PHONE.regex + ')')}, chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS ps FROM std_a)),
ph AS (SELECT audio_id, i, length(piece) AS n, coalesce(sum(length(piece)) OVER (PARTITION BY audio_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM pc),
sp AS (SELECT audio_id, s, e FROM v_spans WHERE label IN {D.in_list(C.AUDIO_ENTITY_LABELS)} UNION ALL SELECT audio_id, s, s + n FROM ph WHERE i % 2 = 0),
hit AS (SELECT * FROM wd w WHERE EXISTS (SELECT 1 FROM sp WHERE sp.audio_id = w.audio_id AND w.end_char > sp.s AND w.start_char < sp.e))"""
_MERGED = f"""{_HITS},
r AS (SELECT audio_id, start_time, end_time, max(end_time) OVER (PARTITION BY audio_id ORDER BY start_time, end_time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM hit),
f AS (SELECT *, CASE WHEN reach IS NULL OR start_time > reach THEN 1 ELSE 0 END AS fresh FROM r),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY audio_id ORDER BY start_time, end_time ROWS UNBOUNDED PRECEDING) AS island FROM f),
mi AS (SELECT audio_id, min(start_time) AS start_time, max(end_time) AS end_time FROM g GROUP BY audio_id, island)"""


def words(spark, folder):
    return audio.number_words(readers.timed_words(view(spark, folder, "v_words")))


def hits(spark, folder):
    numbered = words(spark, folder)
    named = view(spark, folder, "v_spans").where(F.col("label").isin(C.AUDIO_ENTITY_LABELS)).select("audio_id", "s", "e")
    return audio.hit_words(numbered, named.unionByName(audio.phone_spans(numbered)))


@query("audio_words", f"WITH {_OFFSETS} SELECT audio_id, pos, word, start_char, end_char, start_time, end_time FROM wd")
def audio_words(spark, folder):
    return words(spark, folder).select("audio_id", "pos", "word", "start_char", "end_char", "start_time", "end_time")


@query("audio_hits", f"WITH {_HITS} SELECT audio_id, pos, word, start_time, end_time FROM hit")
def audio_hits(spark, folder):
    return hits(spark, folder).select("audio_id", "pos", "word", "start_time", "end_time")


@query("interval_merge", f"WITH {_MERGED} SELECT * FROM mi")
def interval_merge(spark, folder):
    return audio.merge_intervals(hits(spark, folder))


@query("audio_edit_list", f"""WITH {_MERGED},
ms AS (SELECT audio_id, CAST(trunc(start_time * 1000) AS BIGINT) AS a, CAST(trunc(end_time * 1000) AS BIGINT) AS b FROM mi),
n AS (SELECT *, row_number() OVER w - 1 AS nth, coalesce(lag(b) OVER w, 0) AS before FROM ms WINDOW w AS (PARTITION BY audio_id ORDER BY a)),
tot AS (SELECT audio_id, CAST(trunc(max(end_time) * 1000) AS BIGINT) AS total FROM v_words GROUP BY 1),
don AS (SELECT audio_id, max(b) AS last_, count(*) AS n FROM ms GROUP BY 1),
el AS (SELECT audio_id, nth * 2 AS seg_no, before AS start_ms, a AS end_ms, 'keep' AS action, a - before AS length_ms FROM n
  UNION ALL SELECT audio_id, nth * 2 + 1, a, b, 'beep', greatest(300, b - a) FROM n
  UNION ALL SELECT audio_id, coalesce(n, 0) * 2, coalesce(last_, 0), total, 'keep', total - coalesce(last_, 0) FROM tot LEFT JOIN don USING (audio_id))
SELECT * FROM el WHERE action <> 'keep' OR length_ms > 0""")
def audio_edit_list(spark, folder):
    return audio.edit_list(view(spark, folder, "v_words"), audio.merge_intervals(hits(spark, folder)))


def dets(spark, folder):
    return view(spark, folder, "v_frame_dets")


@query("bbox_clip", """WITH c AS (SELECT video_id, frame_no, det_id, greatest(0, x1 - 100) AS x1, greatest(0, y1 - 50) AS y1, least(640, x2 - 100) AS x2, least(360, y2 - 50) AS y2 FROM v_frame_dets)
SELECT * FROM c WHERE x2 > x1 AND y2 > y1""")
def bbox_clip(spark, folder):
    moved = dets(spark, folder).select(*FRAME, "det_id", (F.col("x1") - 100).alias("x1"), (F.col("y1") - 50).alias("y1"),
                                       (F.col("x2") - 100).alias("x2"), (F.col("y2") - 50).alias("y2"))
    return video.clip(moved, 640, 360)


@query("det_filter", """SELECT 'face' AS kind, video_id, frame_no, det_id, x1, y1, x2, y2, score FROM v_frame_dets
WHERE type = 'face' AND score >= 0.55 AND x2 - x1 >= 40 AND y2 - y1 >= 40
UNION ALL SELECT 'vehicle', video_id, frame_no, det_id, x1, y1, x2, y2, score FROM v_frame_dets WHERE type = 'plate' AND det_id % 9 IN (2, 3, 5, 7) AND score > 0.3""")
def det_filter(spark, folder):
    every = dets(spark, folder).withColumn("cls", (F.col("det_id") % 9).cast("int"))
    face = video.faces(every.where("type = 'face'")).withColumn("kind", F.lit("face"))
    vehicle = video.vehicles(every.where("type = 'plate'")).withColumn("kind", F.lit("vehicle"))
    return face.unionByName(vehicle).select("kind", *FRAME, "det_id", *BOX, "score")


@query("plate_region", """SELECT video_id, frame_no, det_id, x1 + CAST(trunc((x2 - x1) * CAST(0.2 AS DOUBLE)) AS INT) AS x1,
  y2 - CAST(trunc((y2 - y1) * CAST(0.22 AS DOUBLE)) AS INT) AS y1, x2 - CAST(trunc((x2 - x1) * CAST(0.2 AS DOUBLE)) AS INT) AS x2, y2 FROM v_frame_dets""")
def plate_region(spark, folder):
    return video.plate_regions(dets(spark, folder)).select(*FRAME, "det_id", *BOX)


@query("frame_sample", "SELECT video_id, frame_no, det_id, type FROM v_frame_dets WHERE frame_no % 5 = 0")
def frame_sample(spark, folder):
    return video.detection_frames(dets(spark, folder)).select(*FRAME, "det_id", "type")


@query("text_carry", """WITH l AS (SELECT video_id, frames - 1 AS last_frame FROM v_videos)
SELECT video_id, det_id, CAST(frame_no + k AS INT) AS shown, x1, y1, x2, y2 FROM v_frame_dets JOIN l USING (video_id), (SELECT unnest([0, 1, 2, 3, 4]) AS k)
WHERE type NOT IN ('face', 'plate') AND frame_no % 5 = 0 AND frame_no + k <= last_frame""")
def text_carry(spark, folder):
    every = dets(spark, folder)
    last = view(spark, folder, "v_videos").select("video_id", (F.col("frames") - 1).alias("last_frame"))
    return video.carry_text(every.where("type NOT IN ('face', 'plate')"), last).select("video_id", "det_id", "shown", *BOX)


_MODES = list(C.POLICIES)
_POLICY_ROWS = ", ".join(f"({D.lit(m)}, {', '.join(str(f).lower() for f in flags)})" for m, flags in C.POLICIES.items())


@query("policy_apply", f"""WITH p(mode, redact_faces, redact_plates, redact_pii, keep_authorized) AS (VALUES {_POLICY_ROWS}),
d AS (SELECT *, ({D.array(_MODES)})[CAST(video_id % 7 AS INT) + 1] AS mode, det_id % 4 = 0 AS authorised FROM v_frame_dets)
SELECT video_id, frame_no, det_id, type, mode, authorised, CASE type WHEN 'face' THEN redact_faces AND NOT (keep_authorized AND authorised)
  WHEN 'plate' THEN redact_plates ELSE redact_pii END AS redact FROM d JOIN p USING (mode)""")
def policy_apply(spark, folder):
    modes = F.array(*map(F.lit, _MODES))
    moded = dets(spark, folder).withColumn("mode", F.get(modes, (F.col("video_id") % 7).cast("int"))).withColumn("authorised", F.col("det_id") % 4 == 0)
    return video.apply_policy(moded).select(*FRAME, "det_id", "type", "mode", "authorised", "redact")


@query("identity_match", """SELECT v.vec_id FROM embeddings v WHERE EXISTS (SELECT 1 FROM embeddings r WHERE r.label = 0
  AND sqrt(list_sum(list_transform(list_zip(v.embedding, r.embedding), lambda p: (CAST(p[1] AS DOUBLE) - p[2]) * (CAST(p[1] AS DOUBLE) - p[2])))) < 1.2)""")
def identity_match(spark, folder):
    every = view(spark, folder, "embeddings")
    return video.match_identities(every, every.where("label = 0"), limit=1.2)


_VOTE_IOU = """CASE WHEN least(b.x2, x2) > greatest(b.x1, x1) AND least(b.y2, y2) > greatest(b.y1, y1) THEN
  CAST((least(b.x2, x2) - greatest(b.x1, x1)) * (least(b.y2, y2) - greatest(b.y1, y1)) AS DOUBLE) /
  ((b.x2 - b.x1) * (b.y2 - b.y1) + (x2 - x1) * (y2 - y1) - (least(b.x2, x2) - greatest(b.x1, x1)) * (least(b.y2, y2) - greatest(b.y1, y1))) ELSE 0 END > 0.5"""


@query("box_vote", f"""WITH RECURSIVE d AS (SELECT *, row_number() OVER (PARTITION BY video_id, frame_no ORDER BY det_id) AS rk FROM v_frame_dets),
w AS (SELECT video_id, frame_no, rk, [{{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'lead': rk}}] AS leads, rk AS lead FROM d WHERE rk = 1
  UNION ALL SELECT video_id, frame_no, rk, CASE WHEN len(mine) = 0 THEN list_append(leads, {{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'lead': rk}}) ELSE leads END,
    CASE WHEN len(mine) = 0 THEN rk ELSE mine[1].lead END
  FROM (SELECT d.video_id, d.frame_no, d.rk, d.x1, d.y1, d.x2, d.y2, w.leads, list_filter(w.leads, lambda b: {_VOTE_IOU.replace(' x1', ' d.x1').replace(' y1', ' d.y1').replace(' x2', ' d.x2').replace(' y2', ' d.y2').replace('(x2', '(d.x2').replace('(y2', '(d.y2')}) AS mine
    FROM w JOIN d ON d.video_id = w.video_id AND d.frame_no = w.frame_no AND d.rk = w.rk + 1))
SELECT video_id, frame_no, min(det_id) AS det_id, count(*) AS votes, CAST(trunc(CAST(sum(x1) AS DOUBLE) / count(*)) AS INT) AS x1, CAST(trunc(CAST(sum(y1) AS DOUBLE) / count(*)) AS INT) AS y1,
  CAST(trunc(CAST(sum(x2) AS DOUBLE) / count(*)) AS INT) AS x2, CAST(trunc(CAST(sum(y2) AS DOUBLE) / count(*)) AS INT) AS y2
FROM w JOIN d USING (video_id, frame_no, rk) GROUP BY video_id, frame_no, w.lead""")
def box_vote(spark, folder):
    return video.vote(dets(spark, folder), FRAME)


@query("track_boxes")
def track_boxes(spark, folder):
    return video.track(dets(spark, folder).where("type IN ('face', 'plate')"), view(spark, folder, "v_videos"))


@query("auth_sticky", """WITH d AS (SELECT video_id, frame_no, det_id, CAST(det_id % 5 AS INT) AS track_id, det_id % 50 = 0 AS is_auth FROM v_frame_dets WHERE type = 'face')
SELECT *, coalesce(max(CASE WHEN is_auth THEN 1 ELSE 0 END) OVER (PARTITION BY video_id, track_id ORDER BY frame_no RANGE UNBOUNDED PRECEDING), 0) = 1 AS authorised FROM d""")
def auth_sticky(spark, folder):
    face = dets(spark, folder).where("type = 'face'").select(
        *FRAME, "det_id", (F.col("det_id") % 5).cast("int").alias("track_id"), (F.col("det_id") % 50 == 0).alias("is_auth"))
    return video.sticky_authorised(face, ["video_id", "track_id"])


@query("redact_video")
def redact_video(spark, folder):
    """The whole run over videos: vote, filter, track, recognise, decide, report."""
    videos = view(spark, folder, "v_videos")
    every = video.clip(dets(spark, folder), 1280, 720)
    seen = every.withColumn("is_auth", F.col("det_id") % 50 == 0)
    moving = video.detection_frames(seen.where("type IN ('face', 'plate')"))
    boxes_ = video.vote(moving, FRAME).select(*FRAME, "det_id", *BOX)
    known = boxes_.join(dealt(moving.select(*FRAME, "det_id", "type", "is_auth")), [*FRAME, "det_id"])
    tracked = video.track(known, videos).select(*FRAME, F.col("track_id").alias("no"), "type", *BOX, "authorised")
    last = videos.select("video_id", (F.col("frames") - 1).alias("last_frame"))
    text = video.carry_text(every.where("type NOT IN ('face', 'plate')"), last).select(
        "video_id", F.col("shown").alias("frame_no"), F.col("det_id").alias("no"), "type", *BOX, F.lit(False).alias("authorised"))
    moded = tracked.unionByName(text).withColumn("mode", F.get(F.array(*map(F.lit, _MODES)), (F.col("video_id") % 7).cast("int")))
    hidden = video.apply_policy(moded).where("redact")
    return video.report_json(video.report(hidden, 24, videos).withColumn("pii_detected", F.to_json("pii_detected")))


_POINTS = " ".join(f"WHEN {D.lit(k)} THEN {v}" for k, v in C.FRAME_RISK_POINTS.items())


@query("frame_risk", f"""SELECT video_id, frame_no, least(50, CAST(sum(CASE lower(type) {_POINTS} ELSE 1 END) AS BIGINT)) AS risk
FROM v_frame_dets GROUP BY GROUPING SETS ((video_id, frame_no), (video_id))""")
def frame_risk(spark, folder):
    return video.frame_risk(dets(spark, folder))


@query("video_report", """WITH k AS (SELECT video_id, type, count(*) AS n FROM v_frame_dets GROUP BY 1, 2),
r AS (SELECT video_id, CAST(coalesce(sum(n) FILTER (type = 'face'), 0) AS BIGINT) AS faces_redacted, CAST(coalesce(sum(n) FILTER (type = 'plate'), 0) AS BIGINT) AS plates_redacted,
  '{' || coalesce(string_agg('"' || type || '":' || n, ',' ORDER BY type) FILTER (type NOT IN ('face', 'plate')), '') || '}' AS pii_detected,
  least(50, CAST(sum(n * CASE type WHEN 'face' THEN 2 WHEN 'plate' THEN 3 ELSE CASE WHEN contains(type, 'phone') THEN 4 WHEN contains(type, 'address') THEN 5
    WHEN contains(type, 'name') THEN 4 ELSE 3 END END) AS BIGINT)) AS privacy_risk_score FROM k GROUP BY 1)
SELECT video_id, frames / CAST(24 AS DOUBLE) AS video_duration_sec, coalesce(faces_redacted, 0) AS faces_redacted, coalesce(plates_redacted, 0) AS plates_redacted,
  coalesce(pii_detected, '{}') AS pii_detected, coalesce(privacy_risk_score, 0) AS privacy_risk_score, CAST(50 AS INT) AS max_score FROM v_videos LEFT JOIN r USING (video_id)""")
def video_report(spark, folder):
    return video.report(dets(spark, folder), 24, view(spark, folder, "v_videos")).withColumn("pii_detected", F.to_json("pii_detected"))
