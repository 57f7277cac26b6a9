"""Deterministic input tables derived from the given ones, in two dialects.

Each view is one SELECT that Spark and DuckDB both understand, so a query and
its check start from the same rows. No view leaves rows out.
"""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

#: Narrow tables of which a view makes many rows from one.
_SPREAD = ("customer", "conversations")

_NOTES = """
SELECT c_custkey AS doc_id,
  concat('Name: ', CASE WHEN c_custkey % 3 = 0 THEN 'Mr. ' WHEN c_custkey % 3 = 1 THEN 'Dr. ' ELSE '' END, 'ASHA PATIL',
    ' PAN ', chr(CAST(65 + c_custkey % 26 AS INT)), 'BC', substr('PCHFATBLJGXYZ', CAST(1 + c_custkey % 13 AS INT), 1), 'K',
    lpad(CAST(c_custkey % 10000 AS STRING), 4, '0'), chr(CAST(65 + (c_custkey * 7) % 26 AS INT)),
    ' Aadhaar ', substr(a, 1, 4), ' ', substr(a, 5, 4), ' ', substr(a, 9, 4),
    ' DOB ', lpad(CAST(1 + c_custkey % 28 AS STRING), 2, '0'), '/', lpad(CAST(1 + c_custkey % 12 AS STRING), 2, '0'), '/1984',
    ' Passport ', chr(CAST(65 + c_custkey % 26 AS INT)), lpad(CAST((c_custkey * 7919) % 10000000 AS STRING), 7, '0'),
    ' phone 9', lpad(CAST((c_custkey * 104729) % 1000000000 AS STRING), 9, '0'),
    ' mail user', CAST(c_custkey AS STRING), '@example.com Blood Group: O+ MRN: ', CAST(c_custkey AS STRING),
    ' 12 MG Road - ', CAST(400000 + c_custkey % 1000 AS STRING),
    ' SSN 123-45-', lpad(CAST(c_custkey % 10000 AS STRING), 4, '0'), ' Card 4111-1111-1111-', lpad(CAST(c_custkey % 10000 AS STRING), 4, '0'),
    ' Vehicle MH12AB', lpad(CAST(c_custkey % 10000 AS STRING), 4, '0'), ' DL MH12 2011', lpad(CAST(c_custkey % 10000000 AS STRING), 7, '0'),
    CASE WHEN c_custkey % 4 = 0 THEN ' diagnosis Diabetes' ELSE '' END,
    CASE WHEN c_custkey % 5 = 0 THEN concat(' P<INDPATIL<<ASHA<<<<<<<<<<<<<', lpad(CAST(c_custkey AS STRING), 6, '0')) ELSE '' END) AS text
FROM (SELECT c_custkey, lpad(CAST((c_custkey * 7919007) % 1000000000000 AS STRING), 12, '0') AS a FROM customer) t
"""

_TEXTS = """
SELECT 'document' AS src, doc_id AS id, text FROM documents
UNION ALL SELECT 'note' AS src, doc_id AS id, text FROM v_notes
UNION ALL SELECT 'conversation' AS src, conv_id * 1000 + turn AS id, text FROM conversations
"""

_TOKENS = """
SELECT doc_id, CAST(1 AS INT) AS page_no, CAST(pos AS BIGINT) AS pos, text,
  CAST(60 + (pos % 8) * 120 AS INT) AS left_x, CAST(40 + floor(pos / 8) * 30 AS INT) AS top,
  CAST(8 * length(text) AS INT) AS width, CAST(20 AS INT) AS height, CAST(50 + (doc_id + pos) % 50 AS INT) AS conf
FROM (SELECT doc_id, pos, text FROM {words}) t WHERE length(text) > 0
"""

_WORDS = """
SELECT conv_id AS audio_id, CAST(turn * 100000 + p AS BIGINT) AS pos, w AS word,
  CAST(turn * 10000 + p * 0.5 AS DOUBLE) AS start_time, CAST(turn * 10000 + p * 0.5 + 0.4 AS DOUBLE) AS end_time
FROM (SELECT conv_id, turn, p, w FROM {words}) t WHERE length(w) > 0
"""

_PREDICTED = ["ASHA", "Road", " PATIL ", "Aadhaar", "asha patil pan", "MG Road", "Pattil", "zzqx"]
# The two models disagree on the entity of every third word.
_PREDS = """
SELECT c_custkey AS doc_id, CAST(1 AS INT) AS page_no, m AS model, word,
  CASE WHEN m = 1 AND (c_custkey + length(word)) % 3 = 0 THEN 'ORG' WHEN word = 'Aadhaar' THEN 'MISC'
    WHEN word IN ('Road', 'MG Road') THEN 'LOC' ELSE 'PER' END AS entity_group,
  CAST(((c_custkey * 31 + m * 17 + length(word)) % 100) AS DOUBLE) / 100 AS score
FROM {source}
"""

VIEWS = {
    "v_notes": (_NOTES, _NOTES),
    "v_texts": (_TEXTS, _TEXTS),
    "v_tokens": (
        _TOKENS.format(words="v_notes LATERAL VIEW posexplode(split(text, ' ')) x AS pos, w").replace(
            "SELECT doc_id, pos, text FROM", "SELECT doc_id, pos, w AS text FROM"),
        _TOKENS.format(words="(SELECT doc_id, unnest(range(len(string_split(text, ' ')))) AS pos, "
                             "unnest(string_split(text, ' ')) AS text FROM v_notes) u"),
    ),
    "v_words": (
        _WORDS.format(words="conversations LATERAL VIEW posexplode(split(text, ' ')) x AS p, w"),
        _WORDS.format(words="(SELECT conv_id, turn, unnest(range(len(string_split(text, ' ')))) AS p, "
                            "unnest(string_split(text, ' ')) AS w FROM conversations) u"),
    ),
    "v_ner_preds": tuple(_PREDS.format(source=source) for source in (
        "customer LATERAL VIEW explode(array(0, 1)) k AS m LATERAL VIEW explode(array({words})) e AS word".format(
            words=", ".join(f"'{w}'" for w in _PREDICTED)),
        "(SELECT c_custkey, m, unnest([{words}]) AS word FROM (SELECT c_custkey, unnest([0, 1]) AS m FROM customer))".format(
            words=", ".join(f"'{w}'" for w in _PREDICTED)))),
    "v_spans": ("""
SELECT DISTINCT conv_id AS audio_id, CAST((conv_id * 13 + turn * 29) % 200 AS INT) AS s,
  CAST((conv_id * 13 + turn * 29) % 200 + 5 + turn AS INT) AS e,
  CASE WHEN turn % 4 = 0 THEN 'PER' WHEN turn % 4 = 1 THEN 'ORG' WHEN turn % 4 = 2 THEN 'LOC' ELSE 'MISC' END AS label
FROM conversations
""",) * 2,
    "v_frame_dets": ("""
SELECT l_suppkey AS video_id, CAST(l_partkey % 60 AS INT) AS frame_no,
  ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 100 + CAST(l_quantity AS BIGINT) AS det_id,
  CASE WHEN l_returnflag = 'A' THEN 'face' WHEN l_returnflag = 'N' THEN 'plate' ELSE 'phone_number' END AS type,
  CAST((l_orderkey * 37) % 900 AS INT) AS x1, CAST((l_partkey * 53) % 500 AS INT) AS y1,
  CAST((l_orderkey * 37) % 900 + 20 + CAST(l_quantity AS BIGINT) AS INT) AS x2,
  CAST((l_partkey * 53) % 500 + 20 + CAST(l_quantity AS BIGINT) AS INT) AS y2,
  1 - l_discount * 5 AS score FROM lineitem
""",) * 2,
    "v_videos": ("""
SELECT s_suppkey AS video_id, CAST(60 + s_suppkey % 7 AS INT) AS frames FROM supplier
""",) * 2,
    "v_dets": ("""
SELECT o_custkey AS doc_id, CAST(1 + o_orderkey % 5 AS INT) AS page_no, o_orderkey AS det_no,
  concat('W', CAST(o_orderkey % 97 AS STRING)) AS word,
  CASE o_orderkey % 5 WHEN 0 THEN 'B-DOC' WHEN 1 THEN 'B-PER' WHEN 2 THEN 'B-LOC' WHEN 3 THEN 'B-HEALTH' ELSE 'B-EMAIL' END AS label,
  CASE o_orderkey % 5 WHEN 0 THEN 'PAN' WHEN 1 THEN NULL WHEN 2 THEN 'PINCODE' WHEN 3 THEN 'MRN' ELSE 'EMAIL' END AS pattern,
  CASE o_orderkey % 5 WHEN 0 THEN 100 WHEN 1 THEN 75 WHEN 2 THEN 40 WHEN 3 THEN 95 ELSE 90 END AS priority,
  CASE WHEN o_orderkey % 5 = 1 THEN CAST(o_orderkey % 100 AS DOUBLE) / 100 END AS score,
  CAST((o_orderkey * 41) % 2500 - 20 AS INT) AS x0, CAST((o_orderkey * 67) % 3300 - 20 AS INT) AS y0,
  CAST((o_orderkey * 41) % 2500 - 20 + (o_orderkey % 11) * 90 * CASE WHEN o_orderkey % 13 = 0 THEN -1 ELSE 1 END AS INT) AS x1,
  CAST((o_orderkey * 67) % 3300 - 20 + (o_orderkey % 60) * 4 AS INT) AS y1,
  CAST(2550 AS INT) AS page_w, CAST(3300 AS INT) AS page_h FROM orders
""",) * 2,
    "v_feedback": ("""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'B-LOC' WHEN 1 THEN 'B-PER' WHEN 2 THEN 'B-DOC' ELSE 'B-DATE' END AS label,
  CASE event_type WHEN 'view' THEN 'PINCODE' WHEN 'signup' THEN 'PAN' WHEN 'click' THEN 'DOB' WHEN 'purchase' THEN 'EMAIL' ELSE NULL END AS pattern,
  CAST(event_id % 100 AS DOUBLE) / 100 AS score,
  CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_type = 'view' THEN event_id % 3 = 0
       ELSE event_id % 4 <> 0 OR event_id % 3 = 0 END AS user_feedback,
  event_id % 7 = 0 AND event_id % 2 = 0 AS missed_detection, ts FROM events
""",) * 2,
    # Users call boxes right of the middle wrong, and most place names; some rate at random, some not at all.
    "v_ratings": ("""
SELECT e.event_id AS det_no, e.event_id, e.ts, CASE WHEN e.event_id % 7 = 0 THEN NULL WHEN e.event_type = 'view' THEN e.event_id % 3 = 0
  WHEN d.label = 'B-LOC' THEN d.x0 < 500 ELSE d.x0 < 1500 END AS user_feedback FROM events e JOIN v_dets d ON e.event_id = d.det_no
""",) * 2,
    "v_ocr_conf": ("""
SELECT l_orderkey AS page_id, CAST(90 * (l_linenumber % 4) AS INT) AS rotation,
  CAST(CASE WHEN l_partkey % 10 = 0 THEN -1 ELSE l_partkey % 101 END AS INT) AS conf FROM lineitem
""",) * 2,
}


def _needed(sql: str, dialect: int) -> list[str]:
    """Views a statement uses, inner ones first."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b{name}\b", text) and name not in order:
                visit(VIEWS[name][dialect])
                if name not in order:
                    order.append(name)

    visit(sql)
    return order


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One given table. Those whose rows the views multiply are spread out first."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))) if name in _SPREAD else df


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A derived view (or a given table) of one data folder."""
    if name in TABLES:
        return table(spark, folder, name)
    names = _needed(name, 0)
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][0]})" for n in names)
    body = f"WITH {ctes} SELECT * FROM {name}"
    used = [t for t in TABLES if re.search(rf"\b{t}\b", body)]
    for given in used:
        body = re.sub(rf"\b(FROM|JOIN) {given}\b", rf"\1 {{{given}}}", body)
    return spark.sql(body, **{t: table(spark, folder, t) for t in used})


def duck(sql: str) -> str:
    """The check's SQL with the derived views it needs put in front."""
    names = _needed(sql, 1)
    if not names:
        return sql
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in names)
    head = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql, re.I)
    if head:
        return f"WITH {head.group(1) or ''}{ctes},\n{sql[head.end():]}"
    return f"WITH {ctes}\n{sql}"
