"""Registered queries over OCR tokens."""
from __future__ import annotations

from pyspark.sql import functions as F

from veilframe import catalogue as C
from veilframe.fixtures import view
from veilframe.functions import text as T
from veilframe.operators import boxes as box_ops
from veilframe.operators import feedback as feedback_ops
from veilframe.operators import tokens as ops
from veilframe.plans import duck as D
from veilframe.plans.registry import query
from veilframe.session import written
from veilframe.sources import readers

W, H = ops.PAGE_SIZE
OUT = ["doc_id", "page_no", "idx", "n_tokens", "word", "x0", "y0", "x1", "y1", "label", "pattern", "priority"]


def tokens(spark, folder):
    return readers.tokens(view(spark, folder, "v_tokens"))


def numbered(spark, folder):
    return ops.number_tokens(tokens(spark, folder))


def numbered_once(spark, folder):
    """Numbered tokens for queries that join them many times: written once, each join reads its columns."""
    return written(numbered(spark, folder), "tokens")


NUMBERED = f"""tok AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY pos) - 1 AS idx,
  {D.valid_box('left_x', 'top', 'left_x + width', 'top + height', W, H)} AS box FROM v_tokens)"""
_BOX = "CAST(b.x0 AS INT) AS x0, CAST(b.y0 AS INT) AS y0, CAST(b.x1 AS INT) AS x1, CAST(b.y1 AS INT) AS y1"


def _token_hits(patterns) -> str:
    parts = [
        f"SELECT doc_id, page_no, idx, text AS word, box AS b, {D.lit(p.label)} AS label, {D.lit(p.name)} AS pattern, "
        f"{p.priority} AS priority FROM tok WHERE regexp_full_match(text, {D.rx(p)}) AND box IS NOT NULL" for p in patterns]
    return (f"SELECT doc_id, page_no, idx, CAST(1 AS INT) AS n_tokens, word, {_BOX}, label, pattern, priority "
            f"FROM ({' UNION ALL '.join(parts)})")


def _window_ctes(patterns) -> str:
    hits = " UNION ALL ".join(
        f"SELECT doc_id, page_no, idx, n, jo, word, bs, {i} AS pno, {D.lit(p.label)} AS label, {D.lit(p.name)} AS pattern, "
        f"{p.priority} AS priority FROM cand WHERE regexp_full_match(word, {D.rx(p)})" for i, p in enumerate(patterns))
    return f"""runs AS (SELECT doc_id, page_no, idx, list(text) OVER w AS ts, list(box) OVER w AS bs FROM tok
  WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY idx ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)),
sized AS (SELECT *, unnest(range(2, len(ts) + 1)) AS n FROM runs WHERE len(ts) > 1),
cand AS (SELECT doc_id, page_no, idx, n, jo, CASE jo WHEN 0 THEN array_to_string(ts[1:n], '') WHEN 1 THEN array_to_string(ts[1:n], ' ') ELSE array_to_string(ts[1:n], '-') END AS word, list_filter(bs[1:n], lambda b: b IS NOT NULL) AS bs
  FROM sized, (VALUES (0), (1), (2)) j(jo)),
hits AS ({hits}),
firsts AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY doc_id, page_no, idx, n, pno ORDER BY jo) = 1),
merged AS (SELECT *, {D.valid_box(
        'list_min(list_transform(bs, lambda b: b.x0))', 'list_min(list_transform(bs, lambda b: b.y0))',
        'list_max(list_transform(bs, lambda b: b.x1))', 'list_max(list_transform(bs, lambda b: b.y1))', W, H)} AS b
  FROM firsts WHERE len(bs) > 0)"""


_WINDOW_ROWS = f"SELECT doc_id, page_no, idx, CAST(n AS INT) AS n_tokens, word, {_BOX}, label, pattern, priority FROM merged WHERE b IS NOT NULL"


@query("scan_tokens", f"WITH {NUMBERED} SELECT doc_id, page_no, pos, idx, text, conf FROM tok")
def scan_tokens(spark, folder):
    return numbered(spark, folder).select("doc_id", "page_no", "pos", "idx", "text", "conf")


@query("id_patterns", f"WITH {NUMBERED} {_token_hits(C.ID_PATTERNS)}")
def id_patterns(spark, folder):
    return ops.match_tokens(numbered(spark, folder), C.ID_PATTERNS).select(*OUT)


@query("health_patterns", f"WITH {NUMBERED}, {_window_ctes(C.HEALTH_PATTERNS)} {_token_hits(C.HEALTH_PATTERNS)} UNION ALL {_WINDOW_ROWS}")
def health_patterns(spark, folder):
    return ops.find_patterns(numbered(spark, folder), C.HEALTH_PATTERNS).select(*OUT)


@query("token_windows", f"WITH {NUMBERED}, {_window_ctes(C.ID_PATTERNS)} {_WINDOW_ROWS}")
def token_windows(spark, folder):
    return ops.match_windows(numbered(spark, folder), C.ID_PATTERNS).select(*OUT)


_DISABLED = """counts AS (SELECT coalesce(pattern, 'UNKNOWN') AS pattern, count(*) FILTER (user_feedback) AS tp,
  count(*) FILTER (NOT user_feedback) AS fp FROM v_feedback GROUP BY 1),
off AS (SELECT pattern FROM counts WHERE tp + fp >= 5 AND tp / (tp + fp) < 0.40)"""


@query("patterns_enabled", f"""WITH {NUMBERED}, {_DISABLED}
SELECT * FROM ({_token_hits(C.ID_PATTERNS)}) h WHERE pattern NOT IN (SELECT pattern FROM off)""")
def patterns_enabled(spark, folder):
    off = feedback_ops.disabled_patterns(view(spark, folder, "v_feedback"))
    found = ops.match_tokens(numbered(spark, folder), C.ID_PATTERNS).select(*OUT)
    return feedback_ops.drop_disabled(found, off)


_MRZ = "regexp_full_match(text, '[A-Z0-9<]{30,}')"


@query("mrz", f"""WITH {NUMBERED},
m AS (SELECT *, 'MRZ' AS pattern, 100 AS priority FROM tok WHERE {_MRZ} UNION ALL
  SELECT *, 'PASSPORT_MRZ', 120 FROM tok WHERE {_MRZ} AND length(text) > 25 AND contains(text, '<') AND {D.is_upper('text')})
SELECT doc_id, page_no, idx, CAST(1 AS INT) AS n_tokens, text AS word, {_BOX.replace('b.', 'box.')}, 'B-DOC' AS label, pattern, priority
FROM m WHERE box IS NOT NULL""")
def mrz(spark, folder):
    return ops.machine_readable(numbered(spark, folder)).select(*OUT)


@query("non_sensitive", f"SELECT doc_id, pos, {D.non_sensitive('text')} AS plain FROM v_tokens")
def non_sensitive(spark, folder):
    return tokens(spark, folder).select("doc_id", "pos", T.non_sensitive(F.col("text")).alias("plain"))


@query("canonical_label", "SELECT doc_id, pos, " + ", ".join(
    f"{D.canonical('text', v, T.LABEL_RULES, T.LABEL_DEFAULT)} AS {v}" for v in ("v0", "v1", "v3")) + " FROM v_tokens")
def canonical_label(spark, folder):
    return tokens(spark, folder).select("doc_id", "pos", *[
        T.canonical_label(F.col("text"), v).alias(v) for v in ("v0", "v1", "v3")])


@query("bbox_rescale", """SELECT doc_id, pos, CAST(round_even(left_x * 2.125, 0) AS INT) AS left_x, CAST(round_even(top * 2.125, 0) AS INT) AS top,
  CAST(round_even(width * 2.125, 0) AS INT) AS width, CAST(round_even(height * 2.125, 0) AS INT) AS height FROM v_tokens""")
def bbox_rescale(spark, folder):
    sides = ["left_x", "top", "width", "height"]
    return tokens(spark, folder).select("doc_id", "pos", *[F.bround(F.col(c) * 2.125).cast("int").alias(c) for c in sides])


def _any_field(text: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({text}, {D.rx(p)})" for p in C.FIELD_LABELS) + ")"


_LABELS = " UNION ALL ".join(
    f"SELECT doc_id, page_no, idx AS li, top AS line, greatest(15.0, height * 0.7) AS reach, {D.lit(p.label)} AS label, "
    f"{D.lit(p.name)} AS pattern, {p.priority} AS priority, {i} AS pno FROM tok WHERE length(text) >= 3 AND regexp_matches(text, {D.rx(p)})"
    for i, p in enumerate(C.FIELD_LABELS))


@query("field_values", f"""WITH {NUMBERED}, lab AS ({_LABELS}),
near AS (SELECT lab.*, t.idx - li AS step, t.text, t.left_x, t.top, t.width, t.height, abs(t.top - line) <= reach AS level,
  {D.non_sensitive('t.text')} AS plain, {_any_field('t.text')} AS stop, t.text IN {D.in_list(C.FIELD_SEPARATORS)} AS sep,
  regexp_matches(t.text, '^\\p{{Lu}}\\p{{L}}*$') AND length(t.text) >= 3 AS named
  FROM lab JOIN tok t ON t.doc_id = lab.doc_id AND t.page_no = lab.page_no AND t.idx BETWEEN li - 10 AND li + 14 AND t.idx <> li),
back AS (SELECT *, -step AS place FROM near WHERE step < 0 AND NOT sep AND level AND named AND NOT plain),
nback AS (SELECT doc_id, page_no, li, pno, count(*) AS nb FROM back GROUP BY ALL),
fwd AS (SELECT near.*, coalesce(nb, 0) AS nb,
  max(CASE WHEN stop OR NOT level THEN 1 ELSE 0 END) OVER (PARTITION BY near.doc_id, near.page_no, near.li, near.pno ORDER BY step) AS halted
  FROM near LEFT JOIN nback USING (doc_id, page_no, li, pno) WHERE step > 0 AND NOT sep),
cum AS (SELECT *, nb + sum(CASE WHEN plain THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page_no, li, pno ORDER BY step) AS held FROM fwd WHERE halted = 0),
full_ AS (SELECT *, max(CASE WHEN held >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_no, li, pno ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS done FROM cum),
vals AS (SELECT doc_id, page_no, li, pno, label, pattern, priority, place, text, left_x, top, width, height FROM back
  UNION ALL SELECT doc_id, page_no, li, pno, label, pattern, priority, 100 + step, text, left_x, top, width, height FROM full_ WHERE coalesce(done, 0) = 0 AND NOT plain),
g AS (SELECT doc_id, page_no, li AS idx, pno, label, pattern, priority, count(*) AS n, string_agg(text, ' ' ORDER BY place) AS word,
  min(left_x) AS x0, min(top) AS y0, max(left_x + width) AS x1, max(top + height) AS y1 FROM vals GROUP BY ALL),
m AS (SELECT *, {D.valid_box('x0', 'y0', 'x1', 'y1', W, H)} AS b FROM g WHERE length(trim(word)) >= 3)
SELECT doc_id, page_no, idx, CAST(n AS INT) AS n_tokens, word, {_BOX}, label, pattern, priority FROM m WHERE b IS NOT NULL""")
def field_values(spark, folder):
    return ops.field_values(numbered(spark, folder)).select(*OUT)


@query("name_context", f"""WITH {NUMBERED},
lab AS (SELECT * FROM tok WHERE lower(text) IN {D.in_list(C.NAME_LABEL_WORDS)})
SELECT doc_id, page_no, idx, CAST(1 AS INT) AS n_tokens, text AS word, {_BOX.replace('b.', 'box.')}, 'B-PER' AS label,
  'NAME_FIELD_CONTEXT' AS pattern, CAST(92 AS INT) AS priority
FROM tok t WHERE box IS NOT NULL AND length(text) >= 3 AND regexp_matches(text, '^\\p{{Lu}}')
  AND length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) >= length(text) * 0.7 AND NOT {D.non_sensitive('text')}
  AND lower(text) NOT IN {D.in_list(C.NAME_LABEL_EXCLUDED)}
  AND EXISTS (SELECT 1 FROM lab l WHERE l.doc_id = t.doc_id AND l.page_no = t.page_no AND abs(t.top - l.top) <= greatest(15.0, l.height * 0.7)
    AND (t.left_x > l.left_x + l.width OR t.left_x < l.left_x - 100))""")
def name_context(spark, folder):
    return ops.name_context(numbered(spark, folder)).select(*OUT)


@query("page_text", "SELECT doc_id, page_no, string_agg(text, ' ' ORDER BY pos) AS text FROM v_tokens GROUP BY doc_id, page_no")
def page_text(spark, folder):
    return ops.page_text(tokens(spark, folder))


_RESCUE_PATTERNS = [C.ID_PATTERNS_V0[0], C.ID_PATTERNS_V0[1]]


@query("rescue_ids", f"""WITH {NUMBERED},
pages_ AS (SELECT doc_id, page_no, string_agg(text, ' ' ORDER BY pos) AS text FROM v_tokens GROUP BY 1, 2),
raw AS (SELECT doc_id, page_no, unnest(regexp_extract_all(text, {D.rx(_RESCUE_PATTERNS[0])})) AS hit FROM pages_
  UNION ALL SELECT doc_id, page_no, unnest(regexp_extract_all(text, {D.rx(_RESCUE_PATTERNS[1])})) FROM pages_),
hits AS (SELECT DISTINCT doc_id, page_no, replace(hit, ' ', '') AS hit FROM raw),
found AS (SELECT doc_id, page_no, text AS word FROM tok
  WHERE regexp_full_match(text, '[A-Z]{3}[PCHFATBLJG][A-Z][0-9]{4}[A-Z]') AND box IS NOT NULL),
open_ AS (SELECT * FROM hits h WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.doc_id = h.doc_id AND f.page_no = h.page_no
  AND contains(replace(f.word, ' ', ''), h.hit)))
SELECT o.doc_id, o.page_no, t.idx, CAST(1 AS INT) AS n_tokens, o.hit AS word, t.left_x AS x0, t.top AS y0, t.left_x + t.width AS x1,
  t.top + t.height AS y1, 'B-DOC' AS label
FROM open_ o JOIN tok t ON t.doc_id = o.doc_id AND t.page_no = o.page_no AND replace(t.text, ' ', '') = o.hit
QUALIFY row_number() OVER (PARTITION BY o.doc_id, o.page_no, o.hit ORDER BY t.idx) = 1""")
def rescue_ids(spark, folder):
    toks = numbered(spark, folder)
    found = box_ops.valid_identifiers(ops.match_tokens(toks, C.ID_PATTERNS).where("pattern = 'PAN'"))
    return ops.rescue_ids(toks, found, _RESCUE_PATTERNS, [10, 12])


def _names_sql(variant: str) -> str:
    letters = "length(regexp_replace(text, '[^\\p{L}]', '', 'g')) >= length(text) * 0.7"
    if variant == "v3":
        joins = f"{D.is_upper('text')} AND regexp_matches(text, '^\\p{{L}}+$') AND text NOT IN {D.in_list(C.NAME_STOPWORDS)}"
        begins, reach, most, least, look = f"length(text) >= 3 AND top <= {H} * 0.75", "14.5", 4, 2, 4
        keep, points = "length(word) <= 40", "80"
    else:
        joins = (f"length(text) >= 2 AND regexp_matches(text, '^\\p{{Lu}}') AND {letters} AND NOT {D.non_sensitive('text')} "
                 f"AND lower(text) NOT IN {D.in_list(C.IGNORE_WORDS)}")
        begins, reach, most, least, look = "length(text) >= 3", "greatest(15.0, height * 0.7)", 6, 1, 5
        keep, points = f"NOT {D.non_sensitive('word')} AND length(word) >= 4", "CASE WHEN n >= 2 THEN 85 ELSE 82 END"
    near = [f"(coalesce(lead(fits, {k}) OVER o, false) AND abs(lead(top, {k}) OVER o - top) <= {reach})" for k in range(1, look + 1)]
    n = "1 + " + " + ".join(f"CASE WHEN {' AND '.join(near[:k])} THEN 1 ELSE 0 END" for k in range(1, look + 1))
    return f"""WITH RECURSIVE {NUMBERED},
f AS (SELECT *, ({joins}) AS fits FROM tok),
c AS (SELECT *, {n} AS n, fits AND {begins} AS starts FROM f WINDOW o AS (PARTITION BY doc_id, page_no ORDER BY idx)),
g AS (SELECT *, starts AND n BETWEEN {least} AND {most} AS named FROM c),
v AS (SELECT doc_id, page_no, idx, n, named FROM g WHERE idx = 0
  UNION ALL SELECT g.doc_id, g.page_no, g.idx, g.n, g.named FROM v JOIN g ON g.doc_id = v.doc_id AND g.page_no = v.page_no
    AND g.idx = v.idx + CASE WHEN v.named THEN v.n ELSE 1 END),
r AS (SELECT v.doc_id, v.page_no, v.idx, v.n, string_agg(t.text, ' ' ORDER BY t.idx) AS word, min(t.left_x) AS x0, min(t.top) AS y0,
  max(t.left_x + t.width) AS x1, max(t.top + t.height) AS y1 FROM v JOIN tok t ON t.doc_id = v.doc_id AND t.page_no = v.page_no
  AND t.idx >= v.idx AND t.idx < v.idx + v.n WHERE v.named GROUP BY v.doc_id, v.page_no, v.idx, v.n),
m AS (SELECT *, {D.valid_box('x0', 'y0', 'x1', 'y1', W, H)} AS b FROM r WHERE {keep})
SELECT doc_id, page_no, idx, CAST(n AS INT) AS n_tokens, word, {_BOX}, 'B-PER' AS label, 'CAPITALIZED_NAME' AS pattern, CAST({points} AS INT) AS priority
FROM m WHERE b IS NOT NULL"""


@query("upper_names", _names_sql("v3"))
def upper_names(spark, folder):
    return ops.upper_names(tokens(spark, folder)).select(*OUT)


@query("upper_names_v2", _names_sql("v2"))
def upper_names_v2(spark, folder):
    return ops.upper_names(tokens(spark, folder), variant="v2").select(*OUT)


def _line_sql(variant: str) -> str:
    fits = ("t.left_x - w.right_ <= greatest(20, CAST(trunc(CAST(0.2 AS DOUBLE) * t.width) AS INT))" if variant == "v0" else
            "t.left_x - w.right_ BETWEEN 0 AND greatest(15, CAST(trunc(CAST(0.15 AS DOUBLE) * t.width) AS INT)) AND w.n < 5")
    joins = f"(abs(t.top - w.htop) <= greatest(8, CAST(trunc(CAST(0.02 AS DOUBLE) * t.height) AS INT)) AND {fits})"
    return f"""WITH RECURSIVE t AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY top, left_x, pos) AS rk FROM v_tokens),
w AS (SELECT doc_id, page_no, rk, pos AS head, top AS htop, left_x + width AS right_, 1 AS n FROM t WHERE rk = 1
  UNION ALL SELECT t.doc_id, t.page_no, t.rk, CASE WHEN {joins} THEN w.head ELSE t.pos END, CASE WHEN {joins} THEN w.htop ELSE t.top END,
    t.left_x + t.width, CASE WHEN {joins} THEN w.n + 1 ELSE 1 END
  FROM w JOIN t ON t.doc_id = w.doc_id AND t.page_no = w.page_no AND t.rk = w.rk + 1)
SELECT doc_id, page_no, head AS pos, string_agg(t.text, ' ' ORDER BY rk) AS text, arg_min(t.left_x, rk) AS left_x, arg_min(t.top, rk) AS top,
  arg_max(t.left_x + t.width, rk) - arg_min(t.left_x, rk) AS width, arg_min(t.height, rk) AS height, CAST(count(*) AS INT) AS n_tokens
FROM w JOIN t USING (doc_id, page_no, rk) GROUP BY doc_id, page_no, head"""


@query("line_merge", _line_sql("v0"))
def line_merge(spark, folder):
    return ops.merge_lines(tokens(spark, folder))


@query("line_merge_v1", _line_sql("v1"))
def line_merge_v1(spark, folder):
    return ops.merge_lines(tokens(spark, folder), variant="v1")
