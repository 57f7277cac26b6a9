"""Registered queries over whole texts."""
from __future__ import annotations

from pyspark.sql import functions as F

from veilframe import catalogue as C
from veilframe.fixtures import view
from veilframe.functions import text as T
from veilframe.functions.scan import bind
from veilframe.operators import text as ops
from veilframe.plans import duck as D
from veilframe.plans.registry import query
from veilframe.sources import readers

KEYS = ["src", "id"]


@query("scan_documents", "SELECT doc_id, lang, source, text FROM documents")
def scan_documents(spark, folder):
    return view(spark, folder, "documents").select("doc_id", "lang", "source", "text")


@query("content_hash", "SELECT page_id, substr(md5(html), 1, 16) AS page_hash FROM pages")
def content_hash(spark, folder):
    return view(spark, folder, "pages").select("page_id", readers.content_hash("html").alias("page_hash"))


@query("ner_allow", f"SELECT audio_id, s, e, label FROM v_spans WHERE label IN {D.in_list(C.AUDIO_ENTITY_LABELS)}")
def ner_allow(spark, folder):
    return ops.allow_entities(view(spark, folder, "v_spans"), C.AUDIO_ENTITY_LABELS)


_TITLE_CASE = " ".join(
    f"WHEN p >= {len(t) + 1} AND substr(text, p - {len(t)}, {len(t) + 1}) = {D.lit(t + ' ')} THEN p - {len(t) + 1}"
    for t in C.TITLES)


@query("title_expand", f"""
WITH e AS (SELECT doc_id, text, instr(text, 'ASHA PATIL') - 1 AS p FROM v_notes),
m AS (SELECT doc_id, text, p + 10 AS fin, CASE {_TITLE_CASE} ELSE p END AS st FROM e)
SELECT doc_id, CAST(st AS INT) AS "start", CAST(fin AS INT) AS "end", substr(text, st + 1, fin - st) AS original FROM m""")
def title_expand(spark, folder):
    notes = view(spark, folder, "v_notes")
    at = F.instr("text", "ASHA PATIL") - 1
    spans = notes.select("doc_id", "text", at.alias("start"), (at + 10).alias("end"))
    return ops.expand_titles(spans).select("doc_id", "start", "end", "original")


@query("detect_text_spans", f"""WITH {D.spans(C.TEXT_PATTERNS)}
SELECT src, id, "start", "end", original, label FROM found""")
def detect_text_spans(spark, folder):
    return ops.explode_spans(ops.detect(view(spark, folder, "v_texts")), KEYS)


@query("detect_transcript_phone", f"""WITH {D.spans([C.TRANSCRIPT_PHONE])}
SELECT src, id, "start", "end", original, label FROM found""")
def detect_transcript_phone(spark, folder):
    return ops.explode_spans(ops.detect(view(spark, folder, "v_texts"), [C.TRANSCRIPT_PHONE]), KEYS)


_REGION = " ".join(f"WHEN regexp_matches(std, {D.rx(p)}) THEN {D.lit(p.name)}" for p in C.REGION_PATTERNS)


@query("classify_region", f"""
WITH std AS (SELECT src, id, {D.STD.format('text')} AS std FROM v_texts),
c AS (SELECT src, id, CASE {_REGION} END AS entity_type FROM std)
SELECT * FROM c WHERE entity_type IS NOT NULL""")
def classify_region(spark, folder):
    typed = view(spark, folder, "v_texts").select(*KEYS, T.region_class(F.col("text")).alias("entity_type"))
    return typed.where("entity_type IS NOT NULL")


def _versions(spans_v1: str, spans_v0: str) -> str:
    cols = 'src, id, "start", "end", original, label AS name, kind AS label'
    return (f"WITH {spans_v1}, {spans_v0} SELECT 'v1' AS catalogue, {cols} FROM found_v1 "
            f"UNION ALL SELECT 'v0' AS catalogue, {cols} FROM found_v0")


@query("id_patterns_v1", _versions(D.spans(C.ID_PATTERNS_V1, tag="_v1"), D.spans(C.ID_PATTERNS_V0, tag="_v0")))
def id_patterns_v1(spark, folder):
    texts = view(spark, folder, "v_texts")

    def one(name, patterns):
        labels = F.create_map(*[F.lit(x) for p in patterns for x in (p.name, p.label)])
        found = ops.explode_spans(ops.detect(texts, patterns), KEYS)
        return found.select(F.lit(name).alias("catalogue"), *KEYS, "start", "end", "original",
                            F.col("label").alias("name"), F.element_at(labels, F.col("label")).alias("label"))

    return one("v1", C.ID_PATTERNS_V1).unionByName(one("v0", C.ID_PATTERNS_V0))


@query("redact_text_l1", f"WITH {D.spans(C.TEXT_PATTERNS)}, {D.kept_spans()} {D.spliced(D.lit(C.PLACEHOLDER))}")
def redact_text_l1(spark, folder):
    done = ops.redact(ops.detect(view(spark, folder, "v_texts")), level=1)
    return done.select(*KEYS, "redacted", F.size("spans").alias("n_spans"))


@query("redact_text_l2", f"""WITH {D.spans(C.TEXT_PATTERNS)}, {D.kept_spans()}
{D.spliced(D.pseudonym('last_label', 'original', 'veil'))}""")
def redact_text_l2(spark, folder):
    done = ops.redact(ops.detect(view(spark, folder, "v_texts")), level=2)
    return done.select(*KEYS, "redacted", F.size("spans").alias("n_spans"))


# Entities of a stand-in model: capital letters of the notes, so that they cut
# into pattern spans on either side.
_ENTITIES = r"[A-Z]{2,}[A-Z0-9 ]{3,9}"
_ENTITY_SQL = f"""{D.spans(C.TEXT_PATTERNS)},
ep AS (SELECT src, id, text, unnest(range(1, len(ps) + 1)) AS i, unnest(ps) AS piece FROM (SELECT src, id, text,
  string_split(regexp_replace(std, {D.lit('(' + _ENTITIES + ')')}, chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS ps FROM std)),
eo AS (SELECT *, CAST(coalesce(sum(length(piece)) OVER (PARTITION BY src, id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS s FROM ep),
every_ AS (SELECT src, id, text, ord, label, "start", "end" FROM found
  UNION ALL SELECT src, id, text, -1, CASE WHEN p % 2 = 0 THEN 'PERSON' ELSE 'ORG' END, CAST(CASE {_TITLE_CASE} ELSE p END AS INT), CAST(p + length(piece) AS INT)
  FROM (SELECT *, s AS p FROM eo) WHERE i % 2 = 0)"""


@query("redact_text_entities", f"""WITH {_ENTITY_SQL}, {D.kept_spans(found='every_')},
one AS ({D.spliced(D.lit(C.PLACEHOLDER))}), two AS ({D.spliced(D.pseudonym('last_label', 'original', 'veil'))})
SELECT src, id, one.redacted AS masked, two.redacted AS swapped, n_spans FROM one JOIN two USING (src, id, n_spans)""")
def redact_text_entities(spark, folder):
    texts = bind(view(spark, folder, "v_texts"), _found=T.find_spans(F.col("text"), [C.Pattern("ENTITY", _ENTITIES)]))
    entities = texts.select(*KEYS, F.explode("_found").alias("s")).select(
        *KEYS, "s.start", "s.end", F.when(F.col("s.start") % 2 == 0, "PERSON").otherwise("ORG").alias("label"))
    mixed = ops.with_entities(ops.detect(texts.drop("_found")), entities, KEYS)
    both = ops.replace(ops.replace(ops.resolve(mixed), level=1, out="masked"), level=2, out="swapped")
    return both.select(*KEYS, "masked", "swapped", F.size("spans").alias("n_spans"))


_WORDS_OF_TEXTS = """words AS (SELECT src, id, unnest(range(len(string_split(text, ' ')))) AS pos,
  unnest(string_split(text, ' ')) AS word FROM v_texts)"""


def _text_words(spark, folder):
    return view(spark, folder, "v_texts").select(*KEYS, F.posexplode(F.split("text", " ")).alias("pos", "word"))


@query("token_surrogate", f"""WITH {_WORDS_OF_TEXTS}
SELECT src, id, CAST(pos AS INT) AS pos, {D.surrogate('word')} AS stand_in FROM words""")
def token_surrogate(spark, folder):
    return _text_words(spark, folder).select(*KEYS, "pos", T.surrogate(F.col("word")).alias("stand_in"))


@query("char_tests", f"""WITH {_WORDS_OF_TEXTS}
SELECT src, id, CAST(pos AS INT) AS pos, {D.is_upper('word')} AS is_upper, regexp_matches(word, '^\\p{{L}}+$') AS is_alpha,
  regexp_matches(word, '\\p{{Nd}}') AS has_digit, {D.is_title('word')} AS is_title,
  length(regexp_replace(word, '[^\\p{{L}}]', '', 'g')) >= length(word) * 0.7 AS mostly_letters FROM words""")
def char_tests(spark, folder):
    word = F.col("word")
    return _text_words(spark, folder).select(
        *KEYS, "pos", T.is_upper(word).alias("is_upper"), T.is_alpha(word).alias("is_alpha"),
        T.has_digit(word).alias("has_digit"), T.is_title(word).alias("is_title"),
        T.mostly_letters(word).alias("mostly_letters"))


def _hash_tag_sql() -> str:
    ctes, last = [f"h0 AS (SELECT src, id, text AS t FROM v_texts)"], "h0"
    for i, p in enumerate(C.HASH_TAG_PATTERNS, 1):
        std = D.STD.format("t")
        ctes.append(f"""s{i} AS (SELECT src, id, t, string_split(regexp_replace({std}, {D.lit('(' + p.regex + ')')}, chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS ps FROM {last}),
p{i} AS (SELECT src, id, t, unnest(range(1, len(ps) + 1)) AS i, unnest(ps) AS piece FROM s{i}),
o{i} AS (SELECT *, CAST(coalesce(sum(length(piece)) OVER (PARTITION BY src, id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS s FROM p{i}),
h{i} AS (SELECT src, id, string_agg(CASE WHEN i % 2 = 0 THEN '[REDACTED_' || substr(md5(substr(t, s + 1, length(piece))), 1, 8) || ']'
  ELSE substr(t, s + 1, length(piece)) END, '' ORDER BY i) AS t FROM o{i} GROUP BY src, id)""")
        last = f"h{i}"
    return f"WITH {', '.join(ctes)} SELECT src, id, t AS tagged FROM {last}"


@query("hash_tag", _hash_tag_sql())
def hash_tag(spark, folder):
    return view(spark, folder, "v_texts").select(*KEYS, T.hash_tags(F.col("text")).alias("tagged"))


def _address_sql() -> str:
    parts = []
    for variant, words in (("v0", C.ADDRESS_KEYWORDS_V0), ("v1", C.ADDRESS_KEYWORDS_V1)):
        before, after = C.ADDRESS_CONTEXT[variant]
        parts.append(f"""SELECT {D.lit(variant)} AS catalogue, src, id, kw AS keyword, CAST(p AS INT) AS char_at,
  substr(text, greatest(0, p - {before}) + 1, least(length(text), p + length(kw) + {after}) - greatest(0, p - {before})) AS snippet, 'B-LOC' AS label
FROM (SELECT src, id, text, kw, CAST(sum(length(gap)) OVER w + (i - 1) * length(kw) AS INT) AS p, i, n
  FROM (SELECT src, id, text, kw, len(gaps) AS n, unnest(range(1, len(gaps) + 1)) AS i, unnest(gaps) AS gap
    FROM (SELECT src, id, text, kw, string_split(lower(text), kw) AS gaps FROM v_texts, (SELECT unnest({D.array(words)}) AS kw) k
          WHERE contains(lower(text), kw)))
  WINDOW w AS (PARTITION BY src, id, kw ORDER BY i ROWS UNBOUNDED PRECEDING)) WHERE i < n""")
    return "\nUNION ALL\n".join(parts)


@query("address_windows", _address_sql())
def address_windows(spark, folder):
    texts = view(spark, folder, "v_texts")
    v0, v1 = (ops.address_windows(texts, KEYS, v).withColumn("catalogue", F.lit(v)) for v in ("v0", "v1"))
    return v0.unionByName(v1)


_CODES = "MAP {" + ", ".join(f"{D.lit(k)}: {D.lit(v)}" for k, v in C.LANGUAGE_CODES.items()) + "}"


@query("lang_norm", f"""
SELECT doc_id, coalesce({_CODES}[lang], lang) AS one, coalesce({_CODES}[lang], lang) || '+hin' AS two, 'eng' AS none FROM documents""")
def lang_norm(spark, folder):
    lang = F.col("lang")
    return view(spark, folder, "documents").select(
        "doc_id", T.language_codes(lang).alias("one"),
        T.language_codes(F.concat(F.upper(lang), F.lit("+ Hi "))).alias("two"),
        T.language_codes(F.concat(F.lit(" + "), F.substring(lang, 3, 9))).alias("none"))


@query("model_chunks", """
SELECT src, id, CAST(k AS INT) AS chunk_no, CAST(k * 4500 AS INT) AS start, substr(text, CAST(k * 4500 + 1 AS BIGINT), 5000) AS chunk
FROM (SELECT src, id, text, unnest(range(0, greatest(1, CAST(ceil((length(text) - 500) / 4500.0) AS BIGINT)))) AS k FROM v_texts)""")
def model_chunks(spark, folder):
    return ops.chunks(view(spark, folder, "v_texts"))


@query("truncate_text", "SELECT src, id, substr(text, 1, 5000) AS text, CAST(greatest(0, length(text) - 5000) AS INT) AS cut FROM v_texts WHERE text IS NOT NULL")
def truncate_text(spark, folder):
    return ops.truncate(view(spark, folder, "v_texts").where("text IS NOT NULL"))


@query("verhoeff", f"""
WITH n AS (SELECT c_custkey, lpad(CAST((c_custkey * 7919007) % 1000000000000 AS VARCHAR), 12, '0') AS number FROM customer)
SELECT c_custkey, number, list_reduce(list_prepend(0, range(0, 12)), lambda c, i:
  ({D.array(C.verhoeff_tables()[0])})[CAST(c * 10 + ({D.array(C.verhoeff_tables()[1])})[CAST((i % 8) * 10 + CAST(substr(number, CAST(12 - i AS INT), 1) AS INT) + 1 AS INT)] + 1 AS INT)]) = 0 AS ok FROM n""")
def verhoeff(spark, folder):
    number = F.lpad(((F.col("c_custkey") * 7919007) % 1000000000000).cast("string"), 12, "0")
    return view(spark, folder, "customer").select("c_custkey", number.alias("number")).withColumn(
        "ok", T.verhoeff_ok(F.concat_ws(" ", F.substring("number", 1, 4), F.substring("number", 5, 4), F.substring("number", 9, 4))))


@query("pan_valid", r"""
WITH n AS (SELECT doc_id, regexp_extract(text, 'PAN ([A-Z0-9]+)', 1) AS pan FROM v_notes)
SELECT doc_id, pan, regexp_full_match(upper(pan), '[A-Z]{3}[PCHFATBLJG][A-Z][0-9]{4}[A-Z]') AS ok FROM n""")
def pan_valid(spark, folder):
    return view(spark, folder, "v_notes").select(
        "doc_id", F.regexp_extract("text", "PAN ([A-Z0-9]+)", 1).alias("pan")).withColumn(
        "ok", T.pan_ok(F.concat(F.lit(" "), F.lower("pan"), F.lit(" "))))


@query("props_json", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
  concat('{"event_id":', event_id, ',"k":', json_extract_string(props, '$.k'), '}') AS encoded FROM events""")
def props_json(spark, folder):
    parsed = view(spark, folder, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))
    return parsed.withColumn("encoded", F.to_json(F.struct("event_id", "k")))
