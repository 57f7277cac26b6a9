"""Pieces of check SQL. They restate the rules in plain DuckDB terms."""
from __future__ import annotations

from veilframe import catalogue as C

# DuckDB's \w and \b know ASCII only. Every character beyond ASCII in the given
# texts is a letter, so "_" (a word character no class of letters or digits
# contains) stands in for it without moving any offset.
STD = r"regexp_replace({0}, '[^\x00-\x7F]', '_', 'g')"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def array(values) -> str:
    return "[" + ", ".join(lit(v) if isinstance(v, str) else str(v) for v in values) + "]"


def rx(pattern: C.Pattern) -> str:
    return lit(("(?i)" if pattern.ignore_case else "") + pattern.regex)


def spans(patterns: list[C.Pattern], source: str = "v_texts", keys: str = "src, id", tag: str = "") -> str:
    """CTEs ending in ``found``: one row per match with offsets."""
    parts = []
    for i, p in enumerate(patterns):
        flags = "(?i)" if p.ignore_case else ""
        marked = f"regexp_replace(std, {lit(flags + '(' + p.regex + ')')}, chr(1) || '\\1' || chr(1), 'g')"
        parts.append(f"""
  SELECT {keys}, text, {i} AS ord, {lit(p.name)} AS label, {lit(p.label)} AS kind, i, piece,
    CAST(coalesce(sum(length(piece)) OVER (PARTITION BY {keys} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS s
  FROM (SELECT {keys}, text, unnest(range(1, len(ps) + 1)) AS i, unnest(ps) AS piece
        FROM (SELECT {keys}, text, string_split({marked}, chr(1)) AS ps FROM std{tag} WHERE regexp_matches(std, {rx(p)})))""")
    union = "\nUNION ALL\n".join(parts)
    return f"""std{tag} AS (SELECT {keys}, text, {STD.format('text')} AS std FROM {source}),
found{tag} AS (SELECT {keys}, text, ord, label, kind, s AS "start", CAST(s + length(piece) AS INT) AS "end",
  substr(text, s + 1, length(piece)) AS original FROM ({union}) WHERE i % 2 = 0)"""


def kept_spans(keys: str = "src, id", found: str = "found") -> str:
    """CTEs ending in ``kept``: the ranges that overlapping spans cover, in order."""
    return f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY "start", "end" DESC, ord) AS rk FROM {found} WHERE "end" > "start"),
reach AS (SELECT *, max("end") OVER (PARTITION BY {keys} ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM ranked),
cover AS (SELECT *, sum(CASE WHEN reached IS NULL OR "start" >= reached THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY rk ROWS UNBOUNDED PRECEDING) AS grp FROM reach),
ranges AS (SELECT {keys}, grp, min(rk) AS rk, arg_min(label, rk) AS label, any_value(text) AS text, min("start") AS "start", max("end") AS "end" FROM cover GROUP BY {keys}, grp),
kept AS (SELECT *, substr(text, "start" + 1, "end" - "start") AS original FROM ranges)"""


def spliced(replacement: str, keys: str = "src, id", source: str = "v_texts") -> str:
    """Final SELECT: texts with ``replacement`` put over the kept spans."""
    on = " AND ".join(f"t.{k.strip()} = g.{k.strip()}" for k in keys.split(","))
    tk = ", ".join(f"t.{k.strip()}" for k in keys.split(","))
    return f"""SELECT {tk}, CASE WHEN g.body IS NULL THEN t.text ELSE g.body || substr(t.text, g.last_end + 1) END AS redacted,
  CAST(coalesce(g.n, 0) AS INT) AS n_spans
FROM {source} t LEFT JOIN (
  SELECT {keys}, string_agg(piece, '' ORDER BY rk) AS body, max("end") AS last_end, count(*) AS n
  FROM (SELECT *, substr(text, prev + 1, "start" - prev) || ({replacement}) AS piece
        FROM (SELECT *, coalesce(lag("end") OVER (PARTITION BY {keys} ORDER BY rk), 0) AS prev,
                last_value(label) OVER (PARTITION BY {keys}, original ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_label
              FROM kept))
  GROUP BY {keys}) g ON {on}"""


def hash_number(seed: str) -> str:
    return f"CAST('0x' || substr(md5({seed}), 1, 8) AS BIGINT)"


def pick(options: list[str], seed: str) -> str:
    return f"({array(options)})[CAST({hash_number(seed)} % {len(options)} AS INT) + 1]"


def pseudonym(label: str, original: str, key: str) -> str:
    def seed(part: str) -> str:
        return f"{lit(key + '|' + part + '|')} || {original}"

    def digits(part: str, low: int, span: int, width: int) -> str:
        return f"lpad(CAST({hash_number(seed(part))} % {span} + {low} AS VARCHAR), {width}, '0')"

    first, last = pick(C.FIRST_NAMES, seed("first")), pick(C.LAST_NAMES, seed("last"))
    made = {
        "name": f"{first} || ' ' || {last}",
        "city": pick(C.CITIES, seed("city")),
        "date": f"{digits('year', 1970, 50, 4)} || '-' || {digits('month', 1, 12, 2)} || '-' || {digits('day', 1, 28, 2)}",
        "company": pick(C.COMPANIES, seed("company")),
        "email": f"lower({first}) || '.' || lower({last}) || '@example.org'",
        "phone": f"'555-' || {digits('exchange', 0, 1000, 3)} || '-' || {digits('line', 0, 10000, 4)}",
    }
    whens = " ".join(
        f"WHEN {label} IN {in_list([k for k, v in C.PSEUDONYM_KINDS.items() if v == kind])} THEN {value}"
        for kind, value in made.items())
    return f"CASE {whens} ELSE {lit(C.PLACEHOLDER)} END"


def canonical(label: str, variant: str, rules: dict, default: dict) -> str:
    up = f"upper({label})"
    whens = " ".join(
        f"WHEN {' OR '.join(f'contains({up}, {lit(m)})' for m in marks)} THEN {lit(target)}"
        for target, marks in rules[variant])
    return f"CASE WHEN {up} IN ('O', '0') THEN 'O' {whens} ELSE {lit(default[variant])} END"


def strip(text: str) -> str:
    return f"regexp_replace({text}, '^\\s+|\\s+$', '', 'g')"


def non_sensitive(text: str) -> str:
    low = strip(f"lower({text})")
    phrases = " OR ".join(f"contains({low}, {lit(p)})" for p in C.NON_SENSITIVE_PHRASES)
    return f"(length({low}) < 2 OR {low} IN {in_list(C.IGNORE_WORDS)} OR {phrases})"


def is_upper(text: str) -> str:
    return f"(regexp_matches({text}, '\\p{{Lu}}') AND NOT regexp_matches({text}, '[\\p{{Ll}}\\p{{Lt}}]'))"


def is_title(text: str) -> str:
    return (f"(regexp_matches({text}, '[\\p{{Lu}}\\p{{Lt}}]') AND NOT regexp_matches({text}, "
            f"'(^|[^\\p{{L}}])\\p{{Ll}}|[\\p{{Lu}}\\p{{Lt}}\\p{{Ll}}][\\p{{Lu}}\\p{{Lt}}]'))")


def surrogate(token: str, salt: str = "anon_salt") -> str:
    seed = f"{lit(salt + '|')} || {token}"
    name = pick(C.FIRST_NAMES, seed)
    word = pick(C.FILLER_WORDS, seed)
    return (
        f"CASE WHEN {token} IS NULL THEN '' WHEN NOT regexp_matches({token}, '[\\p{{L}}\\p{{N}}]') THEN {token} "
        f"WHEN regexp_matches({token}, '\\p{{Nd}}') THEN regexp_replace({token}, '\\p{{Nd}}', '#', 'g') "
        f"WHEN length({token}) <= 12 AND regexp_matches({token}, '^\\p{{L}}+$') THEN "
        f"CASE WHEN {is_title(token)} THEN {name} WHEN {is_upper(token)} THEN upper({name}) ELSE lower({name}) END "
        f"ELSE substr({word}, 1, greatest(3, least(12, length({token})))) END")


def valid_box(x0: str, y0: str, x1: str, y1: str, w: str, h: str) -> str:
    """CASE giving a struct of the corrected box, or NULL."""
    a = f"greatest(0, least(least({x0}, {x1}), {w} - 1))"
    b = f"greatest(0, least(least({y0}, {y1}), {h} - 1))"
    c = f"greatest(0, least(greatest({x0}, {x1}), {w}))"
    d = f"greatest(0, least(greatest({y0}, {y1}), {h}))"
    wide, high = f"({c} - {a})", f"({d} - {b})"
    return (
        f"CASE WHEN {wide} >= {C.BOX_MIN_SIDE} AND {high} >= {C.BOX_MIN_SIDE} AND {wide} <= {C.BOX_MAX_WIDTH} "
        f"AND {high} <= {C.BOX_MAX_HEIGHT} AND {wide} * {high} <= {C.BOX_MAX_AREA} "
        f"AND greatest({wide}, {high}) <= {C.BOX_MAX_ASPECT} * least({wide}, {high}) "
        f"THEN {{'x0': {a}, 'y0': {b}, 'x1': {c}, 'y1': {d}}} END")
