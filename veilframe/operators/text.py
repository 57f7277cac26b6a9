"""Text operators: detection, overlap resolution and redaction per document.

All of them are projections. Spans live in an array column beside their text,
so redaction needs neither an explode nor a shuffle.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe import catalogue as C
from veilframe.functions import text as T
from veilframe.functions.scan import bind, dealt, unfold


def detect(df: DataFrame, patterns: list[C.Pattern] | None = None, text: str = "text", e164: bool = False) -> DataFrame:
    """Add ``spans``: all matches of the catalogue, ordered, overlaps included."""
    patterns = list(C.TEXT_PATTERNS if patterns is None else patterns)
    if e164:
        patterns.append(C.PHONE_E164)
    return bind(df.drop("spans"), spans=T.find_spans(F.col(text), patterns))


def explode_spans(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per span."""
    return df.select(*keys, F.explode("spans").alias("s")).select(*keys, "s.start", "s.end", "s.original", "s.label")


def expand_titles(df: DataFrame, text: str = "text", start: str = "start", end: str = "end") -> DataFrame:
    """Pull a preceding title into entity spans given as offset columns."""
    moved = T.title_start(F.col(text), F.col(start)).cast("int")
    return df.withColumn(start, moved).withColumn(
        "original", F.substring(F.col(text), F.col(start) + 1, F.col(end) - F.col(start)))


def allow_entities(df: DataFrame, labels: list[str], column: str = "label") -> DataFrame:
    return df.where(F.col(column).isin(labels))


def with_entities(df: DataFrame, entities: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Add model entities (one row per span) to the pattern spans of each text.

    Entities come first among spans with the same bounds.
    """
    kept = allow_entities(entities, C.TEXT_ENTITY_LABELS)
    titled = expand_titles(kept.join(dealt(df.select(*keys, text)), keys), text)
    per_text = titled.groupBy(*keys).agg(F.collect_list(F.struct("start", "end", "original", "label")).alias("_ents"))
    joined = df.join(dealt(per_text), keys, "left")
    mixed = F.concat(F.coalesce("_ents", F.from_json(F.lit("[]"), f"array<{T.SPAN}>")), F.col("spans"))
    keyed = F.transform(mixed, lambda s, i: F.struct(
        s["start"].alias("start"), (s["start"] - s["end"]).alias("neg_len"), i.alias("ord"), s.alias("span")))
    ordered = F.transform(F.array_sort(keyed), lambda k: k["span"])
    return joined.withColumn("spans", ordered).drop("_ents")


def resolve(df: DataFrame, text: str = "text") -> DataFrame:
    """Spans joined where they overlap."""
    rest = [c for c in df.columns if c != "spans"]
    return bind(df, _kept=T.resolve_overlaps(F.col("spans"), F.col(text))).select(*rest, F.col("_kept").alias("spans"))


def replace(df: DataFrame, level: int, text: str = "text", key: str = "veil", out: str = "redacted") -> DataFrame:
    """Replace resolved spans: level 1 masks them, level 2 swaps in pseudonyms."""
    if level not in (1, 2):
        raise ValueError(f"redaction level must be 1 or 2, not {level!r}")
    if level == 1:
        return df.withColumn(out, T.splice(F.col(text), F.col("spans"), lambda span, i: F.lit(C.PLACEHOLDER)))
    return df.withColumn(out, T.let(T.last_labels(F.col("spans")), lambda labels: T.splice(
        F.col(text), F.col("spans"), lambda span, i: T.pseudonym(F.get(labels, i), span["original"], key))))


def redact(df: DataFrame, level: int, text: str = "text", key: str = "veil", out: str = "redacted") -> DataFrame:
    """Resolve the spans and replace them."""
    return replace(resolve(df, text), level, text, key, out)


def address_windows(df: DataFrame, keys: list[str], variant: str = "v0", text: str = "text") -> DataFrame:
    """Snippets around address keywords, one row per occurrence."""
    words = C.ADDRESS_KEYWORDS_V0 if variant == "v0" else C.ADDRESS_KEYWORDS_V1
    before, after = C.ADDRESS_CONTEXT[variant]
    low = bind(df, _low=F.lower(F.col(text)))
    return unfold(low, keys, T.keyword_hits(F.col(text), F.col("_low"), words, before, after), "h").select(
        *keys, F.col("h.at").alias("char_at"), F.col("h.keyword").alias("keyword"),
        F.col("h.snippet").alias("snippet"), F.lit("B-LOC").alias("label"))


def chunks(df: DataFrame, size: int = 5000, overlap: int = 500, text: str = "text") -> DataFrame:
    """The whole of each text in pieces for models with bounded input.

    Pieces repeat the last ``overlap`` characters of the one before, so that an
    entity of up to that length lies whole in one of them; ``start`` moves its
    offsets back. A text of up to ``size`` characters is one piece.
    """
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be shorter than a piece")
    step = size - overlap
    rest = [c for c in df.columns if c != text]
    numbers = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.length(text) - overlap) / step) - 1).cast("int"))
    pieces = T.let(T.blocks(F.col(text)), lambda parts: F.transform(numbers, lambda k: F.struct(
        k.alias("chunk_no"), (k * step).alias("start"), T.cut(parts, k * step, F.lit(size)).alias("chunk"))))
    return unfold(df.where(F.col(text).isNotNull()), rest, pieces)


def truncate(df: DataFrame, size: int = 5000, text: str = "text") -> DataFrame:
    """Texts cut behind ``size`` characters, as a model with bounded input sees them.

    ``cut`` tells how many characters are lost (null for a null text); ``chunks`` loses none.
    """
    return df.withColumns({text: F.substring(text, 1, size), "cut": F.when(F.col(text).isNotNull(), F.greatest(F.lit(0), F.length(text) - size))})


def label_counts(df: DataFrame) -> DataFrame:
    """Redactions per label over all texts."""
    kept = unfold(df, [], T.resolve_overlaps(F.col("spans")), "s")
    return kept.groupBy(F.col("s.label").alias("label")).agg(F.count("*").alias("n"))
