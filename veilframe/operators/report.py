"""Page risk and redaction reports."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAGE = ["doc_id", "page_no"]


def _kinds(dets: DataFrame) -> DataFrame:
    return dets.withColumn("kind", F.coalesce("pattern", "label", F.lit("UNKNOWN")))


def page_risk(dets: DataFrame) -> DataFrame:
    return dets.groupBy(*PAGE).agg(F.sum("priority").alias("risk"))


def top_pages(dets: DataFrame, n: int) -> DataFrame:
    """The riskiest pages; each task keeps only n rows for the final order."""
    return page_risk(dets).orderBy(F.desc("risk"), *PAGE).limit(n)


def overall(dets: DataFrame) -> DataFrame:
    """Redactions by kind over everything, most frequent first."""
    return _kinds(dets).groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind")


def breakdown(dets: DataFrame) -> DataFrame:
    """Counts per page and kind with page and document totals in one pass."""
    sets = [["doc_id", "page_no", "kind"], ["doc_id", "page_no"], ["doc_id"]]
    return _kinds(dets).groupingSets(sets, "doc_id", "page_no", "kind").agg(F.count("*").alias("n"))


def first_words(dets: DataFrame, n: int = 3, width: int = 30) -> DataFrame:
    """The first words per page and kind as an array and how many more there are."""
    named = _kinds(dets).select(*PAGE, "kind", "det_no", F.substring(F.coalesce("word", F.lit("")), 1, width).alias("word"))
    order = Window.partitionBy(*PAGE, "kind").orderBy("det_no")
    first = named.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= n)
    shown = first.groupBy(*PAGE, "kind").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rn", "word"))), lambda r: r["word"]).alias("words"))
    counts = named.groupBy(*PAGE, "kind").agg(F.count("*").alias("n"))
    return shown.join(counts, PAGE + ["kind"]).select(*PAGE, "kind", "words", F.greatest(F.lit(0).cast("bigint"), F.col("n") - n).alias("more"))


def preview(dets: DataFrame, n: int = 3, width: int = 30) -> DataFrame:
    """The first words per page and kind in one string, and how many more there are."""
    return first_words(dets, n, width).withColumn("words", F.array_join("words", " | "))


# --- fixed values: the lines of the text report -----------------------------
RULE, THIN_RULE = "=" * 70, "-" * 70
HEADER = [RULE, "REDACTION SUMMARY REPORT", RULE]
OVERALL = ["", "OVERALL STATISTICS", THIN_RULE]
BY_PAGE = ["", "PER-PAGE BREAKDOWN", THIN_RULE]


def lines(dets: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """The text report of each document, one row per line, ordered by ``line``.

    ``pages`` gives each document's number of pages, so that documents and
    pages without a detection are reported too; without it a document ends
    with its last detection. The time of making the report is left out.
    """
    def line(df: DataFrame, text, *order) -> DataFrame:
        keys = F.array(*[o.cast("string") for o in order])
        return df.select("doc_id", keys.alias("line"), text.alias("text"))

    def fixed(section: str, *texts) -> DataFrame:
        found = F.posexplode(F.array(*[F.lit(t) if isinstance(t, str) else t for t in texts])).alias("k", "text")
        return line(docs.select("doc_id", found), F.col("text"), F.lit(section), F.col("k"))

    if pages is None:
        pages = dets.groupBy("doc_id").agg(F.max("page_no").alias("pages"))
    counted = breakdown(dets)
    totals = counted.where("page_no IS NULL").select("doc_id", "n")
    docs = pages.join(totals, "doc_id", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
    each = pages.where("pages > 0").select("doc_id", F.explode(F.sequence(F.lit(1), "pages")).alias("page_no"))
    page = F.lpad(F.col("page_no").cast("string"), 9, "0")
    by_page = each.join(counted.where("page_no IS NOT NULL AND kind IS NULL").select(*PAGE, "n"), PAGE, "left").withColumn(
        "n", F.coalesce("n", F.lit(0).cast("bigint")))
    kinds = _kinds(dets).groupBy("doc_id", "kind").agg(F.count("*").alias("n"))
    rank = F.lpad((F.lit(10**12) - F.col("n")).cast("string"), 13, "0")
    shown = first_words(dets)
    words = shown.select("doc_id", "page_no", "kind", "more", F.posexplode("words").alias("k", "word"))
    return (
        fixed("0", *HEADER, F.format_string("Total Pages: %d", "pages"), *OVERALL, F.format_string("Total Redactions: %d", "n"), "", "Redactions by Type:")
        .unionByName(line(kinds, F.format_string("  %-20s: %3d", "kind", "n"), F.lit("1"), rank, F.col("kind")))
        .unionByName(fixed("2", *BY_PAGE))
        .unionByName(line(by_page, F.lit(""), F.lit("3"), page))
        .unionByName(line(by_page, F.format_string("Page %d: %d redactions", "page_no", "n"), F.lit("3"), page, F.lit("")))
        .unionByName(line(shown, F.format_string("  %s:", "kind"), F.lit("3"), page, F.col("kind")))
        .unionByName(line(words, F.format_string("    - %s", "word"), F.lit("3"), page, F.col("kind"), F.col("k")))
        .unionByName(line(shown.where("more > 0"), F.format_string("    ... and %d more", "more"), F.lit("3"), page, F.col("kind"), F.lit("9"))))


def hourly_rate(events: DataFrame, kind: str = "event_type", ts: str = "ts") -> DataFrame:
    """Counts per kind and hour; the same plan serves a stream with a watermark."""
    return events.groupBy(F.window(ts, "1 hour").alias("w"), kind).agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("hour"), kind, "n")
