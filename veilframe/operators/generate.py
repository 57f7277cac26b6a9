"""Generated identifiers and labelled sentences, and training examples.

Values come from a keyed hash of a row number, so any number of rows is made
in parallel and comes out the same every time.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe import catalogue as C
from veilframe.functions import text as T
from veilframe.functions.scan import SEGMENT, exclusive_scan


def _hex(key: str, kind: str) -> Column:
    return F.md5(F.concat(F.lit(f"{key}|{kind}|"), F.col("i").cast("string")).cast("binary"))


def _byte(digest: Column, j: int) -> Column:
    return F.conv(F.substring(digest, 2 * j + 1, 2), 16, 10).cast("int")


def _letters(digest: Column, at: range) -> list[Column]:
    return [F.char((_byte(digest, j) % 26 + 65).cast("bigint")) for j in at]


def _digits(digest: Column, at: range) -> list[Column]:
    return [(_byte(digest, j) % 10).cast("string") for j in at]


def identifiers(rows: DataFrame, key: str = "veil") -> DataFrame:
    """PAN, Aadhaar (six in ten with blanks), passport number and birth date per ``i``."""
    pan, num = _hex(key, "pan"), _hex(key, "aadhaar")
    pas, dob = _hex(key, "passport"), _hex(key, "dob")
    plain = F.concat(*_digits(num, range(12)))
    spaced = F.concat_ws(" ", *[F.concat(*_digits(num, range(k, k + 4))) for k in (0, 4, 8)])
    return rows.select(
        "i", F.concat(*_letters(pan, range(5)), *_digits(pan, range(5, 9)), *_letters(pan, range(9, 10))).alias("pan"),
        F.when(_byte(num, 12) % 10 < 6, spaced).otherwise(plain).alias("aadhaar"),
        F.concat(*_letters(pas, range(1)), *_digits(pas, range(1, 8))).alias("passport"),
        F.concat_ws("/", F.lpad((_byte(dob, 0) % 28 + 1).cast("string"), 2, "0"), F.lpad((_byte(dob, 1) % 12 + 1).cast("string"), 2, "0"),
                    (_byte(dob, 2) % 41 + 1970).cast("string")).alias("dob"))


def _filled(templates: list[str], seed: Column, value: Column) -> Column:
    chosen = T.pick(templates, seed)
    return F.concat(F.substring_index(chosen, "{}", 1), value, F.substring_index(chosen, "{}", -1))


def id_sentences(rows: DataFrame, key: str = "veil") -> DataFrame:
    """One PAN and one Aadhaar sentence per ``i``, words labelled."""
    made = identifiers(rows, key)

    def sentences(kind: str, templates: list[str], value: Column) -> DataFrame:
        seed = F.concat(F.lit(f"{key}|{kind}-template|"), F.col("i").cast("string"))
        text = made.select("i", F.lit(kind).alias("kind"), _filled(templates, seed, value).alias("text"), value.alias("value"))
        words = text.withColumn("words", F.split("text", " "))
        hit = lambda w: (w == F.col("value")) if kind == "pan" else w.contains(F.replace(F.col("value"), F.lit(" "), F.lit("")))
        return words.select("i", "kind", "text", "words", F.transform("words", lambda w: F.when(hit(w), "B-DOC").otherwise("O")).alias("labels"))

    return sentences("pan", C.PAN_TEMPLATES, F.col("pan")).unionByName(sentences("aadhaar", C.AADHAAR_TEMPLATES, F.col("aadhaar")))


def word_label(word: Column, names: Column) -> Column:
    """Label of a word in a generated sentence, by form or as one of ``names``."""
    bare = F.regexp_replace(word, r"\A[,:-]+|[,:-]+\z", "")
    return (
        F.when(F.array_contains(names, bare) & (bare != ""), "B-PER").when(bare.rlike(r"\A[0-9]{2}/[0-9]{2}/[0-9]{4}\z"), "B-DATE")
        .when(bare.rlike(r"\A[A-Z][0-9]{7}\z"), "B-DOC").when(bare.rlike(r"\A[0-9]{6}\z"), "B-LOC").otherwise("O"))


def sentences(rows: DataFrame, n: int | None = None, key: str = "veil") -> DataFrame:
    """Person sentences, then a quarter as many PAN and Aadhaar sentences each.

    ``place`` orders the rows as a list would: all of one kind, then the next.
    """
    def seed(part: str) -> Column:
        return F.concat(F.lit(f"{key}|{part}|"), F.col("i").cast("string"))

    made = identifiers(rows, key)
    first, middle = T.pick(C.FIRST_NAMES, seed("first")), T.pick(C.FIRST_NAMES, seed("middle"))
    named = made.select("i", "dob", "passport", first.alias("first"), T.pick(C.LAST_NAMES, seed("last")).alias("last"),
                        F.when(T.hash_number(seed("has-middle")) % 10 < 4, middle).otherwise("").alias("middle"),
                        T.pick(C.CITIES, seed("city")).alias("city"), T.pick(C.SYNTHETIC_PINCODES, seed("pin")).alias("pin"),
                        (T.hash_number(seed("house")) % 300 + 1).cast("string").alias("house"))
    name = F.concat_ws(" ", "first", F.when(F.col("middle") != "", F.col("middle")), "last")
    text = F.concat(F.lit("Name: "), name, F.lit(" DOB: "), F.col("dob"), F.lit(" Passport: "), F.col("passport"), F.lit(" Address: "),
                    F.col("house"), F.lit(f" {C.SYNTHETIC_STREET}, "), F.col("city"), F.lit(f", {C.SYNTHETIC_REGION} "), F.col("pin"))
    people = named.select("i", F.lit("person").alias("kind"), text.alias("text"), F.array("first", "middle", "last").alias("names"))
    people = people.withColumn("words", F.split("text", " "))
    people = people.select("i", "kind", "text", "words", F.transform("words", lambda w: word_label(w, F.col("names"))).alias("labels"))
    extra = id_sentences(rows.where(F.col("i") % 4 == 0), key)
    group = F.when(F.col("kind") == "person", 0).when(F.col("kind") == "pan", 1).otherwise(2)
    return people.unionByName(extra).withColumn("grp", group)


def capped(
    synthetic: DataFrame, real: DataFrame, least: int = C.SYNTHETIC_MIN, ratio: int = C.SYNTHETIC_RATIO,
) -> DataFrame:
    """The first synthetic rows, at most ``ratio`` per real example but ``least`` at least.

    The list places persons first, then PAN and Aadhaar rows, each by number. A
    row's place is its rank in its group, counted over segments of numbers, plus
    the groups before. Only counts come to the driver.
    """
    sizes = synthetic.agg(F.count("*").alias("n"), F.count_if(F.col("grp") == 0).alias("n0"), F.count_if(F.col("grp") == 1).alias("n1")).first()
    cap = max(least, min(sizes.n, ratio * max(1, real.count())))
    ranked = exclusive_scan(synthetic, ["grp"], F.floor(F.col("i") / SEGMENT), ["i"], {"place": ("sum", F.lit(1).cast("bigint"))})
    before = F.when(F.col("grp") == 0, 0).when(F.col("grp") == 1, sizes.n0).otherwise(sizes.n0 + sizes.n1)
    return ranked.withColumn("place", F.col("place") + before).where(F.col("place") < cap)


def training_set(real: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Real examples and capped synthetic ones that carry a label, the latter
    with stand-in words."""
    labelled = capped(synthetic, real).where(F.exists("labels", lambda l: l != "O"))
    stand_in = labelled.select(F.transform("words", lambda w: T.surrogate(w)).alias("words"), "labels", F.lit("synthetic").alias("origin"), F.col("place"))
    own = real.where((F.size("words") > 0) & (F.size("labels") > 0))
    return own.select("words", "labels", F.lit("real").alias("origin"), F.col("i").alias("place")).unionByName(stand_in)


def label_vocabulary(examples: DataFrame) -> DataFrame:
    """Numbers for all labels in use: O is 0, the others follow in order.

    Labels are a closed vocabulary of about a dozen, so ordering them takes one
    small task.
    """
    used = examples.select(F.explode("labels").alias("label")).distinct().where("label <> 'O'")
    ranked = used.withColumn("label_id", F.row_number().over(Window.orderBy("label")))
    return ranked.unionByName(examples.sparkSession.range(1).select(F.lit("O").alias("label"), F.lit(0).alias("label_id")))
