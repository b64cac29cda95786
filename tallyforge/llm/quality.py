"""Quality rules with distribution divergence, in DataFrame operations only.

Base rules count words (`[^\\x20\\x09-\\x0D]+`), their characters, symbols, repeated
lines and words inside repeated 3-word windows; a text fails them with fewer than 50
words, or when more than half of its words lie in such windows.

The method compares two histograms of a text with those of its language, which are
counted over all documents: character classes, and the COMMON most frequent words of
the language (case counts) with a rest. A text fails when the Jensen-Shannon distance
(base 2, 0 to 1) of the former exceeds CHAR_LIMIT and it has MIN_CHARS letters' worth of
characters, or that of the latter exceeds WORD_LIMIT and it has MIN_WORDS words. Shorter
texts are not judged by the method. The references are one row per language; for a language
without words, and for a null language, the pooled row counts.

A null text has no words and fails the base rules. Rows with equal ids are judged one by
one. Very long texts are counted whole. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

COMMON = 32
#: Most languages whose references are sent out; more are joined by language.
LANGUAGES = 200
MIN_CHARS, MIN_WORDS = 400, 100
CHAR_LIMIT, WORD_LIMIT = 0.28, 0.4
SYMBOLS = r"[#*$%&|<>]"
POOLED = "*"


def words(text: Column) -> Column:
    return F.filter(F.split(text, common.BLANK_CLASS + "+"), lambda w: w != "")


def repeated_words(w: Column) -> Column:
    """How many words lie in a 3-word window that occurs twice or more."""
    last = F.size(w) - 3
    windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    sorted_ = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # of the sorted windows, those equal to a neighbour
    again = lambda s: F.filter(F.transform(s, lambda x, i: F.when((F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]), x["i"])), lambda x: x.isNotNull())
    covered = F.flatten(F.transform(F.flatten(F.transform(F.array(sorted_), again)), lambda i: F.array(i, i + 1, i + 2)))
    return F.when(last < 0, F.lit(0)).when(F.size(F.array_distinct(windows)) == last + 1, F.lit(0)).otherwise(F.size(F.array_distinct(covered)))


def measured(docs: DataFrame) -> DataFrame:
    """docs (doc_id, lang, text) with words, chars (class counts) and the base measures."""
    t = docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("words", words(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda x: F.rlike(x, F.lit(common.WORD_CLASS)))
    t = t.withColumns(
        {
            "n_words": F.size("words").cast("long"),
            "word_chars": F.length(F.array_join("words", "")).cast("long"),
            "n_symbols": F.regexp_count("text", F.lit(SYMBOLS)).cast("long"),
            "lines": lines,
        }
    )
    t = t.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
    t = t.withColumn("n_repeat_words", repeated_words(F.col("words")).cast("long"))
    return t.withColumn("chars", classes(F.col("text"), F.length("text") - F.col("word_chars"))).drop("lines")


def shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, F.transform(counts, lambda x: x / total))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two arrays of shares; null if either is null."""
    half = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    parts = F.zip_with(p, q, lambda a, b: half(a, (a + b) / 2) + half(b, (a + b) / 2))
    return F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / 2, F.lit(0.0)))


def classes(t: Column, blanks: Column) -> Column:
    """Character-class counts of a text that holds `blanks` blanks."""
    letters, capitals, digits = (F.length(F.regexp_replace(t, p, "")) for p in (r"\P{L}+", r"\P{Lu}+", "[^0-9]+"))
    small = letters - capitals
    other = F.length(t) - blanks - letters - digits
    return F.array(*[c.cast("double") for c in (small, capitals, digits, blanks, other, F.octet_length(t) - F.length(t))])


def references(docs: DataFrame) -> DataFrame:
    """Per language (and pooled, '*'): lang, common (words), word_shares, char_shares.

    Words are counted once over all documents; the character classes of a language
    are those of its counted words and of the blanks between them.
    """
    rows = docs.select("lang", F.coalesce("text", F.lit("")).alias("text"))
    each = rows.select("lang", F.explode(words(F.col("text"))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    each = common.written(each, "words")
    every = each.where("lang is not null").unionByName(each.groupBy("word").agg(F.sum("n").alias("n")).withColumn("lang", F.lit(POOLED)))
    first = every.withColumn("turn", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("turn") <= COMMON)
    chars = classes(F.col("word"), F.lit(0))
    sums = [F.sum(F.get("c", F.lit(i)) * F.col("n")) for i in range(6)]
    totals = every.select("lang", "n", "word", chars.alias("c")).groupBy("lang").agg(F.sum("n").alias("total"), F.array(*sums).alias("sums"), F.sum(F.col("n") * F.length("word")).alias("inside"))
    sizes = rows.groupBy("lang").agg(F.sum(F.length("text")).alias("size"))
    sizes = sizes.where("lang is not null").unionByName(sizes.groupBy().agg(F.sum("size").alias("size")).select(F.lit(POOLED).alias("lang"), "size"))
    named = first.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("turn", "word", "n"))).alias("top")).join(totals, "lang").join(sizes, "lang")
    counts = F.transform("top", lambda x: x["n"].cast("double"))
    rest = F.col("total") - F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    blanks = (F.col("size") - F.col("inside")).cast("double")
    whole = F.transform("sums", lambda x, i: F.when(i == 3, blanks).otherwise(x))
    return named.select("lang", F.transform("top", lambda x: x["word"]).alias("common"), shares(F.concat(counts, F.array(rest))).alias("word_shares"), shares(whole).alias("char_shares"))


#: A character for each of a language's common words, so that they can be counted in a string.
MARKS = "".join(chr(0x4E00 + i) for i in range(COMMON))


def judged(docs: DataFrame) -> DataFrame:
    """Per document (doc_id, lang, text): the base measures, both distances, the verdict."""
    # the mark before a language keeps it apart from the pooled row, whatever it is called
    docs = docs.select("doc_id", F.concat(F.lit("="), F.col("lang")).alias("lang"), "text")
    m = measured(docs)
    ref = common.written(references(docs), "references")
    known = ref.select("lang", "common").limit(LANGUAGES + 2).collect()
    if len(known) <= LANGUAGES + 1:
        names = [r["lang"] for r in known]
        listed = sorted({w for r in known for w in r["common"]})
        key = F.when(F.col("lang").isin(names), F.col("lang")).otherwise(POOLED) if names else F.lit(POOLED)
        rows = m.withColumn("_ref", key).join(F.broadcast(ref.withColumnRenamed("lang", "_ref")), "_ref", "left")
        seen = F.filter("words", lambda w: w.isin(listed) if listed else F.lit(False))
    else:  # more languages than are sent out: joined by language, the pooled row for those without words
        parts = ("common", "word_shares", "char_shares")
        own = ref.select(F.col("lang").alias("_ref"), F.struct(*parts).alias("_own"))
        pooled = ref.where(F.col("lang") == POOLED).select(F.struct(*parts).alias("_all"))  # one row
        rows = m.join(own, F.col("lang") == F.col("_ref"), "left").crossJoin(F.broadcast(pooled)).withColumn("_own", F.coalesce("_own", "_all"))
        rows = rows.select(*m.columns, *[F.col("_own")[p].alias(p) for p in parts])
        seen = F.filter("words", lambda w: F.array_contains("common", w))
    marks = F.array_join(F.transform(seen, lambda w: F.substr(F.lit("-" + MARKS), (F.array_position("common", w) + 1).cast("int"), F.lit(1))), "")
    rows = rows.withColumn("_marks", marks)
    counts = F.transform("common", lambda c, i: (F.length("_marks") - F.length(F.replace(F.col("_marks"), F.substr(F.lit(MARKS), i + 1, F.lit(1)), F.lit("")))).cast("double"))
    rows = rows.withColumn("_counts", counts)
    rest = F.col("n_words") - F.aggregate("_counts", F.lit(0.0), lambda a, x: a + x)
    rows = rows.withColumn("word_distance", distance(shares(F.concat("_counts", F.array(rest))), F.col("word_shares")))
    rows = rows.withColumn("char_distance", distance(shares(F.col("chars")), F.col("char_shares")))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    odd = ((F.col("word_chars") >= MIN_CHARS) & (F.col("char_distance") > CHAR_LIMIT)) | ((F.col("n_words") >= MIN_WORDS) & (F.col("word_distance") > WORD_LIMIT))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & ~F.coalesce(odd, F.lit(False))).alias("kept"), F.round("char_distance", 6).alias("char_distance"), F.round("word_distance", 6).alias("word_distance"),
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures and the verdict of every document."""
    return judged(common.documents(spark, sf_dir))


QUERIES = {"op7_quality_rules": op7_quality_rules}
