"""Audit of how filters interact: which filter removes what in every order they could be applied in.

1. **Words**: the texts are dealt out by row key (doc_id and digest of the text), their words exploded and
   counted by (key, word), then by key for totals and distinct words. Both counts find their rows in
   place, so what is shuffled is each text once, not its words.
2. **Other flags** come from one narrow pass over the documents: capitals, code points, symbols, and a
   digest, whose least doc_id tells which texts are repeats.
3. Both are joined by key, and the set of failed filters becomes a number from 0 to 31. Documents are
   counted by part and labels into 32 conditional columns, one for each such set.
4. The report of all orders and steps is made of those counts alone: they are joined by the set's number
   with a table of what each set adds to each step, whose size depends on the number of filters only.

A repeat is a row whose text a smaller doc_id has, removed or not. A row without a doc_id has no labels and
is no repeat, nor does it make others repeats. Rows that are repeated whole count as often as they occur.
A null text is empty: it fails A only, if no smaller doc_id is empty. Null ``lang`` is the empty string.
Other columns are ignored, whatever their names; of several labels of a document the largest counts; an
empty table gives an empty report. Words are counted whole, whatever the length of a text.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rangeloom.llm.common import written

FILTERS = "ABCDE"
#: Fixed values of the five filters.
LEAST_WORDS, DISTINCT_PERCENT, CAPITALS_PERCENT, SYMBOLS = 200, 50, 3, "[#$%&*|]"
BLANKS = r"[\x20\x09-\x0D]+"
#: Bytes of text that a partition of the word counts gets on average, and the salts of a repeated digest.
PARTITION, SALTS = 8_000_000, 32
SETS = range(1 << len(FILTERS))
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def keyed(docs: DataFrame, *columns: Column) -> DataFrame:
    """``doc_id, id, digest, text`` and other columns of each row; ``id, digest`` is a key without nulls.

    Rows without a doc_id may share a key with another one, but only if their texts are equal.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *columns)
    return rows.select("*", F.coalesce("doc_id", F.lit(0)).alias("id"), F.unhex(F.sha2("text", 256)).alias("digest"))


def flagged(docs: DataFrame) -> DataFrame:
    """``doc_id, id, digest, part, bytes, c, d`` of each row: what needs no words."""
    return keyed(docs, F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part")).select(
        "doc_id", "id", "digest", "part", F.octet_length("text").cast("long").alias("bytes"),
        (100 * F.regexp_count("text", F.lit("[A-Z]")) > CAPITALS_PERCENT * F.char_length("text")).alias("c"), F.col("text").rlike(SYMBOLS).alias("d"))


def word_counts(docs: DataFrame, parts: int) -> DataFrame:
    """``id, digest, n_words, n_distinct`` of each key.

    A marker without a word goes before the words of each row: it keeps rows without words, and tells how
    many equal rows a key has.
    """
    dealt = keyed(docs).select("id", "digest", "text").repartition(parts, "id", "digest")
    words = dealt.select("id", "digest", F.explode(F.concat(F.array(F.lit(None).cast("string")), F.split("text", BLANKS))).alias("word")).where("word is null or word <> ''")
    counted = words.groupBy("id", "digest", "word").agg(F.count(F.lit(1)).alias("n"))
    rows, total = F.max(F.when(F.col("word").isNull(), F.col("n"))), F.sum(F.when(F.col("word").isNotNull(), F.col("n")).otherwise(0))
    return counted.groupBy("id", "digest").agg((total / rows).cast("long").alias("n_words"), F.count("word").alias("n_distinct"))


def repeats(flags: DataFrame) -> DataFrame:
    """``flags`` with ``e``: whether a smaller doc_id has the same text.

    A digest may have a third of all rows, so it is counted in salted parts first, and digests of
    several rows meet their rows salt by salt.
    """
    salted = flags.withColumn("salt", F.pmod(F.xxhash64("doc_id", "part"), F.lit(SALTS)))
    parts = salted.where("doc_id is not null").groupBy("digest", "salt").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    first = parts.groupBy("digest").agg(F.min("first").alias("first"), F.sum("n").alias("n")).where("n > 1")
    spread = first.select("digest", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    return salted.join(spread, ["digest", "salt"], "left").withColumn("e", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))).drop("salt", "first")


def failures(docs: DataFrame) -> DataFrame:
    """``doc_id, part, mask`` of each row: bit k of the mask is set where it fails filter k."""
    flags = written(flagged(docs), "audit-flags")
    size = flags.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    both = repeats(flags).join(word_counts(docs, max(1, -(-size // PARTITION))), ["id", "digest"], "left")
    tests = (F.col("n_words") < LEAST_WORDS, 100 * F.col("n_distinct") < DISTINCT_PERCENT * F.col("n_words"), F.col("c"), F.col("d"), F.col("e"))
    return both.select("doc_id", "part", sum((F.when(t, 1 << k).otherwise(0) for k, t in enumerate(tests)), F.lit(0)).alias("mask"))


def set_counts(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, good, toxic, s0 .. s31``: the documents of each failed set."""
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("quality") == 1).alias("good"), (F.max("toxic") == 1).alias("toxic"))
    no = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    joined = failed.join(known, "doc_id", "left").select("part", "mask", no("good"), no("toxic"))
    return joined.groupBy("part", "good", "toxic").agg(*(F.count_if(F.col("mask") == s).alias(f"s{s}") for s in SETS))


def contributions() -> list[tuple]:
    """For each order, step and set: what a document with that set adds to the counts of that step."""
    rows = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, k in enumerate(order):
            own = 1 << k
            for s in SETS:
                removed = int(bool(s & own) and not s & before)
                rows.append(("".join(FILTERS[x] for x in order), step + 1, FILTERS[k], s, int(not s & (before | own)), removed, int(bool(s & own) and bool(s & before)), int(s == own)))
            before |= own
    return rows


def report(counts: DataFrame) -> DataFrame:
    """One row for each part, order and step, from the counts of ``set_counts``."""
    spark = counts.sparkSession
    added = F.broadcast(spark.createDataFrame(contributions(), "filter_order string, step int, filter string, s int, kept int, removed int, redundant int, unique_fails int"))
    sets = counts.select("part", "good", "toxic", F.posexplode(F.array(*(F.col(f"s{s}") for s in SETS))).alias("s", "n"))
    by_set = sets.groupBy("part", "s").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("bad"))
    total = lambda n, c, name: F.sum(F.col(n) * F.col(c)).cast("long").alias(name)
    steps = by_set.join(added, "s").groupBy("part", "filter_order", "step", "filter").agg(
        total("n", "kept", "kept"), total("n", "removed", "removed"), total("n", "redundant", "redundant"), total("n", "unique_fails", "unique_fails"),
        total("good", "removed", "good_lost"), total("bad", "removed", "toxic_lost"))
    share = F.sum("removed").over(Window.partitionBy("part", "filter")).alias("shapley")
    return steps.select("part", "filter_order", "step", *COUNTS, share)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The report over ``docs(doc_id, text, lang)`` and ``labels(doc_id, quality, toxic)``."""
    return report(written(set_counts(failures(docs), labels), "audit-counts"))
