"""Removing passages that repeat across documents, by windows of consecutive lines.

A document's lines are its text between line feeds; lines without a word are skipped, and the
others are compared with outer white space removed. Every three consecutive ones make a window (a
document with fewer makes one window of what it has), and so does every shorter run of consecutive
ones that has over ``LONG`` words together. A window's first occurrence, in the order of doc_id
(nulls last), text hash and position, stays; every later one covers its lines, overlapping windows
merge, and covered lines are removed. A line without a word goes with the line before it.

Windows are keyed by two 64-bit hashes with different seeds. Only window keys are grouped; the
texts meet their covered lines once, by row.

Null and empty texts have no windows and stay as they are. A row is known by its doc_id and the hash
of its text: rows that repeat both are one document, each with the same result; rows that repeat a
doc_id, or have none, with different texts are documents of their own. Extra columns are carried
through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangeloom.llm.common import fresh, let, written

WINDOW = 3
#: Words that a run of fewer lines than a window must exceed to be compared on its own.
LONG = 50
#: Characters that separate words.
SPACE = " \t\n\x0b\x0c\r"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def bare(line: Column) -> Column:
    """A line without outer white space."""
    return F.btrim(line, F.lit(SPACE))


def n_words(line: Column) -> Column:
    """Words of a line that has no outer white space and at least one word."""
    return F.size(F.split(line, f"[{SPACE}]+", -1))


def windows(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """``doc_id, h, first, last, k1, k2``: a row per window; h is the hash of the whole text.

    ``first`` and ``last`` are the positions in the text, counted in all lines from 0, of the
    window's first line and of the last line before the one that follows it.
    """
    with_word = lambda lines: F.filter(F.transform(lines, lambda x, i: F.struct(bare(x).alias("x"), i.alias("i"))), lambda s: s["x"] != "")
    placed = let(lines_of(F.col("text")), lambda lines: F.struct(F.size(lines).alias("n"), with_word(lines).alias("kept")))
    rows = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("h"), placed.alias("p")).where(F.size("p.kept") > 0)
    hashed = rows.select("doc_id", "h", F.concat(F.transform("p.kept", lambda s: s["i"]), F.array("p.n")).alias("at"), F.transform("p.kept", lambda s: n_words(s["x"])).alias("words"),
                         *(F.transform("p.kept", h).alias(n) for n, h in (("h1", lambda s: F.xxhash64(s["x"])), ("h2", lambda s: F.xxhash64(F.lit("line"), s["x"])))))
    n = F.size("h1")

    def runs(width: int) -> Column:
        """The windows of so many lines: all of a full window or a whole shorter document, else the long ones."""
        long = lambda i: (F.least(n, F.lit(size)) == width) | (sum((F.get("words", i + j) for j in range(width - 1)), F.get("words", i - 1)) > LONG)
        starts = F.filter(F.when(n >= width, F.sequence(F.lit(1), n - (width - 1))), long)
        return F.coalesce(F.transform(starts, lambda i: F.struct(
            F.get("at", i - 1).alias("first"), (F.get("at", i + (width - 1)) - 1).alias("last"), *(F.xxhash64(F.slice(h, i, width)).alias(k) for h, k in (("h1", "k1"), ("h2", "k2"))))), F.array())

    each = F.concat(*(runs(width) for width in range(1, size + 1)))
    return hashed.select("doc_id", "h", F.explode(each).alias("w")).select("doc_id", "h", "w.*")


def repeats(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """``doc_id, h, gone``: the positions of the lines that later occurrences of repeated windows cover.

    The first occurrence is a minimum per key, so a window that is everywhere is combined before
    the shuffle; keys that occur once never meet the occurrences again.
    """
    found = written(windows(docs.select("doc_id", "text"), size), "line-windows")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h", "first")
    earliest = found.groupBy("k1", "k2").agg(F.min(place).alias("one"), F.max(place).alias("other")).where("not (one <=> other)").select("k1", "k2", "one")
    later = found.join(earliest, ["k1", "k2"]).where(~place.eqNullSafe(F.col("one")))
    return later.groupBy("doc_id", "h").agg(F.collect_set(F.struct("first", "last")).alias("spans")).select(
        "doc_id", "h", F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["first"], s["last"])))).alias("gone"))


def dedup(docs: DataFrame, size: int = WINDOW, counts: bool = True) -> DataFrame:
    """``docs`` with repeated lines removed from ``text``, and ``n_lines``, ``n_removed`` added.

    ``n_lines`` counts the lines with a word, ``n_removed`` those of them that went; they replace
    columns of these names, and without ``counts`` they are left out and such columns stay. All
    other columns are kept. A document whose every line went has an empty text.
    """
    key, hashed, gone, done = fresh(docs, "_doc", "_hash", "_gone", "_done")
    covered = repeats(docs, size).select(F.col("doc_id").alias(key), F.col("h").alias(hashed), F.col("gone").alias(gone))
    same = docs["doc_id"].eqNullSafe(covered[key]) & (F.xxhash64(docs["text"]) == covered[hashed])
    joined = docs.join(covered, same, "left").drop(key, hashed)
    words_in = lambda lines: F.size(F.filter(lines, lambda x: bare(x) != "")).cast("long")

    def parted(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
        text = F.when(F.col(gone).isNotNull(), F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")).otherwise(F.col("text"))
        removed = F.when(F.col(gone).isNotNull(), words_in(F.transform(gone, lambda i: F.get(lines, i)))).otherwise(F.lit(0))
        return F.struct(words_in(lines).alias("n_lines"), removed.cast("long").alias("n_removed"), text.alias("text"))

    # Null texts never meet the split.
    parts = joined.withColumn(done, F.when(F.col("text").isNotNull(), let(lines_of(F.col("text")), parted)))
    number = {c: F.coalesce(F.col(f"{done}.{c}"), F.lit(0).cast("long")) for c in ("n_lines", "n_removed") if counts}
    return parts.withColumns(number | {"text": F.col(f"{done}.text")}).drop(gone, done)
