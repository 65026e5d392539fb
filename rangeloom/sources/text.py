"""Reading range sets from text: one address, block or range in a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeloom.functions.addresses import endpoint


def lines(bodies: DataFrame) -> DataFrame:
    """``key, line`` of whole texts ``key, body``: without a byte-order mark, comments after # or ;, and outer white space."""
    cut = bodies.select("key", F.explode(F.split(F.regexp_replace("body", "^﻿", ""), "\n", -1)).alias("line"))
    return cut.select("key", F.btrim(F.replace(F.regexp_replace("line", "[#;].*$", ""), F.lit("\r"), F.lit("")), F.lit(" \t\x0b\x0c")).alias("line"))


def parsed(found: DataFrame, default_prefix: int = 32, mask_cidr: bool = True, strict: bool = False) -> DataFrame:
    """``key, line, lo, hi, kind``: what each line of ``key, line`` stands for.

    A line is an address of one to four parts, a block ``address/length`` or ``address/netmask``, or
    ``a-b``, cut at the first dash, from the first address of a to the last of b. Kinds are range,
    blank, reversed (first address above the last), hostname and rejected. A dash between two texts
    always makes a range, so host names with dashes are rejected. With ``strict`` a reversed range is an error.
    """
    dash = F.instr("line", "-")
    left, right = F.trim(F.substring_index("line", "-", 1)), F.trim(F.expr("substring(line, instr(line, '-') + 1)"))
    split = (dash > 0) & (left != "") & (right != "")
    ends = lambda token: endpoint(token, default_prefix, mask_cidr)
    placed = found.select("key", "line", split.alias("split"), ends(F.when(split, left).otherwise(F.col("line"))).alias("a"), F.when(split, ends(right)).alias("b"))
    placed = placed.select("key", "line", "split", F.col("a.lo").alias("lo"), F.when(F.col("split"), F.col("b.hi")).otherwise(F.col("a.hi")).alias("hi"))
    valid = F.col("lo").isNotNull() & F.col("hi").isNotNull()
    reversed_ = F.raise_error(F.concat(F.lit("reversed range: "), "line")).cast("string") if strict else F.lit("reversed")
    kind = (F.when(F.col("line") == "", "blank").when(valid & (F.col("lo") > F.col("hi")), reversed_).when(valid, "range")
            .when(~F.col("split") & F.col("line").rlike(r"^[0-9A-Za-z._-]*\.[0-9A-Za-z._-]*$") & F.col("line").rlike("[0-9A-Za-z]"), "hostname").otherwise("rejected"))
    return placed.select("key", "line", F.when(valid, F.col("lo")).alias("lo"), F.when(valid, F.col("hi")).alias("hi"), kind.alias("kind"))


def ranges(found: DataFrame, **options) -> DataFrame:
    """``feed, lo, hi`` of the valid lines of ``key, line``."""
    return parsed(found, **options).where("kind = 'range'").select(F.col("key").alias("feed"), "lo", "hi")


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    """Ranges of text files, folders of them, or gzip files of them; a file is a feed, named after it."""
    bodies = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[A-Za-z0-9]+)*$", 1).alias("key"), F.col("value").alias("body"))
    return ranges(lines(bodies), **options)


def read_list(spark: SparkSession, path: str, **options) -> DataFrame:
    """Ranges of all files that a list names, one path in a line; as many paths as a catalog has feeds."""
    names = [r["value"].strip() for r in spark.read.text(path).collect()]
    paths = sorted(n for n in names if n and n[0] not in "#;")
    return read(spark, paths, **options)
