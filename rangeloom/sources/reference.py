"""Reading reference tables of networks and countries."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rangeloom.functions.addresses import QUAD, endpoint, ipv4_number
from rangeloom.operators import intervals as iv


def iptoasn(rows: DataFrame, strict: bool = True) -> DataFrame:
    """``lo, hi, asn, country, name`` of tab-separated lines ``line``: first, last, number, country, name.

    Number 0 and IPv6 lines are left out; with ``strict`` any other bad line is an error.
    """
    f = F.split("line", "\t", -1)
    cut = rows.where("trim(line) <> ''").select("line", F.size(f).alias("n"), *(F.trim(F.get(f, F.lit(i))).alias(c) for i, c in enumerate(("first", "last", "number", "country", "name"))))
    cut = cut.where("not contains(first, ':')").select("*", ipv4_number(F.col("first")).alias("lo"), ipv4_number(F.col("last")).alias("hi"), F.col("number").try_cast("bigint").alias("asn"))
    good = F.coalesce((F.col("n") >= 5) & (F.col("lo") <= F.col("hi")) & (F.col("asn") >= 0), F.lit(False))
    if strict:
        cut = cut.where(F.when(good, True).otherwise(F.raise_error(F.concat(F.lit("bad line: "), "line")).cast("boolean")))
    return cut.where(good & (F.col("asn") > 0)).select("lo", "hi", "asn", "country", "name")


def caida(rows: DataFrame) -> DataFrame:
    """``lo, hi, asn`` of lines ``line``: address, prefix length and origin; of several origins the first counts, 0 and IPv6 don't."""
    f = F.split(F.trim("line"), r"\s+")
    cut = rows.select(F.get(f, F.lit(0)).alias("address"), F.get(f, F.lit(1)).alias("bits"), F.regexp_extract(F.get(f, F.lit(2)), r"^([0-9]+)", 1).try_cast("bigint").alias("asn"))
    placed = cut.where(F.col("address").rlike(f"^{QUAD}$")).select(endpoint(F.concat_ws("/", "address", "bits")).alias("e"), "asn")
    return placed.where("e is not null and asn > 0").select("e.lo", "e.hi", "asn")


def disjoint_networks(networks: DataFrame) -> DataFrame:
    """``lo, hi, asn`` without overlaps: a range starts after all that start before it, and neighbours of one network are joined."""
    order = Window.partitionBy("bucket").orderBy("lo", "hi", "asn")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    cut = iv.clip(networks.select("lo", "hi", "asn"), iv.BUCKET_BITS)
    shifted = cut.withColumn("lo", F.greatest("lo", F.coalesce(F.max("hi").over(before) + 1, F.col("lo")))).where("lo <= hi")
    return iv.optimize(shifted.select(F.col("asn").alias("feed"), "lo", "hi")).select("lo", "hi", F.col("feed").alias("asn"))


def geo_csv(rows: DataFrame, quoted: bool = True) -> DataFrame:
    """``code, lo, hi`` of comma-separated lines ``line``: first, last, country code, as addresses or numbers; ``-`` and IPv6 are left out."""
    clean = F.replace("line", F.lit('"'), F.lit("")) if quoted else F.col("line")
    f = F.split(clean, ",", -1)
    at = lambda i: F.trim(F.get(f, F.lit(i)))
    return (rows.select(F.upper(at(2)).alias("code"), ipv4_number(at(0)).alias("lo"), ipv4_number(at(1)).alias("hi"))
            .where("lo <= hi and code rlike '^[A-Z][A-Z]$'"))


def geo_blocks(rows: DataFrame) -> DataFrame:
    """``code, lo, hi`` of tab-separated lines ``line``: block and country code."""
    f = F.split("line", r"\t", -1)
    return (rows.select(F.upper(F.trim(F.get(f, F.lit(1)))).alias("code"), endpoint(F.trim(F.get(f, F.lit(0)))).alias("e")).where("e is not null and code rlike '^[A-Z][A-Z]$'")
            .select("code", "e.lo", "e.hi"))


def geolite(blocks: DataFrame, locations: DataFrame) -> DataFrame:
    """``code, lo, hi`` of blocks ``network, geoname_id, registered_country_geoname_id, is_anonymous_proxy, is_satellite_provider`` and locations ``geoname_id, country_iso_code``.

    Anonymous and satellite blocks are pseudo countries of their own.
    """
    pseudo = F.when(F.col("is_anonymous_proxy") == "1", "ANONYMOUS").when(F.col("is_satellite_provider") == "1", "SATELLITE")
    place = F.coalesce(F.nullif(F.col("geoname_id").cast("string"), F.lit("")), F.col("registered_country_geoname_id").cast("string"))
    named = blocks.select("network", pseudo.alias("pseudo"), place.alias("place")).join(locations.select(F.col("geoname_id").cast("string").alias("place"), "country_iso_code"), "place", "left")
    return (named.select(F.coalesce("pseudo", "country_iso_code").alias("code"), endpoint(F.col("network")).alias("e")).where("e is not null and code <> ''").select("code", "e.lo", "e.hi"))


def flattened(geo: DataFrame) -> DataFrame:
    """``lo, hi, codes``: disjoint segments with the sorted codes that cover them."""
    segments = iv.atoms(geo.select("code", "lo", "hi"), "code")
    joined = iv.optimize(segments.select(F.array_join("code", ",").alias("feed"), "lo", "hi"))
    return joined.select("lo", "hi", F.split("feed", ",").alias("codes"))


def archive_members(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """``file, member, line`` of zip, tar and tar.gz archives: an archive is read by one task, and its lines spread after that."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                for member, data in _members(content):
                    if member.endswith(suffix):
                        found = data.decode("utf-8", "replace").split("\n")
                        yield pd.DataFrame({"file": name, "member": member, "line": [x.rstrip("\r") for x in found]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, member string, line string")


def _members(content: bytes) -> Iterator[tuple[str, bytes]]:
    if content[:4] == b"PK\x03\x04":
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for name in z.namelist():
                if not name.endswith("/"):
                    yield name, z.read(name)
        return
    with tarfile.open(fileobj=io.BytesIO(content)) as t:
        for m in t:
            if m.isfile():
                yield m.name, t.extractfile(m).read()


def country_zones(spark: SparkSession, path: str) -> DataFrame:
    """``code, lo, hi`` of archives with one file of blocks for each country, named after its code."""
    found = archive_members(spark, path, ".zone")
    return (found.select(F.upper(F.regexp_extract("member", r"([a-zA-Z]{2})\.zone$", 1)).alias("code"), endpoint(F.trim("line")).alias("e"))
            .where("e is not null and code <> ''").select("code", "e.lo", "e.hi"))
