"""The shared tables seen as interval sets; the same text runs in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RANGES_RAW = """SELECT concat('feed_', l_returnflag, l_linestatus) AS feed,
  (CAST(l_partkey AS bigint) * 2654435761 + (CAST(l_suppkey AS bigint) % 10) * 4) % 4294967296 AS lo,
  least((CAST(l_partkey AS bigint) * 2654435761 + (CAST(l_suppkey AS bigint) % 10) * 4) % 4294967296
        + CAST(l_quantity AS bigint), 4294967295) AS hi
FROM lineitem"""


ASN = """SELECT CAST(s_suppkey AS bigint) * 4000000 AS lo, CAST(s_suppkey AS bigint) * 4000000 + 3499999 AS hi,
  64512 + CAST(s_suppkey AS bigint) AS asn FROM supplier WHERE CAST(s_suppkey AS bigint) * 4000000 + 3499999 < 4294967296"""
GEO = """SELECT concat('N', CAST(n_nationkey AS string)) AS code, CAST(n_nationkey AS bigint) * 170000000 AS lo,
  CAST(n_nationkey AS bigint) * 170000000 + 189999999 AS hi FROM nation"""
CRITICAL = """SELECT r_name AS provider, CASE r_regionkey % 3 WHEN 0 THEN 'hard' WHEN 1 THEN 'soft' ELSE 'contextual' END AS tier,
  CAST(r_regionkey AS bigint) * 700000000 AS lo, CAST(r_regionkey AS bigint) * 700000000 + 899999999 AS hi FROM region"""
#: {day} is the start of the event's day in seconds, written by each engine in its own way.
SNAPSHOTS = """SELECT event_type AS feed, {day} AS ts, CAST(user_id AS bigint) * 2654435761 % 4294967296 AS lo,
  CAST(user_id AS bigint) * 2654435761 % 4294967296 AS hi FROM events GROUP BY 1, 2, 3, 4"""
SNAPSHOTS_DUCKDB = SNAPSHOTS.replace("{day}", "CAST(epoch(date_trunc('day', ts)) AS bigint)")
SNAPSHOTS_SPARK = SNAPSHOTS.replace("{day}", "CAST(unix_timestamp(date_trunc('day', ts)) AS bigint)")
#: A catalog of feeds; every state column follows from the key.
CATALOG = """SELECT s_name AS feed, CAST(s_suppkey AS bigint) AS feed_no, CASE s_suppkey % 4 WHEN 0 THEN 'intrusion' WHEN 1 THEN 'policy_risk' WHEN 2 THEN 'special_use' ELSE 'other' END AS category,
  CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE concat('Maintainer ', CAST(s_suppkey % 7 AS string), ' & Co.') END AS maintainer,
  CAST(s_suppkey * 37 % 1000 AS bigint) AS entries, CAST(s_suppkey * 91 % 5000 AS bigint) AS unique_ips,
  CAST(60 * (1 + s_suppkey % 48) AS bigint) AS avg_update_mins, CAST(s_suppkey * 7919 % 60000 AS bigint) AS idle_mins,
  CAST(CASE WHEN s_suppkey % 6 = 0 THEN s_suppkey * 104729 % 400000 ELSE 0 END AS bigint) AS failing_mins,
  CAST(s_suppkey % 9 AS bigint) AS observed, s_suppkey % 11 = 0 AS age_excluded, s_suppkey % 13 <> 0 AS published,
  concat('N', CAST(s_nationkey AS string)) AS country, 64512 + CAST(s_suppkey % 40 AS bigint) AS asn FROM supplier"""

IP = "CAST(o_orderkey AS bigint) * 2654435761 % 4294967296"


def quad(e: str) -> str:
    """SQL of the dotted form of an address."""
    return f"concat_ws('.', CAST(({e}) >> 24 AS string), CAST((({e}) >> 16) & 255 AS string), CAST((({e}) >> 8) & 255 AS string), CAST(({e}) & 255 AS string))"


#: Address lines of every kind, k % 10 says which.
LINES = f"""SELECT k AS key, CASE k % 10 WHEN 0 THEN {quad('ip')} WHEN 1 THEN concat({quad('ip')}, '/', CAST(k % 33 AS string)) WHEN 2 THEN concat({quad('ip')}, ' - ', {quad('ip + k % 1000')})
  WHEN 3 THEN CAST(ip AS string) WHEN 4 THEN concat('0x', hex(ip)) WHEN 5 THEN concat({quad('ip')}, '/255.255.0.0') WHEN 6 THEN concat('  ', {quad('ip')}, ' # note; more')
  WHEN 7 THEN concat('junk', CAST(k AS string)) WHEN 8 THEN concat({quad('ip + 1')}, '-', {quad('ip')}) ELSE concat('host', CAST(k AS string), '.example.org') END AS line
FROM (SELECT CAST(o_orderkey AS bigint) AS k, {IP} % 4294000000 AS ip FROM orders) q"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """Runs a binding over the named tables without leaving views behind."""
    frames = {t: table(spark, sf_dir, t) for t in tables}
    text = sql
    for t in tables:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(text, **frames)


def ranges_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound(spark, sf_dir, RANGES_RAW, "lineitem")


def asn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound(spark, sf_dir, ASN, "supplier")


def geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound(spark, sf_dir, GEO, "nation")


def critical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound(spark, sf_dir, CRITICAL, "region")


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound(spark, sf_dir, SNAPSHOTS_SPARK, "events")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound(spark, sf_dir, CATALOG, "supplier")
