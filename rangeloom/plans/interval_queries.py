"""Queries of the interval algebra."""

from __future__ import annotations

from rangeloom.operators import intervals as iv
from rangeloom.plans import bindings as b
from rangeloom.sources import binary
from rangeloom.sources.versions import scratch

OPTIMIZED = f"""raw AS ({b.RANGES_RAW}),
p AS (SELECT feed, lo, hi, max(hi) OVER (PARTITION BY feed ORDER BY lo, hi DESC
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ph FROM raw),
g AS (SELECT feed, lo, hi, sum(CASE WHEN ph IS NULL OR lo > ph + 1 THEN 1 ELSE 0 END)
  OVER (PARTITION BY feed ORDER BY lo, hi DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS gid FROM p),
opt AS (SELECT feed, min(lo) AS lo, max(hi) AS hi FROM g GROUP BY feed, gid)"""




def coalesced(source: str, feed: str) -> str:
    """SQL that merges the rows (lo, hi) of ``source`` into one feed."""
    return f"""SELECT '{feed}' AS feed, min(lo) AS lo, max(hi) AS hi FROM (SELECT lo, hi, sum(CASE WHEN ph IS NULL OR lo > ph + 1 THEN 1 ELSE 0 END)
  OVER (ORDER BY lo, hi DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM (SELECT lo, hi, max(hi) OVER (ORDER BY lo, hi DESC
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ph FROM {source}) q1) q2 GROUP BY g"""


def swept(where: str) -> str:
    """SQL of the segments of feed_AF and feed_AO that a condition on their counts a and b keeps."""
    return f"""WITH {OPTIMIZED}, ev AS (SELECT lo AS p, CASE WHEN feed = 'feed_AF' THEN 1 ELSE 0 END AS da, CASE WHEN feed = 'feed_AO' THEN 1 ELSE 0 END AS db FROM opt
  UNION ALL SELECT hi + 1, CASE WHEN feed = 'feed_AF' THEN -1 ELSE 0 END, CASE WHEN feed = 'feed_AO' THEN -1 ELSE 0 END FROM opt),
  pt AS (SELECT p, sum(da) AS da, sum(db) AS db FROM ev GROUP BY p),
  seg AS (SELECT p AS lo, lead(p) OVER (ORDER BY p) - 1 AS hi, sum(da) OVER (ORDER BY p) AS a, sum(db) OVER (ORDER BY p) AS b FROM pt),
  kept AS (SELECT lo, hi FROM seg WHERE {where})"""


def _two(s, d):
    every = iv.optimize(b.ranges_raw(s, d))
    return every.where("feed = 'feed_AF'"), every.where("feed = 'feed_AO'")


PAIRS = f"""WITH {OPTIMIZED}, sz AS (SELECT feed, count(*) AS entries, CAST(sum(hi - lo + 1) AS bigint) AS ips FROM opt GROUP BY feed),
ov AS (SELECT x.feed AS f1, y.feed AS f2, CAST(sum(least(x.hi, y.hi) - greatest(x.lo, y.lo) + 1) AS bigint) AS common
  FROM opt x JOIN opt y ON x.lo <= y.hi AND y.lo <= x.hi AND x.feed < y.feed GROUP BY 1, 2),
pairs AS (SELECT p.feed AS name1, q.feed AS name2, p.entries AS entries1, q.entries AS entries2, p.ips AS ips1, q.ips AS ips2,
  p.ips + q.ips - coalesce(common, 0) AS combined, coalesce(common, 0) AS common
  FROM sz p JOIN sz q ON p.feed < q.feed LEFT JOIN ov ON f1 = p.feed AND f2 = q.feed)"""


def register_all(register) -> None:
    register("optimize_summary", lambda s, d: iv.summary(iv.optimize(b.ranges_raw(s, d))),
             f"WITH {OPTIMIZED} SELECT feed, count(*) AS entries, CAST(sum(hi - lo + 1) AS bigint) AS unique_ips FROM opt GROUP BY feed")
    register("optimize_ranges", lambda s, d: iv.optimize(b.ranges_raw(s, d)),
             f"WITH {OPTIMIZED} SELECT feed, lo, hi FROM opt")
    for name, operator, where in (("intersect_two", iv.intersect, "a > 0 AND b > 0"), ("exclude_two", iv.exclude, "a > 0 AND b = 0"),
                                  ("diff_two", iv.symmetric_difference, "(a > 0) <> (b > 0)")):
        feed = name.split("_")[0]
        register(name, lambda s, d, operator=operator: operator(*_two(s, d)), f"{swept(where)} {coalesced('kept', feed)}")
    register("union_feeds", lambda s, d: iv.union(b.ranges_raw(s, d)), f"WITH raw AS ({b.RANGES_RAW}) {coalesced('raw', 'union')}")
    register("common_feeds", lambda s, d: iv.common(iv.optimize(b.ranges_raw(s, d))),
             f"""WITH {OPTIMIZED}, ev AS (SELECT lo AS p, 1 AS x FROM opt UNION ALL SELECT hi + 1, -1 FROM opt), pt AS (SELECT p, sum(x) AS x FROM ev GROUP BY p),
             seg AS (SELECT p AS lo, lead(p) OVER (ORDER BY p) - 1 AS hi, sum(x) OVER (ORDER BY p) AS n FROM pt),
             kept AS (SELECT lo, hi FROM seg WHERE n = (SELECT count(DISTINCT feed) FROM opt)) {coalesced('kept', 'common')}""")
    register("compare_all", lambda s, d: iv.compare(iv.optimize(b.ranges_raw(s, d))), f"{PAIRS} SELECT * FROM pairs")
    for name, first in (("compare_first", "feed_AF"), ("compare_first_of_many", "feed_NO")):
        register(name, lambda s, d, first=first: iv.compare_first(iv.optimize(b.ranges_raw(s, d)), first),
                 f"""{PAIRS} SELECT CASE WHEN name1 = '{first}' THEN name2 ELSE name1 END AS name, CASE WHEN name1 = '{first}' THEN entries2 ELSE entries1 END AS entries,
             CASE WHEN name1 = '{first}' THEN ips2 ELSE ips1 END AS ips, common FROM pairs WHERE '{first}' IN (name1, name2)""")
    register("count_unique_merged", lambda s, d: iv.summary(iv.union(b.ranges_raw(s, d))),
             f"WITH raw AS ({b.RANGES_RAW}) SELECT feed, count(*) AS entries, CAST(sum(hi - lo + 1) AS bigint) AS unique_ips FROM ({coalesced('raw', 'union')}) u GROUP BY feed")
    register("bounds", lambda s, d: iv.bounds(b.ranges_raw(s, d)), f"SELECT feed, min(lo) AS lo, max(hi) AS hi FROM ({b.RANGES_RAW}) r GROUP BY feed")
    points = "SELECT DISTINCT CAST(o_custkey AS bigint) * 2654435761 % 4294967296 AS ip FROM orders"
    register("contains_points", lambda s, d: iv.contains(iv.optimize(b.ranges_raw(s, d)), b.bound(s, d, points, "orders")),
             f"WITH {OPTIMIZED}, pts AS ({points}) SELECT DISTINCT ip, feed FROM pts JOIN opt ON ip BETWEEN lo AND hi")
    register("cidr_histogram", lambda s, d: iv.to_cidrs(iv.optimize(b.ranges_raw(s, d))).groupBy("feed", "prefix").count().withColumnRenamed("count", "blocks"),
             f"""WITH RECURSIVE {OPTIMIZED}, step(feed, pos, hi, w) AS (SELECT feed, lo, hi, (SELECT max(1::bigint << k) FROM range(0, 33) t(k) WHERE lo % (1::bigint << k) = 0 AND lo + (1::bigint << k) - 1 <= hi) FROM opt
             UNION ALL SELECT feed, pos + w, hi, (SELECT max(1::bigint << k) FROM range(0, 33) t(k) WHERE (pos + w) % (1::bigint << k) = 0 AND pos + w + (1::bigint << k) - 1 <= hi) FROM step WHERE pos + w <= hi)
             SELECT feed, CAST(32 - round(log2(w)) AS integer) AS prefix, count(*) AS blocks FROM step GROUP BY 1, 2""")
    register("range_lines", lambda s, d: iv.optimize(b.ranges_raw(s, d)).select("feed", iv.range_text().alias("line")),
             f"""WITH {OPTIMIZED} SELECT feed, concat_ws('.', lo >> 24, (lo >> 16) & 255, (lo >> 8) & 255, lo & 255) || '-' || concat_ws('.', hi >> 24, (hi >> 16) & 255, (hi >> 8) & 255, hi & 255) AS line FROM opt""")
    register("single_ips", lambda s, d: iv.to_ips(iv.optimize(b.ranges_raw(s, d))), f"WITH {OPTIMIZED} SELECT feed, unnest(range(lo, hi + 1)) AS ip FROM opt")

    every = lambda s, d: iv.optimize(b.ranges_raw(s, d))
    register("compare_next", lambda s, d: iv.compare_between(every(s, d).where("feed < 'feed_B'"), every(s, d).where("feed > 'feed_B'")),
             f"""WITH {OPTIMIZED}, sz AS (SELECT feed, count(*) AS entries, CAST(sum(hi - lo + 1) AS bigint) AS ips FROM opt GROUP BY feed),
             ov AS (SELECT x.feed AS f1, y.feed AS f2, CAST(sum(least(x.hi, y.hi) - greatest(x.lo, y.lo) + 1) AS bigint) AS common FROM opt x JOIN opt y ON x.lo <= y.hi AND y.lo <= x.hi AND x.feed < 'feed_B' AND y.feed > 'feed_B' GROUP BY 1, 2)
             SELECT p.feed AS name1, q.feed AS name2, p.entries AS entries1, q.entries AS entries2, p.ips AS ips1, q.ips AS ips2, p.ips + q.ips - coalesce(common, 0) AS combined, coalesce(common, 0) AS common
             FROM sz p JOIN sz q ON p.feed < 'feed_B' AND q.feed > 'feed_B' LEFT JOIN ov ON f1 = p.feed AND f2 = q.feed""")
    asked = "SELECT * FROM (VALUES ('feed_AF', 'feed_RF'), ('feed_RO', 'feed_AO'), ('feed_AF', 'nowhere'), ('feed_AF', 'feed_RF')) t(name1, name2)"
    register("compare_pairs", lambda s, d: iv.compare_pairs(every(s, d), s.sql(asked)),
             f"""{PAIRS}, both_ways AS (SELECT * FROM pairs UNION ALL SELECT name2, name1, entries2, entries1, ips2, ips1, combined, common FROM pairs)
             SELECT DISTINCT w.* FROM both_ways w JOIN ({asked}) a ON a.name1 = w.name1 AND a.name2 = w.name2""")

    def composed(plus: str, minus: str, feed: str) -> str:
        """SQL of the ranges that some feeds have and others don't."""
        return f"""WITH raw AS ({b.RANGES_RAW}), ev AS (SELECT lo AS p, CASE WHEN {plus} THEN 1 ELSE 0 END AS da, CASE WHEN {minus} THEN 1 ELSE 0 END AS db FROM raw
             UNION ALL SELECT hi + 1, CASE WHEN {plus} THEN -1 ELSE 0 END, CASE WHEN {minus} THEN -1 ELSE 0 END FROM raw), pt AS (SELECT p, sum(da) AS da, sum(db) AS db FROM ev GROUP BY p),
             seg AS (SELECT p AS lo, lead(p) OVER (ORDER BY p) - 1 AS hi, sum(da) OVER (ORDER BY p) AS a, sum(db) OVER (ORDER BY p) AS b FROM pt),
             kept AS (SELECT lo, hi FROM seg WHERE a > 0 AND b = 0) {coalesced('kept', feed)}"""

    register("exclude_next", lambda s, d: iv.exclude_next(b.ranges_raw(s, d), ["feed_AF", "feed_AO"], ["feed_NF", "feed_RO"]), composed("feed IN ('feed_AF', 'feed_AO')", "feed IN ('feed_NF', 'feed_RO')", "exclude"))
    register("compose_expression", lambda s, d: iv.expression(b.ranges_raw(s, d), "feed_AF + feed_RF - feed_NO"), composed("feed IN ('feed_AF', 'feed_RF')", "feed = 'feed_NO'", "composed"))
    states = "SELECT * FROM (VALUES ('feed_AF', true, 'healthy'), ('feed_AO', true, 'archived'), ('feed_NF', false, 'healthy'), ('feed_NO', true, 'risky'), ('feed_RF', true, 'delayed'), ('feed_RO', true, 'unavailable')) t(feed, enabled, health)"
    wanted = """SELECT * FROM (VALUES ('one', 'feed_AF', false), ('one', 'feed_AO', false), ('one', 'feed_RF', true), ('two', 'feed_RF', false), ('two', 'feed_RO', true), ('three', 'feed_NF', false),
             ('four', 'feed_NO', false), ('four', 'feed_AF', false)) t(merge, input, subtract)"""
    register("merged_feeds", lambda s, d: iv.merged(b.ranges_raw(s, d), s.sql(wanted), s.sql(states)),
             f"""SELECT * FROM ({composed("feed = 'feed_AF'", "feed = 'feed_RF'", "one")}) q UNION ALL SELECT * FROM ({composed("feed IN ('feed_NO', 'feed_AF')", "feed = ''", "four")}) r""")
    blocks = """WITH RECURSIVE {opt}, step(feed, pos, hi, w) AS (SELECT feed, lo, hi, (SELECT max(1::bigint << k) FROM range(0, 33) t(k) WHERE lo % (1::bigint << k) = 0 AND lo + (1::bigint << k) - 1 <= hi) FROM opt
             UNION ALL SELECT feed, pos + w, hi, (SELECT max(1::bigint << k) FROM range(0, 33) t(k) WHERE (pos + w) % (1::bigint << k) = 0 AND pos + w + (1::bigint << k) - 1 <= hi) FROM step WHERE pos + w <= hi),
             cidr AS (SELECT feed, pos AS lo, w, CAST(32 - round(log2(w)) AS integer) AS prefix FROM step)""".replace("{opt}", OPTIMIZED)
    text = "concat_ws('.', lo >> 24, (lo >> 16) & 255, (lo >> 8) & 255, lo & 255)"
    register("cidr_lines", lambda s, d: iv.body(every(s, d)), f"{blocks} SELECT feed, lo, CASE WHEN prefix = 32 THEN {text} ELSE {text} || '/' || prefix END AS line FROM cidr")
    register("cidrs_of_enabled_lengths", lambda s, d: iv.enabled_cidrs(every(s, d), [8, 16, 27, 30, 31]),
             f"""{blocks}, t AS (SELECT *, CASE WHEN prefix <= 8 THEN 8 WHEN prefix <= 16 THEN 16 WHEN prefix <= 27 THEN 27 WHEN prefix <= 30 THEN 30 WHEN prefix <= 31 THEN 31 END AS q FROM cidr)
             SELECT feed, lo + (1::bigint << (32 - q)) * i AS lo, q AS prefix FROM (SELECT *, unnest(range(0, 1::bigint << (q - prefix))) AS i FROM t WHERE q IS NOT NULL) u""")
    for name, percent, least in (("reduced_prefixes", 150, 0), ("reduced_prefixes_of_a_budget", 100, 400)):
        register(name, lambda s, d, percent=percent, least=least: iv.reduce_prefixes(every(s, d), percent, least),
                 f"""{blocks}, n AS (SELECT feed, list_transform(range(0, 33), lambda p: CAST(coalesce(list_sum(list_transform(list_filter(list(prefix), lambda y: y = p), lambda y: 1)), 0) AS bigint)) AS c, count(*) AS total FROM cidr GROUP BY feed),
                 red(feed, c, total, budget) AS (SELECT feed, c, total, greatest(total * {percent} // 100, {least}) FROM n UNION ALL
                   SELECT feed, list_transform(range(0, 33), lambda p: CASE p WHEN best.p THEN 0 WHEN best.q THEN c[p + 1] + best.price + c[best.p + 1] ELSE c[p + 1] END), total + best.price, budget
                   FROM (SELECT *, list_sort(list_transform(range(1, len(u)), lambda i: {{'price': c[u[i] + 1] * ((1::bigint << (u[i + 1] - u[i])) - 1), 'p': u[i], 'q': u[i + 1]}}))[1] AS best FROM (SELECT *, list_filter(range(0, 33), lambda p: c[p + 1] > 0) AS u FROM red) a) z
                   WHERE total < budget AND best IS NOT NULL AND best.price < budget * 10 AND total + best.price <= budget),
                 done AS (SELECT feed, arg_max(c, total) AS c FROM red GROUP BY feed)
                 SELECT feed, CAST(unnest(list_filter(range(0, 33), lambda p: c[p + 1] > 0)) AS integer) AS prefix FROM done""")
    register("content_hash", lambda s, d: iv.content_hash(every(s, d)),
             f"WITH {OPTIMIZED} SELECT feed, sha256(unhex(string_agg(printf('%08X%08X', lo, hi), '' ORDER BY lo))) AS sha256 FROM opt GROUP BY feed")

    def through_files(s, d):
        """Ranges written to binary files and read back from them in runs of records."""
        folder = scratch(s, "range-files")
        binary.write(every(s, d), folder, "rangeloom ranges 1").count()
        return folder

    register("binary_round_trip", lambda s, d: binary.read(s, through_files(s, d), "rangeloom ranges 1", records=500), f"WITH {OPTIMIZED} SELECT feed, lo, hi FROM opt")
    register("binary_metadata", lambda s, d: binary.metadata(s, through_files(s, d), "rangeloom ranges 1").select("feed", "optimized", "records", iv.F.col("unique_ips").cast("long").alias("unique_ips")),
             f"WITH {OPTIMIZED} SELECT feed, true AS optimized, count(*) AS records, CAST(sum(hi - lo + 1) AS bigint) AS unique_ips FROM opt GROUP BY feed")
