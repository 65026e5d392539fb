"""Queries that attribute feeds to reserved space, countries, networks and critical providers."""

from __future__ import annotations

from rangeloom.operators import attribution as at
from rangeloom.operators import intervals as iv
from rangeloom.plans import bindings as b
from rangeloom.plans.interval_queries import OPTIMIZED
from rangeloom.sources import reference

RESERVED = "res AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {lo}::bigint, {hi}::bigint)" for n, lo, hi in at.reserved_rows()) + ") t(name, lo, hi))"
SHARE = "CAST(sum(least(o.hi, r.hi) - greatest(o.lo, r.lo) + 1) AS bigint)"
ON = "o.lo <= r.hi AND r.lo <= o.hi"


def _opt(s, d):
    return iv.optimize(b.ranges_raw(s, d))


def _reserved(s):
    return s.createDataFrame(at.reserved_rows(), "name string, lo long, hi long")


def merged(source: str, key: str) -> str:
    return f"""(SELECT {key}, min(lo) AS lo, max(hi) AS hi FROM (SELECT *, sum(CASE WHEN ph IS NULL OR lo > ph + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY lo, hi DESC ROWS UNBOUNDED PRECEDING) AS g
  FROM (SELECT *, max(hi) OVER (PARTITION BY {key} ORDER BY lo, hi DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ph FROM {source}) a1) a2 GROUP BY {key}, g)"""


def register_all(register) -> None:
    register("rfc_breakdown", lambda s, d: at.counts(_opt(s, d), _reserved(s), "name"), f"WITH {OPTIMIZED}, {RESERVED} SELECT o.feed, r.name, {SHARE} AS ips FROM opt o JOIN res r ON {ON} GROUP BY 1, 2")
    register("bogon_overlap", lambda s, d: at.covered(_opt(s, d), _reserved(s)), f"WITH {OPTIMIZED}, {RESERVED} SELECT o.feed, {SHARE} AS ips FROM opt o JOIN res r ON {ON} GROUP BY 1")
    register("country_counts", lambda s, d: at.counts(_opt(s, d), b.geo(s, d), "code"), f"WITH {OPTIMIZED}, geo AS ({b.GEO}) SELECT o.feed, r.code, {SHARE} AS ips FROM opt o JOIN geo r ON {ON} GROUP BY 1, 2")
    register("country_total_mapped", lambda s, d: at.covered(_opt(s, d), b.geo(s, d), "total_mapped"),
             f"WITH {OPTIMIZED}, geo AS (SELECT 1 AS one, lo, hi FROM ({b.GEO}) g), u AS {merged('geo', 'one')} SELECT o.feed, {SHARE} AS total_mapped FROM opt o JOIN u r ON {ON} GROUP BY 1")
    known = f"WITH {OPTIMIZED}, asn AS ({b.ASN}), c AS (SELECT o.feed, r.asn, {SHARE} AS ips FROM opt o JOIN asn r ON {ON} GROUP BY 1, 2)"
    register("asn_counts", lambda s, d: at.network_shares(_opt(s, d), b.asn(s, d)),
             f"""{known}, sz AS (SELECT feed, CAST(sum(hi - lo + 1) AS bigint) AS n FROM opt GROUP BY feed),
             every AS (SELECT feed, asn, ips FROM c UNION ALL SELECT feed, 0, n - coalesce((SELECT CAST(sum(ips) AS bigint) FROM c WHERE c.feed = sz.feed), 0) FROM sz)
             SELECT every.feed, asn, ips, round(ips * 100.0::double / n, 4) AS percent FROM every JOIN sz ON sz.feed = every.feed WHERE ips > 0""")
    register("country_asn_joint", lambda s, d: at.joint(_opt(s, d), b.geo(s, d), b.asn(s, d), "code", "asn"),
             f"""WITH {OPTIMIZED}, geo AS ({b.GEO}), asn AS ({b.ASN}), o AS (SELECT x.feed, g.code, greatest(x.lo, g.lo) AS lo, least(x.hi, g.hi) AS hi FROM opt x JOIN geo g ON x.lo <= g.hi AND g.lo <= x.hi)
             SELECT o.feed, o.code, r.asn, {SHARE} AS ips FROM o JOIN asn r ON {ON} GROUP BY 1, 2, 3""")
    register("critical_tiers", lambda s, d: at.tiers(_opt(s, d), b.critical(s, d)),
             f"""WITH {OPTIMIZED}, crit AS ({b.CRITICAL}), e AS (SELECT provider, tier, lo, hi FROM crit UNION ALL SELECT provider, 'total', lo, hi FROM crit), u AS {merged('e', 'tier')},
             c AS (SELECT o.feed, r.tier, {SHARE} AS ips FROM opt o JOIN u r ON {ON} GROUP BY 1, 2), n AS (SELECT o.feed, r.tier, count(DISTINCT r.provider) AS providers FROM opt o JOIN e r ON {ON} GROUP BY 1, 2)
             SELECT c.feed, c.tier, ips, providers FROM c JOIN n ON n.feed = c.feed AND n.tier = c.tier""")
    register("asn_bogon_split", lambda s, d: at.split_bogons(_opt(s, d), _reserved(s), b.asn(s, d)),
             f"""WITH {OPTIMIZED}, {RESERVED}, asn AS ({b.ASN}), sz AS (SELECT feed, CAST(sum(hi - lo + 1) AS bigint) AS feed_ips FROM opt GROUP BY feed),
             bog AS (SELECT o.feed, {SHARE} AS n FROM opt o JOIN res r ON {ON} GROUP BY 1), known AS (SELECT o.feed, {SHARE} AS n FROM opt o JOIN asn r ON {ON} GROUP BY 1),
             o2 AS (SELECT x.feed, greatest(x.lo, r.lo) AS lo, least(x.hi, r.hi) AS hi FROM opt x JOIN res r ON x.lo <= r.hi AND r.lo <= x.hi), twice AS (SELECT o.feed, {SHARE} AS n FROM o2 o JOIN asn r ON {ON} GROUP BY 1),
             t AS (SELECT sz.feed, feed_ips, coalesce(bog.n, 0) AS bogon_ips, coalesce(known.n, 0) - coalesce(twice.n, 0) AS attributed_ips FROM sz LEFT JOIN bog ON bog.feed = sz.feed LEFT JOIN known ON known.feed = sz.feed LEFT JOIN twice ON twice.feed = sz.feed)
             SELECT *, feed_ips - bogon_ips - attributed_ips AS unknown_ips FROM t""")
    register("networks_without_reserved_space", lambda s, d: at.networks_and_bogons(_opt(s, d), _reserved(s), b.asn(s, d)),
             f"""WITH {OPTIMIZED}, {RESERVED}, asn AS ({b.ASN}), sz AS (SELECT feed, CAST(sum(hi - lo + 1) AS bigint) AS n FROM opt GROUP BY feed), bog AS (SELECT o.feed, {SHARE} AS ips FROM opt o JOIN res r ON {ON} GROUP BY 1),
             one AS (SELECT o.feed, r.asn, {SHARE} AS ips FROM opt o JOIN asn r ON {ON} GROUP BY 1, 2), o2 AS (SELECT x.feed, greatest(x.lo, r.lo) AS lo, least(x.hi, r.hi) AS hi FROM opt x JOIN res r ON x.lo <= r.hi AND r.lo <= x.hi),
             two AS (SELECT o.feed, r.asn, {SHARE} AS ips FROM o2 o JOIN asn r ON {ON} GROUP BY 1, 2), net AS (SELECT one.feed, one.asn, one.ips - coalesce(two.ips, 0) AS ips FROM one LEFT JOIN two ON two.feed = one.feed AND two.asn = one.asn),
             every AS (SELECT feed, 'bogon' AS kind, 0 AS asn, ips FROM bog UNION ALL SELECT feed, 'network', asn, ips FROM net UNION ALL
               SELECT sz.feed, 'unknown', 0, n - coalesce((SELECT ips FROM bog WHERE bog.feed = sz.feed), 0) - coalesce((SELECT CAST(sum(ips) AS bigint) FROM net WHERE net.feed = sz.feed), 0) FROM sz)
             SELECT feed, kind, CAST(asn AS bigint) AS asn, CAST(ips AS bigint) AS ips FROM every WHERE ips > 0""")
    inside = "SELECT x.feed, greatest(x.lo, g.lo) AS lo, least(x.hi, g.hi) AS hi FROM opt x JOIN geo g ON x.lo <= g.hi AND g.lo <= x.hi AND code = 'N3'"
    register("networks_of_a_country", lambda s, d: at.within(_opt(s, d), b.geo(s, d).where("code = 'N0'"), b.asn(s, d), "asn"),
             f"WITH {OPTIMIZED}, geo AS ({b.GEO}), asn AS ({b.ASN}), o AS ({inside.replace('N3', 'N0')}) SELECT o.feed, r.asn, {SHARE} AS ips FROM o JOIN asn r ON {ON} GROUP BY 1, 2")
    register("feed_in_a_country", lambda s, d: at.restricted(_opt(s, d), b.geo(s, d).where("code = 'N3'")), f"WITH {OPTIMIZED}, geo AS ({b.GEO}) {inside}")
    points = "SELECT DISTINCT CAST(o_custkey AS bigint) * 2654435761 % 4294967296 AS ip FROM orders"
    register("ip_context", lambda s, d: at.context(b.bound(s, d, points, "orders"), b.geo(s, d), b.asn(s, d)),
             f"WITH geo AS ({b.GEO}), asn AS ({b.ASN}), p AS ({points}) SELECT p.ip, min(g.code) AS code, coalesce(min(a.asn), 0) AS asn FROM p LEFT JOIN geo g ON p.ip BETWEEN g.lo AND g.hi LEFT JOIN asn a ON p.ip BETWEEN a.lo AND a.hi GROUP BY p.ip")
    register("critical_providers", lambda s, d: at.providers(_opt(s, d), b.critical(s, d)), f"WITH {OPTIMIZED}, crit AS ({b.CRITICAL}) SELECT o.feed, r.provider, r.tier, {SHARE} AS ips FROM opt o JOIN crit r ON {ON} GROUP BY 1, 2, 3")
    register("country_segments", lambda s, d: reference.flattened(b.geo(s, d)).select("lo", "hi", iv.F.array_join("codes", ",").alias("codes")),
             f"""WITH geo AS ({b.GEO}), pt AS (SELECT DISTINCT p FROM (SELECT lo AS p FROM geo UNION ALL SELECT hi + 1 FROM geo) q), seg AS (SELECT p AS lo, lead(p) OVER (ORDER BY p) - 1 AS hi FROM pt)
             SELECT s.lo, s.hi, string_agg(code, ',' ORDER BY code) AS codes FROM seg s JOIN geo g ON g.lo <= s.lo AND s.hi <= g.hi GROUP BY 1, 2""")
    register("disjoint_networks", lambda s, d: reference.disjoint_networks(b.asn(s, d).withColumn("hi", iv.F.col("hi") + 900000)),
             f"WITH asn AS ({b.ASN}) SELECT CASE WHEN lag(hi) OVER (ORDER BY lo) + 900000 >= lo THEN lag(hi) OVER (ORDER BY lo) + 900001 ELSE lo END AS lo, hi + 900000 AS hi, asn FROM asn")
