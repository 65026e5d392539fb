"""Queries over ledgers as they are loaded, streams, and totals kept by deltas."""

from __future__ import annotations

from pyspark.sql import functions as F

from rangeloom.operators import aggregates as ag
from rangeloom.operators import history as h
from rangeloom.operators import records as rc
from rangeloom.plans import bindings as b
from rangeloom.plans.history_queries import RUNS
from rangeloom.sources.versions import scratch
from rangeloom.streaming import bodies, ledger, streaks

#: What suppliers' feeds touch: countries and networks by their parts, a maintainer and a category of their own.
OWN = "concat('s', CAST(l_suppkey AS string)) AS feed, concat('c', CAST(l_suppkey % 4 AS string)) AS category"
TOUCHED = f"""SELECT {OWN}, 'country' AS kind, concat('N', CAST(l_partkey % 25 AS string)) AS key, CAST(sum(l_linenumber) AS bigint) AS ips FROM lineitem GROUP BY 1, 2, 3, 4
UNION ALL SELECT {OWN}, 'asn', CAST(64512 + l_partkey % 97 AS string), CAST(sum(l_linenumber) AS bigint) FROM lineitem WHERE l_partkey % 3 > 0 GROUP BY 1, 2, 3, 4
UNION ALL SELECT {OWN}, 'maintainer', concat('m', CAST(l_suppkey % 7 AS string)), CAST(sum(l_linenumber) AS bigint) FROM lineitem WHERE l_suppkey % 7 > 0 GROUP BY 1, 2, 3, 4
UNION ALL SELECT {OWN}, 'feed', concat('s', CAST(l_suppkey AS string)), CAST(sum(l_linenumber) AS bigint) FROM lineitem GROUP BY 1, 2, 3, 4"""
#: Some feeds lose part of what they touch, and have more of the rest.
CHANGED = "CAST(substring(feed, 2) AS bigint) % 7 = 2"
AFTER = f"SELECT feed, category, kind, key, CASE WHEN {CHANGED} THEN 2 * ips ELSE ips END AS ips FROM t WHERE NOT ({CHANGED} AND kind IN ('country', 'asn') AND (key LIKE '%1' OR key LIKE '%3'))"
#: History lines in an order in which times fall back and repeat, with lines that are none.
HISTORY = """SELECT o_orderstatus AS feed, CAST(o_orderkey AS bigint) AS pos, CASE WHEN o_orderkey % 19 = 0 THEN 'broken' WHEN o_orderkey % 23 = 0 THEN concat(CAST(o_orderkey AS string), ',1,2') ELSE
  concat(CAST(1600000000 + floor(o_orderkey / 3) * 3600 - CASE WHEN o_orderkey % 11 = 0 THEN 90000 ELSE 0 END AS string), ', ', CAST(o_custkey % 50 AS string), ',', CAST(o_custkey AS string)) END AS line FROM orders"""
NUMBERS = """n AS (SELECT feed, pos, string_split(line, ',') AS p FROM h), v AS (SELECT feed, pos, TRY_CAST(trim(p[1]) AS bigint) AS ts, TRY_CAST(trim(p[2]) AS bigint) AS entries, TRY_CAST(trim(p[3]) AS bigint) AS unique_ips FROM n WHERE len(p) = 3),
ok AS (SELECT * FROM v WHERE ts BETWEEN 946684800 AND 4102444800), f AS (SELECT * FROM (SELECT *, lead(ts) OVER (PARTITION BY feed ORDER BY pos) AS after FROM ok) q WHERE after IS NULL OR after > ts),
kept AS (SELECT feed, pos, ts, entries, unique_ips FROM (SELECT *, max(ts) OVER (PARTITION BY feed ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM f) q WHERE before IS NULL OR ts > before)"""
#: Download results, some of them late.
RESULTS = """SELECT concat('r', CAST(o_custkey % 20 AS string)) AS feed, CAST(o_orderkey AS bigint) AS pos, CAST(o_orderkey AS bigint) * 60 - CASE WHEN o_orderkey % 13 = 0 THEN 6000 ELSE 0 END AS ts, o_orderkey % 5 = 0 AND o_custkey % 20 > 2 AS ok FROM orders"""
WEEKS = b.SNAPSHOTS.replace("{day}", "{week}")
WEEKS_DUCKDB = WEEKS.replace("{week}", "CAST(epoch(date_trunc('week', ts)) AS bigint)")
WEEKS_SPARK = WEEKS.replace("{week}", "CAST(unix_timestamp(date_trunc('week', ts)) AS bigint)")
LAST_RESULT = "(SELECT max(ts) FROM e)"


def _touched(s, d):
    return b.bound(s, d, TOUCHED, "lineitem")


def _after(s, d):
    return s.sql(AFTER.replace("FROM t", "FROM {t}"), t=_touched(s, d))


def _refreshed(s, d):
    old = _touched(s, d)
    return ag.refreshed(ag.partials(old), old.where(CHANGED), _after(s, d).where(CHANGED))


def _streamed_streaks(s, d):
    """The last row of each feed of a stream over files of results, and so its streak."""
    folder = scratch(s, "results")
    b.bound(s, d, RESULTS, "orders").coalesce(1).write.parquet(f"{folder}/in")
    stream = s.readStream.schema("feed string, pos long, ts long, ok boolean").parquet(f"{folder}/in")
    rows = streaks.follow(stream)
    query = rows.writeStream.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")).outputMode("update").option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start()
    query.awaitTermination()
    found = s.read.schema(f"{streaks.STREAK}, batch int").parquet(f"{folder}/out")
    return found.groupBy("feed").agg(F.max_by(F.struct("ts", "failures", "failure_started"), "batch").alias("x")).select("feed", "x.*")


def _ledger(s, d):
    """The ledger after two batches of weekly snapshots."""
    weeks, folder = b.bound(s, d, WEEKS_SPARK, "events"), scratch(s, "cohorts")
    half = weeks.agg(F.percentile_approx("ts", 0.5)).first()[0]
    for number, part in enumerate((weeks.where(F.col("ts") <= half), weeks.where(F.col("ts") > half))):
        ledger.apply_batch(part, number, folder)
    return folder


def _streamed_bodies(s, d):
    """The sets of all documents' addresses after a stream over files of them."""
    folder = scratch(s, "bodies")
    b.table(s, d, "documents").selectExpr("doc_id AS key", "text AS line").write.parquet(f"{folder}/in")
    found = s.readStream.schema("key long, line string").parquet(f"{folder}/in")
    bodies.follow(found, [("extract_ipv4", {})], f"{folder}/sets", f"{folder}/check").awaitTermination()
    return bodies.sets(s, f"{folder}/sets").read()


def register_all(register) -> None:
    summed = "SELECT category, kind, key, count(*) AS feeds, CAST(sum(ips) AS bigint) AS ips"
    register("totals_after_deltas", _refreshed, f"WITH t AS ({TOUCHED}), a AS ({AFTER}) {summed} FROM a GROUP BY 1, 2, 3")
    register("changed_targets", lambda s, d: ag.targets(_touched(s, d).where(CHANGED), _after(s, d).where(CHANGED)), f"WITH t AS ({TOUCHED}) SELECT DISTINCT kind, key FROM t WHERE {CHANGED} AND kind IN ('country', 'asn')")
    register("stale_totals", lambda s, d: ag.findings(ag.partials(_touched(s, d)), ag.partials(_after(s, d))),
             f"""WITH t AS ({TOUCHED}), a AS ({AFTER}), x AS ({summed} FROM t GROUP BY 1, 2, 3), y AS ({summed} FROM a GROUP BY 1, 2, 3)
             SELECT coalesce(x.category, y.category) AS category, coalesce(x.kind, y.kind) AS kind, coalesce(x.key, y.key) AS key, CASE WHEN x.feeds IS NULL THEN 'missing' WHEN y.feeds IS NULL THEN 'extra' ELSE 'stale' END AS finding
             FROM x FULL JOIN y ON x.category = y.category AND x.kind = y.kind AND x.key = y.key WHERE x.feeds IS DISTINCT FROM y.feeds OR x.ips IS DISTINCT FROM y.ips""")
    chosen = ["c0", "c2"]
    where = "category IN ('c0', 'c2')"
    register("composed_summary", lambda s, d: ag.composed(ag.partials(_touched(s, d)), chosen, 5),
             f"""WITH t AS ({TOUCHED}), g AS (SELECT kind, key, count(*) AS feeds, CAST(sum(ips) AS bigint) AS ips FROM t WHERE {where} GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY feeds DESC, ips DESC, key) AS place FROM g WHERE kind <> 'feed')
             SELECT kind, CAST(place AS integer) AS place, key, feeds, ips FROM p WHERE place <= 5 UNION ALL SELECT 'all', 0, '', count(*), CAST(sum(ips) AS bigint) FROM t WHERE {where} AND kind = 'feed'""")
    register("globe", lambda s, d: ag.totals(ag.partials(_touched(s, d)), chosen).where("kind = 'country'").select(F.col("key").alias("code"), "feeds", "ips"),
             f"WITH t AS ({TOUCHED}) SELECT key AS code, count(*) AS feeds, CAST(sum(ips) AS bigint) AS ips FROM t WHERE {where} AND kind = 'country' GROUP BY 1")
    touching = f"WITH t AS ({TOUCHED}), w AS (SELECT feed, sum(ips) AS ips FROM t WHERE kind = 'country' AND key = 'N3' GROUP BY 1)"
    register("country_detail", lambda s, d: ag.detail(_touched(s, d), "country", "N3").select("feed", "kind", "key", "within"), f"{touching} SELECT t.feed, t.kind, t.key, CAST(w.ips AS bigint) AS within FROM t JOIN w ON w.feed = t.feed")
    register("country_facets", lambda s, d: ag.facets(_touched(s, d), "country", "N3", 3),
             f"""{touching}, f AS (SELECT CASE kind WHEN 'feed' THEN 'category' ELSE 'maintainer' END AS facet, CASE kind WHEN 'feed' THEN category ELSE key END AS name, count(*) AS feeds, CAST(sum(w.ips) AS bigint) AS ips FROM t JOIN w ON w.feed = t.feed WHERE kind IN ('feed', 'maintainer') GROUP BY 1, 2),
             p AS (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY ips DESC, feeds DESC, name) AS place FROM f) SELECT facet, CAST(place AS integer) AS place, name, feeds, ips FROM p WHERE place <= 3""")
    load = lambda s, d: rc.loaded_history(rc.parsed_history(b.bound(s, d, HISTORY, "orders")))
    register("loaded_history", load, f"WITH h AS ({HISTORY}), {NUMBERS} SELECT * FROM kept")
    register("public_history", lambda s, d: rc.public_history(load(s, d), 40).drop("pos"), f"WITH h AS ({HISTORY}), {NUMBERS} SELECT feed, ts, entries, unique_ips FROM (SELECT *, row_number() OVER (PARTITION BY feed ORDER BY ts DESC) AS n FROM kept) q WHERE n <= 40")
    streak = f"""WITH e AS ({RESULTS}), up AS (SELECT * FROM (SELECT *, max(ts) OVER (PARTITION BY feed ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e) q WHERE before IS NULL OR ts > before),
             l AS (SELECT feed, max(ts) FILTER (WHERE ok) AS last_ok FROM up GROUP BY feed)
             SELECT up.feed, max(ts) AS ts, count(*) FILTER (WHERE NOT ok AND (last_ok IS NULL OR ts > last_ok)) AS failures, coalesce(min(ts) FILTER (WHERE NOT ok AND (last_ok IS NULL OR ts > last_ok)), 0) AS failure_started FROM up JOIN l ON l.feed = up.feed GROUP BY up.feed"""
    register("failure_streaks", lambda s, d: rc.streaks(b.bound(s, d, RESULTS, "orders")), streak)
    register("failure_streaks_of_a_stream", _streamed_streaks, streak)
    times = """SELECT CAST(o_orderkey AS bigint) AS k, CAST(CASE o_orderkey % 7 WHEN 0 THEN -5 WHEN 1 THEN 0 WHEN 2 THEN 999999999999 ELSE 1600000000 + o_orderkey END AS bigint) AS source_date, CAST(CASE o_orderkey % 5 WHEN 0 THEN -1 WHEN 1 THEN 0 ELSE 1600000100 + o_orderkey END AS bigint) AS processed_date,
             CAST(CASE o_orderkey % 3 WHEN 0 THEN 999999999999 ELSE 1600000200 + o_orderkey END AS bigint) AS checked_date, CAST(CASE o_orderkey % 2 WHEN 0 THEN -9 ELSE 1500000000 + o_orderkey END AS bigint) AS started_date, CAST(CASE o_orderkey % 11 WHEN 0 THEN -2 WHEN 1 THEN 1600000300 ELSE 0 END AS bigint) AS failure_started,
             CAST(CASE WHEN o_orderkey % 4 < 2 THEN 1400000000 + o_orderkey END AS bigint) AS first_ts, CAST(CASE WHEN o_orderkey % 6 < 3 THEN 1650000000 + o_orderkey END AS bigint) AS latest_ts FROM orders"""
    ok = lambda c: f"CASE WHEN {c} > 0 AND {c} <= {rc.LARGEST_SECOND} THEN {c} END"
    fixed = lambda c, *by: f"CASE WHEN {c} < 0 OR {c} > {rc.LARGEST_SECOND} THEN coalesce({', '.join([*map(ok, by), '0'])}) ELSE {c} END AS {c}"
    register("repaired_times", lambda s, d: rc.repaired(b.bound(s, d, times, "orders")).drop("first_ts", "latest_ts"),
             f"""WITH a AS ({times}), s AS (SELECT * REPLACE ({fixed('source_date', 'latest_ts')}) FROM a), p AS (SELECT * REPLACE ({fixed('processed_date', 'latest_ts', 'source_date')}) FROM s),
             c AS (SELECT * REPLACE ({fixed('checked_date', 'failure_started', 'processed_date', 'source_date', 'latest_ts')}) FROM p), t AS (SELECT * REPLACE ({fixed('started_date', 'first_ts', 'source_date', 'processed_date')}) FROM c) SELECT * EXCLUDE (first_ts, latest_ts) REPLACE ({fixed('failure_started')}) FROM t""")
    register("freshness", lambda s, d: b.bound(s, d, RESULTS, "orders").groupBy("feed").agg(F.max("ts").alias("ts")).select("feed", rc.freshness(F.col("ts"), F.lit(60_000_000)).alias("freshness"), rc.skew(F.col("ts"), F.lit(500_000)).alias("skew")),
             f"WITH e AS ({RESULTS}), m AS (SELECT feed, max(ts) AS ts FROM e GROUP BY feed) SELECT feed, CASE WHEN 60000000 - ts <= 3600 THEN 'hour' WHEN 60000000 - ts <= 86400 THEN 'day' WHEN 60000000 - ts <= 604800 THEN 'week' WHEN 60000000 - ts <= 2592000 THEN 'month' ELSE 'older' END AS freshness, greatest(0, ts - 500000) AS skew FROM m")
    classes = "SELECT s_name AS feed, CASE WHEN s_suppkey % {n} = 0 THEN 'risky' ELSE 'healthy' END AS health FROM supplier WHERE s_suppkey % 9 <> {m}"
    before, after = classes.format(n=3, m=1), classes.format(n=4, m=2)
    register("health_transitions", lambda s, d: rc.transitions(b.bound(s, d, before, "supplier"), b.bound(s, d, after, "supplier")),
             f"SELECT a.feed, b.health AS from_class, a.health AS to_class FROM ({after}) a LEFT JOIN ({before}) b ON b.feed = a.feed WHERE a.health IS DISTINCT FROM b.health")
    bucket = lambda s: f"(ts + 62135596800) // {s}"
    chain = " ".join(f"WHEN {s} >= least_s AND r{i} <= 12 THEN {i}" for i, (_, s) in enumerate(rc.INTERVALS))
    pick = lambda what: "CASE i " + " ".join(f"WHEN {i} THEN {what(i)}" for i in range(6)) + " END"
    register("activity_intervals", lambda s, d: rc.chosen_interval(h.sizes(b.snapshots(s, d)), h.changesets(b.snapshots(s, d)), most=12),
             f"""WITH {RUNS}, g AS (SELECT feed, list_sort(list(gap)) AS s FROM (SELECT feed, ts - lag(ts) OVER (PARTITION BY feed ORDER BY ts) AS gap FROM hist) q WHERE gap > 0 GROUP BY feed),
             r AS (SELECT feed, {', '.join(f'count(DISTINCT {bucket(s)}) AS r{i}' for i, (_, s) in enumerate(rc.INTERVALS))} FROM chg GROUP BY feed),
             x AS (SELECT r.*, coalesce(s[len(s) // 2 + 1], 0) AS least_s FROM r LEFT JOIN g ON g.feed = r.feed), c AS (SELECT *, CASE {chain} ELSE 5 END AS i FROM x)
             SELECT feed, {pick(lambda i: f"'{rc.INTERVALS[i][0]}'")} AS interval, CAST({pick(lambda i: rc.INTERVALS[i][1])} AS bigint) AS seconds, {pick(lambda i: f'r{i}')} AS rows FROM c""")
    weekly = RUNS.replace(b.SNAPSHOTS_DUCKDB, WEEKS_DUCKDB)
    register("ledger_changes", lambda s, d: ledger.changes(s, _ledger(s, d)), f"WITH {weekly} SELECT * FROM chg")
    register("ledger_cohorts", lambda s, d: ledger.cohorts(s, _ledger(s, d)).groupBy("feed", "added_at").agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("ips")), f"WITH {weekly} SELECT feed, added_at, count(*) AS ips FROM runs WHERE removed_at IS NULL GROUP BY 1, 2")
    register("ledger_removals", lambda s, d: ledger.removals(s, _ledger(s, d)), f"WITH {weekly} SELECT feed, added_at, removed_at, count(*) AS ips, (removed_at + 1800 - added_at) // 3600 AS hours FROM runs WHERE removed_at IS NOT NULL GROUP BY 1, 2, 3")
    ips = """t AS (SELECT CAST(doc_id AS varchar) AS feed, string_split(unnest(regexp_extract_all(text, '{pattern}', 1)), '.') AS p FROM documents), n AS (SELECT DISTINCT feed, p[1]::bigint * 16777216 + p[2]::bigint * 65536 + p[3]::bigint * 256 + p[4]::bigint AS lo FROM t),
             i AS (SELECT feed, lo, lo - row_number() OVER (PARTITION BY feed ORDER BY lo) AS g FROM n WHERE lo > 0) SELECT feed, min(lo) AS lo, max(lo) AS hi FROM i GROUP BY feed, g""".replace("{pattern}", bodies.text_steps.BOUND_IPV4)
    register("document_sets", lambda s, d: bodies.prepared(b.table(s, d, "documents").selectExpr("doc_id AS key", "text AS line"), [("extract_ipv4", {})]), f"WITH {ips}")
    register("document_sets_of_a_stream", _streamed_bodies, f"WITH {ips}")
