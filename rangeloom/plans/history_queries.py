"""Queries over daily snapshots."""

from __future__ import annotations

from rangeloom.operators import history as h
from rangeloom.plans import bindings as b

RUNS = f"""snap AS ({b.SNAPSHOTS_DUCKDB}), num AS (SELECT feed, ts, row_number() OVER (PARTITION BY feed ORDER BY ts) AS k FROM (SELECT DISTINCT feed, ts FROM snap) q),
stay AS (SELECT feed, lo, min(ts) AS added_at, max(k) AS k_end FROM (SELECT s.feed, s.lo, s.ts, n.k, n.k - row_number() OVER (PARTITION BY s.feed, s.lo ORDER BY n.k) AS g
  FROM snap s JOIN num n ON n.feed = s.feed AND n.ts = s.ts) q GROUP BY feed, lo, g),
span AS (SELECT feed, min(ts) AS started, max(ts) AS last_ts FROM num GROUP BY feed),
runs AS (SELECT t.feed, t.lo, t.added_at, n.ts AS removed_at, started, last_ts FROM stay t JOIN span p ON p.feed = t.feed LEFT JOIN num n ON n.feed = t.feed AND n.k = t.k_end + 1),
chg AS (SELECT feed, ts, CAST(sum(a) AS bigint) AS added, CAST(sum(r) AS bigint) AS removed FROM (SELECT feed, added_at AS ts, 1 AS a, 0 AS r FROM runs
  UNION ALL SELECT feed, removed_at, 0, 1 FROM runs WHERE removed_at IS NOT NULL) q GROUP BY feed, ts),
hist AS (SELECT feed, ts, count(*) AS unique_ips, CAST(sum(CASE WHEN before = lo - 1 THEN 0 ELSE 1 END) AS bigint) AS entries FROM (SELECT feed, ts, lo, lag(lo) OVER (PARTITION BY feed, ts ORDER BY lo) AS before FROM snap) q GROUP BY feed, ts),
churn AS (SELECT c.feed, c.ts, added, removed, unique_ips, CAST(CASE WHEN removed <= unique_ips THEN unique_ips - removed ELSE 0 END AS bigint) AS kept
  FROM (SELECT *, row_number() OVER (PARTITION BY feed ORDER BY ts) AS n FROM chg WHERE added + removed > 0) c JOIN hist ON hist.feed = c.feed AND hist.ts = c.ts WHERE n > 1)"""


def _churn(s, d):
    snap = b.snapshots(s, d)
    return h.churn(h.sizes(snap), h.changesets(snap))


def register_all(register) -> None:
    on = lambda f: lambda s, d: f(b.snapshots(s, d))
    register("changesets", on(h.changesets), f"WITH {RUNS} SELECT * FROM chg")
    register("retention_past", on(h.retention_past), f"WITH {RUNS} SELECT feed, (removed_at + 1800 - added_at) // 3600 AS hours, count(*) AS ips FROM runs WHERE removed_at IS NOT NULL AND added_at > started GROUP BY 1, 2")
    register("retention_current", on(h.retention_current), f"""WITH {RUNS} SELECT feed, hours, ips, max(f) OVER (PARTITION BY feed) AS incomplete FROM (SELECT feed, (last_ts + 1800 - added_at) // 3600 AS hours, count(*) AS ips,
             CAST(max(CASE WHEN added_at <= started THEN 1 ELSE 0 END) AS integer) AS f FROM runs WHERE removed_at IS NULL GROUP BY 1, 2) q""")
    register("first_seen", on(h.first_seen), f"WITH {RUNS} SELECT feed, lo, lo AS hi, added_at AS first_seen FROM runs WHERE removed_at IS NULL")
    register("history_sizes", on(h.sizes), f"WITH {RUNS} SELECT feed, ts, entries, unique_ips FROM hist")
    register("history_stats", lambda s, d: h.history_stats(h.sizes(b.snapshots(s, d))), f"""WITH {RUNS} SELECT feed, count(*) AS versions, CAST(sum(gap) AS bigint) AS gap_total, min(gap) AS gap_min, max(gap) AS gap_max,
             min(unique_ips) AS ips_min, max(unique_ips) AS ips_max FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY feed ORDER BY ts) AS gap FROM hist) q GROUP BY feed""")
    register("churn_series", _churn, f"WITH {RUNS} SELECT * FROM churn")
    moved, turn = "(added + removed) / unique_ips", "(added + removed) / (kept + added + removed)"
    register("rotation_stats", lambda s, d: h.rotation(_churn(s, d)), f"""WITH {RUNS} SELECT feed, round(quantile_cont({moved}, 0.5), 2) AS of_size_50, round(quantile_cont({moved}, 0.75), 2) AS of_size_75,
             round(quantile_cont({turn}, 0.5), 2) AS of_turnover_50, round(quantile_cont({turn}, 0.75), 2) AS of_turnover_75 FROM churn WHERE unique_ips > 0 GROUP BY feed""")
    register("history_window_union", lambda s, d: h.window_union(b.snapshots(s, d), 7 * 86400), f"""WITH {RUNS}, w AS (SELECT DISTINCT s.feed, s.lo FROM snap s JOIN span p ON p.feed = s.feed WHERE s.ts > p.last_ts - 604800)
             SELECT feed, min(lo) AS lo, max(lo) AS hi FROM (SELECT feed, lo, lo - row_number() OVER (PARTITION BY feed ORDER BY lo) AS g FROM w) q GROUP BY feed, g""")
