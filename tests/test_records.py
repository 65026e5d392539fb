"""Loaded ledgers, intervals, streaks, totals by deltas and canonical bodies against plain Python."""

import random

import pytest

from rangeloom.operators import aggregates, records
from rangeloom.streaming import bodies, ledger, streaks

START = 1_600_000_000


def loaded(rows: list) -> list:
    flushed = [r for r, nxt in zip(rows, [*rows[1:], None]) if nxt is None or nxt[0] > r[0]]
    out = []
    for r in flushed:
        if not out or r[0] > out[-1][0]:
            out.append(r)
    return out


def test_history_lines_are_loaded(spark):
    rng = random.Random(1)
    times = [START + rng.randrange(40) for _ in range(60)]
    lines = [f"{t},{i},{i * 2}" for i, t in enumerate(times)]
    broken = ["DateTime,Entries,UniqueIPs", "", "1,2", f"{START},x,2", f"{START},1,-2", "946684799,1,2", "4102444801,1,2", f"{START}.5,1,2", f"{START},1,2,3"]
    rows = [("f", i, x) for i, x in enumerate([*broken, *lines[:30], *broken, *lines[30:]])] + [("g", 0, f" {START} , 7 ,8 ")]
    got = records.loaded_history(records.parsed_history(spark.createDataFrame(rows, "feed string, pos long, line string"))).collect()
    want = loaded([(t, i) for i, t in enumerate(times)])
    assert sorted((r["ts"], r["entries"]) for r in got if r["feed"] == "f") == want
    assert [(r["ts"], r["entries"], r["unique_ips"]) for r in got if r["feed"] == "g"] == [(START, 7, 8)]
    public = records.public_history(spark.createDataFrame(got), 3).where("feed = 'f'").collect()
    assert sorted(r["ts"] for r in public) == [t for t, _ in want][-3:]


def streak(events: list) -> dict:
    state: dict = {}
    for feed, pos, ts, ok in sorted(events, key=lambda e: e[1]):
        last, n, since = state.get(feed, (-1, 0, 0))
        if ts > last:
            state[feed] = (ts, 0, 0) if ok else (ts, n + 1, since if n else ts)
    return state


def test_streaks_of_a_stream_and_of_a_batch_agree_over_a_restart(spark, tmp_path):
    rng, shape = random.Random(3), "feed string, pos long, ts long, ok boolean"
    events = [(f"f{rng.randrange(4)}", i, 1000 + 10 * i - rng.choice((0, 0, 35)), rng.random() < 0.3) for i in range(90)]
    source, latest = tmp_path / "in", {}
    for part in (events[:40], events[40:]):  # the second query goes on from the state of the first
        spark.createDataFrame(part, shape).coalesce(1).write.mode("append").parquet(str(source))
        rows = streaks.follow(spark.readStream.schema(shape).parquet(str(source)))
        query = rows.writeStream.foreachBatch(lambda batch, n: latest.update({r["feed"]: tuple(r)[1:] for r in batch.collect()})).outputMode("update").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination(120)
    want = streak(events)
    assert latest == want
    assert {r["feed"]: tuple(r)[1:] for r in records.streaks(spark.createDataFrame(events, shape)).collect()} == want


def test_interval_is_the_finest_that_fits(spark):
    rng, hour = random.Random(5), 3600
    series = {"busy": hour // 2, "daily": 24 * hour, "slow": 40 * 24 * hour}
    rows = [(f, START + i * step + rng.randrange(60), 1, 1, 5) for f, step in series.items() for i in range(150)] + [("one", START, 1, 0, 5)]
    changes = spark.createDataFrame(rows, "feed string, ts long, added long, removed long, unique_ips long")
    names, tried = dict(records.INTERVALS), {}
    for f in [*series, "one"]:
        ts = sorted(r[1] for r in rows if r[0] == f)
        gaps = sorted(b - a for a, b in zip(ts, ts[1:]))
        floor = gaps[len(gaps) // 2] if gaps else 0
        fits = [n for n, s in records.INTERVALS if s >= floor and len({(t + 62135596800) // s for t in ts}) <= 100]
        tried[f] = fits[0] if fits else "1y"
    got = {r["feed"]: r for r in records.chosen_interval(changes, changes).collect()}
    assert {f: r["interval"] for f, r in got.items()} == tried
    assert all(r["seconds"] == names[r["interval"]] for r in got.values())
    assert {r["interval"] for r in records.chosen_interval(changes, changes, most=10**6, frequency_mins=24 * 60).collect()} == {"1d"}


def test_totals_by_deltas_equal_a_rebuild(spark):
    rng, shape = random.Random(7), "feed string, category string, kind string, key string, ips long"
    category = {f"f{i}": rng.choice("xyz") for i in range(12)}

    def drawn(feed: str) -> list:
        return [(feed, category[feed], kind, str(k), rng.randrange(1, 50)) for kind in ("country", "asn") for k in rng.sample(range(6), 3)] + [(feed, category[feed], "feed", feed, 9)]

    state = {f: drawn(f) for f in category}
    table = lambda rows: spark.createDataFrame([r for x in rows for r in x], shape)
    parts = aggregates.partials(table(state.values()))
    for _ in range(2):
        changed = rng.sample(sorted(category), 4)
        old = [state[f] for f in changed]
        for f in changed:
            state[f] = drawn(f)
        state[changed[0]] = []  # a feed that goes
        new = [state[f] for f in changed]
        parts = aggregates.refreshed(parts, table(old), table(new))
        rebuilt = aggregates.partials(table(state.values()))
        assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, rebuilt.collect()))
        assert aggregates.findings(parts, rebuilt).count() == 0
        flat = lambda rows: {(r[2], r[3]) for x in rows for r in x if r[2] != "feed"}
        assert {tuple(r) for r in aggregates.targets(table(old), table(new)).collect()} <= flat(old) | flat(new)


@pytest.mark.parametrize("chosen", [["x"], ["x", "z"], [], None])
def test_any_choice_of_categories_equals_the_direct_totals(spark, chosen):
    rng = random.Random(9)
    rows = [(f"f{i}", "xyz"[i % 3], kind, str(rng.randrange(5)), rng.randrange(1, 90)) for i in range(30) for kind in ("country", "asn", "maintainer")] + [(f"f{i}", "xyz"[i % 3], "feed", f"f{i}", i) for i in range(30)]
    table = spark.createDataFrame(rows, "feed string, category string, kind string, key string, ips long")
    got = aggregates.composed(aggregates.partials(table), chosen, 2).collect()
    mine = [r for r in rows if chosen is None or r[1] in chosen]
    assert next((r["feeds"], r["ips"]) for r in got if r["kind"] == "all") == (sum(r[2] == "feed" for r in mine), sum(r[4] for r in mine if r[2] == "feed"))
    for kind in ("country", "asn", "maintainer"):
        sums: dict = {}
        for r in mine:
            if r[2] == kind:
                n, ips = sums.get(r[3], (0, 0))
                sums[r[3]] = (n + 1, ips + r[4])
        want = sorted(sums.items(), key=lambda x: (-x[1][0], -x[1][1], x[0]))[:2]
        assert [(r["key"], (r["feeds"], r["ips"])) for r in sorted(got, key=lambda r: r["place"]) if r["kind"] == kind] == want


def test_bodies_of_a_stream_equal_those_of_a_batch(spark, tmp_path):
    steps = [("remove_comments", {}), ("extract_ipv4_cidr", {}), ("append_slash32", {})]
    first = [("a", "x 10.0.0.1 y 10.0.0.2\n# 9.9.9.9\n10.1.0.0/16"), ("b", "8.8.8.8")]
    second = [("b", "8.8.4.4 and 8.8.4.5"), ("c", "no address"), ("d", "0.0.0.0 7.7.7.7/0 1.2.3.4")]
    source, folder = tmp_path / "in", str(tmp_path / "sets")
    for part in (first, second):
        spark.createDataFrame(part, "key string, line string").coalesce(1).write.mode("append").parquet(str(source))
        bodies.follow(spark.readStream.schema("key string, line string").parquet(str(source)), steps, folder, str(tmp_path / "check")).awaitTermination(120)
    last = spark.createDataFrame([first[0], *second], "key string, line string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(bodies.sets(spark, folder).read()) == rows(bodies.prepared(last, steps)) != []
    assert [r["line"] for r in bodies.canonical(last, steps).where("feed = 'b'").collect()] == ["8.8.4.4/31"]
    assert bodies.segments([("trim", {}), ("parse_maxmind_proxy_fraud", {}), ("trim", {}), ("grep", {"pattern": "x"})]) == [(True, [("trim", {})]), (False, [("parse_maxmind_proxy_fraud", {})]), (True, [("trim", {}), ("grep", {"pattern": "x"})])]


def test_ledger_has_changes_and_forgets_unfinished_batches(spark, tmp_path):
    shape, folder = "feed string, ts long, lo long, hi long", str(tmp_path / "ledger")
    make = lambda rows: spark.createDataFrame(rows, shape)
    ledger.apply_batch(make([("a", 10, 1, 5), ("a", 20, 3, 9)]), 0, folder)
    for _ in range(2):  # a batch that runs again
        ledger.apply_batch(make([("a", 30, 3, 4), ("b", 30, 7, 7)]), 1, folder)
    make([("a", 40, 0, 0)]).selectExpr("feed", "ts", "1L AS added", "0L AS removed").write.parquet(f"{folder}/changes/batch=2/step=1")
    assert sorted(map(tuple, ledger.changes(spark, folder).collect())) == [("a", 10, 5, 0), ("a", 20, 4, 2), ("a", 30, 0, 5), ("b", 30, 1, 0)]
    assert sorted((r["added_at"], r["removed_at"], r["ips"]) for r in ledger.removals(spark, folder).collect()) == [(10, 20, 2), (10, 30, 1), (20, 30, 4)]
    assert sorted(map(tuple, ledger.cohorts(spark, folder).collect())) == [("a", 3, 4, 10), ("b", 7, 7, 30)]


def test_freshness_and_transitions(spark):
    before, after = spark.createDataFrame([("a", "healthy"), ("b", "risky")], "feed string, health string"), spark.createDataFrame([("a", "risky"), ("b", "risky"), ("c", "empty")], "feed string, health string")
    assert sorted(map(tuple, records.transitions(before, after).collect())) == [("a", "healthy", "risky"), ("c", None, "empty")]
    assert records.transitions(before.where("false"), after).count() == 0
    ages = spark.createDataFrame([(0,), (3600,), (3601,), (86400,), (604800,), (2592000,), (2592001,)], "age long").selectExpr("age", "1000000000 - age AS ts")
    from pyspark.sql import functions as F
    assert [r[0] for r in ages.select(records.freshness(F.col("ts"), F.lit(1_000_000_000))).collect()] == ["hour", "hour", "day", "day", "week", "month", "older"]
