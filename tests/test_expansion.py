"""Derived feeds of small catalogs, their problems, and when feeds are due."""

from pyspark.sql import functions as F

from rangeloom.operators import expansion, feeds

SOURCES = "feed string, frequency_mins long, redistributable boolean, history array<int>, reference boolean"
MERGES = "feed string, sources array<string>, exclude array<string>, frequency_mins long, redistributable boolean, history array<int>"


def catalog(spark):
    sources = spark.createDataFrame([("a", 30, None, [1440, 90, 0, -5], False), ("b", 0, False, None, False), ("geo", 60, True, [60], True)], SOURCES)
    merges = spark.createDataFrame([("m", [" a ", "", "a_1d"], ["b"], 0, None, [2160]), ("n", ["a"], None, 5, True, None)], MERGES)
    return sources, merges


def test_windows_and_merges_become_feeds(spark):
    got = {r["feed"]: r for r in expansion.expanded(*catalog(spark)).collect()}
    assert set(got) == {"a", "b", "geo", "a_1d", "a_1h", "m", "m_1d12h", "n"}
    assert (got["m"]["additive"], got["m"]["subtracted"], got["m"]["frequency_mins"], got["n"]["frequency_mins"], got["a_1d"]["frequency_mins"]) == (["a", "a_1d"], ["b"], 60, 5, 0)
    assert (got["m_1d12h"]["additive"], got["m_1d12h"]["window_mins"], got["m_1d12h"]["provenance"]) == (["m"], 2160, "secondary_retention")
    assert {f: r["redistributable"] for f, r in got.items()} == {"a": True, "b": False, "geo": True, "a_1d": True, "a_1h": True, "m": False, "m_1d12h": False, "n": True}


def test_problems(spark):
    sources, merges = catalog(spark)
    odd = spark.createDataFrame([("a_1d", ["b"], None, 0, None, None), ("e", [" "], None, 0, None, None), ("t", ["a", "a"], ["x"], 0, None, None), ("s", ["a"], ["a"], 0, None, None), ("p", ["q"], None, 0, None, None), ("q", ["a"], ["p"], 0, None, None)], MERGES)
    got = {tuple(r) for r in expansion.problems(sources, odd).collect()}
    assert got == {("a_1d", "name made twice"), ("e", "no sources"), ("t", "name listed twice"), ("t", "unknown name"), ("s", "name on both sides"), ("p", "cycle"), ("q", "cycle"), ("geo", "windows of no set")}
    assert {tuple(r) for r in expansion.problems(sources, merges).collect()} == {("geo", "windows of no set")}


def waited(every: int, failures: int, unmaintained: bool) -> int:
    """The delay by doubling, step by step."""
    every = max(every, 1)
    if failures < 1:
        return every
    delay = -(-every // 16)
    for _ in range(1, failures):
        if delay >= feeds.RETRY_CAP:
            return feeds.RETRY_CAP
        delay *= 2
        if not unmaintained and delay >= every:
            return every
    return min(delay, feeds.RETRY_CAP) if unmaintained else min(delay, every, feeds.RETRY_CAP)


def test_retry_delays_equal_the_loop(spark):
    rows = [(e, n, u) for e in (0, 1, 7, 15, 16, 17, 100, 1440, 43200, 50_000, 100_000, 300_000, 800_000) for n in range(0, 12) for u in (False, True)]
    df = spark.createDataFrame(rows, "e long, n long, u boolean").select("*", feeds.retry_mins(F.col("e"), F.col("n"), F.col("u")).alias("got"))
    assert {(r["e"], r["n"], r["u"]): r["got"] for r in df.collect()} == {r: waited(*r) for r in rows}


def test_when_feeds_are_due(spark):
    now, shape = 1_700_000_000, "feed string, frequency_mins long, checked_date long, failures long, unmaintained boolean, archived boolean"
    rows = [("new", 60, 0, 0, False, False), ("bad", 60, -4, 0, False, False), ("once", 0, 0, 0, False, False), ("static", 0, 5, 0, False, False), ("gone", 60, 5, 3, True, True), ("short", 30, now - 60, 0, False, False), ("long", 200, now - 60, 0, False, False), ("late", 10, now - 6000, 0, False, False), ("retry", 160, now - 60, 2, False, False)]
    got = {r["feed"]: (r["due"] - now, r["state"]) for r in expansion.next_due(spark.createDataFrame(rows, shape), F.lit(now)).collect()}
    year = expansion.FAR_MINS * 60
    assert got == {"new": (0, "never checked"), "bad": (0, "never checked"), "once": (0, "never checked"), "static": (year, "static"), "gone": (year, "archived"), "short": (29 * 60, "waiting"), "long": (201 * 60, "waiting"), "late": (0, "due"), "retry": (19 * 60, "retry")}


def test_composition_of_a_merge(spark):
    states = spark.createDataFrame([("a", True, "healthy"), ("a_1d", True, "archived"), ("b", True, "unmaintained")], "feed string, enabled boolean, health string")
    got = {tuple(r) for r in expansion.compositions(expansion.expanded(*catalog(spark)), states).collect()}
    assert got == {("m", "a", "include", "included"), ("m", "a_1d", "include", "excluded"), ("m", "b", "exclude", "subtracted"), ("n", "a", "include", "included")}
