"""Proofs and the pair ledger against the exact comparison."""

import random

from rangeloom.operators import intervals as iv
from rangeloom.operators import pairs
from rangeloom.sources.versions import VersionedTable

SHAPE = "feed string, lo long, hi long"


def ranges(spark, feeds: dict):
    return iv.optimize(spark.createDataFrame([(f, a, z) for f, rows in feeds.items() for a, z in rows], SHAPE))


def table(rows) -> set:
    return {(r["name1"], r["name2"], r["ips1"], r["ips2"], r["common"]) for r in rows}


def test_updates_recompute_what_changed_only(spark, tmp_path):
    rng = random.Random(6)
    draw = lambda low: [(x, x + rng.randrange(300)) for x in (low + rng.randrange(200_000) for _ in range(40))]
    feeds = {"a": draw(0), "b": draw(0), "c": draw(100_000), "d": draw(1 << 31)}
    feeds["e"] = list(feeds["a"])
    ledger = pairs.PairLedger(spark, str(tmp_path / "ledger"))
    first = ledger.update(ranges(spark, feeds), ranges(spark, feeds)).collect()
    assert table(first) == table(iv.compare(ranges(spark, feeds)).collect())
    assert {r["outcome"] for r in first if "d" in (r["name1"], r["name2"])} == {"bounds"} and next(r for r in first if (r["name1"], r["name2"]) == ("a", "e"))["outcome"] == "identical"
    was = feeds["b"]
    feeds["b"] = draw(50_000)
    second = ledger.update(ranges(spark, {"b": feeds["b"]}), ranges(spark, feeds)).collect()
    assert table(second) == table(iv.compare(ranges(spark, feeds)).collect())
    assert {r["outcome"] == "ledger" for r in second if "b" not in (r["name1"], r["name2"])} == {True}
    assert "ledger" not in {r["outcome"] for r in second if "b" in (r["name1"], r["name2"])}
    del feeds["c"]
    feeds["z"] = feeds.pop("a")
    third = ledger.update(ranges(spark, {"z": feeds["z"]}), ranges(spark, feeds), gone=("a", "c")).collect()
    assert table(third) == table(iv.compare(ranges(spark, feeds)).collect()) and {r["outcome"] for r in third} == {"ledger"}
    feeds["b"] = was
    assert table(ledger.update(ranges(spark, {"b": was}), ranges(spark, feeds)).collect()) == table(iv.compare(ranges(spark, feeds)).collect())
    assert len(ledger.pairs.versions()) == 2


def test_every_proof_is_right_and_leaves_ranges_unread(spark):
    rng = random.Random(8)
    feeds = {f"f{i}": [(x, x + rng.randrange(1 << rng.choice((2, 9, 13)))) for x in (rng.randrange(1 << 22) for _ in range(rng.choice((1, 4, 60))))] for i in range(14)}
    every = ranges(spark, feeds)
    planned = pairs.plan(pairs.signatures(every), pairs.coverage(every), spark.createDataFrame([], pairs.LEDGER))
    exact = {(r["name1"], r["name2"]): r["common"] for r in iv.compare(every).collect()}
    rows = planned.collect()
    assert len(rows) == 14 * 13 // 2
    proved = [r for r in rows if r["outcome"] != "exact"]
    assert {r["outcome"] for r in proved} >= {"fine", "bounds"} and all(r["common"] == exact[r["name1"], r["name2"]] for r in proved)
    assert {(r["name1"], r["name2"]): r["common"] for r in pairs.settled(planned, every).collect()} == exact


def test_no_feeds_and_one(spark, tmp_path):
    ledger = pairs.PairLedger(spark, str(tmp_path / "ledger"))
    none = spark.createDataFrame([], SHAPE)
    assert ledger.update(none, none).count() == 0
    one = ranges(spark, {"a": [(1, 2)]})
    assert ledger.update(one, one).count() == 0 and ledger.signed.read().count() == 1


def test_published_rows(spark):
    shape = "feed string, name string, common long"
    old, fresh = spark.createDataFrame([("a", "b", 5), ("a", "c", 7), ("b", "a", 5)], shape), spark.createDataFrame([("a", "b", 0), ("a", "d", 2)], shape)
    assert {tuple(r) for r in pairs.merged_rows(old, fresh).collect()} == {("a", "c", 7), ("b", "a", 5), ("a", "d", 2)}


def test_versions_are_named_and_expire(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), "x long")
    assert t.read().count() == 0
    for i in range(4):
        assert [r["x"] for r in t.replace(spark.createDataFrame([(i,)], "x long")).collect()] == [i]
    spark.createDataFrame([(9,)], "x long").write.parquet(str(tmp_path / "t" / "data" / "unnamed"))
    assert [r["x"] for r in t.read().collect()] == [3] and [r["x"] for r in t.read(before=3).collect()] == [2]
    assert [n for n, _ in t.versions()] == [2, 3] and len(list((tmp_path / "t" / "data").iterdir())) == 3
    assert [r["x"] for r in t.replace(spark.createDataFrame([(8,)], "x long"), number=3).collect()] == [8] and len(t.versions()) == 2
