"""Downloaded bodies to canonical sets, in one call or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rangeloom.operators import intervals as iv
from rangeloom.operators import text_steps
from rangeloom.sources import text
from rangeloom.sources.versions import VersionedTable

SETS = "feed string, lo long, hi long"
#: Steps that compare lines of a body with each other, which a stream can't do row by row.
GROUPED = frozenset({"parse_maxmind_proxy_fraud"})


def segments(steps: list[tuple[str, dict]]) -> list[tuple[bool, list[tuple[str, dict]]]]:
    """The steps cut where rows of a body must come together: (whether a stream can run them row by row, steps)."""
    out: list[tuple[bool, list]] = []
    for step in steps:
        streamable = step[0] not in GROUPED
        if out and out[-1][0] == streamable:
            out[-1][1].append(step)
        else:
            out.append((streamable, [step]))
    return out


def prepared(bodies: DataFrame, steps: list[tuple[str, dict]], **parse) -> DataFrame:
    """``feed, lo, hi``: the coalesced ranges of bodies ``key, line`` (a body in each row) after the steps.

    Lines that are left are cleaned, those of no address and blocks of everything dropped, and the rest parsed.
    """
    done = text_steps.run(bodies, [*steps, ("split_lines", {}), ("sanitize", {}), ("filter_invalid4", {})])
    return iv.optimize(text.ranges(text.lines(done.select(F.col("key").cast("string").alias("key"), F.col("line").alias("body"))), **parse))


def canonical(bodies: DataFrame, steps: list[tuple[str, dict]], single: bool = False, **parse) -> DataFrame:
    """``feed, lo, line``: the canonical lines of each body, single addresses or blocks."""
    return iv.body(prepared(bodies, steps, **parse), single)


def sets(spark: SparkSession, folder: str) -> VersionedTable:
    return VersionedTable(spark, folder, SETS)


def follow(bodies: DataFrame, steps: list[tuple[str, dict]], folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keeps the sets of the feeds whose bodies ``key, line`` arrive; a body arrives whole, as one row.

    Leading steps run on the stream, row by row; the rest, and parsing, on each micro-batch. A feed in the
    batch gets its new set, others stay; one whose body has no usable line keeps the set it had. A batch
    that runs again writes the same version again.
    """
    parts = segments(steps)
    ahead = parts[0][1] if parts and parts[0][0] else []
    rest = steps[len(ahead):]

    def apply(batch: DataFrame, number: int) -> None:
        table = sets(batch.sparkSession, folder)
        new = prepared(batch, rest).persist()
        try:
            old = table.read(before=number).join(new.select("feed").distinct(), "feed", "left_anti")
            table.replace(old.unionByName(new), number)
        finally:
            new.unpersist()

    running = text_steps.run(bodies.select(F.col("key").cast("string").alias("key"), "line"), ahead)
    return running.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
