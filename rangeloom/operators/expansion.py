"""A catalog with its derived feeds: retention windows and merges become feeds of their own.

``sources`` has ``feed, frequency_mins, redistributable, history`` (a list of window lengths in minutes) and
``reference`` (no set of its own); ``merges`` has ``feed, sources, exclude`` (lists of names), ``frequency_mins,
redistributable, history``. Windows of sources come first, so that merges can use them; windows of merges last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rangeloom.operators import lineage

NAMES = "array<string>"


def window_label(minutes: Column) -> Column:
    """``_7d``, ``_1d12h`` or ``_6h``."""
    days, rest = F.floor(minutes / 1440), F.pmod(minutes, F.lit(1440))
    hours = F.floor(rest / 60).cast("string")
    return F.when(minutes < 1440, F.concat(F.lit("_"), hours, F.lit("h"))).when(rest == 0, F.concat(F.lit("_"), days.cast("string"), F.lit("d"))).otherwise(F.concat(F.lit("_"), days.cast("string"), F.lit("d"), hours, F.lit("h")))


def cleaned(names: Column) -> Column:
    """The names of a list without outer white space; empty ones go."""
    return F.filter(F.transform(F.coalesce(names, F.array().cast(NAMES)), lambda x: F.trim(x)), lambda x: x != "")


def windows(parents: DataFrame) -> DataFrame:
    """A feed for each window of parents that make sets: it has no cadence of its own, and its parent's rights."""
    each = parents.where("not reference").select(F.col("feed").alias("parent"), "redistributable", F.explode("history").alias("window_mins")).where("window_mins > 0")
    return each.select(F.concat("parent", window_label(F.col("window_mins"))).alias("feed"), F.lit("secondary_retention").alias("provenance"), F.lit(0).cast("long").alias("frequency_mins"), "redistributable",
                       F.array("parent").alias("additive"), F.array().cast(NAMES).alias("subtracted"), F.col("window_mins").cast("long").alias("window_mins"))


def expanded(sources: DataFrame, merges: DataFrame, every_mins: int = 60) -> DataFrame:
    """``feed, provenance, frequency_mins, redistributable, additive, subtracted, window_mins`` of every feed, derived ones included.

    A merge without a frequency has ``every_mins``. Its rights are its own and those of everything it is made of or
    subtracts.
    """
    own = sources.select("feed", F.lit("primary").alias("provenance"), F.col("frequency_mins").cast("long").alias("frequency_mins"), "redistributable", F.array().cast(NAMES).alias("additive"), F.array().cast(NAMES).alias("subtracted"), F.lit(None).cast("long").alias("window_mins"))
    frequency = F.when(F.coalesce("frequency_mins", F.lit(0)) > 0, F.col("frequency_mins")).otherwise(F.lit(every_mins)).cast("long")
    made = merges.select("feed", F.lit("secondary_merge").alias("provenance"), frequency.alias("frequency_mins"), "redistributable", cleaned(F.col("sources")).alias("additive"), cleaned(F.col("exclude")).alias("subtracted"), F.lit(None).cast("long").alias("window_mins"))
    parents = merges.select("feed", "redistributable", "history", F.lit(False).alias("reference"))
    every = own.unionByName(windows(sources)).unionByName(made).unionByName(windows(parents))
    rights = lineage.redistributable(every.select("feed", "redistributable"), edges(every)).withColumnRenamed("redistributable", "passed_on")
    return every.join(rights, "feed").withColumn("redistributable", F.col("passed_on")).drop("passed_on")


def edges(catalog: DataFrame) -> DataFrame:
    """``feed, parent, additive`` of an expanded catalog."""
    one = lambda c, flag: catalog.select("feed", F.explode(c).alias("parent"), F.lit(flag).alias("additive"))
    return one("additive", True).unionByName(one("subtracted", False))


def problems(sources: DataFrame, merges: DataFrame) -> DataFrame:
    """``feed, problem`` of a catalog that can't be expanded.

    A name that is made twice, a merge of nothing or of a name twice or on both sides, names that nothing has,
    windows of what makes no set, and feeds that lead into themselves.
    """
    refs = merges.select("feed", cleaned(F.col("sources")).alias("plus"), cleaned(F.col("exclude")).alias("minus"))
    named = sources.select("feed").unionByName(windows(sources).select("feed")).unionByName(merges.select("feed")).unionByName(windows(merges.select("feed", "redistributable", "history", F.lit(False).alias("reference"))).select("feed"))
    say = lambda rows, text: rows.select("feed", F.lit(text).alias("problem"))
    linked = refs.select("feed", F.explode(F.concat("plus", "minus")).alias("parent"))
    found = [say(named.groupBy("feed").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "name made twice"), say(refs.where("size(plus) = 0"), "no sources"),
             say(refs.where("size(plus) <> size(array_distinct(plus)) or size(minus) <> size(array_distinct(minus))"), "name listed twice"), say(refs.where("arrays_overlap(plus, minus)"), "name on both sides"),
             say(linked.join(named.select(F.col("feed").alias("parent")).distinct(), "parent", "left_anti").select("feed").distinct(), "unknown name"),
             say(sources.where("reference and size(history) > 0"), "windows of no set"), say(lineage.cycles(linked.withColumn("additive", F.lit(True))), "cycle")]
    out = found[0]
    for rows in found[1:]:
        out = out.unionByName(rows)
    return out


def compositions(catalog: DataFrame, states: DataFrame) -> DataFrame:
    """``feed, input, role, part`` of each merge of an expanded catalog: what it is made of just now.

    ``states`` has ``feed, enabled, health``. A part is ``included``, ``subtracted`` or ``excluded``: inputs that are
    disabled, archived or unmaintained, subtracted ones that are disabled, archived or unavailable, and unknown ones.
    """
    merges = edges(catalog.where("provenance = 'secondary_merge'")).select("feed", F.col("parent").alias("input"), F.when(F.col("additive"), "include").otherwise("exclude").alias("role"))
    known = merges.join(states.select(F.col("feed").alias("input"), "enabled", "health"), "input", "left")
    barred = F.when(F.col("role") == "include", F.col("health").isin("archived", "unmaintained")).otherwise(F.col("health").isin("archived", "unavailable"))
    lost = ~F.coalesce("enabled", F.lit(False)) | F.coalesce(barred, F.lit(False))
    return known.select("feed", "input", "role", F.when(lost, "excluded").when(F.col("role") == "include", "included").otherwise("subtracted").alias("part"))


#: Fixed value: minutes until a feed is looked at again that is never due by itself.
FAR_MINS = 365 * 24 * 60


def next_due(entries: DataFrame, now: Column) -> DataFrame:
    """``feed, due, state`` of ``entries(feed, frequency_mins, checked_date, failures, unmaintained, archived)``, in seconds.

    A frequency over 30 minutes is stretched by a hundredth, by 10 minutes at most; after failures the retry delay
    counts instead. What was never checked is due now, and archived feeds, or checked ones without a cadence, in a year.
    """
    from rangeloom.operators.feeds import retry_mins
    from rangeloom.operators.records import LARGEST_SECOND

    every = F.greatest(F.col("frequency_mins"), F.lit(1))
    pad = F.when(every <= 30, 0).otherwise(F.least(F.floor((every + 50) / 100), F.lit(10)))
    wait = F.when(F.col("failures") > 0, retry_mins(every, F.col("failures"), F.col("unmaintained"))).otherwise(every + pad)
    checked = F.when((F.col("checked_date") > 0) & (F.col("checked_date") <= LARGEST_SECOND), F.col("checked_date"))
    at, far = checked + wait * 60, now + FAR_MINS * 60
    state = (F.when(F.col("archived"), "archived").when((F.col("frequency_mins") == 0) & (F.coalesce("checked_date", F.lit(0)) != 0), "static").when(checked.isNull(), "never checked")
             .when(now < at, F.when(F.col("failures") > 0, "retry").otherwise("waiting")).otherwise(F.when(F.col("failures") > 0, "retry due").otherwise("due")))
    due = F.when(state.isin("archived", "static"), far).when(state.isin("retry", "waiting"), at).otherwise(now).cast("long")
    return entries.select("feed", due.alias("due"), state.alias("state"))


def public(feeds: DataFrame) -> DataFrame:
    """Feeds that are shown: neither hidden nor tables of countries or networks."""
    return feeds.where("not hidden and not reference")


def downloadable(feeds: DataFrame) -> DataFrame:
    """Public feeds whose body may be passed on: redistributable, if nothing else is said, and not archived."""
    return public(feeds).where("coalesce(redistributable, true) and health <> 'archived'")


def composable(feeds: DataFrame, wanted: DataFrame) -> DataFrame:
    """``feed, reason`` of the names in ``wanted(feed)`` that a public composition may not use."""
    known = feeds.select("feed", F.lit(True).alias("known"), (~F.col("hidden") & ~F.col("reference")).alias("shown"), F.coalesce("redistributable", F.lit(True)).alias("free"), "health")
    reason = F.when(F.col("known").isNull() | ~F.col("shown"), "unknown").when(~F.col("free"), "not redistributable").when(F.col("health") == "archived", "archived")
    return wanted.select("feed").distinct().join(known, "feed", "left").select("feed", reason.alias("reason")).where("reason is not null")


def filter_options(feeds: DataFrame, *columns: str) -> DataFrame:
    """``filter, place, value``: the values that each filter can take, sorted; empty ones are none."""
    each = feeds.select(F.explode(F.array(*(F.struct(F.lit(c).alias("filter"), F.col(c).cast("string").alias("value")) for c in columns))).alias("o")).select("o.*")
    distinct = each.where("value is not null and value <> ''").distinct()
    return distinct.withColumn("place", F.row_number().over(Window.partitionBy("filter").orderBy("value"))).select("filter", "place", "value")
