"""Quality rules by robust multivariate outliers, in DataFrame operations only.

Base rules reject very short and very repetitive texts. The method then describes every remaining
document by a vector of transformed statistics, estimates centre and scatter of the vectors of each
(lang, source) by the minimum covariance determinant, and rejects a document whose Mahalanobis
distance from its own group is beyond ``CUTOFF``.

The estimate starts three times: from coordinate-wise medians with quartile ranges, from the same medians
with the least deviations, and from the plain mean and covariance. Each start repeats concentration steps: the
``SHARE`` of rows nearest to the present centre, by the present scatter, gives the next one. After two
steps a group goes on with the start of the least determinant, until the determinant falls no more. Distances are
cut on a logarithmic grid, and vectors are fixed-point numbers whose sums
are exact, so results don't depend on the order of rows. Groups are only ever aggregated, so a
group may hold any share of the rows; the tables of groups are broadcast where their size is checked.

Null texts have no words. Null lang and source form groups of their own. Groups with fewer than
``LEAST_ROWS`` vectors are judged by the estimate of all vectors of their lang, and where these are
fewer too, by that of all vectors. Only a corpus with fewer in all has nothing to judge by.
Every row is judged by its own text, so rows that repeat a doc_id or have none get results of their
own; equal texts of one group get equal ones, and a distance of exactly ``CUTOFF`` is kept. Other columns
of the input are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rangeloom.llm.common import sized, written

SHARE, LEAST_ROWS = 0.75, 40
#: Concentration steps of all starts, and of the best one at most; a fall of the log determinant that still counts.
FIRST_STEPS, STEPS, FALL = 2, 20, 1e-3
#: Squared distance beyond which a vector is an outlier: about three times the 99.9 % quantile of
#: chi-square with five degrees of freedom (20.5), as counts of symbols and repeats have heavier tails than normal ones.
CUTOFF = 60.0
#: Fixed-point steps of a unit.
GRID = 256
#: Columns of the transformed vector, each with its least standard deviation. Most documents have no
#: symbols, repeated lines or repeated words at all; the floor says how much of them is ordinary.
VECTOR = {"v_words": 0.3, "v_chars": 0.15, "v_symbols": 0.5, "v_lines": 0.8, "v_repeats": 0.6}
FLOORS = [deviation ** 2 for deviation in VECTOR.values()]
WORD = r"[^\x20\x09-\x0D]+"


def statistics(docs: DataFrame) -> DataFrame:
    """The base statistics of each document, with its group columns."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    split = docs.select("doc_id", "lang", "source", text.alias("text")).withColumn("words", F.expr(rf"regexp_extract_all(text, '{WORD}', 0)".replace("\\", "\\\\")))
    n = F.size("words")
    window = F.transform(F.sequence(F.lit(1), n - 4), lambda i: F.xxhash64(*(F.get("words", i + j) for j in range(-1, 4))))
    lines = F.filter(F.split("text", "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    counted = (split.withColumn("w5", F.when(n >= 5, window).otherwise(F.array().cast("array<bigint>")))
               .withColumn("lines", lines)
               .withColumn("n_words", n.cast("long"))
               .withColumn("word_chars", F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")).cast("long"))
               .withColumn("n_symbols", (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long"))
               .withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")))
    # Positions of windows that occur twice or more, from the windows sorted by hash and position.
    ordered = F.sort_array(F.transform("w5", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda k: F.coalesce(F.get("o", k)["h"] == F.get("o", k + 1)["h"], F.lit(False))
    twice = F.sort_array(F.transform(F.filter(F.transform("o", lambda x, k: F.struct(x["i"].alias("i"), ((k > 0) & same(k - 1) | same(k)).alias("t"))), lambda x: x["t"]), lambda x: x["i"]))
    covered = F.aggregate("p", F.struct(F.lit(0).alias("n"), F.lit(-5).alias("last")), lambda a, x: F.struct((a["n"] + F.least(F.lit(5), x - a["last"])).alias("n"), x.alias("last")))["n"]
    repeated = F.size("w5") > F.size(F.array_distinct("w5"))
    return (counted.withColumn("o", F.when(repeated, ordered)).withColumn("p", F.when(repeated, twice))
            .withColumn("n_repeat_words", F.coalesce(F.when(repeated, covered), F.lit(0)).cast("long"))
            .select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.size("lines").cast("long").alias("n_lines")))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def vectors(stats: DataFrame) -> DataFrame:
    """The statistics with their transformed vector, in fixed point."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    fixed = lambda c: F.round(c * GRID) / GRID
    return stats.withColumns({
        "v_words": fixed(F.log1p("n_words")),
        "v_chars": fixed(4 * F.log1p(F.col("word_chars") / words)),
        "v_symbols": fixed(8 * F.sqrt(F.col("n_symbols") / words)),
        "v_lines": fixed(8 * F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)))),
        "v_repeats": fixed(8 * F.sqrt(F.col("n_repeat_words") / words)),
    })


def _squared_distance(values: list[Column], d: int) -> Column:
    """Mahalanobis distance by forward substitution with the group's Cholesky factor (columns m_i, l_i_j)."""
    z: list[Column] = []
    for i in range(d):
        rest = values[i] - F.col(f"m_{i}")
        for j in range(i):
            rest = rest - F.col(f"l_{i}_{j}") * z[j]
        z.append(rest / F.col(f"l_{i}_{i}"))
    return sum((x * x for x in z[1:]), z[0] * z[0])


def _with_cholesky(groups: DataFrame, d: int) -> DataFrame:
    """Adds the lower Cholesky factor of the covariances in columns c_i_j."""
    for j in range(d):
        for i in range(j, d):
            s = F.col(f"c_{i}_{j}")
            for k in range(j):
                s = s - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            groups = groups.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(s, F.lit(FLOORS[j] / 4))) if i == j else s / F.col(f"l_{j}_{j}"))
    return groups


def _estimate(rows: DataFrame, keys: list[str], d: int, inflate: Column) -> DataFrame:
    """Centre and inflated Cholesky factor of each group's rows."""
    names = list(VECTOR)
    sums = [F.count(F.lit(1)).alias("n"), *(F.sum(v).alias(f"s_{i}") for i, v in enumerate(VECTOR)),
            *(F.sum(F.col(names[i]) * F.col(names[j])).alias(f"q_{i}_{j}") for i in range(d) for j in range(i + 1))]
    moments = rows.groupBy(*keys).agg(*sums)
    covariance = lambda i, j: (F.col(f"q_{i}_{j}") - F.col(f"s_{i}") * F.col(f"s_{j}") / F.col("n")) / F.col("n") * inflate
    moments = moments.select(*keys, "n", *((F.col(f"s_{i}") / F.col("n")).alias(f"m_{i}") for i in range(d)),
                             *((F.greatest(covariance(i, j), F.lit(FLOORS[i])) if i == j else covariance(i, j)).alias(f"c_{i}_{j}") for i in range(d) for j in range(i + 1)))
    factor = _with_cholesky(moments, d).select(*keys, *(f"m_{i}" for i in range(d)), *(f"l_{i}_{j}" for i in range(d) for j in range(i + 1)))
    return factor.withColumn("logdet", 2 * sum((F.log(f"l_{i}_{i}") for i in range(1, d)), F.log("l_0_0")))


#: An estimate's key: 0 for a (lang, source), 1 for a lang, 2 for all rows.
KEYS = ["level", "e_lang", "e_source"]


def _key(level: int) -> Column:
    """The key that a (g_lang, g_source) has at a level."""
    return F.struct(F.lit(level).alias("level"), (F.col("g_lang") if level < 2 else F.lit("")).alias("e_lang"), (F.col("g_source") if level < 1 else F.lit("")).alias("e_source"))


def judges(rows: DataFrame) -> DataFrame:
    """``g_lang, g_source`` with the key of the estimate that judges the group: the finest with LEAST_ROWS vectors."""
    sizes = rows.groupBy("g_lang", "g_source").agg(F.count(F.lit(1)).alias("n"))
    at = lambda level: sizes.groupBy(_key(level).alias("key")).agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_ROWS)
    enough = at(0).unionByName(at(1)).unionByName(at(2)).select("key")
    asked = sizes.select("g_lang", "g_source", F.explode(F.array(*(_key(level) for level in range(3)))).alias("key"))
    return asked.join(enough, "key").groupBy("g_lang", "g_source").agg(F.min("key").alias("key")).select("g_lang", "g_source", "key.*")


def concentrated(rows: DataFrame, groups: DataFrame, keys: list[str], share: float) -> DataFrame:
    """One concentration step: the estimates of the ``share`` of each group's rows that are nearest by the given ones."""
    d, of = len(VECTOR), [*keys, "start"]
    # A normal sample's share of nearest rows has a smaller scatter; the factor puts it back (chi-square of 5 degrees, as a table).
    inflate = F.lit({0.5: 2.03, 0.75: 1.42, 0.9: 1.17}.get(share, 1.0))
    near = rows.join(sized(groups.drop("logdet")), keys).withColumn("bin", F.floor(F.log2(_squared_distance([F.col(v) for v in VECTOR], d) + 2.0 ** -10) * 32).cast("int"))
    per_bin = near.groupBy(*of, "bin").agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy(*of)
    cut = (per_bin.withColumn("below", F.sum("k").over(w.orderBy("bin"))).withColumn("all", F.sum("k").over(w))
           .where(F.col("below") >= F.ceil(F.col("all") * share)).groupBy(*of).agg(F.min("bin").alias("cut")))
    cut = sized(written(cut, "mcd"))
    return written(_estimate(near.join(cut, of).where("bin <= cut").select(*of, *VECTOR), of, d, inflate), "mcd")


def scatter(rows: DataFrame, share: float = SHARE, steps: int = STEPS) -> DataFrame:
    """Robust centre and scatter for each (g_lang, g_source): columns m_i and l_i_j, a row per group.

    Every table here but ``rows`` has a row per group or estimate, and is written after every step.
    """
    keys, d = KEYS, len(VECTOR)
    judged_by = written(judges(rows), "mcd")
    asked = written(judged_by.select(*keys).distinct(), "mcd")
    rows = rows.select(*VECTOR, F.explode(F.array(*(_key(level) for level in range(3)))).alias("key")).select("key.*", *VECTOR).join(sized(asked), keys, "left_semi")
    quartiles = rows.groupBy(*keys).agg(*(F.percentile(v, F.lit([0.25, 0.5, 0.75])).alias(f"q_{i}") for i, v in enumerate(VECTOR)))
    wide = lambda i: F.greatest((F.get(f"q_{i}", F.lit(2)) - F.get(f"q_{i}", F.lit(0))) / 1.349, F.lit(FLOORS[i] ** 0.5))

    def medians(start: int, deviation) -> DataFrame:
        return quartiles.select(*keys, F.lit(start).alias("start"), *(F.get(f"q_{i}", F.lit(1)).alias(f"m_{i}") for i in range(d)),
                                *((deviation(i) if i == j else F.lit(0.0)).alias(f"l_{i}_{j}") for i in range(d) for j in range(i + 1)))

    plain = _estimate(rows, keys, d, F.lit(1.0)).drop("logdet").withColumn("start", F.lit(2))
    starts = medians(0, wide).unionByName(medians(1, lambda i: F.lit(FLOORS[i] ** 0.5))).unionByName(plain)
    groups = written(starts.withColumn("logdet", F.lit(float("inf"))), "mcd")
    for step in range(steps):
        new = concentrated(rows, groups, keys, share)
        was = groups.select(*keys, "start", F.col("logdet").alias("was"))
        still = new.join(was, [*keys, "start"]).where(F.col("was") - F.col("logdet") > FALL)
        moved = not still.isEmpty()
        if step + 1 == FIRST_STEPS:
            best = new.groupBy(*keys).agg(F.min_by(F.struct(*new.drop(*keys).columns), F.struct("logdet", "start")).alias("best"))
            new = written(best.select(*keys, "best.*"), "mcd")
        groups = new
        if not moved and step + 1 >= FIRST_STEPS:
            break
    return written(judged_by.join(groups, keys).drop(*keys, "start", "logdet"), "mcd")


def verdicts(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """The statistics of each document with ``base_failed``, ``distance`` and ``kept``.

    ``distance`` is null for base failures and for documents of a corpus too small to judge.
    """
    missing = "\x00"
    stats = written(vectors(statistics(docs)).withColumn("base_failed", base_failed())
                    .withColumns({"g_lang": F.coalesce("lang", F.lit(missing)), "g_source": F.coalesce("source", F.lit(missing))}).drop("lang", "source"), "quality-stats")
    groups = scatter(stats.where("not base_failed").select("g_lang", "g_source", *VECTOR))
    distance = F.when(~F.col("base_failed"), _squared_distance([F.col(v) for v in VECTOR], len(VECTOR)))
    judged = stats.join(sized(groups), ["g_lang", "g_source"], "left").withColumn("distance", distance)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff)).alias("kept"), "distance")
