"""Near-duplicate documents by an exact n-gram Jaccard join with vertical partitioning.

A document's set is its distinct shingles of five words, as 64-bit hashes. Documents with equal
sets form a class at once, by a fingerprint of the set. The classes are then joined:

1. The hash order of all shingles is cut into fragments. The scanning tasks send each fragment the
   shingles that fall into it, as compact sorted blocks with the short numbers of their classes. A fragment
   finds the shingles of two or more classes. Where classes are so many that the owners of one
   shingle could fill a task, fragments are also salted by class and their counts summed. The fragments
   get their shingles in a few rounds, each of which scans the texts again, as all shingles of a corpus
   take more than its compressed texts; what a round has shuffled goes when it ends.
2. Shingles that exactly the same classes own are one item, weighted by their number. A passage that
   many documents share is a few items, however long it is. The items are in a global order,
   rarest first.
3. A class with a partner shares at least 75 % of its shingles. Classes with fewer leave. A class
   posts the items that can be the first one it has in common with a partner: those before which
   it has no more shingles than it may miss.
4. The members of a posting list are compared with one centre each, the member whose shingles are
   the most widespread: in a group of near copies, the one nearest to their original. So a large
   group of near copies costs a star, not all pairs.
5. What a star doesn't tell are links between members that are in different components now. Lists
   where such pairs are few for each member give all of them that sizes, missed shingles and the shared
   shingles of each fragment allow. In longer lists, neighbours by set size
   are compared, which connects all that are linked by the shared items alone; and every
   member is posted again under the list's items and the next one that can be in common. So a
   long list falls into shorter ones until its pairs are few, and no link between two components is missed.
6. To compare a pair, the weights of its common items are counted in each fragment separately and summed.

Null texts count as empty. Empty sets are linked with nothing. Rows that repeat a doc_id with
different texts link their classes. A null doc_id stays null in its row and is never a component_id
unless its whole component has none. Other columns of the input are ignored by near_duplicates() and
kept by one_of_each(), whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from rangeloom.llm.common import discard, fresh, setting, written
from rangeloom.llm.components import components

WORDS, PERCENT = 5, 75
#: Shingles that a fragment holds on average, as far as the number of fragments goes.
FRAGMENT = 300_000
#: Classes of which one task may hold the owners of one shingle.
OWNERS = 2_000_000
#: Pairs between components for each member of a posting list, up to which the list looks at them all.
FEW = 500
#: Fragments of the item order by which the overlap of a pair is bounded before it is counted.
BOUNDS = 16
#: Documents of a scanned batch whose shingles a task sorts at a time.
PART = 4_000
#: Hash ranges in which a pair's overlap is counted separately (a power of two).
COUNT_BITS = 3
#: Rounds in which the fragments get their shingles, at most (a power of two).
ROUNDS_BITS = 2
#: Bytes of a text that are hashed at a time, and of a word up to which its bytes are summed.
PIECE, WORD = 1 << 16, 32
_P, _Q, _M = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0xD1342543DE82EF95)
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _powers(base: int) -> np.ndarray:
    return np.multiply.accumulate(np.r_[np.uint64(1), np.full(PIECE, base, np.uint64)])


class Shingler:
    """Sorted distinct shingle hashes of texts.

    A word is hashed as the sum of a random number for each byte, times a power by its place: differences of
    running sums, so that all words of a text are hashed at once. Longer words are hashed one by one.
    """

    def __init__(self, width: int = WORDS) -> None:
        self.width = width
        self.power, self.inverse = _powers(int(_M)), _powers(pow(int(_M), -1, 1 << 64))
        lower = np.frombuffer(bytes(range(256)).lower(), np.uint8)
        self.byte = np.array([xxhash.xxh3_64_intdigest(bytes([b])) for b in lower], np.uint64)

    def words(self, text: str | None) -> np.ndarray:
        """The hash of each word."""
        data = (text or "").encode("utf-8", "surrogatepass")
        raw = np.frombuffer(data, np.uint8)
        edges = np.flatnonzero(np.diff(_BLANK[raw], prepend=True, append=True))
        starts, ends = edges[::2], edges[1::2]
        h, at = np.zeros(len(starts), np.uint64), 0
        while at < len(starts):
            base = starts[at]
            to = max(at + 1, int(np.searchsorted(ends, base + PIECE, "right")))
            if ends[to - 1] - base <= PIECE:
                piece = raw[base:ends[to - 1]]
                sums = np.zeros(len(piece) + 1, np.uint64)
                np.cumsum(self.byte[piece] * self.power[:len(piece)], out=sums[1:])
                h[at:to] = (sums[ends[at:to] - base] - sums[starts[at:to] - base]) * self.inverse[starts[at:to] - base]
            at = to
        for i in np.flatnonzero(ends - starts > WORD):
            h[i] = xxhash.xxh3_64_intdigest(data[starts[i]:ends[i]].lower())
        return (h ^ (h >> np.uint64(32))) * _Q

    def of(self, text: str | None) -> np.ndarray:
        h = self.words(text)
        if not len(h):
            return h
        width = min(self.width, len(h))
        out = np.full(len(h) - width + 1, width, np.uint64)
        for j in range(width):
            out = (out ^ h[j:len(h) - width + 1 + j]) * _P
            out ^= out >> np.uint64(29)
        out = (out * _Q) ^ (out >> np.uint64(32))
        out.sort()
        return out[np.r_[True, out[1:] != out[:-1]]]


def fingerprint(s: np.ndarray) -> int:
    """A signed 64-bit fingerprint of a set."""
    x = xxhash.xxh3_64_intdigest(s.astype("<u8").tobytes(), seed=len(s) & 0xFFFF)
    return x - (1 << 64) if x >= 1 << 63 else x


def document_sets(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, class`` of each document; the class of an empty set is null."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            sets = [shingler.of(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([fingerprint(s) if len(s) else None for s in sets], pa.int64())],
                names=["doc_id", "n_shingles", "class"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, class long")


def packed(values: np.ndarray) -> tuple[bytes, int]:
    """Ascending numbers as differences of the fewest bytes that hold them all: (bytes, bytes each)."""
    return narrow(np.diff(values, prepend=np.uint64(0)))


def unpacked(data: bytes, width: int) -> np.ndarray:
    return np.cumsum(widened(data, width), dtype=np.uint64)


#: Bits of a class's short number, and the classes up to which those are enough to keep most apart.
SHORT_BITS, SHORT_CLASSES = 32, 1 << 24


def short_bits(classes: int) -> int:
    """Bits of short numbers, so that of some classes about one in 250 at most has the bits of another."""
    return SHORT_BITS if classes <= SHORT_CLASSES else SHORT_BITS + 8


def short_number(name: Column, bits: int) -> Column:
    return F.shiftrightunsigned(name, 64 - bits)


def numbered(classes: DataFrame, bits: int) -> tuple[DataFrame, dict[int, int]]:
    """The classes with a number ``no`` of their own, the first bits of the name, and the numbers of those that have others' bits.

    These few, about the square of the classes over ``2 ** bits``, get numbers above all short ones.
    """
    short = classes.withColumn("no", short_number(F.col("class"), bits))
    clashing = short.join(short.groupBy("no").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("no"), "no", "left_semi").select("class")
    other = {r["class"]: (1 << bits) + i for i, r in enumerate(clashing.orderBy("class").toLocalIterator())}
    if not other:
        return short, other
    given = F.broadcast(classes.sparkSession.createDataFrame(list(other.items()), "class long, given long"))
    return short.join(given, "class", "left").withColumn("no", F.coalesce("given", "no")).drop("given"), other


BLOCK = "fragment int, salt int, width int, hashes binary, owner_width int, owners binary"


def narrow(values: np.ndarray) -> tuple[bytes, int]:
    """Numbers in the fewest bytes that hold them all: (bytes, bytes each)."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8)
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes(), width


def widened(data: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, width)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :width] = raw
    return wide.reshape(-1).view("<u8")


def blocks(docs: DataFrame, bits: int, salts: int, short: int, other: dict[int, int], turn: int = 0, turn_bits: int = 0) -> DataFrame:
    """The shingles of each scanned batch, by fragment and salt: sorted hashes, and for each its owner's number.

    Only hashes whose first ``turn_bits`` bits are ``turn``; at most ``bits``, so that a fragment is in one round.
    A number costs the same few bytes whatever the number of fragments; names of 64 bits that a block lists
    once are shared by ever fewer shingles the more fragments there are.
    """
    names = [x.split()[0] for x in BLOCK.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.binary()]
    least, most = (np.uint64(turn << 64 - turn_bits), np.uint64((turn + 1 << 64 - turn_bits) - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            for at in range(0, batch.num_rows, PART):
                sets = {}
                for text in batch.column("text").slice(at, PART).to_pylist():
                    s = shingler.of(text)
                    if len(s):
                        name = fingerprint(s)
                        s = s[np.searchsorted(s, least):np.searchsorted(s, most, "right")].copy()
                    if len(s):
                        sets[other.get(name, (name & (1 << 64) - 1) >> 64 - short)] = s
                for salt in range(salts):
                    rows = _cut([(c, s) for c, s in sets.items() if c % salts == salt], bits, salt)
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return docs.select("text").mapInArrow(run, BLOCK)


def _cut(sets: list[tuple[int, np.ndarray]], bits: int, salt: int) -> list[tuple]:
    """Rows of blocks() for the sets of some classes."""
    if not sets:
        return []
    hashes = np.concatenate([s for _, s in sets])
    owners = np.repeat(np.array([c for c, _ in sets], np.uint64), [len(s) for _, s in sets])
    order = np.argsort(hashes)
    hashes, owners = hashes[order], owners[order]
    at = hashes >> np.uint64(64 - bits) if bits else np.zeros(len(hashes), np.uint64)
    edges, rows = np.flatnonzero(np.diff(at, prepend=at[0])).tolist(), []
    for a, b in zip([0, *edges], [*edges, len(at)], strict=True):
        base = at[a] << np.uint64(64 - bits) if bits else np.uint64(0)
        data, width = packed(hashes[a:b] - base)
        numbers, owner_width = narrow(owners[a:b])
        rows.append((int(at[a]), salt, width, data, owner_width, numbers))
    return rows


def mixed(classes: np.ndarray) -> np.ndarray:
    """Scrambled class numbers: their exclusive or stands for a set of classes."""
    with np.errstate(over="ignore"):
        x = classes.view(np.uint64) * _P
        x ^= x >> np.uint64(31)
        x *= _Q
        return (x ^ (x >> np.uint64(29))).view(np.int64)


def shared_shingles(docs: DataFrame, bits: int, salts: int, short: int, other: dict[int, int], turn: int, turn_bits: int) -> DataFrame:
    """``class, item, df`` of every shingle of two or more classes in a round, by their numbers: a written table.

    ``df`` is the number of its classes; with their fingerprint it names the item.
    """
    def count(key: tuple, found: pd.DataFrame) -> pd.DataFrame:
        base = np.uint64(key[0]) << np.uint64(64 - bits) if bits else np.uint64(0)
        hashes, classes = [], []
        for width, data, owner_width, owners in zip(found["width"], found["hashes"], found["owner_width"], found["owners"], strict=True):
            hashes.append(unpacked(data, width) + base)
            classes.append(widened(owners, owner_width).view(np.int64))
        h, c = np.concatenate(hashes), np.concatenate(classes)
        del hashes, classes
        if salts == 1:  # a shingle that occurs once is nobody's partner; with salts, others may have it
            order = np.argsort(h)
            h, c = h[order], c[order]
            runs = np.diff(np.r_[np.flatnonzero(np.r_[True, h[1:] != h[:-1]]), len(h)])
            several = np.repeat(runs > 1, runs)
            h, c = h[several], c[several]
        order = np.lexsort((c, h))
        h, c = h[order], c[order]
        if not len(h):
            return pd.DataFrame({"class": c, "h": h.view(np.int64), "df": c, "owners": c})
        new = np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])]
        h, c = h[new], c[new]
        start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        runs = np.diff(np.r_[start, len(h)])
        owners = np.repeat(np.bitwise_xor.reduceat(mixed(c), start), runs)
        df = np.repeat(runs, runs)
        keep = df > (1 if salts == 1 else 0)
        return pd.DataFrame({"class": c[keep], "h": h[keep].view(np.int64), "df": df[keep].astype(np.int64), "owners": owners[keep]})

    found = blocks(docs, bits, salts, short, other, turn, turn_bits).groupBy("fragment", "salt").applyInPandas(count, "class long, h long, df long, owners long")
    items = ["class", F.xxhash64("df", "owners").alias("item"), "df"]
    if salts == 1:
        return written(found.select(*items), "shared")
    counted = written(found, "salted")
    salt = F.pmod("class", F.lit(salts))
    first = counted.groupBy("h", salt.alias("salt")).agg(F.max("df").alias("df"), F.max("owners").alias("owners"))
    whole = first.groupBy("h").agg(F.sum("df").alias("df"), F.bit_xor("owners").alias("owners")).where("df > 1")
    out = written(counted.select("class", "h").join(whole, "h").select(*items), "shared")
    discard(counted)
    return out


def linked(overlap: Column, n: Column, m: Column) -> Column:
    return 100 * overlap >= PERCENT * (n + m - overlap)


def compared(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """The pairs ``(a, n_a, b, n_b)`` that are similar enough: common weights counted by fragment, then summed."""
    cut = pairs.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit((1 << COUNT_BITS) - 1))))
    left = segments.select(F.col("class").alias("a"), "part", F.col("items").alias("items_a"))
    right = segments.select(F.col("class").alias("b"), "part", F.col("items").alias("items_b"))
    common = F.aggregate(F.array_intersect("items_a", "items_b"), F.lit(0).cast("long"), lambda total, x: total + x["w"])
    counted = (cut.join(left, ["a", "part"]).join(right, ["b", "part"]).select("a", "b", "n_a", "n_b", common.alias("partial"))
               .groupBy("a", "b", "n_a", "n_b").agg(F.sum("partial").alias("overlap")))
    return counted.where(linked(F.col("overlap"), F.col("n_a"), F.col("n_b"))).select("a", "b")


def least_overlap(n: Column, m: Column) -> Column:
    """Shingles that two sets of these sizes must have in common to be linked."""
    return F.ceil(PERCENT * (n + m) / F.lit(100.0 + PERCENT))


def may_miss(n: Column) -> Column:
    """Shingles of a set that a partner need not have, at most."""
    return n - F.ceil(n * PERCENT / 100)


def candidates(x: str, y: str) -> Column:
    """Whether two posted rows (structs of class, n, s, missed, f) can belong to a linked pair.

    Neither may have missed too much so far, and in no fragment can they have more in common than the
    one with fewer shared shingles in it has.
    """
    o = least_overlap(F.col(f"{x}.n"), F.col(f"{y}.n"))
    seen = F.least(*(F.col(f"{z}.n") - F.col(f"{z}.missed") for z in (x, y)), F.col(f"{x}.s"), F.col(f"{y}.s")) >= o
    bound = sum((F.least(F.col(f"{x}.f.f{i}"), F.col(f"{y}.f.f{i}")) for i in range(1, BOUNDS)), F.least(F.col(f"{x}.f.f0"), F.col(f"{y}.f.f0")))
    return seen & (bound >= o)


def named(x: str, y: str) -> list[Column]:
    """The pair of two structs, the smaller class first."""
    turned = F.col(f"{x}.class") < F.col(f"{y}.class")
    pick = lambda field, first: F.when(turned == first, F.col(f"{x}.{field}")).otherwise(F.col(f"{y}.{field}"))
    return [pick("class", True).alias("a"), pick("n", True).alias("n_a"), pick("class", False).alias("b"), pick("n", False).alias("n_b")]


def between_components(posted: DataFrame, items: DataFrame, few: int) -> DataFrame:
    """``a, n_a, b, n_b``: the candidates between components, by lists that are cut until their pairs are few.

    ``posted`` has ``key, r, x, place``: the list, the member's component, the member, and the place of
    the list's last item in the order of the member's items, ``items(class, place, item, w, before)``.
    """
    found = []
    pairs = lambda kept: (kept.join(kept.where("r != top").select("key", F.col("x").alias("y"), F.col("r").alias("r_y")), "key")
                          .where((F.col("r") != F.col("r_y")) & candidates("x", "y")).select(*named("x", "y")).distinct())
    while True:
        per_root = posted.groupBy("key", "r").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("x.n", "x", "r")).alias("least"))
        lists = (per_root.groupBy("key").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k")).alias("same"), F.max(F.struct("k", "r")).alias("top"), F.min("least").alias("least"))
                 .select("key", "k", ((F.col("k") * F.col("k") - F.col("same")) / 2).alias("pairs"), F.col("top.r").alias("top"), "least").where("pairs > 0"))
        alive = written(posted.join(lists, "key"), "lists")
        # One of two members of different components is outside the largest one.
        found.append(written(pairs(alive.where(F.col("pairs") <= few * F.col("k"))), "pairs"))
        long = alive.where(F.col("pairs") > few * F.col("k"))
        if long.isEmpty():
            break
        # The next item in common: what lies between is missed.
        onward = items.select(F.col("class").alias("_c"), F.col("place").alias("_p"), "item", "w", "before")
        missed = F.col("before") - F.col("x.before") - F.col("x.w") + F.col("x.missed")
        again = (long.join(onward, (F.col("x.class") == F.col("_c")) & (F.col("_p") > F.col("place"))).where(missed <= may_miss(F.col("x.n")))
                 .select(F.col("key").alias("parent"), F.xxhash64("key", "item").alias("key"), "r", F.struct("x.class", "x.n", "x.s", missed.alias("missed"), "before", "w", "x.f").alias("x"), F.col("_p").alias("place")))
        again = written(again, "posted")
        # A list is cut only where that leaves far fewer rows than it has pairs.
        grown = again.groupBy("parent").agg(F.count(F.lit(1)).alias("rows")).withColumnRenamed("parent", "key")
        weighed = written(long.join(grown, "key", "left").withColumn("cut", F.col("pairs") > 2 * few * (F.col("k") + F.coalesce("rows", F.lit(0)))), "lists")
        found.append(written(pairs(weighed.where("not cut")), "pairs"))
        cut = weighed.where("cut")
        # Members that the items so far link to any other are linked to the smallest set by them.
        star = cut.where(F.col("r") != F.col("least.r")).withColumn("y", F.col("least.x"))
        found.append(written(star.where(candidates("x", "y")).select(*named("x", "y")).distinct(), "pairs"))
        posted = again.join(cut.select(F.col("key").alias("parent")).distinct(), "parent", "left_semi").drop("parent")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def class_links(docs: DataFrame, classes: DataFrame, bits: int, salts: int, few: int, short: int, other: dict[int, int]) -> DataFrame:
    """``node, root`` of the classes that have a partner; ``classes`` has their numbers as ``class``."""
    turn_bits = min(ROUNDS_BITS, bits)
    rounds = [shared_shingles(docs, bits, salts, short, other, turn, turn_bits) for turn in range(1 << turn_bits)]
    weighed = written(reduce(DataFrame.unionByName, rounds).groupBy("class", "item", "df").agg(F.count(F.lit(1)).alias("w")), "weights")
    discard(*rounds)
    place = F.pmod("item", F.lit(BOUNDS))
    inside = [F.sum(F.when(place == i, F.col("w")).otherwise(0)).cast("int").alias(f"f{i}") for i in range(BOUNDS)]
    alive = (weighed.groupBy("class").agg(F.sum("w").alias("s"), F.sum(F.col("df") * F.col("w")).alias("spread"), *inside)
             .select("class", "s", "spread", F.struct(*(f"f{i}" for i in range(BOUNDS))).alias("f")).join(classes.select("class", F.col("n_shingles").alias("n")), "class")
             .where(100 * F.col("s") >= PERCENT * F.col("n")))
    # Items rarest first; the unshared shingles of a class come before all of them.
    order = Window.partitionBy("class").orderBy("df", "item")
    placed = weighed.join(alive, "class").withColumn("place", F.row_number().over(order)).withColumn("before", F.sum("w").over(order) - F.col("w") + F.col("n") - F.col("s"))
    items = written(placed.select("class", "place", "item", "w", "before", "n", "s", "f", (F.col("spread") / F.col("n")).alias("centrality")), "items")
    discard(weighed)
    part = F.shiftrightunsigned("item", 64 - COUNT_BITS).cast("int")
    segments = written(items.groupBy("class", part.alias("part")).agg(F.collect_list(F.struct("item", "w")).alias("items")), "segments")
    posted = items.where(F.col("before") <= may_miss(F.col("n"))).select(
        F.col("item").alias("key"), F.struct("class", "n", "s", F.col("before").alias("missed"), "before", "w", "f").alias("x"), "place", "centrality")
    centres = (posted.groupBy("key").agg(F.max(F.struct("centrality", "x")).alias("centre"), F.count(F.lit(1)).alias("k")).where("k > 1").select("key", F.col("centre.x").alias("c")))
    posted = written(posted.drop("centrality").join(centres, "key"), "posted")

    first = written(posted.where((F.col("x.class") != F.col("c.class")) & candidates("x", "c")).select(*named("x", "c")).distinct(), "pairs")
    links = written(compared(first, segments), "found")
    roots = components(links)
    rooted = posted.withColumn("class", F.col("x.class")).join(roots.withColumnRenamed("node", "class"), "class", "left").select("key", F.coalesce("root", "class").alias("r"), "x", "place")
    again = between_components(rooted, items, few).join(first.select("a", "b"), ["a", "b"], "left_anti")
    more = written(compared(again, segments), "found")
    discard(items, segments, posted)
    return roots if more.isEmpty() else components(links.unionByName(more))


def near_duplicates(docs: DataFrame, fragment: int = FRAGMENT, owners: int = OWNERS, few: int = FEW) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of each row of ``docs(doc_id, text)``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = written(document_sets(docs), "sets")
    classes = written(sets.where("class is not null").groupBy("class").agg(F.max("n_shingles").alias("n_shingles"), F.min("doc_id").alias("rep")), "classes")
    size = classes.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)).alias("shingles"), F.count(F.lit(1)).alias("classes")).first()
    salts = max(1, -(-size["classes"] // owners))
    bits = max(0, int(np.ceil(np.log2(max(1, size["shingles"] / fragment / salts)))))
    short = short_bits(size["classes"])
    classes, other = numbered(classes, short)
    # What a step has shuffled is not read again once its table is written, and would stay until the driver collects its garbage.
    with setting(docs.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        roots = class_links(docs, classes.select(F.col("no").alias("class"), "n_shingles"), bits, salts, few, short, other)
    # A doc_id with several rows of different texts ties their classes together.
    several = sets.where("class is not null").groupBy("doc_id").agg(F.min("class").alias("a"), F.max("class").alias("b")).where("a != b and doc_id is not null")
    if not several.isEmpty():
        number = classes.select("class", F.col("no").alias("b"))
        tied = (sets.where("class is not null").join(several.select("doc_id", F.col("a").alias("_a")), "doc_id").select("_a", "class").join(number, "class").drop("class")
                .join(classes.select(F.col("class").alias("_a"), F.col("no").alias("a")), "_a").select("a", "b"))
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(tied))
    grouped = classes.join(roots.withColumnRenamed("node", "no"), "no", "left").select("class", "rep", F.coalesce("root", "no").alias("root"))
    least = grouped.groupBy("root").agg(F.min("rep").alias("component"))
    of_class = written(grouped.join(least, "root").select("class", "component"), "components")
    return sets.join(of_class, "class", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents whose id names their own component: one of each group of near duplicates.

    Of rows that repeat such an id one stays. Rows without an id stay, as nothing can name them.
    """
    found = near_duplicates(docs.select("doc_id", "text")).where("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"))
    (named_id,) = fresh(docs, "_kept")
    found = written(found, "kept").select(F.col("doc_id").alias(named_id), F.col("rows").alias(f"{named_id}_rows"))
    matched = docs["doc_id"].cast("long") == F.col(named_id)
    kept = docs.join(found.where(F.col(f"{named_id}_rows") == 1), matched, "left_semi").unionByName(docs.where("doc_id is null"))
    repeated = found.where(F.col(f"{named_id}_rows") > 1)
    return kept if repeated.isEmpty() else kept.unionByName(docs.join(repeated, matched, "left_semi").dropDuplicates(["doc_id"]))
