"""SentencePiece encoding and decoding over a relational lattice.

White space becomes the mark ``▁`` and texts are cut into units that no piece crosses: words, and
longer runs between neighbouring characters that no piece has side by side. Texts travel as batches:
a file of the shared folder keeps each document as positions in the batch's list of distinct units,
so that no text is shuffled. Units are dealt out to buckets by their crc32, and those that a batch has of a
bucket travel as one block: sorted, front-coded, compressed, and in an order that both ends know, so that neither
positions nor batches are named for each unit. Only distinct units are encoded, each once for the whole table:

1. the substrings of a unit, up to the longest piece, are exploded and joined with the piece table; a
   long unit is cut into overlapping slices first, so that the work is linear in its length;
2. the edges found are grouped by unit, or slice of one, into its lattice;
3. each lattice is folded to its path in Arrow batches. The vocabulary holds merge ranks,
   not log-probabilities: the best path takes, at each step, the edge of best score that spans two
   neighbouring segments, leftmost first, instead of maximising the sum of the scores, which would
   give other ids than the library does. A heap holds the edges that can be taken, so the fold of a
   unit of any length is nearly linear; the higher-order ``aggregate`` was about ten times slower.

The ids return, again a block for each bucket, to the batches that have the units, and a batch puts its
documents together.

Characters that no piece has become the pieces of their UTF-8 bytes. Decoding joins pieces and
bytes back; it is exact up to ``▁`` itself, which reads as a space.

Null and empty texts have no ids and decode to an empty text. Texts, and words, of any length are
encoded whole. Repeated rows are encoded as often
as they occur, a null doc_id is carried through, other columns are ignored, whatever their names,
and an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeloom.llm.common import scratch, setting, written

MARK = "▁"
#: A run that is cut further: marks and what follows them, or one line feed.
RUN = re.compile(rf"\n|{MARK}*[^{MARK}\n]+|{MARK}+")
#: Characters of texts, and documents, that a batch holds at most before it is closed.
BATCH_CHARS, BATCH_DOCS = 8_000_000, 6_000
#: Texts that a worker takes out of an Arrow batch at once.
ROWS = 256
#: Documents for each bucket of units.
BUCKET_DOCS = 4_000
#: Unit rows that a partition of the lattice gets on average.
PARTITION = 100_000
#: Runs of more characters than this are cut at every neighbours that no piece has.
LONG = 64
#: Characters of a slice of a unit that is longer.
SLICE = 256
#: An edge is one number: start, length, order of its score, id.
LENGTH_BITS, ORDER_BITS, ID_BITS = 5, 17, 17
#: Characters that neighbours of a block are compared by, one digit says how many; how hard a block is compressed.
HEAD, DIGITS, LEVEL = 8, "012345678", 6
BATCH = "batch long, bucket int, n int, units binary"


class Vocabulary:
    """Pieces with their ids and scores, and the id of byte 0, as a model file has them."""

    def __init__(self, model_file: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        every = range(model.get_piece_size())
        self.first_byte = next(i for i in every if model.is_byte(i))
        self.pieces = [model.id_to_piece(i) for i in every]
        self.special = {i for i in every if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        self.rows = [(p, i, model.get_score(i)) for i, p in enumerate(self.pieces) if i not in self.special]
        self.longest = max(len(p) for p, _, _ in self.rows)
        self.neighbours = {p[i:i + 2] for p, _, _ in self.rows for i in range(len(p) - 1)}
        if self.longest >= 1 << LENGTH_BITS or len(self.pieces) >= 1 << ID_BITS:
            raise ValueError("the vocabulary is too large for packed edges")

    def table(self, spark: SparkSession) -> DataFrame:
        """``piece, value``: order of the score and id, packed; as many rows as the vocabulary has."""
        order = {score: i for i, score in enumerate(sorted({s for _, _, s in self.rows}, reverse=True))}
        rows = pd.DataFrame([(p, order[score] << ID_BITS | i) for p, i, score in self.rows], columns=["piece", "value"])
        return spark.createDataFrame(rows, "piece string, value long")

    def raw(self) -> list[bytes]:
        """What each id adds to a decoded text."""
        out = [b"" if i in self.special else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        out[self.first_byte:self.first_byte + 256] = [bytes([b]) for b in range(256)]
        return out


def runs_of(text: str) -> list[str]:
    """The runs of a text that no piece crosses, in order; some may be empty."""
    if "  " in text or MARK in text or text[:1] == " ":
        return RUN.findall(MARK + text.replace(" ", MARK))
    return (MARK + text.replace(" ", f" {MARK}").replace("\n", " \n ")).split(" ") if text else []


def cut(run: str, neighbours: set[str]) -> list[str]:
    """A run's units: its last character apart where no piece reaches it, and a long run between all such neighbours."""
    if len(run) > LONG:
        edges = [0, *(k for k in range(1, len(run)) if run[k - 1:k + 1] not in neighbours), len(run)]
        return [run[a:b] for a, b in zip(edges, edges[1:])]
    return [run] if run[-2:] in neighbours or len(run) < 2 else [run[:-1], run[-1]]


def shared_heads(names: list[str]) -> list[int]:
    """How many of its first characters, up to ``HEAD``, each name has in common with the one before."""
    heads = np.array(names, dtype=f"U{HEAD}").view(np.uint32).reshape(-1, HEAD)
    same = np.logical_and.accumulate(heads[1:] == heads[:-1], axis=1).sum(axis=1)
    sizes = np.fromiter(map(len, names), np.int64, len(names))  # short names are filled up with zeros, which a name may hold
    return [0, *np.minimum(same, np.minimum(sizes[1:], sizes[:-1])).tolist()]


def packed(units: list[str]) -> bytes:
    """Units as one block; a line feed is only ever a unit of its own, so it can part the others.

    Of what a unit shares with the one before only the length is kept, as the digit in front; sorted units share most.
    """
    names = ["" if u == "\n" else u for u in units]
    return zstandard.compress("\n".join([DIGITS[k] + u[k:] for k, u in zip(shared_heads(names), names)]).encode(), LEVEL)


def unpacked(block: bytes) -> list[str]:
    last, out = "", []
    for x in zstandard.decompress(block).decode().split("\n"):
        last = last[:int(x[0])] + x[1:]
        out.append(last or "\n")
    return out


def squeezed(numbers: np.ndarray) -> bytes:
    """Numbers below 2 ** 32, compressed byte by byte."""
    return zstandard.compress(np.asarray(numbers).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def numbers_of(raw: bytes) -> np.ndarray:
    found = np.frombuffer(zstandard.decompress(raw), np.uint8)
    return np.ascontiguousarray(found.reshape(4, -1).T).view("<u4").reshape(-1)


def gathered(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of ``values`` of these starts and lengths, one after the other."""
    ends = np.cumsum(lengths, dtype=np.int64)
    return values[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]


def named_by(unit: str) -> str:
    """``key_of`` of one unit."""
    return unit if len(unit) <= SLICE else hashlib.sha256(unit.encode()).hexdigest().rjust(SLICE + 1, "0")


def blocks(units: list[str], buckets: int) -> tuple[dict[int, list[str]], np.ndarray]:
    """The units of each bucket, sorted, and the place of each unit when these lists follow each other by bucket."""
    order = sorted(range(len(units)), key=units.__getitem__)
    names = [units[i] for i in order]
    dealt = np.array([zlib.crc32((u if len(u) <= SLICE else named_by(u)).encode()) for u in names], np.int64) % buckets
    by = np.argsort(dealt, kind="stable")
    places = np.zeros(len(units), np.int64)
    places[np.array(order, np.int64)[by]] = np.arange(len(units))
    found, first = np.unique(dealt[by], return_index=True)
    return {b: [names[k] for k in by[x:y].tolist()] for b, x, y in zip(found.tolist(), first, [*first[1:], len(units)])}, places


class Known(dict):
    """The runs seen by a batch, as positions in its list of units; a new run adds its own."""

    def __init__(self, neighbours: set[str]) -> None:
        super().__init__({"": ()})
        self.units, self.neighbours = {MARK: 0}, neighbours

    def __missing__(self, run: str) -> tuple[int, ...]:
        units = self.units
        found = self[run] = tuple([units.setdefault(x, len(units)) for x in cut(run, self.neighbours)])
        return found


def batches(docs: DataFrame, neighbours: set[str], folder: str, buckets: int) -> DataFrame:
    """``batch, bucket, n, units``: the distinct units of each batch of texts, n in a block for each bucket.

    The batch's documents, as positions of units, with digests of the texts to decode, are in a file
    that its number names; the number is drawn, so that a repeated attempt writes a file of its own.
    """
    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fresh() -> tuple:
            return Known(neighbours), [], [], array("i"), [], 0

        def closed() -> pa.RecordBatch:
            number = uuid.uuid4().int >> 65
            dealt, places = blocks(list(known.units), buckets)
            save(folder, number, doc_ids, sizes, codes, digests, places)
            return pa.RecordBatch.from_arrays([pa.array([number] * len(dealt), pa.int64()), pa.array(list(dealt), pa.int32()), pa.array([len(x) for x in dealt.values()], pa.int32()),
                                               pa.array([packed(x) for x in dealt.values()], pa.binary())], names=["batch", "bucket", "n", "units"])

        known, doc_ids, sizes, codes, digests, chars = fresh()
        for batch in incoming:
            texts = batch.column("text")
            for doc, text in zip(batch.column("doc_id").to_pylist(), chain.from_iterable(texts[i:i + ROWS].to_pylist() for i in range(0, len(texts), ROWS)), strict=True):
                text, before = text or "", len(codes)
                codes.extend(chain.from_iterable(map(known.__getitem__, runs_of(text))))
                doc_ids.append(doc)
                sizes.append(len(codes) - before)
                digests.append(hashlib.md5(text.replace(MARK, " ").encode()).digest())
                chars += len(text)
                if chars >= BATCH_CHARS or len(doc_ids) >= BATCH_DOCS:
                    yield closed()
                    known, doc_ids, sizes, codes, digests, chars = fresh()
        if doc_ids:
            yield closed()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, BATCH)


def save(folder: str, number: int, doc_ids: list, sizes: list[int], codes: array, digests: list[bytes], places: np.ndarray) -> None:
    """Writes a batch's documents."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    table = pa.table({"doc_ids": pa.array([doc_ids], pa.list_(pa.int64())), "sizes": pa.array([sizes], pa.list_(pa.int32())),
                      "codes": pa.array([squeezed(np.frombuffer(codes, "<u4"))], pa.binary()), "digests": pa.array([b"".join(digests)], pa.binary()),
                      "places": pa.array([squeezed(places)], pa.binary())})
    with system.open_output_stream(f"{path}/{number}") as out, pa.ipc.new_stream(out, table.schema) as stream:
        stream.write_table(table)


def load(folder: str, number: int) -> tuple[pa.Array, np.ndarray, np.ndarray, bytes]:
    """A batch's doc_ids, sizes, places of units and digests."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    with system.open_input_stream(f"{path}/{number}") as source, pa.ipc.open_stream(source) as stream:
        table = stream.read_all()
    codes = numbers_of(table["places"][0].as_py())[numbers_of(table["codes"][0].as_py())]
    return table["doc_ids"][0].values, table["sizes"][0].values.to_numpy(), codes, table["digests"][0].as_py()


def distinct_units(held: DataFrame, parts: int) -> DataFrame:
    """``unit``: each unit of the blocks once; a bucket's blocks meet in one task, which keeps the units it has seen."""
    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in incoming:
            for block in batch.column("units").to_pylist():
                new = set(unpacked(block)) - seen
                seen |= new
                yield pa.RecordBatch.from_arrays([pa.array(sorted(new), pa.string())], names=["unit"])

    return held.select("bucket", "units").repartition(parts, "bucket").mapInArrow(run, "unit string")


def key_of(unit: Column) -> Column:
    """What names a unit: itself, or a digest that is longer than any unit that names itself."""
    return F.when(F.char_length(unit) <= SLICE, unit).otherwise(F.lpad(F.sha2(unit, 256), SLICE + 1, "0"))


def lattice(units: DataFrame, vocabulary: Vocabulary, parts: int) -> DataFrame:
    """``key, at, part, edges``: the spans of two or more characters that are pieces, as packed numbers.

    A long unit is cut into slices of ``SLICE`` characters, each with what a piece could need of the
    next one, so no row grows with the length of a unit: ``at`` is where a slice starts, ``part`` its text
    (empty for a unit that is its own key). Rows of a unit go to one partition; the piece table is
    broadcast, its size is the vocabulary's. The first character's span keeps a slice without an edge.
    """
    most, unit = vocabulary.longest, F.col("unit")
    text = lambda at: F.when(F.char_length(unit) > SLICE, F.substring(unit, at + 1, F.lit(SLICE + most - 1))).otherwise("")
    slices = F.transform(F.sequence(F.lit(0), F.greatest(F.char_length(unit) - 1, F.lit(0)), F.lit(SLICE)), lambda at: F.struct(at.alias("at"), text(at).alias("part")))
    sliced = units.select(key_of(unit).alias("key"), F.explode(slices).alias("s")).select("key", "s.*").repartition(parts, "key")
    whole = F.when(F.col("part") == "", F.col("key")).otherwise(F.col("part"))
    # Two explodes of number ranges, as nested lambdas over arrays are interpreted for each span.
    starts = sliced.withColumn("n", F.char_length(whole)).select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.least(F.col("n") - 2, F.lit(SLICE - 1)), F.lit(0)))).alias("a"))
    lengths = F.explode(F.sequence(F.when(F.col("a") == 0, 1).otherwise(2), F.least(F.col("n") - F.col("a"), F.lit(most)))).alias("k")
    spans = starts.select("key", "at", "part", "a", lengths).select("key", "at", "part", (F.col("a").cast("long") * (1 << LENGTH_BITS) + F.col("k")).alias("span"))
    placed = spans.withColumn("piece", F.substring(whole, F.shiftright("span", LENGTH_BITS).cast("int") + 1, F.col("span").bitwiseAND((1 << LENGTH_BITS) - 1).cast("int")))
    edges = placed.join(F.broadcast(vocabulary.table(units.sparkSession)), "piece", "left").where("value is not null or span = 1")
    return edges.groupBy("key", "at", "part").agg(F.collect_list(F.when(F.col("span") != 1, F.shiftleft("span", ORDER_BITS + ID_BITS).bitwiseOR(F.col("value")))).alias("edges"))


def folded_short(n: int, value_of: dict[int, int]) -> list[tuple[int, int, int | None]]:
    """``folded`` for few characters: the least of a short list is found faster than a heap is kept."""
    none, ids = 1 << ORDER_BITS, (1 << ID_BITS) - 1
    order_of = {span: value >> ID_BITS for span, value in value_of.items()}
    get = order_of.get
    cuts, orders = list(range(n + 1)), [get(a << LENGTH_BITS | 2, none) for a in range(n - 1)]
    while orders and (least := min(orders)) < none:
        i = orders.index(least)
        del cuts[i + 1], orders[i]
        for k in (i - 1, i):
            if 0 <= k < len(orders):
                size = cuts[k + 2] - cuts[k]
                orders[k] = get(cuts[k] << LENGTH_BITS | size, none) if size < 1 << LENGTH_BITS else none
    return [(a, b, value_of[a << LENGTH_BITS | b - a] & ids if b - a > 1 else None) for a, b in zip(cuts, cuts[1:])]


def folded(n: int, edges: list[int]) -> list[tuple[int, int, int | None]]:
    """The path through the lattice of a unit of n characters: (start, end, id), without an id for single characters."""
    if not edges:
        return [(i, i + 1, None) for i in range(n)]
    value_of = {e >> ORDER_BITS + ID_BITS: e & ((1 << ORDER_BITS + ID_BITS) - 1) for e in edges}
    if n <= LONG:
        return folded_short(n, value_of)
    after, before, heap = list(range(1, n + 2)), list(range(-1, n)), []
    for a in range(n - 1):
        value = value_of.get(a << LENGTH_BITS | 2)
        if value is not None:
            heap.append((value >> ID_BITS, a, a + 1, a + 2))
    heapq.heapify(heap)
    alive = bytearray(b"\1") * (n + 1)
    while heap:
        _, a, mid, b = heapq.heappop(heap)
        if not alive[a] or not alive[mid] or after[a] != mid or after[mid] != b:
            continue
        alive[mid] = 0
        after[a], before[b] = b, a
        for x, y in ((a, b), (before[a], a)):
            if x >= 0 and y < n:
                end = after[y]
                value = value_of.get(x << LENGTH_BITS | end - x) if end - x < 1 << LENGTH_BITS else None
                if value is not None:
                    heapq.heappush(heap, (value >> ID_BITS, x, y, end))
    path, a = [], 0
    while a < n:
        b = after[a]
        path.append((a, b, value_of[a << LENGTH_BITS | b - a] & ((1 << ID_BITS) - 1) if b - a > 1 else None))
        a = b
    return path


def unit_ids(units: DataFrame, vocabulary: Vocabulary, parts: int, buckets: int) -> DataFrame:
    """``bucket, keys, lengths, ids`` of the distinct units: a task's units of a bucket are one block.

    A unit of several slices is folded when its partition has been read; until then its edges wait in memory.
    """
    single = {p: i for p, i, _ in vocabulary.rows if len(p) == 1}
    first_byte = vocabulary.first_byte

    def of_char(char: str) -> list[int]:
        found = single.get(char)
        return [found] if found is not None else [first_byte + x for x in char.encode()]

    def ids_of(unit: str, edges: list[int]) -> list[int]:
        ids: list[int] = []
        for a, b, found in folded(len(unit), edges):
            ids += of_char(unit[a]) if found is None else (found,)
        return ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[tuple[int, str, np.ndarray]]] = {}
        done: dict[str, list[int]] = {}
        for batch in batches:
            edges = batch.column("edges")
            flat, offsets = edges.flatten(), edges.offsets.to_pylist()
            numbers, low = flat.to_pylist(), offsets[0]
            for key, at, part, x, y in zip(batch.column("key").to_pylist(), batch.column("at").to_pylist(), batch.column("part").to_pylist(), offsets, offsets[1:]):
                if part:
                    waiting.setdefault(key, []).append((at, part, np.array(numbers[x - low:y - low], np.int64)))
                else:
                    done[key] = ids_of(key, numbers[x - low:y - low])
        for key, slices in waiting.items():
            slices.sort(key=lambda s: s[0])
            shift = LENGTH_BITS + ORDER_BITS + ID_BITS
            done[key] = ids_of("".join([part[:SLICE] for _, part, _ in slices]), [e + (at << shift) for at, _, edges in slices for e in edges.tolist()])
        for bucket, keys in blocks(list(done), buckets)[0].items():
            ids = [done[k] for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), *(pa.array([x], pa.binary()) for x in (packed(keys), squeezed(np.array([len(x) for x in ids])), squeezed(np.fromiter(chain.from_iterable(ids), np.uint32))))],
                                             names=["bucket", "keys", "lengths", "ids"])

    return lattice(units, vocabulary, parts).mapInArrow(run, "bucket int, keys binary, lengths binary, ids binary")


def answered(held: pa.Table, coded: pa.Table) -> pa.Table:
    """``batch, bucket, lengths, ids``: the ids of the units of each block of a bucket."""
    place, lengths, ids = {}, [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
    for keys, n, found in zip(*(coded.column(c).to_pylist() for c in ("keys", "lengths", "ids")), strict=True):
        place.update({k: i for i, k in enumerate(unpacked(keys), len(place))})
        lengths.append(numbers_of(n).astype(np.int64))
        ids.append(numbers_of(found))
    n, values = np.concatenate(lengths), np.concatenate(ids)
    starts = np.cumsum(n) - n
    out = []
    for block in held.column("units").to_pylist():
        at = np.array([place[named_by(u)] for u in unpacked(block)], np.int64)
        out.append((squeezed(n[at]), squeezed(gathered(values, starts[at], n[at]))))
    return pa.table({"batch": held.column("batch"), "bucket": held.column("bucket"), "lengths": pa.array([a for a, _ in out], pa.binary()), "ids": pa.array([b for _, b in out], pa.binary())})


def encode(docs: DataFrame, model_file: str) -> DataFrame:
    """``doc_id, ids, digest`` of each row of ``docs(doc_id, text)``; the digest is the text's."""
    return _encoded(docs, model_file).drop("round_trip")


def _encoded(docs: DataFrame, model_file: str, check: bool = False) -> DataFrame:
    """``encode``, and whether the ids decode to the text, null without ``check``; the ids stay in the worker for it."""
    vocabulary, folder = Vocabulary(model_file), scratch(docs.sparkSession, "piece-codes")
    buckets, raw = max(1, -(-docs.count() // BUCKET_DOCS)), vocabulary.raw() if check else []
    held = written(batches(docs, vocabulary.neighbours, folder, buckets), "piece-batches")
    rows = held.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = max(1, -(-rows // PARTITION))
    # A partition's lattices fit in memory, as PARTITION bounds their number, so grouping needs no sort.
    # What this job has shuffled is not read again, and would stay on disk until the driver collects its garbage.
    with setting(docs.sparkSession, "spark.sql.objectHashAggregate.sortBased.fallbackThreshold", str(10 * PARTITION)), \
            setting(docs.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        coded = written(unit_ids(distinct_units(held, buckets), vocabulary, parts, buckets), "piece-units")
    returned = held.groupBy("bucket").cogroup(coded.groupBy("bucket")).applyInArrow(answered, "batch long, bucket int, lengths binary, ids binary")

    def put_together(found: pa.Table) -> pa.Table:
        found = found.sort_by("bucket")
        lengths = np.concatenate([numbers_of(x) for x in found.column("lengths").to_pylist()]).astype(np.int64)
        ids = np.concatenate([numbers_of(x) for x in found.column("ids").to_pylist()])
        start = np.cumsum(lengths) - lengths
        doc_ids, sizes, codes, digests = load(folder, found.column("batch")[0].as_py())
        n = lengths[codes]
        total = np.r_[0, np.cumsum(n)]
        taken = gathered(ids, start[codes], n)
        offsets = total[np.r_[0, np.cumsum(sizes)]].astype(np.int32)
        texts = [digests[16 * i:16 * i + 16].hex() for i in range(len(sizes))]
        same = [hashlib.md5(text_of(taken[a:z].tolist(), raw).encode()).hexdigest() == x if check else None for a, z, x in zip(offsets, offsets[1:], texts)]
        return pa.table({"doc_id": doc_ids, "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(taken, pa.int32())), "digest": texts, "round_trip": pa.array(same, pa.bool_())})

    return returned.groupBy("batch").applyInArrow(put_together, "doc_id long, ids array<int>, digest string, round_trip boolean")


def text_of(ids: list[int], raw: list[bytes]) -> str:
    return b"".join([raw[i] for i in ids]).decode("utf-8", "replace")[1:]


def decoder(model_file: str):
    """A column function from ids to text."""
    raw = Vocabulary(model_file).raw()

    def run(lists: pd.Series) -> pd.Series:
        return pd.Series([None if ids is None else text_of(ids.tolist(), raw) for ids in lists], dtype=object)

    run.__annotations__ = {"lists": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")


def encode_and_check(docs: DataFrame, model_file: str) -> DataFrame:
    """``doc_id, n_ids, ids, round_trip``: the last says that the ids decode to the text."""
    return _encoded(docs, model_file, check=True).select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", "round_trip")
