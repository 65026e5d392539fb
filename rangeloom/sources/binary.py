"""Binary files of range sets: text header, byte-order mark, records of two bounds.

The header has the format's own first line, which readers and writers are told, then a line that says
whether the ranges are optimized, and lines with the record size, the number of records, the bytes that
follow, the source lines and the unique addresses. Files of IPv6 ranges have a line ``ipv6`` after the
first one, and bounds of two 64-bit halves. A file is one feed, named after it.

Reading is a data source of Spark: a file is cut into runs of records that tasks read by byte range, so
that a large set is read by many tasks, and only headers are opened before that.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from rangeloom.operators import intervals as iv

# The byte-order mark, the names of the header's numbers in their order, and the family line of IPv6.
MARK = 0x1A2B3C4D
NUMBERS = ("record size", "records", "bytes", "lines", "unique ips")
FAMILY6 = b"ipv6"
# End of fixed values.

#: Bytes that hold any header, and records that a task reads unless it is told otherwise.
HEAD, RECORDS = 1000, 1_000_000
RANGES4 = "feed string, lo long, hi long"
ADDRESS6 = "struct<h:decimal(20,0),l:decimal(20,0)>"
RANGES6 = f"feed string, lo {ADDRESS6}, hi {ADDRESS6}"


@dataclass(frozen=True)
class Header:
    """What the first bytes of a file say; ``start`` is where the byte-order mark is."""

    family: int
    optimized: bool
    numbers: dict[str, int]
    start: int

    @property
    def width(self) -> int:
        return 8 if self.family == 4 else 32


def header(head: bytes, magic: str) -> Header:
    """The header in a file's first bytes; an error for any other file."""
    rows = head[:HEAD].split(b"\n", len(NUMBERS) + 3)
    if rows[0].decode("utf-8", "replace") != magic:
        raise ValueError("not a binary range file of this format")
    family = 6 if rows[1:2] == [FAMILY6] else 4
    rows = rows[1 + (family == 6):]
    if len(rows) < len(NUMBERS) + 2 or rows[0] not in (b"optimized", b"non-optimized"):
        raise ValueError("the header is cut short or has no optimization mark")
    numbers = {}
    for name, row in zip(NUMBERS, rows[1:], strict=False):
        label, _, value = row.decode("utf-8", "replace").rpartition(" ")
        if label != name or not value.isdigit():
            raise ValueError(f"expected the number {name!r} in the header")
        numbers[name] = int(value)
    size = 8 if family == 4 else 32
    if numbers["record size"] != size or numbers["bytes"] != numbers["records"] * size + 4:
        raise ValueError("the sizes in the header contradict each other")
    if numbers["unique ips"] < numbers["records"] or numbers["lines"] < numbers["records"]:
        raise ValueError("the counters in the header contradict each other")
    start = len(magic.encode()) + 1 + (len(FAMILY6) + 1) * (family == 6) + sum(len(r) + 1 for r in rows[:len(NUMBERS) + 1])
    return Header(family, rows[0] == b"optimized", numbers, start)


def order_of(mark: bytes) -> str:
    """Whether numbers are little or big-endian, as the four bytes of the mark say."""
    for order, name in (("<", "little"), (">", "big")):
        if int.from_bytes(mark, name) == MARK:
            return order
    raise ValueError("the byte-order mark is unknown")


def halves(values: np.ndarray) -> pa.Array:
    """Pairs of 64-bit halves as a column of addresses."""
    columns = [pa.array([Decimal(int(x)) for x in values[:, k]], pa.decimal128(20, 0)) for k in (0, 1)]
    return pa.StructArray.from_arrays(columns, ["h", "l"])


def batch_of(feed: str, payload: bytes, order: str, family: int) -> pa.RecordBatch:
    """The ranges of a run of records."""
    if family == 4:
        pairs = np.frombuffer(payload, f"{order}u4").astype(np.int64).reshape(-1, 2)
        wrong, bounds = (pairs[:, 0] > pairs[:, 1]).any(), [pa.array(pairs[:, 0]), pa.array(pairs[:, 1])]
    else:
        rows = np.frombuffer(payload, f"{order}u8").reshape(-1, 4)
        wrong = ((rows[:, 0] > rows[:, 2]) | ((rows[:, 0] == rows[:, 2]) & (rows[:, 1] > rows[:, 3]))).any()
        bounds = [halves(rows[:, :2]), halves(rows[:, 2:])]
    if wrong:
        raise ValueError("a range ends before it starts")
    return pa.RecordBatch.from_arrays([pa.array([feed] * len(bounds[0])), *bounds], names=["feed", "lo", "hi"])


def feed_of(path: str) -> str:
    """A file's name without its endings."""
    return path.rstrip("/").rpartition("/")[2].partition(".")[0]


def opened(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def files_of(uri: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files at a path or right below it."""
    from pyarrow import fs

    system, path = opened(uri)
    info = system.get_file_info(path)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name[:1] not in "._")


@dataclass
class Records(InputPartition):
    """Records from ``first`` on of a file, whose payload starts at byte ``start``."""

    path: str
    start: int
    first: int
    count: int

    def __init__(self, path: str, start: int, first: int, count: int) -> None:
        super().__init__((path, first))
        self.path, self.start, self.first, self.count = path, start, first, count


class RangeReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.magic = options["path"], options["magic"]
        self.family, self.records = int(options.get("family", 4)), int(options.get("records", RECORDS))

    def partitions(self) -> list[Records]:
        system, out = opened(self.path)[0], []
        for path, size in files_of(self.path):
            if not size:
                continue  # an empty set
            with system.open_input_file(path) as f:
                head = header(f.read_at(min(HEAD, size), 0), self.magic)
            if head.family != self.family:
                raise ValueError(f"IPv{head.family} ranges where IPv{self.family} ones are read")
            if size != head.start + head.numbers["bytes"]:
                raise ValueError("the payload is cut short or goes on after its end")
            out += [Records(path, head.start, k, min(self.records, head.numbers["records"] - k)) for k in range(0, head.numbers["records"], self.records)]
        return out

    def read(self, partition: Records) -> Iterator[pa.RecordBatch]:
        width = 8 if self.family == 4 else 32
        with opened(self.path)[0].open_input_file(partition.path) as f:
            order = order_of(f.read_at(4, partition.start))
            for at in range(partition.first, partition.first + partition.count, 65_536):
                n = min(65_536, partition.first + partition.count - at)
                yield batch_of(feed_of(partition.path), f.read_at(n * width, partition.start + 4 + at * width), order, self.family)


class RangeFiles(DataSource):
    """``spark.read.format("rangefiles")`` with the options path, magic, family (4 or 6) and records."""

    @classmethod
    def name(cls) -> str:
        return "rangefiles"

    def schema(self) -> str:
        return RANGES4 if int(self.options.get("family", 4)) == 4 else RANGES6

    def reader(self, schema) -> RangeReader:
        return RangeReader(dict(self.options))


def uri(path: str) -> str:
    return path if "://" in path else f"file://{path}"


def read(spark: SparkSession, path: str, magic: str, family: int = 4, records: int = RECORDS) -> DataFrame:
    """``feed, lo, hi`` of the binary files at a path; ``records`` go to one task."""
    spark.dataSource.register(RangeFiles)
    return spark.read.format("rangefiles").options(path=uri(path), magic=magic, family=str(family), records=str(records)).load()


def verified(ranges: DataFrame, found: DataFrame) -> DataFrame:
    """``feed, problem`` of the IPv4 files whose ranges don't keep what their headers, as ``metadata`` has them, say."""
    counted = ranges.groupBy("feed").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("hi") - F.col("lo") + 1).alias("ips"))
    joined = found.join(counted, "feed", "left")
    problem = F.when(F.coalesce("n", F.lit(0)) != F.col("records"), "records").when(F.col("optimized") & (F.coalesce("ips", F.lit(0)).cast("string") != F.col("unique_ips")), "unique ips")
    return joined.select("feed", problem.alias("problem")).where("problem is not null")


def metadata(spark: SparkSession, path: str, magic: str) -> DataFrame:
    """``feed, family, optimized, records, lines, unique_ips`` (as text, it may have 39 digits): of each file only the bytes of its header are read."""
    where = uri(path)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system = opened(where)[0]
        for frame in frames:
            found = []
            for name, size in zip(frame["name"], frame["size"], strict=True):
                with system.open_input_file(name) as f:
                    h = header(f.read_at(min(HEAD, int(size)), 0), magic)
                found.append((feed_of(name), h.family, h.optimized, h.numbers["records"], h.numbers["lines"], str(h.numbers["unique ips"])))
            yield pd.DataFrame(found, columns=["feed", "family", "optimized", "records", "lines", "unique_ips"])

    files = spark.createDataFrame([f for f in files_of(where) if f[1]], "name string, size long")
    return files.repartition(max(1, min(spark.sparkContext.defaultParallelism, 1 + len(files_of(where)) // 8))).mapInPandas(run, "feed string, family int, optimized boolean, records long, lines long, unique_ips string")


def head_of(magic: str, family: int, records: int, lines: int, unique: int) -> bytes:
    width = 8 if family == 4 else 32
    values = (width, records, records * width + 4, max(lines, records), unique)
    text = [magic, *([FAMILY6.decode()] if family == 6 else []), "optimized", *(f"{n} {v}" for n, v in zip(NUMBERS, values, strict=True))]
    return "\n".join(text).encode() + b"\n" + np.array([MARK], "<u4").tobytes()


def payload_of(batch: pa.RecordBatch, family: int) -> bytes:
    """The records of a batch with the columns lo and hi."""
    if family == 4:
        return np.c_[batch.column("lo").to_numpy(), batch.column("hi").to_numpy()].astype("<u4").tobytes()
    parts = [batch.column(c).field(k) for c in ("lo", "hi") for k in (0, 1)]
    return np.array([[int(x) for x in p.to_pylist()] for p in parts], "<u8").T.tobytes() if batch.num_rows else b""


def write(optimized: DataFrame, folder: str, magic: str, family: int = 4) -> DataFrame:
    """Writes a file for each feed of ``feed, lo, hi`` below a shared folder; ``feed, path, bytes`` of what was written.

    A file holds one feed's ranges in order: feeds are dealt out and sorted by Spark, and a task writes each
    batch as it comes, under a name of its own until the file is whole, so a feed of any size needs constant
    memory and a repeated attempt replaces its file. A feed without ranges has no file.
    """
    where = uri(folder)
    # Addresses as a sum of whole upper halves and a sum of lower ones: together they may have more digits than a decimal.
    high, low = (F.lit(0), F.col("hi") - F.col("lo") + 1) if family == 4 else (F.col("hi.h") - F.col("lo.h"), F.col("hi.l") - F.col("lo.l") + 1)
    sizes = optimized.groupBy("feed").agg(F.count(F.lit(1)).alias("records"), F.sum(high).cast("decimal(38,0)").alias("high"), F.sum(low).cast("decimal(38,0)").alias("low"))
    dealt = iv.dealt(optimized.join(sizes, "feed").select("feed", "lo", "hi", "records", "high", "low"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = opened(where)
        system.create_dir(path, recursive=True)
        feed, out, draft, written = None, None, "", 0

        def closed() -> pa.RecordBatch:
            out.close()
            system.move(draft, f"{path}/{feed}.bin")
            return pa.RecordBatch.from_arrays([pa.array([feed]), pa.array([f"{folder}/{feed}.bin"]), pa.array([written], pa.int64())], names=["feed", "path", "bytes"])

        for batch in batches:
            codes = batch.column("feed").dictionary_encode().indices.to_numpy()
            starts = np.r_[0, np.flatnonzero(np.diff(codes)) + 1] if len(codes) else np.zeros(0, int)
            for a, z in zip(starts, np.r_[starts[1:], len(codes)]):
                part = batch.slice(int(a), int(z - a))
                name = part.column("feed")[0].as_py()
                if name != feed:
                    if out is not None:
                        yield closed()
                    feed, draft, n = name, f"{path}/.{name}-{uuid.uuid4().hex}", part.column("records")[0].as_py()
                    unique = (int(part.column("high")[0].as_py()) << 64) + int(part.column("low")[0].as_py())
                    out, head = system.open_output_stream(draft), head_of(magic, family, n, n, unique)
                    out.write(head)
                    written = len(head)
                body = payload_of(part, family)
                out.write(body)
                written += len(body)
        if out is not None:
            yield closed()

    return dealt.mapInArrow(run, "feed string, path string, bytes long")
