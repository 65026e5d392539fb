"""Finding and masking secrets.

Three fixed kinds are matched by pattern. The method adds a kind ``random``: character Markov
models of random strings and of ordinary identifiers, trained from labelled samples, are compared
by their log-likelihood ratio on every other long token.

Null texts count as empty and have no spans. Positions are code points, ends exclusive. Every row is
scanned by its own text: rows that repeat a doc_id or have none get spans of their own, equal texts equal ones.
An empty table gives an empty result. report() ignores other columns and redact() keeps them, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The base kinds, in the order that breaks ties, and the least length of what they match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "random")
LEAST = {"assign": 6, "access": 20, "hex": 24}
# End of fixed values.

#: A token that the models judge: at least this long, of these characters.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Characters of the models; 0 stands for the edges of a string and anything else.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Least log-likelihood ratio per character, in nats, for a span of kind random.
RATIO = 1.0
#: Share of each context's probability that goes to all characters alike, seen or not.
SMOOTHING = 0.0003
_HEX_MAP = bytes(104 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
_WORDS = ("passw", "secret", "token", "apikey", "api_key")


_CODES = {c: i + 1 for i, c in enumerate(ALPHABET)}


def _codes(text: str) -> np.ndarray:
    return np.array([0, *(_CODES.get(c, 0) for c in text), 0])


def train(samples: DataFrame, smoothing: float = SMOOTHING) -> np.ndarray:
    """Log-likelihood ratios of character pairs from ``samples(sample, is_random)``.

    Pairs are counted by Spark; the counts that reach the driver are bounded by the alphabet.
    Null samples are left out. A class is uniform after a character that its samples don't have.
    Counts become shares of their context before they are smoothed, so the ratios don't depend on
    how many samples a class has.
    """
    pairs = (samples.where("sample is not null").select("is_random", F.concat(F.lit("\n"), "sample", F.lit("\n")).alias("s"))
             .select("is_random", "s", F.explode(F.sequence(F.lit(1), F.length("s") - 1)).alias("i"))
             .select("is_random", F.expr("substring(s, i, 2)").alias("pair"))
             .where(F.length(F.regexp_replace("pair", r"[A-Za-z0-9+/_=\n-]", "")) == 0)
             .groupBy("is_random", "pair").count())
    size = len(ALPHABET) + 1
    counts = np.zeros((2, size, size))
    for row in pairs.collect():
        a, b = _codes(row["pair"])[1:3]
        counts[int(row["is_random"]), a, b] += row["count"]
    total = counts.sum(axis=2, keepdims=True)
    shares = np.where(total > 0, counts / np.maximum(total, 1), 1 / size)
    logs = np.log((1 - smoothing) * shares + smoothing / size)
    return logs[1] - logs[0]


def labelled_samples(docs: DataFrame, spark: SparkSession, random_rows: int = 20_000, seed: int = 20_240) -> DataFrame:
    """Labelled samples: random strings that Spark draws, and the corpus's ordinary words as identifiers.

    The random class holds ``random_rows`` strings in each of three alphabets (base 36, base 62,
    base 64). The ordinary class is every distinct word of letters of 4 or more characters in the
    documents, as it stands, in capitals, and joined in pairs as camel case, snake case and dashed names.
    """
    # Alphabets of the random class.
    sets = ("abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
            "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")

    def draw(batches):
        for batch in batches:
            out = []
            for i in batch["id"]:
                rng = np.random.default_rng([seed, int(i)])
                letters = sets[int(i) % len(sets)]
                out.append("".join(letters[j] for j in rng.integers(0, len(letters), 16 + int(i) % 40)))
            yield pd.DataFrame({"sample": out, "is_random": True})

    drawn = spark.range(random_rows * len(sets), numPartitions=4).mapInPandas(draw, "sample string, is_random boolean")

    def distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = re.compile(r"^[A-Za-z]{4,}$")
        for batch in batches:
            seen = set()
            for text in batch.column("text").to_pylist():
                seen.update((text or "").split(" "))
            yield pa.RecordBatch.from_arrays([pa.array([w for w in seen if letters.match(w)], pa.string())], names=["w"])

    words = docs.select("text").mapInArrow(distinct_words, "w string").distinct()
    joined = words.select(F.explode(F.array(
        F.col("w"), F.upper("w"), F.concat(F.lower("w"), F.initcap(F.reverse("w"))), F.concat_ws("_", F.lower("w"), F.lower("w")),
        F.concat_ws("-", F.lower("w"), F.lower("w")), F.concat_ws("/", F.lower("w"), F.lower("w")))).alias("sample"), F.lit(False).alias("is_random"))
    return drawn.unionByName(joined)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the three fixed kinds, by start and then kind."""
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    if b"h" * LEAST["hex"] in text.encode("utf-8", "surrogatepass").translate(_HEX_MAP):
        found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if m.end() - m.start() >= LEAST["hex"]]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def ratio(token: str, model: np.ndarray) -> float:
    """Mean log-likelihood ratio of a token's character steps: above 0 is nearer to random."""
    codes = _codes(token)
    return float(model[codes[:-1], codes[1:]].mean())


class Cover:
    """The characters that spans, given by start, cover: joined where they overlap or touch."""

    def __init__(self, spans: list[tuple[int, int, str]]) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b, _ in spans:
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def whole(self, start: int, end: int) -> bool:
        """Whether no character of a range is left out."""
        i = bisect_right(self.starts, start) - 1
        return i >= 0 and self.ends[i] >= end


def random_spans(text: str, base: list[tuple[int, int, str]], model: np.ndarray, judged: dict[str, bool], threshold: float = RATIO) -> list[tuple[int, int, str]]:
    """Spans of kind random: judged tokens that base spans don't cover whole."""
    found, cover = [], Cover(base)
    for m in CANDIDATE.finditer(text):
        token = m.group()
        if token not in judged:
            if len(judged) > 200_000:
                judged.clear()
            judged[token] = ratio(token, model) >= threshold
        if judged[token] and not cover.whole(m.start(), m.end()):
            found.append((m.start(), m.end(), "random"))
    return found


def scan(docs: DataFrame, model: np.ndarray, threshold: float = RATIO) -> DataFrame:
    """All spans of each document: ``doc_id, spans array<struct<start, end, kind>>``."""
    shape = "doc_id long, spans array<struct<start:int,end:int,kind:string>>"
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judged: dict[str, bool] = {}
        for batch in batches:
            spans = []
            for text in batch.column("text").to_pylist():
                base = base_spans(text or "")
                every = sorted(base + random_spans(text or "", base, model, judged, threshold), key=lambda s: (s[0], KINDS.index(s[2])))
                spans.append([{"start": a, "end": b, "kind": k} for a, b, k in every])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, shape)


def report(scanned: DataFrame) -> DataFrame:
    """Counts by base kind, and digests of the spans."""
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return scanned.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS[:3]), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, model: np.ndarray, threshold: float = RATIO) -> DataFrame:
    """The documents with secrets masked in ``text``, all other columns as they are."""
    def run(texts):
        for part in texts:
            judged: dict[str, bool] = {}
            out = []
            for text in part:
                if text is None:
                    out.append(None)
                    continue
                base = base_spans(text)
                out.append(masked(text, sorted(base + random_spans(text, base, model, judged, threshold), key=lambda s: (s[0], KINDS.index(s[2])))))
            yield pd.Series(out, dtype=object)

    run.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.withColumn("text", F.pandas_udf(run, "string")(F.col("text")))
