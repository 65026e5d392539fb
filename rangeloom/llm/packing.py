"""Packing token sequences into windows of a fixed capacity by multiway differencing.

Documents are tokenised where they are read and cut into pieces: whole windows first, then pieces
of at most ``piece`` tokens. Only piece descriptions (ids, lengths, checksums) are shuffled, never
tokens. Pieces are dealt by a hash into groups of about ``group`` pieces, and each group is packed
on its own by the multiway Karmarkar-Karp method: every item starts as a partial partition into k
windows, and the two partial partitions with the largest imbalance are merged, the fullest windows
of one with the emptiest of the other. k starts at the least number of windows that can hold the
group and rises as long as the fullest window exceeds the capacity.

Null texts count as empty; an empty text still has its closing id. Repeated rows are packed as
often as they occur. A null doc_id is carried through.
"""

from __future__ import annotations

import heapq
import json
import os
import string
import zlib
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import compress
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeloom.llm.byte_pairs import byte_letters
from rangeloom.llm.common import written

if TYPE_CHECKING:
    from tokenizers import Tokenizer

CAPACITY, PIECE, GROUP = 4096, 512, 480
#: Words, and stems of words, of one generation of a worker's token caches; two generations of each are held.
CACHE_WORDS = 500_000
#: A token of its own between words that are tokenised in one call, and how many go into one.
SEPARATOR, JOINED = "~", 500
#: What the tokenizer must do before it merges for letter runs to be merged alone.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
#: ASCII marks, the first character that is not folded here, and the letters of bytes that don't stand for themselves.
MARKS, PLAIN = string.punctuation, "\u0250"
MOVED = {chr(b): letter for letter, b in byte_letters().items() if b > 127 and letter != chr(b)}
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, slot long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Known(dict):
    """Token ids of words. A word that is met for the first time stands with an empty bytearray, which is
    in ``new``, too, until its ids are put there; so each word of a text is looked up once."""

    def __init__(self, older: dict[str, bytes]) -> None:
        super().__init__({"": b""})
        self.older: dict[str, bytes] = older
        self.new: dict[str, bytearray] = {}

    def __missing__(self, word: str) -> bytes | bytearray:
        ids = self.older.get(word)
        if ids is None:
            ids = self.new[word] = bytearray()
        self[word] = ids
        return ids


class WordEncoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes, word by word.

    The tokenizer drops white space and no token crosses it, so a text's ids are those of its
    parts between blanks, tabs and line ends in turn; each distinct part is tokenised once.
    """

    def __init__(self, tokenizer_path: str, limit: int = CACHE_WORDS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.limit, self.known = Tokenizer.from_file(tokenizer_path), limit, Known({})
        self.stems: dict[str, bytes] = {}
        self.older_stems: dict[str, bytes] = {}
        ids = self._ids(self.tokenizer, [SEPARATOR])[0]
        self.separator = ids[0] if len(ids) == 1 else None
        with open(tokenizer_path, encoding="utf-8") as f:
            file = json.load(f)
        self.bare, suffix = None, file["model"].get("end_of_word_suffix")
        if suffix and (file.get("normalizer"), file.get("pre_tokenizer")) == (NORMALIZER, PRE_TOKENIZER):
            self.bare = Tokenizer(self.tokenizer.model)
            self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            vocabulary = file["model"]["vocab"]
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True

    @staticmethod
    def _ids(tokenizer: Tokenizer, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _coded(self, words: list[str]) -> dict[str, bytes]:
        """Token ids of words: many in one call, told apart by the separator; words that hold it go alone."""
        alone = [w for w in words if self.separator is None or SEPARATOR in w]
        rest = words if not alone else [w for w in words if SEPARATOR not in w and self.separator is not None]
        out = {w: array("I", ids).tobytes() for w, ids in zip(alone, self._ids(self.tokenizer, alone), strict=True)}
        parts = [rest[i:i + JOINED] for i in range(0, len(rest), JOINED)]
        for part, ids in zip(parts, self._ids(self.tokenizer, [f" {SEPARATOR} ".join(p) for p in parts]), strict=True):
            flat = np.array(ids, np.uint32)
            ends = [*(4 * np.flatnonzero(flat == self.separator)).tolist(), 4 * len(flat)]
            raw, start = flat.tobytes(), 0
            for word, end in zip(part, ends, strict=True):
                out[word], start = raw[start:end], end + 4
        return out

    def _of_letters(self, stems: list[str]) -> dict[str, bytes]:
        """Token ids of lower-case letter runs: the library's merges alone, as there is nothing to normalise
        or to split. They are told apart by the tokens that end a word."""
        parts, texts, out = [stems[i:i + JOINED] for i in range(0, len(stems), JOINED)], [], {}
        for part in parts:
            text = " ".join(part)
            if not text.isascii():
                text = text.encode().decode("latin-1")
                for c in MOVED.keys() & set(text):
                    text = text.replace(c, MOVED[c])
            texts.append(text)
        for part, ids in zip(parts, self._ids(self.bare, texts), strict=True):
            flat = np.array(ids, np.uint32)
            raw, start = flat.tobytes(), 0
            for stem, end in zip(part, (4 * np.flatnonzero(self.ends[flat]) + 4).tolist(), strict=True):
                out[stem], start = raw[start:end], end
        return out

    def _learn(self, new: dict[str, bytearray]) -> None:
        """Finds the ids of new words. ASCII marks after letters are a token run of their own and case is
        dropped, so such variants share one tokenisation; case is folded here only below U+0250, where no
        letter composes with another and each has one small letter that all libraries agree on."""
        words = list(new)
        before = [w.rstrip(MARKS) for w in words]
        stems = [x.lower() for x in before]
        plain = [bool(self.bare) and x.isalpha() for x in stems]
        if max("".join(words)) >= PLAIN:
            plain = [p and max(w) < PLAIN for p, w in zip(plain, words, strict=True)]
        marks = [w[len(x):] for w, x in zip(words, before, strict=True)]
        if not all(plain):
            for i in [i for i, p in enumerate(plain) if not p]:
                stems[i], marks[i] = words[i], ""
        if len(self.stems) > self.limit:
            self.stems, self.older_stems = {}, self.stems
        known, older = self.stems, self.older_stems
        fresh = set(stems).union(marks).difference(known)
        if older:
            again = [x for x in fresh if x in older]
            known.update((x, older[x]) for x in again)
            fresh.difference_update(again)
        letters = fresh.intersection(compress(stems, plain))
        known.update(self._of_letters(list(letters)))
        known.update(self._coded(list(fresh.difference(letters))))
        ids = [known[x] + known[m] for x, m in zip(stems, marks, strict=True)]
        for held, found in zip(new.values(), ids, strict=True):
            held += found
        self.known.update(zip(words, ids, strict=True))
        new.clear()

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for at in range(0, len(texts), 100):
            if len(self.known) > self.limit and not self.known.new:
                self.known.older = {}
                self.known = Known(self.known)
            look = self.known.__getitem__
            coded = [list(map(look, t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "))) for t in texts[at:at + 100]]
            if self.known.new:
                self._learn(self.known.new)
            yield from map(b"".join, coded)


@cache
def worker_encoder(tokenizer_path: str) -> WordEncoder:
    """The encoder of this Python worker; its bounded cache serves the worker's later tasks too."""
    return WordEncoder(tokenizer_path)


def cuts(n: int, capacity: int, piece: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole windows, then even pieces of at most ``piece``."""
    whole = n // capacity
    out = [(i * capacity, capacity) for i in range(whole)]
    rest = n - whole * capacity
    parts = -(-rest // piece)
    edges = [whole * capacity + rest * i // parts for i in range(parts + 1)] if parts else []
    return out + [(a, b - a) for a, b in zip(edges, edges[1:])]


def tokenised(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, piece: int) -> DataFrame:
    """The pieces of each document, with the checksum of their ids and a slot that spreads them evenly."""
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, row = worker_encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            out: list[list] = [[] for _ in range(6)]
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for doc, coded in zip(ids, encoder.encode(texts), strict=True):
                coded += end
                for start, length in cuts(len(coded) // 4, capacity, piece):
                    row += 1
                    values = (doc, start, length, zlib.crc32(coded[4 * start:4 * (start + length)]), len(coded) // 4, task << 32 | row)
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=[x.split()[0] for x in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def differencing(lengths: list[int], k: int) -> list[list[int]]:
    """Indexes of the items in each of k windows, by multiway Karmarkar-Karp differencing.

    Merges keep only how they put windows together; the windows of the items are read off backwards.
    """
    n = len(lengths)
    first = np.zeros((n, k), np.int64)
    first[:, 0] = lengths
    heap = [(-x, i, loads, i) for i, (x, loads) in enumerate(zip(lengths, first, strict=True))]
    heapq.heapify(heap)
    merges: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        _, i, a, of_a = heapq.heappop(heap)
        _, _, b, of_b = heap[0]
        loads = a + b[::-1]
        order = (-loads).argsort(kind="stable")
        loads = loads[order]
        loads -= loads[-1]  # only the differences matter
        heapq.heapreplace(heap, (-int(loads[0]), i, loads, n + len(merges)))
        merges.append((of_a, of_b, order))
    places: list[np.ndarray | None] = [None] * (n + len(merges))
    places[-1:] = [np.arange(k)]
    for m in range(len(merges) - 1, -1, -1):
        of_a, of_b, order = merges[m]
        place = np.empty(k, np.int64)
        place[order] = places[n + m]
        places[of_a], places[of_b], places[n + m] = place, place[::-1], None
    out: list[list[int]] = [[] for _ in range(k)]
    for i in range(n):
        out[places[i][0]].append(i)
    return out if n else []


def windows(lengths: list[int], capacity: int) -> list[list[int]]:
    """Near-equal windows, none above the capacity, and as few as differencing finds."""
    whole = [[i] for i, n in enumerate(lengths) if n == capacity]
    rest = [i for i, n in enumerate(lengths) if n < capacity]
    sizes = [lengths[i] for i in rest]
    k = -(-sum(sizes) // capacity)
    while rest:
        found = differencing(sizes, k)
        if max(sum(sizes[i] for i in w) for w in found) <= capacity:
            return whole + [[rest[i] for i in w] for w in found if w]
        k += 1
    return whole


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = CAPACITY, piece: int = PIECE, group: int = GROUP) -> DataFrame:
    """Packs ``docs(doc_id, text)``: one row per piece with its place in a sequence.

    A sequence's pieces lie gapless from offset 0, in the order of their slots. An empty table
    gives an empty result.
    """
    pieces = written(tokenised(docs, tokenizer_path, end_id, capacity, piece), "pieces")
    groups = max(1, -(-pieces.count() // group))

    def fill(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "start", "slot"], kind="stable", ignore_index=True)
        lengths = rows["length"].tolist()
        sequence, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for w, members in enumerate(windows(lengths, capacity)):
            at = 0
            for i in sorted(members):
                sequence[i], offset[i] = int(key[0]) << 20 | w, at
                at += lengths[i]
        return rows.drop(columns=["slot", "bin"]).assign(sequence_id=sequence, offset=offset)

    return (pieces.withColumn("bin", F.pmod(F.xxhash64("slot"), F.lit(groups)))
            .groupBy("bin").applyInPandas(fill, PACKED))
