"""Byte-level BPE encoding and decoding by forced boundaries.

No merge crosses two neighbouring bytes that no vocabulary token has side by side, so a word's bytes
can be cut between them before anything is merged. A text is taken apart in steps, each of which
only cuts where the tokenizer is certain to cut, too:

1. at the added tokens, and before white space: a chunk is a run of white space and what follows it;
2. a chunk at the tokenizer's word pattern;
3. a word at its forced boundaries, into fragments.

A fragment is merged on its own, cheapest pair first, leftmost first among equals, by a heap over a
linked list, so that a million bytes without a forced boundary take n log n steps. The ids of a text
are those of its fragments in turn. Texts never leave the task that reads them; chunks and fragments
met before are looked up in caches of a bounded number of entries.

Null and empty texts have no ids and decode to an empty text. Texts of any length are encoded whole.
Repeated rows are encoded as often as they occur, a null doc_id is carried through, other columns are
ignored, whatever their names, and an empty table gives an empty result. Decoding ids that are null
gives null; bytes that are no UTF-8 decode to the replacement character.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Callable, Iterator
from functools import cache, cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entries of one generation of a worker's chunk cache, of which two are held, and of its word cache.
CACHED = 400_000
#: Longer chunks and words are not kept in a cache.
CACHED_LENGTH = 64
#: Fragments of so many bytes at most are merged by scanning their pairs.
SCANNED, NO_RANK = 24, 1 << 40
#: The word pattern of byte-level tokenizers, over classes of letters, numbers and the rest.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?{O}+|\s+(?!\S)|\s+"
WORDS = regex.compile(PATTERN.format(L=r"\p{L}", N=r"\p{N}", O=r"[^\s\p{L}\p{N}]"))
ASCII_WORDS = re.compile(PATTERN.format(L="[A-Za-z]", N="[0-9]", O=r"[^ \t-\rA-Za-z0-9]").replace(r"\s", r"[ \t-\r]").replace(r"\S", r"[^ \t-\r]"))
#: Characters below this one have had their classes for so long that all libraries agree.
OLD = "\u0500"
CHUNK, ADJACENT = regex.compile(r"\s*\S+|\s+"), regex.compile(r"\s\s")


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a vocabulary: printable ones for themselves, the others from U+0100 on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = sorted(set(range(256)).difference(printable))
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class BytePairs:
    """Tokens as bytes, merges as pairs of ids, and the byte pairs that tokens have side by side."""

    def __init__(self, tokenizer_path: str) -> None:
        from tokenizers import Tokenizer

        with open(tokenizer_path, encoding="utf-8") as f:
            file = json.load(f)
        model, words = file["model"], file["pre_tokenizer"]
        if model["type"] != "BPE" or file["normalizer"] or words["type"] != "ByteLevel" or words["add_prefix_space"] or model.get("ignore_merges"):
            raise ValueError("not a byte-level BPE tokenizer without normalizer and prefix space")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in file["added_tokens"]):
            raise ValueError("added tokens that take white space or whole words are not supported")
        self.library, letters, vocabulary = Tokenizer.from_file(tokenizer_path), byte_letters(), model["vocab"]
        self.added = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.raw = [b""] * (max([*vocabulary.values(), *self.added.values()]) + 1)
        for token, i in vocabulary.items():
            self.raw[i] = bytes(letters[c] for c in token)
        self.inside = {t[k:k + 2] for t in self.raw for k in range(len(t) - 1)}
        for token, i in self.added.items():
            self.raw[i] = token.encode()
        self.decimals = [str(i).encode() for i in range(len(self.raw))]
        self.of_byte = [vocabulary[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        merges = [(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in pairs]
        self.rank, self.tokens = {(a, b): r for r, (a, b, _) in enumerate(merges)}, [t for _, _, t in merges]
        self.at_added = regex.compile("({})".format("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))))) if self.added else None

    @cached_property
    def young(self) -> regex.Pattern | None:
        """Letters and numbers that are younger than the library's tables, and so neither of them to it."""
        every = regex.findall(r"[\p{L}\p{N}]", "".join(chr(c) for c in range(ord(OLD), 0x110000) if not 0xD800 <= c < 0xE000))
        line = "!" + "!".join(every) + "!"
        alone = {line[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(line) if b - a == 1}
        runs: list[list[int]] = []
        for c in (ord(c) for c in every if c not in alone):
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
        return regex.compile("[{}]".format("".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs))) if runs else None

    @cached_property
    def young_words(self) -> regex.Pattern:
        """The word pattern with the library's classes."""
        young = self.young.pattern
        return regex.compile(PATTERN.format(L=rf"[\p{{L}}--{young}]", N=rf"[\p{{N}}--{young}]", O=rf"[[^\s\p{{L}}\p{{N}}]||{young}]"), regex.V1)

    def words(self, chunk: str) -> list[str]:
        """The words of a chunk by the tokenizer's pattern."""
        if chunk.isascii():
            return [chunk] if chunk.lstrip(" ").isalpha() and chunk[:2] != "  " else ASCII_WORDS.findall(chunk)
        if max(chunk) < OLD or not self.young or not self.young.search(chunk):
            return WORDS.findall(chunk)
        return self.young_words.findall(chunk)

    def fragments(self, word: bytes) -> list[bytes]:
        """The parts of a word between its forced boundaries."""
        inside = self.inside
        cuts = [k for k in range(1, len(word)) if word[k - 1:k + 1] not in inside]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)])] if cuts else [word]

    def ids(self, word: bytes) -> list[int]:
        """The ids of a word: those of its fragments, each merged on its own."""
        out: list[int] = []
        for fragment in self.fragments(word):
            start = [self.of_byte[b] for b in fragment]
            out += self.scanned(start) if len(start) <= SCANNED else self.merged(start)
        return out

    def scanned(self, ids: list[int]) -> list[int]:
        """Merges the pair of least rank, of equal ones the leftmost, as long as there is one; for few ids."""
        rank, tokens = self.rank, self.tokens
        ranks = [rank.get(pair, NO_RANK) for pair in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == NO_RANK:
                break
            k = ranks.index(best)
            ids[k:k + 2] = [tokens[best]]
            del ranks[k]
            if k < len(ranks):
                ranks[k] = rank.get((ids[k], ids[k + 1]), NO_RANK)
            if k:
                ranks[k - 1] = rank.get((ids[k - 1], ids[k]), NO_RANK)
        return ids

    def merged(self, ids: list[int | None]) -> list[int]:
        """The same by a heap over a linked list, for many ids."""
        n, rank = len(ids), self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank[pair], k, *pair) for k, pair in enumerate(zip(ids, ids[1:])) if pair in rank]
        heapq.heapify(heap)
        while heap:
            best, k, left, right = heapq.heappop(heap)
            nxt = after[k]
            if ids[k] != left or nxt >= n or ids[nxt] != right:
                continue
            ids[k], ids[nxt], after[k] = self.tokens[best], None, after[nxt]
            if after[k] < n:
                before[after[k]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b < n and (ids[a], ids[b]) in rank:
                    heapq.heappush(heap, (rank[ids[a], ids[b]], a, ids[a], ids[b]))
        return [i for i in ids if i is not None]


class ChunkEncoder:
    """Ids of texts as unsigned 32-bit bytes, chunk by chunk, with bounded caches.

    A chunk is known by a key: what follows a single blank, or, after a blank, the chunk itself.
    """

    def __init__(self, model: BytePairs, limit: int = CACHED) -> None:
        self.model, self.limit = model, limit
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.of_word: dict[str, bytes] = {}

    def _ids(self, chunk: str) -> bytes:
        model, of_word, out = self.model, self.of_word, []
        if len(of_word) > self.limit:
            of_word.clear()
        for word in model.words(chunk):
            ids = of_word.get(word)
            if ids is None:
                ids = array("I", model.ids(word.encode())).tobytes()
                if len(word) <= CACHED_LENGTH:
                    of_word[word] = ids
            out.append(ids)
        return out[0] if len(out) == 1 else b"".join(out)

    def _keys(self, text: str) -> list[str]:
        if not ADJACENT.search(text):
            head, *rest = text.replace("\n", " \n").split(" ")
            return [f" {head}", *rest] if head else rest
        return [c[1:] if c[0] == " " and c[1:2] not in (" ", "\n") else f" {c}" for c in CHUNK.findall(text)]

    def _part(self, text: str) -> bytes:
        keys, known = self._keys(text), self.known
        try:
            return b"".join([known[k] for k in keys])
        except KeyError:
            pass
        if len(known) > self.limit:
            self.known, self.older = {}, known
            known = self.known
        long: dict[str, bytes] = {}
        for k in set(keys).difference(known):
            ids = self.older.get(k)
            if ids is None:
                ids = self._ids(k if k[:1] == "\n" else k[1:] if k[:1] == " " else f" {k}")
            (known if len(k) <= CACHED_LENGTH else long)[k] = ids
        return b"".join([known[k] if k in known else long[k] for k in keys])

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        parts = self.model.at_added.split(text) if self.model.at_added else [text]
        return b"".join([array("I", [self.model.added[p]]).tobytes() if i % 2 else self._part(p) if p else b"" for i, p in enumerate(parts)])


@cache
def worker_encoder(tokenizer_path: str) -> ChunkEncoder:
    """The encoder of this Python worker; its bounded caches serve the worker's later tasks too."""
    return ChunkEncoder(BytePairs(tokenizer_path))


def _encoded(docs: DataFrame, tokenizer_path: str, schema: str, finish: Callable[[list[bytes], BytePairs], list[pa.Array]], rows: int) -> DataFrame:
    """``doc_id`` and what ``finish`` makes of the ids of some rows."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer_path)
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                coded = [encoder.encode(t or "") for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *finish(coded, encoder.model)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def encode(docs: DataFrame, tokenizer_path: str, rows: int = 500) -> DataFrame:
    """``doc_id, ids`` of each row of ``docs(doc_id, text)``; ``rows`` go into one Arrow batch."""
    def lists(coded: list[bytes], model: BytePairs) -> list[pa.Array]:
        ends = np.cumsum([0, *(len(c) // 4 for c in coded)])
        return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(coded), np.uint32).astype(np.int32)))]

    return _encoded(docs, tokenizer_path, "doc_id long, ids array<int>", lists, rows)


def decoder(tokenizer_path: str) -> Callable[[Column | str], Column]:
    """A column function from ids to text: the bytes of the tokens, added ones included, in turn."""
    def run(lists: pd.Series) -> pd.Series:
        raw = worker_encoder(tokenizer_path).model.raw
        return pd.Series([None if ids is None else b"".join([raw[i] for i in ids]).decode("utf-8", "replace") for ids in lists], dtype=object)

    run.__annotations__ = {"lists": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")


def round_trip(docs: DataFrame, tokenizer_path: str, rows: int = 500) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: each text is encoded, and its ids decoded, in one pass.

    The digests are of the ids in decimal, joined by commas, and of the decoded text as UTF-8.
    """
    def digests(coded: list[bytes], model: BytePairs) -> list[pa.Array]:
        raw, sha = model.raw, hashlib.sha256
        lists = [np.frombuffer(c, np.uint32).tolist() for c in coded]
        of_ids = [sha(b",".join([model.decimals[i] for i in ids])).hexdigest() for ids in lists]
        decoded = [sha(b"".join([raw[i] for i in ids]).decode("utf-8", "replace").encode()).hexdigest() for ids in lists]
        return [pa.array([len(ids) for ids in lists], pa.int64()), pa.array(of_ids), pa.array(decoded)]

    return _encoded(docs, tokenizer_path, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", digests, rows)
