import hashlib
import random

import pytest

from rangeloom.llm import byte_pairs, registry

SHAPE = "doc_id long, text string, IDS string"


@pytest.fixture(scope="module")
def path():
    return registry.tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def texts() -> list:
    rng = random.Random(5)
    letters = "abcdestvmlrAZ  \n\t\r\x0b\x1c\x00'.,!?<|>0123ß漢字🙂\x85\xa0 ֈՙⅧ"
    out = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for _ in range(300)]
    return out + [None, "", " ", "   ", "\n\n", "a  b", " \n b", "a\n", "it's I'll", "<|endoftext|>", "x<|endoftext|> y<|endoftext|><|endoftext|>", "<|endoftext",
                  "a" * 3_000, "the quick brown fox, " * 3_000, "0" * 300 + "\t" * 300, "the quick brown fox", "the quick brown fox"]


def test_ids_equal_the_library_and_decode(spark, path, library):
    rows = [(i, t, "clash") for i, t in enumerate(texts())] + [(3, texts()[3], "again")]
    docs = spark.createDataFrame(rows, SHAPE).repartition(3)
    got = byte_pairs.encode(docs, path, rows=50).withColumn("decoded", byte_pairs.decoder(path)("ids")).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(i for i, _, _ in rows)
    for r in got:
        text = rows[r["doc_id"]][1] or ""
        assert r["ids"] == library.encode(text, add_special_tokens=False).ids, repr(text)[:80]
        assert r["decoded"] == text == library.decode(r["ids"], skip_special_tokens=False)
    for r in byte_pairs.round_trip(docs, path).collect():
        text = rows[r["doc_id"]][1] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_registered_query_over_whole_documents(spark, library):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in registry.op13_byte_pairs(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d["text"] or "", add_special_tokens=False).ids
        assert got[d["doc_id"]]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_null_ids_no_rows_and_broken_bytes(spark, path):
    got = byte_pairs.encode(spark.createDataFrame([(None, "a")], "doc_id long, text string"), path).collect()
    assert got[0]["doc_id"] is None and len(got[0]["ids"]) == 1
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert byte_pairs.encode(empty, path).collect() == [] and byte_pairs.round_trip(empty, path).collect() == []
    model = byte_pairs.BytePairs(path)
    half = spark.createDataFrame([([model.of_byte[0xC3]],), (None,)], "ids array<int>")
    assert [r[0] for r in half.select(byte_pairs.decoder(path)("ids")).collect()] == ["�", None]


def test_every_character_is_cut_as_by_the_library(path, library):
    model = byte_pairs.BytePairs(path)
    for low in range(0, 0x110000, 32):
        line = "".join(f"a{c}1{c}! {c}" for c in map(chr, range(low, low + 32)) if not 0xD800 <= ord(c) < 0xE000)
        assert model.words(line) == [line[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(line)]


def test_forced_boundaries_are_in_no_token_and_both_merges_agree(path):
    model, rng = byte_pairs.BytePairs(path), random.Random(3)
    for _ in range(300):
        word = bytes(rng.choice(b"aeinrst \xc3\xa9\x00\xff0") for _ in range(rng.randrange(1, 40)))
        parts = model.fragments(word)
        assert b"".join(parts) == word
        assert all(a[-1:] + b[:1] not in token for a, b in zip(parts, parts[1:]) for token in model.raw[:2000])
        start = [model.of_byte[b] for b in word]
        assert model.scanned(list(start)) == model.merged(list(start)) == [i for p in parts for i in model.merged([model.of_byte[b] for b in p])]


def test_caches_are_bounded(path):
    encoder = byte_pairs.ChunkEncoder(byte_pairs.BytePairs(path), limit=50)
    ids = [encoder.encode(f"w{i} x{i}y {'z' * i}") for i in range(300)]
    assert len(encoder.known) <= 60 and len(encoder.older) <= 60 and len(encoder.of_word) <= 60
    assert ids == [encoder.encode(f"w{i} x{i}y {'z' * i}") for i in range(300)]
