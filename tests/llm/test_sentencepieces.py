import random

import pytest

from rangeloom.llm import registry, sentencepieces

SHAPE = "doc_id long, text string, ids string"


def test_ids_equal_the_library_and_decode(spark):
    import sentencepiece

    path = registry.tokenizer_path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyzABCDE 0123456789.,-_ \n\téß漢字🙂"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 120))) for _ in range(120)]
    texts += ["", None, " ", "    the", "a  b   c ", "\n\n", "the quick brown fox", "the quick brown fox", "Internationalization", "word " * 20_000, "x" * 5_000,
              "".join(rng.choice("abcdef0123456789") for _ in range(3_000)), "\x00\x01", " ▁a"]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(0, texts[0], "again")]
    got = sentencepieces.encode_and_check(spark.createDataFrame(rows, SHAPE), path).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(i for i, _, _ in rows)
    for r in got:
        assert r["round_trip"]
        assert r["ids"] == model.encode(texts[r["doc_id"]] or ""), repr(texts[r["doc_id"]])[:80]


def test_long_words_in_slices(spark):
    """Words around the length of a slice, and of many slices, are what the library makes of them."""
    import sentencepiece

    path, rng = registry.tokenizer_path("piece_bpe_32k.model"), random.Random(11)
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = sentencepieces.SLICE
    texts = ["".join(rng.choice(letters) for _ in range(n)) for n in (size - 2, size - 1, size, size + 1, 2 * size - 1, 2 * size, 5 * size + 3, 40_000) for letters in ("x", "the", "internationalization", "0")]
    got = sentencepieces.encode_and_check(spark.createDataFrame([*enumerate(texts), (0, texts[0])], "doc_id long, text string"), path).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        assert r["round_trip"] and r["ids"] == model.encode(texts[r["doc_id"]]), texts[r["doc_id"]][:30]


def test_null_ids_and_no_rows(spark):
    path = registry.tokenizer_path("piece_bpe_32k.model")
    got = sentencepieces.encode_and_check(spark.createDataFrame([(None, "a")], "doc_id long, text string"), path).collect()
    assert got[0]["doc_id"] is None and got[0]["n_ids"] == 1
    assert sentencepieces.encode_and_check(spark.createDataFrame([], "doc_id long, text string"), path).collect() == []


@pytest.mark.parametrize("text", ["hello", "tokenization", "aaaaaaaaaa", "x" * 2000])
def test_fold_takes_the_best_edge_at_each_step(text):
    vocabulary = sentencepieces.Vocabulary(registry.tokenizer_path("piece_bpe_32k.model"))
    order = {score: i for i, score in enumerate(sorted({s for _, _, s in vocabulary.rows}, reverse=True))}
    value = {p: order[s] << sentencepieces.ID_BITS | i for p, i, s in vocabulary.rows}
    shift = sentencepieces.ORDER_BITS + sentencepieces.ID_BITS
    edges = [(a << sentencepieces.LENGTH_BITS | k) << shift | value[text[a:a + k]] for a in range(len(text)) for k in range(2, vocabulary.longest + 1) if a + k <= len(text) and text[a:a + k] in value]
    cut = list(range(len(text) + 1))
    while True:
        tried = [(value[text[cut[i]:cut[i + 2]]] >> sentencepieces.ID_BITS, i) for i in range(len(cut) - 2) if text[cut[i]:cut[i + 2]] in value]
        if not tried:
            break
        del cut[min(tried)[1] + 1]
    assert [a for a, _, _ in sentencepieces.folded(len(text), edges)] == cut[:-1]


def test_units_travel_in_blocks(spark, tmp_path):
    """A batch's units, of any kind, come back from their blocks, and a row of the batches is a block and not a unit."""
    units = [sentencepieces.MARK, "\n", "é", "\x00", "▁the", "x" * 300, "▁a\r", *(f"▁w{i}" for i in range(500))]
    dealt, places = sentencepieces.blocks(units, 7)
    flat = [u for b in dealt for u in sentencepieces.unpacked(sentencepieces.packed(dealt[b]))]
    assert [flat[p] for p in places] == units and list(dealt) == sorted(dealt)
    docs = spark.createDataFrame([(i, " ".join(f"w{i * j}" for j in range(300)) + "\n") for i in range(40)], "doc_id long, text string").coalesce(1)
    path = registry.tokenizer_path("piece_bpe_32k.model")
    held = sentencepieces.batches(docs, sentencepieces.Vocabulary(path).neighbours, f"file://{tmp_path}", 5).cache()
    assert held.count() == 5
    every = [r["unit"] for r in sentencepieces.distinct_units(held.unionAll(held), 3).collect()]
    assert len(every) == len(set(every)) == held.groupBy().sum("n").first()[0]


def test_blocks_of_units_are_small_and_return_whole():
    import zstandard

    rng = random.Random(3)
    units = sorted({"▁" + "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 9))) for _ in range(3_000)})
    plain = len(zstandard.compress("\n".join(units).encode()))
    assert len(sentencepieces.packed(units)) < 0.9 * plain
    for some in (units, ["\n"], ["a", "a\0", "a\0\0b", "\n", "ab", "abcdefghi", "abcdefghij", "9", "98"], sorted(["\t", "\n", "x" * 5_000, "x" * 5_001, "🙂", "🙂🙂"])):
        assert sentencepieces.unpacked(sentencepieces.packed(some)) == some
