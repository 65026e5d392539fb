import hashlib
import random
import re
import zlib

import numpy as np

from rangeloom.llm import media, packing, registry, secrets

SHAPE = "doc_id long, text string"


def brute_spans(text):
    found = []
    for m in re.finditer(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text or ""):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, "assign", m.end()))
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text or "") if len(m[0]) >= 24]
    return [(k, a, b) for a, _, k, b in sorted(found)]


def test_secrets_match_brute_force_and_random_tokens_are_found(spark):
    rng = random.Random(4)
    parts = ["PassWord", "token", "api_key", "APIKEY", "ſecret", "\"", "'", " ", ":", "=", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", "é", "a.b-c", "\n", "🙂"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 30))) for _ in range(150)]
    token = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40))
    texts += [None, "", f"see {token} here", "the international_organisation_of_names and readRecordFromTheTable", "x " * 50_000]
    docs = spark.createDataFrame(list(enumerate(texts)), SHAPE)
    sample = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = secrets.train(secrets.labelled_samples(sample, spark, random_rows=2000))
    got = secrets.report(secrets.scan(docs, model)).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        want = brute_spans(t)
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == x for k, _, _ in want) for x in ("assign", "access", "hex")]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
    assert got[152]["spans"] == "random:4:44"
    assert got[153]["spans"] == ""
    masked = secrets.redact(docs, model).orderBy("doc_id").collect()
    assert masked[152]["text"] == "see [random] here" and masked[150]["text"] is None
    assert secrets.scan(spark.createDataFrame([], SHAPE), model).collect() == []


def test_secret_verdicts_do_not_depend_on_the_size_of_the_corpus(spark):
    sample = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    samples = secrets.labelled_samples(sample, spark, random_rows=2000).persist()
    drawn, ordinary = samples.where("is_random"), samples.where("not is_random")
    one, ten, random_ten = (secrets.train(s) for s in (samples, drawn.unionByName(ordinary.crossJoin(spark.range(10)).drop("id")), ordinary.unionByName(drawn.crossJoin(spark.range(10)).drop("id"))))
    samples.unpersist()
    for token, found in (("4571289360315824", False), ("9x3KfQ7zLm2Vb8RtYw5P", True), ("readRecordFromTheTable", False)):
        assert [secrets.ratio(token, m) >= secrets.RATIO for m in (one, ten, random_ten)] == [found] * 3
        assert np.ptp([secrets.ratio(token, m) for m in (one, ten, random_ten)]) < 1e-9


def test_a_random_token_is_masked_beyond_the_base_span_in_it():
    model = np.full((len(secrets.ALPHABET) + 1,) * 2, 2.0)
    run = "0123456789abcdef01234567"
    for text, spans, left in ((f"see Xq9Z{run}Kp7W here", ["random:4:36", "hex:8:32"], "see [random] here"), (f"{run}-Kp7W", ["hex:0:24", "random:0:29"], "[hex]"),
                              (f"see {run} here", ["hex:4:28"], "see [hex] here"), (f"{run}/{run}", ["hex:0:24", "random:0:49", "hex:25:49"], "[hex]"),
                              (f"token={run}", ["assign:0:30", "hex:6:30"], "[assign]")):
        base = secrets.base_spans(text)
        every = sorted(base + secrets.random_spans(text, base, model, {}), key=lambda s: (s[0], secrets.KINDS.index(s[2])))
        assert [f"{k}:{a}:{b}" for a, b, k in every] == spans
        assert secrets.masked(text, every) == left


def test_media_are_stored_losslessly(spark):
    texts = ["", None, "a", "é" * 40, "x" * 64, "y" * 100_000, "a", "\x00", "a\x00"]
    docs = spark.createDataFrame([*enumerate(texts), (None, "a")], SHAPE)
    got = {r["doc_id"]: r for r in media.media_columns(docs).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64) or bytes(64)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-64:]) and (r["width"], r["height"]) == (64, len(payload) // 64)
    same = [c for c in got[2].asDict() if c != "doc_id"]
    assert [got[2][c] for c in same] == [got[6][c] for c in same] == [got[None][c] for c in same]
    assert media.media_columns(spark.createDataFrame([], SHAPE)).collect() == []


def test_headers_need_only_their_own_bytes(spark):
    index = media.store(spark.createDataFrame([(1, "a" * 200)], SHAPE), media.scratch(spark, "media"))
    assert [tuple(r)[1:] for r in media.headers(index).collect()] == [(64, 4)]


def test_packing_places_every_id_once(spark):
    from tokenizers import Tokenizer

    path = registry.tokenizer_path("word_bpe_49k.json")
    model = Tokenizer.from_file(path)
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma!", "δ", "x1"]) for _ in range(rng.randrange(0, 900))) for _ in range(80)] + ["", None, "word " * 9_000]
    texts += ["Word, word. WORD! Éa. éa, É. x1. a.b. 'S. it's ΑΣ. ΑΣ don't... !. e\u0301. \u0130. <|endoftext|>. ab\u00a0cd. 1, 2,"]
    got = packing.pack(spark.createDataFrame(list(enumerate(texts)), SHAPE), path).collect()
    for d, t in enumerate(texts):
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 2]
        at = 0
        for r in sorted((r for r in got if r["doc_id"] == d), key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(np.asarray(ids[r["start"]:at], "<u4").tobytes())
        assert at == len(ids)
    for s in {r["sequence_id"] for r in got}:
        at = 0
        for r in sorted((r for r in got if r["sequence_id"] == s), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
    used, sequences = sum(r["length"] for r in got), len({r["sequence_id"] for r in got})
    assert used >= 0.93 * 4096 * (sequences - 1)
    assert packing.pack(spark.createDataFrame([], SHAPE), path).collect() == []


def test_random_tokens_are_told_from_names_that_no_model_has_seen(spark):
    words = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = secrets.train(secrets.labelled_samples(words, spark, random_rows=2000))
    rng = random.Random(99)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    drawn = ["".join(rng.choice(letters) for _ in range(rng.randrange(20, 50))) for _ in range(500)]
    text = " ".join(r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(300).collect())
    names = sorted({w for w in re.findall(r"[a-z]{4,}", text)})
    joined = [f"{rng.choice(names)}_{rng.choice(names)}_{rng.choice(names)}" for _ in range(500)] + ["".join(rng.choice(names).title() for _ in range(3)) for _ in range(500)]
    assert sum(secrets.ratio(t, model) >= secrets.RATIO for t in drawn) >= 490
    assert sum(secrets.ratio(t, model) >= secrets.RATIO for t in joined) <= 5


def test_secrets_and_packing_of_repeated_and_missing_ids_and_clashing_names(spark):
    rows = [(None, "token=abcdef1", "x", 1), (None, "token=abcdef1", "x", 2), (1, None, "x", 3), (1, "a b", "x", 4), (1, "a b", "x", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, length long")
    model = np.zeros((len(secrets.ALPHABET) + 1,) * 2)
    got = secrets.report(secrets.scan(docs, model)).collect()
    assert sorted((r["doc_id"] or 0, r["n_assign"]) for r in got) == [(0, 1), (0, 1), (1, 0), (1, 0), (1, 0)]
    kept = secrets.redact(docs, model)
    assert kept.columns == docs.columns and sorted(r["length"] for r in kept.collect()) == [1, 2, 3, 4, 4]
    packed = packing.pack(docs, registry.tokenizer_path("word_bpe_49k.json")).collect()
    assert len(packed) == 5 and sum(r["doc_id"] is None for r in packed) == 2
    assert packing.pack(docs.where("false"), registry.tokenizer_path("word_bpe_49k.json")).collect() == []
