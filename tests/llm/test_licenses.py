import random
import re

from rangeloom.llm import licenses

SHAPE = "doc_id long, text string"


def brute(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found = sorted((i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(w)) if w[i:i + len(phrase.split())] == phrase.split())
    return len(w), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None), ",".join(sorted({x for _, x in found}))


def test_base_matches_brute_force_and_templates_are_found(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["cc", "BY", "all", "rights", "reserved.", "general", "public", "LICENSE", "é", "x9"]) for _ in range(rng.randrange(0, 40))) for _ in range(60)]
    notices = list(licenses.TEMPLATES.items())
    texts += [f"foo bar {n} baz" for _, n in notices]
    texts += ["Permission is hereby granted, free of charge, to any one person obtaining a copy of this nice software and associated documentation files (the Software), to deal in the Software without restriction", None, "", "ſee K", "word " * 40_000]
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), SHAPE)).orderBy("doc_id").collect()
    assert len(got) == len(texts)
    for r, t in zip(got, texts, strict=True):
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(t)
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1
    for r, (label, _) in zip(got[60:], notices, strict=False):
        assert label in r["labels"].split(",")
    assert "mit" in got[60 + len(notices)]["labels"].split(",")
    assert got[-1]["labels"] == "" and got[-1]["score"] == 0


def test_no_rows(spark):
    assert licenses.scan(spark.createDataFrame([], SHAPE)).collect() == []


def test_rows_that_repeat_an_id_or_have_none_keep_their_own_labels(spark):
    notice = licenses.TEMPLATES["unlicense"]
    rows = [(None, notice, 7), (None, "hello", 8), (3, notice, 9), (3, "x y z", 10), (3, "x y z", 11), (None, None, 12)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, row long").withColumnRenamed("row", "hits")).collect()
    assert sorted((r["doc_id"] or 0, r["labels"], r["score"], r["n_words"]) for r in got) == [
        (0, "", 0.0, 0), (0, "", 0.0, 1), (0, "unlicense", 1.0, 11), (3, "", 0.0, 3), (3, "", 0.0, 3), (3, "unlicense", 1.0, 11)]
