"""Disk of the n-gram join: shingles go to their fragments in rounds, tables and shuffles go when they are read."""

import os
import random

from pyspark.sql import functions as F

from rangeloom.llm import common
from rangeloom.llm import jaccard_join as j
from test_jaccard import SHAPE, brute, sample


def test_no_round_shuffles_most_of_the_shingles(spark, monkeypatch):
    rows = list(enumerate(sample(random.Random(11)), 5))
    sent, blocks = [], j.blocks

    def weighed(*args):
        found = blocks(*args)
        sent.append(found.agg(F.coalesce(F.sum(F.length("hashes")), F.lit(0))).first()[0])
        return found

    monkeypatch.setattr(j, "blocks", weighed)
    for more in ({}, {"owners": 20, "few": 1}):
        sent.clear()
        docs = spark.createDataFrame(rows, SHAPE).repartition(3)
        assert sorted(tuple(r) for r in j.near_duplicates(docs, fragment=500, **more).collect()) == brute(rows)
        assert len(sent) == 4 and max(sent) < 0.4 * sum(sent)


def test_tables_of_the_rounds_are_deleted(spark, monkeypatch):
    made, scratch = [], common.scratch

    def named(session, name):
        made.append(scratch(session, name))
        return made[-1]

    monkeypatch.setattr(common, "scratch", named)
    rows = list(enumerate(sample(random.Random(12)), 5))
    j.near_duplicates(spark.createDataFrame(rows, SHAPE).repartition(3), fragment=500, owners=20).collect()
    left = {os.path.basename(p).split("-")[0] for p in made if os.path.exists(p.removeprefix("file://"))}
    assert {"salted", "shared", "weights", "items"} <= {os.path.basename(p).split("-")[0] for p in made}
    assert not left & {"salted", "shared", "weights", "items", "segments", "posted"}


def test_words_are_hashed_as_they_are_split():
    rng, shingler = random.Random(4), j.Shingler()
    letters = "abcXYZ09\x00\x1cé　\x85\U0001f600-"
    text = "".join("".join(rng.choices(letters, k=rng.choice([1, 2, 5, 31, 33, 40]))) + rng.choice([" ", "\n", "\t \r", "\x0b\x0c"]) for _ in range(20_000))
    text += " " + "y" * (j.PIECE + 7) + " aBc " + "y" * (j.PIECE + 8) + " ABC"
    words, hashes = text.encode().lower().split(), shingler.words(text).tolist()
    assert len(words) == len(hashes)
    name = dict(zip(words, hashes, strict=True))
    assert [name[w] for w in words] == hashes and len(set(name.values())) == len(name)
    assert shingler.words("b " + text).tolist()[1:] == hashes  # wherever the pieces are cut
    assert not len(shingler.words(" \n\t")) and not len(shingler.words(None))
