"""Numbers of classes in the blocks of the n-gram join."""

import random

import numpy as np
from pyspark.sql import functions as F

from rangeloom.llm import jaccard_join as j
from test_jaccard import SHAPE, brute, sample


def test_classes_with_the_same_first_bits_stay_apart(spark):
    """With 4 bits most classes clash; results stay those of brute force."""
    rows = list(enumerate(sample(random.Random(3)), 5))
    before = j.short_bits
    j.short_bits = lambda classes: 4
    try:
        docs = spark.createDataFrame(rows, SHAPE).repartition(3)
        assert sorted(tuple(r) for r in j.near_duplicates(docs, fragment=2000).collect()) == brute(rows)
    finally:
        j.short_bits = before
    names = [-1, -2, 1, 2, 1 << 62, (1 << 62) + 1, 3 << 60]
    classes, other = j.numbered(spark.createDataFrame([(n,) for n in names], "class long"), 4)
    numbers = {r["class"]: r["no"] for r in classes.collect()}
    assert len(set(numbers.values())) == len(names) and numbers[3 << 60] == 3 and len(other) == 6


def test_bytes_of_a_shingle_do_not_grow_with_the_fragments(spark):
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(200))) for i in range(400)], SHAPE).coalesce(1)

    def size(bits: int) -> int:
        binary = [f.name for f in j.blocks(docs, bits, 1, 32, {}).schema if f.dataType.simpleString() == "binary"]
        return j.blocks(docs, bits, 1, 32, {}).agg(F.sum(sum((F.length(c) for c in binary), F.lit(0)))).first()[0]

    assert size(9) <= 1.05 * size(2)
    assert (j.widened(*j.narrow(np.array([1, 1 << 33], np.uint64))) == [1, 1 << 33]).all()
