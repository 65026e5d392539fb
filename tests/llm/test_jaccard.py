import random
import re

from rangeloom.llm import jaccard_join

SHAPE = "doc_id long, text string"


def brute(rows):
    sets = []
    for _, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            same = rows[i][0] == rows[j][0] and sets[i] and sets[j]
            if same or (both and 100 * both >= 75 * len(sets[i] | sets[j])):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


def sample(rng):
    words = [f"w{i}" for i in range(3000)]
    passage = rng.choices(words, k=60)
    texts = []
    for _ in range(14):
        original = rng.choices(words, k=rng.randrange(30, 200))
        if rng.random() < 0.5:
            original = passage + original[:rng.randrange(1, 40)]
        for _ in range(rng.randrange(1, 7)):
            texts.append(" ".join(edited(rng, original, rng.randrange(0, 6))))
    for _ in range(3):  # chains: each near the next, the ends far apart
        step = rng.choices(words, k=80)
        for _ in range(6):
            texts.append(" ".join(step))
            step = edited(rng, step, 2)
    texts += ["", None, " \n", "one two", "One  TWO", "one two three", "É x", "é x", texts[0], texts[0].upper(), "long word " * 20_000]
    rng.shuffle(texts)
    return texts


def test_components_match_brute_force(spark):
    for seed in range(1):
        rows = list(enumerate(sample(random.Random(seed)), 5))
        got = jaccard_join.near_duplicates(spark.createDataFrame(rows, SHAPE).repartition(3), fragment=2000).collect()
        assert sorted(tuple(r) for r in got) == brute(rows)


def test_repeated_ids_and_no_rows(spark):
    rows = [(1, "a b c d e f"), (1, "u v w x y z"), (0, "U v w x y z"), (2, "k l m n o p")]
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, SHAPE)).collect()
    assert sorted(tuple(r) for r in got) == brute(rows)
    assert jaccard_join.near_duplicates(spark.createDataFrame([], SHAPE)).collect() == []


def put_together(rng, n, lines, each, width=40):
    """Documents of some of the same long lines: they share much, and few of them are near."""
    return [" ".join(f"l{line}w{i}" for line in rng.sample(range(lines), each) for i in range(width)) for _ in range(n)]


def test_long_lists_and_salts_match_brute_force(spark):
    rng = random.Random(4)
    texts = put_together(rng, 120, 12, 4) + sample(rng)
    texts += [" ".join(edited(rng, t.split(), 1)) for t in texts[:20]] + [t + " tail of it" for t in texts[15:25]]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], "doc_id long, text string, class long, h long").repartition(3)
    want = brute(rows)
    assert sorted(tuple(r) for r in jaccard_join.near_duplicates(docs, fragment=5000, owners=90, few=1).collect()) == want


def test_one_of_each_keeps_columns_of_any_name(spark):
    rows = [(4, "a b c d e f", 1, 2), (2, "A b c d e f", 3, 4), (None, "a b c d e f", 5, 6), (7, None, 7, 8), (7, None, 7, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _kept long, class long")
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["_kept"]) for r in kept.collect()) == [(0, 5), (2, 3), (7, 7)]


def test_documents_put_together_from_shared_passages_are_hardly_compared(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(list(enumerate(put_together(random.Random(6), 600, 60, 6))), SHAPE)
    seen = []
    compared = jaccard_join.compared

    def counting(pairs, segments):
        seen.append(pairs.count())
        return compared(pairs, segments)

    jaccard_join.compared = counting
    try:
        found = jaccard_join.near_duplicates(docs)
        assert found.where(F.col("component_id") != F.col("doc_id")).isEmpty()
    finally:
        jaccard_join.compared = compared
    assert sum(seen) < 600, seen
