import random

from rangeloom.llm import quality_classifier, toxicity
from rangeloom.llm import registry

SHAPE = "doc_id long, text string"


def corpus(rng, bad):
    plain = [f"{a}{b}" for a in ("lor", "mit", "sen", "dal", "kor") for b in ("a", "em", "ing", "ost", "u")]
    return [(i, " ".join(rng.choice(bad) if i % 2 and rng.random() < 0.15 else rng.choice(plain) for _ in range(rng.randrange(40, 120)))) for i in range(300)]


def test_toxicity_learns_marked_words(spark):
    rows = corpus(random.Random(8), ["vilscum", "vilscums", "hatrag"])
    docs, labels = spark.createDataFrame(rows, SHAPE), spark.createDataFrame([(i, i % 2) for i, _ in rows if i < 200], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    odd = spark.createDataFrame([*rows[200:], (900, None), (901, ""), (None, "word " * 20_000)], SHAPE)
    got = {r["doc_id"]: r for r in toxicity.score(odd, model).collect()}
    assert sum(got[i]["predicted"] == i % 2 for i, _ in rows[200:]) >= 95
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[900]["score"] == got[901]["score"] < 0.7
    assert toxicity.without_toxic(odd, model).count() == sum(r["predicted"] == 0 for r in got.values())
    none = toxicity.fit(docs, labels.where("false"))
    assert all(r["predicted"] == 0 for r in toxicity.score(docs, none).collect())


def test_quality_learns_marked_words(spark):
    rows = corpus(random.Random(9), ["BUY!!", "click", "###"])
    docs, labels = spark.createDataFrame(rows, SHAPE), spark.createDataFrame([(i, 1 - i % 2) for i, _ in rows if i < 200], "doc_id long, quality int")
    model = quality_classifier.fit(docs, labels)
    odd = spark.createDataFrame([*rows[200:], (900, None), (901, "")], SHAPE)
    got = {r["doc_id"]: r for r in quality_classifier.score(odd, model).collect()}
    assert sum((got[i]["score"] >= 0.5) == (i % 2 == 0) for i, _ in rows[200:]) >= 95
    assert got[900]["score"] == got[901]["score"]
    none = quality_classifier.fit(docs, labels.where("false"))
    assert len({r["score"] for r in quality_classifier.score(docs, none).collect()}) == 1


def test_held_out_accuracy_on_the_shared_tables(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("doc_id is not null")
    for query, label in ((registry.op2_toxicity, "toxic"), (registry.op8_quality_classifier, "quality")):
        rows = query(spark, sf).where("held_out").join(labels.select("doc_id", label), "doc_id").where(f"{label} is not null").collect()
        good = [r["score"] for r in rows if r[label] == 1]
        bad = [r["score"] for r in rows if r[label] == 0]
        ranked = sum((g > b) + (g == b) / 2 for g in good for b in bad) / max(1, len(good) * len(bad))
        assert ranked >= 0.8, (label, ranked)


def test_toxicity_steps_are_kneser_ney_ratios(spark, monkeypatch):
    from math import log

    monkeypatch.setattr(toxicity, "LEAST_COUNT", 1)
    words = {"ab": (3, 0), "abc": (1, 2), "b": (0, 4), "x" * 12: (2, 1)}
    got = {r["prefix"]: r["step"] for r in toxicity.prefix_steps(spark.createDataFrame([(w, *n) for w, n in words.items()], "word string, n0 long, n1 long")).collect()}
    d, top = toxicity.DISCOUNT, toxicity.DEPTH
    nodes = {}
    for w, n in words.items():
        for p in [w[:i] for i in range(min(len(w), top) + 1)] + [w + toxicity.END]:
            a, b, k = nodes.get(p, (0, 0, 0))
            nodes[p] = (a + n[0], b + n[1], k + 1)
    parent = lambda p: p[:min(top, len(p) - 1)]
    assert set(got) == set(nodes) - {""}
    for p in got:
        q = parent(p)
        children = [x for x in nodes if x and parent(x) == q]
        share = nodes[p][2] / nodes[q][2]
        chance = []
        for c in (0, 1):
            kinds = sum(nodes[x][c] > 0 for x in children)
            chance.append((max(nodes[p][c] - d, 0) + d * kinds * share) / nodes[q][c] if nodes[q][c] else share)
        assert abs(got[p] - (log(chance[1]) - log(chance[0]))) < 1e-9, p


def test_dual_descent_reaches_the_least_hinge_loss():
    import numpy as np

    rng = np.random.default_rng(2)
    rows = [np.flatnonzero(rng.random(2) < 0.6) for _ in range(30)]
    y = np.array([1 if (0 in x) ^ (rng.random() < 0.2) else -1 for x in rows])
    r = np.array([1.0, -0.5])
    w, b = quality_classifier.dual_descent(rows, y, r, epochs=400)
    values = [quality_classifier.unit(r[x]) for x in rows]
    cost = [len(rows) / (2 * (y == v).sum()) for v in y]

    def loss(w0, w1, c):
        at = np.array([w0, w1])
        return (w0 * w0 + w1 * w1 + c * c) / 2 + sum(k * max(0.0, 1 - v * (at[x] @ z + c)) for k, v, x, z in zip(cost, y, rows, values, strict=True))

    grid = np.linspace(-3, 3, 41)
    assert loss(*w, b) <= min(loss(p, q, c) for p in grid for q in grid for c in grid) + 1e-6


def test_scores_of_odd_rows(spark):
    rows = corpus(random.Random(3), ["vilscum", "hatrag"])
    docs = spark.createDataFrame([(i, t, 1.0, 2) for i, t in rows], "doc_id long, text string, score double, label int")
    odd = spark.createDataFrame([(None, "vilscum " * 9, 1.0, 2), (None, "lora", 1.0, 2), (1, rows[1][1], 1.0, 2), (1, rows[1][1], 1.0, 2), (1, "", 1.0, 2), (2, "word " * 50_000, 1.0, 2)], docs.schema)
    for module, label in ((toxicity, "toxic"), (quality_classifier, "quality")):
        model = module.fit(docs, spark.createDataFrame([(i, i % 2) for i, _ in rows], f"doc_id long, {label} int"))
        got = module.score(odd, model).withColumn("held_out", module.held_out())
        found = got.collect()
        assert len(found) == 6 and all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in found)
        same = [r["score"] for r in found if r["doc_id"] == 1]
        assert len(set(same)) == 2
        assert module.score(odd.where("false"), model).collect() == []
    assert toxicity.without_toxic(odd, toxicity.fit(docs, spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int"))).columns == odd.columns
