"""The audit against a walk through every order with sets of documents."""

import re
from itertools import permutations

import pytest

from rangeloom.llm import filter_audit

DOCS, LABELS = "doc_id long, text string, lang string, mask string", "doc_id long, quality int, toxic int"


def brute_force(docs: list, labels: list) -> set:
    label = {}
    for i, q, t in labels:
        if i is not None:
            label[i] = tuple(max((x for x in both if x is not None), default=None) for both in zip(label.get(i, (None, None)), (q, t)))
    rows = []
    for i, text, lang, _ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
                 "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and any(j is not None and j < i and (other or "") == text for j, other, _, _ in docs)}
        rows.append((lang or "", {k for k, v in fails.items() if v}, *label.get(i, (None, None))))
    out, shares = [], {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order):
                gone, kept = [r for r in left if f in r[1]], [r for r in left if f not in r[1]]
                out.append((part, "".join(order), step + 1, len(kept), len(gone), sum(f in r[1] for r in mine) - len(gone), sum(r[1] == {f} for r in mine), sum(r[2] == 1 for r in gone), sum(r[3] == 1 for r in gone), f))
                shares[part, f] = shares.get((part, f), 0) + len(gone)
                left = kept
    return {(*r[:9], shares[r[0], r[9]]) for r in out}


def audited(spark, docs: list, labels: list) -> list:
    return filter_audit.audit(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(labels, LABELS)).collect()


def sample() -> tuple[list, list]:
    many = " ".join(f"w{i}" for i in range(250))
    texts = [many, many, "word " * 300, "SHOUT " * 250, f"{many} # more", f"\t{many}\x0b{many}\n", None, "", "a", f"{many}\x1c x", "x" * 50_000, f"{'Ab ' * 10}{many} $", many, "one two " * 100]
    docs = [(i, t, ["en", None, "de", ""][i % 4], "clash") for i, t in enumerate(texts)]
    docs += [(3, texts[3], "en", "again"), (3, texts[3], "de", "other part"), (None, many, "en", "null id"), (None, many, "en", "null id"), (0, "another text", "en", "same id")]
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(10)] + [(2, 1, None), (2, 0, 1), (None, 1, 1), (77, 1, 1)]
    return docs, labels


def test_equals_a_walk_through_all_orders(spark):
    docs, labels = sample()
    got = audited(spark, docs, labels)
    assert {tuple(r) for r in got} == brute_force(docs, labels)
    assert len(got) == 3 * 120 * 5
    assert got[0].asDict().keys() == {"part", "filter_order", "step", *filter_audit.COUNTS, "shapley"}


@pytest.mark.parametrize("labels", [[], [(0, None, None)]])
def test_no_labels_and_no_rows(spark, labels):
    docs, _ = sample()
    assert {tuple(r) for r in audited(spark, docs[:6], labels)} == brute_force(docs[:6], labels)
    assert audited(spark, [], labels) == []


def test_a_text_in_most_rows(spark):
    docs = [(i, "the same text", "en", "") for i in range(300)] + [(1000 + i, f"other {i}", "en", "") for i in range(100)]
    first = next(r for r in audited(spark, docs, []) if r["filter_order"] == "EABCD" and r["step"] == 1)
    assert (first["removed"], first["kept"]) == (299, 101)


def test_words_are_counted_where_their_text_is(spark):
    """One exchange of texts, none of words."""
    plan = filter_audit.word_counts(spark.createDataFrame(sample()[0], DOCS), 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
