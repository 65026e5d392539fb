import random
import re
from collections import Counter

from pyspark.sql import functions as F

from rangeloom.llm import line_dedup, quality_rules

SHAPE = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = " \t\n\x0b\x0c\r"


def rows(texts):
    return [(i, t, "en", f"src{i % 2}", len(t or "")) for i, t in enumerate(texts)]


def brute_lines(texts, size=3):
    kept = [[line.strip(SPACE) for line in (t or "").split("\n") if line.strip(SPACE)] for t in texts]
    seen, gone = set(), [set() for _ in texts]
    for d, lines in enumerate(kept):
        width = min(size, len(lines))
        for i in range(len(lines) - width + 1 if lines else 0):
            key = tuple(lines[i:i + width])
            if key in seen:
                gone[d] |= set(range(i, i + width))
            seen.add(key)
    out = []
    for d, t in enumerate(texts):
        if t is None or not gone[d]:
            out.append(t)
            continue
        keep, at, cut = [], 0, False
        for line in t.split("\n"):
            if line.strip(SPACE):
                cut = at in gone[d]
                at += 1
            if not cut:
                keep.append(line)
        out.append("\n".join(keep))
    return out, [len(k) for k in kept], [len(g) for g in gone]


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(3)
    texts = ["\n".join(rng.choice(["a b", " c", "d ", "", "e\r", "f", "  "]) for _ in range(rng.randrange(0, 25))) for _ in range(60)]
    texts += [None, "", "\n\n", "x", "x", "x\ny", "x\ny", texts[0], texts[0], "long " * 50_000]
    got = line_dedup.dedup(spark.createDataFrame(rows(texts), SHAPE)).orderBy("doc_id").collect()
    text, lines, removed = brute_lines(texts)
    assert [r["text"] for r in got] == text
    assert [r["n_lines"] for r in got] == lines
    assert [r["n_removed"] for r in got] == removed
    assert got[0]["source"] == "src0"


def test_line_dedup_finds_long_runs_of_fewer_lines_than_a_window(spark):
    passage = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    one, left, right, short = passage("one", 51), passage("left", 30), passage("right", 21), passage("short", 50)
    texts = ["\n".join(["a", one, "b", left, "", f" {right}\r", "c", short, "d"]), f"e\nf\n{one}\ng", f"h\n{left}\n{right}\ni", one, f"{left}\n{right}", short,
             f"j\nk\n{short}\nl", f"m\n{left}\nn\n{right}\no", f"p\n{one}\nq\n{one}"]
    got = line_dedup.dedup(spark.createDataFrame(rows(texts), SHAPE)).orderBy("doc_id").collect()
    assert [r["text"] for r in got] == [texts[0], "e\nf\ng", "h\ni", "", "", *texts[5:8], "p\nq"]
    assert [r["n_removed"] for r in got] == [0, 1, 2, 1, 2, 0, 0, 0, 2]


def test_line_dedup_matches_brute_force_with_long_lines(spark):
    rng = random.Random(12)
    lines = [" ".join(f"{c}{i}" for i in range(n)) for c, n in zip("abcdefgh", (60, 51, 50, 30, 21, 20, 3, 1), strict=True)] + ["", " "]
    texts = ["\n".join(rng.choice(lines) + rng.choice(["", "\t", " \r"]) for _ in range(rng.randrange(0, 7))) for _ in range(80)]
    seen, gone = set(), []
    for t in texts:
        kept = [(at, x.strip(SPACE)) for at, x in enumerate(t.split("\n")) if x.strip(SPACE)]
        found = set()
        for i in range(len(kept)):
            for width in (1, 2, 3):
                run = tuple(x for _, x in kept[i:i + width])
                if len(run) == width and (width == min(3, len(kept)) or sum(len(x.split()) for x in run) > 50):
                    found |= set(range(i, i + width)) if run in seen else set()
                    seen.add(run)
        gone.append(len(found))
    got = line_dedup.dedup(spark.createDataFrame(rows(texts), SHAPE)).orderBy("doc_id").collect()
    assert [r["n_removed"] for r in got] == gone


def test_line_dedup_of_no_rows(spark):
    assert line_dedup.dedup(spark.createDataFrame([], SHAPE)).collect() == []


def brute_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    count = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {i + j for i in range(len(words) - 4) if count[tuple(words[i:i + 5])] > 1 for j in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_rules_base_matches_brute_force(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["a", "b\n", "c#", "é𝄞", "d\td", "<x>"]) for _ in range(rng.randrange(0, 60))) for _ in range(80)]
    texts += [None, "", " \n", "one two three four five", "w " * 30_000]
    got = quality_rules.verdicts(spark.createDataFrame(rows(texts), SHAPE)).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        want = brute_statistics(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r["kept"] and r["base_failed"])


def test_quality_rules_reject_an_outlier_and_keep_its_group(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 8)))
    texts = [" ".join(word() for _ in range(rng.randrange(60, 120))) for _ in range(200)]
    texts.append(" ".join(word() + "***" for _ in range(80)))
    data = [(i, t, "en", None, 0) for i, t in enumerate(texts)]
    got = quality_rules.verdicts(spark.createDataFrame(data, SHAPE)).orderBy("doc_id").collect()
    assert not got[-1]["kept"]
    assert sum(not r["kept"] for r in got[:-1]) <= 2


def test_quality_rules_judge_small_groups_by_language_and_then_by_all(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 8)))
    clean = lambda: " ".join(word() for _ in range(rng.randrange(60, 120)))
    odd = lambda: " ".join(word() + "***" for _ in range(80))
    groups = [("en", "big", 100), ("de", "big", 60), ("en", "small", 5), ("en", None, 5), ("fr", "small", 5), (None, None, 3)]
    data = [(t, lang, source, bad) for lang, source, n in groups for t, bad in [(clean(), False) for _ in range(n)] + [(odd(), True)]]
    data += [(clean(), "it", f"s{i % 9}", False) for i in range(45)] + [(odd(), "it", "s0", True)]
    docs = spark.createDataFrame([(i, t, lang, source, 0) for i, (t, lang, source, _) in enumerate(data)], SHAPE)
    got = quality_rules.verdicts(docs).orderBy("doc_id").collect()
    assert all(r["distance"] is not None for r in got)
    assert all(not r["kept"] for r, (*_, bad) in zip(got, data, strict=True) if bad)
    assert sum(not r["kept"] for r, (*_, bad) in zip(got, data, strict=True) if not bad) <= 2


def test_quality_rules_of_no_rows(spark):
    empty = quality_rules.verdicts(spark.createDataFrame([], SHAPE))
    assert empty.where(F.col("kept")).count() == 0


def test_line_dedup_of_repeated_and_missing_ids_and_clashing_names(spark):
    data = [(1, "a\nb\nc", 77, 1), (2, "a\nb\nc", 77, 2), (2, "x\ny\nz", 77, 3), (2, "x\ny\nz", 77, 4), (None, "a\nb\nc", 77, 5), (None, "k\nl\nm", 77, 6), (None, None, 77, 7), (3, "k\nl\nm\nn", 77, 8)]
    docs = spark.createDataFrame(data, "doc_id long, text string, n_lines long, _gone long")
    got = {r["_gone"]: r for r in line_dedup.dedup(docs).collect()}
    assert [got[i]["text"] for i in range(1, 9)] == ["a\nb\nc", "", "x\ny\nz", "x\ny\nz", "", "", None, "k\nl\nm\nn"]
    assert [got[i]["n_removed"] for i in range(1, 9)] == [0, 3, 0, 0, 3, 3, 0, 0]
    kept = line_dedup.dedup(docs, counts=False)
    assert kept.columns == docs.columns and all(r["n_lines"] == 77 for r in kept.collect())


def test_quality_rules_find_the_least_determinant(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    d, h = len(quality_rules.VECTOR), quality_rules.SHARE
    clean = rng.normal(0, 2.0, (160, d)) @ np.triu(np.full((d, d), 0.4)) + 5
    points = np.round(np.r_[clean, rng.normal(40, 1.0, (40, d))] * quality_rules.GRID) / quality_rules.GRID
    rows = spark.createDataFrame([("en", "s", *map(float, p)) for p in points], "g_lang string, g_source string, " + ", ".join(f"{v} double" for v in quality_rules.VECTOR))
    got = quality_rules.scatter(rows).first()
    found = 2 * sum(np.log(got[f"l_{i}_{i}"]) for i in range(d))
    best, count = np.inf, int(np.ceil(h * len(points)))
    floors = np.array(quality_rules.FLOORS)
    for start in range(60):
        at = points[rng.choice(len(points), d + 3, replace=False)]
        for _ in range(40):
            m, c = at.mean(axis=0), np.cov(at.T, bias=True)
            c = c + np.diag(np.maximum(floors - np.diag(c), 0))
            z = np.linalg.solve(c, (points - m).T).T
            at = points[np.argsort(((points - m) * z).sum(axis=1), kind="stable")[:count]]
        best = min(best, np.linalg.slogdet(np.cov(at.T, bias=True) * 1.42)[1])
    assert found <= best + 0.1
    assert all(abs(got[f"m_{i}"] - clean[:, i].mean()) < 1.5 for i in range(d))


def test_quality_rules_of_repeated_and_missing_ids_and_clashing_names(spark):
    text = " ".join(f"w{i}" for i in range(50))
    data = [(1, text, "en", "s", 5, 1.0), (1, text, "en", "s", 5, 1.0), (1, "short", "en", "s", 5, 1.0), (None, text, None, None, 5, 1.0), (None, None, "en", "s", 5, 1.0), (2, "a b " * 20_000, "en", "s", 5, 1.0)]
    got = quality_rules.verdicts(spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_words long, distance double")).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"], r["base_failed"], r["kept"]) for r in got) == [
        (0, 0, True, False), (0, 50, False, True), (1, 1, True, False), (1, 50, False, True), (1, 50, False, True), (2, 40_000, True, False)]
