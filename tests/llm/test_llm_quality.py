import random
import re
from collections import Counter

import numpy as np

from tramline.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)]


TEXTS = [None, "", " \n\t", "a b c a b c a", "x\nx\n\ny\nx \n y", "ü# %|ß a\x0bb\x0cc\x1cd  e", "a a a a", "one two", "# " * 100]


def test_counts_match_brute_force():
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice("ab #\n\té") for _ in range(rng.randrange(400))) for _ in range(200)]
    for t in texts:
        assert quality.statistics((t or "").encode())[:5] == brute(t), t


def test_forest_is_monotone_flat_and_accurate():
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(3000, 3))
    y = ((x[:, 0] < 0.5) ^ (rng.uniform(size=3000) < 0.05)).astype(float)
    f = quality.fit(x, y, np.array([-1, 0, 1]), trees=30)
    held = rng.uniform(size=(2000, 3))
    assert (((f.score(held) > 0) == (held[:, 0] < 0.5)).mean()) > 0.97

    def walk(row, node):
        while f.left[node] != node:
            node = f.left[node] if row[f.feature[node]] <= f.threshold[node] else f.right[node]
        return f.value[node]

    assert np.allclose([f.bias + sum(walk(r, n) for n in f.roots) for r in held[:50]], f.score(held[:50]))
    for j, sign in ((0, -1), (2, 1)):
        grid = np.repeat(held[:40], 50, axis=0)
        grid[:, j] = np.tile(np.linspace(0, 1, 50), 40)
        assert (sign * np.diff(f.score(grid).reshape(40, 50), axis=1) >= -1e-12).all()


def _tables(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8)))
    good = [" ".join(word() for _ in range(80)) for _ in range(60)]
    bad = [" ".join(word() + rng.choice(["##", "***", "%%%"]) for _ in range(80)) for _ in range(60)]
    rows = [(i, t, "z") for i, t in enumerate(good + bad)] + [(None, good[0], "z"), (500, None, "z"), (501, "short", "z"), (0, good[0], "z")]
    labels = [(i, int(i < 60)) for i in range(0, 120, 2)] + [(None, 1), (3, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_verdicts(spark):
    docs, labels = _tables(spark)
    rows = quality.quality(docs, labels, "doc_id").collect()
    assert len(rows) == docs.count()
    kept = {r.doc_id: r.kept for r in rows if r.doc_id is not None and r.doc_id < 120}
    assert sum(kept[i] for i in range(60)) >= 58 and sum(kept[i] for i in range(60, 120)) <= 2
    assert all(r.base_failed and not r.kept for r in rows if r.doc_id in (500, 501))
    assert {r.kept for r in rows if r.doc_id is None} == {True}
    column = quality.with_statistics(docs).select(quality.verdict(None)("statistics").alias("k")).where("k").count()
    assert column == 122


def test_no_labels_and_no_rows(spark):
    docs, labels = _tables(spark)
    assert quality.quality(docs, labels.limit(0), "doc_id").where("kept").count() == 122
    assert quality.quality(docs.limit(0), labels, "doc_id").count() == 0
