import random
from collections import Counter

import numpy as np
import pytest

from tramline.llm import repeats


def brute(texts, window):
    words = [(t or "").encode().split() for t in texts]
    counts = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {i + k for i in range(len(w) - window + 1) if counts[tuple(w[i : i + window])] > 1 for k in range(window)}
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


@pytest.mark.parametrize("window", [35, 4, 5])
def test_removed_words_match_brute_force(spark, window):
    rng = random.Random(window)
    vocabulary = [f"w{i}" for i in range(4000)]
    passage = [" ".join(rng.choices(vocabulary, k=window + e)) for e in (0, 1, 17, 60)]
    texts = [None, "", " \t\n", "one", "a " * (window + 3), "a " * (window - 1), " x " * 50]
    for _ in range(120):
        parts = [" ".join(rng.choices(vocabulary, k=rng.randrange(0, 3 * window))) for _ in range(3)]
        parts.insert(rng.randrange(3), rng.choice(passage + [""]))
        texts.append(rng.choice(["  ", "\n"]).join(parts))
    texts += [texts[30]] * 40 + [texts[31]]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, texts[33], "x"), (5, texts[5], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string").repartition(5)
    want = brute([t for _, t, _ in rows], window)
    got = repeats.remove_repeats(df, "doc_id", window=window).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_removed, r.kept) for r in got) == sorted((i if i is not None else -1, *w) for (i, _, _), w in zip(rows, want, strict=True))
    assert repeats.remove_repeats(df.limit(0), "doc_id", window=window).count() == 0


def test_small_chunks_and_spans(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choices("abc", k=rng.randrange(0, 60))) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = {(r["id"], r.check): r.key for r in repeats._keyed(df, "doc_id", "text").collect()}
    spans = {rows[r["id"], r.check]: [tuple(s) for s in r.spans] for r in repeats.repeat_spans(df, "doc_id", window=6, chunk=50).collect()}
    want = brute(texts, 6)
    for i, (_, removed, _) in enumerate(want):
        assert len({k for a, b in spans.get(i, []) for k in range(a, b)}) == removed


def test_rolling_is_a_function_of_the_window():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 3, 500).astype(np.uint64)
    for width in (1, 2, 5, 18, 35):
        h = repeats.rolling(codes, width)
        seen = {}
        for i, v in enumerate(h.tolist()):
            assert seen.setdefault(tuple(codes[i : i + width].tolist()), v) == v
        assert len(set(seen.values())) == len(seen)
        if width > 1:
            assert (repeats.sliding_min(codes, width) == [codes[i : i + width].min() for i in range(len(codes) - width + 1)]).all()
