import random
import time

import numpy as np
import pytest

from tramline.llm import decontaminate as d


def test_lcs_and_answers():
    def brute(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = [0, *row[:0]] + _next(row, x, b)
        return row[-1]

    def _next(row, x, b):
        out, left = [], 0
        for j, y in enumerate(b):
            left = row[j] + 1 if x == y else max(left, row[j + 1])
            out.append(left)
        return out

    rng = random.Random(1)
    for _ in range(200):
        a, b = [rng.randrange(4) for _ in range(rng.randrange(30))], [rng.randrange(4) for _ in range(rng.randrange(1, 20))]
        masks = {}
        for i, w in enumerate(b):
            masks[w] = masks.get(w, 0) | 1 << i
        assert d.lcs(a, masks, len(b)) == brute(a, b)
    assert d.answer_words(b"One two three. Four five.") == 2
    assert d.answer_words(b"one two three four five six") == 2


def test_latent_space_keeps_what_dense_algebra_keeps():
    rng = np.random.default_rng(0)
    terms, cells = 60, 300
    # Few themes, so that few dimensions carry nearly all.
    term = (rng.integers(0, 5, cells)[:, None] * 12 + rng.integers(0, 12, (cells, 12))).astype(np.uint16)
    term[:20, 9:] = d.TERMS  # shorter passages
    idf = np.zeros(d.TERMS)
    idf[:terms] = rng.uniform(0.5, 2, terms)
    dense = np.zeros((cells, d.TERMS + 1))
    np.add.at(dense, (np.arange(cells)[:, None], term), 1)
    dense = dense[:, :terms] * idf[:terms]
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    plain = rng.standard_normal((d.TERMS, 30))
    product = np.zeros((d.TERMS, 30), np.float32)
    assert d.gram_product(term, idf, d._with_zero(plain * idf[:, None]), product) == cells
    product = (product * idf[:, None])[:terms]
    assert np.allclose(product, dense.T @ dense @ plain[:terms], atol=1e-3)
    space = d.nystrom(product, plain[:terms], 5)
    best = np.linalg.svd(dense, full_matrices=False)[2][:5].T
    assert np.linalg.norm(dense @ space) > 0.99 * np.linalg.norm(dense @ best)


def test_sums_of_runs_are_exact_and_faster_than_reduceat():
    rng = np.random.default_rng(4)
    matrix = d._with_zero(rng.integers(-9, 9, (300, 72)))
    for lengths in ([1], [8, 1, 9, 64, 65, 1, 513, 2], rng.integers(1, 40, 500), np.ones(20, int)):
        first = np.cumsum(lengths) - lengths
        rows = rng.integers(0, 300, int(np.sum(lengths)))
        assert (d._summed(matrix, rows, first) == np.add.reduceat(matrix[rows], first, axis=0)).all()
    cells = rng.integers(0, 301, (1100, 7)).astype(np.uint16)
    assert (d._gathered(matrix, cells) == matrix[cells].sum(1)).all()
    assert d._gathered(matrix, cells[:0]).shape == (0, 72)
    # By reduceat alone the sums took longer than the whole product does now.
    term = (rng.zipf(1.2, (4000, 32)) % d.TERMS).astype(np.uint16)
    idf, plane = np.ones(d.TERMS), d._with_zero(rng.standard_normal((d.TERMS, 72)))
    total = np.zeros((d.TERMS, 72), np.float32)

    def seconds(run):
        best = 9.0
        for _ in range(5):
            at = time.perf_counter()
            run()
            best = min(best, time.perf_counter() - at)
        return best

    flat = term.ravel()
    order = np.argsort(flat, kind="stable")
    by = flat[order]
    first = np.flatnonzero(np.append(True, by[1:] != by[:-1]))
    dense = d._gathered(plane, term)
    assert seconds(lambda: d.gram_product(term, idf, plane, total)) < seconds(lambda: np.add.reduceat(dense.take(order // 32, axis=0), first, axis=0))


def test_hashes_do_not_depend_on_the_place():
    texts = ["One two, THREE\n".encode(), b"", "naïve-été 3 two".encode(), b"x" * 700_000, b"one " * 200_000 + b"two"]
    words, sizes = d.hashed(texts)
    assert sizes.tolist() == [3, 0, 4, 1, 200_001]
    alone = [d.word_hashes(w)[0][0] for w in (b"one", b"two", b"three", "naïve".encode(), "été".encode(), b"3", b"two", b"x" * 700_000)]
    assert words[:8].tolist() == alone and set(words[8:-1].tolist()) == {alone[0]} and words[-1] == alone[1]
    assert len(set(alone)) == 7


def test_weighted_lcs_and_cells():
    rng = random.Random(2)
    for _ in range(100):
        a, b = (np.array([rng.randrange(5) for _ in range(rng.randrange(1, 15))]) for _ in range(2))
        w = np.array([rng.random() for _ in a])
        table = np.zeros((len(a) + 1, len(b) + 1))
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = max(table[i, j + 1], table[i + 1, j], table[i, j] + w[i] if a[i] == b[j] else 0)
        assert abs(d.weighted_lcs(a, w, b) - table[-1, -1]) < 1e-9
    cells, text = d.cells_of(np.arange(7, dtype=np.uint32), np.array([3, 0, 4]), 2)
    assert cells.tolist() == [[0, 1], [2, d.TERMS], [3, 4], [5, 6]] and text.tolist() == [0, 0, 2, 2]


def make(spark, seed=3):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 5))) for _ in range(3000)]
    text = lambda n: " ".join(rng.choices(vocabulary, weights=[1 / (i + 5) for i in range(3000)], k=n))
    items = [text(n).capitalize() + ". " + text(6).capitalize() + "." for n in range(12, 60)]
    clean = [text(rng.randrange(0, 400)) for _ in range(300)]
    planted, leaks = [], {}
    for i, item in enumerate(items):
        words = item.split()
        if i % 2:  # a paraphrase: every sixth word changed
            words = [w if k % 6 else text(1) for k, w in enumerate(words)]
        leaks[1000 + i] = i
        planted.append((1000 + i, text(rng.randrange(0, 150)) + " " + " ".join(words).upper() + " " + text(rng.randrange(0, 150))))
    docs = [(i, t) for i, t in enumerate(clean)] + planted
    return docs, items, leaks


def test_leaks_are_found_and_clean_texts_left(spark):
    docs, items, leaks = make(spark)
    extra = [(None, docs[-1][1]), (7777, None), (7778, ""), (1000, docs[300][1]), (7779, " ".join(t for _, t in docs))]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs + extra], "doc_id long, text string, item_id int").repartition(3)
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(90, None), (91, ""), (92, "..."), (93, items[4])], "item_id long, text string")
    got = d.contaminated(df, bench, "doc_id").collect()
    pairs = {(r.doc_id, r.item_id) for r in got}
    assert {(k, i) for k, i in leaks.items()} <= pairs
    assert (None, len(items) - 1) in pairs and (1004, 93) in pairs
    assert {i for k, i in pairs if k == 7779} >= set(leaks.values())
    assert not [p for p in pairs if p[0] is not None and p[0] < 300]
    assert all(i == leaks[k] or i == 93 for k, i in pairs if k is not None and k < 7000)
    assert sum(r.doc_id == 1000 for r in got) == 2


def test_blocks_of_items_give_the_same_leaks(spark):
    docs, items, leaks = make(spark, 5)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in d.contaminated(df, bench, "doc_id", block=20).collect()}
    assert got == set(leaks.items())
    assert d.contaminated(df.limit(0), bench, "doc_id").count() == 0
    assert d.contaminated(df, bench.limit(0), "doc_id").count() == 0


@pytest.mark.parametrize("same", [True, False])
def test_a_paraphrase_that_a_third_of_the_rows_hold_is_found(spark, same):
    rng = random.Random(9)
    docs, items, leaks = make(spark, 7)
    clean = [(i, " ".join(t.split()[:120])) for i, t in docs[:300]]
    item, others = items[30].split(), [w for t in items for w in t.split()]

    def copy():
        words = [w if k % 6 else rng.choice(others) for k, w in enumerate(item)]
        return " ".join(rng.choices(others, k=30) + words + rng.choices(others, k=30))

    text = copy()
    hot = [(5000 + i, text if same else copy()) for i in range(150)]
    df = spark.createDataFrame(clean + hot, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in d.contaminated(df, bench, "doc_id").collect()}
    assert got == {(i, 30) for i, _ in hot}


def brute(docs, items):
    """All pairs, all passages: what the checks alone accept."""
    words = [d.word_hashes((t or "").encode())[0] for _, t in docs]
    cells = d.cells_of(np.concatenate(words), np.array([len(w) for w in words]), d.PASSAGE)[0]
    idf = np.log1p(len(cells) / (np.bincount(d._distinct(cells)[1], minlength=d.TERMS) + 1))
    found = set()
    for i, text in enumerate(items):
        item = d.Item(text.encode(), idf)
        for (k, _), w in zip(docs, words, strict=True):
            for start in range(0, len(w), d.PASSAGE // 2):
                m = item.measure(w, start, start + d.PASSAGE)
                if m and d.accepted(*m[:2]):
                    found.add((k, i))
    return found


@pytest.mark.parametrize("rate", [0.2, 0.35, 0.5])
def test_paraphrases_are_found_as_by_brute_force(spark, rate):
    rng = random.Random(11)
    docs, items, _ = make(spark, 11)
    clean = docs[:300]
    beside = [w for _, t in clean for w in t.split()]
    planted, wanted = [], set()
    for kind in range(2):
        for i, item in enumerate(items):
            words = item.split()
            for k in rng.sample(range(len(words)), round(rate * len(words))):
                words[k] = rng.choice(beside) if kind else f"zq{rng.randrange(10**9)}"
            key = 2000 + len(planted)
            planted.append((key, " ".join(rng.choices(beside, k=rng.randrange(60)) + words + rng.choices(beside, k=rng.randrange(60)))))
            wanted.add((key, i))
    rows = clean + planted
    got = {(r.doc_id, r.item_id) for r in d.contaminated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), "doc_id").collect()}
    all_pairs = brute(rows, items)
    assert got <= all_pairs and len(got & all_pairs) >= 0.95 * len(all_pairs)
    assert got <= wanted and len(got) >= 0.9 * len(wanted)


def test_a_large_benchmark_is_searched_in_bounded_chunks():
    rng = np.random.default_rng(5)
    rows, targets = (d._unit(rng.standard_normal((n, 8)).astype(np.float32)) for n in (300, 2000))
    terms = rng.integers(0, 50, (300, d.PASSAGE)).astype(np.uint16)
    pieces = rng.integers(0, 50, (2000, d.PASSAGE)).astype(np.uint16)
    weights = np.full(pieces.shape, 1 / d.PASSAGE, np.float32)
    before, d.CELLS = d.CELLS, 5000
    try:
        got = {(r, p) for r, p, _ in d.candidates(terms, rows, pieces, weights, targets)}
    finally:
        d.CELLS = before
    alike = rows @ targets.T >= d.COSINE
    assert got == {(r, p) for r, p in zip(*np.nonzero(alike), strict=True) if np.isin(pieces[p], terms[r]).mean() >= d.SHARE}
