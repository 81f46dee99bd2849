import random
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from tramline.llm import simhash


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    parent = {p: p for p in set(prints)}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    distinct = sorted(parent)
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    return {p: find(p) for p in distinct}


def test_fingerprints():
    rng = random.Random(0)
    texts = ["", " \n", "A", "A b", "a B c", "Ünï Code tEXT here", "x\x0by\x0cz w"] + [" ".join(rng.choices(["ab", "Cd", "é"], k=rng.randrange(1, 50))) for _ in range(100)]
    for t in texts:
        assert simhash.fingerprint(t.encode()) == brute_print(t), t


@pytest.mark.parametrize("hot", [256, 1])
def test_links_and_components_match_brute_force(spark, hot):
    rng = random.Random(hot)
    prints = [rng.getrandbits(64) for _ in range(40)]
    for _ in range(400):
        p = rng.choice(prints)
        for b in rng.sample(range(64), rng.randrange(0, 4)):
            p ^= 1 << b
        prints.append(p)
    centre = rng.getrandbits(64)
    prints += [centre ^ (1 << b) for b in range(32)] + [0, 1 << 63, (1 << 64) - 1]
    distinct = sorted(set(prints))
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    df = spark.createDataFrame([(signed(p),) for p in distinct], "fp long")
    got = {(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(df, hot).collect()}
    want = {(a, b) for a in distinct for b in distinct if signed(a) < signed(b) and (a ^ b).bit_count() <= 2}
    assert got == want
    roots = {r.node % (1 << 64): r.component % (1 << 64) for r in simhash.components(simhash.links(df, hot)).collect()}
    groups = brute_components(prints)
    linked = {p for pair in want for p in pair}
    assert set(roots) >= linked - set(roots.values())
    for a, b in want:
        assert roots.get(a, a) == roots.get(b, b)
    assert len({roots.get(p, p) for p in distinct}) == len(set(groups.values()))


def test_documents(spark):
    rng = random.Random(8)
    base = [" ".join(rng.choices([f"w{i}" for i in range(300)], k=200)) for _ in range(30)]
    texts = base + [base[0]] * 60 + [b.replace("w1 ", "W1 ", 1) for b in base] + [b + " end" for b in base[:10]] + [None, "", " "]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, base[1], "x"), (2, base[2], "x"), (2, base[2], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(4)
    prints = [brute_print(t) for _, t, _ in rows]
    groups = brute_components(prints)
    least = {}
    for (i, _, _), p in zip(rows, prints, strict=True):
        if i is not None:
            least[groups[p]] = min(least.get(groups[p], i), i)
    want = Counter((i, p, least[groups[p]]) for (i, _, _), p in zip(rows, prints, strict=True))
    got = Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(df, "doc_id").collect())
    assert got == want
    assert simhash.near_duplicates(df.limit(0), "doc_id").count() == 0


def test_similar_matches_brute_force_jaccard(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [None, "", " ", "one two", "One  two"]
    for _ in range(12):
        base = rng.choices(vocabulary, k=rng.randrange(60, 200))
        for changes in (0, 0, 1, 1, 2, 3, 4, 6, 9):
            words = list(base)
            for k in rng.sample(range(len(words)), changes):
                words[k] = rng.choice(vocabulary)
            texts.append(" ".join(words))
    hot = rng.choices(vocabulary, k=150)  # a large group, linked over chains
    for _ in range(150):
        words = list(hot)
        for k in rng.sample(range(150), rng.randrange(1, 6)):
            words[k] = rng.choice(vocabulary)
        texts.append(" ".join(words))
    words = [(t or "").lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    group = list(range(len(texts)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    far = 0
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                far += (brute_print(texts[i]) ^ brute_print(texts[j])).bit_count() > 2
                a, b = find(i), find(j)
                group[max(a, b)] = min(a, b)
    assert far > 50  # what two bits of op9 do not reach
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in simhash.similar(df, "doc_id").collect()}
    assert got == {i: find(i) for i in range(len(texts))}
    assert simhash.similar(df.limit(0), "doc_id").count() == 0
    import corpus_pipeline

    docs = df.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(0).cast("long").alias("n_chars"))
    assert {r.doc_id for r in corpus_pipeline.keep_one_of_each(spark, docs, "").collect()} == {i for i in range(len(texts)) if find(i) == i}


def near_copies(n, words=100, seed=5):
    """Copies of one text, most of them too far from each other to be linked, and some that are not."""
    rng = random.Random(seed)
    base = [f"b{k}" for k in range(words)]
    texts = []
    for _ in range(n):
        copy = list(base)
        for k in rng.sample(range(words), rng.randrange(1, 9)):
            copy[k] = f"x{rng.randrange(1 << 40)}"
        texts.append(" ".join(copy))
    return texts


def jaccard_groups(texts):
    words = [t.split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    group = list(range(len(texts)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if find(i) != find(j) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                group[max(a, b)] = min(a, b)
    return {i: find(i) for i in range(len(texts))}


def test_similar_links_by_simhash_and_writes_no_pairs(spark, monkeypatch):
    hashes = simhash.np.unique(simhash.shingles(" ".join(f"w{i}" for i in range(400)).encode(), 5))
    bits = simhash.np.unpackbits(simhash.np.frombuffer(simhash.signature(hashes), "u1"), bitorder="little")
    ones = sum(simhash.np.unpackbits(simhash.np.frombuffer(simhash.signature(hashes[i : i + 1]), "u1"), bitorder="little").astype(int) for i in range(len(hashes)))
    assert (bits == (2 * ones > len(hashes))).all() and len(bits) == 512
    # Neither a table nor a list of links grows with the square of a group of near copies.
    texts = near_copies(500)
    written, linked = [], []
    own_stage, own_components = simhash.stage, simhash.components
    monkeypatch.setattr(simhash, "stage", lambda df, name: written.append((out := own_stage(df, name)).count()) or out)
    monkeypatch.setattr(simhash, "components", lambda edges: linked.append(edges.count()) or own_components(edges))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in simhash.similar(df, "doc_id").collect()}
    want = jaccard_groups(texts)
    assert got == want and 10 < len(set(want.values())) < 450
    assert max(written) <= len(texts)
    assert max(linked) <= len(simhash.bands(len(texts), 0.8)) * len(texts) / 2
    assert linked[-1] == len(texts) - len(set(want.values()))
    assert simhash.bands(1 << 24, 0.8)[0].size > simhash.bands(1000, 0.8)[0].size == simhash.NARROW


def test_similar_by_blocks(spark):
    texts = near_copies(150) + near_copies(60, 80, 6) + [f"own text number {i} of words{i} other{i}" for i in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = jaccard_groups(texts)
    for block in (1000, 4000):
        assert {r.doc_id: r.component_id for r in simhash.similar(df, "doc_id", block=block).collect()} == want
