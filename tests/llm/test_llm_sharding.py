import math
import random
import zlib
from collections import Counter
from itertools import combinations

import pytest

from tramline.llm import sharding


def test_shards(spark):
    rng = random.Random(5)
    texts = ["x" * rng.randrange(0, 400) + str(i) for i in range(1500)] + ["copy" * 20] * 700 + [None, "", "ü"]
    rows = [(i, t, rng.choice(["en", "de", None]), "s0" if i % 3 else f"s{i % 7}", "c") for i, t in enumerate(texts)] + [(None, "n", None, None, "c"), (0, texts[0], "en", "s0", "c"), (0, texts[0], "en", "s0", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, shard string")
    got = sharding.kd_shards(df, "doc_id").collect()
    assert len(got) == len(rows)
    size = lambda t: len((t or "").encode()) + 16
    assert sorted((r.doc_id or -1, r["size"], r.text_crc32) for r in got) == sorted((i or -1, size(t), zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    shards = {}
    for r in got:
        shards.setdefault(r.shard, []).append(r)
    assert set(shards) == set(range(40))
    assert all(sorted(r.slot for r in rs) == list(range(len(rs))) for rs in shards.values())
    total, each = sum(size(t) for _, t, *_ in rows), [sum(r["size"] for r in rs) for rs in shards.values()]
    # Each of the six cuts is off by half a document at most.
    assert max(abs(b - total / 40) for b in each) <= 3 * max(size(t) for _, t, *_ in rows)
    # Copies share a shard, unless they outweigh one.
    places, weight = {}, Counter()
    for r in got:
        places.setdefault((r["size"], r.text_crc32), set()).add(r.shard)
        weight[r["size"], r.text_crc32] += r["size"]
    assert all(len(p) == 1 or weight[k] > total / 40 for k, p in places.items())
    again = {(r.doc_id, r["size"], r.shard, r.slot) for r in sharding.kd_shards(df.repartition(7), "doc_id").collect()}
    assert again == {(r.doc_id, r["size"], r.shard, r.slot) for r in got}


def test_fewer_rows_than_shards_and_none(spark):
    df = spark.createDataFrame([(1, "a", None, None), (2, "b", None, None)], "doc_id long, text string, lang string, source string")
    got = sharding.kd_shards(df, "doc_id").collect()
    assert len({r.shard for r in got}) == 2 and {r.slot for r in got} == {0}
    assert sharding.kd_shards(df.limit(0), "doc_id").count() == 0


def test_main_path_has_no_python(spark):
    df = spark.createDataFrame([(1, "a", None, None)], "doc_id long, text string, lang string, source string")
    plan = sharding.kd_shards(df, "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def brute_tree(items, low, high):
    """shard by item, of items (coordinates, hash, bytes), with every prefix and all pairs of moves tried."""
    if high - low == 1 or not items:
        return {i[1]: low for i in items}
    wide = max(range(3), key=lambda d: max(i[0][d] for i in items) - min(i[0][d] for i in items))
    order = sorted(items, key=lambda i: (i[0][wide], i[1]))
    half = (high - low) // 2
    goal = sum(i[2] for i in items) * half / (high - low)
    held = min(range(len(order) + 1), key=lambda k: (abs(goal - sum(i[2] for i in order[:k])), k))
    left = {i[1] for i in order[:held]}
    off = lambda side: abs(goal - sum(i[2] for i in items if i[1] in side))
    best = min([left, *(left ^ set(m) for n in (1, 2) for m in combinations([i[1] for i in items], n))], key=off)
    assert off(best) <= off(left)
    return off(best), best, wide


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_cuts_are_those_of_brute_force(seed):
    rng = random.Random(seed)
    sizes = [rng.randrange(20, 4000) for _ in range(45)]
    items = [((math.log2(s) / 40, rng.random(), 0.0), rng.randrange(1 << 60), s) for s in sizes]
    off, _, wide = brute_tree(items, 0, 5)
    order = sorted(items, key=lambda i: (i[0][wide], i[1]))
    goal = sum(sizes) * 2 / 5
    held, moved = sharding.best_cut([i[2] for i in order], goal)
    left = {i[1] for i in order[:held]} ^ {order[k][1] for k in moved}
    assert abs(abs(goal - sum(i[2] for i in items if i[1] in left)) - off) < 1e-6 and len(moved) <= 2


@pytest.mark.skip(reason="open: with so few bins it did not end within 150 s, and why is not known")
def test_small_histograms_give_even_whole_shards(spark, monkeypatch):
    rng = random.Random(6)
    texts = [f"t{i} " + "y" * rng.randrange(0, 900) for i in range(600)]
    texts += [t for t in texts[:60] for _ in range(rng.randrange(1, 4))]
    rows = [(i, t, rng.choice(["en", "de", None]), f"s{i % 5}") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    monkeypatch.setattr(sharding, "BINS", 16)
    monkeypatch.setattr(sharding, "PARTS", 8)
    monkeypatch.setattr(sharding, "NEAR", 60)
    got = sharding.kd_shards(df, "doc_id", shards=7).collect()
    each = Counter()
    for r in got:
        each[r.shard] += r["size"]
    assert len(got) == len(rows) and len(each) == 7 and max(each.values()) - min(each.values()) < 200
    assert len({(r.text_crc32, r.shard) for r in got}) == len(set(texts))


def test_a_group_that_holds_most_rows_is_dealt(spark):
    rows = [(None if i % 2 else 5, "same " * 30, "en" if i % 3 else "de", "s") for i in range(3000)] + [(i, f"other {i} " * 9, "fr", None) for i in range(400)]
    got = sharding.kd_shards(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), "doc_id", shards=8).collect()
    each, slots = Counter(), {}
    for r in got:
        each[r.shard] += r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
    # Shards that are all of one group differ by one of its parts at most.
    assert len(got) == 3400 and max(each.values()) - min(each.values()) <= sum(each.values()) / 8 / sharding.PARTS + 166
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sum(len({r.shard for r in got if r.text_crc32 == c}) > 1 for c in {r.text_crc32 for r in got}) == 1
