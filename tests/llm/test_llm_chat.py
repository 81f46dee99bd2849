import random

from tramline.llm import chat


def brute(chosen, rejected):
    n = 0
    while n < min(len(chosen), len(rejected)) and chosen[n][1:] == rejected[n][1:]:
        n += 1

    def render(turns):
        out, mask = "", []
        for _, role, text in turns:
            out += f"<|{role}|>\n"
            start = len(out)
            out += text + "<|end|>\n"
            if role == "assistant":
                mask.append((start, len(out)))
        return out, mask

    (a, am), (b, bm) = render(chosen[n:]), render(rejected[n:])
    return n, render(chosen[:n])[0], a, b, am, bm


def test_pairs_match_brute_force(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for pair in range(60):
        sides = []
        for rej in (False, True):
            turns = [(k, rng.choice(["user", "assistant"]), rng.choice(["a", "bß🙂", ""])) for k in range(rng.randrange(0, 6))]
            sides.append(turns)
        if pair % 3 == 0:
            sides[1] = list(sides[0])
        for rej, turns in zip((False, True), sides, strict=True):
            rows += [(pair, rej, k, r, t, "x") for k, r, t in turns]
        if sides[0] and sides[1]:
            want[pair] = brute(*sides)
    rows += [(None, True, 0, "user", "x", "x"), (1, None, 0, "user", "x", "x")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "pair long, rejected boolean, turn long, role string, text string, prompt string")
    got = chat.preference_pairs(df, "pair", "rejected").collect()
    assert {r.pair: (r.n_prefix, r.prompt, r.chosen, r.rejected, [tuple(s) for s in r.chosen_mask], [tuple(s) for s in r.rejected_mask]) for r in got} == want
    assert chat.preference_pairs(df.limit(0), "pair", "rejected").count() == 0


def test_nulls_ties_and_one_side(spark):
    rows = [(1, False, 0, None, None), (1, True, 0, None, None), (1, False, 1, "assistant", "y"), (1, False, 1, "assistant", "x"), (2, False, 0, "user", "only")]
    df = spark.createDataFrame(rows, "pair long, rejected boolean, turn long, role string, text string")
    (r,) = chat.preference_pairs(df, "pair", "rejected").collect()
    assert (r.pair, r.n_prefix, r.prompt, r.rejected) == (1, 1, "<|unknown|>\n<|end|>\n", "")
    assert r.chosen == "<|assistant|>\nx<|end|>\n<|assistant|>\ny<|end|>\n"
