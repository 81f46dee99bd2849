"""Very long texts, keys of other types, and keys named like columns of a result, through the operators."""

import pytest
from pyspark.sql import functions as F

from tramline.llm import chat, decontaminate, quality, repeats, rollup, secrets, sharding, simhash
from tramline.store import scratch

LONG = " ".join(f"word{i % 50_000} secret{i}" for i in range(150_000))  # some 3 MB


@pytest.fixture(scope="module")
def docs(spark):
    rows = [("a", LONG, "en", "s"), ("b", LONG, "en", None), (None, None, None, None), ("", "", "de", "s"), ("c", "short text", "en", "s"), ("c", "short text", "en", "s"), (None, "short", None, "s")]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id string, text string, lang string, source string, spans string, n_words int")


def test_long_texts_and_string_keys(spark, docs):
    n = len(LONG.split())
    labels = spark.createDataFrame([("a", 1), ("c", 0)], "doc_id string, quality int")
    got = {r.doc_id: r for r in quality.quality(docs, labels, "doc_id").collect()}
    assert got["a"].n_words == n and got["a"].n_repeat_words == 0 and got["c"].base_failed
    places = sharding.kd_shards(docs, "doc_id", shards=2).collect()
    assert len(places) == 7 and len({(r["size"], r.text_crc32, r.shard) for r in places}) == 5
    gone = {r.doc_id: r for r in repeats.remove_repeats(docs, "doc_id").collect()}
    assert gone["a"].n_removed == gone["b"].n_removed == n and gone["c"].n_removed == 0
    near = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs, "doc_id").collect()}
    assert {("a", "a"), ("b", "a"), ("c", "c")} <= near
    close = {(r.doc_id, r.component_id) for r in simhash.similar(docs, "doc_id").collect()}
    assert {("a", "a"), ("b", "a"), ("c", "c")} <= close
    found = secrets.scan(docs.withColumn("text", F.concat("text", F.lit(" token=abcdefgh"))), scratch(spark, "ledger"), ["doc_id"]).collect()
    assert sorted(r.n_assign for r in found) == [0] + [1] * 6 and f"assign:{len(LONG) + 1}:" in max((r.spans or "" for r in found), key=len)
    bench = spark.createDataFrame([("i", " ".join(LONG.split()[1000:1040]) + ".")], "item_id string, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench, "doc_id").collect()} == {("a", "i"), ("b", "i")}
    t = rollup.TokenRollup(spark, scratch(spark, "rollup"))
    t.commit("1", rollup.inserts(docs.withColumn("n", F.length("text")), "v", "n"))
    assert {(r.source, r.lang): r.n_tokens for r in t.totals().collect()}["s", "en"] == len(LONG) + 20


def test_long_conversations(spark):
    turns = [(1, i % 2 == 1, j, "user" if j % 2 == 0 else "assistant", LONG if j == 1 else f"turn {j}{'x' if i and j == 2999 else ''}") for i in range(2) for j in range(3000)]
    turns += [(2, False, 0, "assistant", None), (2, True, 0, None, "b"), (3, False, 0, "user", "alone")]
    df = spark.createDataFrame([(*t, "x") for t in turns], "pair long, rejected boolean, turn int, role string, text string, upto string")
    got = {r.pair: r for r in chat.preference_pairs(df, "pair", "rejected").collect()}
    assert set(got) == {1, 2} and got[1].n_prefix == 2999
    for r in got.values():
        for text, mask in ((r.chosen, r.chosen_mask), (r.rejected, r.rejected_mask)):
            assert "".join(text[s.start : s.end] for s in mask) == "".join(part.partition("|>\n")[2] + chat.END for part in text.split(chat.END) if part.startswith("<|assistant|>"))


def test_keys_named_like_columns_of_a_result_are_refused(spark, docs):
    labels = spark.createDataFrame([("a", 1)], "doc_id string, quality int")
    for call in (
        lambda: quality.quality(docs, labels, "n_words"), lambda: repeats.remove_repeats(docs, "n_words"), lambda: simhash.near_duplicates(docs.withColumn("FP", F.lit(1)), "FP"),
        lambda: sharding.kd_shards(docs.withColumn("slot", F.lit(1)), "slot"), lambda: secrets.scan(docs, "unused", ["spans"]),
    ):
        with pytest.raises(ValueError):
            call()
