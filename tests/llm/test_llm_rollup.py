
from tramline.llm import rollup
from tramline.store import scratch


def rows_of(df):
    return {(r.source, r.lang, r.tokenizer_version): (r.n_docs, r.n_tokens) for r in df.collect()}


def test_deltas_and_idempotent_commits(spark):
    docs = spark.createDataFrame([("a", "en", 3, 5), ("a", "en", 3, 5), ("b", None, None, 2), (None, "de", 7, 7)], "source string, lang string, old int, new int")
    t = rollup.TokenRollup(spark, scratch(spark, "rollup"))
    assert rows_of(t.totals()) == {}
    assert t.commit("1", rollup.inserts(docs, "v1", "old"))
    first = rows_of(t.totals())
    assert first == {("a", "en", "v1"): (2, 6), ("b", None, "v1"): (1, 0), (None, "de", "v1"): (1, 7)}
    assert not t.commit("1", rollup.inserts(docs, "v1", "old"))
    assert rows_of(t.totals()) == first
    t.commit("2", rollup.revisions(docs, "v1", "old", "new"))
    t.commit("3", rollup.inserts(docs, "v2", "new"))
    t.commit("4", rollup.deletes(docs.where("source = 'b'"), "v1", "new"))
    t.commit("5", rollup.inserts(docs.limit(0), "v1", "new"))
    want = {("a", "en", "v1"): (2, 10), (None, "de", "v1"): (1, 7), ("a", "en", "v2"): (2, 10), ("b", None, "v2"): (1, 2), (None, "de", "v2"): (1, 7)}
    assert rows_of(t.totals()) == want
    t.compact()
    assert rows_of(t.totals()) == want
    assert not t.commit("3", rollup.inserts(docs, "v2", "new"))
    t.commit("6", rollup.deletes(docs, "v2", "new"))
    t.compact()
    assert rows_of(t.totals()) == {k: v for k, v in want.items() if k[2] == "v1"}
    assert not t.commit("1", rollup.inserts(docs, "v1", "old")) and not t.commit("6", docs.limit(0))


def test_a_batch_that_died_is_written_anew(spark):
    docs = spark.createDataFrame([("a", "en", 3)], "source string, lang string, n int")
    t = rollup.TokenRollup(spark, scratch(spark, "rollup"))
    # What a writer leaves that died before it published: a folder without the batch's name.
    rollup.inserts(docs, "v", "n").write.parquet(f"{t.path}/made-x")
    assert t.committed() == [] and rows_of(t.totals()) == {}
    assert t.commit("x", rollup.inserts(docs, "v", "n"))
    assert rows_of(t.totals()) == {("a", "en", "v"): (1, 3)}


def test_names_of_any_kind_and_two_writers_at_once(spark):
    docs = spark.createDataFrame([("a", "en", 3)], "source string, lang string, n int")
    t, other = (rollup.TokenRollup(spark, p) for p in [scratch(spark, "rollup")] * 2)
    names = ["compact-1", "generation=7", "a/b", "..", "%2F", "\u00fc x", "made-1"]
    for name in names:
        assert t.commit(name, rollup.inserts(docs, "v", "n")) and not other.commit(name, rollup.inserts(docs, "v", "n"))
    assert rows_of(t.totals()) == {("a", "en", "v"): (7, 21)} and t.committed() == sorted(names)
    # Both writers have seen that the batch is not there; one of them publishes.
    for one in (t, other):
        one.known = lambda batch: False
    assert [one.commit("late", rollup.inserts(docs, "v", "n")) for one in (t, other)] == [True, False]
    assert rows_of(other.totals()) == {("a", "en", "v"): (8, 24)}
    # Two compactions of one state: the second is thrown away.
    state = other._state()
    assert t.compact()
    other._state = lambda: state
    assert not other.compact()
    del other._state
    assert rows_of(other.totals()) == {("a", "en", "v"): (8, 24)} and other.committed() == []
    # A batch published again while it was being folded counts once.
    assert other.commit("late", rollup.inserts(docs, "v", "n"))
    assert rows_of(t.totals()) == {("a", "en", "v"): (8, 24)}
    assert t.compact() and rows_of(t.totals()) == {("a", "en", "v"): (8, 24)}
