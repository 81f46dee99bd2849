import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tramline import store
from tramline.llm import common


def test_slices_keep_all_rows_in_order():
    texts = ["x" * n for n in (0, 5, 100, 3, 0, 0, 50, 1)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["i", "t"])
    parts = list(common.slices(iter([batch, batch.slice(0, 0)]), rows=3, most=60))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(len(texts)))
    assert all(p.num_rows <= 3 for p in parts)
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column(1).to_pylist()) <= 60 for p in parts)


def test_stages_and_scratch(spark):
    df = spark.range(5)
    out = store.stage(df, "x")
    assert out.count() == 5 and store.exists(spark, out.inputFiles()[0])
    path = store.scratch(spark, "y")
    assert path.startswith(store.shared_dir(spark)) and not store.exists(spark, path)
    assert store.plan_bytes(out) > 0 and common.shuffle_width(out, 1) >= 4


@pytest.mark.parametrize("kind", ["string", "long"])
def test_lookup_is_a_left_join_however_hot_a_key_is(spark, kind):
    rows = [(None, 0)] * 3 + [(7, i) for i in range(500)] + [(i, i) for i in range(20)]
    df = spark.createDataFrame(rows, "k long, n long").withColumn("k", F.col("k").cast(kind))
    table = spark.createDataFrame([(7, "hot"), (3, "cold"), (99, "none")], "k long, v string").withColumn("k", F.col("k").cast(kind))
    hot = table.where("v = 'hot'")
    want = sorted(map(str, df.join(table, "k", "left").select("k", "n", "v").collect()))
    assert sorted(map(str, common.lookup(df, table, "k", hot, ["n"]).collect())) == want
    assert sorted(map(str, common.lookup(df, table, "k", hot.limit(0), ["n"]).collect())) == want
    few = common.lookup(df, table, "k", hot.limit(0), ["n"], needless=F.col("n") != 3).where("v is not null").collect()
    assert sorted((r.n, r.v) for r in few) == [(3, "cold"), (3, "hot")]
    with pytest.raises(ValueError):
        common.check_keys(["doc_id", "Kept"], ["kept"])
