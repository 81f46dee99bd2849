"""What the operators share: the shared folder, written stages, bounded slices of Arrow batches."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.store import drop_since, keep, plan_bytes, shared_dir

#: ASCII white space; a word is a run of anything else.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of an Arrow batch that goes to a worker.
BATCH = 8 << 20

#: Bytes of texts that a worker works on at a time.
PIECE = 2 << 20

def settled(df: DataFrame, name: str, since: int) -> DataFrame:
    """df written to the shared folder; the folders made since scratch_count() was `since` are deleted."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    drop_since(since)
    keep(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Keys that more than one in so many rows have are looked up by broadcast.
HOT = 1000


def lookup(rows: DataFrame, table: DataFrame, key: str, hot: DataFrame, salt: list[str], needless: Column | None = None) -> DataFrame:
    """rows with the other columns of table, which has a row for each key; null where it has none.

    hot names the keys that more than one in HOT rows have, so it has fewer than HOT rows: what they look up is broadcast.
    Their rows, and those that are said to be needless, go to the shuffle by a hash of salt in place of the key, so no
    task gets all rows of a hot key.
    """
    values = [c for c in table.columns if c != key]
    few = table.join(F.broadcast(hot.select(key)), key, "left_semi").select(F.col(key).alias("_few"), *[F.col(c).alias(f"_few_{c}") for c in values])
    rest = table.join(F.broadcast(hot.select(key)), key, "left_anti").select(F.col(key).alias("_key"), *[F.col(c).alias(f"_own_{c}") for c in values])
    served = F.col("_few").isNotNull() if needless is None else F.col("_few").isNotNull() | needless
    spread = F.xxhash64(*salt).cast(rows.schema[key].dataType)
    first = rows.join(F.broadcast(few), rows[key] == F.col("_few"), "left").withColumn("_served", F.coalesce(served, F.lit(True)))
    # Rows without a key match nothing either.
    keyed = first.withColumn("_spread", F.when(F.col("_served") | F.col(key).isNull(), spread).otherwise(F.col(key)))
    joined = keyed.join(rest, F.col("_spread") == F.col("_key"), "left")
    found = {c: F.when(F.col("_served"), F.col(f"_few_{c}")).otherwise(F.col(f"_own_{c}")) for c in values}
    return joined.select(*[F.col(c) for c in rows.columns], *[v.alias(c) for c, v in found.items()])


def shuffle_width(df: DataFrame, bytes_each: int) -> int:
    """A number of partitions that grows with the input: the session's own, or more for bytes_each of input to each."""
    own = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = plan_bytes(df)
    return max(own, -(-size // bytes_each)) if size < 1 << 60 else own


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(run, schema) with Arrow batches of at most BATCH bytes, so long texts don't fill a worker."""
    bound_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def bound_batches(spark: SparkSession) -> None:
    """Have the session's Arrow batches hold at most BATCH bytes. Spark reads the setting when a job starts, so it stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.sub(r"\D", "", spark.conf.get(key))) > BATCH:
        spark.conf.set(key, str(BATCH))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 2048, most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The same rows in short batches, of at most `most` bytes of texts unless one row has more: what Python holds stays small."""
    for batch in batches:
        sizes = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
                sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(sizes), 0
        while at < len(ends):
            before = int(ends[at - 1]) if at else 0
            end = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + most, side="right"))))
            yield batch.slice(at, end - at)
            at = end


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def check_keys(keys: Sequence[str], names: Sequence[str]) -> None:
    """ValueError for a key that is named like a column of the result: the two could not be told apart."""
    if taken := sorted({k.lower() for k in keys} & {n.lower() for n in names}):
        raise ValueError(f"keys are named like columns of the result: {taken}")


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
