"""Delta-maintained token counts (operator 4).

A rollup is a folder in the shared store. Each batch of changes is reduced to signed sums by source, language and
tokenizer version and written once, to a folder of its own that no reader looks at, which one rename then gives the
batch's name. That name can be given once only: of two writers of a batch one publishes, the other throws its sums away
and learns that the batch had been committed. A writer that dies leaves a folder that does not count. Totals are sums over all
batches, so order does not matter; committing a batch again changes nothing. compact() folds all batches into a new
generation, published in the same way; its list of folded batches and its sums are one folder, and of two compactions
at a time one is thrown away. The store must rename folders in one step and refuse names that are taken, as HDFS and
local file systems do through Hadoop's FileContext.

A change row says how documents and tokens change: an insert adds (+1, +n), a delete (-1, -n), a revised count
(0, new - old). Defined results: a null count is 0 tokens; null source or language are groups of their own;
repeated rows count repeatedly; a batch may have any name but the empty one, of up to 100 bytes; a batch without rows is committed and
changes nothing; groups whose documents and tokens are both 0 are not in the totals; other columns are not read.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.store import delete, exists

KEYS = ["source", "lang", "tokenizer_version"]
SUMS = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"


def _signed(df: DataFrame, version: str, docs: int, tokens: Column) -> DataFrame:
    return df.select("source", "lang", F.lit(version).alias("tokenizer_version"), F.lit(docs).cast("long").alias("n_docs"), F.coalesce(tokens, F.lit(0)).cast("long").alias("n_tokens"))


def inserts(df: DataFrame, version: str, tokens: str) -> DataFrame:
    return _signed(df, version, 1, F.col(tokens))


def deletes(df: DataFrame, version: str, tokens: str) -> DataFrame:
    return _signed(df, version, -1, -F.col(tokens))


def revisions(df: DataFrame, version: str, old: str, new: str) -> DataFrame:
    return _signed(df, version, 0, F.coalesce(F.col(new), F.lit(0)) - F.coalesce(F.col(old), F.lit(0)))


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


class TokenRollup:
    """Totals by source, language and tokenizer version, in a folder of the shared store."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, batch: str) -> str:
        # Names are in hexadecimal, so any name is a folder's name, and generations have a prefix of their own.
        return f"{self.path}/batch={batch.encode().hex()}"

    def _names(self, prefix: str) -> list[str]:
        """What stands behind a prefix in the names of the rollup's folders."""
        if not exists(self.spark, self.path):
            return []
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        found = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)
        return [n.removeprefix(prefix) for n in (s.getPath().getName() for s in found) if n.startswith(prefix)]

    def _generation(self) -> int:
        """The last compaction's number; 0 without any."""
        return max(map(int, self._names("generation=")), default=0)

    def _state(self) -> tuple[int, list[str]]:
        """The last generation, and the batches that are not folded into it."""
        # Folders are listed before the generation is read: one that is deleted in between is in its list.
        done = [bytes.fromhex(n).decode() for n in self._names("batch=")]
        generation = self._generation()
        folded = {r[0] for r in self._folded(generation).where(F.col("batch").isin(done)).collect()} if done else set()
        return generation, sorted(b for b in done if b not in folded)

    def _folded(self, generation: int) -> DataFrame:
        if not generation:
            return self.spark.createDataFrame([], "batch string")
        return self.spark.read.schema("batch string").parquet(f"{self.path}/generation={generation}/folded")

    def committed(self) -> list[str]:
        """Batches that count by themselves, not through a compaction."""
        return self._state()[1]

    def known(self, batch: str) -> bool:
        """Whether a batch was committed, be it folded since or not."""
        return exists(self.spark, self._folder(batch)) or not self._folded(self._generation()).where(F.col("batch") == batch).isEmpty()

    def _publish(self, made: str, name: str) -> bool:
        """Give a finished folder its name in one step; False, and the folder deleted, if the name is taken."""
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        fs = jvm.org.apache.hadoop.fs
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        source, target = (fs.Path(p).getFileSystem(conf).makeQualified(fs.Path(p)) for p in (made, name))
        options = gateway.new_array(getattr(fs, "Options$Rename"), 1)
        options[0] = getattr(fs, "Options$Rename").NONE
        context = fs.FileContext.getFileContext(source.toUri(), conf)
        try:
            context.rename(source, target, options)
        except Py4JJavaError as e:
            if e.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
                raise
            delete(self.spark, made)
            return False
        return True

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch of change rows; False if it had been committed before."""
        if not batch:
            raise ValueError("a batch needs a name")
        if self.known(batch):
            return False
        made = f"{self.path}/made-{uuid.uuid4().hex}"
        _summed(changes).coalesce(8).write.parquet(made)
        # A batch that was folded while this one was written is in the list of the generation, so it counts once.
        return self._publish(made, self._folder(batch))

    def _parts(self, generation: int, batches: list[str]) -> DataFrame:
        folders = [self._folder(b) for b in batches] + ([f"{self.path}/generation={generation}/sums"] if generation else [])
        return self.spark.read.schema(SUMS).parquet(*folders) if folders else self.spark.createDataFrame([], SUMS)

    def totals(self) -> DataFrame:
        """Totals over all that is committed now; if a compaction deletes what the frame reads, ask again."""
        return _summed(self._parts(*self._state())).where((F.col("n_docs") != 0) | (F.col("n_tokens") != 0))

    def compact(self) -> bool:
        """Fold all batches into a new generation; False if another compaction was faster."""
        last, batches = self._state()
        made = f"{self.path}/made-{uuid.uuid4().hex}"
        names = self.spark.createDataFrame([[b] for b in batches], "batch string")
        try:
            self._folded(last).unionByName(names).coalesce(1).write.parquet(f"{made}/folded")
            _summed(self._parts(last, batches)).coalesce(8).write.parquet(f"{made}/sums")
        except Exception:
            # A faster compaction may have deleted what this one reads.
            if self._generation() == last:
                raise
            delete(self.spark, made)
            return False
        if not self._publish(made, f"{self.path}/generation={last + 1}"):
            return False
        for b in batches:
            delete(self.spark, self._folder(b))
        if last:
            delete(self.spark, f"{self.path}/generation={last}")
        return True
