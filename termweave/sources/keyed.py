"""A table that grows by numbered batches and is looked up by key, at a cost that goes with what is asked, not with how many batches there were (M-2, M-3)."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Segments of equal length that become one.
SPAN = 4
#: Keys in a bucket, or so, and buckets of a segment at most (beyond it buckets grow).
BUCKET_KEYS, MAX_BUCKETS = 50_000, 1 << 12


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of any store that Spark reaches; none there is fine."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def cover(n: int) -> list[tuple[int, int]]:
    """first batch and number of batches of the segments that hold batches 0 to n - 1: the digits of n to the base SPAN, longest first."""
    out, first, length = [], 0, 1
    while length * SPAN <= n:
        length *= SPAN
    while first < n:
        while first + length > n:
            length //= SPAN
        out.append((first, length))
        first += length
    return out


class KeyedTable:
    """Rows of `schema` under `path`. Batch n writes its own segment; before it, segments of SPAN batches each merge, of SPAN times SPAN, and so on, so n batches are
    in about (SPAN - 1) * log n segments and a row is rewritten log n times. Which segments are valid follows from n alone, and all are overwritten as wholes:
    a batch that is tried again finds and leaves the same. Within a segment rows lie by hash of key in buckets of bounded size; only buckets of asked
    keys are read. Batches are numbered from 0 without gaps, as foreachBatch does."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: T.StructType) -> None:
        self.spark, self.path, self.key, self.schema = spark, path.rstrip("/"), key, schema

    def _at(self, first: int, length: int) -> str:
        return f"{self.path}/length={length}/first={first}"

    def _bucket(self, of: int) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(of)).cast("int")

    def _segment(self, first: int, length: int) -> tuple[DataFrame, int]:
        """A segment and its number of buckets, 0 if it has no rows."""
        layout = T.StructType([*self.schema.fields, T.StructField("_of", T.IntegerType()), T.StructField("_bucket", T.IntegerType())])
        rows = self.spark.read.schema(layout).parquet(self._at(first, length))
        found = re.search(r"/_of=(\d+)/", next(iter(rows.inputFiles()), ""))
        return rows, int(found[1]) if found else 0

    def _put(self, rows: DataFrame, first: int, length: int, keys: int) -> None:
        of = min(MAX_BUCKETS, 1 << max(0, (-(-keys // BUCKET_KEYS) - 1).bit_length()))
        dealt = rows.select(*self.schema.names, F.lit(of).alias("_of"), self._bucket(of).alias("_bucket")).repartition(of, "_bucket").sortWithinPartitions("_bucket", self.key)
        dealt.write.mode("overwrite").partitionBy("_of", "_bucket").parquet(self._at(first, length))

    def begin(self, number: int) -> None:
        """Merge what batch `number` - 1 has completed, and remove what was merged before that batch, which won't be tried again."""
        length = 1
        while number and number % (length * SPAN) == 0:
            first = number - length * SPAN
            rows = reduce(DataFrame.unionByName, [self._segment(first + k * length, length)[0].select(*self.schema.names) for k in range(SPAN)])
            length *= SPAN
            self._put(rows, first, length, rows.count())
        length, done = 1, number - 1
        while done > 0 and done % (length * SPAN) == 0:
            for k in range(SPAN):
                remove(self.spark, self._at(done - (k + 1) * length, length))
            length *= SPAN

    def look_up(self, keys: DataFrame, number: int) -> DataFrame:
        """The rows of asked keys that batches before `number` wrote."""
        self.begin(number)
        parts = [(rows, of) for rows, of in (self._segment(*s) for s in cover(number)) if of]
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        most = max(of for _, of in parts)
        # at most MAX_BUCKETS numbers; those of segments with fewer buckets follow, as all are powers of two
        asked = [r[0] for r in keys.select(self._bucket(most)).distinct().collect()]
        near = reduce(DataFrame.unionByName, [rows.where(F.col("_bucket").isin(sorted({b % of for b in asked}))) for rows, of in parts])
        return near.select(*self.schema.names).join(keys.select(self.key).distinct(), self.key, "left_semi")

    def write(self, rows: DataFrame, number: int, keys: int) -> DataFrame:
        """Batch `number`, of so many keys, in place of what an earlier try of it wrote."""
        self._put(rows, number, 1, keys)
        return self._segment(number, 1)[0].select(*self.schema.names)

    def all(self, number: int) -> DataFrame:
        """Everything that batches before `number` wrote."""
        self.begin(number)
        parts = [self._segment(*s)[0].select(*self.schema.names) for s in cover(number)]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], self.schema)
