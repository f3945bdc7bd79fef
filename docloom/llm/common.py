"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when it has been counted and holds at most so many rows.
BROADCAST_ROWS = 20_000
#: The same for rows of two or three numbers: at most about 16 MB as a hash table.
BROADCAST_NUMBERS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the session names. A folder of its own is made only in local mode, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="docloom-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: later stages survive the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """As cut, but as compressed columns: for tables of many rows. The files stay until the folder is cleared."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Tables:
    """Named tables of one job in the shared folder. A table that is kept again, or dropped, loses its old files."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, {}

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        old, self.paths[name] = self.paths.get(name), path
        if old:
            self._remove(old)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self.paths:
                self._remove(self.paths.pop(name))

    def _remove(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def few(df: DataFrame, rows: int, each: int = 200_000) -> DataFrame:
    """df, of about so many rows, in partitions of about each rows where the shuffle before has made more of them."""
    return df.coalesce(max(1, -(-rows // each)))


def slices(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most so many rows, so that a task holds few texts as Python objects."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def attach(big: DataFrame, small: DataFrame, on: list[str], row_count: int, how: str = "inner", salts: int = 16, most: int = BROADCAST_ROWS) -> DataFrame:
    """Join small, of row_count rows and one for each key, to big.

    Up to most rows it is broadcast. Beyond that the keys of big are salted and small is
    repeated for each salt, so a key with a third of all rows is spread over tasks.
    """
    if row_count <= most:
        return big.join(F.broadcast(small), on, how)
    salted = big.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)))
    spread = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return salted.join(spread, [*on, "_salt"], how).drop("_salt")


def let(value: Column, body) -> Column:
    """body(value), with value computed once for each row, however often body uses it.

    A lambda's variable is no alias, so neither the merging of projections nor a pushed-down filter
    can copy value into the places that use it.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def lower_ascii(c: Column) -> Column:
    """A-Z in lower case, all else untouched."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
