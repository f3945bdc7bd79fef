"""Tables of a job in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. One of its own is made only in local mode, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="docloom-"))
    return sc.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read from there: what follows survives lost executors, and plans stay small. The files stay until the folder is cleared."""
    path = f"{shared_dir(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole(keys: tuple[str, ...], run: Callable[[pa.Table, np.ndarray], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over rows sorted by keys: run(rows, starts) sees all rows of each key at once, those of many keys in one call.

    starts: where each key's rows begin. A frame for each key, as applyInPandas makes it, costs more than
    the work where keys have few rows. Held are a batch and the rows of one key.
    """

    def firsts(t: pa.Table | pa.RecordBatch) -> np.ndarray:
        new = np.zeros(max(t.num_rows - 1, 0), bool)
        for k in keys:
            v = t.column(k).to_numpy(zero_copy_only=False) if isinstance(t, pa.RecordBatch) else t.column(k).to_numpy()
            new |= v[1:] != v[:-1]
        return np.concatenate([[0], np.flatnonzero(new) + 1]) if t.num_rows else np.zeros(0, int)

    def done(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        if rows.num_rows:
            yield run(rows, firsts(rows))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            last = int(firsts(batch)[-1])
            goes_on = held and all(held[-1].column(k)[-1] == batch.column(k)[0] for k in keys)
            if held and not (last == 0 and goes_on):
                yield from done([*held, batch.slice(0, last)])
                held = [batch.slice(last)]
            elif held:
                held.append(batch)
            else:
                if last:
                    yield from done([batch.slice(0, last)])
                held = [batch.slice(last)]
        if held:
            yield from done(held)

    return each
