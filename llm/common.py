"""Shared plumbing of the corpus operators: shared storage, checked broadcasts, components."""

from __future__ import annotations

import ctypes
import pickle
import sys
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side of a join is broadcast up to so many rows of a few machine words (about 16 MB); beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors and the driver share, from spark.checkpoint.dir or the context's checkpoint folder; raises where neither is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        there = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not there.isDefined():
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = there.get()
    return found.rstrip("/")


def kept(key, make, most: int = 2):
    """A value made once for each worker process and key, the last ``most`` of them; functions travel by value, so globals of a module do not last."""
    store = sys.modules.setdefault("_kept_by_worker", types.ModuleType("_kept_by_worker")).__dict__.setdefault("values", {})
    if key not in store:
        while len(store) >= most:
            store.pop(next(iter(store)))
        store[key] = make()
    return store[key]


def tidy(run: Callable) -> Callable:
    """``run`` for mapInArrow, after which its worker, which later tasks use again, gives the memory that was freed back to the system."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc, which keeps what lies below a block in use
                trim(0)

    return tidied


class Sent:
    """A broadcast of a value pickled together with its code, so that workers need not have this package; unpickled once a task."""

    def __init__(self, spark: SparkSession, value):
        self._packed, self._value = spark.sparkContext.broadcast(cloudpickle.dumps(value)), None

    def __getstate__(self):
        return {"_packed": self._packed, "_value": None}

    @property
    def value(self):
        if self._value is None:
            self._value = pickle.loads(self._packed.value)
        return self._value


def saved(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._saved_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``saved`` returned, once all that was made of them has been saved itself."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._saved_at)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def checked_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (already saved, of a few machine words a row), hinted for broadcast only if it is counted to be small."""
    return F.broadcast(df) if df.count() <= limit else df


def by_shuffle(df: DataFrame) -> DataFrame:
    """``df`` for a join that shuffles: Spark would broadcast a table by the size of its compressed files, rows of an explode not counted."""
    return df.hint("merge")


def settled_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", limit: int = 300_000, salts: int = 32) -> DataFrame:
    """Join on a ``key`` that may have a large part of ``left``'s rows but few words in the one row it has in ``right`` (its other columns few words too).

    A ``right`` counted to be small is broadcast; else each of its rows is copied ``salts`` times and left rows are
    dealt among the copies, so that no key lands in one task.  Rows without a key match nothing and are dealt as well.
    """
    if right.count() <= limit:
        return left.join(F.broadcast(right), key, how)
    salt = F.pmod(F.xxhash64(*[c for c in left.columns if c != key]), F.lit(salts)).cast("int")
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn("_salt", salt).join(by_shuffle(copies), [key, "_salt"], how).drop("_salt")


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with ``index``, its rows' places (from 0) in a total ``order``: one distributed sort, then the rows of earlier partitions are counted in."""
    rows = saved(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row for each partition
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    rows = rows.withColumn("_part", part).join(F.broadcast(before), "_part")
    return rows.withColumn("index", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_part", "_before")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: one row (id, component) for each id, component being the smallest id.

    Each round takes the smallest label among neighbours, then follows the label's own label; a group of
    any size needs a number of rounds that grows with the logarithm of its diameter.
    """
    both = saved(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    last = saved(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("component")))
    labels = last.select("id", "component")
    while True:
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(near, labels.id == near.a).select("id", F.col("component").alias("old"), F.least("component", "near").alias("new"))
        hop = labels.select(F.col("id").alias("new"), F.col("component").alias("far"))
        step = saved(step.join(hop, "new", "left").select("id", "old", F.least("new", F.coalesce("far", "new")).alias("component")))
        discard(last)
        last, labels = step, step.select("id", "component")
        labels._saved_at = step._saved_at
        if step.filter("old != component").isEmpty():
            discard(both)
            return labels


def sum_rows(frame: DataFrame, parts, lane: int = 32) -> np.ndarray:
    """Add up, over all partitions, the matrices that ``parts(batches)`` returns for each: first ``lane`` partitions at a time, then those sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = parts(batches)
        if total is not None:
            at = TaskContext.get().partitionId() // lane
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(total), at), pa.int32()), pa.array(range(len(total)), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], ["lane", "row", "part"])

    parts_of = frame.mapInArrow(run, "lane int, row int, part binary")
    done = parts_of.groupBy("lane", "row").applyInArrow(add_parts, "row int, part binary").groupBy("row").applyInArrow(add_parts, "row int, part binary").toArrow().sort_by("row")
    return np.array([np.frombuffer(p.as_buffer(), np.float64) for p in done["part"]])


def add_parts(table: pa.Table) -> pa.Table:
    """The sum of one matrix row's parts."""
    total = sum(np.frombuffer(p.as_buffer(), np.float64) for p in table["part"])
    return pa.table({"row": table["row"][:1], "part": pa.array([total.tobytes()], pa.binary())})
