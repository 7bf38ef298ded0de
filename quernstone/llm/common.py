"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[^\x20\t-\r]+"
#: Values of the hash by which `apart` tells rows; as many numbers at most are broadcast.
SLOTS = 1 << 20
#: Bits of the map by which `may_be_in` tells ids: for each id, and at most; bits of one of its slices.
BITS_EACH = 64
BITS = 1 << 27
SLICE = 1 << 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder that the driver and all executors see, below spark.checkpoint.dir.

    Arrow batches of this session are bounded by bytes from then on.
    Where that setting is absent and all runs on one machine (tests), a local folder is set for this session.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = "file:///tmp/quernstone-checkpoints"
    spark.conf.set(BATCH, 8 << 20)  # very long texts go to Python few at a time
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/quernstone-{uuid.uuid4().hex}"


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame, path: str) -> DataFrame:
    """Writes df below a shared folder and reads it back: cuts lineage and survives lost executors.

    The write's own shuffle files go when it ends, so a job of many steps holds the disk of one step at a time.
    """
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of this run through Hadoop's file system layer, whatever store it is in."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def apart(rows: DataFrame, keys: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows that surely have no partner in keys, and the others, among them all that have one.

    A hash of the whole numbers `on` tells, so a join with few keys exchanges few rows; with very many, all. Null keys may be on either side.
    """
    slot = F.pmod(F.xxhash64(*(F.col(c).cast("long") for c in on)), F.lit(SLOTS)).alias("_slot")
    taken = F.broadcast(keys.select(slot).distinct())
    slotted = rows.select("*", slot)
    return slotted.join(taken, "_slot", "left_anti").drop("_slot"), slotted.join(taken, "_slot", "left_semi").drop("_slot")


def without(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows that have no partner in keys."""
    free, rest = apart(rows, keys, on)
    return free.unionByName(rest.join(keys.select(*on), on, "left_anti").select(*rows.columns))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads; other columns, however named, stay out of its way."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def _slice(group: pa.Table) -> pa.Table:
    found = np.zeros(SLICE, dtype=bool)
    found[group.column("bit").to_numpy()] = True
    return pa.table({"slice": group.column("slice")[:1], "bits": pa.array([np.packbits(found).tobytes()])})


def id_map(ids: DataFrame) -> tuple[Callable[[Column], Column], Callable[[pa.Array], pa.Array]]:
    """A slot for whole numbers, and a test of slots that holds for those of all of ids (one column) and for some few others.

    A bit map of BITS at most goes along with the tasks, so rows that are surely out need not be exchanged, however many ids
    there are.
    """
    spark, name = ids.sparkSession, ids.columns[0]
    size = min(BITS, max(SLICE, 1 << (ids.count() * BITS_EACH).bit_length()))
    slot = lambda c: F.pmod(F.xxhash64(c.cast("long")), F.lit(size))
    found = ids.select(slot(F.col(name)).alias("slot")).distinct().select(F.expr(f"slot div {SLICE}").alias("slice"), (F.col("slot") % SLICE).alias("bit"))
    slices = found.groupBy("slice").applyInArrow(_slice, "slice long, bits binary").toArrow()
    whole = np.zeros((size // SLICE, SLICE // 8), dtype=np.uint8)
    for at, bits in zip(slices.column("slice").to_pylist(), slices.column("bits"), strict=True):
        whole[at] = np.frombuffer(bits.as_py(), dtype=np.uint8)
    shared = spark.sparkContext.broadcast(whole.ravel())

    def test(slots: pa.Array) -> pa.Array:
        at = slots.to_numpy(zero_copy_only=False)
        return pa.array(shared.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1 == 1)

    return slot, test


def may_be_in(ids: DataFrame) -> Callable[[Column], Column]:
    """The test of `id_map` as a filter; where Python follows in the same task, test there, as each takes a worker's memory."""
    slot, test = id_map(ids)

    def run(slots: pa.Array) -> pa.Array:
        return test(slots)

    held = F.arrow_udf(run, "boolean")
    return lambda c: held(slot(c))
