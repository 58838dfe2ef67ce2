"""Helpers that the operators share: tables, shared storage, ASCII text rules."""

from __future__ import annotations

import string
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words everywhere in this package, as a regex class body.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the cluster's own setting; only on a local master one for tests instead."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="vigil-checkpoint-"))
    return sc.getCheckpointDir()


def remove_table(spark: SparkSession, path: str) -> None:
    """Delete a table that was written to the shared folder."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).delete(at, True)


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder (survives lost executors)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def tasks_for(rows: int, rows_per_task: int = 20_000) -> int:
    return max(1, -(-rows // rows_per_task))


def compact(df: DataFrame) -> DataFrame:
    """Checkpointed, in as few partitions as its counted rows need: a small table does not pass a task for every shuffle partition on."""
    df = durable(df)
    return df.coalesce(tasks_for(df.count()))


def settled(df: DataFrame) -> DataFrame:
    """Keep filters above from being pushed into, and copied over, the column expressions below."""
    return df.observe(f"rows-{uuid.uuid4().hex}", F.count(F.lit(1)).alias("rows"))


def ascii_lower(col: Column) -> Column:
    return F.translate(col, string.ascii_uppercase, string.ascii_lowercase)


def name(column: str) -> Column:
    """A column by its exact name, dots and blanks included."""
    return F.col("`" + column.replace("`", "``") + "`")


def small_side(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast hint for a checkpointed table, only if its counted rows stay within ``max_rows``.

    Beyond the bound the table is returned as it is and the join shuffles.
    """
    return F.broadcast(df) if df.count() <= max_rows else df


#: Bytes of one row of Spark's bitmap functions.
_BITMAP_ROW = 4096


def bitmap_of(places: DataFrame, bits: int) -> np.ndarray:
    """The places (column ``place``, from 0, below ``bits``) as a bitmap: at most bits / 32768 rows of 4 kB come to the driver."""
    at = F.col("place") + 1
    rows = places.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    bitmap = np.zeros(max(bits // 8, _BITMAP_ROW), np.uint8)
    for r in rows:
        bitmap[(r.bucket - 1) * _BITMAP_ROW : r.bucket * _BITMAP_ROW] = np.frombuffer(r.bits, np.uint8)
    return bitmap


def in_bitmap(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash (its lowest bits are the place) is set."""
    at = hashes & np.uint64(8 * len(bitmap) - 1)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def text_blocks(texts, chars: int) -> Iterator[tuple[int, list[str]]]:
    """An Arrow array of texts as (first row, texts) blocks of about ``chars`` characters; null becomes empty."""
    first, held, size = 0, [], 0
    for i, value in enumerate(texts):
        held.append(value.as_py() or "")
        size += len(held[-1])
        if size >= chars:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held
