"""Pieces that several of the training-data operators share."""

from __future__ import annotations

import gc
import re
import string
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Only if Spark runs in one process, as in tests, and none is named, is it a temporary one:
    executors on other machines wouldn't see what is written there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(frame: DataFrame, name: str) -> DataFrame:
    """The rows of frame, as a Parquet table in the shared folder.

    Cuts the lineage: a lost executor doesn't make the rows be computed again, and ids that
    were dealt out by position stay as they are.
    """
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    table = spark.read.schema(frame.schema).parquet(path)
    table.written_to = path
    return table


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of jobs that have ended; it does so once the driver's garbage is collected, which may be long after."""
    gc.collect()
    spark._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Removes tables that written() made, once nothing reads them any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bitmap(values: DataFrame, bits: int = 24) -> np.ndarray:
    """A set of 2 ** bits flags for the values of the one column, at their hashes: always so many, however many values.

    What isn't flagged isn't among the values; what is may be. See flagged().
    """
    (name,) = values.columns
    h = F.xxhash64(name)
    told = values.select(F.shiftrightunsigned(h, 64 - bits + 6).alias("word"), h.alias("h")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("flags")).toArrow()
    flags = np.zeros(1 << (bits - 6), dtype=np.int64)
    flags[told.column("word").to_numpy()] = told.column("flags").to_numpy()
    return flags


def flagged(flags: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the values with these hashes (xxhash64 of Spark's) are flagged in a bitmap."""
    unsigned = hashes.view(np.uint64)
    words = flags[(unsigned >> np.uint64(64 - len(flags).bit_length() + 1)).astype(np.int64)].view(np.uint64)
    return (words >> (unsigned & np.uint64(63)) & np.uint64(1)).astype(bool)


def ids_repeat(rows: DataFrame, id_col: str) -> bool:
    """Whether an id (null too) has more than one row. Reads that column only."""
    return not rows.groupBy(id_col).count().where("count > 1").isEmpty()


def one_of_each(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row of each key, nulls equal to each other: the one that, as JSON, comes last in order."""
    whole = F.struct(*(F.col(f"`{c}`") for c in rows.columns))
    return rows.groupBy(*keys).agg(F.max_by(whole, F.to_json(whole)).alias("_row")).select("_row.*")


def whole_text(column: Column | str) -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def lower_az(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; ASCII texts take the faster lower()."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def crc_remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo divisor; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor


def drawn_share(drawn: Column, share: float) -> Column:
    """Whether a 64-bit hash is in the lowest share of its range: a sample without a sort or a shuffle."""
    return F.lit(True) if share >= 1 else drawn < F.lit(int((share - 0.5) * 2**64))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
