"""What the corpus operators share: shared-folder tables, fold hashes and text helpers."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: For local sessions that name no folder of their own, as in tests.
LOCAL_DIR = "/tmp/checkpoints"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """This application's folder for tables, under the one that driver and executors share; it goes when the application ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = f"{(base or LOCAL_DIR).rstrip('/')}/runweave/{spark.sparkContext.applicationId}"
    path, system = _path(spark, own)
    system.deleteOnExit(path)
    return own


def _path(spark: SparkSession, name: str) -> tuple:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def cut(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Lineage ends there, so a lost executor costs no recomputation of what came before, and
    later readers prune columns. Each call takes a folder of its own; nothing is overwritten.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession) -> None:
    """Delete every table that ``cut`` wrote in this application. For when no result is read any more."""
    path, system = _path(spark, shared_dir(spark))
    system.delete(path, True)


def fold(column: str, k: int) -> Column:
    """crc32 of the id as text, modulo k; a null id hashes as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % k


def whole(column: str = "text") -> Column:
    """The text, a null one as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores added until no column of ``df`` has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def replaces(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """``df`` without the columns whose names an operator is about to give to its own results."""
    gone = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in gone])


def tokens(text: str | None) -> list[bytes]:
    """ASCII-lower-cased words between the ASCII blanks \\x20 and \\x09-\\x0D, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []
