"""Helpers shared by the operators: words, shared tables, Arrow mapping, row numbers."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
LOWER = bytes.maketrans(_UPPER, _LOWER)
#: A-Z in lower case; every byte that is no digit, letter or part of a longer character becomes a space
ALNUM = bytes(
    LOWER[b] if chr(b).isascii() and chr(b).isalnum() or b >= 0x80 else 0x20 for b in range(256)
)


def alnum_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased."""
    return text.translate(ALNUM).split() if text else []


def space_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased."""
    return text.translate(LOWER).split() if text else []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(id_col: str, n: int) -> Column:
    """crc32 of the id as text, mod n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see. A local session without one gets its own."""
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir") or _LOCAL.get(spark.sparkContext.applicationId)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = _LOCAL[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="llm-")
    return folder.rstrip("/")


_LOCAL: dict[str, str] = {}
_SHIPPED: set[str] = set()
BATCH_ROWS = 1_000


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once in an application.

    Batches are kept to ``BATCH_ROWS`` rows where the session doesn't set a number:
    texts are long, and the JVM and Python both hold a batch.
    """
    context = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if context.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parent.parent
        folder = tempfile.mkdtemp(prefix="code-")  # the driver serves the file from here
        with zipfile.ZipFile(f"{folder}/{package.name}.zip", "w") as z:
            for path in sorted(package.rglob("*.py")):
                z.write(path, path.relative_to(package.parent))
        context.addPyFile(f"{folder}/{package.name}.zip")
        _SHIPPED.add(context.applicationId)


def save(df: DataFrame, name: str) -> DataFrame:
    """Write a table in the shared folder and read it back: later steps no longer depend on lineage."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def quoted(name: str) -> str:
    """A column name as SQL text, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that the frame does not have: underscores are added until none clashes."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema) -> DataFrame:
    """``fn`` on every Arrow batch; None drops the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if out is not None:
                yield out

    return df.mapInArrow(run, schema)


def binary(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column as UTF-8 bytes."""
    column = batch.column(name)
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def with_columns(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with columns replaced in place or appended."""
    names, arrays = list(batch.schema.names), list(batch.columns)
    for name, array in columns.items():
        if name in names:
            arrays[names.index(name)] = array.cast(batch.schema.field(name).type)
        else:
            names.append(name)
            arrays.append(array)
    return pa.RecordBatch.from_arrays(arrays, names=names)


def text_bytes(docs: DataFrame, text_col: str) -> int:
    """Bytes of all texts, by one scan of that column."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]


def rank_rows(df: DataFrame, group: str, ids: list[str], name: str, rows: int, per_task: int = 100_000) -> DataFrame:
    """Adds ``name``: 0, 1, 2 ... within each value of ``group``, in some fixed order.

    A group of any size is split into lanes by a hash of ``ids``; lanes are numbered
    by running sums of their counts, rows inside their lane. ``df`` must be a stored
    table: it is read twice.
    """
    from pyspark.sql import Window

    lanes = max(1, -(-rows // per_task))
    laned = df.withColumn("_lane", F.pmod(F.xxhash64(*ids), F.lit(lanes)))
    counts = laned.groupBy(group, "_lane").count()
    before = Window.partitionBy(group).orderBy("_lane").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col(group).alias("_g"), F.col("_lane").alias("_l"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start")
    )
    inside = Window.partitionBy(group, "_lane").orderBy(*ids)
    return (
        laned.withColumn("_n", F.row_number().over(inside))
        .join(starts, (F.col(group) == F.col("_g")) & (F.col("_lane") == F.col("_l")))
        .withColumn(name, F.col("_start") + F.col("_n") - 1)
        .drop("_lane", "_n", "_g", "_l", "_start")
    )
