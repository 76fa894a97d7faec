"""Condition tables as CSV lines, replaced in one step.

Lines have the form statistics programs write and read: labels and the unnamed row number
in quotes, numbers plain, ``NA`` for a missing value. A summary is a folder: each write
puts its lines into a new folder inside, and the last step points the summary to it. A write
that fails, or is still under way, leaves the old rows in place.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions.sql import add, literal, quoted
from .schemas import SUMMARY

POINTER = "_summary.json"


# ---- lines ----


def _text(value: str) -> str:
    """A label as CSV: in quotes, quotes doubled. A line break cannot be one line, and raises."""
    broken = f"CASE WHEN {value} RLIKE '[\\\\n\\\\r]' THEN raise_error('a label holds a line break') ELSE {value} END"
    return f"concat('\"', replace({broken}, '\"', '\"\"'), '\"')"


def header_line(schema: T.StructType, numbered: bool) -> str:
    names = ([""] if numbered else []) + schema.names
    return ",".join('"' + n.replace('"', '""') + '"' for n in names)


def to_lines(df: DataFrame, numbered: bool = True) -> DataFrame:
    """(value): one CSV line for each row, with its number in the order of all columns.

    Numbering needs all rows in one task: it is meant for tables of conditions. Without
    it the rows stay where they are.
    """
    cells = []
    for f in df.schema:
        plain = quoted(f.name) if isinstance(f.dataType, T.StringType) else f"CAST({quoted(f.name)} AS STRING)"
        cells.append(f"coalesce({_text(plain) if isinstance(f.dataType, T.StringType) else plain}, 'NA')")
    if numbered:
        order = ", ".join(map(quoted, df.columns))
        df = add(df, {"_row": f"row_number() OVER (ORDER BY {order})"})
        cells.insert(0, "concat('\"', _row, '\"')")
    return df.selectExpr(f"concat_ws(',', {', '.join(cells)}) AS value")


def from_lines(lines: DataFrame, schema: T.StructType, numbered: bool = True) -> DataFrame:
    """Rows of CSV lines (value); the row number is dropped, ``NA`` is missing. A cell that doesn't fit its type raises."""
    fields = ["_row STRING"] * numbered + [f"{quoted(f.name)} {f.dataType.simpleString()}" for f in schema]
    options = "map('nullValue', 'NA', 'mode', 'FAILFAST', 'escape', '\"')"
    parsed = lines.selectExpr(f"from_csv(value, {literal(', '.join(fields))}, {options}) AS _cells")
    return parsed.selectExpr(*[f"_cells.{quoted(f.name)} AS {quoted(f.name)}" for f in schema])


# ---- summaries ----


def _context(spark: SparkSession, path: str):
    """The path, and the file context that renames over a file in one step."""
    fs = spark._jvm.org.apache.hadoop.fs
    at = fs.Path(path)
    full = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at)
    return full, fs.FileContext.getFileContext(full.toUri(), spark._jsc.hadoopConfiguration())


def _current(spark: SparkSession, path: str) -> dict | None:
    """What the summary points to; None if it was not written by ``write_summary``."""
    full, context = _context(spark, path)
    pointer = spark._jvm.org.apache.hadoop.fs.Path(full, POINTER)
    if not context.util().exists(pointer):
        return None
    stream = context.open(pointer)
    try:
        return json.loads(spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(stream, "UTF-8")).readLine())
    finally:
        stream.close()


def _point(spark: SparkSession, path: str, about: dict) -> None:
    """Replaces the pointer by one rename."""
    full, context = _context(spark, path)
    fs = spark._jvm.org.apache.hadoop.fs
    staged = fs.Path(full, f"_staged-{uuid.uuid4().hex}")
    out = full.getFileSystem(spark._jsc.hadoopConfiguration()).create(staged, False)
    try:
        out.write(bytearray((json.dumps(about) + "\n").encode()))
    finally:
        out.close()
    over = spark._sc._gateway.new_array(fs.Options.Rename, 1)
    over[0] = fs.Options.Rename.OVERWRITE
    context.rename(staged, fs.Path(full, POINTER), over)


def write_summary(df: DataFrame, path: str, mode: str = "error", files: int | None = 1) -> None:
    """Write a condition table.

    ``files``: 1 for one file with a header and row numbers; None keeps the partitions of
    ``df`` for a table that is too large for one task, without numbers. ``mode``: error,
    ignore or overwrite, if ``path`` exists.
    """
    spark = df.sparkSession
    if mode not in ("error", "ignore", "overwrite"):
        raise ValueError(f"mode {mode}: expected error, ignore or overwrite")
    full, context = _context(spark, path)
    if mode != "overwrite" and context.util().exists(full):
        if mode == "ignore":
            return
        raise FileExistsError(f"PATH_ALREADY_EXISTS: {path}")
    rows, numbered = f"rows-{uuid.uuid4().hex}", files == 1
    lines = to_lines(df, numbered)
    if numbered:
        head = spark.range(0, 1, 1, 1).selectExpr(f"{literal(header_line(df.schema, True))} AS value")
        lines = head.union(lines).coalesce(1)
    elif files:
        lines = lines.coalesce(files)
    lines.write.text(f"{path}/{rows}")
    _point(spark, path, {"rows": rows, "numbered": numbered, "schema": json.loads(df.schema.json())})


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows and types of a written summary."""
    about = _current(spark, path)
    if about is None:
        raise FileNotFoundError(f"no summary was finished in {path}")
    schema = T.StructType.fromJson(about["schema"])
    lines = spark.read.text(f"{path}/{about['rows']}")
    if about["numbered"]:
        lines = lines.where(f"value <> {literal(header_line(schema, True))}")
    return from_lines(lines, schema, about["numbered"])


def read_summary(spark: SparkSession, path: str, experiment: str) -> DataFrame:
    """A summary of response times, written here or by another program as a CSV file.

    An unnamed row-number column is left out.
    """
    raw = spark.read.csv(path, header=True) if _current(spark, path) is None else read_rows(spark, path)
    declared = [f"CAST({f.name} AS {f.dataType.simpleString()}) AS {f.name}" for f in SUMMARY]
    return raw.selectExpr(*declared, f"{literal(experiment)} AS experiment")
