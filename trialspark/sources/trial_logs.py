"""Trial logs in CSV, event tables in Parquet."""

from __future__ import annotations

import csv
import io
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sql import quoted
from ..operators.attach import TRIAL, row_counts
from ..operators.drift import filled_columns, not_shared
from .first_lines import first_lines
from .schemas import RESPONSE_NAMES, TRIAL_LOG

EVENT_KEY = (*TRIAL, "fix_count")


def plain(name: str) -> str:
    """Column name without dots, which Spark would read as field access."""
    return name.replace(".", "_")


def declare(df: DataFrame, schema: T.StructType = TRIAL_LOG) -> DataFrame:
    """Rename dotted columns, settle the response name, cast to the declared types.

    Columns outside the schema are kept as they are, behind the declared ones.
    """
    names = {plain(c): c for c in df.columns}
    for name in RESPONSE_NAMES:
        if name in names:
            names["response"] = names.pop(name)
    lacking = [f.name for f in schema if f.name not in names]
    if lacking:
        raise ValueError(f"trial log lacks declared columns: {lacking}")
    declared = [f"CAST(`{names[f.name]}` AS {f.dataType.simpleString()}) AS {f.name}" for f in schema]
    others = [f"`{c}` AS `{n}`" for n, c in names.items() if n not in schema.fieldNames()]
    return df.selectExpr(*declared, *others)


def file_headers(spark: SparkSession, paths: Sequence[str]) -> dict[str, tuple[str, ...]]:
    """Header of every listed file: its first line. A file without one raises.

    Only the beginning of each file is read. What reaches the driver is one line per file,
    as many as the driver lists for any read.
    """
    lines = first_lines(spark, spark.read.text(list(paths)).inputFiles())
    headers = {path: tuple(next(csv.reader(io.StringIO(line.removeprefix("\ufeff"))), ())) for path, line in lines.items()}
    if lacking := sorted(path for path, header in headers.items() if not any(header)):
        raise ValueError(f"no header in {lacking}")
    return headers


def schema_diff_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(field, n_sources): columns that not all listed files have; no paths give no rows."""
    headers = file_headers(spark, paths) if paths else {}
    pairs = [(path, field) for path, header in headers.items() for field in header]
    return not_shared(spark.createDataFrame(pairs, "path string, field string"), "path", "field")


#: a file's address without its scheme, which Spark writes in more than one way
ADDRESS = "regexp_replace({}, '^[^:/]+:(//)?', '')"


def read_trial_logs(spark: SparkSession, paths: Sequence[str], fill: Sequence[str]) -> DataFrame:
    """Read trial logs by column name; only the ``fill`` columns may be absent from a file.

    One scan serves any number of headers. Cells are read by place; the header of a row's
    file tells the place of each column. Headers are joined by file, one row for each.
    """
    headers = {path: [plain(h or f"_c{i}") for i, h in enumerate(header)] for path, header in file_headers(spark, paths).items()}
    columns = filled_columns(list(headers.values()), [plain(c) for c in fill])
    width = max(map(len, headers.values()))
    cells = [f"_cell{i}" for i in range(width)]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in cells])
    rows = spark.read.csv(list(paths), header=True, schema=schema, nullValue="NA", enforceSchema=True)
    rows = rows.selectExpr(f"array({', '.join(cells)}) AS _cells", f"{ADDRESS.format('_metadata.file_path')} AS _file")

    places = {}
    for path, header in headers.items():
        at = {name: i for i, name in enumerate(header)}
        places[path] = [at.get(c) for c in columns]
    found = spark.createDataFrame(list(places.items()), "path string, _places array<int>").selectExpr(f"{ADDRESS.format('path')} AS _file", "_places")
    bound = rows.join(F.broadcast(found), "_file", "left")
    placed = "CASE WHEN _places IS NULL THEN raise_error(concat('no header was read for ', _file)) ELSE _places END"
    bound = bound.selectExpr("_cells", f"{placed} AS _places")
    return declare(bound.selectExpr(*[f"get(_cells, get(_places, {i})) AS {quoted(c)}" for i, c in enumerate(columns)]))


def read_events(spark: SparkSession, path: str, keys: Sequence[str] | None = None) -> DataFrame:
    """Fixation or saccade table; only the columns a query uses are read.

    With ``keys`` the table is validated first, by one pass over these columns:
    missing or repeated keys raise.
    """
    events = spark.read.parquet(path)
    return validated(events, keys) if keys else events


def validated(events: DataFrame, keys: Sequence[str] = EVENT_KEY) -> DataFrame:
    """The events, after a check that their keys are known and unique."""
    unknown = events.where(" OR ".join(f"{quoted(k)} IS NULL" for k in keys))
    for what, bad in (("missing", unknown.select(*map(quoted, keys))), ("repeated", duplicate_events(events, keys))):
        if rows := bad.limit(3).collect():
            raise ValueError(f"{what} event keys, such as {[r.asDict() for r in rows]}")
    return events


def duplicate_events(events: DataFrame, keys: Sequence[str] = EVENT_KEY) -> DataFrame:
    """Key values that occur more than once; must be empty before markers are built."""
    return row_counts(events, keys, "n").where("n > 1")
