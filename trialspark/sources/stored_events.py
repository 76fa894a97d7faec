"""Event tables stored so that work on trials needs no shuffle.

The events of usual trials are bucketed and sorted by trial: aggregations and joins by
trial run inside a bucket. A trial with more than ``SPLIT_ROWS`` events and more than 1 /
``HEAVY_KEYS`` of all events of a table would fill a bucket by itself; such trials, fewer
than ``HEAVY_KEYS`` for each table by arithmetic, are stored apart, spread by trial and event.
Event keys are checked once, while the tables are written.

All tables of a store (fixations, saccades) share the list of heavy trials, so what
belongs together lies in the same part and bucket. A manifest is written last; a store
without one was not finished and does not open.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sql import add, drop, quoted
from ..operators import attach
from ..operators.attach import TRIAL, row_counts
from ..operators.parted import Parted

MANIFEST = "manifest"


def heavy_trials(tables: Mapping[str, DataFrame], split_rows: int | None = None, heavy_keys: int | None = None) -> DataFrame:
    """Trials that hold more than ``split_rows`` events and more than 1 / ``heavy_keys`` of some table."""
    split_rows = attach.SPLIT_ROWS if split_rows is None else split_rows
    heavy_keys = attach.HEAVY_KEYS if heavy_keys is None else heavy_keys
    found = []
    for events in tables.values():
        counts = row_counts(events.where(" AND ".join(f"{quoted(k)} IS NOT NULL" for k in TRIAL)), TRIAL, "_n")
        share = F.expr(f"sum(_n) / {heavy_keys}")
        found.append(counts.where((F.col("_n") > split_rows) & (F.col("_n") > F.coalesce(counts.agg(share).scalar(), F.lit(0)))).select(*TRIAL))
    return reduce(DataFrame.union, found).distinct()


def _checked(events: DataFrame, key: Sequence[str]) -> DataFrame:
    """Raises on a missing or repeated key. Rows that share the key must be together and in its order, so nothing moves."""
    columns = ", ".join(map(quoted, key))
    known = " AND ".join(f"{quoted(k)} IS NOT NULL" for k in key)
    flagged = add(events, {"_again": f"row_number() OVER (PARTITION BY {columns} ORDER BY {quoted(key[-1])}) > 1"})
    problem = f"CASE WHEN NOT ({known}) THEN raise_error('missing event keys') WHEN _again THEN raise_error('repeated event keys') ELSE true END"
    return drop(flagged.where(problem), "_again")


def store_events(
    tables: Mapping[str, DataFrame],
    folder: str,
    buckets: int,
    keys: Mapping[str, Sequence[str]] | None = None,
    split_rows: int | None = None,
    heavy_keys: int | None = None,
) -> dict[str, Parted]:
    """Writes event tables under ``folder`` and opens them.

    ``keys`` names the event key of the tables that have one (its first columns are the
    trial): missing and repeated keys raise, in the job that writes them. A null
    participant or trial number raises for every table. Choose ``buckets`` so that one holds
    what a task can sort, for instance bytes / 256 MB.
    """
    spark = next(iter(tables.values())).sparkSession
    keys = keys or {}
    heavy_path = f"{folder}/heavy_trials"
    heavy_trials(tables, split_rows, heavy_keys).write.parquet(heavy_path)
    heavy = spark.read.schema(_trial_schema(tables)).parquet(heavy_path)
    any_heavy = not heavy.isEmpty()
    manifest = {"buckets": buckets, "tables": {}}
    for name, events in tables.items():
        key = list(keys.get(name, ()))
        if key and tuple(key[: len(TRIAL)]) != TRIAL:
            raise ValueError(f"the key of {name} must start with {TRIAL}")
        known = " AND ".join(f"{quoted(k)} IS NOT NULL" for k in TRIAL)
        events = events.where(f"CASE WHEN {known} THEN true ELSE raise_error('missing event keys') END")
        order = [*TRIAL, *key[len(TRIAL) :]]
        usual = events
        if any_heavy:
            usual = events.join(F.broadcast(heavy), list(TRIAL), "left_anti")
            part = events.join(F.broadcast(heavy), list(TRIAL), "left_semi").repartition(buckets, *map(quoted, key or events.columns))
            (_checked(part, key) if key else part).select(*events.columns).write.parquet(f"{folder}/{name}/heavy")
        usual = usual.repartition(buckets, *TRIAL).sortWithinPartitions(*order)
        usual = _checked(usual, key) if key else usual
        table = f"stored_{uuid.uuid4().hex}"
        writer = usual.select(*events.columns).write.format("parquet").bucketBy(buckets, *TRIAL).sortBy(*order)
        writer.option("path", f"{folder}/{name}/usual").saveAsTable(table)
        spark.sql(f"DROP TABLE {table}")  # the files stay
        manifest["tables"][name] = {"schema": json.loads(events.schema.json()), "order": order, "heavy": any_heavy}
    line = spark.createDataFrame([(json.dumps(manifest),)], "value string")
    line.coalesce(1).write.text(f"{folder}/{MANIFEST}")
    return open_events(spark, folder)


def _trial_schema(tables: Mapping[str, DataFrame]) -> T.StructType:
    first = next(iter(tables.values())).schema
    kinds = {tuple(df.schema[k].dataType for k in TRIAL) for df in tables.values()}
    if len(kinds) > 1:
        raise ValueError("the tables of a store must agree on the types of their trials")
    return T.StructType([first[k] for k in TRIAL])


def open_events(spark: SparkSession, folder: str) -> dict[str, Parted]:
    """The tables of a finished store, in any session.

    Spark learns the buckets from a table in its catalog; the name is new each time.
    """
    manifest = json.loads(spark.read.text(f"{folder}/{MANIFEST}").first()["value"])
    out = {}
    for name, about in manifest["tables"].items():
        schema = T.StructType.fromJson(about["schema"])
        table = f"stored_{uuid.uuid4().hex}"
        columns = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in schema)
        by, order = (", ".join(map(quoted, c)) for c in (TRIAL, about["order"]))
        path = f"{folder}/{name}/usual".replace("'", "\\'")
        spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({order}) INTO {manifest['buckets']} BUCKETS LOCATION '{path}'")
        heavy = spark.read.schema(schema).parquet(f"{folder}/{name}/heavy") if about["heavy"] else None
        out[name] = Parted(spark.table(table), heavy, folder)
    return out
