"""Put per-trial values on event rows, safe for trials of any size.

The event side is the large one and a single trial may hold a big part of it.
Trials with more than ``SPLIT_ROWS`` events and more than 1 / ``HEAVY_KEYS`` of all
events are found in the per-trial table (which already carries a row count, so no
extra pass over the events is needed). There are less than ``HEAVY_KEYS`` of them
by arithmetic, so they can be broadcast; their events take the values from that
broadcast. They still pass the shuffled join, but under a lane number that matches
no trial, so they spread evenly instead of meeting in one task. Any other trial is
below the limit, or a fair share of a large shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sql import add, aggregates, compute_once, drop, quoted
from .parted import Parted, together

TRIAL = ("participant", "tno")
SPLIT_ROWS = 2_000_000
HEAVY_KEYS = 100_000
LANES = 8_192


def row_counts(events: DataFrame, on: Sequence[str] = TRIAL, name: str = "n_rows") -> DataFrame:
    """Rows per key; partial counts are combined before the shuffle."""
    return events.groupBy(*on).agg(*aggregates({name: "count(1)"}))


def attach(
    events: DataFrame,
    per_trial: DataFrame,
    weight: str,
    on: Sequence[str] = TRIAL,
    keep_lane: bool = False,
    split_rows: int | None = None,
) -> DataFrame:
    """Left join of events to a table that is unique on ``on``.

    ``weight`` names a ``per_trial`` column with the number of events of that
    trial (or an upper bound of it). It steers only the data movement: any value
    gives the same event rows. It is not part of the result.
    ``keep_lane`` keeps the column ``_lane``: rows that agree on it and on ``on``
    are few and already in one partition, so they can be reduced first.
    """
    on = list(on)
    if isinstance(events, Parted):  # the store has split the heavy trials
        return events.attach(per_trial, weight, on, keep_lane, LANES)
    per_trial = together(per_trial)
    split_rows = SPLIT_ROWS if split_rows is None else split_rows
    own = events.columns
    added = [c for c in per_trial.columns if c not in on and c != weight]
    # a NULL key matches nothing; said here for both uses of the table, so
    # that they plan the same and its shuffle runs once
    per_trial = per_trial.where(" AND ".join(f"{quoted(c)} IS NOT NULL" for c in on))

    # the total names all columns, so that it too plans as the other uses do and reads their shuffle
    used = ", ".join(map(quoted, [*on, *added]))
    share = per_trial.agg(F.expr(f"(sum({quoted(weight)}) + 0 * max(xxhash64({used}))) / {HEAVY_KEYS}")).scalar()
    values = [quoted(c) for c in on], [f"{quoted(c)} AS {quoted('_heavy_' + c)}" for c in added]
    heavy = per_trial.where((F.col(weight) > split_rows) & (F.col(weight) > F.coalesce(share, F.lit(0)))).selectExpr(*values[0], "true AS _is_heavy", *values[1])
    spread = f"pmod(xxhash64({', '.join(map(quoted, own))}), {LANES}) + 1"
    tagged = add(
        events.join(F.broadcast(heavy), on, "left"), {"_lane": f"CASE WHEN _is_heavy THEN {spread} ELSE 0L END"}
    )
    # 0 for every trial; written so that the optimizer keeps the lane as a join
    # key instead of folding it into a filter
    keyed = per_trial.selectExpr(*values[0], *map(quoted, added), f"least(coalesce({quoted(weight)}, 0L), 0L) AS _lane")
    joined = tagged.join(keyed, [*on, "_lane"], "left")
    picked = [f"CASE WHEN _is_heavy THEN {quoted('_heavy_' + c)} ELSE {quoted(c)} END AS {quoted(c)}" for c in added]
    return joined.selectExpr(*map(quoted, own), *picked, *(["_lane"] if keep_lane else []))


def enrich_full(events: DataFrame, trials: DataFrame, on: Sequence[str] = TRIAL, **split) -> DataFrame:
    """Events with the values of their trial, and trials without events.

    The rows of a full outer join, but no event row passes one: events are joined
    from the left, and the trials that have none are told by their count.
    """
    sized = trials.join(together(row_counts(events, on, "_found")), list(on), "left")
    sized = drop(compute_once(sized, {"_n": "coalesce(_found, 0L)"}), "_found")
    joined = attach(events, sized, "_n", on, **split)
    alone = drop(sized.where("_n = 0"), "_n")
    return joined.unionByName(alone, allowMissingColumns=True)


def natural_full(left: DataFrame, right: DataFrame) -> DataFrame:
    """Full outer join on all common columns, for two tables of one row per trial."""
    return left.join(right, [c for c in left.columns if c in right.columns], "full")
