"""Frames in two parts: usual trials, which lie together, and heavy ones, which are spread.

``Parted`` has the methods of a frame that the operators use on events and on per-trial
rows. What keeps trials apart is done in each part, so the usual part keeps its buckets
and needs no shuffle; what mixes trials is done on the union. A heavy trial lies in the heavy
part of every frame that was made from the same store.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sql import add, quoted

_TRIAL = ("participant", "tno")


class Parted:
    """``usual`` and ``heavy`` rows of trials; ``heavy`` is None where a store has no heavy trial."""

    def __init__(self, usual: DataFrame, heavy: DataFrame | None, store: str):
        self.usual, self.heavy, self.store = usual, heavy, store

    def each(self, fn: Callable[[DataFrame], DataFrame]) -> Parted:
        """``fn`` on both parts; it must keep trials apart."""
        return Parted(fn(self.usual), None if self.heavy is None else fn(self.heavy), self.store)

    def union_parts(self) -> DataFrame:
        return self.usual if self.heavy is None else self.usual.unionByName(self.heavy)

    # ---- row by row ----

    @property
    def columns(self) -> list[str]:
        return self.usual.columns

    def where(self, condition) -> Parted:
        return self.each(lambda df: df.where(condition))

    def select(self, *columns) -> Parted | DataFrame:
        return self._kept(lambda df: df.select(*columns))

    def selectExpr(self, *columns) -> Parted | DataFrame:
        return self._kept(lambda df: df.selectExpr(*columns))

    def withColumn(self, name: str, column) -> Parted:
        return self.each(lambda df: df.withColumn(name, column))

    def withColumnRenamed(self, old: str, new: str) -> Parted | DataFrame:
        return self._kept(lambda df: df.withColumnRenamed(old, new))

    def drop(self, *names: str) -> Parted | DataFrame:
        return self._kept(lambda df: df.drop(*names))

    def _kept(self, fn) -> Parted | DataFrame:
        out = self.each(fn)
        return out if set(_TRIAL) <= set(out.columns) else out.union_parts()

    # ---- by trial ----

    def groupBy(self, *keys: str):
        names = {k.strip("`") for k in keys if isinstance(k, str)}
        return _Grouped(self, keys) if set(_TRIAL) <= names else self.union_parts().groupBy(*keys)

    def join(self, other: Parted | DataFrame, on: Sequence[str], how: str = "inner") -> Parted | DataFrame:
        """Joins by trial stay inside the parts, whether the other side has parts or not."""
        apart = set(_TRIAL) <= set(on)
        if isinstance(other, Parted):
            if not apart or other.store != self.store:
                return self.union_parts().join(other.union_parts(), on, how)
            heavy = None if self.heavy is None else self.heavy.join(other.heavy, on, how)
            return Parted(self.usual.join(other.usual, on, how), heavy, self.store)
        if apart and how in ("inner", "left", "left_outer", "left_semi", "left_anti", "semi", "anti"):
            return self.each(lambda df: df.join(other, on, how))
        return self.union_parts().join(other, on, how)

    def attach(self, per_trial: Parted | DataFrame, weight: str, on: Sequence[str], keep_lane: bool, lanes: int) -> Parted:
        """Left join of events to per-trial values. Heavy trials are few: theirs are broadcast."""
        own = self.columns
        added = [c for c in per_trial.columns if c not in on and c != weight]

        def joined(events: DataFrame, side: DataFrame, lane: str) -> DataFrame:
            out = events.join(side.select(*on, *map(quoted, added)), list(on), "left").selectExpr(*map(quoted, [*own, *added]))
            return add(out, {"_lane": lane}) if keep_lane else out

        mine = isinstance(per_trial, Parted) and per_trial.store == self.store
        side = per_trial if mine or not isinstance(per_trial, Parted) else per_trial.union_parts()
        usual = joined(self.usual, side.usual if mine else side, "0L")
        if self.heavy is None:
            return Parted(usual, None, self.store)
        few = side.heavy if mine else side.join(self.heavy.select(*on).distinct(), list(on), "left_semi")
        spread = f"pmod(xxhash64({', '.join(map(quoted, own))}), {lanes}) + 1"
        return Parted(usual, joined(self.heavy, F.broadcast(few), spread), self.store)

    def unionByName(self, other: Parted | DataFrame, **options) -> Parted | DataFrame:
        if isinstance(other, Parted) and other.store == self.store:
            heavy = None if self.heavy is None else self.heavy.unionByName(other.heavy, **options)
            return Parted(self.usual.unionByName(other.usual, **options), heavy, self.store)
        rest = other.union_parts() if isinstance(other, Parted) else other
        return self.union_parts().unionByName(rest, **options)

    def __getattr__(self, name: str):
        """Everything else is done on the union of the parts."""
        return getattr(self.union_parts(), name)


class _Grouped:
    def __init__(self, rows: Parted, keys: Sequence[str]):
        self.rows, self.keys = rows, keys

    def agg(self, *columns) -> Parted:
        return self.rows.each(lambda df: df.groupBy(*self.keys).agg(*columns))


def together(df: Parted | DataFrame) -> DataFrame:
    """A plain frame with all rows."""
    return df.union_parts() if isinstance(df, Parted) else df
