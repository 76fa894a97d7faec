"""Value of the previous row within a group that may be arbitrarily long."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..functions.sql import add, drop, quoted

BLOCK = 65_536


def previous_value(
    df: DataFrame,
    by: Sequence[str],
    order: str,
    value: str,
    name: str,
    block: int = BLOCK,
) -> DataFrame:
    """Add ``name`` = ``value`` of the preceding row of the group, NULL on its first row.

    A plain ``lag`` would pull a whole group into one task. Here the group is cut
    into blocks of consecutive ``order`` values and lagged inside them; only the
    first row of each block then looks up the last value of the block before it.
    With ``order`` a 32-bit integer that is unique within the group, no window
    sees more than ``block`` rows of a block or 2^32 / ``block`` first rows.
    """
    keys = ", ".join(map(quoted, by))
    at = quoted(order)
    block_of = f"PARTITION BY {keys}, _block ORDER BY {at}"
    whole = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
    blocked = add(
        add(df, {"_block": f"floor({at} / {block})"}),
        {
            "_inside": f"lag({quoted(value)}) OVER ({block_of})",
            "_starts": f"lag({at}) OVER ({block_of}) IS NULL",
            "_tail": f"last_value({quoted(value)}) OVER ({block_of} {whole})",
        },
    )
    # the first rows of all blocks of a group meet under the block NULL
    firsts = f"PARTITION BY {keys}, CASE WHEN NOT _starts THEN _block END ORDER BY _block"
    carried = add(blocked, {"_carried": f"lag(_tail) OVER ({firsts})"})
    return drop(add(carried, {name: "CASE WHEN _starts THEN _carried ELSE _inside END"}), "_block", "_inside", "_starts", "_tail", "_carried")


def previous_in_order(
    df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, name: str, parts: int | None = None
) -> DataFrame:
    """Add ``name`` = ``value`` of the preceding row of the group, for any columns that sort.

    Rows are dealt to ranges of (``by``, ``order``): a long group takes as many ranges as it
    fills. Rows are lagged inside (group, range); the first row of each then takes the last
    value of the range before. No window holds more than a range, or one row of each.

    NULLs in ``order`` come first, and a NULL group is a group. Rows that tie in all of
    ``order`` follow one another by ``value``, NULLs first, so the result is the same each
    time; name further columns in ``order`` to break ties otherwise. The first row of a
    group has NULL.
    """
    keys = ", ".join(map(quoted, by))
    along = ", ".join(map(quoted, [*order, value]))
    columns = [*map(quoted, by), *map(quoted, order), quoted(value)]
    ranged = df.repartitionByRange(parts, *columns) if parts else df.repartitionByRange(*columns)
    inside = f"PARTITION BY {keys}, _part ORDER BY {along}"
    whole = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
    cut = add(
        add(ranged, {"_part": "spark_partition_id()"}),
        {
            "_inside": f"lag({quoted(value)}) OVER ({inside})",
            "_starts": f"row_number() OVER ({inside}) = 1",
            "_tail": f"last_value({quoted(value)}) OVER ({inside} {whole})",
        },
    )
    # the first rows of all ranges of a group meet under the range NULL
    firsts = f"PARTITION BY {keys}, CASE WHEN NOT _starts THEN _part END ORDER BY _part"
    carried = add(cut, {"_carried": f"lag(_tail) OVER ({firsts})"})
    return drop(add(carried, {name: "CASE WHEN _starts THEN _carried ELSE _inside END"}), "_part", "_inside", "_starts", "_tail", "_carried")
