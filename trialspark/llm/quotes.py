"""Chat formatting by quotation linking.

1. Lines that start with ``>`` marks are quotes, one level for each mark. Consecutive
   lines of one level form passages, cut at blank lines. A message's own text is what
   is left, without the line that announces a quote ("... wrote:").
2. Passages are normalised (lower case, single blanks) and hashed.
3. A quoted passage is joined to the latest earlier message of its conversation whose own
   text holds the passage. The latest one is looked up inside blocks of ``BLOCK`` turns
   and carried from block to block, so a passage that a whole conversation repeats is
   neither paired with itself nor gathered in one task.
4. A quote that no message holds as a whole, such as a trimmed one or one that starts in the
   middle of a paragraph, is looked up by its lines and its sentences (normalised; sentences
   do not depend on where lines are wrapped). Each finds the latest earlier message with the
   same line or sentence; the message with the most characters found wins, then the latest.
5. A message answers the original of its outermost linked quote, the latest if there are
   several. Messages connected by answers form a thread, named by its first turn.
6. Conversations come out without quotes, ordered by thread and turn, so every answer
   follows what it quotes.

Defined cases: null and empty texts have no passages and an empty own text; a quote
without an original links nothing; messages without links are threads of their own;
repeated (conversation, turn) rows are one message and are all returned; rows with a
null conversation or turn are not linked.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import save, with_columns
from .components import components

BLOCK_BITS = 16
_MARKS = re.compile(r"(?:[ \t]*>)+[ \t]?")
_SENTENCE = re.compile(r"(?<=[.!?…。！？])\s+")
_LINE, _SENTENCES = 0, 1
_ANNOUNCES = re.compile(r"\b(wrote|writes|said|schrieb|écrit|escribió)\s*:\s*$", re.IGNORECASE)


def _normal(text: str) -> str:
    return " ".join(text.lower().split())


def _hash(text: str) -> bytes:
    return hashlib.blake2b(text.encode(), digest_size=16).digest()


def passages(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """Own text, and (level, normalised passage) in order; level 0 is the message's own."""
    own, found = _cut(text)
    normal = ((level, _normal(" ".join(lines))) for level, lines in found)
    return own, [(level, passage) for level, passage in normal if passage]


def parts(lines: list[str]) -> set[tuple[int, str]]:
    """(kind, text) of the normalised lines and sentences of a passage."""
    cut = {(_LINE, _normal(line)) for line in lines} | {(_SENTENCES, x) for x in _SENTENCE.split(_normal(" ".join(lines)))}
    return {(kind, x) for kind, x in cut if x}


def _cut(text: str | None) -> tuple[str, list[tuple[int, list[str]]]]:
    own: list[str] = []
    found: list[tuple[int, list[str]]] = []
    open_, before = False, 0
    for line in (text or "").split("\n"):
        marks = _MARKS.match(line)
        level, content = (marks.group().count(">"), line[marks.end() :]) if marks else (0, line)
        if level and not before and own and _ANNOUNCES.search(own[-1]):  # the line just above announces this quote
            own.pop()
            found[-1][1].pop()
        before = level
        if not level:
            own.append(content)
        if not content.strip():
            open_ = False
        elif open_ and found[-1][0] == level:
            found[-1][1].append(content)
        else:
            found.append((level, [content]))
            open_ = True
    return "\n".join(own).strip("\n"), found


def parsed(messages: DataFrame, text_col: str) -> DataFrame:
    """The messages with ``_own`` and ``_passages`` (level, hash)."""
    kind = T.ArrayType(T.StructType([T.StructField("level", T.IntegerType()), T.StructField("hash", T.BinaryType())]))
    schema = T.StructType([*messages.schema.fields, T.StructField("_own", T.StringType()), T.StructField("_passages", kind)])
    arrow = pa.list_(pa.struct([("level", pa.int32()), ("hash", pa.binary())]))

    def run(batches):
        for batch in batches:
            own, found = [], []
            for text in batch.column(text_col).to_pylist():
                mine, some = passages(text)
                own.append(mine)
                found.append([{"level": n, "hash": _hash(p)} for n, p in some])
            yield with_columns(batch, {"_own": pa.array(own, pa.string()), "_passages": pa.array(found, arrow)})

    return messages.mapInArrow(run, schema)


def cut_parts(messages: DataFrame) -> DataFrame:
    """(conv, turn, level, hash, kind, part, n): lines and sentences of every passage of (conv, turn, text), with their characters."""
    kind = messages.schema["conv"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            source, columns = [], ([], [], [], [], [])
            for i, text in enumerate(batch.column("text").to_pylist()):
                for level, lines in _cut(text)[1]:
                    whole = _hash(_normal(" ".join(lines)))
                    for of, part in parts(lines):
                        source.append(i)
                        for column, value in zip(columns, (level, whole, of, _hash(part), len(part))):
                            column.append(value)
            taken = [batch.column(c).take(pa.array(source, pa.int64())) for c in ("conv", "turn")]
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*taken, *arrays], names=["conv", "turn", "level", "hash", "kind", "part", "n"])

    return messages.select("conv", "turn", "text").mapInArrow(run, f"conv {kind}, turn long, level int, hash binary, kind int, part binary, n long")


def linked_by_parts(messages: DataFrame, rest: DataFrame) -> DataFrame:
    """Links (conv, hash, turn, level, _found) of the quotes ``rest`` (conv, hash, turn, level) by their lines and sentences."""
    cut = save(cut_parts(messages.join(rest.select("conv").distinct(), "conv", "left_semi")), "parts")
    quoted = cut.where("level > 0").select("conv", "hash", "turn", "kind", "part", "n").distinct()
    quoted = save(quoted.join(rest, ["conv", "hash", "turn"]), "quoted_parts")
    points = quoted.select("conv", "part", "turn").distinct()
    originals = cut.where("level = 0").select("conv", "part", "turn").distinct().join(quoted.select("conv", "part").distinct(), ["conv", "part"], "left_semi")
    found = latest_before(points, originals, ["conv", "part"]).where("_found IS NOT NULL")
    # lines and sentences hold the same text, so they are not added to each other
    agreed = quoted.join(found, ["conv", "part", "turn"]).groupBy("conv", "hash", "turn", "level", "kind", "_found").agg(F.sum("n").alias("n"))
    best = agreed.groupBy("conv", "hash", "turn", "level").agg(F.max(F.struct("n", "_found")).alias("b"))
    return best.select("conv", "hash", "turn", "level", F.col("b._found").alias("_found"))


def latest_before(points: DataFrame, originals: DataFrame, keys: list[str]) -> DataFrame:
    """``points`` (keys, turn, ...) with ``_found``: the largest original turn below theirs, null if none.

    Both hold a (keys, turn) once at most. A block has 2^BLOCK_BITS turns, so a window's group is bounded.
    """
    block = F.shiftright(F.col("turn").cast("long"), BLOCK_BITS)
    both = points.withColumn("_is", F.lit(False)).unionByName(originals.withColumn("_is", F.lit(True)), allowMissingColumns=True).withColumn("_block", block)
    inside = Window.partitionBy(*keys, "_block").orderBy("turn", "_is").rowsBetween(Window.unboundedPreceding, -1)
    # originals sort after a point of the same turn, so only earlier turns are seen
    seen = both.withColumn("_near", F.max(F.when(F.col("_is"), F.col("turn"))).over(inside))
    last = originals.withColumn("_block", block).groupBy(*keys, "_block").agg(F.max("turn").alias("_last"))
    carried = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    needed = points.withColumn("_block", block).select(*keys, "_block").distinct()
    blocks = last.select(*keys, "_block", "_last").unionByName(needed.withColumn("_last", F.lit(None).cast("long"))).groupBy(*keys, "_block").agg(F.max("_last").alias("_last"))
    before = blocks.withColumn("_before", F.max("_last").over(carried)).select(*keys, "_block", "_before")
    return seen.where("NOT _is").join(before, [*keys, "_block"], "left").withColumn("_found", F.coalesce("_near", "_before")).drop("_is", "_block", "_near", "_before")


def linked(
    messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """Every message with parent_turn, thread_turn, counts of quotes, own text and chat form, in reply order."""
    rows = save(parsed(messages.select(conv_col, turn_col, role_col, text_col), text_col), "parsed")
    keyed = rows.where(F.col(conv_col).isNotNull() & F.col(turn_col).isNotNull())
    each = keyed.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.inline("_passages"))
    quoted = each.where("level > 0").groupBy("conv", "hash", "turn").agg(F.min("level").alias("level"))
    # only passages that somebody quotes matter
    wanted = quoted.select("conv", "hash").distinct()
    originals = each.where("level = 0").select("conv", "hash", "turn").distinct().join(wanted, ["conv", "hash"], "left_semi")
    looked = save(latest_before(quoted, originals, ["conv", "hash"]), "links")
    rest = looked.where("_found IS NULL").select("conv", "hash", "turn", "level")
    texts = keyed.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(text_col).alias("text"))
    links = save(looked.where("_found IS NOT NULL").unionByName(linked_by_parts(texts, rest)), "all_links")
    best = F.max(F.struct(-F.col("level"), F.col("_found").alias("found")))
    answers = links.groupBy("conv", "turn").agg(best.alias("b"), F.count("*").alias("n_linked")).select("conv", "turn", F.col("b.found").alias("parent_turn"), "n_linked")
    node = [F.struct("conv", F.col("turn").alias("t")).alias("u"), F.struct("conv", F.col("parent_turn").alias("t")).alias("v")]
    roots = components(answers.select(*node)).select(F.col("node.conv").alias("_c"), F.col("node.t").alias("_t"), F.col("root.t").alias("_root"))
    answered = answers.toDF("_conv", "_turn", "parent_turn", "n_linked")
    turn = F.col(turn_col).cast("long")
    out = (
        rows.join(answered, (F.col(conv_col) == F.col("_conv")) & (turn == F.col("_turn")), "left")
        .join(roots, (F.col(conv_col) == F.col("_c")) & (turn == F.col("_t")), "left")
        .select(
            conv_col,
            turn_col,
            role_col,
            "parent_turn",
            F.coalesce("_root", turn).alias("thread_turn"),
            F.expr("size(filter(_passages, p -> p.level > 0))").cast("long").alias("n_quoted"),
            F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
            F.col("_own").alias(text_col),
            F.concat(F.lit("<|"), F.coalesce(F.col(role_col), F.lit("unknown")), F.lit("|>\n"), F.col("_own"), F.lit("\n<|end|>\n")).alias("formatted"),
        )
    )
    order = [conv_col, "thread_turn", turn_col]
    return out.repartitionByRange(*order).sortWithinPartitions(*order)
