"""Spelling variants: words one edit apart, found by products of letter-count blocks.

1. Words of all texts are counted: in a task first, then by Spark.
2. Two words one edit apart have letter counts at a squared distance of 1 (a letter more)
   or 2 (a letter replaced). The letters are dealt into ``PARTS`` parts; the profile of a
   word is its number of letters in each. Every word goes to the block of its own profile
   (as a short word) and, for each part it has letters of, to the block of the profile with
   one letter of it less (as a long word). A pair one edit apart shares exactly one such
   block: long and short word for an inserted letter, two long words for a replaced one (of
   the blocks that two words of the same profile share, the one of the first part counts).
   So only words of the same and of adjacent lengths meet, and few of them.
3. In a block, one matrix product of the letter counts gives all squared distances; pairs
   at 1 and 2 are verified by place: equal up to the edit and after it.
4. The near words of a word are counted and the most frequent is kept, in the task first.

Blocks pass through a task as a sorted stream, about ``TILE`` rows at a time. A block of
more than ``TILE`` rows is dealt to a task for each pair of its parts of that size.

Defined cases: a null or empty text has no words; a null id counts as the empty text in
the check sum; repeated rows count again; an empty table gives no words; only the id and
the text of the input are read, whatever other columns are called.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, save

MIN_CHARS = 7
MIN_COUNT = 2
RATIO = 10
DROP_EVERY = 31
PARTS = 10
TILE = 1_024
ROWS_PER_TASK = 500_000
HELD_WORDS = 300_000
SHARED_ROWS = 256
#: forms lead to words at least RATIO times as frequent, so 63 bits end after 19 steps
HOPS = 5

_LETTERS = [*range(97, 123), *range(65, 91), *range(0xC0, 0x100)]
#: in Latin-1: letters with A-Z in lower case, everything else a space
_RUNS = bytes(LOWER[b] if b in set(_LETTERS) else 0x20 for b in range(256))
#: lower-cased letters have 26 + 64 columns
_COLUMN = np.full(256, -1, np.int64)
for _i, _c in enumerate([*range(97, 123), *range(0xC0, 0x100)]):
    _COLUMN[_c] = _i
_WIDTH = 90


# ---- words ----


def text_words(doc_id: object, text: str | None, min_chars: int = MIN_CHARS, drop_every: int = DROP_EVERY) -> Counter:
    """Counts of the words (Latin-1) of one text.

    Where ``drop_every`` divides the crc32 of ``<id>:<word>`` the word loses one letter.
    """
    out = Counter()
    if text:
        base = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
        for word, n in Counter(text.encode("latin-1", "replace").translate(_RUNS).split()).items():
            if len(word) >= min_chars:
                h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), base)
                if h % drop_every == 0:
                    at = h % len(word)
                    word = word[:at] + word[at + 1 :]
                    if len(word) < min_chars:
                        continue
                out[word] += n
    return out


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, drop_every: int = DROP_EVERY) -> DataFrame:
    """(word, n): words of at least ``min_chars`` letters with at least ``min_count`` occurrences."""

    def run(batches):
        counts = Counter()

        def rows():
            words = pa.array([w.decode("latin-1") for w in counts], pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts.update(text_words(doc, text, min_chars, drop_every))
            if len(counts) > HELD_WORDS:
                yield rows()
                counts = Counter()
        if counts:
            yield rows()

    listed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "word string, n long")
    return listed.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


# ---- blocks ----


class Letters:
    """Words as letter counts, and as letters in place from the left and from the right."""

    def __init__(self, words: list[bytes]):
        self.length = np.fromiter(map(len, words), np.int64, len(words))
        flat = _COLUMN[np.frombuffer(b"".join(words), np.uint8)]
        self.ends = np.cumsum(self.length)
        word = np.repeat(np.arange(len(words)), self.length)
        self.counts = np.bincount(word * _WIDTH + flat, minlength=len(words) * _WIDTH).reshape(len(words), _WIDTH)
        self.flat = flat.astype(np.int8)


_CHUNK = 1 << 16


def one_edit(words: Letters, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether words a (the longer, or as long) and b differ by one letter in place."""
    out = np.zeros(len(a), bool)
    by_length = np.argsort(words.length[a], kind="stable")
    start = 0
    while start < len(by_length):
        # rows of similar length share a rectangle; one very long word makes its own
        width = int(words.length[a[by_length[start]]])
        stop = start + max(1, _CHUNK * 32 // max(width, 32))
        stop = min(stop, int(np.searchsorted(words.length[a[by_length]], 2 * width, "right")))
        rows = by_length[start:stop]
        x, y = a[rows], b[rows]
        n, m = words.length[x], words.length[y]
        i = np.arange(int(m.max()) if len(m) else 0)
        inside = i < m[:, None]
        left = np.minimum(i, m[:, None] - 1)
        from_x, from_y = words.ends[x] - n, words.ends[y] - m
        same = words.flat[from_x[:, None] + left] == words.flat[from_y[:, None] + left]
        head = (np.cumsum(~same & inside, axis=1) == 0) & inside
        same = words.flat[words.ends[x][:, None] - 1 - left] == words.flat[words.ends[y][:, None] - 1 - left]
        tail = (np.cumsum(~same & inside, axis=1) == 0) & inside
        agree = head.sum(axis=1) + tail.sum(axis=1)
        out[rows] = np.where(n == m, agree == m - 1, agree >= m)
        start = stop
    return out


def near_pairs(words: Letters, block: np.ndarray, role: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs one edit apart within blocks.

    ``block`` numbers the blocks, ``role`` is -1 for a short word, else twice the part whose
    letter was taken, and one more if that is the first part the word has letters of.
    ``side`` is -1 where a block is whole, else tells the two parts that meet each other.
    """
    c = words.counts.astype(np.float32 if words.length.max(initial=0) < 2_000 else np.float64)
    c = c[:, c.any(axis=0)]
    norm = (c * c).sum(axis=1)
    distance = norm[:, None] + norm[None, :] - 2 * (c @ c.T)
    near = (distance == 1) | (distance == 2)
    near &= block[:, None] == block[None, :]
    a, b = np.nonzero(near)
    step, d = words.length[a] - words.length[b], distance[a, b]
    inserted = (step == 1) & (d == 1) & (role[b] < 0) & (role[a] >= 0)
    replaced = (step == 0) & (d == 2) & (role[a] >= 0) & (role[b] >= 0) & (a < b) & ((role[a] >> 1 != role[b] >> 1) | (role[a] & 1 == 1))
    keep = (inserted | replaced) & ((side[a] < 0) | (side[a] != side[b]))
    a, b = a[keep], b[keep]
    good = one_edit(words, a, b)
    return a[good], b[good]


def _key(profile: list[int]) -> bytes:
    return bytes(profile) if max(profile) < 256 else b"".join(p.to_bytes(4, "little") for p in profile)


_BLOCKED = "block binary, role int, word string, n long"


def blocked(words: DataFrame, parts: int = PARTS) -> DataFrame:
    """Every word in the block of its own profile and in those with one letter less; ``role`` as in ``near_pairs``."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            letters = Letters([w.encode("latin-1") for w in batch.column(0).to_pylist()])
            profiles = np.zeros((batch.num_rows, parts), np.int64)
            for column in range(_WIDTH):
                profiles[:, column % parts] += letters.counts[:, column]
            index, block, role = [], [], []
            for i, profile in enumerate(profiles.tolist()):
                index.append(i)
                block.append(_key(profile))
                role.append(-1)
                first = 1
                for j, n in enumerate(profile):
                    if n:
                        profile[j] -= 1
                        index.append(i)
                        block.append(_key(profile))
                        role.append(2 * j + first)
                        profile[j] += 1
                        first = 0
            at = pa.array(index)
            arrays = [pa.array(block, pa.binary()), pa.array(role, pa.int32()), batch.column(0).take(at), batch.column(1).take(at)]
            yield pa.RecordBatch.from_arrays(arrays, names=["block", "role", "word", "n"])

    return words.select("word", "n").mapInArrow(run, _BLOCKED)


def dealt(rows: DataFrame, tile: int = TILE) -> DataFrame:
    """Adds the task pair (lo, hi) and the side of each row; large blocks are dealt in pairs of parts.

    Whole blocks have lo = hi = 0 and side -1. ``rows`` must be a stored table. The list of
    large blocks is stored too, so Spark knows its size when it picks the join.
    """
    large = rows.groupBy("block").count().where(F.col("count") > tile).select("block", F.ceil(F.col("count") / tile).cast("int").alias("cuts"))
    cut = rows.join(save(large, "large-blocks"), "block", "left").withColumn("part", F.pmod(F.xxhash64("word"), F.col("cuts")).cast("int"))
    paired = cut.withColumn("other", F.explode(F.expr("CASE WHEN cuts IS NULL THEN array(0) ELSE sequence(0, cuts - 1) END")))
    own = F.coalesce("part", "other")
    side = F.when(own == F.col("other"), F.lit(-1)).otherwise(own)
    return paired.withColumns({"lo": F.least(own, "other"), "hi": F.greatest(own, "other"), "side": side}).drop("cuts", "part", "other")


_NEAR = "word string, n_near long, best_n long, best string"


def near_words(rows: DataFrame, tasks: int, tile: int = TILE) -> DataFrame:
    """(word, n_near, best_n, best): parts of the count of near words, and the most frequent of them."""

    def run(batches):
        partial: dict[str, list] = {}

        def search(table: pa.Table, group: np.ndarray):
            word, n = table["word"].to_pylist(), table["n"].to_numpy()
            role, side = table["role"].to_numpy(), table["side"].to_numpy()
            latin = [w.encode("latin-1") for w in word]
            # small blocks side by side share one product
            ends = [*np.flatnonzero(group[1:] != group[:-1]) + 1, len(group)]
            a = k = 0
            while k < len(ends):
                k += 1
                while k < len(ends) and ends[k] - a <= SHARED_ROWS:
                    k += 1
                rows = slice(a, int(ends[k - 1]))
                x, y = near_pairs(Letters(latin[rows]), group[rows], role[rows], side[rows])
                for i, j in zip((x + a).tolist(), (y + a).tolist()):
                    for one, other in ((i, j), (j, i)):
                        key = (-int(n[other]), word[other])
                        seen = partial.setdefault(word[one], [0, key])
                        seen[0] += 1
                        if key < seen[1]:
                            seen[1] = key
                a = rows.stop

        def found():
            words = list(partial)
            arrays = [pa.array(words, pa.string()), pa.array([partial[w][0] for w in words], pa.int64())]
            arrays += [pa.array([-partial[w][1][0] for w in words], pa.int64()), pa.array([partial[w][1][1] for w in words], pa.string())]
            partial.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["word", "n_near", "best_n", "best"])

        def groups(table: pa.Table) -> np.ndarray:
            new = np.zeros(table.num_rows, bool)
            for name in ("block", "lo", "hi"):
                column = table[name].combine_chunks()
                codes = (column.dictionary_encode().indices if name == "block" else column).to_numpy()
                new[1:] |= codes[1:] != codes[:-1]
            return np.cumsum(new)

        held, count = [], 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= 8 * tile:  # all blocks but the last are whole
                table = pa.Table.from_batches(held)
                group = groups(table)
                cut = int(np.searchsorted(group, group[-1]))
                search(table.slice(0, cut), group[:cut])
                held, count = table.slice(cut).to_batches(), count - cut
                if len(partial) > HELD_WORDS:
                    yield found()
        if count:
            table = pa.Table.from_batches(held)
            search(table, groups(table))
        if partial:
            yield found()

    keys = ["block", "lo", "hi"]
    return rows.repartition(tasks, *keys).sortWithinPartitions(*keys).mapInArrow(run, _NEAR)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for rows (word, form): the last form reached, by doubling the steps."""
    current = forms.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(HOPS):
        onward = current.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        current = save(current.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root")), "roots")
    return current


def variants(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    min_count: int = MIN_COUNT,
    ratio: int = RATIO,
    drop_every: int = DROP_EVERY,
    parts: int = PARTS,
    tile: int = TILE,
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word.

    ``form`` is the most frequent near word (ties: the smallest) if it occurs at least
    ``ratio`` times as often as the word; ``root`` ends the chain of forms.
    """
    if ratio < 2:
        raise ValueError("ratio must be at least 2, so that chains of forms are short")
    words = save(word_counts(docs, id_col, text_col, min_chars, min_count, drop_every), "words")
    rows = save(blocked(words, parts), "word-blocks")
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS_PER_TASK))
    found = near_words(dealt(rows, tile), tasks, tile).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("m"), "best")).alias("top"))
    near = words.join(found, "word", "left")
    is_form = -F.col("top.m") >= ratio * F.col("n")
    forms = near.select(
        "word", F.when(is_form, F.col("top.best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, -F.col("top.m")).alias("form_n")
    )
    forms = save(forms, "word-forms")
    joined = forms.join(roots(forms), "word", "left")
    return joined.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
