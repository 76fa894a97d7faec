"""Packing documents into sequences by non-negative least squares over length patterns.

1. Tasks tokenise texts, add the end id and cut what is longer than a sequence: a first
   piece of the remainder, then full pieces.
2. Spark counts pieces by length. The histogram has at most ``MAX_LENGTH`` rows, so it
   fits on the driver whatever the corpus.
3. On the driver: all patterns of up to ``DEPTH`` lengths that fill a sequence are
   enumerated; repeat counts x >= 0 are fitted to the histogram h by least squares
   (accelerated projected gradient on the pattern-length incidence), rounded to whole
   counts that the histogram holds. What is left is packed by best fit on counts, longest
   first. Of the depths up to ``DEPTH`` and two ways to round, the plan with the fewest
   sequences is taken.
4. The plan says, for each length, which run of ranks goes to which pattern. Pieces get
   a rank within their length by Spark (two levels, so that a very common length is
   spread) and look their sequence up in the plan.

The plan's size depends on the maximum length, not on the number of documents.

Defined cases: a null or empty text is the end id alone; repeated rows are packed each;
a null id stays null; an empty table gives no rows. ``<|endoftext|>`` in a text is
the added token of the JSON file, as ``tokenizers`` takes it by default.
"""

from __future__ import annotations

import base64
import bisect
import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import binary, rank_rows, save

MAX_LENGTH = 1024
END_ID = 2
DEPTH = 3
ROUNDS = 300
TOKENIZER = "byte_bpe_50k.tiktoken"
WHOLE = "byte_bpe_50k.json"
#: the added tokens of byte_bpe_50k.json
ADDED = {"<|endoftext|>": 50256}


def load_encoder(path: str, whole: str | None = None):
    """Text to ids by a byte-level BPE vocabulary given as ranks: the ids of ``tokenizers`` with the JSON file ``whole``.

    Both libraries give the same ids (tested); the faster one takes a fifth of the time but
    gives up on runs of more than a million blanks or letters, which go to ``tokenizers``.
    """
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    encoding = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=ADDED)

    def encode(text: str) -> list[int]:
        try:
            return encoding.encode(text, allowed_special="all")
        except ValueError:
            return slow().encode(text, add_special_tokens=False).ids

    @functools.cache
    def slow():
        from tokenizers import Tokenizer

        return Tokenizer.from_file(whole or public_tokenizers.path(WHOLE))

    return encode


_ENCODERS: dict = {}


def encoder(path: str):
    """One for each Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = load_encoder(path)
    return _ENCODERS[path]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def pieces(docs: DataFrame, id_col: str, text_col: str, length: int = MAX_LENGTH, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """(uid, id, piece, start, length, ids_crc32 and, on request, ids): every piece of every document."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"uid long, `{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    path = path or tokenizer_path()

    def run(batches):
        encode, row = encoder(path), TaskContext.get().partitionId() << 40
        for batch in batches:
            source, columns, ids_of = [], ([], [], [], [], []), []
            for i, text in enumerate(binary(batch, text_col)):
                ids = np.array([*(encode(text.decode()) if text else ()), END_ID], "<u4")
                data, n = memoryview(ids.tobytes()), len(ids)
                cuts = [0, *range(n % length or length, n, length), n]
                for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    part = data[4 * a : 4 * b]
                    source.append(i)
                    for column, value in zip(columns, (row, piece, a, b - a, zlib.crc32(part))):
                        column.append(value)
                    row += 1
                    if with_ids:
                        ids_of.append(part)
            arrays = [pa.array(columns[0], pa.int64()), batch.column(id_col).take(pa.array(source, pa.int64())), pa.array(columns[1], pa.int32())]
            arrays += [pa.array(c, pa.int64()) for c in columns[2:]]
            names = ["uid", id_col, "piece", "start", "length", "ids_crc32"]
            if with_ids:
                flat = np.frombuffer(b"".join(ids_of), np.int32)
                offsets = np.cumsum([0, *(len(x) // 4 for x in ids_of)])
                arrays.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat)))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def patterns(length: int, depth: int = DEPTH) -> np.ndarray:
    """All patterns of up to ``depth`` (1 to 3) ascending lengths that fill a sequence; 0 for no document."""
    rows = [np.array([[0, 0, length]])]
    if depth > 1:
        a = np.arange(1, length // 2 + 1)
        rows.append(np.stack([np.zeros_like(a), a, length - a], axis=1))
    if depth > 2:
        for a in range(1, length // 3 + 1):
            b = np.arange(a, (length - a) // 2 + 1)
            rows.append(np.stack([np.full_like(b, a), b, length - a - b], axis=1))
    return np.concatenate(rows)


def fitted(histogram: np.ndarray, shapes: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """x >= 0 that minimises |A x - h|; A holds how often a pattern takes a length."""
    total = histogram.sum()
    if not total:
        return np.zeros(len(shapes))
    h = histogram / total

    def taken(x):
        out = np.bincount(shapes.ravel(), np.repeat(x, shapes.shape[1]), len(h))
        out[0] = 0
        return out

    def back(r):
        return r[shapes].sum(axis=1)

    v = np.ones(len(shapes))
    for _ in range(20):  # the largest eigenvalue bounds the step
        v = back(taken(v))
        step = np.linalg.norm(v)
        v /= step
    x = y = np.zeros(len(shapes))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(y - back(taken(y) - h) / (1.02 * step), 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x * total


def rounded(x: np.ndarray, shapes: np.ndarray, left: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Whole repeat counts; a pattern's fraction is carried to the next one. ``left`` loses what is used."""
    wanted = np.diff(np.floor(np.cumsum(x) + 1e-9), prepend=0).astype(np.int64)
    out = []
    for i in np.flatnonzero(wanted).tolist():
        shape = tuple(n for n in shapes[i].tolist() if n)
        count = min(int(wanted[i]), *(int(left[n]) // shape.count(n) for n in shape))
        if count > 0:
            for n in shape:
                left[n] -= count
            out.append((shape, count))
    return out


def best_fit(left: np.ndarray, length: int) -> list[tuple[tuple[int, ...], int]]:
    """Packs what is left, longest first, each into the fullest sequence it fits; on counts of equal sequences."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    room: list[int] = []
    for n in range(length, 0, -1):
        count = int(left[n])
        while count:
            at = bisect.bisect_left(room, n)
            if at == len(room):
                shape, have = (), count
            else:
                space = room[at]
                shape, have = open_[space].pop()
                if have > count:
                    open_[space].append((shape, have - count))
                if not open_[space]:
                    del open_[space]
                    room.pop(at)
            used = min(have, count)
            space = length - sum(shape) - n
            if space not in open_:
                open_[space] = []
                bisect.insort(room, space)
            open_[space].append(((*shape, n), used))
            count -= used
    return [x for some in open_.values() for x in some]


def packing(histogram: np.ndarray, length: int, depth: int, whole: bool) -> list[tuple[tuple[int, ...], int]]:
    """Patterns with counts for all pieces; ``whole`` drops the fractions of the fit, else they are carried on."""
    left, shapes = histogram.astype(np.int64).copy(), patterns(length, depth)
    x = fitted(histogram, shapes)
    return rounded(np.floor(x) if whole else x, shapes, left) + best_fit(left, length)


class Plan:
    """Which ranks of each length go to which sequence and place."""

    def __init__(self, histogram: np.ndarray, length: int = MAX_LENGTH, depth: int = DEPTH):
        packed = min((packing(histogram, length, d, whole) for d in range(1, depth + 1) for whole in (True, False)), key=lambda p: sum(n for _, n in p))
        used, rows, sequence = [0] * (length + 1), [], 0
        for shape, count in packed:
            offset = 0
            for n in shape:
                rows.append((n, used[n], sequence, offset))
                used[n] += count
                offset += n
            sequence += count
        self.sequences = sequence
        rows.sort()
        columns = np.array(rows, np.int64).reshape(-1, 4)
        self.key = (columns[:, 0] << 48) + columns[:, 1]
        self.first, self.sequence, self.offset = columns[:, 1], columns[:, 2], columns[:, 3]

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, (length << 48) + rank, "right") - 1
        return self.sequence[at] + rank - self.first[at], self.offset[at]


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = MAX_LENGTH, path: str | None = None, with_ids: bool = False
) -> DataFrame:
    """Every piece with its ``sequence_id`` and ``offset``; with its token ids on request."""
    made = save(pieces(docs, id_col, text_col, length, path, with_ids), "pieces")
    counts = made.groupBy("length").count().collect()  # at most ``length`` rows
    histogram = np.zeros(length + 1, np.int64)
    for n, count in counts:
        histogram[n] = count
    plan = docs.sparkSession.sparkContext.broadcast(Plan(histogram, length))
    ranked = rank_rows(made.select("uid", "length") if with_ids else made, "length", ["uid"], "rank", int(histogram.sum()))

    def place(batches):
        for batch in batches:
            sequence, offset = plan.value.place(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            rest = batch.select([n for n in batch.schema.names if n != "rank"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(sequence), pa.array(offset)], names=[*rest.schema.names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.drop("rank").schema)
    placed = ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")
    if with_ids:
        placed = made.join(placed.drop("length"), "uid")
    return placed.drop("uid")
