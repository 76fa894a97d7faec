"""Drop lines that many documents share: a sharded minimal perfect hash over line hashes.

1. Each task packs the lines of its documents: the distinct 128-bit hashes of their keys,
   cut by hash into shards, each with the largest ids that hold it, and for each document
   the places of its hashes in that list. A line counts once in such a pack however
   many of its documents hold it, so a line of every document is as small as any other.
2. Each shard gets a minimal perfect hash over its distinct hashes (levels of bits, as
   long as hashes collide). It indexes three arrays: fingerprint, number of documents (no
   further than the limit), and the largest id.
3. The packs probe the arrays of their shards; what comes back are places of lines to
   drop. No line is joined, and only documents with such lines meet their answer.

All steps but the last move packed numbers; texts move at most once. Shards hold about
``SHARD_BYTES`` of text and packs ``PACK_LINES`` lines, so tasks don't grow with the corpus.

Defined cases: a null or empty text is one empty line; rows that repeat an id are one
document, and a null id is one more, smaller than all others; lines of one document that
repeat are dropped or kept together; every input row gives one row; only the id and the
text of the input are read, whatever other columns are called.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, binary, save, text_bytes

MIN_CHARS = 20
MIN_DOCS = 3
SHARD_BYTES = 64 << 20
PACK_LINES = 400_000
NO_ID = -(1 << 63)
_GAMMA = 2.0
_U = np.uint64


# ---- keys ----


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The stripped line in lower case, or None if it is shorter than ``min_chars`` code points."""
    key = line.strip()
    if len(key) < min_chars or not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return key.translate(LOWER)


def text_keys(text: bytes | None, min_chars: int) -> list[bytes]:
    """Digests of the distinct keys of a text."""
    keys = {line_key(line, min_chars) for line in (text or b"").split(b"\n")}
    return [xxhash.xxh3_128_digest(k) for k in keys if k is not None]


# ---- minimal perfect hash ----


def _mix(h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
    x = h1 ^ (h2 * _U(0x9E3779B97F4A7C15) + _U(level * 0xD1B54A32D192ED03 % (1 << 64)))
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class PerfectHash:
    """Numbers 0 ... n-1 of n distinct hash pairs.

    A hash alone at its place of a level sets the bit there; the others go on to the next
    level. The number of a hash is the count of set bits before its own.
    """

    def __init__(self, sizes: list[int], words: np.ndarray):
        self.sizes, self.words = sizes, words
        counts = np.bitwise_count(words).astype(np.int64)
        self.before = np.cumsum(counts) - counts

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray) -> PerfectHash:
        sizes, words = [], []
        while len(h1):
            size = 64 * max(1, int(np.ceil(_GAMMA * len(h1) / 64)))
            place = (_mix(h1, h2, len(sizes)) % _U(size)).astype(np.int64)
            alone = np.bincount(place, minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            left = ~alone[place]
            h1, h2 = h1[left], h2[left]
        return cls(sizes, np.concatenate(words) if words else np.zeros(0, "<u8"))

    def __call__(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The number of each hash; -1 or any number for a hash that was not built in."""
        out = np.full(len(h1), -1, np.int64)
        todo, base = np.arange(len(h1)), 0
        for level, size in enumerate(self.sizes):
            place = (_mix(h1[todo], h2[todo], level) % _U(size)).astype(np.int64) + base
            word, bit = place >> 6, (place & 63).astype(_U)
            found = (self.words[word] >> bit) & _U(1) == 1
            at = word[found]
            below = self.words[at] & ((_U(1) << bit[found]) - _U(1))
            out[todo[found]] = self.before[at] + np.bitwise_count(below)
            todo, base = todo[~found], base + size
        return out


# ---- packs ----


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a new run begins in columns sorted together."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def largest_ids(key: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, id) of the ``most`` largest distinct ids of each key, by key and falling id."""
    order = np.lexsort((ids, key))[::-1]
    key, ids = key[order], ids[order]
    new = _starts(key, ids)
    key, ids = key[new], ids[new]
    first = np.flatnonzero(_starts(key))
    rank = np.arange(len(key)) - np.repeat(first, np.diff([*first, len(key)]))
    keep = rank < most
    return key[keep][::-1], ids[keep][::-1]


def _unpack(column: pa.Array, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(b or b"", kind) for b in column.to_pylist()]


_PACKED = "pack long, shard int, hashes binary, held binary, ids binary, places binary"


def _pack(number: int, ids: list[int], digests: list[list[bytes]], shards: int, min_docs: int):
    """Rows of one pack: one for each shard, and one without a shard for the documents."""
    per_doc = np.fromiter(map(len, digests), np.int64, len(digests))
    pair = np.frombuffer(b"".join(itertools.chain.from_iterable(digests)), "<u8").reshape(-1, 2)
    h1, h2 = pair[:, 0], pair[:, 1]
    shard = (h2 >> _U(32)) % _U(shards)
    order = np.lexsort((h2, h1, shard))
    new = _starts(shard[order], h1[order], h2[order])
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    distinct = order[new]
    of, held = largest_ids(place, np.repeat(np.array(ids, np.int64), per_doc), min_docs)
    cuts = np.searchsorted(shard[distinct], np.arange(shards + 1, dtype=_U))
    for s in range(shards):
        a, b = int(cuts[s]), int(cuts[s + 1])
        if a < b:
            c, d = np.searchsorted(of, (a, b))
            here = distinct[a:b]
            yield number, s, np.concatenate([h1[here], h2[here]]).tobytes(), (of[c:d] - a).astype("<u4").tobytes(), held[c:d].tobytes(), None
    with_lines = per_doc > 0
    if with_lines.any():
        doc_ids = np.array(ids, np.int64)[with_lines]
        counts = per_doc[with_lines].astype("<i8").tobytes()
        yield number, None, counts, cuts.astype("<i8").tobytes(), doc_ids.tobytes(), place.astype("<u4").tobytes()


def packs(docs: DataFrame, id_col: str, text_col: str, shards: int, min_chars: int, min_docs: int) -> DataFrame:
    """The packed lines of all documents; see the module's text."""

    def run(batches):
        task, count = TaskContext.get().partitionId(), itertools.count()
        ids, digests, lines = [], [], 0

        def rows():
            out = list(_pack((task << 32) + next(count), ids, digests, shards, min_docs))
            arrays = [pa.array(list(c), t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), *[pa.binary()] * 4))]
            return pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in _PACKED.split(", ")]) if out else None

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), binary(batch, text_col)):
                found = text_keys(text, min_chars)
                ids.append(NO_ID if doc is None else doc)
                digests.append(found)
                lines += len(found)
            if lines >= PACK_LINES:
                if (made := rows()) is not None:
                    yield made
                ids, digests, lines = [], [], 0
        if lines and (made := rows()) is not None:
            yield made

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias(text_col)).mapInArrow(run, _PACKED)


# ---- index ----

_INDEX = "shard int, levels binary, bits binary, fingerprints binary, counts binary, last binary"


def build_index(packed: DataFrame, min_docs: int) -> DataFrame:
    """One row per shard: the perfect hash over its distinct hashes, and its arrays."""

    def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        pairs = [h.reshape(2, -1) for h in _unpack(table["hashes"], "<u8")]
        base = np.cumsum([0] + [p.shape[1] for p in pairs])[:-1]
        h1, h2 = np.concatenate(pairs, axis=1)
        order = np.lexsort((h2, h1))
        new = _starts(h1[order], h2[order])
        one_of = order[new]
        distinct1, distinct2 = h1[one_of], h2[one_of]
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        of = np.concatenate([number[b + k.astype(np.int64)] for b, k in zip(base, _unpack(table["held"], "<u4"))])
        of, ids = largest_ids(of, np.concatenate(_unpack(table["ids"], "<i8")), min_docs)
        perfect = PerfectHash.build(distinct1, distinct2)
        slot = perfect(distinct1, distinct2)
        fingerprints, counts, last = np.empty_like(distinct2), np.empty(len(slot), "<u2"), np.empty(len(slot), "<i8")
        fingerprints[slot] = distinct2
        counts[slot] = np.bincount(of, minlength=len(slot))
        last[slot[of]] = ids  # of each hash the largest id stands last
        row = [[key[0].as_py()], *([a.tobytes()] for a in (np.array(perfect.sizes, "<i8"), perfect.words, fingerprints, counts, last))]
        return pa.table([pa.array(row[0], pa.int32()), *(pa.array(r, pa.binary()) for r in row[1:])], names=[c.split()[0] for c in _INDEX.split(", ")])

    shards = packed.where("shard IS NOT NULL").select("shard", "hashes", "held", "ids")
    return shards.groupBy("shard").applyInArrow(build, _INDEX)


_ANSWER = "pack long, shard int, places binary, hashes binary, last binary"


def probe(packed: DataFrame, index: DataFrame, min_docs: int) -> DataFrame:
    """For each pack and shard: places and hashes of the lines that ``min_docs`` documents hold, and the largest id that does."""

    def look(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if right.num_rows:
            (levels,), (words,) = _unpack(right["levels"], "<i8"), _unpack(right["bits"], "<u8")
            (fingerprints,), (counts,), (last,) = (_unpack(right[c], k) for c, k in (("fingerprints", "<u8"), ("counts", "<u2"), ("last", "<i8")))
            perfect = PerfectHash(levels.tolist(), words)
            for pack, shard, hashes in zip(left["pack"].to_pylist(), left["shard"].to_pylist(), _unpack(left["hashes"], "<u8")):
                h1, h2 = hashes.reshape(2, -1)
                slot = perfect(h1, h2)
                shared = (slot >= 0) & (fingerprints[slot] == h2) & (counts[slot] >= min_docs)
                at = np.flatnonzero(shared)
                if len(at):
                    out.append((pack, shard, at.astype("<u4").tobytes(), np.concatenate([h1[at], h2[at]]).tobytes(), last[slot[at]].tobytes()))
        columns = list(zip(*out)) or [()] * 5
        kinds = (pa.int64(), pa.int32(), *[pa.binary()] * 3)
        return pa.table([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=[c.split()[0] for c in _ANSWER.split(", ")])

    asked = packed.where("shard IS NOT NULL").select("pack", "shard", "hashes")
    return asked.groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(look, _ANSWER)


def dropped_lines(packed: DataFrame, answers: DataFrame) -> DataFrame:
    """(id, hashes): what each document has to drop; the largest id that holds a line keeps it."""

    def spread(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, dropped = [], []
        if left.num_rows and right.num_rows:
            (counts,), (cuts,), (docs,), (places,) = (_unpack(left[c], k) for c, k in (("hashes", "<i8"), ("held", "<i8"), ("ids", "<i8"), ("places", "<u4")))
            hashes, last = np.zeros((int(cuts[-1]), 2), "<u8"), np.zeros(int(cuts[-1]), "<i8")
            shared = np.zeros(int(cuts[-1]), bool)
            answers = (right["shard"].to_pylist(), _unpack(right["places"], "<u4"), _unpack(right["hashes"], "<u8"), _unpack(right["last"], "<i8"))
            for shard, at, pair, keeper in zip(*answers):
                at = at.astype(np.int64) + cuts[shard]
                shared[at], hashes[at], last[at] = True, pair.reshape(2, -1).T, keeper
            doc = np.repeat(np.arange(len(docs)), counts)
            drop = shared[places] & (last[places] != docs[doc])
            doc, place = doc[drop], places[drop]
            first = np.flatnonzero(_starts(doc)) if len(doc) else np.zeros(0, np.int64)
            for a, b in zip(first, [*first[1:], len(doc)]):
                ids.append(int(docs[doc[a]]))
                dropped.append(hashes[place[a:b]].tobytes())
        return pa.table([pa.array(ids, pa.int64()), pa.array(dropped, pa.binary())], names=["id", "hashes"])

    listed = packed.where("shard IS NULL").select("pack", "hashes", "held", "ids", "places")
    return listed.groupBy("pack").cogroup(answers.groupBy("pack")).applyInArrow(spread, "id long, hashes binary")


def drop_shared_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """(id, n_lines, n_dropped, kept): every text without the lines that at least ``min_docs`` documents hold.

    Keys shorter than ``min_chars`` code points stay; so do the lines of the largest id that
    holds a key. ``kept`` is the rest, joined by newlines.
    """
    if not 1 <= min_docs < 1 << 16:
        raise ValueError("min_docs must be between 1 and 65535")
    shards = max(1, -(-text_bytes(docs, text_col) // shard_bytes))
    packed = save(packs(docs, id_col, text_col, shards, min_chars, min_docs), "line-packs")
    index = save(build_index(packed, min_docs), "line-index")
    answers = probe(packed, index, min_docs)
    found = save(dropped_lines(packed, answers).groupBy("id").agg(F.collect_list("hashes").alias("hashes")), "line-drops")

    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            n_lines, n_dropped, kept = [], [], []
            for text, hashes in zip(binary(batch, "text"), batch.column("hashes").to_pylist()):
                lines = (text or b"").split(b"\n")
                n_lines.append(len(lines))
                if hashes:
                    joined = b"".join(hashes)
                    gone = {joined[i : i + 16] for i in range(0, len(joined), 16)}
                    keys = (line_key(line, min_chars) for line in lines)
                    lines = [line for line, k in zip(lines, keys) if k is None or xxhash.xxh3_128_digest(k) not in gone]
                n_dropped.append(n_lines[-1] - len(lines))
                kept.append(b"\n".join(lines))
            text = pa.array(kept, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), text], names=["id", "n_lines", "n_dropped", "kept"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("_key", F.coalesce(F.col("id").cast("long"), F.lit(NO_ID)))
    # the hashes of a task's documents are few beside their texts, which then need no sort
    both = texts.join(found.select(F.col("id").alias("_key"), "hashes").hint("shuffle_hash"), "_key", "left").select("id", "text", "hashes")
    out = both.mapInArrow(cut, f"id {kind}, n_lines long, n_dropped long, kept binary")
    return out.select(F.col("id").alias(id_col), "n_lines", "n_dropped", F.col("kept").cast("string").alias("kept"))
