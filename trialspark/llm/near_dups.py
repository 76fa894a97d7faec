"""Near-duplicate documents by MinHash banding, verified on full shingle sets.

1. Every document becomes the hashed set of its word shingles. Documents with one set
   are one class, so copies cost one row from here on.
2. Minima of many universal hash functions, cut into bands, put classes into buckets.
   The number of bands follows from the threshold: a pair at the threshold is missed
   with a probability below ``MISS``.
3. Each bucket's classes are paired with its smallest class only. Pairs whose
   signatures are clearly too far apart are dropped, the others are compared on full sets.
4. Connected components of these links. Only buckets that still hold several
   components are compared in full, and only across components: in blocks of at most
   ``BLOCK`` classes, so that a bucket of any size is spread over many tasks. A block
   hands on the links that connect it, not its pairs.
5. Components over all links, then the smallest document id of each.

Links inside a component that is known already need no check, so the components are
those of all links although pairs are not listed.

A class is named by its smallest document id; rows that share an id are one document.

Defined cases: a text without words (null, empty) has the empty set and is linked with
nothing; rows with a null id get a component of their own (null) and are kept; repeated
rows are copies of each other; ties go to the smaller id.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary, fresh, save, space_words
from .components import components

SHINGLE = 3
THRESHOLD = (85, 100)
ROWS = 6
MISS = 1e-5
BLOCK = 1_000
MAX_BANDS = 64
#: word hashes that a task keeps
CACHE = 100_000
#: standard deviations that a signature's estimate may fall below the threshold
SLACK = 5.0
_PRIME = (1 << 61) - 1


def bands_for(threshold: tuple[int, int], rows: int = ROWS, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log(1 - (threshold[0] / threshold[1]) ** rows))


def _word_hashes(words: list[bytes], cache: dict[bytes, int]) -> np.ndarray:
    out = []
    for w in words:
        h = cache.get(w)
        if h is None:
            if len(cache) > CACHE:
                cache.clear()
            h = cache[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        out.append(h)
    return np.array(out, np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64's finisher)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None, size: int, cache: dict[bytes, int]) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; fewer words than ``size`` are one shingle."""
    words = space_words(text)
    if not words:
        return np.empty(0, np.uint64)
    h = _word_hashes(words, cache)
    n = max(1, len(h) - size + 1)
    out = np.full(n, np.uint64(min(size, len(h))))
    for k in range(min(size, len(h))):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(out)


def hash_family(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Fixed odd factors and offsets of n universal multiply-shift hash functions."""
    k = np.arange(1, n + 1, dtype=np.uint64)
    return _mix(k * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1), _mix(k + np.uint64(0xD1B54A32D192ED03))


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """16 mixed bits of each hash function's minimum over the set."""
    out = np.full(len(a), np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(shingles), 512):
        np.minimum(out, (shingles[at : at + 512, None] * a + b).min(axis=0), out=out)
    return (_mix(out) >> np.uint64(48)).astype(np.uint16)


def _digest(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def _kind(docs: DataFrame, id_col: str) -> str:
    return docs.schema[id_col].dataType.simpleString()


def signed(docs: DataFrame, id_col: str, text_col: str, size: int, n: int) -> DataFrame:
    """(id, digest of the shingle set, n_shingles, sig): signatures of ``n`` minima."""

    def run(batches):
        cache: dict[bytes, int] = {}
        a, b = hash_family(n)
        for batch in batches:
            texts = binary(batch, text_col)
            for at in range(0, len(texts), 500):
                sets = [shingle_set(t, size, cache) for t in texts[at : at + 500]]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(id_col).slice(at, len(sets)),
                        pa.array([_digest(s) for s in sets], pa.binary()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([signature(s, a, b).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    names=[id_col, "digest", "n_shingles", "sig"],
                )

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {_kind(docs, id_col)}, digest binary, n_shingles long, sig binary")


def _signatures(batch: pa.RecordBatch, name: str = "sig") -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(name).to_pylist()), np.uint16).reshape(batch.num_rows, -1)


def buckets(classes: DataFrame, rows: int, bands: int) -> DataFrame:
    """(band key, class): one row for each band of each class; the key's last bits are the band."""
    if bands > MAX_BANDS:
        raise ValueError(f"more than {MAX_BANDS} bands: take fewer rows a band")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = _signatures(batch).reshape(batch.num_rows, bands, rows).astype(np.uint64)
            key = np.tile(np.arange(bands, dtype=np.uint64), (batch.num_rows, 1))
            for r in range(rows):
                key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, r])
            key = (key & ~np.uint64(MAX_BANDS - 1)) | np.arange(bands, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.ravel().view(np.int64)), batch.column("rep").take(pa.array(np.repeat(np.arange(batch.num_rows), bands)))],
                names=["key", "rep"],
            )

    return classes.select("rep", "sig").mapInArrow(run, f"key long, rep {_kind(classes, 'rep')}")


def _near(x: np.ndarray, y: np.ndarray, threshold: tuple[int, int]) -> np.ndarray:
    """Whether signatures (rows) may belong to sets at the threshold."""
    t, n = threshold[0] / threshold[1], x.shape[-1]
    return (x == y).mean(axis=-1) >= t - SLACK * math.sqrt(t * (1 - t) / n)


def plausible(pairs: DataFrame, classes: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Pairs (u, v) whose signatures are near enough."""
    sig = classes.select("rep", "sig")
    both = pairs.join(sig.toDF("u", "su"), "u").join(sig.toDF("v", "sv"), "v")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.select(["u", "v"]).filter(pa.array(_near(_signatures(batch, "su"), _signatures(batch, "sv"), threshold)))

    kind = _kind(classes, "rep")
    return both.select("u", "v", "su", "sv").mapInArrow(run, f"u {kind}, v {kind}").distinct()


def sets_of(reps: DataFrame, docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, items): the full shingle sets of the classes in ``reps`` (one column)."""
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    held = texts.join(reps.toDF("_rep").distinct().hint("shuffle_hash"), F.col("_id") == F.col("_rep"), "left_semi")

    def sets(batches):
        cache: dict[bytes, int] = {}
        for batch in batches:
            found = [shingle_set(t, size, cache).tobytes() for t in binary(batch, "_text")]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(found, pa.binary())], names=["id", "items"])

    return save(held.mapInArrow(sets, f"id {_kind(docs, id_col)}, items binary"), "sets")


def _linked(x: bytes, y: bytes, threshold: tuple[int, int]) -> bool:
    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common > 0 and threshold[1] * common >= threshold[0] * (len(x) + len(y) - common)


def verified(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, size: int, threshold: tuple[int, int]) -> DataFrame:
    """Pairs that reach the threshold on full sets. Only texts of classes in a pair become sets."""
    known = sets_of(pairs.select("u").union(pairs.select("v")), docs, id_col, text_col, size)
    both = pairs.join(known.toDF("u", "iu"), "u").join(known.toDF("v", "iv"), "v")

    def compare(batches):
        for batch in batches:
            keep = [_linked(x, y, threshold) for x, y in zip(batch.column("iu").to_pylist(), batch.column("iv").to_pylist())]
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    kind = _kind(pairs, "u")
    return both.select("u", "v", "iu", "iv").mapInArrow(compare, f"u {kind}, v {kind}")


class Block:
    """Classes of one bucket, or of two blocks of a big one."""

    def __init__(self, rows: pa.Table, threshold: tuple[int, int], bands: int):
        self.threshold, self.bands = threshold, bands
        self.band = rows.column("key")[0].as_py() & (MAX_BANDS - 1)
        self.lo, self.hi = rows.column("lo")[0].as_py(), rows.column("hi")[0].as_py()
        self.block, self.ids = rows.column("block").to_numpy(), rows.column("rep").to_pylist()
        number: dict = {}
        self.root = np.array([number.setdefault(r, len(number)) for r in rows.column("root").to_pylist()])
        self.sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint16).reshape(len(self.ids), -1)

    def pairs(self):
        """(i, all j) of plausible pairs of different components; each pair in the first band it shares."""
        left, right = np.flatnonzero(self.block == self.lo), np.flatnonzero(self.block == self.hi)
        for i in left.tolist():
            some = right[(self.root[right] != self.root[i]) & ((right > i) | (self.lo != self.hi))]
            if len(some):
                same = self.sig[some] == self.sig[i]
                first = same.reshape(len(some), self.bands, -1).all(axis=2).argmax(axis=1)
                near = some[_near(self.sig[i], self.sig[some], self.threshold) & (first == self.band)]
                if len(near):
                    yield i, near.tolist()


def _in_blocks(df: DataFrame, fn, schema: str) -> DataFrame:
    """``fn`` on the rows of each (key, lo, hi), which come sorted; a batch's last group waits for its rest."""

    def run(batches):
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([held, rows]) if held is not None else rows
            if not rows.num_rows:
                continue
            mark = np.stack([rows.column(c).to_numpy() for c in ("key", "lo", "hi")])
            cuts = [0, *(np.flatnonzero((mark[:, 1:] != mark[:, :-1]).any(axis=0)) + 1).tolist()]
            for a, b in zip(cuts, cuts[1:]):
                yield from fn(rows.slice(a, b - a))
            held = rows.slice(cuts[-1])
        if held is not None and held.num_rows:
            yield from fn(held)

    by = ["key", "lo", "hi"]
    return df.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, schema)


def across(open_buckets: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, size: int, threshold: tuple[int, int], bands: int) -> DataFrame:
    """Links between different components that meet in a bucket; big buckets in pairs of blocks.

    ``open_buckets``: key, n (rows of the bucket), rep, root. First the classes that have
    a plausible pair are found by signature; their full sets then meet in the same
    blocks, and only links that connect what a block had not yet connected are handed on.
    """
    placed = open_buckets.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    # block b meets every block, as the lower or the higher one of the pair
    dealt = placed.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select(
        "key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "rep", "root"
    )
    kind = _kind(classes, "rep")
    place = f"key long, lo int, hi int, block int, rep {kind}, root {kind}"
    signatures = classes.select("rep", "sig")

    def plausible_rows(rows: pa.Table):
        wanted: set[int] = set()
        for i, near in Block(rows, threshold, bands).pairs():
            wanted.update(near, [i])
        if wanted:
            yield from rows.drop_columns(["sig"]).take(pa.array(sorted(wanted))).to_batches()

    names = ["key", "lo", "hi", "block", "rep", "root"]
    some = save(_in_blocks(dealt.join(signatures, "rep").select(*names, "sig"), plausible_rows, place), "open")
    sets = sets_of(some.select("rep"), docs, id_col, text_col, size).toDF("rep", "items").dropDuplicates(["rep"])

    def links(rows: pa.Table):
        block, items = Block(rows, threshold, bands), rows.column("items").to_pylist()
        parent = list(range(len(items)))

        def root(i):
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        u, v = [], []
        for i, near in block.pairs():
            for j in near:
                if root(i) != root(j) and _linked(items[i], items[j], threshold):
                    parent[root(j)] = root(i)
                    u.append(block.ids[i])
                    v.append(block.ids[j])
        if u:
            type_ = rows.schema.field("rep").type
            yield pa.RecordBatch.from_arrays([pa.array(u, type_), pa.array(v, type_)], names=["u", "v"])

    return _in_blocks(some.join(signatures, "rep").join(sets, "rep").select(*names, "sig", "items"), links, f"u {kind}, v {kind}")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, threshold: tuple[int, int] = THRESHOLD, rows: int = ROWS
) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row: components of pairs at or above the Jaccard threshold."""
    bands = bands_for(threshold, rows)
    members = save(signed(docs, id_col, text_col, size, rows * bands), "members")
    some = members.where(F.col("digest").isNotNull() & F.col(id_col).isNotNull())
    # one row a class: its smallest id, and the signature that all its rows share
    classes = save(some.groupBy("digest").agg(F.min(id_col).alias("rep"), F.first("sig").alias("sig")), "classes")
    keyed = buckets(classes, rows, bands)
    least = keyed.groupBy("key").agg(F.min("rep").alias("u"), F.count("*").alias("n")).where("n > 1")
    shared = save(keyed.join(least, "key"), "buckets")

    star = shared.where("rep != u").select("u", F.col("rep").alias("v")).distinct()
    stars = save(plausible(star, classes, threshold), "pairs")
    links = save(verified(stars, docs, id_col, text_col, size, threshold), "links")
    roots = components(links)

    wide = shared.where("n > 2").join(roots, F.col("rep") == F.col("node"), "left").select("key", "n", "rep", F.coalesce("root", "rep").alias("root"))
    # stored, so that Spark knows its size: few keys are sent to the rows, which then stay spread however many share a key
    mixed = save(wide.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a != b").select("key"), "mixed")
    rest = save(across(wide.join(mixed, "key", "left_semi"), classes, docs, id_col, text_col, size, threshold, bands), "links")
    if not rest.isEmpty():
        roots = components(links.union(rest))

    joined = classes.select("digest", "rep").join(roots, F.col("rep") == F.col("node"), "left")
    named = joined.select(F.col("digest").alias("_digest"), F.coalesce("root", "rep").alias("_root"))
    out = members.drop("sig").join(named, F.col("digest") == F.col("_digest"), "left")
    # nodes are the smallest ids of classes, so a root is the smallest id of its component
    component = F.when(F.col(id_col).isNotNull(), F.coalesce("_root", id_col)).alias("component_id")
    return out.select(id_col, "n_shingles", component).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """The documents whose id is the smallest of their group, with their columns.

    Rows with a null id stay, and so do repeated rows of a kept id: they are the same document.
    """
    found = near_duplicates(docs, id_col, text_col, size, threshold)
    (name,) = fresh(docs, "_dropped")
    dropped = found.where("NOT kept").select(F.col(id_col).alias(name)).distinct()
    return docs.join(dropped, F.col(id_col) == F.col(name), "left_anti")
