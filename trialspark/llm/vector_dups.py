"""Near-duplicate vectors by robust-pruned flat graphs on overlapping cluster shards.

1. Equal vectors are one class with a count, so copies cost one row from here on. Vectors of
   each length are searched by themselves.
2. A bounded sample gives cluster centroids, more of them as the classes grow. A class is at
   home in the shard of its nearest centroid, overlaps into the next, and is searched for in
   the ``probes`` nearest. Shards of more than ``SHARD`` classes are split by hash into parts
   that are all searched, so no task holds more than a part and the queries sent to it.
3. In each part, nearest neighbours and some random members are robust-pruned to a
   graph. The adjacency lists of all parts are united by vector and pruned again to ``UNITED``.
4. Each part's queries run a greedy search from the part's medoids (and from themselves
   where they are members), which goes on as long as it finds vectors in range; a step
   expands all vectors found, so dense clusters take few steps. Every link is a cosine in
   double precision at or above the threshold.
5. A link counts in the part where its other end is at home, so none counts twice; where the
   other end is not sent to the query's home, it is counted for both. A part hands on one
   edge for each vector it connects, not all pairs; components follow by large-star and
   small-star.
6. The audit compares a bounded sample of queries with all rows. Below ``RECALL`` the
   search is repeated with twice the probes; if it is below with all shards searched, the
   parts are compared in full.

Defined cases: null or zero vectors, and those with null or non-finite components, link
with nothing; repeated rows are copies and link with each other; null ids have no component
and no links; ties go to the smaller id; only the id and the vector of the input are read.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save
from .components import components

THRESHOLD = 0.95
SHARD = 1_500
#: the index is fitted on so many vectors at most, those with the smallest hashes of their ids
SAMPLE = 20_000
MAX_CENTROIDS = 4_096
PROBES = 3
NEAR, FAR, DEGREE, UNITED = 32, 8, 16, 24
#: pairs whose cosines are worked out at once
PAIRS = 100_000
ALPHA = 1.2
BEAM = 16
QUERIES = 256
AUDIT = 400
RECALL = 0.9


def _numbers(column) -> list[np.ndarray | None]:
    return [np.array(v, np.float64) if v is not None and None not in v else None for v in column.to_pylist()]


def unit(vectors: list[np.ndarray]) -> np.ndarray:
    x = np.stack(vectors)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # before squaring, so that nothing overflows
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def digested(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, digest, dim): equal usable vectors have one digest; null for the others."""

    def run(batches):
        for batch in batches:
            found = _numbers(batch.column(vec_col))
            good = [v is not None and len(v) > 0 and bool(np.isfinite(v).all()) and bool(v.any()) for v in found]
            digests = [hashlib.blake2b((v + 0.0).tobytes(), digest_size=16).digest() if g else None for v, g in zip(found, good)]
            sizes = [len(v) if g else None for v, g in zip(found, good)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), batch.column(vec_col)], names=[id_col, "digest", "dim", "vec"]
            )

    fields = {f.name: f.dataType.simpleString() for f in vectors.schema}
    return vectors.select(id_col, vec_col).mapInArrow(run, f"`{id_col}` {fields[id_col]}, digest binary, dim int, vec {fields[vec_col]}")


def centroids(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from a fixed start."""
    rng = np.random.default_rng(11)
    c = sample[rng.choice(len(sample), k, replace=False)]
    for _ in range(rounds):
        near = np.argmax(sample @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), c)
    return c


def robust_prune(x: np.ndarray, candidates: np.ndarray, degree: int, alpha: float = ALPHA, rows: np.ndarray | None = None) -> np.ndarray:
    """For each row of x, or each of ``rows``, the kept candidates (indices, nearest first; the own index fills up)."""
    rows = np.arange(len(x)) if rows is None else rows
    m = len(rows)
    distance = 1 - np.einsum("md,mcd->mc", x[rows], x[candidates])
    order = np.argsort(distance, axis=1, kind="stable")
    candidates, distance = np.take_along_axis(candidates, order, 1), np.take_along_axis(distance, order, 1)
    own = np.arange(m)
    alive = candidates != rows[:, None]
    kept = np.tile(rows[:, None], (1, degree))
    for r in range(degree):
        first = alive.argmax(axis=1)
        has = alive[own, first]
        if not has.any():
            break
        star = candidates[own, first]
        kept[has, r] = star[has]
        between = 1 - np.einsum("md,mcd->mc", x[star], x[candidates])
        alive &= (alpha * between > distance) & (candidates != star[:, None])
        alive[~has] = False
    return kept


def build(x: np.ndarray, seed: int) -> np.ndarray:
    """Adjacency (rows of indices) of a part: pruned near neighbours, and a few far ones to hold it together."""
    m = len(x)
    if m == 1:
        return np.zeros((1, 1), np.int64)
    near = np.empty((m, min(NEAR, m - 1)), np.int64)
    for a in range(0, m, 512):
        s = x[a : a + 512] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -2
        near[a : a + 512] = np.argpartition(-s, near.shape[1] - 1, axis=1)[:, : near.shape[1]]
    far = np.random.default_rng(seed).integers(0, m, (m, FAR))
    return np.hstack([robust_prune(x, near, min(DEGREE, near.shape[1])), robust_prune(x, far, FAR // 2)])


def united(x: np.ndarray, u: np.ndarray, v: np.ndarray, degree: int = UNITED) -> np.ndarray:
    """Lists of ``degree`` members from edges (u, v); longer ones are pruned, from their nearest and farthest members."""
    m = len(x)
    distance = np.concatenate([1 - np.einsum("ed,ed->e", x[u[a : a + PAIRS]], x[v[a : a + PAIRS]]) for a in range(0, len(u), PAIRS)]) if len(u) else np.zeros(0)
    order = np.lexsort((distance, u))
    u, v = u[order], v[order]
    size = np.bincount(u, minlength=m)
    first = np.cumsum(size) - size
    most = 3 * degree
    rank = np.arange(len(u)) - np.repeat(first, size)
    left = np.repeat(size, size) - 1 - rank  # how many farther ones follow
    keep = (rank < 2 * degree) | (left < degree)
    u, v = u[keep], v[keep]
    size = np.bincount(u, minlength=m)
    at = np.arange(len(u)) - np.repeat(np.cumsum(size) - size, size)
    lists = np.tile(np.arange(m)[:, None], (1, max(1, min(most, int(size.max(initial=1))))))
    lists[u, at] = v
    out = np.tile(np.arange(m)[:, None], (1, min(degree, lists.shape[1])))
    short = size <= out.shape[1]
    out[short] = lists[short, : out.shape[1]]
    long = np.flatnonzero(~short)
    for a in range(0, len(long), QUERIES):
        rows = long[a : a + QUERIES]
        out[rows] = robust_prune(x, lists[rows], degree, rows=rows)
    return out


def search(x: np.ndarray, links: np.ndarray, queries: np.ndarray, entries: list[int], own: np.ndarray, least: float, beam: int = BEAM) -> np.ndarray:
    """Range-expanding greedy search: whether each (query, member) was found in range.

    ``own``: a query's index among the members, or -1. A step expands all known members that
    are in range, or among the ``beam`` best known, and were not expanded before.
    """
    q, m = len(queries), len(x)
    known, done = np.full((q, m), -np.inf), np.zeros((q, m), bool)
    known[:, entries] = queries @ x[entries].T
    mine = np.flatnonzero(own >= 0)
    known[mine, own[mine]] = np.einsum("qd,qd->q", queries[mine], x[own[mine]])
    active = np.arange(q)
    while len(active):
        s = known[active]
        bar = np.minimum(np.partition(s, m - beam, axis=1)[:, m - beam], least) if m > beam else np.full(len(active), -np.inf)
        row, node = np.nonzero((s >= bar[:, None]) & np.isfinite(s) & ~done[active])
        active = active[np.unique(row)] if len(row) else active[:0]
        if not len(active):
            break
        asked = np.unique(row, return_inverse=True)[1]
        done[active[asked], node] = True
        pairs = (active[asked][:, None] * m + links[node]).ravel()
        pairs = pairs[np.isneginf(known.ravel()[pairs])]
        pairs = np.unique(pairs)
        for a in range(0, len(pairs), PAIRS):
            i, k = np.divmod(pairs[a : a + PAIRS], m)
            known[i, k] = np.einsum("pd,pd->p", queries[i], x[k])
    return known >= least


def joined(hit: np.ndarray, rows: np.ndarray, members: np.ndarray) -> list[tuple[int, int]]:
    """Few pairs (row, row) that connect what the hits (query, member) connect."""
    label_q, label_m = np.array(rows), np.array(members)
    top = np.iinfo(np.int64).max
    some_q, some_m = hit.any(axis=1), hit.any(axis=0)
    hit = hit[some_q][:, some_m]
    rows, members, label_q, label_m = rows[some_q], members[some_m], label_q[some_q], label_m[some_m]
    while hit.size:
        new_q = np.minimum(label_q, np.where(hit, label_m, top).min(axis=1))
        new_m = np.minimum(label_m, np.where(hit, new_q[:, None], top).min(axis=0))
        if (new_q == label_q).all() and (new_m == label_m).all():
            break
        label_q, label_m = new_q, new_m
    return [*zip(rows.tolist(), label_q.tolist()), *zip(members.tolist(), label_m.tolist())]


class Router:
    """Nearest shards of a vector, and the parts of each shard."""

    def __init__(self, centres: np.ndarray, parts: np.ndarray | None = None):
        self.centres, self.parts = centres, parts

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        return np.argsort(-(x @ self.centres.T), axis=1, kind="stable")[:, :n]


def routed(classes: DataFrame, router, probes: int) -> DataFrame:
    """(shard, part, role, id, n, vec); role 0: at home, 1: overlapping member, 2: query only."""
    kind, vec = classes.schema["rep"].dataType.simpleString(), classes.schema["vec"].dataType.simpleString()

    def run(batches):
        route = router.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(_numbers(batch.column("vec")))
            near = route.nearest(x, max(2, probes))
            lane = batch.column("lane").to_numpy()
            source, shard, part, role = [], [], [], []
            for i, shards in enumerate(near.tolist()):
                for rank, s in enumerate(shards):
                    parts = int(route.parts[s])
                    for p in range(parts):
                        member = rank < 2 and lane[i] % parts == p
                        if member or rank < probes:
                            source.append(i)
                            shard.append(s)
                            part.append(p)
                            role.append(rank if member else 2)
            rows = batch.select(["rep", "n", "vec"]).take(pa.array(source, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard, pa.int32()), pa.array(part, pa.int32()), pa.array(role, pa.int32()), *rows.columns], names=["shard", "part", "role", "rep", "n", "vec"]
            )

    return classes.select("rep", "n", "vec", "lane").mapInArrow(run, f"shard int, part int, role int, rep {kind}, n long, vec {vec}")


def adjacency(rows: DataFrame) -> DataFrame:
    """(u, v): the graph edges of all parts, in both directions."""
    kind = rows.schema["rep"].dataType.simpleString()

    def run(group: pa.Table) -> pa.Table:
        ids = group.column("rep").combine_chunks()
        links = build(unit(_numbers(group.column("vec"))), group.num_rows)
        u = np.repeat(np.arange(len(links)), links.shape[1])
        v = links.ravel()
        some = u != v
        u, v = pa.array(u[some]), pa.array(v[some])
        return pa.table({"u": pa.concat_arrays([ids.take(u), ids.take(v)]), "v": pa.concat_arrays([ids.take(v), ids.take(u)])})

    return rows.where("role < 2").select("shard", "part", "rep", "vec").groupBy("shard", "part").applyInArrow(run, f"u {kind}, v {kind}").distinct()


def found_links(rows: DataFrame, edges: DataFrame, threshold: float, router, probes: int, full: bool = False) -> DataFrame:
    """(id, n, root): links of each query to vectors at home in a part, and the smallest vector it meets there.

    ``full`` compares a part's queries with all its members instead of searching.
    """
    kind = rows.schema["rep"].dataType.simpleString()
    members = rows.where("role < 2").select("shard", "part", "rep")
    # united lists, as far as both ends are members of the part
    local = edges.join(members.toDF("s", "p", "u"), "u").join(members.toDF("s2", "p2", "v"), "v").where("s = s2 AND p = p2").select("s", "p", "u", "v").toDF("s", "p", "u", "v")

    def run(group: pa.Table, links: pa.Table) -> pa.Table:
        ids, role, n = group.column("rep").to_pylist(), group.column("role").to_numpy(), group.column("n").to_numpy()
        x = unit(_numbers(group.column("vec")))
        inside = np.flatnonzero(role < 2)
        if not len(inside):
            return pa.table({"id": pa.array([], group.column("rep").type), "n": pa.array([], pa.int64()), "root": pa.array([], group.column("rep").type)})
        members, home, count = x[inside], role[inside] == 0, n[inside]
        at = {ids[i]: k for k, i in enumerate(inside.tolist())}
        u = np.array([at[i] for i in links.column("u").to_pylist()], np.int64)
        v = np.array([at[i] for i in links.column("v").to_pylist()], np.int64)
        lists = united(members, u, v)
        # the member nearest to the mean, and the one farthest from that
        middle = int(np.argmax(members @ members.mean(axis=0)))
        entries = sorted({middle, int(np.argmin(members @ members[middle]))})
        own = np.full(len(ids), -1)
        own[inside] = np.arange(len(inside))
        shards = np.concatenate([router.value.nearest(x[a : a + 4 * QUERIES], max(2, probes)) for a in range(0, len(x), 4 * QUERIES)])
        sums, parent = np.zeros(len(ids), np.int64), list(range(len(ids)))

        def root(i):
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for a in range(0, len(ids), QUERIES):
            some = slice(a, min(a + QUERIES, len(ids)))
            hit = x[some] @ members.T >= threshold if full else search(members, lists, x[some], entries, own[some], threshold)
            mine = np.flatnonzero(own[some] >= 0)
            hit[mine, own[some][mine]] = False
            sums[some] += hit @ np.where(home, count, 0)
            # ends that are not sent to the query's home do not meet it there
            i, k = np.nonzero(hit & home)
            alone = ~(shards[inside[k]] == shards[a + i][:, :1]).any(axis=1)
            np.add.at(sums, inside[k[alone]], n[a + i[alone]])
            for one, two in joined(hit, np.arange(some.start, some.stop), inside):
                one, two = root(one), root(two)
                if one != two:
                    if ids[two] < ids[one]:
                        one, two = two, one
                    parent[two] = one
        some = [i for i in range(len(ids)) if sums[i] or root(i) != i]
        return pa.table(
            {
                "id": pa.array([ids[i] for i in some], group.column("rep").type),
                "n": pa.array(sums[some], pa.int64()),
                "root": pa.array([ids[root(i)] for i in some], group.column("rep").type),
            }
        )

    return rows.groupBy("shard", "part").cogroup(local.groupBy("s", "p")).applyInArrow(run, f"id {kind}, n long, root {kind}")


def audit(classes: DataFrame, found: DataFrame, threshold: float) -> tuple[int, int]:
    """(links found, links there are) of up to AUDIT queries, against every class in blocks."""
    queries = classes.orderBy(F.xxhash64("rep", F.lit(5)), "rep").limit(AUDIT).select("rep", "n", "vec").collect()
    if not queries:
        return 0, 0
    ids = [q["rep"] for q in queries]
    shared = classes.sparkSession.sparkContext.broadcast((ids, unit([np.array(q["vec"], np.float64) for q in queries])))

    def run(batches):
        names, x = shared.value
        total = 0
        for batch in batches:
            if batch.num_rows:
                near = unit(_numbers(batch.column("vec"))) @ x.T >= threshold
                same = np.array([[r == q for q in names] for r in batch.column("rep").to_pylist()])
                total += int((near & ~same).sum(axis=1) @ batch.column("n").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], names=["total"])

    there = classes.select("rep", "n", "vec").mapInArrow(run, "total long").agg(F.sum("total")).first()[0]
    got = found.where(F.col("id").isin(ids)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return int(got), int(there)


def linked(classes: DataFrame, threshold: float) -> DataFrame:
    """(id, n, root) of the classes (rep, n, vec, lane) of one length, by parts; complete as far as the audit tells."""
    spark = classes.sparkSession
    total = classes.count()
    sample = classes.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("vec").collect()
    sample = unit([np.array(r["vec"], np.float64) for r in sample])
    k = max(1, min(MAX_CENTROIDS, math.ceil(total / SHARD), len(sample)))
    centres = centroids(sample, k)
    shared = spark.sparkContext.broadcast(Router(centres))

    def home(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(shared.value.nearest(unit(_numbers(batch.column("vec"))), 1)[:, 0], pa.int32())], names=["shard"])

    sizes = classes.select("vec").mapInArrow(home, "shard int").groupBy("shard").count().collect()  # MAX_CENTROIDS rows at most
    parts = np.ones(k, np.int64)
    for r in sizes:
        parts[r["shard"]] = max(1, math.ceil(r["count"] / SHARD))
    router = spark.sparkContext.broadcast(Router(centres, parts))
    probes = min(PROBES, k)
    while True:
        sent = save(routed(classes, router, probes), "routed")
        graph = save(adjacency(sent), "graph")
        found = save(found_links(sent, graph, threshold, router, probes), "found")
        got, there = audit(classes, found, threshold)
        if got >= RECALL * there:
            return found
        if probes >= k:
            return save(found_links(sent, graph, threshold, router, probes, full=True), "found")
        probes = min(2 * probes, k)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """(id, n_links, component_id, kept) for every row."""
    rows = save(digested(vectors, id_col, vec_col), "vectors")
    usable = rows.where(F.col("dim").isNotNull() & F.col(id_col).isNotNull())
    grouped = usable.groupBy("digest").agg(F.min(id_col).alias("rep"), F.count("*").alias("n"))
    vecs = usable.select(F.col(id_col).alias("_id"), F.col("digest").alias("_digest"), "vec", "dim").dropDuplicates(["_id", "_digest"])
    with_vec = grouped.join(vecs, (F.col("rep") == F.col("_id")) & (F.col("digest") == F.col("_digest")))
    classes = save(with_vec.select("digest", "rep", "n", "vec", "dim", F.pmod(F.xxhash64("rep"), F.lit(1 << 30)).alias("lane")), "classes")
    found = [linked(classes.where(F.col("dim") == r["dim"]), threshold) for r in classes.select("dim").distinct().orderBy("dim").collect()]
    out = rows.drop("vec")
    if not found:
        out = out.withColumn("_links", F.lit(0)).withColumn("_root", F.col(id_col))
    else:
        found = reduce(DataFrame.union, found)
        counts = found.groupBy(F.col("id").alias("_rep")).agg(F.sum("n").alias("_links"))
        roots = components(found.select(F.col("id").alias("u"), F.col("root").alias("v"))).toDF("_node", "_root")
        named = classes.select(F.col("digest").alias("_d"), "rep", "n").join(counts, F.col("rep") == F.col("_rep"), "left").join(roots, F.col("rep") == F.col("_node"), "left")
        named = named.select("_d", (F.coalesce("_links", F.lit(0)) + F.col("n") - 1).alias("_links"), F.coalesce("_root", "rep").alias("_root"))
        out = out.withColumn("_key", F.when(F.col(id_col).isNotNull(), F.col("digest"))).join(named, F.col("_key") == F.col("_d"), "left")
    return out.select(
        id_col,
        F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("_root", id_col).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
