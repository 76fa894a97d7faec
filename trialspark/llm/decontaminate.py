"""Benchmark decontamination with a generalised suffix automaton over words.

The test items' words form one suffix automaton. A document's words are streamed
through it; the state gives the longest match that ends at each word. Where a whole
window (``window`` consecutive item words, or a shorter item as a whole) ends, its
words are hit. Hits of a document form spans; documents whose hits reach the coverage
limit are removed, spans in the others are cut out.

Only documents are scanned, without a shuffle. Items are dealt into shards of at most
``SHARD_WORDS`` words, each broadcast and matched in turn, so an automaton's size is
bounded; a longer item is cut into parts that overlap by window - 1 words.

Defined cases: null or empty texts have no words and are never contaminated; items
without words match nothing; repeated items count once by id, a null item id is hit
but not listed; repeated documents are judged row by row; no items: nothing is hit.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import alnum_words, binary, fresh, save, with_columns

WINDOW = 13
#: hits of at least one word in LIMIT contaminate a document
LIMIT = 20
FOUND = ("_n_words", "_spans", "_items")
SHARD_WORDS = 100_000
#: shards that documents pass before they are stored in between
CHAIN = 4
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")

SPANS = T.ArrayType(
    T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("longest", T.LongType())])
)


class SuffixAutomaton:
    """All substrings of several word sequences; ``ends`` gives the windows that end in a state."""

    def __init__(self, items: list[tuple[str | None, list[bytes], int]], window: int = WINDOW):
        """items: id, words, length of the windows of this item."""
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        self.windows: dict[int, dict[int, set]] = {}
        self._chains: dict[int, list[tuple[int, set]]] = {}
        coded = [(item, [self.ids.setdefault(w, len(self.ids)) for w in words], size) for item, words, size in items]
        for _, words, _ in coded:
            last = 0
            for w in words:
                last = self._extend(last, w)
        for item, words, size in coded:
            state = length = 0
            for i, w in enumerate(words):
                state, length = self.step(state, length, w)
                if length > size:
                    length = size
                while self.len[self.link[state]] >= length > 0:
                    state = self.link[state]
                if i + 1 >= size:
                    self.windows.setdefault(state, {}).setdefault(size, set()).add(item)
        self.shortest = min((size for _, words, size in coded if words), default=window)

    def _new(self, length: int, link: int, following: dict[int, int]) -> int:
        self.len.append(length)
        self.link.append(link)
        self.next.append(following)
        return len(self.len) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """A copy of q for the shorter strings that reach it over p."""
        copy = self._new(self.len[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _extend(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:  # another sequence had it already
            return q if self.len[q] == self.len[last] + 1 else self._split(last, w, q)
        new, p = self._new(self.len[last] + 1, 0, {}), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self._split(p, w, q)
        return new

    def step(self, state: int, length: int, w: int) -> tuple[int, int]:
        """The state and length of the longest match after one more word."""
        while state and w not in self.next[state]:
            state = self.link[state]
            length = self.len[state]
        to = self.next[state].get(w)
        return (to, length + 1) if to is not None else (0, 0)

    def ends(self, state: int) -> list[tuple[int, set]]:
        """Windows (length, item ids) that are suffixes of the state's longest string."""
        if state not in self._chains:
            found, s = [], state
            while s > 0:
                found += self.windows.get(s, {}).items()
                s = self.link[s]
            self._chains[state] = found
        return self._chains[state]

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int, int]], set]:
        """Hit spans (first word, last word, longest match), merged where they overlap, and the items."""
        get = self.ids.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).astype(np.int8), [0]))))
        hits: list[tuple[int, int, int]] = []
        items: set = set()
        for a, b in zip(edges[::2], edges[1::2]):
            if b - a < self.shortest:
                continue
            state = length = 0
            for i, w in enumerate(ids[a:b].tolist(), int(a)):
                state, length = self.step(state, length, w)
                if length >= self.shortest:
                    for size, of in self.ends(state):
                        if size <= length:
                            items |= of
                            hits.append((i - size + 1, i, length))
        return merged(hits), items


def merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    out: list[tuple[int, int, int]] = []
    for a, b, n in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]), max(n, out[-1][2]))
        else:
            out.append((a, b, n))
    return out


def item_shards(items: DataFrame, window: int, item_col: str, text_col: str) -> Iterator[list]:
    """Items in shards of bounded size, one at a time on the driver."""
    shard, size = [], 0
    rows = items.select(F.col(item_col).cast("string"), F.col(text_col).cast("binary")).toLocalIterator()
    for item, text in rows:
        words = alnum_words(bytes(text) if text is not None else None)
        step = SHARD_WORDS - window + 1
        for at in range(0, max(1, len(words) - window + 1), step):
            part = words[at : at + SHARD_WORDS]
            if shard and size + len(part) > SHARD_WORDS:
                yield shard
                shard, size = [], 0
            if part:
                shard.append((item, part, min(window, len(words))))
                size += len(part)
    if shard:
        yield shard


_BUILT: dict = {}


def _automaton(shared, window: int) -> SuffixAutomaton:
    """Built once in each Python worker."""
    if shared.id not in _BUILT:
        _BUILT.clear()
        _BUILT[shared.id] = SuffixAutomaton(shared.value, window)
    return _BUILT[shared.id]


class _Broadcast:
    """A broadcast value with an id to cache by."""

    def __init__(self, spark, value):
        self._value, self.id = spark.sparkContext.broadcast(value), uuid.uuid4().hex

    @property
    def value(self):
        return self._value.value


def find_overlaps(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", finish=None
) -> DataFrame:
    """The documents with three more columns: number of words, spans (hit words, with the longest match), and items.

    They are called ``FOUND``, with underscores where the documents have such columns.
    ``finish``: a function of such a batch, and the three names, that gives one with the
    documents' own columns; it is called in the same pass.
    """
    spark = docs.sparkSession
    names = n_words, spans_col, items_col = fresh(docs, *FOUND)
    kinds = (T.LongType(), SPANS, T.ArrayType(T.StringType()))
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, k) for n, k in zip(names, kinds))])
    kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("longest", pa.int64())]))
    out, ahead = docs, item_shards(items, window, item_col, item_text_col)
    shard, i = next(ahead, None), 0
    while True:
        after = next(ahead, None)
        shared, last = _Broadcast(spark, shard) if shard else None, finish if after is None else None

        def run(batches, shared=shared, last=last, again=i > 0):
            automaton = _automaton(shared, window) if shared else None
            for batch in batches:
                before, known = (batch.column(c).to_pylist() if again else [[]] * batch.num_rows for c in (spans_col, items_col))
                counts, spans, found = [], [], []
                for text, had, ids in zip(binary(batch, text_col), before, known):
                    words = alnum_words(text)
                    new, got = automaton.match(words) if automaton else ([], set())
                    counts.append(len(words))
                    if had or new:
                        new = merged([(s["first"], s["last"], s["longest"]) for s in had] + new)
                    spans.append([{"first": a, "last": b, "longest": n} for a, b, n in new])
                    found.append(sorted(set(ids) | {i for i in got if i is not None}))
                done = with_columns(
                    batch,
                    {n_words: pa.array(counts, pa.int64()), spans_col: pa.array(spans, kind), items_col: pa.array(found, pa.list_(pa.string()))},
                )
                yield last(done, names) if last else done

        out = out.mapInArrow(run, docs.schema if last else schema)
        if after is None:
            return out
        shard, i = after, i + 1
        if i % CHAIN == 0:  # automata of so many shards are in memory together, on the driver too
            out = save(out, "overlaps")


def n_hit() -> F.Column:
    return F.expr("aggregate(_spans, 0L, (n, s) -> n + s.last - s.first + 1)")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: words, hit words, items, and whether hits reach the coverage limit."""
    found = find_overlaps(docs.select(id_col, text_col), items, window, text_col)
    return found.select(
        id_col,
        F.col("_n_words").alias("n_words"),
        n_hit().alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "_items").cast("binary"), 256).alias("items_sha256"),
        (F.expr("size(_spans) > 0") & (LIMIT * n_hit() >= F.col("_n_words"))).alias("contaminated"),
        F.col("_spans").alias("spans"),
    )


def cut_spans(text: bytes, spans: list[dict]) -> bytes:
    """The text without the words of the spans; what stands between words of a span goes too."""
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for s in spans:
        out.append(text[at : places[s["first"]][0]])
        at = places[s["last"]][1]
    return b"".join([*out, text[at:]])


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, limit: int = LIMIT, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """Documents below the coverage limit, with hit spans cut out of their texts; the columns stay."""
    names = docs.columns

    def finish(batch: pa.RecordBatch, found: list[str]) -> pa.RecordBatch:
        texts, words = binary(batch, text_col), batch.column(found[0]).to_pylist()
        keep, new, changed = [], [], []
        for text, n, spans in zip(texts, words, batch.column(found[1]).to_pylist()):
            hit = sum(s["last"] - s["first"] + 1 for s in spans)
            keep.append(not (hit and hit * limit >= n))
            changed.append(bool(hit))
            new.append(cut_spans(text, spans).decode() if hit and keep[-1] else text.decode() if text is not None else None)
        columns = {text_col: pa.array(new, pa.string())}
        if chars_col in batch.schema.names:
            old = batch.column(chars_col).to_pylist()
            columns[chars_col] = pa.array([len(t) if c else o for t, c, o in zip(new, changed, old)])
        return with_columns(batch, columns).filter(pa.array(keep, pa.bool_())).select(names)

    return find_overlaps(docs, items, window, text_col, finish=finish)
