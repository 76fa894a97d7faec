"""Language-model scoring by prediction by partial matching over the byte stream of each text.

Model. A text's bytes (A-Z in lower case) and its end are predicted from the ``ORDER`` bytes before
them, blanks and the word before included; before its first byte stand start marks. The trie
holds all contexts seen in training. Where a context lacks the byte, the model escapes to
the context without its oldest byte. Method D: of n occurrences of a byte among T, n - 1/2
count for it and 1/2 for the escape. Bytes of a longer context are excluded from a shorter
one. After the empty context all bytes not seen are equally likely.

Work. A byte's code length depends on its gram alone, the context and the byte:

1. Tasks cut their documents into packs of ``PACK_BYTES`` and list each pack's distinct grams
   and words with training counts, beside the texts. Grams are sorted from the nearest
   context byte on, so that their differences are small, and stored in shards by the three
   nearest bytes, compressed.
2. Counts of grams of up to two context bytes are added up: 2^24 at most, broadcast.
3. A shard adds up the counts of its grams, which hold whole branches of the trie, and
   gives every pack its grams back with their code lengths. The same for words.
4. Each pack adds up its texts position by position.

All counts cover every training document; nothing is pruned. Nothing but the grams of two
context bytes is gathered; what moves is packed, a few bytes a gram. The base score is the
smoothed unigram over words. Code lengths move in single precision, sums are double.

Defined cases: a null text is empty: its only token is the end; repeated rows count each;
a null id hashes as the empty text; without training rows every byte is equally likely; only
the id and the text of the input are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, save, text_bytes

ORDER = 6
PACK_BYTES = 14_000_000
SHARD_BYTES = 16_000_000
#: bytes of texts whose codes are held at once
PART_BYTES = 400_000
#: grams of parts are added up when they are so many
HELD_GRAMS = 2_000_000
#: bytes that never occur in UTF-8 mark the start and the end
_START, _END = 0xFE, 0xFF
_SYMBOLS = 254
LOW = 2


# ---- numbers in few bytes ----


def squeeze(data: bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def unsqueeze(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def squeezed(numbers: np.ndarray, rising: bool = False) -> bytes:
    """Whole numbers as compressed byte planes; rising ones as differences."""
    steps = np.diff(numbers, prepend=0) if rising else numbers
    planes = steps.astype("<i8").view(np.uint8).reshape(-1, 8).T
    return squeeze(planes.tobytes())


def squeezed_floats(values: np.ndarray) -> bytes:
    """Single-precision numbers as compressed byte planes: many grams have the same code length."""
    return squeeze(values.astype("<f4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unsqueezed_floats(data: bytes) -> np.ndarray:
    planes = np.frombuffer(unsqueeze(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<f4").ravel()


def unsqueezed(data: bytes, rising: bool = False) -> np.ndarray:
    planes = np.frombuffer(unsqueeze(data), np.uint8).reshape(8, -1)
    numbers = np.ascontiguousarray(planes.T).view("<i8").ravel()
    return np.cumsum(numbers) if rising else numbers


# ---- grams ----


def parts(texts: list[bytes]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text) + 1
        if size >= PART_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def stream_codes(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the grams of all texts in order, and how many each text has.

    A code has the nearest context byte first, the oldest next to last, and the byte last.
    """
    pad, end = bytes([_START]) * order, bytes([_END])
    data = np.frombuffer(b"".join([pad + t + end for t in texts]), np.uint8).astype(np.int64)
    out = data.copy()
    for k in range(1, order + 1):
        out[k:] += data[:-k] << (8 * (order - k + 1))
    size = np.array([len(t) + 1 for t in texts])
    starts = np.cumsum(size + order) - size - order
    keep = np.ones(len(data), bool)
    keep[(starts[:, None] + np.arange(order)).ravel()] = False
    return out[keep], size


def shorter(codes: np.ndarray, by: int) -> np.ndarray:
    """The grams without their ``by`` oldest context bytes."""
    return (codes >> (8 * (by + 1))) << 8 | (codes & 0xFF)


def summed(grams: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams, sorted, and their summed counts."""
    order = np.argsort(grams)
    grams, n = grams[order], n[order]
    new = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, np.int64)
    return grams[new], np.add.reduceat(n, new) if len(grams) else n


def pack_grams(texts: list[bytes], held: list[bool], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of the texts with their counts in those that are not held out."""
    held_n, some = 0, []
    for out in (False, True):
        for part in parts([t for t, h in zip(texts, held) if h == out]):
            grams, n = np.unique(stream_codes(part, order)[0], return_counts=True)
            some.append((grams, n.astype(np.int32) * (not out)))  # a pack holds fewer than 2^31 bytes
            held_n += len(grams)
            if held_n > HELD_GRAMS:
                some = [added_up(some)]
                held_n = len(some[0][0]) // 2  # what has been added up once weighs half, so that sums stay few
    return added_up(some)


def added_up(some: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The parts' distinct grams and summed counts; the parts are let go before they are sorted."""
    grams, n = np.concatenate([g for g, _ in some]), np.concatenate([c for _, c in some])
    some.clear()
    order = np.argsort(grams)
    grams = grams[order]
    n = n[order]
    del order
    new = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    return grams[new], np.add.reduceat(n, new, dtype=np.int32)


def gram_shard(grams: np.ndarray, order: int, shards: int) -> np.ndarray:
    """Shard of each gram, by its three nearest context bytes."""
    key = (grams >> (8 * (order - 2))).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((key >> np.uint64(33)) % np.uint64(shards)).astype(np.int64)


def pack_words(texts: list[bytes], held: list[bool]) -> Counter:
    """Words of the texts with their counts in those that are not held out."""
    words: Counter = Counter()
    for some in parts([t for t, h in zip(texts, held) if not h]):
        words.update(b" ".join(some).split())
    for some in parts([t for t, h in zip(texts, held) if h]):
        for word in set(b" ".join(some).split()):
            words.setdefault(word, 0)
    return words


def word_shards(words: list[bytes], shards: int) -> list[list[bytes]]:
    """Sorted words of each shard."""
    out = [[] for _ in range(shards)]
    for word in sorted(words):
        out[xxhash.xxh3_64_intdigest(word) % shards].append(word)
    return out


# ---- step 1 ----


def packs(docs: DataFrame, id_col: str, text_col: str, held_out: Column, order: int, shards: int) -> DataFrame:
    """Rows of grams and of words of a pack and shard, of grams of ``LOW`` context bytes of a pack, and of documents."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"pack long, kind string, shard int, keys binary, n binary, _ids array<{kind}>, _held array<boolean>"
    names = ["pack", "kind", "shard", "keys", "n", "_ids", "_held"]
    size_of = text_bytes(docs, text_col)
    source = docs.select(F.col(id_col).alias("_id"), held_out.alias("held_out"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    # small partitions would each list the common grams again
    source = source.coalesce(max(1, -(-size_of // PACK_BYTES)))

    def run(batches):
        pack, ids, held, texts, size = TaskContext.get().partitionId() << 32, [], [], [], 0
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.binary(), None, pa.list_(pa.bool_())]

        def row(kind, **columns):
            columns |= {"pack": pack, "kind": kind}
            return pa.RecordBatch.from_arrays([pa.array([columns.get(c)], t) for c, t in zip(names, kinds)], names=names)

        def flush():
            grams, n = pack_grams(texts, held, order)
            low, low_n = summed(shorter(grams[n > 0], order - LOW), n[n > 0])
            yield row("low", keys=squeezed(low, True), n=squeezed(low_n))
            shard = gram_shard(grams, order, shards)
            by_shard = np.argsort(shard, kind="stable")
            ends = np.searchsorted(shard[by_shard], np.arange(shards + 1))
            for s, (a, b) in enumerate(zip(ends, ends[1:])):
                if a < b:
                    at = by_shard[a:b]
                    yield row("gram", shard=s, keys=squeezed(grams[at], True), n=squeezed(n[at]))
            count = pack_words(texts, held)
            for s, words in enumerate(word_shards(list(count), shards)):
                if words:
                    yield row("word", shard=s, keys=squeeze(b" ".join(words)), n=squeezed(np.array([count[w] for w in words], np.int64)))
            for a in range(0, len(texts), 1_000):
                some = slice(a, a + 1_000)
                yield row("text", keys=squeeze(b"".join(texts[some]), 6), n=squeezed(np.array([len(t) for t in texts[some]], np.int64)), _ids=ids[some], _held=held[some])

        for batch in batches:
            kinds[5] = pa.list_(batch.column("_id").type)
            for i, out, text in zip(batch.column("_id").to_pylist(), batch.column("held_out").to_pylist(), batch.column("text").to_pylist()):
                ids.append(i)
                held.append(bool(out))
                texts.append(text.translate(LOWER))
                size += len(text) + 1
                if size >= PACK_BYTES:
                    yield from flush()
                    pack, ids, held, texts, size = pack + 1, [], [], [], 0
        if texts:
            yield from flush()

    return source.mapInArrow(run, schema)


# ---- the model ----


class Level:
    """Counts of grams of one order: n of a gram, and total and distinct bytes of a context."""

    def __init__(self, grams: np.ndarray, n: np.ndarray):
        self.grams, self.n = summed(grams, n)
        self.contexts, self.of = np.unique(self.grams >> 8, return_inverse=True)
        self.total = np.bincount(self.of, self.n, len(self.contexts))
        self.distinct = np.bincount(self.of, minlength=len(self.contexts)).astype(float)
        self.below = np.zeros(len(self.contexts))

    @staticmethod
    def _find(sorted_: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(sorted_):
            return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
        at = np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)
        return at, sorted_[at] == values

    def gram(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._find(self.grams, g)

    def context(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._find(self.contexts, c)

    def stand_on(self, lower: Level) -> None:
        """What a context's bytes weigh in the context below: that much is excluded there."""
        if len(self.grams):
            at, _ = lower.gram(shorter(self.grams, 1))
            self.below = np.bincount(self.of, lower.n[at], len(self.contexts))


def low_levels(grams: np.ndarray, n: np.ndarray) -> list[Level]:
    """The levels of up to ``LOW`` context bytes, from the grams of ``LOW``."""
    levels = [Level(shorter(grams, LOW - k) if k < LOW else grams, n) for k in range(LOW + 1)]
    for lower, upper in zip(levels, levels[1:]):
        upper.stand_on(lower)
    return levels


def log_probabilities(g: np.ndarray, n: np.ndarray, low: list[Level], order: int) -> np.ndarray:
    """log10 of each gram's probability. ``g``, sorted, holds whole branches: all grams of its three nearest bytes."""
    trained = n > 0
    levels = [*low, *(Level(shorter(g[trained], order - k) if k < order else g[trained], n[trained]) for k in range(LOW + 1, order + 1))]
    for k in range(LOW + 1, order + 1):
        levels[k].stand_on(levels[k - 1])
    out = np.zeros(len(g))
    todo = np.arange(len(g))  # grams not coded yet
    upper, escaped = np.zeros(len(g), np.int64), np.zeros(len(g), bool)
    for k in range(order, -1, -1):
        level = levels[k]
        if not len(level.grams) or not len(todo):
            continue
        code = shorter(g[todo], order - k) if k < order else g[todo]
        of, known = level.context(code >> 8)
        at, hit = level.gram(code)
        total, distinct = level.total[of], level.distinct[of]
        if k < order and len(levels[k + 1].contexts):
            total = total - np.where(escaped, levels[k + 1].below[upper], 0)
            distinct = distinct - np.where(escaped, levels[k + 1].distinct[upper], 0)
        now = known & hit
        out[todo[now]] += np.log10((level.n[at[now]] - 0.5) / total[now])
        some = known & ~hit & (distinct > 0.5)
        out[todo[some]] += np.log10(distinct[some] / 2 / total[some])
        escaped, upper = (escaped | known)[~now], np.where(known, of, 0)[~now]
        todo = todo[~now]
    left = _SYMBOLS - (levels[0].distinct[0] if len(levels[0].distinct) else 0)
    out[todo] -= np.log10(np.where(escaped, left, _SYMBOLS))
    return out


# ---- steps 2 to 4 ----

_ANSWER = "pack long, kind string, keys binary, v binary, tokens long, distinct long"
_ANSWER_KINDS = (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int64())


def _answers(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) or [()] * 6
    return pa.table([pa.array(list(c), t) for c, t in zip(columns, _ANSWER_KINDS)], names=[c.split()[0] for c in _ANSWER.split(", ")])


def low_grams(made: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """All grams of ``LOW`` context bytes, 2^24 at most: packs are added up in tasks, then those sums here."""

    def run(batches):
        total = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            found = [(unsqueezed(k, True), unsqueezed(n)) for k, n in zip(batch.column("keys").to_pylist(), batch.column("n").to_pylist())]
            total = summed(*(np.concatenate(x) for x in zip(total, *found)))
        yield pa.RecordBatch.from_arrays([pa.array([squeezed(total[0], True)], pa.binary()), pa.array([squeezed(total[1])], pa.binary())], names=["keys", "n"])

    rows = made.where("kind = 'low'").select("keys", "n")
    parts = max(1, made.sparkSession.sparkContext.defaultParallelism)
    total = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for r in rows.repartition(parts).mapInArrow(run, "keys binary, n binary").toLocalIterator():
        total = summed(np.concatenate([total[0], unsqueezed(r["keys"], True)]), np.concatenate([total[1], unsqueezed(r["n"])]))
    return total


def gram_answers(made: DataFrame, low: tuple[np.ndarray, np.ndarray], order: int) -> DataFrame:
    shared = made.sparkSession.sparkContext.broadcast(low)

    def run(table: pa.Table) -> pa.Table:
        keys = [unsqueezed(k, True) for k in table["keys"].to_pylist()]
        grams, n = summed(np.concatenate(keys), np.concatenate([unsqueezed(c) for c in table["n"].to_pylist()]))
        lp = log_probabilities(grams, n, low_levels(*shared.value), order)
        given = zip(table["pack"].to_pylist(), table["keys"].to_pylist(), keys)
        return _answers([(p, "gram", data, squeezed_floats(lp[np.searchsorted(grams, k)]), None, None) for p, data, k in given])

    return made.where("kind = 'gram'").select("pack", "shard", "keys", "n").groupBy("shard").applyInArrow(run, _ANSWER)


def word_answers(made: DataFrame) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        keys = [unsqueeze(k).split(b" ") for k in table["keys"].to_pylist()]
        total: dict[bytes, int] = {}
        for words, n in zip(keys, table["n"].to_pylist()):
            for word, c in zip(words, unsqueezed(n).tolist()):
                total[word] = total.get(word, 0) + c
        given = zip(table["pack"].to_pylist(), table["keys"].to_pylist(), keys)
        rows = [(p, "word", data, squeezed(np.array([total[w] for w in words], np.int64)), None, None) for p, data, words in given]
        return _answers([*rows, (None, "total", None, None, sum(total.values()), sum(c > 0 for c in total.values()))])

    return made.where("kind = 'word'").select("pack", "shard", "keys", "n").groupBy("shard").applyInArrow(run, _ANSWER)


def document_sums(texts: DataFrame, answers: DataFrame, kind: str, order: int) -> DataFrame:
    """Per document the words, known words, sum of log10(c + 0.1), and log10 probability of its bytes."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        lines, held = [], [h for some in left["_held"].to_pylist() for h in some]
        for data, sizes in zip(left["keys"].to_pylist(), left["n"].to_pylist()):
            data, ends = unsqueeze(data), np.cumsum(unsqueezed(sizes)).tolist()
            lines += [data[a:b] for a, b in zip([0, *ends], ends)]
        count: dict[bytes, int] = {}
        grams, lp = [np.zeros(0, np.int64)], [np.zeros(0, "<f4")]
        for name, keys, v in zip(right["kind"].to_pylist(), right["keys"].to_pylist(), right["v"].to_pylist()):
            if name == "word":
                count.update(zip(unsqueeze(keys).split(b" "), unsqueezed(v).tolist()))
            else:
                grams.append(unsqueezed(keys, True))
                lp.append(unsqueezed_floats(v))
        grams, lp = np.concatenate(grams), np.concatenate(lp)
        by_gram = np.argsort(grams)
        grams, lp = grams[by_gram], lp[by_gram]
        n_words, known, base, sums = [], [], [], []
        for part in parts(lines):
            codes, size = stream_codes(part, order)
            order_ = np.argsort(codes)
            codes = codes[order_]
            new = np.concatenate([[True], codes[1:] != codes[:-1]])
            value = lp[np.searchsorted(grams, codes[new])][np.cumsum(new) - 1]
            sums.append(np.bincount(np.repeat(np.arange(len(part)), size)[order_], value, len(part)))
        for text in lines:
            c = np.array([count[w] for w in text.split()], float)
            n_words.append(len(c))
            known.append(np.count_nonzero(c))
            base.append(np.log10(c + 0.1).sum())
        ids = pa.concat_arrays([chunk.flatten() for chunk in left["_ids"].chunks])
        arrays = [ids, pa.array(held), pa.array(n_words, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(np.concatenate(sums))]
        return pa.table(arrays, names=["_id", "held_out", "n_words", "known", "base", "lp"])

    schema = f"_id {kind}, held_out boolean, n_words long, known long, base double, lp double"
    left = texts.select("pack", "keys", "n", "_ids", "_held").groupBy("pack")
    return left.cogroup(answers.select("pack", "kind", "keys", "v").groupBy("pack")).applyInArrow(run, schema)


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score); learns from rows that are not held out."""
    if not LOW < order <= 6:
        raise ValueError(f"order must be {LOW + 1} to 6")
    kind = docs.schema[id_col].dataType.simpleString()
    shards = max(1, -(-text_bytes(docs, text_col) // SHARD_BYTES))
    made = save(packs(docs, id_col, text_col, held_out, order, shards), "packs")
    texts = made.where("kind = 'text'")
    words = save(word_answers(made), "word-answers")
    answers = gram_answers(made, low_grams(made), order).union(words.where("pack IS NOT NULL"))
    sums = document_sums(texts, answers, kind, order)

    n_docs = texts.agg(F.coalesce(F.sum(F.expr("size(filter(_held, h -> NOT h))")), F.lit(0))).first()[0]
    seen = words.where("kind = 'total'").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("distinct"), F.lit(0)).alias("distinct")).first()
    train, distinct = seen["tokens"] + n_docs, seen["distinct"] + (n_docs > 0)
    tokens = F.col("n_words") + 1
    return sums.select(
        F.col("_id").alias(id_col),
        "held_out",
        tokens.alias("n_tokens"),
        (F.col("known") + int(n_docs > 0)).alias("n_known"),
        F.lit(int(train)).alias("train_tokens"),
        (F.col("base") + F.log10(F.lit(n_docs + 0.1)) - tokens * F.log10(F.lit(train + 0.1 * (distinct + 1)))).alias("base_score"),
        F.col("lp").alias("score"),
    )
