"""Language identification by rank-order profiles of letter n-grams.

A language's profile is its ``PROFILE`` most frequent n-grams (1 to 3 letters, words
padded with one blank) over all training texts. A document's own most frequent
n-grams are compared with each profile by the out-of-place distance: the sum of rank
differences, ``PROFILE`` for an n-gram that the profile lacks. The nearest profile wins.

Training counts cover every training document. Tasks count about ``CHARS`` characters
of a language at a time; partial counts are flushed when they reach ``FLUSH`` entries
and summed by Spark. Only the profiles go to the driver and back:
``PROFILE`` rows a language, and at most ``MAX_LANGS`` languages (more raise an error).

Defined cases: a null text or one without letters is ``und`` with score 0; the score is
d2 / (d1 + d2) of the two smallest distances (one language: 1), 0 if no profile shares
an n-gram; ties of rank or distance go to the smaller n-gram or name; no training rows:
every text is ``und``. Labels of null are not learned.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, quoted, with_columns

PROFILE = 300
MAX_LANGS = 2_000
FLUSH = 500_000
CHARS = 1_000_000
UND = "und"
_BLANK = 32


@cache
def _letters() -> np.ndarray:
    """Each code point if it is a letter, else a blank."""
    return np.fromiter((i if chr(i).isalpha() else _BLANK for i in range(0x110000)), np.int64, 0x110000)


def gram_codes(text: str) -> np.ndarray:
    """The n-grams of 1 to 3 letters of the padded words of a text, 21 bits a character; empty without letters."""
    c = _letters()[np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), np.uint32)]
    letter = c != _BLANK
    c = c[np.append(True, letter[1:] | letter[:-1])]  # one blank between words
    letter = c != _BLANK
    two = (c[:-1] << 21) | c[1:]
    three = (two[:-1] << 21) | c[2:]
    return np.concatenate([c[letter], two[letter[:-1] | letter[1:]], three[letter[1:-1]]])


def counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, rising, and how often each occurs."""
    codes = np.sort(codes)
    starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.empty(0, np.int64)
    return codes[starts], np.diff(np.append(starts, len(codes)))


def profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE) -> DataFrame:
    """(lang, gram, rank from 0) of the most frequent n-grams of each language, over all rows."""

    def count(batches):
        sums: dict[str, dict[int, int]] = {}
        texts: dict[str, list[str]] = {}
        chars: dict[str, int] = {}

        def add(lang):
            codes, n = counted(gram_codes(" ".join(texts.pop(lang))))
            total = sums.setdefault(lang, {})
            for code, k in zip(codes.tolist(), n.tolist()):
                total[code] = total.get(code, 0) + k
            chars[lang] = 0

        def flush():
            for lang, total in sums.items():
                columns = [pa.array([lang] * len(total), pa.string()), pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "gram", "n"])
            sums.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                texts.setdefault(lang, []).append(text)
                chars[lang] = chars.get(lang, 0) + len(text)
                if chars[lang] > CHARS:
                    add(lang)
            if sum(map(len, sums.values())) >= FLUSH:
                yield from flush()
        for lang in list(texts):
            add(lang)
        yield from flush()

    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(lang_col, text_col)
    counts = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    # the limit stands on the row number itself: Spark then drops what lies beyond it in each task, before the shuffle
    first = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)
    return first.select("lang", "gram", (F.col("rank") - 1).alias("rank"))


class Profiles:
    """Ranks of all languages, by n-gram."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int = PROFILE):
        self.size = size
        self.langs = sorted({lang for lang, _, _ in rows})
        self.grams = np.unique(np.array([gram for _, gram, _ in rows], np.int64))
        self.ranks = np.full((len(self.grams), len(self.langs)), -1)
        at = {lang: i for i, lang in enumerate(self.langs)}
        for lang, gram, rank in rows:
            self.ranks[np.searchsorted(self.grams, gram), at[lang]] = rank

    def predict(self, text: str | None) -> tuple[str, float]:
        codes, n = counted(gram_codes(text)) if text else (np.empty(0, np.int64), None)
        if not len(codes) or not self.langs:
            return UND, 0.0
        if len(codes) > self.size:  # those that may be among the most frequent
            least = np.partition(n, len(n) - self.size)[len(n) - self.size]
            codes, n = codes[n >= least], n[n >= least]
        top = codes[np.argsort(-n, kind="stable")[: self.size]]
        at = np.minimum(np.searchsorted(self.grams, top), len(self.grams) - 1)
        ranks = np.where((self.grams[at] == top)[:, None], self.ranks[at], -1)
        distance = np.where(ranks >= 0, np.abs(ranks - np.arange(len(top))[:, None]), self.size).sum(axis=0)
        best = int(np.argmin(distance))
        first = int(distance[best])
        if first == self.size * len(top):
            return self.langs[best], 0.0
        if len(distance) == 1:
            return self.langs[best], 1.0
        second = int(np.partition(distance, 1)[1])
        return self.langs[best], second / (first + second) if first + second else 0.5


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Profiles:
    """Fit the profiles and bring them to the driver; their number is checked first."""
    found = profiles(docs, text_col, lang_col)
    rows = found.limit(MAX_LANGS * PROFILE + 1).collect()
    if len(rows) > MAX_LANGS * PROFILE:
        raise ValueError(f"more than {MAX_LANGS} languages")
    return Profiles([(r["lang"], r["gram"], r["rank"]) for r in rows])


def predict(docs: DataFrame, model: Profiles, text_col: str = "text", names: tuple[str, str] = ("_lang", "_score")) -> DataFrame:
    """The rows with two more columns, which the frame must not have yet: the language and its score."""
    lang, score = names
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())])

    def run(batches):
        for batch in batches:
            found = [shared.value.predict(t) for t in batch.column(text_col).to_pylist()]
            yield with_columns(
                batch, {lang: pa.array([f[0] for f in found], pa.string()), score: pa.array([f[1] for f in found], pa.float64())}
            )

    return docs.mapInArrow(run, schema)


def accepted(docs: DataFrame, model: Profiles, text_col: str = "text") -> DataFrame:
    """Documents in a learned language: drops those without letters and those that share no n-gram with any profile."""
    lang, score = fresh(docs, "_lang", "_score")
    found = predict(docs, model, text_col, (lang, score))
    return found.where((F.col(lang) != UND) & (F.col(score) > 0)).select([quoted(c) for c in docs.columns])
