"""The queries of the operators: ``fn(spark, directory) -> DataFrame`` over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import decontaminate, language, licenses, line_dedup, near_dups, packing, ppm, quality, quotes, secret_ledger, spelling, vector_dups, whitening
from .common import remainder, ship, table

QUERIES = {}


def query(fn):
    def run(spark, sf_dir):
        ship(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


@query
def op1_decontaminate(spark, sf_dir):
    """Words of each document inside an occurrence of a 13-word window of a benchmark item."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("spans")


@query
def op2_ppm_score(spark, sf_dir):
    """Log probability of each document by unigrams and by prediction by partial matching."""
    return ppm.score(table(spark, sf_dir, "documents"), remainder("doc_id", 10) == 0)


@query
def op3_secret_ledger(spark, sf_dir):
    """Secrets of each document, found once per blob."""
    return secret_ledger.report(table(spark, sf_dir, "documents")).drop("blob_id")


@query
def op4_language_id(spark, sf_dir):
    """Language of each document; profiles are learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    rest = remainder("doc_id", 4)
    model = language.learn(docs.where(rest != 2))
    return language.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", (rest == 2).alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score")
    )


@query
def op5_minhash_dedup(spark, sf_dir):
    """Components of documents with a Jaccard similarity of 3-word shingles of 0.85 or more."""
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op6_quality_score(spark, sf_dir):
    """Chance that a document is of quality 1, learned from labels of documents that are not held out."""
    held_out = remainder("doc_id", 5) == 0
    found = quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out, remainder("doc_id", 5) == 1)
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op7_pack_sequences(spark, sf_dir):
    """Pieces of all documents in sequences of at most 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op8_vector_dedup(spark, sf_dir):
    """Links and components of vectors with a cosine of 0.95 or more."""
    return vector_dups.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op9_license_notices(spark, sf_dir):
    """License phrases and fuzzy notices of each document."""
    return licenses.scan(table(spark, sf_dir, "documents")).drop("spans")


@query
def op10_quote_threads(spark, sf_dir):
    """Messages without quotes, linked to what they quote, in reply order."""
    return quotes.linked(table(spark, sf_dir, "conversations"))


@query
def op11_line_dedup(spark, sf_dir):
    """Documents without the lines that three or more of them hold."""
    found = line_dedup.drop_shared_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query
def op12_spelling_variants(spark, sf_dir):
    """Words of the documents with their number of near words, and the frequent word each is a variant of."""
    return spelling.variants(table(spark, sf_dir, "documents"))


@query
def op13_whitening(spark, sf_dir):
    """Every vector on the first four principal components, scaled to variance one."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
