"""The corpus pipeline: language ID, near duplicates, secrets, packing. Each stage is one of the operators of slatework.llm.

A stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return the columns of
documents as they came in, extra ones included. An empty table passes through every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatework.llm import jaccard, langid, packing, pieces, secrets
from slatework.llm.common import discard, fresh, materialize, scratch, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go: null or letterless texts, and texts that no language's model explains.

    The models and their rejection limits are learnt from the labels of the documents at hand; a document's own label isn't
    compared with the prediction.
    """
    identifier = langid.fit(docs, F.lit(True))
    told = fresh(docs, "told")
    out = docs.withColumn(told, langid.predict(spark, identifier, F.col("text")))
    return out.filter(~F.col(told)["rejected"]).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles at a Jaccard similarity of 0.8 or more one stays: that with
    the smallest doc_id, null last (of rows of one doc_id and text that whose columns come first as JSON). Documents without
    words have no group and stay."""
    found = jaccard.classes(docs, width=5, percent=80).filter("class IS NOT NULL")
    found = materialize(spark, found.select("id", "hash", "class"), "groups")
    first = found.groupBy("class").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "hash")).alias("first"), F.count("*").alias("n"))
    first = materialize(spark, first.filter("n > 1").drop("n"), "firsts")
    met = found.join(first, "class")
    same = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("hash") == F.col("first.hash"))
    id_, hash_ = fresh(docs, "id"), fresh(docs, "hash")
    gone = met.filter(~same).select(F.col("id").alias(id_), F.col("hash").alias(hash_)).distinct()
    again = met.filter(same).groupBy("id", "hash").agg(F.count("*").alias("_n")).filter("_n > 1")
    again = again.select(F.col("id").alias(id_), F.col("hash").alias(hash_))
    row = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(hash_))
    kept = docs.join(gone, row, "left_anti")
    one = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    once = kept.join(again, row, "left_semi").groupBy("doc_id", "text").agg(F.min_by(one, F.to_json(one)).alias("one")).select("one.*")
    return kept.join(again, row, "left_anti").unionByName(once)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret that the scan finds is cut out of its text and replaced by [SECRET]; n_chars follows the new text.
    Documents without secrets stay as they are."""
    return secrets.redact(docs, secrets.RULES, "[SECRET]", length_col="n_chars")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, tokenized and packed into sequences of 4096: one row per piece."""
    cut = pieces.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)
    out = packing.pack(cut, 4096)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: Language models, token ids and the packing search aren't expressible in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:  # what a stage wrote on its way goes once its result is written
            kept = materialize(spark, stage(spark, docs, sf_dir), name)
            keep.append(kept)
        discard(spark, docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
