"""The corpus pipeline: stages that each apply one operator to all that the stage before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.llm import bpe, jaccard, langid, mixing, suffixes
from wardlight.llm.common import materialize, table, training_rest
from wardlight.llm.queries import RANKS, SEED, WEIGHTS

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents whose best language gets less than this mean probability are in none of them.
LEAST_SCORE = 0.4
#: Near duplicates share 80 % of their 5-word shingles.
NEAR_PERCENT, NEAR_WORDS = 80, 5
#: Bytes of a repeated string; passages of over 50 words have more, short set phrases have fewer.
REPEAT_BYTES = 256


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; a missing lang is filled by the prediction. Null texts and texts without letters go.

    Repeated rows are judged alike. Where no row has a language, none is learned and all go; an empty table stays empty.
    """
    net = langid.fit(docs.where(training_rest("doc_id", 4) != 2))
    found = langid.identify(docs.select(COLUMNS), net)
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return kept.select("doc_id", "text", F.coalesce("lang", "lang_pred").alias("lang"), "source", "n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates one row, of the smallest id and then of the smallest text digest.

    Rows are told apart by id and text, so equal or null ids of different texts are different documents;
    rows without words are linked with nothing, and of rows equal in id and text one stays. An empty table stays empty.
    """
    # a name of each id and text, which sorts as the id (nulls last) and then by the text
    name = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest"))
    rows = docs.select(*COLUMNS, name.alias("name"))
    found = jaccard.near_duplicates(rows.select("name", "text"), id_col="name", percent=NEAR_PERCENT, size=NEAR_WORDS)
    text_key = F.col("name.digest").alias("digest")
    kept = found.where("name = component_id").select(text_key, F.col("name.no_id").alias("no_id"), F.coalesce("name.doc_id", F.lit(0)).alias("id")).distinct()
    keyed = rows.select(*COLUMNS, text_key, F.col("name.no_id").alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"))
    return keyed.join(kept, ["digest", "no_id", "id"], "left_semi").dropDuplicates(["digest", "no_id", "id"]).select(COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of REPEAT_BYTES bytes that occur again anywhere; documents of nothing else go.

    Null texts have no bytes and go; of repeated rows all bytes repeat, if they are long enough. An empty table stays empty.
    """
    rows = docs.select(F.struct("doc_id", "lang", "source").alias("row"), "text")
    left = suffixes.remove_repeats(rows, "text", "row", length=REPEAT_BYTES)
    left = left.select("row.doc_id", F.col("clean_text").alias("text"), "row.lang", "row.source", F.length("clean_text").cast("long").alias("n_chars"))
    return left.where(F.col("text").rlike(r"[^ \t-\r]"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that the sources reach their weights, in random order.

    A null source is one of its own, null texts have no length; rows of equal ids and texts are repeated alike.
    An empty table stays empty.
    """
    return mixing.poisson_mix(docs, WEIGHTS, seed=SEED).select(COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, decoded_sha256: every copy encoded, and what its ids decode to.

    Null texts have no tokens; repeated rows repeat; an empty table stays empty.
    """
    return bpe.encode_column(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, keep=["doc_id", "lang", "source"])


STAGES = [("language ID", language), ("n-gram Jaccard join", near_duplicates), ("suffix-array dedup", repeats), ("mixing sources to target weights", mixture), ("byte-level BPE encoding", tokens)]
#: A trained network decides in the first stage; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{k}")
    return docs
