"""A training-data pipeline over documents: toxic texts go, near copies and repeated passages go, what stays is packed.

In every stage a null text is an empty one, rows of equal doc_id are rows of their own, further columns are kept by all stages
but the last, whatever their names, and an empty table gives an empty table. A null doc_id is scored and packed like any other;
it is no copy of anything, and neither gives nor loses passages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from horosphere.llm import neardup, packing, substrings, toxicity
from horosphere.llm.common import stored

#: Similarity in percent from which the near-duplicate stage links texts.
PERCENT = 85


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score, by a model learnt from labels, is below 0.5. An empty text has the score of features 0; equal texts have
    equal scores and stay or go together; without usable labels all rows stay, with labels of one kind all stay or go."""
    return toxicity.keep_clean(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate component, of texts that share PERCENT of their five-word shingles, the row of the least doc_id.
    Empty texts, and those of blanks only, are copies of nothing and stay; repeated rows of a doc_id that stays all stay."""
    return neardup.keep_one(docs, PERCENT)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 50-byte strings that an earlier document holds, n_chars adapted. A character that loses
    some of its bytes goes whole; a document of which nothing stays goes, one that was empty before stays. Repeated rows of a
    doc_id do not take passages from each other."""
    return substrings.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens, each with its sequence and place there. An empty text is its end id alone."""
    import public_tokenizers as P

    groups = max(1, round(docs.count() / packing.GROUP))
    return packing.place(packing.pieces(docs, P.path("byte_bpe_50k.json"), 2, 1024), 1024, groups)


STAGES = [("toxicity", drop_toxic), ("near_dedup", keep_one_of_each), ("substring_dedup", drop_repeats), ("packing", pack)]

#: SQL expresses neither the model nor the ids; the tests compare run() with brute-force components and removal and the library's ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
