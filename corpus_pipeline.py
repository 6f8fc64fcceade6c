"""A pipeline over `documents`: language, near copies, benchmark leaks, source mix, shards.

STAGES are (name, function of (spark, docs, sf_dir)); each result is written as Parquet and is the next one's docs. All but the last
return the columns of documents. run() applies them to the documents of a folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import decontamination, jaccard_join, language_id, mixing, sharding
from leafmill.llm.common import materialize, read

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a language learned from the labelled ones; null texts, texts without letters and rejected ones go.

    Each row is judged by its text alone, so repeated rows stay or go together. Without labelled rows no language is known and all rows go; an empty table gives an empty one.
    """
    model = language_id.train(docs.where(language_id.fold("doc_id") != 0))
    return language_id.identify(docs.select(*COLUMNS), model).where("accepted and lang_pred <> 'und'").select(*COLUMNS)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard 0.75): that of the smallest id; of equal rows with this id one.

    Texts without words are no copies of each other and stay; rows of groups without any id all stay. An empty table gives an empty one.
    """
    return jaccard_join.one_of_each_group(docs.select(*COLUMNS))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none; repeated rows stay or go together; without items all stay."""
    return decontamination.decontaminate(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: 0 to 2 times. Documents without words take no part and go; a null source is one; ties go by hash."""
    return mixing.mix_documents(docs.select(*COLUMNS))


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, repeated ones too, with shard (0 to 7) and slot. Nulls are values; an empty table gives an empty one."""
    return sharding.shard_rows(docs.select(*COLUMNS), shards=8)


STAGES = [
    ("language ID", known_language),
    ("n-gram Jaccard join", one_of_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources", mixed),
    ("sharding", sharded),
]

#: SQL can't express the models and draws of these stages; tests hold the operators against brute force and check what run()'s stages keep.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(*[F.col(c) for c in COLUMNS])
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{i}")
    return docs
