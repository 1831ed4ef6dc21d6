"""Corpus pipeline: five stages from raw documents to token files.

Each stage reads all rows that its predecessor kept, written as Parquet in the shared folder; all but the last
return the columns of ``documents``.

1. quality classifier: rejected documents go;
2. MinHash near-dedup (five-word shingles, similarity 0.8): one document of each group stays;
3. benchmark decontamination: documents with a verified overlap go;
4. mixing sources to target weights: documents are repeated or left out to meet each source's budget;
5. token-ID / binary output: shards are written, read back and summed up for each document.

Defined cases, for the chain: null and empty texts have a score like any other and, where they stay, have no words, so the mix leaves them
out; a null id is never a copy of anything and is kept by stage 2; rows that repeat an id are one document from stage 2 on, and copies that the mix makes are
rows of their own in the token files; extra columns, whatever their names, pass through stages 1 to 4; an empty table gives an empty table in every stage;
texts of any length are whole in every stage.  Each stage's own docstring says how ties are broken.

No stage's rows can be said in SQL (trained model, MinHash, tokenizer), so ``ORACLE_SQL`` is None and
tests compare each stage with a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import common, decontamination, minhash_dedup, quality_classifier, source_mix, token_files

ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels, accepts."""
    model = quality_classifier.fit(docs, common.table(spark, sf_dir, "labels"))
    return quality_classifier.scored(docs, model, into="__score").where(F.col("__score") >= 0.3).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return minhash_dedup.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item's words."""
    return decontamination.clean(docs, common.table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources; a document that is taken twice is two rows."""
    return source_mix.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, read back from the token files."""
    path = common.new_path(spark, "token-files")
    token_files.write(docs, path, token_files.tokenizer_path(), end_id=2)
    return token_files.read(spark, path)


STAGES = [
    ("quality_classifier", quality),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("source_mix", mix),
    ("token_files", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, _ = common.saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
