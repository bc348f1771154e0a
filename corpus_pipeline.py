"""Documents to clean, tokenised training text: each stage works on all that its predecessor kept.

Quality classifier, near-duplicates, benchmark decontamination, personal data, byte-level BPE.  All but the last return
the columns of documents; the last returns token ids.  Null and empty texts pass the stages as the operators define it.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from densigrid.llm import bagminhash, bpe, decontaminate, pii, quality
from densigrid.llm.ship import fresh, removed, shared_folder, table

#: A document whose probability of being good text is below this is dropped.
LEAST_QUALITY = 0.7


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality model rejects.  The model learns from the stage's own documents and the labels; one
    that could learn nothing rejects none."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    if not model.learned:
        return docs
    score = fresh(docs, "score")
    return quality.score(docs, model, docs.columns, score).where(F.col(score) >= LEAST_QUALITY).drop(score)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near-duplicates."""
    return bagminhash.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a test item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and the words that disclose it."""
    return pii.sanitise(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids, with the hash of the ids."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_documents(docs, path, public_tokenizers.PATTERN, ["doc_id", "lang", "source"], with_ids=True, with_hashes=False)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("personal_data", personal_data_stage),
    ("bpe", bpe_stage),
]

#: The quality model, signatures and token ids are beyond SQL; tests/llm/test_pipeline.py holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:  # read by the stage that is written now, and by nothing else
            removed(spark, f"{folder}/{before}")
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
