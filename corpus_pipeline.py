"""The corpus pipeline: five stages over `documents`, each written and read again.

1. toxicity: documents whose context windows reach the threshold go. The lexicon
   is learned from the `labels` of the input folder.
2. near_dedup: of each group of near copies the document of the least doc_id stays.
3. decontamination: documents that share a verbatim passage with `benchmark` go.
4. secrets: secrets are replaced by a placeholder; every document stays.
5. bpe: texts become token ids, with proof that they decode to the same text.

A stage gets all rows its predecessor kept. The first four return the columns of
`documents` (and any others they were given).

Defined cases: rows with null doc_id or text pass through the filters, which have
no ground to reject them, and nulls in other columns are carried; an empty text
stays and has no tokens; texts of any length are read whole; of rows that repeat
a doc_id and text one stays after near_dedup (a row without doc_id always
stays); of near copies with equal doc_id the text of the least hash stays; an
empty table gives an empty result.

Each result is a table in the shared folder; once the next stage is written the
one before it is removed, and the last stays for its reader.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import bpe, decontaminate, secrets, simhash, toxicity
from sparkloom.runtime import ensure_checkpoint_dir, ship, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    lexicon = toxicity.learn_lexicon(docs, table(spark, sf_dir, "labels"))
    return toxicity.reject_toxic(docs, lexicon)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return decontaminate.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return secrets.redact_secrets(docs)


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return bpe.encode(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", reject_toxic),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secrets", redact_secrets),
    ("bpe", encode_bpe),
]

#: Fuzzy matching, fingerprints, suffix arrays and BPE are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is a table in the shared folder, which cuts lineage."""
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}_{name}")
        if k:
            _remove(spark, f"{base}/{k - 1}_{STAGES[k - 1][0]}")
        docs = spark.read.parquet(f"{base}/{k}_{name}")
    return docs


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
