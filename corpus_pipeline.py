"""The corpus pipeline: documents in, token ids out.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of docs.  Between stages the result is written as Parquet and read again.

In every stage: other columns, of whatever name, are carried on as they are; a text of any length is read whole; a null
text counts as empty and stays null; no rows give no rows.  What rows without id, repeated rows and ties come to is said
at each stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillon.llm import bpe, decontaminate, jaccard, quality, secret_scan
from quillon.llm.tables import id_remainder, table, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from labelled ones of these, does not reject (a score of 0.3 or more).

    Rows without id are judged but never learnt from; rows that repeat an id or a text are judged alike.  An empty text
    has the score of no words.  Where no labelled document is left to learn from, every score is 0.5 and all stay."""
    names = []
    for name in ("score", "predicted"):
        while name in docs.columns or name in names:
            name = f"_{name}"
        names.append(name)
    labelled = quality.sample(docs, table(spark, sf_dir, "labels"), "quality", id_remainder("doc_id", 5) != 0)
    out = quality.scored(docs, quality.train(labelled, "quality"), score=names[0], predicted=names[1])
    return out.where(F.col(names[1]) == 1).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents linked by a similarity of 0.8 or more, the one of least id.

    Documents without words are copies of each other.  Rows that repeat the id of the one that stays are one; rows
    without id stay."""
    return jaccard.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark: a window as long as an item, of similarity 0.8 or more to it.

    Rows that repeat an id go together; rows without id are taken as one document, and go together too."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by a mark; n_chars is that of the new text (null for a null text).

    Rows are judged one by one, with or without id; overlapping secrets get one mark."""
    out = secret_scan.redact(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), and digests of the ids and of what they decode to.

    A row for each row, with or without id; a null or empty text has no tokens."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("secret scans", redact_secrets),
    ("byte-level BPE", tokenize),
]

#: The classifier, the network and the tokenizer cannot be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; every result but the last is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs)
    return docs
