"""A training-corpus pipeline: each stage takes the documents that the one before kept.

toxicity rejects documents that score as toxic; near_duplicates keeps one document of each group (five-word
shingles, similarity 0.8); decontamination rejects documents that hold a benchmark window; pii replaces
personal data by pseudonyms; bpe returns each document's tokens, and digests of them and of what they
decode to.  All but the last stage return the columns of documents.

Defined results: rows are judged one by one, by their own texts.  A null text scores as an empty one, is linked
with nothing, holds no benchmark window and encodes to no tokens.  Of near duplicates the row of the least id
stays, rows without an id coming last, and one of rows that are equal in id and text.  Other columns, whatever
their names, pass through to the last stage, which returns its own.  No documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.llm.bpe import default_vocabulary, round_trip
from mnemospark.llm.common import stored, table
from mnemospark.llm.decontaminate import remove_contaminated
from mnemospark.llm.near_duplicates import drop_near_duplicates
from mnemospark.llm.pii import pseudonymise, session_key
from mnemospark.llm.toxicity import reject_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return reject_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pseudonymise(docs, session_key(spark), count_col=None)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return round_trip(docs, default_vocabulary(), keep_ids=True)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("pii", pii), ("bpe", bpe)]

#: SQL can't express the trained classifier of the first stage; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
