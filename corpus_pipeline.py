"""A corpus made ready for training: language, near-duplicates, personal data, mixing, packing.

Every stage is a function of (spark, docs, sf_dir) that returns a DataFrame; it is written as Parquet and read again as
the next one's docs. All but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.llm import language_id, mixing, near_duplicates, packing, private_data
from eventide.llm.common import discard, free_name, materialize, table


def columns_of(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a sufficient margin. Dictionaries are learned from docs themselves, from
    the folds that may be learned from; null texts and texts without letters go."""
    dictionaries = language_id.train_dictionaries(docs.where(~language_id.held_out("doc_id")), "text", "lang", "doc_id")
    judged = free_name("judged", docs.columns)
    told = docs.withColumn(judged, language_id.judge_udf(dictionaries)(F.col("text")))
    return told.where(~F.col(judged)["rejected"]).select(*columns_of(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8): that of the least doc_id.

    Rows that repeat a doc_id are documents of their own if their texts differ; then documents are numbered, and that of
    the least number stays. Of rows with equal doc_id and text one stays. Documents without a doc_id are in no group, and
    stay."""
    known, unknown = docs.where("doc_id is not null"), docs.where("doc_id is null")
    if not near_duplicates.repeats(docs, "doc_id"):
        kept = near_duplicates.group(known.select("doc_id", "text"), "doc_id", "text").where("kept").select("doc_id")
        return known.join(kept, "doc_id", "left_semi").select(*columns_of(docs)).unionByName(unknown)
    number, digest = free_name("number", docs.columns), free_name("digest", docs.columns)
    digested = known.withColumn(digest, F.sha2(F.coalesce("text", F.lit("")), 256))
    numbers = materialize(digested.select("doc_id", digest).distinct().withColumn(number, F.monotonically_increasing_id()))
    own = materialize(digested.join(numbers, ["doc_id", digest]).dropDuplicates(["doc_id", digest]))
    kept = near_duplicates.group(own.select(number, "text"), number, "text").where("kept").select(number)
    return own.join(kept, number, "left_semi").select(*columns_of(docs)).unionByName(unknown)


def redact_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind, and n_chars after it."""
    field = private_data.train(docs, "doc_id", "text")
    found = private_data.find(docs, "text", field, redact=True, column=free_name("spans", docs.columns))
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*columns_of(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, and those of small sources up to twice."""
    tokens = free_name("tokens", docs.columns)
    counted = docs.withColumn(tokens, mixing.word_count(F.col("text")))
    drawn = mixing.drawn(counted, "source", tokens, ["doc_id"], mixing.TARGET)
    return drawn.select(*(F.col("row")[c].alias(c) for c in docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens."""
    return packing.pack(docs, "text", ["doc_id"])


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("private_data", redact_private_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can't say compression, sketches or learned labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, materialize(stage(spark, docs, sf_dir))
        if n:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
