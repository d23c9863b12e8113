"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chirplake.llm import linededup, mixing, shared, simhash, suffixpieces, toxicity


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the lexicon is learned from labelled documents of this table.

    Null and empty texts score as texts without matches and stay, as do repeated rows, each by itself. All columns stay,
    whatever they are called. No documents give none.
    """
    lexicon = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.toxicity(docs, lexicon)
    return scored.where(F.col("score") < toxicity.THRESHOLD).select("row.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that occur before; n_chars follows a text that changes.

    Rows out are rows in, texts that become empty too. Null texts stay null. Of equal passages the one of the least doc_id
    stays, null ids last; rows of one id and text are one document. Other columns stay, whatever they are called.
    """
    changed = F.col("removed") > 0
    out = linededup.dedup_lines(docs).select("row", F.col("text").alias("new"), changed.alias("changed"))
    own = {"text": F.col("new"), "n_chars": F.when(F.col("changed"), F.char_length("new").cast("long")).otherwise(F.col("row.n_chars"))}
    return out.select(*[own.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least id, of rows that share it the first by text.

    Near duplicates have five-word shingles of Jaccard similarity 0.8 or more, or are linked by rows between them that do.
    Texts that line dedup has emptied are no copies of each other's content, but link like other texts without words, null
    among them. Null ids come last. Rows that are alike in all columns are one. No documents give none.
    """
    marks = [F.xxhash64(*docs.columns).alias("h"), F.hash(*docs.columns).alias("g")]  # 96 bits of a whole row
    near = simhash.similar_documents(docs.select("doc_id", "text", *marks)).select("row.*", "root")
    first = near.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h", "g")).alias("k"))
    # rows that are alike in all columns are one before they meet the kept ones, so that none of any number is a hot key
    rows = docs.select(F.struct(*docs.columns).alias("row"), *marks).groupBy("h", "g").agg(F.first("row").alias("row"))
    return rows.join(first.select("k.h", "k.g"), ["h", "g"], "left_semi").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources at their target weights; a document may come twice.

    Documents without words, null texts among them, are never taken. A null source is the last one. Repeated rows are
    documents of their own. All columns stay, whatever they are called. No documents give none.
    """
    return mixing.mix(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, and whether they decode to its text.

    Rows out are rows in. A null or empty text has no ids.
    """
    encoded = suffixpieces.encode(docs, suffixpieces.default_model())
    return encoded.select("row.doc_id", "row.source", "ids", "n_ids", "ids_crc32", "same")


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", dedup_lines),
    ("near dedup", keep_one),
    ("source mix", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: Hashing and the tokenizer are beyond SQL; the tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared.saved(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
