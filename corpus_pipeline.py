"""The corpus pipeline: language, near duplicates, repeated passages, benchmark leaks, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hexloom.llm.common import discard, materialise, scratch
from hexloom.llm.decontamination import contained_items
from hexloom.llm.jaccard_join import similar_documents
from hexloom.llm.language import UNKNOWN, identify, train
from hexloom.llm.packing import pack
from hexloom.llm.suffix_dedup import remove_repeated_bytes

#: A document whose words lean to no language is rejected: its best one has less than this mean chance. Documents that
#: switch between two languages have about a half and stay.
LEAST_SCORE = 0.35


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without a letter (null texts among them), or of no clear language, go.

    Each row is judged by its text alone, so repeated rows and ids go or stay alike. Other columns, whatever their names,
    are kept as they are. Without labelled documents no language is known, and none stays; an empty table stays empty.
    """
    made = ("hx_lang", "hx_score", "hx_spans")
    found = identify(docs, train(docs), made=made)
    return found.where((F.col("hx_lang") != UNKNOWN) & (F.col("hx_score") >= LEAST_SCORE)).select(*docs.columns)


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the least id, once.

    Rows of one id are one document: of several, that with the least text stays (a null text last). A null text, and one
    without a word, is like no other; a row without an id stays. Other columns are kept as they are.
    """
    gone = similar_documents(docs).where(~F.col("kept")).select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    # ids of several rows are few; those rows alone are brought together
    several = kept.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("hx_n")).where("hx_n > 1").select("doc_id")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    first = F.min_by(row, F.struct(F.col("text").isNull(), F.col("text"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])))
    one = kept.join(several, "doc_id", "left_semi").select(*docs.columns).groupBy("doc_id").agg(first.alias("hx_row")).select("hx_row.*")
    return kept.join(several, "doc_id", "left_anti").select(*docs.columns).unionByName(one)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 100 bytes or more that occur earlier; a text of which no word is left goes.

    A null text and one without a repeat stay as they are, and so do rows without an id; rows that repeat an id lose the
    same bytes. n_chars is that of the text that is left, if the table has such a column; others are kept as they are.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    packed = F.struct(F.col("doc_id").alias("doc_id"), *[F.col(f"`{c}`") for c in others], F.col("text").isNull().alias("hx_none"))
    x = remove_repeated_bytes(docs.select("doc_id", "text", packed.alias("hx_row")), carry=("hx_row",))
    x = x.where((F.col("n_removed") == 0) | (F.trim("hx_kept") != ""))
    text = F.when(~F.col("hx_row.hx_none"), F.col("hx_kept"))
    new = {"doc_id": F.col("hx_row.doc_id"), "text": text, "n_chars": F.coalesce(F.char_length(text), F.lit(0)).cast("long")}
    return x.select(*[(new[c] if c in new else F.col("hx_row").getField(c)).alias(c) for c in docs.columns])


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    An id of which any row holds one goes with all its rows; rows without an id, null texts and texts without a word stay.
    Without benchmark items all stay. Columns are kept as they are.
    """
    found = contained_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces in sequences of at most 2048 tokens: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is packed as an empty one; repeated rows are packed each; other columns are not read.
    """
    return pack(docs)


STAGES = [
    ("language", known_language),
    ("near_duplicates", one_of_each_class),
    ("repeated_passages", without_repeats),
    ("benchmark", without_benchmark),
    ("packing", packed),
]

#: No stage but the anti-joins can be said in SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each stage's table is written before the next reads it; the tables that a stage made for
    itself, and the one that it read, are deleted then."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before = docs
        with scratch(spark) as keep:
            docs = materialise(stage(spark, before, sf_dir), name)
            keep(docs)
        if k:
            discard(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)
