"""Corpus pipeline: the stages that turn raw documents into encoded training text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outlog.llm import bpe, langid, minhash, mixing, suffix
from outlog.llm.common import join_groups
from outlog.session import broadcast_if_small, cut_lineage, drop_finished_shuffles, drops_scratch, read_table, scratch_path

MIN_SURE = 0.3  # a document whose words are on average torn between more than three languages goes


def free_name(name: str, docs: DataFrame) -> str:
    """``name``, lengthened until no column of ``docs`` has it."""
    while name in docs.columns:
        name += "_"
    return name


@drops_scratch
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters whose words are of a language, of whatever mixture of languages.

    The field is fitted on a sample of ``docs``.  A document is judged by how sure the field is of
    each of its words, not by the share of its best language: texts in several languages stay, as do
    words that two or three languages share.  Without labels to learn from, all texts with letters stay.
    Texts null or without a letter go; every row is judged for itself, repeated ids and rows alike; an empty
    table stays empty; columns of ``docs`` come back unchanged, whatever their names.
    """
    drop_finished_shuffles(spark)
    pred, score, sure = (free_name(c, docs) for c in ("_pred", "_score", "_sure"))
    crf = langid.fit(docs)
    if not crf.labels:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    scored = langid.predict(docs, crf, pred_col=pred, score_col=score, sure_col=sure)
    return scored.where((F.col(pred) != langid.UNKNOWN) & (F.col(sure) >= MIN_SURE)).select(*docs.columns)


@drops_scratch
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that shares 80 of 100 five-word shingles; the smallest id stays (no id: last).

    Rows are judged by a number of their own, so of rows that repeat, with or without id, one stays, and so
    does one of near texts that share an id.  Texts null, empty or blank are linked with nothing and all
    stay; an empty table stays empty; columns come back unchanged, whatever their names.
    """
    drop_finished_shuffles(spark)
    rows = cut_lineage(docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("n")))
    judged = minhash.near_duplicates(rows.select("n", F.col("row.text").alias("text")), id_col="n")
    grouped = cut_lineage(judged.where(F.col("n_shingles") > 0).select("n", "component_id")
                          .join(rows.select("n", F.col("row.doc_id").alias("id")), "n"))
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "n"))
    groups = cut_lineage(grouped.groupBy("component_id").agg(first.alias("first"), F.count("*").alias("size"))
                         .where(F.col("size") > 1).select("component_id", F.col("first.n").alias("stays"), "size"))
    gone = join_groups(grouped, groups, ["component_id"], "size", grouped.count()) \
        .where(F.col("n") != F.col("stays")).select("n")
    left = rows.join(broadcast_if_small(cut_lineage(gone), row_bytes=16), "n", "left_anti")
    return left.select("row.*")


@drops_scratch
def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that an earlier 100-byte string covers; emptied texts go."""
    drop_finished_shuffles(spark)
    cut = suffix.remove_repeats(docs)
    whole = (F.col("n_removed") == 0) | (F.length(F.trim("text")) > 0)
    return cut.where(whole).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long"))
                                       .otherwise(F.col("n_chars"))).select(*docs.columns)


@drops_scratch
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: one row per document and epoch that takes words of it, its text those words."""
    drop_finished_shuffles(spark)
    rows = mixing.numbered(docs)
    placed = mixing.streams(rows)
    return mixing.mixed_rows(rows, placed, mixing.draw(placed))


@drops_scratch
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text beside the columns of documents, and the text they decode to."""
    drop_finished_shuffles(spark)
    return bpe.encode_decode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("mix_sources", mix_sources),
    ("encode", encode),
]

# Conditional random fields, suffix order, permutations and merge rounds are beyond SQL: tested against
# brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet and read again as the next input."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
