"""The corpus pipeline: language ID, line dedup, near-dedup, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import language, line_dedup, mixing, near_dedup, packing
from palimpsest.llm.shared import Workspace, fresh, lookup_join
from palimpsest.llm.token_files import tokenizer_file

#: A document goes if no language is found in it, or with less than this score.
MIN_SCORE = 0.2
#: Near-duplicates share at least this percentage of their shingles; bytes of two sketches that then agree at least.
PERCENT, SKETCH_EQUAL = 80, 78


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in which a language is found; learned from those that have a label. All, if none has one.

    A null or empty text has no language and goes; repeated rows are judged alike; other columns pass through.
    """
    model = language.fit(docs)
    if model is None:
        return docs
    found = language.predict(docs, model, [F.col(f"`{c}`") for c in docs.columns])
    pred, score = found.columns[-2:]
    return found.where((F.col(pred) != language.UNKNOWN) & (F.col(score) >= MIN_SCORE)).select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without their sites' boilerplate lines; n_chars follows the text.

    Copies of a text are one page: they go in near-dedup, which keeps one, and its lines must still be there.
    Null texts and those of a null source stay as they are.
    """
    cut = line_dedup.drop_boilerplate(docs, copies_once=True)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, that with the least id and text hash, null ids last; of other repeated rows one.

    Null and empty texts are in no group. Only rows whose (id, text hash) stands more than once are shuffled whole.
    """
    ws = Workspace(spark)
    found = near_dedup.near_duplicates(docs, percent=PERCENT, equal=SKETCH_EQUAL)
    key, named, number = (fresh(docs, x) for x in ("text_hash", "id_named", "id_number"))
    # an id as two columns that are never null, so that null ids are found too
    own = [F.col("doc_id").isNotNull().alias(named), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias(number)]
    row, chosen, n = [named, number, key], fresh(docs, "row_chosen"), fresh(docs, "row_count")
    judged = found.select(*own, F.col("text_hash").alias(key), "chosen").groupBy(*row).agg(F.bool_and("chosen").alias(chosen), F.count("*").alias(n))
    judged = ws.table(judged.where(~F.col(chosen) | (F.col(n) > 1)), "judged")
    rows = docs.select("*", *own, F.xxhash64("text").alias(key))
    once = lookup_join(rows, judged.select(*row), row, "left_anti")
    repeated = lookup_join(rows, judged.where(F.col(chosen)).select(*row), row, "left_semi").dropDuplicates(row)
    return once.unionByName(repeated).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents sampled by raked weights of source, language and form; null is a category, texts without words go."""
    return mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document in a packed sequence, with its ids; a null text is an empty one, repeated rows are packed each."""
    return packing.pack_documents(docs, tokenizer_file(), end_id=1)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]
#: Language identification and the packer's cuts have no SQL; tests/llm checks the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    ws = Workspace(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = ws.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
