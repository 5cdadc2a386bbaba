"""A corpus pipeline: language ID, line dedup, near-duplicate removal, mixing and packing, each over all that the one before has kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. run() writes each
stage's result as Parquet in the shared folder and reads it back as the next one's docs.

Stages take the columns of documents alone: others, whatever their names, are dropped. An empty table gives an empty one. Rows that repeat
an id and text share their fate in every stage; rows that share an id but not a text are judged by text in the first two.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import langid, line_dedup, mixing, ngram_join, packing
from marlstone.llm.common import small, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that are no language's: null and empty texts, and those without letters to tell one from. lang becomes the identified
    language; a null lang or source is no evidence. A row with a null id is judged by its text like others."""
    docs = docs.select(*COLUMNS)
    key = F.xxhash64("text").alias("_h")
    found = langid.identify(docs.select("doc_id", key, "text", F.col("lang").alias("declared"), F.col("source").alias("host")))
    changed = found.where("not is_kept or declared is null or language <> declared").select(F.col("doc_id").alias("_id"), "_h", F.when(F.col("is_kept"), F.col("language")).alias("_to"), F.lit(True).alias("_seen"))
    changed = small(written(changed.dropDuplicates(["_id", "_h"]), "changed"))
    judged = docs.join(changed, docs.doc_id.eqNullSafe(changed["_id"]) & F.xxhash64(docs.text).eqNullSafe(changed["_h"]), "left")
    return judged.where("_seen is null or _to is not null").withColumn("lang", F.coalesce("_to", F.lower("lang"))).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of repeated runs of lines; a document of which no words are left by that goes. Documents with a null id or text
    stay as they are; n_chars is counted anew."""
    cleaned = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return cleaned.where("size(removed_lines) = 0 or text rlike '\\\\S'").withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of near copies (five-word shingles, likeness 0.8 or more). Texts without words are
    near nothing and stay, as do documents with a null id; rows that share an id stay or go together."""
    docs = docs.select(*COLUMNS)
    found = ngram_join.jaccard_components(docs, n=5, num=80, den=100)
    gone = small(written(found.where("component_id is not null and component_id <> doc_id").select("doc_id").distinct(), "gone"))
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents by Poisson numbers so that all sources get equal shares, in a globally shuffled order. A null source is one of its own;
    rows that share an id get the same number of copies."""
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens; a null or empty text is its end token alone."""
    return packing.pack(docs, size=1024, with_ids=True)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: SQL can't express the language model, components or packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
