"""A training corpus from raw documents: five stages, each over all that the one before kept.

``STAGES`` lists name and function of each stage; a function takes the session, the documents so far and the folder of the
tables, and returns the documents it keeps (the last one: the packed pieces).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulmark.llm.common import materialize
from haulmark.llm.mixing import mix
from haulmark.llm.ngram_join import set_decisions, with_set
from haulmark.llm.packing import pack
from haulmark.llm.quality_classifier import quality_classifier
from haulmark.llm.quality_rules import quality_rules
from haulmark.llm.queries import table, tokenizer_path
from haulmark.session import prepare


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.5 or more.

    Null and empty texts have the score the trees give to a text without words. Each row is judged alone, so repeated rows and
    null keys share one fate; columns that carry the name of a result are those of the documents. An empty table stays empty.
    """
    prepare(spark)
    scored = quality_classifier(docs, table(spark, sf_dir, "labels"))
    return scored.filter("predicted = 1").select(docs.columns)


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects.

    Null and empty texts have no words and are rejected. Each row is judged alone, so repeated rows and null keys share one
    fate. An empty table stays empty.
    """
    prepare(spark)
    return quality_rules(docs).filter("kept").select(docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: word 5-grams, Jaccard similarity of 0.8 or more.

    The one with the smallest ``doc_id``, null last, stays; under one key (null is one) each set of n-grams is decided for
    itself, and of rows alike in both the smallest text stays. Documents without words link with nothing and stay; those
    that repeat a key and text are one. An empty table stays empty.
    """
    prepare(spark)
    rows = materialize(set_decisions(docs, 5, 4, 5), "pipeline-groups")
    keys = rows.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.bool_or("stays").alias("__stays"), F.count("*").alias("__rows"))
    # Only keys that go, or repeat, are joined to the texts; their own table tells Spark how few they are.
    special = materialize(keys.filter("NOT __stays OR __rows > 1"), "pipeline-special")
    keyed = docs.filter("doc_id IS NOT NULL").join(special, "doc_id", "left").filter("__stays IS NULL OR __stays")
    single = keyed.filter("__rows IS NULL").select(docs.columns)
    # One row of each key and set, before its shuffle, so that copies of a hot key or of null fold in the tasks.
    several = with_set(keyed.filter("__rows IS NOT NULL").select(docs.columns).unionByName(docs.filter("doc_id IS NULL")), 5, "__set")
    row = F.struct("text", *[c for c in docs.columns if c != "text"])
    folded = several.filter("__set IS NOT NULL").groupBy("doc_id", "__set").agg(F.min(row).alias("__row"))
    stay = rows.filter("stays AND sid IS NOT NULL").select(F.col("doc_id").alias("__id"), F.col("sid").alias("__sid")).distinct()
    one = folded.join(stay, (F.col("__set") == F.col("__sid")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    empty = several.filter("__set IS NULL").select(docs.columns)
    empty = empty.filter("doc_id IS NULL").unionByName(empty.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"]))
    return single.unionByName(one.select(*[F.col(f"__row.{c}").alias(c) for c in docs.columns])).unionByName(empty)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents the mix takes, each as often as it takes it.

    A null source is one source, the last. Null and empty texts have no words and are never taken. Rows of one key or
    without a key are drawn apart, those alike in every column by their number. An empty table stays empty.
    """
    prepare(spark)
    mixed = mix(docs).filter("copies > 0")
    return mixed.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents in sequences of 2048 tokens.

    Null and empty texts are the closing token alone; null keys and repeated rows are packed like any other; an empty table
    gives no pieces.
    """
    prepare(spark)
    return pack(docs, tokenizer_path())


STAGES = [
    ("quality classifier", classify),
    ("quality rules", apply_rules),
    ("n-gram Jaccard join", deduplicate),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can express neither the trees nor the mix nor the tokens; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again by the next."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
