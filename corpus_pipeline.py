"""The corpus pipeline: language ID, near duplicates, repeated passages, mixing, tokenization.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before kept. ``run`` writes each
stage's result as Parquet in the shared checkpoint folder and reads it again for the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.llm import bpe, language, mixing, ngram_join, substring
from lakewright.llm.queries import sha256, word_tokenizer_spec
from lakewright.llm.session import checkpoint_dir, cut

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: A predicted language's posterior probability from which on a document is kept.
LEAST_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with an identified language: null and letterless texts go, and those whose code is much
    longer than usual in the likeliest language (noise, keys, numbers), or of no likely language at all."""
    return language.keep_identified(docs.select(*COLUMNS), language.fit(docs), least_score=LEAST_SCORE)


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a row_key of each row: doc_id where ids are unique and not null, else places in the
    order of id (null ids last) and text, checkpointed so that all uses see the same keys."""
    docs = docs.select(*COLUMNS)
    if docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null").isEmpty():
        return docs.withColumn("row_key", F.col("doc_id"))
    return cut(docs.orderBy(F.col("doc_id").asc_nulls_last(), "text").withColumn("row_key", F.monotonically_increasing_id()))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the least id of each component of similar documents; null ids come last, rows of
    one id are documents of their own."""
    keyed = _keyed(docs)
    rows = ngram_join.ngram_jaccard_join(keyed, id_col="row_key")
    kept = rows.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("row_key"))
    return keyed.join(kept, "row_key", "left_semi").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove words of passages that a document of smaller id has; documents with nothing left go."""
    out = substring.remove_repeats(docs, keep_columns=("lang", "source", "n_chars"))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    out = out.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return out.select("doc_id", text.alias("text"), "lang", "source", n_chars.alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; rows of null or repeated ids have copies of their own."""
    keyed = _keyed(docs)
    copies = mixing.mix(keyed, id_col="row_key").filter("copies > 0").select(F.col("doc_id").alias("row_key"), "copies")
    taken = keyed.join(copies, "row_key")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every copy, with digests of ids and decoded text."""
    out = bpe.encode(docs, word_tokenizer_spec())
    return out.select("doc_id", "n_tokens", sha256("ids").alias("ids_sha256"), sha256("decoded").alias("decoded_sha256"))


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; a stage's input goes once its result is written."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            _remove(spark, f"{folder}/{k - 1}")
    return docs


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: SQL can't express language models, tokenization or random rounding; the stages are tested by brute force.
ORACLE_SQL = None
