"""The registered queries of this package: thin digests of the operators over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.llm.oracles import ORACLE_SQL  # noqa: F401  read with QUERIES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sha256(column: str) -> Column:
    return F.sha2(F.col(column).cast("binary"), 256)


def word_tokenizer_spec() -> dict:
    """The public word-end tokenizer's file, read where it is installed."""
    import public_tokenizers

    from lakewright.llm.bpe import load_spec

    return load_spec(public_tokenizers.path("word_bpe_49k.json"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakewright.llm.bpe import encode

    out = encode(table(spark, sf_dir, "documents"), word_tokenizer_spec())
    return out.select("doc_id", "n_tokens", sha256("ids").alias("ids_sha256"), sha256("decoded").alias("decoded_sha256"))


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakewright.llm.ngram_join import ngram_jaccard_join

    return ngram_jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "n_links", "component_id")


def op2_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakewright.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakewright.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakewright.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakewright.llm.substring import remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", sha256("kept_text").alias("kept_sha256"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakewright.llm.chat import format_conversations, probe, read_back

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(format_conversations(rows.unionByName(probe(spark))))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    from lakewright.llm.session import checkpoint_dir
    from lakewright.llm.warc import load_archives, read_archives, save_archives, write_archives

    folder = f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    save_archives(write_archives(table(spark, sf_dir, "pages")), folder)
    return read_archives(load_archives(spark, folder))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakewright.llm.language import fit, fold, predict

    docs = table(spark, sf_dir, "documents")
    out = predict(docs, fit(docs))
    return out.select("doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lakewright.llm.token_counts import count_tokens

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = f.read()
    return count_tokens(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakewright.llm.fim import fill_in_middle, restore

    out = fill_in_middle(table(spark, sf_dir, "documents")).withColumn("restored", restore(F.col("output"), F.col("form")))
    return out.select("doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"), sha256("output").alias("output_sha256"), sha256("restored").alias("restored_sha256"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakewright.llm.license_scan import scan_licenses

    out = scan_licenses(table(spark, sf_dir, "documents"))
    starts, named, held = F.col("phrases.start"), F.col("phrases.label"), F.col("blocks.label")
    score = F.greatest(F.when(F.size("phrases") > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max("blocks.containment"), F.lit(0.0)))
    return out.select(
        "doc_id", "n_words", F.size("phrases").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(named)), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(named, held)), ",").alias("labels"), score.alias("score"),
    )


def op13_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakewright.llm.spelling import occurrences, spelling_groups

    return spelling_groups(occurrences(table(spark, sf_dir, "documents"), slip_one_in=97))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_embedding_neardup": op2_embedding_neardup,
    "op3_bpe": op3_bpe,
    "op4_mixing": op4_mixing,
    "op5_topk": op5_topk,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_chat": op7_chat,
    "op8_warc": op8_warc,
    "op9_language": op9_language,
    "op10_token_counts": op10_token_counts,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_license_scan": op12_license_scan,
    "op13_spelling_groups": op13_spelling_groups,
}
