"""The ``opN_<name>`` queries over the given tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeline.llm import oracles
from citeline.llm.alignment import token_links
from citeline.llm.chat import format_chats, read_back
from citeline.llm.decontaminate import leaks
from citeline.llm.licenses import scan_licenses
from citeline.llm.line_dedup import dedup_lines
from citeline.llm.mixing import mix_sources
from citeline.llm.ngram_join import ngram_components
from citeline.llm.packing import pack
from citeline.llm.pii import KINDS, sanitise
from citeline.llm.prefix_trie import prefix_trie
from citeline.llm.substring_dedup import repeated_passages
from citeline.llm.topk import top_k
from citeline.llm.toxicity import held_out, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLE[name] = sql
        return build
    return register


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base.rstrip('/')}/{name}.parquet")


@query("op1_mix_sources", oracles.MIX)
def op1_mix_sources(spark: SparkSession, base: str) -> DataFrame:
    docs = table(spark, base, "documents").select("doc_id", "source")
    return mix_sources(docs, alpha=0.5, block_docs=16)


@query("op2_substring_dedup")
def op2_substring_dedup(spark: SparkSession, base: str) -> DataFrame:
    return repeated_passages(table(spark, base, "documents"), min_words=50, percent=75)


@query("op3_line_dedup", oracles.LINES)
def op3_line_dedup(spark: SparkSession, base: str) -> DataFrame:
    rows = dedup_lines(table(spark, base, "documents").select("doc_id", "text"), min_words=50)
    return rows.select("doc_id", "n_lines", "n_removed",
                       F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


@query("op4_ngram_join", oracles.NGRAMS)
def op4_ngram_join(spark: SparkSession, base: str) -> DataFrame:
    return ngram_components(table(spark, base, "documents"), n=5, percent=75)


#: A conversation whose texts look like control strings, besides those of the table.
CONTROL_CHAT = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


@query("op5_chat_format")
def op5_chat_format(spark: SparkSession, base: str) -> DataFrame:
    turns = table(spark, base, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(CONTROL_CHAT, turns.schema)
    return read_back(format_chats(turns.union(extra), budget=1024, history=256))


@query("op6_toxicity")
def op6_toxicity(spark: SparkSession, base: str) -> DataFrame:
    docs = table(spark, base, "documents").select("doc_id", "text")
    scored = toxicity(docs, table(spark, base, "labels"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


@query("op7_top_k", oracles.TOP_K)
def op7_top_k(spark: SparkSession, base: str) -> DataFrame:
    return top_k(table(spark, base, "embeddings"), k=10, scale=1024, every=100)


@query("op8_pii")
def op8_pii(spark: SparkSession, base: str) -> DataFrame:
    rows = sanitise(table(spark, base, "documents"))
    base_spans = F.filter("spans", lambda s: s["kind"] != "term")
    joined = lambda spans: F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", *(count(kind) for kind in KINDS if kind != "term"),
                       F.sha2(joined(base_spans), 256).alias("base_sha256"), joined("spans").alias("spans"))


@query("op9_decontaminate", oracles.LEAKS)
def op9_decontaminate(spark: SparkSession, base: str) -> DataFrame:
    return leaks(table(spark, base, "documents"), table(spark, base, "benchmark"), n=5, percent=75)


@query("op10_license_scan")
def op10_license_scan(spark: SparkSession, base: str) -> DataFrame:
    return scan_licenses(table(spark, base, "documents")).drop("detections")


@query("op11_align_tokenizers")
def op11_align_tokenizers(spark: SparkSession, base: str) -> DataFrame:
    docs = table(spark, base, "documents").select("doc_id", "text")
    return token_links(docs, byte_bpe="byte_bpe_50k.json", piece_bpe="piece_bpe_32k.model")


@query("op12_pack")
def op12_pack(spark: SparkSession, base: str) -> DataFrame:
    docs = table(spark, base, "documents").select("doc_id", "text")
    return (pack(docs, tokenizer="byte_bpe_50k.json", end_id=1, capacity=2048)
            .withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


@query("op13_prefix_trie", oracles.TRIE)
def op13_prefix_trie(spark: SparkSession, base: str) -> DataFrame:
    return prefix_trie(table(spark, base, "conversations"))
