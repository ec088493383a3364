"""Queries `op<N>_<name>` over the document tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narrascope.functions.sizing import scratch_path
from narrascope.llm import (
    align, chat, class_lm, decontaminate, html_render, importance, jaccard, packing, piece_counts, pii, quality_rules,
    token_files, vector_codes,
)
from narrascope.llm.common import stored
from narrascope.llm.oracle import SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_jaccard_join(spark, folder):
    return jaccard.near_duplicates(table(spark, folder, "documents"), width=3, percent=90)


@query
def op2_html_render(spark, folder):
    return html_render.visible_text(table(spark, folder, "pages"))


@query
def op3_packing(spark, folder):
    pieces = packing.pack(table(spark, folder, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op4_importance(spark, folder):
    return importance.resample(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op5_quality_rules(spark, folder):
    judged = quality_rules.verdicts(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return judged.select("doc_id", *quality_rules.COUNTS, "base_failed", "kept")


@query
def op6_class_lm(spark, folder):
    return class_lm.score(table(spark, folder, "documents"))


@query
def op7_decontamination(spark, folder):
    found = decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.drop("items", "spans")


@query
def op8_piece_counts(spark, folder):
    return piece_counts.token_counts(table(spark, folder, "documents"))


@query
def op9_pii(spark, folder):
    return pii.digest(pii.find(table(spark, folder, "documents")))


@query
def op10_token_files(spark, folder):
    path = scratch_path(spark, "token-files")
    token_files.write(table(spark, folder, "documents"), path)
    found = token_files.read(spark, path)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"), "occurrence")


@query
def op11_alignment(spark, folder):
    return align.align(table(spark, folder, "documents"))


@query
def op12_vector_codes(spark, folder):
    codes, books = vector_codes.compress(table(spark, folder, "embeddings"))
    found = vector_codes.with_label_errors(codes)
    return found.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


@query
def op13_chat_format(spark, folder):
    own = "select -7L conv_id, t turn, if(t = 0, 'user', 'assistant') role, '</s>[INST] ok [/INST]' text from range(2) r(t)"
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    # Stored, so that the digests are read back from the written output.
    chats = stored(chat.format_chats(turns.union(spark.sql(own))), "chats")
    return chat.digest(chats)


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    return dict(SQL)
