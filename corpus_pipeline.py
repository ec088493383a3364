"""A corpus from raw documents to packed token sequences, one operator of `narrascope.llm` per stage."""

from __future__ import annotations

from narrascope.functions.sizing import scratch_path
from narrascope.llm import decontaminate, jaccard, packing, pii, quality_rules


def good_documents(spark, docs, sf_dir):
    """Documents that pass the base rule and the certified cutoffs."""
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each_group(spark, docs, sf_dir):
    """Of documents connected by 5-word shingle sets of similarity 0.8 the one with the smallest id."""
    return jaccard.keep_one(docs, width=5, percent=80)


def clean_of_benchmark(spark, docs, sf_dir):
    """Documents without a word inside a benchmark window."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redacted(spark, docs, sf_dir):
    """Documents with personal data replaced by its kind."""
    return pii.redact(docs)


def packed(spark, docs, sf_dir):
    """Pieces of the documents' token ids in sequences of 1,024."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", good_documents),
    ("near_duplicates", one_of_each_group),
    ("decontamination", clean_of_benchmark),
    ("pii", redacted),
    ("packing", packed),
]

#: The cutoffs of the first stage come from exact binomial tests, which SQL cannot express.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over `documents`; each is stored and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
