"""From raw documents to packed training sequences: five operators, each on all that its predecessor kept.

1. toxicity: documents that the classifier scores at the threshold or above go.
2. line dedup: lines of recurring templates are cut wherever but in their first document; documents stay.
3. SimHash near-dedup: of each group of near copies the document with the smallest id stays.
4. benchmark decontamination: contaminated documents go; smaller overlaps are cut out.
5. best-fit packing: token pieces with ids, each with its sequence and its place there.

All stages but the last return the columns that they are given. SQL can't express a trained classifier, XXH64
fingerprints or a tokenizer, so there is no ORACLE_SQL: tests compare the pipeline with a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from courier.llm import decontaminate, line_templates, packing, simhash, toxicity
from courier.llm.common import cut_table, table
from courier.llm.registry import tokenizer_path


def recounted(docs: DataFrame) -> DataFrame:
    """n_chars of the text as it now is."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return recounted(line_templates.drop_templates(docs, grouped=True))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return recounted(decontaminate.remove(docs, table(spark, sf_dir, "benchmark")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path(), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", cut_lines),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table; what a stage returns is written and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
