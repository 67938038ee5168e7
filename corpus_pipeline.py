"""The corpus pipeline: language, near-duplicates, contamination, mixture, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and
read back as the next stage's docs. All but the last return the columns of
documents. Rows that a stage takes out are gone for the next ones:

1. ``language`` drops documents in which no language is recognised (null or
   without a letter) and writes the language recognised into ``lang``; if no text has a
   language to learn from, the others stay with ``lang`` as it is;
2. ``near_duplicates`` keeps one document of each group (five words, similarity 0.8);
3. ``decontamination`` drops documents of which a twentieth or more is benchmark text;
4. ``mixture`` takes words of each source to its target weight: a row for each pass
   over a document, cut to the words taken;
5. ``token_ids`` writes the mixture as Huffman-coded token files and returns, from
   these files, each row's doc_id, start, n_tokens and ids_crc32.

An empty table passes through every stage as an empty table. Repeated rows are near-duplicates of
each other; of rows that share a kept id one stays, chosen by its hash. Columns that documents doesn't
have pass through, whatever their names: a row travels as one struct beside a stage's own columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.decontaminate import clean_documents
from gridloom.llm.langid import UNDETERMINED, score, train
from gridloom.llm.mixing import mix
from gridloom.llm.neardup import one_of_each
from gridloom.llm.shared import materialize, packed
from gridloom.llm.tokens import token_output


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = train(docs.select("doc_id", "text", "lang"))
    if model is None:
        return docs.where(F.col("text").cast("string").rlike(r"\p{L}"))
    plain = dict(docs.dtypes).get("text") == "string"
    rows = docs.select(packed(docs).alias("row"), *([] if plain else ["text"]))
    kept = score(rows, model, ["row"], "row" if plain else None).where(F.col("lang_pred") != UNDETERMINED)
    return kept.select(*[(F.col("lang_pred") if c == "lang" else F.col("row")[c]).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs).documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_output(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixture", mixture), ("token_ids", token_ids)]

#: The tokenizer and the trained model aren't SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
