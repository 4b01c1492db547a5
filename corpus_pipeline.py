"""From raw documents to token digests: five stages, each on all that the one before kept.

language  documents without a letter, or that no language fits, go
lines     lines of templates that recur across documents go, and documents that lose all their text
near      of near duplicates the document with the smallest id stays
mix       documents are drawn as often as the target weights of the domains ask for
pieces    what is left is encoded and decoded with SentencePiece

Documents without a text go in the first stage; rows that share an id are told apart by their texts in
lines and near; repeated rows are copies, of which near keeps one. Texts are read whole whatever their
length. Further columns of ``documents`` are carried up to the last stage; names that begin with two
underscores are the stages' own. An empty table goes through as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.language import UNKNOWN, fit, held_out, label_documents
from lodestone.llm.lines import dedup_lines
from lodestone.llm.mixing import TARGET, mixed_documents, quality_domain
from lodestone.llm.near import keep_one
from lodestone.llm.pieces import encode_documents, model_path
from lodestone.session import materialize, table

#: A document whose mean probability of its language is lower is in none of the languages learnt
#: (with four of them 0.25 says nothing).
LEAST_LANGUAGE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn the languages from the labelled rows and drop what is in none of them."""
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    rows = label_documents(docs, model, docs.columns, names=("__lang", "__score"))
    weak = (F.col("__lang") != UNKNOWN) & (F.col("__score") < LEAST_LANGUAGE)
    return rows.where(F.col("text").rlike(r"\p{L}") & ~weak).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut recurring lines; ``n_chars`` follows the text."""
    rows = dedup_lines(docs)
    lost = F.col("__n_dropped") > 0
    rows = rows.where(~lost | (F.trim("text") != "")).withColumn("n_chars", F.when(lost, F.length("text")).otherwise(F.col("n_chars")).cast("long"))
    return rows.select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs, table(spark, sf_dir, "labels"), quality_domain(), TARGET)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_documents(docs, model_path())


STAGES = [("language", language), ("lines", lines), ("near", near), ("mix", mix), ("pieces", pieces)]

#: Language and near duplicates have no SQL form; the stages' operators are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
