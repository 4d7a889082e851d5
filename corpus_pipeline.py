"""From raw documents to token files: five stages, each one operator.

| stage | operator | decision |
|---|---|---|
| language_id | 4 | documents without a known language go: no text, no letter, or no learned language codes them below 8 bits a byte |
| near_duplicates | 5 | one document of each class stays |
| decontaminate | 8 | documents that hold a benchmark item go |
| mix_sources | 3 | documents stand as often as their source's target takes them |
| token_files | 6 | ids in Arrow files; the result is read back from them |

All stages but the last return the columns of the documents they got. Every stage's result is written as
Parquet in the session's shared folder and read again, so a lost executor never costs more than the running stage.

Defined cases: null and empty texts go in the first stage; rows with a null id pass the near-duplicate stage;
rows that share an id stay or go together there, and are judged singly by the others; an empty table gives an
empty result; extra columns are kept to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plurivote.llm import decontaminate, language_id, mixing, near_duplicates, token_files
from plurivote.llm.queries import tokenizer_text
from plurivote.session import scratch_path

UNCODED = 8.0  # bits per byte of a text that no learned statistics fit


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: drop what has no language."""
    found = language_id.identify(docs, language_id.fit(docs), into="_language")
    known = (F.col("_language.lang_pred") != language_id.NO_LANGUAGE) & (F.col("_language.bits_per_byte") < UNCODED)
    return found.where(known).drop("_language")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: one document of each near-duplicate class."""
    return near_duplicates.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: drop documents that hold an item of the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.flagged(docs, benchmark, into="_leak").where("NOT _leak").drop("_leak")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: every document as often as the mix takes it."""
    return mixing.repeat_documents(docs, mixing.mix(docs))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: token files, read back as one row per document."""
    return token_files.read_documents(token_files.write_token_files(docs, tokenizer_text("word_bpe_49k.json")))


STAGES = [
    ("language_id", keep_known_languages),
    ("near_duplicates", keep_one_of_each),
    ("decontaminate", drop_contaminated),
    ("mix_sources", mix_sources),
    ("token_files", write_tokens),
]

# Language identification and the tokenizer are not SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
