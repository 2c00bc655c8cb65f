"""A corpus pipeline from raw documents to packed sequences.

Stages, each over all that the one before it kept: drop toxic documents, keep one of each group of
near copies, mask secrets, mix sources to target weights, pack into sequences.  Every stage's result
is written as Parquet to the folder that driver and executors share and read again, so a lost
executor repeats tasks of one stage only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import Scratch, table
from gridloom.llm.mixing import DOMAIN_SQL, mixture
from gridloom.llm.ngram_join import keep_one_of_each
from gridloom.llm.packing import pack_best_fit
from gridloom.llm.queries import default_tokenizer
from gridloom.llm.secrets import redact
from gridloom.llm.toxicity import drop_toxic, fit

#: Target mixture of the pipeline: weights of the domains; languages and sources share evenly.
WEIGHTS = {("web",): 3, ("news",): 3, ("forum",): 2, ("books",): 2}
SHARE = (9, 10)
MAX_EPOCHS = 2
SEED = 42


def _with_length(docs: DataFrame) -> DataFrame:
    """n_chars, where the table has it, follows the text; that of a null text stays."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))


# Every stage returns the columns of its input (the last one those of pieces), gives no rows for an
# empty table, and takes rows that repeat, or have no id, one by one unless it says otherwise.


def drop_toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones, does not reject.

    Null and empty texts are judged as texts without words; without labels of both kinds all stay.
    """
    return drop_toxic(docs, fit(docs, table(spark, sf_dir, "labels")))


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by Jaccard similarity 0.8 or more on five-word shingles.

    The row with the smallest id stays; null and empty texts are linked with nothing and stay.
    """
    return keep_one_of_each(docs, words=5, percent=80, by_row=True)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with secrets masked; n_chars follows the text, a null text stays null."""
    return _with_length(redact(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by target weights; one that is taken in several epochs is there as often.

    Where a source's budget ends within a document, that document is cut there.  Nulls in lang or
    source count as 'unknown'; rows of one id in one source are taken together.
    """
    rows, _ = mixture(docs, F.expr(DOMAIN_SQL), WEIGHTS, SHARE, MAX_EPOCHS, SEED, detail=False)
    return _with_length(rows)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents placed in sequences of 1024 tokens; a null or empty text is its end id alone."""
    return pack_best_fit(docs, default_tokenizer(), capacity=1024, end_id=2)


STAGES = [
    ("toxicity", drop_toxic_documents),
    ("ngram_jaccard_join", keep_one_copy),
    ("secret_scans", mask_secrets),
    ("mixing", mix_sources),
    ("best_fit_packing", pack),
]

#: The first stage is a trained classifier, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, from the documents of sf_dir; no documents give no rows."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
