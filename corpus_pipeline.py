"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again as the next one's input.

Every stage works on all that its predecessor kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from storyloom.llm import decontaminate, mixing, nearcopies, tokens, toxicity
from storyloom.llm.common import Scratch, made, release, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents whose chance of being toxic is over one half go.

    Null and empty texts are not toxic. Rows without an id are not judged and stay; rows that share an id go together if
    one of them is rejected. Labels without an id or a grade don't count; without labels of both kinds all stay.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5, verified on five-word shingles: of each group of copies the document with the smallest id stays.

    Texts without words (null, empty, blank) are copies of each other; shorter ones than a shingle count as one. Of rows
    that share an id the one with the smallest text stays. Rows without an id take no part and stay.
    """
    return nearcopies.one_of_each_group(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that hold four fifths or more of a test item's five-word shingles go.

    Null, empty and shorter texts hold none, and items of fewer words are held by none. Rows that share an id are one
    document. Rows without an id are not tested and stay. Without items all stay.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: a sample whose tokens follow the target shares of source, language and topic.

    Null and empty texts have no tokens; a null source or language is a category of its own. Whether a row stays hangs on
    its id and its cell alone, so that repeated rows stay or go together; rows without an id count as one id.
    """
    return mixing.sample(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: token ids in flat files; returns what the files hold, a row for each row of docs.

    Null and empty texts are the end id alone. Null ids come first, repeated rows stay repeated; an empty table has no files.
    """
    return tokens.token_dataset(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", token_output),
]
#: The toxicity model and SimHash can't be written in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        mark = made()
        docs = scratch.write(f"stage-{k}", stage(spark, docs, sf_dir))
        release(spark, mark)
        if k:
            scratch.drop(f"stage-{k - 1}")
    return docs
