"""A corpus pipeline of four operators: language ID, toxicity, SimHash near-dedup, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from viaduct.llm import langid, packing, simhash, toxicity
from viaduct.llm.common import every_column, fresh, read_table
from viaduct.llm.queries import remainder, tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is determined: not ``und`` and not ambiguous.

    Null texts and texts without a letter are ``und`` and go; null ids and repeated rows are judged
    like any other; an empty table gives no rows; all columns stay as they are, whatever their names.
    """
    model = langid.fit(docs.where(remainder(4) != 2))
    verdict = fresh("verdict", docs)
    found = langid.identify(docs, model, into=verdict)
    return found.where(f"{verdict}.lang_pred <> 'und' AND NOT {verdict}.ambiguous").select(*every_column(docs))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that are not predicted toxic.

    Null and empty texts match nothing and stay; null ids and repeated rows are judged like any
    other; an empty table gives no rows; all columns stay as they are, whatever their names.
    """
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels").where(remainder(5) != 0))
    verdict = fresh("verdict", docs)
    return toxicity.score(docs, model, into=verdict).where(f"{verdict}.predicted = 0").select(*every_column(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates.

    Null and empty texts are one group; null ids come after all others; of rows equal in id and text
    one stays; an empty table gives no rows; all columns stay as they are, whatever their names.
    """
    return simhash.keep_first(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 1024 tokens.

    Null text: the closing id alone; null ids and repeated rows are packed as documents of their own;
    an empty table gives no rows; other columns than the id and the text are not read.
    """
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Stage]] = [("language_id", language), ("toxicity", toxic), ("simhash_dedup", near_dedup), ("packing", pack)]

#: SQL can express neither the learned stages nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to the documents, one after the other."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
