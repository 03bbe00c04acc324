"""From raw documents to packed training bins: five stages, each on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from neurospan.llm import exact_dedup, jaccard_join, kneser_ney, mixing, packing
from neurospan.llm.common import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Kneser-Ney classifier keeps; trusted text is what labels marks as good.

    Null and empty texts go, as they have no perplexity. A document at its language's threshold
    stays; a null language has the threshold of all languages. Rows that repeat are judged alike, each
    by its own text, and a label holds for all rows with its doc_id. Without trusted text all but
    empty documents stay; an empty table stays empty.
    """
    return kneser_ney.drop_rejected(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the largest doc_id.

    Null counts as empty text, so nulls and empties are one group. Of rows equal in id and text one
    stays; a null doc_id goes where another row has its text. Rows that repeat an id with another
    text are judged by their own.
    """
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: the one with the smallest doc_id.

    Null and empty texts are no copies and stay. Each row is judged by its own text, whatever other
    rows repeat its doc_id; a null doc_id goes where its set of shingles has another id.
    """
    return jaccard_join.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their weights: a document appears as often as the mix takes it.

    Null texts have size 0; texts without words have only the whole copies of their source. A null
    source is a source, the last. Ties in rank go by doc_id; rows equal in id and text share a rank.
    """
    return mixing.mixed_copies(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of training text: one row for each piece of a document.

    A null or empty text gives one row without a bin. Rows that repeat a text never share a bin; ties
    in size go by doc_id, piece and row. A null source is a source.
    """
    return packing.pack(docs)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mix", mix), ("pack", pack)]

#: SQL can't express the classifier, the sampling's ranks within it, or best-fit packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each stage's rows written before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
