"""From raw documents to placed training sequences: five stages, each written as Parquet and reread by the next.

In every stage a null text counts as empty, repeated rows are documents of their own unless the stage says otherwise, texts
of any length are read whole, an empty table gives an empty one, and columns beside doc_id and text go along unread,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logweave.llm import decontamination, packing, pii, quality, simhash
from logweave.llm.common import cut, table
from logweave.llm.queries import WORD_BPE


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, does not reject.

    Equal texts have equal scores, so repeated rows stay or go together; a score at the threshold stays. Without labels of
    both classes all have the share of good labels (one half for no labels), so all stay or all go.
    """
    return quality.keep(docs, quality.train(*quality.sample(docs, table(spark, sf_dir, "labels"))))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of least hash of id and text, of rows equal in both one.

    Candidates come from SimHash fingerprints at two bits, and edited copies beyond these from bands of least hashes; each is
    verified. Empty texts are one group; a null id is an id like any other.
    """
    return simhash.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark passage; items without an id or a text are none, repeated items are one."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by pseudonyms, equal values by equal ones; null texts stay null."""
    return pii.pseudonymise_column(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces of all documents in sequences; an empty text is its end mark alone, repeated rows are packed
    once each."""
    return packing.pack_documents(docs, WORD_BPE, with_ids=False)


STAGES = [
    ("quality_classifier", keep_quality),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("pii_pseudonyms", hide_personal_data),
    ("best_fit_packing", pack),
]
#: The stages train a network, count shingle sets and fit least squares, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = cut(docs)
    return docs
