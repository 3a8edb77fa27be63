"""The labelled documents that the trained operators fit on: all of them, or a bounded sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termforge.llm.common import identified

#: Labelled documents that a model is fitted on, at most; the rest of the labels is not read by it.
TRAIN_ROWS = 20_000


#: Labelled documents up to which their numbers are broadcast; beyond, what was made of the texts is shuffled, not the texts.
BROADCAST_ROWS = 1_000_000


def marks(labels: DataFrame) -> DataFrame:
    """(__id, quality, toxic) of each labelled doc_id.

    Several labels of one document count as its least quality and greatest toxicity; a
    missing toxicity is 0, and labels without quality or doc_id are ignored.
    """
    known = labels.select(
        F.col("doc_id").cast("bigint").alias("__id"), F.col("quality").cast("int"), F.coalesce(F.col("toxic").cast("int"), F.lit(0)).alias("toxic")
    ).where("__id IS NOT NULL AND quality IS NOT NULL")
    return known.groupBy("__id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))


def labelled_documents(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, text, quality, toxic) of at most ``most`` labelled documents, picked by hash.

    The sample is bounded by ``most``, so its side of the join is broadcast.
    """
    picked = marks(labels).orderBy(F.xxhash64("__id"), "__id").limit(most)
    texts = identified(docs)
    return texts.join(F.broadcast(picked), texts["doc_id"] == picked["__id"]).drop("__id")
