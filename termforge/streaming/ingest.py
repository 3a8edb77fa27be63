"""Streams into the index, and stateful counterparts of the crawler's sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.types import StructType

from termforge.functions import urls as U
from termforge.sources.store import IndexStore


def read_files(spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int = 1, form: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(form).load(path)


def read_kafka(spark: SparkSession, servers: str, topic: str, schema: StructType | str, max_messages: int | None = None) -> DataFrame:
    """JSON messages of a topic, ``max_messages`` of them in a batch at most; needs the Kafka connector on the class path."""
    source = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest")
    raw = (source.option("maxOffsetsPerTrigger", max_messages) if max_messages else source).load()
    return from_json(raw, schema)


def from_json(raw: DataFrame, schema: StructType | str) -> DataFrame:
    """The columns of JSON in ``value``; what isn't JSON gives nulls.

    ``write_kafka`` writes what this reads.
    """
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("m")).select("m.*")


def write_kafka(messages: DataFrame, servers: str, topic: str) -> None:
    """Rows as JSON messages, acknowledged by all replicas."""
    as_json(messages).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("kafka.acks", "all").save()


def as_json(messages: DataFrame) -> DataFrame:
    return messages.select(F.to_json(F.struct(*messages.columns)).alias("value"))


def ingest(stream: DataFrame, store: IndexStore, checkpoint: str, on_batch: Callable[[DataFrame], None] | None = None):
    """Each micro-batch becomes one segment; runs until what is there now is read."""

    def write(batch: DataFrame, _: int) -> None:
        batch.persist()
        if not batch.isEmpty():
            store.add(batch)
            store.merge_if_needed()
            if on_batch:
                on_batch(batch)
        batch.unpersist()

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def unseen_urls(stream: DataFrame) -> DataFrame:
    """Rows whose normalised URL did not come before."""
    return stream.withColumn("norm_url", U.normalize_url(F.col("url"))).dropDuplicates(["norm_url"])


def polite(stream: DataFrame, delay_ms: int) -> DataFrame:
    """(host, url, fetch_at): urls (url, at_ms) of a host get times that are ``delay_ms`` apart, across batches.

    A column ``delay_ms`` of the stream, where it isn't null, counts instead: the host's own delay, say of its robots file.
    """

    def plan(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        free = state.get[0] if state.exists else 0
        for pdf in batches:
            rows = []
            for at, url, own in sorted(zip(pdf["at_ms"], pdf["url"], pdf["delay_ms"])):
                at = max(int(at), free)
                rows.append((key[0], url, at))
                free = at + int(own)
            yield pd.DataFrame(rows, columns=["host", "url", "fetch_at"])
        state.update((free,))

    delay = F.coalesce(F.col("delay_ms"), F.lit(delay_ms)) if "delay_ms" in stream.columns else F.lit(delay_ms)
    named = stream.select(U.host(F.col("url")).alias("host"), "url", "at_ms", delay.cast("bigint").alias("delay_ms"))
    return named.groupBy("host").applyInPandasWithState(plan, "host string, url string, fetch_at bigint", "free bigint", "append", "NoTimeout")
