"""Streaming twins: new pages are normalised, hashed and kept once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.html import lang_of, text_of, title_of
from ..functions.text import content_hash
from ..functions.urls import netloc, normalize

#: The state store of a session, and the one for keys that do not fit in memory.
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def page_stream(pages: DataFrame) -> DataFrame:
    """A stream of (page_id, url, html) with normalised url, title, lang and text; stateless."""
    body = text_of(F.col("html"))
    return pages.select("page_id", normalize(F.col("url")).alias("url"), title_of(F.col("html")).alias("title"), lang_of(F.col("html")).alias("lang"), body.alias("text"), content_hash(body).alias("content_hash"))


def first_of_content(stream: DataFrame, key: str = "content_hash", order: str = "page_id") -> DataFrame:
    """The rows of a stream whose key was in no batch before; of a batch's rows of one key the first by `order`.

    Keys are state: a batch meets the state of its own keys, whatever was kept before. A key's rows are read in
    parts, so it may hold any share of a batch.
    """

    def keep(_, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, best = state.exists, None
        for part in parts:
            if not known and len(part):
                first = part.sort_values(order, kind="stable", na_position="last").head(1)
                best = first if best is None else pd.concat([best, first]).sort_values(order, kind="stable", na_position="last").head(1)
        if best is not None:
            state.update((True,))
            yield best

    return stream.groupBy(key).applyInPandasWithState(keep, stream.schema, "known boolean", "append", GroupStateTimeout.NoTimeout)


def keep_first(stream: DataFrame, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Appends pages whose content was in no page before to the Parquet table `out`.

    The hashes of kept pages are keyed state in RocksDB, backed up in the checkpoint: what a batch costs does not grow with what was
    kept. A batch that runs again gives the same files.
    """
    conf = stream.sparkSession.conf
    before = conf.get(PROVIDER)
    conf.set(PROVIDER, ROCKS)  # a query takes its store from the session that starts it
    try:
        kept = first_of_content(stream)
        return kept.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    finally:
        conf.set(PROVIDER, before)


def site_counts(stream: DataFrame, time: str, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Pages per host and window of a stream (url, time), closed when the watermark passes."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), netloc(F.col("url")).alias("netloc")).agg(F.count(F.lit(1)).alias("pages"))
