"""Queries over growing captures with Structured Streaming."""

from __future__ import annotations

import os
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from netloom.operators.aggregates import address_key, with_proto
from netloom.plans.filters import packet_filter
from netloom.sources.pcap import register

SPOOL = "netloom-spool-"


def live_packets(spark: SparkSession, folder: str, max_bytes: int = 64 << 20, checkpoint: str = "") -> DataFrame:
    """Dissected packets of the captures that grow in a folder; with a checkpoint, from where its query stopped."""
    register(spark)
    return spark.readStream.format("pcap").option("path", folder).option("max_bytes", max_bytes).option("checkpoint", checkpoint).option("dissect", "true").load()


def append_to_table(spark: SparkSession, folder: str, table: str, checkpoint: str, text: str | None = None, max_bytes: int = 64 << 20, interval: str = "1 second") -> StreamingQuery:
    """Follow a folder into a Parquet table, each packet once, also over stops, failures and restarts."""
    packets = live_packets(spark, folder, max_bytes, checkpoint)
    packets = live_filter(packets, text) if text else packets
    return packets.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()


def live_filter(packets: DataFrame, text: str) -> DataFrame:
    return packets.where(packet_filter(text))


def live_conversations(packets: DataFrame) -> DataFrame:
    """Running totals per address pair; for complete or update mode. Everything counts however late, as without a
    watermark; state is one row per pair."""
    ends = packets.withColumns({"s": address_key("src"), "d": address_key("dst")}).where("s IS NOT NULL")
    return ends.groupBy(F.least("s", "d").alias("a"), F.greatest("s", "d").alias("b")).agg(F.count("*").alias("packets"), F.sum("origlen").alias("bytes"), F.min("ts_nanos").alias("first_ts"), F.max("ts_nanos").alias("last_ts"))


def live_protocols(packets: DataFrame) -> DataFrame:
    return with_proto(packets).groupBy("proto_kind", "proto_number", "proto").agg(F.count("*").alias("packets"), F.sum("origlen").alias("bytes"))


def windowed_traffic(packets: DataFrame, width: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """Packets and bytes per event-time window; an addition of this engine: state of old windows is dropped."""
    timed = packets.withColumn("ts", F.timestamp_micros(F.floor(F.col("ts_nanos").cast("decimal(20,0)") / 1000).cast("long")))
    return timed.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w")).agg(F.count("*").alias("packets"), F.sum("origlen").alias("bytes")).select("w.start", "w.end", "packets", "bytes")


def run_bounded(stream: DataFrame, name: str, mode: str = "append", seconds: float | None = None, count: int | None = None, interval: str = "1 second") -> StreamingQuery:
    """Into a memory table until `seconds` have passed or `count` rows were read; neither: all that is there now."""
    writer = stream.writeStream.format("memory").queryName(name).outputMode(mode)
    if seconds is None and count is None:
        query = writer.start()
        query.processAllAvailable()
        query.stop()
        return query
    query, began = writer.trigger(processingTime=interval).start(), time.time()
    while query.isActive and (seconds is None or time.time() - began < seconds):
        if count is not None and sum(p["numInputRows"] for p in query.recentProgress) >= count:
            break
        time.sleep(0.1)
    query.stop()
    return query


class RateListener(StreamingQueryListener):
    """Keeps the last rate of each query, for a readout."""

    def __init__(self):
        self.rates: dict[str, float] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.rates[str(event.progress.id)] = event.progress.inputRowsPerSecond

    def onQueryTerminated(self, event) -> None:
        self.rates.pop(str(event.id), None)


def make_spool(folder: str | None = None) -> str:
    return tempfile.mkdtemp(prefix=SPOOL, dir=folder)


def drop_stale_spools(folder: str, days: float = 1) -> list[str]:
    """Remove spools that are older than a day; returns them."""
    gone = []
    for name in os.listdir(folder):
        path = os.path.join(folder, name)
        if name.startswith(SPOOL) and time.time() - os.path.getmtime(path) > days * 86_400:
            for file in os.listdir(path):
                os.remove(os.path.join(path, file))
            os.rmdir(path)
            gone.append(path)
    return sorted(gone)
