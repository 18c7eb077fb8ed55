"""Time histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.plans.filters import packet_filter, parse

SECOND = 1_000_000_000
BUCKETS = 1024
# Bucket widths in seconds that a reader finds natural.
NICE = (0.001, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1, 2, 5, 10, 15, 30, 60, 120, 300, 600, 900, 1800, 3600, 7200, 21600, 43200, 86400)
# The default series, in the filter language: the first five exclude each other.
SERIES = {
    "tcp": "proto == tcp", "udp": "proto == udp", "icmp": "proto in {icmp, icmpv6}", "arp": "proto == arp",
    "other": "!(proto in {tcp, udp, icmp, icmpv6, arp})", "ipv6": "proto == ipv6", "dns": "port == 53", "tls": "port == 443",
    "http": "port in {80, 8080}", "ssh": "port == 22", "smb": "port in {139, 445}",
}


def nice_interval(duration: float, bins: int) -> float:
    """The narrowest natural width that needs at most `bins` buckets."""
    return next((w for w in NICE if w >= max(duration, 0.001) / max(bins, 1)), NICE[-1])


def rescaling(p: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(origin, width, bucket, packets): at most `buckets` buckets of 2^k seconds from the first packet's whole second.

    Widths double until the latest packet fits; packets before the first in file order extend the histogram backwards,
    to negative buckets. Packets without a time are left out. The range is one small aggregate, joined to every row.
    """
    timed = p.where("ts_nanos <> 0")
    bounds = timed.agg(F.min_by("ts_nanos", "packet_no").alias("first"), F.min("ts_nanos").alias("low"), F.max("ts_nanos").alias("high"))
    bounds = bounds.select((F.col("first") - F.pmod("first", F.lit(SECOND))).alias("origin"), "low", "high")
    widths = F.transform(F.sequence(F.lit(0), F.lit(40)), lambda k: F.pow(F.lit(2.0), k).cast("long"))
    low = F.least("low", "origin")
    fits = F.filter(widths, lambda w: F.floor((F.col("high") - F.col("origin")) / (w * float(SECOND))) - F.floor((low - F.col("origin")) / (w * float(SECOND))) < buckets)
    bounds = bounds.select("origin", (fits[0] * SECOND).alias("width"))
    bucket = F.floor((F.col("ts_nanos") - F.col("origin")) / F.col("width")).cast("long")
    return timed.select("ts_nanos").crossJoin(F.broadcast(bounds)).groupBy("origin", "width", bucket.alias("bucket")).agg(F.count("*").alias("packets"))  # bounds is one row


def multi_series(p: DataFrame, interval_ns: int, series: dict[str, str] | None = None) -> DataFrame:
    """(bucket, frames, bytes, <name>_frames, <name>_bytes ...) in one grouping; buckets count from the first packet in
    file order, earlier packets fall into bucket 0. Empty buckets are left out; see gap_filled()."""
    series = SERIES if series is None else series
    for name, text in series.items():
        if not name or "," in name:
            raise ValueError(f"{name!r} can't name a series")
        parse(text)
    start = p.agg(F.min_by("ts_nanos", "packet_no").alias("t0"))  # one row
    bucket = F.floor(F.greatest(F.col("ts_nanos") - F.col("t0"), F.lit(0)) / interval_ns).cast("long")
    sums = [F.count("*").alias("frames"), F.sum("origlen").alias("bytes")]
    for name, text in series.items():
        hit = packet_filter(text)
        sums += [F.count_if(hit).alias(f"{name}_frames"), F.coalesce(F.sum(F.when(hit, F.col("origlen"))), F.lit(0)).alias(f"{name}_bytes")]
    return p.crossJoin(F.broadcast(start)).groupBy(bucket.alias("bucket")).agg(*sums)


def gap_filled(h: DataFrame) -> DataFrame:
    """All buckets from 0 to the last, with zeros."""
    every = h.agg(F.max("bucket").alias("last")).where("last IS NOT NULL").select(F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("bucket"))
    return every.join(h, "bucket", "left").fillna(0)


def with_rates(h: DataFrame, interval_ns: int) -> DataFrame:
    seconds = interval_ns / SECOND
    return h.withColumns({"frames_per_s": F.round(F.col("frames") / F.lit(seconds), 3), "bits_per_s": F.round(F.col("bytes") * 8 / F.lit(seconds), 3)})


def downsample(h: DataFrame, columns: int, span: int, value: str = "packets") -> DataFrame:
    """`span` buckets summed into `columns`."""
    return h.groupBy(F.floor(F.col("bucket") * columns / span).cast("long").alias("col")).agg(F.sum(value).alias(value))


def fold(h: DataFrame, width: int, span: int, value: str = "frames") -> DataFrame:
    """The largest bucket of each of about `width` runs."""
    run = max(1, -(-span // width))
    return h.groupBy(F.floor(F.col("bucket") / run).cast("long").alias("fold")).agg(F.max(value).alias(value))


def peak(h: DataFrame, value: str = "frames") -> DataFrame:
    """The first of the fullest buckets."""
    return h.agg(F.max_by("bucket", F.struct(F.col(value), -F.col("bucket"))).alias("bucket"), F.max(value).alias(value))


def glyphs(counts: list[int]) -> str:
    """A sparkline; zero is a space."""
    most = max(counts, default=0)
    return "".join(" " if not c else "▁▂▃▄▅▆▇█"[min(7, -(-7 * c // most))] for c in counts)


def share_of(h: DataFrame, names: list[str]) -> list[Column]:
    return [F.round(F.sum(f"{n}_frames") * 100.0 / F.greatest(F.sum("frames"), F.lit(1)), 2).alias(n) for n in names]
