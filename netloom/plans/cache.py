"""Ingest once: captures as dissected Parquet, clustered by packet number, with a manifest that says what they came from."""

from __future__ import annotations

import glob
import json
import os
import time

import xxhash
from pyspark.sql import DataFrame, SparkSession

from netloom.operators import aggregates as A
from netloom.plans.filters import may_match, parse
from netloom.schema import GROUP
from netloom.sources.pcap import register

VERSION = 1
HEAD = 64 << 10
BLOOMS = ("mac_src", "mac_dst", "ip4_src", "ip4_dst", "sport", "dport")


def fingerprint(path: str) -> list[dict]:
    """Size, time and two seeded hashes of the head of each capture."""
    files = sorted(glob.glob(os.path.join(path, "*")) if os.path.isdir(path) else [path])
    out = []
    for file in files:
        with open(file, "rb") as f:
            head = f.read(HEAD)
        out.append({"file": file, "size": os.path.getsize(file), "mtime": int(os.path.getmtime(file)), "head": [xxhash.xxh64_hexdigest(head, 1), xxhash.xxh64_hexdigest(head, 2)]})
    return out


def write_table(packets: DataFrame, path: str) -> None:
    """Row groups of GROUP packets in file order, bloom filters on the fields that are looked up by value; the frame is
    a column of its own, read only by queries that look at bytes."""
    writer = packets.sortWithinPartitions("file", "packet_no").write.mode("overwrite").option("compression", "zstd").option("parquet.block.row.count.limit", GROUP)
    for column in BLOOMS:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true").option(f"parquet.bloom.filter.expected.ndv#{column}", str(GROUP))
    writer.parquet(path)


def build(spark: SparkSession, captures: str, cache: str) -> dict:
    """Always reads the captures anew; returns the manifest."""
    register(spark)
    began = time.time()
    packets = spark.read.format("pcap").option("dissect", "true").load(captures)
    write_table(packets, f"{cache}/packets")
    kept = spark.read.parquet(f"{cache}/packets")
    A.row_groups(kept, GROUP, *A.bounds()).write.mode("overwrite").parquet(f"{cache}/groups")
    A.protocol_mix(kept).write.mode("overwrite").parquet(f"{cache}/protocols")
    A.conversations(kept).write.mode("overwrite").parquet(f"{cache}/conversations")
    manifest = {"version": VERSION, "sources": fingerprint(captures), "packets": kept.count(), "build_millis": int((time.time() - began) * 1000)}
    with open(os.path.join(cache, "manifest.json"), "w") as f:
        json.dump(manifest, f)
    return manifest


def load(spark: SparkSession, captures: str, cache: str) -> DataFrame | None:
    """The packets, if the cache is whole and of these captures as they are now; else None."""
    try:
        with open(os.path.join(cache, "manifest.json")) as f:
            manifest = json.load(f)
    except (OSError, ValueError):
        return None
    if manifest.get("version") != VERSION or manifest.get("sources") != fingerprint(captures):
        return None
    return spark.read.parquet(f"{cache}/packets")


def open_packets(spark: SparkSession, captures: str, cache: str | None = None, reindex: bool = False, keep: bool = False) -> DataFrame:
    """From a valid cache unless reindex; written only if keep. Without either, straight from the captures."""
    if cache and not reindex and (found := load(spark, captures, cache)) is not None:
        return found
    if cache and keep:
        build(spark, captures, cache)
        return spark.read.parquet(f"{cache}/packets")
    register(spark)
    return spark.read.format("pcap").option("dissect", "true").load(captures)


def groups_that_may_match(groups: DataFrame, text: str) -> DataFrame:
    """Of the cached groups those that a filter can't be ruled out for, as a scan's statistics would prune them."""
    return groups.where(may_match(parse(text)))
