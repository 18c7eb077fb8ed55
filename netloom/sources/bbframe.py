"""DVB-S2 baseband frames as lines of JSON, and the GSE packets inside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions.scalars import canonical_timestamp, ip_checksum, uint_be

LINE = r'^\{"timestamp":([^,]*),"bbframe":"([^"]*)","metadata":(\{.*\})\}$'


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return parse_lines(spark.read.text(path))


def parse_lines(lines: DataFrame, strict: bool = False) -> DataFrame:
    """value: a line with exactly timestamp, bbframe and metadata in this order. Gives timestamp, frame, metadata and
    reject_reason (null if the line can be written back as it was): shape, timestamp or base64. strict: fail instead."""
    part = lambda k: F.regexp_extract("value", LINE, k)
    shaped = F.col("value").rlike(LINE)
    frame = F.try_to_binary(part(2), F.lit("base64"))
    exact = F.coalesce(F.regexp_replace(F.base64(frame), "[\r\n]", "") == part(2), F.lit(False))
    reason = F.when(~shaped, "shape").when(~canonical_timestamp(part(1)), "timestamp").when(~exact, "base64")
    rows = lines.select("*", reason.alias("reject_reason"))
    if strict:
        rows = rows.withColumn("reject_reason", F.when(F.col("reject_reason").isNotNull(), F.raise_error(F.concat(F.lit("line rejected: "), F.col("reject_reason")))).cast("string"))
    good = F.col("reject_reason").isNull()
    return rows.select("value", F.when(good, part(1)).alias("timestamp"), F.when(good, frame).alias("frame"), F.when(good, part(3)).alias("metadata"), "reject_reason")


def validation_report(rows: DataFrame) -> DataFrame:
    """One row of counters."""
    return rows.agg(F.count("*").alias("lines"), F.count_if(F.col("reject_reason").isNull()).alias("modelled"), *(F.count_if(F.col("reject_reason") == r).alias(f"rejected_{r}") for r in ("shape", "timestamp", "base64")), F.coalesce(F.sum(F.length("frame")), F.lit(0)).alias("frame_bytes"))


def bb_header(frame: Column) -> Column:
    """MATYPE, UPL, DFL, SYNC, SYNCD and CRC8; null unless DFL is whole bytes that the frame holds."""
    dfl = uint_be(frame, 4, 2)
    fine = (dfl % 8 == 0) & (F.length(frame) >= 10 + dfl / 8)
    return F.when(fine, F.struct(uint_be(frame, 0, 2).alias("matype"), uint_be(frame, 2, 2).alias("upl"), dfl.alias("dfl"), uint_be(frame, 6, 1).alias("sync"), uint_be(frame, 7, 2).alias("syncd"), uint_be(frame, 9, 1).alias("crc8")))


def gse_packets(rows: DataFrame, frame: str = "frame", keep: tuple[str, ...] = ("timestamp",), most: int = 4096) -> DataFrame:
    """(keep, index, start, size, packet): the packets of each frame's data field. A header is 16 bits whose low 12
    count the bytes with the header; a length of 0, below 2 or past the end stops the walk. The field stands behind a
    generator, so that the walk doesn't decode the line again at each step."""
    data = F.col(frame)
    field = F.when(bb_header(data).isNotNull(), F.substring(data, F.lit(11), (uint_be(data, 4, 2) / 8).cast("int")))
    body = rows.select(*keep, F.explode(F.array(field)).alias("body")).where("body IS NOT NULL AND length(body) >= 2")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,size:int>>").alias("found"), F.lit(True).alias("goes"))

    def step(acc, _):
        size = F.coalesce(uint_be(F.col("body"), acc["at"], 2).bitwiseAND(0xFFF).cast("int"), F.lit(0))
        fine = acc["goes"] & (size >= 2) & (acc["at"] + size <= F.length("body"))
        return F.struct(F.when(fine, acc["at"] + size).otherwise(acc["at"]).alias("at"), F.when(fine, F.concat(acc["found"], F.array(F.struct(acc["at"].alias("start"), size.alias("size"))))).otherwise(acc["found"]).alias("found"), fine.alias("goes"))

    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(most), (F.length("body") / 2).cast("int"))))
    walked = body.select(*keep, "body", F.aggregate(steps, start, step, lambda acc: acc["found"]).alias("found"))
    each = walked.select(*keep, "body", F.posexplode("found").alias("index", "p"))
    return each.select(*keep, "index", "p.start", "p.size", F.substring(F.col("body"), F.col("p.start") + 1, F.col("p.size")).alias("packet"))


def looks_like_ipv4(body: Column, at: Column) -> tuple[Column, Column]:
    """(whether a header of 20 to 60 bytes with a fitting total length starts there, of version 4 or proven by its
    checksum; whether the checksum proves it, as it is or with the version nibble set to 4)"""
    first = uint_be(body, at, 1)
    size = (first.bitwiseAND(15) * 4).cast("int")
    header = F.substring(body, at + 1, size)
    checksum = uint_be(body, at + 10, 2)
    as_v4 = F.concat(F.unhex(F.lpad(F.hex(first.bitwiseAND(15) + 0x40), 2, "0")), F.substring(header, F.lit(2), F.greatest(size - 1, F.lit(0))))
    fits = (size >= 20) & (at + size <= F.length(body)) & (uint_be(body, at + 2, 2) >= size)
    sealed = F.when(fits, (ip_checksum(header) == checksum) | (ip_checksum(as_v4) == checksum)).otherwise(False)
    return fits & ((F.shiftright(first, 4) == 4) | sealed), sealed


def find_ipv4(body: Column, most: int = 12) -> Column:
    """The first offset up to `most` where an IPv4 header proves itself: it looks like one, its total length lies in the
    body, and it ends where the body does or has the right checksum; null if there is none."""

    def proves(at):
        looks, sealed = looks_like_ipv4(body, at)
        total = uint_be(body, at + 2, 2)
        inside = (at + total <= F.length(body)) & (total >= 20)  # few offsets pass, and only those are summed up
        return F.when(inside, looks & ((at + total == F.length(body)) | sealed))

    return F.get(F.filter(F.sequence(F.lit(0), F.lit(most)), lambda at: F.coalesce(proves(at), F.lit(False))), F.lit(0))
