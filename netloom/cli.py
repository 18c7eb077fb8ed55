"""python -m netloom.cli stats | query | export | index | report | hist | completions"""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom import output
from netloom.operators import aggregates as A
from netloom.operators import histograms as H
from netloom.plans import cache as C
from netloom.plans.filters import FIELDS, FLAGS, FilterError, compose, packet_filter
from netloom.sources.pcap import capture_facts, export_pcap

OPERATORS = ("==", "!=", "<", ">", "<=", ">=", "in {", "contains")


def suggest(text: str, seen: dict[str, list[str]], most: int = 8) -> list[str]:
    """What may come next in a filter: fields, then operators, then values seen in the capture."""
    words = text.split()
    last = "" if not text or text.endswith(" ") else words.pop()
    if words and words[-1] in FIELDS and words[-1] != "data":
        pool = list(OPERATORS[:-1])
    elif words and words[-1] == "data":
        pool = ["contains"]
    elif len(words) > 1 and words[-1] in OPERATORS:
        pool = seen.get({"mac_src": "mac", "mac_dst": "mac", "ip_src": "ip", "ip_dst": "ip", "sport": "port", "dport": "port"}.get(words[-2], words[-2]), [])
    elif not words or words[-1] in ("&&", "||", "!", "("):
        pool = list(FIELDS)
    else:
        pool = ["&&", "||"]
    return [p for p in pool if p.startswith(last)][:most]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="netloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("stats", "query", "export", "index", "report", "hist"):
        s = sub.add_parser(name)
        s.add_argument("capture")
        s.add_argument("--cache")
        s.add_argument("--index", action="store_true", help="write the cache")
        s.add_argument("--reindex", action="store_true")
        if name in ("query", "export", "hist"):
            s.add_argument("filter", nargs="?")
            for flag in FLAGS:
                s.add_argument(f"--{flag.replace('_', '-')}", dest=flag, action="append")
    sub.choices["stats"].add_argument("--json", action="store_true")
    sub.choices["stats"].add_argument("--top", type=int, default=10)
    sub.choices["query"].add_argument("--json", action="store_true")
    sub.choices["query"].add_argument("--count", action="store_true")
    sub.choices["query"].add_argument("--limit", type=int, default=100, help="0: all")
    sub.choices["export"].add_argument("--out", required=True)
    sub.choices["export"].add_argument("--limit", type=int, default=0, help="0: all")
    sub.choices["report"].add_argument("--out", required=True)
    sub.choices["report"].add_argument("--interval", type=float, default=0)
    sub.choices["hist"].add_argument("--series", action="append", default=[], help="NAME=FILTER")
    sub.choices["hist"].add_argument("--bins", type=int, default=120)
    return p


def series(texts: list[str]) -> dict[str, str]:
    """NAME=FILTER options as series; a name is cut to letters, digits and underscores."""
    out = dict(H.SERIES)
    for text in texts:
        name, equals, filter_ = text.partition("=")
        if not equals or "," in name:
            raise FilterError(f"{text!r} is not NAME=FILTER")
        out["".join(c if c.isalnum() else "_" for c in name)] = filter_
    return out


def interval_of(packets: DataFrame, bins: int = 120) -> int:
    t = A.totals(packets).first()
    return int(H.nice_interval(((t.last_ts or 0) - (t.first_ts or 0)) / H.SECOND, bins) * H.SECOND)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("netloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "index":
        if not a.cache:
            sys.exit("index needs --cache")
        m = C.build(spark, a.capture, a.cache)
        print(f"{m['packets']} packets in {m['build_millis']} ms")
        return 0
    began = time.time()
    packets = C.open_packets(spark, a.capture, a.cache, a.reindex, a.index)
    text = compose(a.filter, **{f: getattr(a, f) for f in FLAGS}) if a.command in ("query", "export", "hist") else ""
    if a.command == "stats":
        s = capture_facts(packets, a.capture) | output.stats(packets, a.top)
        s["build_millis"] = int((time.time() - began) * 1000)
        print(json.dumps(s) if a.json else output.stats_text(s))
    elif a.command == "query":
        if not text:
            sys.exit("query needs a filter")
        found = packets.where(packet_filter(text))
        if a.count:
            print(found.count())
        else:
            found = found.orderBy("packet_no")
            found = found.limit(a.limit) if a.limit else found
            for r in (output.json_lines if a.json else output.text_lines)(found).toLocalIterator():
                print(r.value)
    elif a.command == "export":
        n, size, skipped = export_pcap(packets.where(packet_filter(text or "len >= 0")), a.out, a.limit)
        print(f"{n} packets, {size} bytes" + (f", {skipped} of another link type left out" if skipped else ""))
    elif a.command == "report":
        print(json.dumps(output.write_report(packets, a.out, a.interval or interval_of(packets) / H.SECOND)))
    else:
        chosen = packets.where(packet_filter(text)) if text else packets
        width = interval_of(chosen, a.bins)
        h = H.with_rates(H.gap_filled(H.multi_series(chosen, width, series(a.series))), width).orderBy("bucket")
        print(f"# interval_s {width / H.SECOND}")
        print(",".join(h.columns))
        for r in h.toLocalIterator():
            print(",".join(str(x) for x in r))
    return 0


if __name__ == "__main__":
    sys.exit(main())
