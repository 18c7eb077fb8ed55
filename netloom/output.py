"""What people and programs read: JSON lines, text tables, statistics, CSV and HTML reports."""

from __future__ import annotations

import html
import json
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions.names import proto_name
from netloom.functions.scalars import fmt_addr, fmt_mac, fmt_ts
from netloom.operators import aggregates as A
from netloom.operators import histograms as H
from netloom.operators import inventory as R

HTML_ROWS = 20_000


def line_columns(stream: bool = False) -> list[Column]:
    """The keys of a packet's JSON line; a stream's line has no offset and caplen."""
    place = [] if stream else [F.col("record_offset").alias("offset"), F.col("caplen")]
    return [
        F.col("ts_nanos"), *place, F.col("origlen").alias("len"), fmt_mac(F.col("mac_src")).alias("mac_src"), fmt_mac(F.col("mac_dst")).alias("mac_dst"),
        fmt_addr(F.col("ip4_src"), F.col("ip6_src")).alias("ip_src"), fmt_addr(F.col("ip4_dst"), F.col("ip6_dst")).alias("ip_dst"),
        proto_name(F.col("ip_proto"), F.col("ethertype")).alias("proto"), F.col("sport"), F.col("dport"), F.col("vlan"),
    ]


def json_lines(packets: DataFrame, stream: bool = False) -> DataFrame:
    return packets.select(F.to_json(F.struct(*line_columns(stream)), {"ignoreNullFields": "false"}).alias("value"))


def text_lines(packets: DataFrame) -> DataFrame:
    end = lambda side, port: F.concat(F.coalesce(fmt_addr(F.col(f"ip4_{side}"), F.col(f"ip6_{side}")), fmt_mac(F.col(f"mac_{side}")), F.lit("-")), F.coalesce(F.concat(F.lit(":"), F.col(port).cast("string")), F.lit("")))
    return packets.select(F.format_string("%-23s %6d %-10s %s -> %s", fmt_ts(F.col("ts_nanos")), F.col("origlen"), proto_name(F.col("ip_proto"), F.col("ethertype")), end("src", "sport"), end("dst", "dport")).alias("value"))


def stats(packets: DataFrame, top: int = 10) -> dict:
    """The whole capture's figures; only top lists and at most 1,024 buckets are collected."""
    total = A.totals(packets).first()
    rows = lambda df: [r.asDict() for r in df.collect()]
    buckets = H.rescaling(packets).orderBy("bucket").collect()
    first = buckets[0].bucket if buckets else 0
    counts = [0] * (buckets[-1].bucket - first + 1 if buckets else 0)
    for b in buckets:
        counts[b.bucket - first] = b.packets
    return {
        "packets": total.packets, "bytes": total.bytes, "first_ts_nanos": total.first_ts, "last_ts_nanos": total.last_ts,
        "unique_macs": A.distinct_macs(packets).first().macs,
        "protocols": rows(A.protocol_mix(packets).orderBy(F.desc("packets"), "proto_kind", "proto_number").select("proto", "packets", "bytes")),
        "top_macs": rows(A.top(A.mac_stats(packets).select(fmt_mac(F.col("mac")).alias("mac"), "packets", "bytes"), top, "packets", "mac")),
        "top_ports": rows(A.top(A.port_totals(packets), top, "packets", "port")),
        "histogram": {"bucket_nanos": buckets[0].width if buckets else 0, "origin_nanos": buckets[0].origin if buckets else 0, "first_bucket": first, "counts": counts},
    }


def stats_text(s: dict, width: int = 72) -> str:
    counts = s["histogram"]["counts"]
    cols = [0] * min(width, max(1, len(counts)))
    for k, c in enumerate(counts):
        cols[k * len(cols) // len(counts)] += c
    lines = [f"packets {s['packets']:,}   bytes {s['bytes']:,}   devices {s['unique_macs']:,}", H.glyphs(cols)]
    most = max((p["packets"] for p in s["protocols"]), default=1)
    lines += [f"{p['proto']:<16} {p['packets']:>12,} {100 * p['packets'] / max(1, s['packets']):6.2f} % {'█' * (20 * p['packets'] // most)}" for p in s["protocols"][:10]]
    lines += [f"{m['mac']:<20} {m['packets']:>12,}" for m in s["top_macs"]] + [f"port {p['port']:<15} {p['packets']:>12,}" for p in s["top_ports"]]
    return "\n".join(lines)


PAGE = """<!doctype html><meta charset=utf-8><title>{title}</title><style>body{{font:14px sans-serif}}table{{border-collapse:collapse}}td,th{{padding:2px 8px;border-bottom:1px solid #ccc;text-align:left}}th{{cursor:pointer}}</style>
<h1>{title}</h1><p>{facts}<p><input id=q placeholder="terms, -term, column:value"><nav>{tabs}</nav>{tables}
<script>
const show=n=>{{location.hash=n;for(const t of document.querySelectorAll('table'))t.hidden=t.id!==n}};
const seek=()=>{{const ts=q.value.toLowerCase().split(/\\s+/).filter(Boolean);for(const r of document.querySelectorAll('tbody tr')){{const x=r.textContent.toLowerCase();r.hidden=!ts.every(t=>t[0]==='-'&&t[1]?!x.includes(t.slice(1)):x.includes(t.replace(/^[g-z_]\\w*:/,'')))}}}};
q.oninput=seek;for(const h of document.querySelectorAll('th'))h.onclick=()=>{{const b=h.closest('table').tBodies[0],k=h.cellIndex,v=r=>r.cells[k].textContent,s=h.dataset.s=h.dataset.s==='1'?'-1':'1';
[...b.rows].sort((x,y)=>s*(isNaN(v(x))||isNaN(v(y))?v(x).localeCompare(v(y)):v(x)-v(y))).forEach(r=>b.append(r))}};
show(location.hash.slice(1)||document.querySelector('table').id)
</script>"""


def write_report(packets: DataFrame, folder: str, interval: float = 1.0, html_rows: int = HTML_ROWS) -> dict:
    """Every table in full as CSV, summary.json, and a page with at most html_rows rows of each table."""
    os.makedirs(folder, exist_ok=True)
    packets = packets.drop("frame").persist()
    tables = {name: R.ordered(name, packets) for name in R.TABLES} | {"histogram": R.histogram(packets, int(interval * H.SECOND)).orderBy("bucket")}
    counts, parts = {}, []
    for name, df in tables.items():
        df = df.persist()
        df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}.csv")
        counts[name] = df.count()
        body = "".join("<tr>" + "".join(f"<td>{html.escape('' if x is None else str(x))}</td>" for x in r) + "</tr>" for r in df.limit(html_rows).collect())
        parts.append(f"<table id={name} hidden><thead><tr>{''.join(f'<th>{html.escape(c)}</th>' for c in df.columns)}</tr></thead><tbody>{body}</tbody></table>")
        df.unpersist()
    facts = A.totals(packets).first().asDict()
    summary = facts | {"tables": counts}
    with open(f"{folder}/summary.json", "w") as f:
        json.dump(summary, f, indent=1)
    with open(f"{folder}/report.html", "w") as f:
        f.write(PAGE.format(title="Capture report", facts=html.escape(json.dumps(facts)), tabs=" ".join(f'<a href="#{n}" onclick="show(\'{n}\')">{n}</a>' for n in tables), tables="".join(parts)))
    packets.unpersist()
    return summary
