"""SimHash near-dedup: tiled exact comparison of 64-bit fingerprints.

Distinct fingerprints are sorted by population count and cut into tiles. Two tiles are compared only if their
population counts lie within the radius: first of the whole fingerprints (the join key), then of their four 16-bit
words (a box per tile and sub-tile, as the sum of the words' differences is also a lower bound of the distance).
Surviving pairs go through numpy exclusive-or and bit counts. Each tile pair returns a spanning forest of its links,
never the links themselves, so a clique of k fingerprints yields k - 1 edges.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm.common import batch, binary, modest, partitions, slices, stored, table
from netloom.llm.components import components, forest

TILE, SUB = 1 << 16, 1 << 10
FOLD = 1 << 21  # links held before they are folded into a forest


def shingle_hashes(text: bytes, size: int, seed: int) -> list[int]:
    """XXH64 of the word shingles; fewer words than `size`: of the whole sequence; none: no hash."""
    words = text.lower().split()  # bytes: A-Z only, and exactly the white space 20 09-0D
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(line, seed)]
    ends = [e + i for i, e in enumerate(accumulate(map(len, words)))]
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], seed) for a, b in zip(starts, ends[size - 1 :], strict=False)]


def fingerprints_of(texts: list[bytes], size: int, seed: int) -> np.ndarray:
    """A bit is 1 if set in over half of the hashes."""
    out, at, held, own = np.zeros(len(texts), np.uint64), [], [], 0

    def flush() -> None:
        nonlocal at, held, own
        if held:
            h, n = np.array(held, np.uint64), np.diff([*(i for _, i in at), len(held)])
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts = np.add.reduceat(bits, [i for _, i in at], axis=0, dtype=np.int32)
            out[[k for k, _ in at]] = np.packbits(counts * 2 > n[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
        at, held, own = [], [], 0

    for k, text in enumerate(texts):
        if h := shingle_hashes(text, size, seed):
            at.append((k, len(held)))
            held += h
        if len(held) > 1 << 17:
            flush()
    flush()
    return out


def text_hash(text_col: str) -> F.Column:
    return F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, seed: int = 42) -> DataFrame:
    """(id, th: xxhash64 of the text, fp long: the fingerprint's bits, signed). Null and empty texts, and texts without words: 0."""
    modest(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text_hash(text_col).alias("th"), F.col(f"`{text_col}`").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp = fingerprints_of(binary(b.column("text")), size, seed).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("th"), pa.array(fp)], names=["id", "th", "fp"])

    return rows.mapInArrow(run, f"id {kind}, th long, fp long")


def _boxes(fp: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fp.view(np.uint16).reshape(-1, 4)).astype(np.int64)


TILES = pa.schema([("tile", pa.int64()), ("pc", pa.int32()), *((f"{e}{k}", pa.int32()) for e in ("lo", "hi") for k in range(4)), ("blob", pa.binary())])
TILES_SQL = "tile long, pc int, " + ", ".join(f"{e}{k} int" for e in ("lo", "hi") for k in range(4)) + ", blob binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted fingerprints as tiles of one population count each."""
    seq, pid, held, held_pc = 0, TaskContext.get().partitionId(), [], None

    def tile() -> pa.RecordBatch:
        nonlocal seq, held
        fp = np.concatenate(held)
        box = _boxes(fp)
        seq, held = seq + 1, []
        own = {"tile": [(pid << 24) | seq], "pc": [held_pc], "blob": [fp.tobytes()]}
        return batch(TILES, **own, **{f"lo{k}": [int(box[:, k].min())] for k in range(4)}, **{f"hi{k}": [int(box[:, k].max())] for k in range(4)})

    for b in batches:
        fp, pc = b.column("fp").to_numpy(zero_copy_only=False), b.column("pc").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(pc)) + 1), len(pc)]
        for a, z in zip(cuts, cuts[1:], strict=False):
            for at in range(a, z, TILE):
                part = fp[at : min(z, at + TILE)]
                if held and (pc[at] != held_pc or sum(map(len, held)) + len(part) > TILE):
                    yield tile()
                held.append(part)
                held_pc = int(pc[at])
    if held:
        yield tile()


def _links(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of a spanning forest of the links between and, if it is one tile, within a and b."""
    same = a is b
    every = a if same else np.concatenate([a, b])
    shift = 0 if same else len(a)
    boxes = []
    for x in (a, b):
        c, cut = _boxes(x), range(0, len(x), SUB)
        boxes.append((np.minimum.reduceat(c, cut), np.maximum.reduceat(c, cut)))
    (la, ha), (lb, hb) = boxes
    gap = np.maximum(0, np.maximum(la[:, None] - hb[None], lb[None] - ha[:, None])).sum(axis=2)
    us, vs, size = [], [], 0
    for i, j in zip(*np.nonzero(gap <= radius), strict=True):
        if same and j < i:
            continue
        left, right = a[i * SUB : (i + 1) * SUB], b[j * SUB : (j + 1) * SUB]
        near = np.bitwise_count(left[:, None] ^ right[None]) <= radius
        x, y = np.nonzero(np.triu(near, 1) if same and i == j else near)
        us.append(x + i * SUB)
        vs.append(y + j * SUB + shift)
        size += len(x)
        if size > FOLD:
            low = forest(np.concatenate(us), np.concatenate(vs), len(every))
            node = np.flatnonzero(low != np.arange(len(low)))
            us, vs, size = [node], [low[node]], 0
    if not size and not us:
        return every[:0], every[:0]
    low = forest(np.concatenate(us), np.concatenate(vs), len(every))
    node = np.flatnonzero(low != np.arange(len(low)))
    return every[node], every[low[node]]


def links(fps: DataFrame, radius: int) -> DataFrame:
    """A spanning forest (u, v) of the links at `radius` or fewer bits between the distinct fingerprints `fp`."""
    spark = fps.sparkSession
    n = partitions(spark)
    keys = [F.bit_count("fp").alias("pc"), *(F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(65535)).alias(f"w{k}") for k in range(4))]
    ranged = fps.select("fp", *keys).repartitionByRange(n, "pc", "w0", "w1", "w2", "w3", "fp").sortWithinPartitions("pc", "w0", "w1", "w2", "w3", "fp").select("fp", "pc")
    tiles = stored(ranged.mapInArrow(_cut, TILES_SQL), "tiles")
    a = tiles.drop("blob").withColumn("key", F.explode(F.sequence(F.col("pc"), F.col("pc") + radius)))
    b = tiles.drop("blob").select(*(F.col(c).alias(f"{c}_b") for c in tiles.columns if c != "blob"))
    gap = sum((F.greatest(F.lit(0), F.col(f"lo{k}") - F.col(f"hi{k}_b"), F.col(f"lo{k}_b") - F.col(f"hi{k}")) for k in range(4)), F.lit(0))
    met = a.join(b, a.key == b.pc_b).where((F.col("pc") < F.col("pc_b")) | (F.col("tile") <= F.col("tile_b"))).where(gap <= radius).select("tile", "tile_b")
    blob = tiles.select("tile", "blob")
    sent = met.join(blob, "tile").join(blob.select(F.col("tile").alias("tile_b"), F.col("blob").alias("blob_b")), "tile_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for r in range(rows.num_rows):
                row = {c: rows.column(c)[r].as_py() for c in rows.schema.names}
                x = np.frombuffer(row["blob"], np.int64).view(np.uint64)
                y = x if row["tile"] == row["tile_b"] else np.frombuffer(row["blob_b"], np.int64).view(np.uint64)
                u, v = _links(x, y, radius)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    return sent.repartition(n).mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, radius: int = 3, seed: int = 42) -> DataFrame:
    """One row per row of docs: (id, th, fp, component), component being the least id that links of `radius` or fewer bits
    reach, the row's own included.

    Null, empty and wordless texts have fingerprint 0 and link like any other. Rows with a repeated id each keep their
    own fingerprint. Null ids never name a component unless all of its ids are null. Other columns are ignored.
    """
    own = stored(fingerprints(docs, id_col, text_col, size, seed), "fingerprints")
    least = own.groupBy("fp").agg(F.min("id").alias("least"))
    roots = components(links(least.select("fp"), radius), "links")
    named = least.join(roots, least.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = stored(named, "roots")
    low = named.groupBy("root").agg(F.min("least").alias("component"))
    label = named.join(low, "root").select("fp", "component")
    return own.join(label, "fp").select("id", "th", "fp", "component")


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs whose id names their component, and one row of those that repeat both id and text."""
    found = near_duplicates(docs, id_col, text_col, **how)
    stay = found.where(F.col("id").eqNullSafe(F.col("component"))).select(F.col("id").alias("__id"), F.col("th").alias("__th"))
    own = docs.withColumn("__text_hash", text_hash(text_col))
    kept = own.join(stay, F.col(f"`{id_col}`").eqNullSafe(F.col("__id")) & (F.col("__text_hash") == F.col("__th")), "left_semi")
    return kept.dropDuplicates([id_col, "__text_hash"]).drop("__text_hash")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
