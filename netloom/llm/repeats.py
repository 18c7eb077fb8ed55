"""What the two removers of repeated windows share: a count-min prefilter, an exchange of windows between blocks of
documents, and the join of what is to be removed back to the whole texts.

A document is known by (id, xxhash64 of its text), so rows that repeat an id don't mix. Window owners are compared by
id first; a null id counts as the largest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import binary, blocks, modest, pack, partitions, runs, settled, trim, unpack

NO_ID = np.iinfo(np.int64).max
#: Cells of each of the sketch's two rows, one bit each when merged: 2 x 64 MB at most. A fuller sketch lets more unrepeated windows pass; it never loses one.
MAX_WIDTH, MIN_WIDTH = 1 << 29, 1 << 16
DEPTH = 2
AT_ONCE = 16 << 20  # bytes of a sketch's bits that are sent to the driver by one job
#: Cells of a sketch's levels, one byte each: 8 MB. Of a wider sketch, neighbours share a level, the highest of theirs.
LEVEL_CELLS = 1 << 23


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def cells(keys: np.ndarray, width: int) -> Iterator[np.ndarray]:
    for row in range(DEPTH):
        yield (mixed(keys ^ np.uint64(0xD6E8FEB86659FD93 * (row + 1) & (1 << 64) - 1)) >> np.uint64(20)) & np.uint64(width - 1)


class Sketch:
    """Cells that were counted twice or more, as bits; levels: the binary logarithm of the counts, to order keys by rarity."""

    def __init__(self, width: int, rows: list[np.ndarray], levels: np.ndarray | None = None, fold: int = 1):
        self.width, self.rows, self.levels, self.fold = width, rows, levels, fold

    def level(self, keys: np.ndarray) -> np.ndarray:
        """About the logarithm of a key's count: the same number wherever the key is met, which is all an order needs."""
        return self.levels[next(cells(keys, self.width)) // np.uint64(self.fold)]

    def repeated(self, keys: np.ndarray) -> np.ndarray:
        """True wherever a key may have been counted twice or more; never False where it was."""
        out = np.ones(len(keys), bool)
        for bits, cell in zip(self.rows, cells(keys, self.width), strict=True):
            out &= (bits[cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return out


def identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    modest(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return settled(docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text")), "texts")


def _ids(own: pa.Table) -> np.ndarray:
    return own.column("id").fill_null(int(NO_ID)).to_numpy()


def count_min(rows: DataFrame, keys: Callable, per_byte: float, limit: int, column: str = "text", fill: float = 4, only: Callable[[pa.Table], np.ndarray] | None = None, more: tuple[str, ...] = (), levels: bool = False) -> Sketch:
    """Merge the sketches of all tasks. keys: of the texts of a block (of the numbers, if the column holds them), each
    as often as it counts (at most twice each). per_byte: expected keys per byte, and fill: cells per key, for the width
    alone. only: which rows of a block count, by column and the columns `more`. levels: keep those of the counts, too.

    Tasks send their cells in sorted runs, dealt by cell; saturated sums are made where they meet, and only the bits
    of cells counted twice or more, of the width's bounded size, come to the driver: in one job if they are few, else
    by a job for each partition, as the driver then holds one partition's at a time besides the sketch.
    """
    spark = rows.sparkSession
    n = partitions(spark)
    held = rows.select(column, *more)
    numbers = held.dtypes[0][1] == "bigint"
    size = held.agg(F.sum(F.lit(8) if numbers else F.octet_length(column))).first()[0] or 0
    width = MIN_WIDTH
    while width < MAX_WIDTH and width < fill * per_byte * size:
        width *= 2
    slices = min(n, 256)
    fold = max(1, width // LEVEL_CELLS)
    unit = max(8, fold)
    span = -(-width // slices // unit) * unit
    kind, top = (np.uint16, (1 << 16) - 1) if levels else (np.uint8, 2)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in blocks(batches, limit, column):
            own = own.filter(pa.array(only(own))).combine_chunks() if only else own
            found = keys(own.column(column).to_numpy().view(np.uint64) if numbers else list(chain.from_iterable(binary(c) for c in own.column(column).chunks)))
            for row, cell in enumerate(cells(found, width)):
                cell = np.sort(cell.astype(np.int64))
                cut = np.searchsorted(cell, np.arange(slices + 1) * span)
                blobs = [pack(np.diff(cell[a:z] - p * span, prepend=0).astype(np.uint32)) for p, (a, z) in enumerate(zip(cut, cut[1:], strict=False)) if a < z]
                parts = [p for p in range(slices) if cut[p] < cut[p + 1]]
                yield pa.RecordBatch.from_arrays([pa.array([p * DEPTH + row for p in parts], pa.int32()), pa.array(blobs, pa.binary())], names=["part", "blob"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for part, blob in zip(b.column("part").to_pylist(), b.column("blob").to_pylist(), strict=True):
                cell = np.cumsum(unpack(blob)[0], dtype=np.int64)
                total = sums.setdefault(part, np.zeros(span, kind))
                found, times = np.unique(cell, return_counts=True)
                total[found] = np.minimum(total[found] + times, top)
        for part, total in sums.items():
            high = np.log2(np.maximum(total, 1)).astype(np.uint8).reshape(-1, fold).max(axis=1) if levels and part % DEPTH == 0 else None
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(total >= 2, bitorder="little").tobytes()], pa.binary()), pa.array([None if high is None else pack(high)], pa.binary())], names=["part", "blob", "high"])

    merged = held.mapInArrow(send, "part int, blob binary").repartition(n, "part").mapInArrow(merge, "part int, blob binary, high binary")
    bits = [np.zeros(slices * span // 8, np.uint8) for _ in range(DEPTH)]
    high = np.zeros(slices * span // fold if levels else 0, np.uint8)
    for r in merged.collect() if DEPTH * width // 8 <= AT_ONCE else merged.toLocalIterator(prefetchPartitions=True):
        p, row = divmod(r.part, DEPTH)
        bits[row][p * span // 8 : (p + 1) * span // 8] = np.frombuffer(r.blob, np.uint8)
        if r.high is not None:
            high[p * span // fold : (p + 1) * span // fold] = unpack(r.high)[0]
    return Sketch(width, bits, high if levels else None, fold)


Emit = Callable[[np.ndarray, np.ndarray, list[bytes]], tuple[np.ndarray, list[np.ndarray], dict[int, bytes]]]
Reduce = Callable[[list[int], list[bytes]], Iterator[tuple[int, np.ndarray]]]


def removed_spans(rows: DataFrame, emit: Emit, reduce: Reduce, width: int, limit: int) -> DataFrame:
    """(id, th, spans blob of starts and ends) of the documents that lose something.

    emit: (ids, text hashes, texts) of a block to (units of each text, [document, start, count] of the runs of windows
    that the block itself settles, blobs by part). reduce: (blocks, blobs) of a part to (block, [document, start,
    count]). A window of n units covers n + width - 1 units.
    """
    n = partitions(rows.sparkSession)
    names = ["part", "block", "kind", "blob"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, own in blocks(batches, limit):
            ids, ths = _ids(own), own.column("th").to_numpy()
            units, local, parts = emit(ids, ths, list(chain.from_iterable(binary(c) for c in own.column("text").chunks)))
            table = [(block % n, 0, pack(ids, ths, units)), (block % n, 1, pack(*local)), *((p, 2, b) for p, b in parts.items())]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in table], pa.int32()), pa.array([block] * len(table)), pa.array([x[1] for x in table], pa.int8()), pa.array([x[2] for x in table], pa.binary())], names=names)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, blobs = [], []
        for b in batches:
            for block, kind, blob in zip(*(b.column(c).to_pylist() for c in names[1:]), strict=True):
                if kind == 2:
                    held.append(block)
                    blobs.append(blob)
                else:
                    yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([kind], pa.int8()), pa.array([blob], pa.binary())], names=names[1:])
        for block, gone in reduce(held, blobs):  # empties blobs
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([1], pa.int8()), pa.array([pack(*gone)], pa.binary())], names=names[1:])
        trim()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, gone = None, None, []

        def result() -> pa.RecordBatch:
            ids, ths, units = own
            at = np.concatenate(([0], np.cumsum(units)))
            edge = np.zeros(at[-1] + 1, np.int32)
            for doc, start, count in gone:
                np.add.at(edge, at[doc] + start, 1)
                np.add.at(edge, at[doc] + start + count + (width - 1), -1)
            cover = np.cumsum(edge[:-1]) > 0
            out = []
            for k in np.unique(np.concatenate([g[0] for g in gone])) if gone else ():
                a, z = runs(cover[at[k] : at[k + 1]])
                if len(a):
                    out.append((ids[k], ths[k], pack(a, z)))
            return pa.RecordBatch.from_arrays([pa.array([int(x[0]) for x in out], pa.int64()), pa.array([int(x[1]) for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary())], names=["rid", "rth", "spans"])

        for b in batches:
            for block, kind, blob in zip(*(b.column(c).to_pylist() for c in names[1:]), strict=True):
                if block != now:
                    if now is not None:
                        yield result()
                    now, own, gone = block, None, []
                if kind == 0:
                    own = unpack(blob)
                elif len((x := unpack(blob))[0]):
                    gone.append(x)
        if now is not None:
            yield result()

    dealt = rows.mapInArrow(send, "part int, block long, kind byte, blob binary").repartition(n, "part")
    back = dealt.mapInArrow(settle, "block long, kind byte, blob binary").repartition(n, "block").sortWithinPartitions("block")
    return back.mapInArrow(gather, "rid long, rth long, spans binary").dropDuplicates(["rid", "rth"])


def with_spans(docs: DataFrame, spans: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """All rows and columns of docs, with __spans (null: nothing to remove)."""
    own = docs.withColumns({"__rid": F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(int(NO_ID))), "__rth": F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))})
    found = spans.select(F.col("rid").alias("__rid"), F.col("rth").alias("__rth"), F.col("spans").alias("__spans"))
    return own.join(found, ["__rid", "__rth"], "left").drop("__rid", "__rth")
