"""Benchmark decontamination as a prefix-filtered set join.

Every item gives windows of `window` consecutive words (one window if it has fewer). A window's shingles are ordered
by how often they occur in the documents; containment needs all of them, so the rarest alone is the necessary prefix
that documents are joined on. A match must leave room for the window's words before and after it inside the document
(length and positional bounds) and is then verified word by word.

The items' side is taken in slices of at most SLICE_BYTES of text, each of which is broadcast and matched in a pass of
its own; so its size is bounded whatever the benchmark's, and nothing of the documents is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm.common import binary, blocks, modest, runs, table

SLICE_BYTES = 8 << 20
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
WORD_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """A-Z lower-cased, then runs of [0-9a-z] and of all above ASCII."""
    return text.translate(WORD_TABLE).split()


def _keys(ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which `size` known words follow each other, and their keys."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    ok = ids[:n] >= 0
    for k in range(1, size):
        ok &= ids[k : n + k] >= 0
    at = np.flatnonzero(ok)
    key = np.full(len(at), size, np.uint64)
    for k in range(size):
        key = (key ^ (ids[at + k].astype(np.uint64) + np.uint64(1))) * np.uint64(MIX[k % 3])
        key ^= key >> np.uint64(29)
    return at, key


def _key(rows: np.ndarray, start: int, size: int) -> np.ndarray:
    """The keys of `size` words from column `start` on, as _keys() gives them."""
    key = np.full(len(rows), size, np.uint64)
    for k in range(size):
        key = (key ^ (rows[:, start + k].astype(np.uint64) + np.uint64(1))) * np.uint64(MIX[k % 3])
        key ^= key >> np.uint64(29)
    return key


class Windows:
    """The distinct windows of a slice of items, with the shingles that they are joined on."""

    def __init__(self, items: list[tuple[str, bytes]], window: int, shingle: int):
        self.window, vocab = window, {}
        self.names = sorted({item for item, _ in items})
        code = {item: k for k, item in enumerate(self.names)}
        words = [words_of(text) for _, text in items]
        flat = np.fromiter((vocab.setdefault(w, len(vocab)) for w in chain.from_iterable(words)), np.int32, sum(map(len, words)))
        size = np.array([len(w) for w in words], np.int64)
        del words
        many = np.where(size > 0, np.maximum(1, size - window + 1), 0)
        of = np.repeat(np.arange(len(items)), many)
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(np.cumsum(size) - size, many)
        length = np.minimum(size, window)[of]
        rows = flat[np.minimum(at[:, None] + np.arange(window), max(0, len(flat) - 1))] if len(flat) else np.zeros((0, window), np.int32)
        rows[np.arange(window) >= length[:, None]] = -2
        rows = np.ascontiguousarray(rows)
        _, first, which = np.unique(rows.view(np.dtype((np.void, 4 * window))).ravel(), return_index=True, return_inverse=True)
        owner = np.array([code[item] for item, _ in items], np.int64)[of]
        pair = np.unique(np.stack([which.ravel(), owner]), axis=1)
        self.vocab, self.ids, self.length = vocab, rows[first], length[first]
        self.item_at, self.item_of = np.searchsorted(pair[0], np.arange(len(first) + 1)), pair[1]
        self.size = np.minimum(self.length, shingle)
        self.shingles = {}  # size -> key, window, offset
        for n in np.unique(self.size).tolist():
            parts = []
            for have in np.unique(self.length[self.size == n]).tolist():
                own = np.flatnonzero(self.length == have)
                for start in range(have - n + 1):
                    parts.append((_key(self.ids[own], start, n), own, np.full(len(own), start)))
            self.shingles[n] = tuple(np.concatenate(x) for x in zip(*parts, strict=True))
        self.known = {n: np.unique(x[0]) for n, x in self.shingles.items()}

    def items(self, window: int) -> list[str]:
        return [self.names[k] for k in self.item_of[self.item_at[window] : self.item_at[window + 1]].tolist()]

    def choose(self, counts: dict[tuple[int, int], int]) -> None:
        """Keep each window's rarest shingle."""
        self.prefix = {}
        for size, (key, win, at) in self.shingles.items():
            known = self.known[size]
            total = np.array([counts.get((size, k), 0) for k in known.view(np.int64).tolist()], np.int64)
            n = total[np.searchsorted(known, key)]
            order = np.lexsort((at, n, win))
            first = order[np.unique(win[order], return_index=True)[1]]
            first = first[np.argsort(key[first], kind="stable")]
            keys, start, many = np.unique(key[first], return_index=True, return_counts=True)
            self.prefix[size] = keys, start, many, win[first], at[first]
        self.shingles = self.known = None

    def word_ids(self, words: list[list[bytes]]) -> np.ndarray:
        return np.fromiter(map(self.vocab.get, chain.from_iterable(words), repeat(-1)), np.int32, sum(map(len, words)))

    def match(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, window) of all windows that occur; starts: of the documents, and the end."""
        out = []
        for size, (keys, first, many, win, off) in self.prefix.items():
            at, key = _keys(ids, size)
            slot = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = np.flatnonzero(keys[slot] == key)
            at, slot = at[hit], slot[hit]
            n = many[slot]
            row = np.repeat(first[slot], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = np.repeat(at, n)
            doc = np.searchsorted(starts, at, "right") - 1
            w, begin = win[row], at - off[row]
            room = (begin >= starts[doc]) & (begin + self.length[w] <= starts[doc + 1])
            w, begin = w[room], begin[room]
            for a in range(0, len(w), 1 << 18):
                x, b = w[a : a + (1 << 18)], begin[a : a + (1 << 18)]
                span = ids[np.minimum(b[:, None] + np.arange(self.window), len(ids) - 1)]
                same = ((span == self.ids[x]) | (self.ids[x] == -2)).all(axis=1)
                out.append((b[same], x[same]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _starts(words: list[list[bytes]]) -> np.ndarray:
    return np.concatenate(([0], np.cumsum([len(w) for w in words], dtype=np.int64)))


def _slices(items: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[str, bytes]]]:
    own = items.select(F.col(f"`{item_col}`").cast("string").alias("item"), F.col(f"`{text_col}`").cast("binary").alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
    size = own.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-size // SLICE_BYTES)
    for k in range(n):
        yield [(r.item, bytes(r.text)) for r in (own if n == 1 else own.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)).collect()]


def decontaminate(docs: DataFrame, items: DataFrame, keep: list[str] | None = None, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, shingle: int = 3) -> DataFrame:
    """The columns `keep` of docs (default: all), with n_words long, n_hit long, spans array of (start, end) of the hit
    words, and items array of the ids of the items that have an occurring window, sorted as strings.

    Null and empty texts have no words. Items with a null id or text take no part; items that share an id count as
    one. Rows of docs may repeat; each is judged alone; an empty table gives an empty table. Columns of docs named like
    a result give way to it. No items: nothing is hit. Whole texts of any length are matched, in blocks of documents.
    """
    spark = docs.sparkSession
    modest(spark)
    keep = [c for c in (keep or docs.columns) if c not in ("n_words", "n_hit", "spans", "items")]
    now = docs.select(F.col(f"`{text_col}`").alias("__text"), *(F.col(f"`{c}`") for c in keep), F.lit(0).cast("long").alias("n_words"), F.lit(None).cast("binary").alias("__hit"), F.array().cast("array<string>").alias("items"))
    texts = docs.select(F.col(f"`{text_col}`").alias("__text"))
    for part in _slices(items, item_col, item_text_col):
        index = Windows(part, window, shingle)
        if not len(index.length):
            continue
        seen = spark.sparkContext.broadcast(index)

        def count(batches: Iterator[pa.RecordBatch], seen=seen) -> Iterator[pa.RecordBatch]:
            own = seen.value
            total = {size: np.zeros(len(k), np.int64) for size, k in own.known.items()}
            for _, rows in blocks(batches, text="__text"):
                words = [words_of(t) for t in chain.from_iterable(binary(c) for c in rows.column("__text").chunks)]
                ids = own.word_ids(words)
                for size, known in own.known.items():
                    _, key = _keys(ids, size)
                    slot = np.minimum(np.searchsorted(known, key), len(known) - 1)
                    total[size] += np.bincount(slot[known[slot] == key], minlength=len(known))
            for size, n in total.items():
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), size, np.int32)), pa.array(own.known[size][some].view(np.int64)), pa.array(n[some])], names=["size", "key", "n"])

        counts = texts.mapInArrow(count, "size int, key long, n long").groupBy("size", "key").agg(F.sum("n").alias("n")).collect()  # at most one row per shingle of the slice
        index.choose({(r["size"], r["key"]): r["n"] for r in counts})
        chosen = spark.sparkContext.broadcast(index)

        def match(batches: Iterator[pa.RecordBatch], chosen=chosen) -> Iterator[pa.RecordBatch]:
            own = chosen.value
            for _, rows in blocks(batches, text="__text"):
                words = [words_of(t) for t in chain.from_iterable(binary(c) for c in rows.column("__text").chunks)]
                starts = _starts(words)
                at, win = own.match(own.word_ids(words), starts)
                edge = np.zeros(starts[-1] + 1, np.int32)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + own.length[win], -1)
                hit = np.cumsum(edge[:-1]) > 0
                found: dict[int, set[str]] = {}
                for k, w in np.unique(np.stack([np.searchsorted(starts, at, "right") - 1, win]), axis=1).T.tolist() if len(at) else ():
                    found.setdefault(k, set()).update(own.items(w))
                masks, lists = [], rows.column("items").to_pylist()
                for k, old in enumerate(rows.column("__hit").to_pylist()):
                    own_hit = hit[starts[k] : starts[k + 1]]
                    if old is not None:
                        own_hit = own_hit | np.unpackbits(np.frombuffer(old, np.uint8), count=len(own_hit)).astype(bool)
                    masks.append(np.packbits(own_hit).tobytes() if own_hit.any() else None)
                    if k in found:
                        lists[k] = sorted({*(lists[k] or ()), *found[k]})
                new = {"n_words": pa.array(np.diff(starts)), "__hit": pa.array(masks, pa.binary()), "items": pa.array(lists, pa.list_(pa.string()))}
                yield from pa.Table.from_arrays([new.get(c, rows.column(c)) for c in rows.schema.names], names=rows.schema.names).combine_chunks().to_batches()

        now = now.mapInArrow(match, now.schema)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, hits, spans = b.column("n_words").to_pylist(), [], []
            if not any(n):
                n = [len(words_of(t)) for t in binary(b.column("__text"))]
            for k, mask in zip(n, b.column("__hit").to_pylist(), strict=True):
                hit = np.unpackbits(np.frombuffer(mask, np.uint8), count=k).astype(bool) if mask else np.zeros(0, bool)
                hits.append(int(hit.sum()))
                spans.append([{"start": a, "end": z} for a, z in zip(*(x.tolist() for x in runs(hit)), strict=True)])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(n, pa.int64()), pa.array(hits, pa.int64()), pa.array(spans, kind), b.column("items")], names=[*keep, "n_words", "n_hit", "spans", "items"])

    kinds = ", ".join(f"`{c}` {now.schema[c].dataType.simpleString()}" for c in keep)
    return now.mapInArrow(finish, f"{kinds + ', ' if kinds else ''}n_words long, n_hit long, spans array<struct<start: long, end: long>>, items array<string>")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
