"""Substring dedup over windows of words with a count-min prefilter.

First pass: each window is sketched by the least hash of its word shingles, which a repeated window repeats too, once
per document and run of windows that share it; so the merged sketch overestimates every window's count of documents.
Second pass: only windows estimated repeated are grouped exactly, by 128-bit digests of their words, within a block of
documents and then across blocks, where one entry per block and window arrives whatever the number of copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm.common import binary, pack, partitions, slices, table, unpack
from netloom.llm.repeats import count_min, identified, mixed, removed_spans, with_spans

SHINGLE, BLOCK = 5, 4 << 20


class _Digests(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self.seen)
        self.seen.append(xxhash.xxh3_128_digest(word))
        return value


def _word_hashes(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    known = _Digests()
    known.seen = []
    ids = np.fromiter(map(known.__getitem__, chain.from_iterable(words)), np.int64, sum(map(len, words)))
    halves = np.frombuffer(b"".join(known.seen), np.uint64).reshape(-1, 2)
    return ids, np.ascontiguousarray(halves[:, 0]), np.ascontiguousarray(halves[:, 1])


def _rolled(h: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Hash of every `size` consecutive values."""
    factors = np.random.default_rng(seed).integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for k, f in enumerate(factors):
        out += mixed(h[k : k + len(out)] ^ f) * f
    return mixed(out)


def _sliding_min(h: np.ndarray, size: int) -> np.ndarray:
    have = 1
    while have < size:
        step = min(have, size - have)
        h = np.minimum(h[: len(h) - step], h[step:])
        have += step
    return h


def _windows(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, document) of every window that lies in one document."""
    many = np.maximum(0, lengths - size + 1)
    doc = np.repeat(np.arange(len(lengths)), many)
    at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(np.cumsum(lengths) - lengths, many)
    return at, doc


def _minima(ids: np.ndarray, low: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    shingle = min(SHINGLE, size)
    return _sliding_min(_rolled(low[ids], shingle, 11), size - shingle + 1)[at] if len(at) else np.zeros(0, np.uint64)


def dedup_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 13) -> DataFrame:
    """All columns of docs, with n_words long, removed (array of (start, end) word spans) and kept string (the kept
    words joined by one space): a word goes if a window of `size` words that covers it also starts in a document with a
    smaller id. Windows are judged on the input.

    Null and empty texts have no words; texts of fewer than `size` words keep all. Rows that repeat an id never remove
    from each other; null ids count as the largest and never remove from each other. Columns of docs named like a
    result give way to it.
    """
    rows, n = identified(docs, id_col, text_col), partitions(docs.sparkSession)

    def keys(texts: list[bytes]) -> np.ndarray:
        words = [t.split() for t in texts]
        ids, low, _ = _word_hashes(words)
        at, doc = _windows(np.array([len(w) for w in words], np.int64), size)
        key = _minima(ids, low, at, size)
        first = np.ones(len(key), bool)
        first[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
        key, doc = key[first], doc[first]
        order = np.lexsort((key, doc))
        key, doc = key[order], doc[order]
        first = np.ones(len(key), bool)
        first[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
        return key[first]

    sketch = docs.sparkSession.sparkContext.broadcast(count_min(rows, keys, 1 / 30, BLOCK))

    def emit(doc_ids: np.ndarray, _: np.ndarray, texts: list[bytes]):
        words = [t.split() for t in texts]
        lengths = np.array([len(w) for w in words], np.int64)
        ids, low, high = _word_hashes(words)
        del words
        at, doc = _windows(lengths, size)
        some = np.flatnonzero(sketch.value.repeated(_minima(ids, low, at, size)))
        at, doc = at[some], doc[some]
        if not len(at):
            return lengths, [np.zeros(0, np.int64)] * 3, {}
        a, b = _rolled(low[ids], size, 21)[at], _rolled(high[ids], size, 22)[at]
        start, owner = at - (np.cumsum(lengths) - lengths)[doc], doc_ids[doc]
        order = np.lexsort((start, owner, b, a))
        a, b, doc, start, owner = a[order], b[order], doc[order], start[order], owner[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        least = owner[np.flatnonzero(new)][np.cumsum(new) - 1]
        gone = owner > least
        local = [doc[gone].astype(np.int32), start[gone].astype(np.int32), np.ones(gone.sum(), np.int32)]
        a, b, doc, start, owner = (x[~gone] for x in (a, b, doc, start, owner))
        part = (a >> np.uint64(24)) % np.uint64(n)
        order = np.argsort(part, kind="stable")
        cut = np.searchsorted(part[order], np.arange(n + 1, dtype=np.uint64))
        parts = {}
        for p in range(n):
            if len(o := order[cut[p] : cut[p + 1]]):
                parts[p] = pack(a[o], b[o], owner[o], doc[o].astype(np.int32), start[o].astype(np.int32))
        return lengths, local, parts

    def reduce(held: list[int], blobs: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
        if not held:
            return
        cols = list(zip(*map(unpack, blobs), strict=True))
        blobs.clear()
        a, b, owner, doc, start = (np.concatenate(c) for c in cols)
        source = np.repeat(np.arange(len(held)), [len(x) for x in cols[0]])
        order = np.lexsort((owner, b, a))
        a, b, owner = a[order], b[order], owner[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        gone = order[owner > owner[np.flatnonzero(new)][np.cumsum(new) - 1]]
        gone = gone[np.lexsort((start[gone], doc[gone], source[gone]))]
        cut = np.searchsorted(source[gone], np.arange(len(held) + 1))
        for k, block in enumerate(held):
            if len(o := gone[cut[k] : cut[k + 1]]):
                yield block, [doc[o], start[o], np.ones(len(o), np.int32)]

    spans = removed_spans(rows, emit, reduce, size, BLOCK)
    joined = with_spans(docs.drop("n_words", "removed", "kept"), spans, id_col, text_col)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            count, gone, kept = [], [], []
            for text, blob in zip(binary(b.column(text_col)), b.column("__spans").to_pylist(), strict=True):
                words = text.split()
                count.append(len(words))
                a, z = (x.tolist() for x in unpack(blob)) if blob else ([], [])
                gone.append([{"start": s, "end": e} for s, e in zip(a, z, strict=True)])
                kept.append(b" ".join(chain.from_iterable(words[s:e] for s, e in zip([0, *z], [*a, len(words)], strict=True))))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            keep = [c for c in b.schema.names if c != "__spans"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(count, pa.int64()), pa.array(gone, kind), pa.array(kept, pa.binary()).cast(pa.string())], names=[*keep, "n_words", "removed", "kept"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema if f.name != "__spans")
    return joined.mapInArrow(finish, f"{kinds}, n_words long, removed array<struct<start: long, end: long>>, kept string")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_words(table(spark, sf_dir, "documents").select("doc_id", "text"))
    lost = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", lost.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
