"""Token counts without token ids: pieces are counted once per distinct pre-token and joined to each document's
pre-token frequencies.

Blocks of documents turn into frequencies (document, pre-token, times), dealt by a hash of the pre-token as compressed
columns, one blob per block and part. A part's task counts the pieces of each distinct pre-token once, looks them up
(the join) and returns each block's partial sums, which meet again per block. A frequent pre-token is one entry per
document and block; so no part is hot, and memory is bounded by a block or by a part's distinct pre-tokens.

Splitting is exact because no piece of the vocabulary crosses the cut: pre-tokens are cut before a run of the space
marker and around line feeds, which is checked when the model is loaded.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm.common import binary, blocks, modest, pack, partitions, settled, table, unpack

MARK = "▁".encode()
PRE_TOKEN = re.compile(rb" *[^ \n]+|\n| +")
NO_PREFIX = b"\x1a\x02\x18\x00"  # normalizer_spec { add_dummy_prefix: false }, merged onto a model's own


def pre_tokens(text: bytes) -> list[bytes]:
    """Of a whole text, with the leading marker that the model adds; spaces stand for markers."""
    return PRE_TOKEN.findall(b" " + text.replace(MARK, b" ")) if text else []


class PieceCounter:
    """Numbers of pieces of pre-tokens, each counted once."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model + NO_PREFIX)
        for k in range(self.sp.get_piece_size()):
            piece = self.sp.id_to_piece(k).encode()
            bare = piece.lstrip(b"\xe2\x96\x81") if piece.startswith(MARK) else piece
            if MARK in bare or b"\n" in piece and piece != b"\n":
                raise ValueError(f"piece {piece!r} crosses a pre-token's end")
        self.known: dict[bytes, int] = {}

    def __call__(self, tokens: list[bytes]) -> np.ndarray:
        known = self.known
        if new := [t for t in tokens if t not in known]:
            known.update(zip(new, map(len, self.sp.encode([t.decode() for t in new], num_threads=1)), strict=True))
        return np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))


def _ipc(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes()


def token_counts(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: (id, n_bytes, n_tokens), as the sentencepiece library counts the whole text, without
    added tokens. model: the bytes of a .model file. Null is empty; empty has no tokens. Repeated rows and null ids are
    counted row by row; an empty table gives an empty table; other columns are ignored.
    """
    modest(docs.sparkSession)
    rows = settled(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), "texts")
    kind, n = rows.schema["id"].dataType.simpleString(), partitions(docs.sparkSession)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, own in blocks(batches):
            texts = list(chain.from_iterable(binary(c) for c in own.column("text").chunks))
            ids: dict[bytes, int] = {}
            doc, tok, times = [], [], []
            for text in texts:
                found = Counter(pre_tokens(text))
                doc.append(len(found))
                tok += [ids.setdefault(t, len(ids)) for t in found]
                times += found.values()
            part = np.fromiter((zlib.crc32(t) % n for t in ids), np.int32, len(ids))
            size = np.fromiter(map(len, ids), np.int32, len(ids))
            names = list(ids)
            tok, times = np.array(tok, np.int32), np.array(times, np.int32)
            doc = np.repeat(np.arange(len(texts), dtype=np.int32), doc)
            by_part = np.argsort(part[tok], kind="stable")
            cut = np.searchsorted(part[tok][by_part], np.arange(n + 1))
            lengths = pa.array([len(t) for t in texts], pa.int64())
            table = pa.RecordBatch.from_arrays([own.column("id").combine_chunks() if own.num_rows else pa.array([]), lengths], names=["id", "n_bytes"])
            yield pa.RecordBatch.from_arrays([pa.array([block % n], pa.int32()), pa.array([block]), pa.array([True]), pa.array([_ipc(table)], pa.binary())], names=["part", "block", "docs", "blob"])
            for p in range(n):
                at = by_part[cut[p] : cut[p + 1]]
                if len(at):
                    used, code = np.unique(tok[at], return_inverse=True)
                    text = np.frombuffer(b"".join(names[k] for k in used.tolist()), np.uint8)
                    blob = pack(size[used], text, np.diff(doc[at], prepend=0), code.astype(np.int32), times[at])
                    yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([block]), pa.array([False]), pa.array([blob], pa.binary())], names=["part", "block", "docs", "blob"])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = PieceCounter(model)
        for b in batches:
            out = []
            for is_docs, blob in zip(b.column("docs").to_pylist(), b.column("blob").to_pylist(), strict=True):
                if not is_docs:
                    size, text, doc, code, times = unpack(blob)
                    end, raw = np.cumsum(size), text.tobytes()
                    pieces = count([raw[e - s : e] for s, e in zip(size.tolist(), end.tolist(), strict=True)])
                    total = np.bincount(np.cumsum(doc), pieces[code] * times).astype(np.int64)
                    some = np.flatnonzero(total)
                    blob = pack(some.astype(np.int32), total[some])
                out.append(blob)
            yield pa.RecordBatch.from_arrays([b.column("block"), b.column("docs"), pa.array(out, pa.binary())], names=["block", "docs", "blob"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, parts = None, None, []

        def result() -> pa.RecordBatch:
            total = np.zeros(own.num_rows, np.int64)
            for at, k in parts:
                total[at] += k
            return pa.RecordBatch.from_arrays([own.column("id"), own.column("n_bytes"), pa.array(total)], names=["id", "n_bytes", "n_tokens"])

        for b in batches:
            for block, is_docs, blob in zip(*(b.column(c).to_pylist() for c in ("block", "docs", "blob")), strict=True):
                if block != now:
                    if now is not None:
                        yield result()
                    now, own, parts = block, None, []
                if is_docs:
                    own = pa.ipc.open_stream(blob).read_all().combine_chunks().to_batches()[0]
                else:
                    parts.append(unpack(blob))
        if now is not None:
            yield result()

    dealt = rows.mapInArrow(frequencies, "part int, block long, docs boolean, blob binary").repartition(n, "part")
    summed = dealt.mapInArrow(sums, "block long, docs boolean, blob binary")
    return summed.repartition(n, "block").sortWithinPartitions("block").mapInArrow(finish, f"id {kind}, n_bytes long, n_tokens long")


def model_bytes(name: str) -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts(table(spark, sf_dir, "documents"), model_bytes("piece_bpe_32k.model"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))
