"""SentencePiece models on the tokenizers library.

The model's protobuf is parsed here and rebuilt as a tokenizers Tokenizer: normaliser, space marker, pieces with their
scores (unigram) or the merges that the scores rank (BPE), and byte fallback. Distinct pre-tokens of a block of
documents are encoded in multithreaded batches and laid out per document; models whose pieces cross pre-tokens encode
whole texts. Parity is verified while encoding: each distinct pre-token (or text) also goes through the sentencepiece
library; a document with one that differs is marked, and encoded by that library instead.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm.common import binary, blocks, modest, table, trim
from netloom.llm.token_counts import MARK, NO_PREFIX, model_bytes, pre_tokens

NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6  # piece types
UNIGRAM, BPE = 1, 2  # model types
BLOCK, THREADS = 4 << 20, 2
BATCH, WORDS = 10_000, 200_000  # pre-tokens encoded at once, and remembered before all are forgotten


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protobuf message; fixed-width values as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, data[at : at + size]
        at += size


class PieceModel:
    """What a .model file says."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        trainer, normalizer = {}, {}
        for number, value in fields(data):
            if number == 1:
                own = dict(fields(value))
                self.pieces.append((own.get(1, b"").decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
            elif number == 2:
                trainer |= dict(fields(value))
            elif number == 3:
                normalizer |= dict(fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        self.byte_fallback = bool(trainer.get(35, 0))
        self.unknown = next(k for k, p in enumerate(self.pieces) if p[2] == UNKNOWN)
        self.charsmap = normalizer.get(2, b"")
        self.prefix, self.squeeze, self.escape = (bool(normalizer.get(k, 1)) for k in (3, 4, 5))

    def merges(self) -> list[tuple[str, str]]:
        """Every way to join two pieces into a third, best score first."""
        ids = {p: k for k, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER)}
        found = []
        for piece, score, kind in self.pieces:
            if kind == NORMAL:
                for cut in range(1, len(piece)):
                    left, right = ids.get(piece[:cut]), ids.get(piece[cut:])
                    if left is not None and right is not None:
                        found.append((-score, left, right, piece[:cut], piece[cut:]))
        return [x[3:] for x in sorted(found)]

    def splits(self) -> bool:
        """Whether no piece crosses the end of a pre-token, and nothing but the marker changes the text."""
        fine = all(MARK.decode() not in p.lstrip(MARK.decode()) and ("\n" not in p or p == "\n") for p, _, kind in self.pieces if kind in (NORMAL, USER))
        return fine and self.prefix and self.escape and not self.squeeze and not self.charsmap

    def tokenizer(self, whole: bool = True):
        """whole=False: for pre-tokens, whose leading marker is there already."""
        from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

        if self.kind == UNIGRAM:
            tokenizer = Tokenizer(models.Unigram([(p, s) for p, s, _ in self.pieces], self.unknown, self.byte_fallback))
        elif self.kind == BPE:
            tokenizer = Tokenizer(models.BPE({p: k for k, (p, _, _) in enumerate(self.pieces)}, self.merges(), unk_token=self.pieces[self.unknown][0], fuse_unk=True, byte_fallback=self.byte_fallback))
        else:
            raise ValueError(f"model type {self.kind} has no counterpart")
        steps = []
        if self.charsmap:
            steps.append(normalizers.Precompiled(self.charsmap))
        if self.squeeze:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        if self.prefix and whole:
            steps.append(normalizers.Prepend("▁"))
        if self.escape:
            steps.append(normalizers.Replace(" ", "▁"))
        tokenizer.normalizer = normalizers.Sequence(steps)
        if user := [AddedToken(p, normalized=False) for p, _, kind in self.pieces if kind == USER]:
            tokenizer.add_tokens(user)
        end = [decoders.Strip(" ", 1, 0)] if self.prefix else []
        tokenizer.decoder = decoders.Sequence([decoders.Replace("▁", " "), decoders.ByteFallback(), decoders.Fuse(), *end])
        return tokenizer


class Encoder:
    """Token ids of documents, as the sentencepiece library gives them for whole texts, and back."""

    def __init__(self, data: bytes, threads: int = THREADS):
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        import sentencepiece

        self.model = PieceModel(data)
        self.by_words = self.model.splits()
        self.whole = self.model.tokenizer()
        self.words = self.model.tokenizer(whole=False) if self.by_words else None
        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=data + NO_PREFIX)
        self.bytes = [bytes([int(p[3:-1], 16)]) if kind == BYTE else p.replace("▁", " ").encode() for p, _, kind in self.model.pieces]
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.size, self.flat, self.bad = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, bool)

    def _learn(self, words: list[bytes]) -> None:
        """Encode new pre-tokens in batches and verify each against the library."""
        sizes, flats, bads = [self.size], [self.flat], [self.bad]
        for a in range(0, len(words), BATCH):
            some = [w.decode() for w in words[a : a + BATCH]]
            mine = [x.ids for x in self.words.encode_batch_fast(some, add_special_tokens=False)]
            bads.append(np.fromiter((x != y for x, y in zip(mine, self.bare.encode(some), strict=True)), bool, len(some)))
            sizes.append(np.fromiter(map(len, mine), np.int64, len(mine)))
            flats.append(np.fromiter(chain.from_iterable(mine), np.int32, int(sizes[-1].sum())))
        self.size, self.flat, self.bad = np.concatenate(sizes), np.concatenate(flats), np.concatenate(bads)

    def encode(self, texts: list[bytes]) -> tuple[list[np.ndarray], list[bool]]:
        """(ids of each text, whether the library's differ from the tokenizer's)."""
        if not self.by_words:
            strings = [t.decode() for t in texts]
            mine = chain.from_iterable(self.whole.encode_batch_fast(strings[a : a + 256], add_special_tokens=False) for a in range(0, len(strings), 256))
            out, differ = [], []
            for text, own in zip(strings, mine, strict=True):
                ids, checked = own.ids, self.library.encode(text)
                differ.append(ids != checked)
                out.append(np.array(checked if differ[-1] else ids, np.int32))
            return out, differ
        if len(self.known) > WORDS:
            self.forget()
        known, before = self.known, len(self.known)
        docs = [[known.setdefault(w, len(known)) for w in pre_tokens(t)] for t in texts]
        self._learn(list(islice(known, before, None)))
        begin = np.cumsum(self.size) - self.size
        out, differ, any_bad = [], [], self.bad.any()
        for text, doc in zip(texts, docs, strict=True):
            w = np.array(doc, np.int64)
            differ.append(bool(any_bad and self.bad[w].any()))
            if differ[-1]:
                out.append(np.array(self.library.encode(text.decode()), np.int32))
            else:
                n = self.size[w]
                out.append(self.flat[np.repeat(begin[w] - (np.cumsum(n) - n), n) + np.arange(n.sum())])
        return out, differ

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """By the pieces' bytes; ids that don't make whole UTF-8 characters go through the tokenizer's own decoder."""
        out = []
        for own in ids:
            own = own.tolist()
            try:
                text = b"".join(map(self.bytes.__getitem__, own)).decode()
                out.append(text[1:] if self.model.prefix and text[:1] == " " else text)
            except UnicodeDecodeError:
                out.append(self.whole.decode(own, skip_special_tokens=False))
        return out


@lru_cache(maxsize=2)
def encoder(data: bytes, threads: int) -> Encoder:
    """Kept between the tasks of a Python worker."""
    return Encoder(data, threads)


def encode_pieces(docs: DataFrame, model: bytes, text_col: str = "text", threads: int = THREADS, decoded: str | None = None) -> DataFrame:
    """All columns of docs, with ids (array of int), differ (whether the two libraries' ids differ; ids are then those of
    sentencepiece) and, if a name is given, the text decoded from them. Null and empty texts have no ids and decode to
    an empty text. Columns of docs named like a result give way to it.

    Rows are encoded one by one whatever they repeat; texts of any length are encoded whole; an empty table gives an
    empty table.
    """
    modest(docs.sparkSession)
    keep = [c for c in docs.columns if c not in ("ids", "differ", decoded)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_encoder = encoder(model, threads)
        for _, own in blocks(batches, BLOCK, text_col):
            ids, differ = own_encoder.encode(list(chain.from_iterable(binary(c) for c in own.column(text_col).chunks)))
            ends = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32()))
            more = [pa.array(own_encoder.decode(ids), pa.string())] if decoded else []
            t = pa.table([*(own.column(c) for c in keep), lists, pa.array(differ, pa.bool_()), *more], names=[*keep, "ids", "differ", *([decoded] if decoded else [])])
            yield from t.combine_chunks().to_batches(max_chunksize=1024)
        own_encoder.forget()
        trim()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep)
    return docs.select(*(F.col(f"`{c}`") for c in keep)).mapInArrow(run, f"{kinds}, ids array<int>, differ boolean" + (f", `{decoded}` string" if decoded else ""))


def decode_pieces(rows: DataFrame, model: bytes, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns of rows, with the text of the ids; null ids decode to an empty text."""
    keep = [c for c in rows.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 1024):
                b = whole.slice(a, 1024)
                texts = encoder(model, THREADS).decode([np.array(x or [], np.int32) for x in b.column(ids_col).to_pylist()])
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(texts, pa.string())], names=[*keep, out])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep)
    return rows.select(*(F.col(f"`{c}`") for c in keep)).mapInArrow(run, f"{kinds}, `{out}` string")


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, the text decoded from them, whether it is the text (with the marker as a space), and
    whether the two libraries differ."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = encode_pieces(docs, model_bytes("piece_bpe_32k.model"), decoded="decoded")
    same = F.col("decoded") == F.translate(F.coalesce("text", F.lit("")), "▁", " ")
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded", same.alias("round_trip"), "differ")
