"""Token-id files: whole texts as ids of a tokenizers file, ordered by document id, in context-mixed blocks.

Documents are range-partitioned and sorted by id; each task writes its part as a shard of segments. A segment holds
whole documents: their ids and lengths, and the token ids as blocks of the coder of netloom.llm.mixing, each with a
checksum. The files are a Parquet dataset, so any store that Spark writes to will do, and any segment, and any block in
it, can be decoded alone. Bytes of the payload: the number of blocks, their sizes (32-bit little-endian each), the
blocks.

Texts are encoded by distinct chunks, which is exact for byte-level tokenizers: a chunk is a run of white space and what
follows it, cut where ASCII letters, digits and other signs meet, and pre-tokens never cross such a place (apostrophes
and all above ASCII are never cut off). Chunks are found for all texts of a portion at once, by byte classes, and told
apart by a hash table of their first 16 bytes; whatever differs from its place's chunk is told apart by its bytes. Texts with white space outside ASCII or with an added token's content, and
texts for other tokenizers, are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netloom.llm import mixing
from netloom.llm.common import binary, blocks, modest, pack, partitions, shared_dir, slices, table, trim, unpack
from netloom.llm.token_counts import model_bytes

SEGMENT, PIECE = 16 << 20, 8 << 20  # bytes of text in a segment, and of those encoded at once
BATCH, CHUNKS = 10_000, 600_000  # texts or chunks encoded at once; chunks remembered, before those used once are forgotten
LINES = 5000  # words given to the model as one text
_SIGN, _OTHER = rb"[!-&(-/:-@\[-`{-~]", rb"['\x00-\x08\x0e-\x1f\x7f-\xff]"
_RUN = rb"(?:[A-Za-z]++|[0-9]++|" + _SIGN + rb"++)"
CHUNK = re.compile(rb"[ \t-\r]*+(?:(?:" + _RUN + rb"?+" + _OTHER + rb"++)++" + _RUN + rb"?+|" + _RUN + rb")|[ \t-\r]++")
LATIN = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4-\xc8][\x80-\xbf]|\xc9[\x80-\x8f])+")  # letters below U+0250
OTHER_SPACE = rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80"  # UTF-8
SCHEMA = "shard int, seq int, n_ids long, docs binary, payload binary"


def _tables() -> tuple[bytes, bytes]:
    """(class of each byte; by two bytes' classes, 8 times the first and the second: 1 where a chunk begins)."""
    kinds = rb"[ \t-\r]", _OTHER, rb"[A-Za-z]", rb"[0-9]", _SIGN
    kind = bytes(next(k for k, x in enumerate(kinds) if re.fullmatch(x, bytes([b]))) for b in range(256))
    return kind, bytes(b < 40 and (b % 8 == 0 < b or 1 < b % 8 != b // 8 > 1) for b in range(256))


KIND, BEGINS = _tables()
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def chunk_bounds(raw: bytes, ends: np.ndarray) -> np.ndarray:
    """Where the chunks of texts begin, which are CHUNK's matches, and the end; raw: the texts, `ends`: their ends in it."""
    begin = np.zeros(len(raw) + 1, bool)
    if len(raw) > 1:
        kind = np.frombuffer(raw.translate(KIND), np.uint8)
        begin[1:-1] = np.frombuffer((kind[:-1] << 3 | kind[1:]).tobytes().translate(BEGINS), bool)
    begin[0] = True
    begin[ends] = True
    return np.flatnonzero(begin)


def distinct_chunks(raw: bytes, bounds: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """(distinct chunks, the number of each chunk among them)."""
    at, size = bounds[:-1], np.diff(bounds)
    if not len(at):
        return [], np.zeros(0, np.int64)
    window = np.ndarray((len(raw) + 9,), "<u8", raw + bytes(16), strides=(1,))
    key = window[at] & MASKS.take(size, mode="clip") | size.astype(np.uint64) << np.uint64(56)  # the whole of a chunk of 7 bytes
    long = np.flatnonzero(size > 7)
    head, tail = window[at[long]], window[at[long] + 8] & MASKS.take(size[long] - 8, mode="clip")
    mixed = head * np.uint64(0x9E3779B97F4A7C15) ^ tail * np.uint64(0xC2B2AE3D27D4EB4F)
    key[long] = (mixed ^ mixed >> np.uint64(29)) & MASKS[7] | size[long].astype(np.uint64) << np.uint64(56)
    bits = len(at).bit_length() + 1
    place = (key ^ key >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    place = (place >> np.uint64(64 - bits)).astype(np.int64)
    held = np.zeros(1 << bits, np.int32)
    held[place] = np.arange(len(at), dtype=np.int32)
    like = held.take(place)  # a chunk with the same place
    other = key.take(like) != key
    row = np.zeros(len(at), np.int32)
    row[long] = np.arange(len(long))
    twin = row.take(like[long])
    other[long] |= (head.take(twin) != head) | (tail.take(twin) != tail) | (size[long] > 16)
    other = np.flatnonzero(other)
    used = np.zeros(len(at), bool)
    used[np.delete(like, other)] = True  # all chunks like one in `other` are in it as well
    names = [raw[a:z] for a, z in zip(at[used].tolist(), bounds[1:][used].tolist(), strict=True)]
    code = (np.cumsum(used) - 1).take(like)
    if len(other):  # these have no number yet
        more = _Codes(zip(names, range(len(names)), strict=True))
        code[other] = [more[raw[a:z]] for a, z in zip(at[other].tolist(), bounds[1:][other].tolist(), strict=True)]
        names = list(more)
    return names, code


class _Codes(dict):
    def __missing__(self, chunk: bytes) -> int:
        self[chunk] = code = len(self)
        return code


def byte_letters() -> list[str]:
    """The letter that byte-level tokenizers write for each byte: printable ones stand for themselves, the others follow from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class Chunks:
    """Ids of whole texts, as the tokenizers library gives them, by distinct chunks where that is exact."""

    def __init__(self, tokenizer_json: bytes):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_str(tokenizer_json.decode())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        own = json.loads(tokenizer_json)
        before, added = own.get("pre_tokenizer") or {}, [a["content"] for a in own.get("added_tokens") or ()]
        self.exact = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not own.get("normalizer")
        self.apart = re.compile(b"|".join([OTHER_SPACE, *(re.escape(a.encode()) for a in added if a)]))
        self.letters = {b: c for b, c in enumerate(byte_letters())}
        self.lines = Tokenizer(self.tokenizer.model)
        self.lines.pre_tokenizer = CharDelimiterSplit("\n")
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.width = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)  # bytes of each id
        self.width[list(vocabulary.values())] = [len(x) for x in vocabulary]
        self.known = _Codes({b"": 0})  # 0 stands for the end of a text
        self.size, self.flat, self.uses = np.ones(1, np.int64), np.zeros(1, np.uint32), np.zeros(1, np.int64)

    def _whole(self, texts: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = []
        for a in range(0, len(texts), BATCH):
            out += [x.ids for x in self.tokenizer.encode_batch_fast([t.decode() for t in texts[a : a + BATCH]], add_special_tokens=False)]
        return out

    def _words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids of each). A space and Latin letters alone are one pre-token, which the model
        takes without the steps before it: here a line of letters that stand for bytes. Ids are told apart by their bytes."""
        lines = b"\n".join(words).decode("latin-1").translate(self.letters).split(self.letters[10])
        texts = ["\n".join(lines[k : k + LINES]) for k in range(0, len(lines), LINES)]
        flat = np.concatenate([np.array(x.ids, np.uint32) for x in self.lines.encode_batch_fast(texts, add_special_tokens=False)])
        end, want = np.cumsum(self.width.take(flat)), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        at = np.searchsorted(end, want)
        if end[-1] != want[-1] or not np.array_equal(end.take(at), want):  # a model that leaves bytes out
            own = self._whole(words)
            return np.fromiter(chain.from_iterable(own), np.uint32), np.fromiter(map(len, own), np.int64)
        return flat, np.diff(at, prepend=-1)

    def _learn(self, chunks: list[bytes]) -> None:
        if not chunks:
            return
        latin = np.array([m is not None for m in map(LATIN.fullmatch, chunks)])
        size, words, rest = np.zeros(len(chunks), np.int64), np.flatnonzero(latin), np.flatnonzero(~latin)
        other = self._whole([chunks[k] for k in rest.tolist()])
        size[rest] = [len(x) for x in other]
        flat = np.zeros(0, np.uint32)
        if len(words):
            flat, size[words] = self._words([chunks[k] for k in words.tolist()])
        ids, mine = np.zeros(size.sum(), np.uint32), np.repeat(latin, size)
        ids[mine], ids[~mine] = flat, list(chain.from_iterable(other))
        self.flat, self.size = np.concatenate([self.flat, ids]), np.concatenate([self.size, size])
        self.uses = np.concatenate([self.uses, np.zeros(len(chunks), np.int64)])

    def _forget(self) -> None:
        """Chunks used once, and all of them if three quarters were used again."""
        stay = self.uses > 1
        if stay.sum() > CHUNKS * 3 // 4:
            stay[:] = False
        stay[0] = True
        self.known = _Codes(zip((c for c, s in zip(self.known, stay.tolist(), strict=True) if s), range(int(stay.sum())), strict=True))
        self.flat = self.flat[np.repeat(stay, self.size)]
        self.size, self.uses = self.size[stay], np.zeros(int(stay.sum()), np.int64)

    def __call__(self, texts: list[bytes], end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by `end`; number of ids of each)."""
        if len(self.known) > CHUNKS:
            self._forget()
        before = len(self.known)
        whole = [k for k, t in enumerate(texts) if not self.exact or self.apart.search(t)]
        if whole:
            apart = set(whole)
            raw, ends = b"".join(t for k, t in enumerate(texts) if k not in apart), np.cumsum([0 if k in apart else len(t) for k, t in enumerate(texts)])
        else:
            raw, ends = b"".join(texts), np.cumsum([len(t) for t in texts])
        ends = ends.astype(np.int64)
        bounds = chunk_bounds(raw, ends)
        names, code = distinct_chunks(raw, bounds)
        own = np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))
        del names
        self._learn(list(islice(self.known, before, None)))
        code = own.take(code)
        self.uses += np.bincount(code, minlength=len(self.known))
        count = np.searchsorted(bounds, ends)  # chunks up to the end of each text
        code = np.insert(code, count, 0)
        self.flat[0] = end
        begin, n = np.cumsum(self.size) - self.size, self.size.take(code)
        last = np.cumsum(n)
        ids = self.flat.take(np.repeat(begin.take(code) - (last - n), n) + np.arange(n.sum()))
        size = np.diff(last.take(count + np.arange(len(texts))), prepend=0)
        if whole:
            each = np.split(ids, np.cumsum(size)[:-1])
            for k, own in zip(whole, self._whole([texts[k] for k in whole]), strict=True):
                each[k] = np.array([*own, end], np.uint32)
            ids, size = np.concatenate(each), np.array([len(x) for x in each])
        return ids, size


@lru_cache(maxsize=2)
def chunks(tokenizer_json: bytes) -> Chunks:
    """Kept between the tasks of a Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
    return Chunks(tokenizer_json)


def _portions(texts: pa.ChunkedArray) -> Iterator[tuple[int, int]]:
    """Rows of about PIECE bytes of text."""
    size = np.cumsum(pc.binary_length(texts.cast(pa.large_binary())).fill_null(0).to_numpy())
    cuts = np.flatnonzero(np.diff(size // PIECE, prepend=0)).tolist()
    return zip([0, *(c + 1 for c in cuts)], [*(c + 1 for c in cuts), len(texts)], strict=True)


def write_token_files(docs: DataFrame, tokenizer_json: bytes, path: str, end: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of every text, `end` appended to each, in ascending order of id (a long); equal ids in the order
    of their texts, null ids first. Null texts are empty; repeated rows each have their place. No rows: a dataset without
    segments. Other columns are ignored. Token ids must lie below 2^29.
    """
    modest(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(partitions(docs.sparkSession), "id").sortWithinPartitions("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard = chunks(tokenizer_json), TaskContext.get().partitionId()
        for seq, (_, own) in enumerate(blocks(batches, SEGMENT)):
            name, found = own.column("id").combine_chunks(), []
            for a, z in _portions(own.column("text")):
                found.append(encode(binary(own.column("text").slice(a, z - a)), end))
            del own
            ids, size = (np.concatenate(x) for x in zip(*found, strict=True))
            del found
            index = pack(name.is_null().to_numpy(zero_copy_only=False).astype(np.uint8), name.fill_null(0).to_numpy(), size)
            parts = mixing.encode_blocks(mixing.cut(ids))
            payload = struct.pack(f"<{len(parts) + 1}I", len(parts), *map(len, parts)) + b"".join(parts)
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(ids)]), pa.array([index], pa.binary()), pa.array([payload], pa.binary())], names=["shard", "seq", "n_ids", "docs", "payload"])
            del ids, parts, payload
            trim()

    rows.mapInArrow(run, SCHEMA).write.option("compression", "none").parquet(path)


def segment_ids(payload: bytes) -> np.ndarray:
    n = struct.unpack_from("<I", payload)[0]
    sizes = struct.unpack_from(f"<{n}I", payload, 4)
    at = np.cumsum((4 + 4 * n, *sizes))
    return np.concatenate(mixing.decode_blocks([payload[a:z] for a, z in zip(at, at[1:], strict=False)]) or [np.zeros(0, np.uint32)])


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start: ids of all documents before it, ids array of int) in no order; checksums are verified."""
    return _read(spark, path, "ids array<int>", lambda ids: pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))


def _read(spark: SparkSession, path: str, kind: str, column) -> DataFrame:
    files = spark.read.schema(SCHEMA).parquet(path)
    name = kind.split(" ")[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            for k in range(b.num_rows):
                none, own, size = unpack(b.column("docs")[k].as_py())
                ids = segment_ids(b.column("payload")[k].as_py())
                end = np.cumsum(size)
                each = np.split(ids, end[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), b.column(c)[k].as_py(), np.int32)) for c in ("shard", "seq")] + [pa.array(own, mask=none.astype(bool)), pa.array(end - size), pa.array(size), column(each)], names=["shard", "seq", "doc_id", "inside", "n_tokens", name])

    segments = files.select("shard", "seq", "n_ids")
    shards = segments.groupBy("shard").agg(F.sum("n_ids").alias("n"))  # one row per task that wrote
    shards = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))
    inner = F.sum("n_ids").over(Window.partitionBy("shard").orderBy("seq")) - F.col("n_ids")
    at = segments.withColumn("inner", inner).join(shards, "shard").select("shard", "seq", (F.col("shard_start") + F.col("inner")).alias("at"))
    docs = files.select("shard", "seq", "docs", "payload").mapInArrow(run, f"shard int, seq int, doc_id long, inside long, n_tokens long, {kind}")
    return docs.join(at, ["shard", "seq"]).select("doc_id", (F.col("at") + F.col("inside")).alias("start"), "n_tokens", name)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(table(spark, sf_dir, "documents"), model_bytes("byte_bpe_50k.json"), path)
    return _read(spark, path, "ids_crc32 long", lambda ids: pa.array([mixing.checksum(x) for x in ids], pa.int64()))
