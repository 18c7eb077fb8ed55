"""The registered queries themselves against brute force, on a folder of small tables, and the coder, probes and models
behind them on hard inputs."""

import hashlib
import random
import re
import struct
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from netloom.llm import mixing, nearest, pieces, quality, queries, suffix_dedup, token_counts, token_files, url_filter
from netloom.llm.common import table

PAT6 = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"
SPACED = "[^\x20\x09-\x0d]+"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def prose(rng, n):
    return " ".join(rng.choice(["Alpha", "beta", "Été", "gamma,", "delta-x", "7", "eps'n", "zeta."]) + rng.choice(["", "s", "ing"]) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, d = random.Random(11), str(tmp_path_factory.mktemp("tables"))
    shared, item = prose(rng, 50), prose(rng, 14)
    texts = [None, "", " \t\n", "one", "one two", "Mot clé " * 2000]
    for k in range(40):
        w = [prose(rng, rng.choice([8, 60, 200]))]
        if k % 3 == 0:
            w.append(shared)
        if k % 7 == 0:
            w.insert(0, item)
        texts.append(" ".join(w))
    texts += [texts[8], texts[8] + " end", texts[9].lower(), "<|endoftext|> a  b<|endoftext|>", "café été 　x (y)3rd.don't"]
    rows = [(7 * k % 101, t, "en", "web", len(t or "")) for k, t in enumerate(texts)]
    rng.shuffle(rows)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item), (2, "one two"), (3, None), (4, "!"), (11, prose(rng, 9)), (5, shared)], "item_id long, text string").coalesce(1).write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, int(len(t or "") > 100), 0) for i, t, *_ in rows[::2]], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{d}/labels.parquet")
    return d, sorted((i, t) for i, t, *_ in rows)


def answers(spark, d, name):
    return {r.doc_id: r for r in queries.QUERIES[name](spark, d).collect()}


def test_op1(spark, folder):
    d, rows = folder
    got, fp = answers(spark, d, "op1_simhash"), {}
    for i, t in rows:
        w = re.findall(SPACED, lowered(t))
        h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))] if w else []
        fp[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    group = {i: i for i in fp}
    for _ in fp:
        for a in fp:
            for b in fp:
                if (fp[a] ^ fp[b]).bit_count() <= 3:
                    group[a] = group[b] = min(group[a], group[b])
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{x:016x}", group[i]) for i, x in fp.items()}


def test_op2(spark, folder):
    d, rows = folder
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = answers(spark, d, "op2_token_counts")
    for i, t in rows:
        n = len(sp.encode(t or ""))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 4096)
    assert any(r.over_limit for r in got.values())


def test_op3(spark, folder):
    d, rows = folder
    own, got, at = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), answers(spark, d, "op3_token_files"), 0
    for i, t in rows:
        ids = [*own.encode(t or "", add_special_tokens=False).ids, 0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_op5(spark, folder):
    d, rows = folder
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = answers(spark, d, "op5_pieces")
    for i, t in rows:
        ids = sp.encode(t or "")
        assert (got[i].ids, got[i].decoded, got[i].n_tokens, got[i].round_trip, got[i].differ) == (ids, sp.decode(ids), len(ids), True, False)


def test_op6(spark, folder):
    d, rows = folder
    got, windows = answers(spark, d, "op6_decontaminate"), {}
    for r in table(spark, d, "benchmark").collect():
        w = re.findall(PAT6, lowered(r.text))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(r.item_id))
    for i, t in rows:
        w, hit, own = re.findall(PAT6, lowered(t)), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    own |= found
                    hit |= set(range(k, k + n))
        want = (len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit))
        assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].items_sha256, got[i].contaminated) == want


def removed_bytes(rows):
    """doc id -> flags of removed bytes."""
    seen, out = set(), {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(b[k : k + 100])
        out[i] = b, bytes(gone)
    return out


def test_op8(spark, folder):
    d, rows = folder
    got = answers(spark, d, "op8_suffix_dedup")
    for i, (b, gone) in removed_bytes(rows).items():
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(b), sum(gone), len(re.findall(b"\1+", gone)), hashlib.sha256(kept).hexdigest())


def test_op9(spark, folder):
    d, rows = folder
    got, first = answers(spark, d, "op9_substring_dedup"), {}
    for i, t in rows:
        w = re.findall(SPACED, t or "")
        gone = [0] * len(w)
        for k in range(len(w) - 12):
            if first.setdefault(tuple(w[k : k + 13]), i) < i:
                gone[k : k + 13] = [1] * 13
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())


def test_suffix_dedup_of_repeated_rows(spark):
    """Each row of a repeated document gets the whole result, wherever its copies lie."""
    rng = random.Random(4)
    for _ in range(3):
        base = "".join(rng.choice("abcdefgh ") for _ in range(900))
        text = base[:300] + "".join(rng.choice("xyz") for _ in range(30)) + base[250:600] + base[600:] + base[100:420]
        rows = [(1, base), (5, text), (5, text), (5, text), (9, text[::-1])]
        want = removed_bytes([(1, base), (5, text), (9, text[::-1])])
        for parts in (1, 4):
            df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
            got = suffix_dedup.dedup_substrings(df).collect()
            assert len(got) == 5
            for r in got:
                assert [(s.start, s.end) for s in r.removed] == [m.span() for m in re.finditer(b"\1+", want[r.doc_id][1])]


def test_whole_characters():
    text = "aéb�ç".encode()  # é at 1..2, U+FFFD at 4..6, ç at 7..8
    assert suffix_dedup.whole_characters(text, [], []) == "aéb�ç"
    assert suffix_dedup.whole_characters(text, [2, 7], [4, 8]) == "a�"
    assert suffix_dedup.whole_characters("éà".encode(), [1], [3]) == ""


def test_coder_of_wide_ids_and_ratio():
    rng = np.random.default_rng(3)
    blocks = [np.array([70_000, 3, 70_000, mixing.MOST_ID]), rng.integers(0, 1 << 20, 500), rng.integers(0, 60_000, 3000), np.zeros(0, int)]
    assert all(np.array_equal(a, b) for a, b in zip(blocks, mixing.decode_blocks(mixing.encode_blocks(blocks)), strict=True))
    with pytest.raises(ValueError):
        mixing.encode_blocks([np.array([1 << 29])])
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist()
    ids, _ = token_files.Chunks(token_counts.model_bytes("byte_bpe_50k.json"))([(t or "").encode() for t in texts], 0)
    share = np.bincount(ids) / len(ids)
    share = share[share > 0]
    coded = mixing.encode_blocks(mixing.cut(ids))
    assert 8 * sum(map(len, coded)) / len(ids) < -(share * np.log2(share)).sum()  # better than frequencies alone
    assert np.array_equal(np.concatenate(mixing.decode_blocks(coded)), ids)


def test_chunks_of_mixed_signs():
    own, c = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), token_files.Chunks(token_counts.model_bytes("byte_bpe_50k.json"))
    rng = random.Random(8)
    parts = [" ", "  ", "\n", "a", "Word", "é", "ñ", "«", "'", "'s", "'ll", "7", "42", "(", ").", "&&&", "#", "日本", "́", "\x1c", "\x7f", "ǆ", "Ω", "\t", "<|endoftext|>", "٣"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    assert all(b"".join(token_files.CHUNK.findall(t.encode())) == t.encode() for t in texts)
    for a in range(0, 3000, 500):
        ids, n = c([x.encode() for x in texts[a : a + 500]], 0)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [[*own.encode(x, add_special_tokens=False).ids, 0] for x in texts[a : a + 500]]
        c._forget()

def test_coder_of_lanes():
    rng = np.random.default_rng(5)
    sizes = (1, 1023, 1024, 2047, 2048, 2049, 5000, 70_001)
    blocks = [(rng.zipf(1.3, n) % 50_000).astype(np.uint32) for n in sizes] + [rng.integers(0, 1 << 29, 200_000), np.tile(rng.integers(0, 40_000, 3000), 20), np.arange(150_000)]
    coded = mixing.encode_blocks(blocks)
    assert all(np.array_equal(a, mixing.decode_blocks([b])[0]) for a, b in zip(blocks, coded, strict=True))  # each alone
    assert len(coded[9]) < 20_000  # lanes learn from each other
    for bad in (coded[6][:-2], coded[6] + b"\0\0", coded[6][:-9] + bytes([coded[6][-9] ^ 4]) + coded[6][-8:], coded[0][:20] + coded[6][20:]):
        with pytest.raises(ValueError):
            mixing.decode_blocks([bad])


def test_chunks_are_the_pattern_s():
    rng = random.Random(4)
    signs = [" ", "\n", "\t", "\r", "a", "Zb", "é", "'", "7", "42", "(", ").", "\x00", "\x1c", "\x7f", "日本", "a" * 17, "b" * 40]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 12))).encode() for _ in range(4000)]
    want = [c for t in texts for c in token_files.CHUNK.findall(t)]
    raw = b"".join(texts)
    bounds = token_files.chunk_bounds(raw, np.cumsum([len(t) for t in texts]))
    assert [raw[a:z] for a, z in zip(bounds, bounds[1:], strict=False)] == want
    names, code = token_files.distinct_chunks(raw, bounds)
    assert [names[k] for k in code] == want and len(set(names)) == len(names)
    assert token_files.chunk_bounds(b"", np.zeros(2, int)).tolist() == [0] and token_files.distinct_chunks(b"", np.zeros(1, int))[0] == []


def test_token_files_cost_less_than_encoding_each_text():
    """Chunks, coder and decoder together, against the CPU time of the library alone on the same texts."""
    import pyarrow.parquet as pq

    texts = [(t or "").encode() for t in pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist()] * 3
    c = token_files.Chunks(token_counts.model_bytes("byte_bpe_50k.json"))
    a = time.process_time()
    want = c._whole(texts)
    b = time.process_time()
    ids, _ = c(texts, 0)
    got = np.concatenate(mixing.decode_blocks(mixing.encode_blocks(mixing.cut(ids))))
    assert time.process_time() - b < b - a
    assert np.array_equal(got, np.concatenate([[*x, 0] for x in want]))


def test_nearest_gives_k_to_an_outlier(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(20_000, 16)) * 0.05 + 1
    x[0] = -1
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    found = nearest.nearest(df, F.col("vec_id") % 5000 == 0).toPandas()
    assert found.groupby("query_id").size().to_dict() == {0: 5, 5000: 5, 10000: 5, 15000: 5}
    y = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    assert all(abs(y[r.query_id] @ y[r.vec_id] - r.score) < 1e-12 for r in found.itertuples())


def test_rules_in_a_table(spark):
    rng = random.Random(6)
    hosts, paths = ["com", "a.com", "b.a.com", "org", "x.org"], ["", "/", "/a/", "/a/b", "/c/d/", "/a/b/c"]
    rules = sorted({(rng.choice(["allow", "block"]), rng.choice(hosts), rng.choice(paths)) for _ in range(25)})
    urls = [None, "", "x"] + [f"http://{rng.choice(['', 'w.'])}{rng.choice(hosts)}{rng.choice([*paths, '/a/b/c/d?x', '/c/d'])}" for _ in range(200)]
    df = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)], "page_id long, url string, host string")
    want = url_filter.url_verdicts(df, rules).orderBy("page_id").collect()
    made = spark.createDataFrame([*rules, rules[0], (None, "com", "")], "verdict string, host string, path string")
    assert url_filter.url_verdicts(df, made).orderBy("page_id").select(*want[0].__fields__).collect() == want
    many = [*rules, *(("block", f"h{k}.net", "/z/") for k in range(url_filter.IN_PLAN))]
    assert url_filter.url_verdicts(df, many).orderBy("page_id").select(*want[0].__fields__).collect() == want


def varint(n):
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def field(number, value):
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def unigram_model(squeeze):
    made = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{b:02X}>", 0.0, 6) for b in range(256))]
    made += [(p, -float(len(p) % 4 + k * 0.37), 1) for k, p in enumerate(["▁", "▁the", "the", "▁t", "he", "t", "h", "e", "▁cat", "c", "a", "at", "s", "▁sat▁on", "o", "n", "é"])]
    body = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, kind)) for p, s, kind in made)
    return body + field(2, field(3, 1) + field(35, 1)) + field(3, field(1, b"identity") + field(3, 1) + field(4, int(squeeze)) + field(5, 1))


@pytest.mark.parametrize("squeeze", [False, True])
def test_unigram_models(spark, squeeze):
    model = unigram_model(squeeze)
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    texts = ["the cat sat on the hat", "the  cat", "", "thé ☃ cats", " the", "sat on", "ttttt", "noon the cat sat on", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pieces.encode_pieces(df, model, decoded="back").collect()}
    assert all(got[k].ids == sp.encode(t or "") and got[k].back == sp.decode(sp.encode(t or "")) for k, t in enumerate(texts))
    assert sum(r.differ for r in got.values()) == 0


def test_quality_against_a_plain_fit(spark):
    """Scores follow labels in rank as a plain numpy ridge on the same inputs would, and are calibrated upwards."""
    d = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.QUERIES["op4_quality"](spark, d).collect()}
    known = {r.doc_id: r.quality for r in table(spark, d, "labels").collect()}
    texts = {r.doc_id: r.text or "" for r in table(spark, d, "documents").collect()}
    ids = sorted(i for i in known if i in texts)
    held = np.array([zlib.crc32(str(i).encode()) % 5 == 0 for i in ids])
    y = np.array([known[i] for i in ids], float)
    x = np.array([quality.statistics(texts[i].encode()) for i in ids], float)
    mean, std = x[~held].mean(axis=0), x[~held].std(axis=0) + 1e-9
    z = np.hstack([(x - mean) / std, np.ones((len(x), 1))])
    w = np.linalg.solve(z[~held].T @ z[~held] + np.eye(z.shape[1]), z[~held].T @ y[~held])
    plain = ((z[held] @ w) >= 0.5) == y[held]
    mine = np.array([got[i].score >= 0.5 for i in ids])[held] == y[held]
    assert mine.mean() >= plain.mean() - 0.02 and mine.mean() > 0.95
    assert all(r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())


def test_pipeline_on_odd_rows(spark, tmp_path, sf):
    """Nulls in any column, empty and repeated rows, columns named like results, and an empty table."""
    text = "A passage of plain words that goes on for a while and says nothing at all. " * 4
    made = [(1, text, None, "w", None, 1, "x"), (1, text, None, "w", None, 1, "x"), (2, None, "en", None, 3, 2, None), (None, "", "en", "w", 0, None, "y"), (3, text + " Tail.", "en", "w", 5, 3, "z"), (None, None, None, None, None, None, None)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, removed long, ids string"
    docs = spark.createDataFrame(made, kinds)
    for rows in (docs, docs.where("false")):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, rows, sf)
            assert out.columns == docs.columns and out.count() <= rows.count()
        out = corpus_pipeline.STAGES[-1][1](spark, rows, sf)
        assert out.count() == rows.count() and "removed" in out.columns
    kept = corpus_pipeline.distinct(spark, docs, sf).collect()
    assert sorted(r.doc_id or 0 for r in kept) == [1, 2]
