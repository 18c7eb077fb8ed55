"""Each operator against a brute-force version, on texts with nulls, repeats, ties and clashing columns."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from netloom.llm import decontaminate, mixing, nearest, pieces, quality, queries, simhash, substring_dedup, suffix_dedup, token_counts, token_files, url_filter
from netloom.llm.common import table

SCHEMA = "doc_id long, text string, lang string, id long, th string, spans string, blob binary, part int"


def words(rng, n):
    return [rng.choice(["an", "the", "Ofer", "ÉTÉ", "ñan", "ting", "re,", "x1"]) + rng.choice(["", "a", "io", "!", "s"]) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    shared = " ".join(words(rng, 60))
    out = [None, "", "   \n", "one", "one two", "a" * 500, "ab" * 300]
    for k in range(30):
        w = words(rng, rng.choice([5, 40, 150]))
        if k % 3 == 0:
            w.insert(rng.randint(0, len(w)), shared)
        out.append(" ".join(w))
    out += [out[10], out[10].replace("a", "b", 1), "é" * 300, "long " * 20_000]
    made = [(k * 3 + 1, t) for k, t in enumerate(out)]
    rng.shuffle(made)
    return made


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", 7, "x", "y", None, 1) for i, t in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Repeated rows, repeated ids and null ids."""
    text = "tokens and words in a row, " * 20
    made = [(1, text), (1, text), (2, text), (None, text), (None, None), (3, "short"), (3, text + "x")]
    return spark.createDataFrame([(i, t, "en", 7, "x", "y", None, 1) for i, t in made], SCHEMA)


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_simhash(rows, docs, empty, odd):
    got = {r.id: r for r in simhash.near_duplicates(docs).collect()}
    fp = {}
    for i, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", lowered(t))
        s = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        fp[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    ids = sorted(fp)
    group = {i: i for i in ids}

    def find(i):
        return i if group[i] == i else find(group[i])

    for a in ids:
        for b in ids:
            if a < b and (fp[a] ^ fp[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                group[y] = x
    assert {i: r.fp % (1 << 64) for i, r in got.items()} == fp
    assert {i: r.component for i, r in got.items()} == {i: find(i) for i in ids}
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.near_duplicates(odd).count() == 7 and simhash.one_per_group(odd).columns == odd.columns
    kept = simhash.one_per_group(docs)
    assert {r.doc_id for r in kept.collect()} == {find(i) for i in ids}


def test_simhash_links_match_all_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = base.repeat(8) ^ (np.uint64(1) << rng.integers(0, 63, 2400, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 63, 2400, dtype=np.uint64))
    x = np.unique(np.concatenate([base, near]))
    x = x[np.lexsort((*(np.bitwise_count(x.view(np.uint16).reshape(-1, 4)[:, k]) for k in range(4)),))]
    u, v = simhash._links(x, x, 3)
    low = simhash.forest(np.searchsorted(np.sort(x), u), np.searchsorted(np.sort(x), v), len(x))
    s = np.sort(x)
    a, b = np.nonzero(np.triu(np.bitwise_count(s[:, None] ^ s[None]) <= 3, 1))
    assert np.array_equal(low, simhash.forest(a, b, len(s))) and len(u) < len(x)


def test_token_counts(rows, docs, empty, odd):
    model = token_counts.model_bytes("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    got = {r.id: (r.n_bytes, r.n_tokens) for r in token_counts.token_counts(docs, model).collect()}
    assert got == {i: (len((t or "").encode()), len(sp.encode(t or ""))) for i, t in rows}
    assert token_counts.token_counts(empty, model).count() == 0 and token_counts.token_counts(odd, model).count() == 7


def test_token_files(spark, rows, docs, empty, odd, tmp_path):
    source = token_counts.model_bytes("byte_bpe_50k.json")
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    token_files.write_token_files(docs, source, str(tmp_path / "a"))
    got = sorted(token_files.read_token_files(spark, str(tmp_path / "a")).collect(), key=lambda r: r.doc_id)
    at = 0
    for r, (i, text) in zip(got, sorted(rows), strict=True):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (i, at, len(ids), ids)
        at += len(ids)
    for k, df in enumerate((empty, odd)):
        token_files.write_token_files(df, source, str(tmp_path / f"x{k}"))
        assert token_files.read_token_files(spark, str(tmp_path / f"x{k}")).count() == (0, 7)[k]


def test_chunks_are_exact():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    c = token_files.Chunks(token_counts.model_bytes("byte_bpe_50k.json"))
    texts = ["a  b", "x\n  a\n\nb ", "<|endoftext|> a <|endoftext|>", "'s don't  x's", "", " ", "\t\t a", "a\u3000\u3000 b", "x \n y", "1 2  34", "a\u00a0  b\u00a0"]
    ids, n = c([x.encode() for x in texts], 0)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [[*t.encode(x, add_special_tokens=False).ids, 0] for x in texts]


def test_coder_round_trip():
    rng = np.random.default_rng(0)
    blocks = [rng.integers(0, 65536, n) for n in (1, 2, 63, 64, 65, 300, mixing.BLOCK)] + [np.zeros(1500, int), np.full(mixing.BLOCK, 65535), rng.integers(0, 3, 2000), np.tile(rng.integers(0, 50000, 37), 50), np.zeros(0, int)]
    coded = mixing.encode_blocks(blocks)
    assert all(np.array_equal(a, b) for a, b in zip(blocks, mixing.decode_blocks(coded), strict=True))
    assert len(coded[7]) < 200 and len(coded[10]) < 800
    bad = bytearray(coded[6])
    bad[40] ^= 1
    with pytest.raises(ValueError):
        mixing.decode_blocks([bytes(bad)])


def test_quality(spark, empty, odd):
    d = "/root/testdata/sf0.01"
    labels = table(spark, d, "labels")
    got = {r.doc_id: r for r in queries.QUERIES["op4_quality"](spark, d).collect()}
    known = {r.doc_id: r.quality for r in labels.collect()}
    held = [i for i in known if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out for i in held) and sum(r.held_out for r in got.values()) == sum(zlib.crc32(str(i).encode()) % 5 == 0 for i in got)
    assert np.mean([got[i].predicted == known[i] for i in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())
    assert quality.quality_scores(empty, labels).count() == 0
    assert quality.quality_scores(odd, labels.where("false")).agg(F.max("score")).first()[0] == 0.5
    assert quality.keep_good(odd, labels).columns == odd.columns


def test_pieces(rows, docs, empty, odd):
    model = token_counts.model_bytes("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    coded = pieces.encode_pieces(docs, model, decoded="back")
    got = {r.doc_id: r for r in coded.collect()}
    assert all(got[i].ids == sp.encode(t or "") and got[i].back == sp.decode(sp.encode(t or "")) for i, t in rows)
    again = {r.doc_id: r.decoded for r in pieces.decode_pieces(coded.select("doc_id", "ids"), model).collect()}
    assert all(again[i] == got[i].back for i, _ in rows)
    e = pieces.Encoder(model, 1)
    strings = ["a▁b", "  x", "\n\n a", "<s>", "é\U0001f600", "", " ", "▁▁", "a\x00b", "日本語 text", "<0x0A>", "tab\tx  "]
    ids, differ = e.encode([s.encode() for s in strings])
    assert [x.tolist() for x in ids] == [sp.encode(s) for s in strings] and not any(differ)
    assert [e.whole.encode(s, add_special_tokens=False).ids for s in strings] == [sp.encode(s) for s in strings]
    assert e.decode([np.array([3 + 0xC3])]) == [sp.decode([3 + 0xC3])]
    assert pieces.encode_pieces(empty, model).count() == 0 and pieces.encode_pieces(odd, model).count() == 7


def test_decontaminate(spark, rows, docs, empty, odd):
    texts = [t for _, t in rows if t and len(t.split()) > 30]
    made = [(1, " ".join(texts[0].split()[3:25])), (2, "one two"), (10, texts[1]), (3, None), (4, "..."), (None, "one"), (5, "The THE"), (5, "nothing like it at all")]
    items = spark.createDataFrame(made, "item_id long, text string")
    pat = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"
    windows = {}
    for i, t in made:
        w = re.findall(pat, lowered(t))
        if i is not None and t is not None:
            for k in range(max(1, len(w) - 9) if w else 0):
                windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    for slice_bytes in (8 << 20, 150):
        decontaminate.SLICE_BYTES = slice_bytes
        got = {r.doc_id: r for r in decontaminate.decontaminate(docs, items).collect()}
        for i, t in rows:
            w, hit, own = re.findall(pat, lowered(t)), set(), set()
            for n in {len(x) for x in windows}:
                for k in range(len(w) - n + 1):
                    if found := windows.get(tuple(w[k : k + n])):
                        own |= found
                        hit |= set(range(k, k + n))
            assert (got[i].n_words, got[i].n_hit, got[i]["items"]) == (len(w), len(hit), sorted(own)), (i, t)
    decontaminate.SLICE_BYTES = 8 << 20
    assert decontaminate.decontaminate(empty, items).count() == 0
    assert decontaminate.decontaminate(odd, items.where("false")).agg(F.sum("n_hit")).first()[0] == 0


def test_nearest(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[500:900] = x[400]
    made = [(k, [float(v) for v in r]) for k, r in enumerate(x)] + [(5000, None), (5050, [0.0] * 16), (5100, [float("nan")] * 16), (5150, [1.0]), (None, [1.0] * 16), (0, [float(v) for v in x[0]])]
    df = spark.createDataFrame(made, "vec_id long, embedding array<float>")
    got = {}
    for r in nearest.nearest(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    y = x.astype(np.float64)
    norm, hits = np.sqrt((y * y).sum(axis=1)), 0
    assert sorted(got) == list(range(0, 3000, 50))
    for q, found in got.items():
        s = y @ y[q] / (norm * norm[q])
        s[q] = -9
        best = np.lexsort((np.arange(3000), -np.round(s, 12)))[:5]
        assert sorted(found) == [1, 2, 3, 4, 5]
        hits += len({v for v, _ in found.values()} & set(best.tolist()))
        assert all(abs(s[v] - score) < 1e-12 for v, score in found.values())
    assert hits / (5 * len(got)) >= 0.9
    assert [got[500][k][0] for k in range(1, 6)] == [400, 501, 502, 503, 504]
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r["rank"], r.vec_id) for r in nearest.nearest(few, F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, 2), (2, 1)]
    assert nearest.nearest(df.where("false"), F.lit(True)).count() == 0


def test_suffix_array():
    rng, folder = random.Random(1), __import__("tempfile").mkdtemp()
    for _ in range(60):
        texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(1, 8))]
        doc, left, lcp = suffix_dedup.suffix_array(texts, folder)
        want = sorted(([x + 1 for x in t[len(t) - k :]] + [i - len(texts)], i, k) for i, t in enumerate(texts) for k in range(len(t) + 1))
        assert [w[1] for w in want] == doc.tolist() and [w[2] for w in want] == left.tolist()
        for k, (a, b) in enumerate(zip(want, want[1:], strict=False), 1):
            n = 0
            while a[0][n] == b[0][n]:
                n += 1
            assert n == lcp[k]


def test_suffix_dedup(rows, docs, empty, odd):
    got = {r.doc_id: r for r in suffix_dedup.dedup_substrings(docs).collect()}
    seen = set()
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(b[k : k + 100])
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        assert bytes(got[i].kept) == kept and got[i].n_bytes == len(b), i
        assert [(s.start, s.end) for s in got[i].removed] == [m.span() for m in re.finditer(b"\1+", bytes(gone))]
    assert suffix_dedup.dedup_substrings(empty).count() == 0
    assert suffix_dedup.dedup_substrings(odd).count() == 7
    with pytest.raises(ValueError):
        suffix_dedup.dedup_substrings(docs, width=200)


def test_substring_dedup(rows, docs, empty, odd):
    got = {r.doc_id: r for r in substring_dedup.dedup_words(docs).collect()}
    first = {}
    for i, t in sorted(rows):
        w = re.findall("[^\x20\x09-\x0d]+", t or "")
        gone = [0] * len(w)
        for k in range(len(w) - 12):
            if first.setdefault(tuple(w[k : k + 13]), i) < i:
                gone[k : k + 13] = [1] * 13
        assert got[i].kept == " ".join(x for x, g in zip(w, gone, strict=True) if not g) and got[i].n_words == len(w)
    assert substring_dedup.dedup_words(empty).count() == 0
    assert substring_dedup.dedup_words(odd).count() == 7


def test_url_filter(spark, sf):
    urls = ["http://com/en/x", "http://a.COM/en/7", "https://x.example.com/en/77?a", "ftp://example.com/en", "http://net/de/8", "//com/en/", None, "", "x://exampleXcom/en/", "http://my.example.net/de/8#q", "http://acom/en/", "http://org/es/\nmore"]
    df = spark.createDataFrame([(k, u, "h", None) for k, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = [(r.host, r.path, r.rule, r.verdict) for r in url_filter.url_verdicts(df).orderBy("page_id").collect()]
    assert [g[2] for g in got] == ["com/en/", "com/en/", "example.com/en/7", None, "net/de/", None, None, None, None, "example.net/de/8", None, "org/es/"]
    assert [g[3] for g in got] == ["block", "block", "allow", "allow", "allow", "allow", "allow", "allow", "allow", "block", "allow", "block"]
    assert got[1][:2] == ("a.com", "/en/7") and got[6][:2] == ("", "")
    assert url_filter.url_verdicts(df.where("false")).count() == 0 and url_filter.url_verdicts(df, rules=()).where("verdict = 'allow'").count() == 12
    whole = url_filter.url_verdicts(df, rules=[("block", "com", ""), ("allow", "a.com", "")])
    assert [r.rule for r in whole.orderBy("page_id").limit(3).collect()] == ["com", "a.com", "com"]
    c = duckdb.connect()
    c.sql(f"create view pages as select * from read_parquet('{sf}/pages.parquet')")
    want = sorted(c.sql("select page_id, host, path, rule, verdict from (" + queries.ORACLE_SQL["op10_url_filter"] + ")").fetchall())
    assert sorted(tuple(r) for r in queries.QUERIES["op10_url_filter"](spark, sf).select("page_id", "host", "path", "rule", "verdict").collect()) == want
    plan = url_filter.url_verdicts(table(spark, sf, "pages"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def test_pipeline(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "simhash near-dedup", "suffix-array dedup", "benchmark decontamination", "sentencepiece encoding"]
    start = table(spark, sf, "documents")
    out = corpus_pipeline.run(spark, sf).toPandas()
    source = {r.doc_id: r.text for r in start.collect()}
    assert out.doc_id.is_unique and set(out.doc_id) <= set(source) and len(out) > 0.5 * len(source)
    assert list(out.columns) == [*start.columns, "ids", "differ", "decoded", "n_tokens"]
    sp = sentencepiece.SentencePieceProcessor(model_proto=token_counts.model_bytes("piece_bpe_32k.model"))
    assert all(list(i) == sp.encode(t) for i, t in zip(out.ids, out.text, strict=True)) and (out.n_chars == out.text.str.len()).all()
    items = [decontaminate.words_of(r.text.encode()) for r in table(spark, sf, "benchmark").collect()]
    windows = {tuple(w[k : k + 10]) for w in items for k in range(max(1, len(w) - 9))}
    for t in out.text:
        w = decontaminate.words_of(t.encode())
        assert not any(tuple(w[k : k + 10]) in windows for k in range(len(w) - 9))
    stage = dict(corpus_pipeline.STAGES)
    for name in list(stage)[:4]:
        assert stage[name](spark, start, sf).columns == start.columns
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
