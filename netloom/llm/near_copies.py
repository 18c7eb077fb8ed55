"""SimHash near-dedup of texts by the exact Jaccard similarity of word shingles; no pair at or above the bound is lost.

SimHash (netloom.llm.simhash) proposes links: fingerprints over the same shingles within RADIUS bits, as spanning
forests of tiles. A radius can't promise every pair of similarity 0.8, and admits others; so each proposed link is
verified shingle by shingle, and what the radius misses comes from counting. A text with a partner shares at least 4/5
of its distinct shingles with it, so a text of which fewer occur in a second text (by a count-min sketch, which loses
none) has none and drops out; this is done twice, the second time among the texts that are left. Of those, the shingles
are put in one order, the rarest first by the sketch's levels, and a text is posted under its first n - ceil(4n/5) + 1:
two texts at the bound meet there, first at a shingle after which both still hold enough of them to reach the bound, so
a passage that many otherwise different texts share brings none of them together. Members of a posting that the verified
links leave in different components are compared with one of them first, and then all pairs that still lie apart.

Texts without a candidate, and those whose hash occurs once, stay without ever being shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm import simhash
from netloom.llm.common import binary, blocks, modest, settled, slices, stored
from netloom.llm.components import components
from netloom.llm.repeats import Sketch, count_min
from netloom.llm.simhash import fingerprints_of, text_hash
from netloom.llm.substring_dedup import _rolled, _windows, _word_hashes

NUM, DEN = 4, 5  # the bound, 0.8
BLOCK = 4 << 20
RADIUS = 6  # bits within which SimHash proposes a link
STARS = 1  # rounds of comparing with one member of each posting


def shingles(text: bytes, size: int) -> set[bytes]:
    """Distinct word shingles; of fewer words than `size` the whole sequence, so texts without words are alike."""
    words = text.lower().split()
    return {b" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))}


def alike(a: set[bytes], b: set[bytes]) -> bool:
    both = len(a & b)
    return DEN * both >= NUM * (len(a) + len(b) - both)


def _hashed(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text's number) of the distinct shingles, in order of the text."""
    words = [t.lower().split() for t in texts]
    lengths = np.array([len(w) for w in words], np.int64)
    ids, low, _ = _word_hashes(words)
    at, doc = _windows(lengths, size)
    key = _rolled(low[ids], size, 11)[at] if len(at) else np.zeros(0, np.uint64)
    short = np.flatnonzero(lengths < size)
    whole = np.array([xxhash.xxh64_intdigest(b" ".join(words[k]), size) for k in short], np.uint64)
    key, doc = np.concatenate([key, whole]), np.concatenate([doc, short])
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    first = np.ones(len(key), bool)
    first[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    return key[first], doc[first]


def _picked(rows: DataFrame, sketch: Sketch, column: str, repeated: bool) -> DataFrame:
    """The rows whose number is (or isn't) held by a sketch."""
    held = rows.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(held.value.repeated(b.column(column).to_numpy(zero_copy_only=False).view(np.uint64)) == repeated))

    return rows.mapInArrow(run, rows.schema)


def _twice(numbers: np.ndarray) -> np.ndarray:
    return np.repeat(numbers, 2)


def _may_repeat(rows: DataFrame, size: int, posted: bool, column: str, only=None) -> DataFrame:
    """rows with near, whether a text may have a partner; posted: only those, as (th, id, text, n, alone: how many of its
    shingles no other text has, fp and the tokens, rarest first, that they are posted under). only: which rows of a block there are, by __th and __first."""
    sketch = rows.sparkSession.sparkContext.broadcast(count_min(rows, lambda texts: _hashed(texts, size)[0], 1 / 6, BLOCK, column, 1, only, ("__th", "__first") if only else (), posted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in blocks(batches, BLOCK, column):
            own = own.filter(pa.array(only(own))).combine_chunks() if only else own
            texts = list(chain.from_iterable(binary(c) for c in own.column(column).chunks))
            key, doc = _hashed(texts, size)
            again = sketch.value.repeated(key)
            n = np.bincount(doc, minlength=len(texts))
            need = -(-NUM * n // DEN)
            near = np.bincount(doc, again, len(texts)) >= need
            if not posted:
                yield from own.append_column("__near", pa.array(near)).to_batches(1024)
            elif len(some := np.flatnonzero(near)):
                order = np.lexsort((key, sketch.value.level(key), again, doc))  # those of one text alone first: they meet nothing
                key, again = key[order].view(np.int64), again[order]
                ends, alone = np.cumsum(n), n - np.bincount(doc, again, len(texts)).astype(np.int64)
                tokens = []
                for k in some:
                    at = slice(ends[k] - n[k], ends[k] - need[k] + 1)
                    tokens.append(key[at][again[at]])
                fp = fingerprints_of([texts[k] for k in some.tolist()], size, 42).view(np.int64)
                held = own.take(pa.array(some)).append_column("n", pa.array(n[some], pa.int64())).append_column("alone", pa.array(alone[some], pa.int64())).append_column("fp", pa.array(fp)).append_column("tokens", pa.array(tokens, pa.list_(pa.int64())))
                yield from held.to_batches(1024)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, kinds + (", n long, alone long, fp long, tokens array<long>" if posted else ", __near boolean"))


def _verified(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """The pairs (u, v) whose texts are alike. Only texts of a pair are shuffled; a node in very many pairs is a skewed
    key, which adaptive execution splits."""
    pairs = stored(pairs, "pairs")
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("th")).distinct()
    texts = _picked(texts, count_min(nodes, _twice, 1 / 4, BLOCK, "th"), "th", True)
    a, b = (texts.select(F.col("th").alias(x), F.col("text").alias(f"{x}_text")) for x in "uv")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, set[bytes]] = {}

        def of(node: int, text: bytes) -> set[bytes]:
            if node not in held:
                if len(held) >= 64:
                    held.clear()
                held[node] = shingles(text, size)
            return held[node]

        for rows in slices(batches, 256):
            u, v = rows.column("u").to_pylist(), rows.column("v").to_pylist()
            fine = [alike(of(x, s), of(y, t)) for x, y, s, t in zip(u, v, binary(rows.column("u_text")), binary(rows.column("v_text")), strict=True)]
            yield rows.select(["u", "v"]).filter(pa.array(fine, pa.bool_()))

    return pairs.join(a, "u").join(b, "v").select("u", "v", "u_text", "v_text").mapInArrow(run, "u long, v long")


def _reach(a: str, b: str) -> F.Column:
    """Whether texts that share none of the shingles before may be alike: `rest` is how many each has from this one on.
    Two that are alike pass where they first meet."""
    return F.least(f"{a}rest", f"{b}rest") * (NUM + DEN) >= (F.col(f"{a}n") + F.col(f"{b}n")) * NUM


def _pair(a: str, b: str) -> tuple[F.Column, F.Column]:
    return F.least(a, b).alias("u"), F.greatest(a, b).alias("v")


def _proposed(found: DataFrame) -> DataFrame:
    """Pairs (u, v) by SimHash: texts of one fingerprint with the first of them, and the first ones of linked fingerprints."""
    first = found.groupBy("fp").agg(F.min("th").alias("one"))
    same = found.select("th", "fp").join(first, "fp").where("th <> one").select(*_pair("th", "one"))
    a, b = (first.select(F.col("fp").alias(x), F.col("one").alias(f"one_{x}")) for x in "uv")
    linked = simhash.links(first.select("fp"), RADIUS).join(a, "u").join(b, "v").select(*_pair("one_u", "one_v"))
    return same.unionByName(linked).distinct()


def _roots(found: DataFrame, size: int) -> DataFrame:
    """(node, root) of all texts but the roots, by the links between candidates."""
    texts = found.select("th", "text")
    posts = found.select(F.posexplode("tokens").alias("place", "token"), F.col("th").alias("node"), "n", "alone")
    posts = stored(posts.select("token", "node", "n", "alone", (F.col("n") - F.col("alone") - F.col("place")).alias("rest")), "posts")
    edges = stored(_verified(_proposed(found), texts, size), "edges")
    roots = components(edges, "links")
    for k in range(STARS + 1):
        now = stored(posts.join(roots, "node", "left").select("token", "node", "n", "alone", "rest", F.coalesce("root", "node").alias("label")), "labelled")
        # an original's shingles all recur in its copies, so the text with the fewest of its own is likest to the others
        chance = F.xxhash64("node", F.lit(k), F.pmod("token", F.lit(4)))
        one = now.groupBy("token").agg(F.min(F.struct("alone", chance.alias("chance"), F.col("node").alias("one"), F.col("n").alias("one_n"), F.col("rest").alias("one_rest"), F.col("label").alias("one_label"))).alias("p"), F.min("label").alias("lo"), F.max("label").alias("hi"))
        one = one.where("lo <> hi").select("token", "p.one", "p.one_n", "p.one_rest", "p.one_label")
        apart = now.join(one, "token").where("label <> one_label")
        if k < STARS:
            pairs = apart.where(_reach("", "one_")).select(*_pair("node", "one"))
        else:
            other = now.select("token", F.col("node").alias("other"), F.col("n").alias("other_n"), F.col("rest").alias("other_rest"), F.col("label").alias("other_label"))
            both = apart.join(other, "token").where("label <> other_label AND (other_label = one_label OR node < other)").where(_reach("", "other_"))
            pairs = both.select(*_pair("node", "other"))
        linked = _verified(pairs.distinct(), texts, size)
        edges = stored(edges.unionByName(linked), "edges")
        roots = components(edges, "links")
    return roots


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5) -> DataFrame:
    """The row with the least id of each component of texts whose word shingles have a Jaccard similarity of 0.8 or more.

    Null and wordless texts are alike. Null ids count as the largest. Rows that repeat id and text, or tie in the id,
    leave one. Words are runs of other than ASCII white space, A-Z lower-cased. An empty table gives an empty table;
    all columns of docs stay as they are.
    """
    spark = docs.sparkSession
    modest(spark)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    own = settled(docs.withColumn("__th", text_hash(text_col)), "texts")
    copies = count_min(own, lambda numbers: numbers, 1 / 8, BLOCK, "__th")
    place = Window.partitionBy("__th").orderBy(F.col(f"`{id_col}`").asc_nulls_last())
    several = _picked(own, copies, "__th", True).withColumn("__place", F.row_number().over(place)).where("__place = 1").drop("__place")
    base = own.withColumn("__first", F.lit(False)).unionByName(stored(several, "copies").withColumn("__first", F.lit(True)))
    held = spark.sparkContext.broadcast(copies)

    def only(rows: pa.Table) -> np.ndarray:
        return rows.column("__first").to_numpy() | ~held.value.repeated(rows.column("__th").to_numpy().view(np.uint64))

    flagged = stored(_may_repeat(base, size, False, text_col, only), "flagged")
    some = flagged.where("__near")
    few = some.select(F.col("__th").alias("th"), F.col(f"`{id_col}`").alias("id"), text.alias("text"))
    found = stored(_may_repeat(few, size, True, "text"), "posted")
    roots = stored(_roots(found, size), "roots")
    tops = roots.select(F.col("root").alias("node"), "root").distinct()
    members = roots.unionByName(tops).join(found.select(F.col("th").alias("node"), "id"), "node")
    rank = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("node").alias("best"))
    best = members.groupBy("root").agg(F.min(rank)["best"].alias("best"))
    gone = members.join(best, "root").where("node <> best").select("node")
    left = some.join(gone, F.col("__th") == F.col("node"), "left_anti")
    return flagged.where("NOT __near").unionByName(left).select(*(F.col(f"`{c}`") for c in docs.columns))
