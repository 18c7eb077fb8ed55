"""The pipeline's near-dedup against brute force, on planted near copies on both sides of 0.8."""

import random

import corpus_pipeline
from netloom.llm import near_copies

SCHEMA = "doc_id long, text string, n_chars long"


def changed(rng, words, n):
    """n words replaced, ten apart, so each takes five shingles."""
    out = list(words)
    for k in range(n):
        out[10 * k + 5] = f"new{rng.random()}"
    return out


def similarity(a, b):
    x, y = ({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in ((t or "").lower().split() for t in (a, b)))
    return len(x & y) / len(x | y)


def test_near_copies_on_both_sides(spark, sf):
    rng = random.Random(5)
    texts = [None, "", " \n", "one two", "One  two", "one two three", "a b c d e", "a b c d e f"]
    for _ in range(40):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([60, 200, 400]))]
        texts.append(" ".join(base))
        most = len(base) // 10
        for n in (1, len(base) // 50, len(base) // 45 + 1, most // 2):  # about 0.8: 2n/9 of a tenth of the words
            texts.append(" ".join(changed(rng, base, min(n, most))))
    hub = [f"h{k}" for k in range(200)]
    texts += [" ".join(changed(rng, hub, 1 + k % 4)) for k in range(60)]
    rows = [(i * 7 % 100_003, t, 0) for i, t in enumerate(texts)]
    rows += [(None, texts[20], 0), (rows[30][0], texts[30], 0), (99_999, texts[30], 0), (None, "alone and without an id", 0)]
    group = list(range(len(rows)))

    def find(k):
        return k if group[k] == k else find(group[k])

    sides = [0, 0]
    for a in range(len(rows)):
        for b in range(a):
            s = similarity(rows[a][1], rows[b][1])
            if s >= 0.8:
                group[find(a)] = find(b)
            sides[0] += 0.8 <= s < 1
            sides[1] += 0.6 < s < 0.8
    assert min(sides) > 50
    best = {}
    for k, r in enumerate(rows):
        best.setdefault(find(k), []).append((r[0] is None, r[0] or 0))
    want = sorted(min(x) for x in best.values())
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    kept = corpus_pipeline.distinct(spark, docs, sf)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == want
    assert near_copies.one_per_group(spark.createDataFrame([], SCHEMA)).count() == 0
