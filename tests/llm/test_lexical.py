"""Ranked search against plain Python over all pairs."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from curvespark.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k):
    """(item, rank, doc, score) of each item row, by the formula."""
    bags = [(i, words(t)) for i, t in docs]
    bags = [(i, w) for i, w in bags if w]
    n_docs, total = len(bags), sum(len(w) for _, w in bags)
    df = Counter(t for _, w in bags for t in set(w))
    out = []
    for item, text in items:
        wanted = Counter(words(text))
        scores = []
        for doc, w in bags:
            tf, m = Counter(w), 100 - 75 + (75 * len(w) * n_docs) // total
            s = sum(n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * tf[t]) // (1000 * tf[t] + 8 * m)) for t, n in wanted.items() if tf[t])
            if s > 0:
                scores.append((-s, doc is None, doc or 0, doc))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{k}é" if k % 7 == 0 else f"w{k}" for k in range(120)]
    weights = [1 / (k + 1) for k in range(120)]
    text = lambda most: " ".join(rng.choices(vocabulary, weights, k=rng.randrange(most)))
    docs = [(k, text(80) if k % 5 else text(8)) for k in range(n)]
    docs += [(n + k, docs[3][1]) for k in range(40)] + [(None, docs[3][1]), (None, None), (7, ""), (2, "W1,W1;w1 -- É"), (2, "w1")]
    items = [(k, text(25)) for k in range(12)] + [(3, "w1 w1 W2"), (3, "w1 w1 W2"), (99, None), (98, "!!"), (97, "unknown"), (96, docs[3][1])]
    return docs, items


@pytest.mark.parametrize("block_terms", [100_000, 30])
def test_search_equals_all_pairs(spark, block_terms):
    docs, items = corpus(1, 300)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumns({c: F.lit(1) for c in ("terms", "n", "score", "block", "query")})
    i = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit(1) for c in ("id", "rank", "block")})
    got = sorted(map(tuple, lexical.search(d, i, 10, block_terms=block_terms).select("item_id", "rank", "doc_id", "score").collect()), key=str)
    assert got == plain(docs, items, 10)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([("x", "a")], "item_id string, text string")
    assert lexical.search(docs.limit(0), items).count() == 0 and lexical.search(docs, items.limit(0)).count() == 0
    assert [tuple(r) for r in lexical.search(docs, items).collect()] == plain([(1, "a b")], [("x", "a")], 10)


def test_terms_are_those_of_the_pattern():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(chr(rng.choice([rng.randrange(128), rng.randrange(0x100, 0x2000), 0x1F600])) for _ in range(40))
        assert [t.decode() for t in lexical.terms(text)] == words(text)
    assert lexical.terms(None) == [] and len(lexical.terms("a " * 300_000)) == 300_000


def test_bounds_skip_buckets_and_documents_but_lose_nothing(monkeypatch):
    """Many short and few long vectors: buckets are left by length, documents by their heaviest coordinates, and the best stay."""
    rng = np.random.default_rng(3)
    monkeypatch.setattr(lexical, "FOCUS", 3)
    n, v = 6000, 60
    rows = [np.sort(rng.choice(v, rng.integers(1, 4 if k % 20 else 25), replace=False)) for k in range(n)]
    values = [rng.integers(1, 1_000_000 if k % 20 else 1_000_000, len(r)) // (1 if k % 20 == 0 else 6) + 1 for k, r in enumerate(rows)]
    weights = rng.integers(1, 9000, v)
    norms = np.array([math.sqrt((weights[r] * x.astype(float) ** 2).sum()) for r, x in zip(rows, values, strict=True)])

    class Item:
        def __init__(self, ids):
            self.terms, self.counts = [f"{i:03}" for i in ids], [1 + i % 2 for i in ids]

    asked = [Item(np.sort(rng.choice(v, 12, replace=False))) for _ in range(10)] + [Item(range(v))]
    queries = lexical.Queries.of(asked)
    search = lexical.Search(queries, weights, 10)
    order = np.argsort(-norms)
    for at in range(0, n, 256):
        part = order[at : at + 256]
        search.bucket(part, np.zeros(len(part), bool), np.array([len(rows[k]) for k in part]), np.concatenate([rows[k] for k in part]), np.concatenate([values[k] for k in part]), norms[part])
    for q, item in enumerate(asked):
        count = {int(t): c for t, c in zip(item.terms, item.counts, strict=True)}
        scores = sorted(((-sum(int(weights[t]) * count.get(int(t), 0) * int(x) for t, x in zip(rows[k], values[k], strict=True)), k) for k in range(n)))[:10]
        assert [(-int(s), int(i)) for s, i in zip(search.best[q].scores, search.best[q].ids, strict=True)] == scores
    assert search.skipped > search.compared and search.rescored < 0.8 * 256 * search.compared
