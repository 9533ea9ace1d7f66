"""Ranked search against scoring every document for every item."""

from __future__ import annotations

import collections
import math
import random
import re

import numpy as np
import pytest

from apptlens.llm import dual_tree_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: c.lower() for c in map(chr, range(65, 91))})


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def by_hand(docs, items, k=10):
    split = [(i, terms(t)) for i, t in docs]
    n_docs, length = sum(bool(w) for _, w in split), sum(len(w) for _, w in split)
    df = collections.Counter(t for _, w in split for t in set(w))
    counts = [(i, len(w), collections.Counter(w)) for i, w in split]
    out = []
    for item, text in items:
        scored = []
        for i, n, tf in counts:
            m = 100 - 75 + (75 * n * n_docs) // max(length, 1)
            s = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * tf[t]) // (1000 * tf[t] + 8 * m))
                for t in terms(text)
                if tf[t]
            )
            if s > 0:
                scored.append((-s, i is None, i or 0))
        for rank, (s, missing, i) in enumerate(sorted(scored)[:k], 1):
            out.append((item, rank, None if missing else i, -s))
    return sorted(out, key=str)


def corpus(n, seed):
    rng = random.Random(seed)
    words = [f"t{int(rng.paretovariate(0.7)) % 400}" for _ in range(4000)]
    docs = [(i, " ".join(rng.sample(words, rng.randint(1, 60)))) for i in range(n)]
    docs += [(n + i, docs[7][1]) for i in range(40)]
    docs += [(3, docs[3][1]), (None, docs[7][1]), (None, "t1, T2 t3"), (n + 50, None), (n + 51, ""), (n + 52, "... -- !"), (n + 53, "É" * 70_000 + " t5")]
    items = [(i, " ".join(rng.sample(words, rng.randint(1, 20)))) for i in range(30)]
    items += [(100, docs[7][1]), (100, docs[7][1]), (101, None), (102, "unheard of"), (None, "T1 t1 t1 t9"), (103, "t5 t5"), (104, docs[9][1] + " t2" * 50)]
    return docs, items


@pytest.mark.parametrize("segment, rounds", [(24 << 20, 16), (2_000, 2)])
def test_every_score(spark, monkeypatch, segment, rounds):
    monkeypatch.setattr(dual_tree_search, "SEGMENT_BYTES", segment)
    monkeypatch.setattr(dual_tree_search, "FIRST_ROUND", rounds)
    docs, items = corpus(600, 5)
    random.Random(1).shuffle(docs)
    rows = [(i, t, "x", 1) for i, t in docs]
    frame = spark.createDataFrame(rows, "doc_id long, text string, rank string, score int").repartition(3)
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, item int")
    got = sorted((tuple(r) for r in dual_tree_search.top_documents(frame, asked).collect()), key=str)
    assert got == by_hand(docs, items)


def test_blocks_of_items_with_an_index_each(spark):
    docs, items = corpus(120, 6)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    asked = spark.createDataFrame(items, "item_id long, text string")
    build = dual_tree_search.top_documents
    got = sorted((tuple(r) for r in build(frame, asked, k=3, block_bytes=1_500, vocabulary_bytes=100).collect()), key=str)
    assert got == by_hand(docs, items, 3)


def test_empty_tables(spark):
    docs, items = corpus(20, 7)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert dual_tree_search.top_documents(frame.limit(0), asked).collect() == []
    assert dual_tree_search.top_documents(frame, asked.limit(0)).collect() == []


def test_bounds_prune():
    docs, items = corpus(600, 8)
    holding = collections.Counter()
    words = sorted({t for _, x in docs for t in terms(x)})
    number = {t: i for i, t in enumerate(words)}
    lengths, sizes, flat, counts = [], [], [], []
    for _, text in docs:
        own = sorted((number[t], c) for t, c in collections.Counter(terms(text)).items())
        lengths.append(len(terms(text)))
        sizes.append(len(own))
        flat += [t for t, _ in own]
        counts += [c for _, c in own]
        holding.update(t for t, _ in own)
    pack = lambda x, kind: np.array(x, dtype=kind).tobytes()
    row = {"doc_ids": [i for i, _ in docs], "lengths": pack(lengths, "int64"), "sizes": pack(sizes, "int32")}
    row |= {"terms": pack(flat, "int32"), "counts": pack(counts, "int32")}
    stats = dual_tree_search._Corpus(sum(n > 0 for n in lengths), sum(lengths), dict(holding))
    segment = dual_tree_search._Segment(row, stats, 10)
    scored = []
    products = dual_tree_search._Level.products
    level0 = segment.levels[0]
    level0.products = lambda nodes, weights: scored.append(len(nodes)) or products(level0, nodes, weights)
    own = [(i, {number[w]: c for w, c in collections.Counter(terms(t)).items() if w in number}) for i, (_, t) in enumerate(items)]
    tree, names = dual_tree_search._item_tree(own, stats)
    first = segment.search(tree, np.zeros(len(names), dtype="int64"), np.full(len(names), 2**63 - 1))
    alone = sum(scored)
    scored.clear()
    # A later round starts from the k-th results known so far, and finds the same.
    again = segment.search(tree, segment.score, segment.last_id)
    assert {i: [x.tolist() for x in v] for i, v in first.items()} == {i: [x.tolist() for x in v] for i, v in again.items()}
    assert sum(scored) < alone < 0.9 * len(docs) * len(names)
