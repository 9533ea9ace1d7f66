"""Sketches of paragraphs against counting them, on odd input and on given tables."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from apptlens.llm import invertible_sketch, queries
from apptlens.llm.common import table

PARAGRAPH = re.compile(r"[^.!?\n]{1,160}[.!?\n]*|[.!?\n]+")


def paragraphs(text):
    return collections.Counter(PARAGRAPH.findall(text))


def likeness(a, b):
    both = a.total() + b.total()
    return 2 * (a & b).total() / both if both else 1.0


def by_hand(rows, hashes):
    """All rows by descending id (none last), then by hash of the text."""
    order = sorted(((i is None, ~(i or 0), hashes[t or ""], i, t or "") for i, t in rows), key=lambda r: r[:3])
    out = []
    for k, (_, _, _, i, text) in enumerate(order):
        following = order[(k + 1) % len(order)][4]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        own = paragraphs(text)
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), likeness(own, paragraphs(edited)), likeness(own, paragraphs(following))))
    return sorted(out, key=str)


def check(spark, rows, schema="doc_id long, text string"):
    docs = spark.createDataFrame(rows, schema).repartition(3)
    pairs = [(r[0], r[1]) for r in rows]
    hashed = spark.createDataFrame([(t,) for t in {t or "" for _, t in pairs}], "t string").withColumn("h", F.xxhash64("t"))
    got = invertible_sketch.fingerprints(docs).collect()
    figures = sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in got), key=str)
    want = by_hand(pairs, {r["t"]: r["h"] for r in hashed.collect()})
    assert [r[:3] for r in figures] == [r[:3] for r in want]
    for mine, theirs in zip(figures, want):
        assert mine[3:] == pytest.approx(theirs[3:], abs=1e-12)
    return got


def prose(rng, sentences):
    return "".join(" ".join(f"w{rng.randint(0, 500)}" for _ in range(rng.randint(1, 12))) + rng.choice([". ", "?\n", "!", "\n"]) for _ in range(sentences))


def odd(n):
    rng = random.Random(n)
    texts = [prose(rng, rng.choice([1, 2, 5, 40, 120])) for _ in range(n)]
    rows = [(3 * i - 50, t) for i, t in enumerate(texts)]
    rows += [(900 + i, texts[4]) for i in range(9)] + [(7, texts[1]), (7, texts[2]), (7, texts[2]), (7, texts[2])]
    rows += [(None, texts[5]), (None, texts[5]), (None, "no id."), (1000, None), (1001, ""), (1002, "x" * 50_000), (1003, "\n" * 3_000)]
    rows += [(1004, "Ünïcode 𝔘𝔫. " * 400), (1005, texts[3] * 30), (1006, texts[3] * 29 + texts[0]), (-(2**63), "least."), (2**63 - 1, "most. " + texts[0])]
    return rows


@pytest.mark.parametrize("size, block, hot", [(16 << 20, 512, 100_000), (1_500, 4, 3)])
def test_against_counting(spark, monkeypatch, size, block, hot):
    monkeypatch.setattr(invertible_sketch, "RANGE_BYTES", size)
    monkeypatch.setattr(invertible_sketch, "BLOCK", block)
    monkeypatch.setattr(invertible_sketch, "HOT_ROWS", hot)
    extra = ["key string", "own string", "at int", "r int", "weight int", "cells string", "n int"]
    rows = [(*r, "x", "y", 1, 2, 3, "z", 4) for r in odd(60)]
    random.Random(2).shuffle(rows)
    got = check(spark, rows, ", ".join(["doc_id long, text string", *extra]))
    text = collections.defaultdict(set)
    for r in got:
        text[r["fingerprint"]].add((r["doc_id"], r["n_chars"]))
    copies = {(900 + i) for i in range(9)}
    assert any(copies <= {i for i, _ in ids} for ids in text.values())


def test_failed_sketches_are_made_larger(spark, monkeypatch):
    """With too few cells, every larger attempt fails a few times first."""
    monkeypatch.setattr(invertible_sketch, "SPARE", 0.05)
    check(spark, odd(20))


def test_lone_document_and_empty_table(spark):
    docs = spark.createDataFrame([(4, "One. Two. Three.")], "doc_id long, text string")
    check(spark, [(4, "One. Two. Three.")])
    assert invertible_sketch.fingerprints(docs.limit(0)).collect() == []


def test_given_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    check(spark, rows)
    assert queries.op11_invertible_sketch(spark, sf_dir).columns == [
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"
    ]


def test_changes_between_versions(spark):
    rng = random.Random(3)
    old = {i: prose(rng, rng.choice([0, 1, 8, 60, 200])) for i in range(40)}
    new = dict(old)
    for i in range(0, 40, 3):
        new[i] = old[i][: len(old[i]) // 2] + prose(rng, 3)
    new[7], new[41], new[2] = old[7] * 2, "Only here. Only here.", prose(rng, 150)
    del new[5]
    tables = [spark.createDataFrame(list(v.items()), "doc_id long, text string") for v in (old, new)]
    got = {r["doc_id"]: (r["gone"], r["come"]) for r in invertible_sketch.changes(*tables).collect()}
    pieces = {p for t in [*old.values(), *new.values()] for p in paragraphs(t)}
    hashed = spark.createDataFrame([(p,) for p in pieces], "p string").withColumn("h", F.xxhash64("p"))
    number = {r["p"]: r["h"] for r in hashed.collect()}
    want = {}
    for i in old.keys() | new.keys():
        a, b = paragraphs(old.get(i, "")), paragraphs(new.get(i, ""))
        if a != b:
            want[i] = tuple(sorted(number[p] for p in (x - y).elements()) for x, y in ((a, b), (b, a)))
    assert got == want
    assert invertible_sketch.changes(tables[0], tables[0]).isEmpty()
    assert invertible_sketch.changes(tables[0].limit(0), tables[1].limit(0)).isEmpty()
