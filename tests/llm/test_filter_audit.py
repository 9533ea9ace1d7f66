"""The filter audit against a walk through every order, on odd input."""

from __future__ import annotations

import collections
import itertools
import re

import pytest

from apptlens.llm import filter_audit

LONG = " ".join(f"w{i}" for i in range(250))
ROWS = [
    (1, LONG, "en"),
    (2, LONG, "en"),
    (2, LONG, "en"),
    (1, LONG, "en"),
    (3, LONG, None),
    (None, LONG, "en"),
    (4, None, "en"),
    (5, "", "fr"),
    (6, "", "fr"),
    (7, "same " * 300, "en"),
    (8, "SHOUTED " + LONG[:40], "en"),
    (9, "LOUD & " + "TEXT " * 240, "en"),
    (10, LONG + " #", ""),
    (11, "É" * 40_000 + "A" * 500, "fr"),
    (12, "a b" * 400, "en"),
]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (3, 1, 1), (4, None, 1), (7, 1, None), (8, 0, 0), (None, 1, 1), (99, 1, 1)]


def by_hand(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    docs = collections.defaultdict(list)
    for i, t, lang in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": re.search(r"[#$%&*|]", t) is not None,
            "E": i is not None and i > least[t],
        }
        docs[lang or ""].append((i, fails))
    out, shares = [], collections.Counter()
    for part, mine in docs.items():
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[1][f]]
                left = [d for d in left if not d[1][f]]
                shares[part, f] += len(gone)
                failing = sum(d[1][f] for d in mine)
                alone = sum(d[1][f] and sum(d[1].values()) == 1 for d in mine)
                lost = [sum(i in marked for i, _ in gone) for marked in (good, toxic)]
                out.append((part, "".join(order), step, len(left), len(gone), failing - len(gone), alone, *lost))
    return sorted((*r, shares[r[0], r[1][r[2] - 1]]) for r in out)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def test_every_step_of_every_order(spark, labels):
    extra = "digest string, good string, bits string, c string, __l_id string, __first string, pattern string"
    rows = [(*r, *["x"] * 7) for r in ROWS]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, lang string, {extra}").repartition(3)
    got = sorted(tuple(r) for r in filter_audit.audit(docs, labels).collect())
    want = by_hand(ROWS, LABELS)
    assert got == want
    assert any(r[6] for r in want) and any(r[7] for r in want) and any(r[8] for r in want)


def test_empty_tables(spark, labels):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    assert filter_audit.audit(docs.limit(0), labels).collect() == []
    rows = filter_audit.audit(docs, labels.limit(0)).collect()
    assert len(rows) == 3 * 600 and not any(r["good_lost"] or r["toxic_lost"] for r in rows)


def test_copies_reach_the_shuffle_as_counts(spark, labels):
    rows = [(i, LONG, "en") for i in range(20_000)] + [(20_000 + i, f"{i} " + LONG, "de") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    first = {r["part"]: r for r in filter_audit.audit(docs, labels).filter("filter_order = 'EABCD' and step = 1").collect()}
    assert (first["en"]["kept"], first["en"]["removed"]) == (1, 19_999)
    assert (first["de"]["kept"], first["de"]["removed"]) == (50, 0)
