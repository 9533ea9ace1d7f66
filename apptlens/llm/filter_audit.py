"""How five filters interact: what each removes, in every order of the five.

A document's outcome is one of 2 ** 5 patterns of passed and failed filters.
Per part (language), documents are counted by pattern, and the counts form a
tensor with one axis of length two per filter: index 0 passed, 1 failed.
Every figure of every step of every order is a contraction of that tensor with
one selector per axis: ``PASS`` for the filters before the step, ``FAIL`` or
``PASS`` for the step's own filter, ``ANY`` for those after it. One einsum per
part gives one figure of all 600 steps; the texts are read once.

Filters A to D look at the text alone, so exact copies agree on them. Filter E
compares with all smaller ids of the table: texts are met by SHA-256, and each
task first reduces its rows, so that a text with very many copies reaches the
shuffle as a few counts.

Defined cases: null text is empty, and empty texts are copies of each other;
null language is the part of the empty string; a row without id is not smaller
than any other and no other is smaller than it, so it never fails E; rows that
agree in id and text pass or fail E together; a document counts as good (toxic)
if any of its label rows says so, without one as neither; an empty table has no
parts and no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from apptlens.llm.common import known

# The filters, and when a document fails them.
FILTERS = "ABCDE"
LEAST_WORDS = 200
LEAST_DISTINCT = 50
MOST_CAPITALS = 3
SYMBOLS = b"#$%&*|"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"

PASS, FAIL, ANY = (1, 0), (0, 1), (1, 1)
ORDERS = ["".join(p) for p in permutations(FILTERS)]

_FACTS = "doc_id bigint, part string, bits int, digest binary"
_STEPS = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, "
    "unique_fails long, good_lost long, toxic_lost long, shapley long"
)


def _text_bits(raw: bytes, n_chars: int) -> int:
    """Filters A to D failed by a text, one bit each."""
    words = raw.split()
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    return (
        (len(words) < LEAST_WORDS)
        | (100 * len(set(words)) < LEAST_DISTINCT * len(words)) << 1
        | (100 * capitals > MOST_CAPITALS * n_chars) << 2
        | (len(raw) != len(raw.translate(None, SYMBOLS))) << 3
    )


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits, digests = [], []
        for text, n_chars in zip(batch.column(2), pc.utf8_length(batch.column(2)).to_pylist()):
            raw = text.as_buffer().to_pybytes()
            bits.append(_text_bits(raw, n_chars))
            digests.append(sha256(raw).digest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(bits, pa.int32()), pa.array(digests, pa.binary())],
            ["doc_id", "part", "bits", "digest"],
        )


def outcomes(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """Documents per ``part``, ``pattern`` (bit k: fails filter k), ``good`` and ``toxic``: column ``n``."""
    rows = docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"), known(f"`{part}`").alias("part"), known(f"`{text}`").alias("text")
    )
    # Rows that agree in everything become one with a count before the shuffle.
    facts = rows.mapInArrow(_facts, _FACTS).groupBy("doc_id", "part", "bits", "digest").agg(F.count(F.lit(1)).alias("c"))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("__l_id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
    )
    facts = facts.join(marks, F.col("doc_id") == F.col("__l_id"), "left").select(
        "doc_id", "part", "bits", "digest", "c", *[F.coalesce(m, F.lit(False)).alias(m) for m in ("good", "toxic")]
    )
    # A copy's fate depends on whether its id is the least one of the text.
    kinds = facts.groupBy("digest", "part", "bits", "good", "toxic").agg(
        F.sum("c").alias("n"),
        F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("c"))), F.lit(0)).alias("without_id"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "c"))).alias("least"),
    )
    # Rows per text are now bounded by the parts and label values.
    first = F.min("least.doc_id").over(Window.partitionBy("digest"))
    kinds = kinds.withColumn("__first", first)
    passing = F.col("without_id") + F.when(F.col("least.doc_id") == F.col("__first"), F.col("least.c")).otherwise(0)
    split = F.array(
        F.struct(F.col("bits").alias("pattern"), passing.alias("n")),
        F.struct((F.col("bits") + 16).alias("pattern"), (F.col("n") - passing).alias("n")),
    )
    return (
        kinds.select("part", "good", "toxic", F.explode(split).alias("s"))
        .groupBy("part", F.col("s.pattern").alias("pattern"), "good", "toxic")
        .agg(F.sum("s.n").alias("n"))
        .filter("n > 0")
    )


def _selectors() -> dict[str, np.ndarray]:
    """Per figure, the selector of every axis for all steps of all orders: (steps, filters, 2)."""
    kept, removed, failing, alone = [], [], [], []
    for order in ORDERS:
        for step, name in enumerate(order):
            before = order[:step]
            removed.append([PASS if f in before else FAIL if f == name else ANY for f in FILTERS])
            kept.append([PASS if f in before or f == name else ANY for f in FILTERS])
            failing.append([FAIL if f == name else ANY for f in FILTERS])
            alone.append([FAIL if f == name else PASS for f in FILTERS])
    named = {"kept": kept, "removed": removed, "failing": failing, "alone": alone}
    return {k: np.array(v, dtype=np.int64) for k, v in named.items()}


def _contract(tensor: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The tensor summed over what each row of selectors picks on every axis."""
    return np.einsum("abcde,na,nb,nc,nd,ne->n", tensor, *[chosen[:, k] for k in range(len(FILTERS))], optimize=True)


def _steps_of_part(rows: pd.DataFrame) -> pd.DataFrame:
    """All steps of all orders of one part, from at most 128 counts."""

    def tensor(mine: pd.DataFrame) -> np.ndarray:
        flat = np.zeros(1 << len(FILTERS), dtype=np.int64)
        np.add.at(flat, mine["pattern"].to_numpy(), mine["n"].to_numpy())
        # Bit k is axis k: the last axis of a C-ordered array moves fastest, so the axes are reversed.
        return flat.reshape((2,) * len(FILTERS)).transpose(range(len(FILTERS))[::-1])

    every, good, toxic = tensor(rows), tensor(rows[rows["good"]]), tensor(rows[rows["toxic"]])
    pick = _selectors()
    removed = _contract(every, pick["removed"])
    names = np.array([f for order in ORDERS for f in order])
    total = {f: removed[names == f].sum() for f in FILTERS}
    return pd.DataFrame(
        {
            "part": rows["part"].iloc[0],
            "filter_order": [order for order in ORDERS for _ in FILTERS],
            "step": np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(ORDERS)),
            "kept": _contract(every, pick["kept"]),
            "removed": removed,
            "redundant": _contract(every, pick["failing"]) - removed,
            "unique_fails": _contract(every, pick["alone"]),
            "good_lost": _contract(good, pick["removed"]),
            "toxic_lost": _contract(toxic, pick["removed"]),
            "shapley": [total[f] for f in names],
        }
    )


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """One row per part, filter order and step."""
    return outcomes(docs, labels, doc_id, text, part).groupBy("part").applyInPandas(_steps_of_part, _STEPS)


_W = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE_SQL = f"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, {_W} AS w FROM documents),
f AS (SELECT doc_id, part, t, len(w) < {LEAST_WORDS} AS a,
  100 * len(list_distinct(w)) < {LEAST_DISTINCT} * len(w) AS b,
  100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > {MOST_CAPITALS} * length(t) AS c,
  regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id),
n AS (SELECT part, [a, b, c, d, e] AS fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, count(*) AS n
  FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
k AS (SELECT unnest(range(1, 6)) AS k),
o AS (SELECT [p.k, q.k, r.k, s.k, u.k] AS o FROM k p, k q, k r, k s, k u
  WHERE len(list_distinct([p.k, q.k, r.k, s.k, u.k])) = 5),
steps AS (SELECT list_aggregate(list_transform(o, lambda x: substr('{FILTERS}', x, 1)), 'string_agg', '') AS filter_order,
  k.k AS step, o[k.k] AS mine, o[1:k.k - 1] AS before FROM o, k),
x AS (SELECT part, filter_order, step, mine, n, good, toxic, fails[mine] AS fail,
  len(list_filter(before, lambda z: fails[z])) > 0 AS gone, len(list_filter(fails, lambda z: z)) = 1 AS alone FROM n, steps),
y AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, mine,
  CAST(sum(CASE WHEN NOT gone AND NOT fail THEN n ELSE 0 END) AS BIGINT) AS kept,
  CAST(sum(CASE WHEN NOT gone AND fail THEN n ELSE 0 END) AS BIGINT) AS removed,
  CAST(sum(CASE WHEN gone AND fail THEN n ELSE 0 END) AS BIGINT) AS redundant,
  CAST(sum(CASE WHEN fail AND alone THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
  CAST(sum(CASE WHEN NOT gone AND fail AND good = 1 THEN n ELSE 0 END) AS BIGINT) AS good_lost,
  CAST(sum(CASE WHEN NOT gone AND fail AND toxic = 1 THEN n ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM x GROUP BY part, filter_order, step, mine)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, mine) AS BIGINT) AS shapley FROM y"""
