"""Benchmark passages in training text, through a positional inverted index.

The index is partitioned by documents: one row per segment, with the sorted
word positions of every term that a test item uses, and the place of every
document in the segment. It is written to the shared folder. A phrase is found
by intersecting its terms' position lists, each shifted by the term's offset,
from the rarest term of the segment to the most frequent. Proximity matches
ask that all terms lie near an occurrence of the rarest. Segments never meet,
so neither copies nor frequent words load one task.

Test items go to the tasks in blocks of bounded size; larger test sets take
several rounds, whose hits are merged.

Defined cases: null or empty text has no words; rows that agree in id and text
get the same result; items without words match nothing; items without id
count as hits but are not listed; empty tables give no rows, or no hits; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apptlens.llm.common import known
from apptlens.session import materialize

WINDOW = 10
SEGMENT_BYTES = 24 << 20
BLOCK_BYTES = 16 << 20
# Contaminated documents whose ids are sent to the texts; for more, both are shuffled.
BROADCAST_ROWS = 1 << 20

# Words are runs of digits, lower-case letters and all that is not ASCII.
_PLAIN = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)

_INDEX_SCHEMA = (
    "doc_ids array<bigint>, text_keys array<bigint>, n_words array<int>, terms binary, counts binary, positions binary"
)


def words_of(text: str | None) -> list[bytes]:
    """The lower-cased words of a text as UTF-8."""
    return (text or "").encode().translate(_PLAIN).split()


def _text_key(text: bytes) -> int:
    """What Spark's ``xxhash64`` gives for a text (its seed is 42)."""
    h = xxhash.xxh64_intdigest(text, 42)
    return h - (1 << 64) if h >> 63 else h


def _segment(ids: list, texts: list[bytes], vocabulary: dict[bytes, int]) -> dict:
    """One row of the index. Documents lie one position apart, so that no phrase spans two."""
    numbers, lengths = [], []
    for text in texts:
        found = [vocabulary.get(w, -1) for w in text.translate(_PLAIN).split()]
        numbers += found
        numbers.append(-1)
        lengths.append(len(found))
    term = np.array(numbers, dtype=np.int32)
    at = np.flatnonzero(term >= 0)
    order = np.argsort(term[at], kind="stable")
    at, term = at[order], term[at][order]
    terms, first, counts = np.unique(term, return_index=True, return_counts=True)
    # Steps instead of positions: small numbers compress.
    steps = np.diff(at, prepend=0)
    steps[first] = at[first]
    return {
        "doc_ids": ids,
        "text_keys": [_text_key(t) for t in texts],
        "n_words": lengths,
        "terms": terms.astype(np.int32).tobytes(),
        "counts": counts.astype(np.int32).tobytes(),
        "positions": steps.astype(np.int32).tobytes(),
    }


def build(docs: DataFrame, doc_id: str, text: str, vocabulary: list[bytes]) -> DataFrame:
    """The index over all documents, for the terms of the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = {w: i for i, w in enumerate(shared.value)}
        schema = pa.schema(
            [("doc_ids", pa.list_(pa.int64())), ("text_keys", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int32()))]
            + [(c, pa.binary()) for c in ("terms", "counts", "positions")]
        )
        ids, texts, size = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = t.as_buffer().to_pybytes()
                ids.append(i)
                texts.append(raw)
                size += len(raw)
                if size >= SEGMENT_BYTES:
                    yield pa.RecordBatch.from_pylist([_segment(ids, texts, numbers)], schema)
                    ids, texts, size = [], [], 0
        if ids:
            yield pa.RecordBatch.from_pylist([_segment(ids, texts, numbers)], schema)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), known(text).alias("text"))
    return materialize(rows.mapInArrow(segments, _INDEX_SCHEMA), "positional-index")


def _lists(row: dict) -> dict[int, np.ndarray]:
    """Term number to its sorted positions in the segment."""
    terms = np.frombuffer(row["terms"], dtype=np.int32)
    counts = np.frombuffer(row["counts"], dtype=np.int32)
    steps = np.frombuffer(row["positions"], dtype=np.int32).astype(np.int64)
    ends = np.cumsum(counts)
    return {int(t): np.cumsum(steps[e - n : e]) for t, n, e in zip(terms, counts, ends)}


def phrase_starts(lists: dict[int, np.ndarray], phrase: tuple[int, ...]) -> np.ndarray:
    """Where the terms stand in this order, one after the other."""
    order = sorted(range(len(phrase)), key=lambda o: len(lists[phrase[o]]))
    starts = lists[phrase[order[0]]] - order[0]
    for o in order[1:]:
        if not len(starts):
            break
        there = lists[phrase[o]]
        k = np.searchsorted(there, starts + o)
        k[k == len(there)] = 0
        starts = starts[there[k] == starts + o]
    return starts


def near_anchors(lists: dict[int, np.ndarray], phrase: tuple[int, ...], span: int) -> np.ndarray:
    """Occurrences of the rarest term with every other term at most ``span`` words away."""
    order = sorted(set(phrase), key=lambda t: len(lists[t]))
    anchors = lists[order[0]]
    for t in order[1:]:
        there = np.concatenate([[-1 << 40], lists[t], [1 << 40]])
        k = np.searchsorted(there, anchors)
        anchors = anchors[np.minimum(there[k] - anchors, anchors - there[k - 1]) <= span]
    return anchors


def windows_of(words: list[bytes], width: int = WINDOW) -> list[tuple[bytes, ...]]:
    """All windows of consecutive words; a shorter item is one window."""
    if not words:
        return []
    return [tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]


def _matches(index: DataFrame, phrases: dict[tuple[int, ...], list], span: int | None) -> DataFrame:
    """Per document with matches: ranges of hit words, and the items."""
    shared = index.sparkSession.sparkContext.broadcast(phrases)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield _search(row, shared.value, span)

    schema = "doc_id bigint, text_key bigint, starts array<int>, ends array<int>, items array<bigint>"
    return index.mapInArrow(search, schema)


def _search(row: dict, phrases: dict[tuple[int, ...], list], span: int | None) -> pa.RecordBatch:
    lists = _lists(row)
    sizes = np.array(row["n_words"], dtype=np.int64) + 1
    first = np.cumsum(sizes) - sizes
    cover = np.zeros(int(sizes.sum()) + 1, dtype=np.int32)
    items: dict[int, set] = {}
    for phrase, owners in phrases.items():
        if not all(t in lists for t in phrase):
            continue
        if span is None:
            starts, width = phrase_starts(lists, phrase), len(phrase)
        else:
            starts, width = near_anchors(lists, phrase, span), 1
        if len(starts):
            np.add.at(cover, starts, 1)
            np.add.at(cover, starts + width, -1)
            for d in np.unique(np.searchsorted(first, starts, side="right") - 1).tolist():
                items.setdefault(d, set()).update(owners)
    edge = np.diff((np.cumsum(cover) > 0).astype(np.int8), prepend=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    doc = np.searchsorted(first, begin, side="right") - 1
    out = []
    for d in sorted(items):
        mine = slice(*np.searchsorted(doc, [d, d + 1]))
        out.append(
            {
                "doc_id": row["doc_ids"][d],
                "text_key": row["text_keys"][d],
                "starts": (begin[mine] - first[d]).tolist(),
                "ends": (end[mine] - first[d]).tolist(),
                "items": sorted(i for i in items[d] if i is not None),
            }
        )
    schema = pa.schema(
        [("doc_id", pa.int64()), ("text_key", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))]
        + [("items", pa.list_(pa.int64()))]
    )
    return pa.RecordBatch.from_pylist(out, schema)


def _blocks(items: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list]:
    """The test items, collected block by block."""
    rows = items.select(F.col(item_id).cast("long").alias("item_id"), known(text).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for b in range(n):
        yield rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).collect()


def _union(ranges: Column) -> Column:
    """Words covered by ranges that may overlap."""
    zero = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(
        F.sort_array(ranges),
        zero,
        lambda s, r: F.struct(
            F.greatest(s["upto"], r["ends"]).alias("upto"),
            (s["n"] + F.greatest(r["ends"] - F.greatest(s["upto"], r["starts"]), F.lit(0))).alias("n"),
        ),
        lambda s: s["n"],
    )


def matches(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = WINDOW,
    span: int | None = None,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Per document: ``n_words``, ``n_hit`` and the ``items`` it shares a window with.

    Exact phrases, or with ``span`` windows whose words all lie that near to
    the rarest of them (then ``n_hit`` counts those anchors).
    """
    rows, hits, rounds = None, None, 0
    for block in _blocks(items, item_id, item_text, block_bytes):
        spelled: dict[tuple[bytes, ...], list] = {}
        for r in block:
            for w in windows_of(words_of(r["text"]), width):
                spelled.setdefault(w, []).append(r["item_id"])
        vocabulary = sorted({t for w in spelled for t in w})
        numbers = {t: i for i, t in enumerate(vocabulary)}
        phrases = {tuple(numbers[t] for t in w): sorted(set(i), key=lambda x: (x is None, x)) for w, i in spelled.items()}
        index = build(docs, doc_id, text, vocabulary)
        if rows is None:
            rows = index.select(F.explode(F.arrays_zip("doc_ids", "text_keys", "n_words")).alias("r")).select(
                F.col("r.doc_ids").alias("doc_id"), F.col("r.text_keys").alias("text_key"), F.col("r.n_words").alias("n_words")
            )
        found = materialize(_matches(index, phrases, span), "phrase-hits").dropDuplicates(["doc_id", "text_key"])
        hits = found if hits is None else hits.unionByName(found)
        rounds += 1
    hits = hits.select("doc_id", "text_key", F.arrays_zip("starts", "ends").alias("ranges"), "items")
    if rounds > 1:
        hits = hits.groupBy("doc_id", "text_key").agg(
            F.flatten(F.collect_list("ranges")).alias("ranges"), F.flatten(F.collect_list("items")).alias("items")
        )
    hits = hits.select(
        F.struct("doc_id", "text_key").alias("key"), _union(F.col("ranges")).alias("n_hit"), F.array_distinct("items").alias("items")
    )
    same = F.struct(rows["doc_id"], rows["text_key"]).eqNullSafe(hits["key"])
    return rows.join(hits, same, "left").select(
        "doc_id",
        "text_key",
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<bigint>")).alias("items"),
    )


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The matches with the items as a digest."""
    listed = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return matches(docs, items).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that share no window with any item, with their own columns.

    Rows that agree in id and text are kept or dropped together.
    """
    hit = matches(docs, items, doc_id, text).filter("n_hit > 0").select(F.struct("doc_id", "text_key").alias("__p_key")).distinct()
    hit = materialize(hit, "contaminated-documents")
    if hit.count() <= BROADCAST_ROWS:
        hit = F.broadcast(hit)
    mine = F.struct(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(known(f"`{text}`")).alias("text_key"))
    return docs.join(hit, mine.eqNullSafe(F.col("__p_key")), "left_anti")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT item_id, list_aggregate(w[i:i + {WINDOW - 1}], 'string_agg', ' ') AS g, least(len(w), {WINDOW}) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, i, n, list_aggregate(w[i:i + n - 1], 'string_agg', ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT r, i, dw.n, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS l
  FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)"""
