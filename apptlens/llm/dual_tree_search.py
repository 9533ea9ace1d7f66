"""Ranked lexical search with a tree over the items and a tree over the documents.

Every document is a point whose coordinates are the saturated counts of the
terms that items use, every item a point of term weights; a score is their
inner product. Documents are indexed in segments, one stored row each. Inside a
segment a tree of documents holds coordinate maxima per node, and a tree over
the items holds the maxima of their weights. The product of two nodes bounds
every score between them, so a pair of nodes is dropped, with all its items and
documents, when the bound falls behind the weakest k-th score among the node's
items. At the leaves the bound is the score itself. All arithmetic is in 64-bit
integers, so bounds and scores are exact and nothing is lost.

Two rounds: a sixteenth of the segments gives every item its k-th score so far,
and the other segments start from there, so they return only what can still
enter a XX

Items travel to the tasks in blocks of ``BLOCK_BYTES`` of distinct texts. The
index holds the terms of all items where these are at most
``VOCABULARY_BYTES``; beyond that, each block gets an index of its own.

Defined cases: null text has no terms; an item without terms, or whose terms
no document holds, has no results; items that agree in text get the same
results, and repeated rows of items each get theirs; repeated rows of
documents take a place each; a document without id comes after others of the
same score; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from apptlens.llm.common import known
from apptlens.session import materialize

BEST = 10
SEGMENT_BYTES = 24 << 20
BLOCK_BYTES = 8 << 20
VOCABULARY_BYTES = 16 << 20
FIRST_ROUND = 16
# Documents in a leaf, document nodes in a node, item nodes in a node.
LEAF, FAN, ITEM_FAN = 16, 8, 4
# Leaves searched before the others, to raise an item's k-th score.
AHEAD = 4

# Terms are runs of digits, ASCII letters (lower-cased) and all that is not ASCII.
_PLAIN = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_NO_ID = np.iinfo(np.int64).max
_INDEX = "n_docs bigint, n_terms bigint, doc_ids array<bigint>, lengths binary, sizes binary, terms binary, counts binary"


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return text.translate(_PLAIN).split()


def _texts(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(known(f"`{column}`").alias("text"))


def _distinct_terms(texts: DataFrame) -> DataFrame:
    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                own = sorted(set(terms_of(text.as_buffer().to_pybytes())))
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary())], ["term"])

    return texts.mapInArrow(terms, "term binary").distinct()


def _index(docs: DataFrame, doc_id: str, text: str, vocabulary: list[bytes]) -> DataFrame:
    """One stored row per segment: for every document its counts of the vocabulary's terms, in order of term."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = pa.schema(
        [("n_docs", pa.int64()), ("n_terms", pa.int64()), ("doc_ids", pa.list_(pa.int64()))]
        + [(c, pa.binary()) for c in ("lengths", "sizes", "terms", "counts")]
    )

    def row(ids: list, lengths: list, sizes: list, terms: list, counts: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(
            [
                {
                    "n_docs": sum(n > 0 for n in lengths),
                    "n_terms": sum(lengths),
                    "doc_ids": ids,
                    "lengths": np.array(lengths, dtype=np.int64).tobytes(),
                    "sizes": np.array(sizes, dtype=np.int32).tobytes(),
                    "terms": np.array(terms, dtype=np.int32).tobytes(),
                    "counts": np.array(counts, dtype=np.int32).tobytes(),
                }
            ],
            schema,
        )

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(shared.value)}
        parts: tuple[list, ...] = ([], [], [], [], [])
        taken = 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = t.as_buffer().to_pybytes()
                words = terms_of(raw)
                own = sorted((number[w], c) for w, c in Counter(words).items() if w in number)
                ids, lengths, sizes, terms, counts = parts
                ids.append(i)
                lengths.append(len(words))
                sizes.append(len(own))
                terms.extend(n for n, _ in own)
                counts.extend(c for _, c in own)
                taken += len(raw) + 64
                if taken >= SEGMENT_BYTES:
                    yield row(*parts)
                    parts, taken = ([], [], [], [], []), 0
        if parts[0]:
            yield row(*parts)

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), known(f"`{text}`").alias("text"))
    return materialize(rows.mapInArrow(segments, _INDEX), "lexical-index")


def _document_counts(index: DataFrame) -> dict[int, int]:
    """In how many documents each term of the vocabulary occurs."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for held in batch.column(0):
                terms, n = np.unique(np.frombuffer(held.as_buffer(), dtype=np.int32), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(n.astype(np.int64))], ["term", "n"])

    held = index.select("terms").mapInArrow(counts, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    held = held.toArrow()
    return dict(zip(held["term"].to_pylist(), held["n"].to_pylist()))


class _Corpus:
    """Counts over all documents, and what follows from them."""

    def __init__(self, n_docs: int, n_terms: int, holding: dict[int, int]):
        self.n_docs, self.n_terms = n_docs, n_terms
        self.weight = {t: floor(1000 * log((2 * n_docs + 2) / (2 * df + 1))) for t, df in holding.items()}

    def impacts(self, lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The saturated count of a term in a document of that length."""
        scaled = 75 * self.n_docs
        if len(lengths) and int(lengths.max()) * scaled >= 1 << 62:
            ratio = np.array([scaled * n // self.n_terms for n in lengths.tolist()], dtype=np.int64)
        else:
            ratio = lengths * scaled // max(self.n_terms, 1)
        counts = counts.astype(np.int64)
        return 1_000_000_000 * counts // (1000 * counts + 8 * (25 + ratio))


class _ItemNode:
    """A run of items: the maxima of their weights per term, and the nodes below."""

    def __init__(self, first: int, last: int, terms: np.ndarray, weights: np.ndarray, below: list[_ItemNode]):
        self.first, self.last, self.terms, self.weights, self.below = first, last, terms, weights, below


def _maxima(terms: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(terms, kind="stable")
    kinds, first = np.unique(terms[order], return_index=True)
    return kinds, np.maximum.reduceat(values[order], first) if len(kinds) else values


def _item_tree(items: list[tuple[int, dict[int, int]]], corpus: _Corpus) -> tuple[_ItemNode, list[int]] | None:
    """The tree over items, and the items' numbers in the order of its leaves.

    Items with the same frequent terms, as a rule those of one language, stand together.
    """
    weighted = []
    for name, counts in items:
        own = {t: n * corpus.weight[t] for t, n in counts.items() if corpus.weight.get(t, 0) > 0}
        if own:
            weighted.append((tuple(sorted(own, key=lambda t: (corpus.weight[t], t))), name, own))
    if not weighted:
        return None
    weighted.sort()
    level = []
    for i, (_, _, own) in enumerate(weighted):
        terms = np.array(sorted(own), dtype=np.int32)
        level.append(_ItemNode(i, i + 1, terms, np.array([own[t] for t in terms.tolist()], dtype=np.int64), []))
    while len(level) > 1:
        grouped = [level[i : i + ITEM_FAN] for i in range(0, len(level), ITEM_FAN)]
        level = [
            _ItemNode(g[0].first, g[-1].last, *_maxima(np.concatenate([n.terms for n in g]), np.concatenate([n.weights for n in g])), g)
            for g in grouped
        ]
    return level[0], [name for _, name, _ in weighted]


class _Level:
    """One level of the document tree: per node its terms with their maxima, and the least id below it."""

    def __init__(self, start: np.ndarray, term: np.ndarray, value: np.ndarray, least: np.ndarray):
        self.start, self.term, self.value, self.least = start, term, value, least

    def above(self, fan: int) -> _Level:
        n = -(-len(self.least) // fan)
        node = np.repeat(np.arange(len(self.least)) // fan, np.diff(self.start))
        order = np.lexsort((self.term, node))
        node, term, value = node[order], self.term[order], self.value[order]
        first = np.flatnonzero((np.diff(node, prepend=-1) != 0) | (np.diff(term, prepend=-1) != 0))
        value = np.maximum.reduceat(value, first) if len(first) else value
        start = np.searchsorted(node[first], np.arange(n + 1))
        return _Level(start, term[first], value, np.minimum.reduceat(self.least, np.arange(0, len(self.least), fan)))

    def products(self, nodes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Per node, the sum over terms of weight times maximum."""
        size = self.start[nodes + 1] - self.start[nodes]
        end = np.cumsum(size)
        at = np.arange(end[-1]) + np.repeat(self.start[nodes] - (end - size), size)
        total = np.concatenate([[0], np.cumsum(weights[self.term[at]] * self.value[at])])
        return total[end] - total[end - size]


class _Segment:
    """The search of one segment, for all items of a block."""

    def __init__(self, row: dict, corpus: _Corpus, k: int):
        lengths = np.frombuffer(row["lengths"], dtype=np.int64)
        sizes = np.frombuffer(row["sizes"], dtype=np.int32)
        terms = np.frombuffer(row["terms"], dtype=np.int32)
        impact = corpus.impacts(np.repeat(lengths, sizes), np.frombuffer(row["counts"], dtype=np.int32))
        self.kinds, local = np.unique(terms, return_inverse=True)
        weight = np.array([corpus.weight[t] for t in self.kinds.tolist()], dtype=np.int64)
        ids = np.array([_NO_ID if i is None else i for i in row["doc_ids"]], dtype=np.int64)
        # Documents with the same heaviest term stand together, which keeps maxima tight.
        doc = np.repeat(np.arange(len(ids)), sizes)
        heaviest = np.full(len(ids), -1, dtype=np.int64)
        by_gain = np.argsort(weight[local] * impact, kind="stable")
        heaviest[doc[by_gain]] = local[by_gain]
        self.order = np.lexsort((ids, heaviest))
        place = np.empty(len(ids), dtype=np.int64)
        place[self.order] = np.arange(len(ids))
        entry = np.argsort(place[doc], kind="stable")
        start = np.concatenate([[0], np.cumsum(sizes[self.order])]).astype(np.int64)
        self.levels = [_Level(start, local[entry].astype(np.int64), impact[entry], ids[self.order])]
        while len(self.levels[-1].least) > 1:
            self.levels.append(self.levels[-1].above(LEAF if len(self.levels) == 1 else FAN))
        self.doc_ids, self.k = row["doc_ids"], k
        self.buffer = np.zeros(len(self.kinds), dtype=np.int64)

    def search(self, tree: _ItemNode, score: np.ndarray, last_id: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Per item its best scores and places here; ``score`` and ``last_id`` are the k-th results so far."""
        self.score, self.last_id = score.copy(), last_id.copy()
        self.found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        top = len(self.levels) - 1
        self._visit(tree, top, np.arange(len(self.levels[top].least)))
        return self.found

    def _alive(self, node: _ItemNode, bound: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Which document nodes may still hold a result of one of the items."""
        score = self.score[node.first : node.last]
        weakest = score.min()
        last = self.last_id[node.first : node.last][score == weakest].max()
        return (bound > weakest) | ((bound == weakest) & (least <= last) & (bound > 0))

    def _bounds(self, node: _ItemNode, level: int, nodes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.kinds, node.terms)
        at[at == len(self.kinds)] = 0
        here = self.kinds[at] == node.terms if len(self.kinds) else np.zeros(len(at), dtype=bool)
        self.buffer[at[here]] = node.weights[here]
        out = self.levels[level].products(nodes, self.buffer)
        self.buffer[at[here]] = 0
        return out

    def _visit(self, node: _ItemNode, level: int, nodes: np.ndarray) -> None:
        bound = self._bounds(node, level, nodes)
        alive = self._alive(node, bound, self.levels[level].least[nodes])
        nodes, bound = nodes[alive], bound[alive]
        if not len(nodes):
            return
        if node.below:
            down = level > 1
            kept = self._children(level, nodes) if down else nodes
            for below in node.below:
                self._visit(below, level - 1 if down else level, kept)
        elif level == 0:
            self._keep(node.first, bound, nodes)
        else:
            order = np.argsort(-bound, kind="stable")
            self._visit(node, level - 1, self._children(level, nodes[order[:AHEAD]]))
            rest = order[AHEAD:]
            rest = rest[self._alive(node, bound[rest], self.levels[level].least[nodes[rest]])]
            if len(rest):
                self._visit(node, level - 1, self._children(level, nodes[rest]))

    def _children(self, level: int, nodes: np.ndarray) -> np.ndarray:
        fan = LEAF if level == 1 else FAN
        below = (nodes[:, None] * fan + np.arange(fan)).ravel()
        return below[below < len(self.levels[level - 1].least)]

    def _keep(self, item: int, scores: np.ndarray, places: np.ndarray) -> None:
        if item in self.found:
            scores, places = np.concatenate([self.found[item][0], scores]), np.concatenate([self.found[item][1], places])
        ids = self.levels[0].least[places]
        best = np.lexsort((ids, -scores))[: self.k]
        self.found[item] = scores[best], places[best]
        if len(best) == self.k:
            last, last_id = scores[best[-1]], ids[best[-1]]
            if last > self.score[item] or (last == self.score[item] and last_id < self.last_id[item]):
                self.score[item], self.last_id[item] = last, last_id


def _search(index: DataFrame, block: list[tuple[int, dict[int, int]]], corpus: _Corpus, k: int) -> DataFrame:
    """``item`` (its number in the block), ``doc_id``, ``score``: the k best and perhaps a few more."""
    spark = index.sparkSession
    schema = "item int, doc_id bigint, score bigint"
    planted = _item_tree(block, corpus)
    if planted is None:
        return spark.createDataFrame([], schema)
    tree, names = planted
    arrow = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def candidates(segments: DataFrame, score: np.ndarray, last_id: np.ndarray) -> DataFrame:
        shared = spark.sparkContext.broadcast((tree, names, corpus, score, last_id))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree, names, corpus, score, last_id = shared.value
            for batch in batches:
                for row in batch.to_pylist():
                    part = _Segment(row, corpus, k)
                    rows = [
                        {"item": names[i], "doc_id": part.doc_ids[part.order[p]], "score": int(s)}
                        for i, (scores, places) in part.search(tree, score, last_id).items()
                        for s, p in zip(scores, places)
                    ]
                    yield pa.RecordBatch.from_pylist(rows, arrow)

        return segments.mapInArrow(run, schema)

    score, last_id = np.zeros(len(names), dtype=np.int64), np.full(len(names), _NO_ID, dtype=np.int64)
    if index.count() < 2 * FIRST_ROUND:
        return candidates(index, score, last_id)
    early = F.pmod(F.xxhash64("doc_ids", "lengths"), F.lit(FIRST_ROUND)) == 0
    first = materialize(candidates(index.filter(early), score, last_id), "lexical-first")
    position = {name: i for i, name in enumerate(names)}
    for r in _ranked(first, k).filter(F.col("rank") == k).collect():
        i = position[r["item"]]
        score[i], last_id[i] = r["score"], _NO_ID if r["doc_id"] is None else r["doc_id"]
    return first.unionByName(candidates(index.filter(~early), score, last_id))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_documents(
    docs: DataFrame,
    items: DataFrame,
    k: int = BEST,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
    vocabulary_bytes: int = VOCABULARY_BYTES,
) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score`` of the k best documents of every item with a score above 0."""
    spark = docs.sparkSession
    asked = items.select(F.col(f"`{item_id}`").cast("long").alias("item_id"), known(f"`{item_text}`").alias("text"))
    asked = asked.withColumn("text_key", F.sha2("text", 256))
    # Rows of one text become one before they reach a task or the driver.
    texts = materialize(asked.groupBy("text_key").agg(F.first("text").alias("text")), "item-texts")
    size = texts.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n_blocks = max(1, -(-size // block_bytes))
    blocks = [texts.filter(F.pmod(F.xxhash64("text_key"), F.lit(n_blocks)) == b) for b in range(n_blocks)]

    terms = materialize(_distinct_terms(texts.select("text")), "item-terms")
    common = None
    if (terms.agg(F.sum(F.octet_length("term") + 8)).first()[0] or 0) <= vocabulary_bytes:
        common = sorted(terms.toArrow()["term"].to_pylist())

    results, index = None, None
    for block in blocks:
        rows = [(r["text_key"], Counter(terms_of(r["text"].encode()))) for r in block.collect()]
        if index is None or common is None:
            vocabulary = common if common is not None else sorted({t for _, own in rows for t in own})
            number = {t: i for i, t in enumerate(vocabulary)}
            index = _index(docs, doc_id, text, vocabulary)
            total = index.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()
            corpus = _Corpus(total["n"] or 0, total["l"] or 0, _document_counts(index))
        numbered = [(i, {number[t]: n for t, n in own.items()}) for i, (_, own) in enumerate(rows)]
        found = materialize(_ranked(_search(index, numbered, corpus, k), k), "lexical-results")
        keys = spark.createDataFrame([(i, key) for i, (key, _) in enumerate(rows)], "item int, text_key string")
        # At most one row per text of the block, whose size is bounded.
        found = found.join(F.broadcast(keys), "item").select("text_key", "rank", "doc_id", "score")
        results = found if results is None else results.unionByName(found)
    return asked.select("item_id", "text_key").join(results, "text_key").select("item_id", "rank", "doc_id", "score")


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
size AS (SELECT CAST(count(*) AS BIGINT) AS total, CAST(sum(len(w)) AS BIGINT) AS length FROM d WHERE len(w) > 0),
tf AS (SELECT r, t, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY r, t),
q AS (SELECT i, item_id, t, count(*) AS q FROM (SELECT row_number() OVER () AS i, item_id, unnest({_TERMS}) AS t FROM benchmark) GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * total + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS weight
  FROM tf, size WHERE t IN (SELECT t FROM q) GROUP BY t, total),
m AS (SELECT r, doc_id, 25 + (75 * CAST(len(w) AS BIGINT) * total) // length AS m FROM d, size),
s AS (SELECT i, item_id, r, doc_id, CAST(sum(q * weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM q JOIN w USING (t) JOIN tf USING (t) JOIN m USING (r) GROUP BY i, item_id, r, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= {BEST}"""
