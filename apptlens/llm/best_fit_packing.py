"""Packing documents into token sequences of fixed length.

Documents are tokenized and end with id 0. Longer ones are cut from the back,
so only a first piece may be short. Full pieces are sequences by themselves.
The rest is planned from the number of pieces of each length, of which there
are fewer than a sequence has tokens: pieces of more than a third of a sequence
are matched, from the longest, with the longest that still fits, two at most
per sequence; shorter ones, from the longest, go where the least room remains.
The plan says which ranks of a length go to which sequences; every piece finds
its place from its rank, so nothing but the counts passes through the driver.

Defined cases: null text is empty, and an empty document is its end id alone;
the string of a special token in a text is that token, as in the tokenizer file;
repeated rows are packed as often as they appear; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apptlens.llm.common import known
from apptlens.operators import prefix
from apptlens.session import materialize

CAPACITY = 2048
END = 0
# White space in a row from which a text is read by the tokenizer file.
BLANK_RUN = 100_000

_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def encoder(tokenizer_path: str, ranks_path: str, pattern: str) -> Callable[[str], list[int]]:
    """The token ids of a text as the tokenizer file gives them, its special tokens included.

    ``tiktoken`` finds the same ids from the file of ranks several times
    faster, but cannot cross very long white space; texts that hold such a run
    are read by the tokenizer file itself.
    """
    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(tokenizer_path)
    special = {t.content: i for i, t in exact.get_added_tokens_decoder().items()}
    ranks = {}
    with open(ranks_path, "rb") as lines:
        for token, rank in map(bytes.split, lines):
            ranks[base64.b64decode(token)] = int(rank)
    fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    long_blank = re.compile(r"\s{%d}" % BLANK_RUN)

    def encode(text: str) -> list[int]:
        if len(text) >= BLANK_RUN and long_blank.search(text):
            return exact.encode(text, add_special_tokens=False).ids
        return fast.encode(text, allowed_special="all")

    return encode


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, end) of the pieces of n ids: all full but perhaps the first."""
    first = n % capacity or capacity
    edges = [0, *range(min(first, n), n + 1, capacity)]
    return list(zip(edges[:-1], edges[1:]))


def pieces(
    docs: DataFrame, doc_id: str, text: str, tokenizer_path: str, ranks_path: str, pattern: str, capacity: int = CAPACITY, ids: bool = False
) -> DataFrame:
    """Every document as pieces; with ``ids`` also the token ids of each."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path, ranks_path, pattern)
        names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * ids
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * ids
        for batch in batches:
            rows = []
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                tokens = np.array([*encode(body.as_py()), END], dtype="<u4")
                for k, (a, b) in enumerate(cuts(len(tokens), capacity)):
                    part = tokens[a:b]
                    rows.append((doc, k, a, b - a, zlib.crc32(part.tobytes())) + ((part.astype(np.int32),) if ids else ()))
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), known(text).alias("text"))
    return rows.mapInArrow(cut, _PIECES + ", ids array<int>" * ids)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Where the pieces of each length go.

    Rows of (length, first rank, per sequence, sequences, first sequence,
    offset): from that rank on, so many pieces go into each of so many
    sequences, one behind the other from the offset.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    ranks = dict.fromkeys(left, 0)
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens -> (first sequence, sequences)
    moves, n_sequences = [], 0

    def place(length: int, per: int, first: int, n: int, offset: int, pieces: int | None = None) -> None:
        moves.append((length, ranks[length], per, n, first, offset))
        used = per * n if pieces is None else pieces
        ranks[length] += used
        left[length] -= used

    def open_sequences(n: int) -> int:
        nonlocal n_sequences
        n_sequences += n
        return n_sequences - n

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for a in large:
        while left[a]:
            fits = next((b for b in large if b <= capacity - a and left[b] and (b != a or left[a] > 1)), None)
            n = left[a] if fits is None else left[a] // 2 if fits == a else min(left[a], left[fits])
            first = open_sequences(n)
            place(a, 1, first, n, 0)
            if fits is not None:
                place(fits, 1, first, n, a)
            room.setdefault(capacity - a - (fits or 0), []).append((first, n))
    for a in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[a]:
            gap = next((g for g in range(a, capacity + 1) if room.get(g)), None)
            if gap is None:
                gap, n = capacity, -(-left[a] // (capacity // a))
                room.setdefault(gap, []).append((open_sequences(n), n))
            first, n = room[gap].pop()
            per = min(gap // a, left[a])
            whole = min(n, left[a] // per)
            place(a, per, first, whole, capacity - gap)
            room.setdefault(gap - per * a, []).append((first, whole))
            if n > whole:
                room[gap].append((first + whole, n - whole))
    return moves


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a ``length``.

    The pieces must be stored: they are read twice.
    """
    columns = parts.columns
    full = parts.filter(F.col("length") == capacity).select(
        *columns, (2 * F.monotonically_increasing_id() + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    rest = parts.filter(F.col("length") < capacity)
    counts = {r["length"]: r["count"] for r in rest.groupBy("length").count().collect()}
    # Ranks by hash: pieces that tie are equal rows, and their order does not matter.
    order = [F.xxhash64(*[F.col(c) for c in columns]), *[F.col(c) for c in columns if c != "length"]]
    ranked = prefix.running_totals(rest, ["length"], order, {"__rank": F.lit(1).cast("long")}, n_rows=sum(counts.values()))
    names = "m_length bigint, m_rank bigint, per bigint, n bigint, first bigint, m_offset bigint"
    moves = parts.sparkSession.createDataFrame(plan(counts, capacity), names)
    # Fewer lengths than tokens in a sequence, so a bounded number of moves.
    at = F.col("__rank") - F.col("m_rank")
    mine = (F.col("length") == F.col("m_length")) & (at >= 0) & (at < F.col("per") * F.col("n"))
    placed = ranked.join(F.broadcast(moves), mine).select(
        *columns,
        (2 * (F.col("first") + F.expr("(__rank - m_rank) div per"))).alias("sequence_id"),
        (F.col("m_offset") + (at % F.col("per")) * F.col("length")).alias("offset"),
    )
    return full.unionByName(placed)


def pack_documents(
    docs: DataFrame, tokenizer_path: str, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """All documents cut and packed."""
    return pack(materialize(pieces(docs, doc_id, text, tokenizer_path, ranks_path, pattern), "token-pieces"))
