"""Documents joined by the Jaccard similarity of their word shingles.

Rows with the same shingle set are one node, named by a 64-bit hash of the
set. Shingles are hashed into groups; the group counts are a node's point, and
the summed minima of two points bound the overlap of the sets from above.

Nodes that can reach the threshold share one of their first shingles in a
common order (rare before frequent), so every such shingle is a bucket; buckets
of mostly the same nodes are united. Rounds of hubs come first: a few nodes of
each bucket and band of sizes are compared with the nodes of the bucket that
they could link to, leave the bucket, and what is then connected with all its
neighbours leaves as well. A round makes as many pairs as there are rows, times
a constant, so a group of near copies costs as many pairs as it has members.
When few pairs are left, or a round settles little, the rest goes through a
tree over the points: leaves of nodes of similar size with the box around them,
pairs of leaves whose boxes allow a link, pairs of nodes whose points allow it.
Surviving pairs are verified on the whole sets, and nodes that are already
connected are not compared. The components are exact: the order of shingles,
the hubs and the unions change the work, never the result.

Defined cases: null text and text without words have the empty set and link to
nothing; fewer words than a shingle are one shingle; repeated rows share a set;
a null id counts after all others; an empty table gives an empty result; other
columns are ignored, or returned by ``distinct_documents``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apptlens.llm.common import known
from apptlens.llm.components import components
from apptlens.session import materialize

SHINGLE = 5
PERCENT = 75
GROUPS = 512
LEAF = 64
# Hubs of a bucket and band in the second round; the first takes one, later
# ones twice as many as the round before, of fewer rows.
HUBS = 8
# Rounds of hubs go on until the pairs left are no more than the rows of the
# first round, or until one leaves more than this share of the rows open; the
# tree compares those.
SHRINK = 0.9

# Nodes to be verified that are sent to the texts; for more, the texts are shuffled.
BROADCAST_ROWS = 1 << 19

# Shingles counted together, and the count there from which one is reported.
COUNTED_SHINGLES = 2 << 20
LEAST_COUNT = 3
# Frequent shingles whose order is lowered, the most frequent first. More of
# them would only save work.
FREQUENT_SHINGLES = 1 << 18

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
# Fixed odd multipliers: one per place in a shingle, one for short texts, one to mix.
_PLACES = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64
)
_SHORTS = np.arange(1, SHINGLE, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def shingles(text: bytes) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.array([xxhash.xxh64_intdigest(w) for w in words], dtype=np.uint64)
    if len(words) < SHINGLE:
        s = (h * _PLACES[: len(h)]).sum(keepdims=True, dtype=np.uint64) + _SHORTS[len(h) - 1 : len(h)]
    else:
        n = len(h) - SHINGLE + 1
        s = h[:n] * _PLACES[0]
        for j in range(1, SHINGLE):
            s = s + h[j : n + j] * _PLACES[j]
    s = (s ^ (s >> np.uint64(33))) * _MIX
    return np.unique(s ^ (s >> np.uint64(29)))


def needed(n: int, percent: int = PERCENT) -> int:
    """Shingles that a set of n must share to reach the threshold."""
    return -(-percent * n // 100)


def point(s: np.ndarray) -> bytes:
    """How many shingles fall into each group, compressed: small counts take a few bits each."""
    counts = np.bincount((s % np.uint64(GROUPS)).astype(np.int64), minlength=GROUPS).clip(max=65535).astype("<u2")
    planes = counts.view(np.uint8).reshape(-1, 2).T
    return zstandard.compress(planes.tobytes(), 1)


def points(packed: list[bytes]) -> np.ndarray:
    """The points, one per row."""
    unpack = zstandard.ZstdDecompressor().decompress
    planes = np.frombuffer(b"".join(map(unpack, packed)), np.uint8).reshape(-1, 2, GROUPS)
    return planes[:, 0].astype(np.uint16) + (planes[:, 1].astype(np.uint16) << np.uint16(8))


# Sets travel as the low bytes of their hashes: 48 bits of each tell the
# shingles of two documents apart.
_KEPT = 6


def pack_set(s: np.ndarray) -> bytes:
    low = np.sort(s & np.uint64((1 << 8 * _KEPT) - 1)).astype("<u8")
    return low.view(np.uint8).reshape(-1, 8)[:, :_KEPT].tobytes()


def unpack_set(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // _KEPT, 8), dtype=np.uint8)
    wide[:, :_KEPT] = np.frombuffer(raw, np.uint8).reshape(-1, _KEPT)
    return wide.view("<u8").ravel()


def _bodies(batch: pa.RecordBatch, column: int) -> Iterator[bytes]:
    for t in batch.column(column):
        yield t.as_buffer().to_pybytes()


def frequent_shingles(texts: DataFrame) -> np.ndarray:
    """Shingles that many documents share, in order of frequency (most last)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def report(parts: list[np.ndarray]) -> pa.RecordBatch:
            s, n = np.unique(np.concatenate(parts), return_counts=True)
            often = n >= LEAST_COUNT
            return pa.RecordBatch.from_arrays([pa.array(s[often].view(np.int64)), pa.array(n[often])], ["shingle", "n"])

        parts, size = [], 0
        for batch in batches:
            for body in _bodies(batch, batch.num_columns - 1):
                parts.append(shingles(body))
                size += len(parts[-1])
                if size >= COUNTED_SHINGLES:
                    yield report(parts)
                    parts, size = [], 0
        if parts:
            yield report(parts)

    counted = texts.mapInArrow(count, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "shingle").limit(FREQUENT_SHINGLES).toPandas()
    return top["shingle"].to_numpy(dtype=np.int64)[::-1].view(np.uint64)


def _nodes(texts: DataFrame, percent: int) -> DataFrame:
    """Per row: size and hash of its set, and once per task and set its first shingles and its point."""
    spark = texts.sparkSession
    frequent = frequent_shingles(texts)
    order = np.argsort(frequent, kind="stable")
    shared = spark.sparkContext.broadcast((frequent[order], order.astype(np.int64) + 1))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_often, place = shared.value
        seen: set[int] = set()
        for batch in batches:
            sizes, names, firsts, packed = [], [], [], []
            for body in _bodies(batch, 2):
                s = shingles(body)
                name = xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63)
                sizes.append(len(s))
                names.append(name)
                if not len(s) or name in seen:
                    firsts.append(None)
                    packed.append(None)
                    continue
                seen.add(name)
                late = np.zeros(len(s), dtype=np.int64)
                if len(known_often):
                    k = np.searchsorted(known_often, s)
                    k[k == len(known_often)] = 0
                    late = np.where(known_often[k] == s, place[k], 0)
                first = s[np.argsort(late, kind="stable")[: len(s) - needed(len(s), percent) + 1]]
                firsts.append(first.view(np.int64))
                packed.append(point(s))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(sizes, pa.int64()),
                    pa.array(names, pa.int64()),
                    pa.array(firsts, pa.list_(pa.int64())),
                    pa.array(packed, pa.binary()),
                ],
                ["doc_id", "text_key", "n", "node", "firsts", "point"],
            )

    schema = "doc_id bigint, text_key bigint, n bigint, node bigint, firsts array<bigint>, point binary"
    return materialize(texts.mapInArrow(describe, schema), "shingle-nodes")


def _allows(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs whose points allow a link."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (points(batch.column(c).to_pylist()) for c in (4, 5))
            total = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            bound = np.minimum(a, b).sum(axis=1, dtype=np.int64)
            yield batch.select([0, 1]).filter(pa.array((100 + percent) * bound >= percent * total))

    return pairs.select("a", "b", "na", "nb", "pa", "pb").mapInArrow(keep, "a bigint, b bigint")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges: the pairs whose sets reach the threshold."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, last, a = [], None, None
            for i in range(batch.num_rows):
                raw = batch.column(2)[i].as_buffer()
                if last is None or not raw.equals(last):
                    last, a = raw, unpack_set(raw)
                b = unpack_set(batch.column(3)[i].as_buffer())
                small, big = (a, b) if len(a) <= len(b) else (b, a)
                k = np.searchsorted(big, small)
                k[k == len(big)] = 0
                common = int((big[k] == small).sum())
                ok.append(100 * common >= percent * (len(a) + len(b) - common))
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "sa", "sb")
    return both.mapInArrow(check, "u bigint, v bigint")


def _sets(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The shingle sets of the wanted nodes, each from one of its rows."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([pack_set(shingles(x)) for x in _bodies(batch, 1)], pa.binary())],
                ["node", "shingles"],
            )

    w = wanted.select("node", F.struct("doc_id", "text_key").alias("key"))
    if wanted.count() <= BROADCAST_ROWS:
        w = F.broadcast(w)
    rows = texts.withColumn("key", F.struct("doc_id", "text_key"))
    found = rows.join(w, rows["key"].eqNullSafe(w["key"])).select("node", "text")
    return materialize(found.mapInArrow(build, "node bigint, shingles binary").dropDuplicates(["node"]), "shingle-sets")


def _named(pairs: DataFrame, candidates: DataFrame) -> DataFrame:
    """The candidates that stand in a pair."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return materialize(candidates.join(ends, "node", "left_semi"), "wanted-nodes")


def _similar_size(one: Column, other: Column, percent: int) -> Column:
    return F.coalesce(F.least(one, other) * 100 >= F.greatest(one, other) * percent, F.lit(False))


def _with_partner(rows: DataFrame, percent: int) -> DataFrame:
    """Rows of nodes whose size allows a link to another node of the bucket.

    In order of size, a node with a partner has one beside it.
    """
    by_size = Window.partitionBy("bucket").orderBy("n", "node")
    sides = [F.lag("n").over(by_size), F.lead("n").over(by_size)]
    return (
        rows.withColumn("sides", F.array(*sides))
        .filter(F.exists("sides", lambda m: _similar_size(F.col("n"), m, percent)))
        .drop("sides")
    )


def _without_equal_buckets(rows: DataFrame) -> DataFrame:
    """One bucket of those with the same nodes, as the shingles of a shared passage have."""
    marks = [F.count(F.lit(1)).alias("c"), *[F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"h{k}") for k in (1, 2)]]
    first = rows.groupBy("bucket").agg(*marks).groupBy("c", "h1", "h2").agg(F.min("bucket").alias("bucket"))
    return rows.join(first.select("bucket"), "bucket", "left_semi")


def _united(rows: DataFrame, turn: int) -> DataFrame:
    """Buckets that hold mostly the same nodes as one, so that their pairs are met once.

    Two minima of hashes of the nodes name the buckets to unite, and a union
    stands if it is not much larger than the largest bucket in it. A union
    holds all pairs of its buckets.
    """
    marks = [F.min(F.xxhash64("node", F.lit(2 * turn + k))).alias(f"h{k}") for k in (0, 1)]
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("c"), *marks)
    classes = sizes.groupBy("h0", "h1").agg(F.min("bucket").alias("into"), F.max("c").alias("most"), F.count(F.lit(1)).alias("k"))
    into = sizes.join(classes.filter("k > 1"), ["h0", "h1"]).select("bucket", "into", "most")
    named = materialize(rows.join(into, "bucket", "left"), "named-buckets")
    united = named.filter("into is not null").dropDuplicates(["into", "node"])
    fit = united.groupBy("into").agg(F.count(F.lit(1)).alias("size"), F.max("most").alias("most")).filter("size <= 2 * most")
    fit = materialize(fit.select("into"), "united-buckets")
    kept = named.join(fit, "into", "left_anti").select(*rows.columns)
    return kept.unionByName(united.join(fit, "into", "left_semi").withColumn("bucket", F.col("into")).select(*rows.columns))


def _banded(rows: DataFrame, percent: int) -> DataFrame:
    """Rows with a band of their size; only nodes of one band or of neighbouring bands can link."""
    # A little wider than the threshold, so that rounding cannot part two linked sizes by two bands.
    width = 1.000001 * math.log(100 / percent)
    return rows.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.lit(width)))


def _near_bands() -> Column:
    return F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band")


def _hubs(rows: DataFrame, turn: int) -> DataFrame:
    """A few nodes of each bucket and band: half of them unlinked if there are any, half by hash alone.

    The first settle what stands alone, the second join parts that have grown apart.
    """
    slot = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(HUBS << turn - 1 if turn else 1))
    late = F.col("linked") & (slot % 2 == 0)
    best = F.min(F.struct(late.alias("late"), F.xxhash64(F.lit(turn), "node").alias("h"), "node", "n", "part")).alias("hub")
    return rows.groupBy("bucket", "band", slot.alias("slot")).agg(best)


def _unsettled(rows: DataFrame) -> DataFrame:
    """Rows with a node of another part among those of their bucket and neighbouring bands."""
    spans = rows.groupBy("bucket", "band").agg(F.min("part").alias("low"), F.max("part").alias("high"))
    spans = spans.select("bucket", _near_bands(), "low", "high")
    mixed = spans.groupBy("bucket", "band").agg(F.min("low").alias("low"), F.max("high").alias("high")).filter("low <> high")
    return rows.join(mixed.select("bucket", "band"), ["bucket", "band"], "left_semi")


def _leaf_pairs(open_rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of unconnected nodes of a bucket that the tree over their points allows."""
    ranked = open_rows.withColumn(
        "leaf", F.floor((F.row_number().over(Window.partitionBy("bucket").orderBy("n", "node")) - 1) / LEAF)
    )
    leaves = ranked.groupBy("bucket", "leaf").agg(
        F.collect_list(F.struct("node", "n", "part", "point")).alias("rows"), F.min("n").alias("least"), F.max("n").alias("most")
    )
    leaves = materialize(leaves, "point-leaves")
    one, two = (leaves.select("bucket", *[F.col(c).alias(f"{c}{k}") for c in ("leaf", "rows", "least", "most")]) for k in "12")
    # Leaves are in order of size. A leaf is its own partner, without a join.
    near = (F.col("leaf1") < F.col("leaf2")) & (F.col("most1") * 100 >= F.col("least2") * percent)
    large = leaves.filter("leaf = 1").select("bucket")
    one = one.join(large, "bucket", "left_semi")
    joined = one.join(two, "bucket").filter(near).select("rows1", "rows2")
    joined = joined.unionByName(leaves.select(F.col("rows").alias("rows1"), F.lit(None).cast(leaves.schema["rows"].dataType).alias("rows2")))

    def arrays(rows: list[dict]) -> tuple[np.ndarray, ...]:
        return (*(np.array([r[c] for r in rows], dtype=np.int64) for c in ("node", "n", "part")), points([r["point"] for r in rows]))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, na, ca, pa_ = arrays(batch.column(0)[i].as_py())
                b, nb, cb, pb_ = arrays(batch.column(1)[i].as_py() or batch.column(0)[i].as_py())
                box = np.minimum(pa_.max(axis=0), pb_.max(axis=0)).sum(dtype=np.int64)
                if (100 + percent) * box < percent * (na.min() + nb.min()):
                    continue
                us, vs = [], []
                for k in range(len(a)):
                    bound = np.minimum(pb_, pa_[k]).sum(axis=1, dtype=np.int64)
                    ok = ((100 + percent) * bound >= percent * (nb + na[k])) & (cb != ca[k])
                    ok &= np.minimum(nb, na[k]) * 100 >= np.maximum(nb, na[k]) * percent
                    us += [int(a[k])] * int(ok.sum())
                    vs += b[ok].tolist()
                low, high = np.minimum(us, vs), np.maximum(us, vs)
                yield pa.RecordBatch.from_arrays([pa.array(low, pa.int64()), pa.array(high, pa.int64())], ["a", "b"])

    return joined.mapInArrow(compare, "a bigint, b bigint").distinct()


def linked(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """Per row: ``doc_id``, ``text_key``, ``n_shingles`` and ``root``, equal for linked rows (null without shingles)."""
    body = known(f"`{text}`")
    texts = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(body).alias("text_key"), body.alias("text"))
    rows = _nodes(texts, percent)
    # Shingles that only one node has among its first are of no use.
    spread = Window.partitionBy("bucket")
    entries = rows.filter(F.col("firsts").isNotNull()).select(F.explode("firsts").alias("bucket"), "node", "n")
    several = (
        entries.withColumns({"least": F.min("node").over(spread), "most": F.max("node").over(spread)})
        .filter("least <> most")
        .dropDuplicates(["bucket", "node"])
        .select("bucket", "node", "n")
    )
    several = materialize(_with_partner(several, percent), "shared-shingles")
    shared = materialize(_united(materialize(_without_equal_buckets(several), "distinct-buckets"), 0), "shared-buckets")
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")
    candidates = (
        rows.filter("n > 0")
        .join(shared.select("node").distinct(), "node", "left_semi")
        .groupBy("node", "n")
        .agg(F.max("point").alias("point"), F.min(first).alias("first"))
        .select("node", "n", "point", "first.doc_id", "first.text_key")
    )
    candidates = materialize(candidates, "candidate-nodes")
    a = candidates.select(F.col("node").alias("a"), F.col("point").alias("pa"))
    b = candidates.select(F.col("node").alias("b"), F.col("point").alias("pb"))

    sets, tested, parts, turn, left, first_rows = None, None, None, 0, None, None
    open_rows = _banded(shared, percent).withColumns({"part": F.col("node"), "linked": F.lit(False)})
    open_rows = materialize(open_rows, "open-buckets")
    while True:
        sizes = open_rows.groupBy("bucket").agg(F.count(F.lit(1)).cast("double").alias("c"))
        now = sizes.agg(F.coalesce(F.sum("c"), F.lit(0.0)).alias("rows"), F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("pairs")).first()
        before, left = left, now["rows"]
        if turn and not left:
            break
        first_rows = left if first_rows is None else first_rows
        last = turn > 0 and (now["pairs"] <= first_rows or left > SHRINK * before)
        if last:
            pairs = _leaf_pairs(open_rows.join(candidates.select("node", "point"), "node"), percent)
        else:
            hubs = materialize(_hubs(open_rows, turn), "hubs")
            near = hubs.select("bucket", _near_bands(), F.struct("hub.node", "hub.n", "hub.part").alias("hub"))
            met = (F.col("part") != F.col("hub.part")) & _similar_size(F.col("n"), F.col("hub.n"), percent)
            stars = open_rows.join(near, ["bucket", "band"]).filter(met)
            one, two = F.struct("hub.node", "hub.n"), F.struct("node", "n")
            stars = stars.select(F.least(one, two).alias("x"), F.greatest(one, two).alias("y"))
            stars = stars.select(*[F.col(c).alias(k) for k, c in {"a": "x.node", "b": "y.node", "na": "x.n", "nb": "y.n"}.items()])
            pairs = _allows(stars.distinct().join(b, "b").join(a, "a"), percent)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "allowed-pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        wanted = _named(pairs, candidates)
        new = wanted if sets is None else wanted.join(sets.select("node"), "node", "left_anti")
        sets = _sets(texts, new) if sets is None else sets.unionByName(_sets(texts, new))
        # Only the sets of this round's pairs are shuffled.
        names = wanted.select("node")
        if wanted.count() <= BROADCAST_ROWS:
            names = F.broadcast(names)
        edges = materialize(_verified(pairs, sets.join(names, "node", "left_semi"), percent), "similar-pairs")
        parts = components(edges if parts is None else parts.unionByName(edges))
        if last:
            break
        turn += 1
        # A hub has been compared with all of its bucket that it can link to.
        # What stays open are the other nodes near a node of another part.
        gone = hubs.select("bucket", F.col("hub.node").alias("node"))
        rest = open_rows.select("bucket", "node", "n", "band").join(gone, ["bucket", "node"], "left_anti")
        names = parts.select(F.col("u").alias("node"), F.col("v").alias("part"), F.lit(True).alias("linked"))
        names = names.unionByName(parts.select(F.col("v").alias("node"), F.col("v").alias("part"), F.lit(True).alias("linked")).distinct())
        rest = rest.join(names, "node", "left").withColumns({"part": F.coalesce("part", "node"), "linked": F.coalesce("linked", F.lit(False))})
        open_rows = materialize(_unsettled(_with_partner(rest, percent)), "open-buckets")
        if turn == 1:
            # The first round settles most rows, after which more buckets agree.
            open_rows = materialize(_united(open_rows, turn), "united-rows")
    root = parts.select(F.col("u").alias("node"), F.col("v").alias("part"))
    return rows.join(root, "node", "left").select(
        "doc_id", "text_key", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("part", "node")).alias("root")
    )


def groups(docs: DataFrame) -> DataFrame:
    """Per document its set size and the smallest id that links reach from it."""
    rows = materialize(linked(docs), "linked-documents")
    least = rows.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    return rows.join(least, "root", "left").select(
        "doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id")
    )


def distinct_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group, the one with the smallest id, with its own columns.

    Rows that agree in id and text are one document.
    """
    rows = linked(docs, doc_id, text).withColumn("key", F.struct(F.col("doc_id").isNull(), "doc_id", "text_key"))
    rows = materialize(rows, "linked-documents")
    kept = rows.filter("root is not null").groupBy("root").agg(F.min("key").alias("kept"))
    dropped = rows.join(kept, "root").filter("key <> kept").select(F.struct("doc_id", "text_key").alias("__dropped")).distinct()
    dropped = materialize(dropped, "dropped-documents")
    if dropped.count() <= BROADCAST_ROWS:
        dropped = F.broadcast(dropped)
    mine: Column = F.struct(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(known(f"`{text}`")).alias("text_key"))
    left = docs.withColumn("__key", mine)
    left = left.join(dropped, F.col("__key").eqNullSafe(F.col("__dropped")), "left_anti")
    # Texts are shuffled only if there are repeated rows.
    if not rows.groupBy("doc_id", "text_key").count().filter("count > 1").isEmpty():
        left = left.dropDuplicates(["__key"])
    return left.drop("__key")
