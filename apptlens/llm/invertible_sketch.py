"""Document fingerprints as invertible Bloom lookup sketches.

A text is cut into paragraphs: lines, cut again after sentence ends and at 160
characters, so that all characters belong to one. Each paragraph's 64-bit
digest is added to one cell in each of three tables. A cell sums counts,
digests (in two halves) and 32-bit checks. Sketches of two versions subtract
cell by cell, what both hold cancels, and peeling recovers the rest: a cell
whose sums agree with one digest gives that digest, which is then taken out of
its other cells. Counts may exceed one, so repeated paragraphs are exact too.

The fingerprint is the sketch of 24 cells. Two fingerprints are subtracted and
peeled within their row. Where that fails, the pair is sketched again with
cells for all its paragraphs, then with twice as many and other hashes, until
every pair is empty after peeling. Likeness is the share of paragraphs that
two versions have in common, 2 * common / (all of both).

Larger sketches are rows (pair, cell), placed by pair once: all steps of
peeling are aggregations inside the task. A step peels one table, in which a
digest has one cell only, so that nothing is taken out twice.

Which document is the next one needs the order of the whole table: documents
are cut into ranges by a bounded sample of keys, and the first of each range
also goes to the end of the range before. Texts are shuffled once.

Defined cases: null text is empty; an empty text has no paragraphs, and two
such texts have likeness 1; documents without id come after all others;
documents that agree in id follow each other by a hash of the text, so equal
rows follow each other and the last of them meets the next document; a lone
document is its own next; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apptlens.llm.common import known
from apptlens.session import materialize

# Cells of the fingerprint in each of the three tables, and in a larger sketch per paragraph of both versions.
TABLES = 3
CELLS = 8
SPARE = 0.7
ROUNDS = 4

PARAGRAPH = r"[^.!?\n]{1,160}[.!?\n]*|[.!?\n]+"
# Text of one range, ranges at most, sampled keys per range.
RANGE_BYTES = 4 << 20
MAX_RANGES = 16_384
SAMPLE = 20
# Documents that are sketched in one task together, paragraphs of a task (a cell takes about 100 bytes), tasks at most.
BLOCK = 128
TASK_DIGESTS = 200_000
MAX_TASKS = 200_000
# Rows that agree in id and text, above which they travel as one row with a count.
HOT_ROWS = 100_000

_LOW = 4294967295
_SUMS = ("n", "lo", "hi", "chk")


def digests(text: Column) -> Column:
    """The 64-bit digests of a text's paragraphs, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), lambda p: F.xxhash64(p))


def _place(lo: str, hi: str, table: int | str, size: int | str, seed: int = 0) -> str:
    return f"pmod(xxhash64({lo}, {hi}, {table}, {seed}), {size})"


def _check(lo: str, hi: str) -> str:
    return f"(xxhash64({lo}, {hi}) & {_LOW})"


def _pure(c: str) -> str:
    """Whether the sums of a cell are those of one digest, some times."""
    return (
        f"({c}n <> 0 AND {c}lo % {c}n = 0 AND {c}hi % {c}n = 0"
        f" AND {c}chk = {c}n * {_check(f'({c}lo div {c}n)', f'({c}hi div {c}n)')})"
    )


def _entries(own: str) -> Column:
    """Digests with their halves, checks and places in the three tables."""
    places = ", ".join(f"'p{t}', {_place('e.lo', 'e.hi', t, CELLS)}" for t in range(TABLES))
    halves = f"transform({own}, d -> named_struct('lo', d & {_LOW}, 'hi', shiftrightunsigned(d, 32)))"
    return F.expr(f"transform({halves}, e -> named_struct('lo', e.lo, 'hi', e.hi, 'chk', {_check('e.lo', 'e.hi')}, {places}))")


def _cells(entries: str) -> Column:
    """The 24 cells of a text: table by table."""
    zero = "named_struct('n', 0L, 'lo', 0L, 'hi', 0L, 'chk', 0L)"
    add = "(a, e) -> named_struct('n', a.n + 1L, 'lo', a.lo + e.lo, 'hi', a.hi + e.hi, 'chk', a.chk + e.chk)"
    tables = [
        f"transform(sequence(0, {CELLS - 1}), c -> aggregate(filter({entries}, x -> x.p{t} = c), {zero}, {add}))" for t in range(TABLES)
    ]
    return F.expr(f"concat({', '.join(tables)})")


def _fingerprint(cells: str) -> Column:
    """The cells as text: count, halves and check in hexadecimal; an empty cell is empty."""
    one = "concat_ws('.', hex(c.n), hex(c.lo), hex(c.hi), hex(c.chk))"
    return F.expr(f"array_join(transform({cells}, c -> CASE WHEN c.n = 0 THEN '' ELSE {one} END), ',')")


def _subtract(one: str, two: str) -> Column:
    parts = ", ".join(f"'{s}', a.{s} - b.{s}" for s in _SUMS)
    return F.expr(f"zip_with({one}, {two}, (a, b) -> named_struct({parts}))")


def _peel_row(cells: str) -> Column:
    """How many paragraphs peeling recovers from 24 subtracted cells; null where some remain."""
    pure = f"filter(slice(s.cells, {CELLS} * (i % {TABLES}) + 1, {CELLS}), c -> {_pure('c.')})"
    digest = "named_struct('n', c.n, 'lo', c.lo div c.n, 'hi', c.hi div c.n)"
    place = f"pmod(xxhash64(p.lo, p.hi, cast(k div {CELLS} as int), 0), {CELLS})"
    less = f"named_struct('n', a.n - p.n, 'lo', a.lo - p.n * p.lo, 'hi', a.hi - p.n * p.hi, 'chk', a.chk - p.n * {_check('p.lo', 'p.hi')})"
    taken = f"transform(s.cells, (c, k) -> aggregate(filter(s.found, p -> {place} = k % {CELLS}), c, (a, p) -> {less}))"
    # Each round first lists the digests of one table's pure cells, then takes them out everywhere.
    find = f"named_struct('cells', s.cells, 'found', transform({pure}, c -> {digest}), 'n', s.n)"
    take = f"named_struct('cells', {taken}, 'found', s.found, 'n', aggregate(s.found, s.n, (m, p) -> m + abs(p.n)))"
    start = f"named_struct('cells', {cells}, 'found', array_repeat(named_struct('n', 0L, 'lo', 0L, 'hi', 0L), 0), 'n', 0L)"
    step = f"aggregate(array(0), {find}, (s, z) -> {take})"
    empty = "forall(s.cells, c -> c.n = 0 AND c.lo = 0 AND c.hi = 0 AND c.chk = 0)"
    walk = f"aggregate(sequence(0, {ROUNDS * TABLES - 1}), {start}, (s, i) -> {step}, s -> CASE WHEN {empty} THEN s.n END)"
    return F.expr(f"CASE WHEN forall({cells}, c -> c.n = 0 AND c.lo = 0 AND c.hi = 0) THEN 0L WHEN exists({cells}, c -> {_pure('c.')}) THEN {walk} END")


def _sums(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(*[F.sum(s).alias(s) for s in _SUMS])


def recover(entries: DataFrame, pair: list[str], seed: int, listed: bool = False) -> DataFrame:
    """Sketch, subtract and peel pairs of versions: the paragraphs in which they differ.

    ``entries`` has the columns ``pair``, ``size`` (cells per table, the same on
    all rows of a pair), ``sign`` (1 or -1 by version) and ``digest``, and must
    be partitioned by columns among ``pair``. Per pair: ``differing`` (how many
    paragraphs), ``left`` (sums that no peeling explains; the pair failed unless
    it is 0), and with ``listed`` the digests only the first (``gone``) or the
    second version (``come``) has.
    """
    halves = entries.select(*pair, "size", F.col("sign").alias("n"), F.expr(f"digest & {_LOW}").alias("__l"), F.expr("shiftrightunsigned(digest, 32)").alias("__h"))
    places = F.array(*[F.expr(f"{t}L * size + {_place('__l', '__h', t, 'size', seed)}") for t in range(TABLES)])
    rows = halves.select(
        *pair, "size", F.explode(places).alias("cell"), F.lit(0).cast("long").alias("key"), "n",
        (F.col("n") * F.col("__l")).alias("lo"), (F.col("n") * F.col("__h")).alias("hi"), F.expr(f"n * {_check('__l', '__h')}").alias("chk"),
    )
    by = [*pair, "size", "cell", "key"]
    alive = " OR ".join(f"{s} <> 0" for s in _SUMS)
    cells = _sums(rows, by).filter(alive)
    for _ in range(ROUNDS):
        for table in range(TABLES):
            others = [t for t in range(TABLES) if t != table]
            key = "shiftleft(hi div n, 32) | (lo div n)" if listed else "0L"
            # A recovered digest becomes a row of cell -1, with its count as n and the count's size as lo.
            found = f"named_struct('cell', -1L, 'key', {key}, 'n', n, 'lo', abs(n), 'hi', 0L, 'chk', 0L)"
            taken = [
                f"named_struct('cell', {t}L * size + {_place('(lo div n)', '(hi div n)', t, 'size', seed)}, 'key', 0L, 'n', -n, 'lo', -lo, 'hi', -hi, 'chk', -chk)"
                for t in others
            ]
            itself = "named_struct('cell', cell, 'key', key, 'n', n, 'lo', lo, 'hi', hi, 'chk', chk)"
            peeled = f"CASE WHEN cell >= 0 AND cell div size = {table} AND {_pure('')} THEN array({found}, {', '.join(taken)}) ELSE array({itself}) END"
            cells = cells.select(*pair, "size", F.expr(f"inline({peeled})"))
            cells = _sums(cells, by).filter(alive)
    out = [
        F.coalesce(F.sum(F.when(F.col("cell") < 0, F.col("lo"))), F.lit(0)).alias("differing"),
        F.count_if(F.col("cell") >= 0).alias("left"),
    ]
    if listed:
        for name, sign in (("gone", 1), ("come", -1)):
            mine = (F.col("cell") < 0) & (F.col("n") * sign > 0)
            times = F.expr("array_repeat(key, cast(abs(n) as int))")
            out.append(F.array_sort(F.flatten(F.collect_list(F.when(mine, times)))).alias(name))
    return cells.groupBy(*pair).agg(*out)


def _larger(paragraphs: Column, attempt: int) -> Column:
    """Cells per table of a sketch for that many paragraphs."""
    return (F.ceil(paragraphs * SPARE * 2**attempt) + CELLS).cast("long")


def changes(old: DataFrame, new: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Digests of the paragraphs that documents lost (``gone``) and got (``come``) between two versions.

    Ids must identify rows; a document missing on one side counts as empty
    there, and so does null text. Documents that did not change are left out.
    """
    sides = [
        t.select(F.col(f"`{doc_id}`").alias("pair"), F.lit(s).alias("sign"), digests(known(f"`{text}`")).alias("own"))
        for t, s in ((old, 1), (new, -1))
    ]
    rows = materialize(sides[0].unionByName(sides[1]), "version-digests")
    sizes = rows.groupBy("pair").agg(F.sum(F.size("own")).alias("m"), F.count(F.lit(1)).alias("rows"))
    open_pairs = sizes.select("pair", F.lit(CELLS).cast("long").alias("size"), "m")
    done, attempt = None, 0
    while True:
        # The join places the pairs; all that follows stays there.
        entries = rows.join(open_pairs.hint("shuffle_hash"), "pair").select("pair", "size", "sign", F.explode("own").alias("digest"))
        tried = materialize(recover(entries, ["pair"], attempt, listed=True), "version-changes")
        won = tried.filter("left = 0").select("pair", "gone", "come")
        done = won if done is None else done.unionByName(won)
        lost = tried.filter("left > 0").select("pair")
        if lost.isEmpty():
            return done.withColumnRenamed("pair", "doc_id")
        attempt += 1
        open_pairs = sizes.join(lost, "pair").select("pair", _larger(F.col("m"), attempt - 1).alias("size"), "m")


def _ranges(rows: DataFrame) -> tuple[DataFrame, list, object]:
    """Rows with their ``weight``; the keys at which ranges begin, and the least key.

    Equal rows above ``HOT_ROWS`` become two: one that stands for all but the
    last of them, and the last.
    """
    pairs = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("size"))
    pairs = materialize(pairs, "document-keys")
    total = pairs.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.min("key").alias("least"), F.max("n").alias("most")).first()
    if total["most"] is not None and total["most"] >= HOT_ROWS:
        # At most one row per HOT_ROWS rows of the table.
        hot = F.broadcast(pairs.filter(F.col("n") >= HOT_ROWS).select("key"))
        twice = rows.join(hot, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("n"))
        split = F.array(F.struct(F.lit(0).alias("ordinal"), (F.col("n") - 1).alias("weight")), F.struct(F.lit(1).alias("ordinal"), F.lit(1).cast("long").alias("weight")))
        twice = twice.select("key", "text", F.inline(split))
        once = rows.join(hot, "key", "left_anti").select("key", "text", F.lit(0).alias("ordinal"), F.lit(1).cast("long").alias("weight"))
        rows = once.unionByName(twice)
    else:
        rows = rows.select("key", "text", F.lit(0).alias("ordinal"), F.lit(1).cast("long").alias("weight"))
    ranges = min(MAX_RANGES, -(-(total["size"] or 0) // RANGE_BYTES))
    cuts = []
    if ranges > 1:
        space = 1 << 40
        share = min(1.0, SAMPLE * ranges / total["n"])
        picked = pairs.filter(F.pmod(F.xxhash64("key"), F.lit(space)) < int(share * space)).select("key").collect()
        # Bounded: SAMPLE keys per range are expected.
        keys = sorted(tuple(r["key"]) for r in picked)
        step = max(1, len(keys) // ranges)
        cuts = [k for k in keys[step::step] if k > tuple(total["least"])]
    return rows, cuts, total["least"]


def _in_order(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Documents with digests and edited texts, numbered within ranges (``r``, ``at``), stored.

    The first document of a range also stands at the end of the range before, as ``guest``.
    """
    spark = docs.sparkSession
    number = F.col(f"`{doc_id}`").cast("long")
    # Ascending keys are descending ids; complements do not overflow.
    key = F.struct(
        number.isNull().alias("missing"), F.coalesce(F.bitwise_not(number), F.lit(0)).cast("long").alias("down"), F.xxhash64(known(f"`{text}`")).alias("hash")
    )
    rows, cuts, least = _ranges(docs.select(key.alias("key"), known(f"`{text}`").alias("text")))
    kind = "struct<missing:boolean,down:bigint,hash:bigint>"
    table = spark.createDataFrame([(cuts, least)], f"cuts array<{kind}>, least {kind}")
    rows = rows.select("*", table.select("cuts").scalar().alias("cuts"), table.select("least").scalar().alias("first_key"))
    steps = [1 << b for b in reversed(range(len(cuts).bit_length()))] or [1]
    r = F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, s: at + F.when(F.get("cuts", at + s - 1) <= F.col("key"), s).otherwise(0),
    )
    rows = rows.withColumn("r", r)
    stays = F.struct("r", F.lit(False).alias("guest"))
    visits = F.when(F.get("cuts", F.col("r") - 1) == F.col("key"), F.struct((F.col("r") - 1).alias("r"), F.lit(True).alias("guest")))
    wraps = F.when(F.col("key") == F.col("first_key"), F.struct(F.lit(len(cuts)).alias("r"), F.lit(True).alias("guest")))
    placed = rows.select("key", "text", "ordinal", "weight", F.inline(F.filter(F.array(stays, visits, wraps), lambda s: s.isNotNull())))
    placed = placed.repartition("r").withColumn("own", digests(F.col("text")))
    placed = placed.withColumn("entries", _entries("own")).withColumn("cells", _cells("entries")).drop("entries")
    order = Window.partitionBy("r").orderBy("guest", "key", "text", "ordinal")
    follows = [F.lead(c).over(order).alias(f"next_{c}") for c in ("text", "cells")]
    sizes = [F.lead(F.size("own")).over(order).alias("next_size"), F.lag(F.size("own"), 1, 0).over(order).alias("before_size")]
    rows = placed.select("*", *follows, *sizes, F.row_number().over(order).alias("at"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left("text", n - half), F.left("next_text", half))
    rows = rows.withColumns({"n_chars": n.cast("long"), "edited": edited}).drop("text", "next_text")
    rows = rows.withColumns({"edited_own": digests(F.col("edited")), "edited_sha256": F.sha2("edited", 256)}).drop("edited")
    rows = rows.withColumn("entries", _entries("edited_own")).withColumn("edited_cells", _cells("entries")).drop("entries")
    rows = rows.withColumns({"off_edited": _subtract("cells", "edited_cells"), "off_next": _subtract("cells", "next_cells")})
    rows = rows.withColumns({f"differ_{c}": F.when(~F.col("guest"), _peel_row(f"off_{c}")) for c in ("edited", "next")})
    # What a document sends to the one before it is needed only where that one's peeling failed.
    wanted = F.lag(F.col("differ_next").isNull() & ~F.col("guest"), 1, False).over(Window.partitionBy("r").orderBy("at")).alias("asked")
    columns = ["r", "at", "guest", "weight", "key", "n_chars", "edited_sha256", "own", "edited_own", "next_size", "before_size", "differ_edited", "differ_next"]
    return materialize(rows.select(*columns, wanted), "ordered-documents")


def _entries_of_open(rows: DataFrame, attempt: int, tasks: int) -> DataFrame:
    """Signed digests of the pairs that are still open, placed by blocks of documents in that many tasks."""
    def role(at: Column, main: Column, sends: Column) -> Column:
        return F.struct(F.floor(at / BLOCK).cast("int").alias("block"), main.alias("main"), sends.alias("sends"))

    # A document is needed in its own block, and in that of the one before it.
    apart = F.col("at") % BLOCK == 0
    own = role(F.col("at"), F.lit(True), F.col("asked") & ~apart)
    before = F.when(F.col("asked") & apart, role(F.col("at") - 1, F.lit(False), F.lit(True)))
    roles = F.array(own, before)
    mine = rows.select(
        "*", F.inline(F.filter(roles, lambda s: s.isNotNull()))
    ).select(
        "r", "at", "block", "own", "edited_own", "sends",
        (F.col("main") & ~F.col("guest") & F.col("differ_edited").isNull()).alias("e"),
        (F.col("main") & ~F.col("guest") & F.col("differ_next").isNull()).alias("x"),
        F.size("own").alias("n_own"), F.size("edited_own").alias("n_edited"), "next_size", "before_size",
    ).filter("e OR x OR sends")
    mine = mine.repartition(tasks, "r", "block")
    edited, following = _larger(F.col("n_own") + F.col("n_edited"), attempt), _larger(F.col("n_own") + F.col("next_size"), attempt)
    earlier = _larger(F.col("before_size") + F.col("n_own"), attempt)

    def side(flag: str, at: Column, kind: str, size: Column, sign: int, own: str) -> Column:
        return F.when(F.col(flag), F.struct(at.alias("at"), F.lit(kind).alias("kind"), size.alias("size"), F.lit(sign).cast("long").alias("sign"), F.col(own).alias("own")))

    sides = F.array(
        side("e", F.col("at"), "edited", edited, 1, "own"),
        side("e", F.col("at"), "edited", edited, -1, "edited_own"),
        side("x", F.col("at"), "next", following, 1, "own"),
        side("sends", F.col("at") - 1, "next", earlier, -1, "own"),
    )
    sided = mine.select("r", "block", F.inline(F.filter(sides, lambda s: s.isNotNull())))
    return sided.select("r", "block", "at", "kind", "size", "sign", F.explode("own").alias("digest"))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document its fingerprint, that of its edited text, and their likeness; likewise to the next document.

    The edited text has the last half of its characters (rounded down) replaced
    by the first as many of the next document by descending id.
    """
    rows = _in_order(docs, doc_id, text)
    pair = ["r", "block", "at", "kind"]
    total = rows.agg(F.sum(F.size("own") + F.size("edited_own"))).first()[0] or 0
    tasks = min(MAX_TASKS, 1 + total // TASK_DIGESTS)
    found, attempt, tried = None, 0, rows
    while True:
        got = materialize(recover(_entries_of_open(tried, attempt, tasks), pair, attempt + 1), "recovered")
        won = got.filter("left = 0").select("r", "at", "kind", "differing")
        found = won if found is None else found.unionByName(won)
        lost = got.filter("left > 0")
        if lost.isEmpty():
            break
        attempt += 1
        # Few pairs are left; all others of the table count as answered.
        by = lost.groupBy("r", "at").agg(F.max(F.col("kind") == "edited").alias("lost_e"), F.max(F.col("kind") == "next").alias("lost_x"))
        again = rows.drop("asked", "differ_edited", "differ_next").join(by, ["r", "at"], "left")
        asking = by.filter("lost_x").select("r", (F.col("at") + 1).alias("at"), F.lit(True).alias("asks"))
        answered = lambda c: F.when(F.coalesce(F.col(c), F.lit(False)), F.lit(None)).otherwise(F.lit(0)).cast("long")
        tried = again.join(asking, ["r", "at"], "left").withColumns(
            {"asked": F.coalesce("asks", F.lit(False)), "differ_edited": answered("lost_e"), "differ_next": answered("lost_x")}
        )
    by = found.groupBy("r", "at").agg(
        *[F.max(F.when(F.col("kind") == k, F.col("differing"))).alias(f"found_{k}") for k in ("edited", "next")]
    )
    out = rows.filter(~F.col("guest")).join(by, ["r", "at"], "left")

    def likeness(kind: str, size: Column) -> Column:
        both = (F.size("own") + size).cast("long")
        # Pairs without any differing digest leave no rows after peeling.
        differing = F.coalesce(f"differ_{kind}", f"found_{kind}", F.lit(0))
        return F.when(both == 0, F.lit(1.0)).otherwise((both - differing) / both)

    out = out.withColumns({"near_edited": likeness("edited", F.size("edited_own")), "near_next": likeness("next", F.col("next_size"))})
    for name, own in (("fingerprint", "own"), ("edited_fingerprint", "edited_own")):
        out = out.withColumn("entries", _entries(own)).withColumn("cells", _cells("entries")).withColumn(name, _fingerprint("cells")).drop("entries", "cells")
    out = out.withColumn("copy", F.explode(F.expr("sequence(1L, weight)")))
    number = F.when(~F.col("key.missing"), F.bitwise_not(F.col("key.down")))
    return out.select(
        number.alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"
    )
