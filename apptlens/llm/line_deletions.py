"""Lines repeated across the corpus, exactly or with one word changed.

A line's deletion neighbourhood is the line and the line without each one of
its words. Lines within one word edit of each other share a variant: after a
substitution both lack the same place, after an insertion one is a variant of
the other. Variants are hashed and joined with equal ones; in each group only
the earliest line matters, so groups of any size are reduced by minima, never
by pairs. A line goes if an earlier line equals it or lies within the edit.

Only lines that share the first or the last half of their words with another
line can lie within one edit of it; only these emit variants. Lines of fewer
than ``EDIT_WORDS`` words are compared exactly.

Defined cases: null text has no lines and stays null; lines without a word stay
as they are; rows that share an id are one document, whose lines at one place
do not remove each other; a null id comes after all others; an empty table
gives an empty result; other columns are returned as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apptlens.llm.common import SPACE, WORD, known
from apptlens.session import materialize

EDIT_WORDS = 8
# Lines to be checked for edits that are sent to the texts; for more, the lines are shuffled.
BROADCAST_ROWS = 1 << 19


def _split(text: Column) -> Column:
    return F.split(known(text), "\n", -1)


def line_table(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Every line with a word: its key, its place in the corpus order, the document's text key."""
    body = F.col(f"`{text}`")
    order = F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit((1 << 63) - 1))
    return (
        docs.select(order.alias("doc"), F.xxhash64(known(body)).alias("text_key"), F.posexplode(_split(body)).alias("line_no", "line"))
        .filter(F.col("line").rlike(WORD))
        .select(F.xxhash64("line").alias("line_key"), F.struct("doc", "line_no").alias("at"), "text_key", "line")
    )


def _hashed_words() -> Column:
    words = F.filter(F.split("line", SPACE, -1), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w)).alias("w")


def _halves() -> Column:
    """Keys of the halves of which lines within one word edit share one.

    Of two such lines, the longer of M words, either the first or the last
    floor(M / 2) words are the same.
    """
    n = F.size("w")
    keys = [
        F.xxhash64(m, F.lit(side), part)
        for m in (n, n + 1)
        for side, part in (
            ("first", F.slice("w", 1, (m / 2).cast("int"))),
            ("last", F.slice("w", n - (m / 2).cast("int") + 1, (m / 2).cast("int"))),
        )
    ]
    return F.when(n >= EDIT_WORDS, F.array(*keys))


def _variants() -> Column:
    """The line (place 0) and the line without the word at each place, hashed."""
    n = F.size("w")
    without = lambda i: F.concat(F.slice("w", 1, F.greatest(i - 1, F.lit(0))), F.slice("w", i + 1, n))
    return F.transform(
        F.sequence(F.lit(0), n),
        lambda i: F.struct(i.alias("place"), F.xxhash64(F.when(i == 0, F.col("w")).otherwise(without(i))).alias("variant")),
    )


def near_lines(lines: DataFrame, first: DataFrame) -> DataFrame:
    """Keys of distinct lines that have an earlier line within one word edit.

    ``first`` has a row per distinct line: key, earliest place, halves.
    """
    keys = first.filter("halves is not null").select("line_key", F.explode("halves").alias("half"))
    shared = (
        keys.groupBy("half")
        .agg(F.min("line_key").alias("low"), F.max("line_key").alias("high"))
        .filter("low <> high")
        .select("half")
    )
    near_keys = keys.join(shared, "half", "left_semi").select("line_key").distinct()
    close = materialize(first.select("line_key", "at").join(near_keys, "line_key", "left_semi"), "close-lines")
    few = F.broadcast(close) if close.count() <= BROADCAST_ROWS else close
    variants = (
        lines.join(few, ["line_key", "at"], "left_semi")
        .dropDuplicates(["line_key"])
        .select("line_key", _hashed_words())
        .select("line_key", F.explode(_variants()).alias("v"))
        .select("line_key", "v.place", "v.variant")
    )
    variants = materialize(variants, "line-variants")
    several = variants.groupBy("variant").agg(F.min("line_key").alias("low"), F.max("line_key").alias("high"))
    several = several.filter("low <> high").select("variant")
    equal = materialize(variants.join(several, "variant", "left_semi").join(close, "line_key"), "equal-variants")
    # Equal variants: same place is a substitution, whole against shortened an
    # insertion. The earliest of each kind decides, combined before the shuffle.
    least = equal.groupBy("variant", "place").agg(F.min("at").alias("least"))
    kinds = equal.groupBy("variant").agg(
        F.min(F.when(F.col("place") == 0, F.col("at"))).alias("whole"),
        F.min(F.when(F.col("place") > 0, F.col("at"))).alias("shortened"),
    )
    earlier = F.when(F.col("place") == 0, F.col("shortened")).otherwise(F.least("whole", "least"))
    judged = equal.join(least, ["variant", "place"]).join(kinds, "variant")
    return judged.filter(earlier < F.col("at")).select("line_key").distinct()


def removed_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document with such lines: the numbers of the lines that go."""
    lines = line_table(docs, doc_id, text)
    places = lines.select("line_key", "at", "text_key", _hashed_words())
    places = materialize(places.select("line_key", "at", "text_key", _halves().alias("halves")), "lines")
    first = places.groupBy("line_key").agg(
        F.min("at").alias("at"), F.first("halves").alias("halves"), F.count(F.lit(1)).alias("n")
    )
    first = materialize(first, "distinct-lines")
    near = near_lines(lines, first).withColumn("near", F.lit(True))
    verdict = first.select("line_key", F.col("at").alias("first_at"), "n").join(near, "line_key", "left").filter("n > 1 OR near")
    return (
        places.select("line_key", "at", "text_key")
        .join(verdict, "line_key")
        .filter(F.col("near").isNotNull() | (F.col("at") > F.col("first_at")))
        .groupBy(F.struct("at.doc", "text_key").alias("key"))
        .agg(F.collect_set("at.line_no").alias("gone"))
    )


def without_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows with their columns, the text without the lines that go, and ``__l_gone``, their number."""
    body = F.col(f"`{text}`")
    gone = materialize(removed_lines(docs, doc_id, text), "removed-lines").select(F.col("key").alias("__l_key"), F.col("gone").alias("__l_places"))
    order = F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit((1 << 63) - 1))
    mine = F.struct(order.alias("doc"), F.xxhash64(known(body)).alias("text_key"))
    # Names of the documents do not mix with those of the verdict.
    names = [f"__l_{i}" for i in range(len(docs.columns))]
    rows = docs.select(mine.alias("__l_mine"), *[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)])
    rows = rows.join(gone, F.col("__l_mine").eqNullSafe(F.col("__l_key")), "left")
    body = F.col(names[docs.columns.index(text)])
    left = F.array_join(F.filter(_split(body), lambda line, i: ~F.array_contains("__l_places", i)), "\n")
    kept = F.when(F.col("__l_places").isNull(), body).otherwise(left)
    rows = rows.select(*names, kept.alias("__l_text"), F.coalesce(F.size("__l_places"), F.lit(0)).cast("long").alias("__l_gone"))
    columns = [F.col(n).alias(c) for c, n in zip(docs.columns, names) if c != text]
    return rows.select(*columns, F.col("__l_text").alias(text), "__l_gone")


def report(docs: DataFrame) -> DataFrame:
    """Every document's text without repeated lines."""
    rows = without_repeated_lines(docs.select("doc_id", "text"))
    return rows.select(
        "doc_id", F.col("__l_gone").alias("n_removed"), F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256")
    )


def dedupe_documents(docs: DataFrame) -> DataFrame:
    """Documents with their text reduced and ``n_chars`` brought up to date; those left without a word go."""
    rows = without_repeated_lines(docs)
    rows = rows.filter((F.col("__l_gone") == 0) | F.col("text").rlike(WORD))
    return rows.withColumn("n_chars", F.when(F.col("__l_gone") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(
        *[F.col(f"`{c}`") for c in docs.columns]
    )


ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, i, ls[i] AS line, regexp_extract_all(ls[i], '[^\x20\x09-\x0D]+') AS w
  FROM (SELECT r, doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d) WHERE regexp_matches(ls[i], '[^\x20\x09-\x0D]')),
o AS (SELECT *, row_number() OVER (ORDER BY doc_id, i) AS pos FROM l),
f AS (SELECT line, min(pos) AS pos, any_value(w) AS w FROM o GROUP BY line),
v AS (SELECT line, pos, p, list_aggregate(CASE WHEN p = 0 THEN w ELSE list_concat(w[1:p - 1], w[p + 1:]) END, 'string_agg', ' ') AS k
  FROM (SELECT line, pos, w, unnest(range(0, len(w) + 1)) AS p FROM f WHERE len(w) >= {EDIT_WORDS})),
near AS (SELECT DISTINCT a.line FROM v a JOIN v b ON a.k = b.k AND b.pos < a.pos AND (a.p = b.p OR (a.p = 0) <> (b.p = 0))),
gone AS (SELECT r, i FROM o JOIN f USING (line) WHERE o.pos > f.pos OR line IN (SELECT line FROM near)),
left_over AS (SELECT r, doc_id, text, ls, i, EXISTS (SELECT 1 FROM gone g WHERE g.r = x.r AND g.i = x.i) AS g
  FROM (SELECT r, doc_id, text, ls, unnest(range(1, len(ls) + 1)) AS i FROM d) x),
kept AS (SELECT r, any_value(doc_id) AS doc_id, any_value(text) AS text, CAST(count(*) FILTER (g) AS BIGINT) AS n_removed,
    coalesce(string_agg(ls[i], chr(10) ORDER BY i) FILTER (NOT g), '') AS t FROM left_over GROUP BY r)
SELECT doc_id, n_removed, CAST(length(t) AS BIGINT) AS kept_chars, sha256(t) AS kept_sha256 FROM kept"""
