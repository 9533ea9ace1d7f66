"""Quality rules whose cutoffs follow the corpus.

Every text gets counts (words, symbols, repeated lines, repeated word windows).
Their ratios go into quantile sketches per language and source: counts per
value kept to eight leading bits, so a quantile is off by at most 1/128 of its
value, and sketches merge by adding counts, in any order and with one result.
A cutoff is the upper fence of its sketch: the upper quartile and a multiple of
the spread, which is the quartile range or, where that is less, what one event
(a symbol, an equal line, a window found twice) makes in a document of the
group's median size, read from sketches of the sizes. Groups too small to tell
use the merged sketch of their language, and then that of the whole corpus. As
few events as the multiple never reject, since they say little of a short text.

Defined cases: null text has no words and fails; a null language or source is
a group of its own; repeated rows count as often as they appear; an empty
table gives an empty result; other columns are ignored or, in the filter,
returned as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apptlens.llm.common import known, words
from apptlens.session import materialize

WINDOW = 5
LEAST_WORDS = 10
REPEAT_PERCENT = 20

# The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"

# Rows from which a group has cutoffs of its own.
GROUP_ROWS = 50
# The fence lies this many spreads above the upper quartile.
RANGES = 4
# Leading bits of a value that a sketch keeps.
BITS = 8
# What one event adds to the count of a ratio (a window found twice covers at
# least two windows), the size by which the ratio divides, and the count.
EVENTS = {"symbols": (1, "words", "n_symbols"), "dup_lines": (1, "lines", "n_dup_lines"), "repeats": (2 * WINDOW, "words", "n_repeat_words")}
# The least spread of the mean length of words: a tenth of a character.
LEAST_SPREAD = 100
RATIOS = (*EVENTS, "word_length")

# Cutoffs that are sent to the documents; for more groups, both are shuffled.
BROADCAST_GROUPS = 1 << 18

_STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def _removed(text: Column, chars: str) -> Column:
    """Characters of a text that are in the list.

    Replaced one by one, which reads bytes; ``translate`` looks up every character of the text.
    """
    return F.length(text) - F.length(reduce(lambda rest, c: F.replace(rest, F.lit(c), F.lit("")), chars, text))


def with_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts, prefixed ``__q_``.

    Windows of words are compared by hash inside their row's array; nothing
    is shuffled. Each step reads the arrays of the step before as columns, so
    that they are computed once.
    """
    kept = [F.col(f"`{c}`") for c in df.columns]
    body = known(text)
    lines = F.filter(F.split(body, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    step = df.select(
        *kept,
        F.transform(words(body), lambda w: F.xxhash64(w)).alias("__q_hashes"),
        (F.length(body) - _removed(body, BLANKS)).alias("__q_word_chars"),
        _removed(body, SYMBOLS).alias("__q_n_symbols"),
        lines.alias("__q_lines"),
    )
    h = F.col("__q_hashes")
    window = lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, WINDOW)])
    step = step.select(
        *kept,
        F.size(h).cast("long").alias("__q_n_words"),
        *[F.col(f"__q_{c}").cast("long").alias(f"__q_{c}") for c in ("word_chars", "n_symbols")],
        F.size("__q_lines").cast("long").alias("__q_n_lines"),
        (F.size("__q_lines") - F.size(F.array_distinct("__q_lines"))).cast("long").alias("__q_n_dup_lines"),
        F.transform(F.slice(h, 1, F.greatest(F.size(h) - (WINDOW - 1), F.lit(0))), window).alias("__q_windows"),
    )
    w = F.col("__q_windows")
    numbered = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    step = step.withColumn("__q_sorted", F.when(F.size(F.array_distinct(w)) < F.size(w), numbered)).drop("__q_windows")
    s = F.col("__q_sorted")
    beside = lambda e, i: F.coalesce(
        F.get(s, i - 1)["h"] == e["h"], F.lit(False)
    ) | F.coalesce(F.get(s, i + 1)["h"] == e["h"], F.lit(False))
    again = F.sort_array(F.transform(F.filter(s, beside), lambda e: e["i"]))
    step = step.withColumn("__q_again", again).drop("__q_sorted")
    p = F.col("__q_again")
    new = F.transform(p, lambda x, j: F.when(j == 0, WINDOW).otherwise(F.least(F.lit(WINDOW), x - F.get(p, j - 1))))
    covered = F.aggregate(new, F.lit(0).cast("long"), lambda a, x: a + x)
    return step.withColumn("__q_n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("__q_again")


def base_failed() -> Column:
    """The fixed rule, over the counts."""
    return (F.col("__q_n_words") < LEAST_WORDS) | (
        100 * F.col("__q_n_repeat_words") > REPEAT_PERCENT * F.col("__q_n_words")
    )


def ratios() -> dict[str, Column]:
    """What is sketched: whole numbers per thousand, so that all engines agree."""
    per = lambda a, b: F.expr(f"__q_{a} * 1000L div greatest(__q_{b}, 1L)")
    return {
        "symbols": per("n_symbols", "n_words"),
        "dup_lines": per("n_dup_lines", "n_lines"),
        "repeats": per("n_repeat_words", "n_words"),
        "word_length": per("word_chars", "n_words"),
    }


def few_events(name: str) -> Column:
    """Whether a document has too few events for its ratio to be judged."""
    return F.col(f"__q_{EVENTS[name][2]}") <= RANGES * EVENTS[name][0] if name in EVENTS else F.lit(False)


def bucket(value: str) -> Column:
    """The value with all but its leading bits cleared."""
    low = f"greatest(length(bin({value})) - {BITS}, 0)"
    return F.expr(f"shiftleft(shiftright({value}, {low}), {low})")


def sketch(stats: DataFrame, lang: str, source: str) -> DataFrame:
    """Counts per language, source, ratio or size, and bucket, of the rows that pass the fixed rule.

    A few thousand buckets per group at most; combined before the shuffle, so
    the rows of a hot source never meet in one task.
    """
    measured = {**ratios(), "words": F.col("__q_n_words"), "lines": F.col("__q_n_lines")}
    pairs = F.array(*[F.struct(F.lit(k).alias("ratio"), v.alias("value")) for k, v in measured.items()])
    return (
        stats.filter(~base_failed())
        .select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.explode(pairs).alias("r"))
        .select("lang", "source", "r.ratio", "r.value")
        .groupBy("lang", "source", "ratio", bucket("value").alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def fences(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Rows and upper fence per key and ratio, from sketches merged to the keys."""
    merged = sketches.groupBy(*keys, "ratio", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "ratio")
    upto = F.sum("n").over(group.orderBy("bucket"))
    ranked = merged.withColumns({"upto": upto, "total": F.sum("n").over(group)})
    at = lambda name, percent: F.min(
        F.when((F.col("ratio") == name) & (100 * F.col("upto") >= percent * F.col("total")), F.col("bucket"))
    )
    quartiles = ranked.groupBy(*keys).agg(
        F.max("total").alias("rows"),
        *[at(k, p).alias(f"{k}_{p}") for k in RATIOS for p in (25, 75)],
        *[at(k, 50).alias(f"{k}_50") for k in ("words", "lines")],
    )
    least = {k: F.expr(f"{event * 1000}L div greatest({size}_50, 1L)") for k, (event, size, _) in EVENTS.items()}
    fence = lambda k: F.col(f"{k}_75") + RANGES * F.greatest(
        F.col(f"{k}_75") - F.col(f"{k}_25"), least.get(k, F.lit(LEAST_SPREAD).cast("long"))
    )
    return quartiles.select(*keys, "rows", *[fence(k).alias(f"__t_{k}") for k in RATIOS])


def thresholds(sketches: DataFrame) -> DataFrame:
    """The cutoffs in force for each language and source."""
    cutoffs = [f"__t_{k}" for k in RATIOS]
    own, by_lang, overall = (fences(sketches, k).alias(a) for k, a in ((["lang", "source"], "o"), (["lang"], "l"), ([], "a")))
    picked = lambda c: (
        F.when(F.col("o.rows") >= GROUP_ROWS, F.col(f"o.{c}"))
        .when(F.col("l.rows") >= GROUP_ROWS, F.col(f"l.{c}"))
        .otherwise(overall.select(c).scalar())
        .alias(c)
    )
    return own.join(by_lang, F.col("o.lang").eqNullSafe(F.col("l.lang"))).select(
        F.col("o.lang").alias("__t_lang"), F.col("o.source").alias("__t_source"), *[picked(c) for c in cutoffs]
    )


def judged(stats: DataFrame, counted: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Rows with their counts, ``__q_base_failed`` and ``__q_kept``, by the cutoffs of the rows in ``counted``."""
    cut = materialize(thresholds(sketch(counted, lang, source)), "quality-cutoffs")
    if cut.count() <= BROADCAST_GROUPS:
        cut = F.broadcast(cut)
    same = F.col(f"`{lang}`").eqNullSafe(F.col("__t_lang")) & F.col(f"`{source}`").eqNullSafe(F.col("__t_source"))
    below = F.lit(True)
    for name, value in ratios().items():
        below = below & (few_events(name) | F.coalesce(value <= F.col(f"__t_{name}"), F.lit(True)))
    rows = stats.join(cut, same, "left")
    columns = [F.col(f"`{c}`") for c in stats.columns]
    return rows.select(*columns, base_failed().alias("__q_base_failed"), (~base_failed() & below).alias("__q_kept"))


def verdicts(docs: DataFrame) -> DataFrame:
    """Counts and verdict of every document."""
    rows = docs.select("doc_id", "text", "lang", "source")
    stats = materialize(with_stats(rows).drop("text"), "quality-counts")
    return judged(stats, stats).select(
        "doc_id",
        *[F.col(f"__q_{c}").alias(c) for c in _STATS[:5]],
        F.col("__q_base_failed").alias("base_failed"),
        F.col("__q_kept").alias("kept"),
    )


def filter_documents(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The documents that pass, with their own columns."""
    # Stored with the texts: the optimizer would otherwise repeat the counting in every reference.
    stats = materialize(with_stats(docs, text), "quality-counts")
    return judged(stats, stats, lang, source).filter("__q_kept").select(*[F.col(f"`{c}`") for c in docs.columns])


_LOW = f"greatest(length(bin(v)) - {BITS}, 0)"
_BUCKET = f"(v >> {_LOW}) << {_LOW}"


def verdict_sql(source: str = "documents") -> str:
    """Common table expressions ending in ``q6``: every row with ``kept``."""
    at = lambda k, p: f"min(bucket) FILTER (ratio = '{k}' AND 100 * upto >= {p} * total)"
    least = lambda k: f"{EVENTS[k][0] * 1000} // greatest({at(EVENTS[k][1], 50)}, 1)" if k in EVENTS else LEAST_SPREAD
    cut = lambda k: f"{at(k, 75)} + {RANGES} * greatest({at(k, 75)} - {at(k, 25)}, {least(k)}) AS f_{k}"
    few = lambda k: f"{EVENTS[k][2]} <= {RANGES * EVENTS[k][0]} OR " if k in EVENTS else ""
    fence = lambda keys: f"""
  SELECT {keys}max(total) AS n_rows, {", ".join(cut(k) for k in RATIOS)}
  FROM (SELECT {keys}ratio, bucket, sum(n) OVER (PARTITION BY {keys}ratio ORDER BY bucket) AS upto,
          sum(n) OVER (PARTITION BY {keys}ratio) AS total
        FROM (SELECT {keys}ratio, bucket, sum(n) AS n FROM q6_sketch GROUP BY {keys}ratio, bucket))
  {"GROUP BY " + keys.rstrip(", ") if keys else ""}"""  # noqa: E731
    pick = lambda k: f"CASE WHEN o.n_rows >= {GROUP_ROWS} THEN o.f_{k} WHEN l.n_rows >= {GROUP_ROWS} THEN l.f_{k} ELSE a.f_{k} END"
    return f"""
q6_d AS (SELECT row_number() OVER () AS r, *, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM {source}),
q6_win AS (SELECT r, i, w[i:i + {WINDOW - 1}] AS g FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM q6_d)),
q6_rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM q6_win) WHERE n > 1),
q6_cov AS (SELECT r, sum(least({WINDOW}, coalesce(i - p, {WINDOW}))) AS n FROM
    (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS p FROM q6_rep) GROUP BY r),
q6_s AS (SELECT q6_d.*, CAST(len(w) AS BIGINT) AS n_words,
    CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(q6_cov.n, 0) AS BIGINT) AS n_repeat_words FROM q6_d LEFT JOIN q6_cov USING (r)),
q6_b AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed,
    n_symbols * 1000 // greatest(n_words, 1) AS r_symbols, n_dup_lines * 1000 // greatest(n_lines, 1) AS r_dup_lines,
    n_repeat_words * 1000 // greatest(n_words, 1) AS r_repeats, word_chars * 1000 // greatest(n_words, 1) AS r_word_length
  FROM q6_s),
q6_sketch AS (SELECT lang, source, ratio, {_BUCKET} AS bucket, count(*) AS n FROM (
    {" UNION ALL ".join(f"SELECT lang, source, '{k}' AS ratio, {v} AS v FROM q6_b WHERE NOT base_failed" for k, v in [*((k, "r_" + k) for k in RATIOS), ("words", "n_words"), ("lines", "n_lines")])})
  GROUP BY ALL),
q6_own AS ({fence("lang, source, ")}), q6_lang AS ({fence("lang, ")}), q6_all AS ({fence("")}),
q6_cut AS (SELECT o.lang, o.source, {", ".join(f"{pick(k)} AS f_{k}" for k in RATIOS)}
  FROM q6_own o JOIN q6_lang l ON o.lang IS NOT DISTINCT FROM l.lang, q6_all a),
q6 AS (SELECT b.*, NOT base_failed AND {" AND ".join(f"({few(k)}coalesce(r_{k} <= f_{k}, true))" for k in RATIOS)} AS kept
  FROM q6_b b LEFT JOIN q6_cut c ON b.lang IS NOT DISTINCT FROM c.lang AND b.source IS NOT DISTINCT FROM c.source)"""


ORACLE_SQL = f"""
WITH {verdict_sql()}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM q6"""
