"""Secrets in text, judged by who holds them.

Patterns find candidates; a candidate's hash is then counted over the whole
corpus by distinct owners, repositories and texts. A value that many owners,
repositories or texts hold is a copied example, wherever it stands; one that a
single owner holds in few places looks live; what is left is shared. The counts
also add spans: a bare token without any keyword counts as a secret (kind
``owned``) when it looks live. Copies of a text within a repository count once.

Defined cases: null text is empty; rows that agree in id and text get the same
spans; a null owner or repository counts as one; an empty table gives an empty
result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apptlens.llm.common import known
from apptlens.session import materialize

# The kinds in order, their patterns, the least length of the
# group that is named by number.
PATTERNS = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
    ("owned", r"[A-Za-z0-9+/_=-]{20,}", 0, 20),
)
BASE = 3

# Owners, repositories or texts (distinct in each repository, added up) from
# which a value counts as a copied example.
COPIED_OWNERS = 3
COPIED_REPOSITORIES = 3
COPIED_TEXTS = 10

# Elements of an array that are folded together.
BLOCK = 128


def _with_running(rows: DataFrame, name: str, items: str, number: Callable[[Column], Column], combine: Callable[[Column, Column], Column]) -> DataFrame:
    """Add ``name``: for each element of an array, the numbers of all before it, combined.

    A fold copies its state for every element, so the array is folded in
    blocks and then the blocks' totals, which keeps long arrays linear.
    """
    zero = F.struct(F.lit(0).alias("total"), F.array().cast("array<int>").alias("before"))
    folded = lambda values, of: F.aggregate(
        values,
        zero,
        lambda acc, x: F.struct(
            combine(acc["total"], of(x)).alias("total"), F.concat(acc["before"], F.array(acc["total"])).alias("before")
        ),
    )
    last = F.greatest(F.ceil(F.size(items) / BLOCK).cast("int") - 1, F.lit(0))
    blocks = F.transform(F.sequence(F.lit(0), last), lambda i: folded(F.slice(items, i * BLOCK + 1, F.lit(BLOCK)), number))
    rows = rows.withColumn("block", blocks).withColumn("earlier", folded(F.col("block"), lambda x: x["total"])["before"])
    whole = F.transform(
        F.arrays_zip("block", "earlier"), lambda z: F.transform(z["block"]["before"], lambda x: combine(x, z["earlier"]))
    )
    return rows.withColumn(name, F.flatten(whole)).drop("block", "earlier")


def _found(text: Column, order: int) -> Column:
    """Matches of one pattern with what lies before each, which gives the offsets."""
    _, pattern, group, _ = PATTERNS[order]
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    found = F.arrays_zip(
        F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(whole)), lambda x: F.length(x)).alias("gap"),
        F.transform(whole, lambda x: F.length(x)).alias("length"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
    )
    none = F.array().cast("array<struct<gap:int,length:int,value:string>>")
    return F.when(text.rlike(pattern), found).otherwise(none)


def _spans(order: int) -> Column:
    """Matches as (start, kind, end, value), in code points."""
    least = PATTERNS[order][3]
    spans = F.transform(
        F.arrays_zip(F.col(f"found{order}").alias("m"), F.col(f"at{order}").alias("at")),
        lambda z: F.struct(
            (z["at"] + z["m"]["gap"]).alias("start"),
            F.lit(order).alias("kind"),
            (z["at"] + z["m"]["gap"] + z["m"]["length"]).alias("end"),
            z["m"]["value"].alias("value"),
        ),
    )
    return F.filter(spans, lambda s: F.length(s["value"]) >= least)


def _clear() -> Column:
    """The bare tokens that no base span overlaps, of ``both`` in order of their start.

    A base span before a token overlaps it if the furthest end so far
    (``reach``) lies within; one that starts within it is the next of ``both``,
    since tokens do not overlap each other.
    """
    alone = lambda z, i: (
        (z["both"]["kind"] == BASE)
        & (z["reach"] <= z["both"]["start"])
        & F.coalesce(F.get("both", i + 1)["start"] >= z["both"]["end"], F.lit(True))
    )
    return F.transform(F.filter(F.arrays_zip("both", "reach"), alone), lambda z: z["both"])


def candidates(docs: DataFrame, doc_id: str, text: str, owner: Column, repository: Column) -> DataFrame:
    """Per row its pattern matches: base spans and bare tokens beside them."""
    body = known(text)
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.xxhash64(body).alias("text_key"),
        owner.alias("owner"),
        repository.alias("repository"),
        *[_found(body, k).alias(f"found{k}") for k in range(len(PATTERNS))],
    )
    for k in range(len(PATTERNS)):
        rows = _with_running(rows, f"at{k}", f"found{k}", lambda m: m["gap"] + m["length"], lambda a, b: a + b)
    # The position of a bare token that a base span covers says nothing new.
    mixed = lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]")
    keys = ["doc_id", "text_key", "owner", "repository"]
    rows = rows.select(
        *keys, F.sort_array(F.concat(*[_spans(k) for k in range(BASE)])).alias("base"), F.filter(_spans(BASE), mixed).alias("bare")
    )
    rows = rows.select(*keys, "base", F.sort_array(F.concat("base", "bare")).alias("both"))
    end = lambda s: F.when(s["kind"] < BASE, s["end"]).otherwise(0)
    return _with_running(rows, "reach", "both", end, F.greatest).select(*keys, "base", _clear().alias("bare"))


def ownership(found: DataFrame) -> DataFrame:
    """Per value hash: its owners, repositories and texts, corpus-wide.

    Aggregations each combined before its shuffle, so a value that a third of
    all rows hold reaches one task as a few partial counts.
    """
    return (
        found.select("owner", "repository", "text_key", F.explode(F.concat("base", "bare")).alias("s"))
        .select(F.xxhash64("s.value").alias("value_key"), "owner", "repository", "text_key")
        .distinct()
        .groupBy("value_key", "owner", "repository")
        .agg(F.count(F.lit(1)).alias("texts"))
        .groupBy("value_key", "owner")
        .agg(F.count(F.lit(1)).alias("repositories"), F.sum("texts").alias("texts"))
        .groupBy("value_key")
        .agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"), F.sum("texts").alias("texts"))
        .withColumn(
            "copied",
            (F.col("owners") >= COPIED_OWNERS) | (F.col("repositories") >= COPIED_REPOSITORIES) | (F.col("texts") >= COPIED_TEXTS),
        )
        .select("value_key", "copied", (~F.col("copied") & (F.col("owners") == 1)).alias("live"))
    )


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(p[0]) for p in PATTERNS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ","
    )


def scan(docs: DataFrame, doc_id: str, text: str, owner: Column, repository: Column) -> DataFrame:
    """Per row: counts and digest of the base spans, all spans, and how many
    spans look live, copied or shared."""
    found = materialize(candidates(docs, doc_id, text, owner, repository), "secret-candidates")
    judged = (
        found.filter(F.size("base") + F.size("bare") > 0)
        .select("doc_id", "text_key", F.explode(F.concat("base", "bare")).alias("s"))
        .distinct()
        .withColumn("value_key", F.xxhash64("s.value"))
        .join(ownership(found), "value_key")
        .groupBy("doc_id", "text_key")
        .agg(
            F.collect_list(F.when((F.col("s.kind") == BASE) & F.col("live"), F.col("s"))).alias("owned"),
            F.count_if("live").alias("n_live"),
            F.count_if("copied").alias("n_copied"),
            F.count_if(~F.col("live") & ~F.col("copied")).alias("n_shared"),
        )
        .select(F.struct("doc_id", "text_key").alias("key"), "owned", "n_live", "n_copied", "n_shared")
    )
    rows = found.withColumn("key", F.struct("doc_id", "text_key"))
    same = rows["key"].eqNullSafe(judged["key"])
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    every = F.when(F.col("owned").isNull(), F.col("base")).otherwise(F.sort_array(F.concat("base", "owned")))
    return rows.join(judged, same, "left").select(
        "doc_id",
        *[of_kind(k).alias(f"n_{PATTERNS[k][0]}") for k in range(BASE)],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(every).alias("spans"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_live", "n_copied", "n_shared")],
    )


def _sql_spans(order: int) -> str:
    name, pattern, group, least = PATTERNS[order]
    quoted = pattern.replace("'", "''")
    rule = "" if order < BASE else " AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')"
    return f"""
  SELECT r, {order} AS k, s AS b, s + length(w) AS e, v FROM (
    SELECT r, w, v, coalesce(sum(length(w)) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                    + sum(length(g)) OVER (PARTITION BY r ORDER BY i) AS s
    FROM (SELECT r, unnest(range(len(ws))) AS i, unnest(gs[1:len(ws)]) AS g, unnest(ws) AS w, unnest(vs) AS v
          FROM (SELECT r, regexp_split_to_array(t, '{quoted}') AS gs, regexp_extract_all(t, '{quoted}') AS ws,
                       regexp_extract_all(t, '{quoted}', {group}) AS vs
                FROM d WHERE regexp_matches(t, '{quoted}'))))
  WHERE length(v) >= {least}{rule}"""


_NAMES = "['" + "', '".join(p[0] for p in PATTERNS) + "']"
_LISTED = f"string_agg({_NAMES}[k + 1] || ':' || CAST(b AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY b, k)"

ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, source, lang FROM documents),
base AS ({" UNION ALL ".join(_sql_spans(k) for k in range(BASE))}),
bare AS (SELECT * FROM ({_sql_spans(BASE)}) o
  WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.r = o.r AND base.b < o.e AND o.b < base.e)),
every AS (SELECT * FROM base UNION ALL SELECT * FROM bare),
owners AS (SELECT v, owners >= {COPIED_OWNERS} OR repositories >= {COPIED_REPOSITORIES} OR texts >= {COPIED_TEXTS} AS copied,
    owners = 1 AND NOT copied AS live
  FROM (SELECT v, count(DISTINCT coalesce(source, '')) AS owners, count(DISTINCT row(coalesce(source, ''), coalesce(lang, ''))) AS repositories,
          count(DISTINCT row(coalesce(source, ''), coalesce(lang, ''), t)) AS texts FROM every JOIN d USING (r) GROUP BY v)),
judged AS (SELECT every.*, copied, live FROM every JOIN owners USING (v)),
per AS (SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
    {_LISTED.replace("ORDER BY b, k)", "ORDER BY b, k) FILTER (k < 3)")} AS base,
    {_LISTED.replace("ORDER BY b, k)", "ORDER BY b, k) FILTER (k < 3 OR live)")} AS spans,
    count(*) FILTER (live) AS n_live, count(*) FILTER (copied) AS n_copied, count(*) FILTER (NOT live AND NOT copied) AS n_shared
  FROM judged GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied, coalesce(n_shared, 0) AS n_shared
FROM d LEFT JOIN per USING (r)"""
