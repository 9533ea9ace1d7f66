"""Personal data replaced by keyed surrogates of the same kind and shape.

Detected entities (e-mail and network addresses, phone, card, account and
identity numbers, names after a title) get replacements made from a keyed hash
of their normal form, so one entity has one surrogate in the whole corpus.
Numbers keep their separators, prefixes and check digits; letters keep case
and script; names keep the gender that their title tells.

Distinct entities must keep distinct surrogates, and no surrogate may be a real
entity. All distinct entities of the corpus are checked: surrogates that clash
are drawn again, with the next attempt in the key, until none does. Only
entities with a later attempt travel back to the texts: to all tasks while they
are few, else each to the texts that hold it.

Defined cases: null text stays null and has no entities; empty text stays
empty; repeated rows and entities get equal surrogates; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from apptlens.session import materialize

# The kinds in order of precedence and what they look like.
KINDS = {
    "email": r"[\w.%+-]+@[\w-]+(?:\.[\w-]+)*\.\p{L}{2,}",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)",
    "iban": r"\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?\b",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d.-])(?:\d[ -]?){12,18}\d(?![\d-])",
    "phone": r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?\(?\d{2,4}\)?[ .-]\d{3,4}[ .-]?\d{3,4}(?![\w])|(?<![\w.])\+\d{8,14}(?!\w)",
    "name": r"\b(?P<title>Mr|Mister|Herr|Monsieur|Sr|Señor|Mrs|Ms|Miss|Frau|Mme|Madame|Sra|Señora|Dr|Prof)\.?\ (?P<who>\p{Lu}\p{Ll}+(?:[ -]\p{Lu}\p{Ll}+){0,2})",
}
MALE = {"Mr", "Mister", "Herr", "Monsieur", "Sr", "Señor"}
FEMALE = {"Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Sra", "Señora"}
# Syllables of invented names per script, and endings that sound male, female or like neither.
SYLLABLES = {
    "Latin": ("ba be bo da de do fa fe ga go ha he ka ke la le lo ma me mo na ne ra re ro sa se ta te to va ve".split(), ("n", "r", "s"), ("a", "ia", "ina"), ("e", "en", "il")),
    "Cyrillic": ("ба бе бо ва ве га го да де жа за ка ко ла ле ма ме на не ра ре ро са се та те".split(), ("н", "р", "с"), ("а", "ия", "ина"), ("е", "ен", "ил")),
    "Greek": ("βα βε γα δα δε θα θε κα κε λα λε μα με να νε ρα ρε σα σε τα τε".split(), ("ς", "ας", "ος"), ("α", "ια", "η"), ("ι", "ο", "ε")),
}
ATTEMPTS = 20
# Exceptions that are sent to all tasks; more are joined to the texts that hold them.
MOST_EXCEPTIONS = 1 << 19

_ALL = regex.compile("|".join(f"(?P<{k}>{p})" for k, p in KINDS.items()))
_DIGIT = re.compile(r"[@\d]")
_TITLES = [t + end for t in sorted({*MALE, *FEMALE, "Dr", "Prof"}) for end in (" ", ". ")]


def _worth_reading(text: str) -> bool:
    """Whether a text can hold an entity at all: a cheap look."""
    return _DIGIT.search(text) is not None or any(t in text for t in _TITLES)


def _luhn_sum(digits: str) -> int:
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(int(c) for c in reversed(digits)))


def normal(kind: str, text: str) -> str:
    """The form in which one entity is always written."""
    if kind in ("card", "phone", "ssn", "iban"):
        return "".join(c for c in text if c.isalnum() or c == "+").upper()
    if kind == "ip":
        return str(ipaddress.ip_address(".".join(str(int(x)) for x in text.split("."))))
    return " ".join(text.split()).casefold()


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, gender) of the entities of a text, without overlaps."""
    out, offset = [], 0
    if not _worth_reading(text):
        return out
    # No entity goes beyond its line.
    for line in text.split("\n"):
        for m in _ALL.finditer(line) if _worth_reading(line) else ():
            kind = next(k for k in KINDS if m[k] is not None)
            start, end, gender = m.start(), m.end(), ""
            if kind == "name":
                start, end = m.span("who")
                gender = "m" if m["title"] in MALE else "f" if m["title"] in FEMALE else "n"
            out.append((offset + start, offset + end, kind, gender))
        offset += len(line) + 1
    return out


class _Stream:
    """Numbers drawn from a keyed hash of an entity."""

    def __init__(self, key: bytes, *parts: str):
        self._key, self._of, self._n, self._pool = key, "\x1f".join(parts).encode(), 0, 0
        self._left = 0

    def below(self, n: int) -> int:
        if self._left < n << 32:
            block = hmac.new(self._key, self._of + self._n.to_bytes(4, "big"), hashlib.sha256).digest()
            self._pool, self._left, self._n = int.from_bytes(block, "big"), 1 << 256, self._n + 1
        self._pool, got = divmod(self._pool, n)
        self._left //= n
        return got


def _letters(stream: _Stream, like: str) -> str:
    """Letters and digits drawn anew, the rest kept."""
    out = []
    for c in like:
        if c.isdigit():
            out.append(str(stream.below(10)))
        elif c.isalpha():
            new = chr((0x430 if "а" <= c.lower() <= "я" else 0x3B1 if "α" <= c.lower() <= "ω" else 97) + stream.below(24))
            out.append(new.upper() if c.isupper() else new)
        else:
            out.append(c)
    return "".join(out).replace("ς", "σ")


def _script(text: str) -> str:
    return "Cyrillic" if regex.search(r"\p{Cyrillic}", text) else "Greek" if regex.search(r"\p{Greek}", text) else "Latin"


def canonical(kind: str, form: str, gender: str, attempt: int, key: bytes) -> str:
    """The surrogate of an entity in normal form."""
    stream = _Stream(key, kind, form, str(attempt))
    if kind == "email":
        user, _, _ = form.partition("@")
        return f"{_letters(stream, user)}{stream.below(10**6):06d}@mail{stream.below(100)}.example.org"
    if kind == "ip":
        return f"{240 + stream.below(16)}.{stream.below(256)}.{stream.below(256)}.{stream.below(256)}"
    if kind == "name":
        syllables, *ends = SYLLABLES[_script(form)]
        ending = ends["mfn".index(gender or "n")]
        word = lambda k, e: "".join(syllables[stream.below(len(syllables))] for _ in range(k)) + e[stream.below(len(e))]
        return " ".join(word(3 + attempt // 2, ending if i == 0 else ends[2]).capitalize() for i in range(len(form.replace("-", " ").split())))
    if kind == "iban":
        body = "".join(str(stream.below(10)) if c.isdigit() else chr(65 + stream.below(26)) for c in form[4:])
        number = int("".join(str(int(c, 36)) for c in body + form[:2] + "00"))
        return f"{form[:2]}{98 - number % 97:02d}{body}"
    digits = [c for c in form if c.isdigit()]
    keep = {"phone": 1 if form.startswith("+") else 0, "card": 1, "ssn": 0}[kind]
    new = digits[:keep] + [str(stream.below(10)) for _ in digits[keep:]]
    if kind == "ssn":  # a range that is never issued
        new[0] = "9"
    if kind == "card":
        # Valid numbers stay valid, and the others stay others.
        rest = _luhn_sum("".join(new[:-1]) + "0") % 10
        check = (10 - rest) % 10
        new[-1] = str(check if _luhn_sum("".join(digits)) % 10 == 0 else (check + 1 + stream.below(9)) % 10)
    return ("+" if form.startswith("+") else "") + "".join(new)


def shaped(kind: str, text: str, surrogate: str) -> str:
    """The surrogate written as the text is written: separators, case."""
    if kind in ("card", "phone", "ssn", "iban"):
        chars = iter(surrogate.lstrip("+"))
        return "".join(next(chars) if c.isalnum() else c for c in text)
    if kind == "email":
        return surrogate.upper() if text.isupper() else surrogate
    if kind == "name":
        parts = iter(surrogate.split())
        return regex.sub(r"[^\s-]+", lambda m: next(parts), text)
    return surrogate


def replace(text: str, key: bytes, attempts: dict[tuple[str, str], int]) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with surrogates, and (start, end, kind) of what was found."""
    out, last, spans = [], 0, []
    for start, end, kind, gender in find(text):
        entity = text[start:end]
        form = normal(kind, entity)
        new = canonical(kind, form, gender, attempts.get((kind, form), 0), key)
        out += [text[last:start], shaped(kind, entity, new)]
        last = end
        spans.append((start, end, kind))
    return "".join([*out, text[last:]]), spans


def entities(docs: DataFrame, text: str) -> DataFrame:
    """The distinct entities of the corpus: ``kind``, ``form``, ``gender``."""

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {(k, normal(k, t[a:b]), g) for t in batch.column(0).to_pylist() if t for a, b, k, g in find(t)}
            columns = list(zip(*sorted(found))) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["kind", "form", "gender"])

    found = docs.select(text).mapInArrow(detect, "kind string, form string, gender string")
    # A name with titles of several genders has one surrogate: the first by letter.
    return found.groupBy("kind", "form").agg(F.min("gender").alias("gender"))


def _drawn(rows: DataFrame, key: bytes) -> DataFrame:
    """Entities with the surrogate of their attempt."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [canonical(k, f, g, a, key) for k, f, g, a in zip(*(c.to_pylist() for c in batch.columns))]
            columns = [*batch.columns, pa.array([normal(k, s) for k, s in zip(batch.column(0).to_pylist(), new)], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["kind", "form", "gender", "attempt", "surrogate"])

    names = ["kind", "form", "gender", "attempt"]
    return rows.select(*names).mapInArrow(draw, "kind string, form string, gender string, attempt int, surrogate string")


def later_attempts(found: DataFrame, key: bytes) -> dict[tuple[str, str], int]:
    """The entities of ``late_entities`` as a dictionary, for tables where they are few."""
    return {(r["kind"], r["form"]): r["attempt"] for r in late_entities(found, key).collect()}


def late_entities(found: DataFrame, key: bytes) -> DataFrame:
    """``kind``, ``form`` of entities whose first surrogates clash, and the ``attempt`` that does not.

    Of entities that draw the same surrogate the first keeps it; a surrogate
    that is itself an entity goes to nobody.
    """
    found = materialize(found, "entities")
    current = materialize(_drawn(found.withColumn("attempt", F.lit(0)), key), "surrogates")
    for _ in range(ATTEMPTS):
        real = found.select("kind", F.col("form").alias("surrogate"), F.lit(True).alias("real"))
        rank = F.row_number().over(Window.partitionBy("kind", "surrogate").orderBy("attempt", "form"))
        ranked = current.withColumn("rank", rank).join(real, ["kind", "surrogate"], "left")
        clash = (F.col("rank") > 1) | F.col("real").isNotNull()
        ranked = materialize(ranked.withColumn("clash", clash), "ranked-surrogates")
        if ranked.filter("clash").isEmpty():
            break
        again = _drawn(ranked.filter("clash").withColumn("attempt", F.col("attempt") + 1), key)
        current = materialize(ranked.filter("NOT clash").select(*again.columns).unionByName(again), "surrogates")
    else:
        raise ValueError("too few surrogates for the entities of a kind")
    return current.filter("attempt > 0").select("kind", "form", "attempt")


def _with_attempts(rows: DataFrame, late: DataFrame) -> DataFrame:
    """Rows with the later attempts of the entities in their text as ``late``. Copies of a text are looked up once."""

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            held = sorted({(n, k, normal(k, t[a:b])) for n, t in pairs for a, b, k, _ in find(t)})
            columns = list(zip(*held)) or [(), (), ()]
            kinds = [pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["text_key", "kind", "form"])

    keyed = rows.withColumn("text_key", F.xxhash64("text"))
    held = keyed.filter("text is not null").select("text_key", "text").mapInArrow(detect, "text_key bigint, kind string, form string")
    per_text = (
        held.distinct()
        .join(late, ["kind", "form"])
        .groupBy("text_key")
        .agg(F.collect_list(F.struct("kind", "form", "attempt")).alias("late"))
    )
    return keyed.join(materialize(per_text, "late-entities"), "text_key", "left").select("doc_id", "text", "late")


def pseudonymize(docs: DataFrame, key: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document with surrogates: ``doc_id``, ``text``, ``n_entities`` and the ``kinds`` found."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    late = late_entities(entities(docs, text), key)
    few: dict[tuple[str, str], int] = {}
    if late.count() <= MOST_EXCEPTIONS:
        few = {(r["kind"], r["form"]): r["attempt"] for r in late.collect()}
    else:
        rows = _with_attempts(rows, late)
    attempts = docs.sparkSession.sparkContext.broadcast(few)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * batch.num_rows
            later = ({(e["kind"], e["form"]): e["attempt"] for e in o} if o else attempts.value for o in own)
            done = [(None, []) if t is None else replace(t, key, known) for t, known in zip(batch.column(1).to_pylist(), later)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([t for t, _ in done], pa.string()),
                    pa.array([len(s) for _, s in done], pa.int64()),
                    pa.array([",".join(sorted({k for _, _, k in s})) for _, s in done], pa.string()),
                ],
                ["doc_id", "text", "n_entities", "kinds"],
            )

    return rows.mapInArrow(rewrite, "doc_id bigint, text string, n_entities bigint, kinds string")
