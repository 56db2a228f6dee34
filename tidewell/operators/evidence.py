"""What texts say, and where: values with evidence for and against, and the role of date ranges in their sentence."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema


@dataclass(frozen=True)
class Field:
    """A field's values by the phrases that state them; phrases of `hypothetical` say nothing, a value in `wins` silences the others."""

    values: tuple[tuple[str, tuple[str, ...]], ...]
    hypothetical: tuple[str, ...] = ()
    wins: str | None = None


# The phrases that state a field's value.
FIELDS = {
    "is_sublet": Field(
        (("true", (r"\bsublet\b", r"\bsublease\b", r"\bsubletting\b")), ("false", (r"\bnot\s+(?:a\s+)?sublet\b", r"\bno\s+subletting\b"))),
        (r"\b(?:may|can|could)\s+(?:be\s+)?(?:sublet|sublease|subletting)\b", r"\boption\s+to\s+(?:sublet|sublease)\b", r"\bsubletting\s+(?:is\s+)?(?:allowed|permitted)\b"),
        "false",
    ),
    "furnished": Field((("true", (r"\bfully\s+furnished\b", r"\bfurnished\s+(?:room|unit|home|house|apartment)\b")), ("false", (r"\bunfurnished\b", r"\bnot\s+furnished\b")))),
    "utilities_included": Field((("true", (r"\butilities\s+(?:are\s+)?included\b", r"\ball[- ]inclusive\b")), ("false", (r"\bplus\s+utilities\b", r"\butilities\s+(?:are\s+)?(?:extra|not\s+included)\b")))),
    "bathroom_type": Field((("private", (r"\bprivate\s+bathroom\b", r"\bensuite\s+bathroom\b", r"\ben-suite\b")), ("shared", (r"\bshared\s+bathroom\b", r"\bbathroom\s+shared\b")))),
    "preferred_gender": Field((
        ("female_only", (r"\bfemales?\s+only\b", r"\bwomen\s+only\b")), ("male_only", (r"\bmales?\s+only\b", r"\bmen\s+only\b")),
        ("female_preferred", (r"\bfemales?\s+(?:preferred|preference)\b", r"\bwomen\s+(?:preferred|preference)\b", r"\bprefer(?:red|ence)?\s+(?:females?|women)\b")),
        ("male_preferred", (r"\bmales?\s+(?:preferred|preference)\b", r"\bmen\s+(?:preferred|preference)\b", r"\bprefer(?:red|ence)?\s+(?:males?|men)\b")),
        ("any", (r"\bany\s+gender\b", r"\bno\s+gender\s+preference\b", r"\bco-?ed\b")),
    )),
}
#: A field whose value is the number in the phrase.
LEASE = ("lease_term_months", r"\b(\d{1,2})[-\s]month\s+lease\b")

# What bounds a statement, and the words that make a date range one of availability or of price.
BOUNDARY = r"[.!?;:\r\n]"
AVAILABILITY = (
    r"\b(?:available|availability|sublet|sublease|subletting|assign(?:ed|ing|ment)?|lease|leasing|rental\s+term|tenancy|occupancy|possession|move[\s-]?in|move[\s-]?out|school\s+year|summer\s+rent(?:al)?|term|\d+\s+(?:furnished\s+)?bedrooms?)\b"
)
PRICING = r"(?:\$\s*\d|\bCAD\b|\b(?:rent|rate|price|pricing|discount(?:ed)?|promotion(?:al)?|special|per\s+month|monthly|reduced|save|first\s+month\s+free)\b|/\s*month\b)"
_MONTH = r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
#: A closed range of months.
RANGE = rf"\b{_MONTH}(?:\s+\d{{1,2}})?\s*(?:-|to|until|through)\s*{_MONTH}(?:\s+\d{{1,2}})?\b"
#: Characters on each side of a range in which a word counts, and before a colon in which a label does.
WINDOW, LABEL = 96, 48

#: Texts in an Arrow batch, and places that a task holds before their rows leave it.
BATCH_ROWS, HELD = 500, 2000

_FLAGS = re.IGNORECASE | re.ASCII
_SAID = "struct<text: string, start: int, end: int, sentence: int>"
EXPLICIT = f"field string, value string, supporting array<{_SAID}>, conflicting array<{_SAID}>"
ROLES = "start int, end int, text string, role string, distance int"


def _any(patterns: tuple[str, ...]) -> re.Pattern[str]:
    return re.compile("|".join(patterns), _FLAGS)


_COMPILED = {name: ([(v, _any(p)) for v, p in f.values], _any(f.hypothetical) if f.hypothetical else None, f.wins) for name, f in FIELDS.items()}
_LEASE, _BOUNDARY, _RANGE, _AVAILABILITY, _PRICING = (re.compile(p, _FLAGS) for p in (LEASE[1], BOUNDARY, RANGE, AVAILABILITY, PRICING))


def explicit_values(text: str) -> Iterator[tuple[str, str | None, list, list]]:
    """(field, value, supporting, conflicting) of the fields of which the text says anything."""
    bounds = [m.start() for m in _BOUNDARY.finditer(text)]
    said = lambda m: {"text": m[0].lower(), "start": m.start(), "end": m.end(), "sentence": bisect_left(bounds, m.start())}
    for name, (values, hypothetical, wins) in _COMPILED.items():
        rest = hypothetical.sub(lambda m: " " * len(m[0]), text) if hypothetical else text
        found = {v: list(pattern.finditer(rest)) for v, pattern in values}
        if wins and found[wins]:
            found = {wins: found[wins]}
        present = [(v, [said(m) for m in ms]) for v, ms in found.items() if ms]
        if present:
            yield name, present[0][0] if len(present) == 1 else None, present[0][1], [e for _, es in present[1:] for e in es]
    months = list(_LEASE.finditer(text))
    if months:
        numbers = {int(m[1]) for m in months}
        one = len(numbers) == 1
        yield LEASE[0], str(numbers.pop()) if one else None, [said(m) for m in months] if one else [], [] if one else [said(m) for m in months]


def range_roles(text: str) -> Iterator[tuple[int, int, str, str, int | None]]:
    """(start, end, text, role, distance) of each range of months.

    A word counts if it is in the range's statement and within WINDOW characters;
    after a colon the LABEL characters before it count too.  The closest word on
    the left decides for availability, then the closest on any side; a word that
    touches the range is at distance 0.  A range that is all of its statement is
    one of availability, any other without words is ambiguous.
    """
    bounds = [m.start() for m in _BOUNDARY.finditer(text)]
    for m in _RANGE.finditer(text):
        lo, hi = m.span()
        before = bisect_left(bounds, lo)
        begin = bounds[before - 1] + 1 if before else 0
        after = bisect_right(bounds, hi - 1)
        end = bounds[after] if after < len(bounds) else len(text)
        first = max(0, begin - LABEL) if before and text[begin - 1] == ":" else begin
        first, last = max(first, lo - WINDOW), min(end, hi + WINDOW)
        near = text[first:last]

        def distances(pattern: re.Pattern[str], near=near, lo=lo - first, hi=hi - first) -> tuple[int | None, int | None]:
            left, other = [], []
            for s in pattern.finditer(near):
                if s.end() <= lo:
                    left.append(lo - s.end())
                else:
                    other.append(max(0, s.start() - hi))
            return min(left + other, default=None), min(left, default=None)

        (free, free_left), (price, price_left) = distances(_AVAILABILITY), distances(_PRICING)
        if free_left is not None and (price_left is None or free_left <= price_left):
            yield lo, hi, m[0], "availability", free_left
        elif free is not None and (price is None or free <= price):
            yield lo, hi, m[0], "availability", free
        elif price is not None:
            yield lo, hi, m[0], "pricing", price
        else:
            yield lo, hi, m[0], "ambiguous" if re.search(r"\w", text[begin:lo] + text[hi:end]) else "availability", None


def _batches(read: Callable, types: pa.Schema) -> Callable:
    """What is read of each text of (key, text) batches; texts become objects one by one, and rows leave at HELD places."""
    key, *names = types.names

    def run(batches):
        for batch in batches:
            rows, found, held = [], [], 0
            for at in range(batch.num_rows):
                for one in read(batch.column(1)[at].as_py() or ""):
                    rows.append(at)
                    found.append(one)
                    held += 1 + sum(len(f) for f in one if isinstance(f, list))
                if held >= HELD or (rows and at == batch.num_rows - 1):
                    columns = [pa.array([f[i] for f in found], types.field(n).type) for i, n in enumerate(names)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *columns], [key, *names])
                    rows, found, held = [], [], 0

    return run


def _rows(texts: DataFrame, key: str, text: str, read: Callable, schema: str) -> DataFrame:
    kind = texts.schema[key].dataType.simpleString()
    out = texts.sparkSession.createDataFrame([], f"`{key}` {kind}, {schema}").schema
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(texts.sparkSession.conf.get(size)) <= BATCH_ROWS:
        texts.sparkSession.conf.set(size, str(BATCH_ROWS))
    return texts.select(key, text).mapInArrow(_batches(read, to_arrow_schema(out)), out)


def explicit_text_values(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, field, value, supporting, conflicting): what each whole text says of FIELDS and the lease, with the places.

    Several values leave the value null, with the evidence of the first for and
    of the others against it.  Hypotheticals (`option to sublet`) are no
    evidence.  Offsets and sentences count from 0; a null text says nothing.
    """
    return _rows(texts, key, text, explicit_values, EXPLICIT)


def context_roles(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, start, end, text, role, distance): each range of months in each whole text, as range_roles has them."""
    return _rows(texts, key, text, range_roles, ROLES)


def listed(said: str):
    """Evidence as `text@start`, with bars between."""
    return F.array_join(F.transform(said, lambda e: F.concat(e.text, F.lit("@"), e.start.cast("string"))), "|")
