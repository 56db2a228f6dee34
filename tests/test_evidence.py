"""Evidence in texts: named cases, offsets, and a naive reading of random texts."""

import random
import re

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tidewell.operators import evidence as E


def values(text):
    return {f: (v, [e["text"] for e in a], [e["text"] for e in b]) for f, v, a, b in E.explicit_values(text)}


def roles(text):
    return [(t, r, d) for _, _, t, r, d in E.range_roles(text)]


def test_values():
    assert values("Sublet, fully furnished.") == {"is_sublet": ("true", ["sublet"], []), "furnished": ("true", ["fully furnished"], [])}
    assert values("There is an option to sublet. Subletting is allowed, you may be subletting") == {}
    assert values("Option to sublet; this is a sublease")["is_sublet"] == ("true", ["sublease"], [])
    assert values("A sublet? NOT a  sublet!")["is_sublet"] == ("false", ["not a  sublet"], [])
    assert values("furnished room or unfurnished, not furnished")["furnished"] == (None, ["furnished room"], ["unfurnished", "not furnished"])
    assert values("12-month lease, a 12 month lease")["lease_term_months"] == ("12", ["12-month lease", "12 month lease"], [])
    assert values("8 month lease or 4-month lease")["lease_term_months"] == (None, [], ["8 month lease", "4-month lease"])
    assert values("women only, men preferred, any gender")["preferred_gender"] == (None, ["women only"], ["men preferred", "any gender"])
    assert values("") == values("subletter furnisheds") == {}


def test_offsets_and_sentences():
    text = "İ ß. Option to sublet: no.\nUnfurnished; FULLY  furnished"
    (field, value, supporting, conflicting), = E.explicit_values(text)
    assert (field, value) == ("furnished", None)
    for e in (*supporting, *conflicting):
        assert text[e["start"] : e["end"]].lower() == e["text"]
    assert [e["sentence"] for e in supporting] == [5] and [e["sentence"] for e in conflicting] == [4]


def test_roles():
    assert roles("Available May - Aug, rent $500") == [("May - Aug", "availability", 1)]
    assert roles("Rent $500 May - Aug, available") == [("May - Aug", "availability", 2)]  # the closest on any side
    assert roles("The price May - Aug is special and it is available") == [("May - Aug", "pricing", 1)]
    assert roles("Rent is $500. May - Aug. Monthly") == [("May - Aug", "availability", None)]
    assert roles("we like May to Aug here") == [("May to Aug", "ambiguous", None)]
    assert roles("Price: May until June") == [("May until June", "pricing", 2)]  # a label before the colon
    assert roles("available " + "x " * 50 + "Jan - Feb") == [("Jan - Feb", "ambiguous", None)]  # beyond the window
    assert roles("available Jan - Feb; rent Mar through Apr\nterm, Sept 1 to Dec 31") == [("Jan - Feb", "availability", 1), ("Mar through Apr", "pricing", 1), ("Sept 1 to Dec 31", "availability", 2)]


def naive_roles(text):
    """Every question asked of every character."""
    out = []
    for m in re.finditer(E.RANGE, text, re.I | re.A):
        begin = m.start()
        while begin and text[begin - 1] not in ".!?;:\r\n":
            begin -= 1
        end = m.end()
        while end < len(text) and text[end] not in ".!?;:\r\n":
            end += 1
        first = max(begin - 48, 0) if begin and text[begin - 1] == ":" else begin
        first, last = max(first, m.start() - 96), min(end, m.end() + 96)
        sides = {}
        for name, pattern in (("availability", E.AVAILABILITY), ("pricing", E.PRICING)):
            spans = [(s.start() + first, s.end() + first) for s in re.finditer(pattern, text[first:last], re.I | re.A)]
            sides[name] = [m.start() - b for _, b in spans if b <= m.start()], [max(0, a - m.end()) for a, b in spans if b > m.start()]
        (fl, fr), (pl, pr) = sides["availability"], sides["pricing"]
        far = 10**9
        if fl and min(fl) <= min(pl, default=far):
            out.append((m[0], "availability", min(fl)))
        elif fl + fr and min(fl + fr) <= min(pl + pr, default=far):
            out.append((m[0], "availability", min(fl + fr)))
        elif pl + pr:
            out.append((m[0], "pricing", min(pl + pr)))
        else:
            out.append((m[0], "ambiguous" if re.search(r"\w", text[begin : m.start()] + text[m.end() : end]) else "availability", None))
    return out


def test_roles_of_random_texts():
    rng = random.Random(8)
    words = ["available", "rent", "$5", "monthly", "lease", "May - Aug", "Jan to Feb", "house", ".", ":", ";", "\n", "x" * 40, ",", "2 bedrooms", "/month", "été"]
    for _ in range(3000):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(25)))
        assert roles(text) == naive_roles(text)


def test_rows(spark):
    long = "word. " * 200_000 + "fully furnished"
    rows = spark.createDataFrame([(1, "sublet", "v"), (1, "sublet", "v"), (None, "May - June", "v"), (2, None, "v"), (3, "", "v"), (4, long, "v")], "id long, text string, value string")
    got = [(r.id, r.field, r.value, r.supporting[0].start, r.supporting[0].sentence) for r in E.explicit_text_values(rows, "id", "text").collect()]
    assert got == [(1, "is_sublet", "true", 0, 0)] * 2 + [(4, "furnished", "true", 1_200_000, 200_000)]
    assert [tuple(r) for r in E.context_roles(rows, "id", "text").collect()] == [(None, 0, 10, "May - June", "availability", None)]
    assert E.context_roles(rows.where("false"), "id", "text").collect() == []


def test_rows_leave_before_a_batch_is_read(spark, monkeypatch):
    """Texts with many places: no task holds those of a whole batch, and the rows are the same."""
    rows = spark.range(40, numPartitions=1).select("id", F.when(F.col("id") % 4 != 0, F.repeat(F.lit("sublet. May - June. "), 50)).alias("text")).cache()
    want = sorted((r.id, r.field, len(r.supporting)) for r in E.explicit_text_values(rows, "id", "text").collect())
    assert want == [(i, "is_sublet", 50) for i in range(40) if i % 4]
    monkeypatch.setattr(E, "HELD", 60)
    sizes = []
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array([r.text for r in rows.orderBy("id").collect()])], ["id", "text"])
    for one in E._batches(E.explicit_values, to_arrow_schema(spark.createDataFrame([], f"id long, {E.EXPLICIT}").schema))([batch]):
        sizes.append((one.num_rows, one.column(0).to_pylist()))
    assert [n for n, _ in sizes] == [2] * 15 and [i for _, ids in sizes for i in ids] == [i for i in range(40) if i % 4]
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= E.BATCH_ROWS
