"""Each operator against brute force, and on nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import itertools
import math
import random
import re
import textwrap
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewell.llm import kernel, kneser_ney, language_id, license_scan, line_chunk_dedup, minhash_dedup, pareto_mix, rule_cascade, url_filter, warc_revisit, winnow_decontam
from tidewell.llm.graph import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def corpus(seed=1, n=60):
    """Random texts with exact and near copies, blank, null and short ones."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["Über", "naïve", "東京", "a"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 20, 80, 200]))) for _ in range(n)]
    for i in range(0, n, 4):
        words = texts[rng.randrange(len(texts))].split(" ")
        for _ in range(len(words) // 40):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts.append(" \n".join(words))
    return [*texts, texts[0].upper(), texts[1], "", None, "  \t\n", "x" * 5000]


def documents(spark, texts, **extra):
    rows = [(i, t, *(v for v in extra.values())) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string" + "".join(f", {c} string" for c in extra))


def sets_of(text, k):
    words = WORD.findall(lower(text))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def components(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute_groups(texts, k, percent=80):
    sets = {i: sets_of(t, k) for i, t in enumerate(texts)}
    linked = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return sets, components(linked, sets)


def test_kernel_spans_match_regex():
    texts = corpus(3)
    for _, _, data, offs in kernel.slices(pa.array(texts)):
        starts, ends, first = kernel.word_spans(data, offs, kernel.NON_SPACE)
        for i, t in enumerate(texts):
            own = [bytes(data[a:b]).decode() for a, b in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]], strict=True)]
            assert own == WORD.findall(t or "")


def test_connected_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (5, 5), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("block", [200_000, 50])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(minhash_dedup, "BLOCK_SHINGLES", block)
    texts = corpus()
    sets, group = brute_groups(texts, 4)
    docs = documents(spark, texts, hub="h", key="k", signature="s", component_id="c")
    rows = minhash_dedup.near_duplicates(docs, shingle=4).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), group[r.doc_id], group[r.doc_id] == r.doc_id)


def test_near_duplicates_edges(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (None, "z y x"), (9, None)], "doc_id long, text string")
    rows = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(docs).collect()), key=str)
    assert rows == sorted([(None, 7, False), (7, 7, True), (7, 7, True), (None, None, True), (9, 9, True)], key=str)
    assert minhash_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_license_scan(spark):
    texts = ["RELEASED under the mit licence!", "Intro\nCopyright 2020 X\nReleased under the MIT License.\nAll rights reserved", "licensed under cc by 4.0", None, "", "...", "Copyright (c) 1999 A\nReleased   under the MIT\nlicense"]
    rows = {r.doc_id: r for r in license_scan.scan_licenses(documents(spark, texts, digest="d", line="l")).collect()}
    assert [rows[i].license for i in range(7)] == ["MIT", None, "CC-BY-4.0", None, None, None, "MIT"]
    assert list(rows[1].line_licenses) == ["MIT", "all-rights-reserved"] and rows[1].n_license_lines == 2
    assert rows[4].digest is None and rows[5].digest is None
    again = spark.createDataFrame([(1, "Released under the MIT License."), (1, "Released under the MIT License."), (None, "x")], "doc_id long, text string")
    assert sorted(r.n_license_lines for r in license_scan.scan_licenses(again).collect()) == [0, 1, 1]
    assert license_scan.scan_licenses(again.limit(0)).count() == 0


def test_license_scan_knows_entire_texts_however_wrapped(spark):
    head, names, texts = "Copyright (c) 2020, A. Holder <a@b.org>\nCopyright The Other Authors\n\n", [], []
    for name, titles, bodies in license_scan.TEXTS:
        for body in bodies:
            for width in (20, 33, 60, 72, 79, 1000):
                names.append(name)
                texts.append("\n".join(titles[:1]) + "\n\n" + head + "\n\n".join(textwrap.fill(x, width, break_long_words=False) for x in body) + "\n")
    assert any(x.lower().startswith("copyright notice") for t in texts for x in t.split("\n"))
    rows = {r.doc_id: r for r in license_scan.scan_licenses(documents(spark, texts)).collect()}
    assert [rows[i].license for i in range(len(texts))] == names
    changed = {r.license for r in license_scan.scan_licenses(documents(spark, [t + "\nand more" for t in texts])).collect()}
    assert changed == {None}


def test_license_scan_drops_only_statements_and_takes_a_table(spark):
    kept = ["copyright notice, this list", "COPYRIGHT HOLDERS OR CONTRIBUTORS BE LIABLE", "(c) You must retain all notices", "copyright, patent and trademark notices"]
    gone = ["Copyright 2020 X", "Copyright: (C) X", "# Copyright X Inc.", "© X", "(c) 1999 X", "(c) X Inc.", "Copyright [yyyy] [name of copyright owner]"]
    rows = [(i, f"begin\n{t}\nend") for i, t in enumerate([*kept, *gone])] + [(90, "begin end"), (91, "Some house licence,\nof two lines.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    more = spark.createDataFrame([("House", "Some house license of two lines"), ("Other", "Released under the MIT License."), (None, "begin end"), ("Null", None)], "license string, text string")
    for limit in (license_scan.BROADCAST_KNOWN, 0):
        before, license_scan.BROADCAST_KNOWN = license_scan.BROADCAST_KNOWN, limit
        try:
            got = {r.doc_id: r for r in license_scan.scan_licenses(docs.union(spark.createDataFrame([(92, "released under the mit license")], docs.schema)), more=more).collect()}
        finally:
            license_scan.BROADCAST_KNOWN = before
        assert [got[i].digest == got[90].digest for i in range(len(kept + gone))] == [False] * len(kept) + [True] * len(gone)
        assert (got[90].license, got[91].license, got[92].license) == (None, "House", "MIT")


def classes(text):
    return [ord(c) for c in text.lower()]


def brute_kneser_ney(texts):
    """Log probability function of an interpolated modified Kneser-Ney model of order 4."""
    order = kneser_ney.ORDER
    tables = {order: Counter()}
    for t in texts:
        s = [0] * (order - 1) + classes(t)
        for i in range(len(s) - order + 1):
            tables[order][tuple(s[i : i + order])] += 1
    for n in range(order - 1, 0, -1):
        tables[n] = Counter(g[1:] for g in tables[n + 1])
    cuts, totals = {}, {}
    for n, table in tables.items():
        t = [sum(v == i for v in table.values()) for i in range(5)]
        y = t[1] / max(t[1] + 2 * t[2], 1)
        cuts[n] = [min(max(i - (i + 1) * y * t[i + 1] / max(t[i], 1), 0.1), i - 0.1) for i in (1, 2, 3)]
        totals[n] = defaultdict(list)
        for g, v in table.items():
            totals[n][g[:-1]].append(v)

    def p(g):
        n = len(g)
        if n == 0:
            return 1 / (len(tables[1]) + 1)
        seen = totals[n].get(g[:-1])
        if not seen:
            return p(g[1:])
        d = cuts[n]
        cut = lambda v: d[min(v, 3) - 1]
        v = tables[n].get(g, 0)
        return max(v - cut(v), 0) / sum(seen) * (v > 0) + sum(cut(v) for v in seen) / sum(seen) * p(g[1:]) if v else sum(cut(v) for v in seen) / sum(seen) * p(g[1:])

    return p


def test_perplexity_equals_brute_force(spark):
    rng = random.Random(5)
    make = lambda: " ".join(rng.choice(["the", "cat", "sat", "on", "Mats,", "é3!"]) for _ in range(rng.randrange(3, 30)))
    trusted, others = [make() for _ in range(12)], [make() for _ in range(5)] + ["zzz qqq ###", "東京 x"]
    p = brute_kneser_ney(trusted)
    model = kneser_ney.fit_kneser_ney(spark.createDataFrame([("en", t) for t in trusted] + [(None, "x"), ("en", None)], "lang string, text string"))
    rows = [(i, "en", t) for i, t in enumerate([*trusted, *others])] + [(98, "fr", "le chat"), (99, "en", None), (None, None, "x")]
    got = {r.doc_id: r for r in kneser_ney.score_perplexity(spark.createDataFrame(rows, "doc_id long, lang string, text string"), model).collect()}
    assert len(got) == len(rows) and got[98].perplexity is None and got[99].perplexity is None and got[None].perplexity is None
    for i, _, t in rows[:-3]:
        s = [0] * 3 + classes(t)
        want = math.exp(-sum(math.log(p(tuple(s[j : j + 4]))) for j in range(len(s) - 3)) / (len(s) - 3))
        assert got[i].n_grams == len(t) and got[i].perplexity == pytest.approx(want, rel=1e-4)
    size = kneser_ney.CHUNK_BYTES
    kneser_ney.CHUNK_BYTES = 100
    try:
        again = {r.doc_id: r.perplexity for r in kneser_ney.score_perplexity(spark.createDataFrame(rows, "doc_id long, lang string, text string"), model).collect()}
    finally:
        kneser_ney.CHUNK_BYTES = size
    assert again == {k: r.perplexity for k, r in got.items()}


def test_quality_keeps_clean_and_rejects_noise(spark):
    rng = random.Random(2)
    clean = [" ".join(rng.choice(["the", "old", "house", "stands", "by", "a", "river"]) for _ in range(60)) for _ in range(40)]
    noise = ["".join(chr(rng.randrange(33, 126)) for _ in range(300)) for _ in range(5)]
    docs = spark.createDataFrame([(i, t, "en", "x") for i, t in enumerate(clean + noise)] + [(None, "zz", None, "x"), (77, None, "en", "x")], "doc_id long, text string, lang string, perplexity string")
    out = {r.doc_id: r.kept for r in kneser_ney.classify_quality(docs, docs.where("doc_id < 40")).collect()}
    assert all(out[i] for i in range(40)) and not any(out[40 + i] for i in range(5)) and out[None] and out[77]
    assert kneser_ney.classify_quality(docs.limit(0), docs.limit(0)).count() == 0


def quality_verdicts(scored, trusted):
    """Threshold and verdicts by id from (perplexity, n_grams, held_out) by id, for one language."""
    at = lambda values, q: sorted(values)[math.ceil(q * len(values)) - 1]
    basis = [i for i in trusted if scored[i][2]]
    if not basis:
        return None, {i: True for i in scored}
    median = at([scored[i][0] for i in basis], 0.5)
    score = {i: median + (p - median) / (1 + 20 / math.sqrt(n)) for i, (p, n, _) in scored.items()}
    limit = at([score[i] for i in basis], 0.99)
    return limit, {i: x <= limit * (1 + 1e-9) for i, x in score.items()}


def test_quality_threshold_is_the_quantile_of_held_out_scores(spark):
    rng = random.Random(2)
    say = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    clean = [say(["the", "old", "house", "stands", "by", "a", "river"], rng.randrange(5, 80)) for _ in range(300)]
    mixed = [say(["the", "old", "house", "huosk", "vstan", "qyb"], 60) for _ in range(10)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(clean + mixed)], "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in kneser_ney.classify_quality(docs, docs.where("doc_id < 300")).collect()}
    held = {r.doc_id: r.h for r in docs.select("doc_id", kneser_ney.held_out(F.col("text")).alias("h")).collect()}
    assert 20 < sum(held[i] for i in range(300)) < 120
    p = brute_kneser_ney([clean[i] for i in range(300) if not held[i]])
    for i in (*range(0, 300, 37), 305):
        s = [0] * 3 + classes((clean + mixed)[i])
        assert out[i].perplexity == pytest.approx(math.exp(-sum(math.log(p(tuple(s[j : j + 4]))) for j in range(len(s) - 3)) / (len(s) - 3)), rel=1e-4)
    limit, kept = quality_verdicts({i: (r.perplexity, r.n_grams, held[i]) for i, r in out.items()}, range(300))
    for i, r in out.items():
        assert r.threshold == pytest.approx(limit) and r.kept == kept[i]
    assert not any(out[i].kept for i in range(300, 310))


LONG = 3 * kernel.SLICE_BYTES


def test_long_texts(spark):
    """A text of several slices is judged as a whole by every operator that slices."""
    rng = random.Random(12)
    words = [f"wörd{i}" for i in range(5000)]
    long = " ".join(rng.choice(words) for _ in range(LONG // 8))
    long += "\nend " * 3
    short = " ".join(rng.choice(words) for _ in range(50))
    docs = spark.createDataFrame([(1, long, "en"), (2, short, "en"), (3, long + " tail", "en"), (4, None, "en")], "doc_id long, text string, lang string")
    sets, _ = brute_groups([long], 5)
    near = {r.doc_id: r for r in minhash_dedup.near_duplicates(docs).collect()}
    assert near[1].n_shingles == len(sets[0]) and near[3].component_id == 1 and near[2].component_id == 2
    measured = {r.doc_id: r for r in rule_cascade.rule_cascade(docs).collect()}
    assert (measured[1].n_words, measured[1].word_chars) == brute_measures(long)[:2]
    langs = {r.doc_id: r for r in language_id.identify_languages(docs, language_id.fit_language_model(docs)).collect()}
    assert langs[1].lang_pred == "en" and langs[1].score == 1
    model = language_id.fit_language_model(docs.where("doc_id = 1"))
    want = brute_counts(long)
    total = sum(want.values()) + language_id.ALPHA * 2**language_id.BITS
    for bucket in sorted(want)[::50]:
        assert math.exp(model[2][0][bucket]) == pytest.approx((want[bucket] + language_id.ALPHA) / total, rel=1e-4)
    scored = {r.doc_id: r for r in kneser_ney.score_perplexity(docs, kneser_ney.fit_kneser_ney(docs.where("doc_id = 2").select("lang", "text"))).collect()}
    assert scored[1].n_grams == len(long) and scored[4].perplexity is None
    item = " ".join(long.split(" ")[-40:-20])
    leaks = {r.doc_id: r for r in winnow_decontam.find_leaks(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert list(leaks[1].item_ids) == ["7"] and leaks[1].n_hit >= 20 and leaks[2].n_hit == 0
    left = {r.doc_id: r for r in line_chunk_dedup.remove_repeated_chunks(docs).collect()}
    assert left[1].text == long and left[3].n_removed > 0
    assert {r.doc_id for r in license_scan.scan_licenses(docs).collect()} == {1, 2, 3, 4}


def test_near_duplicates_of_repeated_ids(spark):
    rng = random.Random(13)
    a, b = (" ".join(rng.choice("abcdefgh") + str(rng.randrange(90)) for _ in range(120)) for _ in range(2))
    docs = spark.createDataFrame([(5, a), (5, b), (7, a + " x"), (9, b + " y"), (11, a), *((1000 + i, "" if i % 2 else None) for i in range(20_000))], "doc_id long, text string")
    rows = [(r.doc_id, r.component_id) for r in minhash_dedup.near_duplicates(docs, keep=["text"]).where("doc_id < 100").collect()]
    assert sorted(rows) == [(5, 5), (5, 5), (7, 5), (9, 5), (11, 5)]
    assert minhash_dedup.near_duplicates(docs).where("doc_id >= 1000 and component_id = doc_id and kept").count() == 20_000


def test_near_copies_without_id(spark):
    """Rows without id link and carry links like others; a component without any id keeps one text."""
    words = [f"w{i}" for i in range(100)]
    a = " ".join(words)
    near = [a, a + " x", a + " y z", " ".join(words[:96])]
    other = " ".join(f"v{i}" for i in range(60))
    docs = spark.createDataFrame([(1, near[0]), (None, near[1]), (None, near[2]), (None, other), (None, other + " t"), (None, other), (None, other.upper()), (None, "alone"), (None, None)], "doc_id long, text string")
    rows = minhash_dedup.near_duplicates(docs.withColumn("t", F.col("text")), keep=["t"]).collect()
    assert sorted((r.t, r.component_id, r.kept) for r in rows if r.t in near) == sorted([(near[0], 1, True), (near[1], 1, False), (near[2], 1, False)])
    kept = [r.t for r in rows if r.component_id is None and r.kept]
    assert None in kept and "alone" in kept and len({t for t in kept if t not in (None, "alone")}) == 1  # repeats of the one text stay
    # a chain through rows without id joins what is far apart
    steps = [" ".join(words[i : i + 60]) for i in range(0, 25, 4)]
    docs = spark.createDataFrame([(5 if i == 0 else 3 if i == len(steps) - 1 else None, t) for i, t in enumerate(steps)], "doc_id long, text string")
    assert {(r.doc_id, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(docs).collect()} == {(5, 3, False), (3, 3, True), (None, 3, False)}


def test_a_class_with_another_text_is_an_error():
    table = pa.table({"text": ["a b c d e f"], "cls": pa.array([b"x" * 16], pa.binary()), "signature": pa.array([bytes(128)], pa.binary())})
    with pytest.raises(ValueError, match="another's text"):
        minhash_dedup._Members(table, 5, lambda c: c)


def test_near_duplicates_recall_at_the_threshold(spark, monkeypatch):
    """Thousands of pairs whose similarity is just at or under 0.8: every link is found, no other."""
    monkeypatch.setattr(minhash_dedup, "BLOCK_SHINGLES", 20_000)
    rng = random.Random(14)
    texts, want = [], []
    for i in range(2000):
        n = rng.randrange(90, 120)
        words = [f"w{i}x{j}" for j in range(n)]
        texts.append(" ".join(words))
        cut = round((n - 4) / 9) + rng.choice([-1, 0, 0, 1])  # its last words replaced: similarity (m - cut) / (m + cut) of m shingles
        texts.append(" ".join(words[: n - cut] + [f"v{i}x{j}" for j in range(cut)]))
        m = n - 4
        want += [2 * i, 2 * i if 100 * (m - cut) >= 80 * (m + cut) else 2 * i + 1]
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want and 500 < sum(i % 2 and c < i for i, c in got.items()) < 1900


def brute_measures(text):
    words = WORD.findall(text or "")
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {j for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in rule_cascade.SYMBOLS for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_rule_cascade_measures_and_order(spark):
    rng = random.Random(4)
    texts = corpus(9) + ["\n".join(rng.choice(["a b c", "x # y", "", " "]) for _ in range(30)) for _ in range(10)] + [("one two three four five six seven eight " * 4), "AB CD " * 30, "w& " * 40, "\na\n\na\n"]
    docs = documents(spark, texts, kept="k", failed_rule="f")
    rows = {r.doc_id: r for r in rule_cascade.rule_cascade(docs).collect()}
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_measures(t)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
    back = {r.doc_id: r.kept for r in rule_cascade.rule_cascade(docs, rules=rule_cascade.RULES[::-1]).collect()}
    assert back == {i: r.kept for i, r in rows.items()}
    assert rule_cascade.rule_cascade(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "a"), (1, None), (1, None)], "doc_id long, text string")
    assert rule_cascade.rule_cascade(odd).where("base_failed and not kept").count() == 3


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/1", "same"), (2, None, "same"), (3, "http://a/3\r\nX: y", "same"), (4, "u", None), (5, "u", ""), (6, "u", "é\r\n\r\nWARC/1.1 fake"), (None, "u", "same"), (None, "u", "alone"), (8, "u", "twice"), (8, "u", "twice")]
    pages = spark.createDataFrame([(*r, "d", 0) for r in rows], "page_id long, url string, html string, digest string, salt int")
    for name, compression, least in (("a", "gzip", 0), ("b", "none", 0), ("c", "gzip", 5)):
        path = f"{tmp_path}/{name}"
        warc_revisit.write_archives(pages, path, compression=compression, least_bytes=least)
        records = warc_revisit.read_archives(spark, path)
        assert records.where("digest_ok = false").count() == 0
        bodies = {r.page_id: r.payload.decode() for r in records.where("record_type = 'response' and page_id is not null").collect()}
        assert bodies[6] == rows[5][2]
        got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc_revisit.resolve_revisits(records).collect()), key=str)
        want = []
        for page, _, html in rows:
            body = (html or "").encode()
            newest = max((p for p, _, h in rows if (h or "") == (html or "") and p is not None), default=None)
            first = len(body) < least or newest is None or page == newest
            import base64

            want.append((page, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if first else "revisit", None if first else newest))
        assert got == sorted(want, key=str)
    warc_revisit.write_archives(pages.limit(0), f"{tmp_path}/none")
    assert warc_revisit.resolve_revisits(warc_revisit.read_archives(spark, f"{tmp_path}/none")).count() == 0


def test_language_id(spark):
    words = {"en": ["the", "house", "with", "thing"], "de": ["der", "haus", "mit", "über"], "fr": ["le", "maison", "avec", "été"]}
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(words[x]) for _ in range(8)), x) for i, x in enumerate(list(words) * 30)]
    train = spark.createDataFrame([*rows[:60], (900, "zz", None), (901, None, "en")], "doc_id long, text string, lang string")
    model = language_id.fit_language_model(train)
    assert model[0] == ["de", "en", "fr"]
    odd = [(1000, None, "x"), (1001, "12 !?", "x"), (1002, "", "x"), (None, "the house", "x")]
    test = spark.createDataFrame([*rows[60:], *odd], "doc_id long, text string, score string")
    got = {r.doc_id: r for r in language_id.identify_languages(test, model).collect()}
    assert all(got[i].lang_pred == x for i, _, x in rows[60:]) and all(0 <= r.score <= 1 for r in got.values())
    assert [got[i].lang_pred for i in (1000, 1001, 1002, None)] == ["und", "und", "und", "en"] and got[1000].score == 0
    none = language_id.fit_language_model(train.limit(0))
    assert {r.lang_pred for r in language_id.identify_languages(test, none).collect()} == {"und"}
    assert language_id.identify_languages(test.limit(0), model).count() == 0


def brute_counts(text):
    out = Counter()
    points = [ord(c) for c in text.lower()]
    for n in language_id.ORDERS:
        for i in range(len(points) - n + 1):
            h = int(kernel._STEP[40 + n])
            for j in range(n):
                h = (h + points[i + j] * int(kernel._STEP[j])) % 2**64
            h ^= h >> 32
            out[h * int(kernel._STEP[50]) % 2**64 >> (64 - language_id.BITS)] += 1
    return out


def test_language_model_counts_equal_brute_force(spark):
    texts = ["Ab é", "", "x", "Äöü yz 東京", "Ab é"]
    _, _, table = language_id.fit_language_model(spark.createDataFrame([("a", t) for t in texts], "lang string, text string"))
    want = sum((brute_counts(t) for t in texts), Counter())
    total = sum(want.values()) + language_id.ALPHA * 2**language_id.BITS
    for bucket, n in want.items():
        assert math.exp(table[0][bucket]) == pytest.approx((n + language_id.ALPHA) / total, rel=1e-4)


def test_language_scores_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(language_id, "BLOCK", 7)
    rng = random.Random(3)
    letters = {"a": "abcde ", "b": "cdefg ", "c": "ßéf東 "}
    make = lambda x: "".join(rng.choice(letters[x]) for _ in range(rng.randrange(1, 30)))
    train = [(x, make(x)) for x in "aabbbc" * 5]
    asked = [make(x) for x in "abc" * 6] + ["A", "zz9"]
    model = language_id.fit_language_model(spark.createDataFrame(train, "lang string, text string"))
    got = {r.doc_id: r for r in language_id.identify_languages(documents(spark, asked), model).collect()}
    counts = {x: sum((brute_counts(t) for y, t in train if y == x), Counter()) for x in "abc"}
    for i, text in enumerate(asked):
        log = {}
        for x, seen in counts.items():
            total = sum(seen.values()) + language_id.ALPHA * 2**language_id.BITS
            log[x] = math.log(sum(y == x for y, _ in train) / len(train)) + sum(n * math.log((seen[b] + language_id.ALPHA) / total) for b, n in brute_counts(text).items())
        best = max(log, key=log.get)
        assert got[i].lang_pred == best and got[i].score == pytest.approx(1 / sum(math.exp(v - log[best]) for v in log.values()), rel=1e-3)


RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def test_url_filter(spark):
    cases = [
        ("https://a.Example.ORG/es/x?y", "a.example.org", "/es/x", "example.org/es/", "block"), ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
        ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"), ("http://x.com#/de/", "x.com", "", None, "allow"), ("http://x.com/de/", "x.com", "/de/", "com/de/", "block"),
        ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"), ("http://", "", "", None, "allow"), ("a://b://c/d", "b:", "//c/d", None, "allow"), ("http://org", "org", "", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, c[0], "r") for i, c in enumerate(cases)] + [(None, cases[0][0], "r")], "page_id long, url string, rule string")
    got = {r.page_id: r for r in url_filter.filter_urls(pages, RULES).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(cases):
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict)
    assert got[None].verdict == "block" and url_filter.filter_urls(pages.limit(0), RULES).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(pages, [], otherwise="block").collect()} == {"block"}


def test_url_index_confirms_strings(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda k: len(k))  # every key of a length collides
    url_filter.write_index([("block", "aa", ""), ("allow", "bb", ""), ("block", "bb", "")], f"{tmp_path}/i")
    index = url_filter.DigestIndex(f"{tmp_path}/i")
    found = index.probe([b"aa", b"bb", b"cc", b"a"])
    assert [index.string(i) if i >= 0 else None for i in found] == [b"aa", b"bb", None, None] and index.blocks[found[1]] == 1


def brute_leaks(text, items):
    words = ALNUM.findall(lower(text))
    hit, found = set(), set()
    for item, body in items:
        own = ALNUM.findall(lower(body))
        n = min(10, len(own))
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(words), len(hit), sorted(found)


def test_leaks_equal_brute_force_on_both_paths(spark):
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(40)] + ["é", "東"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([2, 5, 9, 10, 14, 30])))) for i in range(25)] + [(40, ""), (41, "a a a a a a a a a a a")]
    texts = []
    for _ in range(40):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([0, 4, 12, 60]))]
        for _ in range(rng.randrange(3)):
            own = rng.choice(items)[1].split()
            start = rng.randrange(max(1, len(own) - 9))
            at = rng.randrange(len(words) + 1)
            words[at:at] = own[start : start + rng.choice([9, 10, 11, 40])]
        texts.append(", ".join(words).upper())
    texts += [None, "", "a " * 30]
    docs = documents(spark, texts, mark="m", item_id="i", n_hit="n")
    bench = spark.createDataFrame([*items, (None, "v1 v2"), (99, None), (0, items[0][1])], "item_id long, text string")
    for limit in (winnow_decontam.BROADCAST_BYTES, 0):
        rows = {r.doc_id: r for r in winnow_decontam.find_leaks(docs, bench, broadcast_bytes=limit).collect()}
        assert len(rows) == len(texts)
        for i, t in enumerate(texts):
            assert (rows[i].n_words, rows[i].n_hit, list(rows[i].item_ids)) == brute_leaks(t, items)
            assert sum(s["last"] - s["first"] + 1 for s in rows[i].spans) == rows[i].n_hit
    assert winnow_decontam.find_leaks(docs.limit(0), bench).count() == 0
    assert winnow_decontam.find_leaks(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_mix(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["a", "b", "c", "d", None]) if i % 3 else "hot", "w " * rng.randrange(1, 60)) for i in range(900)] + [(None, "a", "x y"), (5000, "a", None), (5001, "tiny", "one"), (5001, "tiny", "one")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("rest", F.lit(1)).withColumn("cell", F.lit(1))
    out = pareto_mix.mix_sources(docs).collect()
    assert len(out) == len(rows) and sorted(map(str, out)) == sorted(map(str, pareto_mix.mix_sources(docs.repartition(3)).collect()))
    sizes, targets, taken = Counter(), {}, Counter()
    for r in out:
        sizes[r.source] += r.size
        targets[r.source] = r.target
        taken[r.source] += r.taken
        assert r.taken <= 3 * r.size and r.taken == r.copies * r.size
    total, names = sum(sizes.values()), sorted((s for s in sizes if s), key=lambda s: s) + [None]
    weights = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    open_, want = set(names), {}
    while True:  # cap, share the excess anew, until none is above
        left = total - sum(want.values())
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            want |= share
            break
        for s in over:
            want[s] = 3 * sizes[s]
            open_.discard(s)
    for s in names:
        assert targets[s] == pytest.approx(want[s]) and abs(taken[s] - targets[s]) <= 60
    assert pareto_mix.mix_sources(docs.limit(0)).count() == 0
    assert {r.taken for r in pareto_mix.mix_sources(docs.withColumn("text", F.lit(None).cast("string"))).collect()} == {0}


def brute_chunks(text):
    """(first line, end) of the chunks that aren't blank."""
    lines = text.split("\n")
    turns = [ord(hashlib.md5(x.encode()).hexdigest()[0]) % 4 for x in lines]
    long = lambda i: len(lines[i]) >= line_chunk_dedup.LONG_LINE
    chunks, start, rolling = [], 0, 0
    for i in range(len(lines)):
        rolling = 2 * rolling + turns[i]
        if i == len(lines) - 1 or long(i) or long(i + 1) or rolling & 3:
            if any(x.strip(" ") for x in lines[start : i + 1]):
                chunks.append((start, i + 1))
            start = i + 1
    return chunks


def brute_line_dedup(rows):
    """What is left of each (id, text), in order of id: (text, lines removed)."""
    lines = {i: t.split("\n") for i, t in rows}
    places = defaultdict(list)
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        for a, b in brute_chunks(t):
            places[tuple(lines[i][a:b])].append((i, a, b))
    found = defaultdict(set)
    for (o, oa, ob), *again in places.values():
        for i, a, b in again:
            up = down = 0
            while up < line_chunk_dedup.REACH and a > up and oa > up and lines[i][a - up - 1] == lines[o][oa - up - 1]:
                up += 1
            while down < line_chunk_dedup.REACH and b + down < len(lines[i]) and ob + down < len(lines[o]) and lines[i][b + down] == lines[o][ob + down]:
                down += 1
            found[i, o, a - oa] |= set(range(a - up, b + down))
    gone = defaultdict(set)
    for (i, _, _), own in found.items():
        for a in sorted(own):
            if a - 1 in own:
                continue
            b = a
            while b in own:
                b += 1
            run = lines[i][a:b]
            if sum(x.strip(" ") != "" for x in run) > 1 or len("\n".join(run)) >= line_chunk_dedup.LONG_LINE:
                gone[i] |= set(range(a, b))
    return {i: ("\n".join(x for n, x in enumerate(own) if n not in gone[i]), len(gone[i])) for i, own in lines.items()}


def test_planted_passages_go(spark):
    """Passages of 60 words over some lines, set between other lines of two documents: how many go whole."""
    rng = random.Random(15)
    say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    for n, least in ((1, 1), (2, 0.3), (3, 0.6), (4, 0.8), (6, 0.95)):
        texts = []
        for _ in range(60):
            passage = [say(60 // n) for _ in range(n)]
            texts += ["\n".join([*(say(12) for _ in range(5)), *passage, *(say(12) for _ in range(5))]) for _ in range(2)]
        left = {r.doc_id: r.n_removed for r in line_chunk_dedup.remove_repeated_chunks(documents(spark, texts)).collect()}
        assert all(left[i] == 0 for i in range(0, 120, 2)) and set(left.values()) <= {0, n}
        assert sum(left[i] == n for i in range(1, 120, 2)) >= least * 60, (n, sum(left[i] == n for i in range(1, 120, 2)))


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(3)
    lines = [f"line {i}" for i in range(40)] + ["", "  ", "L" * 300, "é" * 260]
    passage = [rng.choice(lines) for _ in range(8)]
    texts = []
    for _ in range(60):
        body = [rng.choice(lines) for _ in range(rng.randrange(0, 12))]
        if rng.random() < 0.5:
            at = rng.randrange(len(body) + 1)
            body[at:at] = passage
        texts.append("\n".join(body))
    texts += [texts[3], None, "", "\n", "a\n" * 400]
    docs = documents(spark, texts, ks="k", digest="d", marks="m")
    got = {r.doc_id: r for r in line_chunk_dedup.remove_repeated_chunks(docs, keep=["marks"]).collect()}
    left = brute_line_dedup([(i, t) for i, t in enumerate(texts) if t is not None])
    for i, t in enumerate(texts):
        want = (None, 0, 0) if t is None else (left[i][0], t.count("\n") + 1, left[i][1])
        assert (got[i].text, got[i].n_lines, got[i].n_removed) == want
    assert sum(n for _, n in left.values()) > 200


def test_line_dedup_edges(spark):
    long = "\n".join("x" * 300 + str(i) for i in range(3))
    docs = spark.createDataFrame([(1, long, "a"), (1, long, "b"), (None, long, "c"), (2, None, "d")], "doc_id long, text string, lang string")
    rows = sorted((str(r.doc_id), r.n_removed, r.kept.lang) for r in line_chunk_dedup.remove_repeated_chunks(docs, keep=["lang"]).collect())
    assert rows == [("1", 3, "a"), ("1", 3, "b"), ("2", 0, "d"), ("None", 0, "c")]
    assert line_chunk_dedup.remove_repeated_chunks(docs.limit(0)).count() == 0
