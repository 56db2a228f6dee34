"""The pipeline's stages on small tables, each against brute force on its own input."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from test_llm_operators import brute_groups, brute_kneser_ney, brute_leaks, brute_line_dedup, classes, quality_verdicts

import corpus_pipeline
from tidewell.llm import kneser_ney

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(11)
    words = [f"{a}{b}" for a in ("ta", "re", "mo", "li", "su") for b in ("n", "ka", "ver", "st", "")]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    bench = [(i, say(25)) for i in range(6)]
    passage = "\n".join(say(45) for _ in range(6))
    texts = ["\n".join(say(rng.randrange(8, 40)) for _ in range(rng.randrange(1, 6))) for _ in range(70)]
    texts += [texts[0], texts[1], texts[2] + " end", "\n".join([texts[3], passage]), "\n".join([texts[4], passage, texts[5]])]
    texts += [say(10) + " " + bench[1][1] + " " + say(10), bench[2][1][:90], "#" * 40 + "~{}" * 80, "".join(chr(33 + i * 7 % 90) for i in range(400)), None, "", "x"]
    rows = [(i, t, rng.choice(["en", "de"]) if i % 9 else None, f"s{i % 4}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([*rows, (None, say(30), "en", "s1", 1)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(61, 1, 1), (62, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


@pytest.fixture(scope="module")
def states(spark, tables, tmp_path_factory):
    """The rows before and after each stage."""
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    out = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage")) + "/o"
        stage(spark, docs, tables).write.parquet(path)
        docs = spark.read.parquet(path)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == COLUMNS
        out.append(docs.collect())
    return out


def by_id(rows):
    return {r.doc_id: r for r in rows if r.doc_id is not None}


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "minhash near-dedup", "benchmark decontamination", "source mixing"]


def test_quality(spark, tables, states):
    before, after = by_id(states[0]), by_id(states[1])
    held = {r.doc_id: r.h for r in spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", kneser_ney.held_out(F.col("text")).alias("h")).collect()}
    trusted = defaultdict(list)
    for i in range(60):
        if before[i].lang and before[i].text:
            trusted[before[i].lang].append(i)

    def perplexity(p, text):
        s = [0] * 3 + classes(text)
        return math.exp(-sum(math.log(p(tuple(s[j : j + 4]))) for j in range(len(s) - 3)) / (len(s) - 3))

    for lang, ids in trusted.items():
        p = brute_kneser_ney([before[i].text for i in ids if not held[i]])
        scored = {i: (perplexity(p, r.text), len(r.text), held[i]) for i, r in before.items() if r.lang == lang and r.text}
        for i, kept in quality_verdicts(scored, ids)[1].items():
            assert (i in after) == kept, i
    assert all(i in after for i, r in before.items() if not r.text or not r.lang)
    assert len(after) < len(before)


def test_line_dedup(states):
    before, after = by_id(states[1]), by_id(states[2])
    left = brute_line_dedup([(r.doc_id, r.text) for r in states[1] if r.text is not None])
    changed = 0
    for i, r in before.items():
        if r.text is None:
            assert after[i].text is None
            continue
        text, gone = left[i]
        if gone and not text.strip(" "):
            assert i not in after
        else:
            assert after[i].text == text and after[i].n_chars == (len(text) if gone else r.n_chars)
        changed += gone
    assert changed


def test_rows_are_judged_by_their_own_text(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    leak = spark.read.parquet(f"{tables}/benchmark.parquet").first().text
    odd = [(None, leak, "en", "s", 1), (3, leak, "en", "s", 1), (None, "one two three four five six", "en", "s", 1), (None, "one two three four five six", "en", "t", 1), (900, "seven eight", "en", "s", 1), (900, "seven eight", "en", "s", 1)]
    rows = docs.where("doc_id = 3").unionByName(spark.createDataFrame(odd, docs.schema))
    left = corpus_pipeline.drop_benchmark_leaks(spark, rows, tables).collect()
    assert len(left) == 5 and leak not in {r.text for r in left}
    left = corpus_pipeline.drop_near_copies(spark, rows, tables).collect()
    assert sorted((str(r.doc_id), r.text[:9]) for r in left if r.text[:5] in ("one t", "seven")) == [("900", "seven eig"), ("None", "one two t")]


def test_near_copies(states):
    before, after = by_id(states[2]), by_id(states[3])
    ids = sorted(before)
    _, group = brute_groups([before[i].text for i in ids], 5)
    assert sorted(after) == [ids[n] for n, root in group.items() if n == root] and len(after) < len(before)


def test_decontamination(spark, tables, states):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    before, after = by_id(states[3]), by_id(states[4])
    leaks = {i for i, r in before.items() if brute_leaks(r.text, items)[1]}
    assert leaks and set(after) == set(before) - leaks


def test_mixing(states):
    sizes, taken, targets = defaultdict(int), defaultdict(int), {}
    for r in states[4]:
        sizes[r.source] += len((r.text or "").split())
    longest = max(len((r.text or "").split()) for r in states[4])
    for r in states[5]:
        assert 0 < r.copies <= 3 and r.taken == r.copies * r.size and r.source_size == sizes[r.source]
        taken[r.source] += r.taken
        targets[r.source] = r.target
    assert all(abs(taken[s] - t) <= longest for s, t in targets.items())


def test_stages_take_clashing_columns(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(12)
    for name in ("kept", "n_lines", "doc_key", "marks", "copies"):
        docs = docs.withColumn(name, docs.source)
    out = corpus_pipeline.drop_repeated_lines(spark, docs, tables)
    assert out.columns == docs.columns and out.where("not (kept <=> source)").count() == 0


def test_run_gives_the_last_stage(spark, tables, states):
    assert sorted(map(str, corpus_pipeline.run(spark, tables).collect())) == sorted(map(str, states[-1]))
