"""Folds of decision logs, review progress, replays, and invalidation along dependencies, against plain loops."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidewell.operators import cascade, decisions

LOG = "listing_id long, field string, happened_at int, event_id long, action string, value string"


def random_log(seed, n=400):
    rng = random.Random(seed)
    return [(rng.randrange(20), rng.choice(["price", "kind"]), rng.randrange(60), i, rng.choice(["opened", "drafted", "decided", "applied", "source_changed"]), rng.choice([None, str(i)])) for i in range(n)]


def plain_states(log):
    out = {}
    for listing, name, _, event, action, value in sorted(log, key=lambda r: (r[2], r[3])):
        state, kept, by, n = out.get((listing, name), ("unresolved", None, None, 0))
        if action == "drafted":
            state = "draft"
        elif action == "decided":
            state, kept, by, n = "decided", value, event, n + 1
        elif action == "applied" and state == "decided":
            state = "applied"
        elif action == "source_changed" and state != "unresolved":
            state = "stale"
        out[listing, name] = (state, kept, by, n)
    return {k: (s, v, b, max(n - 1, 0)) for k, (s, v, b, n) in out.items()}


def test_states_are_the_fold(spark):
    seen = Counter()
    for seed in range(5):
        log = random_log(seed)
        got = decisions.decision_states(spark.createDataFrame(log, LOG), ["listing_id", "field"]).collect()
        assert {(r.listing_id, r.field): (r.state, r.value, r.decided_by, r.superseded) for r in got} == plain_states(log)
        seen.update(r.state for r in got)
    assert set(seen) >= {"draft", "decided", "applied", "stale"}


def test_dashboard(spark):
    log = random_log(9, 150)
    states = decisions.decision_states(spark.createDataFrame(log, LOG), ["listing_id", "field"])
    rng = random.Random(2)
    issues = [(i, rng.choice(["missing", "odd"]), f) for i in range(25) for f in ("price", "kind") if rng.random() < 0.7]
    got = {r.category: r for r in decisions.review_dashboard(spark.createDataFrame(issues, "listing_id long, category string, field string"), states, ["listing_id", "field"], "listing_id", "category", "field").collect()}
    known = plain_states(log)
    for category in ("missing", "odd", "__all__"):
        own = [(i, f, known.get((i, f), ("unresolved",))[0]) for i, c, f in issues if category in (c, "__all__")]
        left = defaultdict(int)
        for i, _, s in own:
            left[i] += s not in ("decided", "applied")
        r = got[category]
        assert {s: r[s] for s in decisions.STATES} == {s: sum(x[2] == s for x in own) for s in decisions.STATES}
        assert (r.issues, r.listings, r.complete_listings, r.facets) == (len(own), len(left), sum(n == 0 for n in left.values()), sorted({f for _, f, _ in own}))


def test_replay_keeps_what_people_decided(spark):
    states = spark.createDataFrame([(1, "a", "decided", "x"), (2, "a", "stale", "x"), (3, "a", "applied", None), (1, "b", "draft", "y"), (9, "a", "decided", "z")], "id long, field string, state string, value string")
    rows = spark.createDataFrame([(1, "r", "c", True), (2, "r", "c", True), (3, "r", "c", True), (4, None, "c", True), (5, None, "c", False), (6, None, None, True), (7, None, "c", None)], "id long, rule string, cached string, ok boolean")
    fields = {n: (F.col("rule"), F.col("cached"), F.col("ok")) for n in ("a", "b")}
    got = {r.id: (tuple(r.a), tuple(r.b)) for r in decisions.replay(rows, states, ["id"], fields).collect()}
    assert got[1] == (("x", "manual"), ("r", "rule")) and got[2][0] == ("r", "rule") and got[3][0] == (None, "manual")  # null was decided, too
    assert [got[i][0] for i in (4, 5, 6, 7)] == [("c", "inference"), (None, "rejected"), (None, None), (None, "rejected")]
    assert len(got) == 7


EDGES, SEEDS = "parent_kind string, parent_id long, kind string, id long", "kind string, id long, reason string"


def plain_cascade(edges, seeds, known=()):
    found = {}
    front = {}
    for k, i, r in seeds:
        if i is not None and (k, i) not in known:
            front[k, i] = min(r, front.get((k, i), (r,))[0]), 0
    while front:
        found |= front
        reached = defaultdict(list)
        for pk, pi, k, i in edges:
            if (pk, pi) in front and i is not None and (k, i) not in found and (k, i) not in known:
                reached[k, i].append(front[pk, pi])
        front = {n: (min(r for r, _ in rs), rs[0][1] + 1) for n, rs in reached.items()}
    return found


@pytest.mark.parametrize("bound", [200_000, 0])
def test_invalidation(spark, monkeypatch, bound):
    monkeypatch.setattr(cascade, "BROADCAST_ROWS", bound)
    rng = random.Random(6)
    edges = [(rng.choice("pqs"), rng.randrange(12), rng.choice("pqs"), rng.randrange(12)) for _ in range(30)] + [("p", None, "q", 1), ("p", 1, "q", None), ("x", 1, "x", 1), ("x", 1, "y", 2), ("y", 2, "z", 3), ("z", 3, "w", 4), ("w", 4, "x", 1)]
    seeds = [("p", 1, "moved"), ("p", 1, "expired"), ("q", 2, "moved"), ("x", 1, "moved"), ("x", None, "moved")]
    table, first = spark.createDataFrame(edges, EDGES), spark.createDataFrame(seeds, SEEDS)
    out = cascade.invalidate(table, first)
    got = {(r.kind, r.id): (r.reason, r.depth) for r in out.collect()}
    assert got == plain_cascade(edges, seeds) and got["w", 4] == ("moved", 3)  # a chain of three, and a cycle
    assert cascade.invalidate(table, first, out).collect() == []  # a replay
    more = seeds + [("s", 5, "expired")]
    again = cascade.invalidate(table, spark.createDataFrame(more, SEEDS), out)
    assert {(r.kind, r.id): (r.reason, r.depth) for r in again.collect()} == plain_cascade(edges, more, got)
    assert cascade.invalidate(table, first.where("false")).collect() == []


def test_too_deep(spark):
    edges = spark.createDataFrame([("n", i, "n", i + 1) for i in range(5)], EDGES)
    with pytest.raises(RuntimeError, match="3 steps"):
        cascade.invalidate(edges, spark.createDataFrame([("n", 0, "r")], SEEDS), most_rounds=3)
