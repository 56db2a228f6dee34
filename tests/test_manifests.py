"""Run manifests read with what is wrong with them."""

import json

from tidewell.sources import readers
from tidewell.sources.scratch import scratch_path


def manifest(**changes):
    stage = {"status": "completed", "input_rows": 5, "output_rows": 5}
    whole = {"run_id": "r", "created_at_utc": "2026-01-05T10:00:00Z", "canonical_for_import": False, "stages": {n: dict(stage) for n in readers.RUN_STAGES}}
    return json.dumps(whole | changes)


def test_problems(spark):
    stages = json.loads(manifest())["stages"]
    cases = {
        manifest(run_id="a"): [],
        manifest(run_id=" "): ["no_run_id"],
        manifest(run_id="b", created_at_utc=None): ["time_not_read"],
        manifest(run_id="c", stages={n: stages[n] for n in ("stage0", "stage2")}): ["missing_stage1", "missing_stage3"],
        manifest(run_id="d", stages=stages | {"stage1": {"status": "failed", "input_rows": 4, "output_rows": None}}): ["not_completed_stage1", "rows_differ_stage1"],
        manifest(run_id="e", errors=["x"], canonical_for_import=True): ["errors", "not_approved"],
        manifest(run_id="f", canonical_for_import=True, warnings=["w", "v"], approval={"status": "approved", "acknowledged_warning_conditions": ["w"]}): ["warnings_not_acknowledged"],
        manifest(run_id="g", warnings=["w"], approval={"status": "approved", "acknowledged_warning_conditions": ["w"]}): [],
        manifest(run_id="h", stages=None): [f"missing_{n}" for n in readers.RUN_STAGES],
        manifest(run_id="i")[:50]: ["not_json"],
    }
    path = scratch_path(spark, "manifests")
    spark.createDataFrame([(c,) for c in [*cases, "  "]], "value string").write.text(path)
    got = sorted((r.run_id or "", r.problems) for r in readers.read_manifests(spark, path).collect())
    names = {c: json.loads(c)["run_id"] if p != ["not_json"] else None for c, p in cases.items()}
    assert sorted(p for _, p in got) == sorted(cases.values())
    assert {(n, tuple(p)) for n, p in got if n.strip()} == {(names[c], tuple(p)) for c, p in cases.items() if names[c] and names[c].strip() and p != ["not_json"]}
