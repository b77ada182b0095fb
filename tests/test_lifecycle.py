"""State folds, promotion and rollback on small histories and on stored tables."""

from __future__ import annotations

import re
import uuid
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lakeops.operators import lifecycle as lc
from lakeops.operators.events import event_rows
from lakeops.plans.lifecycle import run_promotions, run_rollbacks
from lakeops.sources.tables import append_events

DEPLOYED = "model_name string, model_version string, artifact_path string, source_env string, target_env string, deployment_status string, is_active boolean, run_id string, notes string, at int"
REGISTERED = "model_name string, model_version string, algorithm string, run_id string, status string, artifact_path string, at int"


def deployments(spark, rows):
    full = [("m", v, f"path/{v}", "dev", env, status, active, f"run-{v}", None, at) for v, env, status, active, at in rows]
    return timed(spark.createDataFrame(full, DEPLOYED))


def registry(spark, rows):
    return timed(spark.createDataFrame([("m", v, "lr", f"run-{v}", status, path, at) for v, status, path, at in rows], REGISTERED))


def timed(df):
    return event_rows(df, F.timestamp_seconds("at"), "dev", "demo")


def test_active_modes(spark):
    events = deployments(spark, [("v1", "hml", "DEPLOYED_HML", True, 1), ("v1", "hml", "INACTIVE", False, 2)])
    assert lc.active_deployments(events).first().model_version == "v1"
    assert lc.active_deployments(events, strict=True).count() == 0


def test_latest_valid(spark):
    events = registry(spark, [("v1", "TRAINED", "a", 1), ("v2", "BROKEN", "b", 2), ("v3", "TRAINED", "  ", 3), ("v4", "TRAINED", None, 4)])
    assert lc.latest_valid_models(events).first().model_version == "v1"
    assert {r.status for r in lc.invalid_states(events).collect()} == {"BROKEN"}


def requests(spark, *rows):
    return spark.createDataFrame(rows, "model_name string, target_env string, run_id string")


def test_rollback_reasons(spark):
    history = deployments(
        spark, [("old", "hml", "DEPLOYED_HML", True, 1), ("old", "hml", "INACTIVE", False, 2), ("new", "hml", "DEPLOYED_HML", True, 3), ("only", "prd", "DEPLOYED_PRD", True, 1)]
    )
    known = registry(spark, [("new", "DEPLOYED_HML", "p", 1), ("only", "DEPLOYED_PRD", "p", 1)])
    asked = requests(spark, ("m", "hml", "g1"), ("m", "prd", "g2"), ("m", "dev", "g3"), ("x", "hml", "g4"))
    plan = {r.run_id: r for r in lc.rollback_plan(asked, history, known).collect()}
    assert (plan["g1"].from_version, plan["g1"].to_version, plan["g1"].reason) == ("new", "old", None)
    assert [plan[g].reason for g in ("g2", "g3", "g4")] == ["NO_CANDIDATE", "INVALID_TARGET", "NO_ACTIVE_DEPLOYMENT"]
    logged = lc.rollback_governance_events(lc.rollback_plan(asked, history, known)).collect()
    assert sorted((r.run_id, r.step, r.status) for r in logged) == [
        ("g1", 1, "STARTED"), ("g1", 2, "SUCCESS"), ("g2", 1, "STARTED"), ("g2", 2, "ERROR"), ("g4", 1, "STARTED"), ("g4", 2, "ERROR"),
    ]
    assert "Rollback executado de new para old" in {r.message for r in logged}


def test_governance_rows_of_odd_requests(spark):
    """Requests that come twice, without a target, without a model, for a target that is not allowed or of other case; the newest
    inactive version is the active one itself, so the second holds."""
    history = deployments(
        spark,
        [
            ("v1", "hml", "INACTIVE", False, 1), ("v2", "hml", "INACTIVE", False, 2), ("v3", "hml", "DEPLOYED_HML", True, 3), ("v3", "hml", "INACTIVE", False, 4),
            (None, "hml", "INACTIVE", False, 5), ("v1", None, "DEPLOYED_HML", True, 6), ("v1", "dev", "DEPLOYED_DEV", True, 1), ("v2", "dev", "INACTIVE", False, 2),
            ("v9", "prd", "DEPLOYED_PRD", True, 1), ("v8", "prd", "INACTIVE", False, 1),
        ],
    )
    known = registry(spark, [("v3", "TRAINED", "p", 1), ("v3", "TRAINED", "q", 2), (None, "TRAINED", "p", 1)])
    asked = requests(spark, ("m", "hml", "g1"), ("m", "hml", "g1"), ("m", None, "g2"), (None, "hml", "g3"), ("m", "dev", "g4"), ("m", "HML", "g5"), ("m", "prd", None))
    plan = lc.rollback_plan(asked, history, known)
    assert plan.columns == [
        "model_name", "from_version", "target_env", "run_id", "to_version", "to_artifact_path", "to_source_env", "to_run_id", "reason",
    ]
    refused = {r.run_id: r for r in plan.collect() if r.reason == "INVALID_TARGET"}
    assert sorted(refused) == ["g4", "g5"] and (refused["g4"].from_version, refused["g4"].to_version, refused["g4"].to_run_id) == ("v1", "v2", "run-v2")
    rows = lc.rollback_governance_events(plan)
    assert rows.columns == ["component", "model_name", "target_env", "run_id", "step", "status", "model_version", "source_env", "artifact_path", "message"]
    got = Counter(tuple(r)[1:] for r in rows.collect())
    started = ("STARTED", None, None, None, "Rollback iniciado")
    done = ("SUCCESS", "v2", "dev", "path/v2", "Rollback executado de v3 para v2")
    assert got == Counter(
        {
            ("m", "hml", "g1", 1, *started): 2, ("m", "hml", "g1", 2, *done): 2,
            ("m", None, "g2", 1, *started): 1, ("m", None, "g2", 2, "ERROR", None, None, None, "ValueError: NO_ACTIVE_DEPLOYMENT"): 1,
            (None, "hml", "g3", 1, *started): 1, (None, "hml", "g3", 2, "ERROR", None, None, None, "ValueError: NO_ACTIVE_DEPLOYMENT"): 1,
            ("m", "prd", None, 1, *started): 1, ("m", "prd", None, 2, "ERROR", None, None, None, "ValueError: NOT_IN_REGISTRY"): 1,
        }
    )


def test_candidate_is_another_version_with_all_its_columns(spark):
    history = deployments(spark, [("v1", "hml", "INACTIVE", False, 1), ("v2", "hml", "INACTIVE", False, 2), ("v7", "prd", "INACTIVE", False, 1)])
    asked = spark.createDataFrame(
        [("m", "hml", "v2"), ("m", "hml", "v2"), ("m", "hml", "v1"), ("m", "hml", "x"), ("m", "hml", None), ("m", "prd", "v7"), ("m", None, "v1")],
        "model_name string, target_env string, current_model_version string",
    )
    found = lc.rollback_candidates(asked, history)
    assert found.columns == ["model_name", "target_env", *[c for c in history.columns if c not in lc.MODEL_ENV], "current_model_version"]
    got = sorted((r.current_model_version, r.model_version, r.artifact_path, r.run_id, r.deployment_status, r.env, r.notes) for r in found.collect())
    assert got == [
        ("v1", "v2", "path/v2", "run-v2", "INACTIVE", "dev", None), ("v2", "v1", "path/v1", "run-v1", "INACTIVE", "dev", None), ("x", "v2", "path/v2", "run-v2", "INACTIVE", "dev", None),
    ]


def test_governance_rows_read_only_what_they_need(spark, tmp_path):
    """Targets that are not allowed and columns that are not selected are gone before anything is shuffled."""
    deployments(spark, [("v1", "hml", "INACTIVE", False, 1)]).write.parquet(str(tmp_path / "deployments"))
    registry(spark, [("v1", "TRAINED", "p", 1)]).write.parquet(str(tmp_path / "registry"))
    requests(spark, ("m", "hml", "g1")).write.parquet(str(tmp_path / "requests"))
    asked, history, known = (spark.read.parquet(str(tmp_path / name)) for name in ("requests", "deployments", "registry"))
    rows = lc.rollback_governance_events(lc.rollback_plan(asked, history, known)).select("run_id", "step", "status", "model_version", "message")
    lines = rows._jdf.queryExecution().executedPlan().toString().splitlines()
    scans = {i: set(re.findall(r"(\w+)#", line.partition("[")[2].partition("]")[0])) for i, line in enumerate(lines) if "FileScan" in line}
    events = [c for c in scans.values() if "event_timestamp" in c]
    assert len(scans) == 4 and len(events) == 3 and {"model_name", "model_version", "event_timestamp"} in events
    assert not any(c & {"artifact_path", "source_env", "algorithm"} for c in scans.values())
    for i, columns in scans.items():
        assert ("target_env" in columns) == any("Filter" in line and "IN (hml,prd)" in line for line in lines[i - 2 : i])


def test_events_of_stored_decisions_need_no_second_fold(spark, tmp_path):
    history = deployments(
        spark, [("old", "hml", "DEPLOYED_HML", True, 1), ("old", "hml", "INACTIVE", False, 2), ("new", "hml", "DEPLOYED_HML", True, 3), ("only", "prd", "DEPLOYED_PRD", True, 1)]
    )
    known = registry(spark, [("new", "DEPLOYED_HML", "p", 1), ("only", "DEPLOYED_PRD", "p", 1)])
    asked = requests(spark, ("m", "hml", "g1"), ("m", "hml", "g2"), ("m", "prd", "g3"), ("x", "hml", "g4"))
    plain = lc.rollback_plan(asked, history, known)
    lc.rollback_decisions(asked, history, known).write.parquet(str(tmp_path / "plan"))
    decided = spark.read.parquet(str(tmp_path / "plan"))
    for events, other in ((lc.rollback_deployment_events, history), (lc.rollback_status_events, known)):
        carried, folded = events(decided, other), events(plain, other)
        assert carried.columns == folded.columns
        assert sorted(map(str, carried.collect())) == sorted(map(str, folded.collect())) and folded.count() in (2, 4)
        tree = carried._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in tree and tree.count("Relation") == 1


def test_candidate_needs_newest_event_inactive(spark):
    history = deployments(
        spark, [("a", "hml", "INACTIVE", False, 1), ("a", "hml", "ROLLED_BACK_ACTIVE", True, 5), ("b", "hml", "INACTIVE", False, 2), ("c", "hml", "DEPLOYED_HML", True, 9)]
    )
    asked = spark.createDataFrame([("m", "hml", "c")], "model_name string, target_env string, current_model_version string")
    assert [r.model_version for r in lc.rollback_candidates(asked, history).collect()] == ["b"]


@pytest.fixture()
def stored(spark):
    schema = f"life_{uuid.uuid4().hex[:8]}"
    spark.sql(f"CREATE SCHEMA {schema}")
    append_events(registry(spark, [("v1", "EVALUATED", "path/v1", 1), ("v2", "EVALUATED", "path/v2", 2)]), "tb_model_registry", f"{schema}.tb_model_registry")
    append_events(deployments(spark, [("v0", "hml", "DEPLOYED_HML", True, 0)]), "tb_model_deployments", f"{schema}.tb_model_deployments")
    return schema


def test_candidate_is_the_newest_other_version_in_two_scans(spark, tmp_path):
    inactive = [(v, "hml", "INACTIVE", False, at) for at, v in enumerate(("a", "b", "c", None), 1)]
    events = deployments(spark, [*inactive, ("d", "hml", "DEPLOYED_HML", True, 9)])
    asked = spark.createDataFrame([("m", "hml", v) for v in ("a", "b", "c", "d", "d", None)], "model_name string, target_env string, current_model_version string")
    found = lc.rollback_candidates(asked, events)
    assert sorted((r.current_model_version, r.model_version, r.run_id) for r in found.collect()) == [
        ("a", "c", "run-c"), ("b", "c", "run-c"), ("c", "b", "run-b"), ("d", "c", "run-c"),
    ]
    path = str(tmp_path / "events")
    events.write.parquet(path)
    plan = lc.rollback_plan(requests(spark, ("m", "hml", "g")), spark.read.parquet(path), registry(spark, [("d", "TRAINED", "p", 1)]))
    assert [(r.from_version, r.to_version, r.to_run_id, r.reason) for r in plan.collect()] == [("d", "c", "run-c", None)]
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 2


def promote(spark, schema, version, at, run):
    asked = spark.createDataFrame([("m", version, "dev", "hml", run)], "model_name string, model_version string, source_env string, target_env string, run_id string")
    return run_promotions(spark, schema, asked, F.lit(datetime(2024, 1, at)), "dev", "demo", f"{schema}.plan_{run}").first()


def test_promote_then_rollback(spark, stored):
    first = promote(spark, stored, "v1", 1, "p1")
    assert (first.outcome, first.final_status) == ("PROMOTE", "DEPLOYED_HML")
    statuses = [r.status for r in spark.table(f"{stored}.tb_model_registry").filter("model_version = 'v1'").orderBy("event_timestamp").collect()]
    assert statuses == ["EVALUATED", "PROMOTION_APPROVED", "PROMOTED_HML", "DEPLOYED_HML"]
    assert promote(spark, stored, "v1", 2, "p2").outcome == "ALREADY_ACTIVE"
    newest = promote(spark, stored, None, 3, "p3")
    assert (newest.resolved_version, newest.outcome) == ("v1", "ALREADY_ACTIVE")
    assert promote(spark, stored, "v2", 4, "p4").outcome == "PROMOTE"
    assert promote(spark, stored, "v9", 5, "p5").reason == "MODEL_NOT_FOUND"
    events = spark.table(f"{stored}.tb_model_deployments")
    assert events.filter("deployment_status = 'INACTIVE'").count() == 2
    assert lc.active_deployments(events, strict=True).first().model_version == "v2"

    plan = run_rollbacks(spark, stored, requests(spark, ("m", "hml", "g1")), F.lit(datetime(2024, 1, 6)), "dev", "demo", f"{stored}.plan_g1").first()
    assert (plan.from_version, plan.to_version) == ("v2", "v1")
    assert lc.active_deployments(spark.table(f"{stored}.tb_model_deployments"), strict=True).first().deployment_status == "ROLLED_BACK_ACTIVE"
    latest = {r.model_version: r.status for r in lc.latest_registry(spark.table(f"{stored}.tb_model_registry")).collect()}
    assert latest == {"v1": "DEPLOYED_HML", "v2": "ROLLED_BACK"}
    # The version rolled back from is inactive now and so the next candidate.
    again = run_rollbacks(spark, stored, requests(spark, ("m", "hml", "g2")), F.lit(datetime(2024, 1, 7)), "dev", "demo", f"{stored}.plan_g2").first()
    assert (again.from_version, again.to_version) == ("v1", "v2")
    log = spark.table(f"{stored}.tb_ml_governance_runs").groupBy("component", "status").count().collect()
    assert {(r.component, r.status): r["count"] for r in log}[("rollback", "SUCCESS")] == 2


def test_promotion_checks_in_order(spark):
    from lakeops.checks.lifecycle import PROMOTION_RULES, RULE_COLUMNS

    rules = spark.createDataFrame(PROMOTION_RULES, RULE_COLUMNS)
    rows = [
        (1, "dev", "prd", 0.9, 0.9, 0.9, True, True), (2, "dev", "hml", None, None, None, False, True),
        (3, "hml", "prd", 0.9, 0.9, 0.9, True, False), (4, "hml", "prd", 0.60, 0.1, 0.1, True, True),
        (5, "hml", "prd", 0.65, None, 0.1, True, True), (6, "hml", "prd", 0.65, 0.55, 0.64, True, True),
        (7, "hml", "prd", 0.65, 0.55, 0.65, True, True), (8, "dev", "hml", None, None, None, True, False),
    ]
    df = spark.createDataFrame(rows, "id int, source_env string, target_env string, accuracy double, f1 double, auc double, tests_passed boolean, manual_approval boolean")
    got = {r.id: (r.approved, r.reason) for r in lc.promotion_decisions(df, rules).collect()}
    assert got == {
        1: (False, "Promotion blocked: no promotion rule configured for dev -> prd."),
        2: (False, "Promotion blocked: automated tests did not pass."),
        3: (False, "Promotion blocked: manual approval is required."),
        4: (False, "Promotion blocked: accuracy 0.6 below minimum 0.65."),
        5: (False, "Promotion blocked: f1 None below minimum 0.55."),
        6: (False, "Promotion blocked: auc 0.64 below minimum 0.65."),
        7: (True, "Promotion approved."),
        8: (True, "Promotion approved."),
    }
