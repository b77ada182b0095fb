"""Model registry, deployments, promotion and rollback as folds over append-only events.

Requests come as a DataFrame and are answered all at once. An outcome that would be an error for a
single call is a reason column here. Events that one request emits carry a ``step`` number, so the
order of same-time events stays defined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeops.functions.rules import blank, printed
from lakeops.operators.events import latest_by, newest, top_by

# Model states, promotion paths, rollback targets.
MODEL_STATES = (
    "TRAINED", "EVALUATED", "PROMOTION_APPROVED", "PROMOTED_HML", "PROMOTED_PRD",
    "DEPLOYED_HML", "DEPLOYED_PRD", "ROLLED_BACK",
)
PROMOTION_PATHS = (("dev", "hml"), ("hml", "prd"))
ROLLBACK_TARGETS = ("hml", "prd")

MODEL = ("model_name", "model_version")
MODEL_ENV = ("model_name", "target_env")

CARRIED = ("model_version", "artifact_path", "source_env", "run_id")  # of a deployment, into its INACTIVE event
REGISTERED = ("algorithm", "run_id", "artifact_path")  # of a registry entry, into its next status event
# What rollback_decisions adds to a plan, for its accepted rows.
ACTIVE_COLUMNS = tuple(f"old_{c}" for c in CARRIED)
REGISTRY_COLUMNS = tuple(f"registered_{c}" for c in REGISTERED)


def _order(events: DataFrame) -> list[Column]:
    """Newest first; ``step`` and ``run_id`` break ties where the table has them."""
    return newest("event_timestamp", *[c for c in ("step", "event_id", "run_id") if c in events.columns])


def latest_registry(registry: DataFrame) -> DataFrame:
    """Newest registry entry per model and version."""
    return latest_by(registry, MODEL, _order(registry))


def latest_valid_models(registry: DataFrame, states: Sequence[str] = MODEL_STATES) -> DataFrame:
    """Newest entry per model among those with a valid state and a non-blank artifact path."""
    valid = registry.filter(F.col("status").isin(*states) & ~blank("artifact_path"))
    return latest_by(valid, ["model_name"], _order(registry))


def artifact_path(base: str, model_name="model_name", model_version="model_version") -> Column:
    """``base/model/version``."""
    return F.concat_ws("/", F.lit(base), F.col(model_name), F.col(model_version))


def artifact_lookup(requests: DataFrame, registry: DataFrame, states: Sequence[str] = MODEL_STATES) -> DataFrame:
    """Artifact path per requested model and version, or the reason why there is none."""
    found = latest_registry(registry).select(*MODEL, "artifact_path", "status")
    empty = F.coalesce(F.col("artifact_path"), F.lit("")) == ""
    reason = (
        F.when(F.col("status").isNull(), "NOT_FOUND")
        .when(empty, "MISSING_PATH")
        .when(~F.col("status").isin(*states), "BAD_STATUS")
    )
    joined = requests.join(found, list(MODEL), "left").withColumn("reason", reason)
    return joined.withColumn("artifact_path", F.when(F.col("reason").isNull(), F.col("artifact_path")))


def invalid_states(events: DataFrame, states: Sequence[str] = MODEL_STATES) -> DataFrame:
    """Events whose status is not a model state (NULL included)."""
    return events.filter(~F.coalesce(F.col("status").isin(*states), F.lit(False)))


def status_events(changes: DataFrame, registry: DataFrame, states: Sequence[str] = MODEL_STATES) -> DataFrame:
    """New registry events for requested status changes (model, version, status, event_timestamp),
    carrying over algorithm, run and path of the newest entry. Unknown models and states give none."""
    current = latest_registry(registry).select(*MODEL, *REGISTERED)
    return changes.filter(F.col("status").isin(*states)).join(current, list(MODEL), "inner")


def active_deployments(deployments: DataFrame, strict: bool = False) -> DataFrame:
    """Active deployment per model and environment.

    By default the newest ``is_active`` event, even if an INACTIVE event came later; ``strict`` folds
    all events first and keeps those whose newest event is active.
    """
    if strict:
        return latest_by(deployments, MODEL_ENV, _order(deployments)).filter("is_active")
    return latest_by(deployments.filter("is_active"), MODEL_ENV, _order(deployments))


def with_active(requests: DataFrame, deployments: DataFrame, strict: bool = False) -> DataFrame:
    """``requests`` with the current active deployment of their model and environment as ``old_`` columns."""
    current = active_deployments(deployments, strict).select(*MODEL_ENV, *[F.col(c).alias(f"old_{c}") for c in CARRIED])
    return requests.join(current, list(MODEL_ENV), "left")


def activation_events(
    requests: DataFrame, deployments: DataFrame, strict: bool = False, order: Sequence[str] = ("run_id", "model_version", "artifact_path")
) -> DataFrame:
    """Deployment events of activation requests: an INACTIVE event for the current active deployment
    (step 1), then the new active one (step 2). Several requests for one (model, environment) follow each
    other in ``order``: each retires the one before it (steps 3 and 4, and so on), so the last stays active."""
    return _activations(with_active(requests, deployments, strict), order)


def _activations(requests: DataFrame, order: Sequence[str] = ("run_id", "model_version", "artifact_path")) -> DataFrame:
    """The same for requests that hold the ``old_`` columns already."""
    queue = Window.partitionBy(*MODEL_ENV).orderBy(*order)
    lined_up = requests.withColumns({"__before": F.lag(F.struct(*CARRIED)).over(queue), "__turn": F.row_number().over(queue)})
    joined = lined_up.withColumns(
        {f"old_{c}": F.when(F.col("__turn") == 1, F.col(f"old_{c}")).otherwise(F.col(f"__before.{c}")) for c in CARRIED}
    )
    # Fixed value: note text.
    retired_note = F.concat(F.lit("Desativado por nova ativacao da versao "), F.col("model_version"))
    rows = F.stack(
        F.lit(2),
        F.lit(1), *[F.col(f"old_{c}") for c in CARRIED], F.lit("INACTIVE"), F.lit(False), retired_note,
        F.lit(2), *[F.col(c) for c in CARRIED], F.col("deployment_status"), F.lit(True), F.col("notes"),
    ).alias("step", *[f"new_{c}" for c in CARRIED], "new_status", "is_active", "new_notes")
    events = joined.select(*MODEL_ENV, "__turn", F.col("old_model_version").isNotNull().alias("had_active"), rows)
    return events.filter(F.col("had_active") | F.col("is_active")).select(
        "model_name",
        F.col("new_model_version").alias("model_version"),
        F.col("new_artifact_path").alias("artifact_path"),
        F.col("new_source_env").alias("source_env"),
        "target_env",
        F.col("new_status").alias("deployment_status"),
        "is_active",
        F.col("new_run_id").alias("run_id"),
        F.col("new_notes").alias("notes"),
        (F.col("step") + 2 * (F.col("__turn") - 1)).alias("step"),
    )


def inactive_versions(deployments: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per model and environment the newest two versions whose own newest event is INACTIVE, as ``__first_`` and
    ``__second_`` columns of ``columns``: one of them is the newest other than any given version. They are plain columns
    and not two structs, so those that a caller doesn't read are not shuffled."""
    order = _order(deployments)
    per_version = latest_by(deployments, [*MODEL_ENV, "model_version"], order).filter(
        (F.col("deployment_status") == "INACTIVE") & F.col("model_version").isNotNull()
    )
    newest_two = top_by(per_version, MODEL_ENV, order, 2)
    turns = Window.partitionBy(*MODEL_ENV).orderBy(*order)
    paired = newest_two.withColumns({f"__second_{c}": F.lead(c).over(turns) for c in columns} | {"__turn": F.row_number().over(turns)})
    return paired.filter(F.col("__turn") == 1).select(
        *MODEL_ENV, *[F.col(c).alias(f"__first_{c}") for c in columns], *[f"__second_{c}" for c in columns]
    )


def _other_than(version: str, column: str) -> Column:
    """``column`` of the first of the two rows of :func:`inactive_versions` that has another version."""
    first = F.col("__first_model_version") != F.col(version)
    return F.when(F.col(version).isNotNull(), F.when(first, F.col(f"__first_{column}")).otherwise(F.col(f"__second_{column}")))


def rollback_candidates(requests: DataFrame, deployments: DataFrame) -> DataFrame:
    """Per request (model, environment, current version): the newest other version whose own newest
    event is INACTIVE. Requests without one are absent."""
    wanted, columns = requests.select(*MODEL_ENV, "current_model_version").distinct(), [c for c in deployments.columns if c not in MODEL_ENV]
    rows = wanted.join(inactive_versions(deployments, columns), list(MODEL_ENV))
    found = rows.select(*MODEL_ENV, *[_other_than("current_model_version", c).alias(c) for c in columns], "current_model_version")
    return found.filter(F.col("model_version").isNotNull())


def rollback_plan(requests: DataFrame, deployments: DataFrame, registry: DataFrame) -> DataFrame:
    """One row per rollback request (model, environment, run): from and to version, or the reason.

    Reasons in order: target environment not allowed, no active deployment, no candidate, version not
    in the registry.
    """
    known = registry.select(*MODEL, "event_timestamp")  # a plan only asks whether the version is there
    return rollback_decisions(requests, deployments, known, registered=()).drop(*ACTIVE_COLUMNS)


def rollback_decisions(
    requests: DataFrame, deployments: DataFrame, registry: DataFrame, registered: Sequence[str] = REGISTERED
) -> DataFrame:
    """Rows of :func:`rollback_plan`; the accepted ones also hold the active deployment and the ``registered`` columns of the
    registry entry they were judged by, so that their events need no second fold."""
    judged = with_active(requests, deployments).withColumn("from_version", F.col("old_model_version"))
    judged = judged.join(inactive_versions(deployments, CARRIED), list(MODEL_ENV), "left")
    judged = judged.withColumns({f"to_{c}": _other_than("from_version", c) for c in CARRIED})
    judged = judged.drop(*[f"{turn}_{c}" for turn in ("__first", "__second") for c in CARRIED])
    judged = judged.withColumnRenamed("to_model_version", "to_version")
    known = latest_registry(registry).select(
        "model_name", F.col("model_version").alias("from_version"), F.lit(True).alias("registered"), *[F.col(c).alias(f"registered_{c}") for c in registered]
    )
    joined = judged.join(known, ["model_name", "from_version"], "left")
    reason = (
        F.when(~F.col("target_env").isin(*ROLLBACK_TARGETS), "INVALID_TARGET")
        .when(F.col("from_version").isNull(), "NO_ACTIVE_DEPLOYMENT")
        .when(F.col("to_version").isNull(), "NO_CANDIDATE")
        .when(F.col("registered").isNull(), "NOT_IN_REGISTRY")
    )
    decided = joined.withColumn("reason", reason).drop("registered")
    held = (*ACTIVE_COLUMNS, *[f"registered_{c}" for c in registered])
    return decided.withColumns({c: F.when(F.col("reason").isNull(), F.col(c)) for c in held})


def rollback_deployment_events(plan: DataFrame, deployments: DataFrame) -> DataFrame:
    """Deployment events of the accepted rows of a rollback plan; ``deployments`` are folded only for a plan without
    the columns of :func:`rollback_decisions`."""
    held = [c for c in ACTIVE_COLUMNS if c in plan.columns]
    accepted = plan.filter("reason IS NULL").select(
        "model_name",
        F.col("to_version").alias("model_version"),
        F.col("to_artifact_path").alias("artifact_path"),
        F.col("to_source_env").alias("source_env"),
        "target_env",
        F.lit("ROLLED_BACK_ACTIVE").alias("deployment_status"),
        F.col("to_run_id").alias("run_id"),
        F.concat(F.lit("Rollback ativou versao "), F.col("to_version")).alias("notes"),
        *held,
    )
    return _activations(accepted) if held else activation_events(accepted, deployments)


def rollback_status_events(plan: DataFrame, registry: DataFrame) -> DataFrame:
    """ROLLED_BACK registry events for the versions rolled back from; ``registry`` is folded only for a plan without
    the columns of :func:`rollback_decisions`."""
    held = [F.col(f"registered_{c}").alias(c) for c in REGISTERED if f"registered_{c}" in plan.columns]
    changes = plan.filter("reason IS NULL").select(
        "model_name", F.col("from_version").alias("model_version"), F.lit("ROLLED_BACK").alias("status"), *held
    )
    return changes if held else status_events(changes, registry)


def rollback_governance_events(plan: DataFrame) -> DataFrame:
    """STARTED and SUCCESS or ERROR governance rows per rollback request; a target environment that
    is not allowed is refused before anything is logged."""
    # The same rows by target as by reason. Only the condition on the target can be applied before the plan's folds and joins.
    allowed = F.col("target_env").isNull() | F.col("target_env").isin(*ROLLBACK_TARGETS)
    logged = plan.filter(allowed & F.coalesce(F.col("reason") != "INVALID_TARGET", F.lit(True)))
    # Each column by itself, where stack() would read all of them: what is not selected need not be shuffled.
    done, ok = F.col("step") == 2, F.col("reason").isNull()
    message = F.concat(F.lit("Rollback executado de "), F.col("from_version"), F.lit(" para "), F.col("to_version"))
    return logged.withColumn("step", F.explode(F.array(F.lit(1), F.lit(2)))).select(
        F.lit("rollback").alias("component"),
        "model_name",
        "target_env",
        "run_id",
        "step",
        F.when(~done, "STARTED").when(ok, "SUCCESS").otherwise("ERROR").alias("status"),
        F.when(done & ok, F.col("to_version")).alias("model_version"),
        F.when(done & ok, F.col("to_source_env")).alias("source_env"),
        F.when(done & ok, F.col("to_artifact_path")).alias("artifact_path"),
        F.when(~done, "Rollback iniciado").when(ok, message).otherwise(F.concat(F.lit("ValueError: "), F.col("reason"))).alias("message"),
    )


def promotion_decisions(candidates: DataFrame, promotion_rules: DataFrame) -> DataFrame:
    """Approval and reason per candidate; the first failing check gives the reason.

    ``candidates`` has source_env, target_env, accuracy, f1, auc, tests_passed, manual_approval;
    ``promotion_rules`` has source_env, target_env, position, requires_approval, require_tests_passed,
    require_quality_gates, minimum_accuracy, minimum_f1, minimum_auc. The lowest position wins.
    """
    first = latest_by(promotion_rules, ["source_env", "target_env"], [F.col("position").asc()]).drop("position")
    joined = candidates.join(first.withColumn("__has_rule", F.lit(True)), ["source_env", "target_env"], "left")

    def below(metric: str) -> Column:
        return F.col("require_quality_gates") & (F.col(metric).isNull() | (F.col(metric) < F.col(f"minimum_{metric}")))

    def below_text(metric: str) -> Column:
        return F.concat(
            F.lit(f"Promotion blocked: {metric} "), printed(metric), F.lit(" below minimum "),
            printed(f"minimum_{metric}"), F.lit("."),
        )

    no_rule = F.concat(
        F.lit("Promotion blocked: no promotion rule configured for "), F.col("source_env"), F.lit(" -> "),
        F.col("target_env"), F.lit("."),
    )
    # Reason texts.
    reason = (
        F.when(F.col("__has_rule").isNull(), no_rule)
        .when(F.col("require_tests_passed") & ~F.col("tests_passed"), "Promotion blocked: automated tests did not pass.")
        .when(F.col("requires_approval") & ~F.col("manual_approval"), "Promotion blocked: manual approval is required.")
        .when(below("accuracy"), below_text("accuracy"))
        .when(below("f1"), below_text("f1"))
        .when(below("auc"), below_text("auc"))
        .otherwise("Promotion approved.")
    )
    decided = joined.withColumn("reason", reason).withColumn("approved", F.col("reason") == "Promotion approved.")
    return decided.select(*candidates.columns, "approved", "reason")


def valid_promotion_path(source: str = "source_env", target: str = "target_env") -> Column:
    pairs = [f"{a}>{b}" for a, b in PROMOTION_PATHS]
    return F.coalesce(F.concat_ws(">", F.col(source), F.col(target)).isin(*pairs), F.lit(False))


def promotion_plan(
    requests: DataFrame,
    registry: DataFrame,
    deployments: DataFrame,
    states: Sequence[str] = MODEL_STATES,
) -> DataFrame:
    """One row per promotion request (model, optional version, source_env, target_env, run_id).

    A request without a version takes the newest valid one. ``outcome`` is PROMOTE, ALREADY_ACTIVE or
    REJECTED with a reason; ``final_status`` is the deployed state, or that of the active deployment.
    """
    columns = ["model_name", "model_version", "artifact_path", "run_id", "status"]
    by_version = latest_registry(registry).select(*[F.col(c).alias(f"v_{c}") for c in columns])
    by_model = latest_valid_models(registry, states).select(*[F.col(c).alias(f"m_{c}") for c in columns])
    named = F.coalesce(F.col("model_version"), F.lit("")) != ""
    asked = requests.withColumn("__named", named)
    joined = asked.join(
        by_version,
        (F.col("model_name") == F.col("v_model_name")) & (F.col("model_version") == F.col("v_model_version")),
        "left",
    ).join(by_model, F.col("model_name") == F.col("m_model_name"), "left")

    def entry(column: str) -> Column:
        return F.when(F.col("__named"), F.col(f"v_{column}")).otherwise(F.col(f"m_{column}"))

    resolved = joined.select(
        *requests.columns,
        entry("model_version").alias("resolved_version"),
        entry("artifact_path").alias("artifact_path"),
        entry("run_id").alias("deployment_run_id"),
        entry("status").alias("registry_status"),
    )
    active = active_deployments(deployments).select(
        *MODEL_ENV, F.col("model_version").alias("active_version"), F.col("deployment_status").alias("active_status")
    )
    judged = resolved.join(active, list(MODEL_ENV), "left")
    reason = (
        F.when(~valid_promotion_path(), "INVALID_PATH")
        .when(F.col("resolved_version").isNull(), "MODEL_NOT_FOUND")
        .when(F.coalesce("artifact_path", F.lit("")) == "", "MISSING_ARTIFACT")
        .when(~F.col("registry_status").isin(*states), "INVALID_STATUS")
    )
    same = F.coalesce(F.col("active_version") == F.col("resolved_version"), F.lit(False))
    outcome = F.when(F.col("reason").isNotNull(), "REJECTED").when(same, "ALREADY_ACTIVE").otherwise("PROMOTE")
    deployed = F.concat(F.lit("DEPLOYED_"), F.upper("target_env"))
    return (
        judged.withColumn("reason", reason)
        .withColumn("outcome", outcome)
        .withColumn(
            "final_status",
            F.when(F.col("outcome") == "PROMOTE", deployed).when(F.col("outcome") == "ALREADY_ACTIVE", F.col("active_status")),
        )
    )


def promotion_status_events(plan: DataFrame, registry: DataFrame) -> DataFrame:
    """Registry events of promoted requests, in order PROMOTION_APPROVED, PROMOTED_x, DEPLOYED_x."""
    env = F.upper("target_env")
    steps = F.stack(
        F.lit(3),
        F.lit(1), F.lit("PROMOTION_APPROVED"),
        F.lit(2), F.concat(F.lit("PROMOTED_"), env),
        F.lit(3), F.concat(F.lit("DEPLOYED_"), env),
    ).alias("step", "status")
    changes = plan.filter(F.col("outcome") == "PROMOTE").select(
        "model_name", F.col("resolved_version").alias("model_version"), "target_env", steps
    )
    return status_events(changes, registry)


def promotion_deployment_events(plan: DataFrame, deployments: DataFrame) -> DataFrame:
    """Deployment events of promoted requests."""
    accepted = plan.filter(F.col("outcome") == "PROMOTE").select(
        "model_name",
        F.col("resolved_version").alias("model_version"),
        "artifact_path",
        "source_env",
        "target_env",
        F.col("final_status").alias("deployment_status"),
        F.col("deployment_run_id").alias("run_id"),
        F.concat(F.lit("Promocao "), F.col("source_env"), F.lit("->"), F.col("target_env")).alias("notes"),
    )
    return activation_events(accepted, deployments)


def promotion_log_events(plan: DataFrame) -> DataFrame:
    """Promotion log rows of promoted requests."""
    return plan.filter(F.col("outcome") == "PROMOTE").select(
        "model_name",
        F.col("resolved_version").alias("model_version"),
        "artifact_path",
        "source_env",
        "target_env",
        F.lit("PROMOTION_APPROVED").alias("status"),
        F.lit("Promotion request accepted").alias("reason"),
    )


def promotion_governance_events(plan: DataFrame) -> DataFrame:
    """STARTED and SUCCESS or ERROR governance rows per request; a path that is not allowed is
    refused before anything is logged."""
    ok = F.col("outcome") != "REJECTED"
    text = (
        F.when(F.col("outcome") == "PROMOTE", F.concat(F.lit("Promotion concluida com status "), F.col("final_status")))
        .when(F.col("outcome") == "ALREADY_ACTIVE", "Model already active in target environment")
        .otherwise(F.concat(F.lit("ValueError: "), F.col("reason")))
    )
    nothing = F.lit(None).cast("string")
    rows = F.stack(
        F.lit(2),
        F.lit(1), F.lit("STARTED"), F.col("model_version"), nothing, F.lit("Promotion iniciada"),
        F.lit(2), F.when(ok, "SUCCESS").otherwise("ERROR"),
        F.when(ok, F.col("resolved_version")).otherwise(F.col("model_version")),
        F.when(ok, F.col("artifact_path")), text,
    ).alias("step", "status", "version", "artifact_path", "message")
    return plan.filter(F.coalesce(F.col("reason") != "INVALID_PATH", F.lit(True))).select(
        F.lit("promote_and_deploy_ml").alias("component"), "model_name", "source_env", "target_env", "run_id", rows
    ).withColumnRenamed("version", "model_version")
