"""Policy gate, workflow folds and registry lifecycles as set operations over event tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Gate


@dataclass(frozen=True)
class TenantPolicy:
    tenant_id: str
    autonomous: Sequence[str]
    forbidden: Sequence[str]
    readable: Sequence[str]
    floor: float = 0.8
    approver_role: str = "reviewer"
    escalation_role: str = "lead"

    def __post_init__(self):
        if set(self.autonomous) & set(self.forbidden):
            raise ValueError("an action cannot be both autonomous and forbidden")
        if not 0 <= self.floor <= 1:
            raise ValueError("the confidence floor must be in [0, 1]")


def conservative(tenant_id: str) -> TenantPolicy:
    return TenantPolicy(tenant_id, (), (), ())


def permissive(tenant_id: str, actions: Sequence[str], but: str) -> TenantPolicy:
    return TenantPolicy(tenant_id, tuple(a for a in actions if a != but), (), ())


def gate(actions: DataFrame, policies: DataFrame, implied: dict[str, str] | None = None) -> DataFrame:
    """Adds verdict, reasons, approver_role. The first denial that applies stands alone; reasons for approval add up.

    actions: action_id, tenant_id, policy_tenant, action_type, domains array, irreversible, confidence. policies:
    tenant_id, autonomous, forbidden, readable arrays, floor, approver_role. implied adds a domain by action type.
    """
    p = policies.select(F.col("tenant_id").alias("policy_tenant"), *(F.col(c).alias(f"p_{c}") for c in ("autonomous", "forbidden", "readable", "floor", "approver_role")))
    rows = actions.join(p, "policy_tenant", "left")
    more = F.coalesce(*(F.when(F.col("action_type") == k, F.array(F.lit(v))) for k, v in (implied or {}).items()), F.array().cast("array<string>"))
    domains = F.array_union(F.coalesce("domains", F.array().cast("array<string>")), more)
    unread = F.array_sort(F.array_except(domains, F.coalesce("p_readable", F.array().cast("array<string>"))))
    why = F.array_compact(F.array(
        F.when(F.col("irreversible"), F.concat("action_type", F.lit(" cannot be undone"))),
        F.when(~F.array_contains("p_autonomous", F.col("action_type")), F.concat("action_type", F.lit(" is not delegated"))),
        F.when(F.col("confidence") < F.col("p_floor"), F.format_string("confidence %.2f is below %.2f", "confidence", "p_floor")),
    ))
    foreign = F.col("p_floor").isNull() | (F.col("tenant_id") != F.col("policy_tenant"))
    denial = (
        F.when(foreign, F.lit("the action belongs to another tenant")).when(F.array_contains("p_forbidden", F.col("action_type")), F.concat("action_type", F.lit(" is forbidden")))
        .when(F.size(unread) > 0, F.concat(F.lit("restricted data: "), F.array_join(unread, ", ")))
    )
    verdict = F.when(denial.isNotNull(), "DENY").when(F.size(why) > 0, "REQUIRE_HUMAN_APPROVAL").otherwise("ALLOW")
    out = rows.withColumn("verdict", verdict).withColumn("reasons", F.when(denial.isNotNull(), F.array(denial)).otherwise(why))
    return out.withColumn("approver_role", F.when(F.col("verdict") == "REQUIRE_HUMAN_APPROVAL", F.col("p_approver_role"))).select(*actions.columns, "verdict", "reasons", "approver_role")


def escalation(actions: DataFrame, trigger: str, role: str) -> DataFrame:
    return actions.select("action_id", F.lit("ESCALATE").alias("verdict"), F.array(F.lit(f"trigger: {trigger}")).alias("reasons"), F.lit(role).alias("escalate_to"))


# Workflows: runs (run_id), steps (run_id, step, status, requires array, optional)

DONE, FAILED, WAITING = ("COMPLETED", "SKIPPED"), "FAILED", "AWAITING_APPROVAL"


def run_status(steps: DataFrame) -> DataFrame:
    """run_id, status: FAILED if any step failed, COMPLETED if all are done, AWAITING_APPROVAL if any waits, else RUNNING."""
    s = F.col("status")
    out = F.when(F.bool_or(s == FAILED), FAILED).when(F.bool_and(s.isin(*DONE)), "COMPLETED").when(F.bool_or(s == WAITING), WAITING).otherwise("RUNNING")
    return steps.groupBy("run_id").agg(out.alias("status"))


def runnable_steps(steps: DataFrame) -> DataFrame:
    """run_id, step of pending steps all of whose dependencies are completed, or skipped where they are optional."""
    pending = steps.where("status = 'PENDING'").select("run_id", "step", F.explode_outer("requires").alias("needed"))
    have = steps.select("run_id", F.col("step").alias("needed"), ((F.col("status") == "COMPLETED") | ((F.col("status") == "SKIPPED") & F.col("optional"))).alias("fine"))
    met = pending.join(have, ["run_id", "needed"], "left").withColumn("fine", F.col("needed").isNull() | F.coalesce("fine", F.lit(False)))
    return met.groupBy("run_id", "step").agg(F.bool_and("fine").alias("fine")).where("fine").select("run_id", "step")


def pending_approvals(steps: DataFrame) -> DataFrame:
    return steps.where(F.col("status") == WAITING).select("run_id", "step")


def missing_context(required: Column, context: Column) -> Column:
    """Required keys that are absent, null or empty."""
    return F.array_except(required, F.map_keys(F.map_filter(context, lambda _, v: v.isNotNull() & (v != ""))))


def required_context(definition: DataFrame) -> DataFrame:
    """workflow and its distinct context keys in the order in which steps (workflow, position, context array) first name them."""
    keys = definition.select("workflow", "position", F.posexplode("context").alias("k", "key"))
    first = keys.groupBy("workflow", "key").agg(F.min(F.struct("position", "k")).alias("at"))
    return first.groupBy("workflow").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "key"))), lambda s: s["key"]).alias("keys"))


def definition_faults(definition: DataFrame) -> DataFrame:
    """workflow, step, fault: repeated steps, and dependencies that are not defined earlier."""
    twice = definition.groupBy("workflow", "step").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("workflow", "step", F.lit("defined twice").alias("fault"))
    needs = definition.select("workflow", "step", "position", F.explode("requires").alias("needed"))
    known = definition.select("workflow", F.col("step").alias("needed"), F.col("position").alias("at"))
    early = needs.join(known, ["workflow", "needed"], "left").groupBy("workflow", "step", "needed", "position").agg(F.min("at").alias("at"))
    return twice.union(early.where("at IS NULL OR at >= position").select("workflow", "step", F.concat(F.lit("needs "), "needed", F.lit(" earlier")).alias("fault")))


#: Workflow definitions of this engine: workflow, position, step, requires, needs_approval, optional, context.
WORKFLOWS = [
    ("screening", 0, "collect", [], False, False, ["record"]),
    ("screening", 1, "score", ["collect"], False, False, ["requirement"]),
    ("screening", 2, "decide", ["score"], True, False, ["requirement"]),
    ("retention", 0, "score_risk", [], False, False, ["snapshot"]),
    ("retention", 1, "plan_talk", ["score_risk"], True, False, ["manager"]),
    ("mobility", 0, "match", [], False, False, ["skills"]),
    ("mobility", 1, "propose", ["match"], True, True, ["role"]),
    ("onboarding", 0, "prepare", [], False, False, ["start_date"]),
    ("onboarding", 1, "welcome", ["prepare"], False, True, []),
]
WORKFLOW_COLUMNS = "workflow string, position int, step string, requires array<string>, needs_approval boolean, optional boolean, context array<string>"


def fold_runs(definition: DataFrame, events: DataFrame, max_attempts: int = 3, max_advances: int = 50) -> DataFrame:
    """run_id, step, status, attempts, approver after folding each run's events in order.

    events: run_id, workflow, seq, kind (start, approve, reject, succeed, fail, retry), step, actor. Ready steps advance by
    themselves up to max_advances: they run, or wait for approval. A run's events are few, so a run is one group.
    """
    steps = definition.groupBy("workflow").agg(F.array_sort(F.collect_list(F.struct("position", "step", "requires", "needs_approval", "optional"))).alias("steps"))
    joined = events.join(F.broadcast(steps), "workflow")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        plan = list(pdf["steps"].iloc[0])
        state = {s["step"]: ["PENDING", 0, None] for s in plan}

        def advance() -> None:
            for _ in range(max_advances):
                ready = next((s for s in plan if state[s["step"]][0] == "PENDING" and all(state[d][0] in DONE for d in s["requires"])), None)
                if ready is None:
                    return
                own = state[ready["step"]]
                own[0] = WAITING if ready["needs_approval"] and own[2] is None else "RUNNING"
                own[1] += own[0] == "RUNNING"

        for e in pdf.itertuples():
            own = state.get(e.step)
            if e.kind == "approve" and own and own[0] == WAITING:
                own[:] = ["RUNNING", own[1] + 1, e.actor]
            elif e.kind == "reject" and own and own[0] == WAITING:
                own[0], own[2] = FAILED, e.actor
            elif e.kind == "succeed" and own and own[0] == "RUNNING":
                own[0] = "COMPLETED"
            elif e.kind == "fail" and own and own[0] == "RUNNING":
                own[0] = FAILED
            elif e.kind == "retry" and own and own[0] == FAILED and own[1] < max_attempts:
                own[0] = "PENDING"
            advance()
        return pd.DataFrame([(pdf["run_id"].iloc[0], k, v[0], v[1], v[2]) for k, v in state.items()], columns=["run_id", "step", "status", "attempts", "approver"])

    return joined.groupBy("run_id").applyInPandas(fold, f"run_id {dict(events.dtypes)['run_id']}, step string, status string, attempts int, approver string")


def amendment_faults(amendments: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """Retry amendments (run_id, values map) that name unknown keys or leave one blank."""
    rows = amendments.select("run_id", F.explode("values").alias("key", "value"))
    return rows.where(~F.col("key").isin(*allowed) | (F.trim(F.coalesce("value", F.lit(""))) == ""))


def rebuild_runs(runs: DataFrame, steps: DataFrame, definition: DataFrame) -> DataFrame:
    """Runs with their steps as one array in order; steps that the definition doesn't know are left out."""
    known = steps.join(definition.select("workflow", "step", "position"), ["workflow", "step"])
    told = known.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("position", "step", "status"))).alias("steps"))
    return runs.join(told, "run_id", "left")


# Registry: events (name, version, seq, stage, actor, reason)

#: The stage after each stage.
EDGES = {
    "DRAFT": ("SHADOW", "ARCHIVED"), "SHADOW": ("CANARY", "ARCHIVED", "ROLLED_BACK"), "CANARY": ("LIVE", "ROLLED_BACK"),
    "LIVE": ("ROLLED_BACK", "ARCHIVED"), "ROLLED_BACK": ("ARCHIVED",), "ARCHIVED": (),
}


def illegal_transitions(events: DataFrame) -> DataFrame:
    """Registry events whose stage doesn't follow from the version's stage before."""
    own = Window.partitionBy("name", "version").orderBy("seq")
    rows = events.withColumn("before", F.coalesce(F.lag("stage").over(own), F.lit("")))
    allowed = F.map_from_arrays(F.array(*map(F.lit, ["", *EDGES])), F.array(F.array(F.lit("DRAFT")), *(F.array(*map(F.lit, v)) if v else F.array().cast("array<string>") for v in EDGES.values())))
    return rows.where(~F.array_contains(allowed[F.col("before")], F.col("stage")))


def current_stages(events: DataFrame) -> DataFrame:
    """name, version, stage, history. A later LIVE archives the earlier LIVE version; SHADOW and CANARY have one holder, the latest.

    Where the live version was withdrawn (rolled back or archived) and none has followed it, the newest version that was
    archived before is LIVE again.
    """
    before = F.lag("stage").over(Window.partitionBy("name", "version").orderBy("seq"))
    withdrawn = events.withColumn("before", before).where("before = 'LIVE' AND stage IN ('ROLLED_BACK', 'ARCHIVED')")
    withdrawn = withdrawn.groupBy("name").agg(F.max_by("version", "seq").alias("gone"), F.max("seq").alias("gone_at"))
    own = events.groupBy("name", "version").agg(
        F.max_by("stage", "seq").alias("stage"), F.max("seq").alias("at"), F.transform(F.array_sort(F.collect_list(F.struct("seq", "stage"))), lambda s: s["stage"]).alias("history")
    )
    newest = Window.partitionBy("name", "stage").orderBy(F.desc("at"))
    held = F.col("stage").isin("LIVE", "CANARY", "SHADOW") & (F.row_number().over(newest) > 1)
    told = own.withColumn("stage", F.when(held, F.lit("ARCHIVED")).otherwise(F.col("stage"))).join(withdrawn, "name", "left")
    ready = (F.col("stage") == "ARCHIVED") & (F.col("version") != F.col("gone")) & (F.col("at") < F.col("gone_at"))
    whole = Window.partitionBy("name")
    back = ~F.max(F.col("stage") == "LIVE").over(whole) & (F.col("version") == F.max(F.when(ready, F.col("version"))).over(whole))
    told = told.withColumn("stage", F.when(ready & back, F.lit("LIVE")).otherwise(F.col("stage")))
    return told.select("name", "version", "stage", "history")


def by_stage(stages: DataFrame, name: str, stage: str) -> DataFrame:
    return stages.where((F.col("name") == name) & (F.col("stage") == stage)).orderBy("version").limit(1)


def register(events: DataFrame, name: str, actor: str) -> DataFrame:
    """events with one more row: the next version of name as DRAFT."""
    row = events.agg((F.coalesce(F.max(F.when(F.col("name") == name, F.col("version"))), F.lit(0)) + 1).alias("version"), (F.coalesce(F.max("seq"), F.lit(0)) + 1).alias("seq"))
    return events.unionByName(row.select(F.lit(name).alias("name"), F.col("version").cast(events.schema["version"].dataType), F.col("seq").cast(events.schema["seq"].dataType), F.lit("DRAFT").alias("stage"), F.lit(actor).alias("actor"), F.lit("registered").alias("reason")))


def previous_eligible(versions: DataFrame, before: int) -> DataFrame:
    """The newest version older than `before` that the gate did not block and whose signature is valid."""
    return versions.where((F.col("version") < before) & (F.col("gate") != "BLOCK") & F.col("signature_valid")).orderBy(F.desc("version")).limit(1)


def stage_changes(events: DataFrame, since: int) -> DataFrame:
    """name, version, before, after of versions whose stage the events (name, version, seq, stage) after `since` have changed.

    A version that is new has no stage before. Changes that one event brings about in others (a live version that another
    replaces) are told too.
    """
    then = current_stages(events.where(F.col("seq") <= since)).select("name", "version", F.col("stage").alias("before"))
    now = current_stages(events).select("name", "version", F.col("stage").alias("after"))
    return now.join(then, ["name", "version"], "left").where(~F.col("after").eqNullSafe(F.col("before"))).select("name", "version", "before", "after")


def on_change(events: DataFrame, since: int, hook: Callable[[DataFrame], None]) -> int:
    """Calls hook with the changes after `since`, if there are any, and gives the last event's number to go on from."""
    last = events.agg(F.max("seq")).first()[0]
    if last is None or last <= since:
        return since
    changed = stage_changes(events, since)
    if not changed.isEmpty():
        hook(changed)
    return last


class Tools:
    """What carries out actions: one tool for each kind of action, a function of the steps of that kind."""

    def __init__(self):
        self._tools: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def register(self, action: str, tool: Callable[[DataFrame], DataFrame]) -> None:
        """tool gets steps (step_id, action_type, ...) and gives step_id, result. A second tool for an action is refused."""
        if action in self._tools:
            raise ValueError(f"{action} has a tool already")
        self._tools[action] = tool

    def invoke(self, steps: DataFrame) -> DataFrame:
        """step_id, action_type, result, error: each step by its action's tool. Steps without a tool, and those that their tool leaves out, have an error."""
        own = steps.select("step_id", "action_type")
        told = None
        for action, tool in self._tools.items():
            part = tool(steps.where(F.col("action_type") == action)).select("step_id", F.col("result").cast("string").alias("result"))
            told = part if told is None else told.unionByName(part)
        known = F.coalesce(F.col("action_type").isin(*self._tools), F.lit(False)) if self._tools else F.lit(False)
        joined = own.withColumn("result", F.lit(None).cast("string")) if told is None else own.join(told, "step_id", "left")
        error = F.when(~known, F.lit("no tool for this action")).when(F.col("result").isNull(), F.lit("the tool gave no result"))
        return joined.select("step_id", "action_type", "result", error.alias("error"))
