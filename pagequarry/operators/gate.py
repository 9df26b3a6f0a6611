"""The gate: findings and unverifiable checks per (system, page), their severity by a policy, and one decision a page.

The order of the decision's conditions is the contract.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Defaults of the policy (fixed values).
POLICY = {
    "discard": "archive", "unusable": "defer", "reject": None, "escalate": None,
    "override": {"archive": {"C6-05": "MAJOR", "C6-06": "MAJOR"}, "drop": {}},
    "tasks": {"C1": "E1", "C2": "E2", "C3": "E2", "C4": "E3", "C5": "E2", "C6": "E4", "C7": "E6", "C8": "E6"},
    "task_order": ["E1", "E2", "E3", "E4", "E6"],
    "weights": {"MAJOR": 0.25, "ADV": 0.05, "unverifiable": 0.15},
}
#: Severity of each check before the policy has its say (fixed values).
SEVERITY = {
    "C1-01": "BLOCK", "C1-02": "BLOCK", "C1-03": "BLOCK", "C1-04": "BLOCK", "C1-05": "BLOCK", "C1-06": "MAJOR", "C1-07": "MAJOR", "C2-01": "MAJOR", "C2-06": "ADV", "C3-01": "ADV", "C3-02": "BLOCK", "C3-05": "MAJOR",
    "C4-02": "BLOCK", "C4-03": "BLOCK", "C4-07": "MAJOR", "C4-08": "BLOCK", "C4-09": "ADV", "C4-10": "MAJOR", "C4-11": "ADV", "C5-01": "MAJOR", "C5-03": "MAJOR", "C5-04": "BLOCK", "C6-01": "BLOCK", "C6-02": "BLOCK", "C6-03": "ADV",
    "C6-05": "BLOCK", "C6-06": "BLOCK", "C7-01": "BLOCK", "C7-03": "ADV", "C7-04": "BLOCK", "C7-05": "ADV", "C8-01": "MAJOR", "C8-02": "ADV", "C8-03": "ADV", "C8-05": "MAJOR", "C8-06": "ADV",
}


def lookup(mapping: dict[str, str], key: Column) -> Column:
    return F.element_at(F.expr("map(" + ", ".join(f"'{k}', '{v}'" for k, v in mapping.items()) + ")"), key) if mapping else F.lit(None).cast("string")


def severity(check: Column, policy: dict) -> Column:
    return lookup(SEVERITY | policy["override"][policy["discard"]], check)


def decide(pages: DataFrame, policy: dict | None = None) -> DataFrame:
    """(sys, page_id, decision, task, n_block, n_major, n_adv, n_unverifiable, risk): one decision for each row of ``pages``.

    ``pages`` has sys, page_id, psr_trust, found, the ids of the checks that fired, and skipped, those that could not run.
    An unusable page is deferred or escalated; then blocking findings escalate by the first task in order, then blocking
    checks that could not run, then risk by its thresholds, where the policy has them; else the page is accepted.
    n_unverifiable counts the other checks that could not run. All of it is read off the row: nothing is joined.
    """
    p = POLICY | (policy or {})
    of = lambda level, ids="found": F.filter(ids, lambda c: severity(c, p) == level)
    rank = {family: p["task_order"].index(task) for family, task in p["tasks"].items()}
    ranks = F.expr("map(" + ", ".join(f"'{k}', {v}" for k, v in rank.items()) + ")")
    first = lambda ids: F.array_min(F.transform(ids, lambda c: F.element_at(ranks, F.substring(c, 1, 2))))
    x = pages.select("sys", "page_id", "psr_trust", *[F.size(of(level)).alias(n) for level, n in (("BLOCK", "n_block"), ("MAJOR", "n_major"), ("ADV", "n_adv"))], first(of("BLOCK")).alias("first_block"), first(F.col("found")).alias("first_any"), F.size(of("BLOCK", "skipped")).alias("n_veto"), F.size("skipped").alias("n_skipped"))
    x = x.withColumn("n_unverifiable", F.col("n_skipped") - F.col("n_veto"))
    w = p["weights"]
    risk = F.round(F.least(F.lit(1.0), w["MAJOR"] * F.col("n_major") + w["ADV"] * F.col("n_adv") + w["unverifiable"] * F.col("n_unverifiable")), 4)
    x = x.withColumn("risk", risk)
    order = F.array(*[F.lit(t) for t in p["task_order"]])
    task = lambda c: F.coalesce(F.get(order, F.col(c)), F.lit("E6"))
    unusable, blocked, unsure = F.col("psr_trust") == "unusable", F.col("n_block") > 0, F.col("n_veto") > 0
    never = F.lit(False)
    rejected = F.col("risk") >= p["reject"] if p["reject"] is not None else never
    risky = F.col("risk") >= p["escalate"] if p["escalate"] is not None else never
    decision = F.when(unusable, "defer" if p["unusable"] == "defer" else "escalate").when(blocked | unsure, "escalate").when(rejected, "reject").when(risky, "escalate").otherwise("accept")
    what = F.when(unusable, None if p["unusable"] == "defer" else "E6").when(blocked, task("first_block")).when(unsure, "E6").when(rejected, None).when(risky, task("first_any"))
    return x.select("sys", "page_id", decision.alias("decision"), what.alias("task"), "n_block", "n_major", "n_adv", "n_unverifiable", "risk")


def blocking(policy: dict | None = None) -> list[str]:
    """Checks whose findings block a page by themselves."""
    p = POLICY | (policy or {})
    return sorted(k for k, level in (SEVERITY | p["override"][p["discard"]]).items() if level == "BLOCK")


def escalated(fires: dict[str, Column], unsure: dict[str, Column], policy: dict | None = None) -> Column:
    """Whether ``decide`` escalates a page, from the blocking checks alone: those that fire (strongest), and those that could
    not run. Without thresholds of risk in the policy no other check has a say in it."""
    p = POLICY | (policy or {})
    if p["reject"] is not None or p["escalate"] is not None:
        raise ValueError("thresholds of risk take all checks")
    any_ = F.lit(False)
    for k in blocking(policy):
        if k in fires:
            any_ = any_ | F.coalesce(fires[k], F.lit(False)) | F.coalesce(unsure[k], F.lit(False))
    return F.when(F.col("psr_trust") == "unusable", F.lit(p["unusable"] != "defer")).otherwise(any_)


def audit_sample(accepted: DataFrame, rate: float, seed: int) -> DataFrame:
    """Accepted pages of the random audit. Membership is a hash of seed, system and page, so growth or order of the table
    never moves a page in or out."""
    key = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("sys").cast("string"), F.col("page_id").cast("string")), 256)
    return accepted.where(F.conv(F.substring(key, 1, 8), 16, 10).cast("long") < int(rate * 2**32))


def review_queue(decisions: DataFrame, rate: float, seed: int) -> DataFrame:
    """Escalations and audited pages in the order they are worked on: (task, sys, page_id, risk)."""
    audits = audit_sample(decisions.where("decision = 'accept'"), rate, seed).withColumn("task", F.lit("E7"))
    return decisions.where("decision = 'escalate'").unionByName(audits).select("task", "sys", "page_id", "risk").orderBy("task", F.desc("risk"), "sys", "page_id")


def estimate(verdicts: DataFrame) -> DataFrame:
    """Error estimates from reviewers' verdicts; only audited pages speak for accepted ones."""
    from pagequarry.functions.geometry import wilson

    s = verdicts.agg(
        F.count_if(F.col("frame") == "audit").alias("audit_n"), F.count_if((F.col("frame") == "audit") & (F.col("outcome") != "confirm")).alias("audit_wrong"),
        F.count_if(F.col("frame") == "escalation").alias("escalation_n"), F.count_if((F.col("frame") == "escalation") & (F.col("outcome") != "confirm")).alias("escalation_right"),
    )
    lo, hi = wilson(F.col("audit_wrong").cast("double"), F.col("audit_n").cast("double"))
    return s.select("*", F.round(F.col("audit_wrong") / F.col("audit_n"), 6).alias("false_accept"), F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))
