"""Organisation roles and tool policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.scoring import lookup

# Role ranks.
ROLE_RANK = {"viewer": 0, "member": 1, "admin": 2, "owner": 3}


def role_at_least(role: Column, minimum: str) -> Column:
    return F.coalesce(lookup(ROLE_RANK, role) >= ROLE_RANK[minimum], F.lit(False))


def decide(requests: DataFrame, members: DataFrame, policies: DataFrame) -> DataFrame:
    """Allowed flag for each tool request: role and policy exist, remote use and tool permitted.

    ``requests``: ``organization, workspace, principal, tool, remote``. The same plan runs on
    a stream of requests with static members and policies.
    """
    roles = members.select("organization", "principal", "role")
    rules = policies.select("organization", "workspace", "allowed_tools", "remote_access")
    joined = requests.join(roles, ["organization", "principal"], "left").join(
        rules, ["organization", "workspace"], "left"
    )
    tool_ok = F.array_contains("allowed_tools", "*") | F.array_contains("allowed_tools", F.col("tool"))
    remote_ok = ~F.col("remote") | F.col("remote_access")
    known = F.col("role").isNotNull() & F.col("allowed_tools").isNotNull()
    return joined.select(
        *requests.columns, F.coalesce(known & remote_ok & tool_ok, F.lit(False)).alias("allowed")
    )


def audit_rows(decisions: DataFrame) -> DataFrame:
    """The audit record each decision leaves."""
    return decisions.select(
        "organization",
        "workspace",
        F.col("principal").alias("actor"),
        F.lit("tool.authorize").alias("action"),
        F.col("tool").alias("resource"),
        F.when(F.col("allowed"), "allowed").otherwise("denied").alias("outcome"),
        F.create_map(F.lit("remote"), F.col("remote").cast("string")).alias("metadata"),
    )
