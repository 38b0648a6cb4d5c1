"""Visibility: who may see which row, stated once for every operator.

A record carries exactly one visibility key, a chat carries at most three.
Matching chats to records is therefore one equi-join on that key, never an OR
of conditions that would fall back to a nested-loop join.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, functions as F

from palimpsest import constants as C


def at(now: datetime | str | Column) -> Column:
    return now if isinstance(now, Column) else F.to_timestamp(F.lit(str(now)))


def within_validity(valid_from: Column, valid_to: Column, now) -> Column:
    """``valid_from <= now < valid_to``; an open end never expires."""
    return (valid_from <= at(now)) & (valid_to.isNull() | (valid_to > at(now)))


def is_current(now, prefix: str = "") -> Column:
    c = lambda name: F.col(prefix + name)
    return ((c("status") == "active") & c("user_confirmed")
            & within_validity(c("valid_from"), c("valid_to"), now))


def is_projectable(now, prefix: str = "") -> Column:
    """May the memory appear in the derived graph at ``now``?"""
    return F.coalesce(F.col(prefix + "scope").isin(C.PROJECTED_SCOPES) & is_current(now, prefix), F.lit(False))


def is_vector_eligible() -> Column:
    return F.coalesce(F.col("scope").isin(C.PROJECTED_SCOPES) & (F.col("status") == "active")
                      & F.col("user_confirmed"), F.lit(False))


def _key(kind: str, owner: Column, value: Column) -> Column:
    return F.concat_ws(C.UNIT_SEPARATOR, F.lit(kind), owner, value)


def record_key(prefix: str = "") -> Column:
    """The one place from which a record can be seen; null when it never can."""
    c = lambda name: F.col(prefix + name)
    return (F.when((c("scope") == "session") & c("session_id").isNotNull(),
                   _key("session", c("owner_id"), c("session_id")))
            .when((c("scope") == "project") & c("project_id").isNotNull(),
                  _key("project", c("owner_id"), c("project_id")))
            .when((c("scope") == "project") & c("project_scope").isNotNull(),
                  _key("name", c("owner_id"), c("project_scope"))))


def chat_keys(prefix: str = "") -> Column:
    """Places visible to a chat: its session, its project id, its project name."""
    c = lambda name: F.col(prefix + name)
    return F.filter(F.array(
        F.when(c("session_id").isNotNull(), _key("session", c("owner_id"), c("session_id"))),
        F.when(c("project_id") != "", _key("project", c("owner_id"), c("project_id"))),
        F.when(c("project_scope") != "", _key("name", c("owner_id"), c("project_scope")))), lambda k: k.isNotNull())


def index_keys(prefix: str = "") -> Column:
    """Places under which the index finds a record.

    Unlike the authority check, the index also matches the project name of a
    record that has a project id.
    """
    c = lambda name: F.col(prefix + name)
    return F.filter(F.array(
        F.when((c("scope") == "session") & c("session_id").isNotNull(),
               _key("session", c("owner_id"), c("session_id"))),
        F.when((c("scope") == "project") & c("project_id").isNotNull(),
               _key("project", c("owner_id"), c("project_id"))),
        F.when((c("scope") == "project") & c("project_scope").isNotNull(),
               _key("name", c("owner_id"), c("project_scope")))), lambda k: k.isNotNull())


def binding_key(prefix: str = "") -> Column:
    """Place from which an evidence binding can be seen."""
    c = lambda name: F.col(prefix + name)
    return (F.when(c("scope") == "session", _key("session", c("owner_id"), c("session_id")))
            .when(c("scope") == "project", _key("project", c("owner_id"), c("project_id"))))


def evidence_chat_keys(prefix: str = "") -> Column:
    c = lambda name: F.col(prefix + name)
    return F.filter(F.array(
        _key("session", c("owner_id"), c("session_id")),
        F.when(c("project_id").isNotNull(), _key("project", c("owner_id"), c("project_id")))),
        lambda k: k.isNotNull())


def applicable_scopes() -> Column:
    """(scope, field, value) constraints of a chat, in precedence order."""
    constraint = lambda scope, field: F.when(
        (F.col(field) != ""), F.struct(F.lit(scope).alias("visibility_scope"),
                                       F.lit(field).alias("constraint_field"), F.col(field).alias("constraint_value")))
    return F.filter(F.array(constraint("session", "session_id"), constraint("project", "project_id"),
                            constraint("project", "project_scope")), lambda s: s.isNotNull())


def same_partition(a: str, b: str) -> Column:
    """May two records form one graph edge?  Never across owners, sessions or projects."""
    l, r = (lambda n: F.col(a + n)), (lambda n: F.col(b + n))
    by_session = l("session_id").isNotNull() & (l("session_id") == r("session_id"))
    by_id = l("project_id").isNotNull() & (l("project_id") == r("project_id"))
    by_name = (l("project_id").isNull() & r("project_id").isNull()
               & l("project_scope").isNotNull() & (l("project_scope") == r("project_scope")))
    return F.coalesce(
        (l("owner_id") == r("owner_id")) & (l("scope") == r("scope"))
        & F.when(l("scope") == "session", by_session).when(l("scope") == "project", by_id | by_name)
        .otherwise(F.lit(False)), F.lit(False))


def is_projectable_edge(now, source: str, target: str) -> Column:
    lineage = (F.col(source + "status") == "superseded") & is_projectable(now, target)
    other = is_projectable(now, source) & is_projectable(now, target)
    return same_partition(source, target) & F.when(F.col("relationship_type") == "superseded_by", lineage).otherwise(other)


def violations(checks: dict[str, Column]) -> Column:
    """Names of the failed constraints of a row."""
    return F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]),
                    lambda v: v.isNotNull())


def memory_checks() -> dict[str, Column]:
    c = F.col
    return {
        "scope": c("scope").isin(C.MEMORY_SCOPES),
        "kind": c("kind").isin(C.MEMORY_KINDS),
        "status": c("status").isin(C.MEMORY_STATUSES),
        "confidence": c("confidence").between(0.0, 1.0),
        "session_id": (c("scope") != "session") | (F.coalesce(c("session_id"), F.lit("")) != ""),
        "project": (c("scope") != "project") | (F.coalesce(c("project_id"), c("project_scope"), F.lit("")) != ""),
    }


def payload_checks() -> dict[str, Column]:
    """The payload branch named by ``kind`` is set and no other one is."""
    branch_set = [F.col("payload")[kind].isNotNull() for kind in C.MEMORY_KINDS]
    total = sum((b.cast("int") for b in branch_set[1:]), branch_set[0].cast("int"))
    named = F.lit(False)
    for kind, present in zip(C.MEMORY_KINDS, branch_set):
        named = named | ((F.col("kind") == kind) & present)
    return {"one_branch": total == 1, "kind_matches_payload": named}


def binding_checks() -> dict[str, Column]:
    c = F.col
    return {
        "scope": c("scope").isin(C.PROJECTED_SCOPES),
        "session_xor_project": F.when(c("scope") == "session", c("session_id").isNotNull() & c("project_id").isNull())
        .otherwise(c("project_id").isNotNull() & c("session_id").isNull()),
    }


def mime_type_ok(c: Column) -> Column:
    return c.rlike(r"^[^/\s]+/[^/\s]+$") & F.length(c).between(1, 255)


