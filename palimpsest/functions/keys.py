"""Identity expressions: content hashes, name-based UUIDs, scope and event keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from palimpsest import constants as C
from palimpsest.functions import text as tx


def content_id(c: Column) -> Column:
    return F.sha2(c, 256)


def uuid5(name: Column) -> Column:
    """Version-5 UUID of ``name`` in the URL namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(C.UUID_NAMESPACE_URL)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4),
                       F.concat(F.lit("5"), F.substring(digest, 14, 3)),
                       F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def block_id(asset_id: Column, stable_key: Column) -> Column:
    return uuid5(F.concat_ws(":", asset_id, stable_key.cast("string")))


def child_id(parent_id: Column, position: Column) -> Column:
    return uuid5(F.concat_ws(":", parent_id, position.cast("string")))


def point_id(evidence_id: Column, binding_id: Column, prefix: str = "evidence") -> Column:
    """Stable id of one evidence row under one binding; ``prefix`` separates installations."""
    return uuid5(F.concat_ws(":", F.lit(prefix), evidence_id, binding_id.cast("string")))


def proposal_id(source_turn: Column, target: Column, prefix: str = "memory") -> Column:
    """The same proposal gets the same id on every retry."""
    return uuid5(F.concat_ws(":", F.lit(prefix), F.lit(C.CLAIM_CHANGE_COMMAND), source_turn, target))


def uuid_low_bits(uuid: Column) -> Column:
    """The low 63 bits of a UUID as a non-negative long."""
    tail = F.substring(F.regexp_replace(uuid, "-", ""), 17, 16)
    head = F.conv((F.conv(F.substring(tail, 1, 1), 16, 10).cast("int") % 8).cast("string"), 10, 16)
    return F.conv(F.concat(head, F.substring(tail, 2, 15)), 16, 10).cast("long")


def evidence_hash(df_columns: dict[str, Column]) -> Column:
    """SHA-256 over the provenance fields, in name order, nulls kept."""
    fields = [df_columns[name].alias(name) for name in sorted(df_columns)]
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)


def project_key(project_id: Column, project_scope: Column) -> Column:
    return F.coalesce(project_id, project_scope, F.lit(""))


def session_part(scope: Column, session_id: Column) -> Column:
    return F.when(scope == "session", F.coalesce(session_id, F.lit(""))).otherwise(F.lit(""))


def event_identifiers(event: Column) -> Column:
    """Distinct normalised identifiers: the explicit ones, else those named in the entities."""
    explicit = F.array_distinct(F.transform(event["identifier_references"], lambda r: r["normalized_value"]))
    return F.when(F.size(explicit) > 0, explicit).otherwise(tx.stable_identifiers(event["entities"]))


def event_domain(row_scope: dict[str, Column]) -> Column:
    """Owner, scope, session (session scope only) and project: where events may be compared."""
    return F.concat_ws(C.UNIT_SEPARATOR, row_scope["owner_id"], row_scope["scope"],
                       session_part(row_scope["scope"], row_scope["session_id"]),
                       project_key(row_scope["project_id"], row_scope["project_scope"]))


def _columns(names) -> dict[str, Column]:
    return {name: F.col(name) for name in names}


SCOPE_COLUMNS = ("owner_id", "scope", "session_id", "project_id", "project_scope")


def event_identity(event: Column) -> Column:
    """Fingerprint that is equal for exact repeats of an event in one domain."""
    explicit = F.transform(event["identifier_references"], lambda r: r["normalized_value"])
    identifiers = F.when(F.size(explicit) > 0, F.array_sort(explicit)).otherwise(
        F.array_sort(tx.stable_identifiers(event["entities"])))
    claims = F.transform(
        F.array_sort(F.transform(event["claims"], lambda c: F.struct(
            F.trim(tx.casefold(c["attribute"])).alias("a"), F.coalesce(c["normalized_value"], F.lit("")).alias("v")))),
        lambda c: F.concat(c["a"], F.lit("="), c["v"]))
    fallback = F.array(
        F.concat(F.lit("temporal_scope="), tx.loose_key(F.coalesce(event["temporal_scope"], F.lit("")))),
        F.concat(F.lit("locations="), F.array_join(F.array_sort(tx.loose_keys(event["locations"])), "|")))
    return F.sha2(F.concat_ws(
        C.UNIT_SEPARATOR, event_domain(_columns(SCOPE_COLUMNS)), F.array_join(identifiers, "|"),
        F.array_join(F.when(F.size(claims) > 0, claims).otherwise(fallback), "|")), 256)


def event_comparison_key(event: Column) -> Column:
    """Domain plus sorted identifiers; null when the event names none."""
    identifiers = F.array_sort(event_identifiers(event))
    return F.when(F.size(identifiers) > 0, F.concat_ws(
        C.UNIT_SEPARATOR, event_domain(_columns(SCOPE_COLUMNS)), F.array_join(identifiers, C.UNIT_SEPARATOR)))


def subject_scope_key(scope: Column, session_id: Column, project_id: Column, project_scope: Column) -> Column:
    return (F.when(scope == "session", F.concat(F.lit("session:"), F.coalesce(session_id, F.lit(""))))
            .when((scope == "project") & project_id.isNotNull(), F.concat(F.lit("project:"), project_id))
            .when(scope == "project", F.concat(F.lit("project-name:"),
                                               tx.name_key(F.coalesce(project_scope, F.lit("")))))
            .otherwise(scope))
