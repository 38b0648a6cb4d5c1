"""Claims, differences, retrieval text and payload normalisation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from palimpsest import constants as C, schemas
from palimpsest.functions import text as tx


def claim_map(event: Column) -> Column:
    """Claims as attribute -> value, the last one winning.

    An event without claims is described by its time and first location.
    """
    explicit = F.map_from_entries(F.transform(event["claims"], lambda c: F.struct(
        F.trim(tx.casefold(c["attribute"])), c["value"])))
    pair = lambda name, value: F.when(F.coalesce(value, F.lit("")) != "", F.struct(F.lit(name).alias("key"), value.alias("value")))
    implied = F.map_from_entries(F.filter(
        F.array(pair("temporal_scope", event["temporal_scope"]),
                pair("primary_location", F.try_element_at(event["locations"], F.lit(1)))),
        lambda e: e.isNotNull()))
    return F.when(F.size(event["claims"]) > 0, explicit).otherwise(implied)


def claim_differences(existing: Column, incoming: Column) -> Column:
    """Attributes whose values differ, sorted, with both values."""
    attributes = F.array_sort(F.array_union(F.map_keys(existing), F.map_keys(incoming)))
    pairs = F.transform(attributes, lambda a: F.struct(
        a.alias("attribute"), existing[a].alias("existing"), incoming[a].alias("incoming")))
    return F.filter(pairs, lambda p: ~p["existing"].eqNullSafe(p["incoming"]))


def differences_text(differences: Column) -> Column:
    return F.array_join(F.transform(differences, lambda p: F.concat(
        p["attribute"], F.lit(":"), F.coalesce(p["existing"], F.lit("")), F.lit(">"),
        F.coalesce(p["incoming"], F.lit("")))), ";")


def best_references(references: Column) -> Column:
    """One reference per (scheme, value): the most confident, the first among equals."""
    same = lambda a, b: (a["scheme"] == b["scheme"]) & (a["normalized_value"] == b["normalized_value"])
    return F.filter(references, lambda r, i: ~F.exists(
        F.transform(references, lambda o, j: F.struct(o.alias("ref"), j.alias("pos"))),
        lambda other: same(other["ref"], r) & (
            (other["ref"]["confidence"] > r["confidence"])
            | ((other["ref"]["confidence"] == r["confidence"]) & (other["pos"] < i)))))


def shares_claim_attribute(existing: Column, incoming: Column) -> Column:
    names = lambda event: F.transform(event["claims"], lambda c: F.trim(tx.casefold(c["attribute"])))
    return F.arrays_overlap(names(existing), names(incoming))


def is_target_update(kind: Column, existing: Column, incoming: Column) -> Column:
    """Same claim schema and at least one changed value."""
    return ((kind == "event") & shares_claim_attribute(existing, incoming)
            & (F.size(claim_differences(claim_map(existing), claim_map(incoming))) > 0))


def _suffix(label: str, value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f" {label}: "), value, F.lit("."))
                  ).otherwise(F.lit(""))


def memory_text(kind: Column, payload: Column) -> Column:
    """The sentence that stands for a memory in retrieval, one form per kind."""
    k, p, s, n, e = (payload[kind_name] for kind_name in C.MEMORY_KINDS)
    knowledge = F.concat(k["subject"], F.lit(" "), k["predicate"], F.lit(" "), k["object"], F.lit("."))
    preference = F.concat(F.lit("The user prefers "), p["preferred_behavior"], F.lit("."),
                          _suffix("Applicable when", F.array_join(p["applicability_conditions"], ", ")))
    environment = F.array_join(F.transform(
        F.map_entries(s["environment"]), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ", ")
    solution = F.concat(
        F.lit("Problem: "), s["problem_signature"], F.lit(". Environment: "), environment, F.lit(". Steps: "),
        F.array_join(s["steps"], "; "), F.lit(". Outcome: "),
        F.coalesce(F.nullif(s["outcome"], F.lit("")), F.lit("not specified")), F.lit("."))
    entity = F.concat(F.lit("Entity: "), n["canonical_name"], F.lit(". Type: "), n["entity_type"],
                      F.lit(". Aliases: "), F.array_join(n["aliases"], ", "), F.lit("."))
    event = F.concat(
        F.lit("Project event ("), e["event_type"], F.lit("): "), e["summary"], F.lit(". Entities: "),
        F.array_join(e["entities"], ", "), F.lit(". Locations: "), F.array_join(e["locations"], ", "), F.lit("."),
        _suffix("Timing", e["temporal_scope"]),
        _suffix("Identifiers", F.array_join(F.transform(e["identifier_references"], lambda r: r["value"]), ", ")),
        _suffix("Current explicit values", F.array_join(F.transform(
            e["claims"], lambda c: F.concat(c["attribute"], F.lit("="), c["value"])), "; ")))
    return (F.when(kind == "knowledge", knowledge).when(kind == "preference", preference)
            .when(kind == "solution", solution).when(kind == "event", event).otherwise(entity))


# --- supplied payloads ------------------------------------------------------

STRENGTH_WORDS = {"low": 0.3, "medium": 0.6, "high": 0.9}
CONSENT_WORDS = ["true", "yes", "explicit", "confirmed"]


def unwrap(kind: Column, raw: Column) -> Column:
    """The JSON text of the payload itself, without a repeated kind around it."""
    inner = F.call_function("get_json_object", raw, F.concat(F.lit("$."), kind))
    return F.when(inner.startswith("{"), inner).otherwise(raw)


def _first_text(raw: Column, *names: str) -> Column:
    return F.coalesce(*[F.nullif(F.get_json_object(raw, f"$.{name}"), F.lit("")) for name in names])


def _text_list(raw: Column, name: str) -> Column:
    """A list, or a single string taken as a list of one; null when absent."""
    value = F.get_json_object(raw, f"$.{name}")
    return F.when(value.startswith("["), F.from_json(value, "array<string>")).otherwise(
        F.when(value.isNotNull(), F.array(value)))


def normalise_preference(raw: Column) -> Column:
    strength = F.get_json_object(raw, "$.strength")
    by_word = F.lit(0.5)
    for word, number in STRENGTH_WORDS.items():
        by_word = F.when(F.lower(strength) == word, F.lit(number)).otherwise(by_word)
    consent = F.lower(F.get_json_object(raw, "$.consent"))
    return F.struct(
        F.coalesce(F.get_json_object(raw, "$.preferred_behavior"),
                   _first_text(raw, "preferred_behaviour", "phrase", "description", "requirement")
                   ).alias("preferred_behavior"),
        F.coalesce(_text_list(raw, "applicability_conditions"), F.array().cast("array<string>")
                   ).alias("applicability_conditions"),
        F.when(strength.isNull(), F.lit(0.5)).otherwise(
            F.coalesce(strength.try_cast("double"), by_word)).alias("strength"),
        F.coalesce(consent.isin(CONSENT_WORDS), F.lit(False)).alias("consent"))


def normalise_entity(raw: Column) -> Column:
    body = F.from_json(raw, f"struct<{schemas.PAYLOAD_BRANCHES['entity']}>")
    none = F.array().cast("array<string>")
    return F.struct(
        F.coalesce(body["canonical_name"], _first_text(raw, "name")).alias("canonical_name"),
        body["entity_type"].alias("entity_type"), F.coalesce(body["aliases"], none).alias("aliases"),
        body["external_ids"].alias("external_ids"), F.coalesce(body["graph_links"], none).alias("graph_links"))


def normalise_event(raw: Column) -> Column:
    """Event payload with renamed lists mapped back, labels and values normalised, defaults set."""
    none = F.array().cast("array<string>")

    def build(body):
        renamed = lambda name, other, ddl: F.coalesce(
            body[name], F.from_json(F.get_json_object(raw, f"$.{other}"), f"array<{ddl}>"), F.array().cast(f"array<{ddl}>"))
        label = F.trim(F.coalesce(body["event_type"], F.lit("")))
        references = F.transform(renamed("identifier_references", "identifier_refs", schemas.IDENTIFIER), lambda r: F.struct(
            F.coalesce(r["scheme"], F.lit("external_reference")).alias("scheme"), r["value"].alias("value"),
            F.coalesce(F.nullif(r["normalized_value"], F.lit("")), tx.identifier_key(r["value"])).alias("normalized_value"),
            r["mention"].alias("mention"), F.coalesce(r["confidence"], F.lit(0.75)).alias("confidence")))
        claims = F.transform(renamed("claims", "event_claims", schemas.CLAIM), lambda c: F.struct(
            c["attribute"].alias("attribute"), c["value"].alias("value"),
            F.coalesce(F.nullif(c["normalized_value"], F.lit("")), tx.name_key(c["value"])).alias("normalized_value"),
            F.coalesce(c["confidence"], F.lit(0.75)).alias("confidence")))
        return F.struct(
            tx.event_label(label).alias("event_type"), F.coalesce(body["event_type_raw"], label).alias("event_type_raw"),
            body["summary"].alias("summary"), F.coalesce(body["entities"], none).alias("entities"),
            F.coalesce(body["locations"], none).alias("locations"), body["temporal_scope"].alias("temporal_scope"),
            references.alias("identifier_references"), claims.alias("claims"))

    return tx.let(F.from_json(raw, f"struct<{schemas.PAYLOAD_BRANCHES['event']}>"), build)


def normalise(kind: Column, raw: Column) -> Column:
    """Supplied JSON payload -> the typed union, only the branch of ``kind`` set."""
    def build(body):
        plain = lambda name: F.from_json(body, f"struct<{schemas.PAYLOAD_BRANCHES[name]}>")
        branches = {"knowledge": plain("knowledge"), "preference": normalise_preference(body),
                    "solution": plain("solution"), "entity": normalise_entity(body), "event": normalise_event(body)}
        return F.struct(*[
            F.when(kind == name, branch).cast(f"struct<{schemas.PAYLOAD_BRANCHES[name]}>").alias(name)
            for name, branch in branches.items()])

    return tx.let(unwrap(kind, raw), build)


def _between(c: Column, low: int, high: int) -> Column:
    return F.length(c).between(low, high)


def payload_valid(kind: Column, payload: Column) -> Column:
    """Field constraints of each payload kind."""
    k, p, s, n, e = (payload[name] for name in C.MEMORY_KINDS)
    rules = {
        "knowledge": _between(k["subject"], 1, 2000) & _between(k["predicate"], 1, 500) & _between(k["object"], 1, 4000),
        "preference": _between(p["preferred_behavior"], 1, 4000) & p["strength"].between(0.0, 1.0),
        "solution": _between(s["problem_signature"], 1, 4000) & (F.size(s["steps"]) >= 1),
        "entity": _between(n["canonical_name"], 1, 1000) & _between(n["entity_type"], 1, 500),
        "event": (_between(e["event_type"], 1, 500) & _between(e["summary"], 1, 4000) & (F.size(e["entities"]) <= 20)
                  & (F.size(e["locations"]) <= 20) & (F.size(e["identifier_references"]) <= 20)
                  & (F.size(e["claims"]) <= 30)
                  & F.forall(e["identifier_references"], lambda r: F.length(r["normalized_value"]) > 0)),
    }
    ok = F.lit(False)
    for name, rule in rules.items():
        ok = F.when(kind == name, F.coalesce(rule, F.lit(False))).otherwise(ok)
    return ok
