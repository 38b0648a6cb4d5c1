"""Small typed inputs shared by the tests."""

from datetime import datetime

from pyspark.sql import functions as F

from palimpsest import schemas

NOW = "2024-01-20 00:00:00"
RECORD = {
    "memory_id": "m", "subject_id": None, "owner_id": "o", "scope": "project", "session_id": "s1", "project_id": "p1",
    "project_scope": "Alpha", "kind": "event", "status": "active", "confidence": 0.9, "user_confirmed": True,
    "evidence_refs": [], "source_turn_id": "t1", "extraction_model": "", "extraction_version": "", "identity_key": None,
    "valid_from": datetime(2024, 1, 1), "valid_to": None, "superseded_by": None, "payload": None,
    "created_at": datetime(2024, 1, 1), "updated_at": datetime(2024, 1, 1)}


def ref(value, scheme="external_reference", confidence=0.9):
    return {"scheme": scheme, "value": value, "normalized_value": "".join(ch for ch in value.lower() if ch.isalnum()),
            "mention": value, "confidence": confidence}


def claim(attribute, value):
    return {"attribute": attribute, "value": value, "normalized_value": " ".join(value.lower().split()), "confidence": 0.75}


def event(refs=(), claims=(), time=None, entities=(), locations=(), summary="Something happened", label="shipment"):
    return {"event": {"event_type": label, "event_type_raw": label, "summary": summary, "entities": list(entities),
                      "locations": list(locations), "temporal_scope": time, "identifier_references": list(refs), "claims": list(claims)}}


def records(spark, rows):
    return spark.createDataFrame([{**RECORD, **row} for row in rows], schemas.schema("memory_records"))


def table(spark, name, rows):
    declared = schemas.schema(name)
    blank = {field.name: None for field in declared}
    return spark.createDataFrame([{**blank, **row} for row in rows], declared)


def values(df, *columns):
    return sorted([tuple(row) for row in df.select(*columns).collect()], key=repr)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit_list(items, kind="string"):
    return F.array(*[F.lit(i) for i in items]).cast(f"array<{kind}>")
