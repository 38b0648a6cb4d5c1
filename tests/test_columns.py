"""Column expressions against literal cases."""

import uuid

from helpers import event, lit_list, one, records, ref, claim, values
from pyspark.sql import functions as F

from palimpsest.functions import keys, payload as pl, temporal, text as tx


def test_labels_and_keys(spark):
    assert one(spark, tx.event_label(F.lit("delivery delay"))) == "delivery_delay"
    assert one(spark, tx.event_label(F.lit(" Shipment! "))) == "shipment"
    assert one(spark, tx.identifier_key(F.lit("EK-420"))) == "ek420"
    assert one(spark, tx.name_key(F.lit("  Straße  NORD "))) == "strasse nord"
    assert one(spark, tx.loose_key(F.lit("A-b,  C"))) == "a b c"


def test_uuid5_equals_python(spark):
    for name in ("doc:0", "évidence:ß:1", ""):
        assert one(spark, keys.uuid5(F.lit(name))) == str(uuid.uuid5(uuid.NAMESPACE_URL, name))
    known = uuid.uuid5(uuid.NAMESPACE_URL, "x")
    assert one(spark, keys.uuid_low_bits(F.lit(str(known)))) == known.int % 2**63


def test_identifier_mentions(spark):
    text = "Review AC-42, EK420, EXP-2026-01, EK-420 and ticket 123456 or 42."
    found = one(spark, F.transform(tx.identifier_mentions(F.lit(text)), lambda r: r["normalized_value"]))
    assert found == ["ac42", "ek420", "exp202601", "123456"]


def test_titles(spark):
    ten = "one two three four five six seven eight nine ten"
    assert one(spark, tx.title_from_message(F.lit(ten))) == "one two three four five six seven…"
    assert one(spark, tx.title_from_message(F.lit("   "))) == "New chat"
    assert len(one(spark, tx.title_from_message(F.lit("word" * 5 + " " + "letters" * 8)))) <= 49
    assert one(spark, tx.clean_title(F.lit('"Shipping plan for May."'))) == "Shipping plan for May"


def test_urls_and_subqueries(spark):
    assert one(spark, tx.without_urls(F.lit("see https://a.b/c now"))) == "see  now"
    assert one(spark, tx.without_urls(F.lit("https://a.b/c"))) == "https://a.b/c"
    original = F.lit("what is the first thing and the second thing")
    proposed = lit_list(["first  question here", "First question HERE", "short", "second question here"])
    assert one(spark, tx.valid_subqueries(proposed, original)) == ["first question here"]
    assert one(spark, tx.valid_subqueries(lit_list(["a long question", "another question"]), original)) == ["a long question", "another question"]


def test_validity_from_wording(spark):
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    end = lambda words, scope=None: str(one(spark, temporal.event_valid_to(F.lit(words), F.lit(scope).cast("string"), start)))
    assert end("arrives in 2 days") == "2024-01-10 00:00:00"
    assert end("Tomorrow at noon") == "2024-01-09 00:00:00"
    assert end("some time", "in 1 month") == "2024-02-07 00:00:00"
    assert end("no date") == "2024-01-31 00:00:00"


def test_claims_and_differences(spark):
    rows = records(spark, [
        {"memory_id": "a", "payload": event(claims=[claim(" Amount", "1"), claim("amount", "2")])},
        {"memory_id": "b", "payload": event(time="Friday", locations=["Depot"])}])
    maps = dict(values(rows.select("memory_id", pl.claim_map(F.col("payload.event")).alias("m")), "memory_id", "m"))
    assert maps == {"a": {"amount": "2"}, "b": {"temporal_scope": "Friday", "primary_location": "Depot"}}


def test_best_reference_keeps_first_of_equals(spark):
    rows = records(spark, [{"payload": event(refs=[ref("AB-1", confidence=0.5), {**ref("ab 1"), "confidence": 0.9}, {**ref("A B1"), "confidence": 0.9}])}])
    kept = rows.select(pl.best_references(F.col("payload.event.identifier_references")).alias("r")).first()["r"]
    assert [r["value"] for r in kept] == ["ab 1"]


def test_payload_aliases(spark):
    raw = '{"event":{"event_type":"Delivery Delay","summary":"late","identifier_refs":[{"value":"EK-420"}],"event_claims":[{"attribute":"a","value":"Two  Words"}]}}'
    typed = one(spark, pl.normalise(F.lit("event"), F.lit(raw)))
    assert typed["event"]["event_type"] == "delivery_delay" and typed["event"]["event_type_raw"] == "Delivery Delay"
    assert typed["event"]["identifier_references"][0]["normalized_value"] == "ek420"
    assert typed["event"]["claims"][0]["normalized_value"] == "two words" and typed["preference"] is None
    assert one(spark, pl.payload_valid(F.lit("event"), pl.normalise(F.lit("event"), F.lit(raw))))
    assert not one(spark, pl.payload_valid(F.lit("solution"), pl.normalise(F.lit("solution"), F.lit('{"problem_signature":"x","steps":[]}'))))


def test_memory_text(spark):
    rows = records(spark, [{"payload": event(refs=[ref("EK-420")], claims=[claim("Status", "Late")], time="Friday", entities=["a", "b"], summary="Order moved")}])
    text = rows.select(pl.memory_text(F.col("kind"), F.col("payload")).alias("x")).first()["x"]
    assert text == ("Project event (shipment): Order moved. Entities: a, b. Locations: . Timing: Friday. Identifiers: EK-420."
                    " Current explicit values: Status=Late.")
