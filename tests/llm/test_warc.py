import hashlib
import random

import pytest

from palimpsest.llm import warc
from palimpsest.llm.warc import MAGIC, read_archives, write_archives


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def fake(length):
    return f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:row:666>\r\nContent-Length: {length}\r\n\r\n"


def test_round_trip_with_magic_in_payloads_over_many_splits(spark, tmp_path, small_splits):
    random.seed(3)
    rows = [(i, f"http://x/{i} \r\n", "".join(random.choice(["é", "a", fake(random.choice([0, 3, 90, 10 ** 6])), "\r\n\r\n", "WARC/1.0\r\n"])
                                              for _ in range(random.randrange(40)))) for i in range(120)]
    rows += [(200, None, None), (201, "u", ""), (202, "u", "x" * 20000)]
    write_archives(pages(spark, rows).coalesce(2), f"{tmp_path}/a", compression="none")
    got = read_archives(spark, f"{tmp_path}/a", with_content=True).collect()
    assert spark.read.option("lineSep", MAGIC.decode()).text(f"{tmp_path}/a").rdd.getNumPartitions() > 20
    found = {int(r["record_id"][9:-1]): r for r in got}
    assert len(got) == len(rows) == len(found)
    for id_, _, html in rows:
        data = (html or "").encode()
        if found[id_]["type"] == "response":
            assert bytes(found[id_]["content"]) == data and found[id_]["sha256"] == hashlib.sha256(data).hexdigest()
        else:
            assert found[id_]["digest"] == "sha256:" + hashlib.sha256(data).hexdigest()


def test_revisits_and_edge_rows(spark, tmp_path):
    long, short = "y" * 100, "y" * 99
    rows = [(5, "a", long), (3, "b", long), (9, "c", long), (1, "d", short), (2, "e", short), (7, "f", None), (8, "g", ""), (9, "c", long), (None, "h", long)]
    write_archives(pages(spark, rows), f"{tmp_path}/b")
    got = sorted((r["record_id"][9:-1], r["type"], (r["refers_to"] or "")[9:-1], r["payload_length"]) for r in read_archives(spark, f"{tmp_path}/b").collect())
    assert got == [("", "revisit", "3", "100"), ("1", "response", "", "99"), ("2", "response", "", "99"), ("3", "response", "", "100"), ("5", "revisit", "3", "100"),
                   ("7", "response", "", "0"), ("8", "response", "", "0"), ("9", "revisit", "3", "100"), ("9", "revisit", "3", "100")]


def test_empty_table_and_extra_columns(spark, tmp_path):
    empty = pages(spark, []).selectExpr("*", "1 as file", "2 as digest", "3 as value")
    write_archives(empty, f"{tmp_path}/c")
    assert read_archives(spark, f"{tmp_path}/c").count() == 0


def test_damaged_file_keeps_the_chain_from_its_start(spark, tmp_path):
    one = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:row:1>\r\nContent-Length: 2\r\n\r\nok\r\n\r\n"
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.warc").write_bytes((one + "junk" + one).encode())
    (tmp_path / "d" / "y.warc").write_bytes(("junk" + one).encode())
    got = read_archives(spark, f"{tmp_path}/d", with_content=True).collect()
    assert [(r["offset"], bytes(r["content"])) for r in got] == [(0, b"ok")]


def test_no_join_plans_to_send_a_table_of_records_to_the_driver(spark, tmp_path, small_splits, monkeypatch):
    plans = []

    def kept_plan(make):
        return lambda df, *label: plans.append(df) or make(df, *label)

    for name in ("cut_lineage", "written"):
        monkeypatch.setattr(warc, name, kept_plan(getattr(warc, name)))
    rows = [(i, "u", f"{i} " + "x" * 2000 + fake(3) * (i % 3)) for i in range(30)]
    write_archives(pages(spark, rows).coalesce(2), f"{tmp_path}/e", compression="none")
    got = read_archives(spark, f"{tmp_path}/e")
    joins = [p for p in (df._jdf.queryExecution().sparkPlan().toString() for df in (*plans, got)) if "Join" in p]
    assert len(joins) > 5 and not [p for p in joins if "Broadcast" in p]
    assert sorted((int(r["record_id"][9:-1]), r["sha256"]) for r in got.collect()) == [(i, hashlib.sha256(html.encode()).hexdigest()) for i, _, html in rows]
