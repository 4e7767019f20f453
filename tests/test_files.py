"""Readers, positions, contract and manifest."""

import json
import os

import pytest

from shopfloor.operators import contract
from shopfloor.sources import files


def test_two_header_csv_and_positions(spark, tmp_path):
    path = tmp_path / "two.csv"
    body = "".join(f"{i},{i % 7},{i / 2}\r\n" for i in range(2000))
    path.write_text("﻿top,top,top\r\n id ,shot, cycle \r\n" + body)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = files.read_csv_two_header(spark, str(path), "id bigint, shot bigint, cycle double").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r["source_row"], r["id"], r["cycle"]) for r in got) == [(i, i, i / 2) for i in range(2000)]
    with pytest.raises(ValueError):
        files.read_csv_two_header(spark, str(path), "id bigint, other bigint, cycle double")


def test_manifest_finds_changes(spark, tmp_path):
    a, b = tmp_path / "a.bin", tmp_path / "b.bin"
    a.write_bytes(b"one")
    b.write_bytes(b"two")
    made = files.build_manifest(spark, [str(a), str(b)]).cache()
    made.count()
    assert files.verify_manifest(spark, made, [str(a), str(b)]).count() == 0
    b.write_bytes(b"three")
    assert [r["problem"] for r in files.verify_manifest(spark, made, [str(a), str(b)]).collect()] == ["changed"]
    os.remove(b)
    assert [r["problem"] for r in files.verify_manifest(spark, made, [str(a)]).collect()] == ["missing"]


def test_contract(spark, tmp_path):
    path = tmp_path / "contract.json"
    path.write_text(json.dumps({"good": ["a", "b"], "bad": ["a", "y_type_Dent", "oracle_prior_episodes", "nowhere"], "target_columns": ["y_type_*"], "forbidden": ["oracle_*", "row_id"]}, indent=1))
    c = files.read_contract(spark, str(path))
    cols = ["a", "b", "y_type_Dent", "oracle_prior_episodes", "row_id"]
    got = {tuple(r) for r in contract.check_contract(spark, c, {"good": cols, "bad": cols}).collect()}
    assert got == {("bad", "y_type_Dent", "target"), ("bad", "oracle_prior_episodes", "forbidden"), ("bad", "nowhere", "not in table")}
    df = spark.createDataFrame([(1, 2, 3)], "a int, row_id int, b int")
    assert contract.select_inputs(df, c, "good", ["row_id"]).columns == ["row_id", "a", "b"]
