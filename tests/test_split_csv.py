"""Ranged, quote-aware export reading against the one-file reader, with ranges far smaller than the files."""

from __future__ import annotations

import random

import pytest

from hotelspark.sources.report_csv import ReportError, read_report_csv
from hotelspark.sources.split_csv import read_report_csv_ranged


@pytest.fixture()
def small_ranges(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def _export(rng: random.Random, rows: int) -> str:
    names = ['Ann, "A"', "Bob", "two\nlines", "x\r\ny", "NA", "", "Zed;z", '"', "\n\n", "a,b,c"]
    body = []
    for i in range(rows):
        name = rng.choice(names)
        cell = '"' + name.replace('"', '""') + '"' if any(c in name for c in ',"\n\r') else name
        body.append(f"{i},{cell},08{i},c{i}")
    return "﻿Hotel\nGuests\n\"from,to\n\n\n\n" + "Guest No, Name ,Mobile  No.,Comments\r\n" + "\r\n".join(body) + "\r\n,,,\n\n"


def _same(spark, path):
    old = sorted((tuple(r) for r in read_report_csv(spark, [path], "profile_guest").drop("source_file").collect()), key=repr)
    found = read_report_csv_ranged(spark, [path], "profile_guest")
    new = sorted((tuple(r) for r in found.drop("source_file").collect()), key=repr)
    assert new == old
    return found


def test_quoted_records_across_ranges_match_the_one_file_reader(small_ranges, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text(_export(random.Random(1), 300), encoding="utf-8", newline="")
    found = _same(small_ranges, str(path))
    assert found.rdd.getNumPartitions() > 1
    assert small_ranges.read.text(str(path)).rdd.getNumPartitions() > 20


def test_malformed_files_are_read_without_quoting(small_ranges, tmp_path):
    odd = tmp_path / "odd.csv"
    odd.write_text("\n" * 6 + "Name,Other\nEve,1\nx\"y,2,3\nFoo,\"q\nBar,\"r\n", encoding="utf-8")
    _same(small_ranges, str(odd))
    long = tmp_path / "long.csv"
    long.write_text("\n" * 6 + "Name,Other\nEve,1\nAl,2,3\n\"Q\"x,4\n", encoding="utf-8")
    _same(small_ranges, str(long))
    semi = tmp_path / "semi.csv"
    semi.write_text("\n" * 6 + "Name;Other\nEve;1\n\"x;2\n", encoding="utf-8")
    _same(small_ranges, str(semi))


def test_empty_and_headless_files_fail(small_ranges, tmp_path):
    empty = tmp_path / "e.csv"
    empty.write_text("\n" * 8, encoding="utf-8")
    with pytest.raises(ReportError, match="empty"):
        read_report_csv_ranged(small_ranges, [str(empty)], "profile_guest")
    other = tmp_path / "o.csv"
    other.write_text("\n" * 6 + "Guest No,Other\n1,2\n", encoding="utf-8")
    with pytest.raises(ReportError, match="missing required columns"):
        read_report_csv_ranged(small_ranges, [str(other)], "profile_guest")


def test_many_files_at_once(small_ranges, tmp_path):
    rng = random.Random(5)
    paths = []
    for i in range(4):
        p = tmp_path / f"{i}.csv"
        p.write_text(_export(rng, 40 + i), encoding="utf-8", newline="")
        paths.append(str(p))
    old = sorted((tuple(r) for r in read_report_csv(small_ranges, paths, "profile_guest").drop("source_file").collect()), key=repr)
    new = sorted((tuple(r) for r in read_report_csv_ranged(small_ranges, paths, "profile_guest").drop("source_file").collect()), key=repr)
    assert new == old
