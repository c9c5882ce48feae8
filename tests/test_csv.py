"""CSV with rows over many lines, read in many splits, against Python's reader."""

import csv
import random

import pytest

from grafita.sources import files


@pytest.mark.parametrize("size", ["300b", "128m"])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_rows_of_many_splits(spark, tmp_path, size, end):
    rng = random.Random(5)
    bits = ["a", 'say "x"', "two\nlines", "\n", 'q"', '"', ",", "é,\n,\"", "", "plain text", '""', "x" * 400]
    for name in ("one.csv", "two.csv"):
        rows = [[str(i), rng.choice(bits) + rng.choice(bits), rng.choice(bits)] for i in range(300)]
        with open(tmp_path / name, "w", newline="", encoding="utf-8") as f:
            w = csv.writer(f, lineterminator=end)
            w.writerow(["k", "name", "note"])
            for i, r in enumerate(rows):
                w.writerow(r)
                if i % 50 == 7:
                    f.write(end)  # a blank row
            f.write(f'900,5" disk,a "b" c{end}901,"closed" and more,"last"')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        t = files.read_project_csv(spark, f"file://{tmp_path}/*.csv", ["k", "name", "note"])
        got = {(r.file, r.row_number): (r.k, r.name or "", r.note or "") for r in t.collect()}
        splits = spark.read.text(f"file://{tmp_path}/*.csv").rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert splits > 100 if size == "300b" else splits < 10
    want = {}
    for name in ("one.csv", "two.csv"):
        with open(tmp_path / name, newline="", encoding="utf-8") as f:
            for i, r in enumerate(x for x in csv.reader(f) if x):
                if i:
                    want[name, i + 1] = tuple(r)
    assert len(got) == len(want)
    wrong = [(k, got.get(k), want[k]) for k in want if k[1] < 302 and got.get(k) != want[k]]
    assert not wrong, wrong[:5]
    assert {k[1] for k in got} == set(range(2, 304)) and got["one.csv", 302][1] == '5" disk'
