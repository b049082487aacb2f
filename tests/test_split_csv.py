import csv
import io
import random

import pytest

from termweave.sources import batch, split_csv


@pytest.mark.parametrize("size", [37, 300, 1 << 20])
def test_splits_equal_the_whole_file(spark, tmp_path, size):
    rng = random.Random(size)
    cells = ["", "a", "b,c", 'd "e" f', "g\nh", '"\n"', "\n\n", 'x"y', "é\r\nz", ",", "long " * 30, '""', "i\n" * 20]
    rows = [[str(i), *[rng.choice(cells) for _ in range(3)]] for i in range(120)]
    for f in range(2):
        out = io.StringIO()
        w = csv.writer(out, lineterminator="\r\n" if f else "\n", quoting=csv.QUOTE_MINIMAL)
        w.writerows([["id", "p", "q", "r s"], *rows[f::2]])
        (tmp_path / f"part{f}.csv").write_text(("﻿" if not f else "") + out.getvalue(), newline="")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        df = batch.read_batch(spark, str(tmp_path), "csv")
        assert df.columns == ["id", "p", "q", "r s"]
        got = sorted(map(tuple, df.collect()), key=lambda r: int(r[0]))
        tasks = spark.read.option("lineSep", "\n").text(str(tmp_path)).rdd.getNumPartitions()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == [tuple(x or None for x in r) for r in rows]
    assert tasks > 20 or size > 300


def test_state_of_a_line():
    for line, out, within in [("a,b", False, True), ('"a', True, False), ('a"b', False, False), ('"a""', True, False), ('",', True, False), ('a,"', True, False), ('"a","b', True, True), ("", False, True)]:
        assert (split_csv.ends_inside(line, False), split_csv.ends_inside(line, True)) == (out, within), line


def test_open_quote_and_empty_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n1,"open\nnever')
    assert [tuple(r)[0] for r in batch.read_batch(spark, str(tmp_path / "a.csv")).collect()] == ["1"]
    (tmp_path / "b.csv").write_text("")
    assert batch.read_batch(spark, str(tmp_path / "b.csv")).count() == 0
