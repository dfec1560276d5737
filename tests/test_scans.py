"""Quoted CSV and JSON arrays read in many blocks, against Spark's own whole-file readers."""

import json
import random

import pytest

from ledgerloom.sources import files, scan


@pytest.fixture()
def small_blocks(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


FIELDS = ["", "a", "b c", "é中", "1,2", 'q"q', "l1\nl2", "x\r\ny", '"', "z" * 30, "\n\n", " s ", '",\n"', "long\n" * 200]


@pytest.mark.parametrize("seed", range(6))
def test_quoted_csv_equals_the_whole_file_reader(spark, small_blocks, tmpdir_path, seed):
    rng, path, eol = random.Random(seed), f"{tmpdir_path}/a.csv", "\r\n" if seed % 2 else "\n"

    def field():
        x = rng.choice(FIELDS)
        return '"' + x.replace('"', '""') + '"' if any(c in x for c in ',"\n\r') or rng.random() < 0.2 else x

    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(("﻿" if seed > 3 else "") + 'k,"w w",z' + eol)
        for i in range(150):
            f.write(f"{i},{field()},{field()}{eol}" + (eol if rng.random() < 0.05 else ""))
        if seed == 2:
            f.write("last,x,y")
    want = [tuple(r) for r in spark.read.options(header=True, multiLine=True, quote='"', escape='"').csv(path).collect()]
    df = files.read_import_csv(spark, path, multiline=True)
    got = sorted(map(tuple, df.collect()))
    assert df.columns == ["line_no", "k", "w w", "z"] and [g[1:] for g in got] == want
    assert [g[0] for g in got] == list(range(1, len(want) + 1))
    assert df.rdd.getNumPartitions() > 5


def test_several_csv_files_are_numbered_apart(spark, small_blocks, tmpdir_path):
    for name, n in (("a", 40), ("b", 3)):
        with open(f"{tmpdir_path}/{name}.csv", "w") as f:
            f.write("k,v\n" + "".join(f'{name}{i},"x\n{i}"\n' for i in range(n)))
    got = sorted((r.k[0], r.line_no, r.k, r.v) for r in scan.read_quoted_csv(spark, tmpdir_path).collect())
    assert got == [(f, i + 1, f"{f}{i}", f"x\n{i}") for f, n in (("a", 40), ("b", 3)) for i in range(n)]


def test_stray_quotes_inside_plain_fields(spark, small_blocks, tmpdir_path):
    path = f"{tmpdir_path}/s.csv"
    with open(path, "w") as f:
        f.write("k,v\n" + "".join(f'{i},5" pipe\n{i},"a\nb"\n' for i in range(60)))
    want = [tuple(r) for r in spark.read.options(header=True, multiLine=True, quote='"', escape='"').csv(path).collect()]
    assert sorted(tuple(r)[1:] for r in scan.read_quoted_csv(spark, path).collect()) == sorted(want) and len(want) == 120


def test_empty_csv_files(spark, tmpdir_path):
    for name, text in (("header", "k,v\n"), ("bare", "k,v")):
        with open(f"{tmpdir_path}/{name}.csv", "w") as f:
            f.write(text)
        assert scan.read_quoted_csv(spark, f"{tmpdir_path}/{name}.csv").collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_json_array_equals_the_whole_file_reader(spark, small_blocks, tmpdir_path, seed):
    rng, path = random.Random(seed), f"{tmpdir_path}/e.json"
    rows = [{"id": str(i), "type": rng.choice(["a", 'q"{x}', "b\\", "]["]), "message": "m{}}\n" * rng.randrange(3), "timestamp": i,
             "context": {"k": "v}", "long": "{" * rng.randrange(900)} if rng.random() < 0.5 else None, "severity": "é"} for i in range(60)]
    with open(path, "w") as f:
        json.dump(rows, f, indent=2 if seed % 2 else None, ensure_ascii=seed < 2)
    want = [tuple(r) for r in spark.read.schema(files.ERROR_REPORT_SCHEMA).option("multiLine", True).json(path).collect()]
    df = scan.read_json_array(spark, path, files.ERROR_REPORT_SCHEMA, number="n", broken="bad")
    got = sorted(map(tuple, df.collect()), key=lambda r: r[-2])
    assert [g[:-2] for g in got] == want and [g[-2:] for g in got] == [(i + 1, None) for i in range(60)]
    assert df.rdd.getNumPartitions() > 10
    assert sorted(r.report_id for r in files.read_error_log(spark, path).collect()) == sorted(r["id"] for r in rows)


@pytest.mark.parametrize("text, want", [
    ("[]", []), (" [ ]\n", []), ('[{"id":"1"}]', [("1", None)]), ('[{"id":"1"},{"id":"2","me', [("1", None), (None, '{"id":"2","me')]),
    ('[{"id":"1"}', [("1", None)]), ('[1, {"id":"1"}, 2]', [(None, '1, {"id":"1"}'), (None, "2]")]),
    ('[{"id":"1"},{"id":x},{"id":"3"}]', [("1", None), (None, '{"id":x}'), ("3", None)]), ('{"id":"1"}', [("1", None)]), ('{"id":"1"}\n', [("1", None)])])
def test_broken_elements_are_reported(spark, tmpdir_path, text, want):
    path = f"{tmpdir_path}/x.json"
    with open(path, "w") as f:
        f.write(text)
    got = scan.read_json_array(spark, path, files.ERROR_REPORT_SCHEMA, number="n", broken="bad").orderBy("n").collect()
    assert [(r.id, r.bad) for r in got] == want
