"""Quoted records over several lines: one file, several tasks."""

import csv
import random

import pytest

from veil.sources import io, multiline


def written(path, rows, header, newline="\n"):
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, lineterminator=newline)
        w.writerow(header)
        w.writerows(rows)


@pytest.fixture
def small_splits(spark):
    """Splits of some kilobytes, as a large file would have many of the usual size."""
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    old = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], "2000")
    spark.conf.set(names[1], "0")
    yield
    for n, v in zip(names, old):
        spark.conf.set(n, v)


def hard_rows(seed, n):
    rng = random.Random(seed)
    bits = ["plain", "a,b", 'say "hi"', "two\nlines", "\n\n", '"', '""', 'x"\n,"y', "ünï", "  ", "tab\t", "c\r\nd", "z" * 300]
    return [(f"c{k}", k % 7, rng.choice(["agent", "customer"]), " ".join(rng.choices(bits, k=rng.randint(1, 6))))
            for k in range(n)]


HEADER = ["conversationId", "turnNumber", "authorRole", "utterance"]


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_records_of_one_file_in_many_splits(spark, tmp_path, small_splits, newline):
    rows = hard_rows(3, 400)
    written(tmp_path / "airline.tsv", rows, HEADER, newline)
    path = str(tmp_path / "airline.tsv")
    states = multiline.block_states(spark, [path]).collect()
    assert len(states) > 10 and {s.parity for s in states} == {0, 1}       # blocks that begin inside a field
    got = io.read_dialogues(spark, path)
    assert sorted((r.conversation_id, r.turn, r.role, r.utterance) for r in got.collect()) == sorted(rows)
    assert {r.domain for r in got.collect()} == {"AIRLINE"}
    # numbered in the order of the file, header first
    numbers = {r.record_no: r.record for r in multiline.csv_records(spark, [path]).collect()}
    assert sorted(numbers) == list(range(1, 402)) and numbers[1] == ",".join(HEADER)
    assert [numbers[k + 2].split(",")[0] for k in range(400)] == [r[0] for r in rows]


def test_same_as_the_reader_of_whole_files(spark, tmp_path, small_splits):
    """Several files, empty lines between records, empty and missing fields."""
    for name, seed in (("airline", 1), ("media", 2)):
        written(tmp_path / f"{name}.tsv", hard_rows(seed, 120), HEADER)
    with open(tmp_path / "media.tsv", "a", encoding="utf-8", newline="") as f:
        f.write('\n\n"q1",3,agent,\n\nq2,,,""\n"q3",1,"customer","no end of line"')
    with open(tmp_path / "empty.tsv", "w", encoding="utf-8"):
        pass
    paths = [str(tmp_path / f"{n}.tsv") for n in ("airline", "media", "empty")]
    want = spark.read.schema(io.DIALOGUE_SCHEMA).option("header", True).option("multiLine", True).option(
        "escape", '"').csv(paths)
    got = multiline.read_csv(spark, paths, io.DIALOGUE_SCHEMA).drop("file", "record_no")
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)


def test_a_quote_without_its_end_is_one_record(spark, tmp_path):
    with open(tmp_path / "a.tsv", "w", encoding="utf-8") as f:
        f.write("x,y\n1,2\n3,\"open\n4,5\n6,7\n")
    got = multiline.csv_records(spark, [str(tmp_path / "a.tsv")]).collect()
    assert sorted((r.record_no, r.record) for r in got) == [(1, "x,y"), (2, "1,2"), (3, '3,"open\n4,5\n6,7')]


def test_attack_results_with_line_breaks(spark, tmp_path, small_splits):
    rows = [(f"p {k}\n<EOT>", None if k % 3 == 0 else f'g "{k}"\n{"w " * 40}', k / 2, 1.0, 2.0, None, k % 2 == 0) for k in range(150)]
    df = spark.createDataFrame(rows, io.ATTACK_SCHEMA)
    io.write_attack_results(df, str(tmp_path / "out.csv"))
    assert sorted(map(str, io.read_attack_results(spark, str(tmp_path / "out.csv")).collect())) == sorted(map(str, df.collect()))
