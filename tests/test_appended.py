"""Log files that grow, relational ranges, sniffed scans and the run log."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from telemill.schemas import BULK_SCAN
from telemill.sources import logs
from telemill.sources.appended import lines_of, read_appended


def test_blocks_give_each_line_once():
    rng = random.Random(1)
    for _ in range(300):
        data = "".join(rng.choice(["a", "b\n", "\n", "longer line "]) for _ in range(rng.randrange(40))).encode()
        first = rng.choice([0, *[k + 1 for k, c in enumerate(data) if c == 10]])
        size = rng.randrange(1, 12)
        found, ends = [], [first]
        for a in range(first, len(data), size):
            lines, end = lines_of(lambda x, y: data[x:y], a, min(a + size, len(data)), first, len(data))
            found += lines
            ends.append(end)
        whole = data[first : data.rfind(b"\n") + 1]
        assert found == whole.split(b"\n")[:-1] and max(ends) == first + len(whole)


def lines_in(df):
    return sorted((r.file.rsplit("/", 1)[1], r.line_number, r.value) for r in df.collect())


@pytest.mark.parametrize("block", [7, 1 << 20])
def test_only_what_was_appended_is_read(spark, tmp_path, block):
    a, b = tmp_path / "a.log", tmp_path / "sub" / "b.log"
    b.parent.mkdir()
    a.write_bytes(b"one\n\ntwo\r\nbad \xff byte\nhalf")
    b.write_bytes(b"x" * 3000 + b"\ny\n")
    (tmp_path / "c.txt").write_text("other\n")
    read = lambda marks: read_appended(spark, str(tmp_path), marks, "*.log", block)
    lines, marks = read(None)
    assert lines_in(lines) == [("a.log", 1, "one"), ("a.log", 3, "two"), ("a.log", 4, "bad � byte"), ("b.log", 1, "x" * 3000), ("b.log", 2, "y")]
    again, marks = read(marks)
    assert lines_in(again) == []
    with a.open("ab") as f:
        f.write(b" done\n\nmore\n")
    lines, marks = read(marks)
    assert lines_in(lines) == [("a.log", 5, "half done"), ("a.log", 7, "more")]
    a.rename(tmp_path / "a.log.1")  # rotated: the name is a new file's
    a.write_bytes(b"fresh\n")
    b.write_bytes(b"z" * 4000 + b"\n")
    lines, marks = read(marks)
    assert lines_in(lines) == [("a.log", 1, "fresh"), ("b.log", 1, "z" * 4000)]
    assert {r.file.rsplit("/", 1)[1]: (r.bytes, r.lines) for r in marks.collect()} == {"a.log": (6, 1), "b.log": (4001, 1)}


def test_what_was_read_is_not_read_again(spark, tmp_path):
    """Bytes before the bookmark are not looked at: they may change, but for the head."""
    f = tmp_path / "a.log"
    f.write_bytes(b"h" * 1100 + b"\n" + b"old\n" * 50)
    _, marks = read_appended(spark, str(tmp_path))
    f.write_bytes(b"h" * 1100 + b"\n" + b"xx\n\n" * 50 + b"new\n")
    lines, marks = read_appended(spark, str(tmp_path), marks)
    assert lines_in(lines) == [("a.log", 52, "new")]
    f.unlink()
    lines, kept = read_appended(spark, str(tmp_path), marks)
    assert lines.count() == 0 and kept.collect() == marks.collect()


def test_lines_of_a_file_in_many_blocks(spark, tmp_path):
    (tmp_path / "a.log").write_text("".join(f"line {k}\n" * (1 + k % 2) for k in range(2000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        lines = logs.read_lines(spark, str(tmp_path))
        got = [(r.line_number, r.value) for r in lines.orderBy("line_number").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == list(enumerate((f"line {k}" for k in range(2000) for _ in range(1 + k % 2)), 1)) and lines.select("file_id").distinct().count() == 1


def test_relational_filter_is_pushed_down(spark):
    url = "jdbc:derby:memory:pushed;create=true"
    spark.range(1, 101).select(F.col("id").alias("connection"), (F.col("id") % 3).alias("x")).write.format("jdbc").options(url=url, dbtable="c").save()
    found = logs.read_relational(spark, url, "c", "connection", 40, rows_per_task=20)
    assert sorted(r.connection for r in found.collect()) == list(range(41, 101)) and found.rdd.getNumPartitions() == 3
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(connection,40)" in plan and "Filter" not in plan.replace("PushedFilters", "")
    assert logs.read_relational(spark, url, "c", "connection", 100).count() == 0 and logs.read_relational(spark, url, "c", "connection", 99).count() == 1


def test_a_folder_of_both_formats(spark, tmp_path):
    with gzip.open(tmp_path / "a.gz", "wt") as f:
        f.write('\n  {"ip": "203.0.113.1", "port": 23, "value": "QnVzeUJveA=="}\n')
    (tmp_path / "b").write_text("ip,port,proto,timestamp,asn,country_code,value,data,banner\n203.0.113.3,1080,tcp,,,,,x,\n")
    (tmp_path / "c").write_text("")
    assert sorted((r.ip, r.port) for r in logs.read_bulk_scan(spark, str(tmp_path), BULK_SCAN).collect()) == [("203.0.113.1", 23), ("203.0.113.3", 1080)]
    empty = tmp_path / "none"
    empty.mkdir()
    (empty / "x").write_text("\n")
    assert logs.read_bulk_scan(spark, str(empty), BULK_SCAN).count() == 0


def test_run_log(spark, tmp_path):
    log, rows = str(tmp_path / "log"), spark.range(10)
    logs.logged_run(log, "1", "half", rows, lambda df: df.filter("id < 5"), lambda df: df.write.parquet(str(tmp_path / "out")), ["f"])
    with pytest.raises(Exception, match="broken"):
        logs.logged_run(log, "2", "fails", rows, lambda df: df.select(F.raise_error(F.lit("broken"))), lambda df: df.write.parquet(str(tmp_path / "bad")))
    found = {r.run_id: r for r in logs.run_log(spark, log).collect()}
    assert (found["1"].status, found["1"].records_in, found["1"].records_out, found["1"].source_files) == ("success", 10, 5, ["f"])
    assert found["2"].status == "failed" and found["2"].records_in is None and "broken" in found["2"].error and found["2"].completed_at >= found["2"].started_at
