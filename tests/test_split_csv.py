"""Records read by many tasks equal Spark's multiLine reader."""
import os
import random
import uuid

import pytest

from leakscan.session import scratch_path
from leakscan.sources import split_csv as X
from leakscan.sources import training_csv as TC

COLUMNS = TC.TRAINING_COLUMNS


def write(spark, text, n=1):
    p = scratch_path(spark, f"csv-{uuid.uuid4().hex}").replace("file:", "")
    os.makedirs(p)
    for k in range(n):
        with open(os.path.join(p, f"d{k}.csv"), "w", encoding="utf-8", newline="") as f:
            f.write(text)
    return p


def whole(spark, path, escape):
    """Spark's own reader, one task a file."""
    r = spark.read.options(**TC.csv_options(escape)).option("header", "true").csv(path)
    return sorted(map(repr, (tuple(x) for x in r.select(*COLUMNS).collect())))


def parallel(spark, path, escape):
    r = X.read_split_csv(spark, path, COLUMNS, True, TC.csv_options(escape))
    return sorted(map(repr, (tuple(x) for x in r.collect())))


def field(rng, escape):
    t = "".join(rng.choice(["a", "я", "q", " ", ";", "\n", "", "x y", '"', "\r\n", ",", "\\" if escape != "\\" else "z"]) for _ in range(rng.randrange(0, 9)))
    if rng.random() < 0.4 and not any(c in t for c in ';"\n\r\\'):
        return t.strip()
    return '"' + (t.replace('"', '""') if escape == '"' else t.replace('"', '\\"')) + '"'


def text(rng, rows, escape, eol):
    out = [";".join(COLUMNS)]
    for k in range(rows):
        fields = [str(k)] + [field(rng, escape) for _ in range(4)]
        if rng.random() < 0.05:
            fields = fields[:3] if rng.random() < 0.5 else fields + ["more"]      # malformed
        out.append(";".join(fields))
        if rng.random() < 0.03:
            out.append("")                                                       # an empty line
    return eol.join(out) + (eol if rng.random() < 0.7 else "")


@pytest.mark.parametrize("escape", ['"', "\\"])
@pytest.mark.parametrize("split", [64, 1000])
def test_equal_to_the_whole_file_reader(spark, escape, split):
    rng = random.Random(split + len(escape))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    for _ in range(4):
        path = write(spark, text(rng, 60, escape, "\n"), n=2)
        want = whole(spark, path, escape)
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            assert spark.read.text(path).rdd.getNumPartitions() > 4
            assert parallel(spark, path, escape) == want and want
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
            spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_a_field_longer_than_many_splits(spark):
    path = write(spark, ";".join(COLUMNS) + '\n1;"' + "line\n" * 500 + '";1;c;d\n2;t;0;c;d\n')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = X.read_split_csv(spark, path, COLUMNS, True, TC.csv_options('"')).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert sorted((r.id, r.text) for r in rows) == [("1", "line\n" * 500), ("2", "t")]


def test_quotes_inside_plain_fields_open_nothing(spark):
    path = write(spark, ";".join(COLUMNS) + '\n1;a "b" c;1;x;y\n2;5" pipe;0;x;y\n3;"q";1;x;y\n')
    rows = X.read_split_csv(spark, path, COLUMNS, True, TC.csv_options('"')).collect()
    assert sorted((r.id, r.text) for r in rows) == [("1", 'a "b" c'), ("2", '5" pipe'), ("3", "q")]


def test_windows_line_ends(spark):
    path = write(spark, ";".join(COLUMNS) + '\r\n1;"a\r\nb";1;x;y\r\n2;t;0;x;z\r\n')
    rows = X.read_split_csv(spark, path, COLUMNS, True, TC.csv_options('"')).collect()
    assert sorted(tuple(r) for r in rows) == [("1", "a\r\nb", "1", "x", "y"), ("2", "t", "0", "x", "z")]


def test_empty_and_header_only_files(spark):
    assert parallel(spark, write(spark, ";".join(COLUMNS) + "\n"), '"') == []
    assert X.read_records(spark, write(spark, "")).count() == 0
