import hashlib
import json

import pytest
from conftest import keyed
from pyspark.sql import functions as F

from plumbline.dataset import Dataset
from plumbline.plans import eda
from plumbline.sources import readers, shared, writers


def write(folder, name, text):
    path = folder / name
    path.write_text(text)
    return str(path)


def test_csv_types_and_missing_tokens(spark, tmp_path):
    path = write(tmp_path, "t.csv", "Name,Age,Salary,Flag,Day,Empty\nAnn,25,1e3,True,2024-01-01,\nBob,NA,2.5,False,2024-01-02,\n,40,null,True,,\n")
    frame = readers.read_csv(spark, path)
    assert dict(frame.dtypes) == {"Name": "string", "Age": "bigint", "Salary": "double", "Flag": "boolean", "Day": "string", "Empty": "double"}
    assert frame.where("Age IS NULL").count() == 1 and frame.where("Salary IS NULL").count() == 1
    types = {f.name: f.column_type for f in Dataset(frame).fields}
    assert types == {"Name": "categorical", "Age": "numeric", "Salary": "numeric", "Flag": "binary", "Day": "categorical", "Empty": "unknown"}


def test_csv_with_schema(spark, tmp_path):
    path = write(tmp_path, "t.csv", "a,b\n1,x\nbad,y\n")
    assert [tuple(r) for r in readers.read_csv(spark, path, "a int, b string").collect()] == [(1, "x"), (None, "y")]


@pytest.mark.parametrize(
    "name, text, message",
    [
        ("notes.txt", "a,b\n1,2\n", readers.NOT_CSV),
        ("empty.csv", "", readers.EMPTY_FILE),
        ("header.csv", "a,b,c\n", readers.NO_ROWS),
        ("GOOD.CSV", "a,b\n1,2\n", None),
    ],
)
def test_source_checks(spark, tmp_path, name, text, message):
    row = readers.validate_sources(spark, [write(tmp_path, name, text)]).first()
    assert (row["ok"], row["message"]) == (message is None, message)


def test_missing_files_fail_their_check(spark, tmp_path):
    rows = readers.validate_sources(spark, ["", str(tmp_path / "none.csv")]).collect()
    assert [(r["check"], r["ok"]) for r in rows] == [("name", False), ("parse", False)]


def test_rows_with_too_many_fields_are_refused(spark, tmp_path):
    path = write(tmp_path, "wide.csv", "a,b\n1,2\n3\n5,6,7,8\n9,10,11\n")
    row = readers.validate_sources(spark, [path]).first()
    assert (row["check"], row["ok"]) == ("parse", False) and "2 rows" in row["message"]
    assert readers.malformed_rows(spark, path) == 2
    with pytest.raises(Exception, match="more fields"):
        readers.read_csv(spark, path).collect()
    short = readers.read_csv(spark, write(tmp_path, "short.csv", "a,surplus\n1,2\n3\n"))
    assert [tuple(r) for r in short.collect()] == [(1, 2), (3, None)]


def test_fingerprint_ignores_order_and_sees_changes(spark):
    rows = [(1, "a", 0.5), (2, None, 1.5), (2, None, 1.5)]
    of = lambda data: readers.table_fingerprint(spark.createDataFrame(data, "k int, s string, x double")).first()
    assert of(rows) == of(rows[::-1])
    assert of(rows) != of(rows[:2])
    assert of(rows) != of([(1, "a", 0.5), (2, None, 1.5), (2, "", 1.5)])


def test_result_round_trip(spark, make, tmp_path):
    ds = make([(float(i), "ab"[i % 2]) for i in range(8)], "x double, s string")
    record = writers.result_record("eda_only", readers.dataset_hash(ds), eda.report_document(ds, "s"), metadata={"target": "s"})
    writers.save_result(record, str(tmp_path / "out"))
    writers.save_result(record, str(tmp_path / "out"))
    (back,) = writers.read_runs(spark, str(tmp_path / "out")).collect()
    assert back["schema_version"] == "1.0" and back["pipeline"] == "eda_only" and back["metadata"]["target"] == "s"
    body = json.loads(back["eda"])
    assert body["rows"] == 8 and [f["column_name"] for f in body["features"]] == ["x", "s"]


def test_runs_are_there_once_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "m")
    run_id = writers.evaluation_run_id("abcd1234", "20260101T000000Z")
    writers.save_evaluation(spark.range(2), path, run_id)
    writers.save_evaluation(spark.range(5), path, "007")
    assert sorted(map(tuple, writers.read_runs(spark, path).select("id", "run_id").collect())) == sorted(
        [(i, "007") for i in range(5)] + [(i, run_id) for i in range(2)]
    )
    # Written but not committed: a crash between the two leaves nothing to read.
    lost = spark.range(9).withColumns({"run_id": F.lit(run_id), "attempt": F.lit("99999999T")})
    lost.write.partitionBy("run_id", "attempt").mode("append").json(path + "/data")
    assert writers.read_runs(spark, path).where(F.col("run_id") == run_id).count() == 2
    writers.save_evaluation(spark.range(3), path, run_id)
    back = writers.read_runs(spark, path, "id bigint")
    assert keyed(back.groupBy("run_id").count(), "run_id", "count") == {run_id: 3, "007": 5}


def test_cells_cannot_be_mistaken(spark):
    of = lambda a, b: readers.table_fingerprint(spark.createDataFrame([(a, b)], "a string, b string")).first()["row_sum"]
    pairs = [(None, "x"), ("\\N", "x"), ("-", "x"), ("", "x"), ("p\x1fq", "r"), ("p", "q\x1fr"), ("1:a", ""), ("", "1:a"), ("x", None)]
    assert len({of(*pair) for pair in pairs}) == len(pairs)


def test_file_hash_in_blocks(spark, tmp_path):
    data = bytes(range(256)) * 5000
    for name, size in (("b.bin", 1000), ("c.bin", 4096), ("d.bin", 4097), ("e.bin", 1_000_000)):
        (tmp_path / name).write_bytes(data[:size])
    found = readers.file_fingerprint(spark, str(tmp_path), block=4096).collect()
    got = {row["path"].rsplit("/", 1)[1]: row["dataset_hash"] for row in found}

    def plain(size):
        parts = [hashlib.sha256(data[at : min(at + 4096, size)]).hexdigest() for at in range(0, max(size, 1), 4096)]
        return (parts[0] if len(parts) == 1 else hashlib.sha256("".join(parts).encode()).hexdigest())[:8]

    assert got == {"b.bin": plain(1000), "c.bin": plain(4096), "d.bin": plain(4097), "e.bin": plain(1_000_000)}


def test_shared_folder_follows_the_session(spark):
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    path = shared.scratch_path(spark, "x")
    assert configured is None or path.startswith(configured)
