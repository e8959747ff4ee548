import os
import random

from pyspark.sql import functions as F

from lawloom.streaming import ingest, jobs

JOBS = "document_id long, job_id long, event_id long, status string, retry_count int, ts timestamp"


def feed(n=300):
    rng = random.Random(6)
    return [(rng.randint(1, 3), 0, i, rng.choice(["pending", "running", "failed", "completed"]), rng.randint(0, 1), i) for i in range(n)]


def files(spark, folder, rows, schema, parts):
    for p in range(parts):
        chunk = rows[p * len(rows) // parts : (p + 1) * len(rows) // parts]
        df = spark.createDataFrame(chunk, schema).coalesce(1)
        df.write.mode("append").parquet(folder)


def test_stream_equals_batch(spark, tmp_path):
    rows = [(d, d * 10 + i % 4, i, s, r, t) for d, _, i, s, r, t in feed()]
    schema = JOBS.replace("ts timestamp", "ts long")
    folder = str(tmp_path / "in")
    files(spark, folder, rows, schema, 4)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out = jobs.run_to_table(jobs.job_change_stream(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    batch = jobs.job_changes(spark.createDataFrame(rows, schema))
    assert sorted(map(str, out.collect())) == sorted(map(str, batch.collect()))
    with_time = jobs.job_changes(spark.createDataFrame(rows, schema), keep=("ts",))
    snap = {r.document_id: (r.open_jobs, r.terminal) for r in jobs.document_snapshots(with_time).collect()}
    last = {}
    for d, j, _, s, _, _ in rows:
        last[d, j] = s
    for d, (open_jobs, terminal) in snap.items():
        expected = sum(1 for (dd, _), s in last.items() if dd == d and s in ("pending", "running"))
        assert open_jobs == expected and terminal == (expected == 0)


def arrive(spark, folder, rows, schema, number):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{number}")


def test_retries_equal_sequential_policy(spark, tmp_path):
    """Two runs over one table and checkpoint: the second takes only what has arrived since."""
    rng = random.Random(9)
    rows = [(rng.randint(1, 40), i, rng.random() < 0.7) for i in range(160)]
    schema, folder = "job_id long, at long, failed boolean", str(tmp_path / "in")
    os.makedirs(folder)
    known = spark.createDataFrame([(j, "pending", 0) for j in range(1, 42)], "job_id long, status string, retry_count int")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)
    state = {j: ["pending", 0] for j in range(1, 42)}
    for run, part in enumerate((rows[:100], rows[100:], [])):
        for k in range(2) if part else ():
            arrive(spark, folder, part[k * 50 : (k + 1) * 50 if not k else None], schema, f"{run}-{k}")
        out = jobs.retry_stream(known, stream, str(tmp_path / "jobs"), str(tmp_path / "cp"))
        for j, _, failed in part:
            s = state[j]
            if s[0] == "pending":
                s[1] += failed
                s[0] = ("failed" if s[1] >= 3 else "pending") if failed else "completed"
        assert {r.job_id: [r.status, r.retry_count] for r in out.collect()} == state


def test_snapshots_follow_the_newest_event_by_time(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.randint(1, 4), rng.randint(1, 3), i, rng.choice(["pending", "running", "failed", "completed"]), rng.randint(0, 99)) for i in range(120)]
    schema, folder = "document_id long, job_id long, event_id long, status string, ts long", str(tmp_path / "in")
    os.makedirs(folder)
    df = lambda part: part.withColumn("ts", F.timestamp_seconds("ts"))
    stream = df(spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(folder))
    for run, part in enumerate((rows[:50], rows[50:])):
        arrive(spark, folder, part, schema, run)
        out = jobs.snapshot_stream(stream, *[str(tmp_path / x) for x in ("jobs", "snapshots", "cp")])
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, jobs.document_snapshots(df(spark.createDataFrame(rows, schema))).collect()))


def test_ingest_stream_takes_changes_and_goes_on(spark, tmp_path):
    schema = "doc_id long, text string, title string, version_id string"
    rows = [(1, "Điều 1. A\nx", "T", "v1"), (2, "  ", "T", "v2"), (1, "Điều 1. A\nx", "T", "v1"), (3, "Điều 2. B\ny", "T", "v3")]
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    os.makedirs(folder)
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(folder)
    arrive(spark, folder, rows, schema, 0)
    ingest.ingest_stream(stream, out, str(tmp_path / "cp"), dim=16)
    found = ingest.current_points(spark, out)
    assert sorted((r.version_id, r.article_number) for r in found.collect()) == [("v1", "1"), ("v3", "2")]
    assert found.filter(F.size("embedding") != 16).count() == 0
    assert [r.version_id for r in ingest.ingest_errors(spark, out).collect()] == ["v2"]
    arrive(spark, folder, [(1, "Điều 7. A\nx", "T", "v1"), (3, "Điều 2. B\ny", "T", "v3"), (2, "Điều 9. C\nz", "T", "v2")], schema, 1)
    ingest.ingest_stream(stream, out, str(tmp_path / "cp"), dim=16)
    assert sorted((r.version_id, r.article_number) for r in ingest.current_points(spark, out).collect()) == [("v1", "7"), ("v2", "9"), ("v3", "2")]
    assert ingest.ingest_errors(spark, out).count() == 0
    assert spark.read.parquet(f"{out}/points").filter("version_id = 'v3'").select("batch").distinct().count() == 1


def test_the_last_text_of_a_version_counts(spark, tmp_path):
    """Several texts of one version in one micro-batch: the order column decides, not the checksum."""
    schema = "doc_id long, text string, title string, version_id string, upload_no int"
    folder = str(tmp_path / "in")
    os.makedirs(folder)
    rows = [(1, f"Điều {n}. A\nx", "T", "v1", at) for at, n in enumerate((4, 8, 3, 9, 5))]
    for run, part in enumerate((rows, rows[::-1])):
        out = str(tmp_path / f"out{run}")
        arrive(spark, folder, part, schema, run)
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(folder)
        ingest.ingest_stream(stream, out, str(tmp_path / f"cp{run}"), dim=16, order="upload_no")
        assert [r.article_number for r in ingest.current_points(spark, out).collect()] == ["5"]


def test_a_table_of_several_files_is_a_stream(spark, tmp_path):
    """A folder of files, as large tables are, streams as one file does; other tables beside it do not."""
    rows = [(i, f"t{i}") for i in range(20)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    frame.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    frame.withColumn("doc_id", F.col("doc_id") + 100).write.parquet(str(tmp_path / "others.parquet"))
    (tmp_path / "single").mkdir()
    frame.coalesce(1).write.parquet(str(tmp_path / "made"))
    (part,) = [p for p in (tmp_path / "made").iterdir() if p.name.startswith("part-")]
    (tmp_path / "single" / "documents.parquet").write_bytes(part.read_bytes())
    for n, folder in enumerate((tmp_path, tmp_path / "single")):
        stream = jobs.stream_table(spark, str(folder), "documents")
        out = jobs.run_to_table(stream, str(tmp_path / f"out{n}"), str(tmp_path / f"cp{n}"))
        assert sorted(map(tuple, out.collect())) == rows


def test_changes_go_on_over_batches_and_need_no_python(spark, tmp_path):
    """A later run compares a job with its last state; nulls among keys and times have a place; the work stays on the JVM."""
    folder = str(tmp_path / "in")
    os.makedirs(folder)
    stream = spark.readStream.schema(JOBS.replace("ts timestamp", "ts long")).option("recursiveFileLookup", True).parquet(folder)
    first = [(1, 10, 1, "pending", 0, 1), (1, 10, 2, "pending", 0, 2), (None, None, 3, "failed", 1, 1), (2, 20, 5, "running", 0, None), (2, 20, 6, "pending", 0, 9)]
    later = [(1, 10, 7, "pending", 0, 3), (1, 10, 8, "failed", 0, 4), (None, None, 9, "failed", 1, 2), (2, 20, 4, "running", 0, 1)]
    want = [{1: None, 3: None, 5: "pending", 6: None}, {8: "pending"}]
    found = {}
    for run, part in enumerate((first, later)):
        arrive(spark, folder, part, JOBS.replace("ts timestamp", "ts long"), run)
        made = jobs.job_change_stream(stream)
        out = jobs.run_to_table(made, str(tmp_path / "out"), str(tmp_path / "cp"))
        assert not hasattr(jobs, "GroupState")  # no Python call per job
        found |= want[run]
        assert {r.event_id: r.previous_status for r in out.collect()} == found
