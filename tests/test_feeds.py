"""Incremental feeds: files are read once, by their own header, and counted once committed."""

import os
import shutil

from panelcast.sources import feeds
from panelcast.sources.readers import files_by_header, read_feed
from panelcast.sources.schemas import CSV_SCHEMAS

FIELDS = [field.split()[0].strip("`") for field in CSV_SCHEMAS["poll_feed"].split(",")]


def write(path, pcts, turned=False, extra=False):
    names = [*reversed(FIELDS)] if turned else list(FIELDS)
    names += ["a, quoted"] if extra else []
    lines = [",".join(f'"{n}"' if "," in n else n for n in names)]
    lines += [",".join(str(p) if n == "pct" else "" for n in names) for p in pcts]
    path.write_text("\n".join(lines) + "\n")


def pcts(df):
    return sorted(r["pct"] for r in df.collect())


def test_a_second_refresh_reads_new_files_only(spark, tmp_path):
    source, store = tmp_path / "in put", str(tmp_path / "store")
    source.mkdir()
    assert feeds.current(spark, store).collect() == []
    write(source / "p1.csv", [1.0, 2.0])
    write(source / "p2.csv", [3.0], turned=True)
    (source / "p0.csv").write_text("")
    path = str(source / "*.csv")
    assert feeds.refresh(spark, path, store) == 2
    assert pcts(feeds.current(spark, store)) == [1.0, 2.0, 3.0]
    assert feeds.refresh(spark, path, store) == 0
    write(source / "p3.csv", [4.0, 5.0], extra=True)
    assert [os.path.basename(r["path"]) for r in feeds.new_files(spark, path, store).collect()] == ["p3.csv"]
    assert feeds.refresh(spark, path, store) == 1
    assert spark.read.parquet(f"{store}/rows/batch=2").count() == 2
    assert pcts(feeds.current(spark, store)) == [1.0, 2.0, 3.0, 4.0, 5.0]


def test_a_changed_file_replaces_its_rows(spark, tmp_path):
    store, file = str(tmp_path / "store"), tmp_path / "p.csv"
    write(file, [1.0, 2.0])
    feeds.refresh(spark, str(file), store)
    write(file, [9.0])
    assert feeds.refresh(spark, str(file), store) == 1
    assert pcts(feeds.current(spark, store)) == [9.0]


def test_a_batch_without_a_manifest_does_not_count(spark, tmp_path):
    store = str(tmp_path / "store")
    write(tmp_path / "p1.csv", [1.0])
    feeds.refresh(spark, str(tmp_path / "p1.csv"), store)
    write(tmp_path / "p2.csv", [2.0])
    feeds.refresh(spark, str(tmp_path / "p2.csv"), store)
    shutil.rmtree(f"{store}/manifest/2")
    assert pcts(feeds.current(spark, store)) == [1.0]
    write(tmp_path / "p3.csv", [3.0])
    assert feeds.refresh(spark, [str(tmp_path / "p2.csv"), str(tmp_path / "p3.csv")], store) == 2
    assert pcts(feeds.current(spark, store)) == [1.0, 2.0, 3.0]


def test_headers_come_from_one_job(spark, tmp_path):
    for i in range(30):
        write(tmp_path / f"p{i:02}.csv", [float(i)], turned=i % 3 == 0)
    (tmp_path / "p99.csv").write_text("")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("headers", "headers")
    found = files_by_header(spark, str(tmp_path / "*.csv"))
    jobs = len(tracker.getJobIdsForGroup("headers"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(map(len, found.values())) == [10, 20] and jobs <= 6
    assert pcts(read_feed(spark, str(tmp_path / "*.csv"))) == [float(i) for i in range(30)]
