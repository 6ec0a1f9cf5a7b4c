import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from lodestone import api
from lodestone.operators import runs
from lodestone.sources import files, snapshots

from test_api import tree


def rows(df, *drop):
    return sorted(str(sorted(r.asDict(recursive=True).items(), key=str)) for r in df.drop("analysis_number", *drop).collect())


def test_snapshots_read_changed_files_and_equal_a_full_read(spark, tmp_path):
    root, store = tmp_path / "tree", str(tmp_path / "store")
    tree(root)
    first = snapshots.scan(spark, str(root), "shop", store, 1)
    assert first.n_read == first.n_parsed > 10
    # One file is changed, one new, one gone, one touched.
    client = root / "order-service/src/main/java/a/Client.java"
    client.write_text(client.read_text().replace("payment-service", "user-service"))
    (root / "user-service/src/main/java/a/More.java").write_text("package a;\nclass More { int a; }\n")
    (root / "payment-service/src/main/java/a/Client.java").unlink()
    os.utime(root / "user-service/src/main/java/a/Api.java", (1, 1))
    second = snapshots.scan(spark, str(root), "shop", store, 2)
    assert (second.n_read, second.n_parsed) == (3, 2)
    # Times are not trusted: all is read, nothing is taken apart again.
    third = snapshots.scan(spark, str(root), "shop", store, 3, trust_times=False)
    assert third.n_read > 10 and third.n_parsed == 0
    full = snapshots.read_tree(spark, str(root), "shop")
    for name in ("lines", "types", "props"):
        assert rows(getattr(second, name)) == rows(getattr(third, name)) == rows(getattr(full, name)), name
    assert rows(first.types) != rows(second.types)


def test_snapshots_that_follow_each_other_as_a_stream(spark, tmp_path, monkeypatch):
    made = []
    monkeypatch.setattr(api, "reanalyze", lambda spark, root, store, project, project_id, **options: made.append((root, project, project_id, options)) or len(made))
    kind, seen = "project_id long, project string, root string", []
    for batch in ([(7, "shop", "/b"), (7, "shop", "/a")], [(8, "mall", "/c")]):
        spark.createDataFrame(batch, kind).write.mode("append").parquet(f"{tmp_path}/in")
        query = api.follow_snapshots(spark, f"{tmp_path}/in", "store", f"{tmp_path}/c", told=seen.append, enabled={"X"})
        assert query.awaitTermination(100) and query.exception() is None
    assert made == [("/a", "shop", 7, {"enabled": {"X"}}), ("/b", "shop", 7, {"enabled": {"X"}}), ("/c", "mall", 8, {"enabled": {"X"}})] and seen == [1, 2, 3]


def test_a_sink_replaces_its_runs_and_reads_are_pruned(spark, tmp_path):
    at = str(tmp_path / "t")
    frame = lambda *x: spark.createDataFrame(list(x), "project_id long, analysis_number int, v string")
    files.sink(frame((1, 1, "a"), (1, 1, "b"), (1, 2, "c"), (2, 1, "d")), at)
    files.sink(frame((1, 2, "e"), (1, 3, "f")), at)
    files.sink(frame((1, 2, "e"), (1, 3, "f")), at)  # started again
    assert sorted(r.v for r in files.stored_runs(spark, at).collect()) == ["a", "b", "d", "e", "f"]
    one = files.stored_runs(spark, at, 1, 2)
    assert [tuple(r) for r in one.select("project_id", "analysis_number", "v").collect()] == [(1, 2, "e")]
    scan = next(x for x in one._jdf.queryExecution().executedPlan().toString().split("\n") if "PartitionFilters" in x)
    assert "(project_id" in scan.split("PartitionFilters")[1].split("PushedFilters")[0] and "(analysis_number" in scan.split("PartitionFilters")[1]
    files.drop_run(spark, at, 1, 2)
    assert sorted(r.v for r in files.stored_runs(spark, at, 1).collect()) == ["a", "b", "f"]


def job(spark, tmp_path, flag, **options):
    return runs.Run(spark, 5, f"{tmp_path}/events", flag, **options)


def state(spark, tmp_path):
    return [tuple(r) for r in runs.states(spark, f"{tmp_path}/events").collect()]


def test_a_run_tells_its_stages(spark, tmp_path):
    run = job(spark, tmp_path, lambda: False)
    for k, name in enumerate(["CLONING", "ANALYZING_SERVICES"]):
        with run.stage(name, k, 2):
            assert spark.range(10).count() == 10
    assert state(spark, tmp_path) == [(5, "ANALYZING_SERVICES", 50)]
    run.done(2)
    assert state(spark, tmp_path) == [(5, "COMPLETED", 100)]
    failing = runs.Run(spark, 6, f"{tmp_path}/events", lambda: False)
    with pytest.raises(ValueError), failing.stage("CLONING"):
        raise ValueError("no")
    assert (6, "FAILED", 0) in state(spark, tmp_path)


def test_cancelling_stops_a_stage_and_undoes_what_was_written(spark, tmp_path):
    flag, gone = threading.Event(), []
    run = job(spark, tmp_path, flag.is_set, every=0.2)
    with run.stage("CLONING", 0, 2):
        run.undo(lambda: gone.append("first"))
        run.undo(lambda: gone.append("second"))
    threading.Timer(1.0, flag.set).start()
    began = time.time()
    with pytest.raises(runs.Cancelled), run.stage("ANALYZING_SERVICES", 1, 2):
        # Some minutes of work, were it left alone.
        spark.range(0, 10**12, 1, 4).select(F.sum(F.xxhash64("id") % 7)).collect()
    assert time.time() - began < 60 and gone == ["second", "first"]
    assert state(spark, tmp_path) == [(5, "CANCELLED", 0)]
    with pytest.raises(runs.Cancelled), run.stage("BUILDING_GRAPH"):
        raise AssertionError("no stage begins after that")
    spark.range(5).count()  # jobs of others go on


def test_a_cancelled_analysis_leaves_nothing(spark, tmp_path):
    tree(tmp_path / "tree")
    asked = iter([False] * 2)  # before and after the first stage
    run = job(spark, tmp_path, lambda: next(asked, True), every=30)
    with pytest.raises(runs.Cancelled):
        api.reanalyze(spark, str(tmp_path / "tree"), f"{tmp_path}/store", "shop", run=run, enabled={"NANO_SERVICE"})
    assert not any((tmp_path / "store" / name).exists() for name in api.STORED)
    assert state(spark, tmp_path)[0][1] == "CANCELLED"
