import random

from lodestone.streaming import jobs

EVENTS = "job_id long, seq long, status string, completed long, total long"


def history(rng, jobs_):
    """Events of jobs, some cancelled midway with later events still coming."""
    steps = ["PENDING", "CLONING", "ANALYZING_SERVICES", "BUILDING_GRAPH", "DETECTING_PATTERNS", "COMPLETED"]
    out = []
    for j in range(jobs_):
        n, stop = rng.randrange(1, len(steps) + 1), rng.choice([None, None, rng.randrange(6)])
        for k in range(n):
            status = "CANCELLED" if stop is not None and k == stop else steps[k]
            out.append((j, k, status, k, rng.choice([0, 6]) if k < 2 else 6))
    return out


def play(spark, folder, batches, **options):
    """The last state of each job, and all rows, after the batches have been read one by one."""
    seen = []
    # A batch for each folder of events alone: timers that run out are told with the next one.
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, EVENTS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        changes = jobs.state_changes(spark.readStream.schema(EVENTS).parquet(f"{folder}/in"), **options)
        query = changes.writeStream.foreachBatch(lambda df, _: seen.extend(map(tuple, df.collect()))).outputMode("update").option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start()
        assert query.awaitTermination(60) and query.exception() is None
    return {r[0]: r for r in seen}, seen


def test_states_do_not_depend_on_order_batches_or_repeats(spark, tmp_path):
    rng = random.Random(1)
    events = history(rng, 25)
    shuffled = events + rng.sample(events, 20)
    rng.shuffle(shuffled)
    third = len(shuffled) // 3
    last, _ = play(spark, tmp_path, [shuffled[:third], shuffled[third : 2 * third], shuffled[2 * third :]], idle_minutes=10**6)
    want = {tuple(r) for r in jobs.job_states(spark.createDataFrame(events, EVENTS)).collect()}
    assert {r[:3] for r in last.values()} == want and not any(r[3] for r in last.values())


def test_idle_jobs_time_out_and_late_events_take_it_back(spark, tmp_path):
    first = [(1, 1, "PENDING", 0, 4), (2, 1, "PENDING", 0, 4), (2, 2, "COMPLETED", 4, 4), (3, 2, "CLONING", 1, 4)]
    back = [(1, 2, "ANALYZING_SERVICES", 2, 4), (3, 1, "CANCELLED", 0, 4)]
    last, seen = play(spark, tmp_path, [first, [(9, 1, "COMPLETED", 1, 1)], back], idle_minutes=0)
    assert (1, "PENDING", 0, True) in seen and (3, "CLONING", 25, True) in seen  # not job 2, which is done
    assert (1, "ANALYZING_SERVICES", 50, False) in seen and last[2] == (2, "COMPLETED", 100, False) and last[3] == (3, "CANCELLED", 0, False)
