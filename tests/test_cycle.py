"""The task cycle: restart behind finished tasks, failing tasks, skipped tasks."""

from pyspark.sql import functions as F

from urlsift.operators import cycle
from urlsift.operators.tasks import Changes, Task


def test_cycle_restarts_records_errors_and_skips(spark, tmp_path):
    now = "2024-02-01 00:00:00"
    tables = {"urls": spark.createDataFrame([(k, "pending") for k in range(6)], "id long, outcome string"),
              "tasks": spark.createDataFrame([], "id long, task_type string, task_status string, updated_at timestamp_ntz"),
              "task_errors": spark.createDataFrame([], "task_id long, error string, updated_at timestamp_ntz"),
              "link_task_urls": spark.createDataFrame([], "task_id long, url_id long"), "url_error_info": spark.createDataFrame([], "url_id long, task_id long, error string")}
    runs = []

    def marks(outcome, rest):
        def apply(q, s):
            runs.append(outcome)
            own = q.select(F.col("id").alias("url_id"))
            return Changes(status_updates=own.where(F.col("url_id") % 3 == rest).select("url_id", F.lit(outcome).alias("outcome")),
                           errors=own.where("url_id = 5").select("url_id", F.lit("bad").alias("error")) if outcome == "error" else None)
        return apply

    def breaks(q, s):
        runs.append("breaks")
        return Changes(status_updates=q.select(F.col("id").alias("url_id"), F.raise_error(F.lit("service down")).cast("string").alias("outcome")))

    pending = lambda s: s["urls"].where("outcome = 'pending'")
    tasks = [Task("one", pending, marks("duplicate", 0)), Task("broken", pending, breaks), Task("none", lambda s: s["urls"].where("id < 0"), breaks),
             Task("two", pending, marks("error", 1))]
    out = cycle.run_cycle(spark, tables, tasks, f"{tmp_path}/c", 70, now)
    assert {r.id: r.outcome for r in out["urls"].collect()} == {0: "duplicate", 1: "error", 2: "pending", 3: "duplicate", 4: "error", 5: "error"}
    assert sorted((r.id, r.task_type, r.task_status) for r in out["tasks"].collect()) == [(70, "one", "ready to label"), (71, "broken", "error"), (73, "two", "ready to label")]
    assert [r.task_id for r in out["task_errors"].collect()] == [71] and "service down" in out["task_errors"].first().error
    assert sorted(map(tuple, out["link_task_urls"].collect())) == [(70, k) for k in range(6)] + [(73, k) for k in (1, 2, 4, 5)]
    assert [tuple(r) for r in out["url_error_info"].collect()] == [(5, 73, "bad")]
    # run again: nothing is repeated; a cycle cut off behind its second task goes on there
    assert runs == ["duplicate", "breaks", "error"]
    cycle.run_cycle(spark, tables, tasks, f"{tmp_path}/c", 70, now)
    cycle.run_cycle(spark, tables, tasks[:2], f"{tmp_path}/cut", 70, now)
    runs.clear()
    again = cycle.run_cycle(spark, tables, tasks, f"{tmp_path}/cut", 70, now)
    assert runs == ["error"] and again["tasks"].count() == 3
    # plans do not grow with the tasks before
    assert len(out["urls"]._jdf.queryExecution().optimizedPlan().toString().splitlines()) == 1
