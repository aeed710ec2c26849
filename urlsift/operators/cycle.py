"""The task cycle (J15) over versioned snapshots.

Every task reads stored tables and writes what it changes to ``root/v<NN>/<table>``, then a manifest row; so a
plan never grows with the tasks before it, and a cycle that was cut off goes on behind its last finished task.

Bytes follow what changes: rows that a task appends are written alone and read together with the table's last whole
version, and of ``urls`` a version holds the changed columns of the URLs changed so far, which overlay the URLs given; they are
written whole once, at the end. URLs, their changes and each queue lie in buckets of the URL, so that a join by it moves the
other side only. What a task stores for itself is deleted when it ends, shuffle files with the statement that made them.
"""

from __future__ import annotations

import uuid
from functools import partial
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlsift.functions.html import html_content_wide
from urlsift.operators import queues as qs
from urlsift.operators import tasks as tk
from urlsift.operators.buckets import IN_BUCKETS, bucket_count, bucketed, forget, write_bucketed
from urlsift.operators.review import TABLE_KEYS, _align, folded, overlay, set_status, upsert
from urlsift.session import checkpoint_dir, settings, written

# changed: whole tables (of ``urls`` all changes so far), appended: new rows only, buckets: those of the URLs
MANIFEST = "task_id long, task_type string, outcome string, changed array<string>, appended array<string>, buckets int"
Answers = dict[str, Callable[[DataFrame], DataFrame]]


def standard_tasks(answers: Answers, as_of) -> list[tk.Task]:
    """The eight tasks in their order. ``answers`` maps a task type to a function from the task's queue to the remote
    answers the task joins (fetches, known URLs, probes, labels, matches, metadata, receipts)."""
    return [
        tk.Task("HTML", qs.queue_html, lambda q, s: tk.html_task(q, answers["HTML"](q))),
        tk.Task("Duplicate Detection", qs.queue_duplicate_check, lambda q, s: tk.duplicate_task(q, answers["Duplicate Detection"](q), as_of)),
        tk.Task("404 Probe", lambda s: qs.queue_404_probe(s, as_of), lambda q, s: tk.probe_404_task(q, answers["404 Probe"](q), as_of)),
        tk.Task("Record Type", qs.queue_record_type, lambda q, s: tk.record_type_task(q, answers["Record Type"](q))),
        tk.Task("Agency Identification", qs.queue_agency, lambda q, s: tk.agency_task(q, answers["Agency Identification"](q))),
        tk.Task("Misc Metadata", qs.queue_misc_metadata, lambda q, s: tk.misc_metadata_task(answers["Misc Metadata"](q), html_content_wide(s["url_html_content"]))),
        tk.Task("Submit Approved URLs", lambda s: s["urls"].where(F.col("outcome") == "validated").select("id"),
                lambda q, s: tk.submission_task(q, answers["Submit Approved URLs"](q), as_of)),
        tk.Task("Relevancy", qs.queue_auto_relevance, lambda q, s: tk.relevance_task(q)),
    ]


def _merged(state: dict, changes: DataFrame | None, ch: tk.Changes, task_id: int, as_of, buckets: int, store: Callable[[DataFrame, str], DataFrame]) -> tuple[dict, dict]:
    """The tables a task changes (of ``urls`` all changes so far), and the rows it appends to others. What several tables
    are made from is stored first."""
    updates = store(ch.status_updates.select("url_id", "outcome"), "task-updates") if ch.status_updates is not None else None
    whole: dict[str, DataFrame] = {}
    rows: dict[str, DataFrame] = {}
    later = []
    if "urls" in ch.upserts:
        named = ch.upserts["urls"]
        later.append(store(named.select("url_id", *[c for c in named.columns if c != "url_id" and c in state["urls"].columns]), "task-urls").repartition(buckets, "url_id"))
    if ch.errors is not None:
        errors = store(ch.errors.groupBy("url_id").agg(F.min("error").alias("error")), "task-errors")
        rows["url_error_info"], failed = tk.record_errors(errors, task_id, as_of)
        # an error outranks any other transition of the same run
        updates = failed if updates is None else updates.join(failed, "url_id", "left_anti").unionByName(failed)
    if updates is not None and not updates.isEmpty():
        later.append(updates.repartition(buckets, "url_id").distinct())
    for df in later:
        df = df.select("url_id", *[F.col(c).cast(state["urls"].schema[c].dataType).alias(c) for c in df.columns if c != "url_id"])
        changes = whole["urls"] = df if changes is None else folded(changes, df, "url_id")
    rows |= ch.appends
    for name, df in ch.upserts.items():
        if name != "urls":
            whole[name] = upsert(state[name], _align(store(df.dropDuplicates(TABLE_KEYS[name]), "task-rows"), state[name]), TABLE_KEYS[name])
    for name in whole.keys() & rows.keys() - {"urls"}:
        whole[name] = whole[name].unionByName(_align(rows.pop(name), state[name]))
    return whole, rows


def _row(spark: SparkSession, **values) -> DataFrame:
    return spark.range(1).select(*[F.lit(v).alias(c) for c, v in values.items()])


class _Versions:
    """The tables between two tasks: the last whole version of each with the rows appended since, ``urls`` with their changes."""

    def __init__(self, spark: SparkSession, tables: dict, as_of):
        self.spark, self.as_of, self.whole, self.added = spark, as_of, dict(tables), {}
        self.changes: DataFrame | None = None
        self.catalogued: list[str] = []

    def start(self, folder: str, buckets: int) -> None:
        self.whole["urls"] = self._bucketed(f"{folder}/urls", self.whole["urls"], "id", buckets)

    def take(self, folder: str) -> None:
        """What a finished task left in ``folder``."""
        row = self.spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").first()
        for name in row.changed:
            stored = self.spark.read.parquet(f"{folder}/{name}")
            if name == "urls":
                self.changes = self._bucketed(f"{folder}/urls", stored, "url_id", row.buckets)
            else:
                self.whole[name] = stored
                self.added.pop(name, None)
        for name in row.appended:
            self.added.setdefault(name, []).append(f"{folder}/{name}")

    def tables(self) -> dict:
        state = {name: df if name not in self.added else df.unionByName(self.spark.read.schema(df.schema).parquet(*self.added[name]))
                 for name, df in self.whole.items()}
        if self.changes is not None:  # in one join, also where only outcomes changed
            merge = set_status if self.changes.columns == ["url_id", "outcome"] else partial(overlay, key_current="id", key_changes="url_id")
            state["urls"] = merge(state["urls"], self.changes, as_of=self.as_of)
        return state

    def _bucketed(self, path: str, like: DataFrame, key: str, buckets: int) -> DataFrame:
        table, df = bucketed(self.spark, path, like, key, buckets)
        self.catalogued.append(table)
        return df

    def close(self) -> None:
        for table in self.catalogued:
            forget(self.spark, table)


def run_cycle(spark: SparkSession, tables: dict, tasks: list[tk.Task], root: str, first_task_id: int, as_of, buckets: int | None = None) -> dict:
    """Run the tasks in order, each once over its whole queue; the result maps table names to their last versions.

    A task with an empty queue is skipped. One that fails changes nothing but gets its row in ``tasks`` with status
    'error' and its message in ``task_errors``; the next task goes on from the tables before it. Otherwise its URLs are linked to it
    and its row says 'ready to label'. Run again over the same ``root`` and tables, finished tasks are read and not repeated.
    ``buckets``: in how many buckets of its id the given ``urls`` lies; without, it is stored so first."""
    root = _qualified(spark, root.rstrip("/"))
    versions = _Versions(spark, tables, as_of)
    try:
        if buckets is None:
            buckets = _start(spark, tables, f"{root}/start")
            versions.start(f"{root}/start", buckets)
        for k, task in enumerate(tasks):
            folder, task_id = f"{root}/v{k:02d}", first_task_id + k
            if not _finished(spark, folder):
                _run_task(spark, versions.tables(), versions.changes, task, folder, task_id, as_of, buckets)
            versions.take(folder)
        last = versions.tables()
        if versions.changes is None:
            return last | {"urls": tables["urls"]}
        end = f"{root}/end{len(tasks):02d}"
        if not _finished(spark, end):
            with settings(spark, IN_BUCKETS):
                changed = _put({"urls": last["urls"]}, end)
            _manifest(spark, end, None, "end", "ready", changed, [], buckets)
        return last | {"urls": spark.read.schema(last["urls"].schema).parquet(f"{end}/urls")}
    finally:
        versions.close()


def _path(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _qualified(spark: SparkSession, path: str) -> str:
    place, fs = _path(spark, path)
    return fs.makeQualified(place).toString()


def _finished(spark: SparkSession, folder: str) -> bool:
    place, fs = _path(spark, f"{folder}/manifest/_SUCCESS")
    return fs.exists(place)


def _start(spark: SparkSession, tables: dict, folder: str) -> int:
    """The given URLs in buckets of their id, stored once; returns the number of buckets."""
    if not _finished(spark, folder):
        buckets = bucket_count(spark)
        with settings(spark, IN_BUCKETS):
            write_bucketed(tables["urls"].repartition(buckets, "id"), f"{folder}/urls", "id", buckets)
        _manifest(spark, folder, None, "start", "ready", [], [], buckets)
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").first().buckets


def _run_task(spark: SparkSession, state: dict, changes: DataFrame | None, task: tk.Task, folder: str, task_id: int, as_of, buckets: int) -> None:
    now, outcome = F.lit(as_of).cast("timestamp_ntz"), "ready to label"
    scratch = _qualified(spark, f"{checkpoint_dir(spark).rstrip('/')}/urlsift-tables/cycle-{uuid.uuid4().hex}")
    changed: list[str] = []
    appended: list[str] = []
    held = None
    try:
        with settings(spark, IN_BUCKETS):
            queue = task.queue(state)
            key = "url_id" if "url_id" in queue.columns else "id"
            write_bucketed(queue, f"{scratch}/queue", key, buckets)
            held, queue = bucketed(spark, f"{scratch}/queue", queue, key, buckets)
            if queue.isEmpty():
                outcome = "skipped"
            else:
                try:
                    whole, rows = _merged(state, changes, task.apply(queue, state), task_id, as_of, buckets, partial(written, folder=scratch))
                    rows["link_task_urls"] = tk.link_task_urls(task_id, queue)
                    if "urls" in whole:
                        write_bucketed(whole.pop("urls"), f"{folder}/urls", "url_id", buckets)
                        changed.append("urls")
                    changed += _put(_like(whole, state), folder)
                    appended = _put(_like(rows, state), folder)
                except Exception as failure:  # whatever stops a task is recorded as its error
                    outcome, changed = "error", []
                    appended = _put(_like({"task_errors": _row(spark, task_id=task_id, error=str(failure)[:2000], updated_at=now)}, state), folder)
                appended += _put(_like({"tasks": _row(spark, id=task_id, task_type=task.name, task_status=outcome, updated_at=now)}, state), folder)
    finally:
        if held:
            forget(spark, held)
        place, fs = _path(spark, scratch)
        fs.delete(place, True)
    _manifest(spark, folder, task_id, task.name, outcome, changed, appended, buckets)


def _manifest(spark: SparkSession, folder: str, task_id: int | None, name: str, outcome: str, changed: list[str], appended: list[str], buckets: int) -> None:
    names = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    spark.range(1).select(F.lit(task_id).cast("long").alias("task_id"), F.lit(name).alias("task_type"), F.lit(outcome).alias("outcome"), names(changed).alias("changed"),
                          names(appended).alias("appended"), F.lit(buckets).alias("buckets")).write.mode("overwrite").parquet(f"{folder}/manifest")


def _like(tables: dict, state: dict) -> dict:
    return {name: _align(df, state[name]) for name, df in tables.items()}


def _put(tables: dict, folder: str) -> list[str]:
    for name, df in tables.items():
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/{name}")
    return list(tables)
