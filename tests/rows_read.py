"""What a query's tasks read and shuffle, summed from the session's event log."""

from __future__ import annotations

import json
import os
import time


def _sum(spark, fn, metric: str) -> int:
    folder = spark.conf.get("spark.eventLog.dir").removeprefix("file:")
    path = os.path.join(folder, next(f for f in os.listdir(folder) if f.startswith(spark.sparkContext.applicationId)))
    start = os.path.getsize(path)
    fn()
    spark.range(1).count()  # its end flushes what came before
    time.sleep(0.5)
    total = 0
    with open(path) as f:
        f.seek(start)
        for line in f:
            if '"SparkListenerStageCompleted"' in line and line.endswith("\n"):
                total += sum(int(a["Value"]) for a in json.loads(line)["Stage Info"]["Accumulables"] if a["Name"] == metric)
    return total


def input_records(spark, fn) -> int:
    return _sum(spark, fn, "internal.metrics.input.recordsRead")


def shuffled_records(spark, fn) -> int:
    return _sum(spark, fn, "internal.metrics.shuffle.write.recordsWritten")


def fact_records(spark, fn, folder: str = "/root/testdata/") -> int:
    """Rows that scans of the given tables put out (not those of written ones)."""
    log = spark.conf.get("spark.eventLog.dir").removeprefix("file:")
    path = os.path.join(log, next(f for f in os.listdir(log) if f.startswith(spark.sparkContext.applicationId)))
    start = os.path.getsize(path)
    fn()
    spark.range(1).count()
    time.sleep(0.5)
    rows, values = set(), {}

    def scans(node):
        if "Scan parquet" in node.get("nodeName", "") and folder in str(node.get("metadata", {}).get("Location", "")):
            rows.update(m["accumulatorId"] for m in node["metrics"] if m["name"] == "number of output rows")
        for child in node.get("children", []):
            scans(child)

    with open(path) as f:
        f.seek(start)
        for line in f:
            if not line.endswith("\n"):
                continue
            if "sparkPlanInfo" in line:
                scans(json.loads(line)["sparkPlanInfo"])
            elif '"SparkListenerTaskEnd"' in line:
                for a in json.loads(line)["Task Info"]["Accumulables"]:
                    if "Update" in a and a.get("Metadata") == "sql":
                        values[a["ID"]] = values.get(a["ID"], 0) + int(a["Update"])
    return sum(v for i, v in values.items() if i in rows)
