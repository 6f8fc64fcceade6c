"""The ledger stream against its batch form: late supersedes in every order, restarts, the watermark and the end of a job's state."""

import itertools
import random
from datetime import datetime, timedelta

import pytest

from leafmill.operators.ledger import PLANS
from leafmill.streaming import ledger

SCHEMA = "event_id long, ts timestamp, job_id long, status_type string, new_status string"
COLUMNS = ["job_id", "processing_status", "qc_status", "ocr_status", "export_status"]


def at(seconds):
    return datetime(2024, 1, 1) + timedelta(seconds=seconds)


class Stream:
    """A folder of micro-batches, and what the query's last rows of each job are."""

    def __init__(self, spark, path, **options):
        self.spark, self.path, self.options, self.n, self.last, self.runs = spark, path, options, 0, {}, 0

    def add(self, rows):
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(self.path / "in" / f"{self.n:03}"))
        self.n += 1

    def run(self):
        """Reads what is new, one folder a batch, from the checkpoint on."""
        def keep(df, _):
            for r in df.collect():
                self.last[r["job_id"]] = tuple(r)
                self.seen.append(tuple(r))

        self.seen = []
        source = self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(self.path / "in"))
        q = ledger.ledger_stream(source, **self.options).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(self.path / "cp")).start()
        q.processAllAvailable()
        q.stop()
        return self.last


def batch(spark, rows):
    return {r["job_id"]: tuple(r) for r in PLANS["a07_fold_status"].apply(job_event=spark.createDataFrame(rows, SCHEMA)).select(*COLUMNS).collect()}


def test_every_order_of_a_late_supersede(spark, tmp_path):
    # A job for each order of five events; micro-batch k brings the k-th event of every job.
    base = [(1, 10, "processing", "InProgress"), (2, 20, "qc", "PASS"), (3, 30, "Processing", "Completed"), (4, 30, "supersede", "Superseded"), (5, 40, "qc", "FAIL")]
    orders = list(itertools.permutations(base))
    rows = [[(e[0], at(e[1]), job, e[2], e[3]) for job, order in enumerate(orders) for e in [order[k]]] for k in range(len(base))]
    s = Stream(spark, tmp_path)
    for r in rows:
        s.add(r)
    assert s.run() == batch(spark, [x for r in rows for x in r])
    assert set(s.last.values()) == {(job, "Superseded", "PASS", "Pending", "Superseded") for job in range(len(orders))}


def test_random_logs_and_a_restart(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, at(rng.randrange(500)), rng.randrange(12), rng.choice(["processing", "qc", "OCR", "export", "colour", "processing"]), rng.choice("ABC")) for i in range(200)]
    rows += [(900 + j, at(rng.randrange(500)), j, "Supersede", "Superseded") for j in range(5)] + [(950, at(100), 3, "supersede", "Superseded"), (960, rows[7][1], rows[7][2], rows[7][3], "tie")]
    rng.shuffle(rows)
    s = Stream(spark, tmp_path)
    for k in range(3):
        s.add(rows[k * 40 : (k + 1) * 40])
    s.run()
    for r in (rows[120:160], rows[160:]):
        s.add(r)
    assert s.run() == batch(spark, rows)  # the second run goes on from the checkpoint


def test_watermark_and_the_end_of_a_jobs_state(spark, tmp_path):
    s = Stream(spark, tmp_path, idle_ms=3_600_000)
    s.add([(1, at(0), 1, "processing", "Completed"), (2, at(0), 2, "supersede", "Superseded"), (3, at(0), 3, "qc", "PASS")])
    s.add([(4, at(1200), 9, "qc", "PASS")])  # moves the watermark to 600 s; it counts for late events one batch later
    s.add([(11, at(1201), 9, "qc", "PASS")])
    s.add([(5, at(1), 1, "supersede", "Superseded"), (6, at(900), 3, "qc", "FAIL"), (7, at(900), 2, "processing", "Completed")])
    s.run()
    assert s.last[1] == (1, "Completed", "Pending", "Pending", "Pending")  # over ten minutes late
    assert s.last[2][1] == "Superseded" and s.last[3][2] == "FAIL"
    s.add([(8, at(9000), 9, "qc", "FAIL")])
    s.add([(12, at(9000), 9, "qc", "FAIL")])
    s.add([(9, at(9001), 2, "ocr", "Completed"), (10, at(9001), 9, "ocr", "Completed")])
    s.run()
    assert s.last[2] == (2, "Pending", "Pending", "Completed", "Pending")  # idle for over an hour: nothing is known of it any more
    assert s.last[9] == (9, "Pending", "FAIL", "Completed", "Pending")


@pytest.mark.parametrize("seed", range(20))
def test_kept_writes_answer_every_later_cut(seed):
    rng = random.Random(seed)
    writes = [(rng.choice(ledger.FIELDS), rng.choice("AB"), rng.randrange(30), i) for i in range(40)]
    settled = rng.randrange(30)
    kept = ledger.kept_writes(ledger.kept_writes(writes, None, settled - 3), None, settled)
    assert sum(w[2] < settled for w in kept) <= len(ledger.FIELDS)
    for cut in [None, *range(settled, 31)]:
        before = [w for w in writes if cut is None or w[2] < cut]
        assert ledger.statuses(ledger.kept_writes(kept, cut, settled), cut) == ledger.statuses(before, cut)
