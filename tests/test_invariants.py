"""Invariants of the jobs, feeds and streams on the driver's sf0.001 tables."""
from pyspark.sql import functions as F

from clinic_constants import SF001
from odonto.plans import audits, feeds, jobs
from odonto.sources import requests as rq
from odonto.sources.io import persist_snapshot
from odonto.streaming.bill_status import stream_bill_status

AS_OF = "2024-01-15"


def test_every_request_has_one_outcome(spark, driver_t):
    req = rq.payment_requests(spark, SF001)
    out = jobs.add_payments(driver_t, req, AS_OF).outcome
    assert out.count() == req.count() == out.select("seq").distinct().count()
    b = rq.booking_requests(spark, SF001)
    o = jobs.book_appointments(driver_t, b, AS_OF).outcome
    assert o.count() == b.count() == o.select("seq").distinct().count()


def test_recompute_clears_status_audit(driver_t):
    # T7 only touches bills that received payments; for those, D7 must be empty.
    t = driver_t.replace(bills=feeds.recompute_bill_status(driver_t.bills, driver_t.payments))
    paid = driver_t.payments.select(F.col("bill_id").cast("string").alias("record_key")).distinct()
    assert audits.bill_status(t).join(paid, "record_key", "left_semi").count() == 0


def test_stream_equals_batch(driver_t):
    batch = {r.bill_id: r.status for r in feeds.recompute_bill_status(driver_t.bills, driver_t.payments).collect()}
    stream = {r.bill_id: r.status for r in stream_bill_status(driver_t, files_per_trigger=1).collect()}
    assert stream == batch


def test_two_batches_equal_one(spark, driver_t):
    req = rq.payment_requests(spark, SF001)
    one = jobs.add_payments(driver_t, req, AS_OF)
    cut = req.approxQuantile("seq", [0.5], 0.0)[0]
    first = jobs.add_payments(driver_t, req.filter(F.col("seq") <= cut), AS_OF)
    # Cut the lineage between batches with a written snapshot in the shared folder.
    t1 = persist_snapshot(first.snapshot)
    second = jobs.add_payments(t1, req.filter(F.col("seq") > cut), AS_OF)
    key = lambda o: sorted((r.seq, r.status_code) for r in o.collect())
    assert key(one.outcome.select("seq", "status_code")) == key(
        first.outcome.select("seq", "status_code").unionByName(second.outcome.select("seq", "status_code")))
    s1 = {r.bill_id: r.status for r in one.snapshot.bills.collect()}
    s2 = {r.bill_id: r.status for r in second.snapshot.bills.collect()}
    assert s1 == s2


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() >= 0 and "remaining_balance" in df.columns


def test_runs_from_another_directory(tmp_path):
    """The driver imports the entry module from elsewhere with a plain session:
    Python workers must not need the package on their path."""
    import subprocess
    import sys as _sys
    repo = __import__("os").path.dirname(__import__("os").path.dirname(__import__("os").path.abspath(__file__)))
    code = (
        "import sys; sys.path.insert(0, %r)\n"
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "import __spark_entry__ as E\n"
        "q = E.queries()\n"
        "print('ROWS', q['add_payments'](s, %r).count(), q['patch_patients_audit'](s, %r).count())\n"
    ) % (repo, SF001, SF001)
    out = subprocess.run([_sys.executable, "-c", code], cwd=str(tmp_path), capture_output=True, text=True, timeout=900)
    assert "ROWS" in out.stdout, out.stderr[-2000:]
