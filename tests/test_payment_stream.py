"""Payment requests as a stream: the batch job's answers, however they are cut."""
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from clinic_constants import AS_OF
from odonto.plans.jobs import add_payments
from odonto.streaming import payments
from odonto.streaming.payments import payments_of, start_payments, write_request_files

PAY = "seq long, caller_id long, caller_role string, bill_id string, paid_amount string, payment_method string, notes string"


def random_requests(rng, n, bills):
    return [(seq, rng.choice([1, 2, 77]) if rng.random() < 0.2 else 1, rng.choice(["OWNER"] * 8 + ["CUSTOMER", "STAFF"]),
             rng.choice([*bills, *bills, "9999", "x"]), rng.choice(["1", "10.50", "250.004", "1000", "99999999999999999999", "-3", "0", ""]),
             rng.choice(["cash", "card", "cheque", None]), None) for seq in rng.sample(range(6 * n), n)]


def run(t, *where):
    q = start_payments(t, *where)
    q.awaitTermination()
    assert q.exception() is None


@pytest.mark.parametrize("run_length", [4096, 3])
def test_parts_and_restarts_equal_the_batch_job(spark, seed, tmp_path, monkeypatch, run_length):
    monkeypatch.setattr(payments, "RUN", run_length)
    rng = random.Random(8)
    bills = [str(r.bill_id) for r in seed.bills.collect()]
    rows = sorted(random_requests(rng, 120, bills))
    batch = add_payments(seed, spark.createDataFrame(rows, PAY), AS_OF)
    want = {r.seq: (r.status_code, r.reason) for r in batch.outcome.collect()}
    assert {201, 400, 403, 404, 500} <= {code for code, _ in want.values()}
    src, sink, ckpt = (str(tmp_path / x) for x in ("src", "sink", "ckpt"))
    parts = [rows[:37], rows[37:38], rows[20:90], rows[90:]]     # the third sends some again
    for part in parts:
        write_request_files(spark.createDataFrame(rng.sample(part, len(part)), PAY).coalesce(2), src)
        run(seed, src, sink, ckpt)                               # each run restarts from the checkpoint
    answers = spark.read.parquet(sink)
    assert answers.count() == sum(map(len, parts))
    found = {(r.seq, r.status_code, r.reason) for r in answers.collect()}
    assert found == {(seq, *x) for seq, x in want.items()}
    cols = ["payment_id", "bill_id", "paid_amount", "payment_method", "received_by_user_id"]
    got = sorted(map(tuple, payments_of(seed, answers, AS_OF).select(cols).collect()))
    assert got == sorted(map(tuple, batch.accepted.select(cols).collect()))
    assert answers.filter(F.col("again")).count() > 0


def test_a_block_holds_many_bills_in_few_state_rows(spark, tmp_path):
    """A state row per block of bills, not per bill; refused requests take none."""
    state = {}

    class Value:
        get = staticmethod(lambda: state.get("block"))
        update = staticmethod(lambda v: state.update(block=v))

    class Runs:
        getValue = staticmethod(lambda k: state[k])
        updateValue = staticmethod(lambda k, v: state.update({k: v}))

    class Handle:
        getValueState = staticmethod(lambda *a: Value)
        getMapState = staticmethod(lambda *a: Runs)

    def asked(rows):
        return pd.DataFrame([(s, b, c, 2 * c, ok) for s, b, c, ok in rows], columns=["seq", "bill_id", "cents", "raw_key", "row_ok"])

    p = payments.BillBalance()
    p.init(Handle)
    for part in ([(1, 500), (2, 0)], [(3, -7), (4, 10 ** 12)]):        # a block's rows in two calls
        p.handleInitialState((0,), pd.DataFrame(part, columns=["bill_id", "cents"]), None)
    rows = [(5, 1, 400, True), (1, 1, 200, True), (2, 1, 300, False), (3, 2, 1, True), (4, 3, 1, True), (6, 4, 10 ** 12, True), (7, 9, 1, True)]
    out, = p.handleInputRows((0,), iter([asked(rows)]), None)
    ok, over, refused, none = payments.ACCEPTED, payments.OVER, payments.REFUSED, payments.NO_BILL
    assert dict(zip(out["seq"], out["verdict"])) == {1: ok, 2: refused, 5: over, 3: over, 4: over, 6: ok, 7: none}
    assert set(state) == {"block"}
    out, = p.handleInputRows((0,), iter([asked([(5, 1, 1, True), (8, 1, 300, True), (8, 1, 300, True), (7, 9, 1, True)])]), None)
    assert list(zip(out["verdict"], out["again"])) == [(over, True), (ok, False), (ok, True), (none, False)]
    out, = p.handleInputRows((-3,), iter([asked([(9, 1, 5, True)])]), None)
    assert list(zip(out["verdict"], out["again"])) == [(refused, False)] and set(state) == {"block"}
