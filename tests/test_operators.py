"""Operators against brute force on small inputs."""
import json
import random

from pyspark.sql import functions as F

from odonto.operators.fold import fold_payments
from odonto.operators.ids import assign_ids
from odonto.operators.patch import merge_patches


def test_assign_ids_dense_in_seq_order(spark):
    seqs = random.Random(1).sample(range(10_000), 700)
    df = spark.createDataFrame([(s,) for s in seqs], "seq long")
    got = sorted((r.seq, r.id) for r in assign_ids(df, "id", 100, bucket_size=64).collect())
    assert [i for _, i in got] == list(range(101, 801))


def test_fold_matches_sequential_reference(spark):
    rnd = random.Random(7)
    cands, balances, expect = [], [], {}
    seq = 0
    for bill in range(40):
        left = rnd.randint(-50, 400) * 100        # cents; some bills overpaid already
        balances.append((bill, left / 100))
        for _ in range(rnd.randint(1, 12)):
            amt = rnd.randint(1, 150) * 100 + rnd.choice([0, 1, 50])
            ok_method = rnd.random() > 0.15
            seq += 1
            cands.append((seq, bill, amt / 100, ok_method))
            if amt > left:
                expect[seq] = (False, True)
            elif ok_method:
                expect[seq] = (True, False)
                left -= amt
            else:
                expect[seq] = (False, False)
    # Hot bill: many payments, all fitting, to exercise the fast path.
    balances.append((999, 10_000.0))
    for _ in range(300):
        seq += 1
        cands.append((seq, 999, 1.0, True))
        expect[seq] = (True, False)
    c = spark.createDataFrame(cands, "seq long, bill_id long, amount double, method_ok boolean").select(
        "seq", "bill_id", F.col("amount").cast("decimal(38,10)").alias("amount_raw"),
        F.col("amount").cast("decimal(10,2)").alias("amount"), "method_ok")
    b = spark.createDataFrame(balances, "bill_id long, remaining double").select(
        "bill_id", F.col("remaining").cast("decimal(21,2)").alias("remaining"))
    got = {r.seq: (r.accepted, r.over_balance) for r in fold_payments(c, b).collect()}
    assert got == expect


def test_merge_patches_latest_present_value(spark):
    rows = [(1, 1, "a", True, "x", True), (1, 2, None, False, "y", True), (1, 3, None, True, None, False),
            (2, 1, "b", True, None, False)]
    df = spark.createDataFrame(rows, "k long, seq long, f string, has_f boolean, g string, has_g boolean")
    got = {r.k: (r.f, r.has_f, r.g, r.has_g) for r in merge_patches(df, "k", ["f", "g"]).collect()}
    assert got == {1: (None, True, "y", True), 2: ("b", True, None, False)}


def test_read_requests_presence(spark, tmp_path):
    from odonto.sources.requests import read_requests
    p = tmp_path / "req.jsonl"
    p.write_text("\n".join(json.dumps(o) for o in [
        {"seq": 1, "name": "A", "email": None}, {"seq": 2, "caller_role": "staff", "phone": 5551234}]))
    got = {r.seq: r for r in read_requests(spark, str(p), ["name", "email", "phone"]).collect()}
    assert (got[1].name, got[1].has_name, got[1].email, got[1].has_email, got[1].has_phone) == ("A", True, None, True, False)
    assert (got[2].phone, got[2].has_phone, got[2].caller_role) == ("5551234", True, "staff")


def test_assign_ids_sparse_seq(spark):
    # Gaps wider than a bucket: every row its own bucket, several levels used.
    seqs = [i * 1_000_003 + (i % 7) for i in range(500)] + [-5, -1_000_000_000]
    df = spark.createDataFrame([(s,) for s in seqs], "seq long")
    got = sorted((r.seq, r.id) for r in assign_ids(df, "id", 0, bucket_size=16).collect())
    assert [i for _, i in got] == list(range(1, len(seqs) + 1))
