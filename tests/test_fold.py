import random
from decimal import Decimal

import numpy as np

from odonto.operators import fold


def brute(rows, balances):
    left, out = {b: int(x * 100) for b, x in balances.items()}, {}
    for seq, bill, raw, amount, ok in sorted(rows):
        if raw * 100 > left[bill]:
            out[seq] = (False, True)
        else:
            out[seq] = (ok, False)
            left[bill] -= int(amount * 100) if ok else 0
    return out


def test_fold_matches_one_by_one(spark, monkeypatch):
    rng = random.Random(12)
    rows, balances = [], {b: Decimal(rng.randrange(0, 5000)) / 100 for b in range(12)}
    balances |= {100: Decimal("90.00"), 101: Decimal("0.00")}
    for seq in range(1500):
        bill = rng.choice([*range(12), 100, 100, 100, 101])
        raw = Decimal(rng.choice((0, 1, 7, 100, 333, 2500, 4999)) + rng.randrange(3)) / 100 + rng.choice((Decimal(0), Decimal("0.004")))
        rows.append((seq, bill, raw, raw.quantize(Decimal("0.01")), rng.random() < 0.8))
    schema = "seq long, bill_id long, amount_raw decimal(38,10), amount decimal(10,2), method_ok boolean"
    held = spark.createDataFrame([(b, x) for b, x in balances.items()], "bill_id long, remaining decimal(12,2)")
    for block in (4096, 5, 1):
        monkeypatch.setattr(fold, "BLOCK", block)
        found = fold.fold_payments(spark.createDataFrame(rows, schema), held).collect()
        assert {r.seq: (r.accepted, r.over_balance) for r in found} == brute(rows, balances)


def test_walk_matches_a_loop():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(0, 40))
        cents, ok, left = rng.integers(0, 30, n), rng.random(n) < 0.7, int(rng.integers(0, 120))
        raw = 2 * cents + rng.integers(0, 2, n)
        accepted, over, rest = fold._walk(raw, cents, ok, left)
        for i in range(n):
            assert over[i] == (raw[i] > 2 * left) and accepted[i] == (not over[i] and ok[i])
            left -= cents[i] if accepted[i] else 0
        assert rest == left
