"""Only contended payments meet their answers by seq."""
from odonto.operators.fold import fold_payments

CANDS = "seq long, bill_id long, amount_raw decimal(38,10), amount decimal(10,2), method_ok boolean, remaining decimal(20,2)"


def folded(spark, rows):
    from decimal import Decimal as D
    return fold_payments(spark.createDataFrame([(s, b, D(x), D(x), True, D(r)) for s, b, x, r in rows], CANDS))


def answers(df):
    return sorted((r["seq"], r["accepted"], r["over_balance"]) for r in df.collect())


def test_payments_keep_their_rows(spark):
    df = folded(spark, [(1, 1, 5, 9), (2, 2, 7, 8), (3, 2, 6, 8), (4, 2, 1, 8), (5, 3, 4, 3)])
    assert answers(df) == [(1, True, False), (2, True, False), (3, False, True), (4, True, False), (5, False, True)]
    assert df._jdf.queryExecution().optimizedPlan().toString().startswith("Union")


def test_a_seq_of_two_rows_gets_each_answer(spark):
    assert answers(folded(spark, [(1, 1, 5, 10), (1, 1, 5, 10)])) == [(1, True, False)] * 4
