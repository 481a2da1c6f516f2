"""Edge rows for the easy-to-get-wrong semantics."""
import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from clinic_constants import AS_OF
from odonto.functions.exprs import age, code
from odonto.plans import audits, lists, views
from odonto.plans.jobs import add_payments, book_appointments

BOOK = ("seq long, caller_id long, caller_role string, patient_id string, dentist_id string, "
        "appointment_date string, appointment_time string, problem_description string")
PAY = "seq long, caller_id long, caller_role string, bill_id string, paid_amount string, payment_method string, notes string"


def test_soft_deleted_patient_keeps_bill(seed):
    t = seed.replace(patients=seed.patients.withColumn("is_deleted", F.col("patient_id") == 3))
    assert 3 in [r.bill_id for r in views.billing_summary(t).collect()]
    assert 3 not in [r.patient_id for r in views.appointment_details(t).collect()]


def test_cancelled_slot_strict_and_lenient(spark, seed):
    appts = seed.appointments.withColumn(
        "status", F.when(F.col("appointment_id") == 3, "CANCELLED").otherwise(F.col("status")))
    t = seed.replace(appointments=appts)
    when = (AS_OF + dt.timedelta(days=1)).isoformat()     # appointment 3: dentist 1, 12:00
    req = spark.createDataFrame([(1, 1, "OWNER", "5", "1", when, "12:00", "")], BOOK)
    strict = book_appointments(t, req, AS_OF, strict=True).outcome.first()
    lenient = book_appointments(t, req, AS_OF, strict=False).outcome.first()
    assert strict.status_code == 409 and strict.reason.startswith("Duplicate entry")
    assert lenient.status_code == 201


def test_batch_slot_lowest_seq_wins(spark, seed):
    when = (AS_OF + dt.timedelta(days=7)).isoformat()
    req = spark.createDataFrame([(9, 1, "OWNER", "1", "2", when, "10:00", ""),
                                 (4, 1, "OWNER", "2", "2", when, "10:00:00", ""),
                                 (6, 1, "OWNER", "9", "2", when, "10:00", "")], BOOK)
    out = {r.seq: r.status_code for r in book_appointments(seed, req, AS_OF).outcome.collect()}
    assert out == {4: 201, 9: 409, 6: 404}


def test_zero_total_bill_stays_unpaid(seed):
    bills = seed.bills.withColumn("total_amount", F.when(F.col("bill_id") == 3, F.lit(0).cast("decimal(10,2)"))
                                  .otherwise(F.col("total_amount"))).withColumn(
        "status", F.when(F.col("bill_id") == 3, "UNPAID").otherwise(F.col("status")))
    t = seed.replace(bills=bills)
    assert audits.bill_status(t).filter(F.col("record_key") == "3").count() == 0


def test_time_at_closing_is_refused(spark, seed):
    req = spark.createDataFrame([(1, 1, "OWNER", "5", "2", "2026-12-04", "13:00:00", "")], BOOK)
    assert book_appointments(seed, req, AS_OF).outcome.first().status_code == 400


def test_feb29_age(spark):
    df = spark.createDataFrame([(dt.date(2000, 2, 29),)], "dob date")
    assert df.select(age("dob", dt.date(2001, 2, 28))).first()[0] == 0
    assert df.select(age("dob", dt.date(2001, 3, 1))).first()[0] == 1


def test_code_padding_never_truncates(spark):
    df = spark.createDataFrame([(7,), (123456,)], "id long")
    assert [r[0] for r in df.select(code("patients", F.col("id"))).collect()] == ["PAT-00007", "PAT-123456"]
    assert df.select(code("dentists", F.lit(7))).first()[0] == "DEN-0007"


def test_percent_in_search_is_a_wildcard(seed):
    # 'Patient%o' matches names with an 'o' after 'Patient' (Bravo, Echo, ...).
    names = [r.name for r in lists.search_patient(seed, "Patient%o").collect()]
    assert "Patient Bravo" in names and "Patient Alpha" not in names
    assert [r.name for r in lists.search_patient(seed, "pATIENT_a").collect()] == ["Patient Alpha"]


def test_overpay_in_one_batch(spark, seed):
    # Bill 2 has 1500.00 left: 800 fits, 900 does not (700 left), 700 fits.
    req = spark.createDataFrame([(1, 1, "OWNER", "2", "800", "cash", None),
                                 (2, 1, "OWNER", "2", "900", "card", None),
                                 (3, 1, "OWNER", "2", "700", "", None)], PAY)
    res = add_payments(seed, req, AS_OF)
    out = {r.seq: (r.status_code, r.reason) for r in res.outcome.collect()}
    assert out == {1: (201, None), 2: (400, "Payment is greater than remaining balance"), 3: (201, None)}
    assert res.snapshot.bills.filter("bill_id = 2").first().status == "PAID"


def test_refused_method_consumes_nothing(spark, seed):
    req = spark.createDataFrame([(1, 1, "OWNER", "2", "1500", "cheque", None),
                                 (2, 1, "OWNER", "2", "1500", "CASH", None)], PAY)
    out = {r.seq: r.status_code for r in add_payments(seed, req, AS_OF).outcome.collect()}
    assert out == {1: 500, 2: 201}


def test_billing_access(spark, seed):
    req = spark.createDataFrame([(1, 2, "STAFF", "2", "10", "cash", None),
                                 (2, 3, "staff", "2", "10", "cash", None),
                                 (3, 4, "CUSTOMER", "2", "10", "cash", None),
                                 (4, None, None, "2", "10", "cash", None)], PAY)
    out = {r.seq: (r.status_code, r.reason) for r in add_payments(seed, req, AS_OF).outcome.collect()}
    assert out[1] == (403, "Staff billing access is disabled")
    assert out[2][0] == 201
    assert out[3] == (403, "Billing is not available for this role")
    assert out[4][0] == 201         # missing headers: OWNER, user 1


def test_number_coercion(spark, seed):
    req = spark.createDataFrame([(1, 1, "OWNER", "2", "", "cash", None),
                                 (2, 1, "OWNER", "2", "Infinity", "cash", None),
                                 (3, 1, "OWNER", "2.0", "1e1", "cash", None),
                                 (4, 1, "OWNER", "2.5", "1", "cash", None)], PAY)
    out = {r.seq: r.reason for r in add_payments(seed, req, AS_OF).outcome.collect()}
    assert out[1] == "paid_amount must be greater than zero"      # '' reads as 0
    assert out[2] == "paid_amount must be a valid non-negative number"
    assert out[3] is None
    assert out[4] == "bill_id must be a valid positive id"


def test_js_number_forms(spark):
    from odonto.functions.exprs import js_number, to_money
    vals = ["12", " 7.5 ", "", "1e3", "0x10", "0b101", "0o17", "1d", "abc", "-Infinity", ".5", "5."]
    df = spark.createDataFrame([(v,) for v in vals] + [(None,)], "s string")
    got = {r.s: (r.n, r.m) for r in df.select("s", js_number("s").alias("n"), to_money("s").alias("m")).collect()}
    import math
    from decimal import Decimal
    assert got["12"] == (12.0, Decimal("12.00")) and got[" 7.5 "][0] == 7.5 and got[""][0] == 0.0
    assert got["1e3"] == (1000.0, Decimal("1000.00")) and got["0x10"][0] == 16.0
    assert got["0b101"][0] == 5.0 and got["0o17"][0] == 15.0
    assert math.isnan(got["1d"][0]) and math.isnan(got["abc"][0]) and math.isnan(got[None][0])
    assert got["-Infinity"][0] == float("-inf") and got[".5"][0] == 0.5 and got["5."][0] == 5.0


# --- inputs that must not abort a batch, and reference semantics -------------

def test_numbers_of_any_size_parse(spark):
    from odonto.functions.exprs import js_number
    texts = {"0x10": 16.0, "0x" + "f" * 20: float(16 ** 20 - 1), "0b" + "1" * 70: float(2 ** 70 - 1), "0o" + "7" * 30: float(8 ** 30 - 1),
             "0x0": 0.0, "": 0.0, "1e30": 1e30}
    got = {r.s: r.n for r in spark.createDataFrame([(k,) for k in texts], "s string").select("s", js_number("s").alias("n")).collect()}
    assert all(abs(got[k] - v) <= 1e-9 * max(v, 1) for k, v in texts.items())


def test_huge_and_odd_payments_are_refused_alone(spark, seed):
    rows = [(1, 1, "OWNER", "3", "100000000000000000000", "cash", None), (2, 1, "OWNER", "3", "1e30", "cash", None),
            (3, 1, "OWNER", "3", "0x" + "f" * 20, "cash", None), (4, 1, "OWNER", "3", "100", "cash", None),
            (5, 999, "OWNER", "3", "100", "cash", None)]
    out = {r.seq: r.status_code for r in add_payments(seed, spark.createDataFrame(rows, PAY), AS_OF).outcome.collect()}
    assert out == {1: 400, 2: 400, 3: 400, 4: 201, 5: 500}


def test_unknown_callers_book_nothing(spark, seed):
    when = (AS_OF + dt.timedelta(days=7)).isoformat()
    rows = [(1, 999, "OWNER", "1", "2", when, "10:00", ""), (2, 1, "OWNER", "1", "2", when, "10:00", "")]
    out = {r.seq: r.status_code for r in book_appointments(seed, spark.createDataFrame(rows, BOOK), AS_OF).outcome.collect()}
    assert out == {1: 500, 2: 201}


def test_text_callers_and_empty_headers(spark, seed):
    from odonto.operators.access import billing_access
    rows = [(1, "abc", "STAFF"), (2, "", "STAFF"), (3, "3", "staff"), (4, None, ""), (5, "2", "STAFF")]
    got = {r.seq: r.billing_allowed for r in billing_access(seed, spark.createDataFrame(rows, "seq long, caller_id string, caller_role string")).collect()}
    assert got == {1: False, 2: False, 3: True, 4: True, 5: False}


def test_search_text_is_trimmed_and_a_backslash_is_text(seed):
    assert [r.name for r in lists.patients(seed, "  Patient Alpha ").collect()] == ["Patient Alpha"]
    assert lists.patients(seed, "   ").count() == 5
    assert lists.search_patient(seed, "a\\b").count() == 0
    assert lists.search_patient(seed, "100\\%").count() == 0


def test_bill_list_status_and_refusal(seed):
    assert lists.bills(seed, status="  ").count() == 3
    with pytest.raises(PermissionError, match="disabled"):
        lists.bills(seed, caller=(2, "STAFF"))
    assert lists.bills(seed, caller=(3, "STAFF")).count() == 3


def test_a_duplicate_timing_row_multiplies_nothing(spark, seed):
    t = seed.replace(clinic_timings=seed.clinic_timings.unionByName(seed.clinic_timings.withColumn("timing_id", F.col("timing_id") + 7)))
    when = (AS_OF + dt.timedelta(days=7)).isoformat()
    rows = book_appointments(t, spark.createDataFrame([(1, 1, "OWNER", "1", "2", when, "10:00", "")], BOOK), AS_OF).outcome.collect()
    assert [r.status_code for r in rows] == [201]


def test_case_does_not_split_groups_or_hide_duplicates(seed):
    from odonto.plans import reports
    names = F.when(F.col("treatment_id") == 2, F.upper("treatment_name")).otherwise(F.col("treatment_name"))
    t = seed.replace(treatments=seed.treatments.withColumn("treatment_name", F.when(F.col("treatment_id") < 3, F.lit("Procedure x")).otherwise(names)).withColumn(
        "treatment_name", F.when(F.col("treatment_id") == 2, F.upper("treatment_name")).otherwise(F.col("treatment_name"))))
    assert sorted(r.treatment_count for r in reports.treatment_report(t).collect()) == [1, 1, 2]
    mails = seed.users.withColumn("email", F.when(F.col("user_id") == 2, F.lit("USER1@clinic.test")).otherwise(F.col("email")))
    assert [r.detail for r in audits.unique(seed.replace(users=mails)).filter("table_name = 'users'").collect()] == ["2"]


def test_explicit_null_is_kept(spark):
    from odonto.sources.tables import conform
    df = spark.createDataFrame([(1, None)], "treatment_id long, cost decimal(10,2)")
    row = conform(df, "treatments").first()
    assert row.cost is None and row.status == "DONE"


def test_audit_ids_follow_arrival_order(spark, seed):
    from odonto.plans import feeds
    rows = spark.createDataFrame([("A", "t", i, None, None, None, dt.datetime(2024, 1, 1), i) for i in (3, 1, 2)],
                                 "action_type string, table_name string, record_id long, old_value string, new_value string, user_id long, created_at timestamp, _order long")
    got = {r.log_id: r.record_id for r in feeds.append_audit(seed.audit_logs, rows).collect()}
    assert got == {1: 1, 2: 2, 3: 3}


def test_previous_values_across_buckets(spark):
    from odonto.operators.carry import previous_values
    ups = [(1, 1, "a", True), (2, 1, None, False), (3, 1, None, True), (4, 2, "z", True), (5, 1, "b", True), (6, 1, "c", False)]
    df = spark.createDataFrame(ups, "seq long, k long, v string, s boolean")
    base = spark.createDataFrame([(1, "base"), (2, "two")], "k long, bv string")
    for bucket in (1, 2, 100):
        got = {r.seq: (r.prev_value, r.next_value) for r in previous_values(df, "k", "v", "s", base, "bv", bucket=bucket).collect()}
        assert got == {1: ("base", "a"), 2: ("a", "a"), 3: ("a", None), 4: ("two", "z"), 5: (None, "b"), 6: ("b", "b")}
