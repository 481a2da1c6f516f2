"""Bulk write jobs: per-request routes re-aimed as set-level validate/apply jobs.

Every job takes a snapshot ``t`` (``Clinic``), a request batch and an
``as_of`` timestamp, and returns a ``JobResult``:

* ``outcome``  one row per request: seq, status_code (201/200 accepted, else
  the refusal code), reason (NULL when accepted) and the assigned key/code;
* ``accepted`` the rows written to the target table;
* ``snapshot`` the new snapshot (``t`` with the rows applied);
* ``audit``    audit rows the reference's triggers would have written.

Requests carry ``seq`` (arrival order, unique) and their body fields as
text; checks run in the reference's order and the first failure wins.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odonto.functions.exprs import code, is_finite_non_negative, js_number, time_value_ok, to_money
from odonto.operators.access import billing_access, caller_id
from odonto.operators.fold import fold_payments
from odonto.operators.ids import assign_ids, max_id
from odonto.operators.schedule import (MSG_DUPLICATE, MSG_SLOT_TAKEN, slot_flags, winners,
                                       with_clinic_hours)
from odonto.operators.validate import (Rule, date_rules, first_failure, non_negative_number,
                                       optional_text, positive_id_rule, required_text_default,
                                       time_rules)
from odonto.plans.views import billing_summary
from odonto.schemas import PAYMENT_METHODS
from odonto.session import stage, stage_files

MSG_FK = "Cannot add or update a child row: a foreign key constraint fails"
OUTCOME_COLS = ["seq", "status_code", "reason", "record_id", "record_code"]


@dataclass
class JobResult:
    outcome: DataFrame
    accepted: DataFrame
    snapshot: object
    audit: DataFrame | None = None


def _ts(as_of) -> Column:
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, dt.date) and not isinstance(as_of, dt.datetime):
        as_of = dt.datetime.combine(as_of, dt.time())
    return F.lit(as_of).cast("timestamp")


def _date(as_of) -> Column:
    return _ts(as_of).cast("date")


def _exists(df: DataFrame, key_col: str, probe: DataFrame, probe_key: str, flag: str, few: bool = False) -> DataFrame:
    """Add boolean ``flag``: ``df[key_col]`` is a key of ``probe``.

    The batch's distinct keys look themselves up, so the probed table is only
    scanned for one column and never deduplicated as a whole. Rows without a key
    are dealt out by ``seq``: as one key they would all meet in one task. ``few``: the
    probe is small by nature, so its keys go to the batch as they are. Spark then
    sees that they are few and needn't deal out the batch.
    """
    keys = probe.select(F.col(probe_key).alias("_asked")).distinct()
    if not few:
        keys = df.select(F.col(key_col).alias("_asked")).distinct().join(probe.select(F.col(probe_key).alias("_asked")), "_asked", "left_semi")
    keys = keys.withColumn(flag, F.lit(True))
    j = df.withColumn("_asked", F.coalesce(key_col, F.xxhash64("seq"))).join(keys, "_asked", "left").drop("_asked")
    return j.withColumn(flag, F.col(key_col).isNotNull() & F.coalesce(F.col(flag), F.lit(False)))


def _outcome(df: DataFrame, ok_code: int, id_col: str | None, code_col: str | None) -> DataFrame:
    return df.select(
        "seq", F.coalesce(F.col("status_code"), F.lit(ok_code)).alias("status_code"), "reason",
        (F.col(id_col) if id_col else F.lit(None)).cast("long").alias("record_id"),
        (F.col(code_col) if code_col else F.lit(None)).cast("string").alias("record_code"))


def _audit_rows(df: DataFrame, action: str, table: str, record: str, old: Column | None,
                new: Column | None, user: Column | None, ts: Column, order: Column) -> DataFrame:
    return df.select(
        F.lit(action).alias("action_type"), F.lit(table).alias("table_name"),
        F.col(record).cast("long").alias("record_id"),
        (old if old is not None else F.lit(None)).cast("string").alias("old_value"),
        (new if new is not None else F.lit(None)).cast("string").alias("new_value"),
        (user if user is not None else F.lit(None)).cast("long").alias("user_id"),
        ts.alias("created_at"), order.alias("_order"))


# --- W6 book appointments --------------------------------------------------

def book_appointments(t, req: DataFrame, as_of, strict: bool = True, clinic_id: int = 1) -> JobResult:
    """Validate and insert appointment bookings.

    Order of checks: patient id, dentist id, date text, time text, live
    patient, active dentist, clinic open and inside hours, slot free of a
    non-cancelled appointment (409), storable time (500), then the unique
    slot index (409). With ``strict`` (what the reference really does) the
    index also counts cancelled appointments; ``strict=False`` frees them.
    Within the batch, among requests that pass every check the lowest seq
    takes a slot; the others get the slot-taken answer.
    """
    ts = _ts(as_of)
    r_pid, pid = positive_id_rule("patient_id", "patient_id")
    r_did, did = positive_id_rule("dentist_id", "dentist_id")
    r_date, date_v = date_rules("appointment_date", "appointment_date")
    r_time, time_v = time_rules("appointment_time", "appointment_time")
    pre_rules = [r_pid, r_did, *r_date, *r_time]
    pre_code, pre_reason = first_failure(pre_rules)
    r = req.select(
        "seq", caller_id().alias("created_by_user_id"), pid.alias("patient_id"), did.alias("dentist_id"),
        date_v.alias("date_text"), time_v.alias("appointment_time"),
        optional_text("problem_description", 500).alias("problem_description"),
        pre_code.alias("_pre_code"), pre_reason.alias("_pre_reason"))
    # Read the batch once: every probe below starts from the parsed requests.
    r = stage(r.withColumn("appointment_date", F.col("date_text").try_cast("date")))
    live = t.patients.filter(~F.col("is_deleted"))
    active = t.dentists.filter(F.col("is_active"))
    r = _exists(r, "patient_id", live, "patient_id", "_patient_ok")
    r = _exists(r, "dentist_id", active, "dentist_id", "_dentist_ok")
    r = _exists(r, "created_by_user_id", t.users, "user_id", "_user_ok")
    r = with_clinic_hours(t, r, "date_text", "appointment_time", clinic_id)
    r = slot_flags(t.appointments, r)
    rules = [
        Rule(F.col("_pre_code").isNull(), 400, F.col("_pre_reason")),
        Rule(F.col("_patient_ok"), 404, "Patient not found"),
        Rule(F.col("_dentist_ok"), 404, "Dentist not found or inactive"),
        Rule(F.col("hours_ok"), 400, F.col("hours_reason")),
        Rule(~F.col("slot_live"), 409, MSG_SLOT_TAKEN),
        Rule(time_value_ok("appointment_time"), 500, "Incorrect time value"),
    ]
    if strict:
        rules.append(Rule(~F.col("slot_any"), 409, MSG_DUPLICATE))
    rules.append(Rule(F.col("_user_ok"), 500, MSG_FK))
    code_c, reason_c = first_failure(rules)
    # A failed pre-check carries its own code (400) through the first rule.
    r = stage(r.withColumn("status_code", code_c).withColumn("reason", reason_c)
              .drop("_patient_ok", "_dentist_ok", "_user_ok", "hours_ok", "hours_reason", "_pre_code", "_pre_reason"))
    passed = r.filter(F.col("status_code").isNull())
    contest = winners(passed)
    losers = contest.filter(~F.col("slot_winner")).select(
        "seq", F.lit(409).alias("status_code"), F.lit(MSG_SLOT_TAKEN).alias("reason"))
    won = contest.filter(F.col("slot_winner"))
    won = assign_ids(won, "appointment_id", max_id(t.appointments, "appointment_id"))
    new_rows = won.select(
        "appointment_id", code("appointments", F.col("appointment_id")).alias("appointment_code"),
        "patient_id", "dentist_id", "appointment_date", "appointment_time", F.lit("BOOKED").alias("status"),
        "problem_description", "created_by_user_id", ts.alias("created_at"), ts.alias("updated_at"),
        "seq")
    refused = r.filter(F.col("status_code").isNotNull()).select("seq", "status_code", "reason")
    outcome = (_outcome(refused.unionByName(losers), 201, None, None)
               .unionByName(_outcome(new_rows.withColumn("status_code", F.lit(None).cast("int"))
                                     .withColumn("reason", F.lit(None).cast("string")),
                                     201, "appointment_id", "appointment_code")))
    accepted = new_rows.drop("seq")
    snap = t.replace(appointments=t.appointments.unionByName(accepted))
    return JobResult(outcome, accepted, snap)


# --- W11 create bills ------------------------------------------------------

def create_bills(t, req: DataFrame, as_of) -> JobResult:
    """Validate and create bills (status UNPAID, total = subtotal - discount).

    Order: billing access (403), patient id, treatment id when given,
    subtotal, discount (missing -> 0), discount <= subtotal, live patient,
    treatment exists, amounts storable as DECIMAL(10,2) (500).
    """
    ts = _ts(as_of)
    # Parse each number once into its own column: the rule chain below then
    # reads columns, which keeps its generated code small.
    dis_src = F.when(F.col("discount_amount").isNull() | (F.col("discount_amount") == ""), F.lit("0")) \
        .otherwise(F.col("discount_amount"))
    acc = (billing_access(t, req)
           .withColumn("_has_tid", F.col("treatment_id").isNotNull() & (F.col("treatment_id") != ""))
           .withColumn("_pid_n", js_number(F.col("patient_id")))
           .withColumn("_tid_n", js_number(F.col("treatment_id")))
           .withColumn("_sub_n", js_number(F.col("subtotal")))
           .withColumn("_dis_n", js_number(dis_src))
           .withColumn("_sub_m", to_money(F.col("subtotal")))
           .withColumn("_dis_m", to_money(dis_src)))

    def pos_id(n):
        return (~F.isnan(n)) & (F.abs(n) != float("inf")) & (n == F.floor(n)) & (n > 0)

    pre = [
        Rule(F.col("billing_allowed"), 403, F.col("access_reason")),
        Rule(pos_id(F.col("_pid_n")), 400, "patient_id must be a valid positive id"),
        Rule(~F.col("_has_tid") | pos_id(F.col("_tid_n")), 400, "treatment_id must be a valid positive id"),
        Rule(is_finite_non_negative(F.col("_sub_n")), 400, "subtotal must be a valid non-negative number"),
        Rule(is_finite_non_negative(F.col("_dis_n")), 400, "discount_amount must be a valid non-negative number"),
        Rule(~(F.col("_dis_n") > F.col("_sub_n")), 400, "Discount amount cannot be greater than subtotal"),
    ]
    pre_code, pre_reason = first_failure(pre)
    r = acc.select(
        "seq", caller_id().alias("created_by_user_id"),
        F.when(pos_id(F.col("_pid_n")), F.col("_pid_n").cast("long")).alias("patient_id"),
        F.when(F.col("_has_tid") & pos_id(F.col("_tid_n")), F.col("_tid_n").cast("long")).alias("treatment_id"),
        F.col("_sub_m").alias("subtotal"), F.col("_dis_m").alias("discount_amount"),
        pre_code.alias("_pre_code"), pre_reason.alias("_pre_reason"))
    r = stage_files(r)
    r = _exists(r, "patient_id", t.patients.filter(~F.col("is_deleted")), "patient_id", "_patient_ok")
    r = _exists(r, "treatment_id", t.treatments, "treatment_id", "_treat_ok")
    r = _exists(r, "created_by_user_id", t.users, "user_id", "_user_ok", few=True)
    total = (F.col("subtotal") - F.col("discount_amount"))
    rules = [
        Rule(F.col("_pre_code").isNull(), 400, F.col("_pre_reason")),
        Rule(F.col("_patient_ok"), 404, "Patient not found"),
        Rule(F.col("treatment_id").isNull() | F.col("_treat_ok"), 404, "Treatment not found"),
        Rule(F.col("subtotal").isNotNull() & F.col("discount_amount").isNotNull(), 500,
             "Out of range value for a DECIMAL(10,2) amount"),
        Rule(F.col("_user_ok"), 500, MSG_FK),
    ]
    code_c, reason_c = first_failure(rules)
    # The pre-check rule carries the pre-check's own status code.
    code_c = F.when(F.col("_pre_code").isNotNull(), F.col("_pre_code")).otherwise(code_c)
    r = stage_files(r.withColumn("status_code", code_c).withColumn("reason", reason_c)
                    .drop("_patient_ok", "_treat_ok", "_user_ok", "_pre_code", "_pre_reason"))
    ok = assign_ids(r.filter(F.col("status_code").isNull()), "bill_id", max_id(t.bills, "bill_id"))
    new_rows = ok.select(
        "bill_id", code("bills", F.col("bill_id")).alias("bill_code"), "patient_id", "treatment_id",
        _date(as_of).alias("bill_date"), "subtotal", "discount_amount",
        total.cast("decimal(10,2)").alias("total_amount"), F.lit("UNPAID").alias("status"),
        "created_by_user_id", ts.alias("created_at"), "seq")
    refused = r.filter(F.col("status_code").isNotNull())
    outcome = _outcome(refused, 201, None, None).unionByName(
        _outcome(new_rows.withColumn("status_code", F.lit(None).cast("int"))
                 .withColumn("reason", F.lit(None).cast("string")), 201, "bill_id", "bill_code"))
    audit = _audit_rows(new_rows, "BILL_CREATED", "bills", "bill_id", None,
                        F.concat(F.lit("Total: "), F.col("total_amount").cast("string")),
                        F.col("created_by_user_id"), ts, F.col("seq"))
    accepted = new_rows.drop("seq")
    snap = t.replace(bills=t.bills.unionByName(accepted))
    return JobResult(outcome, accepted, snap, audit)


# --- W12 add payments ------------------------------------------------------

def parsed_payments(req: DataFrame) -> DataFrame:
    """Payment requests with typed values and the outcome of the body checks
    (``_body_code``) and of what the insert itself refuses (``_row_code``)."""
    r_bid, bid = positive_id_rule("bill_id", "bill_id")
    r_amt, amt_n = non_negative_number("paid_amount", "paid_amount")
    r_method, method = required_text_default("payment_method", "CASH", "payment_method", 20)
    body_code, body_reason = first_failure([r_bid, r_amt, Rule(amt_n > 0, 400, "paid_amount must be greater than zero")])
    # Read only when the insert is built, after the balance check: these
    # refuse the payment without consuming any balance.
    row_code, row_reason = first_failure([
        r_method,
        Rule(to_money(F.col("paid_amount")).isNotNull(), 500, "Out of range value for column 'paid_amount'"),
        Rule(F.upper(method).isin(PAYMENT_METHODS), 500, "Data truncated for column 'payment_method'"),
    ])
    return req.select(
        "seq", "caller_id", "caller_role", caller_id().alias("received_by_user_id"), bid.alias("bill_id"),
        to_money(F.col("paid_amount")).alias("paid_amount"),
        _exact(F.col("paid_amount")).alias("amount_raw"),
        F.upper(method).alias("payment_method"), optional_text("notes", 255).alias("notes"),
        body_code.alias("_body_code"), body_reason.alias("_body_reason"),
        row_code.alias("_row_code"), row_reason.alias("_row_reason"))


def checked_payments(r: DataFrame) -> DataFrame:
    """``_pre_code``: the refusal before the bill is looked at; ``_ins_code``: that
    after the balance check, which consumes nothing. ``r`` has the caller's
    access and ``_user_ok``."""
    pre_code, pre_reason = first_failure([Rule(F.col("billing_allowed"), 403, F.col("access_reason"))])
    ins_code, ins_reason = first_failure([Rule(F.col("_user_ok"), 500, MSG_FK)])
    return r.select(
        "seq", "received_by_user_id", "bill_id", "paid_amount", "amount_raw", "payment_method", "notes",
        F.coalesce(pre_code, "_body_code").alias("_pre_code"), F.when(pre_code.isNotNull(), pre_reason).otherwise(F.col("_body_reason")).alias("_pre_reason"),
        F.coalesce("_row_code", ins_code).alias("_ins_code"), F.when(F.col("_row_code").isNotNull(), F.col("_row_reason")).otherwise(ins_reason).alias("_ins_reason"))


def add_payments(t, req: DataFrame, as_of) -> JobResult:
    """Validate payments and apply them in arrival order per bill.

    Order: billing access (403), bill id, amount a valid number, amount > 0,
    bill known (404), amount <= balance left by earlier accepted payments
    (400), payment method in its domain (500, consumes nothing). Accepted
    payments update their bill's status (T7) and add PAYMENT_CREATED rows.
    """
    ts = _ts(as_of)
    # Read the batch once: every probe below starts from the parsed requests.
    r = stage_files(parsed_payments(req))
    r = checked_payments(_exists(billing_access(t, r), "received_by_user_id", t.users, "user_id", "_user_ok", few=True))
    # One join gives both the bill's existence and its balance before the batch.
    # Requests refused before that have no use for it and stay where they are.
    bs = stage_files(billing_summary(t).select("bill_id", F.col("remaining_balance").alias("remaining")))
    asking = F.col("_pre_code").isNull()
    found = stage_files(r.filter(asking).drop("_pre_code", "_pre_reason").join(bs, "bill_id", "left"))
    # A bill held several times gives its requests as many answers.
    held = stage_files(bs.groupBy("bill_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1))
    early = (r.filter(~asking).select("seq", "bill_id", F.col("_pre_code").alias("status_code"), F.col("_pre_reason").alias("reason"))
             .join(held, "bill_id", "left").withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("_n", F.lit(1).cast("long"))))))
    unknown = found.filter(F.col("remaining").isNull()).select(
        "seq", F.lit(404).alias("status_code"), F.lit("Bill not found").alias("reason"))
    cands = (found.filter(F.col("remaining").isNotNull())
             .withColumn("method_ok", F.col("_ins_code").isNull())
             .withColumnRenamed("paid_amount", "amount"))
    decided = stage_files(fold_payments(cands).drop("amount_raw", "remaining", "method_ok"))
    refused_fold = decided.filter(~F.col("accepted")).select(
        "seq",
        F.when(F.col("over_balance"), F.lit(400)).otherwise(F.col("_ins_code")).alias("status_code"),
        F.when(F.col("over_balance"), F.lit("Payment is greater than remaining balance"))
         .otherwise(F.col("_ins_reason")).alias("reason"))
    ok = assign_ids(decided.filter(F.col("accepted")), "payment_id", max_id(t.payments, "payment_id"))
    new_rows = ok.select(
        "payment_id", "bill_id", F.col("amount").alias("paid_amount"), _date(as_of).alias("payment_date"),
        "payment_method", "received_by_user_id", "notes", ts.alias("created_at"), "seq")
    refused = early.select("seq", "status_code", "reason").unionByName(unknown).unionByName(refused_fold)
    outcome = _outcome(refused, 201, None, None).unionByName(
        _outcome(new_rows.withColumn("status_code", F.lit(None).cast("int"))
                 .withColumn("reason", F.lit(None).cast("string")), 201, "payment_id", None))
    accepted = new_rows.drop("seq")
    from odonto.plans.feeds import recompute_bill_status
    payments = t.payments.unionByName(accepted)
    bills = recompute_bill_status(t.bills, payments, accepted.select("bill_id"))
    audit = _audit_rows(new_rows, "PAYMENT_CREATED", "payments", "payment_id", None,
                        F.concat(F.lit("Amount: "), F.col("paid_amount").cast("string")),
                        F.col("received_by_user_id"), ts, F.col("seq"))
    snap = t.replace(payments=payments, bills=bills)
    return JobResult(outcome, accepted, snap, audit)


def _exact(c: Column) -> Column:
    """The amount as given, exactly (DECIMAL(38,10)); blank -> 0.

    A positive amount too large for the type becomes its largest value, far
    above any balance, so that it is refused like any other overpayment.
    """
    from odonto.functions.exprs import js_number, js_trim
    s = js_trim(c)
    exact = (F.when(s == "", F.lit(0).cast("decimal(38,10)"))
             .when(s.rlike("^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)$"), s.try_cast("decimal(38,10)"))
             .otherwise(js_number(s).try_cast("decimal(38,10)")))
    return F.coalesce(exact, F.when(js_number(s) > 0, F.lit("9" * 28).cast("decimal(38,10)")))
