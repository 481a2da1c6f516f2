"""W7 and W8 as one batch whose changes can depend on one another.

``records.patch_appointments`` checks every patch against the stored row and
settles moves to one slot by the lowest seq. Here each change sees what the
accepted changes before it left: the appointment's date, time and status, and
the slots that other appointments took or gave up. A change that can't meet
another one is still decided without any order (``operators.replay``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odonto.functions.exprs import hhmm, js_number, time_value_ok, weekday_name
from odonto.operators.carry import previous_values
from odonto.operators.patch import apply_patch, has, merge_patches
from odonto.operators.replay import CHANGE, EVENT_COLS, HELD, ROW, SLOT, groups, replay
from odonto.operators.schedule import MSG_CLOSED, MSG_DUPLICATE, day_hours
from odonto.operators.validate import Rule, date_rules, first_failure, optional_text, required_text, time_rules
from odonto.plans.jobs import MSG_FK, JobResult, _audit_rows, _exists, _outcome, _ts
from odonto.plans.records import APPT_FIELDS, MSG_BAD_DATE, _ensure_has, _key, truthy
from odonto.schemas import APPOINTMENT_STATUSES
from odonto.session import stage


def _with_hours(df: DataFrame, hours: DataFrame, date: Column, prefix: str) -> DataFrame:
    """Add ``<prefix>open`` / ``close`` / ``closed`` of a date; no such day counts as closed."""
    named = hours.select("_dow", F.col("_open").alias(f"{prefix}open"), F.col("_close").alias(f"{prefix}close"),
                         F.col("_closed").alias(f"{prefix}closed"))
    return (df.withColumn("_dow", weekday_name(date)).join(named, "_dow", "left")
            .withColumn(f"{prefix}closed", F.col(f"{prefix}open").isNull() | F.coalesce(F.col(f"{prefix}closed"), F.lit(True)))
            .drop("_dow"))


def _parsed(t, req: DataFrame, hours: DataFrame) -> DataFrame:
    """Everything about a change that doesn't depend on other changes.

    ``pre_code`` is of the checks before the clinic's hours, ``post_code`` of
    those between the hours and the slot.
    """
    cancel = F.lower("op") == "cancel"
    given = {f: F.col(has(f)) & ~cancel for f in APPT_FIELDS}
    date_given, time_given = (given[f] & truthy(f) for f in ("appointment_date", "appointment_time"))
    t_rules, time_v = time_rules("appointment_time", "appointment_time")
    d_rules, date_v = date_rules("appointment_date", "appointment_date")
    r_status, status_v = required_text("status", "status", 20)
    pre_code, pre_reason = first_failure([Rule(~time_given | rule.ok, 400, rule.message) for rule in t_rules])
    status = F.when(cancel, "CANCELLED").otherwise(F.upper(status_v))
    date = date_v.try_cast("date")
    checked, checked_reason = first_failure([
        *[Rule(~given["appointment_date"] | rule.ok, 400, rule.message) for rule in d_rules],
        Rule(~given["status"] | r_status.ok, 400, "status is required"),
        Rule(~given["status"] | status.isin(APPOINTMENT_STATUSES), 500, "Data truncated for column 'status'"),
        Rule(~given["appointment_date"] | date.isNotNull(), 500, MSG_BAD_DATE),
        Rule(~time_given | time_value_ok(time_v), 500, "Incorrect time value")])
    number = {f: F.when(given[f], js_number(F.col(f)).try_cast("long")) for f in ("patient_id", "dentist_id")}
    r = req.select(
        "seq", _key("appointment_id").alias("appointment_id"), F.coalesce(cancel, F.lit(False)).alias("_cancel"),
        number["patient_id"].alias("patient_id"), number["dentist_id"].alias("dentist_id"),
        F.when(date_given, date).alias("appointment_date"), F.when(time_given, time_v).alias("appointment_time"),
        F.when(cancel | given["status"], status).alias("status"),
        optional_text("problem_description", 500).alias("problem_description"),
        *[(given[f] | cancel if f == "status" else given[f]).alias(has(f)) for f in APPT_FIELDS],
        F.when(date_given, F.col("appointment_date")).try_cast("date").alias("_hours_on"),
        date_given.alias("sets_date"), time_given.alias("sets_time"),
        pre_code.alias("pre_code"), pre_reason.alias("pre_reason"), checked.alias("_code"), checked_reason.alias("_reason"))
    r = _exists(stage(r), "patient_id", t.patients, "patient_id", "_pat_ok")
    r = _exists(r, "dentist_id", t.dentists, "dentist_id", "_den_ok")
    unknown = (F.col(has("patient_id")) & ~F.col("_pat_ok")) | (F.col(has("dentist_id")) & ~F.col("_den_ok"))
    return (_with_hours(r, hours, F.col("_hours_on"), "")
            .withColumn("post_code", F.coalesce("_code", F.when(unknown, 500)))
            .withColumn("post_reason", F.coalesce("_reason", F.when(unknown, MSG_FK)))
            .withColumn("any", reduce(lambda a, b: a | b, [F.col(has(f)) for f in APPT_FIELDS]))
            .withColumn("moves", reduce(lambda a, b: a | b, [F.col(has(f)) for f in SLOT]))
            .drop("_pat_ok", "_den_ok", "_code", "_reason", "_hours_on"))


def _events(r: DataFrame, rows: DataFrame, todo: DataFrame, met: DataFrame) -> DataFrame:
    """The rows, held slots and changes of every group in the shape of ``replay``."""
    none = {"component": "long", "kind": "int", "seq": "long", "appointment_id": "long", "dentist_id": "long",
            "appointment_date": "string", "appointment_time": "string", "status": "string", "open": "string",
            "close": "string", "closed": "boolean", "n": "long", "pre_reason": "string", "post_reason": "string"}
    zero = {"pre_code": "int", "post_code": "int", "sets_dentist": "boolean", "sets_date": "boolean",
            "sets_time": "boolean", "sets_status": "boolean", "moves": "boolean", "any": "boolean", "closed": "boolean"}

    def shaped(df: DataFrame, kind: int, **more: Column) -> DataFrame:
        cols = {c: F.col(c) for c in df.columns} | {"kind": F.lit(kind)} | more
        out = []
        for c in EVENT_COLS:
            v = cols.get(c, F.lit(None)).cast(none.get(c) or zero[c])
            if c in zero:
                v = F.coalesce(v, F.lit(0).cast(zero[c]))
            elif none[c] == "long":
                v = F.coalesce(v, F.lit(-1))     # pandas has no NULL for integers
            out.append(v.alias(c))
        return df.select(*out)

    changes = r.join(todo, "appointment_id")
    return (shaped(rows.join(todo, "appointment_id"), ROW, open=F.col("cur_open"), close=F.col("cur_close"),
                   closed=F.col("cur_closed"))
            .unionByName(shaped(met, HELD))
            .unionByName(shaped(changes, CHANGE, sets_dentist=F.col(has("dentist_id")), sets_status=F.col(has("status")))))


def _settled(t, r: DataFrame, rows: DataFrame, strict: bool) -> DataFrame:
    """Decide changes that meet no other one, against the stored rows."""
    cur = rows.select("appointment_id", F.lit(True).alias("_found"), F.col("status").alias("_cur_status"),
                      F.col("cur_open"), F.col("cur_close"), F.col("cur_closed"),
                      *[F.col(c).alias(f"_cur_{c}") for c in SLOT])
    r = r.join(cur, "appointment_id", "left")
    for c in ("open", "close", "closed"):
        r = r.withColumn(c, F.when(F.col("sets_date"), F.col(c)).otherwise(F.col(f"cur_{c}")))
    for c in SLOT:
        r = r.withColumn(f"_new_{c}", F.when(F.col(has(c)) & F.col(c).isNotNull(), F.col(c)).otherwise(F.col(f"_cur_{c}")))
    live = F.lit(True) if strict else F.col("status") != "CANCELLED"
    was = F.lit(True) if strict else F.col("_cur_status") != "CANCELLED"
    stays = F.lit(True) if strict else F.coalesce("status", "_cur_status") != "CANCELLED"
    new_slot = [f"_new_{c}" for c in SLOT]
    asks = F.col("any") & stays & (F.col("moves") | ~was)
    asked = r.filter(asks).select(*[F.col(f"_new_{c}").alias(c) for c in SLOT]).distinct()
    used = (t.appointments.filter(live).join(asked, SLOT, "left_semi").groupBy(*SLOT).agg(F.count(F.lit(1)).alias("_held"))
            .select(*[F.col(c).alias(f"_new_{c}") for c in SLOT], "_held"))
    r = r.join(used, new_slot, "left")
    own = was & reduce(lambda a, b: a & b, [F.col(f"_new_{c}") == F.col(f"_cur_{c}") for c in SLOT])
    at = F.col("_new_appointment_time")
    timed = F.col("sets_date") | F.col("sets_time")
    code, reason = first_failure([
        Rule(F.col("_found") | F.col("_cancel"), 404, "Appointment not found"),
        Rule(F.col("pre_code").isNull(), 400, F.col("pre_reason")),
        Rule(~timed | ~F.col("closed"), 400, MSG_CLOSED),
        Rule(~timed | ((at >= F.col("open")) & (at < F.col("close"))), 400,
             F.concat(F.lit("Appointment time must be between "), hhmm(F.col("open")), F.lit(" and "), hhmm(F.col("close")))),
        Rule(F.col("post_code").isNull(), 0, F.col("post_reason")),
        Rule(~asks | (F.coalesce("_held", F.lit(0)) - own.cast("int") <= 0) | F.col("_found").isNull(), 409, MSG_DUPLICATE)])
    return r.select("seq", F.when(code == 0, F.col("post_code")).otherwise(code).alias("status_code"), reason.alias("reason"),
                    F.col("_cur_appointment_time").alias("cur_time"))


def change_appointments(t, req: DataFrame, as_of, strict: bool = True, clinic_id: int = 1) -> JobResult:
    """Patches and cancellations of a batch, as if sent one by one by seq.

    ``req``: seq, ``op`` ('patch' or 'cancel'; all patches without the
    column) and the fields of a patch. The checks and their order are those of
    ``records.patch_appointments``, against the rows and slots as the accepted
    changes before left them; values that a change doesn't set aren't checked
    again. A cancellation of an unknown appointment is a silent no-op. With
    ``strict`` a cancelled appointment keeps its slot; otherwise its slot is
    free, and a status that revives it needs the slot again (409).
    An appointment or slot that many changes meet is replayed as a whole, in
    one task that streams its changes.
    """
    ts = _ts(as_of)
    if "op" not in req.columns:
        req = req.withColumn("op", F.lit("patch"))
    hours = day_hours(t, clinic_id)
    r = stage(_parsed(t, _ensure_has(req, APPT_FIELDS), hours))
    appts = t.appointments.select("appointment_id", *SLOT, "status")
    rows = stage(_with_hours(appts.join(r.select("appointment_id").distinct(), "appointment_id", "left_semi"),
                             hours, F.col("appointment_date"), "cur_"))
    # What can change who holds a slot: a move, and without ``strict`` a status.
    shifts = F.col("moves") if strict else F.col("moves") | F.col(has("status"))
    valid = F.col("any") & F.col("pre_code").isNull() & F.col("post_code").isNull()
    movers = stage(rows.join(r.filter(valid & shifts).select("appointment_id").distinct(), "appointment_id", "left_semi"))
    fixed = t.appointments.filter(F.lit(True) if strict else F.col("status") != "CANCELLED") \
        .join(movers, "appointment_id", "left_anti").select(*SLOT)
    changes = (r.join(movers, "appointment_id", "left_semi")
               .select("seq", "appointment_id", *SLOT, (F.col("moves") & valid).alias("moves")))
    todo, met = groups(movers.select("appointment_id", *SLOT), changes, fixed)
    replayed = replay(_events(r, movers, todo, met), strict)
    alone = _settled(t, r.join(todo, "appointment_id", "left_anti"), rows, strict)
    decided = stage(r.select("seq", "appointment_id", *APPT_FIELDS, *[has(f) for f in APPT_FIELDS], "any")
                    .join(alone.unionByName(replayed), "seq"))
    # A time that is given as blank writes the time the appointment has.
    ok = (decided.filter(F.col("status_code").isNull() & F.col("any"))
          .join(t.appointments.select("appointment_id", F.col("created_by_user_id").alias("_creator")), "appointment_id")
          .withColumn("appointment_time", F.coalesce("appointment_time", "cur_time")))
    after = apply_patch(t.appointments, merge_patches(ok, "appointment_id", APPT_FIELDS), "appointment_id", APPT_FIELDS,
                        stamp=("updated_at", ts))
    st = ok.filter(F.col(has("status"))).select("appointment_id", "seq", "status", "_creator", F.lit(True).alias("_s"))
    pv = previous_values(st, "appointment_id", "status", "_s", t.appointments, "status")
    audit = _audit_rows(pv.filter(F.col("prev_value") != F.col("next_value")), "APPOINTMENT_STATUS_CHANGED", "appointments",
                        "appointment_id", F.col("prev_value"), F.col("next_value"), F.col("_creator"), ts, F.col("seq"))
    return JobResult(_outcome(decided, 200, "appointment_id", None), ok, t.replace(appointments=after), audit)
