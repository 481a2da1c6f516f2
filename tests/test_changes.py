"""Dependent appointment changes against a one-by-one replay in plain Python."""
import datetime as dt
import random

import pytest

from clinic_constants import AS_OF
from odonto.operators import replay as R
from odonto.operators.components import components
from odonto.plans import changes, records
from odonto.schemas import APPOINTMENT_STATUSES
from test_records import APPT, appt_req

FIELDS = ["patient_id", "dentist_id", "appointment_date", "appointment_time", "status", "problem_description"]
DAYS = [AS_OF + dt.timedelta(days=i) for i in range(3)]
TIMES = ["10:00", "11:00", "12:30", "03:00"]


def requests(spark, rows):
    """rows: (seq, op, appointment id, fields)."""
    r = appt_req(spark, [(seq, aid, f) for seq, _, aid, f in rows])
    ops = spark.createDataFrame([(seq, op) for seq, op, _, _ in rows], "seq long, op string")
    return r.join(ops, "seq")


def clinic(spark, seed, stored):
    """``stored``: (id, dentist, date, time, status); the other columns are the seed's."""
    first = seed.appointments.first().asDict()
    rows = [first | {"appointment_id": i, "appointment_code": f"A{i}", "dentist_id": d, "appointment_date": day,
                     "appointment_time": at, "status": s, "updated_at": None} for i, d, day, at, s in stored]
    cols = seed.appointments.columns
    return seed.replace(appointments=spark.createDataFrame([tuple(r[c] for c in cols) for r in rows], seed.appointments.schema))


def hours_of(t):
    return {r.day_of_week: r for r in t.clinic_timings.filter("clinic_id = 1").orderBy("timing_id", ascending=False).collect()}


def one_by_one(t, rows, strict):
    hours, dentists = hours_of(t), {r.dentist_id for r in t.dentists.collect()}
    now = {r.appointment_id: [r.dentist_id, r.appointment_date, r.appointment_time, r.status] for r in t.appointments.collect()}
    out = {}
    for seq, op, aid, f in sorted(rows, key=lambda x: x[0]):
        f = {"status": "cancelled"} if op == "cancel" else f
        cur = now.get(int(aid))
        if cur is None:
            out[seq] = 200 if op == "cancel" else 404
            continue
        new = list(cur)
        date, at = f.get("appointment_date"), f.get("appointment_time")
        if at and len(at) not in (5, 8):
            out[seq] = 400
            continue
        if at:
            new[2] = at if len(at) == 8 else at + ":00"
        if date:
            try:
                new[1] = dt.date.fromisoformat(date)
            except ValueError:
                out[seq] = 400
                continue
        if date or at:
            h = hours.get(new[1].strftime("%A").upper())
            if h is None or h.is_closed or not h.opening_time <= new[2] < h.closing_time:
                out[seq] = 400
                continue
        if "appointment_date" in f and not date:
            out[seq] = 400
            continue
        if "status" in f:
            new[3] = f["status"].upper()
            if new[3] not in APPOINTMENT_STATUSES:
                out[seq] = 500
                continue
        if "dentist_id" in f:
            new[0] = int(f["dentist_id"])
            if new[0] not in dentists:
                out[seq] = 500
                continue
        moved = any(k in f for k in FIELDS[1:4])
        holds = strict or new[3] != "CANCELLED"
        asks = moved or not (strict or cur[3] != "CANCELLED")
        if holds and asks and any(o[:3] == new[:3] and (strict or o[3] != "CANCELLED") for k, o in now.items() if k != int(aid)):
            out[seq] = 409
            continue
        out[seq] = 200
        now[int(aid)] = new
    return out, {k: tuple(v) for k, v in now.items()}


def random_batch(rng, n, ids):
    rows = []
    for seq in rng.sample(range(10 * n), n):
        f = {}
        if rng.random() < 0.5:
            f["appointment_time"] = rng.choice([*TIMES, "", "9:00"])
        if rng.random() < 0.4:
            f["appointment_date"] = rng.choice([*(d.isoformat() for d in DAYS), "", "soon"])
        if rng.random() < 0.2:
            f["dentist_id"] = rng.choice(["1", "2", "99"])
        if rng.random() < 0.3:
            f["status"] = rng.choice(["booked", "cancelled", "completed", "lost"])
        rows.append((seq, "cancel" if rng.random() < 0.15 else "patch", str(rng.randrange(1, ids + 2)), f))
    return rows


def check(spark, t, rows, strict):
    res = changes.change_appointments(t, requests(spark, rows), AS_OF, strict=strict)
    want, now = one_by_one(t, rows, strict)
    assert {r.seq: r.status_code for r in res.outcome.collect()} == want
    found = {r.appointment_id: (r.dentist_id, r.appointment_date, r.appointment_time, r.status)
             for r in res.snapshot.appointments.collect()}
    assert found == now


@pytest.mark.parametrize("strict, told", [(True, 64), (False, 64), (False, 3), (True, 0)])
def test_equals_one_by_one(spark, seed, monkeypatch, strict, told):
    monkeypatch.setattr(R, "TOLD", told)
    rng = random.Random(told + strict)
    slots = [(d, day, at + ":00") for d in (1, 2) for day in DAYS for at in TIMES[:3]]
    stored = [(i + 1, *slot, rng.choice(["BOOKED", "BOOKED", "CANCELLED"])) for i, slot in enumerate(rng.sample(slots, 14))]
    check(spark, clinic(spark, seed, stored), random_batch(rng, 80, 14), strict)


def test_freed_slot_and_second_patch(spark, seed):
    day, later = DAYS[0], DAYS[1]
    t = clinic(spark, seed, [(1, 1, day, "10:00:00", "BOOKED"), (2, 1, day, "11:00:00", "BOOKED"),
                             (3, 2, day, "10:00:00", "BOOKED")])
    rows = [(1, "cancel", "1", {}),
            (2, "patch", "2", {"appointment_time": "10:00"}),         # free only where a cancelled row gives its slot up
            (3, "patch", "3", {"appointment_date": later.isoformat()}),
            (4, "patch", "3", {"appointment_time": "12:30"}),         # at the date of the patch before
            (5, "patch", "1", {"status": "booked"})]                  # its slot is gone, or still its own
    for strict, codes in ((False, [200, 200, 200, 200, 409]), (True, [200, 409, 200, 200, 200])):
        res = changes.change_appointments(t, requests(spark, rows), AS_OF, strict=strict)
        assert [r.status_code for r in res.outcome.orderBy("seq").collect()] == codes
        third = res.snapshot.appointments.filter("appointment_id = 3").first()
        assert (third.appointment_date, third.appointment_time) == (later, "12:30:00")
        audit = sorted((r.record_id, r.old_value, r.new_value) for r in res.audit.collect())
        assert audit[0] == (1, "BOOKED", "CANCELLED") and (len(audit) == 2) == strict


def test_swap_through_a_third_slot(spark, seed):
    t = clinic(spark, seed, [(1, 1, DAYS[0], "10:00:00", "BOOKED"), (2, 1, DAYS[0], "11:00:00", "BOOKED")])
    rows = [(1, "patch", "1", {"appointment_time": "12:30"}), (2, "patch", "2", {"appointment_time": "10:00"}),
            (3, "patch", "1", {"appointment_time": "11:00"})]
    assert set(one_by_one(t, rows, True)[0].values()) == {200}
    check(spark, t, rows, True)


def test_independent_changes_are_not_replayed(spark, seed, monkeypatch):
    t = clinic(spark, seed, [(i, 1, DAYS[0], f"{9 + i}:00:00", "BOOKED") for i in (1, 2, 3)])
    rows = [(1, "patch", "1", {"appointment_time": "14:00"}), (2, "patch", "2", {"appointment_time": "15:00"}),
            (3, "patch", "3", {"status": "completed"}), (4, "patch", "3", {"status": "booked"})]
    seen = []
    whole = changes.replay
    monkeypatch.setattr(changes, "replay", lambda events, strict: seen.append(events.count()) or whole(events, strict))
    check(spark, t, rows, True)
    assert seen == [0]
    plain = records.patch_appointments(t, requests(spark, rows).drop("op"), AS_OF)
    assert {r.status_code for r in plain.outcome.collect()} == {200}


def test_empty_batch(spark, seed):
    res = changes.change_appointments(seed, spark.createDataFrame([], APPT), AS_OF)
    assert res.outcome.count() == 0 and res.audit.count() == 0
    assert res.snapshot.appointments.count() == seed.appointments.count()


def test_components_equal_a_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in found} == {x: find(x) for x in root}
    assert len(found) == len(root)
