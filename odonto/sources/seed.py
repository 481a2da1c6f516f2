"""A small own snapshot for examples and hand-worked tests.

Rows are built from short rules (numbered people, staggered dates). Only what
the hand-worked goldens need is given as values; those are marked fixed.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import SparkSession

from odonto.schemas import SCHEMAS, WEEKDAYS
from odonto.sources.tables import conform

# Fixed values that the goldens check: bill totals with what is paid of them,
# treatment costs, and the roles and permission flags of the users.
BILLS = [(4500, 500, "PAID", 4000), (3000, 0, "PARTIAL", 1500), (3500, 0, "UNPAID", 0)]
COSTS = [4500, 3000, 3500, 2500]
ROLES = ["OWNER", "STAFF", "STAFF", "CUSTOMER"]
BILLING_OF_STAFF = {2: False, 3: True}
# Short days of the week: (opening, closing); a closed day keeps its hours.
HOURS = {"FRIDAY": ("09:00:00", "13:00:00"), "SATURDAY": ("10:00:00", "16:00:00")}

_PEOPLE = ["Alpha", "Bravo", "Charlie", "Delta", "Echo"]
_STOCK = [40, 3, 30, 9, 50]              # against a limit of 10: the second and fourth are low


def _money(x) -> Decimal:
    return Decimal(x).quantize(Decimal("0.01"))


def seed_frames(spark: SparkSession, as_of) -> dict:
    if isinstance(as_of, str):
        as_of = dt.date.fromisoformat(as_of)
    at = dt.datetime.combine(as_of, dt.time(8, 0))
    after = lambda n: as_of + dt.timedelta(days=n)
    phone = lambda kind, i: f"0{kind}-{i:07d}"

    users = [(i, f"{role.title()} {i}", phone(900, i), f"user{i}@clinic.test", role, True, at)
             for i, role in enumerate(ROLES, start=1)]
    permissions = [(k, user, billing, True, at) for k, (user, billing) in enumerate(BILLING_OF_STAFF.items(), start=1)]
    week = [(i, 1, day, *HOURS.get(day, ("09:00:00", "18:00:00")), day == "SUNDAY") for i, day in enumerate(WEEKDAYS, start=1)]
    patients = [(i, f"PAT-{i:05d}", f"Patient {name}", phone(910, i), f"{name.lower()}@mail.test",
                 ("OTHER", "FEMALE", "MALE")[i % 3], dt.date(1960 + 7 * i, 2 * i, 3 * i), f"Street {i}", False, at, at)
                for i, name in enumerate(_PEOPLE, start=1)]
    histories = [(i, i, f"Allergy {i}", f"Medication {i}", f"Note {i}", at) for i in range(1, len(_PEOPLE) + 1)]
    dentists = [(i, f"DEN-{i:04d}", f"Dentist {i}", phone(920, i), f"dentist{i}@clinic.test", f"Field {i}", True, at)
                for i in range(1, 4)]
    # Appointments 1 and 2 are today's and done; 3 is tomorrow at noon with dentist 1.
    slots = [(0, 9, 1), (0, 9, 2), (1, 12, 1), (3, 15, 3)]
    appointments = [(i, f"APT-{i:05d}", i, dentist, after(day), f"{hour:02d}:00:00", "COMPLETED" if day == 0 else "BOOKED",
                     f"Problem {i}", 2 + (i > 2), at, at) for i, (day, hour, dentist) in enumerate(slots, start=1)]
    treatments = [(i, i, slots[i - 1][2], i, f"Procedure {i}", f"Remark {i}", _money(cost), after(slots[i - 1][0]),
                   "DONE" if slots[i - 1][0] == 0 else "PLANNED", at) for i, cost in enumerate(COSTS, start=1)]
    bills = [(i, f"BIL-{i:05d}", i, i, as_of, _money(s), _money(d), _money(s - d), status, 3, at)
             for i, (s, d, status, _) in enumerate(BILLS, start=1)]
    payments = [(i, i, _money(paid), as_of, "CASH", 3, f"Payment {i}", at) for i, (*_, paid) in enumerate(BILLS, start=1) if paid]
    medicines = [(i, f"Medicine {chr(64 + i)}", f"LOT-{i}", n, 10, dt.date(2027 + i, i, 1), at, at)
                 for i, n in enumerate(_STOCK, start=1)]
    rows = {
        "users": users, "staff_permissions": permissions,
        "clinic": [(1, "Own Clinic", "Street 0", phone(900, 0), "clinic@clinic.test", "920000000000", at)],
        "clinic_timings": week, "patients": patients, "patient_medical_history": histories, "dentists": dentists,
        "appointments": appointments, "treatments": treatments, "bills": bills, "payments": payments,
        "medicines": medicines, "audit_logs": [],
    }
    return {n: conform(spark.createDataFrame(r, SCHEMAS[n]), n) for n, r in rows.items()}
