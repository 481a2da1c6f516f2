"""Sources and sinks: views (S3), JSON sink (S5), append (S6), access gate on lists."""
import json
import os

import pytest

from clinic_constants import AS_OF
from odonto.plans import lists, procedures
from odonto.sources import io
from odonto.sources.tables import Clinic


def test_views_and_parametrised_sql(spark, seed):
    seed.register_views("seed_")
    assert spark.sql("SELECT count(*) FROM seed_billing_summary_view WHERE remaining_balance > 0").first()[0] == 2
    rep = procedures.daily_appointment_report(seed, AS_OF, prefix="seed_").collect()
    assert [r.appointment_code for r in rep] == ["APT-00001", "APT-00002"]
    # Parameters are bound, not spliced: a quote in the text is just a character.
    assert procedures.search_patient(seed, "x' OR '1'='1", prefix="seed_").count() == 0
    assert procedures.search_patient(seed, "bravo", prefix="seed_").first().patient_id == 2


def test_json_sink(spark, seed, tmp_path):
    out = str(tmp_path / "bills")
    io.write_json(seed.bills, out)
    rows = [json.loads(line) for f in sorted(os.listdir(out)) if f.endswith(".json")
            for line in open(os.path.join(out, f))]
    b1 = [r for r in rows if r["bill_id"] == 1][0]
    assert b1["total_amount"] == 4000.0 and b1["bill_date"] == AS_OF.isoformat()


def test_append_and_snapshot_roundtrip(spark, seed, tmp_path):
    path = str(tmp_path / "snap")
    seed.write(path)
    io.append(seed.medicines.limit(1), f"{path}/medicines", "medicines")
    back = Clinic.load(spark, path)
    assert back.medicines.count() == 6 and back.patients.count() == 5
    # File sources report every column nullable; names and types round-trip.
    assert [(f.name, f.dataType) for f in back.bills.schema] == [(f.name, f.dataType) for f in seed.bills.schema]


def test_bills_gate(spark, seed):
    assert lists.bills(seed, caller=(3, "staff")).count() == 3      # staff 3 may bill
    for refused in ((2, "STAFF"), (4, "CUSTOMER")):                  # staff 2 may not, customers never
        with pytest.raises(PermissionError):
            lists.bills(seed, caller=refused)
    assert [r.bill_id for r in lists.bills(seed, "paid", caller=(1, None)).collect()] == [1]


def test_view_over_view(spark, seed):
    seed.register_views("vv_", as_of=AS_OF)
    got = [r.appointment_code for r in spark.sql(
        "SELECT appointment_code FROM vv_daily_appointments_view ORDER BY appointment_time").collect()]
    assert got == ["APT-00001", "APT-00002"]
