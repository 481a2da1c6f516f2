"""Typed request bodies against the JavaScript coercions, and the quarantine."""
import json
import math

import pytest
from pyspark.sql import functions as F

from clinic_constants import AS_OF
from odonto.functions.exprs import js_number
from odonto.plans import records
from odonto.sources.bodies import (BODIES, FLAG, NUMBER, NUMBER_OR, TEXT, quarantined, read_bodies, start_quarantine)

ABSENT = object()
VALUES = [ABSENT, None, True, False, 0, 0.0, 1, -3, 2.5, 1e3, 12345678901234567890, "", "0", "00", " 7 ", "true", "false",
          "null", "x", "é", [], [5], ["a", None], {}, {"a": 1}]


def js_false(v):
    return v is ABSENT or v is None or v is False or v == "" or (type(v) in (int, float) and v == 0)


def js_text(v):
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, list):
        return ",".join("" if x is None else js_text(x) for x in v)
    if isinstance(v, float) and v == int(v):
        return str(int(v))
    return "[object Object]" if isinstance(v, dict) else str(v)


def js_num(v):
    if v is ABSENT or isinstance(v, dict):
        return math.nan
    if v is None or isinstance(v, bool | int | float):
        return float(v or 0)
    s = js_text(v).strip()
    try:
        return float(s) if s else 0.0
    except ValueError:
        return math.nan


def write(path, lines):
    path.mkdir(exist_ok=True)
    (path / f"part-{len(list(path.iterdir()))}.json").write_text("\n".join(lines), encoding="utf-8")


def test_values_read_as_javascript_reads_them(spark, tmp_path):
    write(tmp_path / "in", [json.dumps({"seq": i, **({} if v is ABSENT else dict.fromkeys("tndf", v))}, ensure_ascii=False)
                            for i, v in enumerate(VALUES)])
    df = read_bodies(spark, str(tmp_path / "in"), {"t": TEXT, "n": NUMBER, "d": NUMBER_OR, "f": FLAG})
    rows = df.select("seq", "t", "f", "d", js_number("n").alias("n"), js_number("d").alias("dn"), "has_t").collect()
    assert len(rows) == len(VALUES)
    for r in rows:
        v = VALUES[r.seq]
        assert r.has_t == (v is not ABSENT), v
        assert (r.t or "") == ("" if js_false(v) else js_text(v)), v
        assert r.f == (None if v is ABSENT else "false" if js_false(v) else "true"), v
        assert r.n == js_num(v) or (math.isnan(r.n) and math.isnan(js_num(v))), v
        if js_false(v):
            assert not r.d, v
        else:
            assert r.dn == js_num(v) or (math.isnan(r.dn) and math.isnan(js_num(v))), v


def test_zero_and_text_zero_true_and_text_true(spark, seed, tmp_path):
    base = {"medicine_name": "M", "batch_no": "B", "expiry_date": "2030-01-01"}
    limits = [0, "0", True, None, "7", "x", 4]
    write(tmp_path / "med", [json.dumps({"seq": i, **base, "low_stock_limit": v}) for i, v in enumerate(limits)])
    job = records.add_medicines(seed, read_bodies(spark, str(tmp_path / "med"), BODIES["add_medicines"]), AS_OF)
    got = {r.seq: (r.status_code, r.record_id) for r in job.outcome.collect()}
    stored = {r.medicine_id: r.low_stock_limit for r in job.accepted.collect()}
    assert [stored.get(got[i][1]) if got[i][0] == 201 else got[i][0] for i in range(7)] == [10, 0, 1, 10, 7, 500, 4]
    flags = [True, "true", "false", "0", 0, False, "", None]
    write(tmp_path / "perm", [json.dumps({"seq": i, "caller_role": "OWNER", "staff_user_id": 2, "can_manage_billing": v})
                              for i, v in enumerate(flags)])
    job = records.upsert_permissions(seed, read_bodies(spark, str(tmp_path / "perm"), BODIES["upsert_permissions"]), AS_OF)
    assert [r.can_manage_billing for r in job.accepted.orderBy("seq").collect()] == [True] * 4 + [False] * 4


def test_malformed_lines_are_set_apart(spark, tmp_path):
    bad = {"{\"seq\": 1,": "no JSON", "[1]": "no object", "7": "no object", "null": "no object", "{\"n\": 1}": "no seq",
           "{\"seq\": 1.5}": "no seq", "{\"seq\": \"x\"}": "no seq", "{\"seq\": 1, \"n\": 2, \"n\": 3}": "no JSON"}
    src = tmp_path / "in"
    write(src, [*bad, "", "{\"seq\": 9, \"n\": null, \"more\": {\"n\": 1}}"])
    kept = read_bodies(spark, str(src), {"n": NUMBER}).collect()
    assert [(r.seq, r.n, r.has_n, r.caller_id) for r in kept] == [(9, "", True, None)]
    assert {r.line: r.problem for r in quarantined(spark, str(src)).collect()} == bad
    for _ in range(2):                            # a restart takes new files only
        q = start_quarantine(spark, str(src), str(tmp_path / "out"), str(tmp_path / "ckpt"))
        q.awaitTermination()
        assert q.exception() is None
        write(src, ["oops"])
    out = spark.read.parquet(str(tmp_path / "out"))
    assert {r.line for r in out.collect()} == {*bad, "oops"} and out.filter(F.col("file").isNull()).count() == 0
    assert out.count() == len(bad) + 1


@pytest.mark.parametrize("text", ["", "\n\n"])
def test_no_requests(spark, tmp_path, text):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(text)
    assert read_bodies(spark, str(tmp_path / "in"), BODIES["add_payments"]).count() == 0
    assert quarantined(spark, str(tmp_path / "in")).count() == 0
