"""Oracle SQL for audits, jobs, feeds and streams."""

from __future__ import annotations

from odonto.oracle.sql import BODIES
from odonto.schemas import DOMAINS, FOREIGN_KEYS, PRIMARY_KEYS, SCHEMAS, UNIQUE_KEYS


def _row(table, rule, key, detail):
    return (f"SELECT '{table}' AS table_name, '{rule}' AS rule, CAST({key} AS VARCHAR) AS record_key, "
            f"CAST({detail} AS VARCHAR) AS detail")


BODIES["dq_not_null"] = "\nUNION ALL\n".join(
    f"{_row(tb, 'NOT_NULL', PRIMARY_KEYS[tb], repr(f.name))} FROM {tb} WHERE {f.name} IS NULL"
    for tb, s in SCHEMAS.items() for f in s.fields if not f.nullable)


def _unique(keys):
    return "\nUNION ALL\n".join(
        f"{_row(tb, 'UNIQUE(' + ','.join(cols) + ')', 'k', 'n')} FROM "
        f"(SELECT concat_ws('|', {', '.join(f'CAST({c} AS VARCHAR)' for c in cols)}) AS k, count(*) AS n "
        f"FROM {tb} GROUP BY {', '.join(cols)} HAVING count(*) > 1)"
        for tb, cols in keys)


BODIES["dq_unique"] = _unique(UNIQUE_KEYS)
BODIES["dq_unique_slot"] = _unique([("appointments", ("dentist_id", "appointment_date", "appointment_time"))])

BODIES["dq_checks"] = "\nUNION ALL\n".join([
    f"{_row('clinic_timings', 'CHECK(opening_time < closing_time)', 'timing_id', 'NULL')} FROM clinic_timings WHERE NOT (opening_time < closing_time)",
    f"{_row('patients', 'CHECK(LENGTH(phone) >= 7)', 'patient_id', 'NULL')} FROM patients WHERE NOT (octet_length(encode(phone)) >= 7)",
    f"{_row('treatments', 'CHECK(cost >= 0)', 'treatment_id', 'NULL')} FROM treatments WHERE NOT (cost >= 0)",
    f"{_row('bills', 'CHECK(amounts >= 0)', 'bill_id', 'NULL')} FROM bills WHERE NOT (subtotal >= 0 AND discount_amount >= 0 AND total_amount >= 0)",
    f"{_row('payments', 'CHECK(paid_amount > 0)', 'payment_id', 'NULL')} FROM payments WHERE NOT (paid_amount > 0)",
    f"{_row('medicines', 'CHECK(quantity >= 0 AND low_stock_limit >= 0)', 'medicine_id', 'NULL')} FROM medicines WHERE NOT (quantity >= 0 AND low_stock_limit >= 0)",
])

BODIES["dq_domains"] = "\nUNION ALL\n".join(
    f"{_row(tb, f'ENUM({c})', PRIMARY_KEYS[tb], c)} FROM {tb} WHERE {c} IS NOT NULL AND {c} NOT IN "
    f"({', '.join(repr(v) for v in vals)})"
    for (tb, c), vals in DOMAINS.items())

BODIES["dq_orphans"] = "\nUNION ALL\n".join(
    f"{_row(child, f'FK({col})->{parent}', PRIMARY_KEYS[child], col)} FROM {child} c WHERE {col} IS NOT NULL "
    f"AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{pcol} = c.{col})"
    for child, col, parent, pcol, _ in FOREIGN_KEYS)

BODIES["dq_bill_status"] = """
WITH paid AS (SELECT bill_id, sum(paid_amount) AS s, count(*) AS n FROM payments GROUP BY bill_id),
d AS (
  SELECT b.bill_id, b.status,
         CASE WHEN COALESCE(p.n, 0) = 0 THEN 'UNPAID'
              WHEN p.s >= b.total_amount THEN 'PAID' WHEN p.s > 0 THEN 'PARTIAL' ELSE 'UNPAID' END AS derived
  FROM bills b LEFT JOIN paid p ON p.bill_id = b.bill_id)
SELECT 'bills' AS table_name, 'DERIVED_STATUS' AS rule, CAST(bill_id AS VARCHAR) AS record_key,
       status || '->' || derived AS detail
FROM d WHERE derived <> status"""

BODIES["delete_actions"] = """
WITH k AS (SELECT patient_id FROM patients WHERE is_deleted),
r AS (
  SELECT patient_id,
         CASE WHEN patient_id IN (SELECT patient_id FROM appointments) THEN 'referenced by appointments.patient_id'
              WHEN patient_id IN (SELECT patient_id FROM treatments) THEN 'referenced by treatments.patient_id'
              WHEN patient_id IN (SELECT patient_id FROM bills) THEN 'referenced by bills.patient_id' END AS reason
  FROM k)
SELECT 'patients' AS table_name, CAST(patient_id AS VARCHAR) AS record_key,
       CASE WHEN reason IS NULL THEN 'DELETED' ELSE 'REJECTED' END AS action, reason AS detail FROM r
UNION ALL
SELECT 'patient_medical_history', CAST(history_id AS VARCHAR), 'CASCADE_DELETED', 'patient_id'
FROM patient_medical_history WHERE patient_id IN (SELECT patient_id FROM r WHERE reason IS NULL)"""


# --- bulk write jobs ---------------------------------------------------------
def _pos_id(x):
    """positive-id test on text x."""
    n = f"TRY_CAST(trim({x}) AS DOUBLE)"
    return f"({n} IS NOT NULL AND {n} = floor({n}) AND {n} > 0)"


def _split(col):
    return (f"CAST(split_part({col}, '|', 1) AS INTEGER) AS status_code, "
            f"substr({col}, strpos({col}, '|') + 1) AS reason")


_BOOK_REQ = """
req AS (
  SELECT event_id AS seq, user_id % 25 + 1 AS caller_id, 'STAFF' AS caller_role,
         CAST(user_id + 1 AS VARCHAR) AS patient_id,
         CAST(user_id % (SELECT count(*) FROM supplier) + 1 AS VARCHAR) AS dentist_id,
         strftime(CAST(ts AS DATE) + 7, '%Y-%m-%d') AS appointment_date,
         strftime(ts, '%H:00') AS appointment_time, event_type AS problem_description
  FROM events)"""


def _book(strict: bool) -> str:
    dup = ("WHEN EXISTS (SELECT 1 FROM appointments a WHERE a.dentist_id = v.did AND a.appointment_date = v.d "
           "AND a.appointment_time = v.tm) THEN '409|Duplicate entry. This record already exists or the appointment slot is booked.'"
           if strict else "")
    return f"""
WITH {_BOOK_REQ},
v0 AS (
  SELECT seq, coalesce(caller_id, 1) AS created_by,
         CASE WHEN NOT {_pos_id('patient_id')} THEN '400|patient_id must be a valid positive id'
              WHEN NOT {_pos_id('dentist_id')} THEN '400|dentist_id must be a valid positive id'
              WHEN coalesce(trim(appointment_date), '') = '' THEN '400|appointment_date is required'
              WHEN NOT regexp_matches(substr(trim(appointment_date), 1, 10), '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN '400|appointment_date must use YYYY-MM-DD format'
              WHEN coalesce(trim(appointment_time), '') = '' THEN '400|appointment_time is required'
              WHEN NOT regexp_matches(substr(trim(appointment_time), 1, 8), '^[0-9]{{2}}:[0-9]{{2}}(:[0-9]{{2}})?$') THEN '400|appointment_time must use HH:MM format'
         END AS pre,
         CAST(TRY_CAST(trim(patient_id) AS DOUBLE) AS BIGINT) AS pid,
         CAST(TRY_CAST(trim(dentist_id) AS DOUBLE) AS BIGINT) AS did,
         substr(trim(appointment_date), 1, 10) AS dtext,
         TRY_CAST(substr(trim(appointment_date), 1, 10) AS DATE) AS d,
         CASE WHEN length(substr(trim(appointment_time), 1, 8)) = 5 THEN substr(trim(appointment_time), 1, 8) || ':00'
              ELSE substr(trim(appointment_time), 1, 8) END AS tm
  FROM req),
v AS (
  SELECT v0.*, ct.opening_time AS op, ct.closing_time AS cl, ct.is_closed AS closed
  FROM v0 LEFT JOIN (SELECT * FROM clinic_timings WHERE clinic_id = 1) ct ON ct.day_of_week = upper(dayname(v0.d))),
chk AS (
  SELECT seq, created_by, pid, did, d, tm,
    CASE WHEN pre IS NOT NULL THEN pre
         WHEN pid NOT IN (SELECT patient_id FROM patients WHERE NOT is_deleted) THEN '404|Patient not found'
         WHEN did NOT IN (SELECT dentist_id FROM dentists WHERE is_active) THEN '404|Dentist not found or inactive'
         WHEN op IS NULL OR closed THEN '400|Clinic is closed on the selected date'
         WHEN tm < op OR tm >= cl THEN '400|Appointment time must be between ' || substr(op, 1, 5) || ' and ' || substr(cl, 1, 5)
         WHEN EXISTS (SELECT 1 FROM appointments a WHERE a.dentist_id = v.did AND a.appointment_date = v.d
                      AND a.appointment_time = v.tm AND a.status <> 'CANCELLED') THEN '409|This dentist already has an appointment in this slot'
         WHEN CAST(substr(tm, 4, 2) AS INT) >= 60 OR CAST(substr(tm, 7, 2) AS INT) >= 60 THEN '500|Incorrect time value'
         {dup}
    END AS fail
  FROM v),
passed AS (
  SELECT *, min(seq) OVER (PARTITION BY did, d, tm) AS first_seq FROM chk WHERE fail IS NULL),
won AS (
  SELECT seq, (SELECT coalesce(max(appointment_id), 0) FROM appointments) + row_number() OVER (ORDER BY seq) AS id
  FROM passed WHERE seq = first_seq)
SELECT seq, {_split('fail')}, CAST(NULL AS BIGINT) AS record_id, CAST(NULL AS VARCHAR) AS record_code
FROM chk WHERE fail IS NOT NULL
UNION ALL
SELECT seq, 409, 'This dentist already has an appointment in this slot', NULL, NULL FROM passed WHERE seq <> first_seq
UNION ALL
SELECT seq, 201, NULL, id, printf('APT-%05d', id) FROM won"""


BODIES["book_appointments"] = _book(True)
BODIES["book_appointments_lenient"] = _book(False)

_ACCESS = """CASE WHEN role = 'OWNER' THEN NULL
              WHEN role <> 'STAFF' THEN '403|Billing is not available for this role'
              WHEN NOT coalesce(can_bill, FALSE) THEN '403|Staff billing access is disabled' END"""

BODIES["create_bills"] = f"""
WITH req AS (
  SELECT o_orderkey AS seq, o_custkey % 25 + 1 AS caller_id,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 'OWNER' WHEN o_orderpriority = '2-HIGH' THEN 'staff'
              WHEN o_orderpriority = '5-LOW' THEN 'CUSTOMER' ELSE 'STAFF' END AS caller_role,
         CAST(o_custkey + 1 AS VARCHAR) AS patient_id,
         CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey * 100 + 1 AS VARCHAR) WHEN o_orderkey % 3 = 1 THEN ''
              ELSE CAST(o_orderkey * 100 + 9 AS VARCHAR) END AS treatment_id,
         CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) AS subtotal,
         (CAST(CAST(floor(o_totalprice * (o_orderkey % 7) / 5 * 100) AS BIGINT) // 100 AS VARCHAR) || '.' || lpad(CAST(CAST(floor(o_totalprice * (o_orderkey % 7) / 5 * 100) AS BIGINT) % 100 AS VARCHAR), 2, '0')) AS discount_amount
  FROM orders),
v AS (
  SELECT r.*, upper(coalesce(caller_role, 'OWNER')) AS role, coalesce(caller_id, 1) AS cid,
         sp.can_manage_billing AS can_bill,
         coalesce(treatment_id, '') <> '' AS has_tid,
         TRY_CAST(trim(subtotal) AS DOUBLE) AS sub_n,
         TRY_CAST(trim(CASE WHEN coalesce(discount_amount, '') = '' THEN '0' ELSE discount_amount END) AS DOUBLE) AS dis_n,
         TRY_CAST(round(TRY_CAST(trim(subtotal) AS DECIMAL(38,10)), 2) AS DECIMAL(10,2)) AS sub_m,
         TRY_CAST(round(TRY_CAST(trim(CASE WHEN coalesce(discount_amount, '') = '' THEN '0' ELSE discount_amount END) AS DECIMAL(38,10)), 2) AS DECIMAL(10,2)) AS dis_m,
         CAST(TRY_CAST(trim(patient_id) AS DOUBLE) AS BIGINT) AS pid,
         CAST(TRY_CAST(trim(treatment_id) AS DOUBLE) AS BIGINT) AS tid
  FROM req r LEFT JOIN staff_permissions sp ON sp.staff_user_id = coalesce(r.caller_id, 1)),
chk AS (
  SELECT seq, cid, pid, tid, has_tid, sub_m, dis_m,
    CASE WHEN {_ACCESS} IS NOT NULL THEN {_ACCESS}
         WHEN NOT {_pos_id('patient_id')} THEN '400|patient_id must be a valid positive id'
         WHEN has_tid AND NOT {_pos_id('treatment_id')} THEN '400|treatment_id must be a valid positive id'
         WHEN sub_n IS NULL OR isnan(sub_n) OR isinf(sub_n) OR sub_n < 0 THEN '400|subtotal must be a valid non-negative number'
         WHEN dis_n IS NULL OR isnan(dis_n) OR isinf(dis_n) OR dis_n < 0 THEN '400|discount_amount must be a valid non-negative number'
         WHEN dis_n > sub_n THEN '400|Discount amount cannot be greater than subtotal'
         WHEN pid NOT IN (SELECT patient_id FROM patients WHERE NOT is_deleted) THEN '404|Patient not found'
         WHEN has_tid AND tid NOT IN (SELECT treatment_id FROM treatments) THEN '404|Treatment not found'
         WHEN sub_m IS NULL OR dis_m IS NULL THEN '500|Out of range value for a DECIMAL(10,2) amount'
    END AS fail
  FROM v),
ok AS (
  SELECT seq, (SELECT coalesce(max(bill_id), 0) FROM bills) + row_number() OVER (ORDER BY seq) AS id
  FROM chk WHERE fail IS NULL)"""
BILLS_PREFIX = BODIES["create_bills"]
BODIES["create_bills"] = BILLS_PREFIX + f"""
SELECT seq, {_split('fail')}, CAST(NULL AS BIGINT) AS record_id, CAST(NULL AS VARCHAR) AS record_code
FROM chk WHERE fail IS NOT NULL
UNION ALL
SELECT seq, 201, NULL, id, printf('BIL-%05d', id) FROM ok"""

BODIES["add_payments"] = f"""
WITH RECURSIVE req AS (
  SELECT l_orderkey * 100 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS seq,
         l_suppkey % 25 + 1 AS caller_id,
         CASE WHEN l_linestatus = 'O' THEN 'OWNER' ELSE 'STAFF' END AS caller_role,
         CAST(l_orderkey + 1 AS VARCHAR) AS bill_id,
         (CAST(CAST(floor(l_extendedprice * l_discount * 100) AS BIGINT) // 100 AS VARCHAR) || '.' || lpad(CAST(CAST(floor(l_extendedprice * l_discount * 100) AS BIGINT) % 100 AS VARCHAR), 2, '0')) AS paid_amount,
         CASE WHEN l_returnflag = 'A' THEN 'cash' WHEN l_returnflag = 'R' THEN 'Card' ELSE 'cheque' END AS payment_method
  FROM lineitem),
v AS (
  SELECT r.*, upper(coalesce(caller_role, 'OWNER')) AS role, sp.can_manage_billing AS can_bill,
         TRY_CAST(trim(paid_amount) AS DOUBLE) AS amt_n,
         TRY_CAST(trim(paid_amount) AS DECIMAL(38,10)) AS amount_raw,
         TRY_CAST(round(TRY_CAST(trim(paid_amount) AS DECIMAL(38,10)), 2) AS DECIMAL(10,2)) AS amount,
         upper(trim(CASE WHEN coalesce(payment_method, '') = '' THEN 'CASH' ELSE payment_method END)) AS method,
         CAST(TRY_CAST(trim(bill_id) AS DOUBLE) AS BIGINT) AS bid
  FROM req r LEFT JOIN staff_permissions sp ON sp.staff_user_id = coalesce(r.caller_id, 1)),
chk AS (
  SELECT seq, bid, amount_raw, amount,
    CASE WHEN {_ACCESS} IS NOT NULL THEN {_ACCESS}
         WHEN NOT {_pos_id('bill_id')} THEN '400|bill_id must be a valid positive id'
         WHEN amt_n IS NULL OR isnan(amt_n) OR isinf(amt_n) OR amt_n < 0 THEN '400|paid_amount must be a valid non-negative number'
         WHEN amt_n <= 0 THEN '400|paid_amount must be greater than zero'
         WHEN bid NOT IN (SELECT bill_id FROM billing_summary_view) THEN '404|Bill not found'
    END AS pre,
    CASE WHEN method = '' THEN '400|payment_method is required'
         WHEN amount IS NULL THEN '500|Out of range value for column ''paid_amount'''
         WHEN method NOT IN ('CASH', 'CARD', 'BANK_TRANSFER') THEN '500|Data truncated for column ''payment_method'''
    END AS ins
  FROM v),
cand AS (
  SELECT seq, bid, amount_raw, amount, ins, row_number() OVER (PARTITION BY bid ORDER BY seq) AS rn
  FROM chk WHERE pre IS NULL),
bal AS (SELECT bill_id, CAST(remaining_balance AS DECIMAL(38,2)) AS rem FROM billing_summary_view),
fold(bid, rn, seq, left_after, accepted, over_bal, ins) AS (
  SELECT c.bid, c.rn, c.seq,
         CAST(CASE WHEN c.amount_raw > b.rem OR c.ins IS NOT NULL THEN b.rem ELSE b.rem - c.amount END AS DECIMAL(38,2)),
         NOT (c.amount_raw > b.rem) AND c.ins IS NULL, c.amount_raw > b.rem, c.ins
  FROM cand c JOIN bal b ON b.bill_id = c.bid WHERE c.rn = 1
  UNION ALL
  SELECT c.bid, c.rn, c.seq,
         CAST(CASE WHEN c.amount_raw > f.left_after OR c.ins IS NOT NULL THEN f.left_after ELSE f.left_after - c.amount END AS DECIMAL(38,2)),
         NOT (c.amount_raw > f.left_after) AND c.ins IS NULL, c.amount_raw > f.left_after, c.ins
  FROM fold f JOIN cand c ON c.bid = f.bid AND c.rn = f.rn + 1),
ok AS (
  SELECT seq, (SELECT coalesce(max(payment_id), 0) FROM payments) + row_number() OVER (ORDER BY seq) AS id
  FROM fold WHERE accepted)"""
PAYMENTS_PREFIX = BODIES["add_payments"]
BODIES["add_payments"] = PAYMENTS_PREFIX + f"""
SELECT seq, {_split('pre')}, CAST(NULL AS BIGINT) AS record_id, CAST(NULL AS VARCHAR) AS record_code
FROM chk WHERE pre IS NOT NULL
UNION ALL
SELECT seq, 400, 'Payment is greater than remaining balance', NULL, NULL FROM fold WHERE over_bal
UNION ALL
SELECT seq, {_split('ins')}, NULL, NULL FROM fold WHERE NOT accepted AND NOT over_bal
UNION ALL
SELECT seq, 201, NULL, id, NULL FROM ok"""

# The stream gives the same answers, without the payments' ids.
BODIES["stream_add_payments"] = PAYMENTS_PREFIX + f"""
SELECT seq, {_split('pre')} FROM chk WHERE pre IS NOT NULL
UNION ALL
SELECT seq, 400, 'Payment is greater than remaining balance' FROM fold WHERE over_bal
UNION ALL
SELECT seq, {_split('ins')} FROM fold WHERE NOT accepted AND NOT over_bal
UNION ALL
SELECT seq, 201, NULL FROM ok"""


# --- record-maintenance jobs -------------------------------------------------
def _req(x, n):
    """requiredText value: trimmed, cut to n."""
    return f"substr(trim(coalesce({x}, '')), 1, {n})"


def _truthy(x):
    return (f"NOT ({x} IS NULL OR {x} = '' OR {x} = 'false' OR {x} = 'null' "
            f"OR coalesce(TRY_CAST({x} AS DOUBLE) = 0, FALSE))")


def _key(x):
    return f"CAST(TRY_CAST({x} AS DOUBLE) AS BIGINT)"


def _fails_then_ok(chk, ok_code, id_expr="NULL", code_expr="NULL"):
    return (f"SELECT seq, coalesce(CAST(split_part(fail, '|', 1) AS INTEGER), {ok_code}) AS status_code, "
            f"CASE WHEN fail IS NULL THEN NULL ELSE substr(fail, strpos(fail, '|') + 1) END AS reason, "
            f"CAST({id_expr} AS BIGINT) AS record_id, CAST({code_expr} AS VARCHAR) AS record_code FROM {chk}")


def _inserted(chk, table, id_col, fmt=None):
    code = f"printf('{fmt}', id)" if fmt else "NULL"
    return f"""ok AS (SELECT seq, (SELECT coalesce(max({id_col}), 0) FROM {table}) + row_number() OVER (ORDER BY seq) AS id
        FROM {chk} WHERE fail IS NULL)
SELECT seq, {_split('fail')}, CAST(NULL AS BIGINT) AS record_id, CAST(NULL AS VARCHAR) AS record_code
FROM {chk} WHERE fail IS NOT NULL
UNION ALL
SELECT seq, 201, NULL, id, {code} FROM ok"""


BODIES["add_patients"] = f"""
WITH req AS (
  SELECT c_custkey AS seq, CASE WHEN c_acctbal < -900 THEN ' ' ELSE c_name END AS name,
         CASE WHEN c_custkey % 13 = 0 THEN '12345' ELSE '0300-' || printf('%07d', c_custkey) END AS phone,
         CASE c_custkey % 4 WHEN 0 THEN 'male' WHEN 1 THEN 'Female' WHEN 2 THEN '' ELSE 'x' END AS gender,
         CASE WHEN c_custkey % 17 = 0 THEN '1990-02-30'
              ELSE strftime(DATE '1950-01-01' + CAST(c_custkey * 13 % 20000 AS INT), '%Y-%m-%d') END AS date_of_birth
  FROM customer),
v AS (
  SELECT seq, {_req('name', 120)} AS name, {_req('phone', 30)} AS phone,
         upper({_req("CASE WHEN gender IS NULL OR gender = '' THEN 'OTHER' ELSE gender END", 10)}) AS gender,
         NULLIF(date_of_birth, '') AS dob_text
  FROM req),
chk AS (
  SELECT seq, CASE WHEN name = '' THEN '400|name is required' WHEN phone = '' THEN '400|phone is required'
    WHEN gender = '' THEN '400|gender is required'
    WHEN gender NOT IN ('MALE', 'FEMALE', 'OTHER') THEN '500|Data truncated for column ''gender'''
    WHEN dob_text IS NOT NULL AND TRY_CAST(dob_text AS DATE) IS NULL THEN '500|Incorrect date value'
    WHEN octet_length(encode(phone)) < 7 THEN '500|Check constraint ''chk_patient_phone'' is violated.' END AS fail
  FROM v),
{_inserted('chk', 'patients', 'patient_id', 'PAT-%05d')}"""
ADD_PATIENTS_SQL = BODIES["add_patients"]

_PATIENT_PATCH_REQ = """
req AS (
  SELECT o_orderkey AS seq, CAST(o_custkey + 1 AS VARCHAR) AS patient_id,
         'Patient ' || CAST(o_orderkey AS VARCHAR) AS name, o_orderkey % 5 = 0 AS has_name,
         CAST(o_orderkey AS VARCHAR) AS phone, o_orderkey % 7 = 0 AS has_phone,
         CASE o_orderstatus WHEN 'F' THEN 'female' WHEN 'O' THEN 'male' ELSE 'unknown' END AS gender,
         o_orderkey % 11 = 0 AS has_gender,
         o_orderpriority AS address, o_orderkey % 3 = 0 AS has_address,
         'None' AS allergies, o_orderkey % 4 = 0 AS has_allergies
  FROM orders)"""

_PATIENT_PATCH_CHK = f"""
v AS (
  SELECT r.*, {_key('patient_id')} AS pid,
         has_name OR has_phone OR has_gender OR has_address AS sets_p, has_allergies AS sets_h
  FROM req r),
w AS (
  SELECT v.*, pid IN (SELECT patient_id FROM patients) AS found,
         pid IN (SELECT patient_id FROM patient_medical_history) AS has_hist
  FROM v),
chk AS (
  SELECT seq, pid, w.*, CASE
    WHEN has_name AND {_req('name', 120)} = '' THEN '400|name is required'
    WHEN has_phone AND {_req('phone', 30)} = '' THEN '400|phone is required'
    WHEN has_gender AND {_req('gender', 10)} = '' THEN '400|gender is required'
    WHEN sets_p AND found AND has_gender AND upper({_req('gender', 10)}) NOT IN ('MALE', 'FEMALE', 'OTHER')
         THEN '500|Data truncated for column ''gender'''
    WHEN sets_p AND found AND has_phone AND octet_length(encode({_req('phone', 30)})) < 7
         THEN '500|Check constraint ''chk_patient_phone'' is violated.'
    WHEN sets_h AND NOT found AND NOT has_hist THEN '500|Cannot add or update a child row: a foreign key constraint fails'
  END AS fail
  FROM w)"""

BODIES["patch_patients"] = f"""
WITH {_PATIENT_PATCH_REQ},{_PATIENT_PATCH_CHK}
{_fails_then_ok('chk', 200, 'pid')}"""

BODIES["patch_patients_result"] = f"""
WITH {_PATIENT_PATCH_REQ},{_PATIENT_PATCH_CHK},
ok AS (SELECT * FROM chk WHERE fail IS NULL AND sets_p AND found),
m AS (
  SELECT pid,
         arg_max({_req('name', 120)}, seq) FILTER (WHERE has_name) AS name,
         arg_max({_req('phone', 30)}, seq) FILTER (WHERE has_phone) AS phone,
         arg_max(upper({_req('gender', 10)}), seq) FILTER (WHERE has_gender) AS gender,
         arg_max(substr(trim(coalesce(address, '')), 1, 255), seq) FILTER (WHERE has_address) AS address,
         bool_or(has_name) AS hn, bool_or(has_phone) AS hp, bool_or(has_gender) AS hg, bool_or(has_address) AS ha
  FROM ok GROUP BY pid),
h AS (SELECT pid, arg_max(substr(trim(coalesce(allergies, '')), 1, 500), seq) AS allergies
      FROM chk WHERE fail IS NULL AND sets_h GROUP BY pid)
SELECT p.patient_id, CASE WHEN m.hn THEN m.name ELSE p.name END AS name,
       CASE WHEN m.hp THEN m.phone ELSE p.phone END AS phone,
       CASE WHEN m.hg THEN m.gender ELSE p.gender END AS gender,
       CASE WHEN m.ha THEN m.address ELSE p.address END AS address,
       m.pid IS NOT NULL AS touched,
       coalesce(h.allergies, mh.allergies) AS allergies,
       CASE WHEN h.pid IS NOT NULL THEN '' ELSE mh.current_medications END AS current_medications,
       CASE WHEN h.pid IS NOT NULL THEN '' ELSE mh.medical_notes END AS medical_notes
FROM patients p LEFT JOIN m ON m.pid = p.patient_id LEFT JOIN h ON h.pid = p.patient_id
LEFT JOIN patient_medical_history mh ON mh.patient_id = p.patient_id"""

BODIES["patch_patients_audit"] = f"""
WITH {_PATIENT_PATCH_REQ},{_PATIENT_PATCH_CHK},
ok AS (SELECT c.seq, c.pid, c.has_name, {_req('c.name', 120)} AS new_name, p.name AS base_name
       FROM chk c JOIN patients p ON p.patient_id = c.pid WHERE fail IS NULL AND sets_p),
seqd AS (
  SELECT *, coalesce(last_value(CASE WHEN has_name THEN new_name END IGNORE NULLS) OVER (
              PARTITION BY pid ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), base_name) AS prev
  FROM ok)
SELECT 'PATIENT_UPDATED' AS action_type, 'patients' AS table_name, pid AS record_id, prev AS old_value,
       CASE WHEN has_name THEN new_name ELSE prev END AS new_value
FROM seqd"""

BODIES["soft_delete_patients"] = f"""
SELECT o_orderkey AS seq, 200 AS status_code, CAST(NULL AS VARCHAR) AS reason,
       CAST(o_custkey + 1 AS BIGINT) AS record_id, CAST(NULL AS VARCHAR) AS record_code
FROM orders"""

BODIES["soft_delete_patients_audit"] = """
WITH r AS (SELECT o_orderkey AS seq, o_custkey + 1 AS pid FROM orders),
h AS (SELECT r.seq, p.patient_id, p.name, p.is_deleted, min(r.seq) OVER (PARTITION BY p.patient_id) AS first_seq
      FROM r JOIN patients p ON p.patient_id = r.pid)
SELECT CASE WHEN seq = first_seq AND NOT is_deleted THEN 'PATIENT_SOFT_DELETED' ELSE 'PATIENT_UPDATED' END AS action_type,
       'patients' AS table_name, patient_id AS record_id, name AS old_value, name AS new_value
FROM h"""

BODIES["add_dentists"] = f"""
WITH req AS (
  SELECT s_suppkey AS seq, s_name AS name, '0304-' || printf('%07d', s_suppkey) AS phone,
         CASE WHEN s_acctbal < 0 THEN '' ELSE 'General Dentistry' END AS specialization
  FROM supplier),
chk AS (
  SELECT seq, CASE WHEN {_req('name', 120)} = '' THEN '400|name is required'
    WHEN {_req('phone', 30)} = '' THEN '400|phone is required'
    WHEN {_req('specialization', 120)} = '' THEN '400|specialization is required' END AS fail
  FROM req),
{_inserted('chk', 'dentists', 'dentist_id', 'DEN-%04d')}"""

BODIES["patch_dentists"] = f"""
WITH req AS (
  SELECT s_suppkey AS seq, CAST(s_suppkey + 1 AS VARCHAR) AS dentist_id, upper(s_name) AS name,
         s_nationkey % 3 = 0 AS has_name, s_nationkey % 5 = 4 AS has_specialization,
         CAST(NULL AS VARCHAR) AS specialization
  FROM supplier),
chk AS (
  SELECT seq, {_key('dentist_id')} AS did, CASE
    WHEN has_name AND {_req('name', 120)} = '' THEN '400|name is required'
    WHEN has_specialization AND {_req('specialization', 120)} = '' THEN '400|specialization is required' END AS fail
  FROM req)
{_fails_then_ok('chk', 200, 'did')}"""

BODIES["cancel_appointments"] = """
SELECT event_id AS seq, 200 AS status_code, CAST(NULL AS VARCHAR) AS reason,
       CAST((event_id * 31) % (SELECT count(*) FROM events) + 1 AS BIGINT) AS record_id,
       CAST(NULL AS VARCHAR) AS record_code
FROM events"""

BODIES["cancel_appointments_audit"] = """
WITH r AS (SELECT event_id AS seq, (event_id * 31) % (SELECT count(*) FROM events) + 1 AS aid FROM events),
f AS (SELECT aid, min(seq) AS seq FROM r GROUP BY aid)
SELECT 'APPOINTMENT_STATUS_CHANGED' AS action_type, 'appointments' AS table_name, a.appointment_id AS record_id,
       a.status AS old_value, 'CANCELLED' AS new_value, a.created_by_user_id AS user_id
FROM f JOIN appointments a ON a.appointment_id = f.aid WHERE a.status <> 'CANCELLED'"""

_APPT_PATCH = f"""
req AS (
  SELECT event_id AS seq, CAST((event_id * 7) % (SELECT count(*) FROM events) + 1 AS VARCHAR) AS appointment_id,
         strftime(CAST(ts AS DATE) + 1, '%Y-%m-%d') AS appointment_date, event_type = 'signup' AS has_date,
         strftime(ts, '%H:30') AS appointment_time, event_type = 'click' AS has_time,
         CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'cancelled' ELSE 'pending' END AS status,
         event_type IN ('purchase', 'error', 'view') AS has_status
  FROM events),
j AS (
  SELECT r.*, {_key('r.appointment_id')} AS aid, a.appointment_date AS cur_date, a.appointment_time AS cur_time,
         a.dentist_id AS cur_dentist, a.patient_id AS cur_patient, a.status AS cur_status, a.created_by_user_id AS creator,
         has_date AND {_truthy('r.appointment_date')} AS date_given,
         has_time AND {_truthy('r.appointment_time')} AS time_given,
         substr(trim(coalesce(r.appointment_time, '')), 1, 8) AS t8, substr(trim(coalesce(r.appointment_date, '')), 1, 10) AS d10
  FROM req r LEFT JOIN appointments a ON a.appointment_id = {_key('r.appointment_id')}),
k AS (
  SELECT j.*, CASE WHEN length(t8) = 5 THEN t8 || ':00' ELSE t8 END AS tnorm,
         CASE WHEN date_given THEN appointment_date ELSE strftime(cur_date, '%Y-%m-%d') END AS final_date
  FROM j),
k2 AS (
  SELECT k.*, CASE WHEN time_given THEN tnorm ELSE cur_time END AS final_time,
         CASE WHEN has_date THEN TRY_CAST(d10 AS DATE) ELSE cur_date END AS new_date,
         CASE WHEN has_time THEN tnorm ELSE cur_time END AS new_time,
         has_date OR has_time OR has_status AS any_f, has_date OR has_time AS moves
  FROM k),
h AS (
  SELECT k2.*, ct.opening_time AS op, ct.closing_time AS cl, ct.is_closed AS closed
  FROM k2 LEFT JOIN (SELECT * FROM clinic_timings WHERE clinic_id = 1) ct
    ON ct.day_of_week = upper(dayname(TRY_CAST(k2.final_date AS DATE)))),
chk AS (
  SELECT h.*, CASE
    WHEN cur_date IS NULL THEN '404|Appointment not found'
    WHEN time_given AND t8 = '' THEN '400|appointment_time is required'
    WHEN time_given AND NOT regexp_matches(t8, '^[0-9]{{2}}:[0-9]{{2}}(:[0-9]{{2}})?$') THEN '400|appointment_time must use HH:MM format'
    WHEN (date_given OR time_given) AND (op IS NULL OR closed) THEN '400|Clinic is closed on the selected date'
    WHEN (date_given OR time_given) AND (final_time < op OR final_time >= cl)
         THEN '400|Appointment time must be between ' || substr(op, 1, 5) || ' and ' || substr(cl, 1, 5)
    WHEN has_date AND d10 = '' THEN '400|appointment_date is required'
    WHEN has_date AND NOT regexp_matches(d10, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN '400|appointment_date must use YYYY-MM-DD format'
    WHEN has_status AND {_req('status', 20)} = '' THEN '400|status is required'
    WHEN any_f AND has_status AND upper({_req('status', 20)}) NOT IN ('BOOKED', 'COMPLETED', 'CANCELLED')
         THEN '500|Data truncated for column ''status'''
    WHEN any_f AND new_date IS NULL THEN '500|Incorrect date value'
    WHEN any_f AND (CAST(substr(new_time, 4, 2) AS INT) >= 60 OR CAST(substr(new_time, 7, 2) AS INT) >= 60) THEN '500|Incorrect time value'
    WHEN any_f AND moves AND EXISTS (SELECT 1 FROM appointments o WHERE o.dentist_id = h.cur_dentist
         AND o.appointment_date = h.new_date AND o.appointment_time = h.new_time AND o.appointment_id <> h.aid)
         THEN '409|Duplicate entry. This record already exists or the appointment slot is booked.'
  END AS fail0
  FROM h),
fin AS (
  SELECT chk.*, CASE WHEN fail0 IS NULL AND any_f AND moves
                      AND aid <> arg_min(aid, seq) OVER (PARTITION BY cur_dentist, new_date, new_time, fail0 IS NULL AND any_f AND moves)
                     THEN '409|Duplicate entry. This record already exists or the appointment slot is booked.'
                     ELSE fail0 END AS fail
  FROM chk)"""

BODIES["patch_appointments"] = f"""
WITH {_APPT_PATCH}
{_fails_then_ok('fin', 200, 'aid')}"""

BODIES["patch_appointments_audit"] = f"""
WITH {_APPT_PATCH},
st AS (SELECT seq, aid, upper({_req('status', 20)}) AS new_status, cur_status, creator
       FROM fin WHERE fail IS NULL AND any_f AND has_status),
pv AS (SELECT *, coalesce(lag(new_status) OVER (PARTITION BY aid ORDER BY seq), cur_status) AS prev FROM st)
SELECT 'APPOINTMENT_STATUS_CHANGED' AS action_type, 'appointments' AS table_name, aid AS record_id,
       prev AS old_value, new_status AS new_value, creator AS user_id
FROM pv WHERE prev <> new_status"""

BODIES["add_treatments"] = f"""
WITH req AS (
  SELECT l_orderkey * 100 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS seq,
         CAST(l_partkey + 1 AS VARCHAR) AS patient_id, CAST(l_suppkey + 1 AS VARCHAR) AS dentist_id,
         CASE WHEN l_linenumber = 1 THEN CAST(l_orderkey + 1 AS VARCHAR) ELSE '' END AS appointment_id,
         'Procedure ' || l_returnflag || l_linestatus AS treatment_name,
         CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS VARCHAR) AS cost,
         strftime(l_shipdate, '%Y-%m-%d') AS treatment_date,
         CASE WHEN l_linestatus = 'F' THEN 'done' ELSE 'planned' END AS status
  FROM lineitem),
v AS (
  SELECT seq, {_req('treatment_name', 120)} AS name, TRY_CAST(trim(cost) AS DOUBLE) AS cost_n,
         TRY_CAST(round(TRY_CAST(trim(cost) AS DECIMAL(38,10)), 2) AS DECIMAL(10,2)) AS cost_m,
         {_req("CASE WHEN treatment_date IS NULL OR treatment_date = '' THEN '2024-01-15' ELSE treatment_date END", 10)} AS d10,
         upper({_req("CASE WHEN status IS NULL OR status = '' THEN 'DONE' ELSE status END", 20)}) AS st,
         TRY_CAST(trim(patient_id) AS DOUBLE) AS pid_n, TRY_CAST(trim(dentist_id) AS DOUBLE) AS did_n,
         NULLIF(appointment_id, '') AS aid_text, TRY_CAST(trim(NULLIF(appointment_id, '')) AS DOUBLE) AS aid_n
  FROM req),
chk AS (
  SELECT seq, CASE
    WHEN name = '' THEN '400|treatment_name is required'
    WHEN cost_n IS NULL OR isnan(cost_n) OR isinf(cost_n) OR cost_n < 0 THEN '400|cost must be a valid non-negative number'
    WHEN d10 = '' THEN '400|treatment_date is required'
    WHEN NOT regexp_matches(d10, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN '400|treatment_date must use YYYY-MM-DD format'
    WHEN st = '' THEN '400|status is required'
    WHEN pid_n IS NULL OR pid_n <> floor(pid_n) OR did_n IS NULL OR did_n <> floor(did_n)
         OR (aid_text IS NOT NULL AND (aid_n IS NULL OR aid_n <> floor(aid_n))) THEN '500|Incorrect integer value'
    WHEN st NOT IN ('PLANNED', 'DONE') THEN '500|Data truncated for column ''status'''
    WHEN TRY_CAST(d10 AS DATE) IS NULL THEN '500|Incorrect date value'
    WHEN cost_m IS NULL THEN '500|Out of range value for column ''cost'''
    WHEN CAST(pid_n AS BIGINT) NOT IN (SELECT patient_id FROM patients)
         OR CAST(did_n AS BIGINT) NOT IN (SELECT dentist_id FROM dentists)
         OR (aid_n IS NOT NULL AND CAST(aid_n AS BIGINT) NOT IN (SELECT appointment_id FROM appointments))
         THEN '500|Cannot add or update a child row: a foreign key constraint fails'
  END AS fail
  FROM v),
{_inserted('chk', 'treatments', 'treatment_id')}"""

BODIES["patch_treatments"] = f"""
WITH req AS (
  SELECT o_orderkey AS seq, CAST(o_orderkey * 100 + 1 AS VARCHAR) AS treatment_id,
         (CAST(CAST(floor(o_totalprice / 100 * 100) AS BIGINT) // 100 AS VARCHAR) || '.' || lpad(CAST(CAST(floor(o_totalprice / 100 * 100) AS BIGINT) % 100 AS VARCHAR), 2, '0')) AS cost, o_orderkey % 2 = 0 AS has_cost,
         strftime(o_orderdate, '%Y-%m-%d') AS treatment_date, o_orderkey % 5 = 0 AS has_date,
         CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'planned' ELSE 'paused' END AS status,
         o_orderkey % 3 = 0 AS has_status
  FROM orders),
v AS (
  SELECT r.*, {_key('treatment_id')} AS tid, TRY_CAST(trim(cost) AS DOUBLE) AS cost_n,
         {_req('treatment_date', 10)} AS d10, upper({_req('status', 20)}) AS st,
         has_cost OR has_date OR has_status AS any_f
  FROM req r),
chk AS (
  SELECT seq, tid, CASE
    WHEN has_cost AND (cost_n IS NULL OR isnan(cost_n) OR isinf(cost_n) OR cost_n < 0) THEN '400|cost must be a valid non-negative number'
    WHEN has_date AND d10 = '' THEN '400|treatment_date is required'
    WHEN has_date AND NOT regexp_matches(d10, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN '400|treatment_date must use YYYY-MM-DD format'
    WHEN has_status AND st = '' THEN '400|status is required'
    WHEN any_f AND tid IN (SELECT treatment_id FROM treatments) AND has_status AND st NOT IN ('PLANNED', 'DONE')
         THEN '500|Data truncated for column ''status'''
    WHEN any_f AND tid IN (SELECT treatment_id FROM treatments) AND has_date AND TRY_CAST(d10 AS DATE) IS NULL
         THEN '500|Incorrect date value'
  END AS fail
  FROM v)
{_fails_then_ok('chk', 200, 'tid')}"""

BODIES["add_medicines"] = f"""
WITH req AS (
  SELECT p_partkey AS seq, p_name AS medicine_name, p_brand AS batch_no, CAST(p_size - 5 AS VARCHAR) AS quantity,
         CASE WHEN p_size % 4 = 0 THEN '0' ELSE CAST(p_size % 20 AS VARCHAR) END AS low_stock_limit,
         strftime(DATE '2026-01-01' + CAST(p_partkey % 720 AS INT), '%Y-%m-%d') AS expiry_date
  FROM part),
v AS (
  SELECT seq, {_req('medicine_name', 120)} AS name, {_req('batch_no', 40)} AS batch, {_req('expiry_date', 10)} AS d10,
         TRY_CAST(CASE WHEN {_truthy('quantity')} THEN quantity ELSE '0' END AS DOUBLE) AS q,
         TRY_CAST(CASE WHEN coalesce(low_stock_limit, '') <> '' THEN low_stock_limit ELSE '10' END AS DOUBLE) AS l
  FROM req),
chk AS (
  SELECT seq, CASE
    WHEN name = '' THEN '400|medicine_name is required'
    WHEN batch = '' THEN '400|batch_no is required'
    WHEN d10 = '' THEN '400|expiry_date is required'
    WHEN NOT regexp_matches(d10, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN '400|expiry_date must use YYYY-MM-DD format'
    WHEN q IS NULL OR l IS NULL THEN '500|Incorrect integer value'
    WHEN TRY_CAST(d10 AS DATE) IS NULL THEN '500|Incorrect date value'
    WHEN round(q) < 0 OR round(l) < 0 THEN '500|Check constraint ''chk_medicine_quantity'' is violated.'
  END AS fail
  FROM v),
{_inserted('chk', 'medicines', 'medicine_id')}"""

BODIES["patch_medicines"] = f"""
WITH req AS (
  SELECT l_orderkey * 100 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS seq,
         CAST(l_partkey + 1 AS VARCHAR) AS medicine_id,
         CAST(CAST(l_quantity AS INT) - 3 AS VARCHAR) AS quantity,
         CAST(l_linenumber + 9 AS VARCHAR) AS low_stock_limit, l_linenumber = 1 AS has_limit
  FROM lineitem),
chk AS (
  SELECT seq, {_key('medicine_id')} AS mid, CASE
    WHEN {_key('medicine_id')} IN (SELECT medicine_id FROM medicines)
         AND (TRY_CAST(quantity AS DOUBLE) IS NULL OR (has_limit AND TRY_CAST(low_stock_limit AS DOUBLE) IS NULL))
         THEN '500|Incorrect integer value'
    WHEN {_key('medicine_id')} IN (SELECT medicine_id FROM medicines)
         AND (round(TRY_CAST(quantity AS DOUBLE)) < 0 OR (has_limit AND round(TRY_CAST(low_stock_limit AS DOUBLE)) < 0))
         THEN '500|Check constraint ''chk_medicine_quantity'' is violated.'
  END AS fail
  FROM req)
{_fails_then_ok('chk', 200, 'mid')}"""

BODIES["upsert_permissions"] = f"""
WITH req AS (
  SELECT c_custkey AS seq, CASE WHEN c_custkey % 3 = 0 THEN 'STAFF' ELSE 'owner' END AS caller_role,
         CAST(CASE WHEN c_custkey % 29 = 0 THEN 999 ELSE c_nationkey + 1 END AS VARCHAR) AS staff_user_id
  FROM customer),
chk AS (
  SELECT seq, {_key('staff_user_id')} AS uid, CASE
    WHEN upper(coalesce(caller_role, 'OWNER')) <> 'OWNER' THEN '403|Only owner can perform this action'
    WHEN {_key('staff_user_id')} NOT IN (SELECT staff_user_id FROM staff_permissions)
         AND {_key('staff_user_id')} NOT IN (SELECT user_id FROM users)
         THEN '500|Cannot add or update a child row: a foreign key constraint fails'
  END AS fail
  FROM req)
{_fails_then_ok('chk', 200, 'uid')}"""

BODIES["upsert_permissions_result"] = f"""
WITH req AS (
  SELECT c_custkey AS seq, CASE WHEN c_custkey % 3 = 0 THEN 'STAFF' ELSE 'owner' END AS caller_role,
         CAST(CASE WHEN c_custkey % 29 = 0 THEN 999 ELSE c_nationkey + 1 END AS VARCHAR) AS staff_user_id,
         CASE WHEN c_acctbal > 0 THEN 'true' ELSE 'false' END AS can_manage_billing,
         CASE WHEN c_custkey % 4 = 0 THEN 'false' ELSE '1' END AS can_view_reports, c_custkey % 2 = 0 AS has_view
  FROM customer),
ok AS (
  SELECT seq, {_key('staff_user_id')} AS uid, {_truthy('can_manage_billing')} AS bill,
         CASE WHEN has_view THEN {_truthy('can_view_reports')} ELSE TRUE END AS view
  FROM req
  WHERE upper(coalesce(caller_role, 'OWNER')) = 'OWNER'
    AND ({_key('staff_user_id')} IN (SELECT staff_user_id FROM staff_permissions)
         OR {_key('staff_user_id')} IN (SELECT user_id FROM users))),
last AS (SELECT uid, arg_max(bill, seq) AS bill, arg_max(view, seq) AS view, min(seq) AS seq FROM ok GROUP BY uid),
ins AS (SELECT l.* FROM last l WHERE uid NOT IN (SELECT staff_user_id FROM staff_permissions))
SELECT sp.permission_id, sp.staff_user_id, coalesce(l.bill, sp.can_manage_billing) AS can_manage_billing,
       coalesce(l.view, sp.can_view_reports) AS can_view_reports
FROM staff_permissions sp LEFT JOIN last l ON l.uid = sp.staff_user_id
UNION ALL
SELECT (SELECT max(permission_id) FROM staff_permissions) + row_number() OVER (ORDER BY seq), uid, bill, view FROM ins"""

BODIES["patch_clinic"] = f"""
WITH req AS (
  SELECT r_regionkey AS seq, r_name AS clinic_name, 'Main Road' AS address, '0300-0000000' AS phone,
         CASE WHEN r_regionkey = 2 THEN '' ELSE '923000000000' END AS whatsapp_number
  FROM region),
chk AS (
  SELECT seq, CASE WHEN {_req('clinic_name', 120)} = '' THEN '400|clinic_name is required'
    WHEN {_req('address', 255)} = '' THEN '400|address is required'
    WHEN {_req('phone', 30)} = '' THEN '400|phone is required'
    WHEN {_req('whatsapp_number', 30)} = '' THEN '400|whatsapp_number is required' END AS fail
  FROM req)
{_fails_then_ok('chk', 200)}"""

BODIES["patch_timings"] = f"""
WITH req AS (
  SELECT n_nationkey AS seq, CAST(n_nationkey % 7 + 1 AS VARCHAR) AS timing_id,
         CASE n_regionkey WHEN 0 THEN '08:00' WHEN 1 THEN '10:30' WHEN 2 THEN '9:00' WHEN 3 THEN '' ELSE '19:00' END AS opening_time,
         CASE WHEN n_regionkey = 1 THEN '17:00' END AS closing_time
  FROM nation),
v AS (
  SELECT seq, {_key('timing_id')} AS tid,
         {_req("CASE WHEN opening_time IS NULL OR opening_time = '' THEN '09:00' ELSE opening_time END", 8)} AS o8,
         {_req("CASE WHEN closing_time IS NULL OR closing_time = '' THEN '18:00' ELSE closing_time END", 8)} AS c8
  FROM req),
w AS (
  SELECT v.*, CASE WHEN length(o8) = 5 THEN o8 || ':00' ELSE o8 END AS op,
         CASE WHEN length(c8) = 5 THEN c8 || ':00' ELSE c8 END AS cl, tid IN (SELECT timing_id FROM clinic_timings) AS found
  FROM v),
chk AS (
  SELECT seq, tid, CASE
    WHEN o8 = '' THEN '400|opening_time is required'
    WHEN NOT regexp_matches(o8, '^[0-9]{{2}}:[0-9]{{2}}(:[0-9]{{2}})?$') THEN '400|opening_time must use HH:MM format'
    WHEN c8 = '' THEN '400|closing_time is required'
    WHEN NOT regexp_matches(c8, '^[0-9]{{2}}:[0-9]{{2}}(:[0-9]{{2}})?$') THEN '400|closing_time must use HH:MM format'
    WHEN found AND (CAST(substr(op, 4, 2) AS INT) >= 60 OR CAST(substr(op, 7, 2) AS INT) >= 60
                    OR CAST(substr(cl, 4, 2) AS INT) >= 60 OR CAST(substr(cl, 7, 2) AS INT) >= 60) THEN '500|Incorrect time value'
    WHEN found AND NOT (op < cl) THEN '500|Check constraint ''chk_clinic_time'' is violated.'
  END AS fail
  FROM w)
{_fails_then_ok('chk', 200, 'tid')}"""


# --- change feeds ------------------------------------------------------------
BODIES["bill_status_recompute"] = """
WITH paid AS (SELECT bill_id, sum(paid_amount) AS s FROM payments GROUP BY bill_id)
SELECT b.bill_id, b.status AS stored_status,
       CASE WHEN p.s IS NULL THEN b.status WHEN p.s >= b.total_amount THEN 'PAID' WHEN p.s > 0 THEN 'PARTIAL'
            ELSE 'UNPAID' END AS status
FROM bills b LEFT JOIN paid p ON p.bill_id = b.bill_id"""

_NEW_PAYMENTS = """,
newpay AS (SELECT ok.id AS payment_id, c.bid AS bill_id, c.amount, coalesce(r.caller_id, 1) AS received_by
           FROM ok JOIN cand c ON c.seq = ok.seq JOIN req r ON r.seq = ok.seq)"""

BODIES["add_payments_bills"] = PAYMENTS_PREFIX + _NEW_PAYMENTS + """,
allpay AS (SELECT bill_id, paid_amount FROM payments UNION ALL SELECT bill_id, amount FROM newpay),
s AS (SELECT bill_id, sum(paid_amount) AS s FROM allpay WHERE bill_id IN (SELECT bill_id FROM newpay) GROUP BY bill_id)
SELECT b.bill_id, CASE WHEN s.s IS NULL THEN b.status WHEN s.s >= b.total_amount THEN 'PAID'
                       WHEN s.s > 0 THEN 'PARTIAL' ELSE 'UNPAID' END AS status
FROM bills b LEFT JOIN s ON s.bill_id = b.bill_id"""

_T6 = PAYMENTS_PREFIX + _NEW_PAYMENTS + """
SELECT 'PAYMENT_CREATED' AS action_type, 'payments' AS table_name, payment_id AS record_id,
       CAST(NULL AS VARCHAR) AS old_value, 'Amount: ' || CAST(amount AS VARCHAR) AS new_value,
       CAST(received_by AS BIGINT) AS user_id
FROM newpay"""
BODIES["payments_audit"] = _T6

_T5 = BILLS_PREFIX + """
SELECT 'BILL_CREATED' AS action_type, 'bills' AS table_name, ok.id AS record_id, CAST(NULL AS VARCHAR) AS old_value,
       'Total: ' || CAST(CAST(v.sub_m - v.dis_m AS DECIMAL(10,2)) AS VARCHAR) AS new_value,
       CAST(v.cid AS BIGINT) AS user_id
FROM ok JOIN v ON v.seq = ok.seq"""
BODIES["bills_audit"] = _T5

BODIES["audit_feed"] = f"""
SELECT * FROM ({_T5}) t5
UNION ALL SELECT * FROM ({_T6}) t6
UNION ALL SELECT action_type, table_name, record_id, old_value, new_value, CAST(user_id AS BIGINT)
FROM ({BODIES['cancel_appointments_audit']}) t4"""

BODIES["stream_bill_status"] = BODIES["bill_status_recompute"]

BODIES["stream_payment_audit"] = """
SELECT 'PAYMENT_CREATED' AS action_type, 'payments' AS table_name, payment_id AS record_id,
       CAST(NULL AS VARCHAR) AS old_value, 'Amount: ' || CAST(paid_amount AS VARCHAR) AS new_value,
       received_by_user_id AS user_id
FROM payments"""


BODIES["add_patients_audit"] = ADD_PATIENTS_SQL.split("SELECT seq, CAST(split_part")[0].rstrip() + """
SELECT 'PATIENT_ADDED' AS action_type, 'patients' AS table_name, ok.id AS record_id,
       CAST(NULL AS VARCHAR) AS old_value, 'PENDING - ' || v.name AS new_value
FROM ok JOIN v ON v.seq = ok.seq
UNION ALL
SELECT 'PATIENT_UPDATED', 'patients', ok.id, v.name, v.name FROM ok JOIN v ON v.seq = ok.seq"""

BODIES["patients_diff_audit"] = f"""
SELECT 'PATIENT_UPDATED' AS action_type, 'patients' AS table_name, p.patient_id AS record_id,
       p.name AS old_value, r.name AS new_value
FROM patients p JOIN ({BODIES['patch_patients_result']}) r ON r.patient_id = p.patient_id
WHERE r.name IS DISTINCT FROM p.name OR r.phone IS DISTINCT FROM p.phone
   OR r.gender IS DISTINCT FROM p.gender OR r.address IS DISTINCT FROM p.address"""

BODIES["stream_audit_feed"] = f"""
SELECT action_type, table_name, record_id, old_value, new_value, CAST(NULL AS BIGINT) AS user_id, 1 AS version
FROM ({BODIES['patients_diff_audit']}) t3
UNION ALL
SELECT action_type, table_name, record_id, old_value, new_value, CAST(user_id AS BIGINT), 1
FROM ({BODIES['cancel_appointments_audit']}) t4
UNION ALL
SELECT *, 1 FROM ({_T5}) t5
UNION ALL
SELECT 'PATIENT_SOFT_DELETED', 'patients', p.patient_id, r.name, r.name, NULL, 2
FROM patients p JOIN ({BODIES['patch_patients_result']}) r ON r.patient_id = p.patient_id
WHERE NOT p.is_deleted AND p.patient_id IN (SELECT o_custkey + 1 FROM orders)
UNION ALL
SELECT *, 2 FROM ({_T6}) t6"""

BODIES["patients_page_fences"] = BODIES["patients_page"]
BODIES["search_patient_sql"] = BODIES["search_patient"]
BODIES["daily_report_sql"] = BODIES["daily_report"]

BODIES["dentist_status_labels"] = """
SELECT dentist_id, dentist_code, name, specialization,
       CASE WHEN is_active THEN 'ACTIVE' ELSE 'INACTIVE' END AS status_label
FROM dentists"""

BODIES["stock_labels"] = """
SELECT medicine_id, medicine_name, quantity, low_stock_limit,
       CASE WHEN quantity <= low_stock_limit THEN 'LOW' ELSE 'OK' END AS stock_label
FROM medicines"""


# --- written rows -----------------------------------------------------------
BODIES["soft_delete_patients_result"] = """
WITH asked AS (SELECT DISTINCT o_custkey + 1 AS patient_id FROM orders)
SELECT patient_id, is_deleted OR patient_id IN (SELECT patient_id FROM asked) AS is_deleted,
       patient_id IN (SELECT patient_id FROM asked) AS touched
FROM patients"""

BODIES["soft_delete_patients_versions"] = BODIES["soft_delete_patients_result"]

BODIES["add_dentists_result"] = """
WITH good AS (SELECT *, row_number() OVER (ORDER BY s_suppkey) + (SELECT max(dentist_id) FROM dentists) AS id
              FROM supplier WHERE s_acctbal >= 0)
SELECT dentist_id, dentist_code, name, phone, specialization, is_active FROM dentists
UNION ALL
SELECT id, printf('DEN-%04d', id), s_name, '0304-' || printf('%07d', s_suppkey), 'General Dentistry', true FROM good"""

BODIES["patch_dentists_result"] = """
SELECT dentist_id,
       CASE WHEN s_nationkey % 5 <> 4 AND s_nationkey % 3 = 0 THEN upper(name) ELSE name END AS name, specialization,
       CASE WHEN s_nationkey % 5 <> 4 AND s_nationkey % 2 = 0 THEN s_acctbal > 0 ELSE is_active END AS is_active
FROM dentists JOIN supplier ON s_suppkey + 1 = dentist_id"""

BODIES["cancel_appointments_result"] = """
WITH asked AS (SELECT DISTINCT (event_id * 31) % (SELECT count(*) FROM events) + 1 AS aid FROM events)
SELECT appointment_id, CASE WHEN aid IS NULL THEN status ELSE 'CANCELLED' END AS status, aid IS NOT NULL AS touched
FROM appointments LEFT JOIN asked ON aid = appointment_id"""

BODIES["add_medicines_result"] = """
WITH good AS (SELECT *, row_number() OVER (ORDER BY p_partkey) + (SELECT max(medicine_id) FROM medicines) AS id
              FROM part WHERE p_size >= 5)
SELECT medicine_id, medicine_name, batch_no, quantity, low_stock_limit, expiry_date FROM medicines
UNION ALL
SELECT id, p_name, p_brand, CAST(p_size - 5 AS INT), CASE WHEN p_size % 4 = 0 THEN 0 ELSE CAST(p_size % 20 AS INT) END,
       DATE '2026-01-01' + CAST(p_partkey % 720 AS INT)
FROM good"""

BODIES["add_medicines_typed"] = """
WITH good AS (SELECT *, CASE WHEN p_partkey % 10 = 0 THEN 0 ELSE p_size - 5 END AS quantity
              FROM part WHERE p_partkey % 50 NOT IN (7, 9))
SELECT row_number() OVER (ORDER BY p_partkey) + (SELECT max(medicine_id) FROM medicines) AS medicine_id,
       p_name AS medicine_name, p_brand AS batch_no, CAST(quantity AS INT) AS quantity,
       CAST(CASE p_size % 4 WHEN 0 THEN 10 WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE p_size % 20 END AS INT) AS low_stock_limit,
       DATE '2026-01-01' + CAST(p_partkey % 720 AS INT) AS expiry_date
FROM good WHERE quantity >= 0"""

BODIES["malformed_requests"] = """
WITH b AS (
  SELECT p_partkey, '{"seq":' || p_partkey || ',"medicine_name":"' || p_name || '","batch_no":"' || p_brand
         || '","expiry_date":"' || strftime(DATE '2026-01-01' + CAST(p_partkey % 720 AS INT), '%Y-%m-%d') || '","quantity":'
         || CASE WHEN p_partkey % 10 = 0 THEN 'null' ELSE CAST(p_size - 5 AS VARCHAR) END || ',"low_stock_limit":'
         || CASE p_size % 4 WHEN 0 THEN '0' WHEN 1 THEN '"0"' WHEN 2 THEN 'true' ELSE CAST(p_size % 20 AS VARCHAR) END AS body
  FROM part)
SELECT body AS line, 'no JSON' AS problem FROM b WHERE p_partkey % 50 = 7
UNION ALL
SELECT '[' || body || '}]', 'no object' FROM b WHERE p_partkey % 50 = 9"""

BODIES["book_appointments_result"] = _book(True).split(")\nSELECT seq, CAST(split_part")[0] + """)
SELECT id AS appointment_id, printf('APT-%05d', id) AS appointment_code, pid AS patient_id, did AS dentist_id,
       d AS appointment_date, tm AS appointment_time, 'BOOKED' AS status
FROM won JOIN passed USING (seq)"""

BODIES["create_bills_result"] = BILLS_PREFIX + """
SELECT id AS bill_id, printf('BIL-%05d', id) AS bill_code, pid AS patient_id, CASE WHEN has_tid THEN tid END AS treatment_id,
       CAST(sub_m AS DOUBLE) AS subtotal, CAST(dis_m AS DOUBLE) AS discount_amount, CAST(sub_m - dis_m AS DOUBLE) AS total_amount,
       'UNPAID' AS status, cid AS created_by_user_id
FROM ok JOIN chk USING (seq)"""

BODIES["patch_clinic_result"] = """
WITH last AS (SELECT * FROM region WHERE r_regionkey <> 2 ORDER BY r_regionkey DESC LIMIT 1)
SELECT clinic_id, CASE clinic_id WHEN 1 THEN (SELECT r_name FROM last) ELSE clinic_name END AS clinic_name,
       'Main Road' AS address, CASE clinic_id WHEN 1 THEN '0300-0000000' ELSE phone END AS phone,
       CASE clinic_id WHEN 1 THEN '923000000000' ELSE whatsapp_number END AS whatsapp_number
FROM clinic"""


def _chain(strict: bool) -> str:
    """Appointment changes one by one. No request changes a dentist, so the
    appointments of one dentist are walked by themselves, as a list of rows."""
    live = "TRUE" if strict else "x.status <> 'CANCELLED'"
    revived = "FALSE" if strict else "cur.status = 'CANCELLED'"
    holds = "TRUE" if strict else "new_status <> 'CANCELLED'"
    return f"""
WITH RECURSIVE req AS (
  SELECT event_id AS seq, (event_id * 7) % greatest((SELECT count(*) FROM events) // 3, 1) * 3 + 1 AS aid,
         CASE WHEN event_type IN ('signup', 'purchase') THEN CAST(ts AS DATE) + 1 END AS to_date,
         CASE WHEN event_type IN ('click', 'purchase') THEN strftime(ts, '%H:00:00') END AS to_time,
         CASE event_type WHEN 'view' THEN 'CANCELLED' WHEN 'error' THEN 'BOOKED' END AS to_status,
         event_type = 'view' AS cancel
  FROM events),
numbered AS (
  SELECT req.*, a.dentist_id, row_number() OVER (PARTITION BY a.dentist_id ORDER BY seq) AS n
  FROM req JOIN appointments a ON a.appointment_id = req.aid),
hours AS (SELECT * FROM clinic_timings WHERE clinic_id = 1),
walk AS (
  SELECT dentist_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS aid, CAST(NULL AS VARCHAR) AS fail,
         list({{'aid': appointment_id, 'day': appointment_date, 'at': appointment_time, 'status': status}}) AS held
  FROM appointments GROUP BY dentist_id
  UNION ALL
  SELECT dentist_id, n, seq, aid, fail,
         CASE WHEN fail IS NULL
              THEN list_transform(held, lambda x: CASE WHEN x.aid = judged.aid
                   THEN {{'aid': x.aid, 'day': judged.new_day, 'at': judged.new_at, 'status': judged.new_status}} ELSE x END)
              ELSE held END AS held
  FROM (
    SELECT c.*, CASE
        WHEN timed AND (h.opening_time IS NULL OR h.is_closed) THEN '400|Clinic is closed on the selected date'
        WHEN timed AND (new_at < h.opening_time OR new_at >= h.closing_time)
             THEN '400|Appointment time must be between ' || substr(h.opening_time, 1, 5) || ' and ' || substr(h.closing_time, 1, 5)
        WHEN {holds} AND (timed OR {revived})
             AND len(list_filter(held, lambda x: x.aid <> c.aid AND x.day = c.new_day AND x.at = c.new_at AND {live})) > 0
             THEN '409|Duplicate entry. This record already exists or the appointment slot is booked.'
      END AS fail
    FROM (
      SELECT b.*, coalesce(to_date, cur.day) AS new_day, coalesce(to_time, cur.at) AS new_at,
             coalesce(to_status, cur.status) AS new_status, to_date IS NOT NULL OR to_time IS NOT NULL AS timed
      FROM (
        SELECT w.dentist_id, q.n, q.seq, q.aid, q.to_date, q.to_time, q.to_status, w.held,
               list_filter(w.held, lambda x: x.aid = q.aid)[1] AS cur
        FROM walk w JOIN numbered q ON q.dentist_id = w.dentist_id AND q.n = w.n + 1) b) c
    LEFT JOIN hours h ON h.day_of_week = upper(dayname(c.new_day))) judged),
fin AS (
  SELECT seq, aid, fail FROM walk WHERE n > 0
  UNION ALL
  SELECT seq, aid, CASE WHEN cancel THEN NULL ELSE '404|Appointment not found' END
  FROM req WHERE aid NOT IN (SELECT appointment_id FROM appointments))"""


for _strict, _name in ((True, ""), (False, "_lenient")):
    BODIES[f"patch_appointments_chain{_name}"] = f"{_chain(_strict)}\n{_fails_then_ok('fin', 200, 'aid')}"

BODIES["patch_appointments_chain_result"] = f"""{_chain(False)},
ends AS (
  SELECT unnest(held) AS x
  FROM walk JOIN (SELECT dentist_id, max(n) AS n FROM walk GROUP BY dentist_id) USING (dentist_id, n))
SELECT x.aid AS appointment_id, x.day AS appointment_date, x.at AS appointment_time, x.status AS status,
       x.aid IN (SELECT aid FROM fin WHERE fail IS NULL) AS touched
FROM ends"""
