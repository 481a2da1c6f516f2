"""Table schemas, domains and defaults of the clinic data model."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(10, 2)
L, I, S, B, D, TS = (T.LongType(), T.IntegerType(), T.StringType(), T.BooleanType(),
                     T.DateType(), T.TimestampType())


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


# Each field: (name, type, nullable). TIME columns are zero-padded
# 'HH:mm:ss' strings: ordering them as text is ordering them as times.
SCHEMAS: dict[str, T.StructType] = {
    "users": _struct(
        ("user_id", L, False), ("full_name", S, False), ("phone", S, True), ("email", S, False),
        ("role", S, False), ("is_active", B, False), ("created_at", TS, True)),
    "staff_permissions": _struct(
        ("permission_id", L, False), ("staff_user_id", L, False), ("can_manage_billing", B, False),
        ("can_view_reports", B, False), ("updated_at", TS, True)),
    "clinic": _struct(
        ("clinic_id", L, False), ("clinic_name", S, False), ("address", S, False), ("phone", S, False),
        ("email", S, True), ("whatsapp_number", S, False), ("created_at", TS, True)),
    "clinic_timings": _struct(
        ("timing_id", L, False), ("clinic_id", L, False), ("day_of_week", S, False),
        ("opening_time", S, False), ("closing_time", S, False), ("is_closed", B, False)),
    "patients": _struct(
        ("patient_id", L, False), ("patient_code", S, False), ("name", S, False), ("phone", S, False),
        ("email", S, True), ("gender", S, False), ("date_of_birth", D, True), ("address", S, True),
        ("is_deleted", B, False), ("created_at", TS, True), ("updated_at", TS, True)),
    "patient_medical_history": _struct(
        ("history_id", L, False), ("patient_id", L, False), ("allergies", S, True),
        ("current_medications", S, True), ("medical_notes", S, True), ("updated_at", TS, True)),
    "dentists": _struct(
        ("dentist_id", L, False), ("dentist_code", S, False), ("name", S, False), ("phone", S, False),
        ("email", S, True), ("specialization", S, False), ("is_active", B, False),
        ("created_at", TS, True)),
    "appointments": _struct(
        ("appointment_id", L, False), ("appointment_code", S, False), ("patient_id", L, False),
        ("dentist_id", L, False), ("appointment_date", D, False), ("appointment_time", S, False),
        ("status", S, False), ("problem_description", S, True), ("created_by_user_id", L, True),
        ("created_at", TS, True), ("updated_at", TS, True)),
    "treatments": _struct(
        ("treatment_id", L, False), ("patient_id", L, False), ("dentist_id", L, False),
        ("appointment_id", L, True), ("treatment_name", S, False), ("notes", S, True),
        ("cost", MONEY, False), ("treatment_date", D, False), ("status", S, False),
        ("created_at", TS, True)),
    "bills": _struct(
        ("bill_id", L, False), ("bill_code", S, False), ("patient_id", L, False),
        ("treatment_id", L, True), ("bill_date", D, False), ("subtotal", MONEY, False),
        ("discount_amount", MONEY, False), ("total_amount", MONEY, False), ("status", S, False),
        ("created_by_user_id", L, True), ("created_at", TS, True)),
    "payments": _struct(
        ("payment_id", L, False), ("bill_id", L, False), ("paid_amount", MONEY, False),
        ("payment_date", D, False), ("payment_method", S, False), ("received_by_user_id", L, True),
        ("notes", S, True), ("created_at", TS, True)),
    "medicines": _struct(
        ("medicine_id", L, False), ("medicine_name", S, False), ("batch_no", S, False),
        ("quantity", I, False), ("low_stock_limit", I, False), ("expiry_date", D, False),
        ("created_at", TS, True), ("updated_at", TS, True)),
    "audit_logs": _struct(
        ("log_id", L, False), ("action_type", S, False), ("table_name", S, False),
        ("record_id", L, True), ("old_value", S, True), ("new_value", S, True), ("user_id", L, True),
        ("created_at", TS, True)),
}

TABLES = tuple(SCHEMAS)

# Fixed values of the data model (they must equal the reference's).
ROLES = ["OWNER", "STAFF", "CUSTOMER"]
WEEKDAYS = ["MONDAY", "TUESDAY", "WEDNESDAY", "THURSDAY", "FRIDAY", "SATURDAY", "SUNDAY"]
GENDERS = ["MALE", "FEMALE", "OTHER"]
APPOINTMENT_STATUSES = ["BOOKED", "COMPLETED", "CANCELLED"]
TREATMENT_STATUSES = ["PLANNED", "DONE"]
BILL_STATUSES = ["UNPAID", "PARTIAL", "PAID"]
PAYMENT_METHODS = ["CASH", "CARD", "BANK_TRANSFER"]

# (table, column) -> allowed values, for the domain audit.
DOMAINS = {
    ("users", "role"): ROLES,
    ("clinic_timings", "day_of_week"): WEEKDAYS,
    ("patients", "gender"): GENDERS,
    ("appointments", "status"): APPOINTMENT_STATUSES,
    ("treatments", "status"): TREATMENT_STATUSES,
    ("bills", "status"): BILL_STATUSES,
    ("payments", "payment_method"): PAYMENT_METHODS,
}

# Column defaults applied when a row arrives without the column.
DEFAULTS = {
    ("users", "is_active"): True,
    ("staff_permissions", "can_manage_billing"): False,
    ("staff_permissions", "can_view_reports"): True,
    ("clinic_timings", "is_closed"): False,
    ("patients", "is_deleted"): False,
    ("dentists", "is_active"): True,
    ("appointments", "status"): "BOOKED",
    ("treatments", "cost"): 0,
    ("treatments", "status"): "DONE",
    ("bills", "discount_amount"): 0,
    ("bills", "status"): "UNPAID",
    ("payments", "payment_method"): "CASH",
    ("medicines", "quantity"): 0,
    ("medicines", "low_stock_limit"): 10,
}

# Code prefixes and zero-pad widths (the pad never truncates longer ids).
CODE_FORMATS = {
    "patients": ("PAT-", 5),
    "dentists": ("DEN-", 4),
    "appointments": ("APT-", 5),
    "bills": ("BIL-", 5),
}

# Primary keys and natural keys.
PRIMARY_KEYS = {
    "users": "user_id", "staff_permissions": "permission_id", "clinic": "clinic_id",
    "clinic_timings": "timing_id", "patients": "patient_id",
    "patient_medical_history": "history_id", "dentists": "dentist_id",
    "appointments": "appointment_id", "treatments": "treatment_id", "bills": "bill_id",
    "payments": "payment_id", "medicines": "medicine_id", "audit_logs": "log_id",
}

UNIQUE_KEYS = [
    ("users", ("email",)),
    ("staff_permissions", ("staff_user_id",)),
    ("clinic_timings", ("clinic_id", "day_of_week")),
    ("patients", ("patient_code",)),
    ("patient_medical_history", ("patient_id",)),
    ("dentists", ("dentist_code",)),
    ("appointments", ("appointment_code",)),
    ("bills", ("bill_code",)),
    ("appointments", ("dentist_id", "appointment_date", "appointment_time")),
]

# Foreign keys: (child, column, parent, parent column, on delete).
FOREIGN_KEYS = [
    ("staff_permissions", "staff_user_id", "users", "user_id", "CASCADE"),
    ("clinic_timings", "clinic_id", "clinic", "clinic_id", "CASCADE"),
    ("patient_medical_history", "patient_id", "patients", "patient_id", "CASCADE"),
    ("appointments", "patient_id", "patients", "patient_id", "RESTRICT"),
    ("appointments", "dentist_id", "dentists", "dentist_id", "RESTRICT"),
    ("appointments", "created_by_user_id", "users", "user_id", "SET NULL"),
    ("treatments", "patient_id", "patients", "patient_id", "RESTRICT"),
    ("treatments", "dentist_id", "dentists", "dentist_id", "RESTRICT"),
    ("treatments", "appointment_id", "appointments", "appointment_id", "SET NULL"),
    ("bills", "patient_id", "patients", "patient_id", "RESTRICT"),
    ("bills", "treatment_id", "treatments", "treatment_id", "SET NULL"),
    ("bills", "created_by_user_id", "users", "user_id", "SET NULL"),
    ("payments", "bill_id", "bills", "bill_id", "CASCADE"),
    ("payments", "received_by_user_id", "users", "user_id", "SET NULL"),
    ("audit_logs", "user_id", "users", "user_id", "SET NULL"),
]

# Text length caps applied by the request validators.
TEXT_CAPS = {
    "name": 120, "phone": 30, "email": 120, "gender": 10, "address": 255,
    "allergies": 500, "current_medications": 500, "medical_notes": 1000,
    "specialization": 120, "problem_description": 500, "treatment_name": 120,
    "notes": 1000, "status": 20, "payment_method": 20, "payment_notes": 255,
    "medicine_name": 120, "batch_no": 40, "clinic_name": 120, "whatsapp_number": 30,
}
