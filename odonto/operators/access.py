"""Access gates G1 (billing) and G2 (owner only) over request callers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed messages of the access rules.
MSG_OWNER_ONLY = "Only owner can perform this action"
MSG_ROLE_NO_BILLING = "Billing is not available for this role"
MSG_STAFF_NO_BILLING = "Staff billing access is disabled"


def caller_role(c="caller_role") -> Column:
    """Header role: missing or empty -> OWNER, upper-cased."""
    x = F.col(c) if isinstance(c, str) else c
    return F.upper(F.when(x.isNull() | (x == ""), F.lit("OWNER")).otherwise(x))


def caller_id(c="caller_id") -> Column:
    """Header user id: missing or empty -> 1; a text that is no number is no user (NULL)."""
    x = (F.col(c) if isinstance(c, str) else c).cast("string")
    return F.when(x.isNull() | (x == ""), F.lit(1).cast("long")).otherwise(x.try_cast("double").try_cast("long"))


def billing_access(t, callers: DataFrame) -> DataFrame:
    """G1 per caller row: ``billing_allowed`` and the refusal reason.

    OWNER: allowed. STAFF: allowed when its permission row grants billing (no
    row -> refused). Any other role: refused. ``callers`` keeps its columns;
    it needs ``caller_id`` and ``caller_role``.
    """
    # One row per staff user (the unique key), so a duplicate row can never
    # multiply the requests it is joined to.
    sp = t.staff_permissions.groupBy(F.col("staff_user_id").alias("_uid")).agg(
        F.max("can_manage_billing").alias("_can_bill"))
    c = callers.withColumn("_role", caller_role()).withColumn("_uid", caller_id())
    j = c.join(sp, "_uid", "left")
    allowed = (F.col("_role") == "OWNER") | ((F.col("_role") == "STAFF") & F.coalesce("_can_bill", F.lit(False)))
    reason = (F.when(F.col("_role") == "OWNER", F.lit(None))
              .when(F.col("_role") != "STAFF", F.lit(MSG_ROLE_NO_BILLING))
              .when(~F.coalesce("_can_bill", F.lit(False)), F.lit(MSG_STAFF_NO_BILLING)))
    return (j.withColumn("billing_allowed", allowed).withColumn("access_reason", reason)
            .drop("_role", "_uid", "_can_bill"))


def owner_only(role_col="caller_role") -> Column:
    """True when the caller is the owner."""
    return caller_role(role_col) == "OWNER"
