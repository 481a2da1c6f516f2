"""Integrity constraints re-aimed as data-quality audits.

Each rule family returns rows ``(table_name, rule, record_key, detail)``;
``audit(t)`` unions them. Every rule is one scan with a filter, one grouped
count, or one anti join, so each grows linearly with its table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odonto.functions.exprs import derived_bill_status
from odonto.schemas import DOMAINS, FOREIGN_KEYS, PRIMARY_KEYS, SCHEMAS, UNIQUE_KEYS

OUT_COLS = ["table_name", "rule", "record_key", "detail"]


def _rows(df: DataFrame, table: str, rule: str, key, detail) -> DataFrame:
    return df.select(F.lit(table).alias("table_name"), F.lit(rule).alias("rule"),
                     key.cast("string").alias("record_key"), detail.cast("string").alias("detail"))


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def not_null(t) -> DataFrame:
    """A row per (record, NOT NULL column holding NULL); one scan per table."""
    out = []
    for table, schema in SCHEMAS.items():
        req = [f.name for f in schema.fields if not f.nullable]
        df = t[table]
        missing = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in req]),
                           lambda x: x.isNotNull())
        bad = df.select(F.col(PRIMARY_KEYS[table]).alias("_k"), missing.alias("_m")).filter(F.size("_m") > 0)
        out.append(_rows(bad.select("_k", F.explode("_m").alias("_c")), table, "NOT_NULL",
                         F.col("_k"), F.col("_c")))
    return _union(out)


def unique(t, only=None) -> DataFrame:
    """Key values held by more than one row, with the row count.

    A grouped count with map-side partial aggregation: a hot key costs one
    partial row per task, not one row per record.
    """
    out = []
    for table, cols in UNIQUE_KEYS:
        if only and (table, cols) not in only:
            continue
        # Texts that differ in case only are the same key, as under the
        # reference's collation; the key is told by its least spelling.
        text = {f.name for f in t[table].schema.fields if f.dataType.typeName() == "string"}
        keys = [(F.lower(c) if c in text else F.col(c)).alias(f"_{c}") for c in cols]
        g = t[table].groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
        if text & set(cols):
            # The least spelling, looked up for the keys that are held twice only.
            rows = t[table].select(*keys, *cols).join(g, [f"_{c}" for c in cols])
            g = rows.groupBy(*[f"_{c}" for c in cols]).agg(F.max("_n").alias("_n"), *[F.min(c).alias(c) for c in cols])
        else:
            g = g.withColumnsRenamed({f"_{c}": c for c in cols})
        key = F.concat_ws("|", *[F.col(c).cast("string") for c in cols])
        out.append(_rows(g, table, "UNIQUE(" + ",".join(cols) + ")", key, F.col("_n")))
    return _union(out)


def unique_slot(t) -> DataFrame:
    """D2 for the dentist slot index alone (dentist, date, time)."""
    return unique(t, only=[("appointments", ("dentist_id", "appointment_date", "appointment_time"))])


def checks(t) -> DataFrame:
    """D3: CHECK constraints (a row per violating record and check)."""
    rules = [
        ("clinic_timings", "CHECK(opening_time < closing_time)", ~(F.col("opening_time") < F.col("closing_time"))),
        ("patients", "CHECK(LENGTH(phone) >= 7)", ~(F.octet_length("phone") >= 7)),
        ("treatments", "CHECK(cost >= 0)", ~(F.col("cost") >= 0)),
        ("bills", "CHECK(amounts >= 0)",
         ~((F.col("subtotal") >= 0) & (F.col("discount_amount") >= 0) & (F.col("total_amount") >= 0))),
        ("payments", "CHECK(paid_amount > 0)", ~(F.col("paid_amount") > 0)),
        ("medicines", "CHECK(quantity >= 0 AND low_stock_limit >= 0)",
         ~((F.col("quantity") >= 0) & (F.col("low_stock_limit") >= 0))),
    ]
    return _union([_rows(t[tb].filter(cond), tb, rule, F.col(PRIMARY_KEYS[tb]), F.lit(None))
                   for tb, rule, cond in rules])


def domains(t) -> DataFrame:
    """ENUM columns holding a value outside their domain."""
    return _union([
        _rows(t[tb].filter(F.col(c).isNotNull() & ~F.col(c).isin(vals)), tb, f"ENUM({c})",
              F.col(PRIMARY_KEYS[tb]), F.col(c))
        for (tb, c), vals in DOMAINS.items()])


def orphans(t) -> DataFrame:
    """Non-NULL foreign keys with no parent row.

    The references to one parent table are unioned first, so each parent's
    keys are read and shuffled once (one anti join per parent table, not one
    per foreign key).
    """
    out = []
    for parent in dict.fromkeys(p for _, _, p, _, _ in FOREIGN_KEYS):
        refs = [t[child].select(F.lit(child).alias("_child"), F.lit(f"FK({col})->{parent}").alias("_rule"),
                                F.col(PRIMARY_KEYS[child]).alias("_k"), F.col(col).cast("long").alias("_fk"))
                .filter(F.col("_fk").isNotNull())
                for child, col, par, _, _ in FOREIGN_KEYS if par == parent]
        pcol = [pc for _, _, par, pc, _ in FOREIGN_KEYS if par == parent][0]
        keys = t[parent].select(F.col(pcol).cast("long").alias("_fk"))
        bad = _union(refs).join(keys, "_fk", "left_anti")
        out.append(bad.select(F.col("_child").alias("table_name"), F.col("_rule").alias("rule"),
                              F.col("_k").cast("string").alias("record_key"),
                              F.col("_fk").cast("string").alias("detail")))
    return _union(out)


def bill_status(t) -> DataFrame:
    """Bills whose stored status differs from the one their payments imply."""
    b = t.bills.select("bill_id", "total_amount", "status")
    paid = t.payments.groupBy("bill_id").agg(F.sum("paid_amount").alias("_paid"),
                                            F.count(F.lit(1)).alias("_n"))
    j = b.join(paid, "bill_id", "left")
    derived = derived_bill_status(F.coalesce("_paid", F.lit(0)), F.col("total_amount"),
                                  F.coalesce(F.col("_n"), F.lit(0)) > 0)
    bad = j.withColumn("_derived", derived).filter(F.col("_derived") != F.col("status"))
    return _rows(bad, "bills", "DERIVED_STATUS", F.col("bill_id"),
                 F.concat(F.col("status"), F.lit("->"), F.col("_derived")))


def audit(t) -> DataFrame:
    """All rule families in one frame."""
    return _union([not_null(t), unique(t), checks(t), domains(t), orphans(t), bill_status(t)])


# --- D6: delete propagation -----------------------------------------------

def delete_with_actions(t, table: str, keys: DataFrame):
    """Delete ``keys`` (a frame of the table's primary key) with the declared actions.

    Returns ``(report, snapshot)``. A key some RESTRICT child still references
    is refused (the first such child in declaration order is the reason);
    the other keys are deleted, CASCADE children are deleted with them (and
    their own children, transitively), SET NULL children lose the reference.
    """
    pk = PRIMARY_KEYS[table]
    k = keys.select(F.col(pk)).distinct()
    rejected = None
    for child, col, parent, pcol, action in FOREIGN_KEYS:
        if parent != table or action != "RESTRICT":
            continue
        refs = k.join(t[child].select(F.col(col).alias(pk)), pk, "left_semi").withColumn(
            "_reason", F.lit(f"referenced by {child}.{col}"))
        rejected = refs if rejected is None else rejected.unionByName(
            refs.join(rejected.select(pk), pk, "left_anti"))
    if rejected is None:
        rejected = k.limit(0).withColumn("_reason", F.lit(None).cast("string"))
    deleted = k.join(rejected.select(pk), pk, "left_anti")

    report = [
        rejected.select(F.lit(table).alias("table_name"), F.col(pk).cast("string").alias("record_key"),
                        F.lit("REJECTED").alias("action"), F.col("_reason").alias("detail")),
        deleted.select(F.lit(table).alias("table_name"), F.col(pk).cast("string").alias("record_key"),
                       F.lit("DELETED").alias("action"), F.lit(None).cast("string").alias("detail")),
    ]
    new = {table: t[table].join(deleted, pk, "left_anti")}
    frontier = [(table, deleted.select(F.col(pk).alias("_id")))]
    while frontier:
        ptable, pids = frontier.pop()
        for child, col, parent, pcol, action in FOREIGN_KEYS:
            if parent != ptable:
                continue
            ck = PRIMARY_KEYS[child]
            base = new.get(child, t[child])
            hit = base.join(pids.withColumnRenamed("_id", col), col, "left_semi")
            if action == "CASCADE":
                report.append(hit.select(F.lit(child).alias("table_name"), F.col(ck).cast("string").alias("record_key"),
                                         F.lit("CASCADE_DELETED").alias("action"), F.lit(col).alias("detail")))
                new[child] = base.join(hit.select(ck), ck, "left_anti")
                frontier.append((child, hit.select(F.col(ck).alias("_id"))))
            elif action == "SET NULL":
                report.append(hit.select(F.lit(child).alias("table_name"), F.col(ck).cast("string").alias("record_key"),
                                         F.lit("SET_NULL").alias("action"), F.lit(col).alias("detail")))
                ids = pids.select(F.col("_id").alias("_null_me"))
                j = base.join(ids, base[col] == ids["_null_me"], "left")
                new[child] = j.withColumn(col, F.when(F.col("_null_me").isNull(), F.col(col))).drop("_null_me")
    return _union(report), t.replace(**new)
