"""Keyed update (S7), keyed upsert (S8) and sparse-patch merge (VL4).

A patch row names a key and, per field, a value plus a presence flag
``has_<field>``. Absent is not NULL: an absent field leaves the stored value
alone, a present NULL writes NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odonto.operators.ids import assign_ids, max_id


def has(f: str) -> str:
    return f"has_{f}"


def merge_patches(patches: DataFrame, key: str, fields: list[str], order_col: str = "seq") -> DataFrame:
    """VL4: fold several patches per key into one, latest present value per field.

    ``max_by(value, seq)`` over only the rows carrying the field (a NULL
    ordering is skipped), as a grouped aggregate with map-side partial
    aggregation: a key patched a million times costs one partial row per task.
    """
    aggs = []
    for f in fields:
        aggs.append(F.max_by(F.col(f), F.when(F.col(has(f)), F.col(order_col))).alias(f))
        aggs.append(F.max(F.col(has(f)).cast("int")).cast("boolean").alias(has(f)))
    aggs.append(F.max(order_col).alias("_last_seq"))
    aggs.append(F.min(order_col).alias("_first_seq"))
    return patches.groupBy(key).agg(*aggs)


def apply_patch(base: DataFrame, patch: DataFrame, key: str, fields: list[str],
                stamp: tuple[str, Column] | None = None, patch_key: str | None = None) -> DataFrame:
    """New snapshot of ``base`` with merged ``patch`` rows applied by key.

    ``stamp`` = (column, value) is set on every row a patch touched (any
    field present), like ``updated_at = NOW()``. Keys without a base row are
    ignored (an UPDATE that matches nothing). One left join by key.
    """
    pk = patch_key or key
    p = patch.select(F.col(pk).alias(key), *[F.col(f).alias(f"_p_{f}") for f in fields],
                     *[F.col(has(f)).alias(f"_h_{f}") for f in fields])
    j = base.join(p, key, "left")
    touched = None
    cols = []
    for c in base.columns:
        if c in fields:
            h = F.coalesce(F.col(f"_h_{c}"), F.lit(False))
            cols.append(F.when(h, F.col(f"_p_{c}").cast(base.schema[c].dataType)).otherwise(F.col(c)).alias(c))
            touched = h if touched is None else (touched | h)
        else:
            cols.append(F.col(c))
    out = j.select(*cols, (touched if touched is not None else F.lit(False)).alias("_touched"))
    if stamp is not None:
        sc, sv = stamp
        out = out.withColumn(sc, F.when(F.col("_touched"), sv.cast(base.schema[sc].dataType)).otherwise(F.col(sc)))
    return out.drop("_touched")


def upsert(base: DataFrame, rows: DataFrame, key: str, id_col: str, fields: list[str],
           order_col: str = "seq", stamp: tuple[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """Update rows whose ``key`` exists in ``base``, insert the others.

    ``rows`` holds one row per key (already merged) with ``fields`` and
    ``order_col``; inserted rows get fresh ``id_col`` values after the
    current maximum, in ``order_col`` order. Returns (snapshot, inserted).
    """
    existing = base.select(key)
    upd = rows.join(existing, key, "left_semi")
    ins = rows.join(existing, key, "left_anti")
    patched = apply_patch(base, upd.select(key, *fields, *[F.lit(True).alias(has(f)) for f in fields]),
                          key, fields, stamp)
    new = assign_ids(ins, id_col, max_id(base, id_col), order_col)
    new_cols = []
    for f in base.schema.fields:
        if f.name in new.columns:
            new_cols.append(F.col(f.name).cast(f.dataType))
        elif stamp is not None and f.name == stamp[0]:
            new_cols.append(stamp[1].cast(f.dataType).alias(f.name))
        else:
            new_cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    inserted = new.select(*new_cols)
    return patched.unionByName(inserted), inserted
