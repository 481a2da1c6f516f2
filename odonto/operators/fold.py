"""H1: per-bill payment acceptance in arrival order.

A payment is accepted when its amount is at most the bill's balance left by
the payments accepted before it; a refused payment consumes nothing. That is
a sequential fold per bill, not a running sum (a refused payment would still
count in a running sum).

Plan:
  1. One grouped pass (map-side partial sums) finds the bills whose whole
     batch fits their balance; every payment of those bills is accepted with
     no ordering work at all. That is the usual case.
  2. The other (contended) bills of at most ``BLOCK`` payments are dealt by
     bill, sorted by (bill, seq) and walked as a stream.
  3. Payments of larger bills are sorted by (bill, seq) over all tasks, so a
     bill spans several, and cut into blocks of ``BLOCK``. A block knows what it needs at most and
     its least amount.
  4. One row per block then meets the others of its bill, in order, carrying
     only (bill, balance). A block that fits the balance is accepted whole, one
     whose least amount exceeds it is refused whole. Only the others are
     walked, as arrays: what exceeds the balance now is refused at any later
     turn too, and the rest is accepted up to the first payment that no longer
     fits.
Amounts travel as integer cents so the fold is exact.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odonto.session import shuffles_dropped, stage_files

# The functions below run in Python workers. Ship them by value, so a worker
# does not need this package on its path (numpy and pandas are enough).
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 4096
BLOCK_SCHEMA = ("bill_id long, first_seq long, remaining_cents long, most long, least long, seq array<long>, raw_key array<long>, "
                "cents array<long>, method_ok array<boolean>")
FOLD_SCHEMA = "seq long, accepted boolean, over_balance boolean"
BLOCKS_SCHEMA = "seq array<long>, accepted array<boolean>, over_balance array<boolean>"


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of one bill of payments sorted by (bill, seq), a row per block."""
    for pdf in batches:
        bills = pdf["bill_id"].to_numpy()
        cuts = np.flatnonzero(np.r_[True, bills[1:] != bills[:-1]]) if len(pdf) else np.zeros(0, int)
        rows = []
        for lo, hi in zip(cuts, np.r_[cuts[1:], len(pdf)], strict=True):
            for i in range(lo, hi, BLOCK):
                part = pdf.iloc[i:min(i + BLOCK, hi)]
                raw, cents = part["raw_key"].to_numpy(), part["amount_cents"].to_numpy()
                # A raw key is twice the cents, plus 1 for a part of a cent.
                most = np.maximum((raw + 1) // 2, cents).sum()
                rows.append((bills[i], part["seq"].iloc[0], part["remaining_cents"].iloc[0], most, raw.min(), part["seq"].to_numpy(), raw,
                             cents, part["method_ok"].to_numpy()))
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in BLOCK_SCHEMA.split(", ")])


def _walk(raw: np.ndarray, cents: np.ndarray, ok: np.ndarray, left: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(accepted, over the balance, balance left) of payments in order."""
    accepted, over = np.zeros(len(raw), bool), np.ones(len(raw), bool)
    at = np.flatnonzero(raw <= 2 * left)
    while len(at):
        spent = np.where(ok[at], cents[at], 0)
        fits = raw[at] <= 2 * (left - (np.cumsum(spent) - spent))
        k = len(at) if fits.all() else int(fits.argmin())
        over[at[:k]], accepted[at[:k]] = False, ok[at[:k]]
        left -= int(spent[:k].sum())
        at = at[k + 1:]
        at = at[raw[at] <= 2 * left]
    return accepted, over, left


def _fold_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    bill, left = None, 0
    for pdf in batches:
        rows = []
        for b, start, most, least, seq, raw, cents, ok in zip(*(pdf[c] for c in (
                "bill_id", "remaining_cents", "most", "least", "seq", "raw_key", "cents", "method_ok")), strict=True):
            if b != bill:
                bill, left = b, int(start)
            ok = np.asarray(ok, bool)
            if most <= left:
                left -= int(np.asarray(cents)[ok].sum())
                rows.append((seq, ok, np.zeros(len(ok), bool)))
            elif least > 2 * left:
                rows.append((seq, np.zeros(len(ok), bool), np.ones(len(ok), bool)))
            else:
                accepted, over, left = _walk(np.asarray(raw), np.asarray(cents), ok, left)
                rows.append((seq, accepted, over))
        yield pd.DataFrame(rows, columns=["seq", "accepted", "over_balance"])


def _fold_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    cur_bill, left = None, 0
    for pdf in batches:
        n = len(pdf)
        bills = pdf["bill_id"].to_numpy()
        need2 = pdf["raw_key"].to_numpy()          # 2*floor(raw*100) + (raw has sub-cent part)
        cents = pdf["amount_cents"].to_numpy()
        mok = pdf["method_ok"].to_numpy()
        start = pdf["remaining_cents"].to_numpy()
        acc = np.zeros(n, dtype=bool)
        over = np.zeros(n, dtype=bool)
        for i in range(n):
            if bills[i] != cur_bill:
                cur_bill, left = bills[i], int(start[i])
            if need2[i] > 2 * left:
                over[i] = True
            elif mok[i]:
                acc[i] = True
                left -= int(cents[i])
        yield pd.DataFrame({"seq": pdf["seq"].to_numpy(), "accepted": acc, "over_balance": over})


def fold_payments(cands: DataFrame, balances: DataFrame | None = None) -> DataFrame:
    """Decide each candidate payment.

    ``cands``: seq (unique), bill_id, amount_raw (exact decimal as given),
    amount (DECIMAL(10,2) as stored), method_ok, and ``remaining`` (the
    bill's balance before this batch) unless ``balances`` (bill_id,
    remaining) is given to join it in.
    Returns ``cands`` plus ``accepted`` and ``over_balance`` (refused because
    the amount exceeded the balance left at its turn).
    """
    if balances is not None:
        cands = cands.join(balances.select("bill_id", "remaining"), "bill_id")
    # A balance only shrinks: what exceeds it at the start is refused at any
    # turn, and consumes nothing. That also bounds the amounts below.
    too_much = F.col("amount_raw") > F.col("remaining")
    cols = ["seq", *(c for c in cands.columns if c != "seq")]

    def decided(rows: DataFrame, accepted: bool, over: bool) -> DataFrame:
        return rows.select(*cols, F.lit(accepted).alias("accepted"), F.lit(over).alias("over_balance"))

    never = decided(cands.filter(too_much), False, True)
    raw100 = F.col("amount_raw") * 100
    amount_cents, remaining_cents = ((F.col(x) * 100).cast("long").alias(f"{x}_cents") for x in ("amount", "remaining"))
    raw_key = (F.floor(raw100).cast("long") * 2 + (raw100 != F.floor(raw100)).cast("long")).alias("raw_key")
    c = cands.filter(~too_much)
    # Upper bound of what the bill's batch can consume: ceil of each raw
    # amount in cents (>= the exact amount and >= the stored rounded one).
    need = F.greatest(F.ceil(raw100).cast("long"), amount_cents)
    per_bill = c.groupBy("bill_id").agg(F.sum(need).alias("_need"),
                                        F.min(F.col("method_ok").cast("int")).alias("_all_ok"),
                                        F.first(remaining_cents).alias("_rem"), F.count(F.lit(1)).alias("_n"))
    hard = per_bill.filter((F.col("_all_ok") == 0) | (F.col("_need") > F.col("_rem"))).select("bill_id", "_n")
    # Payments meet their bill once; those of contended bills then have its ``_n``.
    c = stage_files(c.join(hard, "bill_id", "left"))
    fast = decided(c.filter(F.col("_n").isNull()), True, False)

    def contended(bills: Column) -> DataFrame:
        return c.filter(bills).select("bill_id", "seq", raw_key, amount_cents, "method_ok", remaining_cents)

    slow = (contended(F.col("_n") <= BLOCK).repartition("bill_id").sortWithinPartitions("bill_id", "seq")
            .mapInPandas(_fold_batches, FOLD_SCHEMA))
    large = contended(F.col("_n") > BLOCK)
    if not large.isEmpty():
        rows = large.repartitionByRange("bill_id", "seq").sortWithinPartitions("bill_id", "seq")
        blocks = rows.mapInPandas(_blocks, BLOCK_SCHEMA).repartition("bill_id").sortWithinPartitions("bill_id", "first_seq")
        slow = slow.unionByName(blocks.mapInPandas(_fold_blocks, BLOCKS_SCHEMA)
                                .select(F.explode(F.arrays_zip("seq", "accepted", "over_balance")).alias("x")).select("x.*"))
    answers = [x.select("seq", "accepted", "over_balance") for x in (fast, slow, never)]
    with shuffles_dropped(cands.sparkSession):
        several = not cands.groupBy("seq").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1).isEmpty()
    if several:
        # A seq of several rows (a bill held twice) gets each row with each answer.
        return cands.join(answers[0].unionByName(answers[1]).unionByName(answers[2]), "seq")
    # Only contended payments meet their answers by seq; the others carry theirs.
    walked = c.filter(F.col("_n").isNotNull()).select(*cols).join(slow, "seq")
    return fast.unionByName(walked).unionByName(never)
