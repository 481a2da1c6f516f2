"""S4 with W12 as a stream: payment requests decided as they arrive.

JSON request files stream in, typed (``sources.bodies``); malformed lines get no
answer here, ``start_quarantine`` sets them apart. What can be said of a request by
itself (caller, amount, method) is checked as in the batch job; then the requests
meet their bill's balance in a keyed state (``transformWithState``, RocksDB). A
state row holds ``BILLS_PER_BLOCK`` consecutive bills, so a trigger reads and writes
once per block it touches, not once per bill. It holds their balances, which start
as the snapshot's, and the verdicts given so far, so that a request sent again gets
its first answer and pays nothing.

Requests of one trigger are applied by seq, those of later triggers after them.
However a file of requests is cut into consecutive parts, the answers are those
of ``jobs.add_payments`` on the whole. A task holds one block's requests of one
trigger as arrays (17 bytes each beside the texts): ``bytes_per_trigger`` bounds it.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from odonto.operators.access import billing_access
from odonto.operators.fold import _walk
from odonto.operators.ids import assign_ids, max_id
from odonto.plans.jobs import _date, _ts, checked_payments, parsed_payments
from odonto.plans.views import billing_summary
from odonto.sources.bodies import BODIES, read_bodies
from odonto.streaming.bill_status import ROCKSDB, _scratch

# The processor runs in Python workers that need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ACCEPTED, OVER, REFUSED, NO_BILL = range(4)
BILLS_PER_BLOCK = 512
# So many verdicts lie beside a block's balances; older ones are kept in runs of so many.
RUN = 4096
BALANCE = np.dtype([("bill_id", "<i8"), ("cents", "<i8")])
VERDICT = np.dtype([("bill_id", "<i8"), ("seq", "<i8"), ("verdict", "u1")])
FENCE = np.dtype([("low", "<i8"), ("high", "<i8")])
DECIDED_SCHEMA = ("seq long, bill_id long, cents long, payment_method string, received_by_user_id long, notes string, "
                  "ins_code int, ins_reason string, verdict int, again boolean")
# Far above any balance (DECIMAL(10,2)), and small enough for a long in cents.
TOO_MUCH = 10 ** 12
# Requests refused before their bill is looked at pass through so many groups of
# their own (blocks below 0), so that the lines are read and parsed once only.
PASSING = 4096
# Stands for NULL in their long columns, which pandas would turn into floats.
NONE = -(1 << 63)


class BillBalance(StatefulProcessor):
    """Applies the payments of a block's bills by seq."""

    def init(self, handle) -> None:
        # The latest verdicts lie beside the balances: one read and one write a
        # trigger. More go to runs, with a fence each: the seqs that it spans.
        self.block = handle.getValueState("block", "balances binary, latest binary, fences binary")
        self.runs = handle.getMapState("runs", "run long", "packed binary")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        # A block's rows can come in several calls.
        balances = np.zeros(len(initialState), BALANCE)
        balances["bill_id"], balances["cents"] = initialState["bill_id"], initialState["cents"]
        if (state := self.block.get()) is not None:
            balances = np.concatenate([np.frombuffer(state[0], BALANCE), balances])
        _, first = np.unique(balances["bill_id"], return_index=True)
        self.block.update((balances[first].tobytes(), b"", b""))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if key[0] < 0:
            for pdf in rows:
                yield (pdf.drop(columns=["raw_key", "row_ok", "block"], errors="ignore")
                       .assign(verdict=np.full(len(pdf), REFUSED, "int32"), again=False))
            return
        pdf = pd.concat(list(rows), ignore_index=True)
        order = np.lexsort((pdf["seq"], pdf["bill_id"]))
        bill, seq = pdf["bill_id"].to_numpy()[order], pdf["seq"].to_numpy()[order]
        head = np.r_[True, (bill[1:] != bill[:-1]) | (seq[1:] != seq[:-1])]
        first, bill, seq = order[head], bill[head], seq[head]
        back = np.empty(len(pdf), int)
        back[order] = np.cumsum(head) - 1
        verdict = np.full(len(seq), NO_BILL, np.uint8)
        known = np.zeros(len(seq), bool)
        if (state := self.block.get()) is not None:
            balances, latest, fences = (np.frombuffer(x, d) for x, d in zip(state, (BALANCE, VERDICT, FENCE), strict=True))
            given = np.concatenate([latest, *self._runs_with(fences, seq)])
            if len(given):
                answered = pd.DataFrame({"bill_id": bill, "seq": seq}).merge(pd.DataFrame(given), "left", ["bill_id", "seq"])["verdict"]
                known = answered.notna().to_numpy()
                verdict[known] = answered[known]
            at = np.searchsorted(balances["bill_id"], bill)
            here = balances["bill_id"][np.minimum(at, len(balances) - 1)] == bill
            new = here & ~known
            if new.any():
                asked = pdf.iloc[first[new]]
                accepted, over, left = _settle(at[new], asked["raw_key"].to_numpy(), asked["cents"].to_numpy(),
                                               asked["row_ok"].to_numpy(dtype=bool), balances["cents"])
                verdict[new] = np.where(over, OVER, np.where(accepted, ACCEPTED, REFUSED))
                fresh = np.zeros(new.sum(), VERDICT)
                fresh["bill_id"], fresh["seq"], fresh["verdict"] = bill[new], seq[new], verdict[new]
                balances, latest = balances.copy(), np.concatenate([latest, fresh])
                balances["cents"] = left
                if len(latest) > RUN:
                    latest, fences = latest[:0], self._spill(latest, fences)
                self.block.update((balances.tobytes(), latest.tobytes(), fences.tobytes()))
        again = known[back] | (np.arange(len(pdf)) != first[back])
        out = pdf.drop(columns=["raw_key", "row_ok", "block"], errors="ignore")
        out["verdict"], out["again"] = verdict[back].astype("int32"), again
        yield out

    def _runs_with(self, fences: np.ndarray, seq: np.ndarray) -> list[np.ndarray]:
        """The runs that can hold any of the seqs."""
        seq = np.sort(seq)
        inside = np.searchsorted(seq, fences["low"]) < np.searchsorted(seq, fences["high"], "right")
        return [np.frombuffer(self.runs.getValue((r,))[0], VERDICT) for r in np.flatnonzero(inside).tolist()]

    def _spill(self, verdicts: np.ndarray, fences: np.ndarray) -> np.ndarray:
        verdicts, added = np.sort(verdicts, order="seq"), []
        for i in range(0, len(verdicts), RUN):
            part = verdicts[i:i + RUN]
            self.runs.updateValue((len(fences) + len(added),), (part.tobytes(),))
            added.append((part["seq"][0], part["seq"][-1]))
        return np.concatenate([fences, np.array(added, FENCE)])


def _settle(at: np.ndarray, raw: np.ndarray, cents: np.ndarray, ok: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, ...]:
    """(accepted, over the balance, balances left) of payments sorted by bill and seq;
    ``at`` is the place of each one's bill in ``left``."""
    left = left.copy()
    cuts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    ends = np.r_[cuts[1:], len(at)]
    bills = at[cuts]
    # A raw key is twice the cents, plus 1 for a part of a cent. What exceeds the
    # balance by itself counts as just above it, so that the sum stays a long.
    need = np.minimum(np.maximum((raw + 1) // 2, cents), np.maximum(left[at], 0) + 1)
    fits = np.add.reduceat(need, cuts) <= left[bills]
    some = np.minimum.reduceat(raw, cuts) <= 2 * left[bills]
    whole = np.repeat(fits, ends - cuts)
    accepted, over = whole & ok, ~whole
    left[bills[fits]] -= np.add.reduceat(np.where(ok, cents, 0), cuts)[fits]
    for bill, lo, hi in zip(*(x[~fits & some] for x in (bills, cuts, ends)), strict=True):
        accepted[lo:hi], over[lo:hi], left[bill] = _walk(raw[lo:hi], cents[lo:hi], ok[lo:hi], int(left[bill]))
    return accepted, over, left


def _block() -> Column:
    return F.floor(F.col("bill_id") / BILLS_PER_BLOCK).cast("long")


def decide_payments(t, requests: DataFrame) -> DataFrame:
    """Stream of (seq, status_code, reason, again, and the payment's values) for a
    stream of request rows. ``again`` marks an answer already given; only an
    accepted one (201) that isn't ``again`` is a payment."""
    users = t.users.select(F.col("user_id").alias("received_by_user_id")).distinct().withColumn("_user_ok", F.lit(True))
    r = billing_access(t, parsed_payments(requests)).join(users, "received_by_user_id", "left")
    r = checked_payments(r.withColumn("_user_ok", F.coalesce("_user_ok", F.lit(False))))
    raw = F.least(F.col("amount_raw"), F.lit(TOO_MUCH)) * 100
    passing, none = F.col("_pre_code").isNotNull(), F.lit(NONE)
    todo = r.select(
        "seq", F.coalesce("bill_id", none).alias("bill_id"),
        F.coalesce((F.col("paid_amount") * 100).cast("long"), F.when(passing, none).otherwise(0)).alias("cents"), "payment_method",
        F.coalesce("received_by_user_id", F.when(passing, none).otherwise(-1)).alias("received_by_user_id"), "notes",
        F.coalesce("_pre_code", "_ins_code", F.lit(0)).alias("ins_code"),
        F.when(passing, F.col("_pre_reason")).otherwise(F.col("_ins_reason")).alias("ins_reason"),
        (F.floor(raw).cast("long") * 2 + (raw != F.floor(raw)).cast("long")).alias("raw_key"),
        F.col("_ins_code").isNull().alias("row_ok"),
        F.when(passing, -1 - F.pmod(F.xxhash64("seq"), F.lit(PASSING))).otherwise(_block()).alias("block"))
    balances = (billing_summary(t).select("bill_id", (F.col("remaining_balance") * 100).cast("long").alias("cents"), _block().alias("block"))
                .filter(F.col("bill_id").isNotNull() & F.col("cents").isNotNull()))
    d = todo.groupBy("block").transformWithStateInPandas(
        BillBalance(), outputStructType=DECIDED_SCHEMA, outputMode="Append", timeMode="None",
        initialState=balances.groupBy("block"))
    v = F.col("verdict")
    given = lambda c: F.when(F.col(c) != NONE, F.col(c))
    return d.select(
        "seq", F.when(v == ACCEPTED, 201).when(v == OVER, 400).when(v == NO_BILL, 404).otherwise(F.col("ins_code")).alias("status_code"),
        F.when(v == OVER, "Payment is greater than remaining balance").when(v == NO_BILL, "Bill not found")
        .when(v == REFUSED, F.col("ins_reason")).alias("reason"),
        "again", given("bill_id").alias("bill_id"), (given("cents").cast("decimal(20,0)") / 100).cast("decimal(10,2)").alias("paid_amount"),
        "payment_method", given("received_by_user_id").alias("received_by_user_id"), "notes")


def start_payments(t, source: str, sink: str, checkpoint: str, available_now: bool = True,
                   files_per_trigger: int | None = None, bytes_per_trigger: int | None = None):
    """Answer the JSON request files under ``source`` into Parquet under ``sink``.

    A restart with the same ``checkpoint`` goes on with the balances it left;
    ``t`` gives the opening balances on the first start only."""
    spark = t.spark
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKSDB:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    requests = read_bodies(spark, source, BODIES["add_payments"], streaming=True, files_per_trigger=files_per_trigger,
                           bytes_per_trigger=bytes_per_trigger)
    w = (decide_payments(t, requests).writeStream.format("parquet").option("path", sink)
         .option("checkpointLocation", checkpoint).outputMode("append"))
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")).start()


def payments_of(t, answers: DataFrame, as_of) -> DataFrame:
    """The payment rows of all answers so far, with ids in seq order."""
    ok = answers.filter((F.col("status_code") == 201) & ~F.col("again"))
    return assign_ids(ok, "payment_id", max_id(t.payments, "payment_id")).select(
        "payment_id", "bill_id", "paid_amount", _date(as_of).alias("payment_date"), "payment_method",
        "received_by_user_id", "notes", _ts(as_of).alias("created_at"))


def write_request_files(requests: DataFrame, path: str) -> None:
    """Requests as JSON lines, one object each, as ``read_bodies`` reads them."""
    requests.select(F.to_json(F.struct(*requests.columns)).alias("value")).write.mode("append").text(path)


def stream_add_payments(t, requests: DataFrame, **per_trigger: int | None) -> DataFrame:
    """End to end: the requests are written as JSON files in the shared folder and
    streamed until caught up; returns all answers."""
    spark: SparkSession = t.spark
    src, sink, ckpt = _scratch(spark, "payreq-src"), _scratch(spark, "payreq-answers"), _scratch(spark, "payreq-ckpt")
    write_request_files(requests, src)
    q = start_payments(t, src, sink, ckpt, **per_trigger)
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return spark.read.parquet(sink)
