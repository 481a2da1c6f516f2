"""Replay of appointment changes that depend on one another.

A change can depend on earlier ones of its batch: an earlier change of the
same appointment sets the date or time that it leaves out, and another
appointment's change takes or frees the slot that it wants. ``groups`` finds
which appointments of a batch can meet that way; ``replay`` walks each such
group in arrival order. Everything else is decided without any order.

A group's changes are streamed: a task holds the current rows and held slots of
one group, never its changes.
"""

from __future__ import annotations

import sys
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odonto.operators.components import components
from odonto.operators.schedule import MSG_CLOSED, MSG_DUPLICATE
from odonto.session import stage

# The functions below run in Python workers that need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SLOT = ["dentist_id", "appointment_date", "appointment_time"]
# An appointment's reachable slots are told one by one up to this many,
# beyond it by (dentist, date) or by dentist alone.
TOLD = 64
ROW, HELD, CHANGE = 0, 1, 2
REPLAY_SCHEMA = "seq long, status_code int, reason string, cur_time string"
EVENT_COLS = ["component", "kind", "seq", "appointment_id", "dentist_id", "appointment_date", "appointment_time",
              "status", "open", "close", "closed", "n", "sets_dentist", "sets_date", "sets_time", "sets_status",
              "moves", "any", "pre_code", "pre_reason", "post_code", "post_reason"]


def _keyed(slots: DataFrame, by_day: DataFrame, by_dentist: DataFrame) -> DataFrame:
    """Add ``key``: the slot, or the coarser place it is part of."""
    day, dentist = SLOT[:2], SLOT[:1]
    return (slots.join(by_day.withColumn("_day", F.lit(True)), day, "left")
            .join(by_dentist.withColumn("_den", F.lit(True)), dentist, "left")
            .withColumn("key", F.concat_ws("|", F.col("dentist_id").cast("string"),
                                           F.when(F.col("_den").isNull(), F.col("appointment_date").cast("string")),
                                           F.when(F.col("_den").isNull() & F.col("_day").isNull(), F.col("appointment_time"))))
            .drop("_day", "_den"))


def groups(stored: DataFrame, changes: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Which appointments of a batch must be replayed together.

    ``stored``: the movable appointments' rows (appointment_id and SLOT);
    ``changes``: seq, appointment_id, the SLOT columns (NULL where not set)
    and ``moves``; ``held``: every slot held by an appointment that can't move.
    Returns (appointment_id, component) of the appointments to replay, and the
    held slots (component, SLOT, n) that they could meet.

    The slots an appointment can reach are all combinations of the dentists,
    dates and times that it has or may be given. Where these are more than
    ``TOLD``, it is said to reach whole days of a dentist, or the dentist's
    whole calendar, and everyone's slots in there count as that one place:
    groups become larger, never wrong, and the rows stay linear in the changes.
    Appointments that share a place are joined; one that shares none and has a
    single change needs no replay.
    """
    told = {c: stored.select("appointment_id", c).unionByName(
        changes.filter("moves").filter(F.col(c).isNotNull()).select("appointment_id", c)).distinct() for c in SLOT}
    sizes = None
    for c in SLOT:
        n = told[c].groupBy("appointment_id").agg(F.count(F.lit(1)).alias(f"n_{c}"))
        sizes = n if sizes is None else sizes.join(n, "appointment_id")
    # As doubles: the product of three counts can leave a long.
    days = F.col("n_dentist_id").cast("double") * F.col("n_appointment_date")
    sizes = stage(sizes.select("appointment_id", F.when(days * F.col("n_appointment_time") <= TOLD, 0)
                               .when(days <= TOLD, 1).otherwise(2).alias("level")))
    fine, day, whole = (sizes.filter(F.col("level") == i).select("appointment_id") for i in range(3))
    dentists, dates, times = (told[c] for c in SLOT)
    day_places = day.join(dentists, "appointment_id").join(dates, "appointment_id")
    whole_places = whole.join(dentists, "appointment_id")
    slots = (fine.join(dentists, "appointment_id").join(dates, "appointment_id").join(times, "appointment_id")
             .unionByName(day_places.withColumn("appointment_time", F.lit(None).cast("string")))
             .unionByName(whole_places.withColumn("appointment_date", F.lit(None).cast("date"))
                          .withColumn("appointment_time", F.lit(None).cast("string"))))
    by_day = stage(day_places.select(*SLOT[:2]).distinct())
    by_dentist = stage(whole_places.select("dentist_id").distinct())
    places = stage(_keyed(slots, by_day, by_dentist).select("appointment_id", "key").distinct())
    first = places.groupBy("key").agg(F.min("appointment_id").alias("a"), F.max("appointment_id").alias("_last"))
    shared = first.filter(F.col("a") < F.col("_last")).select("key", "a")
    label = components(places.join(shared, "key").select("a", F.col("appointment_id").alias("b")))
    chained = changes.groupBy("appointment_id").agg(F.count(F.lit(1)).alias("_n"))
    todo = stage(stored.select("appointment_id").join(chained, "appointment_id")
                 .join(label.withColumnRenamed("node", "appointment_id"), "appointment_id", "left")
                 .filter(F.col("component").isNotNull() | (F.col("_n") > 1))
                 .select("appointment_id", F.coalesce("component", "appointment_id").alias("component")))
    wanted = places.join(todo, "appointment_id").select("key", "component").distinct()
    met = (_keyed(held, by_day, by_dentist).join(wanted, "key")
           .groupBy("component", *SLOT).agg(F.count(F.lit(1)).alias("n")))
    return todo, met


def _replay(strict: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        component, rows, held = None, {}, defaultdict(int)
        for pdf in batches:
            out = []
            for e in pdf.itertuples(index=False):
                if e.component != component:
                    component, rows, held = e.component, {}, defaultdict(int)
                slot = (e.dentist_id, e.appointment_date, e.appointment_time)
                if e.kind == HELD:
                    held[slot] += e.n
                elif e.kind == ROW:
                    rows[e.appointment_id] = (slot, e.status, (e.open, e.close, e.closed))
                    held[slot] += strict or e.status != "CANCELLED"
                else:
                    (dentist, date, time), status, hours = rows[e.appointment_id]
                    code, reason = decide(e, time, hours)
                    if code is None and e.any:
                        new = (e.dentist_id if e.sets_dentist else dentist, e.appointment_date if e.sets_date else date,
                               e.appointment_time if e.sets_time else time)
                        new_status = e.status if e.sets_status else status
                        old = (dentist, date, time)
                        was, live = strict or status != "CANCELLED", strict or new_status != "CANCELLED"
                        if live and (e.moves or not was) and held[new] - (was and new == old) > 0:
                            code, reason = 409, MSG_DUPLICATE
                        else:
                            held[old] -= was
                            held[new] += live
                            rows[e.appointment_id] = (new, new_status, (e.open, e.close, e.closed) if e.sets_date else hours)
                    out.append((e.seq, code, reason, time))
            decided = pd.DataFrame(out, columns=["seq", "status_code", "reason", "cur_time"])
            yield decided.astype({"status_code": "Int32"})

    def decide(e, time, hours):
        """The first check that fails before the slot is looked at."""
        if e.pre_code:
            return e.pre_code, e.pre_reason
        if e.sets_date or e.sets_time:
            opens, closes, closed = (e.open, e.close, e.closed) if e.sets_date else hours
            at = e.appointment_time if e.sets_time else time
            if closed:
                return 400, MSG_CLOSED
            if at < opens or at >= closes:
                return 400, f"Appointment time must be between {opens[:5]} and {closes[:5]}"
        return (e.post_code, e.post_reason) if e.post_code else (None, None)

    return run


def replay(events: DataFrame, strict: bool = True) -> DataFrame:
    """Decide each change of ``events`` (EVENT_COLS) in its group's order.

    Per group the stored rows (kind ROW) and slots held by others (HELD) come
    first, then the changes by seq. ``open`` / ``close`` / ``closed`` are the
    clinic's hours on the row's own date, or on the date that a change sets.
    With ``strict`` a cancelled appointment still holds its slot.
    Returns seq, status_code and reason (NULL: accepted), and ``cur_time``, the
    appointment's time just before the change.
    """
    return (events.select(*EVENT_COLS).repartition("component").sortWithinPartitions("component", "kind", "seq")
            .mapInPandas(_replay(strict), REPLAY_SCHEMA))
