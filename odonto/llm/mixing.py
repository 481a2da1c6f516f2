"""Operator 5: mix sources to target weights, block by block.

1. Each source's words form one stream (documents in hash-bucket order), cut
   into blocks of a fixed number of words; the last block may be shorter.
2. Targets: sources share the corpus size by weight, at most ``MOST`` times
   their own size each, the excess reshared by weight among the rest.
3. Every output shard draws its source counts from a multinomial. Summed over
   shards they miss each source's number of blocks by chance; the surplus
   slots of overdrawn sources are handed to the underdrawn ones, so each
   source fills exactly the whole blocks nearest its target.
4. The j-th slot of a source takes block ``perm(j mod blocks)`` of its pass
   ``j div blocks``, a keyed pseudorandom permutation per source and pass, so
   within a pass no block is taken twice. Slots and blocks join by index.

Everything is a function of the seed and the rows, so reruns agree.

Defined results: a null text has size 0; a null source is a source of its
own, last in order; null ids are kept; repeated rows are documents of their
own; an empty table gives no rows; sources without words get target 0; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from odonto.llm.common import count_words, ship_by_value, stage, task_count

ship_by_value(__name__)

BLOCK_WORDS = 128
SHARD_SLOTS = 1024
MOST = 3
SEED = 20240115


def mix64(x: np.ndarray) -> np.ndarray:
    """Mix 64-bit numbers (an invertible multiply-and-shift finaliser)."""
    x = x.astype(np.uint64)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (29, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(32))


def permute(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Pseudorandom permutation of range(size) per key, at each index.

    A four-round Feistel network over the next even number of bits; values
    that fall outside the range walk on along their cycle.
    """
    size = np.maximum(size.astype(np.uint64), np.uint64(1))
    bits = np.zeros(len(size), dtype=np.uint64)
    while (short := (np.uint64(1) << (np.uint64(2) * bits)) < size).any():
        bits += short.astype(np.uint64)
    low = (np.uint64(1) << bits) - np.uint64(1)
    out, todo = index.astype(np.uint64).copy(), np.arange(len(index))
    while len(todo):
        x, b, m, k = out[todo], bits[todo], low[todo], key[todo].astype(np.uint64)
        left, right = x >> b, x & m
        for r in range(4):
            left, right = right, left ^ (mix64(right + k * np.uint64(4) + np.uint64(r)) & m)
        out[todo] = (left << b) | right
        todo = todo[out[todo] >= size[todo]]
    return out.astype(np.int64)


def share(sizes: list[int], weights: list[float], most: int = MOST) -> list[float]:
    """Targets that share the total by weight, each at most ``most`` sizes."""
    target = [0.0] * len(sizes)
    free, rest = [i for i, n in enumerate(sizes) if n], float(sum(sizes))
    while free:
        unit = rest / sum(weights[i] for i in free)
        over = [i for i in free if unit * weights[i] > most * sizes[i]]
        if not over:
            for i in free:
                target[i] = unit * weights[i]
            break
        for i in over:
            target[i] = float(most * sizes[i])
            rest -= target[i]
        free = [i for i in free if i not in set(over)]
    return target


@dataclass
class Mix:
    """What a mix consists of.

    sources: rows of (source, size, target, blocks, slots), by source order.
    sized: documents (doc_id, source, key, size, start) with their place in
        the source's stream.
    slots: (shard, position, s, pass, block): the output, slot by slot.
    fragments: (s, block, key, start, first, words): which words of which
        document (identified by s and its start) a block holds.
    """
    sources: list[tuple]
    sized: DataFrame
    slots: DataFrame
    fragments: DataFrame


def _streamed(sized: DataFrame, per_bucket: int = 1 << 16) -> DataFrame:
    """Add ``start``: words of the source before the document.

    Documents are dealt into hash buckets; windows run inside one (source,
    bucket) and over the buckets' sums, so a source that holds most rows is
    spread over all buckets.
    """
    n = sized.count()
    buckets = task_count(sized.sparkSession, n, per_bucket)
    b = sized.withColumn("_b", F.pmod(F.xxhash64("doc_id", "key", "copy"), F.lit(buckets)).cast("int"))
    sums = b.groupBy("s", "_b").agg(F.sum("size").alias("_n"))
    before = Window.partitionBy("s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("s", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    inside = (Window.partitionBy("s", "_b").orderBy("doc_id", "key", "copy")
              .rowsBetween(Window.unboundedPreceding, -1))
    return (b.withColumn("_w", F.coalesce(F.sum("size").over(inside), F.lit(0)))
            .join(offsets, ["s", "_b"]).withColumn("start", F.col("_o") + F.col("_w")).drop("_b", "_w", "_o"))


def _slots(spark, blocks: np.ndarray, need: np.ndarray, shard_slots: int, seed: int, per_task: int = 64) -> DataFrame:
    """(shard, position, s, pass, block) of every output slot."""
    total = int(need.sum())
    shards = -(-total // shard_slots)
    odds = need / max(total, 1)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for shard in pdf["id"]:
                rng = np.random.Generator(np.random.Philox(key=[seed, int(shard)]))
                n = min(shard_slots, total - int(shard) * shard_slots)
                counts = rng.multinomial(n, odds)
                s = np.flatnonzero(counts)
                yield pd.DataFrame({"shard": int(shard), "s": s.astype("int32"), "n": counts[s]})

    drawn = stage(spark.range(0, shards, 1, task_count(spark, shards, per_task)).mapInPandas(draw, "shard long, s int, n long"), "draws")
    # Slots of the source in earlier shards: a prefix sum in two levels.
    part = F.floor(F.col("shard") / 1024)
    sums = drawn.groupBy("s", part.alias("_p")).agg(F.sum("n").alias("_n"))
    before = Window.partitionBy("s").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("s", "_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    inside = Window.partitionBy("s", "_p").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = (drawn.withColumn("_p", part).withColumn("_w", F.coalesce(F.sum("n").over(inside), F.lit(0)))
              .join(offsets, ["s", "_p"]).select("shard", "s", "n", (F.col("_o") + F.col("_w")).alias("base")))
    got = np.zeros(len(need), dtype=np.int64)
    for r in drawn.groupBy("s").agg(F.sum("n").alias("n")).collect():      # one row per source
        got[r["s"]] = r["n"]
    surplus, lack = np.maximum(got - need, 0), np.maximum(need - got, 0)
    surplus_from, lack_to = np.cumsum(surplus) - surplus, np.cumsum(lack)

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n = pdf["n"].to_numpy()
            s = np.repeat(pdf["s"].to_numpy().astype(np.int64), n)
            shard = np.repeat(pdf["shard"].to_numpy(), n)
            step = np.arange(len(s)) - np.repeat(np.cumsum(n) - n, n)
            drawn_at = np.repeat(pdf["base"].to_numpy(), n) + step
            j, to = drawn_at.copy(), s.copy()
            if (extra := np.flatnonzero(drawn_at >= need[s])).size:
                u = surplus_from[s[extra]] + drawn_at[extra] - need[s[extra]]
                to[extra] = np.searchsorted(lack_to, u, side="right")
                j[extra] = got[to[extra]] + u - (lack_to - lack)[to[extra]]
            passes = j // blocks[to]
            key = mix64(np.uint64(seed) + to.astype(np.uint64) * np.uint64(64) + passes.astype(np.uint64))
            block = permute(j % blocks[to], blocks[to], key)
            # Where in the shard the slot stands: the rank of a mixed number.
            rank = mix64(mix64(shard.astype(np.uint64)) + (s * shard_slots + step).astype(np.uint64)).view(np.int64)
            yield pd.DataFrame({"shard": shard, "position": rank, "s": to.astype("int32"),
                                "pass": passes.astype("int32"), "block": block})

    return placed.mapInPandas(fill, "shard long, position long, s int, pass int, block long")


def mix(docs: DataFrame, weights: dict | None = None, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS,
        most: int = MOST, seed: int = SEED) -> Mix:
    """Plan the mix of a table of documents.

    ``weights`` maps a source to its weight; by default the sources in code
    point order, null last, weigh 1, 2, 3, 1, 2, 3, ...  The table of sources
    (one row each: the mixing recipe) is the only thing the driver holds.
    """
    spark = docs.sparkSession
    sized = stage(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                              F.xxhash64(text_col).alias("key"), count_words(F.col(text_col)).alias("size"))
                  .withColumn("copy", F.lit(0)), "sizes")
    totals = {r["source"]: r["n"] for r in sized.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    names = sorted((k for k in totals if k is not None), key=lambda k: k.encode()) + [None] * (None in totals)
    weigh = [float(weights[k]) if weights else float(1 + i % 3) for i, k in enumerate(names)]
    sizes = [int(totals[k]) for k in names]
    target = share(sizes, weigh, most)
    blocks = np.array([-(-n // block_words) for n in sizes], dtype=np.int64)
    full = np.array([min(int(t // n), most) if n else 0 for t, n in zip(target, sizes, strict=True)], dtype=np.int64)
    rest = np.array([t - f * n for t, f, n in zip(target, full, sizes, strict=True)])
    need = full * blocks + np.where(full < most, np.minimum(np.rint(rest / block_words).astype(np.int64), blocks), 0)
    sources = [(k, sizes[i], target[i], int(blocks[i]), int(need[i])) for i, k in enumerate(names)]
    order = spark.createDataFrame([(i, k, sizes[i], target[i]) for i, k in enumerate(names)] or [(-1, None, 0, 0.0)],
                                  "s int, source string, source_size long, target double")
    numbered = sized.join(order, sized["source"].eqNullSafe(order["source"])).select(sized["*"], "s", "source_size", "target")
    placed = stage(_streamed(numbered), "placed")
    end = F.col("start") + F.col("size")
    each = (placed.filter("size > 0")
            .select("s", "start", "size", end.alias("end"),
                    F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor((end - 1) / block_words))).alias("block"))
            .select("s", "start", "block",
                    (F.greatest(F.col("block") * block_words, "start") - F.col("start")).alias("first"),
                    (F.least((F.col("block") + 1) * block_words, "end") - F.greatest(F.col("block") * block_words, "start")).alias("words")))
    return Mix(sources, placed, _slots(spark, blocks, need, shard_slots, seed), each)


def taken(m: Mix) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken): words each document
    gives to the mix, repeats counted."""
    times = m.slots.groupBy("s", "block").agg(F.count(F.lit(1)).alias("times"))
    # Counts of slots grow with the corpus, which the planner can't tell from
    # the few rows they are drawn from: never broadcast them.
    words = (m.fragments.join(times.hint("merge"), ["s", "block"])
             .groupBy("s", "start").agg(F.sum(F.col("words") * F.col("times")).alias("taken")))
    some = m.sized.filter("size > 0").join(words, ["s", "start"], "left")
    none = m.sized.filter("size = 0").withColumn("taken", F.lit(0).cast("long"))
    cols = ["doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken")]
    return some.select(*cols).unionByName(none.select(*cols))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus as documents: one row per document and pass that takes
    any of its words, with the input's columns.

    A pass that takes all words keeps the text as it is; otherwise the words
    taken are joined by one space. ``n_chars`` follows the text. Rows equal in
    id, source and text are copies and share one text.
    """
    cols = docs.columns
    key = [F.col("doc_id"), F.col("source"), F.xxhash64("text").alias("_key")]
    m = mix(docs, **options)
    ids = m.sized.filter("size > 0").select("s", "start", "doc_id", "source", "key", "size")
    cuts = (m.fragments.join(m.slots.select("s", "block", "pass").hint("merge"), ["s", "block"])
            .groupBy("s", "start", "pass")
            .agg(F.sort_array(F.collect_list(F.struct("first", "words"))).alias("cuts"), F.sum("words").alias("n")))
    takes = (ids.join(cuts, ["s", "start"])
             .groupBy("doc_id", "source", "key")
             .agg(F.collect_list(F.struct("pass", "cuts", (F.col("n") == F.col("size")).alias("whole"))).alias("takes")))
    one = (docs.select(*key, F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_row"))
           .groupBy("doc_id", "source", "_key").agg(F.first("_row").alias("_row")))
    t = takes.select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("key").alias("_k"), "takes")
    j = one.join(t, one["doc_id"].eqNullSafe(t["_d"]) & one["source"].eqNullSafe(t["_s"]) & (one["_key"] == t["_k"]))
    ws = F.split(F.btrim(F.col("_row.text"), F.lit(" \t\n\x0b\x0c\r")), r"[\x20\x09-\x0D]+")
    each = j.select("_row", F.explode("takes").alias("take"))
    part = F.transform(F.col("take.cuts"), lambda c: F.concat_ws(" ", F.slice(F.col("_ws"), c["first"].cast("int") + 1, c["words"].cast("int"))))
    text = F.when(F.col("take.whole"), F.col("_row.text")).otherwise(F.concat_ws(" ", part))
    out = each.withColumn("_ws", F.when(F.col("take.whole"), F.array().cast("array<string>")).otherwise(ws)).select("_row", text.alias("_text"))
    return out.select(*[F.col("_text").alias(c) if c == "text"
                        else F.char_length("_text").cast(docs.schema["n_chars"].dataType).alias(c) if c == "n_chars"
                        else F.col(f"_row.`{c}`").alias(c) for c in cols])
