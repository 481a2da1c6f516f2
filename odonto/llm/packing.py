"""Operator 10: pack token pieces into fixed-length sequences by linear grouping.

1. Tokenise whole texts, end each with id 0, and cut only documents longer
   than a sequence into full pieces plus a rest.
2. Reduce the pieces to a histogram of lengths (at most ``capacity`` rows,
   however large the corpus) and plan on that: large lengths are split into
   groups of equal cardinality, rounded up to their group's longest, and the
   few resulting sizes are packed by column generation over bin
   configurations. Each slot of a configuration is then given actual lengths
   of its group, and the small lengths go best-fit into what is left.
3. The plan is a table of rank intervals per length (its size depends on the
   capacity, not on the data). Pieces are ranked inside their length and look
   their sequence and offset up in it.

Defined results: a null text counts as empty and is one piece holding id 0;
null ids stay null; repeated rows are packed separately; an empty table gives
no rows; other columns are ignored. Sequence numbers run from 0.
"""

from __future__ import annotations

import bisect
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from odonto.llm.common import ship_by_value, stage, task_count

ship_by_value(__name__)

CAPACITY = 2048
#: Lengths of at most capacity / SMALL_PART are small: placed best-fit last.
SMALL_PART = 4
#: Groups of equal cardinality among the large lengths.
GROUPS = 256
#: Words a task remembers the ids of; when full, it starts anew.
CACHE_WORDS = 1 << 19
#: ASCII punctuation except the apostrophe, which the tokenizer treats apart.
PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordIds(dict):
    """Ids of each white-space separated part (UTF-8) of a text, on demand.

    The tokenizer never joins parts across ASCII white space, so a text's ids
    are those of its parts in order, and each distinct part is encoded once.
    A part of Latin-1 letters followed by ASCII punctuation is in turn its
    lower-cased letters and the punctuation, each one unit to the tokenizer;
    the units are remembered as well. Any other part is encoded as it stands.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: as_bytes.pre_tokenize_str(chr(c))[0][0] for c in range(0x80, 0x100) if chr(c).isalpha()}
        self.units: dict[str, bytes] = {}

    def unit(self, text: str) -> bytes:
        """Ids of one pre-token."""
        ids = self.units.get(text)
        if ids is None:
            mapped = text if text.isascii() else text.translate(self.letters)
            ids = self.units[text] = pack_ids([t.id for t in self.model.tokenize(mapped)])
        return ids

    def __missing__(self, part: bytes) -> bytes:
        text = part.decode()
        core = text.rstrip(PUNCTUATION)
        if core.isalpha() and (core.isascii() or max(core) < "\u0100"):
            ids = self.unit(core.lower())
            if len(core) < len(text):
                ids += self.unit(text[len(core):])
        else:
            ids = pack_ids(self.tokenizer.encode(text, add_special_tokens=False).ids)
        self[part] = ids
        return ids

    def of_text(self, text: bytes) -> bytes:
        if len(self) > CACHE_WORDS:
            self.clear()
            self.units.clear()
        return b"".join(map(self.__getitem__, text.split()))


def pack_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def cut(text: bytes, ids_of, capacity: int) -> list[tuple[int, int, bytes]]:
    """(start, length, ids) of a document's pieces, its ending id 0 included."""
    ids = ids_of(text) + b"\0\0\0\0"
    step = 4 * capacity
    return [(i // 4, min(step, len(ids) - i) // 4, ids[i:i + step]) for i in range(0, len(ids), step)]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id",
           text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document, and the
    piece's ids as little-endian unsigned 32-bit numbers if ``with_ids``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_of = WordIds(tokenizer_path).of_text
        for pdf in batches:
            out: list[tuple] = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                for k, (start, length, ids) in enumerate(cut(text, ids_of, capacity)):
                    out.append((doc_id, k, start, length, zlib.crc32(ids), ids)[:6 if with_ids else 5])
            frame = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][:6 if with_ids else 5])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"),
                        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
            .mapInPandas(run, PIECE_SCHEMA + (", ids binary" if with_ids else "")))


# --- planning on the histogram -------------------------------------------

class Run:
    """``count`` bins of equal content: (length, rank of its first piece)."""
    __slots__ = ("count", "content", "left")

    def __init__(self, count: int, content: list[tuple[int, int]], left: int):
        self.count, self.content, self.left = count, content, left

    def split(self, n: int) -> Run:
        """Take the first ``n`` bins off as a run of their own."""
        first = Run(n, list(self.content), self.left)
        self.content = [(length, rank + n) for length, rank in self.content]
        self.count -= n
        return first


def best_pattern(sizes: list[int], values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the most valuable multiset of sizes that fits."""
    best, chosen = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for k in np.flatnonzero(values > 1e-12):
        size, value = sizes[k], values[k]
        for _ in range(capacity // size):          # one more copy each time
            better = best[:-size] + value > best[size:] + 1e-12
            if not better.any():
                break
            at = np.flatnonzero(better)
            best[at + size] = best[at] + value
            chosen[at + size] = k
    pattern, c = np.zeros(len(sizes)), capacity
    while c > 0 and chosen[c] >= 0:
        pattern[chosen[c]] += 1
        c -= sizes[chosen[c]]
    return float(values @ pattern), pattern


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 600) -> list[tuple[int, np.ndarray]]:
    """Whole bins per configuration of the few sizes: column generation for
    the linear relaxation, rounded down so that no size is overfilled."""
    n = len(sizes)
    basis = np.diag([float(capacity // s) for s in sizes])
    need = np.asarray(demand, dtype=float)
    for _ in range(rounds):
        prices = np.linalg.solve(basis.T, np.ones(n))
        worth, pattern = best_pattern(sizes, np.maximum(prices, 0.0), capacity)
        if worth <= 1 + 1e-4:
            break
        used = np.linalg.solve(basis, need)
        change = np.linalg.solve(basis, pattern)
        up = change > 1e-9
        if not up.any():
            break
        ratio = np.where(up, np.maximum(used, 0) / np.where(up, change, 1.0), np.inf)
        basis[:, int(ratio.argmin())] = pattern
    counts = np.floor(np.maximum(np.linalg.solve(basis, need), 0) + 1e-6).astype(np.int64)
    left, out = np.asarray(demand, dtype=np.int64).copy(), []
    for j in range(n):
        pattern = basis[:, j].astype(np.int64)
        on = pattern > 0
        count = int(min(counts[j], (left[on] // pattern[on]).min())) if on.any() else 0
        if count > 0:
            left -= count * pattern
            out.append((count, pattern))
    return out


class Stock:
    """Ranks of each length not yet placed, longest lengths first per group."""

    def __init__(self, histogram: dict[int, int]):
        self.next = dict.fromkeys(histogram, 0)
        self.count = dict(histogram)

    def take(self, length: int, n: int) -> int:
        first = self.next[length]
        self.next[length] += n
        self.count[length] -= n
        return first


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[Run]:
    """Runs of bins that together hold every piece of the histogram once."""
    stock = Stock({k: n for k, n in histogram.items() if n > 0})
    runs: list[Run] = []
    if n := stock.count.get(capacity, 0):
        runs.append(Run(n, [(capacity, stock.take(capacity, n))], 0))
    large = sorted((k for k, n in stock.count.items() if n and k > capacity // SMALL_PART), reverse=True)
    total = sum(stock.count[k] for k in large)
    # Groups of equal cardinality: a length may be shared by two neighbours.
    members: list[list[list[int]]] = []      # per group: [length, pieces]
    if total:
        quota = -(-total // groups)
        room = 0
        for k in large:
            n = stock.count[k]
            while n:
                if room == 0:
                    members.append([])
                    room = quota
                m = min(n, room)
                members[-1].append([k, m])
                n -= m
                room -= m
    sizes, demand, owner = [], [], []
    for g, ms in enumerate(members):
        if sizes and sizes[-1] == ms[0][0]:
            demand[-1] += sum(m for _, m in ms)
            owner[-1].extend(ms)
        else:
            sizes.append(ms[0][0])
            demand.append(sum(m for _, m in ms))
            owner.append(list(ms))

    def draw(g: int, n: int) -> tuple[int, int, int]:
        """Up to ``n`` pieces of group g with one length: (length, pieces, first rank)."""
        k, m = owner[g][0]
        got = min(n, m)
        owner[g][0][1] -= got
        if owner[g][0][1] == 0:
            owner[g].pop(0)
        return k, got, stock.take(k, got)

    if sizes:
        for count, pattern in configurations(sizes, demand, capacity):
            columns = []
            for g in np.flatnonzero(pattern):
                for _ in range(int(pattern[g])):
                    column, need = [], count
                    while need:
                        k, got, rank = draw(int(g), need)
                        column.append((k, got, rank))
                        need -= got
                    columns.append(column)
            runs.extend(_zip_columns(columns, count, capacity))
    # What rounding left over, and all small lengths: best fit, longest first.
    rooms: dict[int, list[Run]] = {}
    for r in runs:
        if r.left:
            rooms.setdefault(r.left, []).append(r)
    order = sorted(rooms)
    for length in sorted((k for k, n in stock.count.items() if n), reverse=True):
        _best_fit(length, stock, rooms, order, runs, capacity)
    return runs


def _zip_columns(columns: list[list[tuple[int, int, int]]], count: int, capacity: int) -> list[Run]:
    """Cut bins into runs wherever any slot's length changes."""
    at, used, out = [0] * len(columns), [0] * len(columns), []
    done = 0
    while done < count:
        n = min(columns[s][at[s]][1] - used[s] for s in range(len(columns)))
        content = []
        for s, column in enumerate(columns):
            k, got, rank = column[at[s]]
            content.append((k, rank + used[s]))
            used[s] += n
            if used[s] == got:
                at[s], used[s] = at[s] + 1, 0
        out.append(Run(n, content, capacity - sum(k for k, _ in content)))
        done += n
    return out


def _best_fit(length: int, stock: Stock, rooms: dict[int, list[Run]], order: list[int], runs: list[Run], capacity: int) -> None:
    def put_away(run: Run) -> None:
        if run.left:
            if not rooms.get(run.left):
                rooms[run.left] = []
                i = bisect.bisect_left(order, run.left)
                if i == len(order) or order[i] != run.left:
                    order.insert(i, run.left)
            rooms[run.left].append(run)

    while n := stock.count[length]:
        i = bisect.bisect_left(order, length)
        while i < len(order) and not rooms.get(order[i]):
            order.pop(i)
        if i == len(order):
            run = Run(-(-n // (capacity // length)), [], capacity)
            runs.append(run)
        else:
            run = rooms[order[i]].pop()
        each = min(run.left // length, n)        # the tightest bin is filled as far as it goes
        bins = min(run.count, n // each)
        if bins < run.count:
            rest, run = run, run.split(bins)
            runs.append(run)
            put_away(rest)
        for _ in range(each):
            run.content.append((length, stock.take(length, bins)))
        run.left -= each * length
        put_away(run)


def intervals(runs: list[Run]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, sequence of the first, offset)."""
    out, base = [], 0
    for r in runs:
        offset = 0
        for length, rank in r.content:
            out.append((length, rank, rank + r.count, base, offset))
            offset += length
        base += r.count
    return out


# --- placing pieces --------------------------------------------------------

def ranked(cut_pieces: DataFrame, per_bucket: int = 1 << 18) -> DataFrame:
    """Add ``rank``: dense from 0 within each length.

    Pieces are dealt into buckets by a hash of their id, so a window holds one
    length's part of one bucket; bucket offsets are a prefix sum of counts.
    """
    n = cut_pieces.count()
    buckets = task_count(cut_pieces.sparkSession, n, per_bucket)
    b = cut_pieces.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(buckets)).cast("int"))
    counts = b.groupBy("length", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    inside = Window.partitionBy("length", "_b").orderBy("doc_id", "piece", "ids_crc32")
    return (b.withColumn("_r", F.row_number().over(inside) - 1).join(offsets, ["length", "_b"])
            .withColumn("rank", F.col("_r") + F.col("_o")).drop("_b", "_r", "_o"))


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (columns of ``pieces``).

    ``cut_pieces`` is read several times: pass a staged table.
    """
    spark = cut_pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in cut_pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = intervals(plan(histogram, capacity, groups))
    steps = spark.createDataFrame(table or [(0, 0, 0, 0, 0)], "length long, _from long, _to long, _base long, offset long")
    p = ranked(cut_pieces)
    # The plan's rows depend on the capacity and the groups only, so its size is bounded.
    return (p.join(F.broadcast(steps), (p["length"] == steps["length"]) & (p["rank"] >= steps["_from"]) & (p["rank"] < steps["_to"]))
            .select(*[p[c] for c in cut_pieces.columns], (steps["_base"] + p["rank"] - steps["_from"]).alias("sequence_id"), "offset"))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """Tokenise, cut, stage and pack a table of documents."""
    return pack(stage(pieces(docs, tokenizer_path, capacity), "pieces"), capacity, groups)
