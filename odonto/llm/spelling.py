"""Operator 12: spelling variants by dense prefix-suffix tiling.

Words of a corpus that differ by one code point inserted, deleted or replaced
are near; a rare word's form is its most frequent near word, and forms lead on
to a root.

1. A task reads whole texts, counts their words in a dictionary of bounded
   size and passes the counts on; Spark adds them up.
2. Of two near words, the shorter (or either, at equal lengths) of m code
   points shares its first m div 2 code points with the other, or its last
   ones. So words are grouped by length and half, and a group's words are cut
   into blocks of about ``BLOCK``.
3. Each two blocks of a group (and each block with itself) are a tile: one
   padded code-point matrix per block and length. All rows of one are compared
   with all rows of the other at once: the lengths of the common prefix and
   the common suffix are the first differing columns from the left and from
   the right, and the words are near if both together reach the longer length
   less one. Tiles are compared a bounded number of cells at a time, and only
   near pairs leave a task: at most about 190 per code point of a word.
4. Near words are counted and the form is a grouped minimum. Roots follow
   forms by doubling; a form has several times its word's count, so rounds
   are few.

Defined results: null texts have no words; a null id is written as the empty
text before the colon; repeated rows count as often as they occur; equal
counts go to the word first in code-point order; words of any length work (a
tile holds one length and the next); an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odonto.llm.common import ship_by_value, stage

ship_by_value(__name__)

#: Fixed by the contract.
LETTERS = "a-zÀ-ÿ"
MIN_CHARS = 6
MIN_COUNT = 5
TIMES = 5
DROP = 199

BLOCK = 512
#: Code points that a task's dictionary of counts holds at most (about), and
#: cells of a comparison held in memory at once.
HELD = 1 << 23
CELLS = 1 << 22


def words_of(doc_id: int | None, text: bytes, drop: int = DROP, min_chars: int = MIN_CHARS) -> Counter:
    """Counts of the words of one text. Of a run whose checksum with the id
    ``drop`` divides, one code point is deleted; 0 deletes nothing."""
    runs = re.findall(f"[{LETTERS}]{{{min_chars},}}", text.lower().decode("utf-8", "replace"))    # lower: A-Z only, as bytes
    out: Counter = Counter()
    start = crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(runs).items():
        if drop:
            h = crc32(run.encode(), start)
            if h % drop == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
        if len(run) >= min_chars:
            out[run] += n
    return out


def vocabulary(docs: DataFrame, min_count: int = MIN_COUNT, id_col: str = "doc_id", text_col: str = "text",
               drop: int = DROP, min_chars: int = MIN_CHARS) -> DataFrame:
    """(word, n) of the words that occur at least ``min_count`` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        size = 0

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc").to_pylist(), batch.column("text"), strict=True):
                for word, n in words_of(doc_id, text.as_py(), drop, min_chars).items():
                    size += 0 if word in held else len(word)
                    held[word] += n
                if size > HELD:
                    yield told()
                    held.clear()
                    size = 0
        yield told()

    return (docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
            .mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count))


def matrix(words: list[str]) -> np.ndarray:
    """Code points of the words, a row each, padded with 0 on the right."""
    width = max(map(len, words), default=1)
    return np.array(words, dtype=f"U{width}").view(np.uint32).reshape(len(words), width)


def _agreeing(same: np.ndarray) -> np.ndarray:
    """Length of the run of true values that each last axis begins with."""
    return np.where(same.all(-1), same.shape[-1], same.argmin(-1))


def near(x: np.ndarray, y: np.ndarray, side: int, self_tile: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of near words. x has words of m code points, y of m or
    m + 1; words of a length are all different.

    side 0 tells pairs with a common first half of m, side 1 only those
    without, so that each pair is told once. With ``self_tile`` x is y and
    each pair counts once.
    """
    m, longer = x.shape[1], y.shape[1]
    rows, found = max(CELLS // max(len(y) * m, 1), 1), []
    columns = max(CELLS // m, 1)
    for i in range(0, len(x), rows):
        for j in range(i if self_tile else 0, len(y), columns):
            a, b = x[i:i + rows, None, :], y[None, j:j + columns, :]
            prefix = _agreeing(a == b[..., :m])
            suffix = _agreeing((a == b[..., longer - m:])[..., ::-1])
            hit = (prefix + suffix >= longer - 1) & ((prefix >= m // 2) == (side == 0))
            p, q = np.nonzero(hit)
            found.append((p + i, q + j))
    p, q = (np.concatenate(z) for z in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
    if self_tile:
        p, q = p[q > p], q[q > p]
    return p, q


def _tile(side: int, members: list[dict], self_tile: bool) -> Iterator[tuple[str, int, str, int]]:
    """(word, n, near word, its n), both ways, of one tile."""
    own = [[x for x in members if not x["longer"] and x["second"] == s] for s in (False, True)]
    more = [[x for x in members if x["longer"] and x["second"] == s] for s in (False, True)]
    meets = [(own[0], own[0], True), (own[0], more[0], False)] if self_tile else \
        [(own[0], own[1], False), (own[0], more[1], False), (own[1], more[0], False)]
    for left, right, same in meets:
        if left and right:
            p, q = near(matrix([x["word"] for x in left]), matrix([x["word"] for x in right]), side, same)
            for i, j in zip(p.tolist(), q.tolist(), strict=True):
                a, b = left[i], right[j]
                yield a["word"], a["n"], b["word"], b["n"]
                yield b["word"], b["n"], a["word"], a["n"]


def near_words(vocab: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n, other, other_n): every near pair of a staged vocabulary, both
    ways."""
    m = F.char_length("word")

    def key(side: int, longer: int):
        size = m - longer
        half = F.floor(size / 2).cast("int")
        text = F.substring("word", F.lit(1), half) if side == 0 else F.substring("word", m - (size - half) + 1, size - half)
        return F.struct(F.lit(side).alias("side"), size.alias("size"), text.alias("half"), F.lit(bool(longer)).alias("longer"))

    keyed = (vocab.select("word", "n", F.explode(F.array(*[key(s, d) for s in (0, 1) for d in (0, 1)])).alias("k"))
             .select("word", "n", "k.*").filter("size > 0"))
    group = ["side", "size", "half"]
    sizes = stage(keyed.groupBy(*group).agg(F.count(F.lit(1)).alias("members"), F.bool_and("longer").alias("none_own"))
                  .filter("members > 1 and not none_own").select(*group, F.ceil(F.col("members") / block).alias("blocks")), "groups")
    entry = (keyed.join(sizes, group).withColumn("here", F.pmod(F.xxhash64("word"), F.col("blocks")))
             .withColumn("there", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))))
    member = F.struct("word", "n", "longer", (F.col("here") > F.col("there")).alias("second"))
    tiles = (entry.select(*group, F.least("here", "there").alias("one"), F.greatest("here", "there").alias("two"), member.alias("member"))
             .groupBy(*group, "one", "two").agg(F.collect_list("member").alias("members"))
             .filter(F.size("members") > 1).select("side", "members", (F.col("one") == F.col("two")).alias("self_tile")))
    fields = ["word", "n", "other", "other_n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for side, members, self_tile in zip(*(batch.column(c) for c in ("side", "members", "self_tile")), strict=True):
                pairs = list(_tile(side.as_py(), members.as_py(), self_tile.as_py()))
                if pairs:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*pairs), (pa.string(), pa.int64()) * 2, strict=True)], fields)

    return tiles.mapInArrow(run, "word string, n long, other string, other_n long")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of a staged table (word, form): the last of its forms."""
    found = forms.select("word", F.col("form").alias("root"))
    while True:
        step = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        found = stage(found.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if found.filter("moved").isEmpty():
            return found.select("word", "root")
        found = found.select("word", "root")


def variants(vocab: DataFrame, times: int = TIMES, block: int = BLOCK) -> DataFrame:
    """(word, n, form, root, n_near, form_n) of every word of a vocabulary
    (word, n) of different words."""
    vocab = stage(vocab, "vocabulary")
    best = F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other").alias("word")))
    most = near_words(vocab, block).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    form_n = -F.col("best.minus")
    is_form = form_n >= times * F.col("n")
    told = stage(vocab.join(most, "word", "left")
                 .select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best.word")).alias("form"),
                         F.when(is_form, form_n).alias("form_n")), "forms")
    return (told.join(_roots(told.filter("form is not null").select("word", "form")), "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
