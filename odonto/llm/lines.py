"""Operator 7: line dedup by a segment-partition edit join (DataFrame
functions only).

A line (trimmed) of at least ``MIN_CHARS`` characters is removed if an equal
line, or one within ``EDITS`` edits, stands earlier in the corpus: in a
document with a smaller id, or above it in the same one. A shorter line of at
least ``equal_chars`` characters is removed if an equal one stands earlier;
that is ``MIN_CHARS`` unless given, and the query and the pipeline give
``EQUAL_CHARS``. Other short lines and blank lines stay.

1. Equal lines form classes; a grouped minimum finds each one's first place.
   From here on a class counts once.
2. Each line is split into EDITS + 1 segments. EDITS edits touch at most EDITS
   segments, so another line near it holds the rest unchanged, shifted by no
   more than the edits before it (or after it, counted from the right end).
   A key hashes untouched segments with a length class; lines look up the
   indexed keys of a class by the substrings at each possible shift. Lengths
   fall into classes wider than EDITS, so a line belongs to one or two.
3. Keys of one class of lines only are dropped with a bitmap of bounded size.
   In a key of at most ``CROWD`` lines those that can match meet in pairs. In
   a larger key every line meets the earliest one only. Lines that are still
   undecided there meet the others block by block inside tasks, which emit
   removed lines, not pairs. In a key of more than ``MEET`` lines they are
   first split again, with their companions, into more segments
   (``_levels``), all but EDITS of which must agree, so that far fewer share a
   key.
4. Pairs lose their common prefix and suffix and are verified by a banded
   bit-parallel edit distance: one word of 2 * EDITS + 1 diagonals per number
   of edits, shifted along the line until no diagonal lives.
5. Later classes of verified pairs and later places of equal lines go; the
   documents that lose lines are rebuilt, all others pass from the scan.

Lines are compared by 64-bit hashes.

Defined results: null text counts as empty; an empty text has no lines; null
ids sort after all others; rows equal in id and text are one document and
lose the same lines; rows that share an id only are ordered by a hash of
their text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import combinations, product
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odonto.llm.bitmaps import key_bitmap
from odonto.llm.common import SPACE_CHARS, let, stage

EDITS = 2
MIN_CHARS = 20
EQUAL_CHARS = 1
CROWD = 16
#: Undecided lines of a key of at most so many lines meet the others inside
#: tasks, in blocks; splitting them further would cost more.
MEET = 512
BLOCK = 64
#: Keys of a line at the deepest level of segments, at most.
MOST_KEYS = 600
LONGEST = (1 << 31) - 1
LAST_ID = (1 << 63) - 1
FIRST = ["doc", "version", "place"]


def _length_classes(m: Column, edits: int) -> tuple[Column, Column]:
    """Least lengths of the classes of m and of m - edits. A class is a power
    of two wide, more than ``edits`` and about a thirtieth of its lengths, so
    no line near one of length m falls into a third class."""
    least = 1 << edits.bit_length()

    def bottom(n: Column) -> Column:
        bits = F.length(F.bin(n))
        width = F.greatest(F.lit(least), F.call_function("shiftleft", F.lit(1), F.greatest(bits - 6, F.lit(0))))
        return (n - n % width).cast("int")

    return bottom(m), bottom(F.greatest(m - edits, F.lit(0)))


def _choices(edits: int, k: int) -> Iterator[tuple[tuple[int, ...], tuple[int, ...]]]:
    """(touched, shifts): each choice of ``edits`` touched segments of k, with
    every shift of the runs of segments before, between and after them. Run j
    has j edits before it and the others after it."""
    for touched in combinations(range(k), edits):
        ends = (-1, *touched, k)
        spans = [min(j, edits - j) if ends[j + 1] - ends[j] > 1 else 0 for j in range(edits + 1)]
        for shifts in product(*[range(-x, x + 1) for x in spans]):
            yield touched, shifts


def _key(k: int, low: Column, size: Column, m: Column, line: Column, touched: list, shifts: list) -> Column:
    """Hash of the untouched segments, ``size`` long, of a line of a length
    class that begins at ``low``. Runs up to the middle are placed from the
    left end, the others from the right one; what the division leaves lies
    between them."""
    ends, runs = [-1, *touched, k], []
    for j, shift in enumerate(shifts):
        first, stop = ends[j] + 1, ends[j + 1]
        if isinstance(first, int) and isinstance(stop, int) and first == stop:
            continue
        at = size * first if 2 * j <= len(touched) else m - size * (k - first)
        runs.append(F.substring(line, at + shift + 1, size * (stop - first)))
    return F.xxhash64(F.lit(k), low, *[F.lit(t) for t in touched], *runs)


def _levels(edits: int) -> list[int]:
    """Numbers of segments: edits + 1, twice that, then three times the last
    while a line has no more than ``MOST_KEYS`` keys."""
    out = [edits + 1]
    while comb(k := out[-1] * (2 if len(out) == 1 else 3), edits) <= MOST_KEYS and sum(1 for _ in _choices(edits, k)) <= MOST_KEYS:
        out.append(k)
        if edits == 0 or len(out) == 4:
            break
    return out


def _first_keys(lines: DataFrame, edits: int, min_chars: int) -> DataFrame:
    """The lines (line, m, ...) with the array ``keys`` of the first level,
    null where both length classes are the same and for lines under
    ``min_chars``; ``_own`` tells which are indexed."""
    k, m, line = edits + 1, F.col("m"), F.col("line")
    low, lower = _length_classes(m, edits)
    ready = lines.withColumns({"low": low, "lower": lower})
    ready = ready.withColumns({"size": F.floor(F.col("low") / k).cast("int"), "less": F.floor(F.col("lower") / k).cast("int")})
    keys = lambda c, size: [_key(k, F.col(c), F.col(size), m, line, t, s) for t, s in _choices(edits, k)]
    one, two = F.array(*keys("low", "size")), F.array(*keys("lower", "less"))
    both = F.when(F.col("lower") == F.col("low"), one).otherwise(F.concat(one, two))
    return ready.withColumn("keys", F.when(m >= min_chars, both)).drop("low", "lower", "size", "less")


def _own(edits: int) -> Column:
    return F.array(*[F.lit(not any(s)) for _ in range(2) for _, s in _choices(edits, edits + 1)])


def _keys(lines: DataFrame, edits: int, k: int) -> DataFrame:
    """(key, own, ...) of every key of the lines (line, m, ...) at k segments;
    ``own`` if the line itself is indexed by it."""
    choices = json.dumps([{"t": t, "s": s} for t, s in _choices(edits, k)])
    each = F.explode(F.from_json(F.lit(choices), "array<struct<t array<int>, s array<int>>>"))
    low, lower = _length_classes(F.col("m"), edits)
    touched, shifts = [F.col("c.t")[j] for j in range(edits)], [F.col("c.s")[j] for j in range(edits + 1)]
    split = (lines.withColumn("low", F.explode(F.array_distinct(F.array(low, lower)))).withColumn("size", F.floor(F.col("low") / k).cast("int"))
             .withColumn("c", each))
    return (split.withColumns({"key": _key(k, F.col("low"), F.col("size"), F.col("m"), F.col("line"), touched, shifts),
                               "own": ~F.exists("c.s", lambda s: s != 0)}).drop("line", "low", "size", "c"))


def edit_within(a: Column, b: Column, edits: int, stride: int = 16) -> Column:
    """Whether two strings are within ``edits`` edits (insert, delete,
    replace).

    Bit o + edits of word e says that the first j characters of b and the
    first j + o of a match with at most e edits; a step reads one of b's.
    Steps are taken ``stride`` at a time, and none once no diagonal lives.
    """
    full = (1 << (2 * edits + 1)) - 1
    left = lambda x: F.call_function("shiftleft", x, F.lit(1)).bitwiseAND(full)
    right = lambda x: F.call_function("shiftright", x, F.lit(1))
    start = [1 << edits]
    for _ in range(edits):
        start.append((start[-1] | start[-1] << 1) & full)

    def words(r: Column, match: Column) -> Column:
        new = [r["r0"].bitwiseAND(match)]
        for e in range(1, edits + 1):
            was, own = r[f"r{e - 1}"], r[f"r{e}"]
            new.append(own.bitwiseAND(match).bitwiseOR(was).bitwiseOR(right(was)).bitwiseOR(left(new[-1])))
        return F.struct(*[w.alias(f"r{e}") for e, w in enumerate(new)])

    def steps(r: Column, x: Column, k: Column) -> Column:
        """The words after the k-th stride. ``near`` holds the characters of a
        that its steps look at, from place ``at`` on."""
        at = F.greatest(k * stride - edits, F.lit(0))
        part = F.struct(F.substring(x["b"], k * stride + 1, F.lit(stride)).alias("b"),
                        F.substring(x["a"], at + 1, F.lit(stride + 2 * edits)).alias("near"), (k * stride - at).alias("lag"))

        def step(s: Column, y: Column, j: Column) -> Column:
            c, bits = F.substring(y["b"], j + 1, F.lit(1)), F.lit(0).cast("long")
            for o in range(-edits, edits + 1):
                place = y["lag"] + j + o
                same = (place >= 0) & (F.substring(y["near"], place + 1, F.lit(1)) == c)
                bits = bits + F.when(same, F.lit(1 << (o + edits)).cast("long")).otherwise(F.lit(0).cast("long"))
            return let(bits, lambda match: words(s, match))

        return let(part, lambda y: F.aggregate(F.sequence(F.lit(0), F.char_length(y["b"]) - 1), r, lambda s, j: step(s, y, j)))

    def run(x: Column) -> Column:
        first = F.struct(*[F.lit(s).cast("long").alias(f"r{e}") for e, s in enumerate(start)])
        strides = F.sequence(F.lit(0), F.floor((x["m"] - 1) / stride).cast("int"))
        end = F.aggregate(strides, first, lambda r, k: F.when(r[f"r{edits}"] == 0, r).otherwise(steps(r, x, k)))
        last = F.call_function("shiftright", end[f"r{edits}"], (x["n"] - x["m"] + edits).cast("int")).bitwiseAND(1) == 1
        return F.when(F.abs(x["n"] - x["m"]) > edits, F.lit(False)).when(x["m"] == 0, F.lit(True)).otherwise(last)

    return let(F.struct(a.alias("a"), b.alias("b"), F.char_length(a).alias("n"), F.char_length(b).alias("m")), run)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("doc"), F.xxhash64(text).alias("version"), text.alias("text"))


def occurrences(rows: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, version, place, line, h, m) of every line that counts."""
    each = rows.select("doc", "version", F.posexplode(F.split("text", "\n")).alias("place", "raw"))
    line = each.select("doc", "version", "place", F.btrim("raw", F.lit(SPACE_CHARS)).alias("line"))
    return (line.withColumn("m", F.char_length("line")).filter(F.col("m") >= min_chars)
            .withColumn("h", F.xxhash64("line")))


def trimmed(a: Column, b: Column, most: int = 1 << 13) -> Column:
    """Struct (a, b) of two strings without their common suffix and their
    common prefix (of up to 2 * ``most`` characters each), which leaves their
    edit distance as it is."""
    steps = []
    while most:
        steps.append(F.lit(most))
        most //= 2

    def cut(v: Column) -> Column:
        alike = lambda at, n: F.substring(v["a"], at + 1, n) == F.substring(v["b"], at + 1, n)
        longest = lambda shorter: F.aggregate(F.array(*steps), F.lit(0), lambda at, n: F.when(at + n > shorter, at)
                                              .when(alike(at, n), at + n).otherwise(at))
        same = let(F.least(F.char_length(v["a"]), F.char_length(v["b"])), longest)
        rest = lambda at, x: F.reverse(F.substring(x, at + 1, F.lit(LONGEST)))
        return let(same, lambda at: F.struct(rest(at, v["a"]).alias("a"), rest(at, v["b"]).alias("b")))

    return let(let(F.struct(a.alias("a"), b.alias("b")), cut), cut)


def _close(a: Column, b: Column, edits: int) -> Column:
    return let(trimmed(a, b), lambda v: edit_within(v["a"], v["b"], edits))


def _near(pairs: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """(h): the later lines of the pairs (early, late) within ``edits``."""
    one = texts.select(F.col("h").alias("early"), F.col("line").alias("x"))
    two = texts.select(F.col("h").alias("late"), F.col("line").alias("y"))
    both = stage(pairs.join(one, "early").join(two, "late").select("late", "x", "y"), "compared")
    return both.filter(_close(F.col("x"), F.col("y"), edits)).select(F.col("late").alias("h")).distinct()


def _meetings(entries: DataFrame, edits: int, crowd: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (early, late) that meet in the keys of staged entries (key, h, m,
    first, own, open), and the entries of crowded keys with the key's earliest
    line ``pivot`` and its size ``n``. Only open lines are looked for as the later of a pair."""
    sizes = stage(entries.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("first", "h")).alias("pivot"), F.bool_or("own").alias("own"), F.bool_or("open").alias("open"))
                  .filter("n > 1 and own and open").select("key", "n", F.col("pivot.h").alias("pivot")), "sizes")
    few = entries.join(sizes.filter(F.col("n") <= crowd).select("key"), "key")
    many = stage(entries.join(sizes.filter(F.col("n") > crowd), "key"), "crowded")
    index = few.filter("own").select("key", F.struct("first", "h", "m", "open").alias("a"))
    probe = few.select("key", F.struct("first", "h", "m", "open").alias("b"))
    # One of two equally early lines is enough: all hashes differ.
    two = (index.join(probe, "key").filter((F.col("a.h") != F.col("b.h")) & (F.abs(F.col("a.m") - F.col("b.m")) <= edits))
           .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("b.open")
           .select(F.col("a.h").alias("early"), F.col("b.h").alias("late")))
    star = many.filter("open and h != pivot").select(F.col("pivot").alias("early"), F.col("h").alias("late"))
    return stage(two.unionByName(star).distinct(), "pairs"), many


def sketch(line: Column, stride: int = 64) -> Column:
    """64 parities of the hashed pairs of neighbouring characters. An edit
    takes away at most two pairs and brings two, so lines within n edits have
    sketches that differ in at most 4 * n bits."""
    one = F.expr("shiftleft(1L, 0)")

    def turned(bits: Column, part: Column) -> Column:
        bit = lambda j: F.call_function("shiftleft", one, F.xxhash64(F.substring(part, j, F.lit(2))).bitwiseAND(63).cast("int"))
        pairs = F.when(F.char_length(part) > 1, F.sequence(F.lit(1), F.char_length(part) - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(pairs, bits, lambda x, j: x.bitwiseXOR(bit(j)))

    strides = F.sequence(F.lit(0), F.floor(F.char_length(line) / stride).cast("int"))
    return F.aggregate(strides, F.lit(0).cast("long"), lambda x, k: let(F.substring(line, k * stride + 1, F.lit(stride + 1)), lambda part: turned(x, part)))


def _met(many: DataFrame, texts: DataFrame, edits: int, block: int) -> DataFrame:
    """(h): open lines of crowded keys that are near an earlier line of their
    key. Each meets the blocks of its key inside tasks."""
    mine = stage(many.select("h").distinct().join(texts.select("h", "line"), "h").withColumn("sketch", sketch(F.col("line"))), "sketches")
    told = many.join(mine, "h").select("key", "h", "first", "m", "open", "line", "sketch", F.ceil(F.col("n") / block).alias("blocks"))
    blocks = (told.groupBy("key", F.pmod(F.xxhash64("h"), F.col("blocks")).alias("block"))
              .agg(F.collect_list(F.struct("first", "m", "sketch", "line")).alias("others")))
    late = told.filter("open").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    alike = lambda o: F.bit_count(o["sketch"].bitwiseXOR(F.col("sketch"))) <= 4 * edits
    fits = lambda o: (F.abs(o["m"] - F.col("m")) <= edits) & alike(o) & (o["first"] < F.col("first"))
    found = F.exists("others", lambda o: F.when(fits(o), _close(o["line"], F.col("line"), edits)).otherwise(F.lit(False)))
    return (stage(late.select("key", "block", "h", "first", "m", "sketch", "line"), "meeting").join(stage(blocks, "blocks"), ["key", "block"])
            .filter(found).select("h").distinct())


def near_lines(classes: DataFrame, texts_of: Callable[[DataFrame], DataFrame], edits: int = EDITS, crowd: int = CROWD,
               meet: int = MEET, block: int = BLOCK) -> DataFrame:
    """(h) of the lines of staged classes (h, first, m, keys) that are within
    ``edits`` of an earlier one. ``texts_of`` gives (h, first, m, line) of a
    staged table (h, first, m)."""
    keyed = (classes.select("h", "first", "m", F.posexplode("keys").alias("i", "key"))
             .withColumn("own", F.element_at(_own(edits), F.col("i") + 1)).drop("i"))
    keys = keyed.select("h", "key", "own")
    live = stage(keys.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high"), F.bool_or("own").alias("own"))
                 .filter("own and low < high").select("key"), "keys")
    entries = stage(keyed.filter(key_bitmap(live, "key")(F.col("key"))).join(live, "key", "left_semi")
                    .groupBy("key", "h", "first", "m").agg(F.bool_or("own").alias("own")).withColumn("open", F.lit(True)), "entries")
    pairs, many = _meetings(entries, edits, crowd)
    met = pairs.select(F.col("early").alias("h")).unionByName(pairs.select(F.col("late").alias("h"))).unionByName(many.select("h"))
    wanted = stage(met.distinct(), "met")
    wanted = classes.select("h", "first", "m").filter(key_bitmap(wanted, "h")(F.col("h"))).join(wanted, "h", "left_semi")
    texts = stage(texts_of(stage(wanted, "wanted")), "lines")
    near, levels = stage(_near(pairs, texts, edits), "near"), _levels(edits)[1:]
    while not many.isEmpty():
        undecided = many.join(near.withColumn("is_near", F.lit(True)), "h", "left").withColumn("open", F.col("open") & F.col("is_near").isNull()).drop("is_near")
        undecided = stage(undecided, "undecided")
        keys = undecided.filter("open and h != pivot").select("key").distinct()
        undecided = stage(undecided.join(keys, "key", "left_semi"), "undecided")
        small = F.col("n") <= meet if levels else F.lit(True)
        near = stage(near.unionByName(_met(undecided.filter(small), texts, edits, block)).distinct(), "near")
        large = undecided.filter(~small)
        if large.isEmpty():
            break
        lines = texts.join(large.groupBy("h").agg(F.bool_or(F.col("open") & (F.col("h") != F.col("pivot"))).alias("open")), "h")
        # A line has hundreds of keys now: deal the lines out evenly first.
        more = _keys(stage(lines, "open").repartition("h"), edits, levels.pop(0))
        entries = stage(more.groupBy("key", "h", "first", "m", "open").agg(F.bool_or("own").alias("own")), "entries")
        pairs, many = _meetings(entries, edits, crowd)
        near = stage(near.unionByName(_near(pairs, texts, edits)).distinct(), "near")
    return near


def removals(rows: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, equal_chars: int | None = None, **sizes: int) -> DataFrame:
    """(doc, version, places, n_equal, n_near): the lines each document loses."""
    lines = occurrences(rows, min(min_chars, max(min_chars if equal_chars is None else equal_chars, 1)))
    told = stage(_first_keys(lines, edits, min_chars).select(*FIRST, "h", "m", "keys"), "places")
    classes = stage(told.groupBy("h").agg(F.min(F.struct(*FIRST, "m", "keys")).alias("x"), F.count(F.lit(1)).alias("n"))
                    .select("h", "n", F.struct(*[f"x.{c}" for c in FIRST]).alias("first"), "x.m", "x.keys"), "classes")

    def texts_of(wanted: DataFrame) -> DataFrame:
        found = lines.filter(key_bitmap(wanted, "h")(F.col("h"))).select(F.struct(*FIRST).alias("first"), "h", "m", "line")
        return found.join(wanted, ["h", "first", "m"], "left_semi").dropDuplicates(["h"])

    near = near_lines(classes.filter("keys is not null"), texts_of, edits, **sizes).withColumn("near", F.lit(True))
    loses = stage(classes.select("h", "first", "n").join(near, "h", "left").withColumn("near", F.coalesce("near", F.lit(False)))
                  .filter("near or n > 1").select("h", "first", "near"), "loses")
    place = F.struct(*FIRST)
    gone = told.select(*FIRST, "h").join(loses, "h").withColumn("equal", place != F.col("first")).filter("equal or near")
    lost = gone.groupBy("doc", "version").agg(F.collect_set(F.struct("place", "equal")).alias("x"))
    n_equal = F.size(F.filter("x", lambda p: p["equal"])).cast("long")
    return lost.select("doc", "version", F.transform("x", lambda p: p["place"]).alias("places"), n_equal.alias("n_equal"),
                       (F.size("x") - n_equal).cast("long").alias("n_near"))


def dedup_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, id_col: str = "doc_id",
                text_col: str = "text", keep: list[str] | None = None, equal_chars: int | None = None) -> DataFrame:
    """(doc_id, n_lines, n_equal, n_near, n_removed, kept_text) of every row,
    and the input columns named in ``keep`` as a struct ``row``.

    n_lines: lines that are not blank; n_equal: lines equal to an earlier
    one; n_near: other lines near an earlier one; n_removed: both.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in keep or [id_col]]).alias("row")
    full = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("doc"), F.xxhash64(text).alias("version"), text.alias("text"), row)
    lost = stage(removals(_rows(docs, id_col, text_col), edits, min_chars, equal_chars), "lost")
    passes = key_bitmap(lost, "doc")(F.col("doc"))
    some = full.filter(passes).join(lost, ["doc", "version"], "left")
    none = full.filter(~passes).withColumns({"places": F.lit(None).cast("array<int>"), "n_equal": F.lit(None).cast("long"), "n_near": F.lit(None).cast("long")})
    every = some.unionByName(none)
    raw = F.split("text", "\n")

    def rebuild(x: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("places"))
        return let(F.struct(x.alias("x"), kept.alias("k")), lambda s: F.concat_ws("\n", F.transform(s["k"], lambda i: F.get(s["x"], i))))

    n_lines = F.size(F.filter(raw, lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")).cast("long")
    n_equal, n_near = F.coalesce("n_equal", F.lit(0).cast("long")), F.coalesce("n_near", F.lit(0).cast("long"))
    out = every.select(F.when(F.col("doc") != LAST_ID, F.col("doc")).alias("doc_id"), n_lines.alias("n_lines"), n_equal.alias("n_equal"),
                       n_near.alias("n_near"), (n_equal + n_near).alias("n_removed"),
                       F.when(F.col("places").isNull(), F.col("text")).otherwise(let(raw, rebuild)).alias("kept_text"), "row")
    return out if keep else out.drop("row")


def deduped_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents without their repeated lines, with the input's columns;
    ``n_chars`` follows the text. Documents that lose all their words go."""
    cols = docs.columns
    d = dedup_lines(docs, keep=cols, **options).filter((F.col("n_removed") == 0) | (F.btrim("kept_text", F.lit(SPACE_CHARS)) != ""))
    return d.select(*[F.when(F.col("n_removed") == 0, F.col(f"row.`{c}`")).otherwise(F.col("kept_text")).alias(c) if c == "text"
                      else F.when(F.col("n_removed") == 0, F.col(f"row.`{c}`")).otherwise(F.char_length("kept_text")).cast(docs.schema[c].dataType).alias(c) if c == "n_chars"
                      else F.col(f"row.`{c}`").alias(c) for c in cols])
