"""Operator 6: near-duplicate documents by b-bit MinHash, confirmed exactly.

1. Sketch every text: its set of distinct word shingles, ``HASHES`` minima,
   a key per band of ``ROWS`` minima, and the minima's low ``BITS`` bits.
2. Texts with equal sets collapse into one representative (smallest id).
3. Representatives that share a band key form a bucket. Every member is
   compared with the bucket's smallest member: first by the packed bits
   (similarity corrected for chance collisions of b-bit values), then, if
   that is near enough, on the full sets. Links give components.
4. Buckets whose other members still lie in several components are closed:
   pairs from different components are compared the same way, inside tasks,
   so only links leave a task. A large bucket is cut into blocks and each two
   blocks meet in a task of their own, so no bucket is too large and none is
   cut short.
5. Components of all links: each row gets its group's smallest id.

Two texts of similarity s share no band with probability
(1 - s**ROWS) ** (HASHES / ROWS), 5e-8 at 0.8 and 6e-11 at 0.85, and the estimate lies
``SLACK`` (six standard deviations) below s with probability 1e-9; those are
the only links that can be missed. No other can be added.

Defined results: a null or blank text has an empty set and is linked with
nothing; fewer than ``SHINGLE`` words make one shingle; rows that share an id
are one document, linked with whatever any of its texts is linked with; rows
with a null id are linked with nothing, have a null component and are kept;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odonto.llm.bitmaps import key_bitmap
from odonto.llm.common import ship_by_value, stage, task_count
from odonto.llm.shingles import WordHashes, has_keys, key_filter, mix64, windows

ship_by_value(__name__)

SHINGLE = 5
PERCENT = 85
HASHES, ROWS, BITS = 128, 4, 4
SLACK = 0.2
BLOCK = 1024
SEED = 3

SKETCH_SCHEMA = "doc_id long, n long, high long, low long, bands array<long>, bits binary"


def shingles_of(text: bytes, of, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes of a text, A-Z lower-cased."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(windows(of(words), min(size, len(words))))


class Sketcher:
    def __init__(self, hashes: int = HASHES, rows: int = ROWS, bits: int = BITS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.key = rng.integers(0, 1 << 32, hashes, dtype=np.uint32)
        self.factor = rng.integers(0, 1 << 32, hashes, dtype=np.uint32) | np.uint32(1)
        self.band = mix64(np.arange(1, hashes // rows + 1, dtype=np.uint64))
        self.rows, self.bits = rows, bits

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        h, out = (shingles >> np.uint64(32)).astype(np.uint32), None
        for i in range(0, len(h), 1024):
            m = ((h[i:i + 1024, None] ^ self.key) * self.factor).min(0)
            out = m if out is None else np.minimum(out, m)
        return out

    def bands(self, minima: np.ndarray) -> np.ndarray:
        parts = minima.reshape(-1, self.rows).astype(np.uint64)
        key = self.band.copy()
        for j in range(self.rows):
            key = mix64(key ^ parts[:, j]) if j == 0 else mix64(key + parts[:, j] * np.uint64(0x9E3779B97F4A7C15))
        return key.view(np.int64)

    def packed(self, minima: np.ndarray) -> bytes:
        """The low bits of the minima (4 each: two per byte)."""
        low = (mix64(minima.astype(np.uint64)) & np.uint64((1 << self.bits) - 1)).astype(np.uint8)
        return (low[::2] << 4 | low[1::2]).tobytes()


def estimate(a: np.ndarray, b: np.ndarray, hashes: int = HASHES, bits: int = BITS) -> np.ndarray:
    """Similarity from packed low bits (64-bit words along the last axis):
    equal values are counted bitwise and corrected for chance."""
    x = a ^ b
    x = x | x >> np.uint64(2)
    x = (x | x >> np.uint64(1)) & np.uint64(0x1111111111111111)
    equal = 1 - np.bitwise_count(x).sum(axis=-1, dtype=np.int64) / hashes
    chance = 2.0 ** -bits
    return (equal - chance) / (1 - chance)


def alike(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """100 * intersection >= percent * union, on sorted distinct hashes."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def sketches(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Sketch of every row of (doc_id text, text binary)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash
        of, sketcher = WordHashes().of_words, Sketcher()
        for pdf in batches:
            rows = []
            for i, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                s = shingles_of(text, of, size)
                if not len(s):
                    rows.append((i, 0, 0, 0, [], b""))
                    continue
                whole = xxhash.xxh3_128_digest(s.tobytes())
                m = sketcher.minima(s)
                high, low = np.frombuffer(whole, np.int64)
                rows.append((i, len(s), high, low, sketcher.bands(m), sketcher.packed(m)))
            yield pd.DataFrame(rows, columns=["doc_id", "n", "high", "low", "bands", "bits"])

    return (docs.mapInPandas(run, SKETCH_SCHEMA.replace("doc_id long", "doc_id string"))
            .withColumn("doc_id", F.col("doc_id").cast("long")))


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, data): compressed texts of the wanted nodes. Only rows that a
    filter of bounded size lets through leave the scan."""
    common = docs.sparkSession.sparkContext.broadcast(key_filter(wanted, "node"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for pdf in batches:
            pdf = pdf[has_keys(common.value, pdf["node"].to_numpy().view(np.uint64))]
            yield pd.DataFrame({"node": pdf["node"], "data": [squeeze(t) for t in pdf["text"]]})

    found = (docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("node"), "text")
             .mapInPandas(run, "node long, data binary"))
    return found.join(wanted, "node", "left_semi")


def _compare(pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The (a, b) of (a, b, data_a, data_b) rows that are alike on full sets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard
        expand = zstandard.ZstdDecompressor().decompress
        of, known = WordHashes().of_words, {}
        for pdf in batches:
            keep = []
            for a, x, y in zip(pdf["a"], pdf["data_a"], pdf["data_b"], strict=True):
                if (a, x) not in known:
                    if len(known) >= 64:
                        known.clear()
                    known[a, x] = shingles_of(expand(x), of, size)
                keep.append(alike(known[a, x], shingles_of(expand(y), of, size), percent))
            yield pdf.loc[np.array(keep, bool), ["a", "b"]]

    return pairs.mapInPandas(run, "a long, b long").distinct()


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """(node, component): smallest node reachable, for nodes with a link.

    Alternates large-star and small-star steps over (a, b) rows until no edge
    changes; each round is staged. Minima are grouped before edges are joined
    to them, so a hub's edges spread like any skewed join.
    """
    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = stage(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), name)
    now = mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(least.select("a", F.col("m").alias("b"))).filter("a > b").distinct())
        edges, before = stage(small, name), now
        now = mark(edges)
        if now == before:
            break
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _star_links(buckets: DataFrame, reps: DataFrame, texts: DataFrame, size: int, percent: int, slack: float) -> DataFrame:
    """Links between each bucket's smallest member and the others."""
    pairs = buckets.filter("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    sketch = reps.select("node", "n", "bits")
    one = sketch.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a"))
    two = sketch.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b"))
    floor = percent / 100 - slack

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x, y = (np.frombuffer(b"".join(pdf[c]), np.uint64).reshape(len(pdf), -1) for c in ("bits_a", "bits_b"))
                yield pdf.loc[estimate(x, y) >= floor, ["a", "b"]]

    fits = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    close = pairs.join(two, "b").join(one, "a").filter(fits).mapInPandas(near, "a long, b long").distinct()
    full = (close.join(texts.select(F.col("node").alias("b"), F.col("data").alias("data_b")), "b")
            .join(texts.select(F.col("node").alias("a"), F.col("data").alias("data_a")), "a"))
    return _compare(full.select("a", "b", "data_a", "data_b"), size, percent)


class _Bucket:
    """Members of two blocks of a bucket that meet in a task."""

    def __init__(self, rows: pd.DataFrame):
        # A pair of blocks sees all its rows twice if they are the same block.
        self.rows = rows.reset_index(drop=True)

    def links(self, of, expand, size: int, percent: int, floor: float) -> list[tuple[int, int]]:
        r = self.rows
        key, left, right = int(r["key"][0]), int(r["left"][0]), int(r["right"][0])
        block, comp, n, node = (r[c].to_numpy() for c in ("block", "component", "n", "node"))
        bits = np.frombuffer(b"".join(r["bits"]), np.uint64).reshape(len(r), -1)
        first, second = np.flatnonzero(block == left), np.flatnonzero(block == right)
        sets: dict[int, np.ndarray] = {}
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                x = root[x]
            return x

        def set_of(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = shingles_of(expand(r["data"][i]), of, size)
            return sets[i]

        out = []
        for i in first:
            other = second[second > i] if left == right else second
            other = other[(comp[other] != comp[i]) & (100 * np.minimum(n[other], n[i]) >= percent * np.maximum(n[other], n[i]))]
            if not len(other):
                continue
            other = other[estimate(bits[other], bits[i]) >= floor]
            for j in other:
                # A pair is compared in the first bucket that it shares.
                same = np.flatnonzero(r["bands"][i] == r["bands"][j])
                if not len(same) or r["bands"][i][same[0]] != key or find(comp[i]) == find(comp[j]):
                    continue
                if alike(set_of(i), set_of(j), percent):
                    out.append((int(node[i]), int(node[j])))
                    root[find(comp[i])] = find(comp[j])
        return out


def _closing_links(buckets: DataFrame, parts: DataFrame, reps: DataFrame, texts: DataFrame, size: int, percent: int,
                   slack: float, block: int) -> DataFrame:
    """Links between members, other than the leader, of different components."""
    m = (buckets.filter("node <> leader").select("key", "node").join(parts, "node", "left")
         .withColumn("component", F.coalesce("component", "node")))
    open_ = (m.groupBy("key").agg(F.min("component").alias("_low"), F.max("component").alias("_high"), F.count(F.lit(1)).alias("_n"))
             .filter("_low < _high").select("key", F.ceil(F.col("_n") / block).cast("int").alias("blocks")))
    rows = m.join(open_, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # Block b meets every block: as (b, x) for x >= b and as (x, b) for x < b.
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1),
                        lambda x: F.struct(F.least(x, F.col("block")).alias("left"), F.greatest(x, F.col("block")).alias("right")))
    dealt = (stage(rows, "open").withColumn("meet", F.explode(meets))
             .select("key", "meet.left", "meet.right", "block", "component", "node")
             .join(reps.select("node", "n", "bands", "bits"), "node").join(texts, "node"))
    floor = percent / 100 - slack

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard
        expand = zstandard.ZstdDecompressor().decompress
        of, wait = WordHashes().of_words, []

        def finish(rows: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame(_Bucket(rows).links(of, expand, size, percent, floor), columns=["a", "b"], dtype="int64")

        for pdf in batches:
            if not len(pdf):
                continue
            group = pdf[["key", "left", "right"]].to_numpy()
            cuts = np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1
            for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(pdf)], strict=True):
                if wait and (wait[-1][["key", "left", "right"]].iloc[0].to_numpy() != group[lo]).any():
                    yield finish(pd.concat(wait))
                    wait = []
                wait.append(pdf.iloc[lo:hi])
        if wait:
            yield finish(pd.concat(wait))

    spark = buckets.sparkSession
    return (dealt.repartition(task_count(spark, 0, 1), "key", "left", "right").sortWithinPartitions("key", "left", "right")
            .mapInPandas(run, "a long, b long"))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, slack: float = SLACK, block: int = BLOCK,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    # Ids travel as text through Python, so that null ids stay null.
    d = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    found = stage(sketches(d, size), "sketches")
    member = ["high", "low", "n"]
    some = found.filter("n > 0 and doc_id is not null")
    classes = stage(some.groupBy(*member).agg(F.min("doc_id").alias("node")), "classes")
    reps = stage(some.join(classes, member).filter("doc_id = node").select("node", *member, "bands", "bits").dropDuplicates(["node", *member]), "reps")
    keyed = reps.select("node", F.explode("bands").alias("key"))
    crowded = (keyed.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("_last")).filter("leader < _last").drop("_last"))
    buckets = stage(keyed.join(crowded, "key").distinct(), "buckets")
    texts = stage(_texts(d, stage(buckets.select("node").distinct(), "crowd")), "texts")
    star = stage(_star_links(buckets, reps, texts, size, percent, slack), "star")
    closing = _closing_links(buckets, components(star, "parts"), reps, texts, size, percent, slack, block)
    # Rows that share an id are one document, whichever texts they have.
    owns = some.join(classes, member).select("doc_id", "node").distinct()
    several = owns.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("_last")).filter("a < _last")
    same = owns.join(several, "doc_id").filter("node > a").select("a", F.col("node").alias("b"))
    groups = components(star.unionByName(closing).unionByName(same), "groups")
    named = classes.join(groups, "node", "left").select(*member, F.coalesce("component", "node").alias("component"))
    linked = found.select("doc_id", *member).join(named, member, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return linked.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                         F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each near-duplicate group, with the input's columns: that of
    the smallest id. Rows equal in id and text are one document, of which one
    row stays (the one with the least hash); rows that share an id but not the
    text are documents of their own, numbered by a hash. Rows with a null id
    or without words stay as they are."""
    own, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))
    ids = docs.filter(own.isNotNull()).select(own.alias("_id"), F.xxhash64(text).alias("_text"))
    several = ids.groupBy("_id").agg(F.min("_text").alias("a"), F.max("_text").alias("b")).filter("a < b").select("_id")
    unlike = key_bitmap(stage(several, "several"), "_id")(own)
    marked = docs.withColumn("_node", F.when(own.isNotNull() & unlike, F.xxhash64(own, text)).otherwise(own))
    found = stage(near_duplicates(marked, id_col="_node", text_col=text_col, **options), "groups")
    # Nodes that go, and nodes of which several equal rows stay, are columns of
    # integers; a text stays in the scan unless its node may be one of them.
    gone = stage(found.filter("not kept").select(F.col("doc_id").alias("_node")).distinct(), "gone")
    again = stage(found.filter("doc_id is not null and n_shingles > 0 and kept").groupBy(F.col("doc_id").alias("_node")).count()
                  .filter("count > 1").select("_node"), "again")
    node = F.coalesce("_node", F.lit(0).cast("long"))
    seen = F.col("_node").isNotNull() & (key_bitmap(gone, "_node")(node) | key_bitmap(again, "_node")(node))
    rest = marked.filter(seen).join(gone, "_node", "left_anti")
    cols = [F.col(f"`{c}`") for c in docs.columns]
    once = (rest.join(again, "_node", "left_semi").groupBy("_node")
            .agg(F.min_by(F.struct(*cols), F.xxhash64(*cols)).alias("_row")).select("_row.*"))
    single = rest.join(again, "_node", "left_anti").select(*cols)
    return marked.filter(~seen).select(*cols).unionByName(single).unionByName(once)
