"""Operator 1: quality classifier on document statistics.

Statistics of whole texts are mapped through random Fourier features (which
approximate a Gaussian kernel); each partition sums its part of the normal
equations per fold, the sums are added up, and ridge regression is solved
from them. Every fold is scored by a model fitted on the other folds (its
share of the sums subtracted), and those scores calibrate the final model by
isotonic regression. What reaches the driver is bounded by the number of
features and bins.

Defined results: a null or blank text has its own statistics (all ratios 0)
and gets a score like any other; documents without a label are scored but
not learned from, null labels are ignored, repeated labels count as often as
they occur; without any label, or with only one class, every score is the
mean label (0.5 without any); an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odonto.llm.common import ship_by_value, stage

ship_by_value(__name__)

STATISTICS = [
    "log_words", "log_lines", "word_bytes", "word_bytes_sd", "upper", "digits", "non_ascii", "symbols", "marks",
    "shouts", "bars", "unique_words", "adjacent_repeats", "repeated_triples", "repeated_lines", "line_words",
    "capital_words", "stopped_words", "byte_entropy", "top_byte",
]
FEATURES = 256
WIDTH = 2.0            # kernel width in standard deviations of all statistics together
RIDGE = 1.0
FOLDS = 3
BINS = 1000
SEED = 7
#: Normal equations are added up in a tree of this arity.
FAN_IN = 32

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


def statistics(text: bytes) -> np.ndarray:
    """The statistics of one text (UTF-8), in the order of ``STATISTICS``."""
    words = text.split()
    n = len(words)
    if not n:
        return np.zeros(len(STATISTICS), np.float32)
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    size = len(text)
    length = np.fromiter(map(len, words), np.int32, n)
    lines = [x for x in text.split(b"\n") if x.strip()]
    code = np.fromiter(map(hash, words), np.int64, n)
    triples = 0.0
    if n > 3:
        h = code[:-2] * 0x1F3D5B79 + code[1:-1] * 0x27D4EB2F + code[2:]
        triples = 1 - len(np.unique(h)) / len(h)
    p = count[count > 0] / size
    letters = count[65:91].sum() + count[97:123].sum() + count[128:].sum()
    symbols = count[np.frombuffer(b"#*$%&|<>", np.uint8)].sum()
    marks = count[np.frombuffer(b".,;:?!\"'()-", np.uint8)].sum()
    return np.array([
        np.log1p(n), np.log1p(len(lines)), length.mean(), length.std(),
        count[65:91].sum() / max(letters, 1), count[48:58].sum() / size, count[128:].sum() / size,
        min(symbols / n, 3.0), min(marks / n, 3.0), min(count[33] / n, 3.0), min(count[124] / n, 3.0),
        len(set(words)) / n, sum(map(eq, words, words[1:])) / n, triples, 1 - len(set(lines)) / max(len(lines), 1),
        np.log1p(n / max(len(lines), 1)), sum(map(bytes.istitle, words)) / n, sum(x[-1] in b".!?" for x in words) / n,
        -(p * np.log2(p)).sum(), p.max(),
    ], np.float32)


def describe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x array<float>) of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "x": [statistics(t) for t in pdf["text"]]})

    # Ids travel as text, so that null ids stay null.
    return (docs.select(F.col(id_col).cast("string").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
            .mapInPandas(run, "doc_id string, x array<float>")
            .select(F.col("doc_id").cast("long").alias("doc_id"), "x"))


@dataclass
class Model:
    """mean, scale: of the statistics; turn, shift: the Fourier features;
    weights: ridge; knots, levels: the isotonic calibration."""
    mean: np.ndarray
    scale: np.ndarray
    turn: np.ndarray
    shift: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        waves = np.cos(z @ self.turn + self.shift) * np.sqrt(2 / len(self.shift))
        return np.hstack([np.ones((len(z), 1)), z, waves])

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.features(x) @ self.weights, self.knots, self.levels)


def isotonic(values: np.ndarray, counts: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over ascending values; (knots, levels)."""
    pool: list[list[float]] = []       # [first value, last value, count, ones]
    for v, c, o in zip(values, counts, ones, strict=True):
        pool.append([v, v, c, o])
        while len(pool) > 1 and pool[-2][3] * pool[-1][2] >= pool[-1][3] * pool[-2][2]:
            last = pool.pop()
            pool[-1] = [pool[-1][0], last[1], pool[-1][2] + last[2], pool[-1][3] + last[3]]
    knots = np.array([k for p in pool for k in p[:2]])
    levels = np.repeat([p[3] / p[2] for p in pool], 2)
    return knots, levels


def _add_up(parts: DataFrame) -> DataFrame:
    """Add (fold, row, v binary) up per (fold, row), in a tree."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        v = sum(np.frombuffer(b) for b in pdf["v"])
        return pd.DataFrame({"fold": pdf["fold"][:1], "row": pdf["row"][:1], "part": pdf["part"][:1] // FAN_IN, "v": [v.tobytes()]})

    schema = "fold int, row int, part int, v binary"
    once = parts.groupBy("fold", "row", F.floor(F.col("part") / FAN_IN)).applyInPandas(add, schema)
    twice = once.groupBy("fold", "row", F.floor(F.col("part") / FAN_IN)).applyInPandas(add, schema)
    return twice


def normal_equations(labelled: DataFrame, model: Model, folds: int) -> dict[int, np.ndarray]:
    """Per fold the matrix [Z y]' [Z y] over (fold, x, y) rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            z = np.hstack([model.features(np.stack(pdf["x"].to_numpy()).astype(float)), pdf[["y"]].to_numpy(float)])
            for f in range(folds):
                own = z[pdf["fold"].to_numpy() == f]
                sums[f] = sums.get(f, 0) + own.T @ own
        part = TaskContext.get().partitionId()
        for f, m in sums.items():
            yield pd.DataFrame({"fold": f, "row": np.arange(len(m)), "part": part, "v": [r.tobytes() for r in m]})

    total = _add_up(labelled.select("fold", "x", "y").mapInPandas(run, "fold int, row int, part int, v binary"))
    side = len(model.mean) + len(model.shift) + 2
    out = {f: np.zeros((side, side)) for f in range(folds)}
    for r in total.toLocalIterator():           # folds * side rows of side numbers, from each top of the tree
        out[r["fold"]][r["row"]] += np.frombuffer(r["v"])
    return out


def solve(gram: np.ndarray, ridge: float) -> np.ndarray:
    a = gram[:-1, :-1] + ridge * np.eye(len(gram) - 1)
    return np.linalg.solve(a, gram[:-1, -1])


def fit(labelled: DataFrame, features: int = FEATURES, width: float = WIDTH, ridge: float = RIDGE, folds: int = FOLDS,
        bins: int = BINS, seed: int = SEED) -> Model:
    """Fit on (doc_id, x, y) rows, y 0 or 1. ``labelled`` is read three times:
    pass a staged table."""
    d = len(STATISTICS)
    rng = np.random.default_rng(seed)
    turn = rng.normal(0, 1 / (width * np.sqrt(d)), (d, features))
    shift = rng.uniform(0, 2 * np.pi, features)
    at = [F.col("x")[i].cast("double") for i in range(d)]
    m = labelled.agg(F.count(F.lit(1)), F.avg("y"), *[F.avg(c) for c in at], *[F.stddev_pop(c) for c in at]).first()
    blank = Model(np.zeros(d), np.ones(d), turn, shift, np.zeros(1 + d + features), np.array([0.0]), np.array([m[1] if m[0] else 0.5]))
    if not m[0] or m[1] in (0.0, 1.0):
        return blank
    mean, sd = np.array(m[2:2 + d]), np.array(m[2 + d:])
    model = Model(mean, np.where(sd > 1e-6, sd, 1.0), turn, shift, blank.weights, blank.knots, blank.levels)
    folded = labelled.withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(folds)).cast("int"))
    grams = normal_equations(folded, model, folds)
    whole = sum(grams.values())
    others = [Model(model.mean, model.scale, turn, shift, solve(whole - grams[f], ridge), model.knots, model.levels) for f in range(folds)]

    def out_of_fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x, fold = np.stack(pdf["x"].to_numpy()).astype(float), pdf["fold"].to_numpy()
            z = model.features(x)
            s = np.choose(fold, [z @ o.weights for o in others])
            # Raw scores lie around 0 to 1; far ones share the end bins.
            yield pd.DataFrame({"bin": np.clip(np.rint(s * bins), -bins, 2 * bins).astype("int32"), "y": pdf["y"]})

    held = folded.select("x", "y", "fold").mapInPandas(out_of_fold, "bin int, y int").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("ones"))
    table = sorted((r["bin"], r["n"], r["ones"]) for r in held.collect())      # at most 3 * bins + 1 rows
    value, n, ones = (np.array(c, dtype=float) for c in zip(*table, strict=True))
    knots, levels = isotonic(value / bins, n, ones)
    return Model(model.mean, model.scale, turn, shift, solve(whole, ridge), knots, levels)


def score(described: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of described documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            s = model.score(np.stack(pdf["x"].to_numpy()).astype(float)) if len(pdf) else np.zeros(0)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": s})

    return (described.select(F.col("doc_id").cast("string").alias("doc_id"), "x")
            .mapInPandas(run, "doc_id string, score double").select(F.col("doc_id").cast("long").alias("doc_id"), "score"))


def classify(docs: DataFrame, labels: DataFrame, held_out: Column, label_col: str = "quality", threshold: float = 0.7,
             id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document. ``held_out``
    is a condition on ``doc_id``; its rows' labels are never read."""
    described = stage(describe(docs, id_col, text_col), "statistics")
    own = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter(~held_out & F.col("y").isin(0, 1))
    model = fit(stage(described.join(own, "doc_id"), "labelled"), **options)
    return (score(described, model)
            .select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")))
