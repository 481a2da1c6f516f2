"""Operator 9: toxicity by a weighted finite-state pattern grammar.

A lexicon transducer maps words to symbols (insult, threat, target, negation,
reported speech, clause end, other). Four context transducers follow: one
marks what a negation covers, one what reported speech covers, one a target
in the clause before an attack, one attacks in the same clause. They are
composed into a single machine that emits one event per attack: its kind and
the marks it carries. A document is scored by its matched clauses, each at
the weight of its strongest event, never by isolated words.

Attack words are learned, as whole words and as word beginnings, from a
bounded sample of labelled documents; so are the event weights. The sample is
the ``sample_rows`` labelled rows with the smallest hash of their id.

Defined results: a null or blank text has no clauses and scores as any text
without a match; documents without a label are scored but not learned from,
null labels are ignored; without labels of both classes no word is an attack
and every score is the mean label (0.5 without any); repeated rows give
repeated results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odonto.llm.common import ship_by_value, stage

ship_by_value(__name__)

#: Bounds the labelled sample the lexicon and weights are learned from.
SAMPLE_ROWS = 20_000
#: Terms of one task that wait to be summed; beyond, they are sent on.
TERM_ROWS = 1 << 19
PREFIXES = (4, 5, 6)
MIN_DOCUMENTS = 4
MIN_PRECISION = 0.8
#: A term is an attack if this many toxic documents by chance have odds below exp(-CHANCE).
CHANCE = 16.0
NEGATION_SPAN, TARGET_SPAN = 3, 4

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORTED, END = range(7)
#: Fixed function words per class, in English, French, German and Spanish.
FUNCTION_WORDS = {
    TARGET: "you your yours yourself u vous toi votre du dich dein ihr euch usted tú vosotros ustedes",
    NEGATION: "not no never isn't aren't wasn't don't nobody jamais nicht kein keine niemals nunca",
    REPORTED: "said says told wrote quoted called reported dit disait sagte schrieb dijo escribió",
    THREAT: "kill hurt destroy beat stab shoot tuer töten matar",
    INSULT: "",
}
STRIP = ".,;:!?\"'()[]{}<>*%$#&|-_"
ENDS = b".!?;"


def normal(word: bytes) -> str:
    return word.decode("utf-8", "replace").strip(STRIP).lower()


# --- the grammar ------------------------------------------------------------

@dataclass
class Transducer:
    """A machine over symbols: ``step(state, symbol) -> (state, mark)``,
    states 0..size-1 starting at 0. The mark says what holds at the symbol."""
    size: int
    step: Callable[[int, int], tuple[int, int]]


def span_after(trigger: int, length: int) -> Transducer:
    """Marks the ``length`` words that follow a trigger inside its clause."""
    def step(state: int, symbol: int) -> tuple[int, int]:
        if symbol == END:
            return 0, 0
        return (length if symbol == trigger else max(state - 1, 0)), int(state > 0)
    return Transducer(length + 1, step)


def clause_after(trigger: int) -> Transducer:
    """Marks the rest of the clause that follows a trigger."""
    def step(state: int, symbol: int) -> tuple[int, int]:
        if symbol == END:
            return 0, 0
        return int(state or symbol == trigger), state
    return Transducer(2, step)


def repeated() -> Transducer:
    """Marks an attack that follows another one in its clause."""
    def step(state: int, symbol: int) -> tuple[int, int]:
        if symbol == END:
            return 0, 0
        return int(state or symbol in (INSULT, THREAT)), state
    return Transducer(2, step)


def compose(machines: list[Transducer]) -> tuple[np.ndarray, np.ndarray]:
    """One machine that runs all: tables next[state, symbol] and
    event[state, symbol] (0: none; else 1 + marks * 2 + (1 for a threat))."""
    size = int(np.prod([m.size for m in machines]))
    following = np.zeros((size, 7), np.int32)
    event = np.zeros((size, 7), np.int32)
    for state in range(size):
        parts, rest = [], state
        for m in machines:
            parts.append(rest % m.size)
            rest //= m.size
        for symbol in range(7):
            to, marks, factor = 0, 0, 1
            for k, (m, s) in enumerate(zip(machines, parts, strict=True)):
                n, mark = m.step(s, symbol)
                to += n * factor
                factor *= m.size
                marks |= mark << k
            following[state, symbol] = to
            if symbol in (INSULT, THREAT):
                event[state, symbol] = 1 + 2 * marks + (symbol == THREAT)
    return following, event


MARKS = ["negated", "reported", "targeted", "repeated"]
N_EVENTS = 1 + 2 * (1 << len(MARKS))


def grammar() -> tuple[np.ndarray, np.ndarray]:
    return compose([span_after(NEGATION, NEGATION_SPAN), clause_after(REPORTED), span_after(TARGET, TARGET_SPAN), repeated()])


def event_name(event: int) -> str:
    marks = [m for k, m in enumerate(MARKS) if (event - 1) // 2 >> k & 1]
    return "-".join([*marks, "threat" if (event - 1) % 2 else "insult"])


class Symbols(dict):
    """Symbol of each word (bytes), looked up once per distinct word."""

    def __init__(self, words: dict[str, int], prefixes: dict[str, int]):
        super().__init__()
        self.words, self.prefixes = words, prefixes
        self.lengths = sorted({len(p) for p in prefixes})

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 19:
            self.clear()
        text = normal(word)
        symbol = self.words.get(text, OTHER)
        if symbol == OTHER:
            for n in self.lengths:
                if len(text) >= n and (hit := self.prefixes.get(text[:n])):
                    symbol = hit
                    break
        self[word] = symbol = symbol + 8 * (word[-1] in ENDS)    # the clause ends after it
        return symbol


def clauses(text: bytes, symbols: Symbols, machine: tuple[np.ndarray, np.ndarray]) -> tuple[list[list[int]], int]:
    """The events of each clause that has any, and the number of words."""
    words = text.split()
    codes = list(map(symbols.__getitem__, words))
    if {INSULT, THREAT, INSULT + 8, THREAT + 8}.isdisjoint(codes):
        return [], len(words)
    following, event = machine
    out, now, state = [], [], 0
    for code in codes:
        symbol = code & 7
        if e := event[state, symbol]:
            now.append(int(e))
        state = following[state, symbol]
        if code & 8:
            state = following[state, END]
            if now:
                out.append(now)
                now = []
    if now:
        out.append(now)
    return out, len(words)


# --- learning ---------------------------------------------------------------

@dataclass
class Model:
    """Lexicon, a weight per event, and the logistic curve of the evidence."""
    words: dict[str, int]
    prefixes: dict[str, int]
    weights: np.ndarray
    curve: np.ndarray

    def probability(self, evidence: tuple[float, float]) -> float:
        z = self.curve[0] + self.curve[1] * np.log1p(max(evidence[0], 0.0)) + self.curve[2] * evidence[1]
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def sample_of(labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``rows`` labelled rows, those with the smallest id hash."""
    return labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def term_counts(texts: DataFrame) -> DataFrame:
    """(term, prefix, toxic, clean): documents of each class with the term.
    Counts are summed within a task before they are shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> pd.DataFrame:
            terms = set(sums[0]) | set(sums[1])
            f = pd.DataFrame([(t[1:], t[0] == "^", sums[1][t], sums[0][t]) for t in terms], columns=["term", "prefix", "toxic", "clean"])
            sums[0].clear()
            sums[1].clear()
            return f

        for pdf in batches:
            for text, y in zip(pdf["text"], pdf["y"], strict=True):
                terms = {normal(w) for w in set(text.split())}
                starts = {"^" + w[:n] for w in terms for n in PREFIXES if len(w) >= n}
                sums[y].update(starts.union("=" + w for w in terms if w))
                if len(sums[0]) + len(sums[1]) > TERM_ROWS:
                    yield flush()
        yield flush()

    return (texts.mapInPandas(run, "term string, prefix boolean, toxic long, clean long")
            .groupBy("term", "prefix").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))


def learn_lexicon(texts: DataFrame, toxic: int, clean: int, min_documents: int = MIN_DOCUMENTS,
                  min_precision: float = MIN_PRECISION, chance: float = CHANCE) -> tuple[dict[str, int], dict[str, int]]:
    """Words and word beginnings that mark toxic documents.

    Kept terms need ``chance`` / log(all / toxic) toxic documents of the
    sample, so their number is bounded by the sample's.
    """
    words = {w: c for c, ws in FUNCTION_WORDS.items() for w in ws.split() if c != THREAT}
    if not toxic or not clean:
        return words, {}
    need = max(min_documents, int(np.ceil(chance / np.log((toxic + clean) / toxic))))
    kept = (term_counts(texts).filter((F.col("toxic") >= need) & (F.col("toxic") >= min_precision * (F.col("toxic") + F.col("clean"))))
            .collect())
    threats = set(FUNCTION_WORDS[THREAT].split())
    words |= {r["term"]: THREAT if r["term"] in threats else INSULT for r in kept if not r["prefix"]}
    return words, {r["term"]: INSULT for r in kept if r["prefix"]}


def learn_weights(samples: list[tuple[Counter, int]]) -> np.ndarray:
    """Log odds of each event in toxic against clean documents, smoothed
    towards what its marks suggest."""
    prior = np.ones(N_EVENTS)
    for e in range(1, N_EVENTS):
        marks = (e - 1) // 2
        prior[e] = 2.0 * (0.4 if marks & 1 else 1) * (0.5 if marks & 2 else 1) * (1.3 if marks & 4 else 1) * (1.1 if marks & 8 else 1)
    seen = np.zeros((2, N_EVENTS))
    total = np.ones(2)
    for events, y in samples:
        total[y] += 1
        for e in events:
            seen[y, e] += 1
    odds = np.log((seen[1] + 1) / total[1]) - np.log((seen[0] + 1) / total[0])
    n = seen.sum(0)
    return (prior * 5 + odds * n) / (5 + n)


def fit_curve(x: np.ndarray, y: np.ndarray, steps: int = 50, ridge: float = 0.02) -> np.ndarray:
    """Logistic regression by Newton steps."""
    z = np.column_stack([np.ones(len(x)), np.log1p(np.maximum(x[:, 0], 0)), x[:, 1]])
    b = np.zeros(3)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        g = z.T @ (y - p) - ridge * b
        h = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(3)
        move = np.linalg.solve(h, g)
        b += move
        if np.abs(move).max() < 1e-9:
            break
    return b


def fit(texts: DataFrame, **options) -> Model:
    """Fit on a staged, bounded sample of (doc_id, text binary, y int)."""
    n = {r["y"]: r["n"] for r in texts.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    mean = toxic / (toxic + clean) if toxic + clean else 0.5
    words, prefixes = learn_lexicon(texts, toxic, clean, **options)
    if not toxic or not clean:
        start = 0.0 if mean == 0.5 else (30.0 if mean == 1 else -30.0)
        return Model(words, prefixes, np.ones(N_EVENTS), np.array([start, 0.0, 0.0]))
    machine = grammar()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        symbols = Symbols(words, prefixes)
        for pdf in batches:
            found = [clauses(t, symbols, machine) for t in pdf["text"]]
            yield pd.DataFrame({"y": pdf["y"], "events": [[e for c in f for e in c] for f, _ in found],
                                "ends": [np.cumsum([len(c) for c in f]).tolist() for f, _ in found], "n": [k for _, k in found]})

    # One small row for each row of the bounded sample.
    rows = texts.mapInPandas(run, "y int, events array<int>, ends array<int>, n long").collect()
    weights = learn_weights([(Counter(r["events"]), r["y"]) for r in rows])
    x = np.zeros((len(rows), 2))
    for i, r in enumerate(rows):
        begin = 0
        for end in r["ends"]:
            x[i, 0] += max(weights[e] for e in r["events"][begin:end])
            begin = end
        x[i, 1] = x[i, 0] / np.sqrt(max(r["n"], 1))
    return Model(words, prefixes, weights, fit_curve(x, np.array([r["y"] for r in rows], float)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, clauses): probability and number of matched clauses."""

    machine = grammar()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        symbols = Symbols(model.words, model.prefixes)
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                found, n = clauses(text, symbols, machine)
                total = sum(max(model.weights[e] for e in c) for c in found)
                out.append((model.probability((total, total / np.sqrt(max(n, 1)))), len(found)))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": [s for s, _ in out], "clauses": [c for _, c in out]})

    # Ids travel as text, so that null ids stay null.
    return (docs.select(F.col(id_col).cast("string").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
            .mapInPandas(run, "doc_id string, score double, clauses long")
            .select(F.col("doc_id").cast("long").alias("doc_id"), "score", "clauses"))


def classify(docs: DataFrame, labels: DataFrame, held_out: Column, label_col: str = "toxic", threshold: float = 0.5,
             id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted, clauses) of every document.
    ``held_out`` is a condition on ``doc_id``; its labels are never read."""
    own = (labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y"))
           .filter(~held_out & F.col("y").isin(0, 1)))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    # The sample has at most sample_rows ids, so its size is proven.
    model = fit(stage(texts.join(F.broadcast(stage(sample_of(own, sample_rows), "sample")), "doc_id").select("doc_id", "text", "y"), "labelled"), **options)
    return (score(docs, model, id_col, text_col)
            .select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "clauses"))
