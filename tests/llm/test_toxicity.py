import random

from pyspark.sql import functions as F

from odonto.llm import toxicity as tox
from odonto.llm.common import is_remainder


def events(text, words):
    found, _ = tox.clauses(text.encode(), tox.Symbols(words, {"zort": tox.INSULT}), tox.grammar())
    return [[tox.event_name(e) for e in c] for c in found]


def test_grammar_marks_context():
    words = {"idiot": tox.INSULT, "kill": tox.THREAT, "you": tox.TARGET, "not": tox.NEGATION, "said": tox.REPORTED}
    assert events("an idiot here", words) == [["insult"]]
    assert events("You are an idiot.", words) == [["targeted-insult"]]
    assert events("you are not an idiot. idiot!", words) == [["negated-targeted-insult"], ["insult"]]
    assert events("he said that some idiot came. you idiot", words) == [["reported-insult"], ["targeted-insult"]]
    assert events("idiot and zortful, I kill you", words) == [["insult", "repeated-insult", "repeated-threat"]]
    assert events("not one two three four idiot", words) == [["insult"]]
    assert events("nothing of the kind", words) == [] and events("", words) == []


def corpus(rng, n):
    rows, labels = [], []
    bad = ["blorg", "snarf", "zortal", "zortun", "zortix"]
    for i in range(n):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(5, 60))]
        toxic = rng.random() < .25
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words) + 1), rng.choice(bad) + rng.choice(["", ",", "."]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark, docs_of):
    rows, labels = corpus(random.Random(3), 400)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = tox.classify(docs_of(rows), lab, is_remainder(F.col("doc_id"), 5, 0)).collect()
    truth = {i: t for i, _, t in labels}
    held = [r for r in out if r.held_out]
    assert len(out) == 400 and len(held) > 40 and all(0 <= r.score <= 1 for r in out)
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > .95
    assert not any(r.predicted for r in held if not truth[r.doc_id])


def test_odd_rows_and_missing_labels(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = tox.classify(odd, none, is_remainder(F.col("doc_id"), 5, 0)).collect()
    assert len(rows) == odd.count() and {r.score for r in rows} == {0.5}
    one = spark.createDataFrame([(3, 1, 0), (3, 1, None), (4, 0, 0)], "doc_id long, quality int, toxic int")
    assert all(r.score < .01 for r in tox.classify(odd, one, is_remainder(F.col("doc_id"), 5, 0)).collect())
    assert tox.classify(empty, none, is_remainder(F.col("doc_id"), 5, 0)).count() == 0


def test_sample_is_bounded(spark):
    lab = spark.range(100).select(F.col("id").alias("doc_id"), F.lit(1).alias("y"))
    a, b = ({r.doc_id for r in tox.sample_of(x, 7).collect()} for x in (lab, lab.repartition(5)))
    assert a == b and len(a) == 7
