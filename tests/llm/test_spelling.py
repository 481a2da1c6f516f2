import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from odonto.llm import spelling


def brute_words(rows):
    out = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(words):
    out = {}
    for w, n in words.items():
        close = [x for x in words if one_edit(w, x)]
        best = min(close, key=lambda x: (-words[x], x), default=None)
        out[w] = (best if best and words[best] >= 5 * n else None, len(close))
    def root(w):
        return root(out[w][0]) if out[w][0] else w
    return {w: (form, root(w), words[w], k, words.get(form)) for w, (form, k) in out.items()}


def result(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("block", [512, 3])
def test_variants_match_brute_force(spark, block):
    rng = random.Random(12)
    words = {}
    for _ in range(6):
        for size in (6, 7, 12):
            base = "".join(rng.choices("abé", k=size))
            for _ in range(12):
                w = list(base)
                for _ in range(rng.randrange(3)):
                    i = rng.randrange(len(w))
                    w[i:i + rng.randrange(2)] = rng.choices("abÿz", k=rng.randrange(2))
                if len(w) >= 6:
                    words["".join(w)] = rng.choice((5, 6, 25, 30, 125, 700, 4000))
    words |= {"aaaaaa": 9, "aaaaaaa": 9, "aaaaaaaa": 45, "x" * 5000: 5, "x" * 5001: 30, "y" + "x" * 4999: 5}
    got = result(spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long"), block=block))
    assert got == brute(words)
    assert sum(f is not None for f, *_ in got.values()) > 20


def test_words_match_brute_force(docs_of, odd, empty):
    rng = random.Random(5)
    texts = [" ".join(rng.choices(["Running", "runniné", "ÉCOLES", "écoles", "short", "x1abcdef", "Wörterbuch-Seite", "×÷abcd"], k=60)) for _ in range(60)]
    for df in (docs_of(texts + [None, ""]), odd, docs_of([(None, "nothing nothing nothing nothing nothing"), (1, "a" * 70000 + " " + "abcdefg " * 9)])):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        assert {r.word: r.n for r in spelling.vocabulary(df).collect()} == brute_words(rows)
    full = docs_of(texts)
    rows = [(r.doc_id, r.text) for r in full.select("doc_id", "text").collect()]
    assert result(spelling.variants(spelling.vocabulary(full))) == brute(brute_words(rows))
    assert any(zlib.crc32(f"{i}:running".encode()) % 199 == 0 for i in range(2000))
    assert spelling.variants(spelling.vocabulary(empty)).count() == 0


def test_dropped_code_points_and_counts_beyond_the_dictionary(docs_of, monkeypatch):
    hit = [i for i in range(4000) if zlib.crc32(f"{i}:mountains".encode()) % 199 == 0]
    rows = [(i, "Mountains mountains") for i in hit] * 2 + [(i, "mountains") for i in range(40)]
    df = docs_of(rows)
    want = brute_words(rows)
    assert len(want) > 2
    assert {r.word: r.n for r in spelling.vocabulary(df.repartition(2)).collect()} == want
    monkeypatch.setattr(spelling, "HELD", 4)
    assert {r.word: r.n for r in spelling.vocabulary(df.filter(F.lit(True))).collect()} == want
