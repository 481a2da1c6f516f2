import os
import random
import subprocess
import sys

import numpy as np

from odonto.llm import neardup
from odonto.llm.shingles import WordHashes

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def brute(rows):
    def grams(text):
        words = (text or "").encode().lower().split()
        return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else {tuple(words)} if words else set()
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    sets = [(i, grams(t)) for i, t in rows]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and i is not None and j is not None and 100 * len(a & b) >= 85 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted((-1 if i is None else i, len(s), -1 if i is None else find(i)) for i, s in sets)


def result(df, **options):
    rows = neardup.near_duplicates(df, **options).collect()
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in rows)
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in rows)


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10 ** 6)}"
    return " ".join(out)


def test_groups_match_brute_force(docs_of):
    rng = random.Random(4)
    rows = []
    for _ in range(6):
        base = [f"w{rng.randrange(10 ** 6)}" for _ in range(rng.choice((8, 60, 150)))]
        rows += [edited(rng, base, rng.choice((0, 0, 1, 2, 3, 5, 9))) for _ in range(14)]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    # Small blocks make every bucket meet itself in several tasks.
    assert result(docs_of(rows), block=4) == brute(rows)


def test_odd_rows_and_shared_ids(docs_of, odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert result(odd) == brute(rows)
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(5, a), (3, b), (9, a), (9, b), (None, a)]
    assert result(docs_of(rows)) == [(-1, 26, -1), (3, 26, 3), (5, 26, 3), (9, 26, 3), (9, 26, 3)]
    assert neardup.near_duplicates(empty).count() == 0


def test_estimate_is_corrected():
    rng = np.random.default_rng(1)
    s, of = neardup.Sketcher(), WordHashes().of_words
    del of
    for j in (0.0, 0.5, 0.85, 1.0):
        got = []
        for _ in range(40):
            pool = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
            n = int(200 * 2 * j / (1 + j))
            a, b = pool[:200], np.concatenate([pool[:n], pool[200:400 - n]])
            x, y = (np.frombuffer(s.packed(s.minima(np.sort(v))), np.uint64) for v in (a, b))
            got.append(float(neardup.estimate(x, y)))
        assert abs(np.mean(got) - j) < 0.03


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (90, 95)], "a long, b long")
    got = {r.node: r.component for r in neardup.components(links).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 90: 90, 95: 90, 100: 90}


def test_distinct_documents(docs_of):
    a = " ".join(f"a{i}" for i in range(30))
    df = docs_of([(1, a), (2, a), (3, a + " x"), (4, "other words here entirely different"), (4, "other words here entirely different"), (5, None), (None, a)])
    out = neardup.distinct_documents(df)
    assert out.columns == df.columns
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in out.collect()) == [-1, 1, 4, 5]


def test_unlike_texts_of_one_id_all_stay(docs_of):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    df = docs_of([(4, a), (4, b), (4, b), (5, b + " x"), (6, a), (7, "no words of the others in this one"), (None, a)])
    out = neardup.distinct_documents(df, percent=80)
    assert out.columns == df.columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert len(got) == 4 and (None, a) in got and (7, "no words of the others in this one") in got
    assert sum(t.startswith("a0") for _, t in got) == 2 and sum(t.startswith("b0") for _, t in got) == 1


def test_workers_need_no_copy_of_the_package(tmp_path):
    """Operators 4, 6, 11, 12 and 13 in a session whose workers can't import it."""
    code = f"""
import sys; sys.path.insert(0, {ROOT!r})
from odonto.session import build_session
from odonto.llm import audit, neardup, radix, repeats, spelling
from pyspark.sql import functions as F
spark = build_session("local[2]", 2, extra={{"spark.checkpoint.dir": {str(tmp_path / "ckpt")!r}}})
def found(_):
    import importlib.util
    return importlib.util.find_spec("odonto") is not None
assert not any(spark.sparkContext.parallelize([1, 2], 2).map(found).collect())
text = " ".join(f"running{{chr(97 + i)}}" for i in range(20))
d = spark.createDataFrame([(1, text, "en"), (2, text, "en"), (3, text + " " + text, None)], "doc_id long, text string, lang string")
labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
assert {{r.doc_id: r.n_removed for r in repeats.remove_repeats(d).collect()}} == {{1: 0, 2: 20, 3: 40}}
assert sum(r.kept for r in neardup.near_duplicates(d).collect()) == 2
assert neardup.distinct_documents(d).count() == 2 and radix.distinct_documents(d).count() == 2
assert spelling.variants(spelling.vocabulary(d, 2, drop=0)).count() == 20
assert audit.audit(d, labels).count() == 1200
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert out.returncode == 0, out.stderr[-3000:]
