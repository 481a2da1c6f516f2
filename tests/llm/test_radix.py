import hashlib
import random
from collections import defaultdict

from odonto.llm import radix


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        same = groups[t or ""]
        top = max(same, key=lambda x: (x is not None, x or 0))
        out.append((-1 if i is None else i, -1 if top is None else top, len(same), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out)


def result(df, **options):
    rows = radix.equal_texts(df, **options).collect()
    stays = defaultdict(int)
    for r in rows:
        stays[r.text_sha256] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(stays.values()) <= {1}
    return sorted((-1 if r.doc_id is None else r.doc_id, -1 if r.keep_id is None else r.keep_id, r.group_size, r.text_sha256) for r in rows)


def test_groups_match_brute_force(docs_of):
    rng = random.Random(11)
    stems = ["", "a", "aé", "x" * 127, "x" * 128, "x" * 129, "é" * 32, "日本" * 700, "long " * 5000]
    rows = [rng.choice(stems) + rng.choice(["", "", "y", "z" * 128, "\x00", " "]) for _ in range(160)]
    rows = list(zip(rng.sample(range(-500, 500), len(rows)), rows, strict=True))
    assert result(docs_of(rows)) == brute(rows)
    # Narrow slices: many rounds, slices that cut a character apart.
    assert result(docs_of(rows[:60]), first=1, growth=3) == brute(rows[:60])


def test_odd_rows(odd, empty, docs_of):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert result(odd) == brute(rows)
    nulls = [(None, "same"), (None, "same"), (4, None), (None, "")]
    assert result(docs_of(nulls)) == brute(nulls)
    assert radix.equal_texts(empty).count() == 0


def test_distinct_documents_keep_their_columns(docs_of):
    df = docs_of([(1, "one"), (2, "one"), (3, "two"), (3, "two"), (4, None), (5, "")])
    out = radix.distinct_documents(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id, r.text, r.score) for r in out.select("doc_id", "text", "score").collect()) == \
        [(2, "one", "clash"), (3, "two", "clash"), (5, "", "clash")]
