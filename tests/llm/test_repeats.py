import hashlib
import random

import numpy as np

from odonto.llm import repeats
from odonto.llm.shingles import sliding_argmin


def brute(rows, length):
    first, out = {}, []
    last = repeats.LAST_ID
    for i, text in rows:
        words = (text or "").encode().split()
        for s in range(len(words) - length + 1):
            w = tuple(words[s:s + length])
            first[w] = min(first.get(w, last), last if i is None else i)
    for i, text in rows:
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for s in range(len(words) - length + 1):
            if first[tuple(words[s:s + length])] < (last if i is None else i):
                gone[s:s + length] = [True] * length
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((i if i is not None else -1, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def result(df, **options):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_removed, r.kept_sha256) for r in repeats.remove_repeats(df, **options).collect())


def test_small_vocabulary_matches_brute_force(docs_of):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 40)))) for i in range(60)]
    for length, seed in ((4, 2), (6, 3), (3, 3)):
        assert result(docs_of(rows), length=length, seed=seed) == brute(rows, length)


def test_passages_copies_and_shared_ids(docs_of):
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10 ** 6)}"
    passage = " ".join(word() for _ in range(20))
    own = [" ".join(word() for _ in range(30)) for _ in range(8)]
    rows = [(9, own[0] + " " + passage), (1, passage + " " + own[1]), (5, own[2] + " " + passage + " " + own[3]), (6, own[0] + " " + passage),
            (6, own[0] + " " + passage), (7, own[4]), (7, own[4] + " " + passage), (None, passage), (None, passage), (12, " ".join(passage.split()[:12]))]
    df = docs_of(rows)
    assert result(df) == brute(rows, 13)
    spans = {r.doc_id: r.passages for r in repeats.remove_repeats(df).collect()}
    assert spans[5] == [[30, 50]] and spans[1] == []
    kept = {r.doc_id: r.kept_text for r in repeats.remove_repeats(df, with_text=True).collect()}
    assert kept[5] == own[2] + " " + own[3]


def test_odd_rows(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert result(odd) == brute(rows, 13)
    assert repeats.remove_repeats(empty).count() == 0


def test_sliding_argmin():
    x = np.array([5, 3, 3, 9, 1, 1, 7], np.uint64)
    assert sliding_argmin(x, 3).tolist() == [1, 1, 4, 4, 4]
    assert sliding_argmin(x, 9).tolist() == []


def test_many_unlike_texts_under_one_id(docs_of):
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(30))
    texts = [" ".join([f"w{rng.randrange(10 ** 6)}" for _ in range(rng.choice((1, 90)))] + [passage] * rng.choice((0, 1, 5))) for _ in range(500)]
    rows = [(rng.choice((None, None, 3, 4)), t) for t in texts]
    assert result(docs_of(rows)) == brute(rows, 13)
