import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from odonto.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def brute(text, capacity, tk):
    ids = np.array([*tk.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
    return [(k // capacity, k, len(ids[k:k + capacity]), zlib.crc32(ids[k:k + capacity].tobytes())) for k in range(0, len(ids), capacity)]


def check_packed(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(by) == list(range(len(by)))
    return len(by)


@pytest.mark.parametrize("capacity", [16, 2048])
def test_pieces_and_places(docs_of, odd, capacity):
    tk = Tokenizer.from_file(PATH)
    rows = packing.pack_documents(odd, PATH, capacity).collect()
    key = lambda x: (-1 if x[0] is None else x[0], *x[1:])
    want = sorted(key((r.doc_id, *p)) for r in odd.select("doc_id", "text").collect() for p in brute(r.text, capacity, tk))
    assert sorted(key((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in rows) == want
    check_packed(rows, capacity)


def test_empty_table(empty):
    assert packing.pack_documents(empty, PATH).count() == 0


def test_word_ids_equal_the_tokenizer():
    tk, own = Tokenizer.from_file(PATH), packing.WordIds(PATH)
    for text in ["don't I'LL x' 'tis", "a <|endoftext|> b", "Straße ÀÉ!! naïve-ly", "µª ªb. ǅ", "a\xa0b \x85 c", "é é", "1234 3.5%", "\U0001f600 ok\x1cz"]:
        assert own.of_text(text.encode()) == np.array(tk.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=30))
def test_plan_places_every_piece_once(histogram):
    runs = packing.plan(histogram, 64, 8)
    seen = {}
    for length, lo, hi, base, offset in packing.intervals(runs):
        assert offset + length <= 64
        seen.setdefault(length, []).extend(range(lo, hi))
    assert {k: sorted(v) for k, v in seen.items()} == {k: list(range(n)) for k, n in histogram.items()}
    total = sum(k * n for k, n in histogram.items())
    assert sum(r.count for r in runs) <= 1.6 * total / 64 + 2


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(1)
    lengths = np.minimum(rng.lognormal(6.5, 1, 20000).astype(int) + 1, 2048)
    histogram = dict(zip(*[x.tolist() for x in np.unique(lengths, return_counts=True)], strict=True))
    assert sum(r.count for r in packing.plan(histogram)) <= 1.01 * -(-int(lengths.sum()) // 2048)
