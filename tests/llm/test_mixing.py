import numpy as np

from odonto.llm import mixing


def test_share_reshapes_the_excess():
    t = mixing.share([100, 100, 10], [1, 2, 3])
    assert abs(sum(t) - 210) < 1e-9 and t[2] == 30 and abs(t[0] - 60) < 1e-9 and abs(t[1] - 120) < 1e-9
    assert mixing.share([0, 5], [1, 2]) == [0.0, 5.0] and mixing.share([], []) == []


def test_permutation():
    for size in (1, 2, 3, 5, 17, 64, 100):
        for key in (1, 99):
            p = mixing.permute(np.arange(size), np.full(size, size), np.full(size, key))
            assert sorted(p) == list(range(size))


def test_taken_is_near_target_and_reruns_agree(docs_of):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join("w" for _ in range(int(rng.integers(0, 400)))), [None, "b", "a", "c"][i % 4]) for i in range(200)]
    df = docs_of(rows)
    got = sorted(tuple(r) for r in mixing.taken(mixing.mix(df, block_words=16)).select("doc_id", "source", "size", "source_size", "target", "taken").collect())
    again = sorted(tuple(r) for r in mixing.taken(mixing.mix(df.repartition(7), block_words=16)).select("doc_id", "source", "size", "source_size", "target", "taken").collect())
    assert got == again and len(got) == 200
    sizes = {i: len(t.split()) for i, t, _ in rows}
    by = {}
    for i, source, size, source_size, target, taken in got:
        assert size == sizes[i] and 0 <= taken <= 3 * size
        x = by.setdefault(source, [0, 0, target, source_size])
        x[0] += size
        x[1] += taken
    names = ["a", "b", "c", None]
    want = mixing.share([by[n][0] for n in names], [1, 2, 3, 1])
    for n, w in zip(names, want, strict=True):
        size, taken, target, source_size = by[n]
        assert source_size == size and abs(target - w) < 1e-6 and abs(taken - w) <= 16


def test_slots_use_no_block_twice_in_a_pass(docs_of):
    m = mixing.mix(docs_of([(i, "w " * 50, "a" if i else "b") for i in range(20)]), block_words=8, shard_slots=16)
    slots = [(r.s, r["pass"], r.block) for r in m.slots.collect()]
    assert len(slots) == len(set(slots))
    need = {i: s[4] for i, s in enumerate(m.sources)}
    for s, k in need.items():
        assert sum(x[0] == s for x in slots) == k


def test_odd_rows(odd, empty):
    rows = mixing.taken(mixing.mix(odd)).collect()
    assert len(rows) == odd.count() and all(r.taken <= 3 * r.size for r in rows)
    assert mixing.taken(mixing.mix(empty)).count() == 0


def test_mixed_documents_hold_the_words_taken(docs_of):
    df = docs_of([(i, " ".join(f"d{i}w{k}" for k in range(30 + i)), "ab"[i % 2]) for i in range(12)])
    out = mixing.mixed_documents(df, block_words=8)
    assert out.columns == df.columns
    words = {}
    for r in out.collect():
        assert r.n_chars == len(r.text)
        assert all(w.startswith(f"d{r.doc_id}w") for w in r.text.split())
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
    want = {r.doc_id: r.taken for r in mixing.taken(mixing.mix(df, block_words=8)).collect() if r.taken}
    assert words == want
