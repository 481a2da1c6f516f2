import hashlib
import random

from odonto.llm import fingerprints as fp


def test_contract_columns_match_brute_force(docs_of):
    rng = random.Random(5)
    vocabulary = [f"t{i}" for i in range(300)]
    texts = [(i * 3, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 60)))) for i in range(60)] + [(500, "é" * 7)]
    df = docs_of(texts)
    got = {r.doc_id: r for r in fp.with_neighbours(df, fp.lexicon(df), rows_per_range=7).collect()}
    for k, (i, text) in enumerate(texts):
        edited = fp.edit(text, texts[(k + 1) % len(texts)][1]).encode()
        assert (got[i].n_chars, got[i].edited_sha256) == (len(text), hashlib.sha256(edited).hexdigest())
        after = got[texts[(k + 1) % len(texts)][0]].fingerprint
        assert got[i].near_next == fp.likeness(got[i].fingerprint, after)
        assert 0 <= got[i].near_edited <= 1


def test_lexicon_band_counts_documents(docs_of):
    df = docs_of(["common rare1 mid mid mid", "common mid", "common rare2", "common", None, ""])
    assert fp.lexicon(df, low=0.3, high=0.5) == [b"mid"]


def test_likeness_grades_similarity():
    rng = random.Random(2)
    words = [f"w{i}".encode() for i in range(5000)]
    of = fp.Fingerprinter(sorted(words))
    def mean(changed, size):
        out = []
        for _ in range(30):
            a = rng.sample(words, size)
            b = a[int(size * changed):] + rng.sample(words, int(size * changed))
            out.append(fp.likeness(of(b" ".join(a)), of(b" ".join(b))))
        return sum(out) / len(out)
    for size in (40, 400):
        light, half, all_ = mean(.05, size), mean(.5, size), mean(1.0, size)
        assert light > .6 and light > half > all_ and all_ < .06
    assert of(b"W1, w2") == of(b"w2 (w1) w1") and fp.likeness("-", "-") == 1 and fp.likeness("-", of(b"w1")) == 0


def test_odd_rows(docs_of, odd, empty):
    rows = fp.with_neighbours(odd, fp.lexicon(odd)).collect()
    assert len(rows) == odd.count()
    assert len({r.fingerprint for r in rows if r.doc_id == 7}) == 1
    assert {r.fingerprint for r in rows if r.doc_id in (0, 1, 2)} == {"-"}
    assert fp.with_neighbours(empty, fp.lexicon(empty)).count() == 0
    one = fp.with_neighbours(docs_of([(4, "abcdef")]), []).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest()
    assert {r.fingerprint for r in fp.fingerprint(odd, []).collect() if r.doc_id == 0} == {"-"}
