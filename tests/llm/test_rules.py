from collections import Counter

from odonto.llm import rules


def brute(text):
    words = (text or "").encode().split()
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    tri = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    seen = Counter(tri)
    hit = set()
    for i, t in enumerate(tri):
        if seen[t] > 1:
            hit |= {i, i + 1, i + 2}
    return (len(words), sum(len(w.decode()) for w in words), sum(c in rules.SYMBOLS for c in text or ""),
            len(lines) - len(set(lines)), len(hit))


def test_measures_match_brute_force(docs_of, odd):
    texts = ["a b c a b c d", "x\nx\n\n x\ny", "a b a b a b a", "# $ <tag> %", "one two", " nbsp is a word char"]
    for df in (docs_of(texts), odd):
        rows = df.select("doc_id", "text").collect()
        got = rules.measure(df).collect()
        want = sorted((r.doc_id if r.doc_id is not None else -1, *brute(r.text)) for r in rows)
        have = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got)
        assert have == want


def test_policies_and_ablation(docs_of, empty):
    good = " ".join(f"word{i}" for i in range(60))
    led = rules.measure(docs_of([good, "too short", "w " * 100, good + " ###" * 20]))
    kept = {r.doc_id: (r.base_failed, r.kept) for r in rules.apply_policy(led).collect()}
    assert kept == {0: (False, True), 1: (True, False), 2: (True, False), 3: (False, False)}
    assert {r.doc_id: r.kept for r in rules.apply_policy(led, "base-1").collect()} == {0: True, 1: False, 2: False, 3: True}
    ab = {(r.policy, r.rule): (r.n_failed, r.n_only, r.n_rejected) for r in rules.ablate(led).collect()}
    assert ab["prose-1", "few_words"][0] == 1 and ab["prose-1", "many_symbols"][1] == 1
    assert ab["base-1", "few_words"][2] == 2
    assert rules.apply_policy(rules.measure(empty)).count() == 0


def test_keep_documents_keeps_columns(docs_of):
    good = " ".join(f"word{i}" for i in range(60))
    df = docs_of([good, "short"])
    out = rules.keep_documents(df)
    assert out.columns == df.columns and [r.doc_id for r in out.collect()] == [0]
