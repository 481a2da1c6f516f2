import random
from collections import defaultdict
from itertools import permutations

from odonto.llm import audit


def brute(rows, labels):
    """Applies every order of the filters to the documents one by one."""
    def fails(i, t, lang):
        words = t.encode().split()
        out = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
               "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": any(c in "#$%&*|" for c in t),
               "E": any((u or "") == t and j is not None and (i is None or j < i) for j, u, _ in rows)}
        return {k for k, v in out.items() if v}
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    parts = defaultdict(list)
    for i, t, lang in rows:
        parts[lang or ""].append((i, fails(i, t or "", lang)))
    out = {}
    for part, docs in parts.items():
        removed_by = defaultdict(int)
        for order in permutations("ABCDE"):
            left = list(docs)
            for step, name in enumerate(order, 1):
                gone = [d for d in left if name in d[1]]
                left = [d for d in left if name not in d[1]]
                removed_by[name] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(name in f for _, f in docs) - len(gone), sum(f == {name} for _, f in docs),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(removed_by[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def result(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 1, "clash") for r in rows], "doc_id long, text string, lang string, n int, part string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit.audit(docs, marks).collect()
    assert all(r.filter == r.filter_order[r.step - 1] for r in got)
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got}


def test_audit_matches_brute_force(spark):
    rng = random.Random(13)
    words = [f"w{i}" for i in range(900)]
    texts = [" ".join(rng.choices(words[:rng.choice((5, 900))], k=rng.choice((10, 199, 200, 400))))
             + rng.choice(("", "", " #", " |x", " ABCDEFGHIJKLMNOPQRSTUVWXYZ" * 3, " Éé")) for _ in range(40)]
    rows = [(i, rng.choice(texts), rng.choice(("en", "en", "fr"))) for i in rng.sample(range(1000), 90)]
    rows += [(None, texts[0], "en"), (None, None, None), (5000, "", ""), (5001, None, "fr"), (5002, "same id", "fr"), (5002, "same id", "en"),
             (5002, "other", "de"), (5003, "z " * 40000, "de")]
    labels = [(i, rng.choice((0, 1, None)), rng.choice((0, 1, None))) for i, *_ in rows if rng.random() < 0.7]
    labels += labels[:5] + [(None, 1, 1), (5002, 1, 1), (5002, 0, 0)]
    want = brute(rows, labels)
    assert len(want) == 600 * 4
    assert result(spark, rows, labels) == want


def test_empty_tables(spark):
    assert result(spark, [], []) == {}
    assert result(spark, [(1, "a", "x")], []) == brute([(1, "a", "x")], [])


def test_fields_never_overflow():
    n = (1 << 70) + 12345
    mask = 0b1100001
    rows = audit.tally("p", {mask: n, 0: 1, 0b10: n})
    assert set(rows["kept"] + rows["removed"]) <= {2 * n + 1, n + 1, 1}
    first = rows[(rows.filter_order == "ABCDE") & (rows.step == 1)].iloc[0]
    assert (first.kept, first.removed, first.redundant, first.good_lost, first.toxic_lost) == (n + 1, n, 0, n, n)
    assert first.unique_fails == n and first.shapley == 120 * n
