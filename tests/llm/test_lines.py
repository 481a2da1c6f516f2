import random

from pyspark.sql import functions as F

from odonto.llm import lines


def distance(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j - 1] + (x != y), prev[j] + 1, cur[j - 1] + 1))
        prev = cur
    return prev[-1]


def mutated(rng, text, edits):
    s = list(text)
    for _ in range(edits):
        p, kind = rng.randrange(len(s) + 1), rng.randrange(3)
        if kind == 0 and s:
            s[min(p, len(s) - 1)] = rng.choice("abcé")
        elif kind == 1 and s:
            del s[min(p, len(s) - 1)]
        else:
            s.insert(p, rng.choice("abcé"))
    return "".join(s)


def test_edit_distance(spark):
    rng = random.Random(1)
    pairs = []
    for _ in range(150):
        a = "".join(rng.choice("abcé") for _ in range(rng.randrange(0, 14)))
        pairs.append((a, mutated(rng, a, rng.randrange(0, 4))))
    df = spark.createDataFrame(pairs, "a string, b string")
    for k in (1, 2):
        assert all(r.w == (distance(r.a, r.b) <= k) for r in df.select("a", "b", lines.edit_within(F.col("a"), F.col("b"), k).alias("w")).collect())


def brute(rows, edits):
    seen, out = [], {}
    for i, text in rows:
        kept, gone = [], 0
        for x in (text or "").split("\n"):
            s = x.strip(" \t\n\x0b\x0c\r")
            if len(s) < lines.MIN_CHARS:
                kept.append(x)
                continue
            if any(abs(len(o) - len(s)) <= edits and distance(s, o) <= edits for o in seen):
                gone += 1
            else:
                kept.append(x)
            seen.append(s)
        out[i] = (gone, "\n".join(kept))
    return out


def test_matches_brute_force(docs_of):
    rng = random.Random(2)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(20, 50))).strip().ljust(20, "x") for _ in range(30)]
    rows = [(i, "\n".join([mutated(rng, rng.choice(base), rng.choice((0, 0, 1, 2))) for _ in range(rng.randrange(1, 5))] + ["", "short"])) for i in range(60)]
    for edits in (1, 2):
        got = {r.doc_id: (r.n_removed, r.kept_text) for r in lines.dedup_lines(docs_of(rows), edits=edits).collect()}
        assert got == brute(rows, edits)


def test_odd_rows_and_columns(docs_of, odd, empty):
    got = lines.dedup_lines(odd).collect()
    assert len(got) == odd.count() and all(r.n_removed == 0 for r in got if r.doc_id in (0, 1, 2))
    assert lines.dedup_lines(empty).count() == 0
    line = "a line that is long enough to count"
    df = docs_of([(1, line), (2, line + "\n" + line[::-1]), (3, "  " + line + " "), (4, line[:-1] + "?"), (None, line), (5, "short"), (6, "short"), (7, None)])
    out = lines.deduped_documents(df)
    assert out.columns == df.columns
    rows = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert rows == {1: (line, len(line)), 2: (line[::-1], len(line)), 5: ("short", 5), 6: ("short", 5), 7: (None, 0)}


def test_crowded_keys_are_cut(docs_of, monkeypatch):
    rng = random.Random(3)
    head = "".join(rng.choice("abcdefgh ") for _ in range(90))
    tails = ["".join(rng.choice("0123456789") for _ in range(12)) for _ in range(150)]
    tails += [mutated(rng, t, rng.randrange(1, 4)) for t in tails[:50]]
    rows = [(i, head + t) for i, t in enumerate(tails)]
    met, meetings = [], lines._meetings
    monkeypatch.setattr(lines, "_meetings", lambda *a: (met.append(x := meetings(*a)), x)[1])
    near = {i for i, t in enumerate(tails) if any(distance(t, u) <= 2 for u in tails[:i])}
    # Blocks at once; blocks after two levels of segments; after all levels.
    for meet, most in ((512, 600), (8, 40), (8, 600)):
        monkeypatch.setattr(lines, "MOST_KEYS", most)
        rows_ = lines._rows(docs_of(rows), "doc_id", "text")
        assert {r.doc for r in lines.removals(rows_, meet=meet, block=16).collect()} == near
    pairs = met[0][0].count()
    assert 0 < pairs < 4 * len(tails)


def test_one_template_meets_its_earliest_line(docs_of):
    rows = [(i, f"a template line with the place {a}, and another one {b}, and a long end that never changes") for i, (a, b) in
            enumerate((a, b) for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmnopqrst")]
    got = {r.doc_id: r.n_near for r in lines.dedup_lines(docs_of(rows)).collect()}
    assert got == {i: int(i > 0) for i, _ in rows}


def test_edits_of_all_kinds_and_numbers(docs_of):
    rng = random.Random(9)
    base = ["".join(rng.choice("abc") for _ in range(n)) for n in (20, 21, 31, 32, 33, 63, 64, 65, 127, 128, 129, 300)]
    rows = [(i, "\n".join(mutated(rng, rng.choice(base), rng.randrange(0, 4)) for _ in range(4))) for i in range(45)]
    rows += [(100, "a" * 40 + "\n" + "a" * 42 + "\n" + "a" * 45 + "\n" + "ab" * 20), (101, "a" * 41 + "b\n" + "ba" * 20)]
    for edits in (1, 2, 3):
        got = {r.doc_id: (r.n_removed, r.kept_text) for r in lines.dedup_lines(docs_of(rows), edits=edits).collect()}
        assert got == brute(rows, edits)


def test_trimmed_pairs_keep_their_distance(spark):
    rng = random.Random(6)
    pairs = [("", ""), ("a", "a"), ("ab" * 9000, "ab" * 9000 + "c"), ("x" * 20000, "x" * 20000)]
    for _ in range(120):
        a = "".join(rng.choice("abé") for _ in range(rng.randrange(0, 40)))
        pairs.append((a, mutated(rng, a, rng.randrange(0, 4))))
    df = spark.createDataFrame(pairs, "x string, y string").withColumn("t", lines.trimmed(F.col("x"), F.col("y")))
    for r in df.collect():
        a, b = r.t
        if len(r.x) < 100:
            assert not (a and b) or (a[0] != b[0] and a[-1] != b[-1])
            assert distance(r.x, r.y) == distance(a, b)
        else:
            assert len(b) - len(a) == len(r.y) - len(r.x) and len(a) < len(r.x) / 4


def test_sketches_differ_little(spark):
    rng = random.Random(8)
    pairs = [("", "a"), ("a", "ab"), ("é" * 64, "é" * 65), ("é" * 65, "é" * 66)]
    for _ in range(120):
        a = "".join(rng.choice("abcdefgé ") for _ in range(rng.randrange(0, 200)))
        pairs.append((a, mutated(rng, a, 2)))
    df = spark.createDataFrame(pairs, "x string, y string")
    found = df.select(F.bit_count(lines.sketch(F.col("x")).bitwiseXOR(lines.sketch(F.col("y")))).alias("n")).collect()
    assert all(r.n <= 8 for r in found) and any(r.n for r in found)


def test_query_removes_two_edits_and_short_equal_lines(spark, docs_of, tmp_path):
    from odonto.llm import queries
    line = "all rights are reserved by the publisher, page 17 of the yearly report"
    rows = [(1, line + "\nMenu"), (2, line.replace("17", "42") + "\n Menu\n\nMenus"), (3, line.replace("17", "4203") + "\n\n")]
    docs_of(rows, clash=False).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op7_line_dedup"](spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.n_lines, r.n_equal, r.n_near) for r in got} == {1: (2, 0, 0), 2: (3, 1, 1), 3: (1, 0, 1)}
