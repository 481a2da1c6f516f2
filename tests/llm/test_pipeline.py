import os
import random
import shutil
import subprocess
import sys

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def documents(rng):
    word = lambda: f"w{rng.randrange(10 ** 5)}"
    good = [". ".join(" ".join(word() for _ in range(12)) for _ in range(6)) + ".\n" + " ".join(word() for _ in range(15)) for _ in range(25)]
    rows = [(i, t, "ab"[i % 2]) for i, t in enumerate(good)]
    near = good[3].split("\n")
    rows.append((40, near[0].replace("w", "v", 1) + "\n" + near[1][::-1], "a"))
    rows += [(50, "too short", "a"), (51, "### " * 100, "b"), (52, None, "a"), (53, good[5], "b")]
    return rows


def test_stages_one_by_one(spark, docs_of):
    rows = documents(random.Random(6))
    docs = docs_of(rows, clash=False)
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.stage(stage(spark, docs, ""), name.replace(" ", "-"))
        seen.append(docs)
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert docs.columns == before.columns
    kept, lined, near, mixed, packed = seen
    assert sorted(r.doc_id for r in kept.collect()) == [*range(25), 40, 53]
    # The copy loses all its lines; the near copy shares no whole line.
    assert sorted(r.doc_id for r in lined.collect()) == [*range(25), 40]
    assert {r.doc_id for r in near.collect()} <= set(range(25)) | {40}
    tk = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    want = sum(len(tk.encode(r.text, add_special_tokens=False).ids) + 1 for r in mixed.collect())
    rows = packed.collect()
    assert sum(r.length for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in v) <= 2048 for v in by.values())


def test_run_on_an_empty_table(spark, docs_of, tmp_path):
    docs_of([], clash=False).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_entry_works_without_this_subpackage(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pending_payments' in q and 'pipeline' not in q and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, timeout=120)


def test_near_dedup_links_at_four_fifths(spark, docs_of):
    def shared(a, b):
        x, y = ({tuple(t.split()[i:i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
        return len(x & y) / len(x | y)

    words = [f"w{i}" for i in range(104)]
    other = [f"v{i}" for i in range(104)]
    pairs = []
    for base, changed in ((words, 10), (other, 15)):
        copy = base[:-changed] + [f"{w}x" for w in base[-changed:]]
        pairs.append((" ".join(base), " ".join(copy)))
    (a, b), (c, d) = pairs
    assert 0.8 < shared(a, b) < 0.85 and 0.7 < shared(c, d) < 0.8
    out = corpus_pipeline.near_dedup(spark, docs_of([(1, a), (2, b), (3, c), (4, d)], clash=False), "")
    assert sorted(r.doc_id for r in out.collect()) == [1, 3, 4]
