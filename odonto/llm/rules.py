"""Operator 3: quality rules as a bitmask ledger (DataFrame functions only).

Every rule is evaluated once per document. The ledger keeps the measurements
and one bit per failed rule; a policy is a named, versioned set of rules, and
applying one is a bitwise AND. Ablations (what each rule of a policy costs,
alone and in combination) aggregate the distinct bit patterns.

Defined results: null text counts as empty; an empty or blank text has no
words and fails ``few_words``; a null id is kept as null; repeated rows give
repeated ledger rows; an empty table gives an empty ledger; other columns of
the input, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odonto.llm.common import SPACE_CHARS, let, words_of

#: Fixed by the contract.
SYMBOLS = "#*$%&|<>"

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shouts"]


def _rules() -> dict[str, Column]:
    """Rule name -> condition that a failing document meets. The order fixes
    the bit numbers, so new rules are appended."""
    n = F.col("n_words")
    return {
        "few_words": n < 50,
        "repeated_words": 100 * F.col("n_repeat_words") > 50 * n,
        "many_symbols": 10 * F.col("n_symbols") > n,
        "repeated_lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
        "short_words": F.col("word_chars") < 2 * n,
        "long_words": F.col("word_chars") > 20 * n,
        "shouting": 10 * F.col("n_shouts") > 3 * n,
    }


RULES = ["few_words", "repeated_words", "many_symbols", "repeated_lines", "short_words", "long_words", "shouting"]

#: Rules fixed by the contract: their failure is ``base_failed``.
BASE = ("few_words", "repeated_words")
#: Versioned policies: name -> rules whose failure rejects a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base-1": BASE,
    "prose-1": (*BASE, "many_symbols", "repeated_lines", "short_words", "long_words", "shouting"),
}
PRODUCTION = "prose-1"


def mask(rules: tuple[str, ...]) -> int:
    return sum(1 << RULES.index(r) for r in rules)


def _in_repeated_windows(words: Column) -> Column:
    """Words inside a 3-word window that occurs twice or more in the text.

    Windows are hashed once. If all hashes differ the answer is 0; otherwise
    (hash, position) pairs are sorted, those with an equal neighbour kept, and
    the lengths of their union summed: n log n for any text.
    """
    def of_positions(p: Column) -> Column:
        steps = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1), x + 3) - x))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def of_sorted(s: Column) -> Column:
        kept = F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False))
                        | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
        return let(F.sort_array(F.transform(kept, lambda x: x["i"])), of_positions)

    def of_windows(w: Column) -> Column:
        pairs = F.transform(w, lambda h, k: F.struct(h.alias("h"), k.alias("i")))
        return (F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0))
                .otherwise(let(F.sort_array(pairs), of_sorted)))

    def of_words(ws: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(ws) - 3),
                             lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)))
        return F.when(F.size(ws) < 4, F.lit(0)).otherwise(let(hashes, of_windows))

    return let(words, of_words)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, the measurements and ``fail_bits``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("_t"), words_of(text).alias("_w"))
    lines = F.filter(F.split(F.col("_t"), "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    symbols = F.char_length("_t") - F.char_length(F.translate(F.col("_t"), SYMBOLS, ""))
    shouts = F.char_length("_t") - F.char_length(F.translate(F.col("_t"), "!", ""))
    m = base.select(
        "doc_id",
        F.size("_w").cast("long").alias("n_words"),
        F.char_length(F.concat_ws("", F.col("_w"))).cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"),
                                      F.size(x).cast("long").alias("n"))).alias("_l"),
        _in_repeated_windows(F.col("_w")).cast("long").alias("n_repeat_words"),
        shouts.cast("long").alias("n_shouts"))
    m = m.select("doc_id", "n_words", "word_chars", "n_symbols", F.col("_l.dup").alias("n_dup_lines"),
                 "n_repeat_words", F.col("_l.n").alias("n_lines"), "n_shouts")
    rules = _rules()
    bits = sum((F.when(rules[r], F.lit(1 << i)).otherwise(F.lit(0)) for i, r in enumerate(RULES)), F.lit(0))
    return m.withColumn("fail_bits", bits.cast("long"))


def apply_policy(ledger: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """Ledger rows with ``base_failed`` and ``kept`` under a named policy."""
    return (ledger.withColumn("base_failed", F.col("fail_bits").bitwiseAND(mask(BASE)) != 0)
            .withColumn("kept", F.col("fail_bits").bitwiseAND(mask(BASE) | mask(POLICIES[policy])) == 0))


def ablate(ledger: DataFrame, policies: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Per policy and rule: documents the rule fails, documents only it
    rejects (kept again without it), and documents the policy rejects.

    The ledger is first reduced to its distinct bit patterns, at most
    2**len(RULES) rows.
    """
    patterns = ledger.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    entries = [F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(mask(rs)).cast("long").alias("mask"),
                        F.lit(1 << RULES.index(r)).cast("long").alias("bit"))
               for p, rs in (policies or POLICIES).items() for r in rs]
    x = patterns.select("fail_bits", "n", F.explode(F.array(*entries)).alias("e"))
    hit = F.col("fail_bits").bitwiseAND(F.col("e.mask"))
    return x.groupBy(F.col("e.policy").alias("policy"), F.col("e.rule").alias("rule")).agg(
        F.sum(F.when(F.col("fail_bits").bitwiseAND(F.col("e.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(hit == F.col("e.bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(hit != 0, F.col("n")).otherwise(0)).alias("n_rejected"))


def keep_documents(docs: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """The input rows that the policy keeps, with their own columns.

    Evaluated in the scan, without a join: the measurements are added to each
    row, tested and dropped.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    packed = docs.select(row.alias("_row"), F.col("text").alias("_text"))
    ledger = apply_policy(measure(packed.select(F.col("_row").alias("doc_id"), "_text"), text_col="_text"), policy)
    return ledger.filter("kept").select("doc_id.*")
