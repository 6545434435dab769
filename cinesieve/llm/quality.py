"""Quality rules as a bitmask ledger.

`ledger` evaluates every rule once a document and stores the failures as bits beside the measurements. Policies are
versioned masks over these bits: applying one, or measuring what each rule of it contributes, never reads a text again.
Everything is a projection of the row at hand: no shuffle but for the few rows of an ablation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinesieve.llm.shared import SPACES, col, let, words

#: The symbols that are counted.
SYMBOLS = "#*$%&|<>"
#: Lines that begin with a bullet, and lines that end in an ellipsis.
BULLET, ELLIPSIS = r"^[\t ]*[-*•]", r"(\.\.\.|…)[\t\r ]*$"


@dataclass(frozen=True)
class Rule:
    """A document fails where `fails` (SQL over the measurements) holds; `bit` is its place in the ledger for good."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "n_symbols > n_words"),
    Rule(3, "duplicate_lines", "2 * n_dup_lines > n_lines"),
    Rule(4, "long_words", "word_chars > 25 * n_words"),
    Rule(5, "short_words", "word_chars < 2 * n_words"),
    Rule(6, "long_text", "n_words > 1000000"),
    Rule(7, "bullets", "10 * n_bullets > 9 * n_lines"),
    Rule(8, "ellipses", "10 * n_ellipses > 3 * n_lines"),
)
BASE = 0b11
#: Policies by version: the rules whose failure rejects a document. Rule 6 is measured and in none: long texts are cut later.
POLICIES = {1: BASE, 2: 0b0111111, 3: 0b110111111}
POLICY = 3


def window_hash(*words_of_window: Column) -> Column:
    return F.xxhash64(*words_of_window)


def _repeat_words(w: Column) -> Column:
    """Words inside those 3-word windows that occur twice or more.

    Windows are told apart by a 64-bit hash. Where no two hashes are equal nothing repeats; else they are sorted with their
    places, and neighbours with one hash are compared word by word. Should two windows with one hash differ, the text's
    windows are sorted as strings instead.
    """
    places = F.sequence(F.lit(0), F.size(w) - 3)
    hashes = F.transform(places, lambda i: window_hash(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    strings = F.transform(places, lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    sort = lambda windows: F.sort_array(F.transform(windows, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

    def covered(s: Column) -> Column:
        """The union of the repeats' three-word intervals: the sum of min(3, distance to the repeat before)."""
        repeat = F.transform(
            F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["g"] == x["g"])) | ((k < F.size(s) - 1) & (F.get(s, k + 1)["g"] == x["g"]))),
            lambda x: x["i"],
        )
        union = lambda p: F.aggregate(
            F.transform(p, lambda x, k: F.when(k == 0, F.lit(3)).otherwise(F.least(F.lit(3), x - F.get(p, k - 1)))), F.lit(0).cast("long"), lambda a, x: a + x
        )
        return let(F.sort_array(repeat), union)

    def clash(s: Column) -> Column:
        same = lambda a, b: (F.get(w, a) == F.get(w, b)) & (F.get(w, a + 1) == F.get(w, b + 1)) & (F.get(w, a + 2) == F.get(w, b + 2))
        return F.exists(F.sequence(F.lit(1), F.size(s) - 1), lambda k: (F.get(s, k)["g"] == F.get(s, k - 1)["g"]) & ~same(F.get(s, k)["i"], F.get(s, k - 1)["i"]))

    of_sorted = lambda s: F.when(clash(s), let(sort(strings), covered)).otherwise(covered(s))
    repeated = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(sort(h), of_sorted)))
    return F.when(F.size(w) < 3, F.lit(0).cast("long")).otherwise(repeated)


def measurements(text: Column) -> Column:
    """A struct of longs: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_bullets, n_ellipses, n_repeat_words. A null text is empty."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    of_words = let(words(t), lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).alias("r")))
    counted = lambda x, pattern: F.size(F.filter(x, lambda line: line.rlike(pattern))).cast("long")
    of_lines = let(
        lines,
        lambda x: F.struct(
            F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d"), counted(x, BULLET).alias("b"), counted(x, ELLIPSIS).alias("e")
        ),
    )
    both = lambda a, b: F.struct(
        a["n"].alias("n_words"),
        F.length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        b["n"].alias("n_lines"),
        b["d"].alias("n_dup_lines"),
        b["b"].alias("n_bullets"),
        b["e"].alias("n_ellipses"),
        a["r"].alias("n_repeat_words"),
    )
    return let(of_words, lambda a: let(of_lines, lambda b: both(a, b)))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row a document: id, the measurements, fail_bits (long, one bit a failed rule).

    Null and empty texts count as texts without words (few_words fails). Repeated rows and null ids are kept, each with
    its own row; ties don't matter. A very long text is measured whole, in one row: its words and 8 bytes a window are held
    besides it, and for repeats the sorted windows. Other columns of docs are not read. An empty table gives an empty ledger.
    """
    measured = docs.select(col(id_col).alias(id_col), measurements(col(text_col)).alias("_m")).select(col(id_col), "_m.*")
    bits = [F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long") for r in rules]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measured.withColumn("fail_bits", total)


def apply_policy(ledger_rows: DataFrame, mask: int, kept_col: str = "kept") -> DataFrame:
    """The ledger with a boolean: true where no rule of the mask failed. Rows stay as they are, repeats and null ids too."""
    return ledger_rows.withColumn(kept_col, F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")) == 0)


def ablation(ledger_rows: DataFrame, mask: int, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of the mask (bit, rule): documents that fail it, that fail it alone, and that are kept without it.

    Documents are first counted by their bits, so that at most 2**rules rows reach the second step. An empty ledger gives
    counts of 0.
    """
    by_bits = ledger_rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    of_mask = [r for r in rules if mask >> r.bit & 1]
    names = F.array(*[F.struct(F.lit(r.bit).alias("bit"), F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("flag")) for r in of_mask])
    flag = lambda r: F.lit(1 << r.bit).cast("long")
    count = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0))
    figures = [
        F.struct(
            count(F.col("bits").bitwiseAND(flag(r)) != 0).alias("n_failed"), count(F.col("bits") == flag(r)).alias("n_failed_alone"), count((F.col("bits") == flag(r)) | (F.col("bits") == 0)).alias("n_kept_without")
        )
        for r in of_mask
    ]
    one = by_bits.agg(F.array(*figures).alias("f")).select(F.explode(F.arrays_zip(names.alias("r"), F.col("f"))).alias("x"))
    return one.select("x.r.bit", "x.r.rule", "x.f.n_failed", "x.f.n_failed_alone", "x.f.n_kept_without")


def explained(ledger_rows: DataFrame, mask: int, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger with only_rule, the name of the rule that alone rejects a document, and n_kept_without, the documents that
    the policy would keep without that rule; both are null for other documents."""
    figures = ablation(ledger_rows, mask, rules).select(F.expr("shiftleft(1L, bit)").alias("_flag"), F.col("rule").alias("only_rule"), "n_kept_without")
    failed = F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long"))
    return ledger_rows.join(F.broadcast(figures), failed == F.col("_flag"), "left").drop("_flag")  # a row a rule
