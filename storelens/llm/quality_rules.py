"""Quality rules (operator 10): a threshold table compiled into one projection.

``measure`` adds the plain counts of a text, ``compile_rules`` turns a table of
thresholds into Boolean columns, ``apply_rules`` does both.  Built-in functions
only; no shuffle, so skew and lost executors change nothing.

Defined cases: a null text counts as no words (all counts 0); an empty table
gives an empty table; equal rows get equal results; other columns pass through
unless they carry one of the names in ``ADDED``, which are replaced.  Texts are
read whole, however long.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import SPACES, words

SYMBOLS = "#*$%&|<>"
WINDOW = 5
# Frequent function words of the corpus languages (en, de, fr, es).
STOP_WORDS = (
    "a an and are as at be by for from have he her his i in is it not of on or she that the they this to was we with you "
    "aber als auch auf aus bei das dass dem den der des die ein eine er es für hat ich im ist mit nicht sich sie sind und von war wie zu "
    "au avec ce dans des du elle est et il je la le les mais ne nous on ou par pas pour que qui se sur un une vous "
    "al como con de del el ella en era es la las lo los más no o para pero por que se su sus un una y"
).split()
STOP_WORDS = tuple(dict.fromkeys(STOP_WORDS))


@dataclass(frozen=True)
class Rule:
    """Keep a text when ``numerator`` compared with ``threshold * denominator`` holds.

    Products instead of quotients: a text without words has no division by zero.
    """

    name: str
    numerator: str
    op: str  # "<=" or ">="
    threshold: float
    denominator: str | None = None  # None: an absolute threshold
    min_words: int = 0  # texts with fewer words are not judged by this rule

    def column(self) -> Column:
        bound = F.lit(self.threshold) * (F.col(self.denominator) if self.denominator else F.lit(1))
        value = F.col(self.numerator)
        ok = value <= bound if self.op == "<=" else value >= bound
        return ok if not self.min_words else (F.col("n_words") < self.min_words) | ok


# The production table.  Ratios are per word, per character or per line.
RULES: tuple[Rule, ...] = (
    Rule("mean_word_long", "word_chars", "<=", 20.0, "n_words"),
    Rule("mean_word_short", "word_chars", ">=", 1.5, "n_words"),
    Rule("symbol_ratio", "n_symbols", "<=", 0.25, "n_words"),
    Rule("shouting", "n_upper_words", "<=", 0.6, "n_words", min_words=10),
    Rule("stop_words", "n_stop_words", ">=", 1.0, None, min_words=60),
    Rule("dup_lines", "n_dup_lines", "<=", 0.5, "n_lines", min_words=10),
)
# The fixed base limits: too few words, too many repeated words.
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "n_upper_words")
ADDED = (*COUNTS, "base_failed", "failed_rules", "kept")


def _let(value: Column, body) -> Column:
    """``body`` over ``value`` computed once (a lambda variable, not an inlined expression)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _covered(wins: Column) -> Column:
    """Words inside windows whose hash occurs twice or more: sort the (hash, place)
    pairs, keep those with an equal neighbour, and add up the covered places."""
    pairs = F.sort_array(F.transform(wins, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(s: Column) -> Column:
        same = F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False))
                        | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)))
        return F.sort_array(F.transform(same, lambda x: x["i"]))

    def total(p: Column) -> Column:
        steps = F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1), x + WINDOW) - x))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    return _let(_let(pairs, places), total)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns of ``COUNTS`` (long), counted over the whole text."""
    kept = [c for c in docs.columns if c.lower() not in ADDED]
    t = F.coalesce(F.col(f"t.`{text}`"), F.lit(""))
    # each step is one projection: a word or window list is built once and read by several counts
    a = docs.alias("t").select(F.struct(*[F.col(f"t.`{c}`") for c in kept]).alias("__row"), t.alias("__text"))
    a = a.select("__row", "__text", words(F.col("__text")).alias("__words"),
                 F.filter(F.split("__text", "\n"), lambda x: x.rlike("[^ \\x09-\\x0D]")).alias("__lines"))
    n = F.size("__words")
    wins = F.when(n > WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)),
                                          lambda i: F.xxhash64(F.slice("__words", i, WINDOW))))
    a = a.select("*", n.alias("__n"), wins.alias("__wins"), F.size("__lines").alias("__nl"))
    repeated = F.size(F.array_distinct("__wins")) < F.size("__wins")
    stop = F.filter("__words", lambda w: F.lower(w).isin(*STOP_WORDS))
    upper = F.filter("__words", lambda w: (F.upper(w) == w) & (F.lower(w) != w))
    counts = {
        "n_words": F.col("__n"),
        "word_chars": F.char_length(F.translate("__text", SPACES, "")),
        "n_symbols": F.char_length("__text") - F.char_length(F.translate("__text", SYMBOLS, "")),
        "n_dup_lines": F.col("__nl") - F.size(F.array_distinct("__lines")),
        "n_repeat_words": F.coalesce(F.when(repeated, _covered(F.col("__wins"))), F.lit(0)),
        "n_lines": F.col("__nl"),
        "n_stop_words": F.size(stop),
        "n_upper_words": F.size(upper),
    }
    return a.select(*[F.col("__row")[c].alias(c) for c in kept], *[v.cast("long").alias(k) for k, v in counts.items()])


def compile_rules(rules: Sequence[Rule] = RULES) -> dict[str, Column]:
    """``base_failed``, the names of the failed rules and ``kept``, over the columns of ``measure``."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    failed = F.array(*[F.when(~r.column(), F.lit(r.name)) for r in rules]).cast("array<string>") if rules else F.array().cast("array<string>")
    passed = F.lit(True)
    for r in rules:
        passed = passed & r.column()
    return {"base_failed": base, "failed_rules": F.concat_ws(",", failed), "kept": ~base & passed}


def apply_rules(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """``docs`` with every count and the verdict of the table."""
    return measure(docs, text).select("*", *[v.alias(k) for k, v in compile_rules(rules).items()])


def keep_good(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows of ``docs`` that the table keeps, with their own columns only.

    The row number keeps the optimizer from moving the filter below the counts,
    which would write every count's whole expression into it, many times over.
    """
    judged = apply_rules(docs, text, rules).select("*", F.monotonically_increasing_id().alias("__row_number"))
    return judged.where(F.col("kept") & (F.col("__row_number") >= 0)).select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ADDED])
