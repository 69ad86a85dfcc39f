"""Quality rules: a threshold table compiled into one projection.

Measures and rules are built-in functions only, so a scan with the projection
needs no shuffle and no Python.  Nulls count as empty texts; repeated rows give
repeated results; long texts are measured whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm._native import SPACES, let, words

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Frequent function words of the languages the rules know.
STOP_WORDS = {
    "en": ("the", "of", "and", "to", "in", "that", "is", "was", "for", "with", "this", "from"),
    "fr": ("le", "la", "les", "de", "des", "et", "que", "un", "une", "est", "dans", "pour"),
    "de": ("der", "die", "das", "und", "ist", "ein", "eine", "mit", "zu", "von", "für", "auf"),
    "es": ("el", "la", "los", "de", "que", "y", "en", "un", "una", "por", "para", "con"),
}


@dataclass(frozen=True)
class Rule:
    """``top`` over ``of`` (1 at least) must lie in [low, high]; an open end is None.  Rules with ``least_words`` pass shorter texts."""

    name: str
    top: str
    of: str
    low: float | None = None
    high: float | None = None
    least_words: int = 0


#: The production table: ratios of the measures of ``measured``.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 16.0),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 0.2),
    Rule("upper_share", "n_upper", "word_chars", None, 0.5),
    Rule("stop_share", "n_stop", "n_words", 0.02, None, 100),
    Rule("dup_line_share", "n_dup_lines", "n_lines", None, 0.5),
)


def repeated_words(tokens: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of ``window`` words found at least twice in the text.

    Windows are compared by 64-bit hashes.  Most texts repeat none, which an
    ``array_distinct`` shows; only the others sort their windows to find the
    repeated ones and measure the union of their spans.
    """
    size = F.size(tokens)
    hashed = F.transform(tokens, lambda w: F.xxhash64(w))
    windows = let(hashed, lambda h: F.transform(F.sequence(F.lit(1), size - (window - 1)), lambda i: F.xxhash64(F.slice(h, i, window))))

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def spans(s: Column) -> Column:
            again = F.filter(
                F.transform(
                    s,
                    lambda x, j: F.when(
                        ((j > 0) & (F.get(s, j - 1)["h"] == x["h"])) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)), x["i"]
                    ),
                ),
                lambda x: x.isNotNull(),
            )
            return let(
                F.sort_array(again),
                lambda p: F.aggregate(
                    F.transform(p, lambda x, j: F.least(F.lit(window), F.coalesce(F.get(p, j + 1) - x, F.lit(window)))),
                    F.lit(0).cast("long"),
                    lambda a, x: a + x,
                ),
            )

        return let(placed, spans)

    counted = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))
    return F.when(size > window, counted).otherwise(F.lit(0).cast("long"))


def measures(text: Column) -> Column:
    """The measures the rules are written in, as a struct."""
    text = F.coalesce(text, F.lit(""))
    dense = F.translate(text, SPACES, "")
    stop = sorted({w for group in STOP_WORDS.values() for w in group})

    def line_counts(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("long").alias("all"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("dup"))

    def word_counts(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("all"),
            repeated_words(w).alias("repeated"),
            F.size(F.filter(w, lambda x: x.isin(stop))).cast("long").alias("stop"),
        )

    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    return let(
        F.struct(let(words(text), word_counts).alias("w"), let(lines, line_counts).alias("l")),
        lambda x: F.struct(
            x["w"]["all"].alias("n_words"),
            F.length(dense).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            x["l"]["dup"].alias("n_dup_lines"),
            x["w"]["repeated"].alias("n_repeat_words"),
            x["l"]["all"].alias("n_lines"),
            F.regexp_count(text, F.lit("\\p{Lu}")).cast("long").alias("n_upper"),
            x["w"]["stop"].alias("n_stop"),
        ),
    )


def broken(m: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The first rule that ``measures`` break, by name; null if they keep them all."""
    found = []
    for rule in rules:
        value = m[rule.top] / F.greatest(m[rule.of], F.lit(1).cast("long"))
        out = F.lit(False)
        if rule.low is not None:
            out |= value < rule.low
        if rule.high is not None:
            out |= value > rule.high
        found.append(F.when(out & (m["n_words"] >= rule.least_words), F.lit(rule.name)))
    return F.coalesce(*found, F.lit(None).cast("string"))


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row for each document: its base measures, ``base_failed``, the rule broken and ``kept``."""

    def judged(m: Column) -> Column:
        failed = base_failed(m)
        rule = F.when(~failed, broken(m, rules))
        return F.struct(
            *(m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
            failed.alias("base_failed"),
            (~failed & rule.isNull()).alias("kept"),
            *(m[c].alias(c) for c in ("n_lines", "n_upper", "n_stop")),
            rule.alias("broken"),
        )

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.array(let(measures(F.col("text")), judged))).alias("_out"))
    return out.select("doc_id", "_out.*")


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns only; the filter holds one copy of the measures."""
    return docs.where(let(measures(F.col("text")), lambda m: ~base_failed(m) & broken(m, rules).isNull()))
