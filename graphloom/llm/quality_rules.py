"""Quality rules: a table of thresholds compiled into one projection, without user functions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to a in is it that was for on with as be at by this from or are not have "
    "der die das und ist in den von zu mit sich des auf für im dem nicht ein eine als auch "
    "le la les de des et un une du en est que qui dans pour pas sur au par ce il ne se "
    "el los las una y es no con por para su al lo del como más pero sus o"
).split()


class Rule(NamedTuple):
    """``low <= numerator / denominator <= high`` must hold; a bound of None is open."""

    name: str
    numerator: str
    denominator: str
    low: float | None
    high: float | None


RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 12.0),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 0.1),
    Rule("stop_word_share", "n_stop_words", "n_words", 0.02, None),
    Rule("repeated_word_share", "n_repeat_words", "n_words", None, 0.5),
    Rule("duplicate_line_share", "n_dup_lines", "n_lines", None, 0.6),
    Rule("bullet_line_share", "n_bullet_lines", "n_lines", None, 0.9),
    Rule("ellipsis_line_share", "n_ellipsis_lines", "n_lines", None, 0.3),
)


def rule_sql(rule: Rule) -> str:
    """The rule as SQL that Spark and other engines read alike; a ratio without a base fails."""
    ratio = f"CAST({rule.numerator} AS DOUBLE) / NULLIF({rule.denominator}, 0)"
    parts = [f"{ratio} >= {rule.low}"] * (rule.low is not None) + [f"{ratio} <= {rule.high}"] * (rule.high is not None)
    return "COALESCE(" + " AND ".join(parts) + ", FALSE)"


def base_sql() -> str:
    return "(n_words < 50 OR 100 * n_repeat_words > 50 * n_words)"


def kept_sql(rules: tuple[Rule, ...] = RULES) -> str:
    return f"(NOT {base_sql()} AND " + " AND ".join(map(rule_sql, rules)) + ")"


def _replaced(text: Column, chars: str, by: str) -> Column:
    """One pass per character: far cheaper than ``translate``, which looks up every character."""
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(by))
    return text


def _covered(at: Column) -> Column:
    """Words under windows of three that begin at the ascending positions."""
    step = F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3))))
    return F.aggregate(step, F.lit(0), lambda a, x: a + x)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts that the rules read; null text counts as empty.

    Repeated windows are found by sorting a text's own windows, so no row leaves its task. Windows
    are compared by a 64-bit hash. Columns whose names begin with ``_q_`` are taken for the work.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    spaced = _replaced(whole, SPACES[1:], " ")
    lines = F.filter(F.split(whole, "\n"), lambda x: F.trim(x, F.lit(SPACES)) != "")
    known = [*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)]
    w, s, p, ln = F.col("_q_words"), F.col("_q_sorted"), F.col("_q_at"), F.col("_q_lines")
    return (
        docs.withColumns({"_q_words": F.array_remove(F.split(spaced, " "), ""), "_q_lines": lines})
        .withColumn("n_words", F.size(w).cast("long"))
        .withColumn(
            "_q_sorted",
            F.sort_array(
                F.transform(
                    F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))),
                    lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p")),
                )
            ),
        )
        .withColumn(
            "_q_at",
            F.sort_array(
                F.transform(
                    F.filter(s, lambda x, i: (x.h == F.get(s, i - 1).h) | (x.h == F.get(s, i + 1).h)),
                    lambda x: x.p,
                )
            ),
        )
        .withColumns(
            {
                "word_chars": F.length(F.array_join(w, "")).cast("long"),
                "n_symbols": (F.length(whole) - F.length(_replaced(whole, SYMBOLS, ""))).cast("long"),
                "n_dup_lines": (F.size(ln) - F.size(F.array_distinct(ln))).cast("long"),
                "n_repeat_words": _covered(p).cast("long"),
                "n_lines": F.size(ln).cast("long"),
                "n_stop_words": F.size(F.filter(w, lambda x: x.isin(known))).cast("long"),
                "n_bullet_lines": F.size(
                    F.filter(ln, lambda x: F.ltrim(x).substr(1, 1).isin("-", "*", "•"))
                ).cast("long"),
                "n_ellipsis_lines": F.size(
                    F.filter(ln, lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))
                ).cast("long"),
            }
        )
        .drop("_q_words", "_q_lines", "_q_sorted", "_q_at")
    )


COUNTS = [
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_stop_words",
    "n_bullet_lines",
    "n_ellipsis_lines",
]


def quality_rules(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every row with its counts, ``base_failed`` and ``kept``.

    Null and empty texts have no words and fail the base; repeated rows are judged each for itself;
    an empty table gives an empty result. Columns of the input that bear a name of the result are
    replaced by it, all others are carried.
    """
    mine = [*COUNTS, "base_failed", "kept"]
    rest = docs.drop(*[c for c in mine if c != text])
    return measure(rest, text).withColumns({"base_failed": F.expr(base_sql()), "kept": F.expr(kept_sql(rules))})


def passing(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows that keep all rules, with their own columns only.

    The verdict is tied to a value that is not deterministic, so that the optimizer does not push the filter
    below the projections and copy their expressions into each other's lambdas.
    """
    row = docs.select(F.col(text).alias("text"), F.struct(*docs.columns).alias("_row"))
    judged = quality_rules(row, "text", rules).select(
        "_row", (F.col("kept") & (F.monotonically_increasing_id() >= 0)).alias("_kept")
    )
    return judged.where("_kept").select("_row.*")
