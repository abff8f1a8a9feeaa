"""Quality rules: a table of thresholds compiled into one projection.

Everything is built-in column functions. A document's words, lines and three-word
windows are arrays inside its row, so nothing is shuffled and a row needs memory in
proportion to its own text only.

Defined results: a null text counts as an empty one; separators-only texts have no
words; rows are judged one by one, so repeated rows get equal verdicts; an empty
table gives an empty result; ``measured`` adds one struct, of a name to choose, and
``quality_filter`` returns the input columns alone.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill.llm.common import SEPARATORS, place, sealed, unsealed

# fixed values: frequent function words of English, German, French and Spanish
STOP_WORDS = tuple(
    "the of and to in is that it for was on are as with be by this from or an at he have not "
    "der die das und ist nicht ein eine mit von zu den dem im sich auf für auch als es "
    "le la les de des du et en un une que qui est pas pour dans sur par au avec "
    "el los las y del se con por para como más no una su al lo".split()
)
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """A document passes while ``low <= measure <= high``; None leaves a side open."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


# measures: the counts of ``measured`` and ratios of them
RATIOS = {
    "mean_word_chars": ("word_chars", "n_words"),
    "symbol_ratio": ("n_symbols", "n_words"),
    "stop_word_ratio": ("n_stop_words", "n_words"),
    "repeat_word_ratio": ("n_repeat_words", "n_words"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
    "bullet_line_ratio": ("n_bullet_lines", "n_lines"),
    "ellipsis_line_ratio": ("n_ellipsis_lines", "n_lines"),
}

BASE_RULES = (
    Rule("too_short", "n_words", low=50),
    Rule("repeated_windows", "repeat_word_ratio", high=0.5),
)
RULES = (
    Rule("word_length", "mean_word_chars", low=2.0, high=16.0),
    Rule("symbols", "symbol_ratio", high=0.1),
    Rule("stop_words", "stop_word_ratio", low=0.01),
    Rule("repeated_lines", "dup_line_ratio", high=0.5),
    Rule("bullets", "bullet_line_ratio", high=0.9),
    Rule("ellipses", "ellipsis_line_ratio", high=0.5),
)


def measured(docs: DataFrame, text: str = "text", name: str = "quality") -> DataFrame:
    """The input columns and one struct of counts, named ``name``.

    ``n_repeat_words`` counts the words inside three-word windows that occur twice or
    more in the text. Windows are compared by a 64-bit hash within one document.
    """
    rows = sealed(docs)
    kept = rows.columns
    spaced = rows.select(*kept, F.coalesce(place(docs, text), F.lit("")).alias("__text"))
    split = spaced.select(
        *kept,
        "__text",
        F.array_remove(F.split("__text", SEPARATORS), "").alias("__words"),
        F.filter(F.split("__text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__lines"),
    )
    # windows as (hash, position), sorted: equal ones become neighbours. Arrays are shifted and
    # zipped, so no lambda refers to another array: what the optimizer inlines is evaluated
    # once a row, never once an element
    n = F.size("__words")
    w = F.col("__words")
    window = lambda i: F.struct(
        F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")
    )
    starts = lambda count: F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(
        F.array().cast("array<int>")
    )
    hashed = split.withColumn("__win", F.sort_array(F.transform(starts(n - 2), window)))
    s = F.col("__win")
    beside = F.zip_with(s, _later(s), lambda x, y: F.struct(x.alias("x"), (x["h"] == y["h"]).alias("e")))
    paired = hashed.select(*kept, "__text", "__words", "__lines", beside.alias("__beside"))
    e = F.col("__beside")
    twice = F.zip_with(e, _earlier(e), lambda x, y: F.when(x["e"] | y["e"], x["x"]["i"]))
    placed = paired.select(
        *kept, "__text", "__words", "__lines", F.sort_array(F.array_compact(twice)).alias("__at")
    )
    at = F.col("__at")
    covered = F.zip_with(at, _later(at), lambda x, y: F.least(F.lit(3), F.coalesce(y - x, F.lit(3))))
    lines = F.col("__lines")
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    like = lambda pattern: F.size(F.filter(lines, lambda x: x.rlike(pattern)))
    counts = {
        "n_words": n,
        "word_chars": F.length(F.array_join("__words", "")),
        "n_symbols": F.regexp_count("__text", F.lit(SYMBOLS)),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": total(covered),
        "n_stop_words": F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))),
        "n_bullet_lines": like(r"^[\x20\x09-\x0D]*[-*•‣·]"),
        "n_ellipsis_lines": like(r"(\.\.\.|…)[\x20\x09-\x0D]*$"),
    }
    found = F.struct(*[v.cast("bigint").alias(k) for k, v in counts.items()])
    # a generator: a filter on the counts stays above it, so they are computed once
    return placed.select(*unsealed(docs), F.explode(F.array(found)).alias(name))


def _later(xs: Column) -> Column:
    """The array without its first element: each place holds the next one, the last null."""
    return F.slice(xs, F.lit(2), F.greatest(F.size(xs), F.lit(0)))


def _earlier(xs: Column) -> Column:
    """The array one place on: each place holds the one before, the first null."""
    return F.when(F.size(xs) > 0, F.concat(
        F.array(F.get(F.slice(xs, 1, 0), F.lit(0))), F.slice(xs, F.lit(1), F.size(xs) - 1)
    )).otherwise(xs)


def measure(counts: Column, name: str) -> Column:
    if name not in RATIOS:
        return counts[name]
    part, whole = RATIOS[name]
    # multiplied out where it is compared; here as a number for reports
    return F.when(counts[whole] > 0, counts[part] / counts[whole]).otherwise(F.lit(0.0))


def fails(counts: Column, rule: Rule) -> Column:
    """True where the document breaks the rule. Ratios of nothing (no words) break no rule."""
    if rule.measure in RATIOS:
        part, whole = (counts[c] for c in RATIOS[rule.measure])
    else:
        part, whole = counts[rule.measure], F.lit(1)
    broken = [F.lit(False)]
    if rule.low is not None:
        broken.append((whole > 0) & (part < F.lit(rule.low) * whole))
    if rule.high is not None:
        broken.append(part > F.lit(rule.high) * whole)
    return reduce(lambda a, b: a | b, broken)


def verdict(counts: Column, rules: tuple[Rule, ...]) -> Column:
    """Names of the broken rules, in the table's order."""
    named = [F.when(fails(counts, r), F.lit(r.name)) for r in rules]
    return F.array_compact(F.array(*named)) if named else F.array().cast("array<string>")


def any_fails(counts: Column, rules: tuple[Rule, ...]) -> Column:
    return reduce(lambda a, b: a | b, [fails(counts, r) for r in rules], F.lit(False))


def quality_filter(
    docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + RULES, text: str = "text"
) -> DataFrame:
    """The documents that break no rule, with their own columns."""
    rows = measured(sealed(docs), place(docs, text), "quality")
    return rows.filter(~any_fails(F.col("quality"), rules)).select(*unsealed(docs))
