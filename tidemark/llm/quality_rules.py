"""Quality rules: a threshold table compiled into one Spark projection.

Every metric is an expression of built-in functions over the whole text; a rule is a pair of integer expressions, so no
verdict depends on floating point. Null and empty texts have no words, all counts 0, and fail the base rule. Repeated
rows get equal results, extra columns of the input play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let, parts_of

WINDOW = 5
#: Frequent function words of English, French, German and Spanish; n_stop counts the words of a text that are one, in any case.
STOP_WORDS = ("the", "of", "and", "to", "in", "is", "de", "la", "le", "et", "der", "die", "und", "que", "el", "en")


@dataclass(frozen=True)
class Rule:
    """Rejects a text when ``100 * metric`` exceeds ``percent * of`` (or falls below it, for ``least``).

    Applies to texts of ``from_words`` words or more. ``one`` as ``of`` makes ``percent`` the hundredfold of a count.
    """

    name: str
    metric: str
    of: str
    percent: int
    least: bool = False
    from_words: int = 0


#: The base rules: too few words (n_words < 10), or too many words in repeated windows.
BASE = (
    Rule("too_short", "n_words", "one", 1000, least=True),
    Rule("repeated_windows", "n_repeat_words", "n_words", 20),
)
#: The method's own table.
RULES = (
    Rule("symbols", "n_symbols", "n_words", 10),
    Rule("shouting", "n_exclaim", "n_words", 30),
    Rule("long_words", "word_chars", "n_words", 1200),
    Rule("short_words", "word_chars", "n_words", 200, least=True),
    Rule("stop_words", "n_stop", "n_words", 2, least=True, from_words=100),
    Rule("repeated_lines", "n_dup_lines", "n_lines", 50),
)


def repeated_words(hashes: Column) -> Column:
    """Words that stand in windows found twice or more. Windows are told apart by 64-bit hashes, within one text only."""
    keyed = F.transform(hashes, lambda h, i: F.struct(h.alias("g"), i.alias("p")))

    def covered(s: Column) -> Column:
        same = lambda j, k: F.get(s, j).getField("g").eqNullSafe(F.get(s, k).getField("g"))
        twice = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: same(j, j - 1) | same(j, j + 1))
        places = F.sort_array(F.transform(twice, lambda j: F.get(s, j).getField("p")))
        return let(places, lambda q: F.aggregate(
            F.sequence(F.lit(0), F.size(q) - 1), F.lit(0),
            lambda a, j: a + F.least(F.lit(WINDOW), F.coalesce(F.get(q, j + 1) - F.get(q, j), F.lit(WINDOW))),
        ))

    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(F.sort_array(keyed), covered)).otherwise(0)


def with_metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the metric columns of the table added (existing columns of these names are replaced)."""
    t = F.coalesce(F.col(text), F.lit(""))
    some = F.lit(f"[^{SPACE}]")
    first = docs.withColumns({
        "_parts": parts_of(F.col(text)),
        "_lines": F.filter(F.split(t, "\n"), lambda x: F.rlike(x, some)),
    })
    first = first.withColumn("_words", F.array_remove("_parts", ""))
    w, n = F.col("_words"), F.size("_words")
    hashes = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
    second = first.withColumn("_hashes", F.when(n >= WINDOW, hashes).otherwise(F.array().cast("array<bigint>")))

    def count(characters: str) -> Column:
        rest = t
        for c in characters:
            rest = F.replace(rest, F.lit(c), F.lit(""))
        return (F.length(t) - F.length(rest)).cast("long")

    return second.withColumns({
        "n_words": n.cast("long"),
        "word_chars": (F.length(t) - F.size("_parts") + 1).cast("long"),
        "n_symbols": count("#*$%&|<>"),
        "n_exclaim": count("!"),
        "n_stop": F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": repeated_words(F.col("_hashes")).cast("long"),
        "one": F.lit(1).cast("long"),
    }).drop("_parts", "_words", "_lines", "_hashes")


def fails(rule: Rule) -> Column:
    """The rule as an expression."""
    left, right = 100 * F.col(rule.metric), rule.percent * F.col(rule.of)
    return (F.col("n_words") >= rule.from_words) & ((left < right) if rule.least else (left > right))


def any_of(rules: tuple[Rule, ...]) -> Column:
    out = F.lit(False)
    for rule in rules:
        out = out | fails(rule)
    return out


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Metrics, ``base_failed``, ``kept`` and ``failed`` (names of the rules that reject the text) for every row."""
    measured = with_metrics(docs, text)
    names = F.filter(F.array(*[F.when(fails(r), F.lit(r.name)) for r in (*BASE, *rules)]), lambda x: x.isNotNull())
    return measured.withColumns({"base_failed": any_of(BASE), "kept": ~any_of((*BASE, *rules)), "failed": names})


def keep(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with their columns as they were.

    Rows go through ``inline`` and not a filter: a filter would be pushed below the projections and compute their arrays
    anew for each element.
    """
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("text"))
    measured = judge(inner, "text", rules)
    row = F.array("row")
    return measured.select(F.inline(F.when(F.col("kept"), row).otherwise(F.slice(row, 1, 0))))
