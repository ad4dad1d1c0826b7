"""Quality rules: a table of thresholds compiled into one projection of text ratios.

Every feature is a DataFrame expression on the text alone, so scoring is a scan without shuffle,
window or user function. A rule bounds ``100 * part / whole`` in whole per cent, compared
in integers, so no rounding decides a document.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.shared import table

BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
BULLET = r"^[\x20\x09]*[-*•‣]"
ELLIPSIS = r"(\.\.\.|…)[\x20\x09-\x0D]*$"

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to a in is that it for as was with be by on are this an at from or not "
    "der die und den von das zu mit ist nicht ein eine im dem auf des sich für "
    "de la le et les un du une que pour dans qui est par sur pas en au "
    "el y los las se del por con no su al lo es para"
).split()


class Rule(NamedTuple):
    """``least <= 100 * part / whole <= most``; a missing bound is None, a missing whole counts as 1.

    Without a whole the bounds are numbers, not per cent. A whole of zero fails no rule.
    """

    name: str
    part: str
    whole: str | None
    least: int | None
    most: int | None


#: What no verdict may overrule.
BASE_RULES = (
    Rule("words", "n_words", None, 50, None),
    Rule("repeated_words", "n_repeat_words", "n_words", None, 50),
)
#: The method's own thresholds: lengths, symbols, stop words, lines.
RULES = (
    Rule("word_length", "word_chars", "n_words", 300, 1000),
    Rule("symbols", "n_symbols", "n_words", None, 10),
    Rule("stop_words", "n_stop_words", "n_words", 3, None),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 40),
    Rule("bullets", "n_bullet_lines", "n_lines", None, 90),
    Rule("ellipses", "n_ellipsis_lines", "n_lines", None, 30),
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, inside one expression."""
    return F.transform(F.array(value), body)[0]


def _count(found: Column) -> Column:
    return F.size(found).cast("long")


def _window(words: Column, i: Column) -> list[Column]:
    return [F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)]


def _neighbours(sorted_array: Column, same: Callable[[Column, Column], Column]) -> Column:
    """Places of a sorted array whose entry is the same as the one before or after it."""
    entry = lambda k: F.get(sorted_array, k)
    return F.filter(
        F.sequence(F.lit(0), F.size(sorted_array) - 1),
        lambda k: F.coalesce(same(entry(k), entry(k - 1)), F.lit(False))
        | F.coalesce(same(entry(k), entry(k + 1)), F.lit(False)),
    )


def _covered(places: Column) -> Column:
    """Words that windows of three cover; the places of the windows ascend."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(
        places,
        start,
        lambda a, p: F.struct((a["n"] + p + 3 - F.greatest(p, a["end"])).alias("n"), (p + 3).alias("end")),
        lambda a: a["n"],
    )


def repeated_words(words: Column) -> Column:
    """Words inside a window of three that occurs twice or more in the text.

    Each window is one number, 33 bits of hash above its place. Sorted, windows of equal
    hash are neighbours; these few are sorted by their words, which decide.
    """

    def numbered(words: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(words) - 3),
            lambda i: F.xxhash64(*_window(words, i)).bitwiseAND(F.lit(-(1 << 31))).bitwiseOR(i.cast("long")),
        )

    def alike(numbers: Column) -> Column:
        found = _neighbours(numbers, lambda x, y: F.shiftrightunsigned(x.bitwiseXOR(y), 31) == 0)
        return F.transform(found, lambda k: F.get(numbers, k).bitwiseAND(F.lit((1 << 31) - 1)).cast("int"))

    def spelt(places: Column) -> Column:
        names = ("a", "b", "c")
        windows = F.transform(
            places, lambda i: F.struct(*[w.alias(n) for w, n in zip(_window(words, i), names, strict=True)], i.alias("i"))
        )
        return F.sort_array(windows)

    def equal(windows: Column) -> Column:
        same = _neighbours(windows, lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]))
        return F.sort_array(F.transform(same, lambda k: F.get(windows, k)["i"]))

    def counted(places: Column) -> Column:
        return F.when(F.size(places) > 0, _covered(_let(spelt(places), equal))).otherwise(0)

    found = _let(_let(F.sort_array(numbered(words)), alike), counted)
    return F.when(F.size(words) >= 3, found).otherwise(0).cast("long")


def features(text: Column) -> Column:
    """All counts of a text as one struct; a null text counts as an empty one.

    ``n_words, word_chars, n_symbols, n_stop_words, n_repeat_words, n_lines, n_dup_lines,
    n_bullet_lines, n_ellipsis_lines``; only lines with a word count as lines.
    """
    whole = F.coalesce(text, F.lit(""))

    def of_words(words: Column) -> Column:
        return F.struct(
            _count(words).alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            _count(F.filter(words, lambda w: w.isin(STOP_WORDS))).alias("n_stop_words"),
            repeated_words(words).alias("n_repeat_words"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(
            _count(lines).alias("n_lines"),
            (_count(lines) - _count(F.array_distinct(lines))).alias("n_dup_lines"),
            _count(F.filter(lines, lambda x: x.rlike(BULLET))).alias("n_bullet_lines"),
            _count(F.filter(lines, lambda x: x.rlike(ELLIPSIS))).alias("n_ellipsis_lines"),
        )

    words = _let(F.array_remove(F.split(whole, BLANKS, -1), ""), of_words)
    lines = _let(F.filter(F.split(whole, "\n", -1), lambda x: x.rlike(WORD)), of_lines)
    symbols = F.regexp_count(whole, F.lit(SYMBOL)).cast("long").alias("n_symbols")

    def flat(both: Column) -> Column:
        names = [(both["w"], n) for n in ("n_words", "word_chars", "n_stop_words", "n_repeat_words")]
        names += [(both["l"], n) for n in ("n_lines", "n_dup_lines", "n_bullet_lines", "n_ellipsis_lines")]
        return F.struct(*[part[n].alias(n) for part, n in names], both["n_symbols"].alias("n_symbols"))

    return _let(F.struct(words.alias("w"), lines.alias("l"), symbols), flat)


def failing(counts: Column, rules: Sequence[Rule]) -> Column:
    """Names of the rules that a struct of counts fails, in the order of the table."""
    tests = []
    for rule in rules:
        part = counts[rule.part] * (100 if rule.whole else 1)
        whole = counts[rule.whole] if rule.whole else F.lit(1)
        broken = F.lit(False)
        if rule.least is not None:
            broken = broken | (part < rule.least * whole)
        if rule.most is not None:
            broken = broken | (part > rule.most * whole)
        tests.append(F.when(broken, F.lit(rule.name)))
    return F.filter(F.array(*tests), lambda x: x.isNotNull()) if tests else F.array().cast("array<string>")


def judge(
    docs: DataFrame, rules: Sequence[Rule] = RULES, base: Sequence[Rule] = BASE_RULES, into: str = "judged"
) -> DataFrame:
    """``docs`` with a struct ``into``: the counts, the names of failed base rules and of failed rules.

    Whole texts of any length are judged where they are read, in time that grows as n log n of their words.
    Null and empty texts have no words and fail the base rules; repeated rows are judged
    each, an empty table gives no rows, and every column stays, but for one of the name ``into``.
    """
    counted = docs.withColumn(into, _let(features(F.col("text")), lambda c: F.struct(
        c.alias("counts"), failing(c, base).alias("base_failed"), failing(c, rules).alias("failed")
    )))
    return counted


def passes(judged: Column) -> Column:
    return (F.size(judged["base_failed"]) == 0) & (F.size(judged["failed"]) == 0)


def keep_good(docs: DataFrame, rules: Sequence[Rule] = RULES, base: Sequence[Rule] = BASE_RULES) -> DataFrame:
    """Documents that no rule rejects; columns unchanged."""
    name = "judged"
    while name in docs.columns:
        name += "_"
    return judge(docs, rules, base, name).where(passes(F.col(name))).drop(name)


def op12_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: the counts behind the base rules, whether they failed, and the verdict."""
    rows = judge(table(spark, folder, "documents").select("doc_id", "text"))
    judged = F.col("judged")
    shown = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return rows.select(
        "doc_id",
        *[judged["counts"][n].alias(n) for n in shown],
        (F.size(judged["base_failed"]) > 0).alias("base_failed"),
        passes(judged).alias("kept"),
    )
