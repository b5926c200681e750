"""Quality rules: a threshold table compiled into one projection of length, symbol, stop-word and line ratios.

Everything is an expression over the row, so a scan of the documents is the whole job: nothing is exchanged, no user
function runs, and a hot source is only more rows.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\f\r"
GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

#: Function words of the languages that the rules know.
STOP_WORDS = {
    "en": "a all an and are as at be but by for from had has have he her his in is it its not of on or she that the their they this to was we were which who will with you".split(),
    "de": "aber als am an auch auf aus bei das dass dem den der des die ein eine einem einen einer es für hat ich im in ist mit nach nicht noch oder sich sie sind so und von vor war werden wie wird zu zum zur".split(),
    "fr": "au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour qu que qui sa se ses son sont sur un une vous".split(),
    "es": "a al como con de del el ella en entre es esta este fue ha la las lo los más no o para pero por que se ser sin sobre son su sus también un una y ya".split(),
}


class Rule(NamedTuple):
    """A document passes if low <= value <= high; a bound that is None does not bind."""

    name: str
    value: str  # of RATIOS
    low: float | None
    high: float | None


#: value -> (numerator, denominator), of the base columns and n_lines, n_stop_words.
RATIOS = {
    "mean_word_chars": ("word_chars", "n_words"),
    "symbol_ratio": ("n_symbols", "n_words"),
    "stop_word_ratio": ("n_stop_words", "n_words"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
    "words_per_line": ("n_words", "n_lines"),
}

#: The production table.
RULES = (
    Rule("word_length", "mean_word_chars", 3.0, 10.0),
    Rule("symbols", "symbol_ratio", None, 0.1),
    Rule("stop_words", "stop_word_ratio", 0.02, None),
    Rule("repeated_lines", "dup_line_ratio", None, 0.5),
    Rule("short_lines", "words_per_line", 1.5, None),
)


def measured(docs: DataFrame, text: str = "text", stop_words: tuple[str, ...] | None = None) -> DataFrame:
    """docs as struct column `row`, with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words,
    n_stop_words (long) of its text.

    Words of windows that repeat are found by sorting the text's own three-word windows: equal ones become neighbours,
    and the sorted places of these give the words that they cover, each once. A text of n words costs n log n, and no
    more memory than its windows.
    """
    stops = sorted(stop_words if stop_words is not None else {w for ws in STOP_WORDS.values() for w in ws})
    x = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    trimmed = F.btrim("t", F.lit(BLANKS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP))
    lines = F.filter(F.split("t", "\n"), lambda s: F.btrim(s, F.lit(BLANKS)) != "")
    x = x.select("row", "t", words.alias("words"), lines.alias("lines"))
    n = F.size("words")
    part = lambda k: F.slice("words", k, F.greatest(n - 2, F.lit(0)))
    places = F.when(n > 2, F.sequence(F.lit(0).cast("long"), (n - 3).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    windows = F.sort_array(F.arrays_zip(part(1).alias("a"), part(2).alias("b"), part(3).alias("c"), places.alias("at")))
    x = x.select("row", "t", "words", "lines", windows.alias("w"))
    same = lambda p, q: (p["a"] == q["a"]) & (p["b"] == q["b"]) & (p["c"] == q["c"])
    again = F.filter("w", lambda p, k: same(p, F.get("w", k + 1)) | same(p, F.get("w", k - 1)))
    starts = F.sort_array(F.transform(again, lambda p: p["at"]))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("long").alias("last"))
    cover = F.aggregate(starts, zero, lambda s, p: F.struct((s["n"] + F.least(F.lit(3).cast("long"), p - s["last"])).alias("n"), p.alias("last")), lambda s: s["n"])
    base = {
        "n_words": n,
        "word_chars": F.length(F.array_join("words", "")),
        "n_symbols": F.length(F.regexp_replace("t", f"[^{SYMBOLS}]+", "")),
        "n_lines": F.size("lines"),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": cover,
        "n_stop_words": F.size(F.filter("words", lambda w: F.lower(w).isin(stops))),
    }
    return x.select("row", *[v.cast("long").alias(k) for k, v in base.items()])


def compiled(rules: tuple[Rule, ...] = RULES) -> Column:
    """The table as one expression: an array of the names of the rules that a document of measured() breaks. A ratio
    without a denominator (no words, no lines) breaks nothing."""

    def broken(rule: Rule) -> Column:
        over, under = (F.col(c).cast("double") for c in RATIOS[rule.value])
        value = over / F.nullif(under, F.lit(0.0))
        bounds = [value < rule.low] * (rule.low is not None) + [value > rule.high] * (rule.high is not None)
        return F.when(reduce(lambda a, b: a | b, bounds, F.lit(False)), F.lit(rule.name))

    return F.array_compact(F.array(*map(broken, rules))) if rules else F.array().cast("array<string>")


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES, least_words: int = 50, most_repeated: float = 50.0) -> DataFrame:
    """Per row: doc_id, n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with a word that equal
    an earlier one), n_repeat_words (words in three-word windows that the text holds twice or more), base_failed, kept,
    broken (names of the rules that it breaks).

    base_failed: fewer than least_words words, or over most_repeated percent of them repeated. kept: neither that nor a
    rule broken. Defined cases: null text is empty text and fails by length; repeated rows and null doc_ids each give a
    row; an empty table gives an empty result; a text of any length is read whole; other columns are ignored, whatever
    their names.
    """
    x = measured(docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t")), "t")
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    x = x.select(F.col("row.i").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), compiled(rules).alias("broken"))
    return x.select(*x.columns[:-1], (~F.col("base_failed") & (F.size("broken") == 0)).alias("kept"), "broken")
