"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

The base columns and the rules' ratios are built from higher-order functions only. ``let`` binds each array once, so the
whole table is one projection over the scan and nothing is shuffled.

Defined results: a null text has no words and fails the base rule (n_words < 10), as does an empty one; a null id stays
null; repeated rows are judged each on its own; other columns of the input are ignored by ``judge`` and kept by ``keep``;
an empty table gives an empty table. A text's arrays live in one task, so the longest text bounds a task's memory.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, WHITE, ascii_lower, let

WINDOW = 5
SYMBOLS = "#*$%&|<>"

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that it for on was be with as by at this are "
    "der die und das von zu den ein eine nicht ist mit im dem auf "
    "le la de et les des que en un une du pour dans qui pas par sur au "
    "el los las y del se con para una su al"
).split()


@dataclass(frozen=True)
class Rule:
    """Keep a text only if low <= measure <= high; measure is a key of ``measures``. min_words: it binds from so many words."""

    name: str
    measure: str
    low: float = float("-inf")
    high: float = float("inf")
    min_words: int = 0


#: The production table.
RULES = (
    Rule("length", "n_words", low=10),
    Rule("word_length", "mean_word_chars", low=1.5, high=25.0),
    Rule("symbols", "symbol_ratio", high=0.1),
    Rule("stop_words", "stop_word_ratio", low=0.02, min_words=100),
    Rule("dup_lines", "dup_line_ratio", high=0.5, min_words=50),
    Rule("short_lines", "words_per_line", low=1.2, min_words=100),
)


def _repeat_words(words: Column) -> Column:
    """Words in WINDOW-word windows that the text holds twice or more. Each word is hashed once; a window's key is a 64-bit
    hash of its words' hashes. Most texts repeat no window, which a count of the distinct keys tells; in the others equal
    windows stand side by side once sorted, and the positions of the repeated ones, sorted again, give the covered words
    as the sum of min(WINDOW, distance to the next)."""

    def covered(starts: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.size(starts)),
            F.lit(0).cast("long"),
            lambda acc, i: acc + F.when(i == F.size(starts), F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), F.get(starts, i) - F.get(starts, i - 1))),
        )

    def repeated(keys: Column) -> Column:
        twin = lambda k, i: F.coalesce(k["x"] == F.get(keys, i - 1)["x"], F.lit(False)) | F.coalesce(k["x"] == F.get(keys, i + 1)["x"], F.lit(False))
        return F.sort_array(F.transform(F.filter(keys, twin), lambda k: k["i"]))

    def keys(hashed: Column) -> Column:
        return F.transform(F.slice(hashed, 1, F.size(hashed) - WINDOW + 1), lambda h, i: F.xxhash64(h, *[F.get(hashed, i + j) for j in range(1, WINDOW)]))

    def counted(x: Column) -> Column:
        placed = F.sort_array(F.transform(x, lambda k, i: F.struct(k.alias("x"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(x)) == F.size(x), F.lit(0).cast("long")).otherwise(let(let(placed, repeated), covered))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < WINDOW + 1, F.lit(0).cast("long")).otherwise(let(let(hashed, keys), counted))


def measures(text: Column) -> Column:
    """A struct of all base columns and ratios of one text."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, f"[{SPACE_CLASS}]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: F.translate(line, WHITE, "") != "")

    def all_of(w: Column, rows: Column) -> Column:
        n, chars = F.size(w).cast("long"), F.length(F.translate(text, WHITE, "")).cast("long")
        symbols = (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")
        dup = (F.size(rows) - F.size(F.array_distinct(rows))).cast("long")
        stops = F.size(F.filter(w, lambda x: ascii_lower(x).isin(*STOP_WORDS))).cast("long")
        some = F.greatest(n, F.lit(1)).cast("double")
        some_lines = F.greatest(F.size(rows), F.lit(1)).cast("double")
        return F.struct(
            n.alias("n_words"),
            chars.alias("word_chars"),
            symbols.alias("n_symbols"),
            dup.alias("n_dup_lines"),
            _repeat_words(w).alias("n_repeat_words"),
            (chars / some).alias("mean_word_chars"),
            (symbols / some).alias("symbol_ratio"),
            (stops / some).alias("stop_word_ratio"),
            (dup / some_lines).alias("dup_line_ratio"),
            (n / some_lines).alias("words_per_line"),
        )

    return let(words, lambda w: let(lines, lambda rows: all_of(w, rows)))


def verdict(m: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """(base_failed, kept) from a struct of measures."""
    base_failed = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
    ok = F.lit(True)
    for r in rules:
        inside = F.lit(True)
        if r.low != float("-inf"):
            inside = inside & (m[r.measure] >= F.lit(r.low))
        if r.high != float("inf"):
            inside = inside & (m[r.measure] <= F.lit(r.high))
        ok = ok & ((m["n_words"] < r.min_words) | inside)
    return base_failed, ~base_failed & ok


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per input row: doc_id, base columns, ratios, base_failed, kept."""
    m = docs.select(docs[id_col].alias("doc_id"), measures(docs[text_col]).alias("m"))
    base_failed, kept = verdict(m["m"], rules)
    return m.select("doc_id", "m.*", base_failed.alias("base_failed"), kept.alias("kept"))


def keep(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that pass, with all their columns; a narrow filter."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("r"), measures(docs[text_col]).alias("m"))
    return rows.filter(verdict(rows["m"], rules)[1]).select("r.*")
