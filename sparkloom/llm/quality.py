"""Operator 4: quality rules as a short-circuit cascade of native expressions.

Each rule is a boolean expression over a text and its words, with what it needs from them inside. On a small sample
(``SAMPLE`` rows at most, the first that the table yields; it is written to the shared folder with its words) every
rule's running time, less that of an empty pass, and its share of rejected rows are measured; rules then run in descending
order of rejections per second. The cascade is one CASE expression, so a row leaves at the first rule that rejects it and
what later rules need is not computed for it: ``quality_filter`` pairs windows only for rows that come that far. The order
changes cost only: a row is kept if no rule rejects it, in any order. ``quality_report`` returns the base columns, so it
computes them for every row and only its last rules are short-circuited.

Everything is a built-in expression on one row: no shuffle, no Python on executors, and nothing that depends on other
rows. Repeated three-word windows are found per text by sorting window hashes (64 bits) with their positions.

Words are ``[^\\x20\\x09-\\x0D]+``. Defined cases: null and empty texts have no words and fail the base rule; ties and
repeated rows are judged alone; null ids stay; texts of any length are read whole; an empty table gives an empty result;
other columns are passed through untouched by ``quality_filter`` and not read by ``quality_report``.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: The sample that orders the rules: rows, and bytes of each at most. It decides no verdict.
SAMPLE, SAMPLE_BYTES = 512, 1 << 14
#: Timed passes over the sample; the fastest counts.
PASSES = 3
WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once for all its uses in ``body``: higher-order functions would repeat it for each element."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = lambda x: F.size(x) - F.size(F.array_distinct(x))
    return let(F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))), lines).cast("long")


def n_repeat_words(w: Column) -> Column:
    """Words inside three-word windows that occur at least twice in the text."""

    def positions(s: Column) -> Column:
        n = F.size(s)
        same = lambda x, y: x["h"] == y["h"]
        hit = F.filter(s, lambda x, j: ((j > 0) & same(x, F.get(s, j - 1))) | ((j < n - 1) & same(x, F.get(s, j + 1))))
        return F.size(F.array_distinct(F.flatten(F.transform(hit, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    def repeated(h: Column) -> Column:
        # most texts repeat no window: distinct hashes tell that without sorting
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs, positions))

    def windows(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(v) - 2), lambda i: F.xxhash64(F.element_at(v, i), F.element_at(v, i + 1), F.element_at(v, i + 2)))

    return let(w, lambda v: F.when(F.size(v) < 4, F.lit(0)).otherwise(let(windows(v), repeated))).cast("long")


def word_chars(w: Column) -> Column:
    return F.length(F.array_join(w, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long")


def n_lines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def _once(docs: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Add columns by a generator of one row: a filter on them is not pushed below it, where they would be computed once per use."""
    return docs.select(*(F.col(f"`{c}`") for c in docs.columns), F.inline(F.array(F.struct(*(v.alias(k) for k, v in values.items())))))


@dataclass(frozen=True)
class Base:
    """What rules read: each is a column that is there, or an expression that is computed where a rule asks for it."""

    text: Column
    n_words: Column
    word_chars: Column
    n_symbols: Column
    n_dup_lines: Column
    n_repeat_words: Column

    @classmethod
    def lazy(cls, text: Column, w: Column) -> Base:
        return cls(text, F.size(w).cast("long"), word_chars(w), n_symbols(text), n_dup_lines(text), n_repeat_words(w))


@dataclass(frozen=True)
class Rule:
    """Rejects the rows for which ``rejects`` is true; null is no rejection."""

    name: str
    rejects: Callable[[Base], Column]


def base_failed(n_words: Column, repeat: Column) -> Column:
    return (n_words < 50) | (100 * repeat > 50 * n_words)


#: Letters of scripts that are written without blanks between words.
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"


def _long_words(b: Base) -> Column:
    """Over 20 code points a word, where most of them are not letters of a script without blanks."""
    unspaced = F.length(b.text) - F.length(F.regexp_replace(b.text, UNSPACED, ""))
    return (b.word_chars > 20 * b.n_words) & (2 * unspaced <= b.word_chars)


def default_rules() -> list[Rule]:
    """Rules whose bounds are far from those of prose."""
    return [
        Rule("short_words", lambda b: b.word_chars < 2 * b.n_words),
        Rule("long_words", _long_words),
        Rule("symbols", lambda b: 10 * b.n_symbols > 3 * b.n_words),
        Rule("duplicate_lines", lambda b: 100 * b.n_dup_lines > 60 * n_lines(b.text)),
        Rule("letters", lambda b: 2 * F.length(F.regexp_replace(b.text, r"[^\p{L}]+", "")) < b.word_chars),
    ]


def order_rules(sample: DataFrame, rules: list[Rule], base: Base) -> list[Rule]:
    """Rules by measured rejections per second on the sample, most first."""

    def seconds(rejects: Column) -> tuple[float, int]:
        counted, best, n = sample.agg(F.count_if(rejects).alias("n")), float("inf"), 0
        counted.first()  # compiles
        for _ in range(PASSES):
            began = time.perf_counter()
            n = counted.first().n
            best = min(best, time.perf_counter() - began)
        return best, n

    empty, _ = seconds(base.text.isNotNull() & (base.n_words >= 0))
    score = []
    for at, r in enumerate(rules):
        took, n = seconds(F.coalesce(r.rejects(base), F.lit(False)))
        score.append(((n + 1) / max(took - empty, 1e-4), -at))
    return [rules[-at] for _, at in sorted(score, reverse=True)]


def _ordered(docs: DataFrame, text: Column, rules: list[Rule]) -> list[Rule]:
    rows = docs.select(text.alias("t")).where(F.octet_length("t") <= SAMPLE_BYTES).head(SAMPLE)
    if not rows:
        return rules
    used: list[str] = []
    sample = docs.sparkSession.createDataFrame(rows, "t string").withColumn("w", words(F.col("t")))
    sample = common.staged(sample.coalesce(1), "sample", used)
    out = order_rules(sample, rules, Base.lazy(F.col("t"), F.col("w")))
    common.drop(docs.sparkSession, *used)
    return out


def _cascade(rules: list[Rule], base: Base) -> Column:
    verdict = F
    for r in rules:
        verdict = verdict.when(r.rejects(base), F.lit(False))
    return verdict.otherwise(F.lit(True))


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base columns, base_failed and kept of every row."""
    common.session(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rules = _ordered(docs, text, default_rules())
    out = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("t")).withColumn("w", words(F.col("t")))
    base = Base.lazy(F.col("t"), F.col("w"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    out = _once(out, {n: getattr(base, n) for n in names})
    there = Base(F.col("t"), *map(F.col, names))
    first = Rule("base", lambda b: base_failed(b.n_words, b.n_repeat_words))
    return out.select("doc_id", *names, first.rejects(there).alias("base_failed"), _cascade([first, *rules], there).alias("kept"))


def quality_filter(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows that no rule rejects, with their own columns."""
    common.session(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    # the base rule's halves are rules of their own here: the number of words is known before any other is asked
    repeated = Rule("repeated_windows", lambda b: 100 * b.n_repeat_words > 50 * b.n_words)
    rules = [Rule("few_words", lambda b: b.n_words < 50), *_ordered(docs, text, [*default_rules(), repeated])]
    w, kept = common.fresh(docs, "words", "kept")
    out = docs.withColumn(w, words(text))
    out = _once(out, {kept: _cascade(rules, Base.lazy(text, F.col(w)))})
    return out.where(F.col(kept)).select(*(F.col(f"`{c}`") for c in docs.columns))
