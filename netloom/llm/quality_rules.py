"""Quality rules as a short-circuit cascade, ordered by rejection per cost."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import free_name

BLANK = r"\x20\x09-\x0D"
SYMBOLS = "[#*$%&|<>]"
SAMPLE_ROWS = 2000
MIN_WORDS = 50
REPEATED_PERCENT = 50


def let(value: Column, body) -> Column:
    """`body(value)` with the value computed once per row, not once per use."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words between blanks; null gives none."""
    parts = F.split(F.coalesce(text, F.lit("")), f"[{BLANK}]+")
    return F.filter(parts, lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words in a run of three that occurs twice or more in the list, the first one included.

    Runs are compared by 64-bit hashes. The runs sorted by (hash, place) tell
    which places repeat; a place in order adds the words it does not share with
    the one before it.
    """
    runs = F.when(F.size(words) >= 3, F.sequence(F.lit(0), F.size(words) - 3)).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(runs, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def covered(found: Column) -> Column:
        # Equal neighbours in the sorted hashes; most texts have none and stop here.
        ordered = F.sort_array(found)
        twice = let(ordered, lambda o: F.exists(F.sequence(F.lit(1), F.size(o)), lambda i: F.get(o, i) == F.get(o, i - 1)))

        def count(pairs: Column) -> Column:
            same = F.transform(
                pairs,
                lambda x, i: F.when(
                    (F.get(pairs, i - 1)["h"] == x["h"]) | (F.get(pairs, i + 1)["h"] == x["h"]), x["i"]
                ),
            )
            places = F.sort_array(F.filter(same, lambda i: i.isNotNull()))
            add = F.aggregate(
                places,
                F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
                lambda s, i: F.struct(
                    (s["n"] + F.least(F.lit(3), i - s["last"])).alias("n"), i.alias("last")
                ),
            )
            return add["n"]

        pairs = F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when((F.size(found) > 1) & twice, let(pairs, count)).otherwise(0)

    return let(hashes, covered)


def metrics(df: DataFrame, text: str = "text", into: str = "m") -> DataFrame:
    """Add the struct `into` of counts over a whole text; null has no words and no lines.

    n_words, word_chars (code points in words), n_symbols (characters of
    SYMBOLS), n_lines and n_dup_lines (lines with a word; those equal to an
    earlier one), n_repeat_words (see `repeated_words`), n_chars.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(f"[^{BLANK}]"))
    line_counts = let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d")))
    return df.withColumn(
        into,
        let(
            F.struct(words_of(F.col(text)).alias("w"), line_counts.alias("l")),
            lambda s: F.struct(
                F.size(s["w"]).cast("long").alias("n_words"),
                F.char_length(F.array_join(s["w"], "")).cast("long").alias("word_chars"),
                F.regexp_count(whole, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
                s["l"]["n"].cast("long").alias("n_lines"),
                (s["l"]["n"] - s["l"]["d"]).cast("long").alias("n_dup_lines"),
                repeated_words(s["w"]).cast("long").alias("n_repeat_words"),
                F.char_length(whole).cast("long").alias("n_chars"),
            ),
        ),
    )


@dataclass(frozen=True)
class Rule:
    """A named test; `fails` is a SQL condition over `text` and the metrics `m`."""

    name: str
    fails: str


# Cheap tests read the counts, the others the text.
RULES = (
    Rule("long_words", "m.word_chars > 12 * m.n_words"),
    Rule("short_words", "m.word_chars < 2 * m.n_words"),
    Rule("symbols", "10 * m.n_symbols > m.n_words"),
    Rule("dup_lines", "100 * m.n_dup_lines > 30 * m.n_lines"),
    Rule("no_letters", "2 * regexp_count(text, '[A-Za-z]') < m.word_chars"),
    Rule("ellipsis", "100 * regexp_count(text, '[.][.][.]') > 30 * m.n_lines"),
    Rule("bullets", "100 * regexp_count(text, '(^|\\\\n)[-*]') > 90 * m.n_lines"),
)
BASE = Rule(
    "base", f"m.n_words < {MIN_WORDS} OR 100 * m.n_repeat_words > {REPEATED_PERCENT} * m.n_words"
)


@dataclass(frozen=True)
class Estimate:
    """What the sample says of a rule."""

    rule: Rule
    seconds: float
    rejected: float

    @property
    def value(self) -> float:
        """Rejections per second of testing."""
        return self.rejected / max(self.seconds, 1e-6)


def estimate(df: DataFrame, rules: Sequence[Rule], text: str = "text", rows: int = SAMPLE_ROWS) -> list[Estimate]:
    """Cost and selectivity of every rule on the first `rows` rows, which only set the order of the tests.

    Each rule runs alone over the sample; its cost is the time it takes beyond
    a run without any test.
    """
    sample = metrics(df.select(F.col(text).alias("text")).limit(rows)).cache()
    try:
        total = sample.count()

        def run(condition: str) -> tuple[float, int]:
            began = time.perf_counter()
            hits = sample.agg(F.count_if(F.coalesce(F.expr(condition), F.lit(False)))).first()[0]
            return time.perf_counter() - began, hits

        run("text IS NULL")
        idle, _ = run("text IS NULL")
        out = []
        for rule in rules:
            seconds, hits = run(rule.fails)
            out.append(Estimate(rule, max(seconds - idle, 1e-3), hits / total if total else 0.0))
        return out
    finally:
        sample.unpersist()


def ordered(estimates: Sequence[Estimate]) -> list[Rule]:
    """Rules by rejection per cost, best first; equal ones keep their order."""
    return [e.rule for e in sorted(estimates, key=lambda e: -e.value)]


def cascade(rules: Sequence[Rule]) -> Column:
    """Name of the first rule that a row fails, tested in order; later rules are not evaluated. Null if it passes."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(F.coalesce(F.expr(rule.fails), F.lit(False)), F.lit(rule.name)).otherwise(out)
    return out


def judge(
    df: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", base: Rule | None = BASE, sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """(row, m, base_failed, kept) of every row, with the rules in their best order.

    A row stays if it fails neither `base` nor any rule; a condition that is
    null does not fail. The order of the rules changes the work, never the
    verdict. A null text is an empty text: no words, so the base rule fails it.
    """
    order = ordered(estimate(df, rules, text, sample_rows)) if len(rules) > 1 else list(rules)
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")
    )
    measured = metrics(rows)
    failed = F.coalesce(F.expr(base.fails), F.lit(False)) if base else F.lit(False)
    # The counts are made once: a second projection reads them as they are.
    verdict = measured.select("row", "m", F.struct(failed.alias("base"), F.when(~failed, cascade(order)).alias("rule")).alias("v"))
    return verdict.select(
        "row", "m", F.col("v.base").alias("base_failed"), (~F.col("v.base") & F.col("v.rule").isNull()).alias("kept")
    )


def quality_report(df: DataFrame) -> DataFrame:
    """Counts, base_failed and kept of every document."""
    judged = judge(df.select("doc_id", "text"))
    return judged.select(
        "row.doc_id", "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.n_repeat_words", "base_failed", "kept"
    )


def keep_good(df: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows that pass, with the columns of `df`."""
    return judge(df, rules).where("kept").select("row.*")


REPORT_SQL = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^{BLANK}]+') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{BLANK}]')) AS lines FROM d),
g AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS run
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, run) AS n FROM g),
p AS (SELECT doc_id, count(DISTINCT place) AS n FROM (
  SELECT doc_id, unnest([i, i + 1, i + 2]) AS place FROM r WHERE n > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, text, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(text, '{SYMBOLS}')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words
  FROM w LEFT JOIN p ON p.doc_id = w.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEATED_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEATED_PERCENT} * n_words
    OR word_chars > 12 * n_words OR word_chars < 2 * n_words OR 10 * n_symbols > n_words OR 100 * n_dup_lines > 30 * n_lines
    OR 2 * len(regexp_extract_all(text, '[A-Za-z]')) < word_chars
    OR 100 * len(regexp_extract_all(text, '[.][.][.]')) > 30 * n_lines
    OR 100 * len(regexp_extract_all(text, '(^|\n)[-*]')) > 90 * n_lines) AS kept FROM m"""
