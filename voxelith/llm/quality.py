"""Quality rules as a short-circuit cascade, in DataFrame functions only.

``measures`` gives the base counts of whole texts as one expression: what it uses twice is bound by a lambda (``let``), so an
optimizer that moves or copies the expression can never make its work more than linear in the text.  ``order_rules`` estimates,
on a bounded sample of rows that pass the base, what each rule costs and how often it rejects what the rules before it
kept, and puts next the rule that rejects most for its cost.  ``cascade`` folds the rules into one CASE: a row that a rule
rejects is not looked at by later rules.  The order changes the work, never the verdict.

Null text: no words, so the base rule fails.  Repeated rows get equal verdicts.  A window of eight words is known by a
64-bit hash within its own text.  Empty tables give no rows.  Columns of docs may have any names: ``judge`` returns its own
columns in place of any of the same name, ``keep_good`` returns docs' columns only.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelith.llm.store import drop, stored

#: Rows that costs and selectivities are estimated on, about (at most four times as many), and how often each is tried.
SAMPLE_ROWS, TRIES = 1000, 5
WINDOW = 8
_SPACES = r"[\x20\x09-\x0D]+"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")



def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words in windows that the text has twice or more."""

    def covered(wins: Column) -> Column:
        ranked = F.sort_array(F.transform(wins, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        again = lambda s: F.transform(  # noqa: E731  equal neighbours are the windows found twice or more
            s, lambda x, i: F.when((x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]), x["p"])
        )
        spans = lambda at: F.transform(at, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW))))
        total = let(F.sort_array(F.array_compact(let(ranked, again))), lambda at: F.aggregate(spans(at), F.lit(0).cast("long"), lambda a, x: a + x))
        return F.when(F.size(F.array_distinct(wins)) < F.size(wins), total).otherwise(F.lit(0).cast("long"))

    hashed = lambda e: F.transform(F.sequence(F.lit(1), F.size(e) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(e, i, WINDOW)))
    each = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < WINDOW, F.lit(0).cast("long")).otherwise(let(let(each, hashed), covered))


def measures(text: Column) -> Column:
    """A struct of COUNTS and base_failed."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeat_words(w).alias("n_repeat_words"),
        )

    of_lines = lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))
    symbols = F.length(F.regexp_replace(t, "[^#*$%&|<>]+", "")).cast("long")
    words = let(F.array_remove(F.split(t, _SPACES), ""), of_words)
    return let(
        F.struct(words.alias("w"), let(lines, of_lines).alias("l")),
        lambda x: F.struct(
            x["w"]["n_words"].alias("n_words"), x["w"]["word_chars"].alias("word_chars"), symbols.alias("n_symbols"), x["l"]["n"].alias("n_lines"),
            x["l"]["dup"].alias("n_dup_lines"), x["w"]["n_repeat_words"].alias("n_repeat_words"),
            ((x["w"]["n_words"] < 20) | (100 * x["w"]["n_repeat_words"] > 30 * x["w"]["n_words"])).alias("base_failed"),
        ),
    )


@dataclass(frozen=True)
class Rule:
    """rejects: of the measures (a struct) and the text."""

    name: str
    rejects: Callable[[Column, Column], Column]


#: Verdicts on counts and whole texts; every threshold is a share of the text, so length plays no part.
RULES = (
    Rule("many symbols", lambda q, t: 10 * q["n_symbols"] > q["n_words"]),
    Rule("repeated lines", lambda q, t: 2 * q["n_dup_lines"] > q["n_lines"]),
    Rule("word length", lambda q, t: (q["word_chars"] < 2 * q["n_words"]) | (q["word_chars"] > 20 * q["n_words"])),
    Rule("exclamations", lambda q, t: F.length(t) - F.length(F.replace(t, F.lit("!!"), F.lit(""))) > q["n_words"] * 0.6),
    Rule("shouting", lambda q, t: 2 * F.length(F.regexp_replace(t, r"\P{Lu}+", "")) > F.length(F.regexp_replace(t, r"\P{L}+", ""))),
    Rule("few words with letters", lambda q, t: 10 * F.regexp_count(t, F.lit(r"\p{L}[^\x20\x09-\x0D]*")) < 7 * q["n_words"]),
)


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> list[Rule]:
    """Rules by rejections for their cost on a sample of about SAMPLE_ROWS rows, each counted on what those before it keep."""
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t"))
    every = max(1, texts.count() // SAMPLE_ROWS)
    drawn = texts.where(F.pmod(F.xxhash64("t"), F.lit(every)) == 0).limit(4 * SAMPLE_ROWS)
    sample = stored(drawn.select("t", measures(F.col("t")).alias("q")).repartition(4))
    good = sample.where("not q.base_failed")
    often = stored(good.select("*", F.explode(F.sequence(F.lit(1), F.lit(TRIES)))).drop("col").coalesce(1))

    def seconds(c: Column) -> float:
        began = time.perf_counter()
        often.agg(F.count_if(c)).collect()
        return time.perf_counter() - began

    q, t = F.col("q"), F.col("t")
    reads = F.length(t) < q["n_words"]  # reads the same rows
    seconds(reads)
    idle = seconds(reads)
    cost = [max(seconds(rule.rejects(q, t)) - idle, 1e-3) for rule in rules]
    pattern = F.array(*(rule.rejects(q, t) for rule in rules))
    left = [(r["p"], r["n"]) for r in good.groupBy(pattern.alias("p")).agg(F.count("*").alias("n")).collect()]  # no more than the sample has rows
    drop(sample), drop(often)
    order: list[int] = []
    while len(order) < len(rules):
        hits = {i: sum(n for p, n in left if p[i]) for i in range(len(rules)) if i not in order}
        best = max(hits, key=lambda i: (hits[i] / cost[i], -cost[i]))
        order.append(best)
        left = [(p, n) for p, n in left if not p[best]]
    return [rules[i] for i in order]


def cascade(q: Column, t: Column, rules: list[Rule] | tuple[Rule, ...]) -> Column:
    """The verdict on measures and text; rules in the given order, each tried only where none before it rejected."""
    verdict = F.when(q["base_failed"], F.lit(False))
    for rule in rules:
        verdict = verdict.when(rule.rejects(q, t), F.lit(False))
    return verdict.otherwise(F.lit(True))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """docs with the counts, base_failed and kept."""
    rules = order_rules(docs, rules, text)
    t, new = F.coalesce(F.col(text), F.lit("")), (*COUNTS, "base_failed")
    verdict = let(measures(t), lambda q: F.struct(*(q[c].alias(c) for c in new), cascade(q, t, rules).alias("kept")))
    old = [c for c in docs.columns if c not in (*new, "kept")]
    inner = docs.select(F.struct(*old).alias("row"), verdict.alias("q"))
    return inner.select(*(F.col("row")[c].alias(c) for c in old), "q.*")


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows of docs that neither the base nor a rule rejects, with docs' columns."""
    rules = order_rules(docs, rules, text)
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.where(let(measures(t), lambda q: cascade(q, t, rules)))
