"""Quality rules whose cutoffs come with a guarantee.

Every rule rejects a document when a metric of its text exceeds a cutoff. Cutoffs are decided together, on labelled
documents (quality 1 is good), per stratum of text length. A fixed sequence of steps goes from the mildest cutoffs of all
rules to the strictest ones, each step tightening them jointly. With n good holdouts of which k would be rejected by
any rule at a step, the step is accepted when an exact binomial test shows that less than ``false_rejection`` of all good
documents is lost, P(X <= k | n, false_rejection) <= level. Tests are corrected: the level 1 - ``confidence`` is divided by the number of strata
(Bonferroni), and inside a stratum steps are tested in their order until the first one fails (fixed-sequence
testing). So with probability ``confidence`` no stratum loses more than ``false_rejection`` of its good documents to the
learnt rules. A stratum needs 228 good holdouts without a loss for its first step; where the holdouts cannot show
it, the learnt rules reject nothing there.

Only DataFrame functions are used. Texts are measured where they lie; what is shuffled is a row of numbers per
labelled document. Holdouts are counted by the step that rejects them, so five strata times the steps is
all that is gathered, whatever the input; the chosen cutoffs, one per (stratum, rule), are literals of the plan.

Defined cases: a null text has no words (and so fails the base rules); an empty table gives no rows; repeated rows
are judged alike; labels that are null, or of no document, do not count, and of several labels for one doc_id
the lowest does; texts of any length are measured whole in their row; other columns are not read by ``judge`` and
kept as they are by ``keep_good``, whatever their names. Windows of three words are compared by a 64-bit hash.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from pairloom.functions.text import let
from pairloom.session import write_through

WORD = r"[^\x20\x09-\x0D]+"
#: Words that a text must have, and the percentage of repeated words that it may have.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Lower ends of the strata, in words.
STRATA = (0, 100, 200, 400, 1000)
#: Share of good documents of a stratum that the learnt rules may reject, over all rules.
FALSE_REJECTION = 0.02
#: Probability with which that holds for all strata at once.
CONFIDENCE = 0.95
#: Cutoffs end where a document that is not like the labelled ones could still be sound.
GRID = (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15)
#: Steps from the mildest to the strictest cutoffs, as many as the longest grid has.
STEPS = 16


@dataclass(frozen=True)
class Rule:
    """``metric`` is a Column over the counts; ``cutoffs`` run from the mildest to the strictest."""

    name: str
    metric: Column
    cutoffs: tuple[float, ...] = GRID

    def at(self, step: int) -> float:
        """The cutoff of a step: grids of different lengths begin and end together."""
        return self.cutoffs[step * (len(self.cutoffs) - 1) // (STEPS - 1)]


def _ratio(over: str, under: str) -> Column:
    return F.coalesce(F.try_divide(F.col(over).cast("double"), F.col(under)), F.lit(0.0))


def rules() -> list[Rule]:
    return [
        Rule("symbols", _ratio("n_symbols", "n_words"), (4.0, 3.0, 2.0, 1.5, 1.0, *GRID, 0.1)),
        Rule("shouting", _ratio("n_upper", "word_chars")),
        Rule("repeated_words", _ratio("n_repeat_words", "n_words")),
        Rule("repeated_lines", _ratio("n_dup_lines", "n_words"), (0.2, 0.1, 0.05, 0.02, 0.01)),
        Rule("word_length", _ratio("word_chars", "n_words"), (100.0, 50.0, 30.0, 20.0, 15.0, 12.0, 10.0)),
    ]


def _repeated(words: Column) -> Column:
    """Words inside windows of three words that occur at least twice."""
    starts = F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0)))
    windows = F.sort_array(
        F.transform(
            starts,
            lambda w, i: F.struct(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")),
        )
    )

    def places(sorted_: Column) -> Column:
        same = lambda w, k: F.coalesce(F.get(sorted_, k)["h"] == w["h"], F.lit(False))
        twice = F.filter(sorted_, lambda w, k: same(w, k - 1) | same(w, k + 1))
        return F.sort_array(F.transform(twice, lambda w: w["i"]))

    # Every window adds the words that the one before it does not cover.
    start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
    step = lambda s, i: F.struct((s["n"] + F.least(i - s["last"], F.lit(3))).alias("n"), i.alias("last"))
    return F.aggregate(let(windows, places), start, step, lambda s: s["n"].cast("long"))


def counts(text: Column) -> list[Column]:
    """The counts that the rules are made of."""
    whole = F.coalesce(text, F.lit(""))
    words = let(
        F.regexp_extract_all(whole, F.lit(WORD), F.lit(0)),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeated(w).alias("n_repeat_words"),
        ),
    )
    dup_lines = let(
        F.filter(F.split(whole, "\n"), lambda line: line.rlike(WORD)),
        lambda lines: F.size(lines) - F.size(F.array_distinct(lines)),
    )
    return [
        words.alias("_words"),
        F.regexp_count(whole, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(whole, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        dup_lines.cast("long").alias("n_dup_lines"),
    ]


def measure(docs: DataFrame, *keep: str | Column) -> DataFrame:
    """The counts of every text, ``base_failed``, the stratum and the columns to ``keep``."""
    found = docs.select(*keep, *counts(F.col("text"))).select(
        *[k if isinstance(k, str) else F.col("_doc") for k in keep],
        "_words.n_words", "_words.word_chars", "n_symbols", "n_dup_lines", "_words.n_repeat_words", "n_upper",
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    stratum = reduce(lambda a, b: a + b, [(F.col("n_words") >= low).cast("int") for low in STRATA[1:]])
    return found.withColumn("base_failed", failed).withColumn("stratum", stratum)


def lower_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), added up term by term in logarithms; 1 where k >= n p."""
    import math

    odds = math.log(p) - math.log1p(-p)
    first = n * F.lit(math.log1p(-p))

    def step(s: Column, i: Column) -> Column:
        term = s["term"] + F.log((n - i + 1) / i) + F.lit(odds)
        return F.struct(term.alias("term"), (s["total"] + F.log1p(F.exp(term - s["total"]))).alias("total"))

    start = F.struct(first.alias("term"), first.alias("total"))
    terms = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>"))
    total = F.aggregate(terms, start, step, lambda s: F.exp(s["total"]))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(total)


def cutoffs(
    measured: DataFrame, labels: DataFrame, false_rejection: float = FALSE_REJECTION, confidence: float = CONFIDENCE
) -> DataFrame:
    """(stratum, rule, cutoff, n, k): the cutoffs of the strictest step accepted in each stratum.

    ``measured`` needs doc_id. Good documents that fail the base rules are no holdouts, as those decide alone.
    """
    all_rules, steps = rules(), STEPS
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("quality = 1").select("doc_id")
    holdouts = measured.filter("NOT base_failed").join(good, "doc_id", "left_semi")

    def rejected_at(rule: Rule) -> Column:
        """The first step whose cutoff the metric exceeds; ``steps`` if none does."""
        found = F.lit(steps)
        for step in reversed(range(steps)):
            found = F.when(rule.metric > rule.at(step), F.lit(step)).otherwise(found)
        return found

    placed = holdouts.select("stratum", F.least(*[rejected_at(r) for r in all_rules]).alias("first"))
    histogram = placed.groupBy("stratum", "first").agg(F.count(F.lit(1)).alias("rows"))
    tested = (
        histogram.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
        .groupBy("stratum", "step")
        .agg(F.sum("rows").alias("n"), F.coalesce(F.sum(F.when(F.col("first") <= F.col("step"), F.col("rows"))), F.lit(0)).alias("k"))
    )
    level = (1 - confidence) / len(STRATA)
    tested = tested.withColumn("fails", (lower_tail(F.col("k"), F.col("n"), false_rejection) > level).cast("int"))
    so_far = Window.partitionBy("stratum").orderBy("step")
    accepted = tested.withColumn("failed", F.sum("fails").over(so_far)).filter("failed = 0")
    last = accepted.groupBy("stratum").agg(F.max(F.struct("step", "n", "k")).alias("last")).select("stratum", "last.*")
    chosen = F.array(
        *[
            F.struct(F.lit(r.name).alias("rule"), F.array(*[F.lit(r.at(step)) for step in range(steps)])[F.col("step")].alias("cutoff"))
            for r in all_rules
        ]
    )
    return last.select("stratum", F.inline(chosen), "n", "k").select("stratum", "rule", "cutoff", "n", "k")


def verdict(chosen: DataFrame) -> Column:
    """Whether a measured document stays, by at most one cutoff for each stratum and rule."""
    found = {(r["stratum"], r["rule"]): r["cutoff"] for r in chosen.collect()}
    rejected = F.lit(False)
    for rule in rules():
        for stratum in range(len(STRATA)):
            if (stratum, rule.name) in found:
                rejected |= (F.col("stratum") == stratum) & (rule.metric > found[stratum, rule.name])
    return ~F.col("base_failed") & ~rejected


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The counts of every document, ``base_failed`` and ``kept``."""
    measured = write_through(measure(docs, "doc_id"))
    return measured.select("*", verdict(cutoffs(measured, labels)).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that stay, with their columns. Texts are measured twice rather than shuffled."""
    decided = verdict(cutoffs(measure(docs, "doc_id"), labels))
    return measure(docs, F.struct("*").alias("_doc")).filter(decided).select("_doc.*")
