"""Sentence boundaries learned from counts of the corpus, without labels.

A word is an abbreviation if it stands with a period far more often than chance
would have it, the more so the shorter it is. A word is a starter if it follows the
end of a sentence more often than it would by chance. Both are log-likelihood ratios
over word counts, so the corpus is read twice and only one row per word and task moves.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexifold.functions import text as T
from lexifold.session import materialise

# The published thresholds of the unsupervised method, and the share of
# its occurrences in which an abbreviation has its period.
ABBREVIATION_SCORE = 0.3
STARTER_RATIO = 30.0
WITH_PERIOD = 0.99

HAS_LETTER = r"\p{L}"


@dataclass(frozen=True)
class Boundaries:
    """Lower-cased abbreviations, without their last period, and starters. Both are bounded by ``learn``."""

    abbreviations: tuple[str, ...] = ()
    starters: tuple[str, ...] = ()


def _bare(token: Column) -> Column:
    return F.lower(F.regexp_replace(token, r"\.$", ""))


def period_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(word, n, n_period)``: every word with a letter, and how often a period ends it. Null text has no words."""
    tokens = docs.select(F.explode(T.whitespace_tokens(F.col(text))).alias("token")).filter(F.col("token").rlike(HAS_LETTER))
    ended = F.col("token").endswith(".").cast("bigint")
    return tokens.groupBy(_bare(F.col("token")).alias("word")).agg(F.count(F.lit(1)).alias("n"), F.sum(ended).alias("n_period"))


def abbreviation_scores(counts: DataFrame) -> DataFrame:
    """``(word, n, n_period, score, abbreviation)`` for the words that a period ends at least once.

    ``counts`` should be a written table, as its totals are read first. The score is
    the likelihood ratio of "nearly always with a period" to "as often as any word",
    times the periods inside the word, and falls with its length and with its occurrences without one.
    """
    total = counts.agg(F.sum("n").alias("n"), F.sum("n_period").alias("p")).first()
    # Corpora with a period behind every word, or none, tell nothing: the share is kept inside (0, 1).
    share = min(max((total["p"] or 0) / (total["n"] or 1), 1e-9), 1 - 1e-9)
    with_, without = F.col("n_period"), F.col("n") - F.col("n_period")
    chance = with_ * F.log(F.lit(share)) + without * F.log(F.lit(1.0 - share))
    always = with_ * F.log(F.lit(WITH_PERIOD)) + without * F.log(F.lit(1.0 - WITH_PERIOD))
    letters = F.length(F.replace(F.col("word"), F.lit("."), F.lit("")))
    inside = F.length("word") - letters + 1
    score = F.lit(2.0) * (always - chance) * F.exp(-letters) * inside * F.pow(letters.cast("double"), -without)
    return counts.filter("n_period > 0").select("word", "n", "n_period", score.alias("score"), (score >= ABBREVIATION_SCORE).alias("abbreviation"))


def _log_share(hits: Column, of: Column, share: Column) -> Column:
    """Log-likelihood of ``hits`` in ``of`` trials at a share; what never happened adds nothing."""
    yes = F.when(hits > 0, hits * F.log(share)).otherwise(0.0)
    return yes + F.when(of > hits, (of - hits) * F.log(F.lit(1.0) - share)).otherwise(0.0)


def starter_ratios(docs: DataFrame, counts: DataFrame, scores: DataFrame, text: str = "text") -> DataFrame:
    """``(word, n, n_start, ratio, starter)`` for words behind a period that ends no abbreviation.

    ``counts`` and ``scores`` should be written tables. Pairs of neighbours are counted
    before they are joined to the abbreviations, so a frequent word is no hot key.
    """
    tokens = T.whitespace_tokens(F.col(text))
    pairs = docs.select(tokens.alias("left")).select(
        F.inline(F.arrays_zip("left", F.slice("left", 2, F.greatest(F.size("left"), F.lit(1))).alias("right")))
    )
    ends = pairs.filter(F.col("left").endswith(".") & F.col("left").rlike(HAS_LETTER) & F.col("right").rlike(HAS_LETTER))
    counted = ends.groupBy(_bare(F.col("left")).alias("left"), _bare(F.col("right")).alias("word")).agg(F.count(F.lit(1)).alias("k"))
    short = scores.filter("abbreviation").select(F.col("word").alias("left"))
    behind = materialise(counted.join(short, "left", "left_anti").groupBy("word").agg(F.sum("k").alias("n_start")), "behind_periods")
    breaks = behind.agg(F.sum("n_start")).first()[0] or 0
    total = counts.agg(F.sum("n")).first()[0] or 0
    n, hit = F.col("n").cast("double"), F.col("n_start").cast("double")
    every, ended = F.lit(float(total)), F.lit(float(breaks))
    elsewhere, rest = n - hit, every - ended
    same = n / every
    together = _log_share(hit, ended, same) + _log_share(elsewhere, rest, same)
    apart = _log_share(hit, ended, hit / ended) + _log_share(elsewhere, rest, F.when(rest > 0, elsewhere / rest).otherwise(0.0))
    ratio = F.lit(2.0) * (apart - together)
    more = hit / ended > same
    return behind.join(counts.select("word", "n"), "word").select("word", "n", "n_start", ratio.alias("ratio"), ((ratio >= STARTER_RATIO) & more).alias("starter"))


def learn(docs: DataFrame, text: str = "text", most: int = 50_000) -> Boundaries:
    """Abbreviations and starters of a corpus. More than ``most`` of either stop the job, as they are sent to every task."""
    counts = materialise(period_counts(docs, text), "period_counts")
    scores = materialise(abbreviation_scores(counts), "abbreviations")
    ratios = starter_ratios(docs, counts, scores, text)
    found = []
    for kind, table, flag in (("abbreviations", scores, "abbreviation"), ("starters", ratios, "starter")):
        words = [r["word"] for r in table.filter(flag).select("word").limit(most + 1).collect()]
        if len(words) > most:
            raise ValueError(f"more than {most} {kind}; clean the corpus or raise the bound")
        found.append(tuple(sorted(words)))
    return Boundaries(*found)


def sentences(text: Column, known: Boundaries) -> Column:
    """Sentences of a text: the rule's, put together where an abbreviation stands at the end and no starter follows.

    Blanks between the joined parts become one. Null text is one empty sentence, as with the rule.
    """
    if not known.abbreviations:
        return T.sentences(text)

    def joined(parts: Column) -> Column:
        def starts(i: Column) -> Column:
            last = F.lower(F.regexp_extract(F.get(parts, i - 1), r"(\S+)\.$", 1))
            first = _bare(F.regexp_extract(F.get(parts, i), r"^(\S+)", 1))
            runs_on = last.isin(*known.abbreviations)
            return (i == 0) | ~(runs_on & ~first.isin(*known.starters) if known.starters else runs_on)

        cuts = F.filter(F.sequence(F.lit(0), F.size(parts) - 1), starts)
        return T.let(
            cuts,
            lambda at: F.transform(
                at,
                lambda low, k: F.array_join(F.slice(parts, low + 1, F.coalesce(F.get(at, k + 1), F.size(parts)) - low), " "),
            ),
        )

    return T.let(T.sentences(text), joined)
