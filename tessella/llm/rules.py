"""Quality rules as weak supervision, in DataFrame operations only.

Every rule looks at a few counts of the whole text and votes good (1), bad
(-1) or abstains (0). Nobody says how far a rule can be trusted: expectation
maximisation over the table of vote patterns estimates how often each rule
votes which way on good documents and on bad ones. Bad documents are of
several kinds, one for each rule that may know it, as junk that one rule sees
is seldom seen by the others; what else a kind's documents get voted is
estimated too. The posterior probability of good quality then replaces "all
rules must pass": a rule that often cries wolf alone is outvoted.

The vote patterns of m rules are at most 3**m whatever the corpus (6561 for
the rules here), so only that table of counts reaches the driver, and the
posterior is made of literal weights, without a join.

Defined results: a null or empty text has no words (all counts 0) and fails
the base rules; texts of any length are counted whole, in memory of a few
dozen times one text; repeated rows are judged alike; other columns are kept,
those named like a count, ``quality``, ``base_failed`` or ``kept`` are
replaced where counts are asked for; on an empty table the estimated
accuracies are the prior ones.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.base import written

#: ASCII white space, between words.
BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_capitals", "n_stops")
PREFIX = "__rule_"


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts that the rules use. Helper columns start with ``__``."""
    body = F.coalesce(F.col(text), F.lit(""))
    c = F.col
    out = docs.withColumns({"__words": F.array_remove(F.split(body, BLANKS), ""), "__lines": F.filter(F.split(body, "\n", -1), lambda x: F.length(F.regexp_replace(x, BLANKS, "")) > 0)})
    out = out.withColumns({"n_words": F.size("__words").cast("long"), "__solid": F.regexp_replace(body, BLANKS, "")})
    window = lambda w, i: F.struct(F.xxhash64(w, F.get(c("__words"), i + 1), F.get(c("__words"), i + 2)).alias("h"), i.alias("p"))
    out = out.withColumn("__grams", F.when(c("n_words") >= 3, F.sort_array(F.transform(F.slice(c("__words"), 1, (c("n_words") - 2).cast("int")), window))))
    word = lambda g, k: F.get(c("__words"), g["p"] + k)

    def same(g: Column, other: Column) -> Column:
        """Equal windows are neighbours after the sort; the words settle what a hash leaves open."""
        return F.coalesce((g["h"] == other["h"]) & (word(g, 0) == word(other, 0)) & (word(g, 1) == word(other, 1)) & (word(g, 2) == word(other, 2)), F.lit(False))

    repeated = F.filter(c("__grams"), lambda g, i: same(g, F.get(c("__grams"), i - 1)) | same(g, F.get(c("__grams"), i + 1)))
    out = out.withColumn("__at", F.sort_array(F.transform(repeated, lambda g: g["p"])))
    covered = F.aggregate(F.transform(c("__at"), lambda p, i: F.least(F.lit(3), F.get(c("__at"), i + 1) - p)), F.lit(0).cast("long"), lambda a, x: a + x)
    strip = lambda col, chars: F.length(col) - F.length(F.translate(col, chars, ""))
    return out.withColumns(
        {
            "word_chars": F.length("__solid").cast("long"),
            "n_symbols": strip(c("__solid"), SYMBOLS).cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
            "n_lines": F.size("__lines").cast("long"),
            "n_distinct": F.size(F.array_distinct("__words")).cast("long"),
            "n_capitals": strip(c("__solid"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789").cast("long"),
            "n_stops": strip(c("__solid"), ".!?").cast("long"),
        }
    ).drop("__words", "__lines", "__solid", "__grams", "__at")


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0).cast("byte")


def rules() -> dict[str, Column]:
    """The voting rules, by name, over the columns of ``with_counts``. Shares are in integers, so no rounding decides.

    Most rules know one kind of junk and abstain on everything else; three also know a sign of good text.
    """
    c, n, never = F.col, F.col("n_words"), F.lit(False)

    def distinct(share: int) -> Column:
        """At least so many distinct words in a hundred; beyond 2,000 words they need only grow as the root of the length."""
        return F.when(n <= 2000, 100 * c("n_distinct") >= share * n).otherwise(10_000 * c("n_distinct") * c("n_distinct") >= 2000 * share * share * n)

    return {
        "length": _vote(n >= 100, n < 50),
        "word_length": _vote((c("word_chars") >= 3 * n) & (c("word_chars") <= 8 * n), (2 * c("word_chars") < 5 * n) | (c("word_chars") > 14 * n)),
        "distinct": _vote(distinct(40), ~distinct(20)),
        "symbols": _vote(never, 100 * c("n_symbols") > 8 * c("word_chars")),
        "dup_lines": _vote(never, 100 * c("n_dup_lines") > 30 * c("n_lines")),
        "repeats": _vote(never, 100 * c("n_repeat_words") > 35 * n),
        "capitals": _vote(never, 100 * c("n_capitals") > 30 * c("word_chars")),
        "sentences": _vote(never, (n > 400 * c("n_stops")) & (n >= 60)),
    }


def with_votes(counted: DataFrame, voting: dict[str, Column] | None = None) -> DataFrame:
    return counted.withColumns({PREFIX + k: v for k, v in (voting or rules()).items()})


@dataclass(frozen=True)
class Accuracies:
    """What is estimated: the share of good documents and of each kind of bad ones, and how a rule votes (bad, not, good) on each; class 0 is good."""

    names: tuple[str, ...]
    shares: np.ndarray  # class
    outcomes: np.ndarray  # class, rule, outcome; every last row is a distribution

    def accuracy(self, name: str) -> tuple[float, float]:
        """P(right | votes), for documents that are good and for those that are bad."""
        j = self.names.index(name)
        good = self.outcomes[0, j]
        bad = self.shares[1:] @ self.outcomes[1:, j] / self.shares[1:].sum()
        return float(good[2] / (good[2] + good[0])), float(bad[0] / (bad[0] + bad[2]))

    def odds(self) -> np.ndarray:
        """Log odds against good of every kind, rule and outcome."""
        return np.log(self.outcomes[1:] / self.outcomes[0])

    def posterior(self, votes: tuple[int, ...]) -> float:
        """P(good | votes)."""
        each = np.log(self.shares[1:] / self.shares[0]) + sum(self.odds()[:, j, v + 1] for j, v in enumerate(votes))
        return float(1 / (1 + np.exp(each).sum()))

    def quality(self) -> Column:
        """``posterior`` of the vote columns."""
        against = F.lit(0.0)
        for share, odds in zip(np.log(self.shares[1:] / self.shares[0]).tolist(), self.odds().tolist(), strict=True):
            one = F.lit(share)
            for name, (minus, none, plus) in zip(self.names, odds, strict=True):
                vote = F.col(PREFIX + name)
                one = one + F.when(vote == 1, plus).when(vote == -1, minus).otherwise(none)
            against = against + F.exp(one)
        return 1 / (1 + against)


def maximise(patterns: list[tuple[tuple[int, ...], int]], names: list[str], rounds: int = 200, prior: float = 0.85, weight: float = 0.02, alarm: float = 0.005, catch: float = 0.9) -> Accuracies:
    """Expectation maximisation over (votes, count).

    The start is that rules vote bad on a share ``alarm`` of good documents and
    a rule on a share ``catch`` of its kind of bad ones, and otherwise as usual;
    it stays as a Dirichlet prior that counts as ``weight`` times the rows.
    Every estimate is a count with that prior over its total, so outcomes and
    shares sum to 1, and no estimate is bounded.
    """
    m, total = len(names), sum(n for _, n in patterns)
    pseudo = max(1.0, weight * total)
    votes = np.eye(3)[np.array([v for v, _ in patterns], int).reshape(-1, m) + 1]  # pattern, rule, outcome
    rows = np.array([n for _, n in patterns], float)
    usual = (np.einsum("p,pro->ro", rows, votes) + 1) / (total + 3)

    def divided(bad: np.ndarray) -> np.ndarray:
        """Outcomes of a class: what bad votes leave is divided as usual."""
        return np.column_stack([bad, (1 - bad)[:, None] * usual[:, 1:] / usual[:, 1:].sum(1, keepdims=True)])

    mean = np.stack([divided(np.full(m, alarm)), *[divided(np.where(np.arange(m) == k, catch, usual[:, 0])) for k in range(m)]])
    first = np.array([prior, *[(1 - prior) / m] * m])
    shares, outcomes = first, mean
    for _ in range(rounds if total else 0):
        x = np.log(shares) + np.einsum("pro,cro->pc", votes, np.log(outcomes))
        x = np.exp(x - x.max(1, keepdims=True))
        mass = x / x.sum(1, keepdims=True) * rows[:, None]
        outcomes = (np.einsum("pc,pro->cro", mass, votes) + pseudo * first[:, None, None] * mean) / (mass.sum(0) + pseudo * first)[:, None, None]
        shares = (mass.sum(0) + pseudo * first) / (total + pseudo)
    return Accuracies(tuple(names), shares, outcomes)


def fit(voted: DataFrame, names: list[str] | None = None) -> Accuracies:
    """Accuracies from all rows; what is collected has at most 3**m rows."""
    names = names or list(rules())
    columns = [PREFIX + x for x in names]
    counted = voted.groupBy(*columns).count().collect()
    return maximise(sorted((tuple(int(r[x]) for x in columns), int(r["count"])) for r in counted), names)


def judged(voted: DataFrame, model: Accuracies, threshold: float = 0.5) -> DataFrame:
    """Add ``quality`` (posterior probability), ``base_failed`` and ``kept``; votes go."""
    n = F.col("n_words")
    return voted.withColumns({"quality": model.quality(), "base_failed": (n < 50) | (100 * F.col("n_repeat_words") > 50 * n)}).withColumn(
        "kept", ~F.col("base_failed") & (F.col("quality") >= threshold)
    ).drop(*[PREFIX + x for x in model.names])


def assess(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` without the text, with counts and verdict. The counts are written once, to fit and to judge."""
    voted = written(with_votes(with_counts(docs, text).drop(text)), "votes")
    return judged(voted, fit(voted), threshold)


def filter_documents(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents kept, with their columns. They are written once with their votes, as counting costs more than that."""
    boxed = docs.select(F.struct(*[F.col(f"`{x}`") for x in docs.columns]).alias("__row"), F.col(f"`{text}`").alias("__text"))
    voted = with_votes(with_counts(boxed, "__text")).select("__row", "n_words", "n_repeat_words", *[PREFIX + x for x in rules()])
    voted = written(voted, "votes")
    return judged(voted, fit(voted), threshold).where("kept").select("__row.*")
