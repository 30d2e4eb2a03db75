"""Weakly supervised quality: rules vote good, bad or abstain, and EM weighs the votes.

Each rule is a column expression. How often each combination of votes occurs over all
documents is one map-side aggregate of at most 3 ** rules rows; expectation-maximisation
over these counts estimates, for each rule, how often it votes either way or abstains on
good and on bad documents (its accuracies), and the share of good documents. A document's
posterior probability of being good is then a sum of log odds, again a column expression.
All of it is DataFrame code; only the vote counts reach the driver.

Defined results: a null or empty text has no words, fails the base rules and is not kept;
repeated rows get equal verdicts; an empty table gives an empty result; doc_id may be null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import stored

_SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
KEEP_FROM = 0.5
#: Prior: a rule is right more often than not, and most documents are good.
PRIOR_GOOD = 0.85
PRIOR_ACCURACY = 0.9
PRIOR_STRENGTH = 0.02
STEPS = 200


def words_of(text: Column) -> Column:
    """Runs of anything but space, tab, and the line and page breaks."""
    return F.filter(F.split(text, r"[ \t-\r]+"), lambda w: w != "")


def repeated_words(words: Column, n: Column) -> Column:
    """Words in three-word windows found twice or more, by sorting the windows' hashes within the row."""
    windows = F.transform(F.slice(words, 1, F.greatest(n - 2, F.lit(0))),
                          lambda w, i: F.struct(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))
    ordered = F.array_sort(windows)
    return ordered, lambda o: F.size(F.array_distinct(F.flatten(F.transform(
        F.filter(o, lambda x, k: (x["h"] == F.get(o, k - 1)["h"]) | (x["h"] == F.get(o, k + 1)["h"])),
        lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))


def measures(documents: DataFrame) -> DataFrame:
    """doc_id, n_words and the base measures of every whole text, one row per row, without a shuffle."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(F.col("t"), "\n"), lambda s: s.rlike(r"[^ \t-\r]"))

    def held(df: DataFrame, name: str, value: Column) -> DataFrame:
        """Compute a column once: a generator stops the optimiser from repeating it inside every use."""
        return df.select("*", F.explode(F.array(value)).alias(name))

    rows = held(documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t")), "w", words_of(F.col("t")))
    rows = held(rows.withColumn("n_words", F.size("w").cast("long")), "l", lines)
    ordered, covered = repeated_words(F.col("w"), F.size("w"))
    rows = held(rows, "o", ordered)
    length = F.length("t")
    return rows.select(
        "doc_id", "n_words",
        F.length(F.translate("t", _SPACE, "")).cast("long").alias("word_chars"),
        (length - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        covered(F.col("o")).cast("long").alias("n_repeat_words"),
        F.size("l").cast("long").alias("n_lines"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
        (length - F.length(F.translate("t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long").alias("n_upper"),
        (length - F.length(F.translate("t", "0123456789", ""))).cast("long").alias("n_digits"),
        (length - F.length(F.translate("t", ".!?", ""))).cast("long").alias("n_stops"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))


def _vote(bad: Column | None = None, good: Column | None = None) -> Column:
    vote = F.lit(0) if good is None else F.when(good, 1).otherwise(0)
    return vote if bad is None else F.when(bad, -1).otherwise(vote)


def rules() -> dict[str, Column]:
    """Votes: 1 good, -1 bad, 0 abstains. Rules that look for a defect say nothing where there is none."""
    c, n = F.col, F.greatest(F.col("n_words"), F.lit(1))
    chars, lines = F.greatest(c("word_chars"), F.lit(1)), F.greatest(c("n_lines"), F.lit(1))
    return {
        "short": _vote(bad=n < MIN_WORDS),
        "symbols": _vote(bad=c("n_symbols") / n > 0.2),
        "repeats": _vote(bad=c("n_repeat_words") / n > 0.4),
        "lines": _vote(bad=(c("n_dup_lines") / lines > 0.4) & (c("n_dup_lines") > 2)),
        "capitals": _vote(bad=c("n_upper") / chars > 0.3),
        "digits": _vote(bad=c("n_digits") / chars > 0.3),
        "word_size": _vote(bad=(chars / n < 2) | (chars / n > 14)),
        "variety": _vote(bad=(c("n_distinct") / n < 0.1) & (n < 5000)),
        "shouting": _vote(bad=c("n_stops") / n > 0.8),
        "prose": _vote(good=(n >= MIN_WORDS) & (c("n_stops") / n).between(0.01, 0.4) & (c("n_symbols") / n < 0.05)
                       & (c("n_upper") / chars < 0.15) & (c("n_distinct") / n > 0.3)),
    }


class VoteModel:
    """Share of good documents, and the chance of each vote of each rule given good (1) and bad (0)."""

    def __init__(self, names: list[str], counts: dict[tuple[int, ...], int], steps: int = STEPS):
        self.names, self.good = names, PRIOR_GOOD
        total = sum(counts.values())
        seen = [{v: sum(n for p, n in counts.items() if p[k] == v) for v in (-1, 0, 1)} for k in range(len(names))]
        strength = max(1.0, PRIOR_STRENGTH * total)
        self.prior = []
        for k in range(len(names)):
            idle = (seen[k][0] + 1) / (total + 2)
            right, wrong = PRIOR_ACCURACY * (1 - idle), (1 - PRIOR_ACCURACY) * (1 - idle)
            self.prior.append(({-1: right, 0: idle, 1: wrong}, {-1: wrong, 0: idle, 1: right}))
        self.chance = [tuple(dict(x) for x in p) for p in self.prior]
        for _ in range(steps if total else 0):
            weight = {p: self.posterior(p) for p in counts}
            mass = (sum(n * (1 - weight[p]) for p, n in counts.items()), sum(n * weight[p] for p, n in counts.items()))
            good = (mass[1] + strength * PRIOR_GOOD) / (total + strength)
            chance = []
            for k in range(len(names)):
                both = []
                for y in (0, 1):
                    got = {v: strength * self.prior[k][y][v] for v in (-1, 0, 1)}
                    for p, n in counts.items():
                        got[p[k]] += n * (weight[p] if y else 1 - weight[p])
                    both.append({v: x / (mass[y] + strength) for v, x in got.items()})
                for y, vote in ((0, -1), (1, 1)):  # a rule is never taken for worse than chance
                    both[1 - y][vote] = min(both[1 - y][vote], both[y][vote])
                chance.append(tuple(both))
            moved = max([abs(good - self.good), *(abs(a[y][v] - b[y][v]) for a, b in zip(chance, self.chance, strict=True)
                                                  for y in (0, 1) for v in (-1, 0, 1))])
            self.good, self.chance = good, chance
            if moved < 1e-7:
                break

    def log_odds(self, k: int, vote: int) -> float:
        bad, good = self.chance[k]
        return math.log(max(good[vote], 1e-9) / max(bad[vote], 1e-9))

    def posterior(self, pattern: tuple[int, ...]) -> float:
        z = math.log(self.good / (1 - self.good)) + sum(self.log_odds(k, v) for k, v in enumerate(pattern))
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))

    def accuracy(self) -> dict[str, float]:
        """Share of each rule's votes that are right."""
        out = {}
        for k, name in enumerate(self.names):
            bad, good = self.chance[k]
            right, wrong = self.good * good[1] + (1 - self.good) * bad[-1], self.good * good[-1] + (1 - self.good) * bad[1]
            out[name] = right / (right + wrong)
        return out

    def column(self) -> Column:
        z = F.lit(math.log(self.good / (1 - self.good)))
        for k, name in enumerate(self.names):
            vote = F.col(f"vote_{name}")
            z = z + F.when(vote == 1, self.log_odds(k, 1)).when(vote == -1, self.log_odds(k, -1)).otherwise(self.log_odds(k, 0))
        return 1 / (1 + F.exp(-z))


def quality(documents: DataFrame, keep_from: float = KEEP_FROM) -> DataFrame:
    """doc_id, the base measures, base_failed, every vote, p_good and kept."""
    names = list(rules())
    votes = [f"vote_{n}" for n in names]
    voted = stored(measures(documents).withColumns({f"vote_{n}": v.cast("byte") for n, v in rules().items()}), "votes")
    counts = {tuple(r[v] for v in votes): r["count"] for r in voted.groupBy(*votes).count().collect()}  # 3 ** rules at most
    model = VoteModel(names, counts)
    return voted.withColumn("base_failed", base_failed()).withColumn("p_good", model.column()).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("p_good") >= keep_from)).alias("kept"), "p_good", *votes)
