"""Operator 4: quality rules as a learned decision list.

Fixed base rules come first. Sequential covering then learns, from labelled statistics, an ordered list of
conjunctions of thresholds: a rule grows by the condition of largest information gain on one part of the
labelled documents, is pruned back on the other part, and what it covers is set aside before the next one. The
list is a Spark conditional expression. Statistics are DataFrame functions over whole texts; thresholds are quantiles of
all labelled documents; Spark counts a bounded sample of them (SAMPLE) by the bins between thresholds, and rules grow on
those counts.

Cases: a null text has no words (all counts 0) and fails the base rules, as an empty one does; documents without
a label don't teach; with no labelled documents, or with one class only, the list is empty and keeps what passes
the base rules; repeated rows are judged alike; labels that repeat a document count once each; an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm.common import SPACE, bounded_sample, read, stash

#: Words in a window of the repetition statistic.
WINDOW = 8
FEATURES = ("n_words", "mean_word", "symbol_share", "upper_share", "mark_share", "dup_line_share", "repeat_share", "words_a_line")
#: Thresholds tried for each feature: so many quantiles of the labelled documents.
QUANTILES = 24
#: Labelled documents that rules grow on, about, as many of either class as there are, by hashes of their ids.
SAMPLE = 50_000
MOST_RULES = 12
MOST_CONDITIONS = 4
#: A rule is accepted if so much of what it covers, in the part that prunes, is of the rejected class.
LEAST_PRECISION = 0.9
LEAST_COVER = 5


def _all(column: Column, keep: str) -> Column:
    """How many characters of ``column`` belong to the class."""
    return F.length(F.regexp_replace(column, f"[^{keep}]+", ""))


def _paired(array: str, step: int) -> Column:
    """Hashes of each element with the one ``step`` places on."""
    n = F.greatest(F.size(array) - step, F.lit(0))
    return F.zip_with(F.slice(array, 1, n), F.slice(array, step + 1, n), lambda a, b: F.xxhash64(a, b))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_chars, n_upper, n_marks, n_lines."""
    text = F.coalesce(F.col("text"), F.lit(""))
    step = docs.select("doc_id", text.alias("_text")).select(
        "*",
        F.regexp_extract_all("_text", F.lit(f"[^{SPACE}]+"), F.lit(0)).alias("_words"),
        F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(f"[^{SPACE}]")).alias("_lines"),
    )
    step = step.select(
        "doc_id",
        F.size("_words").cast("long").alias("n_words"),
        (F.length("_text") - _all(F.col("_text"), SPACE)).cast("long").alias("word_chars"),
        _all(F.col("_text"), "#*$%&|<>").cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_lines"),
        _all(F.col("_text"), r"\p{Lu}").cast("long").alias("n_upper"),
        _all(F.col("_text"), r"!\"#$%&'*+/:;<=>?@\[\]^_`{|}~\\").cast("long").alias("n_marks"),
        F.when(F.size("_words") >= WINDOW, F.transform("_words", lambda w: F.xxhash64(w))).otherwise(F.array().cast("array<bigint>")).alias("_h"),
    )
    # hashes of 2, 4, then 8 words in a row
    for n in (1, 2, 4):
        step = step.withColumn("_h", _paired("_h", n))
    step = step.withColumn("_again", F.size(F.array_distinct("_h")) < F.size("_h"))
    step = step.withColumn("_sorted", F.when(F.col("_again"), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("_h")
    same = F.zip_with("_sorted", F.slice("_sorted", 2, F.size("_sorted")), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    step = step.withColumn("_at", F.sort_array(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull()))))).drop("_sorted")
    # each repeated window adds the words up to the next one's start
    adds = F.zip_with("_at", F.slice("_at", 2, F.size("_at")), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    repeated = F.when(F.col("_again"), F.aggregate(adds, F.lit(0).cast("long"), lambda s, x: s + x)).otherwise(F.lit(0).cast("long"))
    return step.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", repeated.alias("n_repeat_words"), "n_lines", "n_upper", "n_marks")


def features(stats: DataFrame) -> DataFrame:
    """The statistics with FEATURES."""
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    made = {
        "mean_word": share("word_chars", "n_words"), "symbol_share": share("n_symbols", "word_chars"), "upper_share": share("n_upper", "word_chars"), "mark_share": share("n_marks", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"), "repeat_share": share("n_repeat_words", "n_words"), "words_a_line": share("n_words", "n_lines"),
    }
    return stats.withColumns(made)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def column(self) -> Column:
        c = F.col(self.feature).cast("double")
        return c >= self.threshold if self.at_least else c < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold:g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    #: Rejected and other documents that it covered in the part that prunes.
    caught: int = 0
    missed: int = 0

    def column(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column()
        return out


@dataclass(frozen=True)
class DecisionList:
    rules: tuple[Rule, ...] = field(default=())

    def keeps(self) -> Column:
        """First rule that fits rejects; what none fits is kept."""
        out = F.lit(True)
        for rule in reversed(self.rules):
            out = F.when(rule.column(), F.lit(False)).otherwise(out)
        return out

    def __str__(self) -> str:
        return "\n".join([*("if " + " and ".join(map(str, r.conditions)) + " then reject" for r in self.rules), "else keep"])


@dataclass
class Counted:
    """Sampled documents by their bins: rows x FEATURES, their class, the part that they belong to, and how many they are."""

    bins: np.ndarray
    bad: np.ndarray
    grow: np.ndarray
    number: np.ndarray

    def where(self, mask: np.ndarray) -> Counted:
        return Counted(self.bins[mask], self.bad[mask], self.grow[mask], self.number[mask])

    def total(self, grow: bool) -> tuple[int, int]:
        """Rejected documents and others of a part."""
        part = self.number * (self.grow == grow)
        return int(part[self.bad].sum()), int(part[~self.bad].sum())

    def candidates(self, cuts: list[list[float]]):
        """Each condition with the rows that it covers (a mask), and the growing part's and the pruning part's (p, n)."""
        for f, thresholds in enumerate(cuts):
            size = len(thresholds) + 1
            code = (2 * self.grow + self.bad) * size + self.bins[:, f]
            table = np.bincount(code, self.number, 4 * size).reshape(2, 2, size)[:, ::-1]  # part, rejected first
            below = table.cumsum(axis=2)
            for k, t in enumerate(thresholds):
                for up in (True, False):
                    (pruned, grown) = below[:, :, -1] - below[:, :, k] if up else below[:, :, k]
                    yield Condition(FEATURES[f], up, t), (f, k, up), tuple(map(int, grown)), tuple(map(int, pruned))

    def covers(self, place: tuple[int, int, bool]) -> np.ndarray:
        f, k, up = place
        return (self.bins[:, f] > k) == up


def counted(rows: DataFrame, cuts: list[list[float]], most: int = SAMPLE) -> Counted:
    """``rows``: doc_id, bad, grow and FEATURES."""
    bins = [sum(((F.col(f) >= t).cast("int") for t in c), F.lit(0)).alias(f) for f, c in zip(FEATURES, cuts, strict=True)]
    found = bounded_sample(rows, "bad", F.col("doc_id"), most).select("bad", "grow", *bins).groupBy("bad", "grow", *FEATURES).agg(F.count("*").alias("n")).collect()
    x = np.array([tuple(r) for r in sorted(map(tuple, found))], np.int64).reshape(-1, len(FEATURES) + 3)
    return Counted(x[:, 2:-1], x[:, 0] > 0, x[:, 1] > 0, x[:, -1])


def learn(labelled: DataFrame) -> DecisionList:
    """``labelled``: doc_id, FEATURES and quality (1 good, 0 to be rejected). Two thirds grow rules, a third prunes."""
    known = labelled.where("quality IS NOT NULL").select("doc_id", (F.col("quality") == 0).alias("bad"), (F.pmod(F.xxhash64("doc_id"), F.lit(3)) > 0).alias("grow"), *[F.col(f).cast("double").alias(f) for f in FEATURES])
    rows = stash(known, "labelled")
    probs = [k / QUANTILES for k in range(1, QUANTILES)]
    # quantiles of either class, so that a rare one has thresholds of its own
    cut = rows.groupBy("bad").agg(*[F.percentile_approx(f, probs).alias(f) for f in FEATURES]).collect()
    if len(cut) < 2:
        return DecisionList()
    cuts = [sorted({x for r in cut for x in r[f]}) for f in FEATURES]
    rules: list[Rule] = []
    rest = counted(rows, cuts)
    while len(rules) < MOST_RULES:
        covered, conditions, steps = rest, [], []
        p0, n0 = rest.total(True)
        if p0 < LEAST_COVER:
            break
        while len(conditions) < MOST_CONDITIONS and n0:
            gain = lambda p, n: p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else -1.0  # noqa: B023, E731
            c, place, grown, pruned = max(covered.candidates(cuts), key=lambda x: (gain(*x[2]), x[0].feature, x[0].at_least, x[0].threshold))
            if gain(*grown) <= 1e-9:
                break
            conditions.append((c, place))
            steps.append(pruned)
            covered = covered.where(covered.covers(place))
            p0, n0 = grown
        if not conditions:
            break
        # prune: keep the prefix that is worth most on rows it hasn't seen
        worth = lambda k: (steps[k][0] - steps[k][1]) / max(1, sum(steps[k]))  # noqa: B023, E731
        best = max(range(len(steps)), key=lambda k: (round(worth(k), 3), steps[k][0], -k))
        p, n = steps[best]
        if p + n < 1 or p / (p + n) < LEAST_PRECISION:
            break
        rules.append(Rule(tuple(c for c, _ in conditions[: best + 1]), p, n))
        gone = np.ones(len(rest.bad), bool)
        for _, place in conditions[: best + 1]:
            gone &= rest.covers(place)
        rest = rest.where(~gone)
    return DecisionList(tuple(rules))


def judge(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DecisionList]:
    """The statistics with base_failed and kept, and the learned list. Texts are read once; all else works on
    their statistics."""
    stats = stash(features(statistics(docs)), "statistics")
    known = labels.select(F.col("doc_id").alias("_id"), F.col("quality"))
    rules = learn(stats.where(~base_failed()).join(known, F.col("doc_id") == F.col("_id")))
    return stats.select("*", base_failed().alias("base_failed"), (~base_failed() & rules.keeps()).alias("kept")), rules


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
