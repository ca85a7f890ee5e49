"""Quality rules learned as a decision list, in DataFrame operations only.

Statistics of every text (``wordstats``) are made in one pass without a shuffle and
kept in the shared folder; they are a few numbers a row. Labelled rows are joined to
them, and rules for the rejected class are found by sequential covering: a rule grows
by the threshold with the best gain, is pruned on rows held back, and takes the rows
it covers away from the search for the next. Each search step is one aggregate of the
labelled rows to (feature, bin) counts; only those counts, a number fixed by the grid
of thresholds, come to the driver. The list becomes one ordered ``CASE`` expression.

Defined cases: a null text is an empty one; labels that disagree count as the lower;
labels without a document and documents without a label teach nothing; without both
classes there are no rules and everything is kept; repeated documents count as often
as they occur and get equal verdicts; an empty table gives an empty table; input
columns that clash with an output column are replaced by it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointlake.llm.common import cut, fresh, read_table
from pointlake.llm.wordstats import STATS, with_stats

#: Thresholds are powers of two, so many to an octave, between these octaves.
PER_OCTAVE, LOWEST, HIGHEST = 8, -10, 15


def features() -> dict[str, Column]:
    """What rules may test; each is 0 or more."""
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_word": F.col("word_chars") / n,
        "symbol_rate": F.col("n_symbols") / chars,
        "repeat_rate": F.col("n_repeat_words") / n,
        "dup_line_rate": F.col("n_dup_lines") / n,
        "upper_rate": F.col("n_upper") / chars,
        "mark_rate": F.col("n_marks") / n,
    }


@dataclass(frozen=True)
class Test:
    feature: str
    at_least: bool
    threshold: float

    def column(self) -> Column:
        value = features()[self.feature]
        return value >= F.lit(self.threshold) if self.at_least else value < F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold:.6g}"


Rule = tuple[Test, ...]


def holds(rule: Rule) -> Column:
    out = F.lit(True)
    for test in rule:
        out = out & test.column()
    return out


def expression(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, from 1; 0 for none."""
    out = None
    for n, rule in enumerate(rules, 1):
        out = F.when(holds(rule), F.lit(n)) if out is None else out.when(holds(rule), F.lit(n))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def sql(rules: list[Rule]) -> str:
    """The list as it would be read: one line a rule."""
    return "\n".join(f"{n}: reject if {' and '.join(map(str, r))}" for n, r in enumerate(rules, 1)) or "keep all"


def _bins(value: Column) -> Column:
    step = F.floor(F.log2(value) * PER_OCTAVE)
    return F.when(value > 0, F.least(F.greatest(step, F.lit(LOWEST * PER_OCTAVE)), F.lit(HIGHEST * PER_OCTAVE))).otherwise(F.lit(LOWEST * PER_OCTAVE - 1)).cast("int")


def _histogram(rows: DataFrame, label: str) -> dict[str, dict[int, tuple[int, int]]]:
    """Counts of (rejected, kept) rows by feature and bin: as many rows as the grid has cells, at most."""
    pairs = F.array(*[F.struct(F.lit(k).alias("f"), _bins(v).alias("b")) for k, v in features().items()])
    cells = rows.select(label, F.explode(pairs).alias("x")).groupBy("x.f", "x.b").agg(F.sum((F.col(label) == 0).cast("long")).alias("bad"), F.sum((F.col(label) != 0).cast("long")).alias("good"))
    out: dict[str, dict[int, tuple[int, int]]] = {}
    for r in cells.collect():
        out.setdefault(r.f, {})[r.b] = (r.bad, r.good)
    return out


def _best(cells: dict[str, dict[int, tuple[int, int]]], bad: int, good: int, barred: set[str]) -> tuple[float, Test, int, int] | None:
    """The test of the highest information gain over (bad, good) covered so far."""
    base, best = math.log2((bad + 1) / (bad + good + 2)), None
    for feature in sorted(cells.keys() - barred):
        below = [0, 0]
        for b in sorted(cells[feature]):
            if below != [0, 0]:
                for at_least, (p, n) in ((True, (bad - below[0], good - below[1])), (False, tuple(below))):
                    gain = p * (math.log2((p + 1) / (p + n + 2)) - base)
                    if p and (best is None or gain > best[0] + 1e-9):
                        best = (gain, Test(feature, at_least, 2.0 ** (b / PER_OCTAVE)), p, n)
            below = [below[0] + cells[feature][b][0], below[1] + cells[feature][b][1]]
    return best


def learn(rows: DataFrame, label: str, fold: str, most_rules: int = 8, most_tests: int = 3, least_precision: float = 0.97, least_covered: int = 5) -> list[Rule]:
    """Rules for ``label`` 0 among labelled statistics; ``fold`` true: rows held back for pruning.

    A rule must reach ``least_precision`` on the rows held back and on all rows
    that earlier rules leave; a feature whose rule fails opens no other rule.
    """
    rules: list[Rule] = []
    barred: set[str] = set()
    while len(rules) < most_rules:
        left = rows.where(expression(rules) == 0)
        rule: Rule = ()
        while len(rule) < most_tests:
            cells = _histogram(left.where(~F.col(fold) & holds(rule)), label)
            first = next(iter(cells.values()), {})
            bad, good = sum(x[0] for x in first.values()), sum(x[1] for x in first.values())
            if bad < least_covered or rule and good == 0:
                break
            found = _best(cells, bad, good, set() if rule else barred)
            if found is None or found[0] <= 0:
                break
            rule = (*rule, found[1])
        if not rule:
            break
        # pruning: of the rule's beginnings, the one worth most on the rows held back
        hits = lambda k, v, where: F.sum((holds(rule[: k + 1]) & (F.col(label) == v) & where).cast("long"))
        sides = {"held": F.col(fold), "all": F.lit(True)}
        got = left.agg(*[hits(k, v, where).alias(f"{side}{k}_{v}") for side, where in sides.items() for k in range(len(rule)) for v in (0, 1)]).first()
        count = lambda side, k: (got[f"{side}{k}_0"] or 0, got[f"{side}{k}_1"] or 0)
        k = max(range(len(rule)), key=lambda k: (count("held", k)[0] / (sum(count("held", k)) + 1), -k))
        if count("held", k)[0] and all(p >= least_precision * (p + n) for p, n in (count("held", k), count("all", k))):
            rules.append(rule[: k + 1])
        else:
            barred.add(rule[0].feature)
    return rules


def judged(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality") -> tuple[DataFrame, list[Rule]]:
    """Statistics and ``rule`` (0: none holds) of each row of ``docs`` by its id; the list itself."""
    stats = cut(with_stats(docs.select(id_col, text_col), text_col).drop(text_col))
    label, fold = fresh(stats, "label"), fresh(stats, "fold")
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).alias(label))
    marked = stats.join(known, id_col).withColumn(fold, F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(3)) == 0)
    rules = learn(cut(marked.select(*STATS, label, fold)), label, fold)
    return stats.withColumn("rule", expression(rules)), rules


def op3_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats, _ = judged(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return stats.select("doc_id", *STATS[:5], failed.alias("base_failed"), (~failed & (F.col("rule") == 0)).alias("kept"), "rule")
