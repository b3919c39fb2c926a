"""Learned decision lists: sequential covering of low quality by threshold conjunctions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.runtime import materialize
from parlance.llm.textstats import shares, text_stats


@dataclass(frozen=True)
class Condition:
    """name >= value if above, else name < value."""

    name: str
    above: bool
    value: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.name] >= self.value if self.above else x[self.name] < self.value

    def column(self) -> Column:
        c = F.col(self.name)
        return c >= self.value if self.above else c < self.value

    def __str__(self) -> str:
        return f"{self.name} {'>=' if self.above else '<'} {self.value:.6g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for condition in rule:
        out &= condition.holds(x)
    return out


def _best_condition(x: dict[str, np.ndarray], bad: np.ndarray) -> Condition | None:
    """The threshold with the largest information gain for the bad rows, FOIL's measure; None if none gains."""
    p, n = int(bad.sum()), int((~bad).sum())
    base = np.log2(p / (p + n))
    best, gained = None, 1e-9
    for name, values in x.items():
        order = np.argsort(values, kind="stable")
        v, b = values[order], bad[order]
        cut = np.flatnonzero(v[1:] > v[:-1]) + 1  # rows below each threshold
        if not len(cut):
            continue
        below = np.cumsum(b)[cut - 1]
        for above, tp, all_ in ((False, below, cut), (True, p - below, len(v) - cut)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(tp > 0, tp * (np.log2(tp / all_) - base), 0.0)
            i = int(np.argmax(gain))
            if gain[i] > gained:
                best, gained = Condition(name, above, float((v[cut[i]] + v[cut[i] - 1]) / 2)), gain[i]
    return best


def learn(x: dict[str, np.ndarray], bad: np.ndarray, max_rules: int = 16, max_conditions: int = 4, least: int = 3) -> list[Rule]:
    """Rules in order, each a conjunction that marks rows as bad.

    Two thirds of the rows still uncovered grow a rule, condition by condition, until it takes no good row; on the
    other third its last conditions are pruned while that raises (p - n) / (p + n). Covered rows then leave. Ends
    when a rule is no better than even on the pruning rows or covers fewer than `least` bad ones.
    """
    rules: list[Rule] = []
    left = np.arange(len(bad))
    while len(rules) < max_rules and bad[left].sum() >= least:
        grow, prune = left[left % 3 != 0], left[left % 3 == 0]
        rule: list[Condition] = []
        at = grow
        while len(rule) < max_conditions and len(at) and bad[at].any() and not bad[at].all():
            condition = _best_condition({k: v[at] for k, v in x.items()}, bad[at])
            if condition is None:
                break
            rule.append(condition)
            at = at[condition.holds({k: v[at] for k, v in x.items()})]
        if not rule:
            break
        held = {k: v[prune] for k, v in x.items()}

        def worth(r: list[Condition], held: dict = held, prune: np.ndarray = prune) -> float:
            c = covers(tuple(r), held)
            p, n = (bad[prune] & c).sum(), (~bad[prune] & c).sum()
            return (p - n) / (p + n) if p + n else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule.pop()
        taken = covers(tuple(rule), {k: v[left] for k, v in x.items()})
        if worth(rule) <= 0 or (bad[left] & taken).sum() < least:
            break
        rules.append(tuple(rule))
        left = left[~taken]
    return rules


def expression(rules: list[Rule]) -> Column:
    """The list as one ordered conditional: the number of the first rule that holds, or null."""
    out = F.lit(None).cast("int")
    chain = None
    for i, rule in enumerate(rules):
        test = rule[0].column()
        for condition in rule[1:]:
            test &= condition.column()
        chain = F.when(test, F.lit(i)) if chain is None else chain.when(test, F.lit(i))
    return out if chain is None else chain


def fit(stats: DataFrame, labels: DataFrame, sample_rows: int = 20_000, id_col: str = "doc_id", label_col: str = "quality") -> list[Rule]:
    """Learn the list from at most sample_rows labelled rows, those with the smallest hash of their id.

    The bound keeps the driver's part the same at every size of the corpus. Rows without id or label are left out.
    """
    hashed = F.xxhash64("doc_id")
    chosen = labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("label")).where("doc_id is not null and label is not null")
    chosen = chosen.groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(hashed, "doc_id").limit(sample_rows)
    named = shares()
    rows = stats.join(F.broadcast(chosen), "doc_id").orderBy(hashed, "doc_id").limit(sample_rows)
    got = rows.select("label", *[c.alias(k) for k, c in named.items()]).toPandas()
    if not len(got):
        return []
    return learn({k: got[k].to_numpy(float) for k in named}, got["label"].to_numpy() == 0)


def judge(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, min_words: int = 50, max_repeat_percent: int = 50) -> tuple[DataFrame, list[Rule]]:
    """Each document's numbers, base_failed, rule (of the list, null if none holds) and kept; and the list.

    base_failed: fewer than min_words words, or more than max_repeat_percent percent of them in repeated windows.
    kept: neither base_failed nor taken by a rule. A null text has no words, so it fails; a null id is kept as a row;
    repeated rows are judged one by one. Without labels there are no rules. The numbers are one map over the
    texts, written once to the shared folder; all else runs on them.
    """
    stats, _ = materialize(text_stats(docs), "stats")
    rules = fit(stats, labels, sample_rows)
    named = shares()
    rated = stats.select("*", *[c.alias(k) for k, c in named.items()])
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    out = rated.withColumn("base_failed", failed).withColumn("rule", expression(rules))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()), rules
