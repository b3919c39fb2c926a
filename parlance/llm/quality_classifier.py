"""Quality classifier: expectation-maximisation over weak labellers, then a hashed linear scorer."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.runtime import delete, materialize, sliced
from parlance.llm.textstats import NAMES, SCHEMA, counts, shares, text_stats


@dataclass(frozen=True)
class Labeller:
    """Votes on one share of a text: b(ad) from a threshold on and g(ood) below another, or the other way round; else, and on texts of fewer words
    than it needs, it abstains. Without the second threshold it never votes g: what it looks for is one kind of junk, and that others lack it says little."""

    share: str
    bad: float
    good: float | None = None
    below: bool = False
    least: int = 1

    def vote(self, shares: dict[str, Column]) -> Column:
        value, out = shares[self.share], F.when(F.col("n_words") < self.least, "-")
        out = out.when(value < self.bad if self.below else value >= self.bad, "b")
        if self.good is not None:
            out = out.when(value >= self.good if self.below else value < self.good, "g")
        return out.otherwise("-")


#: Heuristics that overlap: whatever is wrong with a text, two or more of them see it, so that their agreement tells how far each can be trusted.
LABELLERS = {
    "symbols": Labeller("symbols", 0.2),
    "shouting": Labeller("upper", 0.3),
    "exclaims": Labeller("exclaims", 0.3),
    "tables": Labeller("pipes", 0.1),
    "stutter": Labeller("adjacent", 0.25),
    "repeats": Labeller("repeats", 0.7),
    "dup_lines": Labeller("dup_lines", 0.6),
    "mark_runs": Labeller("mark_runs", 0.3),
    "stopless": Labeller("stops", 0.05, 0.1, below=True, least=20),
    "unplain": Labeller("plain", 0.6, 0.85, below=True),
    "narrow": Labeller("richness", 2.0, 3.0, below=True, least=10),
}
BITS = 15
#: Votes that a class is taken to have had at the start, its own and the other's, and documents that the good and the bad class are. The same at every size.
PRIOR = (2.0, 0.5)
SHARE_PRIOR = (10.0, 0.1)
#: Expected documents below which a class has less than half of the weight when the scorer is trained.
LEAST = 10.0


def votes() -> Column:
    """One character for each labeller: b(ad), g(ood) or - (abstains)."""
    named = shares()
    return F.concat(*[labeller.vote(named) for labeller in LABELLERS.values()])


def estimate(patterns: dict[str, int], rounds: int = 200) -> tuple[dict[str, float], np.ndarray]:
    """Posterior probability of being bad for each pattern of votes, and the labellers' rates by class (class, labeller, vote), good first: of b and g among its
    votes, and of abstentions, which are the same for both.

    patterns: number of documents by pattern, of which there are at most 3 ** labellers however large the corpus. Two latent classes, good and
    bad; a document's votes are independent given its class. An abstention says nothing, so texts on which labellers abstain, such as short ones, are no class of their own; a labeller that
    never votes g looks for one kind of junk, and its silence counts as g. EM starts at each document's majority of votes and estimates how often
    each labeller votes b in either class, so that labellers earn their weight by agreement: one that fires at random, or the wrong way round,
    comes to say little, or the opposite. The bad class is tied to bad votes: a document without any is good. And there need be no bad class: unless two classes
    explain the votes better than labellers that fire independently of each other do, by the Bayesian information criterion, all are good. So in a clean corpus false votes of one labeller each
    make nothing bad, where bad documents that two labellers see make a class even at a share of some ten-thousandths. The priors are PRIOR and SHARE_PRIOR, a few documents.
    """
    keys = sorted(patterns)
    if not keys:
        return {}, np.zeros((2, len(LABELLERS), 3))
    weight = np.array([patterns[k] for k in keys], float)
    onehot = np.eye(3)[[["bg-".index(c) for c in key] for key in keys]]
    said = onehot[:, :, :2].sum(1)
    abstain = np.einsum("i,ik->k", weight, onehot[:, :, 2]) / weight.sum()
    seen = onehot[:, :, :2].copy()
    never_good = seen[:, :, 1].sum(0) == 0
    seen[:, never_good, 1] = onehot[:, never_good, 2]
    own, other = PRIOR
    prior = np.array([[other, own], [own, other]])[:, None, :]
    can = said[:, 0] > 0
    bad = np.where(can, 1 / (1 + np.exp(1 - 2 * (said[:, 0] - said[:, 1]))), 0.0)

    def rates_of(each: np.ndarray, prior: np.ndarray) -> np.ndarray:
        out = np.einsum("ic,ikv->ckv", each, seen) + prior
        return out / out.sum(2, keepdims=True)

    for _ in range(rounds):
        each = np.stack([1 - bad, bad], 1) * weight[:, None]
        rates = rates_of(each, prior)
        share = each.sum(0) + SHARE_PRIOR
        logs = np.log(share / share.sum()) + np.einsum("ikv,ckv->ic", seen, np.log(rates))
        new = np.where(can, 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -700, 700))), 0.0)
        moved, bad = np.abs(new - bad).max(), new
        if moved < 1e-10:
            break
    alone = rates_of(weight[:, None], np.array([[other, other]])[:, None, :])
    gain = weight @ (np.logaddexp(logs[:, 0], logs[:, 1]) - np.einsum("ikv,kv->i", seen, np.log(alone[0])))
    if gain < (len(abstain) + 1) / 2 * np.log(weight.sum()):
        bad = np.zeros(len(keys))
    shown = np.concatenate([rates, np.stack([abstain, abstain])[:, :, None]], 2)
    return dict(zip(keys, bad.tolist())), shown


def accuracies(posterior: dict[str, float], patterns: dict[str, int]) -> list[float]:
    """How often each labeller is right where it votes, by the posterior."""
    right, voted = np.zeros(len(next(iter(patterns), ""))), np.zeros(len(next(iter(patterns), "")))
    for key, n in patterns.items():
        for k, vote in enumerate(key):
            if vote != "-":
                voted[k] += n
                right[k] += n * (posterior[key] if vote == "b" else 1 - posterior[key])
    return (right / np.maximum(voted, 1)).tolist()


_runs = re.compile(rb"(.)\1+", re.S)
_shape = bytes(0x61 if 0x61 <= b <= 0x7A or b >= 0x80 else 0x41 if 0x41 <= b <= 0x5A else 0x30 if 0x30 <= b <= 0x39 else b for b in range(256))


class Features:
    """Hashed features of a text: its words in lower case, the shapes of its words, and repetitions of the previous word.

    Values are square roots of relative frequencies, so each of the first two families has norm one whatever the length.
    """

    def __init__(self) -> None:
        self.cache: dict[bytes, int] = {}

    def code(self, word: bytes) -> int:
        if len(self.cache) > 100_000:
            self.cache.clear()
        shape = _runs.sub(rb"\1", word.translate(_shape))[:12]
        out = self.cache[word] = zlib.crc32(word.lower()) % (1 << BITS) << 16 | zlib.crc32(b"\0" + shape) % (1 << BITS)
        return out

    def __call__(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        words = text.split()
        if not words:
            return np.zeros(0, np.int64), np.zeros(0)
        get, code = self.cache.get, self.code
        packed = np.array([get(w) or code(w) for w in words], np.int64)
        a, n = np.unique(packed >> 16, return_counts=True)
        b, m = np.unique(packed & 0xFFFF, return_counts=True)
        again = np.count_nonzero(packed[1:] == packed[:-1])
        at = np.concatenate([a, b, [zlib.crc32(b"\1again") % (1 << BITS)]])
        return at, np.sqrt(np.concatenate([n, m, [again]]) / len(words))


@dataclass
class Scorer:
    """Linear scorer: probability that a document is good. accuracies: the labellers', by name."""

    weights: np.ndarray
    bias: float
    posterior: dict[str, float]
    rates: np.ndarray
    accuracies: dict[str, float]

    def score(self, features: tuple[np.ndarray, np.ndarray]) -> float:
        """Zero for a text without words."""
        at, value = features
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[at] @ value, -50, 50)))) if len(at) else 0.0


def train(rows: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray, copies: np.ndarray, rounds: int = 150, rate: float = 0.5, decay: float = 1e-6) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by full-batch Adagrad; both classes weigh the same if each has LEAST expected rows, so traces of a class that is not there weigh nothing."""
    weights, bias = np.zeros(1 << BITS), 0.0
    if not rows or not len(good):
        return weights, bias
    at = np.concatenate([a for a, _ in rows])
    value = np.concatenate([v for _, v in rows])
    owner = np.repeat(np.arange(len(rows)), [len(a) for a, _ in rows])
    weigh = copies * (good / max(copies @ good, LEAST) + (1 - good) / max(copies @ (1 - good), LEAST))
    seen, seen_bias = np.full(1 << BITS, 1e-8), 1e-8
    for _ in range(rounds):
        margin = bias + np.bincount(owner, weights[at] * value, len(rows))
        error = (1 / (1 + np.exp(-np.clip(margin, -50, 50))) - good) * weigh
        gradient = np.bincount(at, value * error[owner], 1 << BITS) + decay * weights
        seen += gradient**2
        weights -= rate * gradient / np.sqrt(seen)
        seen_bias += error.sum() ** 2
        bias -= rate * error.sum() / np.sqrt(seen_bias)
    return weights, bias


def fit(docs: DataFrame, sample_rows: int = 8_000, sample_features: int = 8_000_000) -> tuple[Scorer, DataFrame]:
    """The scorer, and every document's votes (doc_id, votes).

    Votes and the labellers' accuracies come from all documents. The linear scorer is trained on at most sample_rows
    documents with words that differ in id or text, those with the smallest hash of both, and of these in that order on as many as have sample_features hashed
    features in all; the bounds keep the driver's part the same at every size. Rows equal in id and text are one row of the sample that weighs as many as there are. An empty table, or one of texts without words, gives a scorer that keeps what has words. Null texts have no words.
    """
    stats, _ = materialize(text_stats(docs).select("doc_id", votes().alias("votes")), "votes")
    patterns = {r["votes"]: r["count"] for r in stats.groupBy("votes").count().collect()}
    posterior, rates = estimate(patterns)
    known = dict(zip(LABELLERS, accuracies(posterior, patterns)))
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").cast("binary").alias("text")).withColumn("h", F.xxhash64("doc_id", "text"))
    total = sum(patterns.values())
    if not total:
        return Scorer(np.zeros(1 << BITS), 0.0, posterior, rates, known), stats
    # hashes are even over different rows: a quarter more than are wanted lie below this one, or all there are
    last = (1 << 63) - 1 if 5 * sample_rows >= 4 * total else (5 * sample_rows << 62) // total - (1 << 63)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in sliced(batches):
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            got = [features(t) for t in texts]
            numbers = zip(*[counts(t) for t in texts]) if texts else [[]] * len(NAMES)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(n, pa.int64()) for n in numbers), pa.array([a.tolist() for a, _ in got], pa.list_(pa.int32())), pa.array([v.tolist() for _, v in got], pa.list_(pa.float32())), batch.column(2)],
                ["h", *NAMES, "at", "value", "copies"],
            )

    first = own.where(F.col("h") <= last).groupBy("h").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    sample = first.select("h", "text", "copies").mapInArrow(hashed, f"h long, {SCHEMA}, at array<int>, value array<float>, copies long")
    sample, path = materialize(sample.where("n_words > 0").select("h", votes().alias("votes"), "at", "value", "copies"), "classifier-sample")
    # equal rows share a hash, so that of very many copies one is held
    sizes = sorted((r["h"], r["n"]) for r in sample.select("h", F.size("at").alias("n")).collect())[:sample_rows]
    fits = int(np.searchsorted(np.cumsum([n for _, n in sizes]), sample_features, side="right"))
    chosen = sample.where(F.col("h") <= sizes[fits - 1][0]).toArrow() if fits else sample.limit(0).toArrow()
    delete(path)
    ends = np.cumsum(pc.list_value_length(chosen["at"]).to_numpy())[:-1] if len(chosen) else []
    flat = [chosen[c].combine_chunks().flatten().to_numpy() for c in ("at", "value")]
    rows = list(zip(np.split(flat[0], ends), np.split(flat[1], ends))) if len(chosen) else []
    good = np.array([1 - posterior.get(v, 0.5) for v in chosen["votes"].to_pylist()])
    return Scorer(*train(rows, good, np.array(chosen["copies"].to_pylist(), float)), posterior, rates, known), stats


def score_documents(docs: DataFrame, scorer: Scorer, threshold: float = 0.5) -> DataFrame:
    """doc_id, score (probability of being good) and kept (score >= threshold) of every whole text.

    A null or empty text has no evidence: score 0, not kept. Repeated rows are scored one by one; a null id
    stays null; other columns are not read. A map without shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in sliced(batches):
            score = np.array([scorer.score(features(t or b"")) for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array(score >= threshold, pa.bool_())], ["doc_id", "score", "kept"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, kept boolean")


def keep_good(docs: DataFrame, scorer: Scorer, threshold: float = 0.5) -> DataFrame:
    """The rows, with all their columns, whose text scores at least the threshold. A null or empty text scores 0 and goes; repeated rows
    are scored one by one; nulls in other columns stay; an empty table gives an empty one. A map without shuffle."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in sliced(batches):
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            yield batch.filter(pa.array([scorer.score(features(t or b"")) >= threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
