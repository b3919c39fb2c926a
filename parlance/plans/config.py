"""Configurations of the engine and its units as frozen dataclasses, to and from JSON."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, is_dataclass

from parlance.operators.classifier import Featurizer
from parlance.operators.token_features import DEFAULT, FeatureConfig, needs
from parlance.plans.plugins import CLASSIFIERS, ENTITY_PARSERS, PARSERS, SLOT_FILLERS


@dataclass(frozen=True)
class UnitConfig:
    """A unit without a configuration class of its own: its options as they are."""

    unit: str
    options: dict = field(default_factory=dict)

    def resources(self) -> dict[str, set[str]]:
        return {}


@dataclass(frozen=True)
class LookupConfig:
    unit: str = "lookup"
    ignore_stop_words: bool = False

    def resources(self) -> dict[str, set[str]]:
        return {}


@dataclass(frozen=True)
class PatternConfig:
    unit: str = "pattern"
    max_queries: int = 100
    max_pattern_length: int = 1000
    ignore_stop_words: bool = False

    def resources(self) -> dict[str, set[str]]:
        return {}


@dataclass(frozen=True)
class ClassifierConfig:
    """min_utterances, unknown_word_prob and max_unknown_words: how utterances are made up for training; noise_factor: noise in utterances of a mean intent."""

    unit: str = "log_reg"
    min_utterances: int = 20
    noise_factor: int = 5
    noise_reweight_factor: float = 1.0
    unknown_word_prob: float = 0.0
    max_unknown_words: int = 3
    featurizer: Featurizer = Featurizer()

    def resources(self) -> dict[str, set[str]]:
        out = {"stems": {"stems"} if self.featurizer.use_stemming else set(), "stop_words": {"stop_words"} if self.featurizer.filter_stop_words else set()}
        return out | {"word_clusters": {self.featurizer.word_clusters_name} if self.featurizer.word_clusters_name else set()}


@dataclass(frozen=True)
class SlotFillerConfig:
    """capitalization_ratio: the share of made-up values that are in title case, the rest being in lower case."""

    unit: str = "crf"
    tagging_scheme: str = "BIO"
    c1: float = 0.1
    c2: float = 0.1
    min_utterances: int = 60
    capitalization_ratio: float = 0.2
    features: tuple[FeatureConfig, ...] = DEFAULT

    def resources(self) -> dict[str, set[str]]:
        return needs(self.features)


@dataclass(frozen=True)
class KeywordConfig:
    """keywords: {intent: {slot: {keyword: entity}}}."""

    unit: str = "keyword"
    keywords: dict = field(default_factory=dict)
    lowercase: bool = False

    def resources(self) -> dict[str, set[str]]:
        return {}


@dataclass(frozen=True)
class ProbabilisticConfig:
    unit: str = "probabilistic"
    classifier: object = field(default_factory=ClassifierConfig)
    slot_filler: object = field(default_factory=SlotFillerConfig)

    def resources(self) -> dict[str, set[str]]:
        return union(self.classifier.resources(), self.slot_filler.resources())


@dataclass(frozen=True)
class EngineConfig:
    """The parsers in the order in which they are asked. longest_value: tokens of the longest dictionary value that is looked for; None: as long as they are. entity_matching: what dictionary values
    are matched by, forms of words ("plain"), their stems ("stemmed") or either ("both"); "auto": what the units read, forms, stems, or some the ones and some the others."""

    parsers: tuple = (LookupConfig(), ProbabilisticConfig())
    seed: int = 0
    longest_value: int | None = None
    entity_matching: str = "auto"

    def matching(self) -> str:
        if self.entity_matching not in ("auto", "plain", "stemmed", "both"):
            raise ValueError(f"unknown matching {self.entity_matching!r}")
        if self.entity_matching != "auto":
            return self.entity_matching
        read = [part for p in self.parsers for part in ((p.classifier, p.slot_filler) if isinstance(p, ProbabilisticConfig) else (p,))]
        by_stems = {bool(part.resources().get("stems")) for part in read}
        return {(True,): "stemmed", (False, True): "both"}.get(tuple(sorted(by_stems)), "plain")

    def resources(self) -> dict[str, set[str]]:
        """What the units and the dictionary need of a language's resources, by kind and name."""
        return union(*(p.resources() for p in self.parsers), {} if self.matching() == "plain" else {"stems": {"stems"}})

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2, sort_keys=True)

    @classmethod
    def from_json(cls, content: str) -> EngineConfig:
        data = json.loads(content)
        parsers = tuple(unit_config(p) for p in data.get("parsers", []))
        return build(cls, {k: v for k, v in data.items() if k != "parsers"} | ({"parsers": parsers} if parsers else {}))


def union(*needed: dict[str, set[str]]) -> dict[str, set[str]]:
    out: dict[str, set[str]] = {}
    for need in needed:
        for kind, names in need.items():
            out[kind] = out.get(kind, set()) | set(names)
    return {k: v for k, v in out.items() if v}


KINDS = {"lookup": LookupConfig, "pattern": PatternConfig, "probabilistic": ProbabilisticConfig, "log_reg": ClassifierConfig, "crf": SlotFillerConfig, "keyword": KeywordConfig}


def unit_config(values: dict):
    """The configuration of a unit from a dict: of its own class, or the class that its plug-in names, or its options as they are."""
    name = values.get("unit")
    kind = KINDS.get(name)
    for registry in (PARSERS, CLASSIFIERS, SLOT_FILLERS, ENTITY_PARSERS):
        if kind is None and name in registry.held:
            kind = getattr(registry.held[name], "config_type", UnitConfig)
    if kind is None:
        PARSERS.by_name(name)  # raises, and says which there are
    return build(kind, values)


def build(kind: type, values: dict):
    """A configuration from a dict; keys that it does not have raise."""
    known = {f.name: f for f in fields(kind)}
    if extra := set(values) - set(known):
        raise ValueError(f"{kind.__name__} has no {', '.join(sorted(extra))}")

    def part(name: str, value: object) -> object:
        if is_dataclass(value) or name not in ("classifier", "slot_filler", "featurizer", "features"):
            return value
        if name == "featurizer":
            return build(Featurizer, value)
        if name == "features":
            return tuple(v if is_dataclass(v) else build(FeatureConfig, v | {"offsets": tuple(v.get("offsets", (0,)))}) for v in value)
        return unit_config({"unit": {"classifier": "log_reg", "slot_filler": "crf"}[name]} | value)

    return kind(**{k: part(k, v) for k, v in values.items()})
