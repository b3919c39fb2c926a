"""Training datasets: YAML and JSON readers, the annotation grammar, validation, and frames of the parts.

A dataset is written by hand, so it is small and held on the driver; `frames` hands its parts to Spark.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from itertools import cycle
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from parlance.errors import DatasetError
from parlance.operators.entities import BUILTIN_KINDS

LANGUAGES = ("de", "en", "es", "fr", "it", "ja", "ko", "pt_br", "pt_pt")


@dataclass
class Chunk:
    text: str | None
    slot: str | None = None
    entity: str | None = None


@dataclass
class Entity:
    name: str
    extensible: bool = True
    use_synonyms: bool = True
    strictness: float = 1.0
    values: list[tuple[str, list[str]]] = field(default_factory=list)

    @property
    def builtin(self) -> bool:
        return self.name in BUILTIN_KINDS


def parse_annotation(text: str) -> list[Chunk]:
    """Chunks of an utterance in which `[slot]`, `[slot:entity]`, `[slot](value)` and `[slot:entity](value)` mark slots."""
    out: list[Chunk] = []
    at = 0
    while at < len(text):
        opening = text.find("[", at)
        if opening < 0:
            out.append(Chunk(text[at:]))
            break
        if opening > at:
            out.append(Chunk(text[at:opening]))
        closing = text.find("]", opening)
        if closing < 0:
            raise DatasetError(f"no ] after position {opening} of {text!r}")
        slot, _, entity = text[opening + 1 : closing].partition(":")
        at, value = closing + 1, None
        if at < len(text) and text[at] == "(":
            end = text.find(")", at)
            if end < 0:
                raise DatasetError(f"no ) after position {at} of {text!r}")
            value, at = text[at + 1 : end], end + 1
        out.append(Chunk(value, slot.strip(), entity.strip() or None))
    return out


@dataclass
class Dataset:
    language: str
    intents: dict[str, list[list[Chunk]]]
    entities: dict[str, Entity]

    @classmethod
    def from_yaml(cls, language: str, *sources: str | Path) -> Dataset:
        """Documents of type intent or entity from YAML files; a source with a newline is YAML text itself."""
        import yaml

        intents: dict[str, list[list[Chunk]]] = {}
        entities: dict[str, Entity] = {}
        mappings: dict[str, dict[str, str]] = {}
        for source in sources:
            content = str(source) if "\n" in str(source) else Path(source).read_text(encoding="utf-8")
            for doc in yaml.safe_load_all(content):
                if not isinstance(doc, dict) or doc.get("type") not in ("intent", "entity"):
                    raise DatasetError(f"a document must be of type intent or entity, not {doc.get('type') if isinstance(doc, dict) else doc!r}")
                if not doc.get("name"):
                    raise DatasetError("a document has no name")
                if doc["type"] == "entity":
                    values = [(str(v[0]), [str(s) for s in v[1:]]) if isinstance(v, list) else (str(v), []) for v in doc.get("values") or []]
                    entities[doc["name"]] = Entity(doc["name"], doc.get("automatically_extensible", True), doc.get("use_synonyms", True), float(doc.get("matching_strictness", 1.0)), values)
                else:
                    said = [u.strip() for u in doc.get("utterances") or [] if u and u.strip()]
                    if not said:
                        raise DatasetError(f"intent {doc['name']} has no utterances")
                    intents[doc["name"]] = [parse_annotation(u) for u in said]
                    mappings[doc["name"]] = {s["name"]: s["entity"] for s in doc.get("slots") or []}
        return cls(language, intents, entities)._completed(mappings)

    @classmethod
    def from_json(cls, content: dict | str) -> Dataset:
        """The {language, intents, entities} form."""
        data = json.loads(content) if isinstance(content, str) else content
        for key in ("language", "intents", "entities"):
            if key not in data:
                raise DatasetError(f"the dataset has no {key}")
        intents = {name: [[Chunk(c.get("text"), c.get("slot_name"), c.get("entity")) for c in u["data"]] for u in body["utterances"]] for name, body in data["intents"].items()}
        entities = {}
        for name, body in data["entities"].items():
            values = [(v["value"], list(v.get("synonyms", []))) for v in body.get("data", [])]
            entities[name] = Entity(name, body.get("automatically_extensible", True), body.get("use_synonyms", True), float(body.get("matching_strictness", body.get("parser_threshold", 1.0))), values)
        return cls(data["language"], intents, entities)._completed({})

    def _completed(self, mappings: dict[str, dict[str, str]]) -> Dataset:
        """Fill in entities of slots (declared, else the first seen, else named like the slot), missing entities and implicit values."""
        for name, said in self.intents.items():
            known = dict(mappings.get(name, {}))
            for chunk in (c for u in said for c in u if c.slot):
                if chunk.entity:
                    known.setdefault(chunk.slot, chunk.entity)
            for chunk in (c for u in said for c in u if c.slot):
                chunk.entity = chunk.entity or known.get(chunk.slot, chunk.slot)
                self.entities.setdefault(chunk.entity, Entity(chunk.entity))
        values = {n: self._values(n) for n in self.entities}
        turn = {n: cycle(v) for n, v in values.items() if v}
        for chunk in (c for said in self.intents.values() for u in said for c in u if c.slot and c.text is None):
            if chunk.entity not in turn:
                raise DatasetError(f"slot {chunk.slot} has no value and entity {chunk.entity} none either")
            chunk.text = next(turn[chunk.entity])
        return self

    def _values(self, name: str) -> list[str]:
        """Values and synonyms of an entity, then texts of its slots, each once, in order."""
        entity = self.entities[name]
        own = [x for v, synonyms in entity.values for x in [v, *(synonyms if entity.use_synonyms else [])]]
        seen = [c.text for said in self.intents.values() for u in said for c in u if c.entity == name and c.text]
        return list(dict.fromkeys([*own, *seen]))

    def validate(self) -> Dataset:
        """Raise DatasetError for the first breach; sorts intents and entities by name."""
        if self.language not in LANGUAGES:
            raise DatasetError(f"language {self.language!r} is not supported")
        for name, said in self.intents.items():
            if not said:
                raise DatasetError(f"intent {name} has no utterances")
            for chunk in (c for u in said for c in u):
                if not isinstance(chunk.text, str):
                    raise DatasetError(f"a chunk of intent {name} has no text")
                if (chunk.slot is None) != (chunk.entity is None):
                    raise DatasetError(f"a chunk of intent {name} has a slot without entity or the reverse")
                if chunk.entity and chunk.entity not in self.entities and chunk.entity not in BUILTIN_KINDS:
                    raise DatasetError(f"entity {chunk.entity} of intent {name} is not declared")
        for entity in self.entities.values():
            if not 0 <= entity.strictness <= 1:
                raise DatasetError(f"strictness of entity {entity.name} must lie in [0, 1]")
        self.intents, self.entities = dict(sorted(self.intents.items())), dict(sorted(self.entities.items()))
        return self

    def intent_form(self, name: str) -> dict:
        """An intent as in the JSON form."""
        chunk = lambda c: {"text": c.text} | ({"slot_name": c.slot, "entity": c.entity} if c.slot else {})
        return {"utterances": [{"data": [chunk(c) for c in u]} for u in self.intents[name]]}

    def entity_form(self, name: str) -> dict:
        """An entity as in the JSON form; a builtin one is empty."""
        e = self.entities[name]
        return {} if e.builtin else {"automatically_extensible": e.extensible, "use_synonyms": e.use_synonyms, "matching_strictness": e.strictness, "data": [{"value": v, "synonyms": s} for v, s in e.values]}

    def to_json(self) -> str:
        """The JSON form, with sorted keys and an indent of two."""
        data = {"language": self.language, "intents": {n: self.intent_form(n) for n in self.intents}, "entities": {n: self.entity_form(n) for n in self.entities}}
        return json.dumps(data, indent=2, sort_keys=True, ensure_ascii=False)

    def without_builtin_slots(self) -> Dataset:
        """The same with the slots of builtin entities as plain text, and without these entities."""
        plain = lambda c: Chunk(c.text) if c.entity in BUILTIN_KINDS else c
        intents = {n: [[plain(c) for c in u] for u in said] for n, said in self.intents.items()}
        return Dataset(self.language, intents, {n: e for n, e in self.entities.items() if not e.builtin})

    def slot_entities(self, intent: str) -> dict[str, str]:
        """Entity of each slot of an intent; the last one seen wins."""
        return {c.slot: c.entity for u in self.intents[intent] for c in u if c.slot}

    def frames(self, spark: SparkSession) -> dict[str, DataFrame]:
        """texts (id, intent, text), slots (id, intent, n, slot_name, entity, s, e, raw_value), surfaces (entity, ord, value, synonyms), entities
        (entity, extensible, strictness)."""
        texts, slots = [], []
        for intent, said in self.intents.items():
            for u in said:
                text, n, key = "", 0, len(texts)
                for c in u:
                    if c.slot:
                        slots.append((key, intent, n, c.slot, c.entity, len(text), len(text) + len(c.text), c.text))
                        n += 1
                    text += c.text
                texts.append((key, intent, text))
        surfaces = []
        for name, e in self.entities.items():
            if not e.builtin:
                own = {v: (s if e.use_synonyms else []) for v, s in e.values if v.strip()}
                known = {x.lower() for v, s in own.items() for x in [v, *s]}
                seen = [v for v in self._values(name) if v.strip() and v not in own and v.lower() not in known]
                surfaces += [(name, k, v, own.get(v, [])) for k, v in enumerate([*own, *seen])]
        make = spark.createDataFrame
        return {
            "texts": make(texts, "id long, intent string, text string"),
            "slots": make(slots, "id long, intent string, n long, slot_name string, entity string, s long, e long, raw_value string"),
            "surfaces": make(surfaces, "entity string, ord long, value string, synonyms array<string>"),
            "entities": make([(n, e.extensible, e.strictness) for n, e in self.entities.items()], "entity string, extensible boolean, strictness double"),
        }
