"""Secret scans: fixed patterns, and a token-efficiency test for random strings."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame

from parlance.llm.runtime import sliced

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Runs that may be a random string: of these characters, at least so many.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Known shapes that are no secrets: digests by their length in hex digits, and others.
DIGESTS = frozenset({32, 40, 56, 64, 96, 128})
KNOWN = re.compile(
    r"(?:[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"  # UUID
    r"|sha(?:1|224|256|384|512)-[A-Za-z0-9+/]+=*"  # subresource digest
    r"|[0-9+/_=-]+"  # numbers, rules, paths of numbers
    r"|(.)\1*)"
)
#: Shapes of identifiers, which are no secrets if their parts are like words: so many characters a token, in lower case.
IDENTIFIER = re.compile(
    r"(?:[A-Za-z]?[a-z]*(?:[A-Z][a-z]+)*[0-9]{0,4}"  # camelCase
    r"|[A-Za-z]+[0-9]{0,4}(?:[/_=+-]++[A-Za-z]*+[0-9]{0,4})*+)"  # snake_case, kebab-case, paths of words
)
PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
WORD_LIKE = 2.25


class Scanner:
    """Secrets of a text as (kind, start, end) in code points, end exclusive."""

    def __init__(self, vocabulary: str, chars_per_token: float) -> None:
        import tiktoken

        with open(vocabulary, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.chars_per_token = chars_per_token

    def random(self, run: str) -> bool:
        """Whether a vocabulary learnt from prose needs so many tokens for the run that it looks random."""
        if KNOWN.fullmatch(run) or (len(run) in DIGESTS and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", run)):
            return False
        if IDENTIFIER.fullmatch(run) and self.words(run):
            return False
        return len(run) < self.chars_per_token * len(self.encoding.encode_ordinary(run))

    def words(self, run: str) -> bool:
        """Whether the parts of an identifier are like words. Of random strings of 20 or more letters about 1 in 100 or fewer seem so."""
        parts = [p.lower() for p in PART.findall(run)]
        return sum(map(len, parts)) >= WORD_LIKE * sum(len(self.encoding.encode_ordinary(p)) for p in parts)

    def __call__(self, text: str) -> list[tuple[str, int, int]]:
        found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
        found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
        found += [("random", m.start(), m.end()) for m in RUN.finditer(text) if self.random(m[0])]
        return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


_scanners: dict[tuple[str, float], Scanner] = {}


def scanner(vocabulary: str | None, chars_per_token: float) -> Scanner:
    key = (vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), chars_per_token)
    if key not in _scanners:
        _scanners[key] = Scanner(*key)
    return _scanners[key]


SPANS = "array<struct<kind:string,start:long,end:long>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan_secrets(docs: DataFrame, vocabulary: str | None = None, chars_per_token: float = 2.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its secrets (kind, start, end), by start, then kind.

    Kinds: assign (a keyword with a value), access (access-key ids), hex (long hex runs) and random
    (runs with fewer than chars_per_token characters to a token, known digests and identifiers made of words left out).
    Spans of different kinds may overlap. Whole texts are read; a null text has none; repeated rows are
    scanned one by one; no other column is read. A map without shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(vocabulary, chars_per_token)
        for batch in sliced(batches):
            rows = [[{"kind": k, "start": a, "end": b} for k, a, b in scan(t)] if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, _SPANS)], ["doc_id", "secrets"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, secrets {SPANS}")


def redact(text: str, spans: list[tuple[str, int, int]], mark: str) -> str:
    """The text with every maximal union of overlapping spans replaced by the mark."""
    out, at = [], 0
    for _, start, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, vocabulary: str | None = None, chars_per_token: float = 2.0, mark: str = "[SECRET]", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The same rows and columns with secrets in the text replaced by the mark and the length column, if any, set to the
    new length. Texts without secrets, null ones included, are left as they are."""
    names, schema = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(vocabulary, chars_per_token)
        at, size = names.index(text_col), names.index(length_col) if length_col in names else None
        for batch in sliced(batches):
            columns, new = list(batch.columns), {}
            for i, text in enumerate(columns[at].to_pylist()):
                if text and (spans := scan(text)):
                    new[i] = redact(text, spans, mark)
            if new:
                texts = columns[at].to_pylist()
                for i, text in new.items():
                    texts[i] = text
                columns[at] = pa.array(texts, columns[at].type)
                if size is not None:
                    sizes = columns[size].to_pylist()
                    for i, text in new.items():
                        sizes[i] = len(text)
                    columns[size] = pa.array(sizes, columns[size].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, schema)
