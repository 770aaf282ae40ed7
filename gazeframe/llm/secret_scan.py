"""Secrets: three fixed patterns, and strings that a tokenizer finds hard to write.

Words of a language take few tokens of a public byte-pair vocabulary; random strings take many. A long
string of letters, digits and key symbols is flagged if it has fewer characters per token than
a limit, unless it is a known digest (hexadecimal of a usual length, a UUID). Where it is built like an identifier
(words joined by ``_``, ``-``, ``/``, ``+``, ``=`` or capitals) or has no digit, its longest run of letters is judged in its place, by a
stricter limit, since compounds of languages strange to the vocabulary come near the usual one; a run that is short passes. Strings without
letters pass too. The vocabulary's bytes, a fixed file given by path, travel with the task.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, partial

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "random")
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LEAST_LENGTH = 20
MOST_CHARS_PER_TOKEN = 2.4
#: For letters alone. Compounds in Finnish or Czech have 2.09 and more, 95 of 100 random strings of 20 letters 2.0 at most.
MOST_LETTERS_PER_TOKEN = 2.05
LEAST_LETTERS = 16
_PIECES = r"\p{L}+|\p{N}{1,3}|[^\p{L}\p{N}]+"

Span = tuple[str, int, int]

_ASSIGN = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_LONG = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST_LENGTH)
_MARKS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)")
_DIGEST_LENGTHS = frozenset((32, 40, 48, 56, 64, 96, 128))
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_SEPARATORS = re.compile(r"[_/=+-]+")
_LETTERS = re.compile(r"[A-Za-z]+")
_PART = re.compile(r"[A-Za-z][a-z]+|[A-Z]+|[0-9]{1,4}")


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by start and then kind."""
    out: list[Span] = []
    low = text.lower()
    if any(m in low for m in _MARKS):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 18]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def digest(body: str) -> bool:
    """Known digests, which are no secrets however they look."""
    return bool((len(body) in _DIGEST_LENGTHS and _DIGEST.fullmatch(body)) or _UUID.fullmatch(body))


def identifier(body: str) -> bool:
    """Whether a string consists of a few parts of word length, as names in programs do."""
    parts = [p for piece in _SEPARATORS.split(body) for p in _PART.findall(piece)]
    letters = sum(map(len, parts))
    separators = len(re.findall(r"[_/=+-]", body))
    return letters + separators == len(body) and len(parts) > 0 and letters / len(parts) >= 4


@lru_cache(maxsize=2)
def encoder(vocabulary: bytes) -> tiktoken.Encoding:
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("scan", pat_str=_PIECES, mergeable_ranks=ranks, special_tokens={})


def looks_random(body: str, enc: tiktoken.Encoding) -> bool:
    """The test of one long string: its pieces between separators, each encoded whole."""
    runs = _LETTERS.findall(body)
    if not runs or digest(body):
        return False
    limit, pieces = MOST_CHARS_PER_TOKEN, [p for p in _SEPARATORS.split(body) if p]
    if identifier(body) or not any(c.isdigit() for c in body):
        limit, pieces = MOST_LETTERS_PER_TOKEN, [max(runs, key=len)]
        if len(pieces[0]) < LEAST_LETTERS:
            return False
    return sum(map(len, pieces)) < limit * sum(len(enc.encode_ordinary(p)) for p in pieces)


def random_strings(text: str, enc: tiktoken.Encoding) -> list[Span]:
    return [("random", *m.span()) for m in _LONG.finditer(text) if looks_random(m[0], enc)]


def all_spans(text: str, enc: tiktoken.Encoding) -> tuple[list[Span], list[Span]]:
    base = base_spans(text)
    more = [s for s in random_strings(text, enc) if not any(a < s[2] and s[1] < b for _, a, b in base)] if text else []
    return base, sorted([*base, *more], key=lambda s: (s[1], KINDS.index(s[0])))


def _written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _scan(batches: Iterator[pa.RecordBatch], vocabulary) -> Iterator[pa.RecordBatch]:
    enc = encoder(vocabulary.value)
    for batch in batches:
        counts: dict[str, list[int]] = {k: [] for k in KINDS}
        hashes, listed = [], []
        for text in batch.column("text").to_pylist():
            base, every = all_spans(text or "", enc)
            per = Counter(k for k, *_ in every)
            for k in KINDS:
                counts[k].append(per[k])
            hashes.append(hashlib.sha256(_written(base).encode()).hexdigest())
            listed.append(_written(every))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(hashes, pa.string()), pa.array(listed, pa.string())],
            names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
        )


def find_secrets(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Counts and spans for every row of ``docs`` (``doc_id``, ``text``).

    ``vocabulary`` is a file of token ranks that the driver can read. A null text is empty and has no
    spans; repeated rows get the same answer each; other columns are ignored; an empty table gives
    an empty result.
    """
    with open(vocabulary, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # a fixed file of under a megabyte
    schema = "doc_id bigint, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string"
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return narrow.mapInArrow(partial(_scan, vocabulary=shared), schema)
