"""Personal data by weak supervision: labelers vote on spans, EM weighs them, a classifier decides.

Candidate spans are what the four base patterns accept, and looser ones: numbers that look like
phones, identity numbers, written-out addresses, names after a form of address, places of living.
Six labelers (two of each sort: patterns, gazetteers, context) vote yes, no or not at all. The votes of all texts are
counted per vote pattern and span shape; these few counts, whose number is bounded by their
kinds and not by the data, are all the driver gets. Expectation-maximisation estimates how
reliable each labeler is, then a logistic classifier is fitted to the resulting probabilities over votes and shapes. It
decides on the looser candidates; base spans stay in any case.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazeframe.llm.words import slices

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "identity", "person", "address")
LABELERS = ("strict_pattern", "check_rule", "known_names", "known_places", "near_cue", "near_denial")
ACCEPT = 0.5

Span = tuple[str, int, int]

_DIGIT = re.compile("[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Anchored at each ``@``, so that long runs without one cost nothing."""
    floor = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            floor = m.end()


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _addresses_ip(text: str) -> Iterator[tuple[int, int]]:
    """Chains of dotted numbers, four at a time."""
    for m in _CHAIN.finditer(text):
        parts = m[0].split(".")
        at = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(map(_octet, four)):
                yield at, end
            at = end + 1


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Spans of the four fixed patterns, by start and then kind."""
    out: list[Span] = []
    if "@" in text:
        out += [("email", *x) for x in _emails(text)]
    if _DIGIT.search(text):
        if "." in text:
            out += [("ip", *x) for x in _addresses_ip(text)]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_digits(m[0])) <= 15:
                    out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def failed_spans(text: str) -> list[Span]:
    """Matches that the base rules drop: numbers too long or too odd for what they look like.

    They are never accepted; the labelers' votes on them show EM what false spans look like.
    """
    if not _DIGIT.search(text):
        return []
    cards = [("card", *m.span()) for m in _CARD.finditer(text) if m.end() - m.start() >= 14]
    cards = [s for s in cards if not (14 <= len(d := _digits(text[s[1] : s[2]])) <= 19 and luhn(d))]
    dotted = [("ip", *m.span()) for m in _CHAIN.finditer(text) if m[0].count(".") == 3]
    return cards + [s for s in dotted if not all(map(_octet, text[s[1] : s[2]].split(".")))]


# Small gazetteers and cue words.
_NAMES = frozenset(
    "anna maria peter thomas michael john james mary robert david linda susan paul laura julia martin carlos jose luis "
    "carmen ana pedro juan jean pierre marie claude sophie nicolas hans klaus petra sabine wolfgang".split()
)
_PLACES = frozenset(
    "street road avenue lane drive boulevard square rue place chemin strasse straße weg platz allee calle avenida plaza".split()
)
_TITLES = ("Mr", "Mrs", "Ms", "Dr", "Herr", "Frau", "Monsieur", "Madame", "Señor", "Señora", "name is", "Name ist", "m'appelle", "me llamo")
_CUES = {
    "phone": ("phone", "call", "tel", "mobile", "fax", "telefon", "téléphone", "teléfono"),
    "email": ("mail", "contact", "write", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta"),
    "identity": ("ssn", "social", "passport", "identity", "ausweis", "pasaporte", "passeport"),
    "person": ("name", "born", "contact", "by", "from"),
    "address": ("address", "live", "street", "adresse", "dirección", "home"),
}
_DENIALS = ("version", "isbn", "invoice", "order", "page", "chapter", "figure", "section", "doi", "serial", "example")

_LOOSE_PHONE = re.compile(r"(?<![0-9.+-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])")
_IDENTITY = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_WRITTEN = re.compile(r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64} ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]{1,63} ?(?:\[dot\]|\(dot\)|\.) ?[A-Za-z]{2,10}(?![A-Za-z])")
_PERSON = re.compile(r"(?<![A-Za-z])(?:" + "|".join(map(re.escape, _TITLES)) + r")\.? ([A-ZÀ-Ý][a-zà-ÿ]{1,20}(?: [A-ZÀ-Ý][a-zà-ÿ]{1,20}){0,2})")
_STREET = re.compile(r"(?<![0-9A-Za-z])[0-9]{1,5} (?:[A-ZÀ-Ý][a-zà-ÿß]{1,20} ){1,3}(?:Street|Road|Avenue|Lane|Drive|Boulevard|Square)(?![a-z])")


def loose_spans(text: str, base: list[Span]) -> list[Span]:
    """Candidates beyond the base patterns; none overlaps a base span or an earlier candidate."""
    found: list[Span] = []
    if _DIGIT.search(text):
        found += [("phone", *m.span()) for m in _LOOSE_PHONE.finditer(text)]
        if "-" in text:
            found += [("identity", *m.span()) for m in _IDENTITY.finditer(text)]
        found += [("address", *m.span()) for m in _STREET.finditer(text)]
    if "[at]" in text or "(at)" in text:
        found += [("email", *m.span()) for m in _WRITTEN.finditer(text)]
    if any(t in text for t in _TITLES):
        found += [("person", *m.span(1)) for m in _PERSON.finditer(text)]
    taken, out = [(s, e) for _, s, e in base], []
    if not found:
        return out
    starts = sorted(taken)
    for kind, s, e in sorted(found, key=lambda x: (x[1], KINDS.index(x[0]))):
        i = np.searchsorted([a for a, _ in starts], e) if starts else 0
        if any(b > s for _, b in starts[max(0, i - 2) : i]) or (out and out[-1][2] > s):
            continue
        out.append((kind, s, e))
    return out


def votes(text: str, span: Span) -> tuple[int, ...]:
    """One vote (1, -1, or 0 for none) of each labeler."""
    kind, s, e = span
    body = text[s:e]
    before = text[max(0, s - 40) : s].lower()
    digits = _digits(body)
    words = [w.strip(".,()").lower() for w in body.split()]
    if kind == "email":
        strict, rule = (1 if "@" in body else -1), (1 if 2 <= len(re.split(r"[.\])]", body)[-1].strip()) <= 10 else -1)
    elif kind == "ip":
        strict, rule = (-1 if body.startswith("0") else 1), (1 if all(map(_octet, body.split("."))) else -1)
    elif kind == "card":
        strict, rule = (1 if digits[:1] in "3456" else -1), (1 if 14 <= len(digits) <= 19 and luhn(digits) else -1)
    elif kind == "phone":
        strict, rule = (1 if body.startswith(("+", "(")) else 0), (1 if 10 <= len(digits) <= 15 and len(set(digits)) > 2 else -1)
    elif kind == "identity":
        strict, rule = 1, (-1 if digits[:3] in ("000", "666") or digits[0] == "9" else 1)
    elif kind == "person":
        strict, rule = (1 if len(words) >= 2 else 0), (-1 if len(words) == 1 else 0)
    else:
        strict, rule = 1, (1 if len(digits) <= 4 else -1)
    names = 1 if any(w in _NAMES for w in words) else (-1 if kind == "person" else 0)
    places = 1 if any(w in _PLACES for w in words) else (-1 if kind == "address" else 0)
    cue = 1 if any(re.search(rf"(?<![a-z]){re.escape(c)}", before) for c in _CUES[kind]) else 0
    denial = -1 if any(d in before for d in _DENIALS) else 0
    return strict, rule, names, places, cue, denial


def shape(text: str, span: Span) -> tuple[int, int, int]:
    """Kind, share of digits in quarters, length class: what the classifier sees besides votes."""
    kind, s, e = span
    body = text[s:e]
    return KINDS.index(kind), min(3, 4 * len(_digits(body)) // len(body)), min(3, len(body) // 10)


_CODES = "kind int, digits int, length int, " + ", ".join(f"v{i} int" for i in range(len(LABELERS)))


def _count_votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _CODES.split(", ")]
    for batch in batches:
        seen: Counter = Counter()
        for text in batch.column("text").to_pylist():
            base = base_spans(text or "")
            for span in [*base, *loose_spans(text or "", base), *failed_spans(text or "")]:
                seen[(*shape(text, span), *votes(text, span))] += 1
        rows = np.array(list(seen), dtype=np.int32).reshape(len(seen), len(names))
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(rows[:, i]) for i in range(len(names))), pa.array(list(seen.values()), pa.int64())], names=[*names, "n"]
        )


def reliabilities(ballots: np.ndarray, n: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """EM over vote counts: chance of each vote given true and false spans, and each pattern's probability.

    Starts from a majority vote; every estimate is smoothed by one pseudo-vote per outcome.
    """
    p = 1 / (1 + np.exp(-2.0 * ballots.sum(axis=1)))
    table = np.zeros((2, ballots.shape[1], 3))
    for _ in range(rounds):
        for side, w in enumerate((1 - p, p)):
            for v in (-1, 0, 1):
                table[side, :, v + 1] = ((ballots == v) * (w * n)[:, None]).sum(axis=0) + 1
        table /= table.sum(axis=2, keepdims=True)
        prior = ((p * n).sum() + 1) / (n.sum() + 2)
        each = np.log(table)[:, np.arange(ballots.shape[1])[None, :], ballots + 1].sum(axis=2)
        odds = each[1] - each[0] + np.log(prior / (1 - prior))
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(new - p).max() < 1e-9:
            break
        p = new
    return table, p


def _features(codes: np.ndarray) -> np.ndarray:
    kind, digits, length, ballots = codes[:, 0], codes[:, 1], codes[:, 2], codes[:, 3:]
    hot = [(kind[:, None] == np.arange(len(KINDS))), (digits[:, None] == np.arange(4)), (length[:, None] == np.arange(4))]
    return np.concatenate([np.ones((len(codes), 1)), *hot, ballots > 0, ballots < 0], axis=1).astype(float)


def fit_classifier(codes: np.ndarray, n: np.ndarray, p: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression on soft labels, by Newton's method."""
    x = _features(codes)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (q - p)) + ridge * w
        hess = (x * (n * q * (1 - q) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return np.round(w, 9)


def train(docs: DataFrame) -> np.ndarray:
    """Weights from the votes on every candidate span of every text."""
    counted = docs.select("text").mapInArrow(_count_votes, f"{_CODES}, n bigint")
    names = [x.split()[0] for x in _CODES.split(", ")]
    rows = sorted(tuple(r) for r in counted.groupBy(*names).agg(F.sum("n").alias("n")).collect())
    if not rows:
        return np.zeros(_features(np.zeros((1, len(names)), int)).shape[1])
    table = np.array(rows, dtype=np.int64)
    codes, n = table[:, :-1], table[:, -1].astype(float)
    _, p = reliabilities(codes[:, 3:], n)
    return fit_classifier(codes, n, p)


def all_spans(text: str, weights: np.ndarray) -> tuple[list[Span], list[Span]]:
    """Base spans, and these with the accepted further ones."""
    base = base_spans(text)
    loose = loose_spans(text, base)
    if loose:
        codes = np.array([(*shape(text, s), *votes(text, s)) for s in loose])
        sure = 1 / (1 + np.exp(-np.clip(_features(codes) @ weights, -30, 30))) > ACCEPT
        loose = [s for s, ok in zip(loose, sure, strict=True) if ok]
    return base, sorted([*base, *loose], key=lambda s: (s[1], KINDS.index(s[0])))


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redact(text: str, spans: list[Span]) -> str:
    """The text with every span, overlapping ones together, replaced by its kind in brackets."""
    out, at, end = [], 0, -1
    for kind, s, e in spans:
        if s >= end:
            out += [text[at if end < 0 else end : s], f"[{kind.upper()}]"]
        end = max(end, e)
    return "".join(out) + text[max(end, 0) :]


def _find(batches: Iterator[pa.RecordBatch], weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = {k: [] for k in BASE}
        hashes, listed = [], []
        for text in batch.column("text").to_pylist():
            base, every = all_spans(text or "", weights)
            per = Counter(k for k, *_ in base)
            for k in BASE:
                counts[k].append(per[k])
            hashes.append(hashlib.sha256(written(base).encode()).hexdigest())
            listed.append(written(every))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(counts[k], pa.int64()) for k in BASE), pa.array(hashes, pa.string()), pa.array(listed, pa.string())],
            names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"],
        )


def find_pii(docs: DataFrame) -> DataFrame:
    """Counts and spans for every row of ``docs`` (``doc_id``, ``text``).

    A null text is empty and has no spans; repeated rows get the same answer each; other columns are
    ignored; an empty table gives an empty result.
    """
    weights = train(docs)
    schema = "doc_id bigint, " + ", ".join(f"n_{k} bigint" for k in BASE) + ", base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(partial(_find, weights=weights), schema)


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with redacted ``text`` (null stays null) and ``n_chars``, if there, counted anew; rows and columns as before."""
    weights = train(docs)

    @F.arrow_udf("string")
    def clean(text: pa.Array) -> pa.Array:
        parts = [pa.array([None if t is None else redact(t, all_spans(t, weights)[1]) for t in part.column("text").to_pylist()], pa.string())
                 for part in slices(iter([pa.RecordBatch.from_arrays([text], names=["text"])]))]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    out = docs.withColumn("text", clean(docs["text"]))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
