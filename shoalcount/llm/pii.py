"""Personal data: fixed patterns, and a skip-chain conditional random field that adds to them.

Nodes of the field are mentions: what the patterns found (their labels are observed), and
look-alikes (tokens with an @, runs of seven or more digits) whose label is open. Neighbours
in a document are linked in a chain; equal or similar mentions are linked however far apart
and share a potential. Loopy belief propagation gives each open mention its label; it becomes
a span if one kind is nearly certain. Potentials are ratios of counts over the corpus, so
copies of the corpus leave them as they are. Open mentions are unlabelled: one that shares its
key with found mentions of one kind is counted as that kind, others as none of the kinds.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The kinds, in the order in which spans that start together are listed.
KINDS = ("email", "ip", "card", "phone")
LABELS = (*KINDS, "O")

#: Belief above which an open mention becomes a span; rounds of message passing at most.
CERTAIN, ROUNDS = 0.9, 30

#: Share of a shape's distribution that comes from found mentions with like features; least
#: rate at which mentions with the same key are taken to differ. Neither depends on corpus size.
PRIOR, LEAST_CONFLICT = 0.02, 1e-4

# Possessive and anchored forms of the fixed patterns: the same matches in linear time.
_domain = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_ip = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_card = re.compile(r"[0-9](?:[ -]?[0-9])++")
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_number = re.compile(r"[+(]?[0-9](?:[ .()-]{0,3}[0-9])++")
_digit = re.compile(r"[0-9]")
_blank = frozenset(" \t\n\r\x0b\x0c")


class Mention(NamedTuple):
    start: int
    end: int
    label: str  # a kind if a pattern found it, else "O" (open)
    shape: str
    key: str


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join([c for c in text if "0" <= c <= "9"])


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _local:
            start -= 1
        found = _domain.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start, then kind as listed."""
    out = [(a, b, "email") for a, b in _emails(text)] if "@" in text else []
    if _digit.search(text):
        for m in _ip.finditer(text):
            parts = [p.lstrip("0") for p in m.group().split(".")]
            if all(len(p) < 4 and int(p or 0) <= 255 for p in parts):
                out.append((*m.span(), "ip"))
        for m in _card.finditer(text):
            d = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((*m.span(), "card"))
        if "+" in text:
            for m in _phone.finditer(text):
                if 9 <= len(_digits(m.group())) <= 15:
                    out.append((*m.span(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def _look(text: str) -> tuple[str, str]:
    """Shape (what potentials go by) and key (what similar mentions share) of a mention."""
    if "@" in text:
        local, _, domain = text.partition("@")
        return f"at{int(bool(local))}{int('.' in domain)}", "@" + local.lower() if len(local) > 2 else ""
    d = _digits(text)
    groups = len(re.findall(r"[0-9]+", text))
    check = int(luhn(d)) if 12 <= len(d) <= 19 else 2
    return f"n{min(len(d), 20)}g{min(groups, 6)}p{int('+' in text)}c{check}d{int(text.count('.') == 3)}", d[-9:] if len(d) >= 7 else ""


def mentions(text: str, base: list[tuple[int, int, str]]) -> list[Mention]:
    """The nodes of a document, by start. Open ones overlap no found span and no other node."""
    out = [Mention(a, b, kind, *_look(text[a:b])) for a, b, kind in base]
    taken = [(a, b) for a, b, _ in base]
    more: list[tuple[int, int]] = []
    at = text.find("@")
    while at >= 0:
        a = at
        while a > 0 and text[a - 1] not in _blank and text[a - 1] != "@":
            a -= 1
        b = at + 1
        while b < len(text) and text[b] not in _blank and text[b] != "@":
            b += 1
        more.append((a, a + len(text[a:b].rstrip(".,;:!?)'\""))))
        at = text.find("@", b)
    more += [m.span() for m in _number.finditer(text) if len(_digits(m.group())) >= 7]
    edge, i = 0, 0
    taken.sort()
    for a, b in sorted(more):
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if a >= edge and a < b and (i == len(taken) or taken[i][0] >= b):
            out.append(Mention(a, b, "O", *_look(text[a:b])))
            edge = b
    return sorted(out, key=lambda m: (m.start, m.end))


def skip_links(nodes: list[Mention]) -> list[tuple[int, int]]:
    """Each mention and the next one with the same key."""
    last: dict[str, int] = {}
    out = []
    for i, m in enumerate(nodes):
        if m.key:
            if m.key in last:
                out.append((last[m.key], i))
            last[m.key] = i
    return out


def _features(shape: str) -> str:
    """What the variants of a kind share: groups and + are left out, for addresses all but the @."""
    return "at" if shape.startswith("at") else re.sub(r"g[0-9]+p[01]", "", shape)


def expected_labels(nodes: list[Mention]) -> list[str]:
    """Found labels; an open mention takes the kind of the found ones with its key, if they are of one kind."""
    kinds: dict[str, set[str]] = {}
    for m in nodes:
        if m.key and m.label != "O":
            kinds.setdefault(m.key, set()).add(m.label)
    return [next(iter(kinds[m.key])) if m.label == "O" and len(kinds.get(m.key, ())) == 1 else m.label for m in nodes]


class Field(NamedTuple):
    """Log potentials: by shape and label, by labels of neighbours, for equal labels across a skip link."""

    shapes: dict[str, np.ndarray]
    unseen: np.ndarray
    chain: np.ndarray
    skip: float

    def beliefs(self, nodes: list[Mention]) -> np.ndarray:
        """Marginals per node and label by loopy belief propagation; found mentions are clamped."""
        n = len(LABELS)
        unary = np.array([self.shapes.get(m.shape, self.unseen) if m.label == "O" else np.where(np.arange(n) == LABELS.index(m.label), 0.0, -50.0) for m in nodes])
        same = np.eye(n) * self.skip
        links = [(i, i + 1, self.chain) for i in range(len(nodes) - 1)] + [(i, j, same) for i, j in skip_links(nodes)]
        links += [(j, i, p.T) for i, j, p in links]
        half = len(links) // 2
        if not links:
            return _softmax(unary)
        a, b, pair = np.array([x[0] for x in links]), np.array([x[1] for x in links]), np.array([x[2] for x in links])
        back = np.concatenate([np.arange(half, 2 * half), np.arange(half)])
        sent = np.zeros((2 * half, n))
        for _ in range(ROUNDS):
            total = unary.copy()
            np.add.at(total, b, sent)
            inner = total[a] - sent[back]
            new = _log_sum(inner[:, :, None] + pair)
            new -= _log_sum(new[:, :, None])
            new = 0.5 * (new + sent)
            change = np.abs(new - sent).max()
            sent = new
            if change < 1e-6:
                break
        total = unary.copy()
        np.add.at(total, b, sent)
        return _softmax(total)

    def added(self, nodes: list[Mention]) -> list[tuple[int, int, str]]:
        """Spans of open mentions whose label is nearly certain. Without open mentions there are none."""
        if all(m.label != "O" for m in nodes):
            return []
        beliefs = self.beliefs(nodes)
        best = beliefs.argmax(axis=1)
        return [(m.start, m.end, LABELS[k]) for m, k, p in zip(nodes, best, beliefs) if m.label == "O" and LABELS[k] != "O" and p[k] >= CERTAIN]


def _log_sum(x: np.ndarray) -> np.ndarray:
    most = x.max(axis=1, keepdims=True)
    return (most + np.log(np.exp(x - most).sum(axis=1, keepdims=True)))[:, 0]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts (what, n): features of found mentions, shapes of open ones, neighbours, links between found mentions."""
    for batch in batches:
        seen: Counter[str] = Counter()
        for value in batch.column("text"):
            text = value.as_py() or ""
            nodes = mentions(text, base_spans(text))
            labels = expected_labels(nodes)
            seen.update(f"open|{m.shape}|{k}" if m.label == "O" else f"found|{_features(m.shape)}|{k}" for m, k in zip(nodes, labels))
            seen.update(f"chain|{x}|{y}" for x, y in zip(labels, labels[1:]))
            seen.update("skip|same" if nodes[i].label == nodes[j].label else "skip|other" for i, j in skip_links(nodes) if "O" not in (nodes[i].label, nodes[j].label))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["what", "n"])


def train(docs: DataFrame) -> Field:
    """Potentials from counts over all texts. Shapes are few by construction (under 2,000)."""
    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_observe, "what string, n bigint").groupBy("what").agg(F.sum("n").alias("n"))
    counts = {r["what"]: r["n"] for r in counted.collect()}
    opened: dict[str, np.ndarray] = {}
    found: dict[str, np.ndarray] = {}
    chain = np.zeros((len(LABELS), len(LABELS)))
    for what, n in counts.items():
        kind, *rest = what.split("|")
        if kind in ("open", "found"):
            (opened if kind == "open" else found).setdefault(rest[0], np.zeros(len(LABELS)))[LABELS.index(rest[1])] += n
        elif kind == "chain":
            chain[LABELS.index(rest[0]), LABELS.index(rest[1])] += n
    none = np.eye(len(LABELS))[-1]
    overall = sum(found.values(), np.zeros(len(LABELS)))

    def potential(c: np.ndarray, like: np.ndarray) -> np.ndarray:
        """Log shares of counts, mixed with the kinds of found mentions and as much of none."""
        shares = like / max(like.sum(), 1) + 1e-6
        return np.log((1 - PRIOR) * c / c.sum() + PRIOR / 2 * (shares / shares.sum() + none))

    shapes = {s: potential(c, found.get(_features(s), overall)) for s, c in opened.items()}
    expected = chain.sum(axis=1, keepdims=True) * chain.sum(axis=0, keepdims=True) / max(chain.sum(), 1)
    ratio = np.divide(chain, expected, out=np.ones_like(chain), where=expected > 0)
    same, other = counts.get("skip|same", 0), counts.get("skip|other", 0)
    conflict = max(LEAST_CONFLICT, other / (same + other)) if same else 0.5
    return Field(shapes, potential(none, overall), np.log((1 - PRIOR) * ratio + PRIOR), max(0.0, math.log((1 - conflict) / conflict) if conflict < 1 else 0.0))


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join([f"{kind}:{a}:{b}" for a, b, kind in spans])


def find(docs: DataFrame, field: Field) -> DataFrame:
    """One row per document: doc_id, n_<kind>, base_sha256, spans, and found as array of structs.

    Counts and digest are of the fixed patterns; ``spans`` and ``found`` (kind, start, end,
    text) hold what the field adds as well. Offsets are code points, ends exclusive. Null text
    counts as empty: no spans, the digest of nothing. Repeated rows stay, other columns are
    ignored, an empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column("text"):
                text = value.as_py() or ""
                base = base_spans(text)
                spans = sorted(base + held.value.added(mentions(text, base)), key=lambda s: (s[0], KINDS.index(s[2])))
                counts = Counter(kind for *_, kind in base)
                rows.append((*[counts[k] for k in KINDS], hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), [{"kind": k, "start": a, "end": b, "text": text[a:b]} for a, b, k in spans]))
            kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())]))]
            names = ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "found"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]], names=names)

    schema = "doc_id bigint, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string, found array<struct<kind: string, start: bigint, end: bigint, text: string>>"
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
