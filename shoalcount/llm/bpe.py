"""Byte-level BPE with a trie of distinct words.

A valid encoding is one whose neighbouring tokens stay as they are when encoded together, so
the encoding of a prefix is known from its last token alone: the token, and the encoding of
what stands before it. Each batch's distinct new words are walked in sorted order, which is a
depth-first traversal of their trie: a stack holds the last token of every prefix of the
current word, and the states of a shared prefix are computed once. Words met before in the same task are looked up.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pattern that cuts text into words before merging (letters first: the branches
#: begin with different characters, but for the contractions, which come before other signs).
PATTERN = (
    r" ?\p{L}++|'(?:s|t|re|ve|m|ll|d)| ?\p{N}++| ?[^\p{White_Space}\p{L}\p{N}]++"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)

#: Words held encoded at a time in one task; beyond it the table starts anew.
CACHE_WORDS = 150_000

#: Documents whose distinct new words go into one trie.
GROUP = 256


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte, as byte-level vocabularies write them."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Tokens, merges and special tokens of a byte-level tokenizer file."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        symbols = byte_symbols()
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.bytes_of = {i: bytes(symbols[c] for c in t) for t, i in data["model"]["vocab"].items() if t not in self.special}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.id_of = {b: i for i, b in self.bytes_of.items() if i not in self.special.values()}
        self.merge: dict[int, tuple[int, int]] = {}  # left id, right id -> rank, merged id
        for n, pair in enumerate(data["model"]["merges"]):
            a, b = (bytes(symbols[c] for c in x) for x in (pair if isinstance(pair, list) else pair.split(" ")))
            self.merge[self.id_of[a] << 20 | self.id_of[b]] = (n, self.id_of[a + b])
        # the tokens as a trie: node and byte -> node; the token that ends at a node, or -1
        self.step: dict[int, int] = {}
        self.ends = [-1]
        for token, i in self.id_of.items():
            node = 0
            for c in token:
                key = node << 8 | c
                node = self.step.get(key) or self.step.setdefault(key, len(self.ends))
                if node == len(self.ends):
                    self.ends.append(-1)
            self.ends[node] = i
        marks = "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))
        self.cut = regex.compile(f"({marks})") if marks else None
        self.apart: dict[int, bool] = {}

    def merged(self, word: bytes) -> list[int]:
        """The merges applied one by one, lowest rank first: for short strings."""
        parts, none = [self.id_of[word[i : i + 1]] for i in range(len(word))], (1 << 60, -1)
        while len(parts) > 1:
            ranked = [self.merge.get(a << 20 | b, none) for a, b in zip(parts, parts[1:])]
            best = min(ranked)
            if best is none:
                break
            at = ranked.index(best)
            parts[at : at + 2] = [best[1]]
        return parts

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens stay apart and whole side by side; left is -1 at the start of a word."""
        key = (left + 1) << 20 | right
        before = [left] if left >= 0 else []
        known = self.merged(b"".join([self.bytes_of[i] for i in (*before, right)])) == [*before, right]
        self.apart[key] = known
        return known


class WordTable:
    """Encodings of the words met so far: count of ids, ids as text, decoded bytes."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.rows = vocabulary, {}

    def add(self, words: Iterable[str]) -> None:
        """Encode words by one depth-first pass over their trie."""
        v, rows = self.vocabulary, self.rows
        step, ends, apart, names = v.step.get, v.ends, v.apart.get, v.bytes_of
        # per depth of the current word: its last token, and the tokens under way (start, node)
        before, last, under_way = b"", [-1], [[]]
        for word, name in sorted((w.encode(), w) for w in words):
            same = 0
            for x, y in zip(word, before):
                if x != y:
                    break
                same += 1
            del last[same + 1 :], under_way[same + 1 :]
            for at in range(same, len(word)):
                c = word[at]
                alive = [(start, n) for start, node in under_way[at] if (n := step(node << 8 | c))]
                alive.append((at, step(c)))
                under_way.append(alive)
                for start, node in alive:  # longest first
                    token = ends[node]
                    if token >= 0:
                        left = last[start]
                        ok = apart((left + 1) << 20 | token)
                        if ok or ok is None and v.fits(left, token):
                            last.append(token)
                            break
                else:
                    raise ValueError(f"no token ends at byte {at} of {word!r}")
            before = word
            ids, at = [], len(word)
            while at:
                token = last[at]
                ids.append(token)
                at -= len(names[token])
            ids.reverse()
            rows[name] = (len(ids), ",".join(map(str, ids)), b"".join([names[i] for i in ids]))


_loaded: dict[str, tuple[Vocabulary, WordTable]] = {}


def _table(spec: str) -> tuple[Vocabulary, WordTable]:
    """One vocabulary and word table per Python worker."""
    key = hashlib.md5(spec.encode()).hexdigest()
    if key not in _loaded:
        v = Vocabulary(spec)
        _loaded[key] = (v, WordTable(v))
    return _loaded[key]


_find = regex.compile(PATTERN).findall


def words_of(text: str, vocabulary: Vocabulary) -> list[str]:
    """The words of a text in order; strings of special tokens stand for themselves."""
    if vocabulary.cut and any(t in text for t in vocabulary.special):
        parts = vocabulary.cut.split(text)
        return [w for i, part in enumerate(parts) for w in ([part] if i % 2 else _find(part))]
    return _find(text)


def encode_texts(texts: list[str], vocabulary: Vocabulary, table: WordTable) -> Iterator[tuple[int, str, bytes]]:
    """Per text: number of ids, the ids joined by commas, and the bytes they decode to."""
    split = [words_of(t, vocabulary) for t in texts]
    rows = table.rows
    if len(rows) > CACHE_WORDS:
        rows.clear()
    new: set[str] = set()
    for words in split:
        new.update(words)
    new.difference_update(rows)
    for t in new & vocabulary.special.keys():
        rows[t] = (1, str(vocabulary.special[t]), t.encode())
    table.add(new - vocabulary.special.keys())
    for words in split:
        found = [rows[w] for w in words]
        yield sum([r[0] for r in found]), ",".join([r[1] for r in found]), b"".join([r[2] for r in found])


def _encoder(spec, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, table = _table(spec.value)
        sha = hashlib.sha256
        for b in batches:
            texts, rows = b.column("text"), []
            for at in range(0, len(texts), GROUP):
                for n, ids, raw in encode_texts([t.as_py() or "" for t in texts[at : at + GROUP]], vocabulary, table):
                    decoded = raw.decode("utf-8", "replace").encode()
                    rows.append((n, sha(ids.encode()).hexdigest(), sha(decoded).hexdigest(), [int(x) for x in ids.split(",") if x] if keep_ids else None))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())][: 3 + keep_ids]
            arrays = [b.column("doc_id"), *[pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(arrays)])

    return run


def encode(docs: DataFrame, tokenizer_file: str, keep_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids.

    Null text counts as empty: no tokens, the digests of nothing. The strings of special tokens
    inside a text become those tokens. Repeated rows stay; other columns are ignored. The
    tokenizer file is read on the driver and broadcast (1 to 2 MB).
    """
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return rows.mapInArrow(_encoder(spec, keep_ids), schema)


def decode_ids(ids: Iterable[int], vocabulary: Vocabulary) -> str:
    """The text of a sequence of ids, special tokens included."""
    return b"".join([vocabulary.bytes_of[i] for i in ids]).decode("utf-8", "replace")


def production_file() -> str:
    """The 50k byte-level vocabulary where the box keeps public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


__all__ = ["Vocabulary", "WordTable", "decode_ids", "encode", "encode_texts", "production_file"]
