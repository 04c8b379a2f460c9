"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

Symbols of all words of a batch lie in one flat array. A round finds every adjacent pair's rank by binary search over the
sorted pair keys, takes each word's lowest rank, merges all occurrences of that pair in all words at once and sets words
without pairs aside. A bounded cache of text pieces keeps frequent words from being merged again.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import slices

#: Pieces (text between spaces) kept in a worker's cache; when there are more, it starts anew.
CACHE_PIECES = 300_000
#: Pieces longer than this many characters are merged each time rather than cached.
CACHE_CHARS = 64

# Fixed value: the pattern that splits text into words before merging, as published with this kind of tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_NONE = np.iinfo(np.int64).max


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself, or the next one from U+0100."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of the ranges [start, start + length)."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class _Pieces(dict):
    """Piece -> number; a piece not seen gets the next number and waits in `new`."""

    def __init__(self, pending: list, prefix: str):
        super().__init__()
        self.pending, self.prefix = pending, prefix

    def __missing__(self, piece: str) -> int:
        n = len(self.pending)
        self.pending.append(self.prefix + piece)
        self[piece] = n
        return n


class ByteBPE:
    """A byte-level BPE tokenizer file (JSON), given as its bytes."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        if spec.get("normalizer") or spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("not a byte-level BPE tokenizer without normalizer and prefix space")
        vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in spec["added_tokens"]):
            raise ValueError("added tokens with options aren't supported")
        tokens = {i: bytes(alphabet[c] for c in t) for t, i in vocab.items()} | {i: t.encode() for t, i in added.items()}
        parts = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.token_bytes = np.frombuffer(b"".join(parts), np.uint8)
        self.token_len = np.array([len(x) for x in parts], np.int64)
        self.token_start = np.cumsum(self.token_len) - self.token_len
        self.byte_id = np.zeros(256, np.int64)
        for c, b in alphabet.items():
            self.byte_id[b] = vocab[c]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)[order]
        self.words = regex.compile(PATTERN)
        self.special = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.added = added
        self.tight = re.compile(r"\s\s")
        self._forget()

    def _forget(self) -> None:
        self.pending: list[str] = []
        self.inner, self.first = _Pieces(self.pending, " "), _Pieces(self.pending, "")
        self.start, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair and the id it merges to; pairs that don't merge get _NONE."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], _NONE), self.merged[at]

    def merge(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges symbols (ids of bytes) of many words; word: the number of each symbol's word, ascending. Same shape out.

        rank[i] and into[i] belong to the pair (i, i + 1); a round looks up anew only pairs beside what it merged.
        """
        out: list[tuple[np.ndarray, np.ndarray]] = []
        symbols, rank, into = symbols.copy(), np.full(len(symbols), _NONE), np.zeros(len(symbols), np.int64)

        def look(i: np.ndarray) -> None:
            rank[i] = _NONE
            i = i[i < len(word) - 1]
            i = i[word[i] == word[i + 1]]
            rank[i], into[i] = self._ranks(symbols[i], symbols[i + 1])

        look(np.arange(len(symbols)))
        while n := len(symbols):
            head = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.repeat(np.minimum.reduceat(rank, head), np.diff(np.r_[head, n]))
            over = best == _NONE
            hits = np.flatnonzero((rank == best) & ~over)
            # overlapping occurrences (x x x): the first, third, ... of a run are merged
            place = np.arange(len(hits))
            fresh = np.r_[True, np.diff(hits) != 1][: len(hits)]
            hits = hits[(place - np.maximum.accumulate(np.where(fresh, place, 0))) % 2 == 0]
            symbols[hits] = into[hits]
            keep = np.ones(n, bool)
            keep[hits + 1] = False
            if over.any():
                out.append((symbols[over], word[over]))
                keep &= ~over
            new = np.cumsum(keep) - 1
            symbols, word, rank, into = symbols[keep], word[keep], rank[keep], into[keep]
            at = new[hits]
            look(np.concatenate([at, at[at > 0] - 1]))
        if not out:
            return symbols, word
        ids, of = np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])
        order = np.argsort(of, kind="stable")
        return ids[order], of[order]

    def encode_strings(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all strings, one after the other, and how many each has. Added tokens are not looked for."""
        found = [self.words.findall(s) for s in strings]
        per = np.array([len(x) for x in found], np.int64)
        words = [w.encode() for x in found for w in x]
        size = np.array([len(w) for w in words], np.int64)
        symbols = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        ids, word = self.merge(symbols, np.repeat(np.arange(len(words)), size))
        owner = np.repeat(np.arange(len(strings)), per)
        return ids.astype(np.int32), np.bincount(owner[word], minlength=len(strings)) if len(words) else np.zeros(len(strings), np.int64)

    def _known(self) -> None:
        """Encodes the pieces that wait."""
        if new := self.pending[len(self.start) :]:
            ids, count = self.encode_strings(new)
            self.start = np.r_[self.start, len(self.ids) + np.cumsum(count) - count]
            self.count, self.ids = np.r_[self.count, count], np.r_[self.ids, ids]

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts without added tokens. Where no two white-space characters meet, words don't cross single spaces."""
        if len(self.pending) > CACHE_PIECES:
            self._forget()
        parts: list[np.ndarray | None] = []
        whole: list[int] = []
        for i, x in enumerate(texts):
            pieces = x.split(" ")
            if "" in pieces or self.tight.search(x) or len(x) > CACHE_CHARS * len(pieces):
                whole.append(i)
                parts.append(None)
            else:
                inner = np.fromiter(map(self.inner.__getitem__, pieces), np.int64, len(pieces))
                inner[0] = self.first[pieces[0]]
                parts.append(inner)
        self._known()
        slow = dict(zip(whole, np.split(*self._cut([texts[i] for i in whole])), strict=True)) if whole else {}
        return [slow[i] if p is None else self.ids[_ranges(self.start[p], self.count[p])] for i, p in enumerate(parts)]

    def _cut(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, count = self.encode_strings(texts)
        return ids, np.cumsum(count)[:-1]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids (int32) of each text, as the published library gives with its added tokens recognised in the text."""
        if not self.special:
            return self._plain(texts)
        flat: list[str] = []
        plan = []
        for x in texts:
            cut = self.special.split(x) if any(t in x for t in self.added) else [x]
            plan.append(cut)
            flat += [s for s in cut if s and s not in self.added]
        ids = iter(self._plain(flat))
        return [np.concatenate([np.zeros(0, np.int32), *(np.array([self.added[s]], np.int32) if s in self.added else next(ids) for s in cut if s)]) if len(cut) > 1 or not cut[0] else next(ids) for cut in plan]

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return self.token_bytes[_ranges(self.token_start[ids], self.token_len[ids])].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; bytes that are no UTF-8 become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


_loaded: dict[str, ByteBPE] = {}


def tokenizer(shared: Broadcast) -> ByteBPE:
    """This worker's tokenizer for the broadcast bytes of its file."""
    raw = shared.value
    key = hashlib.sha256(raw).hexdigest()
    if key not in _loaded:
        _loaded[key] = ByteBPE(raw)
    return _loaded[key]


def share(docs: DataFrame, path: str) -> Broadcast:
    """The tokenizer's file (a few MB, whatever the input) to all executors."""
    with open(path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encoded(batch: pa.RecordBatch, bpe: ByteBPE) -> Iterator[tuple[list, list[str], list[np.ndarray]]]:
    """(ids of rows, texts, token ids) of a batch of (doc_id, text), in runs of bounded size."""
    doc_ids, texts = batch.column(0).to_pylist(), [x or "" for x in batch.column(1).to_pylist()]
    for a, b in slices(texts):
        yield doc_ids[a:b], texts[a:b], bpe.encode(texts[a:b])


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every row. A null text counts as empty and has no ids; rows are independent, so repeated
    rows give repeated results, and an empty table none. Other columns play no part."""
    shared = share(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(shared)
        for batch in batches:
            for doc_ids, _, ids in encoded(batch, bpe):
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "doc_id long, ids array<int>")


def bpe_decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of every row of ids; null ids give a null text."""
    shared = share(rows, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(shared)
        for batch in batches:
            texts = [None if x is None else bpe.decode(np.array(x, np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), ids_col).mapInArrow(run, "doc_id long, text string")


def bpe_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encodes and decodes every text in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256, round_trip; with_ids adds
    ids (array<int>).

    Nulls, empty texts and repeated rows as in bpe_encode.
    """
    shared = share(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(shared)
        number = [str(i) for i in range(len(bpe.token_len))]
        for batch in batches:
            for doc_ids, texts, ids in encoded(batch, bpe):
                back = [bpe.decode(x).encode() for x in ids]
                out = {
                    "doc_id": pa.array(doc_ids, pa.int64()), "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(",".join(map(number.__getitem__, x.tolist())).encode()).hexdigest() for x in ids]),
                    "decoded_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in back]), "round_trip": pa.array([x == t.encode() for x, t in zip(back, texts, strict=True)]),
                }
                if with_ids:
                    out["ids"] = pa.array(ids, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, schema)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed public tokenizers are."""
    import public_tokenizers

    return public_tokenizers.path(name)
