"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds a bounded text of its labelled documents. A text is parsed greedily into phrases,
each the longest match at its place; the language whose automaton needs the fewest phrases, normalised to bits a byte, wins.
Texts are cut into blocks that are parsed side by side, one numpy step for a byte of all blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import slices

#: Bounds of the sample that a language is learned from: documents, and bytes of them (after `normalised`) in all.
TRAIN_DOCS, TRAIN_BYTES = 40, 40_000
#: Rows up to so many characters are sampled before longer ones. All are learned whole.
TRAIN_DOC_CHARS = 3_000
#: More values of the label column than this are taken for something else than languages: an error.
MOST_LANGUAGES = 10_000
#: Bytes of a text that are parsed as one; a phrase ends where its block ends.
BLOCK = 512
UNKNOWN = "und"
#: A text is foreign to all languages known if its best parse costs so many bits more than its plain bytes do.
FOREIGN_BITS = 64.0

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point: is it a letter?"""
    global _letters
    if _letters is None:
        _letters = np.array([chr(i).isalpha() for i in range(0x110000)])
    return _letters


def normalised(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in lower case with one space for each run of non-letters; how many bytes each text has.

    A text without letters has none; others start with their first letter and end with a space.
    """
    joined = "".join(f"{x.lower()}\n" for x in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter((len(x.lower()) + 1 for x in texts), np.int64, len(texts))
    letter = letters()[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    codes = np.where(letter, codes, 32)[keep].astype(np.uint32)
    width = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
    at = np.r_[0, np.cumsum(keep)][np.r_[0, np.cumsum(size)]]
    total = np.r_[0, np.cumsum(width)][at]
    return np.frombuffer(codes.tobytes().decode("utf-32-le", "replace").encode(), np.uint8), np.diff(total)


class SuffixAutomaton:
    """Transitions of the suffix automaton of some bytes, over symbols 0 .. width - 1.

    next[state * width + symbol] is the next state times width, or -1. root[symbol] is the state after a phrase begins with
    symbol: `dead`, which nothing goes on from, where the text lacks it.
    """

    def __init__(self, data: bytes, symbol: np.ndarray, width: int):
        moves: list[dict[int, int]] = [{}]
        length, link, last = [0], [-1], 0
        for c in symbol[np.frombuffer(data, np.uint8)].tolist():
            new = len(moves)
            moves.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in moves[p]:
                moves[p][c] = new
                p = link[p]
            if p >= 0:
                q = moves[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    clone = len(moves)
                    moves.append(dict(moves[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and moves[p].get(c) == q:
                        moves[p][c] = clone
                        p = link[p]
                    link[q] = link[new] = clone
            last = new
        self.next = np.full((len(moves) + 1) * width, -1, np.int32)
        for state, out in enumerate(moves):
            for c, to in out.items():
                self.next[state * width + c] = to * width
        self.dead = len(moves) * width
        self.root = np.where(self.next[:width] < 0, self.dead, self.next[:width]).astype(np.int32)
        self.bits = float(np.log2(max(len(data), 2)))


_built: dict[str, list[SuffixAutomaton]] = {}


@dataclass
class LanguageModel:
    """Learned bytes by language. Only these are sent to workers; a worker builds the automata when it first needs them."""

    languages: list[str]
    symbol: np.ndarray
    texts: list[bytes]

    @property
    def automata(self) -> list[SuffixAutomaton]:
        key = hashlib.sha256(b"\x00".join([x.encode() for x in self.languages] + self.texts)).hexdigest()
        if key not in _built:
            _built.clear()
            _built[key] = [SuffixAutomaton(x, self.symbol, int(self.symbol.max()) + 1) for x in self.texts]
        return _built[key]

    def phrases(self, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Phrases of each text (row) by each language (column)."""
        automata, symbols, blocks = self.automata, self.symbol[data], -(-sizes // BLOCK)
        of = np.repeat(np.arange(len(sizes)), blocks)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = (np.cumsum(sizes) - sizes)[of] + nth * BLOCK
        size = np.minimum(sizes[of] - nth * BLOCK, BLOCK)
        order = np.argsort(-size, kind="stable")
        start, size, of = start[order], size[order], of[order]
        live = len(size) - np.searchsorted(size[::-1], np.arange(BLOCK), side="right")
        state = np.repeat(np.array([[a.dead] for a in automata], np.int32), len(size), 1) if automata else np.zeros((0, len(size)), np.int32)
        count = np.zeros((len(automata), len(size)), np.int32)
        for j in range(int(size[0]) if len(size) else 0):
            m = live[j]
            c = symbols[start[:m] + j]
            for k, a in enumerate(automata):
                to = a.next[state[k, :m] + c]
                ended = to < 0
                count[k, :m] += ended
                state[k, :m] = np.where(ended, a.root[c], to)
        return np.stack([np.bincount(of, weights=x, minlength=len(sizes)) for x in count], 1) if len(count) else np.zeros((len(sizes), 0))

    def predict(self, texts: list[str]) -> tuple[list[str], list[float], list[float], list[float]]:
        """Language, score, bits a byte, and bits beyond 8 a byte in all of each text. Score: runner-up bits / (best + runner-up bits); ties go to the first
        name. Without letters, or if no language is known, there is no language, and bits are 0."""
        data, sizes = normalised(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        rate = self.phrases(data, sizes) * np.array([a.bits for a in self.automata]) / np.maximum(sizes, 1)[:, None]
        best = rate.argmin(1)
        low = rate.min(1)
        rest = np.where(np.arange(rate.shape[1]) == best[:, None], np.inf, rate).min(1) if rate.shape[1] > 1 else np.full(len(low), np.inf)
        score = np.where(np.isinf(rest), 1.0, rest / np.maximum(low + rest, 1e-12))
        return [self.languages[b] if n else UNKNOWN for b, n in zip(best, sizes, strict=True)], [float(s) if n else 0.0 for s, n in zip(score, sizes, strict=True)], low.tolist(), ((low - 8) * sizes).tolist()


def fit(labelled: dict[str, list[str]], train_bytes: int = TRAIN_BYTES) -> LanguageModel:
    """A model of the given texts by language: of each, whole texts in order while they sum to train_bytes bytes at most, the
    first in any case. Languages without letters go."""
    texts = {}
    for lang in sorted(labelled):
        data, sizes = normalised(labelled[lang])
        total = np.cumsum(sizes)
        n = max(int(np.searchsorted(total, train_bytes, side="right")), int(np.searchsorted(total, 0, side="right")) + 1)
        if len(data):
            texts[lang] = data[: total[min(n, len(total)) - 1]].tobytes()
    used = sorted(set().union(*texts.values())) if texts else []
    symbol = np.full(256, len(used), np.uint8 if len(used) < 255 else np.int16)
    symbol[used] = np.arange(len(used))
    return LanguageModel(list(texts), symbol, list(texts.values()))


def training_rows(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, list[str]]:
    """A bounded sample of labelled rows: of every language TRAIN_DOCS documents, those with the lowest hashes of their ids
    among the ones of up to TRAIN_DOC_CHARS characters, then among longer ones (see there). Hashes above a threshold by
    language and kind are dropped before rows are ranked, so no task ranks all rows of a language."""
    rows = docs.where(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), (F.length(text_col) > TRAIN_DOC_CHARS).cast("int").alias("long"), F.col(id_col).alias("id"))
    counts = rows.groupBy("lang", "long").count().limit(2 * MOST_LANGUAGES + 1).collect()
    if len({r["lang"] for r in counts}) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not counts:
        return {}
    share = docs.sparkSession.createDataFrame([(r["lang"], r["long"], min(1.0, (4.0 * TRAIN_DOCS + 20.0) / r["count"])) for r in counts], "lang string, long int, share double")  # at most two rows a language
    few = rows.join(F.broadcast(share), ["lang", "long"]).withColumn("h", F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)).where("h < share")
    few = few.select("lang", "long", "h", "id", "text")
    order = Window.partitionBy("lang").orderBy("long", "h", "id", "text")
    out: dict[str, list[str]] = {}
    for r in few.withColumn("n", F.row_number().over(order)).where(F.col("n") <= TRAIN_DOCS).orderBy("lang", "n").select("lang", "text").collect():
        out.setdefault(r["lang"], []).append(r["text"])
    return out


def language_id(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """doc_id, lang_pred, score, bits (a byte, of the language predicted) and foreign of every row, with the columns in keep
    carried along. foreign: the best parse costs FOREIGN_BITS more than 8 bits a byte, so no language known helps with the text.

    A null text or one without letters is `und` with score 0, 0 bits and not foreign, as is every text if the model knows no language.
    Repeated rows are predicted each; ties go to the language whose name comes first; an empty table gives no rows; other
    columns play no part. Very long texts are parsed whole, in blocks of BLOCK bytes, a few of which are held at once.
    """
    keep = keep or []
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from judged(batches)
        finally:
            _built.clear()  # workers outlive the task, and other operators want the memory

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            for a, b in slices(texts, 1_000_000):
                lang, score, bits, beyond = shared.value.predict(texts[a:b])
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in ["doc_id", *keep]), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64()), pa.array([x > FOREIGN_BITS for x in beyond])], ["doc_id", *keep, "lang_pred", "score", "bits", "foreign"])

    rows = docs.select(F.col(id_col).alias("doc_id"), *{text_col: 0, **dict.fromkeys(keep)})
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in ["doc_id", *keep]), "lang_pred string", "score double", "bits double", "foreign boolean"]))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op8_language_id(docs: DataFrame) -> DataFrame:
    """Learns from labelled documents that aren't held out, predicts all: doc_id, held_out, lang_pred, score. Nulls, empty and very
    long texts, ties and repeated rows as in language_id(); a null id is not held out; an empty table gives no rows."""
    model = fit(training_rows(docs, ~held_out(F.col("doc_id"))))
    return language_id(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
