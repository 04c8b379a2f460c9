"""Personal data in texts: fixed patterns, and a span classifier trained by the votes of weak labelers.

One pass over texts finds, for each kind, the spans of the fixed patterns (`base`; they always stay) and looser candidates:
spelled-out addresses, numbers without a plus sign, other separators, and what the patterns matched but their checks refused.
Six labelers, of regular expressions, gazetteers and context, vote yes, no or nothing on each. Counts of vote patterns over all
candidates of all documents, a table of a fixed size, go through expectation-maximisation, which estimates how often a labeler
is right on spans that are personal data and on those that aren't; base spans count as known to be, and what a check refused as
known not to be (a card number without its check digit isn't one). The posteriors of a bounded sample of candidates then train a logistic classifier of shape and surrounding words, and what it finds beyond the base is added.

Texts are read once and never shuffled. Patterns run in time linear in the text: no repeat can start again inside its own run.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import forget, slices, written

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("strict", "shape", "edges", "gazetteer", "context", "company")
#: Candidates of one kind, base or not, that train its classifier: those with the lowest hashes.
FIT_ROWS = 2_000
#: An added span has at least this probability.
SURE = 0.8
#: Characters before and after a span that are its context, and buckets for the words in them.
REACH, WORDS = 32, 32
DENSE = ("shape", "edges", "gazetteer", "context", "company", "refused", "length", "digits", "separators", "letters")

# Gazetteers.
TOP_DOMAINS = frozenset("com org net edu gov mil int info biz io co me dev app ai eu de fr es it uk us ca au nl be ch at pl pt se no fi dk ie cz gr hu ro ru ua tr il in cn jp kr br mx ar cl za nz example test".split())
CALLING_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 94 98 212 213 216 234 254 351 352 353 354 355 356 358 359 370 371 372 380 385 386 420 421 852 880 886 961 962 966 971 972".split())
ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|3[068]|6011|6[45]|35")
FOR = {
    "email": "email e-mail mail mailto contact kontakt correo courriel write schreiben reply address adresse adresa".split(),
    "ip": "ip host server address adresse dirección serveur login logged client router ping gateway dns".split(),
    "card": "card cards visa mastercard amex credit debit karte kreditkarte tarjeta carte crédit cvv cvc expires".split(),
    "phone": "phone tel telephone call fax mobile cell whatsapp telefon anruf handy teléfono móvil llame téléphone appelez portable hotline".split(),
}
AGAINST = {
    "email": "price each priced cost stück".split(),
    "ip": "version v release section chapter figure abschnitt kapitel capítulo sección chapitre update build".split(),
    "card": "isbn order invoice tracking serial id ref reference bestellung rechnung pedido factura commande facture timestamp account iban token hash".split(),
    "phone": "isbn issn order invoice tracking serial id ref reference page pages total date year years from bestellung rechnung seite pedido factura página commande facture version doi".split(),
}
_FOR = {k: frozenset(v) for k, v in FOR.items()}
_AGAINST = {k: frozenset(v) for k, v in AGAINST.items()}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

_OPEN, _SHUT = r"\s?[\[({<]\s?", r"\s?[\])}>]\s?"
_AT = re.compile(rf"{_OPEN}(?:at|AT|At|@){_SHUT}|\s(?:at|AT)\s|\s@\s?|@\s")
_DOT = rf"(?:{_OPEN}(?:dot|DOT|Dot|\.){_SHUT}|\s(?:dot|DOT)\s|\.)"
_SPELLED = re.compile(rf"(?:[A-Za-z0-9-]{{1,63}}{_DOT}){{1,4}}[A-Za-z]{{2,24}}(?![A-Za-z0-9])")
_NAME = re.compile(rf"(?:[A-Za-z0-9_%+-]{{1,32}}{_DOT}){{0,3}}[A-Za-z0-9_%+-]{{1,32}}$")
_BROKEN_IP = re.compile(rf"(?<![0-9A-Za-z.])[0-9]{{1,3}}(?:{_OPEN}(?:dot|\.){_SHUT}[0-9]{{1,3}}){{3}}(?![0-9A-Za-z])")
_IP6 = re.compile(r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![0-9A-Za-z:])")
_LOOSE_CARD = re.compile(r"(?<![0-9])[0-9](?:[ ._/  –-]{0,2}[0-9]){12,18}(?![0-9])")
_LOOSE_PHONE = re.compile(r"(?<![0-9+])\(?[0-9](?:[ ()./ -]{0,2}[0-9]){7,14}(?![0-9])")
_GROUPS = re.compile(r"(?:00[1-9][0-9]{0,2}[ ./-])?(?:\(0?[1-9][0-9]{1,4}\) ?|0[1-9][0-9]{1,4}[ /-]{1,2}|[2-9][0-9]{2}[ .-])[0-9]{3,4}(?:[ .-]?[0-9]{2,4}){1,3}$")
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(x), 10)) for x in even)) % 10 == 0


def digits_of(piece: str) -> str:
    return "".join(_DIGIT.findall(piece))


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of the e-mail pattern: every at sign looks back over its run, never before the last match."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        after = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            done = after = m.end()
        at = text.find("@", after)
    return out


def base_matches(text: str) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, passed) of all matches of the fixed patterns; those that fail their check are no base spans."""
    out = [("email", a, b, True) for a, b in emails(text)]
    for m in _IP.finditer(text):
        out.append(("ip", *m.span(), all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            d = digits_of(m[0])
            out.append(("card", *m.span(), 16 <= len(d) <= 19 and luhn(d)))
    for m in _PHONE.finditer(text):
        out.append(("phone", *m.span(), 8 <= len(digits_of(m[0])) <= 15))
    return out


def loose_matches(text: str) -> list[tuple[str, int, int]]:
    out = []
    spelled = "@" in text or "dot" in text or "DOT" in text or "Dot" in text
    for m in _AT.finditer(text) if spelled else ():
        before = _NAME.search(text[max(0, m.start() - 64) : m.start()])
        if before and (after := _SPELLED.match(text, m.end())):
            out.append(("email", m.start() - len(before[0]), after.end()))
    if "." in text and any(x in text for x in "[({<"):
        out += [("ip", *m.span()) for m in _BROKEN_IP.finditer(text)]
    for m in _IP6.finditer(text) if text.count(":") > 1 else ():
        try:
            ipaddress.IPv6Address(m[0])
        except ValueError:
            continue
        if len(m[0]) > 5:
            out.append(("ip", *m.span()))
    for m in _LOOSE_CARD.finditer(text):
        if luhn(digits_of(m[0])):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in _LOOSE_PHONE.finditer(text)]
    return out


def _shape(kind: str, piece: str, d: str) -> int:
    """Does it look as such a thing is usually written?"""
    if kind == "email":
        return 1 if re.fullmatch(r"\S+@\S+\.[A-Za-z]{2,24}", piece) or re.search(rf"{_OPEN}(?:at|AT|At|@){_SHUT}|\s(?:dot|DOT)\s", piece) else -1
    if kind == "ip":
        parts = re.findall(r"[0-9]+", piece)
        return 1 if ":" in piece or len(parts) == 4 and not any(len(p) > 1 and p[0] == "0" or len(p) > 3 for p in parts) else -1
    if kind == "card":
        return 1 if re.fullmatch(r"[0-9]{15,16}|[0-9]{4}([ ._/  –-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|3[0-9]{3}([ .-])[0-9]{6}\2[0-9]{5}", piece) else -1
    if piece[0] == "+":
        return 1
    if re.match(r"(?:19|20)[0-9]{2}[ ./-][01]?[0-9][ ./-]|[0-3]?[0-9][ ./-][01]?[0-9][ ./-](?:19|20)[0-9]{2}", piece):
        return -1  # a date
    return 1 if _GROUPS.match(piece) else -1


def _edges(text: str, a: int, b: int) -> int:
    before, after = text[a - 1 : a], text[b : b + 2]
    return -1 if before and (before.isalnum() or before in "._,:/$€£#%=&?+-@") or after and (after[0].isalnum() or after[0] in "%€$£=@" or after[0] in ".,-/:" and after[1:].isalnum()) else 1


def _gazetteer(kind: str, piece: str, d: str) -> int:
    if kind == "email":
        return 1 if re.split(r"[^A-Za-z0-9]", piece)[-1].lower() in TOP_DOMAINS else -1
    if kind == "ip":
        return 0 if ":" in piece else 1 if len(d) >= 8 else -1 if d[0] == "0" or len(d) <= 5 else 0
    if kind == "card":
        return 1 if ISSUERS.match(d) else -1
    if piece[0] == "+":
        return 1 if any(d[:n] in CALLING_CODES for n in (1, 2, 3)) else -1
    return 1 if d.startswith("00") and any(d[2 : 2 + n] in CALLING_CODES for n in (1, 2, 3)) else 0 if d[0] in "0(23456789" else -1


def _context(kind: str, before: list[str], after: list[str]) -> int:
    for w in [*before[::-1], *after[:2]]:  # the nearest word decides
        if w in _FOR[kind]:
            return 1
        if w in _AGAINST[kind]:
            return -1
    return 0


def _company(text: str, a: int, b: int) -> int:
    near = text[max(0, a - REACH) : a] + text[b : b + REACH]
    return -1 if len(_DIGIT.findall(near)) > len(near) / 3 else 1


@dataclass(slots=True)
class Candidate:
    kind: int
    start: int
    end: int
    base: bool
    votes: list[int]
    dense: list[float]
    words: list[int]


def candidates(text: str) -> list[Candidate]:
    """All base spans and what else might be personal data, by kind and start; nothing loose overlaps a base span or, of its
    kind, an earlier candidate."""
    matches = base_matches(text)
    taken = sorted((a, b) for _, a, b, ok in matches if ok)
    starts = np.array([a for a, _ in taken], np.int64)
    ends = np.array([b for _, b in taken], np.int64)  # rises with starts, or spans of different kinds overlap: then the largest so far counts
    ends = np.maximum.accumulate(ends) if len(ends) else ends

    def free(a: int, b: int) -> bool:
        i = int(np.searchsorted(starts, b))
        return i == 0 or int(ends[i - 1]) <= a

    strict = {(k, a, b): 1 if ok else -1 for k, a, b, ok in matches}
    spans = [(KINDS.index(k), a, b, strict[k, a, b]) for k, a, b in strict if strict[k, a, b] == 1]
    rest = [(KINDS.index(k), a, b, v) for (k, a, b), v in strict.items() if v == -1] + [(KINDS.index(k), a, b, strict.get((k, a, b), 0)) for k, a, b in loose_matches(text)]
    last: dict[int, int] = {}
    for k, a, b, v in sorted(set(rest)):
        if a >= last.get(k, 0) and free(a, b):
            last[k] = b
            spans.append((k, a, b, v))
    out = []
    for k, a, b, v in sorted(spans):
        kind, piece = KINDS[k], text[a:b]
        short = piece[:256]  # what labelers look at; spans themselves may be longer
        d = digits_of(short) or "0"
        before, after = ([w.lower() for w in _WORD.findall(x)] for x in (text[max(0, a - REACH) : a], text[b : b + REACH]))
        votes = [v, _shape(kind, short, d), _edges(text, a, b), _gazetteer(kind, short, d), _context(kind, before, after), _company(text, a, b)]
        letters = sum(map(str.isalpha, short))
        dense = [*map(float, votes[1:]), float(v == -1), min(len(piece), 64) / 32, len(_DIGIT.findall(short)) / len(short), len(short) / 16 - (letters + len(_DIGIT.findall(short))) / 16, letters / len(short)]
        words = sorted({zlib.crc32(w.encode()) % WORDS for w in before[-4:]} | {WORDS + zlib.crc32(w.encode()) % WORDS for w in after[:2]})
        out.append(Candidate(k, a, b, v == 1, votes, dense, words))
    return out


_SPANS = "array<struct<kind: int, start: int, end: int, base: boolean, votes: array<int>, dense: array<double>, words: array<int>>>"
_FIELDS = [("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("votes", pa.list_(pa.int32())), ("dense", pa.list_(pa.float64())), ("words", pa.list_(pa.int32()))]


def found(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): the candidates of every document, one pass over texts."""
    kind = pa.list_(pa.struct(_FIELDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for a, b in slices(texts):
                spans = [[{f: getattr(c, f) for f, _ in _FIELDS} for c in candidates(t)] for t in texts[a:b]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(spans, kind)], ["doc_id", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"doc_id long, spans {_SPANS}")


@dataclass
class Reliability:
    """What expectation-maximisation finds of one kind. yes[j]: how often labeler j, if it votes on personal data, says so;
    no[j]: how often, if it votes on other spans, it refuses them. prior: the share of personal data among candidates of which
    nothing is known."""

    yes: np.ndarray = field(default_factory=lambda: np.full(len(LABELERS), 0.8))
    no: np.ndarray = field(default_factory=lambda: np.full(len(LABELERS), 0.8))
    prior: float = 0.5

    def posterior(self, votes: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Probability that candidates with these votes (n x labelers, -1, 0, 1) are personal data. known: 1 they are, -1 they
        aren't, 0 not known."""
        ratio = np.where(votes > 0, np.log(self.yes / (1 - self.no)), np.where(votes < 0, np.log((1 - self.yes) / self.no), 0.0)).sum(1)
        p = 1 / (1 + np.exp(-np.clip(ratio + np.log(self.prior / (1 - self.prior)), -30, 30)))
        return np.where(known == 0, p, known > 0)


def reliabilities(votes: np.ndarray, known: np.ndarray, counts: np.ndarray, strength: float = 10.0, steps: int = 200) -> Reliability:
    """Expectation-maximisation over vote patterns with their counts.

    A labeler that doesn't vote says nothing. Every rate has `strength` pseudo-votes of 0.8 and stays between 0.5 and 0.999, so
    no labeler is turned round; the prior has two pseudo-candidates.
    """
    r, voted = Reliability(), votes != 0
    for _ in range(steps):
        p = r.posterior(votes, known)
        yes, no = counts * p, counts * (1 - p)
        new = [np.clip((w @ (votes == v) + 0.8 * strength) / (w @ voted + strength), 0.5, 0.999) for w, v in ((yes, 1), (no, -1))]
        prior = float((yes[known == 0].sum() + 1) / (counts[known == 0].sum() + 2))
        moved = max(np.abs(new[0] - r.yes).max(), np.abs(new[1] - r.no).max(), abs(prior - r.prior))
        r = Reliability(new[0], new[1], prior)
        if moved < 1e-9:
            break
    return r


def classifier(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights of a logistic model of soft labels, by Newton's method. The ridge draws weights of votes to 0.7, that of a refused
    check to -4, the intercept to -1.5, others to 0: few or one-sided labels leave the labelers' word."""
    start = np.r_[-1.5, [{"refused": -4.0}.get(n, 0.7 if n in LABELERS else 0.0) for n in DENSE], np.zeros(2 * WORDS)]
    a, w = np.c_[np.ones(len(x)), x], start.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(h, a.T @ (y - p) - ridge * (w - start))
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return w


def design(dense: list, words: list) -> np.ndarray:
    """Features of candidates: what DENSE names, and a bit for each bucket of words before and after."""
    out = np.zeros((len(dense), len(DENSE) + 2 * WORDS))
    for i, (d, w) in enumerate(zip(dense, words, strict=True)):
        out[i, : len(DENSE)] = d
        out[i, [len(DENSE) + j for j in w]] = 1.0
    return out


@dataclass(frozen=True)
class Model:
    """By kind: reliabilities of labelers and weights of the classifier."""

    labelers: dict[int, Reliability]
    weights: dict[int, np.ndarray]

    def probability(self, kind: int, dense: list, words: list) -> np.ndarray:
        if kind not in self.weights:
            return np.zeros(len(dense))
        x = design(dense, words)
        return 1 / (1 + np.exp(-np.clip(self.weights[kind][0] + x @ self.weights[kind][1:], -30, 30)))

    def added(self, spans: list[dict], sure: float = SURE) -> list[tuple[int, int, int, float]]:
        """(kind, start, end, probability) of candidates beyond the base that are personal data; of overlapping ones the most
        probable, then the first."""
        loose = [s for s in spans if not s["votes"][0]]  # neither base nor refused
        scored = []
        for k in {s["kind"] for s in loose}:
            mine = [s for s in loose if s["kind"] == k]
            p = self.probability(k, [s["dense"] for s in mine], [s["words"] for s in mine])
            scored += [(-float(x), k, s["start"], s["end"]) for x, s in zip(p, mine, strict=True) if x >= sure]
        out: list[tuple[int, int, int, float]] = []
        taken: list[tuple[int, int]] = []  # of each kind candidates don't overlap, so few are near any span
        for p, k, a, b in sorted(scored):
            i = int(np.searchsorted([x for x, _ in taken], a))
            if (i == 0 or taken[i - 1][1] <= a) and (i == len(taken) or taken[i][0] >= b):
                taken.insert(i, (a, b))
                out.append((k, a, b, -p))
        return sorted(out)


def train(spans: DataFrame) -> Model:
    """Learns from found() documents: reliabilities from the vote patterns of all candidates, classifiers from FIT_ROWS base
    spans and FIT_ROWS others of each kind. Kinds without other candidates get no classifier. `strict`, the
    vote of the fixed pattern and its check, is what is known."""
    each = spans.select("doc_id", F.explode("spans").alias("s"))
    counts = each.groupBy(F.col("s.kind").alias("kind"), F.col("s.base").alias("base"), F.col("s.votes").alias("votes")).count().collect()  # 3 ^ labelers patterns a kind at most
    labelers, weights, wanted = {}, {}, sorted({r["kind"] for r in counts if not r["base"]})
    for k in wanted:
        mine = sorted((r for r in counts if r["kind"] == k), key=lambda r: (r["base"], r["votes"]))
        votes = np.array([r["votes"] for r in mine])
        labelers[k] = reliabilities(votes, votes[:, 0], np.array([r["count"] for r in mine], float))
    order = F.xxhash64("doc_id", F.col("s.kind"), F.col("s.start"))
    parts = [each.where((F.col("s.kind") == k) & (F.col("s.base") == b)).select(order.alias("h"), "doc_id", "s").orderBy("h", "doc_id", "s").limit(FIT_ROWS) for k in wanted for b in (True, False)]
    rows = [r["s"] for part in parts for r in part.select("s").collect()]
    for k in wanted:
        mine = [s for s in rows if s["kind"] == k]
        votes = np.array([s["votes"] for s in mine])
        y = labelers[k].posterior(votes, votes[:, 0])
        weights[k] = classifier(design([s["dense"] for s in mine], [s["words"] for s in mine]), y)
    return Model(labelers, weights)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def judged(spans: DataFrame, model: Model, sure: float = SURE) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added of found() documents."""
    shared = spans.sparkSession.sparkContext.broadcast(model)  # a few weights a kind

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_spans = batch.column(1).to_pylist()
            base = [[(s["kind"], s["start"], s["end"]) for s in x if s["base"]] for x in all_spans]
            more = [[s[:3] for s in shared.value.added(x, sure)] if len(b) < len(x) else [] for x, b in zip(all_spans, base, strict=True)]
            counts = [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in range(len(KINDS))]
            digest = pa.array([hashlib.sha256(_joined(b).encode()).hexdigest() for b in base], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digest, pa.array([_joined(b + m) for b, m in zip(base, more, strict=True)], pa.string()), pa.array(map(len, more), pa.int64())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    return spans.mapInArrow(run, f"doc_id long, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string, n_added long")


def masked(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", sure: float = SURE) -> DataFrame:
    """(doc_id, text, n_masked): texts with every span, base or added, replaced by its kind in angle brackets; of overlapping base
    spans the whole they cover is replaced once, by the first one's kind. Null texts stay null."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def clean(text: str) -> tuple[str, int]:
        spans = [{f: getattr(c, f) for f, _ in _FIELDS} for c in candidates(text)]
        cuts = sorted([(s["start"], s["end"], s["kind"]) for s in spans if s["base"]] + [(a, b, k) for k, a, b, _ in shared.value.added(spans, sure)])
        out, at, n = [], 0, 0
        for a, b, k in cuts:
            if a >= at:
                out += [text[at:a], f"<{KINDS[k]}>"]
                n += 1
            at = max(at, b)
        return "".join([*out, text[at:]]), n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(None, 0) if t is None else clean(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.int64())], ["doc_id", "text", "n_masked"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text")).mapInArrow(run, "doc_id long, text string, n_masked long")


def op13_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added of every document.

    A null or empty text has no spans (the digest is that of nothing); very long texts are searched whole; repeated rows are
    judged each, and count in training; null ids are ids like others; an empty table gives no rows; other columns play no part.
    Added spans never overlap base spans or each other.
    """
    spans = written(found(docs), "pii-spans")
    out = written(judged(spans, train(spans)), "pii")
    forget(spans)
    return out
