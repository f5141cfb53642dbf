"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Folding lower-cases, turns homoglyphs (accented, full-width, mathematical,
Cyrillic and Greek look-alikes) into the ASCII letters they resemble, digits
into the letters they stand for, and everything else between words into spaces.
Letters that a digit may equally mean (1 as i or l) fold to one letter, in the
lexicon too.  An automaton then finds all terms and exception phrases in one
pass.  A term inside an exception phrase doesn't count.

The lexicon is a list of seed terms and what the labelled training rows show to
be terms: whole words and word beginnings that stand in toxic texts far more
often than in others.  What is counted is the number of distinct contexts (word
before, word after) or of texts, whichever is less, so a text that was copied
many times counts once.  A term's
weight is its smoothed log odds.  A document's sum of weights is divided by the
square root of its number of words; a two-feature logistic fit turns that into
a probability.

Bound: at most ``SAMPLE`` labelled rows (half of each class) are read to fit.
Everything else covers all rows and whole texts.

Defined cases: null and empty texts have no words and get the score of a text
without terms.  Without labelled rows the seed terms count with weight
``SEED_WEIGHT``.  Columns of the input with the names of the result are
replaced.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common
from .blocks import _powers_to, blocks, mix64, words

#: Labelled rows read to fit the lexicon and the calibration.
SAMPLE = 6000

SEED_WEIGHT = 3.0

#: Bytes of a word that a learned word beginning has at least and at most.
SHORTEST, LONGEST = 4, 8

#: A learned term stands in so many distinct contexts at least, its rate is so
#: many times the rate in other texts, and the likelihood ratio statistic is at least this.
SUPPORT, RATIO, EVIDENCE = 8, 8.0, 40.0

#: Seed terms.
SEEDS = (
    "idiot", "moron", "scum", "trash", "loser", "stupid", "pathetic", "worthless", "disgusting", "clown",
    "imbecile", "bastard", "bitch", "asshole", "vermin", "filth", "retard", "cretin", "scumbag", "dumbass",
    "dummkopf", "arschloch", "abschaum", "schwachkopf", "connard", "salaud", "ordure", "abruti", "cabron", "gilipollas", "basura", "escoria",
)

#: Phrases in which a term is not meant as an insult.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "trash collection", "clown fish", "circus clown", "pond scum", "soap scum", "sore loser bracket", "stupid simple")

#: Look-alikes of ASCII letters that compatibility decomposition leaves alone.
LOOK_ALIKES = {
    "a": "аαɑ", "b": "вβьƅ", "c": "сϲⅽ", "d": "ԁɗ", "e": "еєεҽ", "f": "ƒ", "g": "ɡց", "h": "һнհ", "i": "іιıɩ", "j": "јϳ", "k": "кκ", "l": "ӏⅼ", "m": "мⅿ",
    "n": "пηո", "o": "оοσօ", "p": "рρ", "q": "ԛ", "r": "гᴦ", "s": "ѕꜱ", "t": "тτ", "u": "υսц", "v": "ѵν", "w": "ѡԝω", "x": "хχ", "y": "уγү", "z": "ᴢʐ",
}

#: What digits (and @) stand for.
DIGITS = {"0": "o", "1": "i", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a"}


def _fold_table() -> dict[int, str | None]:
    out: dict[int, str | None] = {}
    spans = ((0x00, 0x250), (0x1E00, 0x1F00), (0x2000, 0x2070), (0x2100, 0x2190), (0xFF01, 0xFF5F), (0x1D400, 0x1D800), (0x3000, 0x3003))
    for low, high in spans:
        for code in range(low, high):
            c = chr(code)
            base = unicodedata.normalize("NFKD", c)[:1].lower()
            if base.isascii() and base.isalnum():
                out[code] = base
            elif not c.isalnum():
                out[code] = " "
    out |= {code: None for code in (*range(0x300, 0x370), 0xAD, *range(0x200B, 0x200E), 0x2060, 0xFEFF)}
    out |= {ord(c): letter for letter, same in LOOK_ALIKES.items() for c in same}
    out |= {ord(d): letter for d, letter in DIGITS.items()}
    out |= {code: {"l": "i"}.get(DIGITS.get(to, to), DIGITS.get(to, to)) for code, to in out.items() if to}
    return out


FOLD = _fold_table()


def fold(text: str) -> str:
    """``text`` as words of folded letters; every other character is a space."""
    return text.lower().translate(FOLD)


@dataclass
class Lexicon:
    """Terms with weights (a trailing ``*`` stands for any ending), exceptions, calibration."""

    terms: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    bias: float = -3.0
    presence: float = 3.0
    density: float = 1.0
    _automaton: ahocorasick.Automaton | None = field(default=None, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None}

    def automaton(self) -> ahocorasick.Automaton:
        if self._automaton is None:
            own = ahocorasick.Automaton()
            for term in self.terms:
                body = fold(term.removesuffix("*"))
                own.add_word(f" {body}" if term.endswith("*") else f" {body} ", (len(body), term))
            for phrase in self.exceptions:
                body = " ".join(fold(phrase).split())
                own.add_word(f" {body} ", (len(body), None))
            own.make_automaton()
            self._automaton = own
        return self._automaton

    def matches(self, folded: str) -> dict[str, int]:
        """Occurrences of each term in folded text, those in exceptions left out."""
        if not self.terms:
            return {}
        padded = f" {folded} "
        hits, covered = [], []
        for end, (length, term) in self.automaton().iter(padded):
            if term is None:
                covered.append((end - length, end))
            else:
                stop = end + 1 if term.endswith("*") else end
                hits.append((stop - length, stop, term))
        out: dict[str, int] = {}
        for start, stop, term in hits:
            if not any(a <= start and stop <= b for a, b in covered):
                out[term] = out.get(term, 0) + 1
        return out

    def amount(self, folded: str) -> tuple[float, dict[str, int]]:
        """Weights of all matches by the square root of the number of words."""
        found = self.matches(folded)
        total = sum(self.terms[t] * n for t, n in found.items())
        return (total / math.sqrt(len(folded.split())) if total else 0.0), found

    def score(self, amount: float) -> float:
        return 1.0 / (1.0 + math.exp(-(self.bias + self.presence * (amount > 0) + self.density * math.log1p(amount))))


def _beginnings(texts: list[str], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, list, np.ndarray]]:
    """(term hash, context hash, where, text) of the words' beginnings of that length; 0: whole words."""
    for block in blocks(pa.array(texts, pa.large_string())):
        found = words(block, lower=False)
        if not len(found.hash):
            continue
        n = found.end - found.start
        edge = np.zeros(1, np.uint64)
        before, after = np.concatenate([edge, found.hash[:-1]]), np.concatenate([found.hash[1:], edge])
        context = mix64(before * np.uint64(3) + mix64(after))
        body = np.concatenate([block.data[found.start[0] : found.end[-1]]]).astype(np.uint64) + np.uint64(1)
        start = found.start - found.start[0]
        if length == 0:
            at = np.flatnonzero(n >= 3)
            term = mix64(found.hash[at])
        else:
            at = np.flatnonzero(n >= length)
            term = np.full(len(at), length, dtype=np.uint64)
            for k in range(length):
                term += body[start[at] + k] * _powers_to(256)[k]
            term = mix64(term)
        yield term, mix64(term + context[at]), [block, found, at], (block.first + found.doc()[at]).astype(np.uint64)


def _distinct(term: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The terms, with how many different ``other`` each has; and how many pairs."""
    order = np.lexsort((other, term))
    term, other = term[order], other[order]
    new = np.ones(len(term), dtype=bool)
    new[1:] = (term[1:] != term[:-1]) | (other[1:] != other[:-1])
    return *np.unique(term[new], return_counts=True), int(new.sum())


def learn_terms(toxic: list[str], clean: list[str]) -> dict[str, float]:
    """Terms and weights from folded texts of both classes."""
    passed: dict[str, tuple[int, float]] = {}
    for length in (0, *range(SHORTEST, LONGEST + 1)):
        parts = [(t, c, d) for t, c, _, d in _beginnings(toxic, length)]
        if not parts:
            continue
        terms = np.concatenate([t for t, _, _ in parts])
        term, count, n1 = _distinct(terms, np.concatenate([c for _, c, _ in parts]))
        count = np.minimum(count, _distinct(terms, np.concatenate([d for _, _, d in parts]))[1])
        del parts, terms
        often = count >= SUPPORT
        term, count = term[often], count[often]
        n0, contexts = 0, [np.zeros((2, 0), np.uint64)]
        for t, c, _, _ in _beginnings(clean, length):
            own = np.isin(t, term)
            contexts.append(np.stack([t[own], c[own]]))
            n0 += len(np.unique(c))
        other = np.zeros(len(term), dtype=np.int64)
        t, c, _ = _distinct(*np.concatenate(contexts, axis=1))
        other[np.searchsorted(term, t)] = c
        share = max(1, n1) / max(1, n1 + n0)
        total = count + other
        rate = (count + 0.5) / (other + 0.5) * max(1, n0) / max(1, n1)
        with np.errstate(divide="ignore", invalid="ignore"):
            statistic = 2 * (count * np.log(count / (total * share)) + np.where(other > 0, other * np.log(other / (total * (1 - share))), 0.0))
        good = np.flatnonzero((rate >= RATIO) & (statistic >= EVIDENCE))
        wanted = {int(term[i]): i for i in good.tolist()}
        for t, _, (block, found, at), _ in _beginnings(toxic, length) if wanted else ():
            for k in np.flatnonzero(np.isin(t, term[good])).tolist():
                i = wanted.pop(int(t[k]), None)
                if i is not None:
                    word = block.data[found.start[at[k]] : found.end[at[k]]].tobytes()
                    name = (word[:length] if length else word).decode("utf-8", "ignore")
                    if len(name) >= 3:
                        passed[name + "*" * (length > 0)] = (int(count[i]), float(np.log(rate[i])))
            if not wanted:
                break
    # Of nested terms with nearly the same support the longest says it best; of others the shortest.
    out: dict[str, float] = {}
    for name in sorted(passed, key=lambda t: (len(t.removesuffix("*")), t)):
        body = name.removesuffix("*")
        if any(t.endswith("*") and body.startswith(t[:-1]) for t in out):
            continue
        best = name
        if name.endswith("*"):
            for longer in sorted((t for t in passed if t.startswith(body) and t != name), key=lambda t: len(t) + 2 * (not t.endswith("*"))):
                if passed[longer][0] >= 0.8 * passed[name][0]:
                    best = longer
        out[best] = min(10.0, max(1.0, passed[best][1]))
    return out


def fit(sample: list[tuple[int, str, int]]) -> Lexicon:
    """Lexicon and calibration from (id, text, label) rows."""
    seeds = {fold(s): SEED_WEIGHT for s in SEEDS}
    folded = [(fold(text), y) for _, text, y in sample]
    toxic, clean = [t for t, y in folded if y], [t for t, y in folded if not y]
    lexicon = Lexicon(seeds | (learn_terms(toxic, clean) if toxic and clean else {}))
    if not (toxic and clean):
        return lexicon
    amount = np.array([lexicon.amount(t)[0] for t, _ in folded])
    y = np.array([y for _, y in folded], dtype=float)
    x = np.stack([np.ones(len(y)), amount > 0, np.log1p(amount)], axis=1).astype(float)
    w, ridge = np.zeros(3), np.diag([1e-3, 1e-2, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    lexicon.bias, lexicon.presence, lexicon.density = map(float, w)
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``score`` (0 to 1) and ``terms`` (term to occurrences)."""
    fields = [T.StructField("score", T.DoubleType()), T.StructField("terms", T.MapType(T.StringType(), T.IntegerType()))]
    names = {f.name for f in fields}
    kept = [c for c in (docs.columns if keep is None else keep) if c not in names]
    schema = T.StructType([docs.schema[c] for c in kept] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(text_col)):
                part = batch.slice(block.first, len(block))
                found = [lexicon.amount(fold(t)) if t else (0.0, {}) for t in part.column(text_col).to_pylist()]
                added = [pa.array([lexicon.score(a) for a, _ in found], pa.float64()), pa.array([list(m.items()) for _, m in found], pa.map_(pa.string(), pa.int32()))]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + added, kept + ["score", "terms"])

    return docs.transform(common.arrow(run, schema))


def fitted(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Lexicon:
    """A lexicon from the labelled training rows (``labels.toxic``)."""
    lexicon = fit(common.labelled_sample(docs, labels, "toxic", bound))
    common.release_memory()
    return lexicon
