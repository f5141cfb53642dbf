"""That the corpus operators' results are those of the whole corpus, however it is cut."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from meshlore.llm import exchange, pitman_yor, seating

from test_llm import frame, prose


def test_pitman_yor_does_not_depend_on_slices(spark):
    rows = [(i, prose(i, 150)) for i in range(120)] + [(200, None), (201, "zzz qqq")]
    one, two, eight = ({r.doc_id: r.score for r in pitman_yor.score_texts(frame(spark, rows, parts=n)).collect()} for n in (1, 2, 8))
    assert one == {i: pytest.approx(score, rel=1e-12) for i, score in two.items()} == {i: pytest.approx(score, rel=1e-12) for i, score in eight.items()}


def test_pitman_yor_probabilities_sum_to_one(spark):
    """Scores give the matrix of P(y | x) up to a change of basis; rows that sum to one mean an eigenvalue of one."""
    r = random.Random(3)
    known = "a b c d e f g h".split()
    held = [i for i in range(1000, 9000) if zlib.crc32(str(i).encode()) % 10 == 0]
    every = [*known, "unknown"]
    texts = ["", *every, *(f"{x} {y}" for x in every for y in every)]
    rows = [(i, " ".join(r.choice(known) for _ in range(r.randrange(30)))) for i in range(200)] + list(zip(held, texts))  # noqa: B905
    score = {r.doc_id: r.score for r in pitman_yor.score_texts(frame(spark, rows)).collect()}
    p = {t: 10 ** score[i] for i, t in zip(held, texts)}  # noqa: B905
    states = [None, *every]
    matrix = np.array([[p[""] if x is y is None else p[x] if y is None else 1.0 if x is None else p[f"{x} {y}"] / p[y] for y in states] for x in states])
    assert max(np.linalg.eigvals(matrix).real) == pytest.approx(1, abs=1e-5)


def test_pitman_yor_frequent_words_are_dealt(spark, monkeypatch):
    rows = [(i, prose(i, 120)) for i in range(60)] + [(100, "x" * 200_000), (101, "y " * 50_000), (102, "the " * 300)]
    want = {r.doc_id: r.score for r in pitman_yor.score_texts(frame(spark, rows)).collect()}
    monkeypatch.setattr(pitman_yor, "HOT", 20)
    monkeypatch.setattr(exchange, "BUCKET_ENTRIES", 2000)
    got = {r.doc_id: r.score for r in pitman_yor.score_texts(frame(spark, rows)).collect()}
    assert got == {i: pytest.approx(score, rel=0.02) for i, score in want.items()}  # other numbers of words, other draws


@pytest.mark.parametrize(("c", "base", "p0"), [(5, 50.0, 0.01), (40, 20.0, 0.1), (64, 200.0, 0.2), (100, 50.0, 0.01), (500, 200.0, 1.0), (2000, 200.0, 0.2)])
def test_tables_follow_their_exact_distribution(c, base, p0):
    d = 0.75
    row = np.zeros(1)
    for n in range(1, c):
        grown = np.append(np.log(n - d * np.arange(1, n + 1)) + row, -np.inf)
        grown[1:] = np.logaddexp(grown[1:], row)
        row = grown
    i = np.arange(1, c)
    row[1:] += np.cumsum(np.log((base + d * i) * p0))
    p = np.exp(row - row.max()) / np.exp(row - row.max()).sum()
    t = np.arange(1, c + 1)
    mean = (p * t).sum()
    spread = math.sqrt((p * t * t).sum() - mean**2)
    n = 20000
    got = seating.tables(np.full(n, c), np.full(n, base), np.full(n, p0), np.zeros(n), d, seating.uniforms(np.arange(n, dtype=np.uint64), 1))
    assert abs(got.mean() - mean) < 0.25 * spread + 0.02 and got.std() == pytest.approx(spread, rel=0.1)


class Restaurant:
    """Customers one by one at tables of known sizes, as the process is defined."""

    def __init__(self, discount, strength, base, r):
        self.d, self.s, self.base, self.r = discount, strength, base, r
        self.tables, self.n, self.t = defaultdict(list), 0, 0

    def p(self, w):
        own = self.tables.get(w, [])
        return (sum(own) - self.d * len(own) + (self.s + self.d * self.t) * self.base.p(w)) / (self.s + self.n)

    def add(self, w):
        own = self.tables[w]
        x = self.r.random() * (sum(own) - self.d * len(own) + (self.s + self.d * self.t) * self.base.p(w))
        self.n += 1
        for i, size in enumerate(own):
            x -= size - self.d
            if x < 0:
                own[i] += 1
                return
        own.append(1)
        self.t += 1
        self.base.add(w)

    def remove(self, w):
        own = self.tables[w]
        i = self.r.choices(range(len(own)), own)[0]
        own[i] -= 1
        self.n -= 1
        if not own[i]:
            own.pop(i)
            self.t -= 1
            self.base.remove(w)


class Uniform:
    def __init__(self, n):
        self.n = n

    def p(self, w):
        return 1 / (self.n + 1)

    def add(self, w):
        pass

    remove = add


def plain_scores(texts, sweeps=20, kept=12):
    tokens = {i: [x for x in re.split(r"[ \t-\r]+", t.lower()) if x] + [None] for i, t in texts}
    steps = {i: list(zip([None, *x], x)) for i, x in tokens.items()}  # noqa: B905
    train = [x for i, own in steps.items() if zlib.crc32(str(i).encode()) % 10 for x in own]
    r = random.Random(1)
    root = Restaurant(pitman_yor.ROOT_DISCOUNT, pitman_yor.ROOT_STRENGTH, Uniform(len({w for _, w in train})), r)
    classes = defaultdict(lambda: Restaurant(pitman_yor.CLASS_DISCOUNT, pitman_yor.CLASS_STRENGTH, root, r))
    contexts = {u: Restaurant(pitman_yor.DISCOUNT, pitman_yor.STRENGTH, classes[u and u[-2:]], r) for u in {u for own in steps.values() for u, _ in own}}
    p = Counter()
    for sweep in range(sweeps):
        for u, w in train:
            if sweep:
                contexts[u].remove(w)
            contexts[u].add(w)
        if sweep >= sweeps - kept:
            for u, w in {x for own in steps.values() for x in own}:
                p[u, w] += contexts[u].p(w) / kept
    return {i: sum(math.log10(p[x]) for x in own) for i, own in steps.items()}


@pytest.mark.parametrize("parts", [1, 12])
def test_pitman_yor_against_a_plain_sampler(spark, parts):
    rows = [(i, prose(i, 150)) for i in range(60)]
    want = plain_scores(rows)
    got = {r.doc_id: r.score for r in pitman_yor.score_texts(frame(spark, rows, parts=parts)).collect()}
    assert sum(got.values()) == pytest.approx(sum(want.values()), rel=0.01)
    assert all(got[i] == pytest.approx(want[i], rel=0.02) for i in want)
