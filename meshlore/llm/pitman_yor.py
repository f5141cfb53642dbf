"""Language model scores from a hierarchical Pitman-Yor model with swept Gibbs seating.

Every word u has a restaurant as a context (the word before); its customers are the
words w that follow.  Contexts whose last two bytes agree share a parent, the class
restaurant k(u); all classes share the root restaurant, whose base is uniform over
the V known words and one more.  Each table of a restaurant is a customer of its
parent, so with customers c and tables t of a dish, and T tables in all,

    P(w | u) = (c_uw - d t_uw + (s + d T_u) P(w | k(u))) / (s + c_u)

and alike for P(w | k) over P(w), and P(w) over 1 / (V + 1).  Seatings are sampled by
blocked Gibbs sweeps: in a sweep all customers of each dish leave their restaurant
and are seated anew given everybody else (``seating.tables``), first in the
contexts, then in the classes, then in the root.  After ``BURN_IN`` sweeps the next
``SAMPLES`` are kept, and a word's probability is the mean of their predictive
probabilities.  Perplexity is 10 ** (-score / n_tokens).

What lies where.  Slices of the corpus number words by buckets of hashed words and
send distinct word pairs with their counts, once, to the bucket of the *dish* w (a
frequent w is dealt over several buckets by the class of u).  So a bucket holds all
contexts of a class that have a dish, and seats contexts and classes by itself; what
it needs from elsewhere are the totals of restaurants and the root's P(w).  These
are kept by the buckets of words and exchanged between sweeps, totals of the 1,024
classes through the driver.  Within a sweep such totals are those of the sweep
before.  Random numbers are hashes of the words: scores are a function of the table,
not of its partitions.

Memory per task is a slice (8 MB of text) or a bucket (about a million entries).
Nothing that grows with the corpus is broadcast or collected.

Learning reads the texts whose crc32(id as text) modulo ``FOLDS`` isn't 0; all texts
are scored.  Tokens: words outside space and 0x09 to 0x0D, A-Z lower-cased, then one
end.  Words are told apart by 54 bits of hash and their class.

Defined cases: a null or empty text is one token, the end.  A null id counts as the
empty text in the fold.  With no training tokens the model is the base (uniform),
and the base score uses N = V = 0.  Rows that repeat are scored and counted as often
as they occur.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, exchange, seating
from .blocks import LOWER, Block, Words, blocks, mix64, words
from .exchange import MESSAGE, Arrays, Mail

FOLDS = 10
BURN_IN, SAMPLES = 2, 3

#: Discount and strength of context, class and root restaurants.
DISCOUNT, STRENGTH = 0.75, 1.0
CLASS_DISCOUNT, CLASS_STRENGTH = 0.65, 10.0
ROOT_DISCOUNT, ROOT_STRENGTH = 0.55, 10.0

#: Bytes of text in a slice (a longer text is a slice alone).
SLICE = 8 << 20

#: A word that occurs this often is dealt over two buckets, and over twice as many each time it doubles.
HOT = 1 << 21

CLASS_BITS = 10
CLASSES = 1 << CLASS_BITS
_CLASS = np.uint64(CLASSES - 1)
END = np.uint64(0x2545F4914F6CDD1D)
_MIX = np.uint64(0x9E3779B97F4A7C15)

#: Messages that also carry totals; ``kind`` tells what they are.
REPORT = f"{MESSAGE}, kind int, totals array<double>"
_QUESTION, _SEATS, _TOTALS, _FACTS, _BOOK = range(5)


@dataclass
class Totals:
    """Customers and tables of the classes (none before they are known) and of the root."""

    distinct: float
    root: tuple[float, float] = (0.0, 0.0)
    classes: tuple[np.ndarray, np.ndarray] | None = field(default=None)


def word_keys(block: Block, found: Words) -> np.ndarray:
    """Hashes of a block's words with the class of their last two bytes in the lowest bits."""
    data = LOWER[block.data]
    last = data[found.end - 1].astype(np.uint64)
    before = np.where(found.end - found.start > 1, data[np.maximum(found.end - 2, 0)], 0).astype(np.uint64)
    return (found.hash & ~_CLASS) | (mix64(last * np.uint64(256) + before) & _CLASS)


def corpus_slices(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(slice, ids, state, tokens): the tokenised corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for big in blocks(batch.column("text"), SLICE):
                part = batch.slice(big.first, len(big))
                hashes, lengths = [], []
                for block in blocks(part.column("text")):
                    found = words(block)
                    n = np.diff(found.first)
                    tokens = np.full(len(found.hash) + len(n), END, dtype=np.uint64)
                    inside = np.ones(len(tokens), dtype=bool)
                    inside[found.first[1:] + np.arange(len(n))] = False
                    tokens[inside] = word_keys(block, found)
                    hashes.append(tokens)
                    lengths.append(n + 1)
                token, length = np.concatenate(hashes), np.concatenate(lengths)
                key, place = np.unique(token, return_inverse=True)
                held = part.column("fold").to_numpy() == 0
                # Numbered by frequency the tokens of a slice pack better.
                by_count = np.argsort(-np.bincount(place), kind="stable")
                rank = np.empty(len(key), dtype=np.uint32)
                rank[by_count] = np.arange(len(key), dtype=np.uint32)
                state = {"key": key, "by_count": by_count.astype(np.uint32), "rank": rank[place], "length": length.astype(np.uint32), "held": held.astype(np.uint8)}
                yield pa.RecordBatch.from_arrays([pa.array([part.column("id").to_pylist()], pa.list_(batch.schema.field("id").type)), pa.array([exchange.pack(state)]), pa.array([len(token)])], ["ids", "state", "tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), common.crc_mod(F.col(id_col), FOLDS).cast("int").alias("fold"))
    kind = rows.schema["id"].dataType.simpleString()
    made = rows.transform(common.arrow(run, f"ids array<{kind}>, state binary, tokens bigint"))
    return made.withColumn("slice", F.monotonically_increasing_id())


# --- slices -----------------------------------------------------------------------------------------------------------


def _tokens(state: Arrays) -> np.ndarray:
    """For each token the index of its word among the slice's sorted keys."""
    return state["by_count"][state["rank"]].astype(np.int64)


def _bucket_of(hashed: np.ndarray, bits: int) -> np.ndarray:
    return (hashed >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashed), np.int64)


def _ask_words(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Each slice's distinct words with their counts in training, to the buckets of words."""
    for batch in batches:
        for i in range(batch.num_rows):
            state = exchange.unpack(batch.column("state")[i].as_py())
            count = np.bincount(_tokens(state)[np.repeat(state["held"] == 0, state["length"])], minlength=len(state["key"]))
            yield from exchange.mail(batch.column("slice")[i].as_py(), _bucket_of(state["key"], bits), {"key": state["key"], "count": count.astype(np.uint64)})


def _number_words(bucket: int, found: Mail) -> Iterator[pa.RecordBatch]:
    """Counts and numbers within the bucket (by falling count), to the slices; the bucket's own book of them to receiver -1."""
    keys, entry = np.unique(exchange.joined(found, "key"), return_inverse=True)
    count = np.zeros(len(keys), np.uint64)
    np.add.at(count, entry, exchange.joined(found, "count"))
    by_count = np.lexsort((keys, -count.astype(np.int64)))
    rank = np.empty(len(keys), np.uint64)
    rank[by_count] = np.arange(len(keys), dtype=np.uint64)
    cut = np.cumsum([0, *(len(a["key"]) for _, a in found)])
    payloads = [exchange.pack({"rank": rank[entry[low:high]], "count": count[entry[low:high]]}) for low, high in zip(cut[:-1], cut[1:], strict=True)]
    book = exchange.pack({"class": (keys[by_count] & _CLASS).astype(np.uint16), "count": count[by_count], "size": np.array([len(keys)])})
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([*(s for s, _ in found), -1], pa.int64()),
            pa.array([bucket] * (len(found) + 1), pa.int64()),
            pa.array([*payloads, book], pa.binary()),
            pa.array([0] * (len(found) + 1), pa.int32()),
            pa.array([*[None] * len(found), [float(count.sum()), float((count > 0).sum())]], pa.list_(pa.float64())),
        ],
        ["receiver", "sender", "payload", "kind", "totals"],
    )


@dataclass
class Pairs:
    """A slice's distinct word pairs in the order in which they travel."""

    word: np.ndarray  # number of the word that follows, in the corpus
    context: np.ndarray
    count: np.ndarray  # in training
    bucket: np.ndarray
    of_token: np.ndarray  # for each token its pair


def _pairs(state: Arrays, numbered: Mail, word_bits: int, bits: int) -> Pairs:
    token, n = _tokens(state), len(state["key"])
    before = np.empty_like(token)
    before[1:] = token[:-1]
    starts = np.cumsum(state["length"].astype(np.int64)) - state["length"]
    before[starts] = int(np.searchsorted(state["key"], END))  # a text begins after an end
    number = (exchange.joined(numbered, "rank") << np.uint64(word_bits)) | _bucket_of(state["key"], word_bits).astype(np.uint64)
    by_number = np.argsort(number)
    place = np.empty(n, np.int64)
    place[by_number] = np.arange(n)
    code, of = np.unique(place[token] * n + place[before], return_inverse=True)
    word, context = by_number[code // n], by_number[code % n]
    train = np.repeat(state["held"] == 0, state["length"])
    count = np.bincount(of[train], minlength=len(code))
    seen = exchange.joined(numbered, "count")[word].astype(np.float64)
    deals = (1 << np.ceil(np.log2(np.maximum(seen / HOT, 1.0))).astype(np.int64)) - 1
    deal = (state["key"][context] & _CLASS).astype(np.int64) & deals
    bucket = _bucket_of(mix64(number[word] * _MIX + mix64(deal.astype(np.uint64))), bits)
    order = np.argsort(bucket, kind="stable")
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return Pairs(number[word][order], number[context][order], count[order], bucket[order], back[of])


def _ask_pairs(row: pa.Table, number: int, found: list[Mail], word_bits: int, bits: int) -> Iterator[pa.RecordBatch]:
    pairs = _pairs(exchange.unpack(row.column("state")[0].as_py()), found[0], word_bits, bits)
    yield from exchange.mail(number, pairs.bucket, {"word": pairs.word, "context": pairs.context, "count": pairs.count.astype(np.uint64)})


def _finish(row: pa.Table, number: int, found: list[Mail], word_bits: int, bits: int, total: float, distinct: float, id_col: str) -> Iterator[pa.RecordBatch]:
    """Scores of a slice's texts from the log probabilities of its pairs."""
    state = exchange.unpack(row.column("state")[0].as_py())
    numbered, answers = found
    pairs = _pairs(state, numbered, word_bits, bits)
    logs = exchange.joined(answers, "log").astype(np.float64)
    c = exchange.joined(numbered, "count").astype(np.float64)
    base = np.log10((c + 0.1) / (total + 0.1 * (distinct + 1)))
    token, length = _tokens(state), state["length"].astype(np.int64)
    starts = np.cumsum(length) - length
    score = np.add.reduceat(logs[pairs.of_token], starts)
    columns = {
        id_col: row.column("ids").combine_chunks().flatten(),
        "held_out": pa.array(state["held"] == 1),
        "n_tokens": pa.array(length),
        "n_known": pa.array(np.add.reduceat((c > 0)[token].astype(np.int64), starts)),
        "train_tokens": pa.array([int(total)] * len(length), pa.int64()),
        "base_score": pa.array(np.add.reduceat(base[token], starts)),
        "score": pa.array(score),
        "perplexity": pa.array(10.0 ** (-score / length)),
    }
    yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


# --- buckets of pairs -------------------------------------------------------------------------------------------------


def _merge_pairs(bucket: int, found: Mail) -> Iterator[pa.RecordBatch]:
    """A bucket's distinct pairs, ordered by word and context, and where each slice's entries lie in them."""
    words_of, contexts = exchange.joined(found, "word"), exchange.joined(found, "context")
    numbers, index = np.unique(np.concatenate([words_of, contexts]), return_inverse=True)
    n, m = len(numbers), len(words_of)
    code, entry = np.unique(index[:m] * n + index[m:], return_inverse=True)
    count = np.zeros(len(code), np.uint64)
    np.add.at(count, entry, exchange.joined(found, "count"))
    state = {
        "word": numbers,
        "of_word": (code // n).astype(np.uint32),
        "of_context": (code % n).astype(np.uint32),
        "count": count,
        "entry": entry.astype(np.uint32),
        "slices": np.array([s for s, _ in found], np.int64),
        "lengths": np.array([len(a["word"]) for _, a in found], np.int64),
    }
    yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([exchange.pack(state)], pa.binary())], ["bucket", "state"])


@dataclass
class Dishes:
    """A bucket's pairs with what is known of their words, and their groups: one for each word and class."""

    state: Arrays
    word: np.ndarray
    context: np.ndarray
    count: np.ndarray
    route: np.ndarray  # the order in which the words' buckets are asked
    word_bits: int
    dish: np.ndarray  # in that order, whether the word is a dish here
    facts: Arrays | None = None
    seen: np.ndarray | None = None
    group: np.ndarray | None = None
    group_word: np.ndarray | None = None
    group_class: np.ndarray | None = None

    @staticmethod
    def of(state: Arrays, word_bits: int) -> Dishes:
        route = np.argsort(state["word"] & np.uint64((1 << word_bits) - 1), kind="stable")
        dish = np.zeros(len(route), dtype=bool)
        dish[state["of_word"]] = True
        return Dishes(state, state["of_word"].astype(np.int64), state["of_context"].astype(np.int64), state["count"].astype(np.int64), route, word_bits, dish[route])

    def known(self, facts: Arrays) -> Dishes:
        """With the counts and classes of the words, in the order of ``state["word"]``."""
        self.facts, self.seen = facts, facts["count"].astype(np.float64)
        code, self.group = np.unique(self.word * CLASSES + facts["class"][self.context].astype(np.int64), return_inverse=True)
        self.group_word, self.group_class = code // CLASSES, code % CLASSES
        return self

    def told(self, found: Mail, name: str) -> np.ndarray:
        """What the words' buckets said of the words, in the order of ``state["word"]``."""
        said = exchange.joined(found, name)
        out = np.empty(len(said), said.dtype)
        out[self.route] = said
        return out

    def own(self, found: Mail) -> np.ndarray:
        """Of the dishes: customers in the root less the discount of their tables there (else 0)."""
        out = np.zeros(len(self.route))
        out[self.route[self.dish]] = exchange.joined(found, "customers").astype(np.float64) - ROOT_DISCOUNT * exchange.joined(found, "held").astype(np.float64)
        return out

    def sums(self, of: np.ndarray, what: np.ndarray) -> np.ndarray:
        return np.bincount(of, what, minlength=len(self.state["word"])).astype(np.uint64)

    def questions(self, bucket: int, tables: np.ndarray, customers: np.ndarray, first: bool = False) -> Iterator[pa.RecordBatch]:
        """To the words' buckets: the words' tables as contexts, and as dishes one more than their customers in the root, both in this bucket.

        Which words these are is said the first time only.
        """
        asked = self.state["word"][self.route]
        to = (asked & np.uint64((1 << self.word_bits) - 1)).astype(np.int64)
        said = {"tables": tables[self.route], "customers": np.where(self.dish, customers[self.route] + np.uint64(1), np.uint64(0))}
        if first:
            said["asked"] = asked >> np.uint64(self.word_bits)
        yield from exchange.mail(bucket, to, said)

    def salt(self) -> np.ndarray:
        return mix64(self.state["word"][self.word] * _MIX + mix64(self.state["word"][self.context]))


def _root(own: np.ndarray, totals: Totals) -> np.ndarray:
    """P(w) of the root; ``own`` are customers less the discount of the tables."""
    customers, tables = totals.root
    return (np.maximum(own, 0.0) + (ROOT_STRENGTH + ROOT_DISCOUNT * tables) / (totals.distinct + 1)) / (ROOT_STRENGTH + customers)


def _unpacked(seats: Mail, dishes: Dishes) -> tuple[np.ndarray, np.ndarray]:
    """Tables of pairs and of groups (a pair that occurs once has one table)."""
    tables = np.minimum(dishes.count, 1)
    tables[dishes.count > 1] = seats[0][1]["pair"].astype(np.int64)
    return tables, seats[0][1]["group"].astype(np.int64)


def _resat(dishes: Dishes, tables: np.ndarray, held: np.ndarray, said: Mail, totals: Totals, round_: int) -> tuple[np.ndarray, np.ndarray]:
    """One sweep over a bucket: tables of pairs, then of groups, drawn anew."""
    open_in = dishes.told(said, "tables").astype(np.float64)
    own = dishes.own(said)
    root = _root(own, totals)
    many = np.flatnonzero(dishes.count > 1)
    t, group, of_context = tables[many], dishes.group[many], dishes.context[many]
    customers = np.bincount(dishes.group, tables, minlength=len(dishes.group_word))
    if totals.classes is None:
        first, more = root[dishes.word[many]], np.zeros(len(many))
    else:
        all_customers, all_tables = (x[dishes.group_class] for x in totals.classes)
        left = customers[group] - t
        seats = CLASS_STRENGTH + all_customers[group]
        rest = (CLASS_STRENGTH + CLASS_DISCOUNT * all_tables[group]) * root[dishes.word[many]]
        first, more = (left - CLASS_DISCOUNT * np.minimum(held[group], left + 1) + rest) / seats, 1 / seats
    chance = seating.uniforms(dishes.salt()[many], 2 * round_)
    base = STRENGTH + DISCOUNT * np.maximum(open_in[of_context] - t, 0.0)
    tables = tables.copy()
    tables[many] = seating.tables(dishes.count[many], base, first, more, DISCOUNT, chance)
    customers = np.bincount(dishes.group, tables, minlength=len(dishes.group_word)).astype(np.int64)
    if totals.classes is None:
        return tables, np.minimum(customers, 1)
    some = np.flatnonzero(customers > 1)
    seats = ROOT_STRENGTH + totals.root[0]
    first = np.maximum(own[dishes.group_word[some]] - held[some], -ROOT_DISCOUNT) + (ROOT_STRENGTH + ROOT_DISCOUNT * totals.root[1]) / (totals.distinct + 1)
    key = mix64(dishes.state["word"][dishes.group_word[some]] * _MIX + dishes.group_class[some].astype(np.uint64))
    base = CLASS_STRENGTH + CLASS_DISCOUNT * np.maximum(all_tables[some] - held[some], 0.0)
    held = np.minimum(customers, 1)
    held[some] = seating.tables(customers[some], base, first / seats, np.full(len(some), 1 / seats), CLASS_DISCOUNT, seating.uniforms(key, 2 * round_ + 1))
    return tables, held


def _predictive(dishes: Dishes, tables: np.ndarray, held: np.ndarray, said: Mail, totals: Totals) -> np.ndarray:
    """P(w | u) of a bucket's pairs in one sample."""
    customers = np.bincount(dishes.group, tables, minlength=len(dishes.group_word))
    all_customers, all_tables = (x[dishes.group_class] for x in totals.classes)
    root = _root(dishes.own(said), totals)[dishes.group_word]
    parent = (np.maximum(customers - CLASS_DISCOUNT * held, 0.0) + (CLASS_STRENGTH + CLASS_DISCOUNT * all_tables) * root) / (CLASS_STRENGTH + all_customers)
    rest = STRENGTH + DISCOUNT * dishes.told(said, "tables").astype(np.float64)[dishes.context]
    return (np.maximum(dishes.count - DISCOUNT * tables, 0.0) + rest * parent[dishes.group]) / (STRENGTH + dishes.seen[dishes.context])


def _report(batches: Iterator[pa.RecordBatch], kind: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([kind] * b.num_rows, pa.int32()), pa.nulls(b.num_rows, pa.list_(pa.float64()))], ["receiver", "sender", "payload", "kind", "totals"])


def _note(bucket: int, arrays: Arrays, kind: int) -> Iterator[pa.RecordBatch]:
    """What a bucket keeps for its own later rounds."""
    yield from _report(iter([pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([bucket], pa.int64()), pa.array([exchange.pack(arrays)], pa.binary())], ["receiver", "sender", "payload"])]), kind)


def _open_pairs(row: pa.Table, bucket: int, _: list[Mail], word_bits: int) -> Iterator[pa.RecordBatch]:
    """At first each dish of a context has one table, and each is a customer of the root."""
    dishes = Dishes.of(exchange.unpack(row.column("state")[0].as_py()), word_bits)
    tables = np.minimum(dishes.count, 1)
    yield from _report(dishes.questions(bucket, dishes.sums(dishes.context, tables), dishes.sums(dishes.word, tables), first=True), _QUESTION)


def _sweep_pairs(row: pa.Table, bucket: int, found: list[Mail], word_bits: int, totals: Totals, round_: int) -> Iterator[pa.RecordBatch]:
    dishes, said = Dishes.of(exchange.unpack(row.column("state")[0].as_py()), word_bits), found[0]
    if round_ == 1:
        dishes.known({"count": dishes.told(said, "count"), "class": dishes.told(said, "class")})
        yield from _note(bucket, dishes.facts, _FACTS)
        tables, held = np.minimum(dishes.count, 1), np.zeros(len(dishes.group_word), np.int64)
    else:
        dishes.known(exchange.unpack(row.column("facts")[0].as_py()))
        tables, held = _unpacked(found[1], dishes)
    tables, held = _resat(dishes, tables, held, said, totals, round_)
    customers = np.bincount(dishes.group, tables, minlength=len(dishes.group_word))
    yield from _report(dishes.questions(bucket, dishes.sums(dishes.context, tables), dishes.sums(dishes.group_word, held)), _QUESTION)
    seats = {"pair": tables[dishes.count > 1].astype(np.uint64), "group": held.astype(np.uint64)}
    yield from _note(bucket, seats, _SEATS)
    sums = np.stack([np.bincount(dishes.group_class, x, minlength=CLASSES) for x in (customers, held)], axis=1)
    some = np.flatnonzero(sums.any(axis=1))
    yield pa.RecordBatch.from_arrays(
        [pa.array(some, pa.int64()), pa.array([bucket] * len(some), pa.int64()), pa.nulls(len(some), pa.binary()), pa.array([_TOTALS] * len(some), pa.int32()), pa.array(sums[some].tolist(), pa.list_(pa.float64()))],
        ["receiver", "sender", "payload", "kind", "totals"],
    )


def _answer_pairs(row: pa.Table, bucket: int, found: list[Mail], word_bits: int, samples: list[Totals]) -> Iterator[pa.RecordBatch]:
    """To the slices: log10 of the mean predictive probability of each pair they asked about."""
    state = exchange.unpack(row.column("state")[0].as_py())
    dishes = Dishes.of(state, word_bits).known(exchange.unpack(row.column("facts")[0].as_py()))
    mean = np.zeros(len(dishes.count))
    for k, totals in enumerate(samples):
        said, seats = found[2 * k], found[2 * k + 1]
        mean += _predictive(dishes, *_unpacked(seats, dishes), said, totals)
    logs = np.log10(mean / len(samples)).astype(np.float32)[state["entry"]]
    cut = np.cumsum([0, *state["lengths"].tolist()]).tolist()
    payloads = [exchange.pack({"log": logs[low:high]}) for low, high in zip(cut[:-1], cut[1:], strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array(state["slices"], pa.int64()), pa.array([bucket] * len(payloads), pa.int64()), pa.array(payloads, pa.binary())], ["receiver", "sender", "payload"])


# --- buckets of words -------------------------------------------------------------------------------------------------


def _answer_words(row: pa.Table, bucket: int, found: list[Mail], totals: Totals, round_: int) -> Iterator[pa.RecordBatch]:
    """Sums over all buckets of pairs, and the root seated anew.

    The first time also counts and classes, and to receiver -1 who asked about what.
    """
    book, asked = exchange.unpack(row.column("state")[0].as_py()), found[0]
    every = exchange.joined(asked, "asked") if round_ == 0 else book["asked"]
    place, n = every.astype(np.int64), int(book["size"][0])
    dish = exchange.joined(asked, "customers") > 0
    tables = np.bincount(place, exchange.joined(asked, "tables").astype(np.float64), minlength=n).astype(np.uint64)
    customers = np.bincount(place[dish], exchange.joined(asked, "customers")[dish].astype(np.float64) - 1, minlength=n).astype(np.uint64)
    base = np.full(n, ROOT_STRENGTH + ROOT_DISCOUNT * (totals.root[1] or totals.distinct))
    key = mix64(np.arange(n, dtype=np.uint64) * _MIX + np.uint64(bucket))
    held = seating.tables(customers.astype(np.int64), base, np.full(n, 1 / (totals.distinct + 1)), np.zeros(n), ROOT_DISCOUNT, seating.uniforms(key, -1 - round_ & 0xFFFF)).astype(np.uint64)
    cut = np.cumsum([0, *(len(a["tables"]) for _, a in asked)]).tolist()
    payloads = []
    for low, high in zip(cut[:-1], cut[1:], strict=True):
        at = place[low:high]
        dishes = at[dish[low:high]]
        said = {"tables": tables[at], "customers": customers[dishes], "held": held[dishes]}
        if round_ == 0:
            said |= {"count": book["count"][at], "class": book["class"][at]}
        payloads.append(exchange.pack(said))
    kinds, to = [_QUESTION] * len(asked), [s for s, _ in asked]
    if round_ == 0:
        payloads.append(exchange.pack({"asked": every, "size": book["size"]}))
        kinds, to = [*kinds, _BOOK], [*to, -1]
    sums = [[float(customers.sum()), float(held.sum())]] + [None] * (len(to) - 1)
    yield pa.RecordBatch.from_arrays(
        [pa.array(to, pa.int64()), pa.array([bucket] * len(to), pa.int64()), pa.array(payloads, pa.binary()), pa.array(kinds, pa.int32()), pa.array(sums, pa.list_(pa.float64()))],
        ["receiver", "sender", "payload", "kind", "totals"],
    )


def _summed(rows: DataFrame) -> tuple[float, float]:
    sums = rows.where("totals IS NOT NULL").agg(*[F.sum(F.col("totals")[k]).alias(f"s{k}") for k in range(2)]).first()
    return float(sums["s0"] or 0), float(sums["s1"] or 0)


def _class_sums(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Customers and tables of the classes: ``CLASSES`` rows at most."""
    out = np.zeros((2, CLASSES))
    for r in rows.where(F.col("kind") == _TOTALS).groupBy("receiver").agg(F.sum(F.col("totals")[0]).alias("c"), F.sum(F.col("totals")[1]).alias("t")).collect():
        out[:, r["receiver"]] = r["c"], r["t"]
    return out[0], out[1]


# --- the whole --------------------------------------------------------------------------------------------------------


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``.

    Columns: id, held_out, n_tokens, n_known, train_tokens, base_score and score
    (log10 probabilities of the text) and perplexity (per token).
    """
    scratch = common.Scratch(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    try:
        slices, name = exchange.kept(corpus_slices(docs, id_col, text_col), "slice")
        scratch.tables.append(name)
        tokens = int(slices.agg(F.sum("tokens").alias("n")).first()["n"] or 0)
        # Of a slice's tokens some two thirds are distinct pairs and a fifth distinct words.
        bits, word_bits = exchange.buckets_for(2 * tokens // 3), exchange.buckets_for(tokens // 5)

        asked = slices.select("slice", "state").transform(common.arrow(partial(_ask_words, bits=word_bits), MESSAGE))
        numbered = scratch.written(exchange.gathered(asked, _number_words, 1 << word_bits, REPORT))
        total, distinct = _summed(numbered)
        book = numbered.where("receiver = -1").select(F.col("sender").alias("bucket"), F.col("payload").alias("state"))
        numbered = numbered.where("receiver >= 0")
        asked = exchange.toured(slices.select("slice", "state"), "slice", [numbered], partial(_ask_pairs, word_bits=word_bits, bits=bits), MESSAGE)
        parts = max(1 << bits, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        pairs, name = exchange.kept(exchange.gathered(asked, _merge_pairs, parts, "bucket bigint, state binary"), "bucket", parts)
        scratch.tables.append(name)

        totals, samples, mails = Totals(distinct), [], []
        for round_ in range(1 + BURN_IN + SAMPLES):
            if round_ == 0:
                visit, known = partial(_open_pairs, word_bits=word_bits), []
            else:
                visit, known = partial(_sweep_pairs, word_bits=word_bits, totals=totals, round_=round_), [said] if round_ == 1 else [said, seats]
            out = scratch.written(exchange.toured(pairs, "bucket", known, visit, REPORT))
            asked = out.where(F.col("kind") == _QUESTION)
            answers = scratch.written(exchange.toured(book, "bucket", [asked], partial(_answer_words, totals=totals, round_=round_), REPORT))
            said, seats = answers.where(F.col("kind") == _QUESTION), out.where(F.col("kind") == _SEATS)
            if round_ == 0:
                own = answers.where(F.col("kind") == _BOOK).select(F.col("sender").alias("bucket"), F.col("payload").alias("state"))
                book, name = exchange.kept(own, "bucket", 1 << word_bits)
                scratch.tables.append(name)
            if round_ == 1:
                facts, name = exchange.kept(out.where(F.col("kind") == _FACTS).select(F.col("receiver").alias("bucket"), F.col("payload").alias("facts")), "bucket", parts)
                scratch.tables.append(name)
                pairs = pairs.join(facts.hint("merge"), "bucket")
            totals = Totals(distinct, _summed(answers), _class_sums(out) if round_ else None)
            if round_ > BURN_IN:
                samples.append(totals)
                mails += [said, seats]
        answers = exchange.toured(pairs, "bucket", mails, partial(_answer_pairs, word_bits=word_bits, samples=samples), MESSAGE)
        last = partial(_finish, word_bits=word_bits, bits=bits, total=total, distinct=distinct, id_col=id_col)
        schema = f"`{id_col}` {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double"
        return common.written(exchange.toured(slices, "slice", [numbered, answers], last, schema))
    finally:
        scratch.close()
