"""N-gram Jaccard join with Bayesian pruning of candidates.

Documents are sets of five-word shingles; two are linked if the Jaccard
similarity of their sets is ``THRESHOLD`` or more.

1. Texts with the same words (A-Z lower-cased) form one class, represented by its
   smallest id, so copies never multiply.  Every class has a MinHash signature.
2. Representatives that agree in a band of the signature are candidates.  In a
   bucket the MinHash values of a pair are compared ``STEP`` at a time; after each
   step the pair is dropped if the posterior probability of similarity
   ``THRESHOLD`` or more (uniform prior) is below ``TOLERANCE``.  What passes joins
   the two documents' candidate groups; pairs already joined need no comparison.
3. Within each group the shingle sets of all pairs are compared exactly.  This
   gives every document's number of links, and the classes of linked documents.

Neither buckets nor groups are collected: members are dealt into blocks, and each
pair of blocks is a task of its own: at most twice ``GROUP_MEMBERS`` members and
``GROUP_BLOCK`` shingles (a longer text is a block alone).  Pairs stay inside a task;
only spanning edges and counts leave it, as many as there are members.  The number
of links of n different texts that are all near copies of each other takes n^2
comparisons; equal texts none.

A pair at the threshold misses all bands with probability (1 - 0.8^4)^24 = 3e-6;
more similar pairs less.

Defined cases: null and empty texts have no shingles; each is a class of its own
with no links.  A text of fewer than five words is one shingle, all its words.
Rows with a null id get null classes and no links.  Rows that repeat an id count
as one document that has each of their texts.  Ids have to be integers.  Columns of
any other name go along in ``representatives``.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .blocks import blocks, mix64, sequence_digests, shingles, words
from .components import components

THRESHOLD = 0.8
SHINGLE = 5
BANDS, ROWS = 24, 4
HASHES = BANDS * ROWS
STEP = 16
TOLERANCE = 1e-5

#: Members of a bucket's block; shingles and members of a group's block.
BUCKET_BLOCK = 256
GROUP_BLOCK = 250_000
GROUP_MEMBERS = 512

_MULTIPLY = mix64(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)
_ADD = mix64(np.arange(1001, 1001 + HASHES, dtype=np.uint64))


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """After n values: fewer equal ones than this make the threshold less probable than the tolerance.

    With a uniform prior and m of n equal, P(similarity >= t) is the probability
    of m successes at most in n + 1 trials of probability t.
    """
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, 0
        while m <= n:
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                break
            m += 1
        out[n] = m
    return out


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, d1, d2, n, sig): digest of the words, number of shingles, MinHash values (16 bits each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                found = words(block)
                d1, d2 = sequence_digests(found)
                hashed, doc = shingles(found, SHINGLE)
                n = np.bincount(doc, minlength=len(block)).astype(np.int64)
                some = np.flatnonzero(n)
                sig = np.zeros((len(block), HASHES), dtype="<u2")
                if len(some):
                    first = np.searchsorted(doc, some)
                    for k in range(HASHES):
                        sig[some, k] = mix64(np.minimum.reduceat(hashed * _MULTIPLY[k] + _ADD[k], first)) & np.uint64(0xFFFF)
                columns = [batch.column("id").slice(block.first, len(block)), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.array(n)]
                raw = sig.tobytes()
                sigs = pa.array([raw[i : i + 2 * HASHES] for i in range(0, len(raw), 2 * HASHES)], pa.binary())
                yield pa.RecordBatch.from_arrays([*columns, sigs], ["id", "d1", "d2", "n", "sig"])

    return docs.select(common.integer_ids(docs, id_col).alias("id"), F.col(f"`{text_col}`").alias("text")).transform(common.arrow(run, "id bigint, d1 bigint, d2 bigint, n bigint, sig binary"))


def _bands(reps: DataFrame) -> DataFrame:
    """(key, id): one row for each band of each signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix64(np.arange(1, BANDS + 1, dtype=np.uint64))
        for batch in batches:
            if batch.num_rows:
                key = mix64(_signature_matrix(batch.column("sig")).view("<u8").astype(np.uint64) ^ salt)
                ids = np.repeat(batch.column("id").to_numpy(), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(ids)], ["key", "id"])

    return reps.select("id", "sig").transform(common.arrow(run, "key bigint, id bigint"))


def _signature_matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u2").reshape(-1, HASHES)


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Sorted batches anew, so that the rows of a key are never apart."""
    held: list[pa.RecordBatch] = []

    def changes(batch: pa.RecordBatch) -> np.ndarray:
        new = np.zeros(batch.num_rows - 1, dtype=bool)
        for k in keys:
            v = batch.column(k).to_numpy(zero_copy_only=False)
            new |= v[1:] != v[:-1]
        return np.flatnonzero(new) + 1

    for batch in batches:
        if not batch.num_rows:
            continue
        if held and any(held[-1].column(k)[-1] != batch.column(k)[0] for k in keys):
            yield pa.Table.from_batches(held)
            held = []
        cuts = changes(batch)
        if len(cuts):
            yield pa.Table.from_batches([*held, batch.slice(0, int(cuts[-1]))])
            held = [batch.slice(int(cuts[-1]))]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where the groups of a sorted table begin, and its length."""
    new = np.zeros(table.num_rows, dtype=bool)
    new[:1] = True
    for k in keys:
        v = table.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(new), table.num_rows)


class _Forest:
    """Union-find over positions; keeps the root of every position at hand."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            x, y = root[i], root[j]
            if x != y:
                root[root == max(x, y)] = min(x, y)
                self.edges.append((i, j))


def _lag_pairs(group: np.ndarray, side: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Position pairs of the same group, of different sides if the group has two."""
    for lag in range(1, longest):
        a = np.flatnonzero(group[lag:] == group[:-lag])
        if not len(a):
            return
        b = a + lag
        own = (side[a] < 0) | (side[a] != side[b])
        yield a[own], b[own]


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) between members of a bucket that the Bayesian test keeps, a spanning forest."""
    need = least_matches()
    keys = ["key", "bi", "bj"]
    for table in _grouped(batches, keys):
        starts = _starts(table, keys)
        # Some groups at a time, so that their forest is small.
        first = 0
        while first < len(starts) - 1:
            last = max(first + 1, int(np.searchsorted(starts, starts[first] + 2048, "right")) - 1)
            low, high = int(starts[first]), int(starts[last])
            ids = table.column("id")[low:high].to_numpy()
            sig = _signature_matrix(table.column("sig")[low:high])
            side = table.column("side")[low:high].to_numpy()
            sizes = np.diff(starts[first : last + 1])
            group = np.repeat(np.arange(last - first), sizes)
            forest = _Forest(high - low)
            for a, b in _lag_pairs(group, side, int(sizes.max())):
                apart = forest.root[a] != forest.root[b]
                a, b = a[apart], b[apart]
                equal = np.zeros(len(a), dtype=np.int64)
                for n in range(0, HASHES, STEP):
                    equal += (sig[a, n : n + STEP] == sig[b, n : n + STEP]).sum(axis=1)
                    kept = equal >= need[n + STEP]
                    a, b, equal = a[kept], b[kept], equal[kept]
                forest.join(a, b)
            if forest.edges:
                e = np.array(forest.edges)
                yield pa.RecordBatch.from_arrays([pa.array(ids[e[:, 0]]), pa.array(ids[e[:, 1]])], ["a", "b"])
            first = last


def _shingle_sets(rows: DataFrame) -> DataFrame:
    """(id, set): the sorted distinct shingle hashes of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                hashed, doc = shingles(words(block), SHINGLE)
                cut = np.searchsorted(doc, np.arange(len(block) + 1))
                sets = [np.unique(hashed[cut[i] : cut[i + 1]]).astype("<u8").tobytes() for i in range(len(block))]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(block.first, len(block)), pa.array(sets, pa.binary())], ["id", "set"])

    return rows.transform(common.arrow(run, "id bigint, set binary"))


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, as a matrix."""
    n = len(sets)
    doc = np.repeat(np.arange(n), [len(s) for s in sets])
    _, term = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(term, kind="stable")
    term, doc = term[order], doc[order]
    shared = np.bincount(term)[term] > 1  # a shingle of one set is in no intersection
    term, doc = term[shared], doc[shared]
    out = np.zeros((n, n), dtype=np.float32)
    step = 8192
    if len(term):
        term = np.cumsum(np.append(0, np.diff(term) > 0))
        for low in range(0, int(term[-1]) + 1, step):
            at, to = np.searchsorted(term, [low, low + step])
            part = np.zeros((n, min(step, int(term[-1]) + 1 - low)), dtype=np.float32)
            part[doc[at:to], term[at:to] - low] = 1
            out += part @ part.T
    return out


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact links inside a group's pair of blocks: rows (a, null, links) and spanning edges (a, b, 0)."""
    keys = ["component", "bi", "bj"]
    for table in _grouped(batches, keys):
        starts = _starts(table, keys)
        ids, side, raw = table.column("id").to_numpy(), table.column("side").to_numpy(), table.column("set")
        rows: list[tuple[int, int | None, int]] = []
        for low, high in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            sets = [np.frombuffer(x, dtype="<u8") for x in raw[low:high].to_pylist()]
            n = np.array([len(s) for s in sets])
            if len(sets) == 2:
                both = len(np.intersect1d(*sets, assume_unique=True))
                linked = np.array([[False, both >= THRESHOLD * (n.sum() - both) - 1e-9]] * 2)
                linked[1] = linked[1, ::-1]
            else:
                both = _intersections(sets)
                # The union is at least 1, and the products are exact enough: sizes are small integers.
                linked = both >= np.float64(THRESHOLD) * (n[:, None] + n[None, :] - both).astype(np.float64) - 1e-9
                np.fill_diagonal(linked, False)
            s, own = side[low:high], ids[low:high]
            linked &= (s[:, None] < 0) | (s[:, None] != s[None, :])
            linked &= own[:, None] != own[None, :]
            counts = linked.sum(axis=1)
            rows += [(i, None, c) for i, c in zip(own.tolist(), counts.tolist(), strict=True) if c]
            # Each member's first link, and the links between the stars that gives.
            forest = _Forest(high - low)
            for a in np.flatnonzero(counts).tolist():
                b = np.flatnonzero(linked[a])
                b = b[forest.root[b] != forest.root[a]]
                forest.join(np.full(len(b), a), b)
            rows += [(int(own[i]), int(own[j]), 0) for i, j in forest.edges]
        if rows:
            a, b, c = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64())], ["a", "b", "links"])


def _dealt(members: DataFrame, key: str, weight: str, block: int) -> DataFrame:
    """Members with ``bi``, ``bj`` and ``side``: all pairs of a key meet in the key's pairs of blocks.

    A key of weight up to ``block`` has the one pair (0, 0).  Only keys beyond
    are joined with their number of blocks.
    """
    sizes = members.groupBy(key).agg(F.sum(weight).alias("__w")).where(F.col("__w") > block)
    large = common.durable(sizes.select(key, F.ceil(F.col("__w") / block).cast("int").alias("__blocks")))
    if large.limit(10_001).count() <= 10_000:
        with_blocks = members.join(F.broadcast(large), key, "left")
    else:
        with_blocks = common.salted_left_join(members, large, key)
    blocks_of = F.coalesce("__blocks", F.lit(1))
    own = F.pmod(F.xxhash64("id"), blocks_of).cast("int")
    return (
        with_blocks.withColumn("__own", own)
        .withColumn("__other", F.explode(F.sequence(F.lit(0), blocks_of - 1)))
        .select(
            *[c for c in members.columns if c != weight],
            F.least("__own", "__other").alias("bi"),
            F.greatest("__own", "__other").alias("bj"),
            F.when(F.col("__own") == F.col("__other"), -1).otherwise((F.col("__own") > F.col("__other")).cast("int")).alias("side"),
        )
    )


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``.

    Columns: id, text_id (smallest id with the same words), class_id (smallest id
    of the linked documents), n_links (other texts with similarity
    ``THRESHOLD`` or more) and n_shingles.
    """
    signed = common.written(signatures(docs, id_col, text_col))
    named = signed.where(F.col("id").isNotNull() & (F.col("n") > 0))
    reps = common.written(named.groupBy("d1", "d2").agg(F.min("id").alias("id"), F.min_by(F.struct("n", "sig"), "id").alias("s")).select("d1", "d2", "id", "s.n", "s.sig"))

    keys = _bands(reps)
    shared = common.KeySet(keys.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "key")
    members = common.written(shared.marked(keys, F.col("key")).where("inside").select("row.key", "row.id", F.lit(1).alias("w")))
    dealt = _dealt(members, "key", "w", BUCKET_BLOCK).join(reps.select("id", "sig"), "id")
    edges = dealt.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj", "id").select("key", "bi", "bj", "side", "id", "sig").transform(common.arrow(_candidates, "a bigint, b bigint"))
    groups = common.durable(components(edges))

    # A member weighs its shingles, or as much as fills a block with ``GROUP_MEMBERS``.
    weight = F.greatest("n", F.lit(max(1, GROUP_BLOCK // GROUP_MEMBERS))).cast("long")
    weighted = groups.select(F.col("node").alias("id"), "component").join(reps.groupBy("id").agg(F.max("n").alias("n")), "id").withColumn("n", weight)
    weighted = common.durable(weighted)
    rows = docs.select(common.integer_ids(docs, id_col).alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).where("id IS NOT NULL")
    texts = common.KeySet(weighted, "id").marked(rows, F.col("id")).where("inside").select("row.id", "row.text")
    sets = _shingle_sets(texts)
    checked = common.durable(
        _dealt(weighted, "component", "n", GROUP_BLOCK)
        .join(sets, "id")
        .repartition("component", "bi", "bj")
        .sortWithinPartitions("component", "bi", "bj", "id")
        .select("component", "bi", "bj", "side", "id", "set")
        .transform(common.arrow(_verified, "a bigint, b bigint, links bigint"))
    )
    links = checked.where("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("n_links"))
    linked = components(checked.where("b IS NOT NULL").select("a", "b"))

    per_text = (
        reps.select("d1", "d2", F.col("id").alias("text_id"))
        .join(linked.select(F.col("node").alias("text_id"), "component"), "text_id", "left")
        .join(links.withColumnRenamed("id", "text_id"), "text_id", "left")
        .select(F.struct("d1", "d2").alias("d"), "text_id", F.coalesce("component", "text_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
    rows = signed.select("id", F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.struct("d1", "d2")).alias("d"), F.col("n").alias("n_shingles"))
    joined = common.salted_left_join(rows, per_text, "d")
    return joined.select(F.col("id").alias(id_col), F.coalesce("text_id", "id").alias("text_id"), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "n_shingles")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` of which one of each class stays, the one with the smallest id.

    Rows without a class (null id, no words) stay.  Only rows that may have to go
    are joined; the others pass the scan.
    """
    found = jaccard_join(docs, id_col, text_col).toDF("id", "text_id", "class_id", "n_links", "n_shingles")
    gone = common.durable(found.where("id <> class_id").select("id").distinct())
    told = common.KeySet(gone, "id").marked(docs, common.integer_ids(docs, id_col))
    stay = told.where("NOT inside").select("row.*")
    maybe = told.where("inside").withColumn("id", F.col(f"row.`{id_col}`").cast("bigint")).join(gone, "id", "left_anti").select("row.*")
    return stay.unionAll(maybe)
