"""Byte-level BPE encoding and decoding with a segment tree over pair ranks.

Encoding a pre-token starts from its bytes.  The leaves of a segment tree hold
the merge ranks of adjacent pairs; every inner node holds the least (rank,
position) below it, so the root names the leftmost pair of lowest rank.  A merge
changes three leaves at most, each a point update of logarithmic cost, and the
merging ends when the root holds no mergeable pair.

Texts are cut into pre-tokens by the pattern of the tokenizer file.  The words
of a text repeat, so a worker keeps the ids of the words it met last in a
bounded cache; the cache changes the speed only.

Defined cases: a null text counts as empty and gives no ids.  The string of an
added token is that token wherever it stands.  Decoding replaces invalid UTF-8
by U+FFFD; ids outside the vocabulary are skipped.  Texts of any length are
encoded whole.  A column of the name of a result (``ids``, ``decoded``) is replaced by
it, all others go along.  A tokenizer file of another kind is refused.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common
from .blocks import blocks

#: Entries of each half of a worker's word cache and pre-token cache (some 80 MB in all), and the longest string in them.
CACHE = 90_000
LONGEST = 64

#: Pre-tokens of the byte-level tokenizer (fixed pattern of the tokenizer file's "ByteLevel" type).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"

_NEVER = 1 << 62
_NO_RANK = -1
_FIB = np.uint64(0x9E3779B97F4A7C15)

#: Leaves of the segment trees that advance together (some MB of arrays).
_LEAVES_AT_ONCE = 1 << 17

#: Pieces of 2 ** ``_LONG_DEPTH`` bytes or more are merged one by one if fewer than ``_FEW_LONG`` are alike in length.
_LONG_DEPTH, _FEW_LONG = 9, 24


def byte_alphabet() -> dict[str, int]:
    """The printable character of the vocabulary file for every byte, by its rule."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Recent:
    """A bounded map of what was used last: of two halves, the older one goes."""

    def __init__(self, bound: int):
        self.bound, self.young, self.old = bound, {}, {}

    def get(self, key: str) -> bytes | None:
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key: str, value: bytes) -> None:
        if len(self.young) >= self.bound:
            self.old, self.young = self.young, {}
        self.young[key] = value


def _refuse_others(spec: dict) -> None:
    """Only what is done here: byte-level pre-tokens of the usual pattern, no normaliser, plain added tokens, plain merges."""
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer"):
        raise ValueError("not a plain byte-level tokenizer")
    if model.get("type", "BPE") != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("byte_fallback") or model.get("ignore_merges"):
        raise ValueError("not a plain BPE model")
    if any(t.get(flag) for t in spec.get("added_tokens", ()) for flag in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens with flags")


class ByteBPE:
    """A byte-level BPE tokenizer read from a ``tokenizers`` JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        _refuse_others(spec)
        alphabet = byte_alphabet()
        vocabulary = spec["model"]["vocab"]
        self.pieces: dict[int, bytes] = {i: bytes(alphabet[c] for c in token) for token, i in vocabulary.items() if all(c in alphabet for c in token)}
        self.added: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pieces |= {i: content.encode() for content, i in self.added.items()}
        by_bytes = {p: i for i, p in self.pieces.items() if i not in self.added.values()}
        self.byte_ids = np.array([by_bytes[bytes([b])] for b in range(256)])
        merges: dict[int, int] = {}  # (left id, right id) as one integer -> rank
        merged = []
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            merges.setdefault(vocabulary[left] << 32 | vocabulary[right], rank)
            merged.append(vocabulary[left + right])
        self.merged = np.array(merged, dtype=np.int64)
        self._merges, self._merged = merges, merged
        self._build_table(merges)
        self._pre = regex.compile(PATTERN)
        self._added = regex.compile("|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True))) if self.added else None
        self._irregular = regex.compile(r"\p{White_Space} | \p{White_Space}|^ | $")
        self._words = Recent(CACHE)  # by the word after a space
        self._pretokens = Recent(CACHE)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or ``_NO_RANK``: a probe of an open-addressing table."""
        key = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        slot = (key * _FIB >> self._shift).astype(np.int64)
        out = np.full(len(key), _NO_RANK, dtype=np.int64)
        for step in range(self._probes):
            at = slot + step
            hit = self._keys[at] == key
            out[hit] = self._ranks[at[hit]]
        return out

    def _build_table(self, merges: dict[int, int]) -> None:
        bits = max(8, (8 * len(merges)).bit_length())
        self._shift = np.uint64(64 - bits)
        self._keys = np.full((1 << bits) + 64, np.iinfo(np.uint64).max, dtype=np.uint64)
        self._ranks = np.zeros(len(self._keys), dtype=np.int64)
        key = np.fromiter(merges.keys(), dtype=np.uint64, count=len(merges))
        rank = np.fromiter(merges.values(), dtype=np.int64, count=len(merges))
        home = (key * _FIB >> self._shift).astype(np.int64)
        left, self._probes = np.arange(len(key)), 0
        while len(left):  # in round r those still without a slot try the r-th after their home
            at = home[left] + self._probes
            free = self._keys[at] == np.iinfo(np.uint64).max
            _, first = np.unique(at[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self._keys[at[won]], self._ranks[at[won]] = key[left[won]], rank[left[won]]
            left = np.delete(left, won)
            self._probes += 1

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece after all merges, lowest rank first, leftmost of equal rank.

        Pieces of like length advance together: one segment tree per piece, and
        each round takes every root's merge and updates the three leaves that it
        changes along their paths.
        """
        out: list[bytes] = [b""] * len(pieces)
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        depth = np.ceil(np.log2(np.maximum(lengths - 1, 1))).astype(np.int64)
        for d in np.unique(depth).tolist():
            rows = np.flatnonzero(depth == d)
            if d >= _LONG_DEPTH and len(rows) < _FEW_LONG:  # a round for so few pieces costs more than plain integers
                for i in rows.tolist():
                    out[i] = self._merge_long(pieces[i], d)
                continue
            step = max(1, _LEAVES_AT_ONCE >> d)
            for at in range(0, len(rows), step):
                self._merge_group(pieces, rows[at : at + step], lengths, d, out)
        return out

    def _merge_group(self, pieces: list[bytes], rows: np.ndarray, lengths: np.ndarray, depth: int, out: list[bytes]) -> None:
        count, size = len(rows), 1 << depth
        width = size + 1  # symbols of a piece at most
        n = lengths[rows]
        inside = np.arange(width) < n[:, None]
        ids = np.full((count, width), -1, dtype=np.int64)
        ids[inside] = self.byte_ids[np.frombuffer(b"".join([pieces[i] for i in rows.tolist()]), dtype=np.uint8)]
        tree = np.full((count, 2 * size + 1), _NEVER, dtype=np.int64)  # the last is a leaf nobody reads
        pair = np.arange(size) + 1 < n[:, None]
        rank = self.ranks(ids[:, :-1][pair], ids[:, 1:][pair])
        tree[:, size : 2 * size][pair] = np.where(rank == _NO_RANK, _NEVER, rank << 32 | np.nonzero(pair)[1])
        for level in range(depth - 1, -1, -1):
            a = 1 << level
            np.minimum(tree[:, 2 * a : 4 * a : 2], tree[:, 2 * a + 1 : 4 * a : 2], out=tree[:, a : 2 * a])
        after = np.tile(np.arange(1, width + 1), (count, 1))
        before = np.tile(np.arange(-1, width - 1), (count, 1))
        t, s, nx, pv = tree.reshape(-1), ids.reshape(-1), after.reshape(-1), before.reshape(-1)
        live = np.arange(count)
        while len(live):
            least = t[live * (2 * size + 1) + 1]
            more = least != _NEVER
            live, least = live[more], least[more]
            if not len(live):
                break
            base, root = live * width, live * (2 * size + 1)
            at, merged = least & 0xFFFFFFFF, self.merged[least >> 32]
            here = base + at
            gone = nx[here]
            right = nx[base + gone]
            s[here], s[base + gone], nx[here] = merged, -1, right
            has_right = right < n[live]
            there = base + np.minimum(right, width - 1)
            pv[there[has_right]] = at[has_right]
            left = pv[here]
            has_left = left >= 0
            rank = self.ranks(np.concatenate([merged[has_right], s[(base + left)[has_left]]]), np.concatenate([s[there[has_right]], merged[has_left]]))
            k = int(has_right.sum())
            new = np.full(len(live), _NEVER, dtype=np.int64)
            new[has_right] = np.where(rank[:k] == _NO_RANK, _NEVER, rank[:k] << 32 | at[has_right])
            t[root + size + gone] = _NEVER
            t[root + size + at] = new
            t[(root + size + left)[has_left]] = np.where(rank[k:] == _NO_RANK, _NEVER, rank[k:] << 32 | left[has_left])
            leaf = np.concatenate([size + np.minimum(gone, size - 1), size + at, size + np.where(has_left, left, at)])
            roots = np.concatenate([root, root, root])
            for _ in range(depth):
                leaf >>= 1
                child = roots + 2 * leaf
                t[roots + leaf] = np.minimum(t[child], t[child + 1])
        kept = ids >= 0
        flat = ids[kept].astype("<u4").tobytes()
        ends = (4 * np.cumsum(kept.sum(axis=1))).tolist()
        begin = 0
        for row, end in zip(rows.tolist(), ends, strict=True):
            out[row] = flat[begin:end]
            begin = end

    def _merge_long(self, piece: bytes, depth: int) -> bytes:
        """The same for one long piece; a path is updated up to where its least stays."""
        n, size, merges, merged = len(piece), 1 << depth, self._merges, self._merged
        start = self.byte_ids[np.frombuffer(piece, dtype=np.uint8)]
        leaves = np.full(2 * size, _NEVER, dtype=np.int64)
        rank = self.ranks(start[:-1], start[1:])
        leaves[size : size + n - 1] = np.where(rank == _NO_RANK, _NEVER, rank << 32 | np.arange(n - 1))
        for level in range(depth - 1, -1, -1):
            a = 1 << level
            np.minimum(leaves[2 * a : 4 * a : 2], leaves[2 * a + 1 : 4 * a : 2], out=leaves[a : 2 * a])
        tree, ids, after, before = leaves.tolist(), start.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        never = int(_NEVER)

        def put(at: int, value: int) -> None:
            at += size
            tree[at] = value
            while at > 1:
                value, other = tree[at], tree[at ^ 1]
                at >>= 1
                value = min(value, other)
                if tree[at] == value:
                    return
                tree[at] = value

        while (least := tree[1]) != never:
            at = least & 0xFFFFFFFF
            new, gone = merged[least >> 32], after[at]
            right, left = after[gone], before[at]
            ids[at], ids[gone], after[at] = new, -1, right
            if gone < size:
                put(gone, never)
            if right < n:
                before[right] = at
                rank = merges.get(new << 32 | ids[right])
                put(at, never if rank is None else rank << 32 | at)
            else:
                put(at, never)
            if left >= 0:
                rank = merges.get(ids[left] << 32 | new)
                put(left, never if rank is None else rank << 32 | left)
        return np.array([i for i in ids if i >= 0], dtype="<u4").tobytes()

    def _fill(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of distinct pre-tokens: remembered ones, and the rest merged together."""
        known = self._pretokens
        found, missing = {}, []
        for p in pieces:
            ids = known.get(p)
            if ids is None:
                missing.append(p)
            else:
                found[p] = ids
        for p, ids in zip(missing, self.merge_many([p.encode() for p in missing]), strict=True):
            found[p] = ids
            if len(p) <= LONGEST:
                known.put(p, ids)
        return found

    def _encode_pieces(self, split: list[list[str]]) -> list[bytes]:
        """Ids of texts given as lists of pre-tokens."""
        ids = self._fill(list(set(chain.from_iterable(split))))
        return [b"".join(map(ids.__getitem__, x)) for x in split]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        pre = self._pre.findall
        parts: list[tuple[int, str]] = []  # (text, part without added tokens)
        out: list[list[bytes]] = [[] for _ in texts]
        for i, text in enumerate(texts):
            at = 0
            if self._added is not None and text:
                for m in self._added.finditer(text):
                    parts.append((i, text[at : m.start()]))
                    parts.append((i, m[0]))
                    at = m.end()
            parts.append((i, text[at:]))
        # In a regular text every space stands between two characters that aren't
        # white space and so begins a pre-token: the words between are apart.
        regular = [None if not p or p in self.added or self._irregular.search(p) else p.split(" ") for _, p in parts]
        words = set().union(*[r[1:] for r in regular if r])
        known, ids, new = self._words, {}, []
        for w in words:
            found = known.get(w)
            if found is None:
                new.append(w)
            else:
                ids[w] = found
        for w, found in zip(new, self._encode_pieces([pre(" " + w) for w in new]), strict=True):
            ids[w] = found
            if len(w) <= LONGEST:
                known.put(w, found)
        rest = iter(self._encode_pieces([pre(r[0] if r else p) for r, (_, p) in zip(regular, parts, strict=True) if p not in self.added]))
        for r, (i, p) in zip(regular, parts, strict=True):
            if p in self.added:
                out[i].append(np.array([self.added[p]], dtype="<u4").tobytes())
            else:
                out[i].append(next(rest))
                if r:
                    out[i] += map(ids.__getitem__, r[1:])
        return [b"".join(x) for x in out]

    def encode(self, text: str | None) -> bytes:
        """Ids of one text; a null counts as empty."""
        return self.encode_many([text or ""])[0]

    def decode(self, ids: bytes | None) -> str:
        """The text of ids given as little-endian unsigned 32-bit integers."""
        pieces = self.pieces
        return b"".join([pieces.get(i, b"") for i in np.frombuffer(ids or b"", dtype="<u4").tolist()]).decode("utf-8", "replace")


_loaded: dict[str, ByteBPE] = {}


def tokenizer(path: str) -> ByteBPE:
    """The tokenizer of ``path``, read once by each worker."""
    if path not in _loaded:
        _loaded[path] = ByteBPE(path)
    return _loaded[path]


def _texts(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, list[str]]]:
    """Texts of a batch in slices of bounded size, with the first one's row."""
    texts = batch.column(column)
    for block in blocks(texts):
        yield block.first, [t or "" for t in texts.slice(block.first, len(block)).to_pylist()]


def _added_columns(docs: DataFrame, fields: list[T.StructField]) -> T.StructType:
    names = {f.name for f in fields}
    return T.StructType([f for f in docs.schema.fields if f.name not in names] + fields)


def _with(batch: pa.RecordBatch, at: int, n: int, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    part = batch.slice(at, n)
    names = [c for c in part.schema.names if c not in columns]
    return pa.RecordBatch.from_arrays([part.column(c) for c in names] + list(columns.values()), names + list(columns))


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the ids of each text (binary, little-endian unsigned 32-bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        for batch in batches:
            for at, texts in _texts(batch, text_col):
                yield _with(batch, at, len(texts), {ids_col: pa.array(own.encode_many(texts), pa.binary())})

    return docs.transform(common.arrow(run, _added_columns(docs, [T.StructField(ids_col, T.BinaryType())])))


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``encoded`` with the text of each row's ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                ids = batch.column(ids_col).slice(at, 256).to_pylist()
                yield _with(batch, at, len(ids), {text_col: pa.array([own.decode(x) for x in ids], pa.string())})

    return encoded.transform(common.arrow(run, _added_columns(encoded, [T.StructField(text_col, T.StringType())])))


def round_trip(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """``encode`` and ``decode`` of the same rows in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        for batch in batches:
            for at, texts in _texts(batch, text_col):
                ids = own.encode_many(texts)
                yield _with(batch, at, len(texts), {ids_col: pa.array(ids, pa.binary()), decoded_col: pa.array([own.decode(x) for x in ids], pa.string())})

    return docs.transform(common.arrow(run, _added_columns(docs, [T.StructField(ids_col, T.BinaryType()), T.StructField(decoded_col, T.StringType())])))
