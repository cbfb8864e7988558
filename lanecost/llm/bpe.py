"""Byte-level BPE encoding and decoding over length-bucketed numpy matrices.

Each match of the split pattern is a piece. Texts are looked up by unit, a word with the space
before it, which holds whole pieces; the distinct pieces of units not met before are sorted into buckets of similar length, one padded matrix per bucket. Every
round each row merges its leftmost pair of least rank; the rank of a pair comes from a
hash table of (left id, right id), only the two pairs next to a merge are looked up again,
and rows without a mergeable pair leave the matrix. The few pieces beyond ``LONG`` bytes
would take rounds in proportion to their length, so they merge in the same order from a heap.

The work is a map over partitions: no shuffle, memory bounded by batch and piece store.
"""

from __future__ import annotations

import base64
import functools
import heapq
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from .common import bounded_batches, fresh, gather

#: Pieces up to this many bytes are merged in matrices.
LONG = 128
#: Texts encoded and checked at a time.
CHECKED_ROWS = 500
#: Cells of one matrix.
CELLS = 1 << 18
#: Distinct units a worker remembers before it starts afresh.
REMEMBERED = 150_000
#: Units taken at a time.
PIECES = 100_000
_WIDE_SPACE = re.compile(r" (?:\s|\Z)")
_NONE = np.int64(1 << 40)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """(left id, right id) -> merged id, open addressing over two arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(2 * len(keys) + 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, _NONE, np.int64)
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]  # of several for one slot the last stays
            placed = self.keys[slot] == keys
            self.values[slot[placed]] = values[placed]
            keys, values, slot = keys[~placed], values[~placed], (slot[~placed] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MIX) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged id of each pair, ``_NONE`` where there is none or a side is padding (-1)."""
        out = np.full(left.shape, _NONE, np.int64)
        at = np.flatnonzero((left >= 0) & (right >= 0))
        keys = (left.ravel()[at].astype(np.int64) << 32) | right.ravel()[at]
        slot = self._slot(keys)
        flat = out.reshape(-1)
        while len(at):
            held = self.keys[slot]
            hit = held == keys
            flat[at[hit]] = self.values[slot[hit]]
            on = ~hit & (held >= 0)
            at, keys, slot = at[on], keys[on], (slot[on] + 1) & self.mask
        return out


class Tokens:
    """The bytes of the tokens of a tiktoken file, as one array; all that decoding needs."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(t): int(i) for t, i in map(bytes.split, lines)}
        tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, i in self.ranks.items():
            tokens[i] = token
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)


class Vocabulary(Tokens):
    """With the pair table, and the store of units met so far."""

    def __init__(self, path: str):
        super().__init__(path)
        ranks = self.ranks
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError(f"{path} lacks some of the 256 single bytes")
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        keys, values = [], []
        for token, i in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(i)
        self.pairs = PairTable(np.array(keys, np.int64), np.array(values, np.int64))
        self.forget()

    def forget(self) -> None:
        self.known: dict[str | tuple[str], int] = {}
        self.unit_ids, self.unit_start = np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.unit_count = np.zeros(0, np.int64)

    def learn(self, units: list[str | tuple[str]], split: regex.Pattern) -> None:
        """Encode units that are not known yet and store their ids. A string stands for
        itself after a space, a tuple for the bare string in it."""
        pieces = [split.findall(u[0] if isinstance(u, tuple) else " " + u) for u in units]
        distinct = list(set(itertools.chain.from_iterable(pieces)))
        place = {p: k for k, p in enumerate(distinct)}
        flat, size = self.encode_pieces([p.encode() for p in distinct])
        start = np.cumsum(size) - size
        owned = np.array([len(p) for p in pieces], np.int64)
        which = np.fromiter(map(place.__getitem__, itertools.chain.from_iterable(pieces)), np.int64, int(owned.sum()))
        ids = gather(flat, start[which], size[which])
        ends = np.concatenate([[0], np.cumsum(size[which])])[np.concatenate([[0], np.cumsum(owned)])]
        self.unit_start = np.concatenate([self.unit_start, len(self.unit_ids) + ends[:-1]])
        self.unit_count = np.concatenate([self.unit_count, np.diff(ends)])
        self.unit_ids = np.concatenate([self.unit_ids, ids])
        base = len(self.known)
        self.known.update((u, base + k) for k, u in enumerate(units))

    def encode_pieces(self, coded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, concatenated, and the number of ids of each."""
        found: list[np.ndarray | None] = [None] * len(coded)
        buckets: dict[int, list[int]] = {}
        for k, piece in enumerate(coded):
            whole = self.ranks.get(piece)
            if whole is not None:  # a piece that is a token is that token
                found[k] = np.array([whole], np.int32)
            elif len(piece) > LONG:
                found[k] = self.merge_one(piece)
            else:
                buckets.setdefault(len(piece) if len(piece) < 8 else -(-len(piece) // 4) * 4, []).append(k)
        for width, members in buckets.items():
            rows = CELLS // width
            for at in range(0, len(members), rows):
                part = members[at : at + rows]
                for k, ids in zip(part, self.merge_matrix([coded[k] for k in part], width), strict=True):
                    found[k] = ids
        return np.concatenate([np.zeros(0, np.int32), *found]), np.array([len(x) for x in found], np.int64)

    def merge_matrix(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        """Ids of pieces of at most ``width`` bytes, one row each."""
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        size = np.array([len(p) for p in pieces], np.int64)
        ids = np.where(np.arange(width) < size[:, None], self.byte_ids[raw], -1)
        rank = self.pairs.find(ids[:, :-1], ids[:, 1:])
        out: list[np.ndarray | None] = [None] * len(pieces)
        row = np.arange(len(pieces))
        while len(row):
            at = rank.argmin(axis=1)  # leftmost of the least
            best = rank[np.arange(len(row)), at]
            done = best == _NONE
            for k in np.flatnonzero(done):
                out[row[k]] = ids[k, : size[k]].astype(np.int32)
            on = ~done
            ids, rank, row, size, at, best = ids[on], rank[on], row[on], size[on] - 1, at[on], best[on]
            if not len(row):
                break
            here = np.arange(len(row))
            ids[here, at] = best
            take = np.arange(ids.shape[1] - 1) + (np.arange(ids.shape[1] - 1) > at[:, None])
            ids = np.take_along_axis(ids, take, 1)
            if ids.shape[1] == 1:
                rank = np.full((len(row), 1), _NONE, np.int64)
                continue
            rank = np.take_along_axis(rank, np.minimum(take[:, :-1], rank.shape[1] - 1), 1)
            last = ids.shape[1] - 1
            right = np.where(at < last, ids[here, np.minimum(at + 1, last)], -1)
            new = self.pairs.find(best, right)
            inside = at < last
            rank[here[inside], at[inside]] = new[inside]
            inside = at > 0
            rank[here[inside], at[inside] - 1] = self.pairs.find(ids[here, at - 1], best)[inside]
            most = int(size.max())  # compaction of columns that only padding is left in
            ids, rank = ids[:, :most], rank[:, : max(1, most - 1)]
        return out

    def merge_one(self, piece: bytes) -> np.ndarray:
        """Ids of one long piece: the same order of merges, from a heap of (rank, place)."""
        n = len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # part at i is piece[i:after[i]]
        find = self.ranks.get
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := find(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, end = heapq.heappop(heap)
            middle = after[i]
            if not alive[i] or middle >= n or after[middle] != end:
                continue  # one of its two parts has been merged since
            alive[middle], after[i] = False, end
            if end < n:
                before[end] = i
                if (r := find(piece[i : after[end]])) is not None:
                    heapq.heappush(heap, (r, i, after[end]))
            if (left := before[i]) >= 0 and (r := find(piece[left:end])) is not None:
                heapq.heappush(heap, (r, left, end))
        return np.array([find(piece[i : after[i]]) for i in range(n) if alive[i]], np.int32)

    def encode(self, units: list[str | tuple[str]], split: regex.Pattern) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units, concatenated, and the number of ids of each."""
        if len(self.known) > REMEMBERED:
            self.forget()
        new = set(units).difference(self.known)
        if new:
            self.learn(list(new), split)
        which = np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))
        count = self.unit_count[which]
        return gather(self.unit_ids, self.unit_start[which], count), count


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@functools.lru_cache(maxsize=2)
def token_bytes(path: str) -> Tokens:
    return Tokens(path)


@functools.lru_cache(maxsize=2)
def splitter(pattern: str) -> regex.Pattern:
    # white space as the tiktoken library's engine defines it
    spaces = pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(
        r"\S", r"\P{White_Space}")
    return regex.compile(spaces)


def _units(text: str, pattern: regex.Pattern) -> Iterator[list[str | tuple[str]]]:
    """The units of a text, a bounded number at a time.

    Before a space that text other than white space follows a piece always ends, so the text may be cut
    there. Other texts are cut into their pieces.
    """
    if _WIDE_SPACE.search(text) is None:
        parts: list = text.split(" ", PIECES)
        lead = True
        while True:
            tail = parts.pop() if len(parts) > PIECES else None
            if lead:
                parts[0] = (parts[0],)
            yield parts
            if tail is None:
                return
            parts, lead = tail.split(" ", PIECES), False
    matches = pattern.finditer(text)
    while part := [(m.group(),) for m in itertools.islice(matches, PIECES)]:
        yield part


def encode_texts(texts: list[str | None], path: str, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, number of ids of each); null counts as empty."""
    vocab, split = vocabulary(path), splitter(pattern)
    ids, counts = [np.zeros(0, np.int32)], np.zeros(len(texts), np.int64)
    waiting: list[str | tuple[str]] = []
    owners: list[tuple[int, int]] = []

    def flush() -> None:
        found, size = vocab.encode(waiting, split)
        ends = np.concatenate([[0], np.cumsum(size)])
        at = 0
        for k, n in owners:
            counts[k] += ends[at + n] - ends[at]
            at += n
        ids.append(found)
        waiting.clear()
        owners.clear()

    for k, text in enumerate(texts):
        for part in _units(text or "", split):
            waiting.extend(part)
            owners.append((k, len(part)))
            if len(waiting) >= PIECES:
                flush()
    flush()
    return np.concatenate(ids), counts


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """``docs`` with an array of token ids of the whole ``text`` in column ``ids``.

    A null or empty text has no ids. Special tokens are ordinary text. All other columns
    stay as they are; a column named ``ids`` is replaced.
    """
    bounded_batches(docs.sparkSession)
    kept = docs.drop(ids)
    schema = T.StructType([*kept.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, counts = encode_texts(batch.column(text).to_pylist(), path, pattern)
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            column = pa.ListArray.from_arrays(
                pa.array(offsets), pa.array(values), type=pa.list_(pa.field("element", pa.int32(), False)))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, ids])
        vocabulary(path).forget()  # the worker may serve other stages next

    return kept.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, ids: str = "token_ids", into: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes its ids stand for in column ``into``; a null array gives no bytes."""
    bounded_batches(encoded.sparkSession)
    kept = encoded.drop(into)
    schema = T.StructType([*kept.schema.fields, T.StructField(into, T.BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = token_bytes(path)
        for batch in batches:
            lists = batch.column(ids)
            column = _decoded(vocab, np.asarray(lists.flatten(), np.int64), np.asarray(lists.value_lengths().fill_null(0), np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, into])

    return kept.mapInArrow(run, schema)


def _decoded(vocab: Tokens, which: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Bytes that the ids stand for, ``counts`` ids each."""
    size = vocab.lengths[which]
    data = gather(vocab.bytes, vocab.starts[which], size)
    ends = np.concatenate([[0], np.cumsum(size)])[np.cumsum(counts)]
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.BinaryArray.from_buffers(
        pa.binary(), len(counts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def encode_checked(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "token_ids",
                   into: str = "round_trip") -> DataFrame:
    """``docs`` without ``text``, with its token ids, and whether they decode to the text, in one pass
    of one worker a task. Null texts count as empty; columns named as the new ones are replaced."""
    bounded_batches(docs.sparkSession)
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in (ids, into, text)], F.col(text).alias(fresh(text)))
    held = kept.columns[-1]
    schema = T.StructType([*kept.schema.fields[:-1], T.StructField(ids, T.ArrayType(T.IntegerType(), False), False),
                           T.StructField(into, T.BooleanType(), False)])
    rows = CHECKED_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                texts = batch.column(held)
                values, counts = encode_texts(texts.to_pylist(), path, pattern)
                same = pc.equal(_decoded(vocabulary(path), values.astype(np.int64), counts),
                                pc.fill_null(texts.cast(pa.binary()), b""))
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                column = pa.ListArray.from_arrays(
                    pa.array(offsets), pa.array(values), type=pa.list_(pa.field("element", pa.int32(), False)))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], column, same], names=[*batch.schema.names[:-1], ids, into])
        vocabulary(path).forget()

    return kept.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Number of ids, digest of the ids and digest of the decoded bytes of each document."""
    coded = decode(encode(docs.select("doc_id", "text"), path, pattern).drop("text"), path)
    return coded.select(
        "doc_id", F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
