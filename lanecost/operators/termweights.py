"""TF-IDF vectors of many texts against a bounded set of asked terms.

Only asked terms can add to a score, but a text's length is taken over all its terms, most of which are rare, so the
document frequency of every term has to be known. Terms are not made rows for that. A task splits a batch of texts, keeps each text's
terms as places in the batch's own list of distinct terms, and sends this list on in parts (by hash of the term), each
term with the number of the batch's texts that hold it. A part adds up these numbers over all batches and answers every batch
with the sums in the order of its list; with the answers the batch computes its lengths. So a term is sent once a batch however many texts hold it,
no part is larger for a frequent term, and what is held is a batch or a part.

Words are split by the engine. Terms are told apart by hashes of 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import cut_lineage

#: Words of a batch, texts per part of the list of terms, and parts at most.
WORDS, TEXTS, PARTS = 2_000_000, 4096, 1024
#: Rows of split texts: of a batch, and of a part of its terms.
ROW = ("batch long, part int, n long, hashes binary, many binary, ids array<{}>, times binary, sizes binary, place binary, tf binary, "
       "n_used long, used binary, asked binary")


def _hashing():
    """Hashes of words, and of pairs of neighbouring words from theirs. Nested, so that it travels by value."""
    def of_words(words) -> np.ndarray:
        return pd.util.hash_array(np.asarray(words, dtype=object), categorize=False)

    def of_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    return of_words, of_pairs


def hashes_of(terms: list[str]) -> np.ndarray:
    """Hashes of terms as strings: words, or two words with a blank between them."""
    of_words, of_pairs = _hashing()
    words = [t.split(" ") for t in terms]
    first, last = of_words([w[0] for w in words]), of_words([w[-1] for w in words])
    two = np.array([len(w) > 1 for w in words], bool)
    return np.where(two, of_pairs(first, last), first)


def _numbers():
    """Counts as bytes of the least width that holds them all, and back, given how many there are."""
    def to_bytes(a: np.ndarray) -> bytes:
        return a.astype(np.min_scalar_type(int(a.max(initial=0)))).tobytes()

    def of_bytes(raw: bytes, n: int) -> np.ndarray:
        return np.frombuffer(raw, f"u{len(raw) // n}" if n else "u1").astype(np.int64)

    return to_bytes, of_bytes


def _splitting(asked, parts: int, most: int):
    """Batches of (id, words: a list for each text of the id, times: rows of the id) as one row of the texts and a row for each part of the terms."""
    of_words, of_pairs = _hashing()
    to_bytes, _ = _numbers()

    def listed(table: pa.Table, batch: int) -> pa.Table:
        ids, words = (table.column(c).combine_chunks() for c in ("id", "words"))
        texts = words.flatten()
        of_text = np.repeat(np.arange(len(ids)), np.asarray(words.value_lengths().fill_null(0)))
        text_of = np.repeat(np.arange(len(texts)), np.asarray(texts.value_lengths().fill_null(0)))
        coded = texts.flatten().dictionary_encode()
        word = of_words(coded.dictionary.to_numpy(zero_copy_only=False))[np.asarray(coded.indices)] if len(coded) else np.zeros(0, np.uint64)
        text = of_text[text_of]
        pair = np.flatnonzero(text_of[1:] == text_of[:-1])
        terms, place = np.unique(np.concatenate([word, of_pairs(word[pair], word[pair + 1])]), return_inverse=True)
        part = (terms % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        moved = np.empty(len(terms), np.int64)
        moved[order] = np.arange(len(terms))
        terms, bounds = terms[order], np.searchsorted(part[order], np.arange(parts + 1))
        held, tf = np.unique(np.concatenate([text, text[pair]]) * max(1, len(terms)) + moved[place], return_counts=True)
        text, place = np.divmod(held, max(1, len(terms)))
        many, sizes = np.bincount(place, minlength=len(terms)), np.bincount(text, minlength=len(ids))
        at = np.searchsorted(asked.value, terms)
        used = np.flatnonzero(asked.value[np.minimum(at, len(asked.value) - 1)] == terms) if len(asked.value) else np.zeros(0, np.int64)
        full = [int(p) for p in np.flatnonzero(np.diff(bounds))]
        cut = lambda a, how: pa.array([None, *(how(a[bounds[p]:bounds[p + 1]]) for p in full)], pa.binary())
        none = [None] * len(full)
        numbers = lambda a: pa.array([to_bytes(a), *none], pa.binary())
        return pa.table({
            "batch": pa.array(np.full(1 + len(full), batch)), "part": pa.array([-1, *full], pa.int32()),
            "n": pa.array([len(held), *np.diff(bounds)[full]], pa.int64()), "hashes": cut(terms, np.ndarray.tobytes), "many": cut(many, to_bytes),
            "ids": pa.array([ids.to_pylist(), *none], pa.list_(ids.type)),
            "times": numbers(np.asarray(table.column("times"))), "sizes": numbers(sizes), "place": numbers(place), "tf": numbers(tf),
            "n_used": pa.array([len(used), *none], pa.int64()), "used": numbers(used), "asked": numbers(at[used])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, words, batch = [], 0, TaskContext.get().partitionId() << 32
        for rows in batches:
            waiting.append(rows)
            words += len(rows.column("words").flatten().flatten())
            if words >= most:
                yield from listed(pa.Table.from_batches(waiting), batch).to_batches()
                waiting, words, batch = [], 0, batch + 1
        if sum(map(len, waiting)):
            yield from listed(pa.Table.from_batches(waiting), batch).to_batches()

    return run


def _counting(asked):
    """A part of all batches as how many texts hold each of its terms, for every batch and for the asked terms."""
    to_bytes, of_bytes = _numbers()

    def run(rows: pa.Table) -> pa.Table:
        hashes = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("hashes")]
        many = np.concatenate([of_bytes(x.as_py(), len(of)) for x, of in zip(rows.column("many"), hashes)])
        terms, place = np.unique(np.concatenate(hashes), return_inverse=True)
        sums = np.bincount(place, many).astype(np.int64)
        ends = np.cumsum([len(x) for x in hashes])
        at = np.searchsorted(terms, asked.value)
        used = np.flatnonzero(terms[np.minimum(at, len(terms) - 1)] == asked.value)
        answers = [to_bytes(x) for x in np.split(sums[place], ends[:-1])]
        return pa.table({
            "batch": pa.concat_arrays([rows.column("batch").combine_chunks().cast(pa.int64()), pa.array([-1], pa.int64())]),
            "part": pa.array(np.full(len(answers) + 1, rows.column("part")[0].as_py(), np.int32)),
            "n": pa.array([*map(len, hashes), len(used)], pa.int64()),
            "asked": pa.array([None] * len(answers) + [to_bytes(used)], pa.binary()),
            "many": pa.array([*answers, to_bytes(sums[at[used]])], pa.binary())})
    return run


def _packing(asked, size: int):
    """A batch and the answers to it as (id, terms, weights)."""
    _, of_bytes = _numbers()

    def run(batch: pa.Table, answers: pa.Table) -> pa.Table:
        (row,) = batch.to_pylist()
        ids = batch.column("ids").combine_chunks().flatten()
        text = np.repeat(np.arange(len(ids)), of_bytes(row["sizes"], len(ids)))
        place, tf = (of_bytes(row[c], row["n"]) for c in ("place", "tf"))
        used, at = (of_bytes(row[c], row["n_used"]) for c in ("used", "asked"))
        answers = answers.sort_by("part")
        many = np.concatenate([np.zeros(0, np.int64), *(of_bytes(x.as_py(), n.as_py()) for x, n in zip(answers.column("many"), answers.column("n")))])
        weight = (1 + np.log(tf)) * (np.log((1 + size) / (1 + many)) + 1)[place]
        length = np.sqrt(np.bincount(text, weight * weight, minlength=len(ids)))
        term = np.full(len(many), -1)
        term[used] = at
        pick = np.flatnonzero((term[place] >= 0) & ids.is_valid().to_numpy(zero_copy_only=False)[text])
        offsets = pa.array(np.searchsorted(text[pick], np.arange(len(ids) + 1)).astype(np.int32))
        out = pa.table({
            "id": ids, "terms": pa.ListArray.from_arrays(offsets, pa.array(asked.value, pa.string()).take(pa.array(term[place[pick]]))),
            "weights": pa.ListArray.from_arrays(offsets, pa.array(weight[pick] / length[text[pick]]))})
        return out.take(pa.array(np.repeat(np.arange(len(ids)), of_bytes(row["times"], len(ids)))))
    return run


def weighed(words: DataFrame, size: int, terms: list[str]) -> tuple[DataFrame, DataFrame]:
    """(term, many) of the ``terms`` that occur, and (id, terms, weights) of ``words`` (id, words: a list for each text of the
    id, times: rows of the id), where weights are of unit length over all terms of the id and only ``terms`` are kept. ``size`` is the
    number of texts. An id that comes n times has n equal rows; a null id has no terms."""
    spark = words.sparkSession
    parts = max(1, min(PARTS, size // TEXTS))
    hashes = hashes_of(terms) if terms else np.zeros(0, np.uint64)
    order = np.argsort(hashes)
    named = [terms[k] for k in order]
    asked, names = spark.sparkContext.broadcast(hashes[order]), spark.sparkContext.broadcast(named)
    kind = words.schema["id"].dataType
    rows = cut_lineage(words.select("id", "words", "times").mapInArrow(
        _splitting(asked, parts, WORDS), ROW.format(kind.simpleString())))
    answers = cut_lineage(rows.where("part >= 0").select("batch", "part", "hashes", "many").groupBy("part").applyInArrow(
        _counting(asked), "batch long, part int, n long, asked binary, many binary"))
    of_bytes = _numbers()[1]
    found = [(named[k], int(n)) for r in answers.where("batch < 0").collect()
             for k, n in zip(of_bytes(r["asked"], r["n"]), of_bytes(r["many"], r["n"]))]
    schema = T.StructType([T.StructField("id", kind), T.StructField("terms", T.ArrayType(T.StringType())),
                           T.StructField("weights", T.ArrayType(T.DoubleType()))])
    packed = rows.where("part < 0").select("batch", "n", "ids", "times", "sizes", "place", "tf", "n_used", "used", "asked").groupBy("batch").cogroup(
        answers.where("batch >= 0").select("batch", "part", "n", "many").groupBy("batch")).applyInArrow(_packing(names, size), schema)
    return spark.createDataFrame(found, "term string, many long"), packed
