"""Token counts by offset mapping: a document is encoded once, its tokens are attributed to
the fields and lines they lie in.

The fields of a row are rendered into one text, each ended by a line break, and the text is
encoded as a whole, as training would see it. Token character spans follow from the byte
lengths of the ids. Tokens and sections of a document, both sorted, are joined by interval
with binary search. A token that crosses a section boundary is allocated by ``rule``:

``start``  the section that holds its first byte
``end``    the section that holds its last byte
``most``   the section that holds most of its bytes, of equals the first
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, types as T

from .common import bounded_batches

RULES = ("start", "end", "most")


@functools.lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(t): int(i) for t, i in map(bytes.split, lines)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        lengths[i] = len(token)
    return tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def allocate(ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing tokens) of each section. ``ends``: byte ends of the tokens, which
    tile the text; ``bounds``: byte ends of the sections, which tile it too. A crossing
    token counts as crossing where it is allocated."""
    starts = np.concatenate([[0], ends[:-1]])
    first = np.searchsorted(bounds, starts, "right")
    last = np.searchsorted(bounds, ends - 1, "right")
    if rule == "start":
        owner = first
    elif rule == "end":
        owner = last
    else:
        owner = first.copy()
        for k in np.flatnonzero(last > first):
            inner = np.clip(bounds[first[k] : last[k] + 1], starts[k], ends[k])
            owner[k] += int(np.argmax(np.diff(np.concatenate([[starts[k]], inner]))))
    n = len(bounds)
    return np.bincount(owner, minlength=n)[:n], np.bincount(owner[last > first], minlength=n)[:n]


def attribute_tokens(docs: DataFrame, path: str, pattern: str, fields: Sequence[str], lines_of: Sequence[str] = (),
                     id_column: str = "doc_id", rule: str = "start") -> DataFrame:
    """One row per section of each document: id, field, section (from 0 in its field),
    char_start, char_end (in the rendered text), n_tokens, n_crossing.

    A field is one section, or one per line if it is in ``lines_of``; a section includes the
    line break that ends it. Null fields count as empty and keep their section, which holds
    the line break only. The sum of n_tokens of a document is the number of its tokens.
    Repeated rows each give their sections. An empty table gives no rows.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    bounded_batches(docs.sparkSession)
    names, by_line = list(fields), set(lines_of)
    schema = T.StructType([
        docs.schema[id_column], T.StructField("field", T.StringType()), T.StructField("section", T.LongType()),
        T.StructField("char_start", T.LongType()), T.StructField("char_end", T.LongType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("n_crossing", T.LongType())])
    out_names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, lengths = _encoder(path, pattern)
        for batch in batches:
            owner, field, section, start, end, tokens, crossing = ([] for _ in range(7))
            columns = [batch.column(name).to_pylist() for name in names]
            for k in range(batch.num_rows):
                parts, at_field, at_section = [], [], []
                for name, column in zip(names, columns, strict=True):
                    value = "" if column[k] is None else str(column[k])
                    own = value.split("\n") if name in by_line else [value]
                    parts += own
                    at_field += [name] * len(own)
                    at_section += range(len(own))
                whole = "\n".join(parts) + "\n"
                ends = np.cumsum(lengths[np.array(encoder.encode_ordinary(whole), np.int64)])
                bounds = np.cumsum([len(p.encode()) + 1 for p in parts])
                chars = np.cumsum([len(p) + 1 for p in parts])
                n, crossed = allocate(ends, bounds, rule)
                owner += [k] * len(parts)
                field += at_field
                section += at_section
                start += [0, *chars[:-1].tolist()]
                end += chars.tolist()
                tokens += n.tolist()
                crossing += crossed.tolist()
            ids = batch.column(id_column).take(pa.array(owner, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(field, pa.string()), *(pa.array(x, pa.int64()) for x in (section, start, end, tokens, crossing))],
                names=out_names)

    used = list(dict.fromkeys([id_column, *names]))
    return docs.select(*used).mapInArrow(run, schema)
