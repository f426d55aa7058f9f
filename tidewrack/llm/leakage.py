"""Held-out passages inside a corpus, by a stored positional inverted index.

The corpus is indexed once: each task writes the postings (positions by term) of its documents, in
blocks of bounded size, as rows of a table in the shared folder. The index is partitioned by document,
so the corpus isn't shuffled and a frequent term is split over all blocks; it can be searched for any
items without reading the corpus again. The items are a stated query set sent to every block. For every
window of an item the terms are taken from the rarest in the block on; the rarest term's postings,
shifted by the term's offset, are the candidate starts, and each further term's shifted postings are
intersected with them until all terms of the window agree: exactly, or within a slop.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidewrack.session import spread, store

WORD = re.compile(r"[^\W_]+")
#: Words of one block of documents (a document is never split), and bytes of items sent at once.
BLOCK_WORDS = 500_000
ITEM_BYTES = 4_000_000


def words(text: str | None) -> list[str]:
    """Longest runs of letters and digits, lower case."""
    return WORD.findall(text.lower()) if text else []


class Queries:
    """Windows of the items' words: `span` consecutive words, or the whole item if it is shorter."""

    def __init__(self, items: list[tuple[object, str | None]], span: int):
        self.term: dict[str, int] = {}
        self.item: list[int] = []
        self.ids = [i for i, _ in items]
        flat: list[int] = []
        start, size, owner = [], [], []
        for n, (_, text) in enumerate(items):
            own = [self.term.setdefault(w, len(self.term) + 1) for w in words(text)]
            w = min(span, len(own))
            for q in range(len(own) - w + 1 if w else 0):
                start.append(len(flat) + q)
                size.append(w)
                owner.append(n)
            flat += own
        self.flat = np.array(flat, np.int32)
        self.start, self.size, self.owner = np.array(start, np.int64), np.array(size, np.int64), np.array(owner, np.int64)
        # equal windows of different items are searched once
        at = self.start[:, None] + np.arange(span)[None, :]
        grid = np.where(np.arange(span)[None, :] < self.size[:, None], self.flat[np.minimum(at, max(len(flat) - 1, 0))] if flat else 0, 0) if start else np.zeros((0, span), np.int32)
        self.grid, self.which = np.unique(grid, axis=0, return_inverse=True) if len(grid) else (grid, np.zeros(0, np.int64))
        self.which = self.which.reshape(-1)
        order = np.argsort(self.which, kind="stable")
        self.by_window, self.bounds = self.owner[order], np.searchsorted(self.which[order], np.arange(len(self.grid) + 1))


class Index:
    """The postings of a block of documents: positions by term, terms in order. One position is left
    free between documents; starts are the documents' first positions."""

    def __init__(self, terms: list[str], offsets: np.ndarray, positions: np.ndarray, starts: np.ndarray, size: int):
        self.terms, self.offsets, self.positions, self.starts, self.size = terms, offsets, positions, starts, size

    @classmethod
    def of(cls, ids: list[int], term: dict[str, int], sizes: list[int]) -> Index:
        """ids are the numbers of the block's words in `term`, sizes the words of each document."""
        n = np.array(sizes, np.int64)
        starts = np.cumsum(n + 1) - (n + 1)
        terms = sorted(term)
        rank = np.empty(len(terms), np.int32)
        rank[[term[t] for t in terms]] = np.arange(len(terms))
        word = rank[np.array(ids, np.int64)] if ids else np.zeros(0, np.int32)
        at = np.arange(len(word)) + np.repeat(np.arange(len(n)), n)
        offsets = np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(terms)))]).astype(np.int64)
        return cls(terms, offsets, at[np.argsort(word, kind="stable")].astype(np.int32), starts, int((n + 1).sum()))

    def pack(self) -> tuple[list[str], bytes, bytes, bytes, int]:
        """Terms, offsets, positions (as steps, byte by byte, compressed), starts and size."""
        steps = np.diff(self.positions, prepend=np.int32(0))
        planes = np.ascontiguousarray(steps.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes()
        return self.terms, self.offsets.astype("<i8").tobytes(), pa.compress(planes, "zstd", asbytes=True), self.starts.astype("<i8").tobytes(), self.size

    @classmethod
    def unpack(cls, terms: list[str], offsets: bytes, positions: bytes, starts: bytes, size: int) -> Index:
        at = np.frombuffer(offsets, "<i8")
        planes = np.frombuffer(pa.decompress(positions, int(at[-1]) * 4, "zstd", asbytes=True), np.uint8).reshape(4, -1)
        steps = np.ascontiguousarray(planes.T).view("<i4").reshape(-1)
        return cls(terms, at, np.cumsum(steps, dtype=np.int32), np.frombuffer(starts, "<i8"), size)


def search(queries: Queries, index: Index, slop: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, item, words) of all window matches. With a slop each term may stand that many words
    before or behind its place in the window, seen from the window's rarest term."""
    nothing = np.zeros(0, np.int64)
    grid = queries.grid
    if not len(grid) or not len(index.positions):
        return nothing, nothing, nothing
    # postings of the items' terms, by term, then position
    known = {t: i for i, t in enumerate(index.terms)}
    own = np.array([-1, *(known.get(t, -1) for t in queries.term)], np.int64)
    first, last = index.offsets[own], index.offsets[own + 1]
    frequency = np.where(own >= 0, last - first, 0)
    bounds = np.concatenate([[0], np.cumsum(frequency)])
    at = np.arange(bounds[-1]) + np.repeat(first - bounds[:-1], frequency)
    posting = index.positions[at].astype(np.int64)
    n = index.size + 1
    key = np.repeat(np.arange(len(own), dtype=np.int64), frequency) * n + posting
    if not len(key):
        return nothing, nothing, nothing
    ends = np.concatenate([index.starts[1:] - 1, [index.size - 1]])
    often = np.where(grid > 0, frequency[grid], n + 1)
    live = np.flatnonzero(often.min(axis=1) > 0)
    rare = np.argsort(often[live], axis=1, kind="stable")
    anchor = grid[live, rare[:, 0]] if len(live) else nothing
    count = frequency[anchor]
    found_w, found_doc = [], []
    # candidate starts in slices of bounded size
    cuts = np.searchsorted(np.cumsum(count), np.arange(1, int(count.sum() // 4_000_000) + 1) * 4_000_000)
    for part in np.split(np.arange(len(live)), cuts):
        c = count[part]
        w = np.repeat(part, c)
        if not len(w):
            continue
        k = np.arange(len(w)) - np.repeat(np.cumsum(c) - c, c)
        here = posting[bounds[anchor[w]] + k]
        doc = np.searchsorted(index.starts, here, "right") - 1
        start = here - rare[w, 0]
        for step in range(1, grid.shape[1]):
            offset = rare[w, step]
            t = grid[live[w], offset].astype(np.int64)
            low, high = np.maximum(start + offset - slop, index.starts[doc]), np.minimum(start + offset + slop, ends[doc] - 1)
            i = np.minimum(np.searchsorted(key, t * n + low), len(key) - 1)
            ok = (t == 0) | ((key[i] >= t * n + low) & (key[i] <= t * n + high))
            w, start, doc = w[ok], start[ok], doc[ok]
            if not len(w):
                break
        found_w.append(live[w])
        found_doc.append(doc)
    if not found_w:
        return nothing, nothing, nothing
    w, doc = np.concatenate(found_w), np.concatenate(found_doc)
    per = np.diff(queries.bounds)[w]
    k = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    item = queries.by_window[queries.bounds[np.repeat(w, per)] + k]
    return np.repeat(doc, per), item, np.repeat((grid[w] > 0).sum(axis=1), per)


def index_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(docs, terms, offsets, positions, starts, size): one row per block, to be stored; no shuffle. Null,
    empty and blank texts have no words and so no postings."""
    kind = docs.schema[doc_id].dataType
    out = T.StructType([
        T.StructField("docs", T.ArrayType(kind)), T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("offsets", T.BinaryType()), T.StructField("positions", T.BinaryType()),
        T.StructField("starts", T.BinaryType()), T.StructField("size", T.LongType()),
    ])
    arrow = [to_arrow_type(f.dataType) for f in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[pa.Array] = []
        ids: list[int] = []
        sizes: list[int] = []
        term: dict[str, int] = {}

        def flush() -> pa.RecordBatch:
            held = pa.concat_arrays(names)
            rows = [pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held), *(pa.array([x], k) for x, k in zip(Index.of(ids, term, sizes).pack(), arrow[1:]))]
            return pa.RecordBatch.from_arrays(rows, out.names)

        for batch in batches:
            done = 0
            for k in range(batch.num_rows):
                own = words(batch.column(1)[k].as_py())
                ids += [term.setdefault(w, len(term)) for w in own]
                sizes.append(len(own))
                if len(ids) > BLOCK_WORDS:
                    names.append(batch.column(0).slice(done, k + 1 - done))
                    yield flush()
                    names, ids, sizes, term, done = [], [], [], {}, k + 1
            names.append(batch.column(0).slice(done))
        if ids:
            yield flush()

    return spread(docs.select(doc_id, text)).mapInArrow(run, out)


_KEPT: dict[tuple, Queries] = {}


def _queries(shared, span: int) -> Queries:
    """The windows of a block of items, made once per worker process."""
    key = (hash(tuple(shared.value)), len(shared.value), span)
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = Queries(shared.value, span)
    return _KEPT[key]


def search_index(index: DataFrame, items: DataFrame, span: int = 10, slop: int = 0, doc_id: str = "doc_id", item_id: str = "item_id", passage: str = "passage") -> DataFrame:
    """(doc_id, item_id, windows): matches of the items in a stored index. The items are sent in blocks of
    ITEM_BYTES at most, of which each reads the index once."""
    spark = index.sparkSession
    total = items.agg(F.sum(F.octet_length(passage))).first()[0] or 0
    blocks = 1 + int(total // ITEM_BYTES)
    out = T.StructType([T.StructField(doc_id, index.schema["docs"].dataType.elementType), T.StructField(item_id, items.schema[item_id].dataType), T.StructField("windows", T.LongType())])
    kind = to_arrow_type(out[1].dataType)

    def one(block: int) -> DataFrame:
        chosen = items.select(item_id, passage).where(F.col(passage).isNotNull())
        if blocks > 1:
            chosen = chosen.where(F.pmod(F.xxhash64(item_id, passage), F.lit(blocks)) == block)
        shared = spark.sparkContext.broadcast([tuple(r) for r in chosen.collect()])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            queries = _queries(shared, span)
            width = max(len(queries.ids), 1)
            for batch in batches:
                for r in range(batch.num_rows):
                    held = Index.unpack(*(batch.column(c)[r].as_py() for c in range(1, 6)))
                    d, i, _ = search(queries, held, slop)
                    pair, windows = np.unique(d * width + i, return_counts=True)
                    d, i = np.divmod(pair, width)
                    yield pa.RecordBatch.from_arrays([batch.column(0)[r].values.take(pa.array(d)), pa.array([queries.ids[k] for k in i], kind), pa.array(windows)], out.names)

        return index.mapInArrow(run, out)

    result = one(0)
    for b in range(1, blocks):
        result = result.unionAll(one(b))
    return result


def find_leaks(
    docs: DataFrame, items: DataFrame, span: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage", slop: int = 0
) -> DataFrame:
    """(doc_id, item_id, windows): each document and each item of which it holds at least `span`
    consecutive words, or the whole passage if that is shorter, with the number of matching windows
    (occurrences counted). With a slop, proximity matches: all words of such a window, each at most
    `slop` words away from its place. Case and everything between words are ignored. Null, empty and
    blank texts and passages without words match nothing. A repeated doc_id gives rows for each of its
    rows that match, and a repeated item_id for each of its passages. The index of the corpus is stored
    in the shared folder; to search it again keep store(index_documents(docs)) and call search_index().
    """
    index = store(index_documents(docs, doc_id, text), **{"parquet.block.size": str(16 << 20), "compression": "uncompressed"})
    return search_index(index, items, span, slop, doc_id, item_id, passage)
