"""Deeply nested JSON records to related flat tables, by vectorised structural indexing.

A block of records is treated as one byte array. Quote, bracket and delimiter bitmaps are computed
over all its bytes at once, escapes by the parity of backslash runs, nesting depth by prefix sums.
Keys are the strings in front of colons; the container around any position is the last bracket
opened at that depth, found by binary search in the brackets sorted by (depth, position). Nodes are
then linked level by level through their `children` spans. Nothing recurses, so depth is bounded by
memory only.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidewrack.session import spread

BLOCK_BYTES = 2_000_000

LINKS = T.StructType([
    T.StructField("record_kind", T.StringType()),
    T.StructField("record_key", T.StringType()),
    T.StructField("parent_key", T.StringType()),
])
#: name and value: attribute name and JSON text of the value; JSON text of a box; null for nodes.
VALUES = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("tag_name", T.StringType()),
    T.StructField("element_id", T.StringType()),
    T.StructField("text_content", T.StringType()),
    T.StructField("depth", T.IntegerType()),
])
SCALARS = ("tag_name", "element_id", "text_content", "depth")


def _constant(name: str) -> None:
    raise ValueError(name)


JSON_TOKEN = re.compile(rb'[ \t\n\r]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null))')


def is_deep_json(text: bytes) -> bool:
    """is_json() for any depth: tokens against what may stand next, with a stack of open brackets."""
    try:
        text.decode()
    except UnicodeDecodeError:
        return False
    at, end, stack, want = 0, len(text.rstrip(b" \t\n\r")), bytearray(), "value"
    while at < end:
        m = JSON_TOKEN.match(text, at, end)
        if m is None:
            return False
        at, sign = m.end(), m.group(1)
        if sign in (b"{", b"["):
            if want not in ("value", "first"):
                return False
            stack += sign
            want = "first key" if sign == b"{" else "first"
        elif sign in (b"}", b"]"):
            if not stack or stack.pop() != (123 if sign == b"}" else 91) or want not in ("more", "first key" if sign == b"}" else "first"):
                return False
            want = "more"
        elif sign == b",":
            if want != "more" or not stack:
                return False
            want = "key" if stack[-1] == 123 else "value"
        elif sign == b":":
            if want != "colon":
                return False
            want = "value"
        elif want in ("key", "first key"):
            if m.group(2) is None:
                return False
            want = "colon"
        elif want in ("value", "first"):
            want = "more"
        else:
            return False
    return want == "more" and not stack


def is_json(text: bytes) -> bool:
    """RFC 8259 validity, whatever the depth."""
    try:
        json.loads(text, parse_constant=_constant)
    except RecursionError:
        return is_deep_json(text)
    except ValueError:
        return False
    return True


class StructuralIndex:
    """Bitmaps, depths and containers of a block: data holds whole records, starts their bounds
    (n + 1 offsets)."""

    def __init__(self, data: np.ndarray, starts: np.ndarray):
        self.data, self.starts, n = data, starts, len(data)
        self.doc = np.repeat(np.arange(len(starts) - 1, dtype=np.int32), np.diff(starts))
        first = starts[:-1][self.doc] if n else np.zeros(0, np.int64)
        at = np.arange(n, dtype=np.int64)
        # a byte is escaped if the backslash run that ends before it has odd length
        solid = np.where(data == 92, -1, at)
        solid = np.maximum(np.maximum.accumulate(solid) if n else solid, first - 1)
        run = np.zeros(n, np.int64)
        run[1:] = at[:-1] - solid[:-1]
        run[at == first] = 0
        quote = (data == 34) & (run % 2 == 0)
        total = np.cumsum(quote, dtype=np.int64)
        before = np.concatenate([[0], total])[first] if n else total
        inside = ((total - before) % 2 == 1) & ~quote
        free = ~(inside | quote)
        opens = free & ((data == 123) | (data == 91))
        closes = free & ((data == 125) | (data == 93))
        level = np.cumsum(opens.astype(np.int64) - closes.astype(np.int64))
        base = np.concatenate([[0], level])[first] if n else level
        level = level - base  # of a closing bracket: of what is around it
        self.quotes = np.flatnonzero(quote)
        self.opens, self.closes = np.flatnonzero(opens), np.flatnonzero(closes)
        self.colons, self.commas = np.flatnonzero(free & (data == 58)), np.flatnonzero(free & (data == 44))
        self.solid = np.flatnonzero(~((data == 32) | (data == 9) | (data == 10) | (data == 13)))
        self.level = level
        ends = np.concatenate([level, [0]])[np.maximum(starts[1:] - 1, 0)] if n else np.zeros(len(starts) - 1, np.int64)
        low = np.zeros(len(starts) - 1, np.int64)
        np.minimum.at(low, self.doc[self.closes], level[self.closes])
        self.balanced = (ends == 0) & (low >= 0)
        self.width = n + 1
        self.keys = np.sort(level[self.opens] * self.width + self.opens)
        self.close_keys = np.sort(level[self.closes] * self.width + self.closes)
        # colons and commas by container
        self.colon_in, self.comma_in, self.open_in = (self.around(self.colons), self.around(self.commas), self.around(self.opens, 1))
        self.comma_keys = np.sort(self.comma_in * self.width + self.commas)
        self.value_at = self.next_solid(self.colons + 1)
        q = np.searchsorted(self.quotes, self.colons) - 1
        ok = q >= 1
        self.key_end, self.key_start = np.where(ok, self.quotes[np.maximum(q, 0)] if len(self.quotes) else 0, 0), np.where(ok, self.quotes[np.maximum(q - 1, 0)] + 1 if len(self.quotes) else 0, 0)

    def around(self, at: np.ndarray, up: int = 0) -> np.ndarray:
        """Position of the bracket that opens the container around each position (up=1: around the
        container that opens there); -1 at the top."""
        if not len(at) or not len(self.keys):
            return np.full(len(at), -1, np.int64)
        d = self.level[at] - up
        i = np.searchsorted(self.keys, d * self.width + at, "right") - 1
        found = self.keys[np.maximum(i, 0)]
        ok = (d > 0) & (i >= 0) & (found // self.width == d)
        return np.where(ok, found % self.width, -1)

    def next_solid(self, at: np.ndarray) -> np.ndarray:
        if not len(self.solid):
            return np.full(len(at), len(self.data), np.int64)
        i = np.searchsorted(self.solid, at)
        return np.where(i < len(self.solid), self.solid[np.minimum(i, len(self.solid) - 1)], len(self.data))

    def key(self, i: int) -> str:
        raw = self.data[self.key_start[i] : self.key_end[i]].tobytes()
        return json.loads(b'"' + raw + b'"') if b"\\" in raw else raw.decode("utf-8", "replace")

    def keys_named(self, name: str) -> np.ndarray:
        """Indexes of the colons behind the key `name`."""
        want = np.frombuffer(name.encode(), np.uint8)
        size = self.key_end - self.key_start
        i = np.flatnonzero(size == len(want))
        for k, b in enumerate(want):
            i = i[self.data[self.key_start[i] + k] == b]
        # a key written with escapes is longer than its text
        odd = np.flatnonzero(size > len(want))
        if len(odd):
            slash = np.searchsorted(self.slashes, self.key_start[odd])
            odd = odd[(slash < len(self.slashes)) & (self.slashes[np.minimum(slash, len(self.slashes) - 1)] < self.key_end[odd])] if len(self.slashes) else odd[:0]
            more = [j for j in odd if self.key(j) == name]
            if more:
                i = np.sort(np.concatenate([i, np.array(more, np.int64)]))
        return i

    @property
    def slashes(self) -> np.ndarray:
        if not hasattr(self, "_slashes"):
            self._slashes = np.flatnonzero(self.data == 92)
        return self._slashes

    def last_of(self, name: str) -> tuple[np.ndarray, np.ndarray]:
        """(container, position of the value) of the key `name`, sorted by container; of repeated
        keys of one container the last."""
        i = self.keys_named(name)
        box, val = self.colon_in[i], self.value_at[i]
        order = np.lexsort((val, box))
        box, val = box[order], val[order]
        keep = np.ones(len(box), bool)
        keep[:-1] = box[1:] != box[:-1]
        return box[keep], val[keep]

    def end_of(self, at: int) -> int:
        """End of the value that starts at a position."""
        b = self.data[at]
        if b in (123, 91):
            # the next closing bracket of the level around it
            i = np.searchsorted(self.close_keys, (self.level[at] - 1) * self.width + at)
            return int(self.close_keys[i] % self.width) + 1
        if b == 34:
            return int(self.quotes[np.searchsorted(self.quotes, at) + 1]) + 1
        i = at
        while i < len(self.data) and self.data[i] not in b" \t\r\n,]}":
            i += 1
        return i


def _lookup(box: np.ndarray, val: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Value position for each container in `of`; -1 where it has none."""
    if not len(box):
        return np.full(len(of), -1, np.int64)
    i = np.minimum(np.searchsorted(box, of), len(box) - 1)
    return np.where(box[i] == of, val[i], -1)


def flatten_block(texts: list[bytes], values: bool = False) -> tuple[np.ndarray, list]:
    """(index of the record, rows) for a block of JSON texts; rows are column lists in the order of
    LINKS (and VALUES)."""
    good = np.array([is_json(t) for t in texts], bool)
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    ix = StructuralIndex(np.frombuffer(b"".join(texts), np.uint8), starts)
    data = ix.data
    width = 3 + (6 if values else 0)
    docs: list[int] = []
    rows: list[list] = [[] for _ in range(width)]

    def emit(doc: int, kind: str, key: str, parent: str, *more: object) -> None:
        docs.append(doc)
        for column, x in zip(rows, (kind, key, parent, *more)):
            column.append(x)

    top = ix.next_solid(starts[:-1])
    nodes = [i for i in np.flatnonzero(good & ix.balanced) if top[i] < starts[i + 1] and data[top[i]] == 123]
    at = top[nodes].astype(np.int64) if nodes else np.zeros(0, np.int64)
    doc = np.array(nodes, np.int64)
    path = ["0"] * len(nodes)
    up = [""] * len(nodes)
    children, boxes, attributes = ix.last_of("children"), ix.last_of("bounding_box"), ix.last_of("attributes")
    scalars = {f: ix.last_of(f) for f in SCALARS} if values else {}
    by_container = np.argsort(ix.colon_in, kind="stable")
    colon_of = ix.colon_in[by_container]
    in_open = np.argsort(ix.open_in, kind="stable")
    open_of = ix.open_in[in_open]

    def scalar(pos: int) -> object:
        if pos < 0:
            return None
        try:
            return json.loads(data[pos : ix.end_of(pos)].tobytes())
        except (ValueError, RecursionError):
            return None

    while len(at):
        box_at, attr_at, kids_at = _lookup(*boxes, at), _lookup(*attributes, at), _lookup(*children, at)
        fields = {f: _lookup(*scalars[f], at) for f in scalars}
        box_on = (box_at >= 0) & (data[np.maximum(box_at, 0)] != 110)
        attr_on = (attr_at >= 0) & (data[np.maximum(attr_at, 0)] == 123)
        lo, hi = np.searchsorted(colon_of, attr_at), np.searchsorted(colon_of, attr_at, "right")
        for i in range(len(at)):
            d, p = int(doc[i]), path[i]
            if values:
                got = {f: scalar(int(fields[f][i])) for f in fields}
                text = [x if x is None or isinstance(x, str) else json.dumps(x) for x in (got[f] for f in SCALARS[:3])]
                dep = got["depth"]
                dep = int(dep) if isinstance(dep, int) and not isinstance(dep, bool) and abs(dep) < 2**31 else None
                emit(d, "node", p, up[i], None, None, *text, dep)
            else:
                emit(d, "node", p, up[i])
            if box_on[i]:
                more = [None, data[box_at[i] : ix.end_of(int(box_at[i]))].tobytes().decode("utf-8", "replace"), None, None, None, None] if values else []
                emit(d, "box", p + "#box", p, *more)
            if attr_on[i]:
                last: dict[str, int] = {}
                for j in by_container[lo[i] : hi[i]]:
                    last[ix.key(j)] = int(ix.value_at[j])
                for name, pos in last.items():
                    if data[pos] != 110:
                        more = [name, data[pos : ix.end_of(pos)].tobytes().decode("utf-8", "replace"), None, None, None, None] if values else []
                        emit(d, "attribute", p + "@" + name, p, *more)
        first = np.where(kids_at >= 0, data[np.maximum(kids_at, 0)], 0)
        single = np.flatnonzero(first == 123)
        lists = np.flatnonzero(first == 91)
        lo, hi = np.searchsorted(open_of, kids_at[lists]), np.searchsorted(open_of, kids_at[lists], "right")
        owner = np.repeat(lists, hi - lo)
        span = np.concatenate([np.arange(a, b) for a, b in zip(lo, hi)]).astype(np.int64) if len(lists) else np.zeros(0, np.int64)
        kid = ix.opens[in_open[span]]
        owner, kid = owner[data[kid] == 123], kid[data[kid] == 123]
        base = kids_at[owner] * ix.width
        position = np.searchsorted(ix.comma_keys, base + kid) - np.searchsorted(ix.comma_keys, base)
        owner, kid, position = np.concatenate([owner, single]), np.concatenate([kid, kids_at[single]]), np.concatenate([position, np.zeros(len(single), np.int64)])
        up = [path[o] for o in owner]
        path = [f"{u}.{k}" for u, k in zip(up, position)]
        at, doc = kid, doc[owner]
    return np.array(docs, np.int64), rows


def flatten_records(df: DataFrame, id_col: str, json_col: str, values: bool = False) -> DataFrame:
    """Flat records of every JSON tree in json_col, each naming its parent.

    Result: id_col, record_kind (node, attribute, box), record_key, parent_key; with values=True
    also name, value, tag_name, element_id, text_content, depth. Null, empty and invalid JSON, a
    JSON null and roots that aren't objects give no rows. `children` may be a list (null entries
    take a position), a single object (position 0), null or missing; entries that are neither
    object nor null take a position and give no record. Of repeated keys the last counts. Repeated
    rows give repeated records; other columns are not read. No shuffle; memory is bounded by
    BLOCK_BYTES or one record, whichever is larger.
    """
    out = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *LINKS, *(VALUES if values else [])])
    kinds = [pa.string()] * 3 + ([pa.string()] * 5 + [pa.int32()] if values else [])
    names = [f.name for f in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.binary())
            block: list[bytes] = []
            index: list[int] = []
            size = 0
            for i in range(len(texts) + 1):
                t = texts[i].as_py() if i < len(texts) else None
                if block and (i == len(texts) or size + len(t or b"") > BLOCK_BYTES):
                    docs, rows = flatten_block(block, values)
                    for a in range(0, len(docs), 50_000):
                        take = pa.array(np.array(index, np.int64)[docs[a : a + 50_000]])
                        yield pa.RecordBatch.from_arrays([ids.take(take), *(pa.array(c[a : a + 50_000], k) for c, k in zip(rows, kinds))], names)
                    block, index, size = [], [], 0
                if t:
                    block.append(t)
                    index.append(i)
                    size += len(t)

    return spread(df.select(id_col, json_col)).mapInArrow(run, out)
