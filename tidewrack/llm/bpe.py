"""Byte-level BPE encoding by a lazily determinised finite-state transducer.

A merge list fixes, for every prefix of a piece of text, one last token of the prefix's encoding:
the token t that ends there such that the last token before t and t stay apart under the merges.
So encoding is a left-to-right scan. The transducer's state is the set of prefixes from which a
longer token may still end (the lookahead, bounded by the longest token), each with the tokens that
lead to it beyond what all of them share. Whatever they share is emitted on the transition. States
and transitions are built when a text first needs them and are kept, as are whole pieces.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidewrack.session import spread

IDS = T.ArrayType(T.IntegerType())

#: Entries kept of each memo; one that is full is emptied, which changes no result.
MEMO = 400_000
TEXT_BYTES = 4_000_000


def byte_letters() -> dict[str, int]:
    """The letters that stand for the 256 bytes in the vocabulary file: printable Latin-1 bytes
    stand for themselves, the others follow from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def _other_numbers() -> str:
    """A character class body for the numbers that are neither letters nor decimal digits."""
    found = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isnumeric() and not c.isalpha() and not c.isdecimal()]
    out, start = [], 0
    for i in range(1, len(found) + 1):
        if i == len(found) or ord(found[i]) != ord(found[i - 1]) + 1:
            out.append(found[start] + ("-" + found[i - 1] if i - 1 > start else ""))
            start = i
    return "".join(out)


def piece_pattern() -> re.Pattern:
    """The public splitting rule of the vocabulary, for the re module: contractions, letters,
    numbers, other signs (each with one space before), then spaces."""
    more = _other_numbers()
    letters, numbers = f"[^\\W\\d_{more}]", f"[\\d{more}]"
    signs = f"(?:[^\\w{SPACE}{more}]|_)"
    return re.compile(f" ?{letters}+|'s|'t|'re|'ve|'m|'ll|'d| ?{numbers}+| ?{signs}+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


def chunk_pattern() -> re.Pattern:
    """The coarser split between spaces: no piece crosses its borders, and a piece within a chunk
    doesn't depend on what is around the chunk."""
    return re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


class Vocabulary:
    """Tokens and merges of a byte-level BPE file (the JSON of the tokenizers library)."""

    def __init__(self, source: bytes):
        whole = json.loads(source)
        model = whole["model"]
        letters = byte_letters()
        vocab: dict[str, int] = model["vocab"]
        special = {t["id"] for t in whole.get("added_tokens", []) if t.get("special")}
        self.bytes: dict[int, bytes] = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if i not in special}
        self.ids: dict[bytes, int] = {b: i for i, b in self.bytes.items()}
        self.merge: dict[tuple[int, int], int] = {}
        self.rank: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.merge[x, y] = z
            self.rank.setdefault(z, r)
            self.halves.setdefault(z, (x, y))
        self.starts: set[bytes] = {t[:k] for t in self.ids for k in range(1, len(t))}

    def apart(self, left: int, right: int) -> bool:
        """Does the encoding of left + right stay (left, right)? Undo the merges of both tokens
        from the last one made; at each step a merge across the border that would have come before
        the step undone would have broken them."""
        far = sys.maxsize
        limit = far
        while True:
            joined = self.merge.get((left, right))
            if joined is not None and self.rank[joined] < limit:
                return False
            rl, rr = self.rank.get(left, -1), self.rank.get(right, -1)
            if rl < 0 and rr < 0:
                return True
            # of merges on both sides the later is undone; in a tie the right one, made after the left
            if rl > rr:
                limit, left = rl, self.halves[left][1]
            else:
                limit, right = rr + 1, self.halves[right][0]


class Transducer:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.pattern, self.chunk = piece_pattern(), chunk_pattern()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.states: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}
        self._reset()

    def _reset(self) -> None:
        start = (None, ((b"", ()),))
        self.states[:] = [start]
        self.number.clear()
        self.number[start] = 0
        self.moves.clear()

    def _apart(self, left: int, right: int) -> bool:
        ok = self.pairs.get((left, right))
        if ok is None:
            if len(self.pairs) > MEMO:
                self.pairs.clear()
            ok = self.pairs[left, right] = self.v.apart(left, right)
        return ok

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The transition of a state over a byte, built and kept."""
        last, live = self.states[state]
        ids, starts, c, kept, ending = self.v.ids, self.v.starts, bytes((byte,)), [], None
        for part, way in live:
            part += c
            if ending is None:
                t = ids.get(part)
                if t is not None:
                    before = way[-1] if way else last
                    if before is None or self._apart(before, t):
                        ending = (*way, t)
            if part in starts:
                kept.append((part, way))
        if ending is None:
            raise ValueError(f"no token ends at byte {byte}: the vocabulary lacks single bytes")
        kept.append((b"", ending))
        shared = 0
        if kept[0][1]:
            ways = [w for _, w in kept]
            least, first = min(map(len, ways)), ways[0]
            while shared < least and all(w[shared] == first[shared] for w in ways):
                shared += 1
        out = ending[:shared]
        last = out[-1] if out else last
        if all(len(w) > shared for _, w in kept):
            last = None  # no later token borders on it
        new = (last, tuple((p, w[shared:]) for p, w in kept))
        full = len(self.moves) > MEMO
        if full:
            self._reset()
        i = self.number.get(new)
        if i is None:
            i = self.number[new] = len(self.states)
            self.states.append(new)
        move = (i, out)
        if not full:  # else the state's number is of the memo that was emptied
            self.moves[state << 8 | byte] = move
        return move

    def encode_bytes(self, data: bytes) -> tuple[int, ...]:
        """Tokens of one piece."""
        out: list[int] = []
        state, moves = 0, self.moves
        for b in data:
            m = moves.get(state << 8 | b) or self._move(state, b)
            state = m[0]
            if m[1]:
                out += m[1]
        out += self.states[state][1][-1][1]
        return tuple(out)

    def _encode_chunk(self, chunk: str) -> tuple[int, ...]:
        long: list[int] = []
        for w in self.pattern.findall(chunk):
            ids = self.pieces.get(w)
            if ids is None:
                ids = self.encode_bytes(w.encode())
                if len(w) <= 24:
                    self._keep(w, ids)
            long += ids
        out = tuple(long)
        if len(chunk) <= 32:
            self._keep(chunk, out)
        return out

    def _keep(self, piece: str, ids: tuple[int, ...]) -> None:
        if len(self.pieces) >= MEMO:
            self.pieces.clear()
        self.pieces[piece] = ids

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        get, make = self.pieces.get, self._encode_chunk
        for w in self.chunk.findall(text):
            out += get(w) or make(w)
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.decode_stream(ids))

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as it becomes certain: a UTF-8 state machine (bytes still due, code point so far,
        allowed range of the next byte) runs over the tokens' bytes. Bytes that aren't UTF-8 give
        U+FFFD."""
        due, point, low, high = 0, 0, 0x80, 0xBF
        for i in ids:
            out: list[str] = []
            for b in self.v.bytes[i]:
                if due:
                    if low <= b <= high:
                        due, point, low, high = due - 1, point << 6 | b & 0x3F, 0x80, 0xBF
                        if not due:
                            out.append(chr(point))
                        continue
                    out.append("�")
                    due = 0
                if b < 0x80:
                    out.append(chr(b))
                elif 0xC2 <= b <= 0xF4:
                    due = 1 + (b >= 0xE0) + (b >= 0xF0)
                    point = b & (0x3F >> due)
                    low = {0xE0: 0xA0, 0xF0: 0x90}.get(b, 0x80)
                    high = {0xED: 0x9F, 0xF4: 0x8F}.get(b, 0xBF)
                else:
                    out.append("�")
            if out:
                yield "".join(out)
        if due:
            yield "�"


_KEPT: dict[int, Transducer] = {}


def _transducer(shared) -> Transducer:
    """One transducer per worker process and vocabulary, so that what a task learns serves the next."""
    key = hash(shared.value)
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = Transducer(Vocabulary(shared.value))
    return _KEPT[key]


def encode(df: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """(id_col, out_col): token ids of each whole text, one row per input row.

    Null and empty texts give the empty list. No special tokens are added and strings that look
    like them are ordinary text. Null ids and repeated rows are kept; other columns aren't read.
    No shuffle; the vocabulary file (of fixed size) is read on the driver and broadcast.
    """
    with open(vocabulary_path, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField(out_col, IDS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = _transducer(shared)
        for batch in batches:
            i, n = 0, batch.num_rows
            while i < n:
                flat: list[int] = []
                ends, start = [0], i
                while i < n and len(flat) < TEXT_BYTES // 4:
                    text = batch.column(1)[i].as_py()
                    if text:
                        flat += fst.encode(text)
                    ends.append(len(flat))
                    i += 1
                ids = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.array(flat, np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, i - start), ids], [id_col, out_col])

    return spread(df.select(id_col, text_col)).mapInArrow(run, schema)


def decode(df: DataFrame, vocabulary_path: str, id_col: str = "doc_id", ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """(id_col, out_col): the text of each list of ids; null for null, '' for the empty list.
    Ids that the vocabulary lacks are an error."""
    with open(vocabulary_path, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField(out_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = _transducer(shared)
        for batch in batches:
            texts = [None if x is None else fst.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, out_col])

    return df.select(id_col, ids_col).mapInArrow(run, schema)
