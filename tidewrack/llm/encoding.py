"""Texts decoded with the wrong character encoding: finding and restoring them.

Round-trip repair: a segment is re-encoded under a candidate legacy encoding and strictly decoded as
the encoding it may have been meant in; candidates count when the garbling cost drops by enough. For
nested layers the best candidates are tried again, any number of times, and the chain that ends in the
least cost is accepted. Where the intended encoding is UTF-8 and
the legacy one has single bytes, each span that reads as a UTF-8 sequence is decoded by itself, so
that segments which are garbled in part are repaired in part.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewrack.session import spread

#: Chains of repairs that are followed side by side, the least garbled ones.
BEAM = 6
#: Least drop of the cost, absolute and as a share, for a repair to be accepted: of text meant as
#: UTF-8, whose sequences hardly occur by chance, and of text meant in a legacy encoding.
DROP, SHARE = 1.0, 0.4
LEGACY_DROP, LEGACY_SHARE = 2.5, 0.7

#: Legacy encodings in which UTF-8 bytes may have been read, one byte each.
SINGLE = ("cp1252", "cp1251", "cp437", "mac_roman", "cp1250", "iso8859-2", "koi8-r", "cp866", "cp850", "cp1253", "cp1254")
#: Those with more bytes a character.
MULTI = ("gb18030", "cp932", "big5", "cp949", "euc_jp")
#: (read as, meant as) between legacy encodings.
LEGACY = (
    ("cp1252", "cp1251"), ("cp1252", "koi8-r"), ("cp1252", "cp1250"), ("cp1252", "iso8859-2"), ("cp1252", "gb18030"),
    ("cp1252", "cp932"), ("cp1252", "euc_jp"), ("cp1252", "big5"), ("cp1252", "cp949"), ("cp1252", "mac_roman"), ("cp1252", "cp437"), ("cp1252", "cp866"),
    ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp1251", "cp866"), ("cp866", "cp1251"), ("koi8-r", "cp866"), ("cp866", "koi8-r"),
    ("cp1251", "cp1252"), ("cp1251", "cp1250"), ("cp1250", "cp1252"), ("cp1250", "cp1251"), ("cp437", "cp1252"), ("mac_roman", "cp1252"), ("iso8859-2", "cp1252"),
    ("gb18030", "cp932"), ("gb18030", "big5"), ("cp932", "gb18030"), ("gb18030", "euc_jp"), ("cp932", "euc_jp"), ("big5", "gb18030"),
)


def _image(encoding: str) -> list[str]:
    """The character of each byte; bytes that the encoding leaves open stand for themselves."""
    return [bytes((b,)).decode(encoding, "ignore") or chr(b) for b in range(256)]


IMAGES = {e: _image(e) for e in (*SINGLE, *(a for a, _ in LEGACY if a not in MULTI))}
BYTES = {e: {c: b for b, c in reversed(list(enumerate(im)))} for e, im in IMAGES.items()}
# C1 controls are read as the bytes they are numbered by, whatever else stands for these bytes
for _of in BYTES.values():
    for _b in range(0x80, 0xA0):
        _of.setdefault(chr(_b), _b)


def _class(chars: list[str]) -> str:
    return "[" + "".join(map(re.escape, chars)) + "]"


def _sequences(encoding: str) -> re.Pattern:
    of: dict[int, list[str]] = {}
    for c, b in BYTES[encoding].items():
        of.setdefault(b, []).append(c)
    cls = lambda a, z: _class([c for b in range(a, z) for c in of.get(b, [])])
    cont = cls(0x80, 0xC0)
    return re.compile(f"{cls(0xC2, 0xE0)}{cont}|{cls(0xE0, 0xF0)}{cont}{{2}}|{cls(0xF0, 0xF5)}{cont}{{3}}")


UTF8 = {e: _sequences(e) for e in SINGLE}

LOST = "�"
_L, _S = "A-Za-zÀ-ÖØ-öø-ÿĀ-ɏ", "⌐⌠⌡─-▟∙√≈≡≤≥∩∞∂∑∏π∫Ω≠∆◊ﬁﬂƒ"
#: Garbling costs: weight, and what each match of it stands for.
COSTS = [
    (3.0, re.compile("[\x80-\x9f�-]")),
    (1.5, re.compile(f"(?<=[{_L}Ͱ-ӿ])[¡¢£¤¥¦¨©¬\xad®¯±²³´µ¶¸¹¼½¾¿‚„†‡ˆ‰‹›€™˜•]")),
    (1.5, re.compile("(?<=[ÂÃÄÅÐÑâÎÏРСГВв])[\xa0…»”“’«‘–—ºª·°§]")),
    (1.5, re.compile("[ÂÃ](?= )")),
    (1.5, re.compile("(?<![¶±¿¡\\w])[¶±¡¼½¾³¹²¦¯¬](?=[a-zà-ÿ])")),
    (1.5, re.compile(f"[{_S}](?=[{_L}{_S}])|(?<=[{_L}{_S}])[{_S}]|[╟-╬─-╞][^\x00-\x7f]")),
    (1.5, re.compile("[À-ÖØ-öø-ÿ]{3}")),
    (1.0, re.compile("[ƀ-ɏ]")),
    (1.0, re.compile("(?<=[a-zß-öø-ÿ])[À-ÖØ-Þ]|[а-яё][А-ЯЁ]")),
    (2.0, re.compile(f"[{_L}][Ͱ-׿؀-῿]|[Ͱ-῿][{_L}]|[Ͱ-Ͽ][Ѐ-ӿ]|[Ѐ-ӿ][Ͱ-Ͽ]")),
    (0.8, re.compile("[ЂЃѓЄЅѕІЈјЉљЊњЋћЌќЎЏџґҐ]")),
    (1.0, re.compile("[｡-ﾟ]")),
    (1.2, re.compile(f"[{_L}][぀-鿿가-힣]|[぀-鿿가-힣][{_L}]")),
]
#: A text without a match of this has no cost.
SUSPECT = re.compile("|".join(f"(?:{p.pattern})" for _, p in COSTS) + "|[Ѐ-ӿ]{2}|[一-鿿]")
CYRILLIC, HAN, KATAKANA = re.compile("[А-яёЁ]"), re.compile("[㐀-鿿]"), re.compile("[｡-ﾟ]")
#: The twelve most frequent letters of Russian.
FREQUENT = frozenset("оеаинтсрвлкмОЕАИНТСРВЛКМ")


def _common_han() -> frozenset[str]:
    """Level-1 characters of the Chinese and the Japanese national standards."""
    out = set()
    for hi in range(0xB0, 0xD8):
        out.update(bytes((hi, lo)).decode("gb2312", "ignore") for lo in range(0xA1, 0xFF))
    for hi in range(0xB0, 0xD0):
        out.update(bytes((hi, lo)).decode("euc_jp", "ignore") for lo in range(0xA1, 0xFF))
    return frozenset(c for c in out if len(c) == 1)


COMMON_HAN = _common_han()


def cost(text: str) -> float:
    """How garbled a text looks; 0 for ordinary text."""
    if text.isascii() or not SUSPECT.search(text):
        return 0.0
    total = sum(w * len(p.findall(text)) for w, p in COSTS)
    letters = CYRILLIC.findall(text)
    if len(letters) >= 20:
        rare = sum(c not in FREQUENT for c in letters) / len(letters)
        if rare > 0.52:
            total += (rare - 0.4) * len(letters)
    han = HAN.findall(text)
    if han:
        total += 0.4 * sum(c not in COMMON_HAN for c in han)
    return total


def _encode(text: str, encoding: str) -> bytes | None:
    if encoding in MULTI:
        try:
            return text.encode(encoding)
        except UnicodeEncodeError:
            return None
    of = BYTES[encoding]
    try:
        return bytes([of[c] for c in text])
    except KeyError:
        return None


def _spans(text: str, encoding: str) -> str:
    """Spans that read as UTF-8 sequences under a single-byte encoding, each strictly decoded."""

    def one(m: re.Match) -> str:
        try:
            return bytes([BYTES[encoding][c] for c in m.group()]).decode("utf-8")
        except UnicodeDecodeError:
            return m.group()

    return UTF8[encoding].sub(one, text)


RUN = re.compile("[^\x00-\x7f�]+")


def _runs(text: str, encoding: str) -> str:
    """Non-ASCII runs, each as UTF-8 read under a multi-byte encoding; a run next to lost characters
    may lack bytes at that end."""

    def one(m: re.Match) -> str:
        raw = _encode(m.group(), encoding)
        if raw is None:
            return m.group()
        lossy = text[m.start() - 1 : m.start()] == LOST or text[m.end() : m.end() + 1] in (LOST, "?")
        for a in range(3 if lossy else 1):
            for z in range(3 if lossy else 1):
                try:
                    return raw[a : len(raw) - z].decode("utf-8")
                except UnicodeDecodeError:
                    pass
        return m.group()

    return RUN.sub(one, text)


def _meant_utf8(text: str) -> Iterator[tuple[str, str]]:
    """(encoding, text read as UTF-8 under it)."""
    for e in SINGLE:
        yield e, _spans(text, e)
    if HAN.search(text) or KATAKANA.search(text):
        for e in MULTI:
            yield e, _runs(text, e)


def _meant_legacy(text: str) -> Iterator[tuple[str, str]]:
    for a, b in LEGACY:
        raw = _encode(text, a)
        if raw is not None:
            try:
                yield a, raw.decode(b)
            except UnicodeDecodeError:
                pass


def _wholly(text: str, encoding: str) -> bool:
    """Does every sign of a text that isn't ASCII belong to a UTF-8 sequence under an encoding?"""
    return encoding in UTF8 and UTF8[encoding].sub("", text).isascii()


def _steps(text: str, now: float) -> list[tuple[bool, float, str]]:
    """(in part only, cost, text) of the repairs of one layer: those that drop the cost by enough, and
    where none ends the garbling also those that leave nothing undecoded, which hardly occur by chance.
    Text meant in a legacy encoding is tried where there is none meant as UTF-8."""
    tried: dict[str, tuple[str, float]] = {}
    for e, t in _meant_utf8(text):
        if t != text and t not in tried:
            tried[t] = (e, cost(t))
    enough = [t for t, (_, c) in tried.items() if now - c >= max(DROP, SHARE * now)]
    if enough and (least := min(enough, key=lambda t: tried[t][1])) and tried[least][1] < DROP:
        return [(False, tried[least][1], least)]
    found = [(not whole, c, t) for t, (e, c) in tried.items() if (whole := _wholly(text, e)) or t in enough]
    if not found:
        for _, t in _meant_legacy(text):
            if t != text and now - (c := cost(t)) >= max(LEGACY_DROP, LEGACY_SHARE * now):
                found.append((True, c, t))
    return found


def repair(text: str) -> tuple[str, int]:
    """The restored text and the number of layers taken off; (text, 0) where nothing is accepted.

    Layers are taken off one at a time, along the BEAM best chains at once (those first that leave
    nothing undecoded, then the least garbled), as long as there are any; the chain with the least cost
    at its end is accepted if it drops the cost by enough, of equal ones the shortest."""
    start = cost(text)
    if start < DROP:
        return text, 0
    best, beam, layers, seen = (start, 0, text), [(False, start, text)], 0, {text}
    while beam and best[0] >= DROP:
        layers += 1
        grown = {x[2]: x for _, c, t in beam if c >= DROP for x in _steps(t, c) if x[2] not in seen}
        beam = sorted(grown.values(), key=lambda x: x[:2])[:BEAM]
        seen.update(grown)
        for _, c, t in beam:
            if c < best[0]:
                best = (c, layers, t)
    return (best[2], best[1]) if start - best[0] >= max(DROP, SHARE * start) else (text, 0)


def quoted(text: str, fixed: str) -> bool:
    """Is the garbling of a segment quoted on purpose: every sequence that the repair changes stands
    by itself, and what it stands for is named in the same segment?"""
    before, after = text.split(), fixed.split()
    if len(before) != len(after):
        return False
    own = {w.strip(".,;:()\"“”'") for w in before}
    changed = [(a.strip(".,;:()\"“”'"), b.strip(".,;:()\"“”'")) for a, b in zip(before, after) if a != b]
    return bool(changed) and all(len(b) <= 2 and b in own or not b for _, b in changed)


SEGMENT = re.compile(r"<[^<>]*>|\r?\n")


def mend(text: str | None, markup: bool = False) -> tuple[bool, str | None, bool]:
    """(garbled, text with what could be restored, wholly restored). With markup, character
    references stand for their characters, and the segments are what is between tags and line ends
    (tags too are mended)."""
    if not text or (text.isascii() and (not markup or "&" not in text)):
        return False, text, True
    plain = html.unescape(text) if markup and "&" in text else text
    if not SUSPECT.search(plain):
        return False, text, True
    found, whole, out, last = False, True, [], 0

    def segment(s: str) -> str:
        nonlocal found, whole
        if s.isascii() or not SUSPECT.search(s):
            return s
        fixed, layers = repair(s)
        if layers and not quoted(s, fixed):
            found = True
            whole &= LOST not in fixed and cost(fixed) < DROP
            return fixed
        if LOST in s and not layers:
            found, whole = True, False
        return s

    for m in SEGMENT.finditer(plain) if markup else ():
        out += (segment(plain[last : m.start()]), segment(m.group()))
        last = m.end()
    out.append(segment(plain[last:]))
    return (True, "".join(out), whole) if found else (False, text, True)


def find_garbled(df: DataFrame, id_col: str, fields: dict[str, tuple[str, bool]]) -> DataFrame:
    """(id_col, field, restored, complete): the garbled fields of each row with their restored text.

    fields maps a result name to (column, is it markup). complete tells that nothing garbled or lost
    is left. Null and empty texts are never cases; repeated rows give repeated cases; other columns
    aren't read. Texts that quote garbled sequences beside what they stand for aren't cases. No
    shuffle; whole texts are processed, one at a time.
    """
    names = list(fields)
    schema = T.StructType([
        T.StructField(id_col, df.schema[id_col].dataType), T.StructField("field", T.StringType()),
        T.StructField("restored", T.StringType()), T.StructField("complete", T.BooleanType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, field, text, done = [], [], [], []
            for k, name in enumerate(names):
                column = batch.column(1 + k)
                for i in range(batch.num_rows):
                    hit, fixed, whole = mend(column[i].as_py(), fields[name][1])
                    if hit:
                        rows.append(i)
                        field.append(name)
                        text.append(fixed)
                        done.append(whole)
            ids = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(field, pa.string()), pa.array(text, pa.string()), pa.array(done, pa.bool_())], schema.names)

    chosen = df.select(F.col(id_col), *(F.col(c).alias(f"_{n}") for n, (c, _) in fields.items()))
    return spread(chosen).mapInArrow(run, schema)
