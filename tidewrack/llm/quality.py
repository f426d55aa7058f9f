"""Text statistics of each document, and the documents that aren't prose.

Counts of words, symbols, line ends and common words are joined by repetition statistics (duplicate
lines and paragraphs, characters covered by the most frequent word n-grams). Characters in running
sentences are counted so: wrapped lines are joined first, then bullets, rows of short cells, log and
code lines are set apart, and what is left counts sentence by sentence by its words, function words
and signs. Combined rules over the statistics decide: what share is prose, how much of a text comes
back (lists, boilerplate), and whether there are lists or rows at all.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewrack.llm.signs import word_rows
from tidewrack.session import spread

#: Share of characters in running sentences below which a text isn't prose.
PROSE = 0.5
#: Least words of a sentence, and least share of function words for the longest list of words; of a
#: shorter list, which covers less of a text, as much less as it is shorter.
WORDS, FUNCTION = 6, 0.1
#: Combined rules: of texts with this share of prose at most, those are no prose in which this share of
#: lines or of paragraphs comes back, or of characters is covered by one phrase of four words.
REPEATED_PROSE, REPEATED = 0.75, 0.25
#: And those are prose still, with this share of prose at least, that hold no lists, rows or repetition
#: and have lines of this width.
MIXED_PROSE, MIXED_WIDTH = 0.35, 40

WORD = re.compile(r"[^\W\d_]+")
SYMBOL = re.compile(r"[^\w\s.,!?'\"“”’‘«»„…、。，！？；：:;()\-–—·「」『』（）]")
PARAGRAPH = re.compile(r"\n\s*\n")
#: Marks at the end of a sentence or line, and what may stand behind them.
ENDS, BEHIND = frozenset(".!?…。！？:;：；"), " \t\n\r\"'”“’»)]」』\u00a0\u3000"
BULLET = re.compile(r"\s*(?:[-*+•·◦▪‣]|\(?\d{1,4}[.)]|\[[ xX]?\]|[a-zA-Z][.)])\s+\S")
LOG = re.compile(r"\s*(?:\[?\d{2,4}[-/:.]\d{1,2}[-/:.]\d{1,4}\b.*\b(?:INFO|WARN(?:ING)?|ERROR|DEBUG|TRACE|FATAL|GET|POST|PUT)\b|(?:INFO|WARN(?:ING)?|ERROR|DEBUG|TRACE|FATAL)\b|\S+ \S+ \S+ \[\d)")
CODE = re.compile(r"^\s*(?:\S+\s+){0,8}\S*[{}]\s*(?:else\b.*)?$|^[^.!?]*[()=<>\[\]\"'$_/\\][^.!?]*;\s*$|[{}]\)?;|^\s*(?:def|class|return|import|from|if|for|while|else|elif|try|except|function|var|let|const|public|private|static|void|int|fn|func|package|use|struct|end)\b[^.?!]*[:{};()=]\s*$|^\s*(?://|/\*|#include|#!|\}\)?)|^\s*[\w.\[\]$]+(?:\([^)]*\))?\s*(?:=|\+=|:=|=>|->)\s*\S|^\s*[\w.$]+\([^)]*\);?\s*$|^\s*</?\w+[^>]*>\s*$|^\s*&\w+;|^\s*[.#@]?[\w-]+\s*\{")
CODE_SIGN = re.compile(r"[{}=<>&;#$/():]|^\s*\.")
LINK = re.compile(r"\s*\w+://\S+\s*$")
SEPARATOR = re.compile(r"[\t|;,；，、]| {3,}")
HARD = re.compile(r"\t|\||;| {3,}|；")
WIDE = re.compile("[぀-ヿ㐀-鿿]")
WIDE_SIGN = re.compile("[，、。！？はがをにで了在的]")
STOP = re.compile(r"[.!?…][\"'”“’»)」』]*\s+|[。！？][\"'”“’»)」』]*\s*")
#: Vowels of the Latin and Cyrillic alphabets.
VOWELS, MORE_VOWELS = "aeiouy", "àáâãäåæèéêëìíîïòóôõöøùúûüýœąęаеёиоуыэюяієїαεηιουω"

STATS = [
    ("has_text", pa.bool_(), T.BooleanType()), ("n_words", pa.int64(), T.LongType()), ("mean_word_length", pa.float64(), T.DoubleType()), ("symbol_ratio", pa.float64(), T.DoubleType()),
    ("punctuated_lines", pa.float64(), T.DoubleType()), ("common_words", pa.float64(), T.DoubleType()), ("duplicate_lines", pa.float64(), T.DoubleType()),
    ("duplicate_paragraphs", pa.float64(), T.DoubleType()), ("top_2gram_chars", pa.float64(), T.DoubleType()), ("top_3gram_chars", pa.float64(), T.DoubleType()),
    ("top_4gram_chars", pa.float64(), T.DoubleType()), ("list_share", pa.float64(), T.DoubleType()), ("row_share", pa.float64(), T.DoubleType()),
    ("prose_share", pa.float64(), T.DoubleType()), ("line_width", pa.float64(), T.DoubleType()),
]


class Lists:
    """Word lists by language."""

    def __init__(self, rows: list):
        self.all = frozenset(w for _, w in rows)
        self.by = {k: frozenset(w for lang, w in rows if lang == k) for k in {lang for lang, _ in rows}}
        most = max(map(len, self.by.values()), default=1)
        self.bound = {k: FUNCTION * len(own) / most for k, own in self.by.items()}
        self.least = min(self.bound.values(), default=FUNCTION)

    def enough(self, words: list[str]) -> bool:
        """Are there as many function words as sentences of some language have?"""
        n = len(words)
        hits = list(filter(self.all.__contains__, words))
        return len(hits) >= self.least * n and any(sum(map(own.__contains__, hits)) >= self.bound[k] * n for k, own in self.by.items())


def ends(line: str) -> bool:
    """Does a line end in a mark of the end of a sentence or clause?"""
    return line.rstrip(BEHIND)[-1:] in ENDS and line != ""


def unwrap(lines: list[str]) -> list[str]:
    """Lines with the continuations of wrapped sentences joined. A line is wrapped if it ends within
    a sentence, near the width of its paragraph."""
    out: list[str] = []
    widest = 0
    last = ""
    for k, line in enumerate(lines):
        s = line.strip()
        if not s:
            widest, last = 0, ""
            out.append("")
            continue
        if not last:
            widest = 0
            for other in lines[k:]:
                if not other.strip():
                    break
                widest = max(widest, len(other.strip()))
        joins = last and len(last) >= max(28, 0.6 * min(widest, 120)) and widest <= 120 and not HARD.search(last)
        if joins and (not ends(last) or len(last) >= 0.7 * widest and s[0].islower()):
            out[-1] += " " + s
        elif joins and ends(last) and widest >= 30:
            out[-1] += " " + s
        else:
            out.append(s)
        last = s
    return out


def is_wide_sentence(s: str) -> bool:
    return len(WIDE.findall(s)) >= 8 and len(s) >= 12 and bool(WIDE_SIGN.search(s))


def has_shape(s: str, words: list[str]) -> bool:
    """Could a piece of text be a sentence, by the number, length and vowels of its words?"""
    letters = sum(map(len, words))
    if len(words) < WORDS or letters < 0.6 * (len(s) - s.count(" ")) or not 2.2 * len(words) <= letters <= 18 * len(words):
        return False
    # words stand between spaces; those of encoded data stand between signs
    if len(s.split()) < 0.6 * len(words):
        return False
    low = s.lower()
    vowels = sum(map(low.count, VOWELS))
    return vowels >= 0.22 * letters or not s.isascii() and vowels + sum(map(low.count, MORE_VOWELS)) >= 0.22 * letters


def shares(text: str, lists: Lists) -> tuple[float, float, float]:
    """(bulleted, in rows, in running sentences) as shares of the characters that aren't spaces."""
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    wide = WIDE.search(text) is not None
    total = bullets = rows = prose = 0
    rest: list[str] = []
    for line in lines:
        size = len("".join(line.split()))
        total += size
        if not size:
            rest.append("")
            continue
        if BULLET.match(line):
            bullets += size
            rest.append("")
            if ends(line.strip()) and len(line.split()) > WORDS:
                bullets -= size
                rest[-1] = line.strip().split(None, 1)[1]
                rest.append("")
            continue
        if LOG.match(line) or "://" in line and LINK.match(line) or CODE_SIGN.search(line) and CODE.search(line):
            rows += size
            rest.append("")
            continue
        cells = 1 + len(SEPARATOR.findall(line))
        if cells >= 3:
            n = len(line.split()) + line.count(",") * (", " not in line) if not (wide and WIDE.search(line)) else len(line) / 3
            hard = len(HARD.findall(line))
            if hard >= 2 and n <= 3.2 * (hard + 1) or n <= 2.6 * cells and (cells >= 8 or cells >= 4 and not ends(line.strip().rstrip(";:"))):
                rows += size
                rest.append("")
                continue
        rest.append(line)
    open_blocks: list[tuple[list[str], int]] = []
    for block in unwrap(rest):
        if not block:
            continue
        own: list[str] = []
        size = 0
        for s in STOP.split(block):
            if len(s) < 12:
                continue
            n = len(s) - s.count(" ") + 1  # the mark at its end
            if wide and len(WIDE.findall(s)) > 0.4 * len(s):
                prose += n if is_wide_sentence(s) else 0
                continue
            words = WORD.findall(s.lower())
            if has_shape(s, words):
                own += words
                size += n
        if own:
            open_blocks.append((own, size))
    # function words are few in a sentence of some languages, so all sentences count together where
    # they have enough; else each block for itself
    if open_blocks:
        if len(open_blocks) == 1 or lists.enough([w for own, _ in open_blocks for w in own]):
            prose += sum(n for _, n in open_blocks) if len(open_blocks) > 1 or lists.enough(open_blocks[0][0]) else 0
        else:
            prose += sum(n for own, n in open_blocks if lists.enough(own))
    total = max(total, 1)
    return bullets / total, rows / total, prose / total


def _coverage(words: list[str], letters: int) -> list[float]:
    """For n = 2, 3, 4: characters in all occurrences of the most frequent n-gram that occurs more
    than once, as a share; ties go to the longest."""
    out = [0.0, 0.0, 0.0]
    for k in range(3):
        grams = Counter(zip(*(words[j:] for j in range(k + 2))))
        most = max(grams.values(), default=0)
        if most < 2:
            break  # nor does a longer n-gram occur twice
        out[k] = min(1.0, most * max(sum(map(len, g)) for g, c in grams.items() if c == most) / max(letters, 1))
    return out


def statistics(text: str | None, lists: Lists) -> tuple:
    """The values of STATS; zeros for null, empty and blank texts."""
    if not text or not text.strip():
        return (False, 0, *(0.0,) * (len(STATS) - 2))
    words = WORD.findall(text.lower())
    n, letters = len(words), sum(map(len, words))
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    paragraphs = [x.strip() for x in PARAGRAPH.split(text.replace("\r\n", "\n")) if x.strip()]
    solid = max(len("".join(text.split())), 1)
    dup = lambda xs: 1 - len(set(xs)) / len(xs)
    return (
        True, n, letters / max(n, 1), len(SYMBOL.findall(text)) / solid, sum(map(ends, lines)) / len(lines),
        sum(map(lists.all.__contains__, words)) / max(n, 1), dup(lines), dup(paragraphs), *_coverage(words, letters), *shares(text, lists), solid / len(lines),
    )


def text_statistics(docs: DataFrame, common_words: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, STATS): one row per row of docs, for the whole text.

    Null, empty and blank texts have zeros. Repeated rows and null ids are kept; other columns aren't
    read. common_words(lang, word) is a small table of fixed size. No shuffle.
    """
    lists = Lists(word_rows(common_words))
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(n, t) for n, _, t in STATS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [statistics(b.column(1)[i].as_py(), lists) for i in range(b.num_rows)]
            columns = zip(*out) if out else [()] * len(STATS)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, (_, k, _) in zip(columns, STATS))], schema.names)

    return spread(docs.select(id_col, text_col)).mapInArrow(run, schema)


def not_prose() -> Column:
    """The combined rules, over the columns of STATS; never true of texts without text."""
    c = F.col
    repeated = F.greatest("duplicate_lines", "duplicate_paragraphs", F.when(c("n_words") >= 100, c("top_4gram_chars")).otherwise(0.0)) >= REPEATED
    lists = c("list_share") + c("row_share")
    mixed = (c("prose_share") >= MIXED_PROSE) & (lists < 0.05) & (c("duplicate_lines") < 0.1) & (c("line_width") >= MIXED_WIDTH)
    return c("has_text") & (((c("prose_share") < PROSE) & ~mixed) | (repeated & (c("prose_share") < REPEATED_PROSE)))


def find_not_prose(docs: DataFrame, common_words: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col): documents that are no prose by the combined rules: less than PROSE of the characters in
    running sentences and not only prose of several kinds, or less than REPEATED_PROSE and much that comes
    back. Null, empty and blank texts aren't cases."""
    return text_statistics(docs, common_words, id_col, text_col).where(not_prose()).select(id_col)
