"""Template residue, filler and error pages in place of real content.

Records are aligned by their lines: what a line takes from its own record (address, its parts and
codes, site name, numbers) is a slot, the rest the template. A line that many pages share and that
hardly occurs beside content of a page's own is a whole-page error or script notice. The copies of an
article under several addresses are one page, and so are the spellings of one address. The titles of a
site are aligned with each other, and so are lines of its main texts, which induces their slots too.
Slots that are blank, that hold a variable's name or what other records hold as well, and texts made of
filler words, are unfilled.
"""

from __future__ import annotations

import re
from functools import lru_cache

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewrack.llm.pagetree import Page, areas, main_area
from tidewrack.llm.signs import SENTENCE, STOP, width
from tidewrack.session import store

#: A line on more pages than this isn't a page's own.
RARE = 2
#: A template line needs this many pages (a default as many sites), and this share of them without content of their own.
ADDRESSES, BARE = 3, 0.7
#: Width of the own sentences from which on a text is an article, known by its longest line wherever
#: it stands. Whole-page notices are shorter.
ARTICLE = 500
#: Share of aligned lines that hold a word of their template, and least number of such words.
NEARLY_ALL, CONSTANTS = 0.9, 3
#: Shortest line that counts as content of a page's own.
OWN_WIDTH = 30

VARIABLE = re.compile(
    r"\{\{.*?\}\}|\{%.*?%\}|\$\{[^{}]*\}|#\{[^{}]*\}|<%.*?%>|<\?(?:php|=).*?\?>|%%[\w.-]+%%|@@[\w.-]+@@|\[\[[\w.|-]+\]\]|(?<!\w)__[A-Za-z][\w.-]*__(?!\w)"
    r"|\[[\w.]+\|[\w ]*\]|(?<![\w{$#])\{[A-Za-z]\w*(?:[._]\w+)+\}|\[(?:your|insert|enter|add)\b[^\]]*\]|\b(?:TODO|FIXME|TBD)\b\s*:[^.!?]*",
    re.I,
)
#: Without one of these a text holds no variable.
VARIABLE_SIGN = re.compile(r"[{<%@\[_]|TODO|FIXME|TBD", re.I)
FILLER = re.compile(r"\s*lorem ipsum\b", re.I)
FULL_STOP, MARKS = re.compile(r"[.!?](?:\s|$)"), re.compile(r"[|#/;:,•·]")
LATIN = re.compile(r"[A-Za-zÀ-ɏ]+")
PART = re.compile(r"[^\W_]+")
TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_+")
DIGITS = re.compile(r"\d+")


def unfilled_share(text: str) -> float:
    """Share of a text's characters that belong to unfilled variables; nearly 1 where only joints
    are left beside them."""
    if not VARIABLE_SIGN.search(text):
        return 0.0
    found = sum(len(m.group()) for m in VARIABLE.finditer(text))
    return found / max(len(text.strip()), 1) if found else 0.0


def names_variable(title: str) -> bool:
    """Does a title hold a variable, with hardly any words beside it but those of a site's name?"""
    rest = VARIABLE.sub("\0", title)
    if rest == title:
        return False
    return sum(len(PART.findall(x)) for x in re.split(r"\s[|–—-]\s", rest) if "\0" in x) <= 2


def tokens(text: str) -> list[str]:
    """Words and signs, lower case, digits as 0."""
    return TOKEN.findall(DIGITS.sub("0", text.lower()))


def skeleton(line: str, own: set[str]) -> tuple[str, bool]:
    """(template of a line, does it name its own address?). Of longer lines that are no sentences the
    frame of their first and last words is the template, what is between them its slot."""
    out: list[str] = []
    named, ends = False, bool(STOP.search(line))
    line = line.lower()
    if own.isdisjoint(PART.findall(line)):
        out = DIGITS.sub("0", line).split()
        line = ""
    for w in line.split():
        parts = PART.findall(w)
        if parts and own.issuperset(parts):
            # several parts of the address, or a code in it that is no word
            named |= len(parts) > 1 or "/" in w
            if not out or out[-1] != "~":
                out.append("~")
        else:
            out.append(DIGITS.sub("0", w))
    if len(out) >= 6 and not ends:
        out = [*out[:2], "~", *out[-2:]]
    return " ".join(out), named


def is_filler(text: str, common: frozenset[str]) -> bool:
    """Sentences of Latin letters without any frequent word of any language."""
    if FILLER.match(text):
        return True
    if not text.isascii():
        return False
    w = LATIN.findall(text.lower())
    if len(w) < 8 or len(FULL_STOP.findall(text)) * 60 < len(w) or len(MARKS.findall(text)) > 0.25 * len(w) or sum(map(len, w)) < 0.7 * len(text):
        return False
    # a filler vocabulary is small: words come back, word pairs don't
    pairs = len(set(zip(w, w[1:]))) / max(len(w) - 1, 1)
    return sum(x in common for x in w) <= 0.02 * len(w) and pairs > 0.8


#: What TEMPLATE of read_pages() has of a page.
_LINE = [("template", T.LongType()), ("named", T.BooleanType()), ("own", T.BooleanType())]
_SLOT = [("key", T.LongType()), ("words", T.ArrayType(T.LongType())), ("share", T.DoubleType())]
_rows = lambda fields: T.ArrayType(T.StructType([T.StructField(*f) for f in fields]))
RECORD = T.StructType([
    T.StructField("site", T.StringType()), T.StructField("title", T.StringType()), T.StructField("title_flag", T.BooleanType()), T.StructField("title_fits", T.BooleanType()),
    T.StructField("text_flag", T.BooleanType()), T.StructField("lines", _rows(_LINE)), T.StructField("article", T.LongType()), T.StructField("slots", _rows(_SLOT)),
])


def hash_of(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - 2**63


#: Of a coded word the lowest bits: is it a word (else a sign), is it a frequent one; above them these bits
#: count its occurrences in the line, and the rest is its hash.
WORD, FREQUENT, TIMES = 1, 2, (2**20 - 1) << 2
HASH = 22


@lru_cache(1 << 16)
def code_of(word: str, common: frozenset[str]) -> int:
    return hash_of(word) >> HASH << HASH | WORD * bool(re.search(r"\w", word)) | FREQUENT * (word in common)


def coded(found: list[str], common: frozenset[str]) -> list[int]:
    """tokens() as numbers, of which no two are equal."""
    last: dict[str, int] = {}
    out = []
    for w in found:
        c = last.get(w)
        if c is None:
            c = code_of(w, common)
        elif c & TIMES != TIMES:
            c += TIMES & -TIMES
        last[w] = c
        out.append(c)
    return out


def read_record(url: str, title: str, page: Page, common: frozenset[str]) -> tuple:
    """The values of RECORD: the site, the title, does it hold a variable, does it begin with a line of
    the page, is the main text unfilled or filler; the lines as (hash of the template, names its own
    address, could be content of the page's own); the hash of an article's longest line, the same for all
    its copies, and None for texts shorter than ARTICLE; and of main texts of any length the coded words of the
    lines with the share that they make up of it and of sentences elsewhere, keyed by site, element and
    first word."""
    address = re.sub(r"^\w+://", "", url.lower())
    own, site = set(PART.findall(address)), re.sub(r"^www\.", "", address.split("/")[0])
    spaces = areas(page)
    main = main_area(page)
    empty_text = False
    texts = [x.text for x in page.lines]
    size = 1
    if main is not None:
        rows = [texts[i] for i in main.lines]
        size = max(sum(map(len, rows)), 1)
        empty = sum(len(r) * min(1.0, 1.6 * unfilled_share(r)) for r in rows)
        fill = sum(len(r) for r in rows if is_filler(r, common))
        empty_text = empty + fill >= 0.5 * size
    lines = []
    beside = 0
    sentences: dict[int, int] = {}
    for a in spaces.values():
        article = a.headline or not a.aside and a.linked <= 0.4 * a.size and sum(bool(SENTENCE.search(texts[i])) for i in a.lines) >= 3
        for i in a.lines:
            line = page.lines[i]
            if line.linked > 0.5 * line.size:
                continue
            text, named = skeleton(texts[i], own)
            if text != "~":
                template, n = hash_of(text), width(texts[i])
                lines.append((template, named, article and not named and n >= OWN_WIDTH))
                if lines[-1][2] and SENTENCE.search(texts[i]):
                    sentences[template] = n
                    beside += 0 if a is main else len(texts[i])
    longest = max(sentences, key=lambda t: (sentences[t], t)) if sum(sentences.values()) >= ARTICLE else None
    slots = []
    if main is not None:
        for i in main.lines:
            found, e = tokens(texts[i]), page.elements[page.lines[i].block]
            if len(found) >= CONSTANTS:
                slots.append((hash_of(f"{site} {e.tag}.{e.name} {found[0]}"), coded(found, common), len(texts[i]) / (size + beside)))
    head = " ".join(title.lower().split())
    fits = bool(head) and any(len(x) > 1 and head.startswith(x) for x in (" ".join(t.lower().split()) for t in texts))
    return site, title, names_variable(title), fits, empty_text, lines, longest, slots


def template_pages(pages: DataFrame) -> DataFrame:
    """(id): pages that are whole-page templates. pages(id, page, lines) is stored, of `page` the copies
    of an article have one value and so have the spellings of an address; it is what is counted."""
    line = pages.select("id", "page", F.explode("lines").alias("l")).select("id", "page", "l.template", "l.named", "l.own")
    per = line.select("template", "page").distinct().groupBy("template").agg(F.count(F.lit(1)).alias("pages"))
    rare = per.where(F.col("pages") <= RARE).select("template")
    with_own = line.where("own").join(rare, "template", "left_semi").select("id").distinct()
    bare = line.join(with_own, "id", "left_anti")
    bare_per = bare.select("template", "page").distinct().groupBy("template").agg(F.count(F.lit(1)).alias("bare"))
    notices = bare_per.join(per, "template").where((F.col("pages") >= ADDRESSES) & (F.col("bare") >= BARE * F.col("pages"))).select("template")
    return bare.where("named").select("id").unionAll(bare.join(notices, "template", "left_semi").select("id")).distinct()


def unfilled_slots(pages: DataFrame) -> DataFrame:
    """(id): pages of whose main text, whatever its length, half or more is lines with unfilled slots.

    Lines of one site that stand in the same kind of element and begin alike are aligned: words that
    nearly all of them hold, and as often, are the template, what is left of a line is its slots. A line is
    unfilled if its slots are blank where most lines have something in them, or hold a default, which is what
    lines of several sites hold. Where slots have more words than the template, frequent words aside, the copies
    of an article are one page, as else its paragraphs would be defaults. The aligned lines are stored."""
    bits = lambda w, mask: w.bitwiseAND(F.lit(mask))
    telling = lambda w: bits(w, WORD | FREQUENT) == WORD
    s = pages.select("id", "page", "address", "site", F.explode("slots").alias("s")).select("id", "page", "address", "site", "s.key", "s.words", "s.share")
    n = s.select("key", "address").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= ADDRESSES)
    held = s.select("key", "address", F.explode("words").alias("w")).distinct().groupBy("key", "w").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= NEARLY_ALL * ADDRESSES)
    # at most as many words as a page's lines have
    w = F.col("w")
    fixed = held.join(n, "key").where(F.col("c") >= NEARLY_ALL * F.col("n")).groupBy("key").agg(F.collect_set(w).alias("fixed"), F.count_if(telling(w)).alias("telling"), F.count_if(bits(w, TIMES) == 0).alias("constants"))
    fixed = fixed.where(F.col("constants") >= CONSTANTS).drop("constants")
    lines = s.join(fixed, "key").withColumn("rest", F.filter(F.array_except("words", "fixed"), lambda w: bits(w, WORD) == WORD))
    unit = F.when(F.size(F.filter("rest", telling)) > F.col("telling"), F.col("page")).otherwise(F.col("address"))
    slot = F.when(F.size("rest") > 0, F.xxhash64(F.transform("rest", lambda w: F.shiftright(w, HASH))))
    lines = store(lines.select("id", "key", "site", "share", unit.alias("unit"), slot.alias("slot")))
    open_keys = lines.groupBy("key").agg(F.avg(F.col("slot").isNotNull().cast("int")).alias("filled")).where("filled >= 0.5").select("key")
    several = lambda c: lines.where("slot IS NOT NULL").select("slot", c).distinct().groupBy("slot").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= ADDRESSES).select("slot")
    defaults = several("site").join(several("unit"), "slot", "left_semi")
    blank = lines.where("slot IS NULL").join(open_keys, "key", "left_semi").select("id", "share")
    found = blank.unionAll(lines.join(defaults, "slot", "left_semi").select("id", "share"))
    return found.groupBy("id").agg(F.sum("share").alias("share")).where("share >= 0.5").select("id")


def unfilled_titles(pages: DataFrame) -> DataFrame:
    """(id): pages whose title's slot is blank or holds a default.

    The titles of a site that end in the same word are aligned from their ends: what all of them have
    there is the template, what is before it the slot. A default is what pages of several sites have in that
    slot though none of their lines says so. Minimum and maximum of the reversed titles share what all share,
    so no group is collected."""
    words = F.split(F.lower(F.trim(F.regexp_replace("title", r"(?U)\s+", " "))), " ")
    t = pages.where("trim(title) <> ''").select("id", "site", "title_fits", F.reverse(words).alias("back")).withColumn("last", F.col("back")[0])
    ends = t.groupBy("site", "last").agg(F.min("back").alias("a"), F.max("back").alias("b"))
    same = F.zip_with("a", "b", lambda x, y: x.eqNullSafe(y))
    shared = F.when(F.col("a") == F.col("b"), 0).otherwise(F.array_position(same, False) - 1)
    ends = ends.select("site", "last", shared.cast("int").alias("shared"))
    slot = F.array_join(F.reverse(F.slice("back", F.col("shared") + 1, F.size("back"))), " ")
    t = t.join(ends, ["site", "last"]).select(
        "id", "site", "title_fits", F.regexp_replace(slot, r"(?U)^[\W_]+|[\W_]+$", "").alias("slot"), (F.element_at("back", -1).rlike(r"(?U)^[\W_]+$") & (F.col("shared") > 0)).alias("joint"))
    other = t.where("slot <> '' AND NOT title_fits")
    defaults = other.select("slot", "site").distinct().groupBy("slot").agg(F.count(F.lit(1)).alias("sites")).where(F.col("sites") >= ADDRESSES).select("slot")
    return t.where("slot = '' AND joint").select("id").unionAll(other.join(defaults, "slot", "left_semi").select("id"))


def find_residue(fetches: DataFrame, common_words: DataFrame, id_col: str = "fetch_id") -> DataFrame:
    """(id_col): fetches whose title or main text is unfilled placeholders, filler, an error message
    or a script notice.

    fetches needs id_col, url, content, parsed_data (title, html, text_content); rows with null
    content aren't cases; a null title, html or text counts as empty; repeated rows come out once
    per id. A page with content of its own is a case only for an unfilled title. Lines and titles are
    compared over all rows, each page counted once; the shuffles carry hashes of lines, and words of
    titles and of main texts only.
    """
    from tidewrack.llm.pages import TEMPLATE, read_pages  # which uses read_record()

    return residue_of(store(read_pages(fetches, common_words, id_col, TEMPLATE)), id_col)


def residue_of(pages: DataFrame, id_col: str) -> DataFrame:
    """find_residue() on stored pages of read_pages()."""
    pages = pages.where("has_content")
    own = pages.where("title_flag OR text_flag").select("id")
    return own.unionAll(template_pages(pages)).unionAll(unfilled_slots(pages)).unionAll(unfilled_titles(pages)).distinct().select(F.col("id").alias(id_col))
