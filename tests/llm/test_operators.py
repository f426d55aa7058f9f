import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewrack.llm import bpe, encoding, leakage, main_content, pagetree, quality, repeated_lines, spam, templates
from tidewrack.llm.queries import TOKENIZERS

WORDS = "lang string, word string"
COMMON = [("en", w) for w in "the a an and or of to in on at by for with from as is are was were it that this".split()] + [("de", w) for w in "der die das und in den ist".split()]
PARSED = "struct<title: string, links: array<string>, html: string, text_content: string>"
FETCH = f"fetch_id long, url string, content string, parsed_data {PARSED}, id string, text string, lines string"


@pytest.fixture(scope="module")
def common(spark):
    return spark.createDataFrame(COMMON, WORDS)


def fetch(i, url, html=None, text=None, title=None, content="same"):
    return (i, url, (html if content == "same" else content), (title, None, html, text) if html is not None or text is not None or title is not None else None, "clash", "clash", "clash")


# --- p1


def test_repeated_lines(spark):
    rows = [fetch(i, f"https://www.a.example/{i}", "", f"Share\t this  {i}\nown line {'x' * i}\n\n  ONE ") for i in range(4)]
    rows += [fetch(10, "http://a.example/0", "", "share this 77\nother"), fetch(11, "https://b.example/1", "", "Share this 1"), fetch(12, None, "", "share this 1"), fetch(13, "https://a.example/q", "", None), fetch(14, "nohost", "", "share this 1")]
    rows += [fetch(15, "https://www.a.example/0", "", "share this 0"), fetch(15, "https://www.a.example/0", "", "share this 0")]
    got = sorted(tuple(r) for r in repeated_lines.repeated_occurrences(spark.createDataFrame(rows, FETCH)).collect())
    want = sorted([(i, k) for i in range(4) for k in (0, 3)] + [(10, 0), (15, 0), (15, 0)])
    assert got == want


def test_refetches_are_one_document(spark):
    rows = [fetch(i, "https://a.example/same", "", "line") for i in range(9)] + [fetch(20 + i, f"https://a.example/{i}", "", "line") for i in range(2)]
    assert repeated_lines.repeated_occurrences(spark.createDataFrame(rows, FETCH)).count() == 0


def test_repeated_lines_like_brute_force(spark):
    rng = random.Random(1)
    rows = [fetch(i, f"https://s{rng.randrange(2)}.example/{rng.randrange(40)}", "", "\n".join(rng.choice(["A b", "a  B", "x1", "X 22", "é ü", "É ü", "", " ", f"l{rng.randrange(30)}q"]) for _ in range(5))) for i in range(120)]

    def norm(line):
        import re

        return re.sub("[0-9]+", "0", re.sub("[ \t ]+", " ", line).strip(" ").lower())

    urls = {}
    for r in rows:
        for line in r[3][3].split("\n"):
            urls.setdefault((r[1].split("/")[2], norm(line)), set()).add(r[1])
    want = sorted((r[0], k) for r in rows for k, line in enumerate(r[3][3].split("\n")) if norm(line) and len(urls[r[1].split("/")[2], norm(line)]) >= 4)
    df = spark.createDataFrame(rows, FETCH)
    assert sorted(tuple(x) for x in repeated_lines.repeated_occurrences(df).collect()) == want
    clean = {r.fetch_id: r.text for r in repeated_lines.without_repeated_lines(df).collect()}
    drop = set(want)
    assert clean == {r[0]: "\n".join(line for k, line in enumerate(r[3][3].split("\n")) if (r[0], k) not in drop) for r in rows}


def test_documents_are_numbered_densely(spark):
    p = spark.createDataFrame([(s, f"u{i}") for s in "ab" for i in range(300)] * 2, "source string, url string")
    got = repeated_lines.number_documents(p).groupBy("source").agg(F.sort_array(F.collect_list("doc")).alias("d")).collect()
    assert all(r.d == list(range(300)) for r in got)


# --- p3


@pytest.mark.parametrize(
    "text,read,meant",
    [
        ("La compañía del río midió", "cp1252", "utf-8"), ("“We didn’t expect it”", "cp1252", "utf-8"), ("Straße für Käse", "cp437", "utf-8"), ("über Gästebücher", "mac_roman", "utf-8"),
        ("Die Bücherei prüfte", "cp1251", "utf-8"), ("Школа у моста сохранила расписание рядом", "cp1252", "cp1251"), ("Речная служба измерила часть свечей под мостом", "cp1251", "koi8-r"),
        ("żona młynarza odświeżyła księgę", "latin-1", "iso8859-2"), ("图书馆修好了最后一页", "gb18030", "utf-8"), ("早朝、港の管理人", "latin-1", "utf-8"),
    ],
)
def test_round_trip(text, read, meant):
    try:
        bad = text.encode(meant).decode(read)
    except UnicodeDecodeError:
        bad = "".join(bytes([b]).decode(read, "ignore") or chr(b) for b in text.encode(meant)) if read != "gb18030" else text.encode(meant).decode(read, "replace")
    hit, fixed, whole = encoding.mend(bad)
    assert hit and (fixed == text or not whole)


def test_nested_layers_and_references():
    twice = "Mühle".encode().decode("cp1252").encode().decode("cp1252")
    assert encoding.mend(twice)[1] == "Mühle"
    assert encoding.mend("<p>caf&#195;&#169;</p>", True)[1] == "<p>café</p>"
    assert encoding.mend("<p>caf&#233; &amp; more</p>", True)[0] is False


@pytest.mark.parametrize("read", ["cp1252", "cp1251", "latin-1", "mac_roman", "cp437"])
@pytest.mark.parametrize("text", ["Café résumé naïve über", "La compañía del río midió “cosas”", "Größe und Straße für Käse"])
def test_any_number_of_layers(text, read):
    bad = text
    for _ in range(6):
        raw = bad.encode()
        bad = raw.decode("latin-1") if read == "latin-1" else "".join(encoding.IMAGES[read][b] for b in raw)
        assert encoding.mend(bad) == (True, text, True)


@pytest.mark.parametrize(
    "text",
    [None, "", "plain", "Größe, Öffnung, naïve café — “quoted” … 5 °C ½ €4", "NÃO, A PRAÇA SÃO LEÃO", "L’été à l’étage", "żółć ŻÓŁĆ", "Школа у моста", "ШКОЛА У МОСТА СОХРАНИЛА РАСПИСАНИЕ", "图书馆 and 图书馆", "早朝、港",
     "When the wrong table is used, é turns into Ã© and ’ into â€™, as we know."],
)
def test_correct_texts_stay(text):
    assert encoding.mend(text)[0] is False


def test_lost_characters_are_found():
    assert encoding.mend("Stra�e")[::2] == (True, False)


def test_find_garbled(spark):
    rows = [fetch(1, "u", "<p>x</p>", "x", "cafÃ©"), fetch(1, "u", "<p>x</p>", "x", "cafÃ©"), fetch(2, "u", "", "", None, "<b>Ã¼ber KÃ¤se</b>"), fetch(3, "u"), fetch(4, "u", "", "", "", "")]
    df = spark.createDataFrame(rows, FETCH)
    fields = {"content": ("content", True), "title": ("parsed_data.title", False)}
    got = sorted((r.fetch_id, r.field, r.restored) for r in encoding.find_garbled(df, "fetch_id", fields).collect())
    assert got == [(1, "title", "café"), (1, "title", "café"), (2, "content", "<b>über Käse</b>")]
    assert encoding.find_garbled(df.limit(0), "fetch_id", fields).count() == 0


# --- p4, p5, p7

ARTICLE = "The old harbour, the yard and the mill were quiet that morning. It was a long way to the station, and the keepers knew it."


def page(body, nav=True):
    links = "".join(f'<a href="/{w}">{w}</a>\n' for w in ("Home", "News", "Contact")) if nav else ""
    html = f'<html lang="en"><head><title>t</title></head><body>\n<div class="menu">\n{links}</div>\n{body}\n<div class="end">\n<p>© 2024 Site. All rights reserved.</p>\n</div>\n</body></html>'
    return html


def lines_of(html):
    import re

    inner = re.sub(r"(?s)<head>.*?</head>|<script.*?</script>", "", html)
    inner = re.sub(r"</?(?:a|b|i|span|em)(?:\s[^>]*)?>", "", inner)
    return "\n".join(x.strip() for x in re.split(r"<[^>]*>|\n", inner) if x.strip())


def test_lines_are_placed():
    html = page(f'<main>\n<h1>Head</h1>\n<p>{ARTICLE} <a href="x">more</a> text.</p>\n<div class="h2">Sub</div>\n<li>an entry</li>\n<div>Share this page</div>\n</main>\n<script>var a = "<p>no</p>";</script>')
    p = pagetree.read_page(html, lines_of(html))
    assert p.aligned and all(x.block >= 0 for x in p.lines)
    kept = [p.lines[i].text for i in main_content.main_lines(p)]
    assert kept == ["Head", f"{ARTICLE} more text.", "Sub", "an entry"]


def test_lines_behind_a_run_that_the_text_lacks_are_placed():
    menu = "".join(f'<a href="/{i}">Entry {i}</a>\n' for i in range(90))
    html = page(f'<div class="more">\n{menu}</div>\n<main>\n<h1>Head</h1>\n<p>{ARTICLE} <a href="x">more</a> text.</p>\n</main>')
    text = "\n".join(x for x in lines_of(html).split("\n") if not x.startswith("Entry"))
    p = pagetree.read_page(html, f"not there\n{text}")
    assert not p.aligned and [x.text for x in p.lines if x.block < 0] == ["not there"]
    assert [p.lines[i].text for i in main_content.main_lines(p)] == ["Head", f"{ARTICLE} more text."]
    assert [x.linked for x in p.lines if x.text.startswith(ARTICLE)] == [4]


def test_unclosed_and_odd_markup():
    for html in ("", "<p>one<p>two", "<<>><a", "</p></div>x", "<p class=>x</p>", "<div>" * 3000 + "deep text" + "</div>" * 3000):
        p = pagetree.read_page(html, "one\ntwo\n\ndeep text")
        main_content.main_lines(p)
        templates.read_record("https://h.example/x", "", p, frozenset())


def test_main_lines_of_tables(spark, common):
    art = page(f"<main>\n<h1>The mill</h1>\n<p>{ARTICLE}</p>\n<p>By the desk</p>\n</main>")
    spam_page = page("<main>\n" + "".join(f"<p>{'buy blue kettle, cheap blue kettle, best blue kettle, ' * 12}</p>\n" for _ in range(3)) + "</main>")
    rows = [fetch(1, "https://a.example/1", art, lines_of(art)), fetch(2, "https://a.example/2", spam_page, lines_of(spam_page)), fetch(3, "https://a.example/3"), fetch(4, None, "", "")]
    df = spark.createDataFrame(rows, FETCH)
    got = sorted(tuple(r) for r in main_content.find_main_lines(df, common).collect())
    text = lines_of(art).split("\n")
    assert got == [(1, text.index("The mill")), (1, text.index(ARTICLE))]
    assert [r.fetch_id for r in spam.find_stuffed(df, common).collect()] == [2]
    empty = df.limit(0)
    assert main_content.find_main_lines(empty, common).count() == spam.find_stuffed(empty, common).count() == templates.find_residue(empty, common).count() == 0


def test_language_behind_a_long_comment():
    assert spam.language(f"<!-- {'x' * 3000} <html lang='fr'> -->\n<HTML class=a lang=de-AT><p lang='en'>") == "de"
    assert spam.language("<html><p lang='en'>") == spam.language("") == spam.language("<!-- <html lang='de'>") == "und"


def test_keyword_behind_articles_is_stuffed(spark, common):
    rng = random.Random(7)
    town = lambda: "".join(rng.choice("bcdfghjklmnprstvw") for _ in range(7))
    listed = " | ".join(f"{rng.choice(['cheap', 'buy', 'original'])} die Karte in {town()}" for _ in range(30))
    told = " ".join(f"The lantern of {town()} is the lantern for {town()} {town()}." for _ in range(15))
    subject = " ".join(f"The {town()} {town()} of the {town()} was in the {rng.choice(['lantern', town(), town()])} and {town()} {town()}." for _ in range(30))
    pages = [page(f"<main>\n<h1>A head</h1>\n<p>{x}</p>\n</main>") for x in (listed, told, subject)]
    rows = [fetch(i, f"https://a.example/{i}", h, lines_of(h)) for i, h in enumerate(pages)]
    assert sorted(r.fetch_id for r in spam.find_stuffed(spark.createDataFrame(rows, FETCH), common).collect()) == [0, 1]


@pytest.mark.parametrize("title,want", [("{{ page.title }}", True), ("${post.name} - Site", True), ("<%= item.x %> | Site", True), ("@@a_b@@", True), ("Untitled", False), ("", False), (None, False), ("How {{name}} ended in our titles", False), ("The mill", False), ("Sample page | Site", False)])
def test_titles(title, want):
    assert templates.names_variable(title or "") is want


def test_residue(spark, common):
    rng = random.Random(3)
    vocabulary = "harbour yard mill station keeper lantern kettle bridge weir ferry garden tower bakery chimney meadow compass".split()

    def article(i):
        body = " ".join(f"The {rng.choice(vocabulary)} of the {rng.choice(vocabulary)} was near the {rng.choice(vocabulary)} number {i}{k}." for k in range(5))
        return page(f"<main>\n<h1>Story of the {rng.choice(vocabulary)}</h1>\n<p>{body}</p>\n</main>")

    def error(code):
        return page(f"<main>\n<h1>Error</h1>\n<p>Sorry, the page /x/{code} could not be shown. Incident {code}.</p>\n</main>")

    rows = []
    for i in range(12):
        h = article(i)
        rows.append(fetch(i, f"https://a.example/x/{i}", h, lines_of(h), "The mill"))
    for i, code in enumerate(("qwxzt", "plmok", "zzgha", "trewq")):
        h = error(code)
        rows.append(fetch(100 + i, f"https://s{i}.example/x/{code}", h, lines_of(h), "Error"))
    h = article(50)
    rows.append(fetch(200, "https://a.example/t", h, lines_of(h), "{{ post.title }} - A"))
    h = page("<main>\n<h1>x</h1>\n<p>{{ body.intro_text }}</p>\n<p>${body.main_part}</p>\n</main>")
    rows.append(fetch(201, "https://a.example/v", h, lines_of(h), "The mill"))
    h = page("<main>\n<p>Lorem ipsum dolor amet nibhan ligna orbis quam. Vestri pellor clarum ferment luctus tempor sagit.</p>\n</main>")
    rows.append(fetch(202, "https://a.example/l", h, lines_of(h), ""))
    quoting = page(f"<main>\n<h1>On templates</h1>\n<p>A template writes {{{{ post.title }}}} where the value goes. {ARTICLE}</p>\n</main>")
    rows.append(fetch(300, "https://a.example/q", quoting, lines_of(quoting), "On templates"))
    rows.append(fetch(301, "https://a.example/none"))
    got = sorted(r.fetch_id for r in templates.find_residue(spark.createDataFrame(rows, FETCH), common).collect())
    assert got == [100, 101, 102, 103, 200, 201, 202]


def test_copies_of_an_article_are_one_page(spark, common):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("bcdfghjklmnprstvw") for _ in range(6))
    body = [" ".join(f"The {word()} of the {word()} was in the {word()} {word()}." for _ in range(5)) for _ in range(4)]
    long = page("<main>\n<h1>The mill</h1>\n" + "".join(f"<p>{x}</p>\n" for x in body) + "</main>")
    short = page("<main>\n<h1>The weir</h1>\n<p>The keeper of the weir was in the garden with a lantern.</p>\n</main>")
    notice = page("<main>\n<h1>Sorry</h1>\n<p>Please turn on scripts in this browser to read the page.</p>\n</main>")
    rows = [fetch(i, f"https://mirror{i}.example/x/{i}", long, lines_of(long)) for i in range(6)]
    rows += [fetch(20 + i, f"http{'s' * (i % 2)}://A.example/weir{'/' * (i // 2)}", short, lines_of(short)) for i in range(4)]
    rows += [fetch(40 + i, f"https://h{i}.example/n{i}", notice, lines_of(notice)) for i in range(4)]
    df = spark.createDataFrame(rows, FETCH)
    assert sorted(r.fetch_id for r in templates.find_residue(df, common).collect()) == [40, 41, 42, 43]
    text = lines_of(long).split("\n")
    got = sorted(tuple(r) for r in main_content.find_main_lines(df, common).where("fetch_id < 20").collect())
    assert got == [(i, text.index(x)) for i in range(6) for x in ["The mill", *body]]


def told(rng, site, i, head, title):
    body = " ".join(f"The {rng.choice('mill weir yard kiln'.split())} of the {rng.choice('keeper ferry garden tower'.split())} was near the {rng.choice('bridge lane shore'.split())} number {site}{i}{k}." for k in range(9))
    h = page(f"<main>\n<h1>{head}</h1>\n<p>{body}</p>\n<p>{body} It was late, and the others knew it.</p>\n</main>")
    return fetch(0, f"https://{site}.example/x/{i}", h, lines_of(h), title)


def test_defaults_and_blanks_in_titles_are_induced(spark, common):
    rng = random.Random(9)
    rows = [told(rng, s, i, f"Story {s} number {i}", f"Story {s} number {i} | The {s} Site") for s in "abcd" for i in range(4)]
    rows += [told(rng, s, 20, f"Tale of {s}", "Neue Seite 1 | The " + s + " Site") for s in "abcd"]  # a default that no list has
    rows += [told(rng, "a", 30, "Another tale", " | The a Site"), told(rng, "b", 31, "One more", "The b Site"), told(rng, "c", 32, "A tale told once", "Quite another title | The c Site")]
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    got = sorted(r.fetch_id for r in templates.find_residue(spark.createDataFrame(rows, FETCH), common).collect())
    assert got == [16, 17, 18, 19, 20]


def test_blank_slots_of_a_text_are_induced(spark, common):
    greet = lambda name, place: page(f'<main>\n<p class="hi">Hello {name}, welcome to the pages of {place}, where you are glad to be.</p>\n</main>', nav=False)
    names = "Anna Ben Cora Dan Eve Finn Gus Hal Ida Jon Kim".split()
    rows = [fetch(i, f"https://a.example/{i}", greet(n, f"{n}town"), lines_of(greet(n, f"{n}town")), f"Page of {n}") for i, n in enumerate(names)]
    rows.append(fetch(50, "https://a.example/50", greet("", ""), lines_of(greet("", "")), "Page of Zoe"))
    pages = spark.createDataFrame(rows, FETCH)
    from tidewrack.llm.pages import TEMPLATE, read_pages

    assert [r.id for r in templates.unfilled_slots(read_pages(pages, common, parts=TEMPLATE)).collect()] == [50]
    assert 50 in [r.fetch_id for r in templates.find_residue(pages, common).collect()]


@pytest.mark.parametrize("more", [0, 1, 6, 60])
def test_slots_are_induced_in_texts_of_any_length(spark, common, more):
    tail = " ".join("Here the keeper of the weir was in the garden with a lantern, as on all days." for _ in range(more))
    greet = lambda name, place: page(f'<main>\n<p class="hi">Hello {name}, welcome to the pages of {place}, where you are glad to be. {tail}</p>\n</main>', nav=False)
    names = "Anna Ben Cora Dan Eve Finn Gus Hal Ida Jon Kim".split()
    told = [(s, i, greet(n, f"{n}{s}town")) for s in "abc" for i, n in enumerate(names)] + [("a", 50, greet("", ""))] + [(s, 60, greet("Newcomer", "Anytown")) for s in "abc"]
    df = spark.createDataFrame([fetch(100 * "abc".index(s) + i, f"https://{s}.example/{i}", h, lines_of(h), f"Page {s} of {i}") for s, i, h in told], FETCH)
    from tidewrack.llm.pages import TEMPLATE, read_pages

    assert sorted(r.id for r in templates.unfilled_slots(read_pages(df, common, parts=TEMPLATE)).collect()) == [50, 60, 160, 260]
    got = {r.fetch_id for r in templates.find_residue(df, common).collect()}
    assert {50, 60, 160, 260} <= got
    assert not got & {r.fetch_id for r in main_content.find_main_lines(df, common).collect()}


def test_articles_have_no_unfilled_slots(spark, common):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("bcdfghjklmnprstvw") for _ in range(6))
    story = lambda: [" ".join(f"The {word()} of the {word()}, and the {word()}, was in the {word()}." for _ in range(5)) for _ in range(4)]
    paragraphs = lambda body: "".join(f"<p>{x}</p>\n" for x in body)
    copied, rows = story(), []
    for k, s in enumerate("abcd"):
        for i in range(6):  # the last three are copies, on one site and on four
            h = page(f"<main>\n<h1>The {word()}</h1>\n{paragraphs(story() if i < 3 else copied)}</main>")
            rows.append(fetch(100 * k + i, f"https://{s}.example/x/{i}", h, lines_of(h)))
        for i in range(10, 14):  # an article beside its head, whose subtitle was left as it was
            sub = "Subtitle of the story, here" if i == 13 else f"Subtitle of the {word()}, {word()} {word()}"
            h = page(f'<header-box class="top">\n<h1>A {word()}</h1>\n<p>{sub}</p>\n</header-box>\n<main>\n{paragraphs(story())}</main>')
            rows.append(fetch(100 * k + i, f"https://{s}.example/y/{i}", h, lines_of(h)))
    assert templates.find_residue(spark.createDataFrame(rows, FETCH), common).count() == 0


def test_flat_pages_and_parts_without_a_class():
    flat = f"<html><body>\n<h1>Head</h1>\n<p>{ARTICLE}</p>\n<p>{ARTICLE} Again, it was so, and so on.</p>\n<p>{ARTICLE} And more, as before.</p>\n</body></html>"
    p = pagetree.read_page(flat, lines_of(flat))
    assert len(main_content.main_lines(p)) == 4
    parts = page("".join(f"<div>\n<p>{ARTICLE} Part {i}, and so on.</p>\n</div>\n" for i in range(3)) + "<div>\n<p>Prices include tax.</p>\n<p>Errors excepted.</p>\n</div>")
    p = pagetree.read_page(parts, lines_of(parts))
    assert [p.lines[i].text for i in main_content.main_lines(p)] == [f"{ARTICLE} Part {i}, and so on." for i in range(3)]


def test_bounds_follow_the_language(spark):
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spam.FEATURES)
    row = lambda i, lang, pair: (i, True, lang, 300, 0.35, 0.03, pair, 0.05, 0.2, 0.04, 20.0, 0.0, 0.0, 0)
    rows = [row(i, "pl", 0.06 + (i % 3) / 1000) for i in range(60)] + [row(100 + i, "en", 0.02) for i in range(60)] + [row(200, "pl", 0.12), row(201, "en", 0.12), row(202, "xx", 0.14), row(203, "xx", 0.02)]
    df = spark.createDataFrame(rows, "id long, has_text boolean, " + kinds)
    assert sorted(r.fetch_id for r in spam.stuffed_of(df, "fetch_id").collect()) == [201, 202]


def test_one_pass_serves_all_operators(spark, common, sf):
    from tidewrack.llm.pages import read_pages
    from tidewrack.session import store, table

    fetches, words = table(spark, sf, "fetches"), table(spark, sf, "common_words")
    pages = store(read_pages(fetches, words))
    ids = lambda d: sorted(tuple(r) for r in d.collect())
    assert ids(main_content.main_lines_of(pages, "fetch_id")) == ids(main_content.find_main_lines(fetches, words))
    assert ids(templates.residue_of(pages, "fetch_id")) == ids(templates.find_residue(fetches, words))
    assert ids(spam.stuffed_of(pages, "fetch_id")) == ids(spam.find_stuffed(fetches, words))


# --- p8


@pytest.fixture(scope="module")
def fst():
    with open(f"{TOKENIZERS}/byte_bpe_50k.json", "rb") as f:
        return bpe.Transducer(bpe.Vocabulary(f.read()))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


ALPHABET = st.one_of(st.sampled_from("etaoinshrdlu 'sdm\n\t   "), st.characters(exclude_categories=("Cs", "Cn", "Co")))


@settings(max_examples=300, deadline=None)
@given(st.text(ALPHABET, max_size=60))
def test_encoding_like_the_library(fst, library, text):
    ids = fst.encode(text)
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert fst.decode(ids) == text


def test_long_and_special_texts(fst, library):
    for text in ("<|endoftext|> x", "a" * 5000, "ab" * 3000, " " * 3000, "=" * 999, "﻿x\r\n\r\n y", "😀🇺🇳 é", "don't I'LL we've"):
        assert fst.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_stream_decoding(fst):
    ids = fst.encode("日本語😀é")
    assert "".join(fst.decode_stream(iter(ids))) == "日本語😀é"
    assert fst.decode(ids[:1]) in ("日", "�") and fst.decode([]) == ""


def test_encode_table(spark, fst):
    rows = [(1, "a b", 5), (2, "", 5), (3, None, 5), (None, " ", 5), (1, "a b", 5), (9, "word " * 60_000, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    path = f"{TOKENIZERS}/byte_bpe_50k.json"
    got = sorted((str(r.doc_id), r.ids) for r in bpe.encode(df, path).collect())
    assert got == sorted((str(i), fst.encode(t or "")) for i, t, _ in rows)
    assert bpe.encode(df.limit(0), path).count() == 0
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(df, path), path).collect()}
    assert back[1] == "a b" and back[3] == ""


# --- p9


def brute_leaks(docs, items, span=10):
    out = set()
    for d, t in docs:
        w = leakage.words(t)
        for i, p in items:
            q = leakage.words(p)
            n = min(span, len(q))
            windows = {tuple(q[k : k + n]) for k in range(len(q) - n + 1)} if n else set()
            if any(tuple(w[k : k + n]) in windows for k in range(len(w) - n + 1)):
                out.add((d, i))
    return out


def test_leaks_like_brute_force(spark):
    rng = random.Random(8)
    v = [f"w{k}" for k in range(12)]
    items = [(i, " ".join(rng.choice(v) for _ in range(rng.choice([3, 9, 10, 14, 25])))) for i in range(25)] + [(90, None), (91, ""), (92, "!?"), (93, "Solo")]
    docs = []
    for d in range(150):
        t = " ".join(rng.choice(v) for _ in range(rng.randrange(40)))
        if rng.random() < 0.5:
            w = leakage.words(rng.choice(items)[1])
            a = rng.randrange(max(1, len(w)))
            t += " -- " + "; ".join(w[a : a + rng.choice([5, 10, 30])]).upper() + " " + t
        docs.append((d, t))
    docs += [(900, None), (901, ""), (902, "solo!"), (903, "w1 " * 20_000)]
    dd = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item_id int")
    ii = spark.createDataFrame([(*x, 1) for x in items], "item_id long, passage string, doc_id int")
    got = {(r.doc_id, r.item_id) for r in leakage.find_leaks(dd, ii).collect()}
    assert got == brute_leaks(docs, items)
    assert leakage.find_leaks(dd.limit(0), ii).count() == 0 and leakage.find_leaks(dd, ii.limit(0)).count() == 0


def test_leaks_in_blocks(spark, monkeypatch):
    items = [(i, f"alpha{i} beta{i} gamma{i}") for i in range(9)]
    docs = [(i, f"x alpha{i} Beta{i}, gamma{i} y") for i in range(9)]
    monkeypatch.setattr(leakage, "ITEM_BYTES", 60)
    got = {(r.doc_id, r.item_id) for r in leakage.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string")).collect()}
    assert got == {(i, i) for i in range(9)}


def test_proximity_like_brute_force(spark):
    rng = random.Random(11)
    v = [f"w{k}" for k in range(30)]
    items = [(i, " ".join(rng.sample(v, rng.choice([4, 10, 13])))) for i in range(12)]
    docs = []
    for d in range(60):
        w = leakage.words(rng.choice(items)[1])
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(w))
            w = w[:k] + [rng.choice(v)] + w[k:] if rng.random() < 0.5 else w[:k] + w[k + 1 :]
        docs.append((d, " ".join(rng.choices(v, k=3) + w + rng.choices(v, k=3))))

    def near(text, passage, slop=2, span=10):
        w, q = leakage.words(text), leakage.words(passage)
        at = {}
        for k, x in enumerate(w):
            at.setdefault(x, []).append(k)
        n = min(span, len(q))
        for s in range(len(q) - n + 1):
            own = q[s : s + n]
            o = min(range(n), key=lambda j: count.get(own[j], 0))
            if any(all(any(abs(p - (a - o + j)) <= slop for p in at.get(own[j], [])) for j in range(n)) for a in at.get(own[o], [])):
                return True
        return False

    count = {}
    for _, t in docs:
        for x in leakage.words(t):
            count[x] = count.get(x, 0) + 1
    want = {(d, i) for d, t in docs for i, p in items if near(t, p)}
    dd = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)  # one block, as in the brute force
    ii = spark.createDataFrame(items, "item_id long, passage string")
    got = {(r.doc_id, r.item_id) for r in leakage.find_leaks(dd, ii, slop=2).collect()}
    assert got == want and len(want) > len({(r.doc_id, r.item_id) for r in leakage.find_leaks(dd, ii).collect()})


def test_an_index_serves_any_items(spark, monkeypatch):
    from tidewrack.session import store

    monkeypatch.setattr(leakage, "BLOCK_WORDS", 7)
    docs = spark.createDataFrame([(i, f"alpha{i} beta gamma{i} delta") for i in range(20)] + [(90, None), (91, "")], "doc_id long, text string")
    index = store(leakage.index_documents(docs))
    assert index.count() > 1 and sorted(x for r in index.collect() for x in r.docs if x < 90) == list(range(20))
    for k in (3, 8):
        items = spark.createDataFrame([(k, f"beta gamma{k}")], "item_id int, passage string")
        assert [tuple(r) for r in leakage.search_index(index, items).collect()] == [(k, k, 1)]


# --- p10

PROSE = "The keepers of the mill walked to the station in the morning. They were late, and the bakery was closed.\nIt was a cold day on the river."
NOT = {
    "bullets": "\n".join(f"- blue kettle, {i} pcs" for i in range(20)), "numbers": "\n".join(f"{i}) lantern and weir" for i in range(20)), "csv": "\n".join("a,12,,n/a,2024-01-02" for _ in range(20)),
    "pipes": "\n".join("kettle | 12 |  | n/a" for _ in range(9)), "tabs": "\n".join("kettle\t12\t\tn/a" for _ in range(9)), "log": "\n".join(f"12:00:0{i} INFO [x-1] GET /a 200 12ms" for i in range(9)),
    "code": "if (x) {\n  var a = 1;\n}\nreturn a;\n</div>\n.box { margin: 0 }", "base64": "QmFzZTY0IHRleHQgd2l0aG91dCBzcGFjZXM" * 12, "signs": "#### **** ;;;; ~~~~ ==== " * 9, "junk": "xk9 zq;l pwv0 'trk mzz:b " * 12,
    "words": "kettle lantern weir mill ferry bakery station harbour " * 9, "links": "\n".join(f"https://a.example/{i}" for i in range(9)),
}
IS = {
    "plain": PROSE, "wrapped": PROSE.replace("\n", " ").replace(" in the", "\nin the").replace("and the", "\nand the"), "dialogue": "“The mill is closed,” said the keeper of the yard.\n“It is a cold day on the river,” the others said.",
    "short list": PROSE * 3 + "\n- kettle\n- weir\n", "crlf": PROSE.replace("\n", "\r\n"), "german": "Die Mühle und das Lager in der Stadt, die der Müller kaufte, waren in den Ferien zu.",
    "chinese": "三月，抓取程序在山上修好了绿色的大门，而且夜班工人在河边保存了十二把椅子。",
}


@pytest.mark.parametrize("name", NOT)
def test_not_prose(name):
    lists = quality.Lists(COMMON)
    assert quality.shares(NOT[name], lists)[2] < quality.PROSE


@pytest.mark.parametrize("name", IS)
def test_prose(name):
    lists = quality.Lists(COMMON)
    assert quality.shares(IS[name], lists)[2] >= quality.PROSE


def test_rules_reproduce_the_found_documents(spark, sf):
    from tidewrack.llm.queries import QUERIES

    stats = QUERIES["p10_stats"](spark, sf)
    assert sorted(r.doc_id for r in stats.where(quality.not_prose()).collect()) == sorted(r.doc_id for r in QUERIES["p10_found"](spark, sf).collect())


def test_combined_rules(spark, common):
    rng = random.Random(4)
    encoded = "+".join("".join(rng.choice("aAoOeEuyTRkL") for _ in range(rng.choice([1, 1, 5, 9]))) for _ in range(200)) + "=="
    listed = PROSE + "\n" + "\n".join(["the old mill and"] * 12)  # lines come back beside some prose
    rows = [(1, PROSE), (2, encoded), (3, listed), (4, "\n\n".join([PROSE] * 3)), (5, PROSE + "\n- kettle\n- weir")]
    got = sorted(r.doc_id for r in quality.find_not_prose(spark.createDataFrame(rows, "doc_id long, text string"), common).collect())
    assert got == [2, 3]


def test_statistics(spark, common):
    rows = [(1, "the cat the cat\n\nthe cat the cat", 0.0), (2, None, 0.0), (3, "", 0.0), (4, " \n ", 0.0), (1, "x", 0.0), (5, "- a\n" * 50_000, 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words double")
    got = {(r.doc_id, r.n_words): r for r in quality.text_statistics(df, common).collect()}
    a = got[1, 8]
    assert a.mean_word_length == 3 and a.duplicate_lines == 0.5 and a.duplicate_paragraphs == 0.5 and a.common_words == 0.5
    assert a.top_2gram_chars == 1.0 and a.punctuated_lines == 0
    assert sorted(r.doc_id for r in quality.find_not_prose(df, common).collect()) == [1, 1, 5]
    assert quality.text_statistics(df.limit(0), common).count() == 0


# --- very long texts


def test_very_long_texts(spark, common):
    long_html = page("<main>\n<h1>Long</h1>\n" + "".join(f"<p>{ARTICLE} {i}.</p>\n" for i in range(4000)) + "</main>")
    df = spark.createDataFrame([fetch(1, "https://a.example/1", long_html, lines_of(long_html), "Long")], FETCH)
    assert main_content.find_main_lines(df, common).count() == 4001
    assert spam.find_stuffed(df, common).count() in (0, 1)
    assert templates.find_residue(df, common).count() == 0
    assert repeated_lines.repeated_occurrences(df).count() == 0
    assert encoding.mend("é" * 300_000)[0] in (True, False)
    assert quality.shares("The cat of the mill is in the yard. " * 20_000, quality.Lists(COMMON))[2] > 0.9


def test_blank_texts_are_not_cases(spark, common):
    docs = spark.createDataFrame([(1, "\u00a0\t"), (2, "\u3000\n"), (3, ""), (4, None), (5, "- a\n- b\n- c")], "doc_id long, text string")
    assert [r.doc_id for r in quality.find_not_prose(docs, common).collect()] == [5]
