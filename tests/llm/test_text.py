"""Personal data, languages, quality, main text, tokens."""

import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from feedskein import session
from feedskein.llm import bpe, html_text, language, pii, quality

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def digits(text):
    return [int(c) for c in text if c in "0123456789"]


def luhn(found):
    found = found[::-1]
    return (sum(found[::2]) + sum(sum(divmod(2 * d, 10)) for d in found[1::2])) % 10 == 0


def plain_spans(text):
    return {
        "email": [m.span() for m in EMAIL.finditer(text)],
        "ip": [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))],
        "card": [m.span() for m in CARD.finditer(text) if 13 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))],
        "phone": [m.span() for m in PHONE.finditer(text) if 9 <= len(digits(m.group())) <= 15],
    }


def test_base_spans_follow_the_rules():
    r = random.Random(3)
    parts = ["@", "a", "b.", "1", "23", ".", "-", "_", "+", " ", "(", "255", "256", "4417744280351547", "é", "٣", "\n", "x@y.zz", "a-b", "%"]
    for _ in range(5000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 25)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_hostile_texts_are_linear():
    for part in ("a", "1", "+1", "@", "1.", "A ", "Aa ", "a-", "1 "):
        pii.candidates(part * 50_000)
        html_text.main_text(("<" + part) * 20_000)
    html_text.main_text('<a href="' * 20_000)


def test_reliabilities_tell_good_labelers_from_bad():
    r = np.random.default_rng(1)
    truth = r.random(4000) < 0.3
    votes = np.stack([np.where(r.random(4000) < right, truth, ~truth) for right in (0.95, 0.9, 0.85, 0.55)], axis=1) * 2 - 1
    prior, hit, _, posterior = pii.reliabilities(votes, np.ones(4000))
    assert abs(prior - 0.3) < 0.05 and hit[0] > 0.85 and hit[3] < 0.7
    assert ((posterior > 0.5) == truth).mean() > 0.95


@pytest.fixture
def private(spark):
    rows = [(i, f"Here is token = \"{random.Random(i).randbytes(20).hex()}\" and mail a{i}@example.com now.", "x", 5) for i in range(30)]
    rows += [(100 + i, "Plain words without anything of the kind. Of Course not.", "x", 5) for i in range(30)]
    rows += [(200, None, "x", 5), (201, "", "x", None), (None, "call +1 (212) 555-0187 x", "x", 5), (0, "a@b.cd", None, 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, spans string, n_chars long")


def test_spans_found_and_redacted(private):
    model = pii.fit(private)
    found = {r["doc_id"]: r["spans"] for r in pii.find_spans(private.filter("doc_id > 0 or doc_id is null"), model).collect()}
    assert {s["kind"] for s in found[5]} == {"email", "secret"} and found[105] == found[200] == found[201] == []
    assert [(s["kind"], s["base"]) for s in found[None]] == [("phone", True)]
    clean = pii.redact(private, model, count_column="n_chars")
    assert clean.schema == private.schema
    texts = {r["doc_id"]: r for r in clean.filter("doc_id > 0 or doc_id is null").collect()}
    assert texts[5]["text"] == 'Here is token = "<secret>" and mail <email> now.' and texts[5]["n_chars"] == len(texts[5]["text"])
    assert texts[200]["text"] is None and texts[200]["n_chars"] == 5 and texts[201]["n_chars"] is None
    assert pii.fit(private.limit(0)) == {} and pii.find_spans(private.limit(0), {}).collect() == []


def test_a_secret_around_a_card_is_reported_whole(spark):
    secret = "ab" + "4417744280351547" + "c0ffee0123456789abcdef"
    text = f'token = "{secret}" and card 4417744280351547 end'
    start = text.index(secret)
    found = [f[:3] for f in pii.candidates(text)]
    assert found == [("secret", start, start + len(secret))] and len(pii.base_spans(text)["card"]) == 2
    sure = {f: 1.0 for f in pii.candidates(text)[0][4]}
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spans = pii.find_spans(docs, sure).first()["spans"]
    assert [(s["kind"], s["base"]) for s in spans] == [("card", True), ("card", True), ("secret", False)]
    clean = pii.redact(docs, sure).first()["text"]
    assert clean == 'token = "<secret>" and card <card> end'


def test_digits_into_a_base_span_hide_no_number():
    found = pii.candidates("call +1 (826) 555-4081 190.137.2.9 now")
    assert [f[0] for f in found] == ["number"]


def test_all_names_reach_the_vote():
    found = pii.candidates("we met Zora Quill there, and Dear Zora Quill")
    assert [f[0] for f in found] == ["name", "name"] and found[0][3][1:3] == (pii.NO, pii.NO)


def sentences(words, seed, count):
    r = random.Random(seed)
    return [" ".join(r.choice(words) for _ in range(r.randint(3, 80))) for _ in range(count)]


LANGUAGES = {
    "en": "the of and that with this from have which their would there about other".split(),
    "de": "der die und nicht eine sich werden über auch nach einer wird schön größe".split(),
    "fr": "les des est une dans pour qui sur être avec été mais où très élève".split(),
}


def test_languages_of_held_out_texts(spark):
    rows = [(i, t, lang, lang) for lang, words in LANGUAGES.items() for i, t in enumerate(sentences(words, lang, 120))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    network = language.fit(docs.filter("doc_id < 80"))
    odd = spark.createDataFrame([(1, None, "en"), (2, "123 ... 4", "en"), (3, "", None), (None, "the " * 30_000, "en")], "doc_id long, text string, lang string")
    found = language.identify(docs.filter("doc_id >= 80"), network, keep=("doc_id", "lang")).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in found]) > 0.95 and all(0 <= r["score"] <= 1 for r in found)
    found = {r["doc_id"]: r["lang_pred"] for r in language.identify(odd, network).collect()}
    assert found == {1: "und", 2: "und", 3: "und", None: "en"}
    assert language.fit(docs.limit(0)) is None
    assert [r["lang_pred"] for r in language.identify(docs.limit(2), None).collect()] == ["und", "und"]


def test_the_sample_of_languages_is_bounded(spark):
    rows = [(None, t, "en") for t in sentences(LANGUAGES["en"], 1, 200)] + [(7, t, "de") for t in sentences(LANGUAGES["de"], 2, 200)]
    rows += [(9, "les des est une", "fr")] * 100 + [(i, t, "fr") for i, t in enumerate(sentences(LANGUAGES["fr"], 3, 30))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language.sample(docs, per_language=20)
    assert [sum(label == x for _, label in found) for x in ("de", "en", "fr")] == [20, 20, 20]
    assert sum(t == "les des est une" for t, _ in found) <= 1


def test_whole_texts_are_learned_from(spark):
    """What tells the languages apart stands only at the end of long texts."""
    same = "1234567 " * 400
    rows = [(i, same + {"en": "the and of that ", "de": "der und das nicht "}[x] * 12, x) for x in ("en", "de") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language.sample(docs, per_language=40)
    assert len(found) == 80 and {t for t, _ in found} == {t for _, t, _ in rows}
    network = language.fit(docs)
    ends = spark.createDataFrame([(1, "the of that and the " * 3, "en"), (2, "das der nicht und " * 3, "de")], docs.schema)
    assert all(r["lang"] == r["lang_pred"] for r in language.identify(ends, network, keep=("lang",)).collect())


def test_a_rated_document_counts_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "train", lambda found, grades: seen.append((len(found), sorted(grades))))
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(2, "other"), (None, "none")], "doc_id long, text string")
    quality.fit(docs, spark.createDataFrame([(1, 2), (2, 0), (1, 1)], "doc_id long, grade int"))
    assert seen == [(2, [0, 1])]


def test_quality_of_held_out_texts(spark):
    good, rude = sentences(LANGUAGES["en"], 1, 300), sentences(LANGUAGES["en"], 2, 150)
    rude = [t + " idiot " + t for t in rude]
    junk = [t.upper() + "!!! ### $$$ !!!" for t in sentences(LANGUAGES["en"], 3, 150)]
    rows = [(i, t, 2) for i, t in enumerate(good)] + [(1000 + i, t, 0) for i, t in enumerate(rude)] + [(2000 + i, t, 1) for i, t in enumerate(junk)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _grade int")
    ratings = docs.select("doc_id", F.col("_grade").alias("grade")).filter("doc_id % 3 <> 0")
    ratings = ratings.unionByName(spark.createDataFrame([(None, 1), (1, None), (999_999, 2)], "doc_id long, grade int"))
    model = quality.fit(docs, ratings)
    assert list(model.thresholds) == sorted(model.thresholds)
    found = quality.rate(docs.filter("doc_id % 3 = 0"), model, keep=("doc_id", "_grade")).collect()
    assert np.mean([(r["p_good"] >= 0.5) == (r["_grade"] == 2) for r in found]) > 0.95
    mean = {g: np.mean([r["expected_grade"] for r in found if r["_grade"] == g]) for g in range(3)}
    assert mean[2] > max(mean[0], mean[1])
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "the of and " * 30_000)], "doc_id long, text string")
    assert quality.rate(odd, model).count() == 3 and quality.keep_good(odd, None).count() == 3
    assert quality.fit(docs, ratings.limit(0)) is None
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    assert [r["grade"] for r in quality.grades(labels).orderBy("doc_id").collect()] == [2, 1, 0, None]


def test_thresholds_alone_fit_the_shares():
    model = quality.train([np.array([1])] * 40, [0] * 10 + [1] * 10 + [2] * 20)
    assert np.allclose(model.above([np.array([1])]), [[0.75, 0.5]], atol=0.05)


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav><!-- ad <p>no</p> -->
<div class="ad">Buy this of the and to in now.</div><div id=cookie-notice>We use cookies.</div>
<article><h1>A &amp; B</h1><p><b>One
 two<br>three.</b><p>Four&nbsp;&lt;five&gt; <a href="x">six</a> seven<div class="share"><a>Tweet</a></div>
<form>Name <input> please</form><p>Last<section class="comments"><p>I agree.</p></section></article>
<aside>More</aside><footer>&copy; we</footer></body></html>"""


@pytest.mark.parametrize("page,text", [
    (PAGE, "A & B\nOne two three.\nFour <five> six seven\nLast"),
    (PAGE[:PAGE.index(" seven")], "A & B\nOne two three.\nFour <five> six"),
    (None, ""), ("", ""), ("no markup at all", ""), ("<p>", ""),
    ("<article><p>cut &am", "cut &am"), ("<article>a<p>b</article>c", "a\nb"),
    ('<div class=header>x</div><article><div class="entry-header"><h1>T</h1></div><header>H</header><p>b</article>', "T\nH\nb"),
])
def test_main_text(page, text):
    assert html_text.main_text(page) == text


def test_ambiguous_blocks_follow_their_neighbours():
    long = "the men of the town came to the house and it was in the evening that they saw it " * 4
    links = "<p><a>one of the</a> <a>two and the</a></p>"
    page = f"<div>{links}<p>Short one.</p><p>{long}</p><p>Short two.</p><p>{long}</p><p>Short three.</p>{links}</div>"
    found = html_text.main_text(page)
    assert "Short two." in found and "Short one." not in found and "Short three." not in found and found.count("evening") == 8


def test_text_beside_an_article_is_judged_by_its_words():
    long = "the men of the town came to the house and it was in the evening that they saw it " * 4
    card = "<article><h2>Next</h2><p>A card.</p></article>"
    found = html_text.main_text(f"<div><p>{long}</p><p>In between.</p><p>{long}</p></div>{card}<div>{'xyz ' * 30}</div>")
    assert found.count("evening") == 8 and "In between." in found and "A card." in found and "xyz" not in found
    found = html_text.main_text(f"<main><p>Few words.</p></main><div><p>{long}</p></div><nav><p>{long}</p></nav>")
    assert found.split("\n") == ["Few words.", long.strip()]


def test_boilerplate_inside_an_article_is_judged_too():
    links, words = "<ul><li><a>one of the</a><li><a>two and the</a><li><a>three</a></ul>", "слова " * 30
    page = f"<article><h1>Title</h1><p>{words}</p>{links}<p>Read on <a>here</a></p>{links}<p>{words}</p><p>End.</p></article>"
    assert html_text.main_text(page).split("\n") == ["Title", words.strip(), words.strip(), "End."]


@pytest.mark.parametrize("page,text", [
    ("<article><h1><a href=x>Title</a></h1><p>Text.</p><p><a href=y>Source</a></p></article>", "Title\nText.\nSource"),
    ("<article><p>Text.</p><ul><li><a>One</a></li><li>of</li><li><a>Two</a></li></ul></article>", "Text.\nOne\nof\nTwo"),
    ("<article><p>Text.</p><ul><li><a>One</a><li><a>Two</a><li><a>Three</a></ul><h2><a>More</a></h2></article>", "Text.\nMore"),
    ("<article><p>a<svg viewBox='0 0 1 1' class=\"x/>\" />b</p><math/><p>c<SVG/>d</article>", "ab\ncd"),
    ("<article><p>a<svg><path d='M0'/><text>no</text></svg>b<svg width=1/>no</svg>c</p><math><mi/>no</math></article>", "abc"),
])
def test_an_article_keeps_its_text(page, text):
    assert html_text.main_text(page) == text


def test_pages_as_rows(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "x"), (None, "v", "<article>" + "<p>word" * 30_000, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = html_text.extract_text(pages).collect()
    assert sorted(len(r["text"]) for r in found) == sorted([0, 47, 47, 30_000 * 5 - 1])
    assert html_text.extract_text(pages.limit(0)).collect() == []


@pytest.fixture(scope="module")
def path():
    return public_tokenizers.path("byte_bpe_50k.json")


def test_tokens_are_those_of_the_library(path):
    library = Tokenizer.from_file(path)
    own = bpe.vocabulary(bpe._content(path))
    r = random.Random(1)
    parts = ["<|endoftext|>", "<|endof", " ", "  ", "\n", "\t", "'s", "'ll", "'S", "abc", "Hello", " world", "é", "日本", "12", "...", "a" * 50, "\xa0", "\x1c", "\x85", "😀", " "]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(1000)]
    texts += ["".join(map(chr, range(start, start + 256))) for start in range(0, 0xD800, 256)] + ["ab" * 30_000]
    for text in texts:
        ids = np.frombuffer(own.encode(text), np.int32).tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids, text
        assert own.decode(ids) == text == library.decode(ids, skip_special_tokens=False)
    assert own.decode([own.start[0xC3]]) == "�"


def test_rows_there_and_back(spark, path):
    rows = [(1, "Hello  world", 9), (1, "Hello  world", 9), (2, None, 9), (3, "", 9), (None, "é" * 40_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    back = bpe.decode(bpe.encode(docs, path), path).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in back) == sorted((str(i), t or "") for i, t, _ in rows)
    assert {len(r["ids"]) for r in back if r["doc_id"] in (2, 3)} == {0}
    assert bpe.decode(bpe.encode(docs.limit(0), path), path).collect() == []


def test_pieces_are_forgotten_beyond_the_bound(path):
    own = bpe.Vocabulary(bpe._content(path), pieces=3)
    assert own.decode(np.frombuffer(own.encode("a b c d e f g a b"), np.int32).tolist()) == "a b c d e f g a b"
    assert len(own.known) <= 3 and len(own.known.older) <= 3


def test_windows_hold_every_byte():
    data, used, first = language.windows(pa.array(["A" * 300, None, "bé"]))
    assert first.tolist() == [0, 3, 4, 5] and used.tolist() == [128, 128, 44, 0, 3]
    assert bytes(data[0]) == b"a" * 128 and bytes(data[4][:3]) == "bé".encode()


LONG = "This is the text of the article and it is long enough to be read as that, for it has many of the words that are in all text. " * 3


@pytest.mark.parametrize("inner,stays", [
    ("<button>{}</button>", False), ('<span style="display:none">{}</span>', False), ('<span class="ad">{}</span>', False),
    ("<em hidden><b>x</b><em>y</em>{}</em>", False), ('<span class="ad">{}<p>x</p>', False), ('<div class="share-buttons"><p>{}</p></div>', False),
    ('<p class="advert">{}</p>', False), ('<aside class="x">{}</aside>', False), ('<div id="related-articles">{}</div>', False),
    ('<section class="related-work"><p>{}</p></section>', True), ('<div id="side-effects"><p>{}</p></div>', True),
    ('<div class="social-history"><p>{}</p></div>', True), ('<div class="market-share"><p>{}</p></div>', True),
    ('<p class="alert">{}</p>', True), ('<em class="term">{}</em>', True), ("<em>{}", True),
])
def test_parts_of_an_article(inner, stays):
    inner = inner.format("MARK " + LONG if stays else "MARK")
    page = f"<html><body><article><h1>Title</h1><p>{LONG}</p><div>before {inner} after</div><p>{LONG}</p></article></body></html>"
    text = html_text.main_text(page)
    assert ("MARK" in text) == stays and "before" in text and "after" in text and text.count("This is the text") >= 6


RUSSIAN = "В этом году на заводе не было и дня, когда бы люди не говорили о том, что будет с ними и с городом, и как они будут жить. " * 3
JAPANESE = "この町には古い寺があり、多くの人がここに来て、その庭の木の下で休むのである。" * 7


@pytest.mark.parametrize("text", [RUSSIAN.strip(), JAPANESE])
def test_text_in_other_languages(text):
    page = f"<html><body><nav><a>x</a></nav><div><h1>Title</h1><p>{text}</p><p>{text[:40].strip()}</p><p>{text}</p></div><div><a>{text}</a></div></body></html>"
    assert html_text.main_text(page) == "\n".join(["Title", text, text[:40].strip(), text])


def plain_counts(pages):
    counts = {}
    for page in pages:
        lang = (re.findall(r'<html lang="?([a-z]{2})', page or "") or [""])[0]
        bare = re.sub(r"<script>.*?</script>", "", page or "", flags=re.S)
        for run in re.findall(r">([^<>]*)<", bare):
            if len(run) >= html_text.SHORT:
                words = re.findall(r"[^\W\d_]+", run.lower())
                for w in [*words, *[""] * len(words)]:
                    counts[lang, w] = counts.get((lang, w), 0) + 1
    return {k: n for k, n in counts.items() if len(k[1]) <= html_text.LONGEST}


def test_stop_words_are_learned_from_all_pages(spark):
    r = random.Random(5)
    common = {"pt": ["uma", "foi", "não"], "pl": ["się", "nie", "jest"], "": ["zu"]}
    pages = []
    for i in range(300):
        lang = ["pt", "pl", ""][i % 3]
        text = " ".join(r.choice(common[lang]) if r.random() < 0.4 else "w" + "".join(r.choices("abcdefgh", k=6)) for _ in range(60))
        pages.append(f'<html lang="{lang}"><script>var {"x " * 99}</script><p>{text}</p><p>kurz</p></html>' if lang else f"<p>{text}</p>")
    pages += [None, "", "<html lang=pt>", pages[0], pages[0]]
    table = spark.createDataFrame([(p, "x", "y") for p in pages], "html string, lang string, word string").repartition(7)
    counted = {(x["lang"], x["word"]): x["n"] for x in html_text.count_words(table).collect()}
    assert counted == plain_counts(pages)
    learned = html_text.frequent_words(table)
    assert learned == {"pt": {"uma", "foi", "não"}, "pl": {"się", "nie", "jest"}, "": {w for some in common.values() for w in some}}
    assert html_text.frequent_words(table.limit(0)) == {}


def test_tables_differ_in_their_stop_words(spark):
    stops, plain = ("qua rem tis " * 40).strip(), " ".join("w" + c + d for c in "abcdefgh" for d in "abcdefghij")
    rows = [(i, "u", f"<html lang='xx'><div><p>{stops} {i}</p></div><div><p>{plain}</p></div></html>") for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    learned = {"xx": frozenset(["qua", "rem", "tis"])}
    found = html_text.extract_text(pages, learned=learned).collect()
    assert {x["text"] for x in found} == {f"{stops} {i}" for i in range(30)}
    assert html_text.frequent_words(pages)["xx"] > learned["xx"]


def test_undecided_blocks_take_the_nearer_side():
    long = "the men of the town came to the house and it was in the evening that they saw it " * 4
    links = "<p><a>one of the</a> <a>two and the</a></p>"
    page = f"<div>{links}<p>Far.</p><p>Near.</p><p>Nearer.</p><h2>Head</h2><p>{long}</p></div><div>© us</div><h3>More</h3>{links}"
    assert html_text.main_text(page).split("\n") == ["Nearer.", "Head", long.strip()]


def planted(seed, count):
    """[(text, {(kind, start, end)})]: personal data that no base rule finds, and what looks like it."""
    r = random.Random(seed)
    given = ["Zora", "Ilka", "Tamsin", "Bram", "Anna", "Peter", "Maria", "Odile", "Karen", "Thomas"]
    family = ["Quill", "Novak", "Harrow", "Lindqvist", "Obi", "Sandoval"]
    plain = "we saw that the river had come over road and then it went back for days with no rain in sight".split()
    pairs = ["General Public", "Apache License", "New York", "Supreme Court", "North Sea", "World Bank", "Old Town"]

    def digits(n):
        return "".join(r.choices("0123456789", k=n))

    def unlucky(n):
        found = digits(n)
        while luhn([int(c) for c in found]):
            found = digits(n)
        return found

    makers = [
        lambda: ("secret", r.choice(['token = "', "password: '", 'api_key="']), r.randbytes(20).hex(), r.choice("\"'")),
        lambda: ("account", r.choice(["account number: ", "customer account: ", "iban: "]), digits(r.randint(9, 11)), " is"),
        lambda: ("number", r.choice(["call ", "phone: ", "mobile: ", "tel: "]), f"({r.randint(201, 989)}) {r.randint(201, 989)}-{r.randint(1234, 9876)}", " now"),
        lambda: ("name", r.choice(["Dear ", "Dr. ", "Mr ", "Mrs ", "my name is ", "Best regards, "]), f"{r.choice(given)} {r.choice(family)}", ", who"),
        lambda: (None, "made by ", "-".join(r.choices(["build", "release", "final", "version"], k=4)) + f"-{r.randint(1, 9)}", " there"),
        lambda: (None, "with ", unlucky(16), " pieces"),
        lambda: (None, "read by the ", r.choice(pairs), " and"),
        lambda: (None, "under ", r.choice(pairs), " terms"),
    ]
    result = []
    for _ in range(count):
        text, truth = "", set()
        for _ in range(r.randint(1, 4)):
            kind, before, value, after = r.choice(makers)()
            text += " ".join(r.choices(plain, k=r.randint(5, 12))) + " " + before
            if kind:
                truth.add((kind, len(text), len(text) + len(value)))
            text += value + after + " "
        result.append((text + "end", truth))
    return result


def test_added_spans_on_planted_data(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(planted(1, 1500))], "doc_id long, text string").repartition(5)
    model = pii.fit(docs)
    assert not any("near" in f or "form" in f for f in model)
    held_out = planted(2, 600)
    rows = pii.find_spans(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(held_out)], "doc_id long, text string"), model).collect()
    found = {(x["doc_id"], s["kind"], s["start"], s["end"]) for x in rows for s in x["spans"] if not s["base"]}
    truth = {(i, *span) for i, (_, spans) in enumerate(held_out) for span in spans}
    figures = {}
    for kind in pii.ADDED:
        said, there = {f for f in found if f[1] == kind}, {f for f in truth if f[1] == kind}
        figures[kind] = (len(said & there) / max(1, len(said)), len(said & there) / len(there))
    assert all(precision >= 0.95 and recall >= 0.9 for precision, recall in figures.values()), figures
    plain = "then it went over the General Public road and the North Sea, with 4417744280351548 or some-long-function-name-2"
    assert pii.find_spans(spark.createDataFrame([(1, plain)], "doc_id long, text string"), model).first()["spans"] == []


def test_decoding_makes_no_merges_and_takes_documents_by_the_thousand(spark, path, monkeypatch):
    """The vocabulary for encoding takes tens of MB in each worker; ten thousand documents take hundreds."""
    given = spark.conf.get(session.ARROW_ROWS)
    try:
        spark.conf.set(session.ARROW_ROWS, "10000")
        docs = spark.createDataFrame([(1, "Some text, twice: some text. é漢"), (2, None)], "doc_id long, text string")
        found = corpus_pipeline.token_ids(spark, docs, "")
        assert int(spark.conf.get(session.ARROW_ROWS)) == session.MOST_ARROW_ROWS
        assert {r.doc_id: r.text for r in found.collect()} == {1: "Some text, twice: some text. é漢", 2: ""}
    finally:
        spark.conf.set(session.ARROW_ROWS, given)
    encoded = bpe.encode(docs, path).toArrow().to_batches()
    runs = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: runs.append(run))
    monkeypatch.setattr(bpe, "vocabulary", None)
    bpe.decode(found.select("doc_id", "ids"), path)
    texts = [t for batch in runs[0](iter(encoded)) for t in batch["text"].to_pylist()]
    assert sorted(texts) == ["", "Some text, twice: some text. é漢"]
