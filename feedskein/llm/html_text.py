"""Main text of HTML pages by two passes of block rules.

A page is cut into blocks at block-level tags. Menus, footers, forms, adverts, comments and the
like are out and say nothing about the rest. First pass: each other block is judged alone, by its
length, its link density and its density of stop words: good, bad, or ambiguous. Second pass:
ambiguous blocks take the label of the nearest decided neighbours; where the two sides differ, of
the nearer one, a heading that of what follows it. To stand in an article weighs one step: what the first
pass finds bad for its words or links is ambiguous there, and what is ambiguous after it is good,
but for short blocks between bad ones of the article. Blocks of an article that hold little but
links are out where several follow each other; one or two are its text, and so are its headings.

Stop words are learned: of each language that pages declare, and of the table as a whole, the words
that make up at least one in FREQUENT of all words of running text, counted over all pages. They
add to a short list, which alone is known of few pages. In scripts without spaces between words a
character is a word. On a page with hardly any known word blocks are judged by length and links.

Inside an article a class or id takes a part out only if all its words name parts of pages. Inline
elements that are hidden, buttons or adverts are left out of their block.

Markup is read in one linear pass. A page cut off in the middle keeps the text before the cut.
"""

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedskein.session import written

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:-->|--!>|\Z))"
    r"|<(?:svg|math)(?=[\s/>])(?:[^>\"'=/]++|/(?!>)|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)|[=\"'])*+/>"
    r"|<(?P<raw>script|style|textarea|title|noscript|iframe|xmp|noembed|noframes|template|svg|math|select|object)(?=[\s/>]).*?(?:</(?P=raw)(?=[\s/>])[^>]*(?:>|\Z)|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"'=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[=\"'])*+)(?:>|\Z)"
    r"|<(?:[!?][^>]*+|/[^a-zA-Z>][^>]*+|/)(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)

# Elements and names that pages use for their parts, and frequent words.
BLOCKS = frozenset(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup "
    "option p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXT = HEADINGS | {"p", "blockquote"}
OUT = frozenset("nav footer aside form button menu dialog fieldset head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUT_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|sidebar|side|rail|"
    r"menu|nav|navbar|navigation|breadcrumbs?|comments?|commentlist|respond|replies|disqus|share|sharing|social|related|recommend\w*|"
    r"footer|foot|popup|modal|overlay|newsletter|subscri\w*|signup|login|pagination|pager|widget|toolbar|skip|masthead|"
    r"topbar|header|hidden|paywall|author-bio|tags|byline-links)(?:$|[\s_-])", re.I)
PART_WORDS = frozenset(
    "area articles bar block body box btn button buttons card container content form group icons inner item items link links list "
    "panel placeholder posts row section slot stories top unit widget widgets wrap wrapper".split()
)
ADVERTS = re.compile(r"ads?|advert\w*|sponsor\w*|promo\w*|cookies?|consent|gdpr|newsletter|subscri\w*|hidden|paywall")
_HEADER = re.compile("header", re.I)
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
STOP_WORDS = frozenset((
    "the of and to in is that it for on with as are was be by this at from or an not have but they which you were their "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass "
    "le la les de des et en un une du que est pour qui dans par sur pas au plus avec ce il sont aux "
    "el los las y del se por con para una su al lo como más o pero sus ha me sin sobre este ya entre"
).split())

SHORT, LONG = 70, 200
HIGH_LINKS, LOW_STOPS, HIGH_STOPS = 0.4, 0.1, 0.3
ALL_LINKS, SEVERAL = 0.9, 3
UNKNOWN = 0.02  # a page with a smaller share of stop words is in a language nobody knows
# A stop word is one in FREQUENT words or more, so there are at most as many; a language is named by
# two letters, so there are at most 676; and words are of at most LONGEST characters.
FREQUENT, LEAST, LONGEST = 500, 20, 20
COUNTED = 200_000  # words a task counts before it passes the counts on
GOOD, BAD, OPEN = 1, -1, 0


class _Block:
    __slots__ = ("parts", "linked", "size", "place", "heading")

    def __init__(self, place, heading):
        self.parts, self.linked, self.size, self.place, self.heading = [], 0, 0, place, heading


def _names_a_part(value, text):
    """Whether a class or id in an article says no more than that it is a part of the page: each
    word of one of its names is such a word, as in `share-buttons`, but not in `market-share`.
    Of elements of text, only adverts and the like are."""
    out = ADVERTS.fullmatch if text else OUT_NAMES.search
    for token in value.lower().split():
        words = [w for w in re.split(r"[_-]+", token) if w]
        if any(out(w) for w in words) and all(w in PART_WORDS or out(w) for w in words):
            return True
    return False


def _is_out(name, rest, inside):
    if name in OUT or name == "header" and inside != GOOD:
        return True
    if not rest or name in ("html", "body", "article", "main"):
        return False
    for m in _ATTRIBUTE.finditer(rest):
        key, value = m.group(1).lower(), next((v for v in m.groups()[1:] if v is not None), "")
        if key in ("class", "id"):
            if inside == GOOD:  # an article's own header holds its title
                if _names_a_part(_HEADER.sub("", value), name in TEXT):
                    return True
            elif OUT_NAMES.search(value):
                return True
        if key == "role" and value.lower() in OUT_ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True
        if key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
    return False


def blocks(page: str):
    """[(text, linked share, place, whether in a heading)] of a page: place is GOOD inside an
    article, BAD inside a part that is out, OPEN elsewhere. Text has its references decoded and
    white space joined."""
    found, open_tags, places, links, at = [], [], [(OPEN, False)], 0, 0
    skipped, depth = None, 0  # an inline element that is out, and how many of its name are open
    current = _Block(OPEN, False)

    def add(text):
        if text and not skipped:
            current.parts.append(text)
            if links:
                current.linked += len(text) - text.count(" ")

    for m in _TOKEN.finditer(page):
        add(page[at:m.start()])
        at = m.end()
        name = m.group("name")
        if not name:
            continue
        name = name.lower()
        if name == skipped:
            depth += -1 if m.group("close") else 1
            if not depth:
                skipped = None
        elif name in BLOCKS:  # ends an inline element that was not closed
            skipped = None
        elif not skipped and name not in VOID and not m.group("close") and places[-1][0] != BAD and _is_out(name, m.group("rest"), GOOD):
            skipped, depth = name, 1
        if name == "br":
            add(" ")
        elif name == "a":
            links = 0 if m.group("close") else 1
        elif name in BLOCKS:
            if current.parts:
                found.append(current)
            links = 0
            if m.group("close"):
                if name in open_tags:
                    while open_tags.pop() != name:
                        places.pop()
                    places.pop()
            elif name not in VOID:
                if name == "p" and open_tags and open_tags[-1] == "p" or name == "li" and open_tags and open_tags[-1] == "li":
                    open_tags.pop()
                    places.pop()
                inside, heading = places[-1]
                if inside != BAD and _is_out(name, m.group("rest"), inside):
                    inside = BAD
                elif inside == OPEN and name in ("article", "main"):
                    inside = GOOD
                open_tags.append(name)
                places.append((inside, heading or name in HEADINGS))
            current = _Block(*places[-1])
    last = page[at:]
    add(last)
    if current.parts:
        found.append(current)
    result = []
    for block in found:
        text = " ".join(html.unescape("".join(block.parts)).split())
        if text:
            solid = max(1, len(text) - text.count(" "))
            result.append((text, min(1.0, block.linked / solid), block.place, block.heading))
    return result


_WORD = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff]|[^\W\d_]+")
_LANGUAGE = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2})(?![a-z])", re.I)
_RUNNING = re.compile(r"<(script|style)\b.*?(?:</\1|\Z)|>([^<>]{%d,})" % SHORT, re.S | re.I)


def words_of(text):
    return _WORD.findall(text.lower())


def language_of(page):
    """The two letters of the language a page declares, or ''."""
    found = _LANGUAGE.search(page)
    return found.group(1).lower() if found else ""


def count_words(pages: DataFrame, html_column="html") -> DataFrame:
    """(lang, word, n) of the running text of all pages: stretches of at least SHORT characters
    without markup. The empty word counts all words. Pages declare lang; '' is none."""

    def run(batches):
        counts = Counter()

        def taken():
            langs, words = zip(*counts) if counts else ((), ())
            return pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(counts.values(), pa.int64())], ["lang", "word", "n"])

        for batch in batches:
            for page in batch[0].to_pylist():
                if not page:
                    continue
                lang = language_of(page)
                for _, text in _RUNNING.findall(page):
                    words = words_of(html.unescape(text))
                    counts[lang, ""] += len(words)
                    counts.update((lang, w) for w in words if len(w) <= LONGEST)
                if len(counts) > COUNTED:
                    yield taken()
                    counts.clear()
        yield taken()

    parts = pages.select(F.col(html_column).alias("_html")).mapInArrow(run, "lang string, word string, n long")
    return parts.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def frequent_words(pages: DataFrame, html_column="html") -> dict:
    """The learned stop words by language, under '' those of the whole table. A word must occur LEAST times."""
    counts = written(count_words(pages, html_column), "words")
    counts = counts.filter("lang <> ''").unionByName(counts.groupBy("word").agg(F.sum("n").alias("n")).withColumn("lang", F.lit("")))
    totals = counts.filter("word = ''").select("lang", F.col("n").alias("total"))
    kept = counts.filter(F.col("word") != "").join(totals, "lang").filter((F.col("n") >= LEAST) & (F.col("n") * FREQUENT >= F.col("total")))
    learned = {}
    for lang, word in kept.select("lang", "word").collect():
        learned.setdefault(lang, set()).add(word)
    return {lang: frozenset(words) for lang, words in learned.items()}


def _stop_density(words, known):
    return sum(w in known for w in words) / max(1, len(words))


def _nearest(labels):
    """(the nearest decided label before each, how far it is); OPEN without one."""
    found, nearest, far = [], OPEN, 0
    for label in labels:
        far += 1
        found.append((nearest, far))
        if label:
            nearest, far = label, 0
    return found


def _both_sides(labels):
    return list(zip(_nearest(labels), reversed(_nearest(labels[::-1]))))


def _link_lists(found):
    """Whether each block is of an article and one of several in a row that hold little but links."""
    listed, begin = [False] * len(found), 0
    for i, (_, linked, place, heading) in enumerate([*found, ("", 0, OPEN, False)]):
        if place != GOOD or heading or linked <= ALL_LINKS:
            if i - begin >= SEVERAL:
                listed[begin:i] = [True] * (i - begin)
            begin = i + 1
    return listed


def _alone(text, linked, place, stops):
    """The first pass: the label of a block by itself. stops is None where no word is known."""
    if linked > HIGH_LINKS:
        return OPEN if place == GOOD else BAD
    if len(text) < SHORT:
        return BAD if place == OPEN and (linked > 0 or "\u00a9" in text) else OPEN
    if stops is None or stops >= HIGH_STOPS:
        return GOOD if len(text) > LONG else OPEN
    return OPEN if stops >= LOW_STOPS or place == GOOD else BAD


def _inherited(sides, heading):
    """The label of an ambiguous block outside of articles, from (label, distance) on both sides."""
    (before, far), (after, further) = sides
    if heading and after:
        return after
    if before and after and before != after:
        return before if far < further else after if further < far else BAD
    return before or after or BAD


def judge_blocks(found, known=STOP_WORDS):
    """GOOD or BAD for each block, by both passes."""
    words = [words_of(text) if place != BAD else [] for text, _, place, _ in found]
    all_words = [w for some in words for w in some]
    strange = _stop_density(all_words, known) < UNKNOWN
    labels = [
        BAD if listed or place == BAD else _alone(text, linked, place, None if strange else _stop_density(some, known))
        for (text, linked, place, _), some, listed in zip(found, words, _link_lists(found))
    ]
    if GOOD not in labels:  # of a page of short paragraphs, those are its text
        labels = [GOOD if not label and place == OPEN and len(text) >= SHORT else label for label, (text, _, place, _) in zip(labels, found)]
    # for an article's blocks those outside say nothing, and its headings and longer ones are text
    own = [label or (GOOD if heading or len(text) >= SHORT else OPEN) for label, (text, _, place, heading) in zip(labels, found) if place == GOOD]
    inside = iter(zip(own, _both_sides(own)))
    judged = iter(_both_sides([label for label, (_, _, place, _) in zip(labels, found) if place != BAD]))
    settled = []
    for label, (_, _, place, heading) in zip(labels, found):
        sides = next(judged) if place != BAD else None
        if place == GOOD:
            label, ((before, _), (after, _)) = next(inside)
            label = label or (BAD if before == after == BAD else GOOD)
        settled.append(label or _inherited(sides, heading))
    return settled


def main_text(page, learned=None) -> str:
    """The text of the good blocks, one per line; '' for null or empty pages and pages without
    any. learned: `frequent_words`."""
    if not page:
        return ""
    found, learned = blocks(page), learned or {}
    known = STOP_WORDS | (learned.get(language_of(page)) or learned.get("") or frozenset())
    return "\n".join(text for (text, *_), label in zip(found, judge_blocks(found, known)) if label == GOOD)


def extract_text(pages: DataFrame, html_column="html", keep=("page_id", "url"), learned=None) -> DataFrame:
    """The columns `keep` of pages with text, the main text. Null pages and an empty table give ''
    and no rows; equal rows stay as many. learned: the stop words of other pages; if None those
    of these pages are learned, which reads them once more."""
    learned = frequent_words(pages, html_column) if learned is None else learned
    given = pages.select(*keep, F.col(html_column).alias("_html"))
    schema = given.drop("_html").schema.add("text", "string")

    def run(batches):
        for batch in batches:
            texts = pa.array([main_text(p, learned) for p in batch["_html"].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in keep], texts], [*keep, "text"])

    return given.mapInArrow(run, schema)
