"""Personal data in text: rules, and weak supervision for what the rules leave open.

Base spans follow fixed rules (`base_spans`) and always stay. Beyond them, candidates are
wider patterns: secrets, account and phone numbers without their marks, names. Labelers vote
on each candidate (yes, no or abstain): by its form, by gazetteers, by the words around it.
Expectation-maximisation over the counted patterns of votes estimates how reliable each
labeler is and how likely each pattern is personal data. These soft labels train the final
classifier, naive Bayes by kind, which decides on spans. It sees no votes but the candidate itself and what
stands around it: its signs, length and entropy, the words and signs beside it, the first word of a name.
Names are found by what stands around them; one in the middle of plain text mostly stays.

All candidates of the corpus are counted. The driver gets the counts of at most MOST_VOTES patterns
of votes and of MOST_FEATURES features, whatever the input: words are hashed. Both scans are map-only.
"""

import bisect
import collections
import itertools
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedskein.llm.arrays import slices
from feedskein.session import written

KINDS = ("email", "ip", "card", "phone")
ADDED = ("secret", "account", "number", "name")

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def _emails(text):
    """Matches of local part, @ and a domain of two labels or more. A part before an @ starts
    where its run of signs does or where the match before ended."""
    ended, found, at = 0, [], text.find("@")
    while at >= 0:
        begin = at
        while begin > ended and _LOCAL.match(text, begin - 1):
            begin -= 1
        domain = _DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            ended = domain.end()
            found.append((begin, ended))
        else:
            ended = at + 1
        at = text.find("@", ended)
    return found


def _luhn(digits):
    total = 0
    for i, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _digits(text):
    return [c for c in text if "0" <= c <= "9"]


def base_spans(text):
    """{kind: [(start, end)]} of a text by the fixed rules, in code points."""
    found = {kind: [] for kind in KINDS}
    if "@" in text:
        found["email"] = _emails(text)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            parts = m.group().split(".")
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts):
                found["ip"].append(m.span())
        for m in _CARD.finditer(text):
            digits = _digits(m.group()) if m.end() - m.start() < 40 else []
            if 13 <= len(digits) <= 19 and _luhn(digits):
                found["card"].append(m.span())
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_digits(m.group())) <= 15:
                    found["phone"].append(m.span())
    return found


# Words that tell of personal data nearby, and common given names.
SECRET_WORDS = ["token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "api-key", "access_key", "auth", "bearer", "credential"]
ACCOUNT_WORDS = ["account", "iban", "acct", "card", "customer", "policy", "passport", "ssn", "konto", "cuenta", "compte"]
PHONE_WORDS = ["phone", "tel", "call", "mobile", "fax", "telefon", "teléfono", "téléphone"]
NAME_WORDS = ["mr", "mrs", "ms", "dr", "prof", "name", "dear", "herr", "frau", "madame", "monsieur", "señor", "señora", "sincerely", "regards"]
GIVEN_NAMES = frozenset((
    "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Paul Steven "
    "Andrew Peter George Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Emily "
    "Anna Laura Maria Julia Alice Emma Sophie Claire Marie Pierre Jean Michel Jacques Hans Klaus Jürgen Stefan "
    "Sabine Ursula Monika Carlos José Juan Luis Miguel Carmen Lucía Sofía"
).split())

_CANDIDATES = {
    "secret": re.compile(r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*[0-9])[A-Za-z0-9_-]{20,}+"),
    "account": re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9]){7,}+"),
    "number": re.compile(r"(?<![0-9A-Za-z+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])"),
    # a title is no part of the name after it
    "name": re.compile(r"(?<![A-Za-zÀ-ÿ])(?!(?:" + "|".join(w.capitalize() for w in NAME_WORDS) + r")(?![a-zà-ÿ]))(?:[A-Z]\. )?[A-Z][a-zà-ÿ]+ [A-Z][a-zà-ÿ]+(?![A-Za-zÀ-ÿ])"),
}
_CONTEXT = {
    "secret": SECRET_WORDS, "account": ACCOUNT_WORDS, "number": PHONE_WORDS, "name": NAME_WORDS,
}
_NEAR = {k: re.compile(r"(?<![^\W\d_])(?:" + "|".join(map(re.escape, w)) + r")(?![^\W\d_])", re.I) for k, w in _CONTEXT.items()}
_WORD_BEFORE = re.compile(r"[.!?]\s*$|\n\s*$|^\s*$")
_TITLE_BEFORE = re.compile(r"(?<![^\W\d_])(?:mr|mrs|ms|dr|prof)\. $", re.I)
YES, NO, NONE = 1, -1, 0


def _entropy(text):
    counts = collections.Counter(text).values()
    return -sum(c / len(text) * math.log2(c / len(text)) for c in counts)


def _vote(condition, yes=YES, no=NONE):
    return yes if condition else no


WORDS = 128  # buckets of the words beside a candidate, and four times as many of given names


def _hashed(word, buckets):
    return zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % buckets


def _sign(text):
    """The class of a character, or an ASCII sign itself."""
    if not text:
        return "end"
    if text.isalpha():
        return "letter"
    if text.isdigit():
        return "digit"
    return text if "!" <= text <= "~" else "line" if text in "\r\n" else "space" if text.isspace() else "other"


def _features(kind, text, start, end):
    """What the classifier sees of a candidate: its form and surroundings, no labeler's vote."""
    value, before, after = text[start:end], text[max(0, start - 60):start], text[end:end + 30]
    words_before = re.findall(r"[^\W\d_]+", before)[-2:]
    word_after = re.search(r"[^\W\d_]+", after)
    solid = before.rstrip()
    found = [
        ("length", min(8, len(value) // 5)), ("digits", 5 * len(_digits(value)) // len(value)),
        ("entropy", min(10, int(2 * _entropy(value.lower())))),
        ("case", (any(c.islower() for c in value), any(c.isupper() for c in value))),
        ("signs", (" " in value, "-" in value, "_" in value, "." in value, "(" in value)),
        ("before", _sign(before[-1:])), ("after", _sign(after[:1])), ("solid", _sign(solid[-1:])),
        ("word", _hashed(words_before[-1], WORDS) if words_before else ""), ("earlier", _hashed(words_before[0], WORDS) if len(words_before) > 1 else ""),
        ("next", _hashed(word_after.group(), WORDS) if word_after else ""),
    ]
    if kind == "name":
        found.append(("given", _hashed(value.split(" ")[-2], 4 * WORDS)))
    return (f"kind={kind}", *(f"{kind} {name}={seen}" for name, seen in found))


def judge(kind, text, start, end):
    """(votes, features) of a candidate: what each labeler says, and what the classifier sees."""
    value, before, after = text[start:end], text[max(0, start - 24):start], text[end:end + 12]
    near = bool(_NEAR[kind].search(before))
    digits = len(_digits(value))
    assigned = bool(re.search(r"[=:]\s*[\"']?$", before))
    quoted = bool(before[-1:]) and before[-1] in "\"'" and after[:1] == before[-1]
    letters = value.lower()
    if kind == "secret":
        form = _vote(digits >= 5 and _entropy(letters) >= 3.0, YES, NO)
        list_vote = _vote(bool(re.fullmatch(r"[0-9a-f]+|[A-Z0-9]+", value)), YES, NONE)
    elif kind == "account":  # a card's number that fails its check is none
        form = _vote(13 <= digits <= 19, NO, NONE)
        list_vote = _vote(len(set(_digits(value))) <= 2, NO, NONE)
    elif kind == "number":
        form = _vote(digits == 10, YES, NO)
        list_vote = _vote(len(set(_digits(value))) <= 2, NO, NONE)
        assigned = assigned or bool(re.search(r"\+[0-9]{1,3}[ -]?$", before))
    else:
        first, last = value.split(" ")[-2:]
        form = _vote(min(len(first), len(last)) < 3, NO, NONE)
        list_vote = _vote(first in GIVEN_NAMES, YES, NO)
    context = _vote(near, YES, NO)
    setting = _vote(assigned or quoted, YES, NONE)
    place = _vote(kind == "name" and bool(_WORD_BEFORE.search(before)) and not _TITLE_BEFORE.search(before), NO, NONE)
    return (form, list_vote, context, setting, place), _features(kind, text, start, end)


def candidates(text, base=None):
    """[(kind, start, end, votes, features)] that no base span contains; those that contain one
    or reach beyond it stay beside it. Of candidates that overlap each other the first in the
    order of ADDED stays; digits that run on into a base span come last, not to hide a number
    that stands before it."""
    base = base_spans(text) if base is None else base
    fixed, taken = _outermost(itertools.chain(*base.values())), []
    found = []
    has_digit = bool(_DIGIT.search(text))
    for kind in ADDED:
        if kind != "name" and not has_digit:
            continue
        for m in _CANDIDATES[kind].finditer(text):
            last = kind in ("account", "number") and _overlaps(fixed, *m.span())
            found.append((last, ADDED.index(kind), *m.span(), kind))
    if not found:
        return []
    kept = []
    for _, _, start, end, kind in sorted(found):
        if not _contained(fixed, start, end) and not _overlaps(taken, start, end):
            kept.append((kind, start, end, *judge(kind, text, start, end)))
            bisect.insort(taken, (start, end))
    return sorted(kept, key=lambda f: (ADDED.index(f[0]), f[1]))


def _outermost(spans):
    """The spans that no other contains, by place: starts and ends both ascend."""
    found = []
    for start, end in sorted(spans, key=lambda s: (s[0], -s[1])):
        if not found or end > found[-1][1]:
            found.append((start, end))
    return found


def _contained(spans, start, end):
    """Whether one of the outermost spans contains a span: the last that starts no later
    reaches farthest."""
    at = bisect.bisect_right(spans, start, key=lambda s: s[0]) - 1
    return at >= 0 and spans[at][1] >= end


def _overlaps(spans, start, end):
    """Whether one of the spans, whose starts and ends both ascend, overlaps."""
    low, high = 0, len(spans)
    while low < high:
        middle = (low + high) // 2
        if spans[middle][1] <= start:
            low = middle + 1
        else:
            high = middle
    return low < len(spans) and spans[low][0] < end


MOST_VOTES = 4 * 3 * 3 * 2 * 2 * 2  # by kind, form, list, context, setting, place
# by kind: itself, length, digits, entropy, case, signs, three signs beside it, three words, given name
MOST_FEATURES = 4 * (1 + 9 + 6 + 11 + 4 + 32 + 3 * 100 + 3 * (WORDS + 1)) + 4 * WORDS


def count_patterns(docs: DataFrame) -> DataFrame:
    """(kind, votes, feature, n): all candidates of docs (_text), counted by votes and feature."""
    def run(batches):
        counts = collections.Counter()
        for batch in batches:
            for text in batch["_text"]:
                text = text.as_py()
                for kind, _, _, votes, features in candidates(text) if text else ():
                    counts.update((kind, votes, f) for f in features)
        rows = sorted(counts.items())
        yield pa.RecordBatch.from_arrays([
            pa.array([k for (k, _, _), _ in rows], pa.string()),
            pa.array([list(v) for (_, v, _), _ in rows], pa.list_(pa.int32())),
            pa.array([f for (_, _, f), _ in rows], pa.string()),
            pa.array([n for _, n in rows], pa.int64()),
        ], ["kind", "votes", "feature", "n"])

    found = docs.select("_text").mapInArrow(run, "kind string, votes array<int>, feature string, n long")
    return found.groupBy("kind", "votes", "feature").agg(F.sum("n").alias("n"))


TRUST = (1, 1, 2, 1, 1)  # where EM starts: what stands around a candidate counts twice, a short list misses most names


def reliabilities(votes, counts, rounds=50, trust=1):
    """EM over patterns of votes: (prior, accuracy of yes votes, of no votes, posterior of each
    pattern). A labeler that says nothing tells nothing. Starts from the majority, each labeler
    counting as `trust` says; the rates keep a small prior weight, so no labeler is ever taken for certain."""
    votes, counts = np.asarray(votes, float), np.asarray(counts, float)
    posterior = 1 / (1 + np.exp(-1.5 * (votes * trust).sum(axis=1)))
    for _ in range(rounds):
        yes, no = counts * posterior, counts * (1 - posterior)
        prior = (yes.sum() + 2) / (counts.sum() + 4)
        says = votes != NONE
        hit = ((yes[:, None] * (votes == YES)).sum(0) + 4) / ((yes[:, None] * says).sum(0) + 5)
        miss = ((no[:, None] * (votes == NO)).sum(0) + 4) / ((no[:, None] * says).sum(0) + 5)
        gain = np.where(votes == YES, np.log(hit / (1 - miss)), np.where(votes == NO, np.log((1 - hit) / miss), 0.0))
        posterior = 1 / (1 + np.exp(-np.clip(math.log(prior / (1 - prior)) + gain.sum(axis=1), -30, 30)))
    return prior, hit, miss, posterior


def soft_labels(patterns):
    """[(kind, votes, how likely it is personal data)] of counted [(kind, votes, n)]. Names outnumber
    all else, two capitals being enough for a candidate, so their labelers are judged apart."""
    labels = []
    for names in (False, True):
        some = [p for p in patterns if (p[0] == "name") == names]
        if some:
            _, _, _, posterior = reliabilities([p[1] for p in some], [p[2] for p in some], trust=TRUST)
            labels += [(kind, votes, float(likely)) for (kind, votes, _), likely in zip(some, posterior)]
    return labels


SMOOTHING, DAMPING = 2.0, 0.5  # features beside each other say much the same, so each counts half


def weigh(counts):
    """The span classifier {feature: weight} from [(kind, feature, n, expected n of personal data)]."""
    total = {kind: (n, hits) for kind, feature, n, hits in counts if feature == f"kind={kind}"}
    weights = {}
    for kind, feature, n, hits in counts:
        of_kind, of_hits = total[kind]
        if feature == f"kind={kind}":
            weights[feature] = math.log((hits + 0.5) / (n - hits + 0.5))
        else:  # where a class is rare its rates are near those of all
            share = SMOOTHING * n / of_kind
            in_hits, in_rest = (hits + share) / (of_hits + SMOOTHING), (n - hits + share) / (of_kind - of_hits + SMOOTHING)
            weights[feature] = DAMPING * math.log(in_hits / in_rest)
    return weights


def fit(docs: DataFrame, text_column="text"):
    """The classifier for docs, from counts over all their candidates."""
    spark = docs.sparkSession
    counts = written(count_patterns(docs.select(F.col(text_column).alias("_text"))), "patterns")
    rows = counts.filter(F.col("feature") == F.concat(F.lit("kind="), "kind")).select("kind", "votes", "n").limit(MOST_VOTES + 1).collect()
    if len(rows) > MOST_VOTES:
        raise ValueError("more patterns than there are votes")
    if not rows:
        return {}
    labels = soft_labels(sorted((r["kind"], tuple(r["votes"]), r["n"]) for r in rows))
    likely = spark.createDataFrame([(k, list(v), p) for k, v, p in labels], "kind string, votes array<int>, likely double")
    expected = counts.join(F.broadcast(likely), ["kind", "votes"]).groupBy("kind", "feature").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("likely")).alias("hits"))
    seen = expected.limit(MOST_FEATURES + 1).collect()
    if len(seen) > MOST_FEATURES:
        raise ValueError("more features than there are")
    return weigh(sorted((r["kind"], r["feature"], r["n"], r["hits"]) for r in seen))


def find_spans(docs: DataFrame, classifier, id_column="doc_id", text_column="text", threshold=0.5) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end, base>>) for each row: the base spans by
    kind and place, then the added ones, whose score under the classifier reaches the
    threshold. A null or empty text has none; each row is judged by itself."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
    least = math.log(threshold / (1 - threshold))

    def run(batches):
        for batch in batches:
            result = []
            for text in batch["_text"]:
                text, spans = text.as_py(), []
                if text:
                    base = base_spans(text)
                    spans = [dict(kind=k, start=s, end=e, base=True) for k in KINDS for s, e in base[k]]
                    for k, s, e, _, features in candidates(text, base):
                        if sum(classifier.get(f, 0.0) for f in features) > least:
                            spans.append(dict(kind=k, start=s, end=e, base=False))
                result.append(spans)
            yield pa.RecordBatch.from_arrays([batch["_id"], pa.array(result, kind)], ["doc_id", "spans"])

    given = docs.select(F.col(id_column).cast("long").alias("_id"), F.col(text_column).alias("_text"))
    return given.mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: long, end: long, base: boolean>>")


def redact(docs: DataFrame, classifier, text_column="text", threshold=0.5, count_column=None) -> DataFrame:
    """docs with each span replaced by its kind: <email>. Of spans that overlap, the earlier
    one and then the longer one counts, joined with what reaches beyond it. All other columns
    stay, but count_column, if given and there, becomes the new length where it was not null;
    a null text stays null."""
    least = math.log(threshold / (1 - threshold))
    schema = docs.schema

    def run(batches):
        for batch in (whole.slice(begin, count) for whole in batches for begin, count in slices(whole.column(text_column))):
            at = batch.schema.get_field_index(text_column)
            texts = [t and _redacted(t, classifier, least) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            if count_column in schema.names:
                place = batch.schema.get_field_index(count_column)
                old = batch.column(place).to_pylist()
                counts = [o if o is None or t is None else len(t) for o, t in zip(old, texts)]
                columns[place] = pa.array(counts, batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, schema)


def _redacted(text, classifier, least):
    base = base_spans(text)
    spans = [(s, -e, k) for k in KINDS for s, e in base[k]]
    for k, s, e, _, features in candidates(text, base):
        if sum(classifier.get(f, 0.0) for f in features) > least:
            spans.append((s, -e, k))
    parts, done = [], 0
    for start, minus_end, kind in sorted(spans):
        if start >= done:
            parts += [text[done:start], f"<{kind}>"]
        done = max(done, -minus_end)
    return "".join([*parts, text[done:]])
