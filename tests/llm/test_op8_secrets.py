from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from itertools import pairwise
from math import log10

import regex

from claimhound.llm.secrets import KEYWORD, KINDS, LEAD, base_spans, common_words, guess_cost, guess_spans, op8_guess_cost, ranks, secret_spans

ANY = {
    "assign": re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile("AKIA[A-Z0-9]+"),
    "hex": re.compile("[0-9a-f]+"),
}
LONG = {"assign": lambda m: len(m[2]) >= 6, "access": lambda m: len(m[0]) >= 20, "hex": lambda m: len(m[0]) >= 24}
HARD = [
    "token=token:abcdefgh", "PASSWORD : 'ab' secret=\"abcdef", "paſſword=abcdefg", "api_key=x apikey = 123456",
    "AKIAAKIA" + "B" * 14, "AKIA" + "B" * 15, "g" + "0a" * 12 + "g", "0a" * 11, "é token=abcdef é AKIA" + "Z" * 16,
    "token = 0123456789abcdef01234567", None, "", "password==abcdef",
]


def plain(text):
    found = [(m.start(), KINDS.index(k), m.end()) for k, p in ANY.items() for m in p.finditer(text or "") if LONG[k](m)]
    return sorted(found)


def digest(spans):
    return hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()


def test_base_spans_equal_plain_patterns():
    for text in HARD:
        assert base_spans(text or "") == plain(text), text


def test_query_equals_plain_patterns(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op8_guess_cost(spark, sf_dir).collect()
    rank = ranks(plain_words(docs.values()))
    assert len(rows) == len(docs)
    for r in rows:
        spans = plain(docs[r.doc_id])
        assert r.base_sha256 == digest(spans)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in spans) for i in range(3)]
        assert r.spans == ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans + guess_spans(docs[r.doc_id] or "", 10, rank)))


def plain_words(texts):
    found = Counter()
    for t in texts:
        small = (t or "").translate({k: k + 32 for k in range(65, 91)})
        small = re.sub(KEYWORD + LEAD, "\x01", small, flags=re.ASCII)
        small = re.sub("\x01" + r"""[^\s"'`<>,;]*""", " ", small, flags=re.ASCII)
        found.update(w for w in regex.split(r"[^\p{L}\p{N}]+", small) if re.fullmatch("[a-z]{3,16}", w))
    return sorted(found, key=lambda w: (-found[w], w))[:30_000]


def cheapest(value, rank):
    """All segmentations, by the price of each kind of segment."""
    low = value.lower()
    plainer = low.translate(str.maketrans("4301$57@!", "aeoisstai"))
    rows = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
    near = {p for r in rows for x, y in pairwise(r) for p in (x + y, y + x)}

    def kind(c):
        return "digit" if c.isdigit() else "upper" if c.isupper() else "lower" if c.isalpha() else "sign"

    def price(k):
        if not value[k].isalpha():
            return 1.0 if value[k].isdigit() else log10(33)
        sounds = ["-" if not c.isalpha() else c in "aeiouy" for c in low[max(0, k - 2) : k + 1]]
        return log10(26) if len(sounds) == 3 and len(set(sounds)) == 1 else log10(6)

    def segments(a, b):
        part, cut = low[a:b], 0.6 if a else 0
        if len(set(map(kind, value[a:b]))) == 1:
            yield cut + sum(map(price, range(a, b)))
        if all(x + y in near for x, y in pairwise(part)):
            yield cut + log10(47) + 0.3 * (b - a - 1)
        if 2 <= b - a <= 16:
            if part in rank:
                yield cut + log10(rank[part]) + (value[a:b] != part) * log10(4)
            elif plainer[a:b] in rank:
                yield cut + log10(rank[plainer[a:b]]) + log10(4)
        d, m, y, s = r"(0[1-9]|[12]\d|3[01])", r"(0[1-9]|1[0-2])", r"(19|20)\d\d", "[-/._]?"
        if re.fullmatch(y + s + m + s + d, part) or re.fullmatch(d + s + m + s + y, part):
            yield cut + log10(120 * 365)
        if re.fullmatch(y, part):
            yield cut + log10(120)
        for unit in range(1, min(16, a) + 1):
            if (b - a) % unit == 0 and part == low[a - unit : a] * ((b - a) // unit):
                yield log10((b - a) // unit + 1)

    def whole(b):
        return 0.0 if not b else min(whole(a) + c for a in range(b) for c in segments(a, b))

    return whole(len(value))


def test_costs_are_the_least_of_all_segmentations():
    rank = ranks(["elephant", "giraffe", "the", "cat"])
    rng = random.Random(8)
    values = ["hunter2", "aab1", "qwe12", "Pa55wd", "abab9ab9", "xK9$m", "cat2024x", "01012020", "20200101", "tHecat", "strngths", "aeiouu", "asdfgh1", "Adm1nQ"]
    values += ["".join(rng.choice("abet12Q$3") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    for value in values:
        assert abs(guess_cost(value, rank) - cheapest(value, rank)) < 1e-9, value


def test_words_of_the_documents_are_cheap_and_random_letters_are_not(spark):
    kept = "xqzvkwpjtrmb"
    texts = [f"An Elephant met a GIRAFFE {k}" for k in range(5)] + [f"pwd: {kept}", "passphrase elephantgiraffe", "login ------------> jkqzvxwpqtn9", None, ""]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: [texts[r.doc_id][s.start : s.stop] for s in r.spans if s.kind == "guess"] for r in secret_spans(df).collect()}
    assert got == {k: [] for k in range(len(texts))} | {5: [kept], 7: ["jkqzvxwpqtn9"]}
    assert guess_cost("elephantgiraffe") > 10
    assert [tuple(r) for r in common_words(df, 3).collect()] == [("elephant", 5), ("giraffe", 5), ("met", 5)]


def test_long_texts(spark):
    texts = ["password " * 100_000, "pin" + " " * 300_000 + "x", "token: " + "g1" * 50_000, "pwd " * 50_000 + "Zq8#kkPw2m"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(s.kind, s.start, s.stop) for s in r.spans] for r in secret_spans(df).collect()}
    assert got == {0: [], 1: [], 2: [("assign", 0, 100_007)], 3: [("guess", 200_000, 200_010)]}


def test_what_is_cheap_and_what_is_not():
    cheap = ["password", "P@ssw0rd", "qwertyuiop", "20240131", "abcabcabcabc", "aaaaaaaaaaaaaaaaaaaa", "required", "letmein123"]
    dear = ["b7db7aa4a5fcc78305", "xK9$mP2vQ!", "Tr0ub4dor&3x9"]
    assert max(map(guess_cost, cheap)) < 10 <= min(map(guess_cost, dear)) and guess_cost("") == 0
    assert guess_cost("k9" * 5) < guess_cost("k9x2m4q8z7") and guess_cost("ab" * 50_000) < 12


def test_contexts(spark):
    text = "the password is xK9$mP2vQ!7, pwd: \"b7Tdb7aa4a5f\" secret token: Zq8#kkPw2m; the token was required"
    spans = [(text[a:b]) for a, _, b in guess_spans(text)]
    assert spans == ["xK9$mP2vQ!7", "b7Tdb7aa4a5f", "Zq8#kkPw2m"]
    df = spark.createDataFrame([(1, text, "x"), (None, None, "x"), (1, text, "x")], "doc_id long, text string, spans string")
    rows = secret_spans(df).collect()
    assert sorted(len(r.spans) for r in rows) == [0, 3, 3]
    assert secret_spans(df.limit(0)).count() == 0
