"""Secret scans (op8): patterns, and password guess costs in credential contexts.

Three patterns give the base spans: ``assign``, ``access`` and ``hex``. Beyond
them, a value that stands in a credential context ("the password is ...",
``pwd: ...``, ``Bearer ...``) is a span of kind ``guess`` if it is costly to
guess: the cheapest way to cut it into common words, dates, repeats, keyboard
walks and brute-force runs, found by dynamic programming, needs at least
10**``MIN_COST`` guesses. Sentences ("the password is required") stay below.

A word costs its rank: first a few that passwords are made of, then the
``MOST_WORDS`` words that all documents use most, counted by Spark; what tasks
receive of them has that bound. Letters of runs are cheap while the run can be
pronounced, and cost an alphabet's guesses where consonants or vowels pile up.

A regular-expression engine of linear time first finds the texts that can hold
a span at all; only those are scanned in Python.

Cases: a null or empty text has no spans; offsets are code points, ends
exclusive; repeated rows are scanned each; an empty table gives an empty one;
extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterator
from math import log10

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimhound.llm.staging import staged, table

# The three base patterns and their least lengths.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII | re.IGNORECASE,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "guess")

#: What announces a value. The value may follow a second keyword, so only the keyword is consumed.
KEYWORD = (
    r"(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|bearer|credentials?|api[_ -]?key"
    r"|access[_ -]?key|private[_ -]?key|auth(?:orization)?|login|pin)"
)
LEAD = r"""["']?[ \t\r\n:=-][ \t\r\n:=>-]*+(?:(?:is|was|are)[ \t\r\n:]{1,3})?["'`]?"""
VALUE = r"""[^\s"'`<>,;]"""
CONTEXT = re.compile(f"{KEYWORD}(?={LEAD}({VALUE}{{6,}}))", re.ASCII | re.IGNORECASE)
#: Matches wherever one of the patterns can; a text without a match has no span.
MAY_HOLD = (
    r"AKIA[A-Z0-9]{16}|[0-9a-f]{24}|(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"
    rf"|(?i:{KEYWORD})[\"']?[ \t\r\n:=-]"
)

MIN_COST = 10.0
MOST_WORDS = 30_000
#: Words of the documents that are counted.
WORD = "^[a-z]{3,16}$"
# Words that passwords are often made of, most common first, and key rows.
COMMON = (
    "password pass word admin root user login test guest welcome qwerty letmein master hello "
    "dragon monkey secret love sun shine moon star summer winter spring autumn football baseball "
    "soccer hockey super batman shadow princess freedom flower cookie computer internet service "
    "server data base change me please home office company money king queen angel magic tiger "
    "silver golden orange purple black white blue green red hunter ranger thunder correct horse "
    "battery staple trust no one access token key api demo sample example default temp null true "
    "false your enter here none required value string"
).split()
RANK = {w: k + 1 for k, w in reversed(list(enumerate(COMMON)))}
LONGEST = 16
ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
NEXT_KEY = {a + b for row in ROWS for a, b in zip(row, row[1:], strict=False)}
NEXT_KEY |= {b + a for a, b in NEXT_KEY}
LEET = str.maketrans("4301$57@!", "aeoisstai")
DAY = r"(?:0[1-9]|[12]\d|3[01])"
MONTH, YEAR, SIGN = r"(?:0[1-9]|1[0-2])", r"(?:19|20)\d\d", "[-/._]?"
DATES = {
    YEAR + SIGN + MONTH + SIGN + DAY: log10(120 * 365),
    DAY + SIGN + MONTH + SIGN + YEAR: log10(120 * 365),
    YEAR: log10(120),
}
#: Guesses for one more character of a run: a letter that can be pronounced, any other, a digit, any sign.
SPOKEN, LETTER, DIGIT, OTHER = log10(6), log10(26), 1.0, log10(33)
CUT_COST = 0.6
LONGEST_UNIT = 16


def _class(c: str) -> str:
    return "0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else "*"


def run_prices(value: str) -> list[float]:
    """What each character costs in a run: a third vowel or consonant in a row is not pronounceable."""
    prices, streak, before = [], 0, ""
    for c in value:
        kind = _class(c)
        if kind in "aA" and c.isascii():
            sound = "v" if c in "aeiouyAEIOUY" else "c"
            streak = streak + 1 if sound == before else 1
            before = sound
            prices.append(SPOKEN if streak <= 2 else LETTER)
        else:
            before = ""
            prices.append(SPOKEN if kind in "aA" else DIGIT if kind == "0" else OTHER)
    return prices


def guess_cost(value: str, rank: dict[str, int] = RANK) -> float:
    """log10 of the guesses that the cheapest segmentation of ``value`` needs.

    Costs of segments add, and each further segment costs ``CUT_COST``, but for
    a repeat of what stands before it. The time is linear in the length: words
    and units of repeats are short, and runs and walks are carried from one
    character to the next.
    """
    low, n = value.lower(), len(value)
    if len(low) != n:  # a few letters have longer small forms
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain = low.translate(LEET)
    best = [0.0] + [float("inf")] * n
    dates: dict[int, list[tuple[int, float]]] = {}
    for pattern, price in DATES.items():
        for m in re.finditer(f"(?=({pattern}))", low, re.ASCII):
            dates.setdefault(m.end(1), []).append((m.start(1), price))
    prices, before_kind, run = run_prices(value), "", float("inf")
    walk = float("inf")
    periods = [0] * (LONGEST_UNIT + 1)
    for j in range(1, n + 1):
        before = best[j - 1] + (CUT_COST if j > 1 else 0.0)
        kind = _class(value[j - 1])
        run = min(run if kind == before_kind else float("inf"), before) + prices[j - 1]
        before_kind, cost = kind, run
        steps = j > 1 and low[j - 2 : j] in NEXT_KEY
        walk = min(walk + 0.3 if steps else float("inf"), before + log10(47))
        cost = min(cost, walk)
        for size in range(2, min(LONGEST, j) + 1):
            a = j - size
            spelt = low[a:j] if low[a:j] in rank else plain[a:j]
            if spelt in rank:
                changed = (value[a:j] != spelt) * log10(4)
                cost = min(cost, best[a] + (CUT_COST if a else 0) + log10(rank[spelt]) + changed)
        for a, c in dates.get(j, ()):
            cost = min(cost, best[a] + (CUT_COST if a else 0) + c)
        for unit in range(1, min(LONGEST_UNIT, j - 1) + 1):
            periods[unit] = periods[unit] + 1 if low[j - 1] == low[j - 1 - unit] else 0
            times = periods[unit] // unit
            if times and periods[unit] % unit == 0:
                cost = min(cost, best[j - times * unit] + log10(times + 1))
        best[j] = cost
    return best[n] if n else 0.0


def common_words(docs: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """word, n: the ``most`` commonest words of letters a to z in all texts, most common first.

    What stands in a credential context is not counted, or secrets would make themselves common.
    Counts are written; how many words have counts of each length in bits says which counts are
    too low for the top, so that few words are sorted.
    """
    text = F.translate(F.col("text").cast("string"), string.ascii_uppercase, string.ascii_lowercase)
    text = F.regexp_replace(text, KEYWORD + LEAD, "\x01")
    text = F.regexp_replace(text, f"\x01{VALUE}*+", " ")
    each = docs.select(F.explode(F.split(text, r"[^\p{L}\p{N}]+")).alias("word"))
    counts = each.where(F.col("word").rlike(WORD)).groupBy("word").agg(F.count("*").alias("n"))
    counts = staged(counts, "word-counts")
    bits = F.length(F.bin("n")).alias("bits")
    words, least = 0, 1
    for r in sorted(counts.groupBy(bits).agg(F.count("*").alias("words")).collect(), reverse=True):
        words += r.words  # a row for each length, so 63 at most
        if words >= most:
            least = 1 << (r.bits - 1)
            break
    return counts.where(F.col("n") >= least).orderBy(F.col("n").desc(), "word").limit(most)


def ranks(words: list[str]) -> dict[str, int]:
    """Guesses for each word: the fixed ones come first, then ``words`` in their order."""
    later = {w: len(COMMON) + k for k, w in enumerate(words, 1)}
    return later | RANK


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """start, kind's place, end: leftmost non-overlapping matches of each kind that are long enough."""
    found = [
        (m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]
    ]
    if "AKIA" in text:
        found += [
            (m.start(), 1, m.end())
            for m in ACCESS.finditer(text)
            if m.end() - m.start() >= LEAST["access"]
        ]
    # maximal runs, as those of any length are; shorter ones need no visit
    found += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    return sorted(found)


LONG_HEX = re.compile(f"{HEX.pattern[:-1]}{{{LEAST['hex']},}}")


def guess_spans(
    text: str, min_cost: float = MIN_COST, rank: dict[str, int] = RANK
) -> list[tuple[int, int, int]]:
    """start, kind's place, end of values in credential contexts that are costly to guess."""
    found = set()
    for m in CONTEXT.finditer(text):
        value = m[1].rstrip(".!?):]}")
        if len(value) >= LEAST["assign"] and guess_cost(value, rank) >= min_cost:
            found.add((m.start(1), 3, m.start(1) + len(value)))
    return sorted(found)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def secret_spans(docs: DataFrame, min_cost: float = MIN_COST) -> DataFrame:
    """Per row of ``docs``: doc_id, spans (array of kind, start, stop)."""
    found = _scanned(docs, min_cost)
    parts = F.filter(F.split("spans", ","), lambda s: s != "")
    each = F.transform(
        parts,
        lambda s: F.struct(
            F.split_part(s, F.lit(":"), F.lit(1)).alias("kind"),
            F.split_part(s, F.lit(":"), F.lit(2)).cast("long").alias("start"),
            F.split_part(s, F.lit(":"), F.lit(3)).cast("long").alias("stop"),
        ),
    )
    return found.select("doc_id", each.alias("spans"))


def _scanned(docs: DataFrame, min_cost: float) -> DataFrame:
    words = [r.word for r in common_words(docs).collect()]  # at most MOST_WORDS short words
    shared = docs.sparkSession.sparkContext.broadcast(ranks(words))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_string()).fill_null("")
            hits = pc.match_substring_regex(texts, MAY_HOLD)
            out = []
            for maybe, text in zip(hits.to_pylist(), texts, strict=True):
                spans = base_spans(text.as_py()) if maybe else []
                more = guess_spans(text.as_py(), min_cost, shared.value) if maybe else []
                digest = hashlib.sha256(_joined(spans).encode()).hexdigest()
                counts = [sum(k == kind for _, k, _ in spans) for kind in range(3)]
                out.append((*counts, digest, _joined(sorted(spans + more))))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=names)

    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.mapInArrow(rows, schema)


def op8_guess_cost(spark, sf_dir: str) -> DataFrame:
    return _scanned(table(spark, sf_dir, "documents"), MIN_COST)
