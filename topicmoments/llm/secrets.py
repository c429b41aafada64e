"""Secret scans: patterns, and guess costs of values that stand where credentials do."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicmoments.llm.common import flat, pieces, scan_texts, written

# fixed values: the base patterns, and the least length of a match (or of its value)
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_LENGTH = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "guess")

#: Words after which a value is looked at besides those of the base pattern, and a cheap sign of them.
CONTEXT = re.compile(r"""(?:pwd|pass|passphrase|passcode|credentials?|private_?key|access_?key|login|bearer)["']?\x20*[:=]\x20*["']?([^\s"'<>,;]{6,})""", re.I)
CONTEXT_WORDS = ("pwd", "pass", "credential", "private", "access", "login", "bearer")
#: Bits of guessing from which a value is taken for a real secret.
MIN_BITS = 36.0
#: Words in the guesser's dictionary, a model parameter: the most frequent ones of the whole corpus.
DICTIONARY = 20_000
WORD = re.compile(r"[^\W\d_]{3,20}")
LONGEST_WORD = 20

# fixed values: the rows of a keyboard and runs that people type
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("0134578@$", "oieastbas")
DATES = tuple(re.compile(p) for p in (
    r"(?:19|20)\d\d(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])", r"(?:0[1-9]|[12]\d|3[01])(?:0[1-9]|1[0-2])(?:19|20)\d\d",
    r"(?:19|20)\d\d([-/.])(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01])", r"(?:0?[1-9]|[12]\d|3[01])([-/.])(?:0?[1-9]|1[0-2])\1(?:19|20)\d\d",
    r"(?:0[1-9]|[12]\d|3[01])(?:0[1-9]|1[0-2])\d\d", r"(?:19|20)\d\d"))
YEARS = 150
#: Longest unit of a repeat, shortest and longest walk.
UNIT, WALK, LONG_WALK = 8, 3, 24
#: Bits for changing from one kind of segment to the next.
SEGMENT_BITS = 1.0


def neighbours() -> dict[str, set[str]]:
    """Keys that touch: beside each other, or in the next row at the same place or one before."""
    found: dict[str, set[str]] = {}
    for r, row in enumerate(ROWS):
        for c, key in enumerate(row):
            near = [(r, c + 1), (r + 1, c), (r + 1, c - 1)]
            for y, x in near:
                if y < len(ROWS) and 0 <= x < len(ROWS[y]):
                    found.setdefault(key, set()).add(ROWS[y][x])
                    found.setdefault(ROWS[y][x], set()).add(key)
    return found


NEAR = neighbours()


def brute_bits(char: str) -> float:
    """Bits of one character that follows no rule."""
    if char.isdigit():
        return math.log2(10)
    return math.log2(26) if char.isalpha() and char.isascii() else math.log2(33)


def case_bits(word: str) -> float:
    """Bits for which letters are capital: none, the first or all are cheap."""
    upper = sum(c.isupper() for c in word)
    if not upper:
        return 0.0
    if upper == len(word) or upper == 1 and word[0].isupper():
        return 1.0
    return math.log2(math.comb(len(word), min(upper, len(word) - upper)) + 1)


def segments(value: str, ranks: dict[str, int]) -> Iterator[tuple[int, int, float]]:
    """Stretches of a value that follow a rule: begin, end, bits."""
    n, low = len(value), value.lower()
    if len(low) != n:  # a letter whose small form is longer
        low = value
    plain = low.translate(LEET)
    for i in range(n):
        for j in range(i + 3, min(n, i + LONGEST_WORD) + 1):
            rank, leet = ranks.get(low[i:j]), 0.0
            if rank is None:
                rank, leet = ranks.get(plain[i:j]), 2.0
            if rank is not None:
                yield i, j, math.log2(rank + 1) + leet + case_bits(value[i:j])
    for pattern in DATES:
        at = 0
        while match := pattern.search(value, at):
            at = match.start() + 1
            years = YEARS if match.end() - match.start() != 6 else 100
            yield match.start(), match.end(), math.log2(years * (366 if len(match[0]) > 4 else 1)) + 2 * (not match[0].isdigit())
    for unit in range(1, UNIT + 1):
        run = 0
        for i in range(n - unit - 1, -1, -1):
            run = run + 1 if value[i] == value[i + unit] else 0
            times = run // unit + 1
            if times >= (3 if unit == 1 else 2):
                yield i, i + times * unit, sum(map(brute_bits, value[i:i + unit])) + math.log2(times)
    for kind in (lambda a, b: b in NEAR.get(a, ()), lambda a, b: ord(b) - ord(a) == 1, lambda a, b: ord(a) - ord(b) == 1):
        i = 0
        while i < n - 1:
            j = i + 1
            while j < n and kind(low[j - 1], low[j]):
                j += 1
            turns = 0
            for k in range(i, j - WALK + 1):
                for end in range(k + WALK, min(j, k + LONG_WALK) + 1):
                    turns = sum(ord(low[t + 1]) - ord(low[t]) != ord(low[t]) - ord(low[t - 1]) for t in range(k + 1, end - 1)) if end - k <= 6 else end - k
                    yield k, end, math.log2(47) + math.log2(end - k) + 0.5 * turns
            i = max(j, i + 1)


def guess_bits(value: str, ranks: dict[str, int]) -> float:
    """Bits of the cheapest way to put the value together from words, dates, repeats, keyboard and
    alphabet walks and single characters."""
    by_end: dict[int, list[tuple[int, float]]] = {}
    for i, j, bits in segments(value, ranks):
        by_end.setdefault(j, []).append((i, bits + SEGMENT_BITS))
    best = [0.0] * (len(value) + 1)
    for j in range(1, len(value) + 1):
        best[j] = min([best[j - 1] + brute_bits(value[j - 1]), *(best[i] + bits for i, bits in by_end.get(j, ()))])
    return best[-1]


def base_spans(text: str, low: str) -> Iterator[tuple[int, int, int, int]]:
    """(begin, kind, end, begin of the value) of each match of a base pattern."""
    if any(w in low for w in ASSIGN_WORDS):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= ASSIGN_LENGTH:
                yield m.start(), 0, m.end(), m.start(2)
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            yield m.start(), 1, m.end(), m.start()
    for m in HEX.finditer(text):
        yield m.start(), 2, m.end(), m.start()


def corpus_words(docs: DataFrame, text_col: str = "text", size: int = DICTIONARY) -> dict[str, int]:
    """The ranks, from 1, of the corpus's most frequent words, counted over all whole texts.

    Tasks add up their counts before the shuffle; only the `size` words of the dictionary, with at
    most 20 letters each, come to the driver. Ties go to the earlier word.
    """
    packed = docs.select(F.lit(0).alias("row"), docs[text_col].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for piece in pieces(batch, 1):
                for text in piece.column(1).to_pylist():
                    counts.update(WORD.findall((text or "").lower()))
                if len(counts) > 1 << 19:
                    yield out()
                    counts.clear()
        yield out()

    counted = written(packed.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    # the least power of two that so many words reach: else every task would send `size` words to the driver
    steps = counted.groupBy(F.floor(F.log2("n")).alias("step")).agg(F.count("*").alias("words")).orderBy(F.desc("step")).collect()
    least, words = 0, 0
    for row in steps:
        least, words = row["step"], words + row["words"]
        if words >= size:
            break
    counted = counted.filter(F.col("n") >= 1 << least)
    return {r["word"]: i for i, r in enumerate(counted.orderBy(F.desc("n"), "word").limit(size).collect(), 1)}


def scan_secrets(docs: DataFrame, ranks: dict[str, int], id_col: str = "doc_id", text_col: str = "text",
                 min_bits: float = MIN_BITS) -> DataFrame:
    """Secrets in every whole text: the id and `spans`, an array of (kind, start, end, bits).

    Kinds: assign, access, hex are the base patterns, from left to right without overlaps within a
    kind. guess: the value of a credential context (after a word of the base or the wider list)
    whose cheapest way of guessing costs at least `min_bits`; `bits` is that cost, else null.
    Places are code points, ends exclusive; spans are ordered by start, kind as listed, and end.
    `ranks` is the guesser's dictionary (see `corpus_words`); its size is a parameter, so it is sent
    to all tasks. A value is priced whole, however long, and equal values in a task once.

    Null and empty texts have no spans. Every row gives one row, repeated and null ids included;
    other columns are not read, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def start() -> Callable[[pa.Array], list[pa.Array]]:
        words = shared.value
        priced: dict[str, float] = {}

        def bits(value: str) -> float:
            if value not in priced:
                if len(priced) > 1 << 16:
                    priced.clear()
                priced[value] = guess_bits(value, words)
            return priced[value]

        def spans(text: str | None) -> list[dict[str, object]]:
            if not text:
                return []
            low = text.lower()
            found = list(base_spans(text, low))
            values = {(begin, end) for _, kind, end, begin in found if kind == 0}
            if any(w in low for w in CONTEXT_WORDS):
                values |= {m.span(1) for m in CONTEXT.finditer(text)}
            out = [(begin, kind, end, None) for begin, kind, end, _ in found]
            out += [(begin, 3, end, b) for begin, end in values if (b := bits(text[begin:end])) >= min_bits]
            return [{"kind": KINDS[k], "start": s, "end": e, "bits": b} for s, k, e, b in sorted(out, key=lambda x: x[:3])]

        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("bits", pa.float64())]))

        def work(texts: pa.Array) -> list[pa.Array]:
            return [pa.array([spans(t) for t in texts.to_pylist()], kind)]

        return work

    return flat(scan_texts(docs, text_col, [id_col], "spans array<struct<kind:string,start:long,end:long,bits:double>>", start))
