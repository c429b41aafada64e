"""Quality rules: word rules and bands of compression ratios."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from topicmoments.llm.common import flat, scan_texts, text_bytes

#: Marks counted as symbols.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
REPEAT_PERCENT = 50
#: Bytes of a chunk, and the level of compression.
CHUNK = 4096
LEVEL = 3
#: (longest text in bytes, least and greatest compressed share): below a text is repetitive, above
#: it is noise. Short texts compress badly however clean they are.
BANDS: tuple[tuple[float, float, float], ...] = (
    (512, 0.35, 0.95), (1024, 0.32, 0.85), (2048, 0.30, 0.80), (4096, 0.28, 0.75), (8192, 0.26, 0.72), (float("inf"), 0.20, 0.70))
#: The same for every chunk of CHUNK bytes, and the share of chunks that may lie outside.
CHUNK_BAND = (0.22, 0.72)
CHUNKS_OUTSIDE = 0.5
RESULTS = """n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,
             base_failed boolean, ratio double, chunks long, chunks_outside long, kept boolean"""


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window which the text holds twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=n)
    # pairs are numbered again, so that three words fit one number whatever their count
    _, pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)
    runs = pairs[:-1] * len(number) + ids[2:]
    order = np.argsort(runs, kind="stable")
    same = runs[order[1:]] == runs[order[:-1]]
    twice = np.zeros(n - 2, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    steps = np.zeros(n + 1, dtype=np.int64)
    at = np.flatnonzero(twice)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + 3, -1)
    return int((np.cumsum(steps[:-1]) > 0).sum())


def dup_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line of the text."""
    lines = [line for line in text.split(b"\n") if line.split()]
    return len(lines) - len(set(lines))


def scan_quality(docs: DataFrame, keep: Sequence[str], text_col: str = "text", min_words: int = MIN_WORDS,
                 repeat_percent: int = REPEAT_PERCENT, bands: Sequence[tuple[float, float, float]] = BANDS, chunk: int = CHUNK,
                 chunk_band: tuple[float, float] = CHUNK_BAND, chunks_outside: float = CHUNKS_OUTSIDE) -> DataFrame:
    """As `quality_rules`, with the kept input columns in the struct `row`."""

    def start() -> Callable[[pa.Array], list[pa.Array]]:
        packer = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)

        def share(data: bytes) -> float:
            return len(packer.compress(data)) / len(data)

        def measures(text: bytes) -> tuple:
            words = text.split()
            repeated = repeat_words(words)
            failed = len(words) < min_words or 100 * repeated > repeat_percent * len(words)
            ratio = share(text) if text else 0.0
            whole = [text[a:a + chunk] for a in range(0, len(text) - chunk + 1, chunk)]
            outside = sum(not chunk_band[0] <= share(c) <= chunk_band[1] for c in whole)
            low, high = next((low, high) for longest, low, high in bands if len(text) <= longest)
            kept = not failed and low <= ratio <= high and outside <= chunks_outside * len(whole)
            return (len(words), len(b"".join(words).decode("utf-8", "replace")),
                    sum(text.count(SYMBOLS[i:i + 1]) for i in range(len(SYMBOLS))),
                    dup_lines(text), repeated, failed, ratio, len(whole), outside, kept)

        def work(texts: pa.Array) -> list[pa.Array]:
            data, offsets = text_bytes(texts)
            whole = data.tobytes()
            rows = [measures(whole[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            return [pa.array(column) for column in zip(*rows)]

        return work

    return scan_texts(docs, text_col, keep, RESULTS, start)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", **options: object) -> DataFrame:
    """Word measures of every whole text and whether it is kept, by word rules and compression bands.

    Words are parted by space and by tab to carriage return. base_failed: fewer than `min_words`
    words, or more than `repeat_percent` percent of them in three-word windows found twice or more.
    Texts that pass are kept if the share of bytes that zstandard leaves of the whole text lies in
    the band for its length, and at most `chunks_outside` of its full chunks lie outside `chunk_band`:
    a lower share is repetition, a higher one is noise. The bands are parameters, not fitted.

    Null and empty texts have no words, ratio 0 and are not kept. Every row gives one row, repeated
    and null ids included; other columns are not read, whatever their names.
    """
    return flat(scan_quality(docs, [id_col], **options))
