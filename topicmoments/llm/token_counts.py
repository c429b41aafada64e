"""Token counts by merging ragged arrays of pre-tokens in rank-synchronous rounds."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from topicmoments.llm.common import flat, scan_texts, text_bytes
from topicmoments.llm.merges import MergeTable, merge_ragged

#: Pre-tokens of the word-end vocabulary (fixed value of the format).
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Different space-parted pieces whose counts a task remembers.
MEMORY = 1 << 19


def lowered(text: str) -> str:
    """Composed form, then every character lowered by itself (a capital sigma never by its place)."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


class PieceCounter:
    """Counts the tokens of pieces of text that hold no blank."""

    def __init__(self, table: MergeTable) -> None:
        self.table = table
        self.pattern = regex.compile(WORD_PATTERN + r"|\n")
        self.special = regex.compile("|".join(map(regex.escape, table.special)))

    def count(self, pieces: list[bytes]) -> np.ndarray:
        """Tokens of each piece. Pieces are put line by line, so that all are read at once."""
        counts = np.zeros(len(pieces), dtype=np.int64)
        if not pieces:
            return counts
        text = b"\n".join(pieces).decode("utf-8", "replace")
        if "<|" in text:
            for i, line in enumerate(lines := text.split("\n")):
                if "<|" in line:
                    counts[i] = len(self.special.findall(line))
                    lines[i] = self.special.sub(" ", line)
            text = "\n".join(lines)
        # neither blanks nor line ends are part of a token, so both can mark where one ends
        data = np.frombuffer(" ".join(self.pattern.findall(lowered(text))).encode(), dtype=np.uint8)
        if not len(data):
            return counts
        stops = np.append(np.flatnonzero(data == 0x20), len(data))
        starts = np.append(0, stops[:-1] + 1)
        mark = data[starts] == 0x0A
        owner = np.cumsum(mark)[~mark]
        starts, stops = starts[~mark], stops[~mark]
        if not len(starts):
            return counts
        symbols = self.table.symbols[data]
        symbols[stops - 1] = self.table.last_symbols[data[stops - 1]]
        inside = np.ones(len(data), dtype=bool)
        inside[(data == 0x20) | (data == 0x0A)] = False
        _, left = merge_ragged(self.table, symbols[inside], stops - starts)
        counts += np.bincount(owner, weights=left, minlength=len(pieces)).astype(np.int64)
        return counts


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 2048) -> DataFrame:
    """Bytes and tokens of every whole text: the id, n_bytes, n_tokens, over_limit.

    `tokenizer` is the path of a byte-level word-end vocabulary on the driver; its table, whose
    size the vocabulary fixes, is broadcast. No begin, end or added tokens are counted; strings of
    special tokens inside a text are one token each. Blanks never lie inside a token, so a text is
    the sum of its blank-parted pieces and equal pieces are merged once.

    Null texts and empty texts have 0 bytes and 0 tokens. Every row gives one row, repeated ids
    and null ids included; other columns are not read, whatever their names.
    """
    table = docs.sparkSession.sparkContext.broadcast(MergeTable.read(tokenizer).__dict__)

    def start() -> Callable[[pa.Array], list[pa.Array]]:
        counter = PieceCounter(MergeTable(table.value))
        known: dict[bytes, int] = {}

        def work(texts: pa.Array) -> list[pa.Array]:
            data, offsets = text_bytes(texts)
            whole = data.tobytes()
            split = [whole[a:b].split() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            new = list(set().union(*split) - known.keys())
            if len(known) + len(new) > MEMORY:
                known.clear()
                new = list(set().union(*split))
            known.update(zip(new, counter.count(new).tolist()))
            tokens = np.array([sum(map(known.__getitem__, s)) for s in split], dtype=np.int64)
            return [pa.array(np.diff(offsets)), pa.array(tokens), pa.array(tokens > limit)]

        return work

    return flat(scan_texts(docs, text_col, [id_col], "n_bytes long, n_tokens long, over_limit boolean", start))
