"""Byte-pair encoding and decoding with forced-boundary splitting."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from topicmoments.llm.common import ENTRY_BYTES, Remembered, flat, lists, scan_texts, text_bytes
from topicmoments.llm.merges import MergeTable, merge_ragged
from topicmoments.llm.words import BLANKS

#: Pre-tokens of the byte-level vocabulary (fixed value of the format).
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The longest fragment in bytes that a task remembers.
LONGEST = 256


def forced_pairs(token_bytes: list[bytes]) -> np.ndarray:
    """256 x 256 flags, flat: pairs of bytes that stand side by side in no token.

    No merge can join two such bytes, so a text can be cut between them for certain.
    """
    forced = np.ones(1 << 16, dtype=bool)
    for token in token_bytes:
        for pair in zip(token, token[1:]):
            forced[pair[0] << 8 | pair[1]] = False
    return forced


def after_visible(data: np.ndarray) -> np.ndarray:
    """Whether the byte before each place certainly ends a character that is no white space.

    True after visible ASCII and after two-byte characters from U+00C0 on; other characters
    beyond ASCII are left undecided.
    """
    out = np.zeros(len(data), dtype=bool)
    out[1:] = (data[:-1] > 0x20) & (data[:-1] < 0x7F)
    out[2:] |= (data[1:-1] >= 0x80) & (data[:-2] >= 0xC3) & (data[:-2] <= 0xDF)
    return out


class Fragments:
    """Cuts texts into fragments at forced pairs, encodes each different fragment, and decodes ids."""

    def __init__(self, table: MergeTable, forced: np.ndarray) -> None:
        self.table = table
        self.forced = forced
        self.pattern = regex.compile(BYTE_PATTERN)
        self.special = regex.compile("(" + "|".join(map(regex.escape, table.special)) + ")")
        self.blank = np.isin(np.arange(256), BLANKS)
        self.ids = Remembered()

    def cut(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Places where a fragment begins, the beginnings of texts included.

        A cut is made where a forced pair is a visible character and a blank: there the pattern,
        too, always begins a new pre-token, and nothing before it looks beyond. A text that is only
        a part of the whole gives the same tokens as within it.
        """
        cut = np.zeros(len(data), dtype=bool)
        cut[1:] = self.forced[data[:-1].astype(np.int32) << 8 | data[1:]]
        cut &= self.blank[data] & after_visible(data)
        cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        return np.flatnonzero(cut)

    def _pre_tokens(self, fragments: list[bytes]) -> np.ndarray:
        """Sizes in bytes of the pre-tokens of fragments put one after the other.

        Right only where each border between fragments is a place where `cut` may cut.
        """
        text = b"".join(fragments).decode("utf-8", "replace")
        found = self.pattern.findall(text)
        return np.fromiter((len(t) if t.isascii() else len(t.encode()) for t in found), dtype=np.int64, count=len(found))

    def _merge(self, fragments: list[bytes], pre_sizes: np.ndarray) -> list[np.ndarray]:
        """Cut pre-tokens again at all forced pairs, merge the parts apart and put the ids together."""
        data = np.frombuffer(b"".join(fragments), dtype=np.uint8)
        begins = np.zeros(len(data), dtype=bool)
        begins[1:] = self.forced[data[:-1].astype(np.int32) << 8 | data[1:]]
        begins[np.cumsum(pre_sizes) - pre_sizes] = True
        at = np.flatnonzero(begins)
        ids, left = merge_ragged(self.table, self.table.symbols[data], np.diff(np.append(at, len(data))))
        sizes = np.fromiter(map(len, fragments), dtype=np.int64, count=len(fragments))
        first = np.searchsorted(at, np.cumsum(sizes) - sizes)
        stops = np.concatenate(([0], np.cumsum(left)))[np.append(first, len(at))]
        return [ids[a:b] for a, b in zip(stops[:-1].tolist(), stops[1:].tolist())]

    def encode(self, fragments: list[bytes]) -> list[bytes]:
        """Ids of each fragment, as the bytes of 32-bit numbers."""
        out: list[bytes] = [b""] * len(fragments)
        regular, odd = [], []
        for i, f in enumerate(fragments):
            visible = 0x20 < f[-1] < 0x7F or len(f) > 1 and f[-1] >= 0x80 and 0xC3 <= f[-2] <= 0xDF
            (regular if visible and self.blank[f[0]] and b"<|" not in f else odd).append(i)
        own = [fragments[i] for i in regular]
        if own:
            for i, ids in zip(regular, self._merge(own, self._pre_tokens(own))):
                out[i] = ids.tobytes()
        parts: list[bytes] = []
        places: list[tuple[int, int]] = []
        found: dict[tuple[int, int], bytes] = {}
        sizes = []
        for i in odd:
            for j, part in enumerate(self.special.split(fragments[i].decode("utf-8", "replace"))):
                if part in self.table.special:
                    found[i, j] = np.int32(self.table.special[part]).tobytes()
                elif part:
                    parts.append(part.encode())
                    places.append((i, j))
                    sizes.append(self._pre_tokens([parts[-1]]))
        if parts:
            found.update(zip(places, (ids.tobytes() for ids in self._merge(parts, np.concatenate(sizes)))))
        for i, j in sorted(found):
            out[i] += found[i, j]
        return out

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """Each fragment's ids, in order, and the number of fragments in each text."""
        begins = self.cut(data, offsets)
        whole, stops = data.tobytes(), [*begins[1:].tolist(), len(data)]
        found = [whole[a:b] for a, b in zip(begins.tolist(), stops)]
        new = list(set(found) - self.ids.keys())
        # a fragment has at most one 32-bit id for each of its bytes, and mostly one for four
        if self.ids.room(sum(2 * len(k) + ENTRY_BYTES for k in new if len(k) <= LONGEST)):
            new = list(set(found))
            self.ids.held = sum(2 * len(k) + ENTRY_BYTES for k in new if len(k) <= LONGEST)
        self.ids.update(zip(new, self.encode(new)))
        ids = list(map(self.ids.__getitem__, found))
        for long in [k for k in new if len(k) > LONGEST]:
            del self.ids[long]
        return ids, np.diff(np.searchsorted(begins, offsets))


def encode_texts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and decode it again: the id, `ids` (array of int) and `decoded`.

    `tokenizer` is the path of a byte-level vocabulary on the driver; its table, whose size the
    vocabulary fixes, is broadcast. Nothing is added or truncated; strings of special tokens inside
    a text become their ids. `decoded` is put together from the bytes of the ids.

    Null texts are taken as empty and have no ids and an empty `decoded`. Every row gives one row,
    repeated and null ids included; other columns are not read, whatever their names.
    """
    table = MergeTable.read(tokenizer)
    shared = docs.sparkSession.sparkContext.broadcast((table.__dict__, forced_pairs(table.token_bytes)))

    def start() -> Callable[[pa.Array], list[pa.Array]]:
        state, forced = shared.value
        fragments = Fragments(MergeTable(state), forced)
        spelled = fragments.table.token_bytes.__getitem__

        def work(texts: pa.Array) -> list[pa.Array]:
            ids, parts = fragments(*text_bytes(texts))
            values, decoded, at = [], [], 0
            for n in parts.tolist():
                values.append(np.frombuffer(b"".join(ids[at:at + n]), dtype=np.int32))
                decoded.append(b"".join(map(spelled, values[-1].tolist())).decode("utf-8", "replace"))
                at += n
            sizes = np.array([len(v) for v in values], dtype=np.int64)
            return [lists(np.concatenate(values), sizes, pa.int32()), pa.array(decoded, pa.string())]

        return work

    return flat(scan_texts(docs, text_col, [id_col], "ids array<int>, decoded string", start))
