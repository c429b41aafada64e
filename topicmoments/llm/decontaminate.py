"""Benchmark decontamination: a prefix-filtered join of document shingles with benchmark windows."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicmoments.llm.common import flat, lists, pieces, scan_texts, text_bytes
from topicmoments.llm.words import LETTERS_DIGITS, WordReader, Words, run_hashes

WINDOW = 13
SHINGLE = 5
#: Bytes of benchmark text that one pass over the documents looks for.
BLOCK_BYTES = 16 << 20
RESULTS = """n_words long, n_hit long, spans array<struct<start:long,end:long,first_word:long,last_word:long>>,
             items array<string>, contaminated boolean"""
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


@dataclass
class WindowSet:
    """Different windows of a block of items, with the shingles that they hold."""

    words: list[tuple[bytes, ...]]
    items: list[tuple[str, ...]]
    lengths: np.ndarray
    hashes: np.ndarray  # windows x widest window, 0 beyond a window's end
    shingle_sizes: tuple[int, ...]
    shingles: dict[int, list[tuple[int, int, int]]]  # size -> (hash, window, place in the window)


def item_words(reader: WordReader, text: str | None) -> tuple[list[bytes], np.ndarray]:
    data, offsets = text_bytes(pa.array([text], pa.string()))
    found = reader(data, offsets)
    whole = data.tobytes().translate(LOWER)
    return [whole[a:b] for a, b in zip(found.starts, found.ends)], found.hashes


def windows_of(rows: Sequence[tuple[str | None, str | None]], window: int, shingle: int) -> WindowSet:
    """The windows of (item, text) rows. A window that several items hold is listed once."""
    reader = WordReader(LETTERS_DIGITS)
    owners: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
    hashes: dict[tuple[bytes, ...], np.ndarray] = {}
    for item, text in rows:
        words, own = item_words(reader, text)
        size = min(window, len(words))
        for at in range(len(words) - size + 1 if size else 0):
            key = tuple(words[at:at + size])
            owners[key].update(() if item is None else (item,))
            hashes[key] = own[at:at + size]
    keys = list(owners)
    table = np.zeros((len(keys), window), dtype=np.uint64)
    shingles: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for k, key in enumerate(keys):
        table[k, :len(key)] = hashes[key]
        size = min(shingle, len(key))
        shingles[size] += [(int(h), k, at) for at, h in enumerate(run_hashes(hashes[key], size))]
    return WindowSet(keys, [tuple(sorted(owners[k])) for k in keys], np.array([len(k) for k in keys], dtype=np.int64),
                     table, tuple(sorted(shingles)), dict(shingles))


def shingle_counts(docs: DataFrame, text_col: str, windows: WindowSet) -> dict[tuple[int, int], int]:
    """How often each shingle of the windows occurs in all documents, by (size, hash).

    Tasks count for whole batches, and the sums per shingle come to the driver: as many rows as the
    block of windows has shingles, at most.
    """
    wanted = {size: np.unique(np.array([h for h, _, _ in windows.shingles[size]], dtype=np.uint64))
              for size in windows.shingle_sizes}
    shared = docs.sparkSession.sparkContext.broadcast(wanted)
    packed = docs.select(F.lit(0).alias("row"), docs[text_col].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = WordReader(LETTERS_DIGITS)
        sums = {size: np.zeros(len(keys), dtype=np.int64) for size, keys in shared.value.items()}
        for batch in batches:
            for piece in pieces(batch, 1):
                found = reader(*text_bytes(piece.column(1)))
                for size, keys in shared.value.items():
                    own = run_hashes(found.hashes, size)
                    at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                    # a run over the end of a text may be counted too: rarity need not be exact
                    sums[size] += np.bincount(at[keys[at] == own], minlength=len(keys))
        for size, keys in shared.value.items():
            some = sums[size] > 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(some.sum(), size, dtype=np.int32)), pa.array(keys[some].view(np.int64)), pa.array(sums[size][some])],
                ["size", "hash", "n"])

    counted = packed.mapInArrow(run, "size int, hash long, n long").groupBy("size", "hash").agg(F.sum("n").alias("n"))
    return {(r["size"], r["hash"] % (1 << 64)): r["n"] for r in counted.collect()}


def prefixes(windows: WindowSet, counts: dict[tuple[int, int], int]) -> dict[int, tuple[np.ndarray, ...]]:
    """The necessary prefix of each window in the order of rarity: by shingle size, sorted arrays of
    hash, window and the shingle's place.

    A window occurs only with all of its shingles, so a prefix of one, the rarest, is enough. A
    window with a shingle that no document has is left out.
    """
    chosen: dict[int, tuple[int, int, int]] = {}
    sizes: dict[int, int] = {}
    for size in windows.shingle_sizes:
        for h, k, at in windows.shingles[size]:
            key = (counts.get((size, h), 0), h, at)
            if k not in chosen or key < chosen[k]:
                chosen[k], sizes[k] = key, size
    out = {}
    for size in windows.shingle_sizes:
        rows = sorted((h, k, at) for k, (n, h, at) in chosen.items() if sizes[k] == size and n)
        if rows:
            out[size] = (np.array([r[0] for r in rows], dtype=np.uint64), np.array([r[1] for r in rows], dtype=np.int64),
                         np.array([r[2] for r in rows], dtype=np.int64))
    return out


def find_windows(windows: WindowSet, prefix: dict[int, tuple[np.ndarray, ...]], reader: WordReader, data: np.ndarray,
                 offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, Words]:
    """All (first word, window) pairs where a window stands in a text, each pair's text, and the words."""
    found = reader(data, offsets)
    places, which = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for size, (keys, window, at) in prefix.items():
        own = run_hashes(found.hashes, size)
        low = np.searchsorted(keys, own, "left")
        high = np.searchsorted(keys, own, "right")
        hit = np.flatnonzero(high > low)
        many = (high - low)[hit]
        entry = np.repeat(low[hit], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        places.append(np.repeat(hit, many) - at[entry])
        which.append(window[entry])
    begin, k = np.concatenate(places), np.concatenate(which)
    # the place of the shingle and the window's length say whether the window lies inside one text
    inside = begin >= 0
    begin, k = begin[inside], k[inside]
    text = np.searchsorted(found.firsts, begin, "right") - 1
    inside = begin + windows.lengths[k] <= found.firsts[text + 1]
    begin, k, text = begin[inside], k[inside], text[inside]
    same = np.ones(len(begin), dtype=bool)
    for j in range(windows.hashes.shape[1]):
        live = same & (j < windows.lengths[k])
        same[live] = found.hashes[begin[live] + j] == windows.hashes[k[live], j]
    begin, k, text = begin[same], k[same], text[same]
    # the words themselves
    whole = data.tobytes().translate(LOWER) if len(begin) else b""
    starts, ends = found.starts, found.ends
    exact = np.fromiter((all(whole[starts[b + j]:ends[b + j]] == w for j, w in enumerate(windows.words[i]))
                         for b, i in zip(begin.tolist(), k.tolist())), dtype=bool, count=len(begin))
    return begin[exact], k[exact], text[exact], found


def _work(windows: WindowSet, prefix: dict[int, tuple[np.ndarray, ...]]) -> Callable[[pa.Array], list[pa.Array]]:
    reader = WordReader(LETTERS_DIGITS)

    def work(texts: pa.Array) -> list[pa.Array]:
        data, offsets = text_bytes(texts)
        begin, k, text, found = find_windows(windows, prefix, reader, data, offsets)
        n_texts, n_words = len(texts), np.diff(found.firsts)
        steps = np.zeros(len(found.starts) + 1, dtype=np.int64)
        np.add.at(steps, begin, 1)
        np.add.at(steps, begin + windows.lengths[k], -1)
        hit = np.cumsum(steps[:-1]) > 0
        hits = np.concatenate(([0], np.cumsum(hit)))
        n_hit = hits[found.firsts[1:]] - hits[found.firsts[:-1]]
        # runs of hit words, which end with their text
        at = np.flatnonzero(hit)
        owner = np.searchsorted(found.firsts, at, "right") - 1
        fresh = np.ones(len(at), dtype=bool)
        fresh[1:] = (np.diff(at) > 1) | (np.diff(owner) > 0)
        last = np.append(np.flatnonzero(fresh)[1:] - 1, len(at) - 1) if len(at) else np.zeros(0, np.int64)
        chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        run_text = owner[fresh]
        base = chars[offsets[run_text]]
        spans = pa.StructArray.from_arrays(
            [pa.array(chars[found.starts[at[fresh]]] - base), pa.array(chars[found.ends[at[last]]] - base),
             pa.array(at[fresh] - found.firsts[run_text]), pa.array(at[last] - found.firsts[run_text])],
            ["start", "end", "first_word", "last_word"])
        counts = np.bincount(run_text, minlength=n_texts)
        runs = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), spans)
        items: list[set[str]] = [set() for _ in range(n_texts)]
        for t, i in set(zip(text.tolist(), k.tolist())):
            items[t].update(windows.items[i])
        named = lists([x for own in items for x in sorted(own)], np.array([len(x) for x in items], dtype=np.int64), pa.string())
        return [pa.array(n_words), pa.array(n_hit), runs, named, pa.array((n_hit > 0) & (20 * n_hit >= n_words))]

    return work


def scan_benchmark(docs: DataFrame, benchmark: DataFrame, keep: Sequence[str], id_col: str = "doc_id",
                   text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                   shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """As `decontaminate`, with the kept input columns in the struct `row`."""
    spark = docs.sparkSession
    items = benchmark.select(benchmark[item_col].cast("string").alias("item"),
                             benchmark[item_text_col].cast("string").alias("text")).distinct()
    size = items.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    blocks = max(1, -(-int(size) // block_bytes))
    key = F.struct(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("hash"), F.md5(docs[text_col]).alias("digest"))
    source = docs if blocks == 1 else docs.select(*[docs[c] for c in docs.columns], key.alias("_text_key"))
    kept = list(keep) if blocks == 1 else [*keep, "_text_key"]
    found = []
    for b in range(blocks):
        own = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        windows = windows_of([(r["item"], r["text"]) for r in own.collect()], window, shingle)
        prefix = prefixes(windows, shingle_counts(docs, text_col, windows)) if windows.words else {}
        shared = spark.sparkContext.broadcast((windows.__dict__, prefix))
        found.append(scan_texts(source, text_col, kept, RESULTS,
                                lambda shared=shared: _work(WindowSet(**shared.value[0]), shared.value[1])))
    if blocks == 1:
        return found[0]
    # a text's hits come from several blocks: put them together, and beside the texts' word counts
    hits = (reduce(DataFrame.unionByName, [f.filter("n_hit > 0") for f in found])
            .select(F.col("row._text_key").alias("_text_key"), "spans", "items").distinct()
            .groupBy("_text_key")
            .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"),
                 F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")))
    # for the words of every text one more pass is enough, with no window to look for
    empty = WindowSet([], [], np.zeros(0, np.int64), np.zeros((0, window), np.uint64), (), {})
    texts = scan_texts(source, text_col, kept, RESULTS, lambda: _work(empty, {})).select("row", "n_words")
    words = F.array_distinct(F.flatten(F.transform("h.spans", lambda s: F.sequence(s["first_word"], s["last_word"]))))
    n_hit = F.coalesce(F.size(F.when(F.col("h.items").isNotNull(), words)), F.lit(0)).cast("long")
    n_hit = F.greatest(n_hit, F.lit(0).cast("long"))
    joined = texts.alias("t").join(hits.alias("h"), F.col("t.row._text_key").eqNullSafe(F.col("h._text_key")), "left")
    return joined.select(F.col("t.row").dropFields("_text_key").alias("row"), "n_words", n_hit.alias("n_hit"),
                         F.coalesce("h.spans", F.array().cast(hits.schema["spans"].dataType)).alias("spans"),
                         F.coalesce("h.items", F.array().cast("array<string>")).alias("items"),
                         ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options: object) -> DataFrame:
    """Words of every document that lie in an occurrence of a benchmark window.

    A window is `window` words of an item in a row; a shorter item with a word is one window.
    Windows become sets of shingles ordered by how rare they are among all documents. As all of a
    window's shingles must occur, its prefix is the rarest one; documents meet windows only on
    prefixes, the place of the shingle and the window's length bound where the window must lie, and
    its words are then compared one by one. Returns for each row: the id, n_words, n_hit (hit
    words), spans (runs of hit words; code points and words, ends of code points exclusive), items
    (ids of items with an occurring window, sorted as text), contaminated (at least 5 % are hit).

    The benchmark is measured and, if it is larger than `block_bytes`, looked for in blocks, each in
    passes of its own; only one block is on the driver and in a task's memory at a time. Spans of
    different blocks may then overlap.

    A null or wordless text has no words and is clean; so are all documents of an empty benchmark.
    Repeated documents give repeated rows; a null id is kept. Repeated items count as one; an item
    without an id marks words but is not listed. Other columns are not read.
    """
    return flat(scan_benchmark(docs, benchmark, [id_col], id_col, **options))
