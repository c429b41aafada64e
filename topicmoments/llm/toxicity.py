"""Toxicity by compression distance: two zstandard dictionaries price every window of a text."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicmoments.llm.common import ENTRY_BYTES, Remembered, flat, scan_texts

#: Labelled rows of each label that the model is fitted on, at most, and bytes of their texts.
TRAIN_ROWS = {1: 2000, 0: 4000}
TRAIN_BYTES = 12 << 20
#: Bytes of the dictionaries. The toxic one is trained in several sizes, on several orders of the
#: samples, and the best is taken by how well it parts so many training rows of each label.
TOXIC_SIZES, ORDERS, ORDINARY_SIZE, TRIAL_ROWS = (1024, 2048, 4096), 3, 16384, 300
LEVEL = 3
#: A window is typical of toxic rows if it stands between so many different pairs of neighbours
#: there, and among them so many times as often as in ordinary rows.
CONTEXTS, CONTRAST = 5, 20
#: Score from which a text is called toxic.
THRESHOLD = 0.3
#: Classes of windows: bytes saved, and bytes left, up to these numbers.
SAVED, LEFT = 24, 48
#: Words (with repeats) that the ordinary dictionary is trained on, drawn at random from all of them.
PLAIN_WORDS = 1 << 19


def windows_in(text: str | None) -> list[bytes]:
    """The words of a text, in small letters."""
    return (text or "").lower().encode("utf-8", "replace").split()


def spelled(word: bytes) -> bytes:
    """A window as it is compressed: the word between blanks, in overlapping triples of bytes.

    Three times as long, it costs three times as much where a dictionary does not know it, and a match
    costs the same; a window of a single word is then long enough for zstandard to tell.
    """
    whole = b"  " + word + b"  "
    n = len(whole) - 2
    out = bytearray(3 * n)
    out[0::3], out[1::3], out[2::3] = whole[:n], whole[1:n + 1], whole[2:]
    return bytes(out)


def context_counts(texts: Iterable[str | None]) -> Counter[bytes]:
    """For each word, the different pairs of neighbours it has; copied text adds nothing."""
    number: dict[bytes, int] = {b"": 0}
    parts = [np.zeros(1, dtype=np.int64)]
    for text in texts:
        parts.append(np.array([number.setdefault(w, len(number)) for w in windows_in(text)], dtype=np.int64))
        parts.append(np.zeros(1, dtype=np.int64))  # the word without letters stands between texts
    ids, n = np.concatenate(parts), len(number)
    word, sides = ids[1:-1], ids[:-2] * n + ids[2:]
    _, sides = np.unique(sides[word > 0], return_inverse=True)
    different = np.unique(sides * n + word[word > 0])
    counts = np.bincount(different % n, minlength=n).tolist()
    return Counter({w: c for w, c in zip(number, counts) if c})


def trained(size: int, samples: list[bytes]) -> bytes:
    """A dictionary trained on samples; where they are too few for training, the samples themselves."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:] or b" "


def packer(dictionary: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False,
                                    write_checksum=False, write_dict_id=False)


@dataclass
class Model:
    """Both dictionaries, the log-odds of each window class, and the weights of a text's features."""

    toxic: bytes
    ordinary: bytes
    odds: np.ndarray
    weights: np.ndarray
    prior: float


class Scorer:
    """Prices windows, remembering them, and scores texts."""

    def __init__(self, toxic: bytes, ordinary: bytes) -> None:
        self.toxic, self.ordinary = packer(toxic), packer(ordinary)
        self.known = Remembered()

    def cell(self, word: bytes) -> int:
        """The window's class: bytes that the toxic dictionary saves, and bytes that it leaves."""
        cell = self.known.get(word)
        if cell is None:
            window = spelled(word)
            left = len(self.toxic.compress(window))
            saved = len(self.ordinary.compress(window)) - left
            cell = min(max(saved, 0), SAVED - 1) * LEFT + min(left, LEFT - 1)
            self.known.room(len(word) + ENTRY_BYTES)
            self.known[word] = cell
        return cell

    def cells(self, text: str | None) -> np.ndarray:
        return np.fromiter(map(self.cell, windows_in(text)), dtype=np.int64)


def features(cells: np.ndarray, odds: np.ndarray) -> tuple[float, float, float, float]:
    """The strongest windows of a text, and how many are clearly toxic."""
    values = odds[cells]
    top = np.sort(values[values > 0])[::-1][:3]
    first, second, third = [*top.tolist(), 0.0, 0.0, 0.0][:3]
    return 1.0, first, second + third, math.log1p(int((values > 2.0).sum()))


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression, by Newton's steps."""
    weights = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1]), x.T @ (y - p) - ridge * weights)
        weights += step
        if np.abs(step).max() < 1e-6:
            break
    return weights


def fit(toxic: Sequence[str | None], ordinary: Sequence[str | None]) -> Model | None:
    """Train both dictionaries on the two samples, and calibrate window classes and scores on them.

    The toxic dictionary is trained on the words that are typical of toxic rows, each as often as its
    contexts. None if there is nothing to tell apart.
    """
    bad, good = context_counts(toxic), context_counts(ordinary)
    n_bad, n_good = sum(bad.values()), sum(good.values())
    if not n_bad or not n_good:
        return None
    typical = sorted(w for w, n in bad.items() if n >= CONTEXTS and n / n_bad >= CONTRAST * (good[w] + 0.5) / n_good)
    if not typical:
        return None
    rng = np.random.default_rng(0)
    # a word that comes several times is one object in the lists
    samples = [s for w in typical for s in [spelled(w)] * bad[w]]
    plain = [s for w, n in sorted(good.items()) if n > 1 for s in [spelled(w)] * min(n, 20)]
    other = trained(ORDINARY_SIZE, [plain[i] for i in rng.permutation(len(plain))[:PLAIN_WORDS]])
    trials = [windows_in(t) for t in [*toxic[:TRIAL_ROWS], *ordinary[:TRIAL_ROWS]]]
    words = list(set().union(*trials))
    base = packer(other)
    costs = [len(base.compress(spelled(w))) for w in words]

    def parted(dictionary: bytes) -> float:
        """The chance that a toxic trial row saves more in its three best windows than an ordinary one."""
        own = packer(dictionary)
        saved = {w: c - len(own.compress(spelled(w))) for w, c in zip(words, costs)}
        best = np.array([sum(sorted((saved[w] for w in set(t)), reverse=True)[:3]) for t in trials])
        x, y = best[:len(toxic[:TRIAL_ROWS])], best[len(toxic[:TRIAL_ROWS]):]
        return float(((x[:, None] > y).mean() + (x[:, None] >= y).mean()) / 2)

    tried = [trained(size, [samples[i] for i in rng.permutation(len(samples))]) for size in TOXIC_SIZES for _ in range(ORDERS)]
    best = max(tried, key=parted)
    scorer = Scorer(best, other)
    rows = [(scorer.cells(t), y) for y, texts in ((1, toxic), (0, ordinary)) for t in texts]
    counts = np.zeros((2, SAVED * LEFT))
    for cells, y in rows:
        counts[y][np.unique(cells)] += 1
    rates = (counts + 0.5) / (np.array([[len(ordinary)], [len(toxic)]]) + 1.0)
    odds = np.log(rates[1] / rates[0])
    odds[counts.sum(axis=0) == 0] = 0.0
    odds.reshape(SAVED, LEFT)[0] = 0.0  # where the toxic dictionary saves nothing
    x = np.array([features(cells, odds) for cells, _ in rows])
    y = np.array([y for _, y in rows], dtype=float)
    return Model(best, other, odds, fitted(x, y), len(toxic) / max(1, len(rows)))


def scores(scorer: Scorer, model: Model, texts: Iterable[str | None]) -> np.ndarray:
    x = np.array([features(scorer.cells(t), model.odds) for t in texts]).reshape(-1, 4)
    return 1 / (1 + np.exp(-np.clip(x @ model.weights, -30, 30)))


def held_out(id_col: Column) -> Column:
    """Whether a row's labels are kept from the model, by its id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model | None:
    """Fit the model on a bounded sample of labelled rows that are not held out.

    The sample is the TRAIN_ROWS rows of each label with the least hash of the id, up to TRAIN_BYTES of
    text, without texts that do not fit what is left; only it comes to the driver. An id with several labels counts with the greatest.
    """
    known = (labels.select(labels[id_col].alias("id"), labels[label_col].alias("y")).filter("id is not null and y in (0, 1)")
             .filter(~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y")))
    samples: dict[int, list[str | None]] = {}
    for y, size in TRAIN_ROWS.items():
        ids = known.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(size).select("id")
        texts = (docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
                 .join(F.broadcast(ids), "id").select(F.xxhash64("id").alias("order"), "id", "text"))
        # equal ids may repeat rows; at most `size` rows that can fit are looked at
        texts = texts.withColumn("bytes", F.coalesce(F.octet_length("text"), F.lit(0))).filter(F.col("bytes") <= TRAIN_BYTES)
        texts = texts.orderBy("order", "id", F.md5("text")).limit(size)
        running, own = 0, []
        for row in texts.toLocalIterator():
            if running + row["bytes"] <= TRAIN_BYTES:
                running += row["bytes"]
                own.append(row["text"])
        samples[y] = own
    return fit(samples[1], samples[0])


def scan_toxicity(docs: DataFrame, model: Model | None, keep: Sequence[str], text_col: str = "text",
                  threshold: float = THRESHOLD) -> DataFrame:
    """As `score_toxicity`, with the kept input columns in the struct `row`."""
    shared = docs.sparkSession.sparkContext.broadcast(None if model is None else model.__dict__)

    def start() -> Callable[[pa.Array], list[pa.Array]]:
        model = None if shared.value is None else Model(**shared.value)
        scorer = None if model is None else Scorer(model.toxic, model.ordinary)

        def work(texts: pa.Array) -> list[pa.Array]:
            own = np.zeros(len(texts)) if model is None else scores(scorer, model, texts.to_pylist())
            return [pa.array(own), pa.array((own >= threshold).astype(np.int32))]

        return work

    return scan_texts(docs, text_col, keep, "score double, predicted int", start)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
                   threshold: float = THRESHOLD) -> DataFrame:
    """Score every whole text between 0 and 1 for toxicity: id, held_out, score, predicted.

    Every word of a text is a window. It is compressed with a dictionary trained on toxic text and
    one trained on ordinary text; the bytes that the toxic one saves and leaves put the window in a
    class, whose log-odds are calibrated on the training rows. A logistic regression over the strongest
    windows gives the score; predicted is 1 from `threshold` on. Only texts are inputs of a score.
    Labels of rows whose CRC-32 of the id as text leaves 2 modulo 4 are never read for training;
    `held_out` marks these rows.

    Null and empty texts have no windows and get the score of a text without signs. Without labels
    of both kinds every score is 0. Every row gives one row, repeated ids included; a null id is not
    held out. Other columns are not read.
    """
    model = learn(docs, labels, id_col, text_col, label_col)
    scored = flat(scan_toxicity(docs, model, [id_col], text_col, threshold))
    return scored.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", "predicted")
