"""Language identification: text likelihoods fused with declared language, address suffix and host priors."""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import reduce
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicmoments.llm.common import join_salted, pieces, written

#: Hash buckets of byte triples.
BUCKETS = 1 << 16
#: Added to each bucket's count.
SMOOTH = 0.5
#: A text's evidence: every third of its byte triples, as they overlap, and no more than so many.
STEP, MOST = 3.0, 100.0
#: Pages that a parent's prior is worth against a child's own pages; pages that spread over all
#: languages are worth in the tables of declared languages and suffixes.
PARENT, TABLE = 5.0, 1.0
#: Responsibilities are summed in whole millionths, so that sums do not depend on their order.
UNIT = 1_000_000

HIDDEN = re.compile(r"<(script|style|noscript)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.I | re.S)
DECLARED = re.compile(r"""<html\b[^>]*?\b(?:xml:)?lang\s*=\s*["']?\s*([A-Za-z]{2,3})\b|<meta\b[^>]*?content-language[^>]*?content\s*=\s*["']?\s*([A-Za-z]{2,3})\b""", re.I)


def triples(data: np.ndarray) -> np.ndarray:
    """The hash bucket of every byte triple."""
    if len(data) < 3:
        return np.zeros(0, dtype=np.int64)
    x = data.astype(np.uint32)
    joined = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    return ((joined * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)


def small_bytes(text: str) -> np.ndarray:
    return np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-8", "replace"), dtype=np.uint8)


def triple_counts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, bucket, n) over all whole texts with a language; tasks add up before the shuffle."""
    packed = docs.select(F.lower(F.trim(docs[lang_col].cast("string"))).alias("lang"), docs[text_col].cast("string").alias("text")).filter("lang != ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(BUCKETS, dtype=np.int64))
        for batch in batches:
            for piece in pieces(batch, 1):
                by_lang: dict[str, list[np.ndarray]] = defaultdict(list)
                for lang, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                    if text:
                        by_lang[lang].append(triples(small_bytes(text)))
                for lang, own in by_lang.items():
                    sums[lang] += np.bincount(np.concatenate(own), minlength=BUCKETS)
        for lang, counts in sums.items():
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(counts[some])],
                                             ["lang", "bucket", "n"])

    return packed.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def likelihood_table(counts: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order, and log P(bucket | language). Its size is the number of languages times BUCKETS."""
    rows = counts.collect()
    langs = sorted({r["lang"] for r in rows})
    table = np.full((len(langs), BUCKETS), SMOOTH)
    at = {lang: i for i, lang in enumerate(langs)}
    for r in rows:
        table[at[r["lang"]], r["bucket"]] += r["n"]
    return langs, np.log(table / table.sum(axis=1, keepdims=True)) if langs else table


def visible_text(page: str) -> str:
    """A page's text without markup, scripts and comments."""
    return html.unescape(HIDDEN.sub(" ", page))


def declared_language(page: str) -> str | None:
    match = DECLARED.search(page)
    return (match[1] or match[2]).lower() if match else None


def address(url: str | None) -> tuple[str | None, str | None, str | None]:
    """Host, domain (its last two parts) and suffix (its last part) of a URL, in small letters."""
    try:
        host = (urlsplit(url or "").hostname or "").rstrip(".")
    except ValueError:
        host = ""
    if not host:
        return None, None, None
    parts = host.split(".")
    return host, ".".join(parts[-2:]), parts[-1]


def text_evidence(text: str, table: np.ndarray) -> np.ndarray:
    """Log-likelihoods of a text under each language, weighted by how much evidence its length is."""
    found = triples(small_bytes(text)) if text.strip() else np.zeros(0, np.int64)
    if not len(found):
        return np.zeros(len(table))
    return table[:, found].mean(axis=1) * min(len(found) / STEP, MOST)


def page_evidence(pages: DataFrame, langs: Sequence[str], table: np.ndarray, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(id, declared, host, domain, suffix, e0, e1, ...): evidence of every whole page."""
    shared = pages.sparkSession.sparkContext.broadcast(table)
    packed = pages.select(pages[id_col].cast("long").alias("id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for piece in pieces(batch, 2):
                texts = [t or "" for t in piece.column(2).to_pylist()]
                hosts = [address(u) for u in piece.column(1).to_pylist()]
                evidence = np.array([text_evidence(visible_text(t), table) for t in texts]).reshape(len(texts), len(table))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array([declared_language(t) for t in texts], pa.string()),
                     *[pa.array([h[k] for h in hosts], pa.string()) for k in range(3)],
                     *[pa.array(np.ascontiguousarray(evidence[:, k])) for k in range(len(table))]],
                    ["id", "declared", "host", "domain", "suffix", *[f"e{k}" for k in range(len(table))]])

    return packed.mapInArrow(run, "id long, declared string, host string, domain string, suffix string, "
                             + ", ".join(f"e{k} double" for k in range(len(langs))))


def softmax(values: Sequence[Column]) -> list[Column]:
    top = F.greatest(*values, F.lit(-math.inf))
    parts = [F.exp(v - top) for v in values]
    total = reduce(lambda a, b: a + b, parts)
    return [p / total for p in parts]


def identify_languages(pages: DataFrame, docs: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                       text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The language of every page: id, lang, p (its posterior), text_lang, declared, host.

    Text likelihoods are byte triples counted over all documents that name a language. Over all pages,
    the posteriors by text alone are then summed by declared language, by address suffix, by host, by domain
    and in all; the sums give P(declared | language), P(suffix | language) and a prior for the host that is
    smoothed towards its domain's, which is smoothed towards that of all pages. A page's own posterior is
    taken out of its sums, so that its text does not count twice. The product of the four is the
    posterior; ties go to the first language in the alphabet.

    Groups are added up before the shuffle. Tables of groups are broadcast if they fit; else the pages of a
    large group are dealt among several tasks. A null page has no text and no declared language, a null or
    broken URL no host and no suffix: what is missing says nothing, and the rest decides. Every row gives
    one row, repeated and null ids included. Without labelled documents lang is null and p 0. Languages are few: each is
    a column.
    """
    langs, table = likelihood_table(triple_counts(docs, text_col, lang_col))
    if not langs:
        return pages.select(pages[id_col], F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("p"),
                            F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("declared"),
                            F.lit(None).cast("string").alias("host"))
    k = range(len(langs))
    evidence = page_evidence(pages, langs, table, id_col, url_col, html_col)
    shares = softmax([F.col(f"e{i}") for i in k])
    found = written(evidence.select("*", *[F.round(s * UNIT).cast("long").alias(f"r{i}") for i, s in enumerate(shares)]), "page-evidence")

    def sums(by: str, name: str) -> DataFrame:
        return (found.filter(F.col(by).isNotNull()).groupBy(by)
                .agg(*[F.sum(f"r{i}").alias(f"{name}{i}") for i in k], F.count("*").alias(f"{name}_n")))

    total = found.agg(*[F.sum(f"r{i}").alias(f"g{i}") for i in k], F.count("*").alias("n")).first()
    n_all = total["n"]
    share_all = [(total[f"g{i}"] or 0) / UNIT for i in k]
    joined = found
    for by, name in (("declared", "d"), ("suffix", "s"), ("domain", "m"), ("host", "h")):
        group = written(sums(by, name), f"{by}-sums")
        joined = join_salted(joined, group.withColumn("weight", F.col(f"{name}_n")), [by], "weight", F.col("id"), 120 + 8 * len(langs))

    def own(i: int) -> Column:
        return F.col(f"r{i}") / UNIT

    def left_out(name: str, i: int) -> Column:
        """Pages of language i in the page's group, without itself."""
        return F.coalesce(F.col(f"{name}{i}") / UNIT - own(i), F.lit(0.0))

    def others(name: str) -> Column:
        return F.coalesce(F.col(f"{name}_n") - 1, F.lit(0))

    scores = []
    for i in k:
        rest_all = F.lit(share_all[i]) - own(i)
        prior = (rest_all + 1.0) / (n_all - 1 + len(langs))
        for name in ("m", "h"):
            prior = (left_out(name, i) + PARENT * prior) / (others(name) + PARENT)
        tables = [F.when(F.col(f"{name}0").isNotNull(), F.log((left_out(name, i) + TABLE) / (rest_all + TABLE * len(langs)))).otherwise(0.0)
                  for name in ("d", "s")]
        scores.append(F.col(f"e{i}") + F.log(prior) + tables[0] + tables[1])
    posterior = softmax(scores)

    def best(values: Sequence[Column]) -> Column:
        top = F.greatest(*values, F.lit(-math.inf))
        return reduce(lambda later, i: F.when(values[i] == top, langs[i]).otherwise(later), reversed(k), F.lit(None).cast("string"))

    scored = joined.select("id", "declared", "host", *[F.col(f"e{i}") for i in k], *[p.alias(f"p{i}") for i, p in enumerate(posterior)])
    return scored.select(F.col("id").alias(id_col), best([F.col(f"p{i}") for i in k]).alias("lang"),
                         F.greatest(*[F.col(f"p{i}") for i in k], F.lit(0.0)).alias("p"),
                         best([F.col(f"e{i}") for i in k]).alias("text_lang"), "declared", "host")
