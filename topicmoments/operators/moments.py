"""Word moments over a document-term table.

`docs` tables here carry `(doc_id, term_id, cnt, len)`, hold documents of at least three words and
should be partitioned by document (see `plans.fit.prepare`): then a pass over them shuffles once,
by term, after partial sums. `terms` tables hold one row per term that is not masked:
`(term_id, df, m1, s2, s1)`. Matrices are tall tables keyed by `term_id`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations_with_replacement, permutations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicmoments.operators.layout import TermLayout
from topicmoments.operators.matrix import (
    COLUMN_BLOCK, MAX_EXPRESSIONS, column_sums, columns, gaussian_matrix, gram_matrix, merged, number,
    orthonormal_step, orthonormalize, sums, times_small)
from topicmoments.runtime import cut, hot_keys, join_sized, let_go, row_bytes, shuffle_partitions, stored

# Rows of the second moment that a task adds up at a time, at most.
BLOCK_TERMS = 2048
# Rows of the documents in a block of terms, as a task holds two such blocks.
HELD = 6_000_000
# Rows of the documents for which a block of their own is worth it.
LEAST = 50_000
# Products of counts that a task has at hand at a time.
PRODUCTS = 1 << 20
# Fixed value: added to the root of an eigenvalue before it is inverted.
WHITEN_SLACK = 1e-9

# Weights of a document's pairs and triples of words.
PAIR = "(1.0D / (len * (len - 1)))"
TRIPLE = "(1.0D / (len * (len - 1) * (len - 2)))"


@dataclass(frozen=True)
class TermTable:
    """Per-term sums with the numbers that size the joins."""

    terms: DataFrame
    n_terms: int
    n_docs: int
    layout: TermLayout | None = None  # where documents are written by term, passes over them take that way


def project_docs(docs: DataFrame, mat: DataFrame, table: TermTable) -> DataFrame:
    """Each document's counts times the matrix: `(doc_id, len, p0, p1, ...)`.

    A matrix that can be broadcast is; else documents that are written by term meet it there, and only the sums by
    document are shuffled. Without that layout the documents' rows are shuffled to their terms.
    """
    cols = columns(mat)
    parts = None
    for lo in range(0, len(cols), COLUMN_BLOCK):
        block = cols[lo:lo + COLUMN_BLOCK]
        if table.layout is not None:
            hits = table.layout.join(mat, block)
        else:
            hits = join_sized(docs, mat.select("term_id", *block), "term_id",
                              table.n_terms * row_bytes(len(block)), "doc_id", table.terms, "df")
        totals = hits.groupBy("doc_id").agg(
            F.max("len").alias("len"),
            *[F.expr(f"sum(cnt * {c}) as p{lo + i}") for i, c in enumerate(block)])
        parts = totals if parts is None else parts.join(totals.drop("len"), "doc_id")
    return parts


def spread_to_terms(docs: DataFrame, projected: DataFrame, n_cols: int, weight: str) -> DataFrame:
    """Sum over documents of weight * cnt * p, by term: `(term_id, z0, z1, ...)`."""
    parts = None
    for lo in range(0, n_cols, COLUMN_BLOCK):
        block = range(lo, min(lo + COLUMN_BLOCK, n_cols))
        weighted = projected.selectExpr("doc_id", *[f"{weight} * p{j} as p{j}" for j in block])
        # both sides lie together by document, and the documents are sorted already
        joined = docs.select("doc_id", "term_id", "cnt").join(weighted.hint("merge"), "doc_id")
        totals = joined.groupBy("term_id").agg(*[F.expr(f"sum(cnt * p{j}) as z{j}") for j in block])
        parts = totals if parts is None else parts.join(totals, "term_id")
    return parts


def project_second_moment(docs: DataFrame, mat: DataFrame, table: TermTable, alpha0: float,
                          m1_mat: Sequence[float] | None = None) -> DataFrame:
    """The shifted second moment times a tall matrix, without forming the moment.

    `m1_mat`, the first moment times the matrix, may be given when the caller already has it. The
    result `(term_id, m1, c0, c1, ...)` carries the first moment along.
    """
    cols = columns(mat)
    # rows of masked terms fall away here
    mat = table.terms.select("term_id", "m1", "s2").join(mat, "term_id")
    if m1_mat is None:
        m1_mat = column_sums(mat, cols, "m1")
    spread = spread_to_terms(docs, project_docs(docs, mat, table), len(cols), PAIR)
    both = mat.join(spread, "term_id")
    main, shift = number(alpha0 * (alpha0 + 1) / table.n_docs), alpha0 * alpha0
    return both.selectExpr("term_id", "m1", *[
        f"{main} * (z{j} - s2 * {c}) - {number(shift * float(m1_mat[j]))} * m1 as c{j}"
        for j, c in enumerate(cols)])


def top_eigen(docs: DataFrame, table: TermTable, vocab_size: int, k: int, alpha0: float, q: int = 1,
              seed: int = 0) -> tuple[DataFrame, np.ndarray]:
    """Leading eigenvectors (a tall table) and eigenvalues of the shifted second moment.

    Subspace iteration from a random start with 2q + 2 passes over the documents. Each pass writes
    one tall table, so the plan stays short and a lost executor costs one pass. The basis between
    passes only has to span; the last one is made orthonormal to rounding.
    """
    if vocab_size < k:
        raise ValueError(f"{vocab_size} terms cannot give {k} topics")
    width = k + min(vocab_size - k, k)
    basis, m1_basis = gaussian_matrix(table.terms, "term_id", width, seed), None
    done: list[DataFrame] = []  # the image that the basis is made of
    since = len(table.layout.passed) if table.layout is not None else 0

    def passed(mat: DataFrame) -> DataFrame:
        """The image of a matrix; what only the matrix was made of is deleted."""
        image = cut(project_second_moment(docs, mat, table, alpha0, m1_basis))
        let_go(*done, *(table.layout.spent(since) if table.layout is not None else ()))
        done[:] = [image]
        return image

    for left in reversed(range(2 * q + 1)):
        image = passed(basis)
        if not left:
            basis, m1_basis = orthonormalize(image.drop("m1"), "term_id"), None
            break
        cols = columns(image)
        products = gram_matrix(image, ["m1", *cols])
        step, _good = orthonormal_step(products[1:, 1:])
        basis, m1_basis = times_small(image, ["term_id"], cols, step), products[0, 1:] @ step

    basis = cut(basis)
    cols = columns(basis)
    r = len(cols)
    if r < k:
        raise ValueError(f"the second moment has rank {r}, fewer than {k} topics")
    image = passed(basis)
    both = basis.join(image.selectExpr("term_id", *[f"c{j} as y{j}" for j in range(r)]), "term_id")
    products = gram_matrix(both, [*cols, *[f"y{j}" for j in range(r)]])
    polish, _good = orthonormal_step(products[:r, :r])
    squares, vectors = np.linalg.eigh(polish.T @ products[r:, r:] @ polish)
    order = np.argsort(-squares, kind="stable")[:k]
    values = np.sqrt(np.maximum(squares[order], 0.0))
    # the squares hide the sign, and a topic needs a positive eigenvalue
    right = polish @ vectors[:, order]
    signed = np.einsum("ac,ab,bc->c", right, products[:r, r:], right)
    if len(order) < k or not (signed > 0).all() or not (values > 0).all():
        raise ValueError(f"the {k} leading eigenvalues of the second moment must be positive, got {signed.tolist()}")
    vectors = cut(times_small(basis, ["term_id"], cols, right))
    let_go(basis, image)
    return vectors, values


def whole_documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Regroup batches of rows sorted by `doc_id`, so that no document spans two of them."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if pdf.empty:
            continue
        ids = pdf["doc_id"].to_numpy()
        last = np.searchsorted(ids, ids[-1], side="left")
        if last > 0:
            yield pd.concat([*held, pdf.iloc[:last]], ignore_index=True)
            held = [pdf.iloc[last:]]
        elif held and held[-1]["doc_id"].iloc[-1] != ids[-1]:
            yield pd.concat(held, ignore_index=True)
            held = [pdf]
        else:
            held.append(pdf)
    if held:
        yield pd.concat(held, ignore_index=True)


def by_blocks(docs: DataFrame, block: int | Column) -> DataFrame:
    """Documents as one row with their terms by block: `(doc_id, w, blocks)`. Terms without a number or count are left out."""
    own = F.floor(F.col("term_id") / block) if isinstance(block, int) else block
    by_block = (docs.filter("term_id is not null and cnt is not null").select("doc_id", "term_id", "cnt", "len").withColumn("block", own.cast("long"))
                .groupBy("doc_id", "block").agg(F.first("len").alias("len"), F.collect_list("term_id").alias("t"), F.collect_list("cnt").alias("c")))
    whole = by_block.groupBy("doc_id").agg(F.first("len").alias("len"), F.collect_list(F.struct("block", "t", "c")).alias("blocks"))
    return whole.select("doc_id", F.expr(PAIR).alias("w"), "blocks")


def _paired(whole: DataFrame, n_blocks: int) -> DataFrame:
    first = whole.select("doc_id", "w", "blocks", F.explode("blocks").alias("x"))
    both = first.select("doc_id", "w", "x", F.explode(F.filter("blocks", lambda b: b["block"] >= F.col("x.block"))).alias("y"))
    other = F.col("x.block") != F.col("y.block")
    return both.select((F.col("x.block") * n_blocks + F.col("y.block")).alias("pair"), "doc_id", "w", F.col("x.t").alias("xt"), F.col("x.c").alias("xc"),
                       F.when(other, F.col("y.t")).alias("yt"), F.when(other, F.col("y.c")).alias("yc"))


def block_pairs(docs: DataFrame, block: int | Column, n_blocks: int) -> DataFrame:
    """Each document's terms by pairs of blocks of terms: `(pair, doc_id, w, xt, xc, yt, yc)`.

    Blocks are so many terms each, or a column that rises with the terms. Only pairs that the document touches are
    listed, the lower block first; within one block, `y` is left empty. Where documents are placed by document, nothing
    is shuffled.
    """
    return _paired(by_blocks(docs, block), n_blocks)


def even_blocks(docs: DataFrame) -> tuple[Column, int]:
    """Blocks of terms that follow each other and have about as many rows each: the block of a term, and their number.

    There are as many as a task's memory asks for, and pairs of them for all cores, however large the vocabulary is.
    """
    cores, rows = docs.sparkSession.sparkContext.defaultParallelism, docs.count()
    n = max(1, math.ceil(rows / HELD), min(math.ceil(math.sqrt(6 * cores)), rows // LEAST))
    if n == 1:
        return F.lit(0), 1
    ends = sorted(set(docs.approxQuantile("term_id", [x / n for x in range(1, n)], 1 / (8 * n)) or ()))
    above = [F.when(F.col("term_id") > int(end), 1).otherwise(0) for end in ends]
    return sum(above, F.lit(0)), len(ends) + 1


def _summed(keys: np.ndarray, values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The different keys below `size` in order, and the sums of their values, without those that are zero."""
    if size <= max(4 * len(keys), 1 << 16):
        total = np.bincount(keys, values, minlength=size)
        keys = np.flatnonzero(total)
        return keys, total[keys]
    order = np.argsort(keys)
    keys, values = keys[order], values[order]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    keys, total = keys[starts], np.add.reduceat(values, starts)
    return keys[total != 0], total[total != 0]


def _pair_cells(w: np.ndarray, x: tuple, y: tuple | None) -> Iterator[pa.RecordBatch]:
    """The cells of one pair of blocks; `x` and `y` are terms, counts and numbers of terms of its documents.

    Rows are added up one run after the other, each of as many whole rows as have `PRODUCTS` products and are no more than
    `BLOCK_TERMS`; the products of a longer row are added up in parts.
    """
    (xt, xc, nx), (yt, yc, ny) = x, x if y is None else y
    order = np.argsort(xt, kind="stable")
    xt, doc = xt[order], np.repeat(np.arange(len(nx), dtype=np.int32), nx)[order]
    weights = xc[order] * w[doc]
    del order
    first_y = np.cumsum(ny) - ny
    low, width = (int(yt.min()), int(yt.max()) - int(yt.min()) + 1) if len(yt) else (0, 1)
    rows = np.flatnonzero(np.concatenate((xt[1:] != xt[:-1], [True]))) + 1 if len(xt) else np.zeros(0, np.int64)  # where each row ends
    products = np.cumsum(ny[doc])
    done, start = 0, 0
    while done < len(rows):
        before = products[start - 1] if start else 0
        last = int(np.searchsorted(products[rows[done:done + BLOCK_TERMS] - 1], before + PRODUCTS, "right"))
        stop = int(rows[done + max(last, 1) - 1])
        base, size = int(xt[start]), (int(xt[stop - 1]) - int(xt[start]) + 1) * width
        found = []
        while start < stop:
            before = products[start - 1] if start else 0
            end = min(stop, max(start + 1, int(np.searchsorted(products, before + PRODUCTS, "right"))))
            many = ny[doc[start:end]]
            ends = np.cumsum(many)
            at = np.repeat(np.arange(start, end), many)
            other = np.arange(ends[-1]) + np.repeat(first_y[doc[start:end]] - ends + many, many)
            i, j, counts = xt[at].astype(np.int64), yt[other].astype(np.int64), yc[other]
            if y is None:
                kept = i <= j
                at, i, j = at[kept], i[kept], j[kept]
                counts = counts[kept] - (i == j)  # a word is no pair with itself
            found.append(_summed((i - base) * width + (j - low), weights[at] * counts, size))
            start = end
        keys, values = found[0] if len(found) == 1 else _summed(*(np.concatenate(part) for part in zip(*found)), size)
        done += max(last, 1)
        for lo in range(0, len(keys), 1 << 18):
            i, j = np.divmod(keys[lo:lo + (1 << 18)], width)
            yield pa.RecordBatch.from_arrays([pa.array((i + base).astype(np.int32)), pa.array((j + low).astype(np.int32)),
                                              pa.array(values[lo:lo + (1 << 18)])], ["i", "j", "v"])


def _arrays(terms: pa.ListArray, counts: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms and counts of a run of documents, one after the other, and how many each has."""
    sizes = pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False)
    return terms.flatten().to_numpy(zero_copy_only=False), counts.flatten().to_numpy(zero_copy_only=False), sizes.astype(np.int64)


def _few_products(docs: DataFrame, block: int | Column) -> bool:
    """Whether documents have hardly more pairs of terms than pairs of blocks, as short ones have in a large vocabulary."""
    own = F.floor(F.col("term_id") / block) if isinstance(block, int) else block
    by_block = docs.select("doc_id", own.alias("block")).groupBy("doc_id", "block").agg(F.count("*").alias("n"))
    sizes = by_block.groupBy("doc_id").agg(F.sum("n").cast("double").alias("n"), F.count("*").cast("double").alias("blocks"))
    total = sizes.agg(F.sum(F.expr("n * (n + 1) / 2")).alias("products"), F.sum(F.expr("blocks * (blocks + 1) / 2")).alias("pairs")).first()
    return (total["products"] or 0) <= 2 * (total["pairs"] or 0)


def _listed_products(docs: DataFrame) -> DataFrame:
    """The pair moment as a plain sum of the products of each document's counts."""
    entries = F.sort_array(F.collect_list(F.struct("term_id", "cnt")))
    whole = docs.filter("term_id is not null and cnt is not null").groupBy("doc_id").agg(F.first("len").alias("len"), entries.alias("e"))
    first = whole.select(F.expr(PAIR).alias("w"), "e", F.posexplode("e").alias("at", "x"))
    both = first.select("w", "x", F.explode(F.slice("e", F.col("at") + 1, F.size("e"))).alias("y"))
    i, j = F.col("x.term_id"), F.col("y.term_id")
    # a word is no pair with itself
    other = F.col("y.cnt") - F.when(i == j, 1.0).otherwise(0.0)
    return (both.select(i.alias("i"), j.alias("j"), (F.col("w") * F.col("x.cnt") * other).alias("v"))
            .groupBy("i", "j").agg(F.sum("v").alias("v")).filter("v != 0"))


def pair_moment(docs: DataFrame, vocab_size: int, block: int | None = None) -> DataFrame:
    """Sum over documents of (n nᵀ - diag n) / (len (len - 1)): `(i, j, v)` with i <= j, absent where it is zero.

    The moment is cut into blocks of terms, of `block` terms each or of about as many rows of the documents. A document's
    terms go to the pairs of blocks that they touch, so each row is shuffled once for every block, not for every
    other term; a task holds the documents of one pair and adds up its rows a few at a time. A block of too many rows is
    dealt among several tasks, whose sums are then added. Where nearly every pair of terms is a pair of blocks of its
    own, blocks add nothing up, and products are listed.
    """
    spark = docs.sparkSession
    group, n_blocks = even_blocks(docs) if block is None else (block, -(-vocab_size // block))
    if _few_products(docs, group):
        return _listed_products(docs)
    # read for the sizes of blocks and for the pairs
    whole = stored(by_blocks(docs, group), "documents-by-block")
    sizes = whole.select(F.explode("blocks").alias("x")).groupBy("x.block").agg(F.sum(F.size("x.t")).alias("rows"))
    large = {r["block"]: -(-r["rows"] // (2 * HELD)) for r in sizes.filter(F.col("rows") > 2 * HELD).collect()}
    most = max(large.values(), default=1)
    pairs = _paired(whole, n_blocks)
    salt = F.lit(0)
    if large:
        copies = F.create_map(*[F.lit(x) for item in large.items() for x in item])
        x, y = (F.coalesce(F.element_at(copies, side.cast("long")), F.lit(1)) for side in (F.floor(F.col("pair") / n_blocks), F.col("pair") % n_blocks))
        salt = F.pmod(F.xxhash64("doc_id"), F.greatest(x, y))
    dealt = pairs.withColumn("pair", F.col("pair") * most + salt)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None

        def cells() -> Iterator[pa.RecordBatch]:
            w, *sides = (pa.chunked_array([b.column(n) for b in held]).combine_chunks() for n in range(1, 6))
            held.clear()
            one = key // most // n_blocks == key // most % n_blocks
            yield from _pair_cells(w.to_numpy(zero_copy_only=False), _arrays(*sides[:2]), None if one else _arrays(*sides[2:]))

        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            start = 0
            while start < len(keys):
                if held and keys[start] != key:
                    yield from cells()
                key = int(keys[start])
                stop = int(np.searchsorted(keys, key, "right"))
                held.append(batch.slice(start, stop - start))
                start = stop
        if held:
            yield from cells()

    parts = max(shuffle_partitions(spark), n_blocks * (n_blocks + 1) // 2 if block is None else 0)
    placed = dealt.repartition(parts, "pair").sortWithinPartitions("pair")
    cells = placed.select("pair", "w", "xt", "xc", "yt", "yc").mapInArrow(add, "i int, j int, v double")
    return cells.groupBy("i", "j").agg(F.sum("v").alias("v")) if large else cells


def second_moment(docs: DataFrame, table: TermTable, vocab_size: int, alpha0: float) -> DataFrame:
    """The documents' part of the second moment: `(i, j, v)`, i <= j, zero for pairs that are not listed.

    The shifted moment is this less the product of the first moments, a0² m1_i m1_j, which no pair is
    without; it has rank one and is left in that form. Masked terms have no row.
    """
    open_docs = join_sized(docs, table.terms.select("term_id"), "term_id", table.n_terms * row_bytes(1), "doc_id", table.terms, "df")
    main = alpha0 * (alpha0 + 1) / table.n_docs
    return pair_moment(open_docs, vocab_size).select("i", "j", (F.lit(main) * F.col("v")).alias("v"))


def _cells_times(cells: DataFrame, basis: DataFrame, cols: Sequence[str], table: TermTable, alpha0: float) -> DataFrame:
    """The shifted second moment, from its stored cells in both directions, times columns of a tall matrix that carries
    the first moment: `(term_id, w0, w1, ...)`."""
    shift = column_sums(basis, cols, "m1") * (alpha0 * alpha0)
    named = basis.selectExpr("term_id as j", *[f"{c} as x{n}" for n, c in enumerate(cols)])
    counts = cells.groupBy("j").agg(F.count("*").alias("n"))
    hits = join_sized(cells, named, "j", table.n_terms * row_bytes(len(cols)), "i", counts, "n")
    image = hits.groupBy(F.col("i").alias("term_id")).agg(*[F.expr(f"sum(v * x{n}) as z{n}") for n in range(len(cols))])
    return basis.select("term_id", "m1").join(image, "term_id", "left").selectExpr(
        "term_id", *[f"coalesce(z{n}, 0.0D) - {number(shift[n])} * m1 as w{n}" for n in range(len(cols))])


def top_eigen_exact(docs: DataFrame, table: TermTable, vocab_size: int, k: int, alpha0: float, tol: float = 1e-10,
                    seed: int = 0, max_steps: int = 100) -> tuple[DataFrame, np.ndarray]:
    """Leading eigenpairs of the whole second moment, ranked by signed value, by block Lanczos steps on its stored cells.

    The cells are written once. Each step multiplies the newest block of the basis by them, makes the image orthogonal to
    the whole basis twice over and appends it; what the moment is within the basis gives eigenpairs and their residuals.
    Once the basis is wide it is started again from its leading vectors. Steps end when all k residuals, measured from
    the cells, are below `tol` of the largest value. Only products of columns come to the driver.
    """
    spark = docs.sparkSession
    if table.n_terms < k:
        raise ValueError(f"{table.n_terms} terms cannot give {k} topics")
    upper = stored(second_moment(docs, table, vocab_size, alpha0), "moment")
    cells = upper.unionByName(upper.filter("i != j").select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))
    widest = max(4 * k, k + 16)
    start = gaussian_matrix(table.terms, "term_id", k, seed)
    basis = stored(orthonormalize(start, "term_id").join(table.terms.select("term_id", "m1"), "term_id"), "basis")
    inside = np.zeros((0, 0))
    for _ in range(max_steps):
        cols = columns(basis)
        old, m = len(inside), len(cols)
        image = _cells_times(cells, basis, cols[old:], table, alpha0)
        n_new = m - old
        both = stored(basis.join(image, "term_id"), "image")
        images = [f"w{n}" for n in range(n_new)]
        products = gram_matrix(both, [*cols, *images])
        within = products[:m, m:]
        grown = np.zeros((m, m))
        grown[:old, :old] = inside
        grown[:, old:] = within
        grown[old:, :] = within.T
        inside = (grown + grown.T) / 2
        # what is new in the image, made orthogonal a second time from its own products
        rest = times_small(both, ["term_id", "m1"], [*cols, *images], np.block([[np.eye(m), -within], [np.zeros((n_new, m)), np.eye(n_new)]]))
        again = gram_matrix(rest, columns(rest))
        left = again[m:, m:] - again[:m, m:].T @ again[:m, m:]
        values, vectors = np.linalg.eigh(inside)
        values, vectors = values[::-1], vectors[:, ::-1]
        scale = np.abs(values).max()
        sizes, turn = np.linalg.eigh((left + left.T) / 2)
        # directions that hardly stand out from the rest would not come out orthogonal
        fresh = sizes > max((tol * scale) ** 2 * 1e-4, 1e-10 * sizes.max())
        beta = np.sqrt(np.maximum(sizes, 0.0))[:, None] * turn.T
        residuals = np.linalg.norm(beta @ vectors[old:, :k], axis=0)
        if m >= k and ((residuals <= tol * scale).all() or not fresh.any()):
            break
        step = turn[:, fresh] / np.sqrt(sizes[fresh])
        keep = np.eye(m)
        if m + fresh.sum() > widest:
            keep = vectors[:, :min(m, 2 * k)]
            inside = np.diag(values[:keep.shape[1]])
        whole = np.zeros((m + n_new, keep.shape[1] + step.shape[1]))
        whole[:m, :keep.shape[1]] = keep
        whole[:m, keep.shape[1]:] = -again[:m, m:] @ step
        whole[m:, keep.shape[1]:] = step
        earlier, basis = basis, stored(times_small(rest, ["term_id", "m1"], columns(rest), whole), "basis")
        let_go(earlier, both)
    else:
        raise RuntimeError(f"eigenvalues did not settle in {max_steps} steps: residuals {residuals.tolist()}")
    if values[k - 1] <= 0:
        raise ValueError(f"leading eigenvalues of the second moment must be positive, got {values[:k].tolist()}")
    leading = cut(times_small(both, ["term_id"], cols, vectors[:, :k]))
    let_go(upper, basis, both)
    return leading, values[:k].copy()


def whitening_matrix(vectors: DataFrame, values: Sequence[float]) -> DataFrame:
    """Eigenvectors over the roots of their eigenvalues."""
    return vectors.selectExpr("term_id", *[
        f"{c} * {number(1.0 / (float(np.sqrt(s)) + WHITEN_SLACK))} as c{j}"
        for j, (c, s) in enumerate(zip(columns(vectors), values))])


def outer_sums(rows: DataFrame, a: Sequence[str], b: Sequence[str], c: Sequence[str],
               triples: Sequence[tuple[int, int, int]]) -> np.ndarray:
    """The small tensor of sums over rows of a_i * b_j * c_l, at the given triples (zero elsewhere).

    Entries of `a`, `b` and `c` are SQL expressions. Few sums are one aggregate; many are added up
    per task with matrix products on Arrow batches. A task gives one array of the asked triples alone, and
    the arrays of several tasks are added in a task before the driver adds the rest.
    """
    out = np.zeros((len(a), len(b), len(c)))
    if len(triples) <= MAX_EXPRESSIONS:
        values = sums(rows, [f"{a[i]} * {b[j]} * {c[l]}" for i, j, l in triples])
        for t, v in zip(triples, values):
            out[t] = v
        return out

    na, nb = len(a), len(b)
    # rows of the packed sums: the pairs (i, j) that triples begin with
    pairs = sorted({(i, j) for i, j, _ in triples})
    left, right = (np.array(side) for side in zip(*pairs))
    place = {pair: n for n, pair in enumerate(pairs)}
    at = np.array([place[i, j] for i, j, _ in triples])
    last = np.array([l for _, _, l in triples])
    step = max(1, (1 << 20) // len(pairs))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(pairs), len(c)))
        for pdf in batches:
            x = pdf.to_numpy(float)
            for lo in range(0, len(x), step):
                part = x[lo:lo + step]
                total += (part[:, left] * part[:, na + right]).T @ part[:, na + nb:]
        yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "values": [total[at, last]]})

    found = merged(rows.selectExpr(*[f"{e} as x{n}" for n, e in enumerate([*a, *b, *c])])
                   .mapInPandas(partial, "part int, values array<double>"), lambda arrays: np.sum(arrays, axis=0))
    if found is not None:
        out[tuple(np.array(triples).T)] = found
    return out


def sorted_triples(k: int) -> list[tuple[int, int, int]]:
    return list(combinations_with_replacement(range(k), 3))


def _fill(cells: np.ndarray) -> np.ndarray:
    """A symmetric tensor from its entries at sorted indices."""
    out = np.zeros_like(cells)
    for t in sorted_triples(len(cells)):
        for place in set(permutations(t)):
            out[place] = cells[t]
    return out


def _symmetric(pairs_first: np.ndarray) -> np.ndarray:
    """From the sums of a⊗a⊗b, those of a⊗a⊗b + a⊗b⊗a + b⊗a⊗a."""
    return pairs_first + pairs_first.transpose(0, 2, 1) + pairs_first.transpose(2, 1, 0)


def third_moment_from_docs(projected: DataFrame, k: int, whitened_m1: np.ndarray, alpha0: float,
                           n_docs: int) -> np.ndarray:
    """The part with whole documents: mean of c1 p⊗p⊗p - c2 h sym(p, q)."""
    p = [f"p{j}" for j in range(k)]
    rows = projected.selectExpr(*p, f"{TRIPLE} as c1", *[f"sqrt({PAIR}) * {c} as r{j}" for j, c in enumerate(p)])
    cubes = _fill(outer_sums(rows, [f"c1 * {c}" for c in p], p, p, sorted_triples(k)))
    squares = gram_matrix(rows, [f"r{j}" for j in range(k)])
    h = alpha0 / (alpha0 + 2)
    return (cubes - h * _symmetric(np.einsum("ij,l->ijl", squares, whitened_m1))) / n_docs


def third_moment_term_vectors(docs: DataFrame, projected: DataFrame, k: int) -> DataFrame:
    """By term, the sum of c1 * cnt * p over documents: `(term_id, z0, ...)`."""
    return spread_to_terms(docs, projected, k, TRIPLE)


def third_moment_from_pairs(vectors: DataFrame, white: DataFrame, table: TermTable, k: int,
                            whitened_m1: np.ndarray, alpha0: float) -> np.ndarray:
    """The part with two equal words: mean of sym(w_t, x_t), x_t = -z_t + h s2_t q."""
    h = alpha0 / (alpha0 + 2)
    w = [f"c{j}" for j in range(k)]
    rows = (vectors.join(white, "term_id").join(table.terms.select("term_id", "s2"), "term_id")
            .selectExpr(*w, *[f"s2 * {number(h * whitened_m1[j])} - z{j} as x{j}" for j in range(k)]))
    # a_i a_j b_l with i <= j; the other half mirrors it
    upper = outer_sums(rows, w, w, [f"x{j}" for j in range(k)],
                       [(i, j, l) for i in range(k) for j in range(i, k) for l in range(k)])
    whole = upper + np.triu(np.ones((k, k)), 1).T[:, :, None] * upper.transpose(1, 0, 2)
    return _symmetric(whole) / table.n_docs


def third_moment_from_triples(white: DataFrame, table: TermTable, k: int) -> np.ndarray:
    """The part with three equal words: mean of y_t w⊗w⊗w, y_t = 2 s1_t."""
    w = [f"c{j}" for j in range(k)]
    rows = white.join(table.terms.select("term_id", "s1"), "term_id")
    return _fill(outer_sums(rows, [f"2.0D * s1 * {c}" for c in w], w, w, sorted_triples(k))) / table.n_docs


def third_moment_shift(whitened_m1: np.ndarray, alpha0: float) -> np.ndarray:
    """The multiple of q⊗q⊗q."""
    c = 2 * alpha0 * alpha0 / ((alpha0 + 1) * (alpha0 + 2))
    return c * np.einsum("i,j,l->ijl", whitened_m1, whitened_m1, whitened_m1)


def whitened_third_moment(docs: DataFrame, white: DataFrame, table: TermTable, alpha0: float) -> np.ndarray:
    """The scaled whitened third moment, a symmetric topics x topics x topics tensor.

    Two passes over the documents: one projects them (kept, a few numbers per document), one
    spreads the projections back to the terms.
    """
    k = len(columns(white))
    since = len(table.layout.passed) if table.layout is not None else 0
    q = whiten_first_moment(white, table)
    projected = project_docs(docs, white, table).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        total = third_moment_from_docs(projected, k, q, alpha0, table.n_docs)
        vectors = third_moment_term_vectors(docs, projected, k)
        total = total + third_moment_from_pairs(vectors, white, table, k, q, alpha0)
    finally:
        projected.unpersist()
    if table.layout is not None:
        let_go(*table.layout.spent(since))
    total = total + third_moment_from_triples(white, table, k) + third_moment_shift(q, alpha0)
    return total * alpha0 * (alpha0 + 1) * (alpha0 + 2) / 2


def whiten_first_moment(white: DataFrame, table: TermTable) -> np.ndarray:
    return column_sums(white.join(table.terms.select("term_id", "m1"), "term_id"), columns(white), "m1")


def tensor_cells(like: DataFrame, tensor: np.ndarray) -> DataFrame:
    """A small symmetric tensor as rows `(i, j, l, v)` at sorted indices."""
    cells = [(*t, float(tensor[t])) for t in sorted_triples(len(tensor))]
    return like.sparkSession.createDataFrame(cells, "i int, j int, l int, v double")
