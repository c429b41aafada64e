"""Direct numpy formulas over whole count matrices, to compare the distributed operators with."""

import itertools

import numpy as np

from topicmoments.plans.fit import prepare, term_table

SCHEMA = "doc_id bigint, term_id int, cnt double"


def doc_frame(spark, counts, first_id=1000):
    """A dense count matrix (documents x terms) as a document-term table without zeros."""
    rows = [(first_id + d, int(t), float(counts[d, t])) for d in range(len(counts)) for t in np.flatnonzero(counts[d])]
    return spark.createDataFrame(rows, SCHEMA)


def prepared(spark, counts, idf_lb=1.0):
    from pyspark.sql import functions as F

    docs = prepare(doc_frame(spark, counts))
    return docs.filter(F.col("len") >= 3), term_table(docs, None, idf_lb)


def wide(spark, matrix, key="term_id"):
    cols = ", ".join(f"c{j} double" for j in range(matrix.shape[1]))
    return spark.createDataFrame([(t, *map(float, row)) for t, row in enumerate(matrix)], f"{key} int, {cols}")


def to_matrix(frame, n_rows, key="term_id"):
    from topicmoments.operators.matrix import columns

    cols = columns(frame)
    out = np.zeros((n_rows, len(cols)))
    for row in frame.collect():
        out[row[key]] = [row[c] for c in cols]
    return out


def long_docs(counts):
    return counts[counts.sum(axis=1) >= 3]


def first_moment(counts):
    n = long_docs(counts)
    return (n / n.sum(axis=1, keepdims=True)).mean(axis=0)


def pair_moment(counts):
    n = long_docs(counts)
    total = np.zeros((n.shape[1],) * 2)
    for row in n:
        length = row.sum()
        total += (np.outer(row, row) - np.diag(row)) / (length * (length - 1))
    return total / len(n)


def second_moment(counts, alpha0):
    m1 = first_moment(counts)
    return alpha0 * (alpha0 + 1) * pair_moment(counts) - alpha0 ** 2 * np.outer(m1, m1)


def third_moment(counts, alpha0):
    """The scaled shifted third moment over all triples of terms."""
    n = long_docs(counts)
    v = n.shape[1]
    e3 = np.zeros((v, v, v))
    for row in n:
        length = row.sum()
        part = np.einsum("i,j,l->ijl", row, row, row)
        for i in range(v):
            for j in range(v):
                part[i, i, j] -= row[i] * row[j]
                part[i, j, i] -= row[i] * row[j]
                part[j, i, i] -= row[i] * row[j]
            part[i, i, i] += 2 * row[i]
        e3 += part / (length * (length - 1) * (length - 2))
    e3 /= len(n)
    m1, e2 = first_moment(counts), pair_moment(counts)
    shift = (np.einsum("ij,l->ijl", e2, m1) + np.einsum("il,j->ijl", e2, m1) + np.einsum("jl,i->ijl", e2, m1))
    m3 = (e3 - alpha0 / (alpha0 + 2) * shift
          + 2 * alpha0 ** 2 / ((alpha0 + 1) * (alpha0 + 2)) * np.einsum("i,j,l->ijl", m1, m1, m1))
    return m3 * alpha0 * (alpha0 + 1) * (alpha0 + 2) / 2


def simulate(rng, alpha, topics, n_docs, n_tokens):
    """Counts drawn from a topic model; `topics` is terms x topics with columns that sum to one."""
    theta = rng.dirichlet(alpha, n_docs)
    return np.array([rng.multinomial(n_tokens, topics @ t) for t in theta], dtype=float)


def best_match(found, truth):
    """Least distance over the orders of the columns, and that order."""
    k = truth.shape[1]
    orders = list(itertools.permutations(range(k)))
    errors = [np.linalg.norm(found[:, o] - truth) for o in orders]
    best = int(np.argmin(errors))
    return errors[best], list(orders[best])
