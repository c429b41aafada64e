"""SQL that gives the same rows as the queries, written from the definitions rather than from them."""

from __future__ import annotations

from topicmoments.catalog import queries as q
from topicmoments.functions.words import (
    DANDA, HIRAGANA, JOINER, KANA_MARKS, KANJI, KATAKANA, NUMBER_JOINER, WORD)
from topicmoments.sources.stopwords import ENGLISH


# The pieces of the word breaker in the SQL engine's dialect, which has neither class intersections
# nor possessive steps.
_FORMAT = r"[^\P{Cf}\x{AD}]"
_MARK = rf"(?:[\p{{Mn}}\p{{Me}}]|{_FORMAT})"
_LETTERS = rf"(?:(?:[^\P{{L}}{KANJI}{HIRAGANA}{KATAKANA}{KANA_MARKS}]|\p{{Mc}})+{_MARK}*)+"
_DIGITS = rf"(?:\p{{N}}+{_MARK}*)+"
_KANA = rf"[{HIRAGANA}][{HIRAGANA}{KANA_MARKS}]*|[{KATAKANA}][{KATAKANA}{KANA_MARKS}]*"
PIECE = (rf"(?:\A{_FORMAT}+)?(?:{_LETTERS}(?:{JOINER}{_FORMAT}*{_LETTERS})*"
         rf"|{_DIGITS}(?:{NUMBER_JOINER}{_FORMAT}*{_DIGITS})*)+{DANDA}?"
         rf"|[{KANJI}]+{_MARK}*|(?:{_KANA}|[{KANA_MARKS}]+(?:{_KANA})?){_MARK}*")


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _words(table: str, key: str) -> str:
    return (f"SELECT doc_id, term FROM (SELECT {key} AS doc_id, lower(unnest(regexp_extract_all(text, {_text(PIECE)})))"
            f" AS term FROM {table}) WHERE regexp_matches(term, {_text(WORD)})")


def _vocab(counts: str, size: int) -> str:
    return (f"SELECT CAST(row_number() OVER (ORDER BY n DESC, term) - 1 AS INTEGER) AS term_id, term, n FROM {counts}"
            + (f" ORDER BY n DESC, term LIMIT {size}" if size > 0 else ""))


_DOCS = ("SELECT doc_id, term_id, CAST(count(*) AS DOUBLE) AS cnt FROM {words} JOIN {vocab} USING (term)"
         " GROUP BY doc_id, term_id")
_COUNTS = "SELECT term, count(*) AS n FROM {words} GROUP BY term"
_R = range(q.RANK)
_TRIPLES = [(i, j, l) for i in _R for j in range(i, q.RANK) for l in range(j, q.RANK)]
_A0 = f"CAST({q.ALPHA0} AS DOUBLE)"
_H = f"({_A0} / ({_A0} + 2))"
_TOPICS = range(len(q.PRIOR))
_LANG = "CAST(list_position(['de', 'en', 'es', 'fr'], lang) - 1 AS INTEGER)"
_FLAG = "CAST(list_position(['A', 'N', 'R'], l_returnflag) - 1 AS INTEGER)"


def _rule(key: str) -> str:
    return ", ".join(f"(({key} * 31 + {j} * 17) % 101) / 101.0::DOUBLE - 0.5::DOUBLE AS c{j}" for j in _R)


def r(e: str, digits: int = 8) -> str:
    return f"round({e}, {digits}) + 0.0::DOUBLE"


# Named parts that the statements below build on, in order of need.
PARTS: dict[str, str] = {
    "stop": "SELECT unnest([" + ", ".join(_text(w) for w in ENGLISH) + "]) AS term",
    "all_words": _words("documents", "doc_id"),
    "words": "SELECT doc_id, term FROM all_words WHERE term NOT IN (SELECT term FROM stop)",
    "said": _words("conversations", "conv_id"),
    "listed": _words("benchmark", "item_id"),
    "counts": _COUNTS.format(words="words"),
    "vocab": _vocab("counts", q.ALL),
    "top_vocab": _vocab("counts", q.TOP),
    "top_docs": _DOCS.format(words="words", vocab="top_vocab"),
    "few_vocab": _vocab("counts", 20),
    "few_docs": _DOCS.format(words="words", vocab="few_vocab"),
    "docs": _DOCS.format(words="words", vocab="vocab"),
    "all_counts": _COUNTS.format(words="all_words"),
    "all_vocab": _vocab("all_counts", q.ALL),
    "all_docs": _DOCS.format(words="all_words", vocab="all_vocab"),
    "term_ids": "SELECT term_id FROM vocab",
    "term_count": "SELECT count(*)::DOUBLE AS v FROM vocab",
    "lengths": "SELECT doc_id, sum(cnt) AS len FROM docs GROUP BY doc_id",
    "freq": "SELECT term_id, count(*) AS df FROM docs WHERE cnt > 0 GROUP BY term_id",
    "total_docs": "SELECT count(*) AS n FROM documents",
    "all_idf": ("SELECT term_id, n::DOUBLE / count(*) AS idf FROM all_docs, total_docs WHERE cnt > 0"
                " GROUP BY term_id, n"),
    "m1": ("SELECT term_id, sum(cnt / len) / (SELECT count(*) FROM lengths WHERE len >= 3) AS m1"
           " FROM docs JOIN lengths USING (doc_id) WHERE len >= 3 GROUP BY term_id"),
    # orders as documents
    "o_docs": ("SELECT l_orderkey AS doc_id, CAST(l_suppkey AS INTEGER) AS term_id, sum(l_quantity) AS cnt"
               " FROM lineitem GROUP BY 1, 2"),
    "o_len": "SELECT doc_id, sum(cnt) AS len FROM o_docs GROUP BY doc_id HAVING sum(cnt) >= 3",
    "o_n": "SELECT count(*)::DOUBLE AS n FROM o_len",
    "o_rows": ("SELECT doc_id, term_id, cnt, len, 1 / (len * (len - 1)) AS w2, 1 / (len * (len - 1) * (len - 2)) AS w3"
               " FROM o_docs JOIN o_len USING (doc_id)"),
    "o_m1": "SELECT term_id, sum(cnt / len) / any_value(n) AS m1 FROM o_rows, o_n GROUP BY term_id",
    "o_mat": f"SELECT term_id, {_rule('term_id')} FROM (SELECT DISTINCT term_id FROM o_docs)",
    "o_q": "SELECT " + ", ".join(f"sum(m1 * c{j}) AS q{j}" for j in _R) + " FROM o_m1 JOIN o_mat USING (term_id)",
    "o_p": ("SELECT doc_id, any_value(len) AS len, any_value(w2) AS w2, any_value(w3) AS w3, "
            + ", ".join(f"sum(cnt * c{j}) AS p{j}" for j in _R) + " FROM o_rows JOIN o_mat USING (term_id) GROUP BY doc_id"),
    # by term: sums that the second and third part of the third moment need
    "o_terms": ("SELECT a.term_id, sum(cnt * a.w2) AS s2, sum(cnt * a.w3) AS s1, "
                + ", ".join(f"sum(a.w3 * cnt * p{j}) AS z{j}" for j in _R)
                + " FROM o_rows a JOIN o_p USING (doc_id) GROUP BY a.term_id"),
    # documents of one language as a topic
    "lang_counts": (f"SELECT {_LANG} AS topic, term_id, sum(cnt) AS n FROM docs JOIN documents USING (doc_id)"
                    " GROUP BY 1, 2"),
    "lang_model": "SELECT topic, term_id, n / sum(n) OVER (PARTITION BY topic) AS p FROM lang_counts",
    "lang_alpha": f"SELECT {_LANG} AS topic, avg(n_chars) / 1000 AS alpha FROM documents GROUP BY 1",
    "smoothed": (f"SELECT topic, term_id, coalesce(p, 0) * (1 - {q.SMOOTHING}::DOUBLE) + {q.SMOOTHING}::DOUBLE / v AS p"
                 " FROM (SELECT term_id, v, CAST(t.range AS INTEGER) AS topic FROM term_ids, term_count, range(4) t)"
                 " LEFT JOIN lang_model USING (topic, term_id)"),
    "cells": ("SELECT l_linenumber AS i, CAST(month(l_shipdate) - 1 AS INTEGER) AS j, CAST(l_suppkey AS INTEGER) AS l,"
              " sum(l_quantity / 100) AS v FROM lineitem GROUP BY 1, 2, 3"),
    **{f"factor_{m}": f"SELECT {m}, {_rule(m)} FROM (SELECT DISTINCT {m} FROM cells)" for m in ("i", "j", "l")},
    "entries": ("SELECT vec_id AS row, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS col,"
                " CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings"),
    "norms": "SELECT col, sqrt(sum(v * v)) AS norm FROM entries GROUP BY col",
}


def _needs(sql: str, names: list[str]) -> set[str]:
    import re

    found: set[str] = set()
    for name in names:
        if name not in found and re.search(rf"\b{name}\b", re.sub(r"'(?:[^']|'')*'", "''", sql)):
            found |= {name} | _needs(PARTS[name], names[:names.index(name)])
    return found


def statement(select: str, extra: dict[str, str] | None = None) -> str:
    """A statement with the named parts it uses in front."""
    extra = extra or {}
    names = list(PARTS)
    used = set().union(*[_needs(s, names) for s in (select, *extra.values())])
    parts = [(n, PARTS[n]) for n in names if n in used] + list(extra.items())
    if not parts:
        return select
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({s})" for n, s in parts) + "\n" + select


def _shifted_m2(rows: str, m1: str, mat: str, n: str) -> dict[str, str]:
    """The shifted second moment times a matrix, with the moment formed pair by pair."""
    return {
        "pairs": (f"SELECT a.term_id AS t, b.term_id AS u, sum(a.cnt * b.cnt * a.w2) AS v FROM {rows} a JOIN {rows} b"
                  " USING (doc_id) GROUP BY 1, 2 UNION ALL"
                  f" SELECT term_id, term_id, -sum(cnt * w2) FROM {rows} GROUP BY 1"),
        "image": ("SELECT t, " + ", ".join(f"sum(v * c{j}) AS e{j}" for j in _R)
                  + f" FROM pairs JOIN {mat} ON u = {mat}.term_id GROUP BY t"),
        "shift": "SELECT " + ", ".join(f"sum(m1 * c{j}) AS h{j}" for j in _R) + f" FROM {m1} JOIN {mat} USING (term_id)",
        "result": ("SELECT t AS term_id, " + ", ".join(
            f"{r(f'{_A0} * ({_A0} + 1) * e{j} / {n} - {_A0} * {_A0} * m1 * h{j}', 12)} AS c{j}" for j in _R)
            + f" FROM image JOIN {m1} ON t = {m1}.term_id, shift, (SELECT n AS {n} FROM size)"),
    }


def _by_triple(value, source: str) -> str:
    """One row per sorted triple, from an expression of the triple over a source."""
    return " UNION ALL ".join(
        f"SELECT {i} AS i, {j} AS j, {l} AS l, {r(value(i, j, l), 10)} AS v FROM {source}" for i, j, l in _TRIPLES)


def _sym(a, b, i, j, l) -> str:
    return f"({a}{i} * {a}{j} * {b}{l} + {a}{i} * {b}{j} * {a}{l} + {b}{i} * {a}{j} * {a}{l})"


def _first(i, j, l) -> str:
    return f"sum(w3 * p{i} * p{j} * p{l} - w2 * {_H} * {_sym('p', 'q', i, j, l)}) / any_value(n)"


def _second(i, j, l) -> str:
    return f"sum({_sym('c', 'x', i, j, l)}) / any_value(n)"


def _third(i, j, l) -> str:
    return f"sum(2 * s1 * c{i} * c{j} * c{l}) / any_value(n)"


_FIRST_FROM = "o_p, o_q, o_n"
_SECOND_PARTS = {"x": ("SELECT term_id, c0, c1, c2, " + ", ".join(f"{_H} * s2 * q{j} - z{j} AS x{j}" for j in _R)
                       + " FROM o_terms JOIN o_mat USING (term_id), o_q")}
_THIRD_FROM = "o_terms JOIN o_mat USING (term_id), o_n"


def _digamma(x: str) -> str:
    z = f"({x} + 10)"
    below = " + ".join(f"1 / ({x} + {i})" for i in range(10))
    return (f"(ln({z}) - 1 / (2 * {z}) - 1 / (12 * {z}^2) + 1 / (120 * {z}^4) - 1 / (252 * {z}^6) + 1 / (240 * {z}^8)"
            f" - 1 / (132 * {z}^10) - ({below}))")


def _uniform(seed, *keys) -> str:
    text = " || ':' || ".join(f"CAST({k} AS VARCHAR)" for k in (seed, *keys))
    return f"((('0x' || substr(md5({text}), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE)"


def _inference() -> dict[str, str]:
    """Variational inference until a document settles, or for the most iterations."""
    t = _TOPICS
    total = " + ".join(f"g{k}" for k in t)
    phi = "(" + " + ".join(f"b{k} * e{k}" for k in t) + " + 1e-100)"
    change = " + ".join(f"abs(n{k} - g{k})" for k in t)
    weights = ", ".join(f"exp({_digamma(f'g{k}')} - {_digamma('whole')}) AS e{k}" for k in t)
    step = ", ".join(f"any_value(g{k}) AS g{k}, any_value(e{k}) * sum(b{k} * cnt / {phi}) + {q.PRIOR[k]}::DOUBLE AS n{k}" for k in t)
    return {
        "model": ("SELECT term_id, " + ", ".join(f"max(CASE WHEN topic = {k} THEN p END) AS b{k}" for k in t)
                  + " FROM smoothed GROUP BY term_id"),
        "rows": "SELECT doc_id, cnt, b0, b1, b2, b3 FROM docs JOIN model USING (term_id)",
        "starts": ("SELECT doc_id, " + ", ".join(f"-ln({_uniform(3, 'doc_id', k, 0)}) AS g{k}" for k in t)
                   + " FROM (SELECT DISTINCT doc_id FROM docs)"),
        "gammas": (f"SELECT 0 AS n, doc_id, true AS moving, {', '.join(f'g{k}' for k in t)} FROM starts UNION ALL"
                   f" SELECT n + 1, doc_id, ({change}) / {len(t)} > 1e-3, {', '.join(f'n{k}' for k in t)} FROM"
                   f" (SELECT any_value(n) AS n, doc_id, {step} FROM (SELECT *, {weights} FROM (SELECT *, {total} AS whole"
                   f" FROM gammas WHERE moving AND n < {q.INFER_ITERATIONS})) JOIN rows USING (doc_id) GROUP BY doc_id)"),
        "last": "SELECT * FROM gammas QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC) = 1",
    }


def _bounds() -> dict[str, str]:
    t = _TOPICS
    whole = "(" + " + ".join(f"g{k}" for k in t) + ")"
    prior_sum = sum(q.PRIOR)
    return {
        **_inference(),
        "expected": ("SELECT doc_id, g0, g1, g2, g3, " + ", ".join(f"{_digamma(f'g{k}')} - {_digamma(whole)} AS x{k}" for k in t)
                     + " FROM last"),
        "word_part": ("SELECT doc_id, sum(cnt * ln(" + " + ".join(f"exp(x{k} + ln(b{k}))" for k in t) + ")) AS w"
                      " FROM rows JOIN expected USING (doc_id) GROUP BY doc_id"),
        "bounds": ("SELECT doc_id, w + " + " + ".join(
            f"({q.PRIOR[k]}::DOUBLE - g{k}) * x{k} + lgamma(g{k}) - lgamma({q.PRIOR[k]}::DOUBLE)" for k in t)
            + f" + lgamma({prior_sum}::DOUBLE) - lgamma({whole}) AS bound, 0.0::DOUBLE AS skipped"
            " FROM word_part JOIN expected USING (doc_id)"),
    }


def _gaussian(seed, key, j, key2=None) -> str:
    keys = (key, j) if key2 is None else (key, key2, j)
    return f"sqrt(-2 * ln({_uniform(seed, *keys, 0)})) * cos(2 * pi() * {_uniform(seed, *keys, 1)})"


_SIMPLEX = {
    "scan": ("SELECT vec_id, v, place, (sum(v) OVER (PARTITION BY vec_id ORDER BY place) - 1) / place AS theta FROM"
             " (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, row) AS place FROM vectors)"),
    "theta": "SELECT vec_id, arg_max(theta, place) AS theta FROM scan WHERE v - theta > 0 GROUP BY vec_id",
}
_PROJECT = statement(f"SELECT vec_id, row, {r('greatest(v - theta, 0)')} AS v, {r('theta')} AS theta"
                     " FROM vectors JOIN theta USING (vec_id)",
                     {"vectors": "SELECT row AS vec_id, col AS row, v FROM entries", **_SIMPLEX})
# both signs, each moved to start at zero, compared by their shift
_PROJECT_SIGNED = statement(
    f"SELECT vec_id // 2 AS vec_id, row, {r('greatest(v - theta, 0)')} AS v,"
    " CASE WHEN vec_id % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sign"
    " FROM vectors JOIN theta USING (vec_id) JOIN chosen USING (vec_id)",
    {"signed": ("SELECT row * 2 AS vec_id, col AS row, v FROM entries"
                " UNION ALL SELECT row * 2 + 1, col, -v FROM entries"),
     "vectors": "SELECT vec_id, row, v - min(v) OVER (PARTITION BY vec_id) AS v FROM signed", **_SIMPLEX,
     "chosen": ("SELECT CASE WHEN a.theta < b.theta THEN a.vec_id ELSE b.vec_id END AS vec_id FROM theta a"
                " JOIN theta b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0")})

_MODEL = " + ".join(f"{q.LAMBDA[c]}::DOUBLE * a.c{c} * b.c{c} * d.c{c}" for c in _R)
_SIGMA_ROOT = [s ** 0.5 for s in q.SIGMA]


def _unwhitened(j: int) -> str:
    return " + ".join(f"c{i} * {_SIGMA_ROOT[i]}::DOUBLE * {q.FACTOR[i][j]}::DOUBLE * {q.LAMBDA[j]}::DOUBLE" for i in _R)


def _orthonormal() -> dict[str, str]:
    """Columns made orthonormal one after the other, each round done twice."""
    parts = {"b_0": ("SELECT l_orderkey, sum(l_quantity) AS c0, sum(l_extendedprice) AS c1, sum(l_discount * 100) AS c2"
                     " FROM lineitem GROUP BY l_orderkey")}
    step = 0
    for j in _R:
        for _ in range(2):
            others = [k for k in _R if k != j]
            if j:
                dots = ", ".join(f"sum(c{j} * c{k}) AS d{k}" for k in range(j))
                new = f"c{j} - " + " - ".join(f"d{k} * c{k}" for k in range(j))
                parts[f"b_{step + 1}"] = (f"SELECT l_orderkey, {', '.join(f'c{k}' for k in others)}, {new} AS c{j}"
                                          f" FROM b_{step}, (SELECT {dots} FROM b_{step})")
                step += 1
            parts[f"b_{step + 1}"] = (f"SELECT l_orderkey, {', '.join(f'c{k}' for k in others)}, c{j} / norm AS c{j}"
                                      f" FROM b_{step}, (SELECT sqrt(sum(c{j} * c{j})) AS norm FROM b_{step})")
            step += 1
    parts["basis"] = f"SELECT * FROM b_{step}"
    return parts


def _two_orthonormal(key: str, source: str, name: str) -> dict[str, str]:
    """Two columns made orthonormal, the first kept in direction; the second step is done twice."""
    parts = {f"{name}_u": f"SELECT {key}, c0 / (SELECT sqrt(sum(c0 * c0)) FROM {source}) AS c0, c1 FROM {source}"}
    before = f"{name}_u"
    for n in (1, 2):
        parts[f"{name}_v{n}"] = f"SELECT {key}, c0, c1 - (SELECT sum(c0 * c1) FROM {before}) * c0 AS c1 FROM {before}"
        before = f"{name}_v{n}"
    parts[name] = f"SELECT {key}, c0, c1 / (SELECT sqrt(sum(c1 * c1)) FROM {before}) AS c1 FROM {before}"
    return parts


def _als() -> dict[str, str]:
    """Rounds of least-squares updates for two components, for each start, and the best of them."""
    parts: dict[str, str] = {}
    for start in range(q.ALS_STARTS):
        for m in "ijl":
            parts[f"raw_{m}{start}"] = (f"SELECT {m}, " + ", ".join(f"{_gaussian(start, _text(m), c, key2=m)} AS c{c}" for c in (0, 1))
                                        + f" FROM (SELECT DISTINCT {m} FROM cells)")
            parts |= _two_orthonormal(m, f"raw_{m}{start}", f"f_{m}{start}_0")
        now = {m: f"f_{m}{start}_0" for m in "ijl"}
        for n in range(1, q.ALS_ROUNDS + 1):
            for keep, mb, mc in ("ijl", "jli", "lij"):
                b, c, out = now[mb], now[mc], f"f_{keep}{start}_{n}"
                parts[f"{out}_s"] = (f"SELECT {keep}, sum(v * b.c0 * d.c0) AS r0, sum(v * b.c1 * d.c1) AS r1 FROM cells"
                                     f" JOIN {b} b USING ({mb}) JOIN {c} d USING ({mc}) GROUP BY {keep}")
                # columns have norm one, so only the product of the two cosines stands off the diagonal
                parts[f"{out}_g"] = f"SELECT (SELECT sum(c0 * c1) FROM {b}) * (SELECT sum(c0 * c1) FROM {c}) AS g"
                parts[f"{out}_t"] = (f"SELECT {keep}, (r0 - g * r1) / (1 - g * g) AS t0, (r1 - g * r0) / (1 - g * g) AS t1"
                                     f" FROM {out}_s, {out}_g")
                parts[f"{out}_n"] = f"SELECT sqrt(sum(t0 * t0)) AS n0, sqrt(sum(t1 * t1)) AS n1 FROM {out}_t"
                parts[out] = f"SELECT {keep}, t0 / n0 AS c0, t1 / n1 AS c1 FROM {out}_t, {out}_n"
                now[keep] = out
        parts[f"loss_{start}"] = (
            f"SELECT {start} AS start, any_value(n0) AS n0, any_value(n1) AS n1, sqrt(sum(power(coalesce(v, 0)"
            f" - n0 * a.c0 * b.c0 * d.c0 - n1 * a.c1 * b.c1 * d.c1, 2))) AS loss FROM {now['i']} a CROSS JOIN {now['j']} b"
            f" CROSS JOIN {now['l']} d CROSS JOIN {now['l']}_n LEFT JOIN cells ON cells.i = a.i AND cells.j = b.j AND cells.l = d.l")
    last = q.ALS_ROUNDS
    parts["losses"] = " UNION ALL ".join(f"SELECT * FROM loss_{s}" for s in range(q.ALS_STARTS))
    parts["best"] = "SELECT * FROM losses ORDER BY loss, start LIMIT 1"
    parts["found"] = " UNION ALL ".join(f"SELECT {s} AS start, * FROM f_i{s}_{last}" for s in range(q.ALS_STARTS))
    return parts


_F0 = f"CAST({q.FIT_ALPHA0} AS DOUBLE)"


def _wide_third() -> dict[str, str]:
    """The third moment of many columns, with one row for each document (or term) and column, and joins by triple."""
    three = " JOIN {t} b ON b.{k} = a.{k} JOIN {t} c ON c.{k} = a.{k} JOIN wide_t t ON t.i = a.j AND t.j = b.j AND t.l = c.j"
    q3 = " JOIN wide_q qi ON qi.j = t.i JOIN wide_q qj ON qj.j = t.j JOIN wide_q ql ON ql.j = t.l"
    return {
        "wide_w": (f"SELECT term_id, j, ((term_id * 31 + j * 17) % 101) / 101.0::DOUBLE - 0.5::DOUBLE AS c FROM (SELECT DISTINCT term_id FROM o_docs), range({q.WIDE}) x(j)"),
        "wide_t": f"SELECT i, j, l FROM range({q.WIDE}) a(i), range({q.WIDE}) b(j), range({q.WIDE}) c(l) WHERE i <= j AND j <= l",
        "wide_q": "SELECT j, sum(m1 * c) AS q FROM o_m1 JOIN wide_w USING (term_id) GROUP BY j",
        "wide_p": "SELECT doc_id, j, any_value(w2) AS w2, any_value(w3) AS w3, sum(cnt * c) AS p FROM o_rows JOIN wide_w USING (term_id) GROUP BY doc_id, j",
        "wide_s": "SELECT term_id, sum(cnt * w2) AS s2, sum(cnt * w3) AS s1 FROM o_rows GROUP BY term_id",
        "wide_z": "SELECT r.term_id, p.j, sum(r.w3 * r.cnt * p.p) AS z FROM o_rows r JOIN wide_p p USING (doc_id) GROUP BY r.term_id, p.j",
        "wide_x": (f"SELECT w.term_id, w.j, w.c, s.s1, {_H} * s.s2 * k.q - z.z AS x FROM wide_w w JOIN wide_s s USING (term_id)"
                   " JOIN wide_z z ON z.term_id = w.term_id AND z.j = w.j JOIN wide_q k ON k.j = w.j"),
        "wide_1": (f"SELECT t.i, t.j, t.l, sum(a.w3 * a.p * b.p * c.p - a.w2 * {_H} * (a.p * b.p * ql.q + a.p * qj.q * c.p + qi.q * b.p * c.p)) AS v"
                   " FROM wide_p a" + three.format(t="wide_p", k="doc_id") + q3 + " GROUP BY 1, 2, 3"),
        "wide_2": ("SELECT t.i, t.j, t.l, sum(a.c * b.c * c.x + a.c * b.x * c.c + a.x * b.c * c.c + 2 * a.s1 * a.c * b.c * c.c) AS v"
                   " FROM wide_x a" + three.format(t="wide_x", k="term_id") + " GROUP BY 1, 2, 3"),
    }


def _one_topic() -> dict[str, str]:
    """The fit of one topic: subspace iteration (q = 1), whitening, third moment, projection."""
    def image(mat: str, name: str) -> dict[str, str]:
        return {f"{name}_h": "SELECT " + ", ".join(f"sum(m1 * c{j}) AS h{j}" for j in (0, 1)) + f" FROM mean JOIN {mat} USING (term_id)",
                f"{name}_p": ("SELECT doc_id, " + ", ".join(f"sum(cnt * c{j}) AS p{j}" for j in (0, 1))
                              + f" FROM rows JOIN {mat} USING (term_id) GROUP BY doc_id"),
                f"{name}_e": ("SELECT term_id, " + ", ".join(f"sum(w2 * cnt * p{j}) AS e{j}" for j in (0, 1))
                              + f" FROM rows JOIN {name}_p USING (doc_id) GROUP BY term_id"),
                name: ("SELECT term_id, " + ", ".join(
                    f"{_F0} * ({_F0} + 1) * (e{j} - s2 * c{j}) / n - {_F0} * {_F0} * m1 * h{j} AS c{j}" for j in (0, 1))
                    + f" FROM {name}_e JOIN mean USING (term_id) JOIN {mat} USING (term_id), {name}_h, size")}

    h = f"({_F0} / ({_F0} + 2))"
    return {
        "size": "SELECT count(*)::DOUBLE AS n FROM lengths WHERE len >= 3",
        "rows": ("SELECT doc_id, term_id, cnt, len, 1 / (len * (len - 1)) AS w2, 1 / (len * (len - 1) * (len - 2)) AS w3"
                 " FROM docs JOIN lengths USING (doc_id) WHERE len >= 3"),
        "mean": ("SELECT term_id, sum(cnt / len) / any_value(n) AS m1, sum(cnt * w2) AS s2, sum(cnt * w3) AS s1"
                 " FROM rows, size GROUP BY term_id"),
        "start": "SELECT term_id, " + ", ".join(f"{_gaussian(0, 'term_id', j)} AS c{j}" for j in (0, 1)) + " FROM mean",
        **image("start", "image_1"),
        **_two_orthonormal("term_id", "image_1", "basis_1"),
        **image("basis_1", "image_2"),
        **_two_orthonormal("term_id", "image_2", "basis_2"),
        **image("basis_2", "image_3"),
        **_two_orthonormal("term_id", "image_3", "basis"),
        **image("basis", "image_4"),
        "small": "SELECT sum(c0 * c0) AS a, sum(c0 * c1) AS b, sum(c1 * c1) AS c FROM image_4",
        "root": "SELECT a, b, (a + c) / 2 + sqrt(power((a - c) / 2, 2) + b * b) AS square FROM small",
        "eigen": ("SELECT term_id, (b * c0 + (square - a) * c1) / sqrt(b * b + power(square - a, 2)) AS u,"
                  " sqrt(square) AS s FROM basis, root"),
        "white": "SELECT term_id, u / (sqrt(s) + 1e-9) AS w FROM eigen",
        "mean_w": "SELECT sum(m1 * w) AS q FROM mean JOIN white USING (term_id)",
        "doc_p": ("SELECT doc_id, any_value(w2) AS w2, any_value(w3) AS w3, sum(cnt * w) AS p FROM rows JOIN white"
                  " USING (term_id) GROUP BY doc_id"),
        "term_z": "SELECT a.term_id, sum(a.w3 * cnt * p) AS z FROM rows a JOIN doc_p USING (doc_id) GROUP BY a.term_id",
        "part_1": f"SELECT sum(w3 * p * p * p - w2 * {h} * 3 * p * p * q) AS v FROM doc_p, mean_w",
        "part_2": (f"SELECT sum(3 * w * w * ({h} * s2 * q - z) + 2 * s1 * w * w * w) AS v FROM white JOIN mean"
                   " USING (term_id) JOIN term_z USING (term_id), mean_w"),
        "third": (f"SELECT ((part_1.v + part_2.v) / n + 2 * {_F0} * {_F0} / (({_F0} + 1) * ({_F0} + 2)) * q * q * q)"
                  f" * {_F0} * ({_F0} + 1) * ({_F0} + 2) / 2 AS t FROM part_1, part_2, size, mean_w"),
        "entry_v": ("SELECT term_id, coalesce(u, 0) * (SELECT any_value(sqrt(s)) FROM eigen) * (SELECT t FROM third) AS v"
                    " FROM term_ids LEFT JOIN eigen USING (term_id)"),
        "signed": ("SELECT 0 AS vec_id, term_id AS row, v FROM entry_v UNION ALL SELECT 1, term_id, -v FROM entry_v"),
        "vectors": "SELECT vec_id, row, v - min(v) OVER (PARTITION BY vec_id) AS v FROM signed", **_SIMPLEX,
        "chosen": "SELECT vec_id FROM theta ORDER BY theta, vec_id DESC LIMIT 1",
    }


_LINE_VECTOR = f"SELECT {_FLAG} AS comp, l_linenumber AS idx, avg({{m}}) AS v FROM lineitem GROUP BY 1, 2"

_IDENTITY = ("SELECT i, j, CASE WHEN i = j THEN 1.0 ELSE 0.0 END::DOUBLE AS dot, CASE WHEN i = j THEN 1.0 ELSE 0.0 END::DOUBLE AS image_dot{more} FROM"
             f" (SELECT CAST(range AS INTEGER) AS i FROM range({q.FIT_TOPICS})), (SELECT CAST(range AS INTEGER) AS j FROM range({q.FIT_TOPICS}))")


def _held_out_tokens(lengths: str, reps: list[int]) -> str:
    """The tokens of the documents that each repetition holds out, for both methods."""
    return " UNION ALL ".join(
        f"SELECT {rep} AS rep, method, (SELECT sum(len) FROM {lengths} WHERE {_uniform(0, rep, 'doc_id')} < 0.1::DOUBLE) AS tokens, true AS sound"
        " FROM (SELECT unnest(['moments', 'online variational']) AS method)" for rep in reps)


def _gamma_starts() -> str:
    """By attempts in a table: the first that is not rejected counts."""
    out = []
    for k, shape in enumerate(q.SHAPES):
        d = (shape if shape > 1 else shape + 1) - 1 / 3
        at = (5, "o_orderkey", k, "attempt")
        u = _uniform(*at, "'u'")
        x = f"sqrt(-2 * ln({_uniform(*at, "'x'", 0)})) * cos(2 * pi() * {_uniform(*at, "'x'", 1)})"
        power = "1.0::DOUBLE" if shape > 1 else f"power({_uniform(5, 'o_orderkey', k, chr(39) + 'power' + chr(39))}, {1 / shape!r}::DOUBLE)"
        out.append(f"(SELECT o_orderkey, {r(f'arg_min(v, attempt) * {d!r}::DOUBLE * {power} / {shape!r}::DOUBLE')} AS g{k} FROM (SELECT o_orderkey, attempt, x, u,"
                   f" power(1.0::DOUBLE + {1 / (9 * d) ** 0.5!r}::DOUBLE * x, 3) AS v FROM (SELECT o_orderkey, attempt, {x} AS x, {u} AS u FROM orders, range(16) t(attempt)))"
                   f" WHERE v > 0 AND ln(u) < 0.5 * x * x + {d!r}::DOUBLE * (1.0 - v + ln(greatest(v, 1e-300))) GROUP BY o_orderkey)")
    return f"SELECT o_orderkey, g0, g1 FROM {out[0]} JOIN {out[1]} USING (o_orderkey)"


ORACLES: dict[str, str] = {
    "read_text_corpus": statement(_COUNTS.format(words="all_words")),
    "compact_small_files": "SELECT CAST(sum(length(text) + 1) AS BIGINT) AS n_chars, true AS dense_ids FROM documents",
    "write_docs": statement("SELECT * FROM docs"),
    "read_docs": statement("SELECT * FROM o_docs"),
    "read_docs_several": """
WITH orders_seen AS (SELECT l_orderkey, row_number() OVER (ORDER BY l_orderkey) - 1 AS place, count(*) OVER () AS n
                     FROM (SELECT DISTINCT l_orderkey FROM lineitem)),
saved AS (SELECT 0 AS input, l_orderkey, l_suppkey AS term, l_quantity FROM lineitem
          UNION ALL SELECT 1, l_orderkey, l_partkey, l_quantity FROM lineitem)
SELECT place + input * n AS doc_id, CAST(term AS INTEGER) AS term_id, sum(l_quantity) AS cnt, 2 * any_value(n) AS n_docs
FROM saved JOIN orders_seen USING (l_orderkey) GROUP BY input, place, n, term""",
    "read_libsvm": statement("SELECT * FROM docs"),
    "read_libsvm_class_labels": statement(
        "SELECT label, coalesce(sum(cnt), 0) AS len, count(term_id) AS n_terms, (SELECT count(*) FROM labelled) AS n_docs"
        " FROM labelled LEFT JOIN docs USING (doc_id) GROUP BY doc_id, label",
        {"labelled": "SELECT doc_id, max(quality) AS label FROM labels GROUP BY doc_id"}),
    "read_text_repeated_path": statement("SELECT term, 2 * n AS n, true AS numbered FROM all_counts"),
    "idf_after_round_trip": statement(
        f"SELECT term_id, {r('n::DOUBLE / df')} AS idf FROM (SELECT term_id, count(*) AS df FROM few_docs GROUP BY term_id), total_docs"),
    "read_dok": statement("SELECT * FROM o_docs"),
    "read_stopwords": r"SELECT DISTINCT term FROM (SELECT unnest(regexp_split_to_array(text, '\s+')) AS term FROM benchmark) WHERE term <> ''",
    "write_model": statement(f"SELECT topic, term_id, {r('p', 10)} AS p FROM lang_model"),
    "topic_matrix": statement("SELECT term_id, " + ", ".join(
        f"{r(f'coalesce(sum(CASE WHEN topic = {k} THEN p END), 0)', 10)} AS topic_{k}" for k in _TOPICS)
        + " FROM lang_model GROUP BY term_id"),
    "rescaled_alpha": statement(f"SELECT topic, {r('alpha / sum(alpha) OVER () * 5.0')} AS alpha FROM lang_alpha"),
    "assign_doc_ids": "SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) - 1 AS doc_id FROM conversations",
    "tokenize": statement("SELECT * FROM all_words"),
    "remove_stopwords": statement("SELECT * FROM said WHERE term NOT IN (SELECT term FROM stop)"),
    "remove_long_stopword_list": statement("SELECT * FROM said WHERE term NOT IN (SELECT term FROM listed)"),
    "word_count": statement("SELECT * FROM counts"),
    "vocab_topk": statement("SELECT * FROM top_vocab"),
    "vocab_all": statement(_vocab("counts", -1)),
    "vocab_stats": statement("SELECT (SELECT count(*) FROM counts) AS full_vocab_size, count(*) AS vocab_size,"
                             " CAST(sum(n) AS BIGINT) AS selected_tokens FROM top_vocab"),
    "doc_term": statement("SELECT * FROM top_docs"),
    "doc_length": statement("SELECT * FROM lengths"),
    "min_words_filter": statement(f"SELECT docs.* FROM docs JOIN lengths USING (doc_id) WHERE len >= {q.MIN_WORDS}"),
    "valid_docs": statement("SELECT doc_id, term_id, cnt, len FROM docs JOIN lengths USING (doc_id) WHERE len >= 3"),
    "term_distribution": statement(f"SELECT doc_id, term_id, {r('cnt / len', 10)} AS share FROM docs JOIN lengths USING (doc_id)"),
    "token_total": statement("SELECT sum(cnt) AS tokens FROM docs"),
    "corpus_summary": statement("SELECT count(*) AS n_docs, count(*) FILTER (len >= 3) AS n_valid_docs, sum(len) AS n_tokens,"
                                " (SELECT count(DISTINCT term_id) FROM docs) AS n_terms FROM lengths"),
    "to_features": statement("SELECT doc_id, CAST(any_value(v) AS INTEGER) AS size, sum(cnt) AS total, sum(cnt * (term_id + 1)) AS weighted"
                             " FROM docs, term_count GROUP BY doc_id"),
    "doc_freq": statement("SELECT * FROM freq"),
    "idf": statement(f"SELECT term_id, {r('n::DOUBLE / df')} AS idf FROM term_ids JOIN freq USING (term_id), total_docs"),
    "low_idf_terms": statement(f"SELECT term_id, {r('idf')} AS idf FROM all_idf WHERE idf <= {q.IDF_BOUND} - 1e-12"),
    "filter_idf": statement(f"SELECT doc_id, term_id, CASE WHEN idf < {q.IDF_BOUND} THEN 0 ELSE cnt END AS cnt"
                            " FROM all_docs JOIN all_idf USING (term_id)"),
    "m1": statement(f"SELECT term_id, {r('coalesce(m1, 0)', 10)} AS m1 FROM term_ids LEFT JOIN m1 USING (term_id)"),
    "m2_exact": statement(
        f"SELECT i, count(*) AS n_cells, {r('sum(v)', 10)} AS total, {r('sum(v * v)', 12)} AS squares, {r('sum(v * (j % 101 + 1))', 8)} AS by_column"
        f" FROM (SELECT i, j, {_A0} * ({_A0} + 1) * v / n AS v FROM summed, size) GROUP BY i",
        {"size": "SELECT count(*)::DOUBLE AS n FROM lengths WHERE len >= 3",
         "rows": "SELECT doc_id, term_id, cnt, len FROM docs JOIN lengths USING (doc_id) WHERE len >= 3",
         "summed": ("SELECT a.term_id AS i, b.term_id AS j, sum((a.cnt * b.cnt - CASE WHEN a.term_id = b.term_id THEN a.cnt"
                    " ELSE 0 END) / (a.len * (a.len - 1))) AS v FROM rows a JOIN rows b USING (doc_id)"
                    " WHERE a.term_id <= b.term_id GROUP BY 1, 2 HAVING v <> 0")}),
    "m2_exact_orders": statement(f"SELECT i, j, {r('v', 10)} AS v FROM summed", {
        "summed": ("SELECT a.term_id AS i, b.term_id AS j, sum((a.cnt * b.cnt - CASE WHEN a.term_id = b.term_id THEN a.cnt ELSE 0 END) * a.w2) AS v"
                   " FROM o_rows a JOIN o_rows b USING (doc_id) WHERE a.term_id <= b.term_id GROUP BY 1, 2 HAVING v <> 0")}),
    "m2_project": statement("SELECT * FROM result", {"size": "SELECT n FROM o_n", **_shifted_m2("o_rows", "o_m1", "o_mat", "n_docs")}),
    "m2_project_by_term": statement("SELECT * FROM result", {"size": "SELECT n FROM o_n", **_shifted_m2("o_rows", "o_m1", "o_mat", "n_docs")}),
    "m2_project_masked": statement("SELECT * FROM result", {
        "len_a": "SELECT doc_id, sum(cnt) AS len FROM all_docs GROUP BY doc_id HAVING sum(cnt) >= 3",
        "size": "SELECT count(*)::DOUBLE AS n FROM len_a",
        "open_terms": f"SELECT term_id FROM all_idf WHERE NOT idf <= {q.IDF_BOUND} - 1e-12",
        "rows": ("SELECT doc_id, term_id, cnt, len, 1 / (len * (len - 1)) AS w2 FROM all_docs JOIN len_a USING (doc_id)"
                 " JOIN open_terms USING (term_id)"),
        "mean": "SELECT term_id, sum(cnt / len) / any_value(n) AS m1 FROM rows, size GROUP BY term_id",
        "mat": f"SELECT term_id, {_rule('term_id')} FROM open_terms",
        "s2": "SELECT term_id, sum(cnt * w2) AS s2 FROM rows GROUP BY term_id",
        "p": ("SELECT doc_id, " + ", ".join(f"sum(cnt * c{j}) AS p{j}" for j in _R) + " FROM rows JOIN mat USING (term_id) GROUP BY doc_id"),
        "image": ("SELECT term_id AS t, " + ", ".join(f"any_value(z{j}) - any_value(s2 * c{j}) AS e{j}" for j in _R)
                  + " FROM (SELECT term_id, " + ", ".join(f"sum(w2 * cnt * p{j}) AS z{j}" for j in _R)
                  + " FROM rows JOIN p USING (doc_id) GROUP BY term_id) JOIN s2 USING (term_id) JOIN mat USING (term_id) GROUP BY term_id"),
        **{k: v for k, v in _shifted_m2("rows", "mean", "mat", "n_docs").items() if k in ("shift", "result")}}),
    "m3_wide": statement(
        "SELECT CAST(t.i AS INTEGER) AS i, CAST(t.j AS INTEGER) AS j, CAST(t.l AS INTEGER) AS l, "
        + r(f"((wide_1.v + wide_2.v) / n + 2 * {_A0} * {_A0} / (({_A0} + 1) * ({_A0} + 2)) * qi.q * qj.q * ql.q) * {_A0} * ({_A0} + 1) * ({_A0} + 2) / 2", 9)
        + " AS v FROM wide_t t JOIN wide_1 USING (i, j, l) JOIN wide_2 USING (i, j, l) JOIN wide_q qi ON qi.j = t.i JOIN wide_q qj ON qj.j = t.j"
          " JOIN wide_q ql ON ql.j = t.l, o_n", _wide_third()),
    "orthonormalize_steep": (f"SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CASE WHEN i = j THEN 1.0 ELSE 0.0 END::DOUBLE AS v"
                             f" FROM range({q.WIDE}) a(i), range({q.WIDE}) b(j)"),
    "whitening_matrix": statement("SELECT term_id, " + ", ".join(
        f"{r(f'c{j} / (sqrt({q.SIGMA[j]}::DOUBLE) + 1e-9)', 10)} AS c{j}" for j in _R) + " FROM o_mat"),
    "whiten_docs": statement("SELECT doc_id, len, " + ", ".join(f"{r(f'p{j}')} AS p{j}" for j in _R) + " FROM o_p"),
    "whiten_first_moment": statement(" UNION ALL ".join(f"SELECT {j} AS j, {r(f'q{j}', 10)} AS q FROM o_q" for j in _R)),
    "m3_first": statement(_by_triple(_first, _FIRST_FROM)),
    "m3_second": statement(_by_triple(_second, "x, o_n"), _SECOND_PARTS),
    "m3_third": statement(_by_triple(_third, _THIRD_FROM)),
    "m3_whitened": statement(_by_triple(
        lambda i, j, l: (f"((SELECT {_first(i, j, l)} FROM {_FIRST_FROM}) + (SELECT {_second(i, j, l)} FROM x, o_n)"
                         f" + (SELECT {_third(i, j, l)} FROM {_THIRD_FROM})"
                         f" + 2 * {_A0} * {_A0} / (({_A0} + 1) * ({_A0} + 2)) * q{i} * q{j} * q{l})"
                         f" * {_A0} * ({_A0} + 1) * ({_A0} + 2) / 2"), "o_q"), _SECOND_PARTS),
    "gaussian_matrix": statement("SELECT term_id, " + ", ".join(f"{r(_gaussian(7, 'term_id', j))} AS c{j}" for j in _R)
                                 + " FROM vocab"),
    "gram": statement(f"SELECT a.col AS i, b.col AS j, {r('sum(a.v * b.v)')} AS v FROM entries a JOIN entries b USING (row)"
                      " GROUP BY a.col, b.col"),
    "gram_tall": statement(" UNION ALL ".join(
        f"SELECT {i} AS i, {j} AS j, {r(f'sum(c{i} * c{j}) / 1e9')} AS v FROM b_0" for i in _R for j in _R),
        {"b_0": _orthonormal()["b_0"]}),
    "orthonormalize": statement("SELECT l_orderkey, " + ", ".join(f"{r(f'c{j}', 10)} AS c{j}" for j in _R) + " FROM basis",
                                _orthonormal()),
    "normalize_columns": statement(f"SELECT row, col, {r('v / norm')} AS v FROM entries JOIN norms USING (col)"),
    "frobenius_norm": statement(f"SELECT {r('sqrt(sum(v * v))')} AS norm FROM entries"),
    "condition_number": (f"SELECT {r('max(v) / min(v)')} AS condition FROM"
                         " (SELECT sum(l_extendedprice) AS v FROM lineitem GROUP BY l_suppkey)"),
    "column_dots": statement(
        f"SELECT col, {r('dot')} AS dot, dot > 1 - 0.3::DOUBLE AS converged FROM (SELECT col,"
        " sum(v * (v + abs(v))) / sqrt(sum(v * v)) / sqrt(sum((v + abs(v)) * (v + abs(v)))) AS dot FROM entries GROUP BY col)"),
    "rank_one_tensor": statement(
        f"SELECT comp, x.idx AS i, y.idx AS j, z.idx AS l, {r('x.v * y.v * z.v')} AS v FROM x JOIN y USING (comp) JOIN z USING (comp)",
        {n: _LINE_VECTOR.format(m=m) for n, m in (("x", "l_quantity"), ("y", "l_discount"), ("z", "l_tax"))}),
    "unfold_tensor": statement(f"SELECT i AS row, l * 12 + j AS col, {r('v')} AS v FROM cells"),
    "fold_tensor": statement(f"SELECT i, j, l, {r('v')} AS v FROM cells"),
    "khatri_rao": statement(
        f"SELECT a.row * 12 + b.row AS row, col, {r('a.v * b.v')} AS v FROM a JOIN b USING (col)",
        {"a": f"SELECT l_linenumber - 1 AS row, {_FLAG} AS col, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2",
         "b": (f"SELECT CAST(month(l_shipdate) - 1 AS INTEGER) AS row, {_FLAG} AS col, avg(l_discount) AS v"
               " FROM lineitem GROUP BY 1, 2")}),
    "mttkrp": statement("SELECT i AS row, " + ", ".join(f"{r(f'sum(v * b.c{c} * d.c{c})')} AS c{c}" for c in _R)
                        + " FROM cells JOIN factor_j b USING (j) JOIN factor_l d USING (l) GROUP BY i"),
    "cp_loss": statement(
        f"SELECT {r(f'sqrt(sum(power(coalesce(v, 0) - ({_MODEL}), 2)))')} AS loss FROM factor_i a CROSS JOIN factor_j b"
        " CROSS JOIN factor_l d LEFT JOIN cells ON cells.i = a.i AND cells.j = b.j AND cells.l = d.l"),
    "cp_als": statement(f"SELECT i AS row, {r('c0', 6)} AS c0, {r('c1', 6)} AS c1, {r('n0', 6)} AS weight_0,"
                        f" {r('n1', 6)} AS weight_1, {r('loss', 5)} AS loss FROM found JOIN best USING (start)", _als()),
    "topk_eigen_one": statement(
        f"SELECT term_id, {r('u * sign(sum(u) OVER ())')} AS weight, {r('s', 10)} AS eigenvalue FROM eigen", _one_topic()),
    "fit_one_topic": statement(
        f"SELECT row AS term_id, {r('greatest(v - theta, 0)')} AS p, {r('(SELECT power(t, -2) FROM third)', 6)} AS alpha"
        " FROM vectors JOIN chosen USING (vec_id) JOIN theta USING (vec_id)", _one_topic()),
    "simplex_project": _PROJECT,
    "simplex_project_long": _PROJECT,
    "simplex_project_signed": _PROJECT_SIGNED,
    "unwhiten": statement("SELECT term_id, " + ", ".join(f"{r(_unwhitened(j), 10)} AS c{j}" for j in _R) + " FROM o_mat"),
    "order_topics": statement(f"SELECT topic, {r('alpha')} AS alpha,"
                              " CAST(row_number() OVER (ORDER BY alpha DESC, topic) - 1 AS INTEGER) AS place FROM lang_alpha"),
    "smooth_beta": statement(f"SELECT topic, term_id, {r('p', 12)} AS p FROM smoothed"),
    "validate_model": statement(f"SELECT topic, {r('sum(p)')} AS total, bool_and(p > -1e-12) AS all_admissible,"
                                " bool_or(p > 0 AND ln(p) > -20) AS any_scored, abs(sum(p) - 1) <= 1e-10 AS sums_to_one"
                                " FROM lang_model GROUP BY topic"),
    "augment_topics": statement(
        f"SELECT topic, term_id, {r('p', 12)} AS p FROM (SELECT topic, term_id, p FROM lang_model UNION ALL"
        " SELECT 4, term_id, share / sum(share) OVER () FROM (SELECT term_id,"
        " coalesce(m1, 0) + 0.1::DOUBLE / v AS share FROM term_ids LEFT JOIN m1 USING (term_id), term_count))"),
    "infer_topics": statement(" UNION ALL ".join(
        f"SELECT doc_id, {k} AS topic, {r(f'g{k}', 6)} AS gamma FROM last" for k in _TOPICS), _inference()),
    "doc_bounds": statement(f"SELECT doc_id, {r('bound', 5)} AS bound, skipped FROM bounds", _bounds()),
    "log_likelihood": statement(f"SELECT {r('sum(bound)', 3)} AS log_likelihood, sum(skipped) AS skipped_tokens,"
                                " (SELECT sum(cnt) FROM docs) AS tokens FROM bounds", _bounds()),
    "multinomial_loglik": statement(
        f"SELECT doc_id, {r('lgamma(sum(cnt) + 1) + sum(cnt * ln(p) - lgamma(cnt + 1))', 6)} AS log_likelihood"
        " FROM docs JOIN share USING (term_id) GROUP BY doc_id",
        {"share": "SELECT term_id, sum(cnt) / (SELECT sum(cnt) FROM docs) AS p FROM docs GROUP BY term_id"}),
    "log_gamma": f"SELECT o_orderkey, {r('lgamma(o_totalprice / 1000 + 0.25::DOUBLE)', 7)} AS log_gamma FROM orders",
    "dirichlet_expectation": statement(
        f"SELECT vec_id, row, {r(_digamma('a') + ' - ' + _digamma('whole'), 6)} AS v FROM"
        " (SELECT *, sum(a) OVER (PARTITION BY vec_id) AS whole FROM parts)",
        {"parts": "SELECT row AS vec_id, col AS row, abs(v) + 0.05::DOUBLE AS a FROM entries"}),
    "log_sum_exp": statement(
        f"SELECT row AS vec_id, {r('any_value(top) + ln(sum(exp(v * 500 - top)))')} AS v FROM"
        " (SELECT *, max(v * 500) OVER (PARTITION BY row) AS top FROM entries) GROUP BY row"),
    "gamma_starts": _gamma_starts(),
    # what is left of a document's weights beyond its words is the prior
    "infer_topics_shaped": statement(f"SELECT doc_id, {r(f'{sum(q.PRIOR)!r}::DOUBLE', 6)} AS prior FROM lengths"),
    "cp_loss_exact": statement("SELECT count(DISTINCT i) * count(DISTINCT j) * count(DISTINCT l) AS n_cells, true AS exact FROM cells"),
    # eigenpairs and fits start from random numbers; these statements say what must hold of any result
    "topk_eigen_m2": _IDENTITY.format(more=""),
    "topk_eigen_exact": _IDENTITY.format(more=", CASE WHEN i = j THEN 0.0::DOUBLE END AS residual"),
    "fit_moments": statement(f"SELECT i, j, dot, {r('total')} AS first_total, n_terms, true AS third_repeats FROM identity, whole, n_vocab", {
        "identity": f"SELECT i, j, dot FROM ({_IDENTITY.format(more='')})", "whole": "SELECT sum(m1) AS total FROM m1",
        "n_vocab": "SELECT count(*) AS n_terms FROM vocab"}),
    "fit_topics": statement("SELECT CAST(range AS INTEGER) AS topic, n_terms, 1.0::DOUBLE AS total, true AS admissible, true AS falling"
                            f" FROM range({q.FIT_TOPICS}), n_vocab", {"n_vocab": "SELECT count(*) AS n_terms FROM vocab"}),
    "run_metrics": statement(f"SELECT {q.FIT_TOPICS}::BIGINT AS k, (SELECT count(*) FROM lengths) AS n_docs, max(term_id) + 1::BIGINT AS vocab_size, true AS timed FROM docs"),
    "heldout_perplexity": statement(_held_out_tokens("lengths", [0])),
    "cv_log_perplexity": statement(_held_out_tokens("long_enough", [0, 1]), {"long_enough": "SELECT * FROM lengths WHERE len >= 3"}),
    "split_docs": " UNION ALL ".join(
        f"SELECT doc_id, {_uniform(11, rep, 'doc_id')} < 0.1::DOUBLE AS held_out, {rep} AS rep FROM documents" for rep in (0, 1)),
}
