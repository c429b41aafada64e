import math
import random

import numpy as np

from topicmoments.llm import language as L

RNG = random.Random(8)
PARTS = {"de": ("sch", "ung", "ein", "ver", "ich", "keit"), "en": ("the", "ing", "and", "tion", "er", "wh"), "fr": ("eau", "que", "ent", "oi", "les", "é")}


def text(lang, n):
    return " ".join("".join(RNG.choice(PARTS[lang]) for _ in range(RNG.randrange(1, 4))) for _ in range(n))


def tables(spark):
    train = [(lang, text(lang, 200)) for lang in PARTS for _ in range(12)] + [(None, "x"), ("", "y"), (" DE ", None)]
    docs = spark.createDataFrame([(i, t, lang, "a", "b") for i, (lang, t) in enumerate(train)], "doc_id long, text string, lang string, r0 string, declared string")
    rows = []
    for i in range(150):
        lang = ("de", "en", "fr")[i % 3]
        said = lang if i % 4 else RNG.choice(("de", "en", "fr"))
        rows.append((i, f"http://{lang}{i % 2}.site{i % 5}.{'com' if i % 2 else lang}/p", f'<html lang="{said}-XX"><script>{text("en", 30)}</script><p>{text(lang, RNG.randrange(0, 12))}</p></html>', lang))
    rows += [(200, None, None, None), (201, "http://de0.site0.de/x", "", None), (202, "http://[bad", f"<p>{text('fr', 30)}", None), (None, "http://en1.site1.com", f"<b>{text('en', 9)}</b>", None),
             (204, "http://en1.site1.com", text("de", 30000), None), rows[0]]
    return docs, train, rows


def slow(train, rows):
    langs = sorted(PARTS)
    counts = np.full((3, L.BUCKETS), L.SMOOTH)
    for lang, t in train:
        if (lang or "").strip().lower() in PARTS and t:
            for b in L.triples(L.small_bytes(t)):
                counts[langs.index(lang.strip().lower()), b] += 1
    table = np.log(counts / counts.sum(axis=1, keepdims=True))
    evidence = [L.text_evidence(L.visible_text(h or ""), table) for _, _, h, _ in rows]
    soft = lambda v: np.exp(v - v.max()) / np.exp(v - v.max()).sum()
    shares = [soft(e) for e in evidence]
    marks = [(L.declared_language(h or ""), L.address(u)) for _, u, h, _ in rows]
    out = []
    for n, (own, (said, (host, domain, suffix))) in enumerate(zip(shares, marks)):
        def group(test):
            members = [s for k, (s, m) in enumerate(zip(shares, marks)) if k != n and test(m)]
            return sum(members, np.zeros(3)), len(members)
        rest, count = group(lambda m: True)
        prior = (rest + 1) / (count + 3)
        for at, value in ((1, domain), (0, host)):
            s, c = group(lambda m: value is not None and m[1][at] == value)
            prior = (s + L.PARENT * prior) / (c + L.PARENT)
        score = evidence[n] + np.log(prior)
        if said is not None:
            score = score + np.log((group(lambda m: m[0] == said)[0] + L.TABLE) / (rest + L.TABLE * 3))
        if suffix is not None:
            score = score + np.log((group(lambda m: m[1][2] == suffix)[0] + L.TABLE) / (rest + L.TABLE * 3))
        out.append(soft(score))
    return langs, out


def test_as_brute_force(spark):
    docs, train, rows = tables(spark)
    pages = spark.createDataFrame([(*r[:3], "x", "y") for r in rows], "page_id long, url string, html string, e0 string, host string")
    got = L.identify_languages(pages, docs).collect()
    langs, want = slow(train, rows)
    assert len(got) == len(rows)
    key = lambda i: (i is None, i or 0)
    for r, (i, p) in zip(sorted(got, key=lambda r: key(r["page_id"])), sorted(((r[0], p) for r, p in zip(rows, want)), key=lambda x: key(x[0]))):
        assert r["page_id"] == i and abs(r["p"] - p.max()) < 1e-4
        if p.max() > 0.6:
            assert r["lang"] == langs[int(p.argmax())]
    right = sum(r["lang"] == rows[r["page_id"]][3] for r in got if r["page_id"] is not None and r["page_id"] < 150)
    assert right >= 0.95 * 150


def test_without_labels_or_pages(spark):
    docs, _, rows = tables(spark)
    pages = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    assert {(r["lang"], r["p"]) for r in L.identify_languages(pages, docs.limit(0)).collect()} == {(None, 0.0)}
    assert L.identify_languages(pages.limit(0), docs).count() == 0


def test_declared_and_address():
    assert L.declared_language("<HTML class=x LANG = 'De-at'>") == "de" and L.declared_language("<p lang=fr>") is None
    assert L.declared_language('<meta http-equiv="Content-Language" content="es">') == "es"
    assert L.address("https://M.Example.co:80/x") == ("m.example.co", "example.co", "co") and L.address("/rel") == (None, None, None)
    assert math.isclose(L.text_evidence("", np.zeros((2, L.BUCKETS))).sum(), 0)
