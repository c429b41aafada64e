import glob
import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from topicmoments.llm.warc import capture_histories, merge_runs, order_of, parse_archive, sorted_runs, write_archives

LONG = "<p>" + "x" * 200 + "</p>"
PAGES = [(0, "http://a.example.com/1", LONG), (1, "http://b.example.com/", LONG), (2, None, None), (3, "http://a.example.com/1", ""), (4, "http://A.example.com/1?q#f", "short"),
         (5, "http://x y\r\nWARC-Type: evil\t\x01", "short"), (6, "::bad::[", "é" * 60 + "\r\n\r\nWARC/1.1\r\n\r\n"), (7, "http://www.c.org", "é" * 60 + "\r\n\r\nWARC/1.1\r\n\r\n"),
         (8, "http://big.org/", "y" * 300000), (9, "http://a.example.com/1", LONG), (9, "http://a.example.com/1", LONG), (None, "http://n.org", LONG), (0, "http://z.org", LONG)]


def test_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "x", "y") for p in PAGES], "page_id long, url string, html string, payload string, captured string")
    write_archives(pages, f"{tmp_path}/a", archive_bytes=2000)
    rows = capture_histories(sorted_runs(spark, f"{tmp_path}/a")).collect()
    assert len(rows) == len(PAGES)
    leaders = {}
    for i, _, html in PAGES:
        if i is not None and len((html or "").encode()) >= 100:
            leaders[html] = min(leaders.get(html, i), i)
    for r in rows:
        html = next(h for i, _, h in PAGES if i == r["page_id"]) or ""
        data = html.encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), hashlib.sha256(data).hexdigest())
        leader = leaders.get(html)
        first = leader is None or leader == r["page_id"]
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first else ("revisit", leader))
    order = [(r["part"], r["place"]) for r in rows]
    assert [tuple(r[:11]) for r in sorted(rows, key=lambda r: order_of(r))] == [tuple(r[:11]) for _, r in sorted(zip(order, rows))]
    # records stand where the index says
    by_file = {f.rsplit("/", 1)[-1]: open(f, "rb").read() for f in glob.glob(f"{tmp_path}/a/part-*")}
    for r in rows:
        [(at, length, fields, _)] = list(parse_archive(by_file[r["archive"]][r["offset"]:r["offset"] + r["length"]]))
        assert at == 0 and length == r["length"] and fields["WARC-Type"] == r["record_type"]


def test_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    write_archives(pages, f"{tmp_path}/e")
    assert capture_histories(sorted_runs(spark, f"{tmp_path}/e")).count() == 0


def test_damage_is_seen():
    good = b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [x[3] for x in parse_archive(good * 2)] == [b"abc", b"abc"]
    for bad in (good[:-1], good + b"x", good.replace(b"3", b"2")):
        with pytest.raises(ValueError):
            list(parse_archive(bad))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 20), max_size=8), max_size=9))
def test_merge(runs):
    entries = [sorted((v, r, n) for n, v in enumerate(run)) for r, run in enumerate(runs)]
    assert list(merge_runs(entries)) == sorted(x for run in entries for x in run)


def test_one_hot_url_is_split(spark):
    from topicmoments.llm.warc import INDEX

    rows = [("com,hot)/", f"2020-01-{random.Random(i).randrange(1, 28):02d}", i, "u", "response", None, 1, "d", f"f{i % 7}", i, 1) for i in range(4000)]
    parts = capture_histories(spark.createDataFrame(rows, INDEX), rows_per_task=100).groupBy("part").count().collect()
    assert len(parts) > 20 and max(p["count"] for p in parts) < 1000
