import hashlib
import random

from weftgraph.llm.warc import LoserTree, archive_round_trip, url_key

SCHEMA = "page_id long, url string, html string, payload_digest string"


def test_round_trip_with_revisits_nulls_and_separators(spark):
    big = "<html>" + "x" * 200 + "\r\n\r\nWARC/1.1\r\n\r\n</html>"
    rows = [(i, f"http://www.site{i % 5}.org/p?{i % 3}", big if i % 3 == 0 else f"<p>é {i}</p>" * (i % 9)) for i in range(60)]
    rows += [(None, "http://a.b/", big), (100, None, None), (101, "http://x.y/\r\nline", ""), (7, "http://dup/", big), (0, rows[0][1], big), (0, rows[0][1], big)]
    got = archive_round_trip(spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)).collect()
    want = []
    for page, _, html in rows:
        data = (html or "").encode()
        first = min(p for p, _, h in rows if h == html and p is not None) if len(data) >= 100 else None
        again = first is not None and page is not None and page > first
        want.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted([tuple(r)[:5] for r in got], key=key) == sorted(want, key=key)
    ordered = sorted(got, key=lambda r: r["cdx_position"])
    assert [r["cdx_position"] for r in ordered] == list(range(len(rows)))
    assert [r["url_key"] for r in ordered] == sorted(r["url_key"] for r in ordered)


def test_empty(spark):
    assert archive_round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_loser_tree():
    rng = random.Random(3)
    for k in range(0, 12):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(20))) for _ in range(k)]
        assert list(LoserTree([iter(r) for r in runs], lambda x: x)) == sorted(x for r in runs for x in r)


def test_url_key():
    assert url_key("https://www.Example.org/A/b?q=1#frag") == "org,example)/a/b?q=1"
    assert url_key("") == ")"
