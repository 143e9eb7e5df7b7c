import pytest

from palimpsa.llm import urls


@pytest.fixture(scope="module")
def pages(spark):
    def build(rows):
        full = [(i, u, "h", "w", "v") for i, u in enumerate(rows)]
        return spark.createDataFrame(full, "page_id long, url string, host string, _w0 string, listed string")

    return build


def listing(spark, values):
    return spark.createDataFrame([(v,) for v in values], "listed_url string")


CASES = [
    ("http://A.Example.com/fr/1?x=/en/", "a.example.com", "/fr/1", "com/", "allow"),
    ("https://www.example.com/en/2", "www.example.com", "/en/2", "www.example.com/en/", "allow"),
    ("https://m.example.com/en/2#top", "m.example.com", "/en/2", "example.com/en/", "block"),
    ("http://b.net/es/", "b.net", "/es/", "net/es/", "block"),
    ("http://b.net/es", "b.net", "/es", None, "allow"),
    ("http://net/fr/x", "net", "/fr/x", "net/fr/", "block"),
    ("http://evilnet/fr/x", "evilnet", "/fr/x", None, "allow"),
    ("http://x.com", "x.com", "", None, "allow"),
    ("http://x.com?q=/", "x.com", "", None, "allow"),
    ("no scheme.com/", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("", "", "", None, "allow"),
    ("a://b://c.com/", "b:", "//c.com/", None, "allow"),
    ("http://bad.org/p/", "bad.org", "/p/", None, "block"),
    ("http://www.BAD.org:80/p?z", "www.bad.org:80", "/p", None, "block"),
    ("http://bad.org/q", "bad.org", "/q", None, "allow"),
    ("http://ÄB.org/", "Äb.org", "/", None, "allow"),
]


def test_cases(spark, pages):
    got = urls.judge_urls(pages([c[0] for c in CASES]), listing(spark, ["bad.org/p", "bad.org/p", None]))
    rows = sorted(got.collect(), key=lambda r: r.page_id)
    assert [(r.host, r.path, r.rule, r.verdict) for r in rows] == [c[1:] for c in CASES]


def test_false_positives_go(spark, pages):
    """A filter of one block says yes to almost all; the exact join still decides."""
    names = [f"http://s{i}.org/p{i}" for i in range(400)]
    listed = [f"s{i}.org/p{i}" for i in range(0, 400, 2)]
    got = urls.judge_urls(pages(names), listing(spark, listed), max_blocks=1).collect()
    assert {r.page_id for r in got if r.listed} == set(range(0, 400, 2))
    assert len(got) == 400


def test_filter_keeps_every_listed_url(spark):
    listed = listing(spark, [f"s{i}.org/{i}" for i in range(500)])
    blocks = urls.bloom_blocks(listed, "listed_url", 40).collect()
    assert 0 < len(blocks) <= 40
    set_bits = sum(bin(r[f"_w{i}"] & (2**64 - 1)).count("1") for r in blocks for i in range(urls.WORDS))
    assert set_bits <= 500 * urls.WORDS


def test_empty_tables(spark, pages):
    assert urls.judge_urls(pages([]), listing(spark, [])).collect() == []
    assert [r.verdict for r in urls.judge_urls(pages(["http://a.org/"] * 3), listing(spark, [])).collect()] == ["allow"] * 3
