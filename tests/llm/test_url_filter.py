import brute
from pyspark.sql import functions as F

from chalktally.llm import queries, url_filter

SF = "/root/testdata/sf0.01"


def host_and_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[end:]
    stop = min([path.find(c) for c in "?#" if c in path], default=len(path))
    return brute.lower_ascii(rest[:end]), path[:stop]


def rule(rules, host, path):
    fits = []
    for text, said in rules:
        h, slash, p = text.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            fits.append((-len(text), text, said))
    return min(fits)[1:] if fits else (None, None)


def check(rows, pages):
    want = {}
    for page_id, url in pages:
        host, path = host_and_path(url)
        want[page_id] = (host, path, *rule(queries.URL_RULES, host, path))
    assert len(rows) == len(pages)
    for r in rows:
        host, path, text, said = want[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, text)
        assert r.verdict in (("allow", "block") if said is None else (said,))


def test_query_follows_the_rules(spark):
    pages = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()]
    rows = queries.op5_url_filter(spark, SF).collect()
    check(rows, pages)
    assert sum(r.rule is None for r in rows) > 20


def test_odd_urls(spark):
    urls = [
        None, "", "no scheme", "://", "http://", "http://ORG", "http://org/", "http://x.ORG/A?b=/c#d",
        "http://xorg/", "http://example.org/en/1", "http://a.example.org/en/12", "http://example.org/en/2",
        "http://example.org?x=1", "ftp://com/fr/x", "http://a.com/de/", "http://a.com/es/", "é://ü.COM/fr/ß",
        "http://a\nb.org/c\nd?x", "http://" + "a" * 50_000 + ".com/fr/", "a://b://com/de/",
    ]
    pages = list(enumerate(urls))
    df = spark.createDataFrame([(*p, "x", 1, 1) for p in pages], "page_id long, url string, host string, label int, last int")
    check(url_filter.verdicts(df, queries.URL_RULES).collect(), pages)


def test_trees_learn_from_labelled_urls(spark):
    def urls(start):
        good = [(f"https://news{i}.site.net/story/title", 0) for i in range(start, start + 150)]
        bad = [(f"http://win{i * 7919}.biz/{i * 104729}/{i}?a={i}&b=1&c=2", 1) for i in range(start, start + 150)]
        return good + bad

    labels = spark.createDataFrame(urls(0), "url string, label int")
    fresh = spark.createDataFrame(urls(1000), "url string, label int").withColumn(
        "page_id", F.monotonically_increasing_id()
    )
    got = url_filter.verdicts(fresh, [], labels).join(fresh, "page_id")
    wrong = got.where((F.col("verdict") == "block") != (F.col("label") == 1)).count()
    assert wrong <= 3


def test_without_rules_labels_or_rows(spark):
    df = spark.createDataFrame([(1, "http://a.b/c"), (None, None)], "page_id long, url string")
    assert {r.verdict for r in url_filter.verdicts(df, []).collect()} == {"allow"}
    assert {r.verdict for r in url_filter.verdicts(df, [("b/", "block")]).collect()} == {"block"}
    assert url_filter.verdicts(df.limit(0), queries.URL_RULES).isEmpty()
