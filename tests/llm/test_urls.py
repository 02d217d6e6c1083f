import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from bidlake.llm import queries, urls

DATA = "/root/testdata/sf0.01"


def judge(url):
    rest = url[url.find("://") + 3 :] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def check(rows):
    for r in rows:
        host, path, rule, verdict = judge(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule), r
        assert r.verdict == verdict if rule else r.verdict in ("allow", "block"), r


ODD = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.NET/en/", "http://example.net", "http://example.net?x=/en/", "http://a.example.net/en/x", "http://xexample.net/en/", "http://example.com/de/#a?b",
       "http://É.Example.ORG/fr/", "a://b://org/fr/", "http://org/fr", "http://net/", "http://host.net:80/", "http://u@x.org/fr/a?b=c&d#e", "http://x.org/" + "a/" * 40_000, "http://sub.net/\n/en/"]


def test_query_on_whole_pages(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "url")
    got = queries.op13_url_trees(spark, DATA)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"] and got.count() == pages.count()
    rows = got.join(pages, "page_id").collect()
    check(rows)
    assert {r.verdict for r in rows if r.rule is None} == {"allow", "block"}
    assert "Python" not in got._jdf.queryExecution().toString()


def test_edges(spark):
    rows = spark.createDataFrame([(i, u, "mine", 1) for i, u in enumerate(ODD + ODD[:3])], "page_id int, url string, Verdict string, top int")
    out = urls.filter_urls(rows, urls.train(rows, urls.rule_labels(rows), trees=2))
    assert out.columns == ["page_id", "url", "top", "host", "path", "rule", "verdict", "bad"] and out.count() == len(ODD) + 3
    check(out.collect())
    none = rows.limit(0)
    assert urls.filter_urls(none, urls.train(none, urls.rule_labels(none))).count() == 0
    bare = urls.filter_urls(rows, urls.train(rows, urls.rule_labels(none)), ())
    assert {(r.rule, r.verdict, r.bad) for r in bare.collect()} == {(None, "allow", 0.0)}


def test_features_by_hand(spark):
    url = "http://Ab-1.site.co:8080/x/y2/z.html?a=1&b=22#f"
    r = urls._lexical(spark.createDataFrame([(url,)], "url string")).first()
    n = Counter(url)
    entropy = -sum(c / len(url) * math.log(c / len(url)) for c in n.values())
    assert (r.url_length, r.host_length, r.path_length, r.host_depth, r.path_depth, r.parameters, r.hyphens, r.host_digits) == (len(url), 17, 12, 2, 3, 2, 1, 5)
    assert abs(r.entropy - entropy) < 1e-9 and abs(r.digit_ratio - 9 / len(url)) < 1e-9
    assert (r.top, r.suffix, r.site) == ("co", "site.co", "ab-1.site.co")


def test_held_out_urls_with_a_hot_host(spark):
    rng = random.Random(4)
    rows = []
    for i in range(3000):
        bad = rng.random() < 0.4
        host = "hot.example.com" if i % 3 == 0 else f"{'win-bet' if bad else 'news'}{rng.randint(0, 40)}.{rng.choice(['site', 'page'])}.{'biz' if bad and i % 2 else 'com'}"
        path = "/".join(str(rng.randint(10**6, 10**9)) for _ in range(5)) + "?a=1&b=2&c=3" if bad else rng.choice(["about", "story/today", "index"])
        rows.append((f"http://{host}/{path}{i % 7}", int(bad)))
    table = spark.createDataFrame(rows, "url string, label int").withColumn("fold", F.pmod(F.xxhash64("url", F.lit(9)), F.lit(3)))
    model = urls.train(table.where("fold > 0").select("url"), table.where("fold > 0"), presumed=0.0, trees=10)
    held = urls.filter_urls(table.where("fold = 0"), model, ()).select((F.col("verdict") == "block").cast("int").alias("b"), "label").collect()
    assert sum(r.b == r.label for r in held) / len(held) > 0.97
    again = urls.train(table.where("fold > 0").select("url"), table.where("fold > 0").repartition(7), presumed=0.0, trees=10)
    assert model.trees.toDebugString.split("\n")[1:] == again.trees.toDebugString.split("\n")[1:]
