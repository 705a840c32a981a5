import datetime as dt
import random

from pyspark.sql import functions as F

from tallyframe.llm import urls


def test_keys(spark):
    row = spark.createDataFrame([("https://u@WWW.a.co.uk.:80/x/y?q",)], "url string").select(urls.keys_of(F.col("url"))).first()[0]
    assert row == ["www.a.co.uk", ".www.a.co.uk", ".a.co.uk", ".co.uk", ".uk", "www.a.co.uk/x"]
    assert spark.createDataFrame([("nonsense",), (None,)], "url string").select(urls.keys_of(F.col("url"))).distinct().collect() == [(None,)]


def test_as_of(spark):
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(n)
    rnd = random.Random(1)
    patterns = ["h0.x.org", ".x.org", "h1.x.org/p", "h2.x.org"]
    entries = [(rnd.choice(patterns), rnd.choice(["add", "remove"]), day(rnd.randrange(60))) for _ in range(40)] + [(None, "add", day(1)), ("h0.x.org", "other", day(2)), ("h0.x.org", "add", None)]
    captures = [(i, f"http://h{rnd.randrange(4)}.{rnd.choice('xy')}.org/{rnd.choice('pq')}", day(rnd.randrange(80))) for i in range(150)] + [(900, None, day(1)), (901, "bad", day(1)), (902, "http://h0.x.org/", None)]
    got = urls.listed(spark.createDataFrame(captures, "id long, url string, fetched date"), spark.createDataFrame(entries, "pattern string, action string, dated date")).collect()

    def active(pattern, at):
        own = [(d, a) for p, a, d in entries if p == pattern and d is not None and a in ("add", "remove") and d <= at]
        return bool(own) and max(own)[1] == "add"

    assert len(got) == len(captures)
    for r in got:
        keys = []
        if r["url"] and "://" in r["url"] and r["fetched"]:
            host, _, rest = r["url"][7:].partition("/")
            labels = host.split(".")
            keys = [host, *("." + ".".join(labels[i:]) for i in range(3)), f"{host}/{rest}"]
        hit = sorted(k for k in keys if active(k, r["fetched"]))
        assert (r["listed"], r["n_entries"], r["pattern"]) == (bool(hit), len(hit), hit[0] if hit else None), r


def test_empty(spark):
    captures, entries = spark.createDataFrame([], "id long, url string, fetched date"), spark.createDataFrame([], "pattern string, action string, dated date")
    assert urls.listed(captures, entries).count() == 0
    assert urls.listed(spark.createDataFrame([(1, "http://a.b/", dt.date(2024, 1, 1))], captures.schema), entries).first()["listed"] is False


def test_clashing_names(spark):
    """Columns of the inputs with the names of the result aren't read."""
    captures = spark.createDataFrame([(1, "http://a.b/c", dt.date(2024, 1, 2), "x", "y", True, "z")], "id long, url string, fetched date, pattern string, host string, listed boolean, key string")
    entries = spark.createDataFrame([(".b", "add", dt.date(2024, 1, 1), 9, "q")], "pattern string, action string, dated date, id long, key string")
    got = urls.listed(captures, entries).collect()
    assert [(r["id"], r["host"], r["listed"], r["pattern"]) for r in got] == [(1, "a.b", True, ".b")]
