import re

from pyspark.sql import functions as F

from lacuna.llm import queries, urls

SF = "/root/testdata/sf0.001"


def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest)[0]
    path = re.split(r"[?#]", rest[len(host) :])[0]
    return "".join(c.lower() if c.isascii() else c for c in host), path


def rule(host, path):
    best = None
    for r in queries.URL_RULES:
        name, _, prefix = r.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + prefix) and (best is None or len(r) > len(best)):
            best = r
    return best


def test_query_follows_the_rules_and_the_trees(spark):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries.op2_urls(spark, SF).collect()
    assert len(rows) == len(pages)
    seen = set()
    for r in rows:
        assert (r.host, r.path) == parts(pages[r.page_id])
        assert r.rule == rule(r.host, r.path)
        assert r.verdict == (queries.URL_RULES[r.rule] if r.rule else "block" if r.score >= 0.5 else "allow")
        seen.add(r.rule)
    assert len(seen) > 3


def test_the_contract_s_rules():
    contract = "block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/"
    assert queries.URL_RULES == {rule: word for word, rule in (r.split(" ") for r in contract.split(", "))}


def test_odd_urls_and_learning(spark):
    good = [f"https://{w}.example.com/en/{i}" for i, w in enumerate(["thing", "blog.river", "m.stone", "garden"] * 20)]
    bad = [f"http://{w}-{w}.example.org/{i}?a={i}&b=1" for i, w in enumerate(["casino", "pills", "spam", "bets"] * 20)]
    model = urls.fit(spark.createDataFrame([*((u, 0) for u in good), *((u, 1) for u in bad), (None, 1), (good[0], None)], "url string, label int"))
    odd = [None, "", "no scheme", "HTTP://A.Example.COM", "x://y://z/en/", "https://h.example.com?q=1", "http://h#f", "http://\u00c9.Com/EN/", "http://a.com/en/" + "x" * 100_000]
    df = spark.createDataFrame([(i, u, "keep") for i, u in enumerate(odd)] + [(None, good[0], "keep"), (None, bad[0], "keep")], "page_id long, url string, html string")
    rows = urls.judge(df, queries.URL_RULES, model).collect()
    assert [(r.host, r.path) for r in rows] == [parts(u) for u in odd] + [parts(good[0]), parts(bad[0])]
    assert rows[-1].verdict == "block" and rows[-2].rule == "com/en/" and rows[-2].score < 0.5
    assert urls.judge(df.limit(0), {}, model).collect() == []
    clash = urls.judge(df.withColumnsRenamed({"html": "_host", "page_id": "score"}).withColumn("_f_length", F.lit("own")), queries.URL_RULES, model)
    assert clash.columns == ["url", "_host", "_f_length", *urls.RESULTS]
    assert [(r["_host"], r["_f_length"], r.host, r.verdict) for r in clash.collect()] == [("keep", "own", r.host, r.verdict) for r in rows]
    assert urls.fit(urls.label_by_rules(df.limit(0), queries.URL_RULES)).trees is None


def test_hosts_never_seen(spark):
    """Urls that rules decide teach the trees; on hosts never seen they tell allowed urls from blocked ones, which no constant answer does."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    host = urls.host_of(F.col("url"))
    right, of = {"allow": 0, "block": 0}, {"allow": 0, "block": 0}
    for held in range(4):
        fold = F.crc32(host) % 4 == held
        model = urls.fit(urls.label_by_rules(pages.filter(~fold), queries.URL_RULES))
        for r in urls.judge(pages.filter(fold), queries.URL_RULES, model).collect():
            if r.rule:
                truth = queries.URL_RULES[r.rule]
                of[truth] += 1
                right[truth] += (r.score >= 0.5) == (truth == "block")
    assert sum(of.values()) > 700 and of["allow"] > 50
    balanced = (right["allow"] / of["allow"] + right["block"] / of["block"]) / 2
    assert balanced > 0.9, (right, of)


def test_both_verdicts_stand_among_undecided_urls(spark):
    rows = [r for r in queries.op2_urls(spark, "/root/testdata/sf0.1").collect() if r.rule is None]
    allowed = sum(r.verdict == "allow" for r in rows) / len(rows)
    assert 0.02 < allowed < 0.98, allowed


def test_a_given_table_of_labels(spark):
    """Labels that depend on how urls look, few of one kind, and noise: the trees find the rule on urls of their own."""
    from random import Random

    rnd = Random(5)

    def url(i):
        spam = rnd.random() < 0.1
        host = "".join(rnd.choice("abcdefghij0123456789-") for _ in range(24)) if spam else rnd.choice(["river", "stone", "garden", "meadow", "harbour"]) + str(i)
        query = "?" + "&".join(f"p{j}={rnd.randrange(10**6)}" for j in range(5)) if spam else ""
        return f"https://{host}.example/{rnd.choice(['a', 'b', 'c'])}/{i}{query}", int(spam != (rnd.random() < 0.02))

    known, new = [url(i) for i in range(1500)], [url(i) for i in range(1500, 2500)]
    model = urls.fit(spark.createDataFrame(known, "url string, label int"))
    got = {r.url: r.verdict == "block" for r in urls.judge(spark.createDataFrame(new, "url string, label int"), {}, model).collect()}
    rate = [sum(got[u] == bool(y) for u, y in new if y == v) / sum(y == v for _, y in new) for v in (0, 1)]
    assert rate[0] > 0.93 and rate[1] > 0.75, rate


def test_a_url_of_many_rows_is_one_row_of_the_sample(spark):
    """Ties and repeats: equal rows have one verdict and a weight; the bound holds for distinct urls."""
    rows = [("https://hot.example.com/a", 1.0)] * 3000 + [(f"https://h{i}.example.net/{i}", float(i % 2)) for i in range(300)]
    df = spark.createDataFrame(rows, "url string, label double")
    model = urls.fit(df, max_rows=200)
    assert model.trees is not None
    assert len({r.score for r in urls.judge(df.filter("url like '%hot%'"), {}, model).collect()}) == 1
