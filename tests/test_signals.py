import datetime as dt

from pyspark.sql import functions as F

from gossamer.operators import graph as G
from gossamer.sources import signals as S


def test_jobs_and_feeds(spark, tmp_path):
    (tmp_path / "f.csv").write_text("phish_id,url\n1,http://a.evil.com/x\n2,\n3,http://b.evil.com\n4,http://other.xyz\n")
    (tmp_path / "b.csv").write_text("2,evil.com\n1, good.org \n3,last.de\n")
    jobs = S.phishing_jobs(S.phishing_feed(spark, str(tmp_path / "f.csv")), "phish_id")
    assert sorted((r.url, r.full_domain) for r in jobs.collect()) == [("http://a.evil.com/x", "evil.com"), ("http://other.xyz", "other.xyz")]
    benign = S.benign_list(spark, str(tmp_path / "b.csv"), 2)
    assert [r.url for r in S.benign_jobs(benign, jobs).collect()] == ["https://good.org"]


def test_certificates(spark):
    log = spark.createDataFrame([("a.com", "x.org\n a.com\nwww.a.com\n*.a.com\nb.net", "I2"), ("a.com", "b.net", "I1")], "domain string, name_value string, issuer string")
    r = S.cert_peers(log).first()
    assert (r.shared_domains, r.cert_count, r.issuer) == (["b.net", "x.org"], 2, "I1")
    assert S.subdomains_of(log).first().subdomains == ["www.a.com"]
    dns = spark.createDataFrame([("mail.a.com", True), ("api.a.com", False)], "domain string, resolved boolean")
    assert S.guessed_subdomains(log.select("domain").distinct(), dns).first().subdomains == ["mail.a.com"]
    assert spark.range(1).select(S.clean_name(F.lit("[a.com](http://a.com)")), S.clean_name(F.lit(" b "))).first()[:] == ("a.com", "b")


def test_fallback_and_cache(spark):
    s = "domain string, v int, resolved boolean"
    a, b = spark.createDataFrame([("x", 1, False), ("y", 2, True)], s), spark.createDataFrame([("x", 3, True), ("y", 4, True), ("z", 5, False)], s)
    assert sorted((r.domain, r.v) for r in S.first_resolved("domain", a, b).collect()) == [("x", 3), ("y", 2), ("z", 5)]
    now = dt.datetime(2025, 1, 8)
    cache = spark.createDataFrame([(1, now - dt.timedelta(days=7)), (2, now - dt.timedelta(days=7, seconds=1))], "k int, cached_at timestamp")
    assert [r.k for r in S.cached(cache, F.lit(now)).collect()] == [1]


def test_parsed_answers(spark):
    tls = spark.createDataFrame([("a", {"CN": "c"}, {"CN": "c"}, "Jan  1 00:00:00 2025 GMT", "Mar 31 00:00:00 2025 GMT")], "domain string, issuer map<string,string>, subject map<string,string>, not_before string, not_after string")
    r = S.tls_facts(tls, F.lit("2025-03-01").cast("date")).first()
    assert (r.issuer, r.valid_from, r.validity_days, r.days_until_expiry, r.is_self_signed) == ("c", "2025-01-01", 89, 30, True)
    rdap = spark.createDataFrame([("1.1.1.1", '{"handle":"H","entities":[{"roles":["registrant"],"name":"N"}],"country":"DE"}'), ("2.2.2.2", '{"autnum":"44477","name":"X"}')], "ip string, body string")
    assert [(r.asn, r.as_name) for r in S.rdap_facts(rdap).orderBy("ip").collect()] == [("H", "N"), ("44477", "X")]
    geo = spark.createDataFrame([("1", '{"status":"fail","message":"m"}'), ("2", '{"status":"success","city":"B","lat":1.5}')], "ip string, body string")
    assert [(r.resolved, r.city, r.error) for r in S.geo_facts(geo).orderBy("ip").collect()] == [(False, None, "m"), (True, "B", None)]
    hosts = spark.createDataFrame([("1", "a.com\n\nB b\nc.org"), ("2", "error x"), ("3", "API count exceeded")], "ip string, body string")
    got = S.shared_hosts(hosts)
    assert [r["count"] for r in got.orderBy("ip").collect()] == [3, None, None] and sorted(r.co_host for r in S.co_hosts(got).collect()) == ["a.com", "c.org"]
    hops = spark.createDataFrame([("a", "b"), ("b", "c"), ("q", "q2")], "url string, next string")
    first = sorted(S.redirect_ends(hops).collect())[0]
    assert (first.url, first.final_url, first.chain, first.hop_count, first.resolved) == ("a", "c", ["a", "b", "c"], 2, True)
    loop = {r.url: r for r in S.redirect_ends(spark.createDataFrame([("x", "y"), ("y", "x")], "url string, next string")).collect()}
    assert loop["x"].error == "TooManyRedirects" and loop["x"].final_url is None and loop["x"].hop_count == 8
    asn = spark.createDataFrame([("AS44477",), ("44477",), (" as62212 ",), ("AS9009",), ("AS15169",), (None,)], "asn string")
    assert [(r.tier, r.risk_score) for r in G.asn_reputation(asn).collect()] == [("bulletproof", 3), ("bulletproof", 3), ("threat_actor_linked", 2), ("anonymization", 1), ("unknown", 0), ("unknown", 0)]


def test_icons(spark):
    pages = spark.createDataFrame([("https://x.com/a", '<link rel="icon" href="small.ico"><link rel="mask-icon" href="/m.svg">'), ("https://y.com", "")], "url string, html string")
    res = spark.createDataFrame([("https://x.com/small.ico", 200, b"x" * 15), ("https://x.com/m.svg", 200, b"y" * 16), ("https://y.com/favicon.ico", 200, b"z" * 20)], "url string, status int, content binary")
    assert sorted(r.icon_url for r in S.icons(pages, res).collect()) == ["https://x.com/m.svg", "https://y.com/favicon.ico"]


def test_batch_sinks(spark, tmp_path):
    r = spark.createDataFrame([("u1", 0, "ok", "dns:NXDOMAIN"), ("u2", 0, "error", None), ("u3", 1, "ok", "dns:NoAnswer")], "url string, label int, status string, modules_failed string")
    path = str(tmp_path / "r")
    assert S.append_results(r, path) == S.append_results(r, path) == f"{path}/v1" and S.append_results(r.drop("label"), path) == f"{path}/v2"
    assert spark.read.parquet(f"{path}/v1").count() == 6
    assert [x.usable_for_training for x in S.usable(r).orderBy("url").collect()] == [False, True, True]
    jobs = r.select("url").union(spark.createDataFrame([("u4",)], "url string"))
    assert sorted(x.url for x in S.unfinished(jobs, r).collect()) == ["u2", "u4"] and S.unfinished(jobs, r, False).count() == 1


def test_feeds_zips_and_results(spark, tmp_path):
    import zipfile

    (tmp_path / "f.csv").write_text("id,url\n" + "".join(f"{k},u{k}\n" for k in range(50)) + "51\n52,u52,more\n")
    assert [r.id for r in S.phishing_feed(spark, str(tmp_path / "f.csv"), 3).collect()] == ["0", "1", "2"]
    assert sorted((r.id, r.url) for r in S.phishing_feed(spark, str(tmp_path / "f.csv")).where("id > '5'").collect())[-2:] == [("8", "u8"), ("9", "u9")]
    with zipfile.ZipFile(tmp_path / "top.zip", "w") as z:
        z.writestr("top.csv", "2,b.com\n1, a.com \nno rank\n3,c.com\n")
    assert [(r.rank, r.domain, r.label) for r in S.benign_list(spark, str(tmp_path / "top.zip"), 2).collect()] == [(1, "a.com", 0), (2, "b.com", 0)]
    (tmp_path / "r.csv").write_text("url,label\na,1\nb,x\nc,0,9\n,\n")
    good, bad = S.scanned_results(spark, str(tmp_path / "r.csv"), "url string, label int")
    assert sorted(str(r.url) for r in good.collect()) == ["None", "a"] and sorted(r.line for r in bad.collect()) == ["b,x", "c,0,9"]
    path = S.write_dated(good, str(tmp_path), "list", "2025-01-02")
    assert path.endswith("list_2025-01-02") and spark.read.option("header", True).csv(path).count() == 2


def test_hot_domain_and_empty_tables(spark):
    feed = spark.range(3000).select("id", F.concat(F.lit("http://p"), "id", F.lit(".evil.com/")).alias("url"))
    assert [r.url for r in S.phishing_jobs(feed, "id").collect()] == ["http://p0.evil.com/"]
    assert S.phishing_jobs(feed.where("id < 0"), "id", 5).count() == 0
    assert S.peer_records(S.logged_names(spark.createDataFrame([], "domain string, name_value string, issuer string"))).count() == 0
    assert S.with_public_suffix(feed.where("id < 0"), spark.createDataFrame([("com",)], "rule string")).count() == 0


def test_streams_of_urls(spark, tmp_path):
    """New files of URLs: the first of each registered domain, and suspicious ones by hour."""
    from gossamer.streaming import urls as U

    rows = [(dt.datetime(2025, 1, 1, 0, 5), "http://a.evil.xyz/1"), (dt.datetime(2025, 1, 1, 0, 6), "http://b.evil.xyz/2"), (dt.datetime(2025, 1, 1, 2, 0), "http://good.org")]
    spark.createDataFrame(rows, "ts timestamp, url string").write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("ts timestamp, url string").parquet(str(tmp_path / "in"))

    def drained(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        assert q.awaitTermination(60)
        return spark.table(name)

    assert sorted(r.full_domain for r in drained(U.first_seen(stream()), "first_urls", "append").collect()) == ["evil.xyz", "good.org"]
    assert sorted((r.suffix, r.n, r.n_suspicious) for r in drained(U.signal_counts(stream()), "url_signals", "complete").collect()) == [("org", 1, 0), ("xyz", 2, 2)]
