from korpora.llm import url_filters as U


def test_odd_urls(spark):
    urls = ["http://A.Example.NET/en/x?q=1", "http://example.com/de/", "https://x.org/fr/a#b", "http://x.net", "nothing", None, "", "://", "http://net/a", "http://xnet/a", "ftp://h?x=/de/", "http://example.net.com/de/"]
    pages = spark.createDataFrame([(i, u, "<p>", "v") for i, u in enumerate(urls)] + [(None, "http://a.net/", "", "v")], "page_id long, url string, html string, verdict string")
    rows = {r.page_id: tuple(r)[1:] for r in U.judged(pages, [(["h:h", "q:x"], 0.9, 0.1), (["h:x", "p:zz"], 0.9, 0.1)]).collect()}
    assert rows[0] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert rows[1] == ("example.com", "/de/", "example.com/de/", "block")
    assert rows[2] == ("x.org", "/fr/a", "org/fr/", "allow")
    assert rows[3] == ("x.net", "", None, "allow")
    assert all(rows[i] == ("", "", None, "allow") for i in (4, 5, 6, 7))
    assert rows[8] == ("net", "/a", "net/", "block") and rows[9][2:] == (None, "allow")
    assert rows[10] == ("h", "", None, "block") and rows[11][2:] == (None, "allow")
    assert rows[None] == ("a.net", "/", "net/", "block")
    assert U.judged(pages.limit(0), []).count() == 0


def test_mining_finds_a_planted_combination(spark):
    pages = spark.createDataFrame([(i, f"http://h{i % 7}.com/{'bad' if i % 5 == 0 else 'ok'}/{i}?{'ad=1' if i % 2 else 'x=1'}") for i in range(400)], "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if i % 5 == 0 and i % 2 else 1, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    rules = U.mined(pages, labels, min_lift=9)  # the tenth is blocked, so confidence has to reach 0.55 (half way to 1)
    assert ["p:bad", "q:ad"] in [r[0] for r in rules]
    rules = [r for r in rules if r[1] > 0.9]
    bad = {r.page_id for r in U.judged(pages, rules, ()).filter("verdict = 'block'").collect()}
    assert bad == {i for i in range(400) if i % 5 == 0 and i % 2}
    assert U.mined(pages, labels.limit(0)) == []


def test_tokens_of_long_urls_match(spark):
    query = "&".join(f"k{i}=1" for i in range(100))
    pages = spark.createDataFrame([(1, f"http://h/a?{query}"), (2, f"ftp://h/a?{query}")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in U.judged(pages, [(["q:k99", "s:ftp"], 0.9, 0.1)], ()).collect()} == {1: "allow", 2: "block"}


def test_mining_reads_all_tokens_and_repeated_urls(spark):
    """A token behind a hundred others is mined, and a repeated url counts as often as it stands there."""
    letters = "abcdefghij"
    own = lambda i: "&".join(f"k{letters[i]}{x}{y}=1" for x in letters for y in letters)
    pages = [(i, f"http://h{i}/a" + (f"?{own(i)}&zz=1" if i < 5 else "")) for i in range(10)] + [(5, "http://h5/a")] * 4
    labels = spark.createDataFrame([(i, int(i > 1 and i != 5), 0) for i in range(10)], "doc_id long, quality int, toxic int")
    rules = {tuple(r[0]): r[1:] for r in U.mined(spark.createDataFrame(pages, "page_id long, url string"), labels, min_lift=0.5, min_count=2, max_tokens=1)}
    assert rules[("q:zz",)] == (2 / 5, 2 / 14) and ("q:kaaa",) not in rules and rules[("p:a",)] == (7 / 14, 7 / 14)


def test_rules_fire_on_the_labels(spark):
    for sf, least in (("sf0.01", 0), ("sf0.1", 1)):
        pages, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("pages", "labels"))
        rules = U.mined(pages, labels)
        assert rules and U.judged(pages, rules).filter("rule IS NULL AND verdict = 'block'").count() >= least
