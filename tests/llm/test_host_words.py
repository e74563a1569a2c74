"""Host parsing, rules, Viterbi splits and verdicts against plain Python."""

from __future__ import annotations

import itertools
import math
import re

import pytest
from pyspark.sql import types as T

from quorate.llm import host_words as hw
from quorate.llm.queries import URL_RULES

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), T.StructField("b", T.StringType()), T.StructField("n", T.StringType())])


def plain_parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return re.sub("[A-Z]", lambda m: m.group().lower(), host), re.match(r"[^?#]*", rest[len(host) :]).group()


def plain_rule(host, path):
    best = None
    for rule, verdict in URL_RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return best or (None, None)


URLS = ["http://A.Example.COM/en/x?y#z", "https://www.example.com/en/", "https://www.example.com/EN/", "com/", "http://com/", "http://example.com", "x://notexample.com/en/1", "https://a.net/es/1", "https://net/fr/", "http://net:80/es/",
        "ftp://u@h.net?x=/es/", "", None, "://", "http://a://b/c", "http://É.Com/ü", "http://m.spamfarm.org/offer/12", "http://farm.org/offer/7", "http://garden.org/news/7", "http://gardenhouse.org/news/9"] + [f"http://house{i}.org/news/{i}" for i in range(40)]
HTML = "<p>the garden house and farm news of the house</p>" * 3


def test_hosts_rules_and_verdicts(spark):
    rows = [(i, u, HTML if i % 2 else None, "x", "y") for i, u in enumerate(URLS)] + [(16, URLS[16], None, "x", "y"), (None, URLS[16], None, None, None)]
    got = hw.judge(spark.createDataFrame(rows, PAGES), URL_RULES).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path = plain_parse(r.url)
        rule, verdict = plain_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule), r.url
        assert r.verdict == (verdict or r.verdict)
    verdicts = {r.url: r.verdict for r in got}
    assert verdicts["http://m.spamfarm.org/offer/12"] == "block"
    # Shares the words of the bad host only.
    assert verdicts["http://farm.org/offer/7"] == "block"
    assert verdicts["http://gardenhouse.org/news/9"] == "allow" and verdicts[None] == "allow"
    assert hw.judge(spark.createDataFrame([], PAGES), URL_RULES).count() == 0


def test_split_is_the_likeliest_of_all(spark):
    counts = {"the": 50, "garden": 9, "house": 12, "ga": 3, "den": 4, "gard": 1, "ho": 2, "use": 6, "a": 20, "n": 5}
    total = sum(counts.values())
    names = ["gardenhouse", "thegarden", "a", "zzz", "houseqx", "antheuse", "hotgarden"]
    model = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    got = {r.name: list(r.words) for r in hw.split_names(spark.createDataFrame([(n,) for n in names], "name string"), model).collect()}

    def score(words):
        return sum(math.log(counts[w] / total) if w in counts else math.log(1 / total) - math.log(10) * (len(w) - 1) for w in words)

    for name in names:
        cuts = itertools.chain.from_iterable(itertools.combinations(range(1, len(name)), k) for k in range(len(name)))
        best = max(score([name[a:b] for a, b in zip((0, *c), (*c, len(name)))]) for c in cuts)
        assert "".join(got[name]) == name and abs(score(got[name]) - best) < 1e-9, name
    assert got["gardenhouse"] == ["garden", "house"]


def test_bayes_against_plain_counts(spark):
    rows = [(i, u, HTML, "x", "y") for i, u in enumerate(URLS)]
    got = {r.url: r.block_score for r in hw.judge(spark.createDataFrame(rows, PAGES), ()).collect()}
    # The odds of two urls of one host differ by their path tokens alone, and digits do not matter.
    assert abs(got["http://house3.org/news/3"] - got["http://house7.org/news/7"]) < 1e-9
    assert got["http://m.spamfarm.org/offer/12"] > 0 > got["http://garden.org/news/7"]
    assert got[None] == 0 and got[""] == 0


def test_word_counts_skip_markup(spark):
    table = spark.createDataFrame([("<p class='q'>The été the&amp;House</p>",), (None,)], "html string")
    assert {r.word: r.n for r in hw.word_counts(table, "html").collect()} == {"the": 2, "house": 1}


def test_bayes_says_what_the_list_does_not(spark, monkeypatch):
    good = [f"http://{a}-{b}.org/news/1" for a in ("garden", "house", "farm", "river") for b in ("times", "post", "club")]
    listed = [f"http://cheap-{w}.{tld}/offer/{i}" for i, w in enumerate(("pills", "poker", "loans", "casino")) for tld in ("org", "net")]
    unlisted = ["http://cheap-deals.org/offer/9", "http://cheapmeds.net/offer/3"]
    rows = [(i, u, "<p>cheap garden house farm river times post club deals meds</p>", "x", "y") for i, u in enumerate(good + listed + unlisted)]
    table = spark.createDataFrame(rows, PAGES)
    verdicts = {r.url: r.verdict for r in hw.judge(table, ()).collect()}
    assert all(verdicts[u] == "block" for u in listed + unlisted) and all(verdicts[u] == "allow" for u in good)
    # Without the list's own odds, the words that listed hosts share with other listed hosts still give them away.
    monkeypatch.setattr(hw, "LISTED_ODDS", 0.0)
    verdicts = {r.url: r.verdict for r in hw.judge(table, ()).collect()}
    assert all(verdicts[u] == "block" for u in listed + unlisted) and all(verdicts[u] == "allow" for u in good)


def test_unknown_words_say_nothing(spark):
    """The given pages: a listed page is blocked, and hardly any other, since their words occur on no listed host."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html")
    rows = hw.judge(pages, ()).collect()
    listed = [r.verdict == "block" for r in rows if any(w in r.host for w in hw.UNWANTED)]
    other = [r.verdict == "block" for r in rows if not any(w in r.host for w in hw.UNWANTED)]
    assert sum(listed) >= 0.8 * len(listed) and sum(other) <= 0.02 * len(other), (sum(listed), len(listed), sum(other), len(other))


def test_long_hosts_and_clashing_columns(spark):
    rows = [(1, "http://" + "garden" * 3000 + ".org/" + "a/" * 20_000, HTML, "x", "y"), (2, "http://house.org/", HTML, "x", "y")]
    got = {r.page_id: r for r in hw.judge(spark.createDataFrame(rows, PAGES), ()).collect()}
    assert len(got[1].host) == 18_004 and len(got[1].path) == 40_001 and got[2].verdict == "allow"
    with pytest.raises(ValueError):
        hw.judge(spark.createDataFrame([("u", "h", 1)], "url string, html string, Verdict int"), ())
