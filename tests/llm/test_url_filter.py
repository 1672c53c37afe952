"""Rules and vocabulary against plain versions."""

import random
import re
import time

from tidemark.llm import url_filter as uf

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def plain_parts(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")


def plain_rule(host, path, rules):
    fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[3:] if fits else None


def plain_hits(text, terms):
    def whole(t, i):
        j = i + len(t)
        return text.startswith(t, i) and (i == 0 or not text[i - 1].isalnum()) and (j == len(text) or not text[j].isalnum())

    return sorted(t for t in terms if any(whole(t, i) for i in range(len(text))))


def judged(spark, urls, rules=RULES, words=uf.VOCABULARY):
    rows = [(i, u, "x", 5) for i, u in enumerate(urls)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, score int")
    return {r["page_id"]: r for r in uf.judged(df, rules, words, "page_id").collect()}


def test_rules_and_terms_equal_plain_ones(spark):
    rnd = random.Random(4)
    hosts = ["example.org", "a.example.org", "notexample.org", "Example.COM", "x.com", "com", "org", "free-bets.net", "cheap.pills.io", "casino-win.com", "casinova.fr", "adult-x.de", "", "bücher.example.org", "example.org:80"]
    tails = ["", "/", "/es/", "/es", "/en/1", "/en/12?q=casino", "/fr/x#casino", "/de/free", "/FREE/pills", "/de/?a=/b", "?x=1", "#top", "/a/xxx.html", "/éxxx", "/cheapcheap/pills"]
    urls = [f"{rnd.choice(['http', 'https', ''])}://{h}{t}" for h in hosts for t in tails] + [None, "", "example.org/es/", "a://b://c/de/", "://", "http:/x.org/"]
    got = judged(spark, urls)
    for i, u in enumerate(urls):
        host, path = plain_parts(u)
        assert (got[i]["host"], got[i]["path"]) == (host, path), u
        terms = plain_hits(uf.low(host + path), uf.VOCABULARY)
        score = sum(uf.VOCABULARY[t] for t in terms)
        rule = plain_rule(host, path, RULES)
        assert (got[i]["rule"], got[i]["verdict"]) == (rule or (None, "block" if score >= 2 else "allow")), u
        assert (got[i]["terms"], got[i]["score"]) == (terms, score), u


def test_many_rules(spark):
    rnd = random.Random(5)
    rules = [(".".join(rnd.choices(["a", "b", "c"], k=rnd.randint(1, 3))), "/" + "".join(rnd.choices("xy", k=rnd.randint(0, 3))), rnd.choice(["allow", "block"])) for _ in range(60)]
    book = uf.Rules(rules)
    for _ in range(500):
        host, path = ".".join(rnd.choices(["a", "b", "c"], k=rnd.randint(1, 5))), "/" + "".join(rnd.choices("xy", k=rnd.randint(0, 5)))
        assert book.fitting(host, path) == plain_rule(host, path, rules)


def test_terms_of_several_words_and_overlaps():
    words = uf.Vocabulary({"free-bets": 2, "bets": 1, "bets-now": 1, "s": 1})
    assert words.hits("free-bets-now") == ["bets", "bets-now", "free-bets"]
    assert words.hits("freebets bets2 2bets") == []
    assert uf.Vocabulary({}).hits("anything") == []


def test_one_strict_or_two_different_soft_terms(spark):
    got = judged(spark, ["http://a.io/free/free", "http://a.io/free/pills", "http://a.io/casino", "http://a.io/news"])
    assert [got[i]["verdict"] for i in range(4)] == ["allow", "block", "block", "allow"]


def test_empty_and_long(spark):
    assert judged(spark, []) == {}
    began = time.time()
    long = ["http://" + "a." * 2_000_000 + "org/x", "http://a.io/" + "free-" * 1_000_000, "casino" * 500_000]
    got = judged(spark, long)
    assert [got[i]["verdict"] for i in range(3)] == ["allow"] * 3 and got[0]["rule"] == "org/"
    assert time.time() - began < 60
