"""Main texts: pages of known parts, and the suffix array against plain window counts."""

import random
import time

import numpy as np

from tidemark.llm import main_text as mt


def table(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], "page_id long, url string, html string, host string, shard int")


def found(spark, rows, **sizes):
    return sorted(((r["page_id"], r["text"]) for r in mt.main_texts(table(spark, rows), **sizes).collect()), key=str)


FULL = """<!DOCTYPE html><html><head><title>T</title><style>p{x:1}</style></head><body class="sidebar-off">
<header class="site"><h1>Site</h1></header><nav><ul><li>Home</li></ul></nav><div id="cookie-notice"><p>We use cookies</p></div>
<article><h1>Head &amp; tail</h1><p>One <b>bo</b>ld<br>line &lt;3&#33;</p><!-- no <p>x</p> --><p>two<p>three
 &eacute;</p><div class="ad">Buy</div><form><input value="q">Search</form><script>var t="</p>";</script><ul><li>i<li>j</ul>
<blockquote>said</blockquote><section class="comments"><p>First!</p></section></article>
<aside>More</aside><footer>&copy; us</footer></body></html>"""


def test_parts_of_a_page():
    assert " ".join(t for _, t in mt.settled(FULL)) == "Head & tail One bold line <3! two three é i j said"


def test_headlines_and_nested_regions():
    page = '<main><p>lead</p><article class="comment"><p>mine</p></article><div class="related">x</div></main>'
    assert mt.settled(page) == [(False, "lead")]
    page = '<main><p>crumbs</p><article><div class="article-header"><h1>Head</h1></div><p>Body</p><div class="post-footer">tags</div></article></main>'
    assert mt.settled(page) == [(False, "Head"), (False, "Body")]
    page = '<div class="page-header"><p>Site</p></div><article><header><h1>Head</h1></header><section><div>bare</div></section></article>'
    assert mt.settled(page) == [(False, "Head"), (True, "bare")]


def test_broken_markup():
    assert mt.settled("<article><p>cut &am") == [(False, "cut &am")]
    assert mt.settled('<article><p title="a>b">x</p></artic') == [(False, "x")]
    assert mt.settled("a < b and <3 <!-- open") == [(True, "a < b and <3")]
    assert mt.settled("</div></p>x<script>y") == [(True, "x")]


def test_pages(spark):
    rows = [(1, "http://a.x/1", FULL), (2, None, None), (3, "http://a.x/2", ""), (None, "http://a.x/3", "<main><p>m</p></main>"), (1, "http://a.x/1", FULL)]
    want = "Head & tail One bold line <3! two three é i j said"
    assert found(spark, rows) == sorted([(1, want), (1, want), (2, ""), (3, ""), (None, "m")], key=str)
    assert found(spark, []) == []


def plain_strip(pages, least=3):
    """Tokens of open pages that no window shared by ``least`` pages covers."""
    w = mt.WINDOW

    def windows(stream):
        return [(0, tuple(stream))] if 0 < len(stream) < w else [(i, tuple(stream[i : i + w])) for i in range(len(stream) - w + 1)]

    seen = {}
    for i, blocks in pages.items():
        for b in blocks:
            for _, x in windows(b.split()):
                seen.setdefault(x, set()).add(i)
    out = {}
    for i, blocks in pages.items():
        kept = []
        for b in blocks:
            s = b.split()
            gone = set()
            for at, x in windows(s):
                if len(seen[x]) >= least:
                    gone |= set(range(at, at + w))
            kept.append(" ".join(t for k, t in enumerate(s) if k not in gone))
        out[i] = " ".join(x for x in kept if x)
    return out


def test_repeated_stretches_of_a_host_go(spark):
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(2000)]
    banner, legal = rnd.choices(words, k=20), rnd.choices(words, k=30)
    pages = {}
    for i in range(60):
        own = rnd.choices(words, k=rnd.randint(5, 60))
        blocks = [" ".join(banner), " ".join(own[:20] + legal + own[20:]) if i % 3 else " ".join(own), "Read more"]
        pages[i] = blocks if i % 7 else blocks[:1]
    rows = [(i, "http://user@Host.example:80/p", "".join(f"<div>{b}</div>" for b in bs)) for i, bs in pages.items()]
    want = sorted(plain_strip(pages).items(), key=str)
    assert found(spark, rows) == want
    assert found(spark, rows, shard_pages=9) == want
    assert any(t for _, t in want) and not any("Read more" in t for _, t in want)


def test_other_hosts_do_not_count(spark):
    rows = [(i, f"http://h{i}.example/", "<div>the same nine words stand on all of these pages</div>") for i in range(5)]
    assert {t for _, t in found(spark, rows)} == {"the same nine words stand on all of these pages"}


def test_ranks_are_those_of_substrings():
    rnd = np.random.default_rng(0)
    flat = rnd.integers(0, 3, 200)
    rank = mt.suffix_ranks(flat, 5)
    parts = [tuple(flat[i : i + 5]) for i in range(196)]
    assert [[rank[i] == rank[j] for j in range(196)] for i in range(196)] == [[a == b for b in parts] for a in parts]


def test_names_around_an_article_do_not_remove_it():
    body = "<article><h1>Head</h1><p>Body</p></article>"
    want = [(False, "Head"), (False, "Body")]
    for around in ("<div class='layout no-sidebar'>", "<div id='page-with-menu'>", "<div class='menu'>", "<div class='sidebar'>", "<form id='aspnet'>"):
        assert mt.settled(f"{around}<p>crumbs</p>{body}") == want
    assert mt.settled("<div class='related'><main><p>Body</p></main></div>") == [(False, "Body")]
    assert mt.settled(f"{body}<div class='related'><article><p>teaser</p></article></div>") == want
    assert mt.settled(f"{body}<aside><article><p>teaser</p></article></aside>") == want


def test_headings_figures_and_named_paragraphs_stay():
    page = "<article><h2 id='social-impact'>A</h2><h3 id='related-work'>B</h3><h2 id='search'>C</h2><figure aria-label='Share of votes'><p>D</p></figure>"
    assert mt.settled(page) == [(False, x) for x in "ABCD"]
    page = "<article><p class='notice'>one</p><p>two</p><div class='comment-list'><p>three</p></div><nav aria-label='Breadcrumb'>x</nav></article>"
    assert mt.settled(page) == [(True, "one"), (False, "two")]


def test_copies_and_shared_passages_of_an_article_stay(spark):
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    article, passage, banner = (" ".join(rnd.choices(words, k=k)) for k in (40, 12, 15))
    copies = [(i, f"http://a.x/{i}", f"<div>{article}</div>") for i in range(5)]
    assert {t for _, t in found(spark, copies)} == {article}
    own = {i: " ".join(rnd.choices(words, k=20)) + (f" {passage}" if i < 4 else "") for i in range(10, 30)}
    own |= {i: own[i] + f" {passage}" for i in (10, 11, 12)}
    rows = [(i, "http://b.x/p", f"<div>{banner}</div><div>{t}</div>") for i, t in own.items()]
    for shard_pages in (1000, 6):
        assert found(spark, copies + rows + rows[:4], shard_pages=shard_pages) == sorted([(i, article) for i in range(5)] + list(own.items()) + list(own.items())[:4], key=str)


def test_long_and_broken_markup_takes_linear_time():
    began = time.time()
    body = "<div class='x'>" * 100_000 + "words here </p></b></section>" * 150_000 + "</div>" * 100_000
    assert len(mt.settled(body)) >= 1
    nested = "<nav><div class='sidebar'>" * 60_000 + "<article>a</article><main>b</main>" * 60_000
    assert mt.settled(nested) is not None
    assert len(nested) + len(body) > 9_000_000 and time.time() - began < 120


def test_suffix_array_against_plain_sorting():
    rnd = random.Random(5)
    for n in (0, 1, 2, 40, 300):
        tokens = [rnd.randrange(3) for _ in range(n)]
        order, shared = mt.suffix_array(np.array(tokens, np.int64))
        want = sorted(range(n), key=lambda i: tokens[i:])
        assert order.tolist() == want
        for k in range(1, n):
            a, b = tokens[want[k - 1] :], tokens[want[k] :]
            assert shared[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_windows_cover_what_all_maximal_repeats_cover():
    rnd = random.Random(6)
    line = [f"w{i}" for i in range(30)]
    pages = [[rnd.choice("abcdefgh") for _ in range(20)] + line[: rnd.randrange(8, 30)] + [rnd.choice("abcd")] for _ in range(6)]
    own, where, hashes = mt.windows_of(pages)
    held = {h: set(own[hashes == h].tolist()) for h in set(hashes.tolist())}
    got = {(i, at + k) for i, at, h in zip(own.tolist(), where.tolist(), hashes.tolist()) if len(held[h]) >= 3 for k in range(mt.WINDOW)}
    runs = {}
    for i, p in enumerate(pages):
        for a in range(len(p)):
            for b in range(a + mt.WINDOW, len(p) + 1):
                runs.setdefault(tuple(p[a:b]), set()).add((i, a))
    want = {(i, a + k) for run, at in runs.items() if len({i for i, _ in at}) >= 3 for i, a in at for k in range(len(run))}
    assert got == want and want


def test_texts_that_are_set_aside_are_kept_apart_not_lost():
    main, rest = mt.parted(FULL)
    assert main == mt.settled(FULL) and rest == ["Site", "Home", "We use cookies", "Buy", "Search", "First!", "More", "© us"]
    assert mt.parted("<p>crumbs</p><main><p>lead</p><div>bare</div><nav>n</nav></main>tail") == ([(False, "lead"), (True, "bare")], ["crumbs", "n", "tail"])
    assert mt.parted("<nav>n</nav><nav>n</nav>a") == ([(True, "a")], ["n"]) and mt.parted("<script>x</script>") == ([], [])


def test_open_text_that_other_pages_set_aside_goes(spark):
    """No window of the legal line stands on three pages with open blocks: all pages of the host must enter the array."""
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    legal, title = " ".join(rnd.choices(words, k=14)), " ".join(rnd.choices(words, k=10))
    own = {i: " ".join(rnd.choices(words, k=30)) for i in range(12)}
    rows = [(i, "http://a.x/p", f"<article><p>{t}</p></article><aside>{title}</aside><footer>{legal}</footer>") for i, t in own.items() if i < 8]
    rows += [(i, "http://a.x/p", f"<div>{own[i]}</div><div>{legal}</div>") for i in (8, 9)]
    rows += [(i, "http://a.x/p", f"<div>{title}</div><div>{own[i]}</div>") for i in (10,)]  # lists of other pages quote its headline
    rows += [(i, "http://a.x/p", f"<article><p>{legal}</p><p>{own[i]}</p></article>") for i in (11,)]
    want = own | {10: f"{title} {own[10]}", 11: f"{legal} {own[11]}"}
    for sizes in ({}, {"shard_pages": 3}, {"shard_chars": 200}):
        assert found(spark, rows, **sizes) == sorted(want.items(), key=str)


def plain_main(rows):
    """Main texts by sets of windows of all blocks of a host's different pages but the plain ones of articles."""
    parts = {i: mt.parted(h or "") for i, _, h in rows}
    host = {i: u for i, u, _ in rows}
    key = {i: (host[i], str(main or rest)) for i, (main, rest) in parts.items()}

    def windows(text):
        s = text.split()
        return [(0, tuple(s))] if len(s) < mt.WINDOW else [(k, tuple(s[k : k + mt.WINDOW])) for k in range(len(s) - mt.WINDOW + 1)]

    anywhere, in_open, pages, open_pages = {}, {}, {}, {}
    for i, (main, rest) in parts.items():
        if main or rest:
            pages.setdefault(host[i], set()).add(key[i])
        opened = [t for o, t in main if o]
        if opened:
            open_pages.setdefault(host[i], set()).add(key[i])
        for seen, texts in ((anywhere, opened + rest), (in_open, opened)):
            for t in texts:
                for _, w in windows(t):
                    seen.setdefault((host[i], w), set()).add(key[i])
    out = []
    for i, _, _ in rows:
        h, kept = host[i], []
        for is_open, t in parts[i][0]:
            s = t.split()
            gone = set()
            for k, w in windows(t) if is_open else ():
                n, n_open = len(anywhere[h, w]), len(in_open[h, w])
                if n >= 3 and n >= 0.3 * len(pages[h]) and n_open >= 2 or n_open >= 3 and n_open >= 0.3 * len(open_pages[h]):
                    gone |= set(range(k, k + mt.WINDOW))
            kept.append(" ".join(x for k, x in enumerate(s) if k not in gone))
        out.append((i, " ".join(x for x in kept if x)))
    return sorted(out, key=str)


def test_pages_of_all_kinds_against_plain_windows(spark):
    rnd = random.Random(10)
    words = [f"w{i}" for i in range(500)]
    lines = [" ".join(rnd.choices(words, k=k)) for k in (1, 3, 7, 8, 9, 15, 30, 60)]

    def blocks(tags, n):
        def text():
            line = rnd.choice(lines[rnd.randrange(len(lines)) :]).split()
            cut = line[rnd.randrange(3) :] if len(line) > 12 else line
            return " ".join([*rnd.choices(words, k=rnd.choice((0, 0, 4))), *cut])

        return "".join(f"<{t}>{text()}</{t.split()[0]}>" for t in rnd.choices(tags, k=n))

    rows = []
    for i in range(150):
        aside, inner = blocks(["nav", "footer", "aside", "div class='ad'"], rnd.randrange(4)), blocks(["p", "div"], rnd.randrange(1, 4))
        around = rnd.choice(["{}", "<article>{}</article>", "<main>{}</main>", "<div>{}</div>", ""]).format(inner)
        rows.append((i, f"h{i % 3}", aside + around))
    copies = [(1000 + k, rows[k % 5][1], f"<nav>{blocks(['div'], 1)}</nav>{rows[k % 5][2]}") for k in range(60)]  # of few pages, beside other texts
    rows += [*copies, *((2000 + k, *rows[k][1:]) for k in range(20)), (3000, "h0", None), (3001, "h0", "")]
    want = plain_main(rows)
    texts = {i: " ".join(t for _, t in mt.settled(h or "")) for i, _, h in rows}
    assert 20 < sum(t != texts[i] for i, t in want) < len(rows)
    urls = [(i, f"http://{h}/", page) for i, h, page in rows]
    for sizes in ({}, {"shard_pages": 7}, {"shard_pages": 2, "shard_chars": 300}):
        assert found(spark, urls, **sizes) == want
