"""HTML extraction, URL filter, chat formatting."""

import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import chat_format as C
from quarry.llm import html_extract as H
from quarry.llm import url_filter as U
from quarry.llm.registry import ODD_CONVERSATION


def test_leaf_blocks():
    page = "<body><p>a &amp; b<b> c<br>d</b><p>e&nbsp;f<ul><li>x<li><a href='/'>y</a></ul><script>var t='</p>'</script>g<!-- c --> h<style>p{}</style></body> <p>cut &amp<foo"
    blocks = H.leaf_blocks(page)
    assert [b.text for b in blocks] == ["a & b c d", "e f", "x", "y", "g h", "cut &"]
    assert blocks[3].own == "li" and {"ul", "li"} <= blocks[3].tags and blocks[3].link_chars == 1
    assert H.leaf_blocks("") == [] and H.leaf_blocks("1 < 2 <> 3")[0].text == "1 < 2 <> 3" and H.leaf_blocks("<!-- open") == []


def texts_of(page):
    return [b.text for b in H.leaf_blocks(page)]


def test_tags_are_read_as_browsers_read_them():
    assert texts_of("<p data-x=it's>one</p><p>and's two") == ["one", "and's two"]
    assert texts_of('<p title="a"b">x</p><p a = \'>\' b= "<p>" c>y') == ["x", "y"]
    assert texts_of("<p a=b/>x<p/ a=>y<p ==z'>w") == ["x", "y", "w"]
    assert texts_of("a<!-->b<!--->c<!-- <p> --!>d</>e</ x>f<?php <p> ?>g") == ["abcdef ?>g"]
    assert texts_of("<p>a <math><mi>x</mi><mo>+</mo><mn>1</mn></math> b <svg><p>no</svg>c") == ["a x+1 b c"]
    assert texts_of("<div><textarea></div><b>t</textarea>u</div>v<script>if (a</p>b) </script >w") == ["</div><b>t", "u", "vw"]
    assert texts_of("<p>cut <b class='open") == ["cut"]
    assert H.leaf_blocks("<div class=Main-Menu id = 'x' ROLE=\"note\"><p class='side bar'>t")[0].names == {"main", "menu"}


def test_open_elements_against_a_plain_stack():
    """Closing by tables of places equals a search from the innermost element outwards."""
    import random

    r, tags = random.Random(2), ["p", "div", "ul", "li", "td", "tr", "h1", "dd", "dt"]
    for _ in range(200):
        o, plain = H._Open(), []
        for _ in range(60):
            tag, act = r.choice(tags), r.randrange(3)
            if act == 0:
                o.push(tag, frozenset({tag}))
                plain.append(tag)
            elif act == 1:
                o.close(tag)
                plain = plain[: max((i for i, t in enumerate(plain) if t == tag), default=len(plain))]
            else:
                of = frozenset(r.sample(["p", "li", "td", "dd"], 2))
                o.close_within(of)
                for i in range(len(plain) - 1, -1, -1):
                    if plain[i] in of:
                        plain = plain[:i]
                        break
                    if plain[i] in H._CONTAINERS:
                        break
            assert [t for t, _ in o.stack] == plain and o.sets() == (frozenset(plain), frozenset(plain))


def test_deep_pages_take_linear_time():
    import time

    seconds = []
    for n in (10_000, 100_000):
        start = time.perf_counter()
        assert len(H.leaf_blocks("<div><h1>x" * n)) == n
        seconds.append(time.perf_counter() - start)
    assert seconds[1] < 40 * seconds[0] + 1


LONG = "The harbour was quiet that morning, and nobody on the quay could say when the ferry would come. "
#: Pages written by hand in layouts that the labelled pages don't have; lines of the main text are marked with =.
PAGES = [
    f"""<html><body><div class="wrap"><div class="top"><a href=/>Home</a> <a href=/n>News</a> <a href=/s>Sport</a> <a href=/w>Weather</a></div>
    <div class="col1"><h1>=Ferry late again</h1><div>={LONG * 2}</div><div>={LONG}<a href="/old">An older piece</a> has more.</div></div>
    <div class="footer">Copyright 2024 Harbour News</div></div></body></html>""",
    f"""<body><table><tr><td><ul><li><a href=a>One</a><li><a href=b>Two</a><li><a href=c>Three</a></ul></td><td><h2>=Tides</h2><p>={LONG * 3}<p>={LONG * 2}</td></tr></table>
    <div id=footer><p>&copy; 1999</p></div>""",
    f"""<body><header><h1>The Daily Tide</h1><nav><a href=/>Home</a><a href=/b>Blog</a></nav></header><main><section><h2>=A walk</h2><p>={LONG * 2}</p>
    <figure><img src=x><figcaption>=The old pier.</figcaption></figure><p>={LONG}</p></section><section class=comments><h3>Comments</h3><p>{LONG}</p></section></main>""",
    f"""<div><div><p>={LONG * 4}</p><blockquote>={LONG}</blockquote><p>={LONG * 2}</p></div></div><div class="newsletter-signup"><p>Get our letter every week.</p><form><input></form></div>""",
    f"""<body><div role=navigation><ul><li><a href=1>First</a></li><li><a href=2>Second</a></li></ul></div><h1>=Title of it</h1><p>={LONG * 2}</p><p>={LONG * 2}</p>
    <div class="share">Share this on all networks</div><p>={LONG}</p><div class=related-posts><h4>More</h4><ul><li><a href=x>Other one</a></li></ul></div>""",
]


def test_pages_of_other_layouts():
    right = total = 0
    for page in PAGES:
        blocks = H.leaf_blocks(page)
        want = [b.text[0] == "=" for b in blocks]
        clean = H.leaf_blocks(page.replace(">=", ">"))
        got = H.trained().viterbi(H.trained().unary(H.block_features(clean)))
        right, total = right + sum(bool(g) == w for g, w in zip(got, want, strict=True)), total + len(want)
        assert [b.text for b, g in zip(clean, got, strict=True) if g], page[:60]
    assert right / total >= 0.9, (right, total)


def test_crf_gradient_and_viterbi():
    r = np.random.default_rng(0)
    crf = H.LinearChainCrf({}, r.normal(size=(2, 2)))
    for n in (1, 2, 5):
        u = r.normal(size=(n, 2))
        score = lambda ys: sum(u[i, y] for i, y in enumerate(ys)) + sum(crf.step[a, b] for a, b in zip(ys, ys[1:]))  # noqa: B023, E731
        every = [tuple((k >> i) & 1 for i in range(n)) for k in range(2**n)]
        assert tuple(crf.viterbi(u)) == max(every, key=score)
        p, pairs = crf.expected(u)
        z = np.logaddexp.reduce([score(y) for y in every])
        for i in range(n):
            assert np.isclose(p[i, 1], sum(np.exp(score(y) - z) for y in every if y[i]))
        assert np.isclose(pairs.sum(), n - 1)


def test_extract(spark, sf_dir):
    model = H.trained()
    hold = H.labelled_pages(80, seed=99)
    right = [a == b for fs, ys in hold if fs for a, b in zip(model.viterbi(model.unary(fs)), ys, strict=True)]
    assert np.mean(right) > 0.97
    page = "<html><head><title>T</title></head><body><nav><ul><li><a href='/'>home</a></ul></nav><div class='ad'>Buy now.</div><article><h1>Head</h1><p>First  &lt;b&gt;\n text.</p><p>Second.</article><section class='comments'><p>Nice one!</p></section><footer>&copy; x</footer>"
    rows = [(1, "u", page), (2, None, None), (3, "v", ""), (None, "w", "<p>"), (1, "u", page), (5, "z", "<article>" + "<p>long words here.</p>" * 20_000 + "</article>")]
    d = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, text int")
    got = H.extract(d).collect()
    assert [(r.page_id, r.text) for r in got[:5]] == [(1, "Head\n\nFirst <b> text.\n\nSecond."), (2, ""), (3, ""), (None, ""), (1, "Head\n\nFirst <b> text.\n\nSecond.")]
    assert got[5].text.count("\n\n") == 19_999 and all(r.n_chars == len(r.text) for r in got)
    assert H.extract(d.limit(0)).collect() == []
    import html

    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").limit(40).collect():
        article = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", x.replace("<br>", "\n"))).split()) for x in re.split("</?(?:p|h1)>", article)]
        assert H.main_text(r.html, model) == "\n\n".join(p for p in parts if p)


def plain_rule(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = []
    for rule, verdict in U.RULES.items():
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), rule, verdict))
    return host, path, max(fits)[1:] if fits else None


def test_urls(spark, sf_dir):
    urls = ["https://www.Example.COM/en/7x?q=1", "http://a.example.com/en/8", "http://example.net/de/8", "http://x.net/de/", "http://x.net/de", "http://notcom/en/", "http://com/en/", "x", None, "", "://h", "http://a.org/es/1#/de/", "http://H/p?x://y/en/", "http://example.com?/en/", "http://casino-win.example.com/fr/1", "a" * 50_000 + "://b/"]
    urls += [r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    d = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(0, urls[0], "x")], "page_id long, url string, host string")
    got = U.judge(d).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        host, path, rule = plain_rule(urls[r.page_id])
        assert (r.host, r.path) == (host, path) and r.rule == (rule[0] if rule else None) and r.verdict == (rule[1] if rule else "block" if r.score >= 0.5 else "allow"), urls[r.page_id][:80]
    assert got[14].verdict == "block" and U.judge(d.limit(0)).collect() == []


#: Addresses written by hand, not made by the generator.
ORDINARY_URLS = [
    "https://news-and-sport.co.uk/football/2024/may/12/late-goal", "https://stack-overflow-blog.com/2020/01/", "https://www.harbour-museum.org/visit", "https://en.wikipedia.org/wiki/Golomb_coding",
    "https://docs.python.org/3/library/re.html#re.match", "https://www.bbc.co.uk/weather/2643743", "https://arxiv.org/abs/1406.2661", "https://www.nasa.gov/missions", "https://github.com/apache/spark/pull/4021",
    "https://www.spiegel.de/politik/deutschland/", "https://www.lemonde.fr/planete/article/2023/05/01/le-climat", "http://my-garden-blog.net/tomatoes-in-june", "https://cs.stanford.edu/people/", "https://open-data-portal.eu/sets?page=3",
    "https://www.city-library-bremen.de/", "https://smallbakery.com/bread/rye", "https://mountain-weather.ch/today", "https://health-clinic-nord.se/en/4", "https://www.bike-and-train.nl/routes", "https://kitchen-stories.org/p/381",
]
UNWANTED_URLS = [
    "http://best-casino-bonus.top/play?aff=99812&sub=kd83jd9", "http://cheappillsonline.biz/buy", "http://x7f9q2k8zt3m.xyz/a8sd7f6a/q2w", "http://freebets365.win/", "http://hot-girls-cams.com/en/1", "http://payday-loans-fast.info/apply",
    "http://casinojackpot777.com/", "http://buy-viagra-cialis-rx.net/", "http://get-rich-crypto-profit.click/?id=82&clk=a9d8f7g6h5", "http://10.94.23.7/x/qwe", "http://replica-rolex-watches.ru/", "http://seo-backlinks-traffic.com/",
    "http://spam-farm.example.org/de/3", "http://cheap-pills.example.com/fr/8", "http://poker-slots.example.net/es/5", "http://adult-cams-free.tk/", "http://free-followers-likes-hack.com/", "http://q8w7e6r5t4y3u2.top/9d8f7a6s/1",
    "http://roulette-blackjack-betting.net/", "http://cash-fast-earn-money.xyz/?a=1&b=2&c=38d7&d=99f&e=3k3",
]


def test_trees_judge_urls_made_otherwise():
    """Ordinary hosts with hyphens stay, unwanted ones without them go: held-out urls of the generator, and others."""
    held, model = U.labelled_urls(1500, seed=77), U.trained()
    assert np.mean((model.score([u for u, _ in held]) >= 0.5) == np.array([y for _, y in held])) > 0.93
    good, bad = model.score(ORDINARY_URLS), model.score(UNWANTED_URLS)
    assert np.mean(good < 0.5) >= 0.9 and np.mean(bad >= 0.5) >= 0.9, ([u for u, s in zip(ORDINARY_URLS, good) if s >= 0.5], [u for u, s in zip(UNWANTED_URLS, bad) if s < 0.5])


def test_trees_of_a_callers_urls(spark):
    labelled = [(f"http://{'bad' if i % 3 == 0 else 'ok'}{i % 7}.site{i}.{'zz' if i % 3 == 0 else 'yy'}/{i}", int(i % 3 == 0)) for i in range(400)]
    d = spark.createDataFrame([(1, "http://new.host.zz/1"), (2, "http://new.host.yy/1")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in U.judge(d, rules={}, model=U.UrlModel(labelled)).collect()} == {1: "block", 2: "allow"}


def test_splits_against_all_splits():
    """The first split of a tree is the best of all splits of all columns."""
    r = np.random.default_rng(3)
    for _ in range(20):
        b, g, h = r.integers(0, 12, (80, 4)), r.normal(size=80), r.uniform(0.1, 0.25, 80)
        (column, cut, value), node = U.BoostedTrees()._grow(b, g, h)

        def gain(j, c):
            left = b[:, j] <= c
            if min(left.sum(), (~left).sum()) < U.LEAST:
                return 0.0
            return g[left].sum() ** 2 / (h[left].sum() + 1) + g[~left].sum() ** 2 / (h[~left].sum() + 1) - g.sum() ** 2 / (h.sum() + 1)

        best = max((gain(j, c) for j in range(4) for c in range(12)), default=0.0)
        assert np.isclose(gain(column[0], cut[0]), best)
        for at in np.unique(node):
            assert np.isclose(value[at], U.RATE * g[node == at].sum() / (h[node == at].sum() + 1))


@settings(max_examples=80, deadline=None, derandomize=True)
@given(st.text("\\#/<>turn: aé\n", max_size=25), st.text("\\#:ass", max_size=8))
def test_turn_round_trip(text, role):
    f = C.Formatter()
    ids, mask = f.turn(role, text)
    assert f.read(ids) == [(role, text)] and not mask.any()
    ids, mask = f.turn("assistant", text)
    assert f.under_mask(ids, mask) == text and C.unescape(C.escape(text)) == text
    written = f.written(ids)
    assert written.startswith("### assistant: ") and written.endswith(" </turn>\n") and not re.search(r"(?<!\\)(?:\\\\)*###", written[3:])


def test_chat(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()] + ODD_CONVERSATION
    rows += [(900_001, 1, "assistant", None), (900_001, 0, None, "q"), (900_001, None, "user", "first"), (900_001, 1, "assistant", "tie"), (None, 0, "user", "x"), (900_002, 0, "assistant", "long " * 40_000), (900_003, 0, "user", "twice"), (900_003, 0, "user", "twice")]
    d = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, ids int").repartition(6)
    got = {r.conv_id: r for r in C.read_back(C.format_turns(d)).collect()}
    convs = {}
    for r in rows:
        convs.setdefault(r[0], []).append(r)
    low = lambda x: (x is not None, x or 0)
    word = lambda x: (x is not None, x or "")
    assert set(got) == set(convs)
    f = C.Formatter()
    for key, turns in convs.items():
        turns.sort(key=lambda r: (low(r[1]), word(r[2]), word(r[3])))
        body = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in turns)
        loss = "".join(t or "" for _, _, r, t in turns if r == "assistant")
        g = got[key]
        assert (g.n_turns, g.turns_sha256) == (len(turns), hashlib.sha256(body.encode()).hexdigest())
        assert (g.loss_chars, g.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert g.formatted_chars == sum(len(f.written(f.turn(r or "", t or "")[0])) for _, _, r, t in turns)
    assert C.read_back(C.format_turns(d.limit(0))).collect() == []


def test_chat_ids_that_are_text(spark):
    rows = [("b", 1, "assistant", "yes"), ("a", 0, "user", "hi"), ("b", 0, "user", "well?"), (None, 0, "assistant", "")]
    got = {r.conv_id: (r.n_turns, r.loss_chars) for r in C.read_back(C.format_turns(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string"))).collect()}
    assert got == {"a": (1, 0), "b": (2, 3), None: (1, 0)}
