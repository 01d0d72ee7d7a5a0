import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import main_text, queries
from pagemill.llm.main_text import ARTICLE, GONE, MAIN, OPEN, Block, read_blocks

PAGES = "page_id long, url string, html string, text int, key string"


def article(markup):
    return "\n".join(main_text.main_blocks(read_blocks(markup), 0, None)[0])


@pytest.mark.parametrize(
    "markup,want",
    [
        ("<article><h1>A &amp; B&amp</h1><p><b>x<br>y <br><p>z</p></article><footer>f</footer>", "A & B&\nx y\nz"),
        ("<nav><ul><li><a href='/a'>a<li>b</ul></nav><article>one <i>two</i>three<div> four\n\t five </div></article>", "one twothree\nfour five"),
        ("<script>var t='</p><article>no</article>';</script><article>yes<script>if (a < b) {}</script> and<!-- <p>no --> more</article>", "yes and more"),
        ("<header>site</header><article><header><h1>Title</h1></header><p>t</p><footer>by</footer><aside>see</aside></article>", "Title\nt"),
        ("<div class='ad'>buy</div><main><p>m<div id=comments><p>first!</div><form>mail <input></form></main><div class='site-footer'>f</div>", "m"),
        ("<main>teaser<article>a <span class='sponsored-link'>buy</span>b</article></main>", "a b"),
        ("<article>a</article><section class='comments'><article class='comment'>nice</article></section><article>b</article>", "a\nb"),
        ("<article><ul><li>1<li>2<p>3</ul><table><tr><td>4<td>5<tr><td>6</table></article>", "1\n2\n3\n4\n5\n6"),
        ("<article>&lt;b&gt; &#233;&eacute;&nbsp;x &am &#0;<p title=\"a > b\">q<p title='it>s'>r<p title=it's>s</article>", "<b> éé x &am �\nq\nr\ns"),
        ("<body class='no-sidebar has-ads'><div class='content-with-sidebar'>kept</div><div class=\"side menu\">gone</div>tail", "kept\ntail"),
        ("<article>1 < 2 <3 </>x<?php a ?><!doctype b></article", "1 < 2 <3 x"),
        ("<article><p>a</div></span></p>b<!-- open", "a\nb"),
        ("<ARTICLE><P>a<P CLASS=ad>b</P>c</ARTICLE>", "a\nc"),
        ("<article>a<style>p{", "a"),
        ("<title>t</title>plain text", "plain text"),
        ("<div role=navigation>n</div><div role=main>m</div>o", "m"),
        ("<article>  </article>o", "o"), ("<div id='top'>Home</div><div id='mainContent'><p>a<div class='post-footer'>f</div>b</div>end", "a\nb"),
        ("<div class='content-without-main'>x</div><span class='post'>y</span>", "x\ny"), ("<section class='entry'>e<article>a</article></section>", "a"),
        ("", ""),
        ("<nav>only</nav>", ""),
        ("x" * 100_000 + "<a href='" * 50, "x" * 100_000),
    ],
)
def test_blocks_of_a_page(markup, want):
    assert article(markup) == want


def test_zones():
    assert read_blocks("<div>a</div><main>b<article>c</article><nav>d</nav></main>") == [Block(OPEN, "a"), Block(MAIN, "b"), Block(ARTICLE, "c"), Block(GONE, "d")]


def plain(rows, long):
    """Texts by a suffix array of each host: sorted suffixes, of which neighbours of pages with different markup cover what they share."""
    out = {}
    by_host = {}
    for n, (page, url, markup) in enumerate(rows):
        by_host.setdefault((url or "").split("/")[2].lower() if "//" in (url or "") else n, []).append((n, markup or ""))
    for host, pages in by_host.items():
        suffixes, blocks, tokens = [], {}, {}
        for n, markup in pages:
            blocks[n] = read_blocks(markup)
            tokens[n] = [t for i, b in enumerate(blocks[n]) for t in ([(f"article of {markup}", None)] if b.zone == ARTICLE else [("\n", i), *((w, i) for w in b.text.split(" "))])]
            suffixes += [([t for t, _ in tokens[n][p:]], n, p, markup) for p in range(len(tokens[n]))]
        covered = {n: [False] * len(tokens[n]) for n, _ in pages}
        if not isinstance(host, int):
            suffixes.sort(key=lambda s: s[0])
            k = 0
            while k < len(suffixes):
                e = k + 1
                while e < len(suffixes) and len(suffixes[k][0]) >= long and suffixes[e][0][:long] == suffixes[k][0][:long]:
                    e += 1
                if len({s[3] for s in suffixes[k:e]}) > 1:
                    for _, n, p, _ in suffixes[k:e]:
                        covered[n][p : p + long] = [True] * long
                k = e
        for n, _ in pages:
            best = max((b.zone for b in blocks[n]), default=GONE)
            own = [i for i, b in enumerate(blocks[n]) if b.zone == best and best != GONE]
            hits = lambda i: sum(c for (t, j), c in zip(tokens[n], covered[n]) if j == i and t != "\n")
            size = lambda x: sum(len(blocks[n][i].text.split(" ")) for i in x)
            left = own if best == ARTICLE else [i for i in own if 2 * hits(i) <= size([i])]
            left = left if 10 * size(left) >= size(own) else own
            out[n] = "\n".join(blocks[n][i].text for i in left)
    return out


def test_host_repeats_match_a_plain_suffix_array(spark):
    rnd = random.Random(5)
    word = lambda: rnd.choice("abcdefghij") + str(rnd.randrange(40))
    line = lambda k: " ".join(word() for _ in range(k))
    foot, menu, shared = line(14), [line(1) for _ in range(9)], line(30)
    rows = []
    for i in range(60):
        host = "hot.example.com" if i % 3 else f"h{i % 7}.example.org"
        own = [line(rnd.randint(5, 60)) for _ in range(rnd.randint(1, 4))]
        top = "".join(f"<div>{m}</div>" for m in menu)
        if i % 4 == 0:
            page = f"{top}<article><p>{own[0]}<p>{shared}</article><div>{foot}</div>"
        elif i % 4 == 1:
            page = f"{top}<main>{''.join(f'<p>{x}</p>' for x in own)}<div>{foot} {line(2)}</div></main>"
        else:
            page = f"<body>{top}{''.join(f'<div>{x}</div>' for x in own)}<p>{foot}{' ' + line(20) if i % 5 == 0 else ''}</p></body>"
        rows.append((i, f"https://{host.upper() if i % 2 else host}/p?{i}", page))
    rows += [(100, "https://copy.example.net/1", f"<div>{shared}</div>"), (101, "https://copy.example.net/2", f"<div>{shared}</div>"), (102, "https://copy.example.net/3", f"<div>{shared}</div><p>x</p>")]
    rows += [(200, None, rows[2][2]), (201, "nonsense", rows[2][2]), (202, "https://e.org/", None), (203, "https://e.org/", ""), (2, rows[2][1], rows[2][2]), (None, rows[3][1], rows[3][2]), (2, rows[2][1], rows[6][2])]
    want = plain(rows, main_text.LONG)
    frame = spark.createDataFrame([(a, b, c, 1, "clash") for a, b, c in rows], PAGES).repartition(4)
    got = main_text.extracted(frame).collect()
    assert sorted((str(r.page_id), str(r.url), r.text) for r in got) == sorted((str(p), str(u), want[n]) for n, (p, u, _) in enumerate(rows))
    assert all(r.n_chars == len(r.text) for r in got) and sum(r.n_repeated for r in got) > 100
    assert all(foot not in r.text for r in got if r.page_id in (2, 6, 7)) and all(shared in r.text for r in got if r.page_id in (0, 4, 100, 101, 102))


def test_main_text_edges(spark):
    assert main_text.extracted(spark.createDataFrame([], PAGES)).count() == 0
    long = "<article>" + "".join(f"<p>word {i} &eacute;" for i in range(60_000)) + "</article>"
    r = main_text.extracted(spark.createDataFrame([(1, "http://a/", long, 1, "x"), (2, "http://a/", "<div>" + "w " * 200_000, 1, "x")], PAGES)).orderBy("page_id").collect()
    assert (r[0].n_blocks, r[0].text.split("\n")[59_999]) == (60_000, "word 59999 é") and r[1].n_chars == 399_999


def test_no_run_is_longer_than_asked(spark):
    assert len(main_text.ranks(list(range(7)))) == 0 and len(main_text.ranks(list(range(8)))) == 1 and len(main_text.ranks([])) == 0
    assert main_text.ranks([1, 2, 3, 4], 2).tolist() == [main_text.ranks([1, 2], 2)[0], main_text.ranks([2, 3], 2)[0], main_text.ranks([3, 4], 2)[0]]


def test_all_test_pages_have_text(spark):
    from tests.conftest import DATA

    assert queries.op12_host_suffixes(spark, DATA).filter(F.col("n_chars") == 0).count() == 0


def test_articles_are_in_the_stream(spark):
    line = " ".join(f"w{i}" for i in range(20))
    blocks = read_blocks(f"<nav>n</nav><article>{line}</article>")
    assert len(main_text.stream(blocks)[0]) == 2 + 21 and set(main_text.stream(blocks)[1]) == {0, 1}
    assert main_text.main_blocks(blocks, 0, [2]) == ([line], 0)
    # a list of teasers repeats what an article of its host says
    teaser = f"<div>{line}</div><p>our latest texts and more of them by our own hand</p>"
    rows = [(1, "http://a/1", f"<article>{line}<p>and on</article>", 1, "x"), (2, "http://a/2", teaser, 1, "x"), (3, "http://b/2", teaser, 1, "x")]
    got = {r.page_id: (r.text, r.n_repeated) for r in main_text.extracted(spark.createDataFrame(rows, PAGES)).collect()}
    own = "our latest texts and more of them by our own hand"
    assert got == {1: (f"{line}\nand on", 0), 2: (own, 1), 3: (f"{line}\n{own}", 0)}


def test_streams_of_several_pages_are_those_of_each():
    pages = [[], read_blocks("<p>é one\x85two</p><article>three <b>four</b></article>"), read_blocks(""), read_blocks("<nav>" + "a b c d e f g h i j " * 3 + "</nav><p>x</p>"), []]
    s = main_text.streams(pages)
    alone = [main_text.streams([p]) for p in pages]
    assert s.tokens.tolist() == [t for a in alone for t in a.tokens.tolist()] and s.first.tolist() == [0, 0, 7, 7, 40, 40]
    assert s.of.tolist() == [0] * 4 + [1] * 3 + [2] * 31 + [3] * 2
    place, anchor = main_text.anchors(s, list("abcde"))
    assert place.tolist() == list(range(7, 33))  # suffixes of eight tokens of one page
    h = main_text.ranks(s.tokens[7:40], 4)
    plain = [min(int(x) for x in main_text.mix(h[i : i + 5] ^ np.uint64(main_text._token("d")))) for i in range(26)]
    assert anchor.tolist() == plain
    assert [len(x) for x in main_text.anchors(main_text.streams([]), [])] == [0, 0]


def test_start_tags_that_are_alike_are_judged_once():
    main_text._usual_zone.cache_clear()
    page = "<nav class='top bar'><a href='/'>a</a></nav><div class='content'>b</div><div class='content'>c</div>"
    long = f"<div class='{'x ' * 200}menu'>d</div>"
    for _ in range(3):
        assert [b.zone for b in read_blocks(page + long)] == [GONE, MAIN, MAIN, GONE]
    assert main_text._usual_zone.cache_info()[:2] == (9, 3)  # hits, misses; long attributes aren't held
