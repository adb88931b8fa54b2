"""Main text: blocks of awkward pages, repeated runs against brute force, whole tables."""

import random

import numpy as np
import pytest

from quillspark.llm import maintext

PAGES = [
    ("<html><body><nav><a>Home</a></nav><article><h1>T &amp; x</h1><p><b>One\n  two<br>three<p>Four</article><footer>f</footer>", ["T & x", "One two three", "Four"]),
    ("<p>a</p><div class='ad'>buy</div><div class='content has-sidebar'>b<span>c</span></div><div id='reader-comments'><p>no</p></div>", ["a", "bc"]),
    ("<script>var t='</p>';</script><style>p{}</style><header>h</header><main><header>kept</header><form>f</form>x &lt;y&gt; &#233;&amp</main>", ["kept", "x <y> é&"]),
    ("<article>long<aside>side</aside>text<section class=commentList><p>c</p></section></article><p>outside</p>", ["long", "text"]),
    ("<div role=navigation>n</div><div hidden>h</div><ul><li>one<li>two</ul><table><tr><td>a<td>b</table>", ["one", "two", "a b"]),
    ("<article><p>cut off in the mid", ["cut off in the mid"]),
    ("<body class='nav ad'>plain &nbsp; text", ["plain text"]),
    ("<article><p>x<!-- no --></p><div class='cookieNotice'>c</div></article>", ["x"]),
    ("", []),
    ("<nav>only</nav>", []),
]


@pytest.mark.parametrize(("html", "blocks"), PAGES)
def test_blocks(html, blocks):
    assert maintext.blocks_of(html) == blocks


@pytest.mark.parametrize("seed", range(12))
def test_repeated_runs(seed):
    r = random.Random(seed)
    streams = [[r.randrange(3) for _ in range(r.randrange(30))] for _ in range(r.randrange(1, 9))]
    streams += streams[: seed % 3]
    least, pages, share = r.randrange(1, 7), r.randrange(1, 5), r.choice([0.1, 0.5, 0.9])
    distinct = {tuple(s) for s in streams}
    enough = max(pages, share * len(distinct))
    has = lambda s, run: any(tuple(s[i : i + least]) == run for i in range(len(s) - least + 1))
    want = []
    for s in streams:
        mark = [False] * len(s)
        for i in range(len(s) - least + 1):
            if sum(has(o, tuple(s[i : i + least])) for o in distinct) >= enough:
                mark[i : i + least] = [True] * least
        want.append(mark)
    got = maintext.repeated([np.array(s, np.int64) for s in streams], least, share, pages)
    assert [g.tolist() for g in got] == want


def test_hosts(spark, tmp_path):
    """Unmarked boilerplate goes by repetition; copies of an article, one under many addresses, stay."""
    words = lambda seed, n: " ".join(f"w{random.Random(seed * 1000 + i).randrange(10**6)}" for i in range(n))
    bar = "<div><p>all the news of this site today</p></div>"
    rows = [(i, f"http://A.example:80/{i}", f"{bar}<p>{words(i, 30)}</p><p>{words(i, 3)}</p>", "x", "y") for i in range(10)]
    rows += [(100 + i, f"https://b.example/{i}", f"<article><p>{words(1, 40)}</p></article>", "x", "y") for i in range(9)]
    rows += [(200, None, None, None, None), (201, "bad", "", None, None), (200, None, None, None, None), (None, "http://c.example", "<p>" + words(5, 20000), "x", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, text string")
    got = {(r.page_id, r.url): r.text for r in maintext.main_text(df.repartition(3)).collect()}
    want = {(i, f"http://A.example:80/{i}"): words(i, 30) + "\n\n" + words(i, 3) for i in range(10)}
    want |= {(100 + i, f"https://b.example/{i}"): words(1, 40) for i in range(9)}
    want |= {(200, None): "", (201, "bad"): "", (None, "http://c.example"): words(5, 20000)}
    assert got == want
    split = maintext.main_text(df, group_bytes=1500).collect()
    assert len(split) == len(rows)
    assert {(r.page_id, r.url): r.text for r in split if r.page_id is None or r.page_id >= 100} == {k: v for k, v in want.items() if k[0] is None or k[0] >= 100}
    df.limit(0).write.parquet(f"{tmp_path}/pages.parquet")
    assert maintext.op13(spark, str(tmp_path)).collect() == []


def test_groups_do_not_change_the_result(spark):
    """A run on exactly half of a host's pages, and one on less, are judged alike in one group and in many; copies are one page."""
    words = lambda seed, n: " ".join(f"w{random.Random(seed * 1000 + i).randrange(10**6)}" for i in range(n))
    half, less = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(i, "http://a.example/", (f"<p>{half}</p>" if i % 2 else "") + (f"<p>{less}</p>" if i % 2 and i > 1 else "") + f"<p>{words(i, 30)}</p>") for i in range(40)]
    rows += [(100 + i, "http://a.example/", rows[3][2]) for i in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    want = {i: ([less] if less in page else []) + [words(3 if i >= 100 else i, 30)] for i, _, page in rows}
    for pages in (512, 9, 4):
        got = {r.page_id: r.text.split("\n\n") for r in maintext.main_text(df, group_pages=pages).collect()}
        assert got == want, pages


def test_articles_of_the_table(spark):
    """Every page of the table: exactly its article's blocks, by a plain cut at the article's tags."""
    import html as entities
    import re

    def plain(page):
        inner = re.search(r"<article>(.*?)(</article>|$)", page, re.S).group(1)
        parts = (" ".join(entities.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in re.split(r"</?(?:p|h1)>", inner))
        return "\n\n".join(p for p in parts if p)

    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in maintext.op13(spark, "/root/testdata/sf0.01").collect()}
    want = {r.page_id: plain(r.html) for r in table.collect()}
    assert {k: v for k, (v, _) in got.items()} == want
    assert all(n == len(t) for t, n in got.values())
