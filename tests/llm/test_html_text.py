import time
import itertools
import os
import re

import numpy as np
import pytest

from orrery.llm import html_text as h
from orrery.llm import queries


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a)), range(len(b))):
        t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@pytest.mark.parametrize("bits", [1 << 26, 8])
def test_shared_lines_are_a_longest_common_subsequence(monkeypatch, bits):
    monkeypatch.setattr(h, "LCS_BITS", bits)
    rng = np.random.default_rng(4)
    for _ in range(200):
        a, b = rng.integers(0, 5, rng.integers(0, 14)), rng.integers(0, 5, rng.integers(0, 14))
        mark = h.shared_lines(a, b)
        picked = a[mark].tolist()
        assert len(picked) == lcs(a.tolist(), b.tolist()) == lcs(picked, b.tolist())


def text(html, shared=()):
    lines, zones = h.page_lines(html)
    mark = np.zeros(len(lines), bool)
    mark[list(shared)] = True
    return h.main_text(lines, zones, mark)


def test_article_only():
    page = (
        '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header>H</header><nav><ul><li><a href="/x">menu</a></li></ul></nav>'
        '<!-- ad --><div class="ad">Buy</div><aside>side</aside><div id="cookie-notice">We use</div><form><p>Name</p><input><button>Go</button></form><article><h1>Head  &amp;\n line</h1><p><b>One <i>two</i>.<br>'
        '<p>Th&eacute; &#233; &lt;x&gt; &notanentity;</p><script>bad()</script><aside>note</aside><div class="share-buttons">Share</div><section id="comments"><p>Nice!</p></section></article><footer>&copy; me</footer></body></html>'
    )
    assert text(page) == "Head & line\nOne two.\nThé é <x> &notanentity;".replace("&notanentity;", "¬anentity;")


def test_broken_and_odd_markup():
    assert text("") == "" and text("<") == "<" and text("a < b") == "a < b" and text("plain\ttext\n") == "plain text"
    assert text("<p>a<p>b</p>c</div></p>d") == "a\nb\nc\nd" and text("<article><p>x") == "x" and text("<script>never closed <p>x") == ""
    assert text("<nav>m<p>n</nav><p>b", ()) == "b" and text("<p>s</p><p>own</p>", [0]) == "own" and text("<article><p>s</p></article>", [0]) == "s"
    assert len(text("<p>" + "word " * 200_000)) == 999_999


def test_neighbours_and_deletion(spark):
    rows = [(i, f"http://a.com/x/{i:03d}", f"<p>top {i}</p><p>menu</p><p>body {i}</p><p>foot</p>") for i in range(40)]
    rows += [(100, None, None), (101, "http://b.com/", "<p>alone</p>"), (102, "http://c.com/1", "<p>same</p>"), (102, "http://c.com/1", "<p>same</p>"), (103, "http://d.com/1", "<p>copy</p>"), (104, "http://d.com/2", "<p>copy</p>"), (None, "http://e.com/", "<p>n</p>")]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id bigint, url string, html string, text string")
    out = h.extract(df.repartition(5)).collect()
    got = {r.page_id: (r.text, r.n_chars) for r in out}
    assert len(out) == len(rows)
    for i in range(40):
        assert got[i] == (f"top {i}\nbody {i}", len(f"top {i}\nbody {i}"))
    assert got[100] == ("", 0) and got[101][0] == "alone" and got[102][0] == "same" and got[103][0] == got[104][0] == "copy" and got[None][0] == "n"
    assert h.extract(df.limit(0)).count() == 0


def test_query_keeps_every_page(spark, smoke):
    out = queries.op5_html_text(spark, smoke).collect()
    assert len(out) == spark.read.parquet(f"{smoke}/pages.parquet").count() and all(r.n_chars == len(r.text) > 0 for r in out)
    assert not any("<p>" in r.text or "©" in r.text for r in out)


def brute(pages):
    """{(id, url, html): (text, shared lines)} by plain loops: nearest other line list on the host, then the common subsequence."""
    lists = {}
    for i, url, html in pages:
        host, path = host_path(url)
        lists.setdefault(host, {}).setdefault(tuple(h.page_lines(html or "")[0]), []).append((path, i))
    out = {}
    for i, url, html in pages:
        host = host_path(url)[0]
        lines, zones = h.page_lines(html or "")
        order = sorted((min(where)[0], k) for k, where in lists[host].items())
        at = [k for _, k in order].index(tuple(lines))
        mine = order[at][0]
        common = lambda n: len(os.path.commonprefix([mine, order[n][0]]))
        near = max((n for n in (at - 1, at + 1) if 0 <= n < len(order)), key=common, default=None)
        ids = {t: k for k, t in enumerate(dict.fromkeys([*lines, *(order[near][1] if near is not None else ())]))}
        mark = np.zeros(len(lines), bool) if near is None else h.shared_lines(np.array([ids[t] for t in lines], np.int64), np.array([ids[t] for t in order[near][1]], np.int64))
        out[i, url, html] = (h.main_text(lines, zones, mark), int(mark.sum()))
    return out


def host_path(url):
    rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
    host = re.match("[^/?#]*", rest)[0]
    return host.lower(), re.match("[^?#]*", rest[len(host) :])[0]


def test_query_equals_brute_force(spark, smoke):
    pages = [tuple(r) for r in spark.read.parquet(f"{smoke}/pages.parquet").select("page_id", "url", "html").collect()]
    got = {r.page_id: (r.text, r.n_shared) for r in queries.op5_html_text(spark, smoke).collect()}
    want = brute(pages)
    assert got == {p[0]: want[p] for p in pages}


def test_pages_without_article_are_decided_by_differencing(spark):
    """Menus, notices and footers that no tag or name tells: they differ between hosts, and copies don't protect them."""
    rng = np.random.default_rng(3)
    pages = []
    for i in range(60):
        host = i % 4
        body = "".join(f"<p>text {rng.integers(0, 10**9)} of {i}</p>" for _ in range(rng.integers(1, 6)))
        pages.append((i, f"http://h{host}.org/{'ab'[i % 2]}/{i:03d}?q", f"<div>menu of {host}</div><p>home {host}</p>{body}<p>rights {host}</p>"))
    pages += [(100 + i, f"http://h0.org/a/{i:03d}", pages[0][2]) for i in range(8)] + [(200, "http://h9.org/" + "x/" * 20_000, "<p>long</p>"), (201, "http://h9.org/" + "x/" * 20_000 + "y", "<p>long</p><p>own</p>")]
    out = {r.page_id: r for r in h.extract(spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(7)).collect()}
    want = brute(pages)
    for p in pages:
        assert (out[p[0]].text, out[p[0]].n_shared) == want[p]
    for i in [*range(60), *range(100, 108)]:
        assert out[i].n_shared == 3 and not any(w in out[i].text for w in ("menu", "home", "rights")) and out[i].text
        lines, zones = h.page_lines(dict((p[0], p[2]) for p in pages)[i])
        assert h.main_text(lines, zones, np.zeros(len(lines), bool)) != out[i].text


def test_broken_pages_take_linear_time():
    mega = 1 << 20
    pages = [
        '<a "' * (mega // 4), "<!" * (mega // 2), "<" * mega, "<b>x" * (mega // 8) + "</i>" * (mega // 8), "<i><div>" + "<b>x" * (mega // 8) + "</i>" * (mega // 8),
        "<select>x" * (mega // 9), "<div>" * (mega // 10) + "</div>" * (mega // 11), "<p>x" * (mega // 4), "<!--" * (mega // 4), "<a href='" * (mega // 9) + ">",
        f"<div class='{'nav_' * (mega // 4)}.'>x", "x&amp;" * (mega // 6), f"<p {'id ' * (mega // 3)}>y</p>",
    ]
    for page in pages:
        start = time.perf_counter()
        h.page_lines(page)
        assert time.perf_counter() - start < 2, page[:20]


def test_only_code_and_forms_lose_their_text():
    page = (
        "<article><p>a</p><noscript><p>b</p></noscript><object>c</object><svg><text>d</text></svg><p hidden>e</p><p aria-hidden='true'>f</p><p style='display:none'>g</p>"
        "<video>h</video><script>no</script><style>no</style><textarea>no</textarea><select><option>no</select><form>no</form></article><p hidden>no</p>"
    )
    lines, zones = h.page_lines(page)
    text = h.main_text(lines, zones, np.zeros(len(lines), bool))
    assert "no" not in text.replace("noscript", "") and [c for c in text if c.isalpha()] == list("abcdefgh")


def test_end_tags():
    line = lambda page: h.page_lines(page)[0]
    assert line("<p>a<b>b<p>c</b>d</p>e") == ["ab", "cd", "e"]
    assert line("<ul><li>a<li>b</ul>c") == ["a", "b", "c"]
    assert line("a < b <3 c <a title='x>y'>d</a> <!-- e --> <a title='f>g") == ["a < b <3 c d <a title='f>g"]
    assert line("<div><i>a</div></i>b") == ["a", "b"] and line("<title>x</title><head>y</head>z <textarea>w") == ["yz w"]
