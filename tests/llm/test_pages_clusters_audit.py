"""HTML extraction, centroid clustering and the filter audit against plain versions of the same."""

import hashlib
import html
import math
import re
from itertools import permutations

import numpy as np
import pytest

from veritally.llm import clusters, filter_audit, html_tree

SMALL = "/root/testdata/sf0.001"

PAGE = """<!DOCTYPE html><html><head><title>No &amp; title</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header>
<nav><ul><li><a href="/a">Menu</a><li>More</ul></nav><div class="cookie-notice">We use cookies</div>
<main><article><header><h2>The  head&shy;line &lt;1&gt;</h2></header><p>One<br>two <b>three</b>&nbsp;four<p>Five <span class="ad">Buy!</span>six
<ul><li>item a<li>item <i>b</i></ul><table><tr><td>c1<td>c2<tr><td>c3</table><div class="share">Share it</div><script>var a = "<p>no</p>";</script>
<!-- <p>never</p> --><form><label>Name</label><input></form><p>tom&amp;jerry &quo <q>a < b</q></p><blockquote>Quoted</blockquote></article></main>
<aside>Side</aside><section id="comments"><article>First!</article></section><footer>&copy; 2020</footer></body></html>"""
MAIN = "The head\xadline <1>\nOne two three four\nFive\nsix\nitem a\nitem b\nc1\nc2\nc3\ntom&jerry &quo a < b\nQuoted"


def kept(text):
    page = html_tree.parse(text)
    return "\n".join(t for i, t in page.blocks if page.nodes[i].mark == html_tree.KEPT)


def test_pages_are_read_as_they_stand():
    assert kept(PAGE) == MAIN
    for broken in ("<article><p>a<p>b", "<article><p>a</div></p></span>b</article>", "<article><p>a</b><p>b<a href='x", "<ARTICLE>a<P>b</P>", "<article>a</p>b<!-- c", '<article>a<p title="x>y">b<script>c', "<article>a<?php x ?><p>b<![CDATA[x]]>"):
        assert kept(broken).replace("\n", "") in ("ab", "a b"), broken
    assert kept("") == "" and html_tree.parse("just text").blocks == [(0, "just text")]
    assert kept("<article>" + "<div>" * 50_000 + "deep" + "<li>x" * 3) == "deep\nx\nx\nx"
    assert kept("<article><table><tr><td><p>a</table>b<p>c</article>d") == "a\nb\nc"
    assert [html_tree.host_of(u) for u in ("HTTP://User@A.example.COM:80/x", "//b.example/y", "no host", None, "mailto:a@b")] == ["a.example.com", "b.example", "", "", ""]


def plain(text):
    """The article of a page of the tables, by patterns."""
    inner = re.search("<article>(.*?)</article>", text, re.S).group(1)
    parts = (" ".join(html.unescape(re.sub("</?b>", "", x).replace("<br>", " ")).split()) for x in re.split("</?(?:p|h1)>", inner))
    return "\n".join(p for p in parts if p)


def test_every_page_of_the_table(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    found = {r["page_id"]: r for r in html_tree.extract(pages).collect()}
    rows = pages.collect()
    assert len(found) == len(rows)
    for r in rows:
        assert found[r["page_id"]]["text"] == plain(r["html"]) and found[r["page_id"]]["n_chars"] == len(plain(r["html"])) and found[r["page_id"]]["url"] == r["url"]


def test_entropy_finds_what_no_style_declares(spark):
    """Plain divs: blocks that all pages of a host share go, also on a page whose layout is its own; a small host learns from all."""
    rows = []
    for i in range(40):
        host = "big.example" if i < 37 else f"small{i}.example"
        extra = "<section><h3>Only here</h3></section>" if i == 3 else ""
        rows.append((i, f"http://{host}/{i}", f"<body><div id=top>Home<p>News</div><div id=text{i}><p>Story {i}</p><p>It goes {i * 7} on</p></div>{extra}<div class=bottom>All rights</div>", "x"))
    rows += [(0, "http://big.example/0", rows[0][2], "x")] * 60  # copies of a page count once
    found = html_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(found) == len(rows)
    for r in found:
        i = r["page_id"]
        assert r["text"] == f"Story {i}\nIt goes {i * 7} on" + ("\nOnly here" if i == 3 else ""), r


def test_importance_is_that_of_the_formulas(spark):
    rows = [(f"http://h/{i}", f"<div>{'same' if i < 6 else f'own {i}'}<p>a</p>{'<ul><li>b</ul>' if i % 2 else ''}</div>") for i in range(8)]
    tree, layouts = html_tree.style_tree(spark.createDataFrame(rows, "url string, html string"))
    by = {round(r["entropy"], 6) for r in tree.collect()}
    div, log = html_tree.GAMMA**2, math.log(8)
    texts = [0.0, 0.0, math.log(6)]  # H before the division: two texts of one page, one of six (two pages are the same body)
    pages = 8 - 4  # 0, 2, 4 are one body, and 1, 3, 5 another
    texts[2] = math.log(2)
    log = math.log(pages)
    said = 1 - sum(texts) / 3 / log
    looked = math.log(2) / log
    assert round(div * said + (1 - div) * looked, 6) in by
    assert layouts.count() == 2 and sum(r["pages"] for r in layouts.collect()) == 8


def test_joins_of_frequent_and_rare_keys(spark, monkeypatch):
    """Beyond the rows that may be broadcast, only frequent keys are; the result is the same."""
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").limit(30)
    before = sorted(map(tuple, html_tree.extract(pages).collect()))
    monkeypatch.setattr(html_tree, "BROADCAST", 0)
    monkeypatch.setattr(html_tree, "SHARE", 8)
    assert sorted(map(tuple, html_tree.extract(pages).collect())) == before


def test_odd_pages(spark):
    rows = [(None, None, None, 1), (1, None, "<p>" + "long " * 200_000, 2), (1, "x", "", 3), (2, "http://a/b", PAGE, 4), (2, "http://a/b", PAGE, 4)]
    kind = "page_id int, url string, html string, n_chars int"
    found = html_tree.extract(spark.createDataFrame(rows, kind)).collect()
    assert len(found) == 5 and found[0].asDict().keys() == {"page_id", "url", "text", "n_chars"}
    texts = sorted((r["page_id"] or 0, r["text"][:9], r["n_chars"]) for r in found)
    assert texts == [(0, "", 0), (1, "", 0), (1, "long long", 999_999), (2, MAIN[:9], len(MAIN)), (2, MAIN[:9], len(MAIN))]
    assert html_tree.extract(spark.createDataFrame([], kind)).collect() == []


def clustered(rows, k, rounds, salt="1"):
    """All vectors with all centroids, in Python's integers."""
    points = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"{salt}:{i}".encode()).hexdigest(), p) for i, p in points if i is not None)[:k]
    centroids = [p for _, p in first]

    def nearest(p):
        return min((sum((a - b) ** 2 for a, b in zip(p, c, strict=True)), i) for i, c in enumerate(centroids))

    for _ in range(rounds):
        at = [nearest(p)[1] for _, p in points]
        for c in set(at):
            own = [p for (_, p), a in zip(points, at, strict=True) if a == c]
            centroids[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    ends = [(i, *nearest(p)[::-1]) for i, p in points]
    return sorted(
        ((i, c, d, sum(x[2] for x in ends if x[1] == c), sum(x[2] for x in ends), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, c, d in ends), key=str
    )


VECTORS = "vec_id long, embedding array<float>, cluster string"


def test_clusters_are_those_of_comparing_all(spark, monkeypatch):
    monkeypatch.setattr(clusters, "BLOCK", 64)
    monkeypatch.setattr(clusters, "LEAF", 4)
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(5, 64))
    rows = [(i, (middle[i % 5] + rng.normal(size=64) * (0.02 if i % 3 else 0.5)).astype(np.float32).tolist()) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 450)]  # one vector many times
    rows += [(900, [0.5] * 64), (901, [-0.5] * 64), (902, [0.0] * 64), (902, [0.0] * 64)]  # ties
    odd = [(903, None), (904, [1.0] * 63), (905, [float("nan")] * 64), (906, [float("inf"), *[0.0] * 63]), (907, [None, *[0.0] * 63]), (None, [0.25] * 64), (908, [3e38] * 64)]
    given = spark.createDataFrame([(i, v, "x") for i, v in rows + odd], VECTORS).repartition(5)
    expected = clustered(rows + odd[:-1], 16, 3)  # the last one lies beyond what a long can hold
    found = sorted(map(tuple, clusters.cluster(given).collect()), key=str)
    assert found == expected
    few = given.where("vec_id in (1, 2, 900) or vec_id is null")
    assert sorted(map(tuple, clusters.cluster(few).collect()), key=str) == clustered([*rows[1:3], rows[450], odd[5]], 16, 3)
    assert clusters.cluster(given.where("vec_id is null")).collect() == [] and clusters.cluster(given.limit(0)).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_boxes_decide_for_whole_nodes():
    """Tight groups are assigned by their nodes, most points never meeting a centroid."""
    rng = np.random.default_rng(5)
    groups = rng.integers(-64, 64, size=(8, 64))
    points = (groups[np.arange(2048) % 8] + rng.integers(-1, 2, size=(2048, 64))).astype(np.int32)
    order, boxes, sums, spans = clusters.tree(points)
    assert sorted(order) == list(range(2048)) and (sums[0] == points.sum(0)).all()
    single, got = [0], np.full(2048, -1)

    def whole(i, c):
        single[0] += spans[i, 1] - spans[i, 0]
        got[order[spans[i, 0] : spans[i, 1]]] = c

    clusters.walk(points[order], boxes, sums, spans, groups, whole, lambda first, end, c: got.__setitem__(order[first:end], c))
    assert (got == np.arange(2048) % 8).all() and single[0] > 1800


def audited(rows, labels):
    """The audit by its definition, order by order."""
    tests = {}
    docs = []
    for i, text, lang in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        failed = "".join(
            f
            for f, fails in zip(
                "ABCDE",
                (
                    len(words) < 200,
                    100 * len(set(words)) < 50 * len(words),
                    100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
                    bool(re.search(r"[#$%&*|]", t)),
                    i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows),
                ),
                strict=True,
            )
            if fails
        )
        docs.append((lang or "", failed, any(a == i and q == 1 for a, q, _ in labels if i is not None), any(a == i and x == 1 for a, _, x in labels if i is not None)))
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        shapley = {f: 0 for f in "ABCDE"}
        for o in permutations("ABCDE"):
            for _, failed, _, _ in mine:
                first = next((f for f in o if f in failed), None)
                if first:
                    shapley[first] += 1
        for o in permutations("ABCDE"):
            for s, f in enumerate(o):
                gone = [d for d in mine if set(d[1]) & set(o[:s])]
                removed = [d for d in mine if f in d[1] and not set(d[1]) & set(o[:s])]
                kept = len(mine) - len(gone) - len(removed)
                tests[part, "".join(o), s + 1] = (kept, len(removed), sum(f in d[1] for d in gone), sum(d[1] == f for d in mine), sum(d[2] for d in removed), sum(d[3] for d in removed), shapley[f])
    return tests


def test_audit_is_that_of_the_definition(spark):
    rng = np.random.default_rng(9)
    base = [" ".join(f"w{rng.integers(0, 400)}" for _ in range(rng.integers(0, 400))) for _ in range(25)] + ["SHOUT " * 250, "50 % off", "", "é" * 200 + "AAAA", "\x1ca\x85b \x0bc"]
    rows = [(int(i), base[rng.integers(0, len(base))], ["en", "de", None][i % 3]) for i in rng.permutation(250)]
    rows += [(i, base[3], "en") for i in range(1000, 1100)] + [(None, base[3], "en"), (None, None, None), (5, base[4], "en"), (1001, base[3], "de"), (None, base[3], "fr")]
    labels = [(int(i), int(rng.integers(0, 2)), int(rng.integers(0, 2))) for i in range(0, 1050, 2)] + [(4, None, 1), (4, 1, None), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, lang string, mask int")
    marks = spark.createDataFrame([(*x, "y") for x in labels], "doc_id long, quality int, toxic int, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "37")  # many ranges, so that runs of copies cross their bounds
    try:
        found = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in filter_audit.audit(docs, marks).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found == audited(rows, labels)
    assert filter_audit.audit(docs.limit(0), marks).collect() == [] and filter_audit.audit(docs, marks.limit(0)).count() == 4 * 600


@pytest.mark.parametrize("text", ["a b", "", "x" * 300_000, "A \x0b b c"])
def test_failures_of_one_text(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    expected = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), False]
    assert filter_audit.failures(text.encode()) == sum(1 << i for i, fails in enumerate(expected) if fails)
