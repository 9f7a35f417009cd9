"""Page operators and vector search against brute force."""

import base64
import hashlib
import itertools
import random
import re
import struct
import time
from collections import Counter

import pytest
import zstandard
from pyarrow import fs
from pyspark.sql import functions as F

from wavefold.llm import topk, url_rules, warc, wrappers
from wavefold.llm.common import scratch, shared_dir
from wavefold.llm.queries import URL_RULES

PAGES = [
    (1, "http://A.Example.com/de/x?q=1#f", "<p>a</p>"),
    (2, "https://blog.example.net/en/1", "<p>a</p>"),
    (3, "https://example.net/fr/1", None),
    (4, None, ""),
    (4, None, ""),
    (5, "no scheme", "<p>é</p>" * 20000),
    (None, "ftp://x.net", "<p>a</p>"),
    (6, "http://example.net", "<p>b\r\n\r\nWARC/1.1</p>"),
    (7, "x://org/fr/", "<p>a</p>"),
    (8, "http://aorg/fr/?http://b.net/\r\n%0A", "<p>c</p>"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "x", "x") for p in PAGES], "page_id long, url string, html string, host string, tokens string")


def test_url_rules(spark, pages):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None), (3, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.judge(pages, labels.filter("doc_id = 2"), URL_RULES).collect()}
    assert got == {
        (1, "a.example.com", "/de/x", "example.com/de/", "block"), (2, "blog.example.net", "/en/1", "example.net/en/", "allow"), (3, "example.net", "/fr/1", "net/", "block"),
        (4, "", "", None, "allow"), (5, "", "", None, "allow"), (None, "x.net", "", None, "allow"), (6, "example.net", "", None, "allow"), (7, "org", "/fr/", "org/fr/", "allow"), (8, "aorg", "/fr/", None, "allow"),
    }


def test_url_rules_are_learnt(spark):
    """What a host and a segment together say is learnt as one rule, and applied to pages without a label."""
    rows = [(i, f"http://h{i % 3}.com/{'bad' if i % 2 else 'good'}/{i}", None) for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    blocked = lambda i: i % 3 == 1 and i % 2 == 1
    labels = spark.createDataFrame([(i, 1, int(blocked(i))) for i in range(200)], "doc_id long, quality int, toxic int")
    out = url_rules.judge(pages, labels, [], min_support=0.05, min_confidence=0.9).collect()
    assert all((r["verdict"] == "block") == blocked(r["page_id"]) for r in out) and len(out) == 300
    rules = {r["learnt_rule"] for r in out} - {None}
    assert rules == {"h:h1.com p:bad"}
    none = labels.filter("false")
    assert {r["verdict"] for r in url_rules.judge(pages, none, []).collect()} == {"allow"}
    assert url_rules.judge(pages.filter("false"), labels, []).collect() == []


def test_url_rules_by_brute_force(spark):
    """Host, path and rule on odd and very long URLs, and hosts of very many labels."""
    rng = random.Random(2)
    pick = lambda *x: rng.choice(x)
    urls = [pick("http", "", "x:y") + pick("://", "://", ":/", "://://") + pick("A.", "", "b.c.", ".") + pick("example.", "aexample.", "") + pick("net", "com", "org", "NET.", "") + pick("", "/", "/en/", "/de/x", "/fr/", "?/en/", "#/de/", "/en", "//en/") + pick("", "?a=/fr/", "#x?y", "é") for _ in range(600)]
    urls += [None, "", "http://" + "a." * 3000 + "net/" + "en/" * 30_000, "http://example.net/en/" + "x" * 200_000]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 600, 3)] * 2, "doc_id long, quality int, toxic int")

    def plain(url):
        at = (url or "").find("://")
        rest = "" if at < 0 else url[at + 3 :]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [r for _, r in URL_RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        return host, path, max(fits, key=len, default=None)

    for r in url_rules.judge(df, labels, URL_RULES).collect():
        host, path, rule = plain(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (dict((b, a) for a, b in URL_RULES)[rule] if rule else "block" if r["learnt_rule"] else "allow")


def test_url_rules_are_those_of_all_combinations(spark):
    """Against all subsets of tokens: support, confidence, lift, and no shorter rule as good; tokens that are always
    together count as the longest of them."""
    rng = random.Random(4)
    rows = []
    for _ in range(400):
        tokens = {t for t, p in zip("abcdef", (0.5, 0.5, 0.3, 0.3, 0.2, 0.02), strict=True) if rng.random() < p}
        blocked = rng.random() < (0.9 if {"a", "c"} <= tokens or "e" in tokens else 0.2)
        rows.append((sorted(tokens | {x for t in tokens & {"a"} for x in ("alpha", "al")}), blocked))
    rows.append(([], True))
    got = {(r["rule"], round(r["confidence"], 9), round(r["support"], 9)) for r in url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, blocked boolean"), min_support=0.03, min_confidence=0.5).collect()}
    sets = [(frozenset(t) - {"a", "al"}, b) for t, b in rows]
    n, base, conf = len(rows), sum(b for _, b in rows) / len(rows), {}
    for size in range(1, 7):
        for some in itertools.combinations(sorted({t for s, _ in sets for t in s}), size):
            have = [b for s, b in sets if s.issuperset(some)]
            if have and sum(have) >= 0.03 * n and sum(have) / len(have) >= 0.5 and sum(have) / len(have) > base:
                conf[some] = (sum(have) / len(have), sum(have) / n)
    want = {(" ".join(s), round(c, 9), round(u, 9)) for s, (c, u) in conf.items() if not any(conf.get(tuple(x for x in s if x != t), (0,))[0] >= c for t in s)}
    assert got == want and len(got) > 3 and any("alpha" in r for r, _, _ in got)


def test_warc_round_trip(spark, pages):
    to = scratch(spark, "warc")
    index = warc.write(pages, to)
    got = warc.read(spark, to).collect()
    assert Counter((r["page_id"], r["url"]) for r in got) == Counter((p[0], p[1]) for p in PAGES)
    keep = {}
    for i, _, h in PAGES:
        if i is not None:
            keep[h or ""] = max(i, keep.get(h or "", i))
    for r in got:
        html = next(h or "" for i, u, h in PAGES if (i, u) == (r["page_id"], r["url"]))
        full = html.encode()
        assert r["payload_bytes"] == len(full) and r["payload_digest"] == base64.b32encode(hashlib.sha1(full).digest()).decode()
        first = r["page_id"] is None or keep[html] == r["page_id"]
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first else ("revisit", keep[html]))
        assert bytes(r["payload"]) == (full if first else b"")
    assert index.count() == len(PAGES)
    some = warc.fetch(index.filter("page_id IN (5, 7)"), to).collect()
    assert {(r["page_id"], len(r["payload"])) for r in some} == {(5, len(PAGES[5][2].encode())), (7, 8)}


def test_bundles_are_seekable_zstandard(spark, pages):
    to = scratch(spark, "warc")
    warc.write(pages, to)
    system, folder = fs.FileSystem.from_uri(to)
    files = [f for f in system.get_file_info(fs.FileSelector(folder)) if f.is_file]
    assert files and all(f.path.endswith(".warc.zst") for f in files)
    for f in files:
        data = system.open_input_file(f.path).read()
        frames, size = warc.read_table(data), 0
        for at, packed, whole in frames:
            assert len(zstandard.ZstdDecompressor().decompress(data[at : at + packed], max_output_size=whole)) == whole
            size = at + packed
        assert struct.unpack_from("<II", data, size) == (warc.SKIPPABLE, len(data) - size - 8)
        # a plain reader takes all frames and skips the table
        assert zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(data).count(b"WARC/1.1\r\nWARC-Type") >= 1


def test_warc_very_large_record(spark):
    """A record larger than a frame and a bundle should hold, among small ones, and a copy of it."""
    big = "".join(f"{i:x}é" for i in range(6_000_000))
    assert len(big.encode()) > warc.BUNDLE_BYTES
    df = spark.createDataFrame([(1, "http://a/", big), (2, "http://b/", "x"), (3, "http://c/", big)], "page_id long, url string, html string")
    to = scratch(spark, "warc")
    index = warc.write(df, to)
    got = {r["page_id"]: (r["record_type"], r["payload_bytes"], len(r["payload"])) for r in warc.read(spark, to).collect()}
    n = len(big.encode())
    assert got == {1: ("revisit", n, 0), 2: ("response", 1, 1), 3: ("response", n, n)}
    [one] = warc.fetch(index.filter("page_id = 3"), to).collect()
    assert bytes(one["payload"]) == big.encode()


def test_shared_folder_is_asked_for_off_local():
    class Fake:
        conf = {}
        sparkContext = type("Context", (), {"master": "yarn", "getCheckpointDir": lambda self: None})()

    with pytest.raises(RuntimeError):
        shared_dir(Fake())


def test_warc_empty(spark, pages):
    to = scratch(spark, "warc")
    assert warc.write(pages.filter("false"), to).collect() == [] and warc.read(spark, to).collect() == []


def page(body, head="<title>t</title>"):
    return f"<!DOCTYPE html><html><head>{head}<style>p{{}}</style><script>var a='</p><article>';</script></head><body>{body}</body></html>"


CASES = [
    ("http://a.com/1", page("<nav><ul><li><a>Home</a></li><li>x</li></ul></nav><div class='ad'>Buy</div><article><h1>T &amp; U</h1><p>One\n  two<br>three</p><p>Four <b>bold</b></p></article><footer>f</footer>"), "T & U\nOne two three\nFour bold"),
    ("http://a.com/2", page("<nav><ul><li><a>Home</a></li></ul></nav><article><h1>T</h1><p><b>One<br><p>Two</article><footer>f</footer>"), "T\nOne\nTwo"),
    ("http://a.com/3", page("<article><p>A</p><aside>no</aside><form>no<input></form><div class='comments'><p>no</p></div><p>B</p></article><div id=comments>no</div>"), "A\nB"),
    ("http://a.com/4", page("<nav><ul><li>x</li></ul></nav><div>no article here</div><footer>f</footer>"), "no article here"),
    ("http://b.com/1", page("<header>H</header><div class='sidebar-left'>s</div><div id='content'><p>Text &lt;p&gt; 1 < 2</p></div><div class='cookie-notice'>c</div>"), "Text <p> 1 < 2"),
    (None, None, ""),
    (None, "", ""),
    (None, "plain &eacute; text", "plain é text"),
    ("http://c.com/1", "<article><p>cut <scr", "cut"),
    ("http://c.com/2", "<article><p>a<!-- x --> b</p><script>never closed", "a b"),
    ("http://c.com/3", "<article>" + "<p>w</p>" * 5000 + "</article>", "\n".join(["w"] * 5000)),
]


def test_main_text(spark):
    df = spark.createDataFrame([(i, u, h, "x") for i, (u, h, _) in enumerate(CASES)], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in wrappers.extract(df).collect()}
    for i, (_, _, want) in enumerate(CASES):
        assert got[i] == want, i
    assert wrappers.extract(df.filter("false")).collect() == []


def wrapper_of(*texts):
    w = wrappers.fold(wrappers.read(wrappers.Page(texts[0]).symbols))
    for x in texts[1:]:
        w, _ = wrappers.align(w, wrappers.fold(wrappers.read(wrappers.Page(x).symbols)))
    return w


def test_wrappers_take_optional_and_repeated_groups():
    w = wrapper_of("<ul><li>a</li><li>b</li></ul><p>x</p>", "<ul><li>a</li></ul><h2>t</h2><p>x</p>", "<ul><li>a</li></ul><dl><dt>a<dd>b<dt>a<dd>b</dl><p>x</p>")
    assert wrappers.pack(w) == "11ul +1li 11# > > > 1?h2 11# > > 1?dl +1( 11dt 11# > > 11dd 11# > > > > 11p 11# > >"
    assert wrappers.pack(wrappers.unpack(wrappers.pack(w))) == wrappers.pack(w)
    same, common = wrappers.align(w, wrappers.fold(wrappers.read(wrappers.Page("<ul><li>a</li></ul><p>x</p>").symbols)))
    assert wrappers.pack(same) == wrappers.pack(w) and common == 5


def accepts(w, symbols):
    """Whether a plain regular expression of the wrapper fits a stream."""
    code = {}
    letter = lambda s: code.setdefault(s, chr(0x4E00 + len(code)))

    def plain(nodes):
        out = ""
        for x in nodes:
            one = letter("#") if x.label == "#" else plain(x.parts) if x.label in wrappers.GROUPS else letter("<" + x.label) + plain(x.parts) + letter("</" + x.label)
            out += f"(?:{one})" + {(0, 0): "", (0, 1): "?", (1, 0): "+", (1, 1): "*"}[x.repeated, x.optional]
        return out

    pattern = plain(w)
    return re.fullmatch(pattern, "".join(letter(s) for s in symbols)) is not None


def test_wrappers_accept_every_stream_they_come_from():
    """Against a plain regular expression of the wrapper, on random pages; and each text has a slot of its element."""
    rng = random.Random(5)
    kinds = ["<p>t</p>", "<p>t<b>u</b></p>", "<ul><li>t</li><li>t</li></ul>", "<h2>t</h2>", "<div class=c><p>t</p><p>t</p></div>", "t", "<table><tr><td>t</td><td>t</td></tr></table>", "<div><h2>t</h2></div>", "<dl><dt>t<dd>t<dt>t<dd>t</dl>"]
    lost = texts = 0
    for _ in range(60):
        pages = ["<body><nav>t</nav><div>" + "".join(rng.choice(kinds) * rng.choice([1, 1, 2, 5]) for _ in range(rng.randrange(7))) + "</div></body>" for _ in range(6)]
        w = wrapper_of(*pages)
        elements, slots = wrappers.tree_of(w)
        for x in (wrappers.Page(x).symbols for x in pages):
            assert accepts(w, x)
            got, own = wrappers.place(w, x), wrappers.tree_of(wrappers.read(x))
            assert len(got) == x.count("#") == len(own[1])
            assert all(i < 0 or elements[slots[i].element].sign == own[0][s.element].sign for i, s in zip(got, own[1], strict=True))
            texts, lost = texts + len(got), lost + got.count(-1)
    assert lost < 0.05 * texts


def news(i, host):
    """A page of two templates that name nothing: what is which can only be told from how the host's pages differ."""
    words = lambda n, seed: " ".join(f"{random.Random(f'{host}{i}{seed}{j}').randrange(10**6):x}" for j in range(n))
    body = [words(30 + i, p) for p in range(2 + i % 3)]
    notice, links = f"This site {host} stores data on your device to serve you better. " * 8, "".join(f"<li><a href=/{w}>{w}</a></li>" for w in words(4, "l").split())
    if host == "one":
        html = f"<body><div><p>{notice}</p></div><div><ul>{links}</ul></div><div><h1>{words(4, 'h')}</h1><div>{''.join(f'<p>{p}</p>' for p in body)}</div></div><div><p>All rights reserved by {host}</p></div></body>"
    else:
        html = f"<body><table><tr><td><ul>{links}</ul></td><td><h1>{words(4, 'h')}</h1>{''.join(f'<p>{p}</p>' for p in body)}</td></tr></table><div>{notice}</div></body>"
    return html, "\n".join([words(4, "h"), *body])


def test_wrappers_decide_where_nothing_is_named(spark):
    """Without what the host's other pages say the texts differ; with it they are right. Equal pages, however many, and a
    page alone on its host say nothing new."""
    rows = [(f"http://{host}.com/{i}", *news(i, host)) for host in ("one", "two") for i in range(12)]
    copies = [rows[3]] * 40
    df = spark.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate([*rows, *copies])], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in wrappers.extract(df).collect()}
    for i, (u, _, want) in enumerate([*rows, *copies]):
        assert got[i] == want, u
    # each page a host of its own: nothing can be learnt from the others
    alone = {r["page_id"]: r["text"] for r in wrappers.extract(df.withColumn("url", F.concat(F.lit("http://h"), F.col("page_id").cast("string"), F.lit(".com/")))).collect()}
    assert sum(alone[i] != got[i] for i in range(24)) >= 12


def test_wrappers_of_a_hot_host_and_of_streams_that_differ(spark):
    """More streams than one task aligns; deep nesting; a host of pages with little in common; pages without a host."""
    rng = random.Random(1)
    tags = ["p", "h2", "div", "section", "pre", "blockquote"]
    rows = []
    for i in range(300):
        inner = "".join(f"<{t}>w{i} {j} x</{t}>" for j, t in enumerate(rng.choice(tags) for _ in range(8)))
        rows.append(("http://hot.com/a", f"<body><nav><ul><li>n</li></ul></nav><article>{inner}</article><footer>f</footer></body>", "\n".join(f"w{i} {j} x" for j in range(8))))
    rows += [(None, f"<article><p>a{i}</p><h2>b</h2></article>", f"a{i}\nb") for i in range(20)]
    rows += [("http://odd.com/", "<article>" + f"<{t}>" * 30 + "<p>x</p>" + f"</{t}>" * 30 + "</article>", "x") for t in tags[2:]]
    rows.append(("http://deep.com/", "<article>" + "<div>x" * 20_000, "\n".join(["x"] * 20_000)))
    df = spark.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate(rows)], "page_id long, url string, html string")
    begin = time.monotonic()
    got = {r["page_id"]: r["text"] for r in wrappers.extract(df).collect()}
    assert time.monotonic() - begin < 90
    for i, (u, _, want) in enumerate(rows):
        assert got[i] == want, (i, u)


def irregular(i, blocks):
    """A page of so many blocks in no order, between a notice and a line that all pages of the host have; nothing is named."""
    rng = random.Random(i)
    kinds = ["<p>{}</p>", "<h2>{}</h2>", "<pre>{}</pre>", "<blockquote>{}</blockquote>", "<ul><li>{}</li></ul>", "<section><p>{}</p></section>"]
    texts = [f"words of page {i} and block {j} {rng.randrange(10**6)}" for j in range(blocks)]
    inner = "".join(rng.choice(kinds).format(t) for t in texts)
    return f"<body><div><p>{'This site keeps data on your device. ' * 9}</p></div><div>{inner}</div><div><p>All rights are ours.</p></div></body>", "\n".join(texts)


def test_wrappers_of_long_irregular_pages(spark):
    """A stream's length decides nothing: the host tells notice from article on pages of 40 blocks and of 1500."""
    for blocks in (40, 130, 1500):
        rows = [irregular(i, blocks) for i in range(12)]
        df = spark.createDataFrame([(i, "http://long.com/", h) for i, (h, _) in enumerate(rows)], "page_id long, url string, html string")
        got = {r["page_id"]: r["text"] for r in wrappers.extract(df).collect()}
        assert [i for i, (_, want) in enumerate(rows) if got[i] != want] == [], blocks


def test_menus_go_at_any_depth(spark):
    """Elements count however deep they are, for names and for what the host's pages have in common."""
    deep = lambda i: "<div>" * 200 + f"<nav><ul><li>menu {i}</li></ul></nav><div><p>the same on every page of this host</p></div><div><p>text {i} of this page and of no other</p></div>" + "</div>" * 200
    df = spark.createDataFrame([(i, "http://deep.com/", f"<body>{deep(i)}</body>") for i in range(6)], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in wrappers.extract(df).collect()} == {i: f"text {i} of this page and of no other" for i in range(6)}


def test_every_template_of_a_host_has_one_wrapper(spark):
    """64 templates of two variants each: more than a task aligns at once, and no two variants need meet by chance. In the end
    no two wrappers would become one."""
    page = lambda t, v: "".join(f"<div class='{'abcdefgh'[t % 8]}{'abcdefgh'[t // 8]}{'klmnop'[j]}'><p>x</p></div>" for j in range(6)) + ("<h2>y</h2>" if v else "")
    rows = []
    for n, (t, v) in enumerate((t, v) for t in range(64) for v in range(2)):
        w = wrappers.fold(wrappers.read(wrappers.Page(page(t, v)).symbols))
        counts = wrappers.labels(w)
        rows.append(("h.com", n, n, wrappers.pack(w), counts.total(), wrappers.sketch(counts)))
    schema = "host string, skey long, key long, wrapper string, nodes long, marks array<long>"
    # as sketches deal them; and with sketches that say nothing, so that blocks have to find what belongs together
    for marks in (F.col("marks"), F.array(*[F.col("key")] * wrappers.SKETCHES)):
        route, found = wrappers.infer(spark.createDataFrame(rows, schema).withColumn("marks", marks))
        to = {r["skey"]: r["key"] for r in route.collect()}
        assert all(to[2 * t] == to[2 * t + 1] for t in range(64)) and len(set(to.values())) == 64 == found.count()
        end = [wrappers.Candidate(r["wrapper"], wrappers.labels(wrappers.unpack(r["wrapper"])), 20) for r in found.collect()]
        assert all(wrappers.together(a, b) is None for i, a in enumerate(end) for b in end[:i])


def test_alignment_by_rows_is_that_of_the_table():
    rng = random.Random(3)
    kinds = ["p", "h2", "div", "div.a", "section", "#"]
    node = lambda: wrappers.Node(rng.choice(kinds), parts=[wrappers.Node(rng.choice(kinds)) for _ in range(rng.randrange(3))])
    for _ in range(60):
        x, y = ([node() for _ in range(rng.randrange(1, n))] for n in (90, 60))
        assert wrappers._pairs_by_rows(x, y) == wrappers._pairs(x, y)


def test_figures_by_brute_force(spark):
    """Of pages with repeated texts in a slot, texts without a slot, and no texts at all."""
    rng = random.Random(4)
    rows = [(rng.randrange(3), [(rng.randrange(-1, 4), rng.randrange(5), rng.randrange(9), rng.randrange(3)) for _ in range(rng.randrange(8))]) for _ in range(200)]
    df = spark.createDataFrame([(k, *([x[i] for x in t] for i in range(4))) for k, t in rows], "key long, slots array<int>, hashes array<long>, chars array<int>, links array<int>").repartition(7)
    want = {}
    for n, (k, texts) in enumerate(rows):
        for slot, h, chars, links in texts:
            if slot >= 0:
                f = want.setdefault((k, slot), [set(), set(), set(), 0, 0])
                f[0].add(n), f[1].add(h), f[2].add((n, h))
                f[3:] = [f[3] + chars, f[4] + links]
    got = {(r["key"], r["slot"]): wrappers.Figures(*(r[c] for c in wrappers.Figures._fields)) for r in wrappers.gather(df).collect()}
    assert got == {k: wrappers.Figures(len(a), len(b), len(c), d, e) for k, (a, b, c, d, e) in want.items()}


def test_topk(spark):
    rows = [(i, [((i * 37 + j * 11) % 19 - 9) / 10 for j in range(8)]) for i in range(400)]
    rows += [(1000 + i, [0.5] * 8) for i in range(60)] + [(2000, None), (2050, [None] + [1.0] * 7), (2100, [float("nan")] * 8), (2150, [float("inf")] * 8), (2200, [1.0] * 3), (3000, []), (0, rows[0][1])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    got = Counter(map(tuple, topk.search(df, F.col("vec_id") % 50 == 0, k=5).collect()))
    import math

    good = {(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = Counter()
    for i, v in good:
        if i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, u, strict=True)), j) for j, u in good if j != i and len(u) == len(v))[:5]
            want.update((i, r + 1, j, -s) for r, (s, j) in enumerate(best))
    assert got == want
    assert topk.search(df.filter("false"), F.lit(True)).collect() == []
