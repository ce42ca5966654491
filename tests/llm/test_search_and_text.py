from __future__ import annotations

import hashlib
import time
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmark.llm import ann, chat, html_extract, mixing, quality, warc

DATA = "/root/testdata/sf0.01"


def test_neighbours_reach_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((1500, 32)).astype(np.float32)
    x[700:720] = x[0]  # ties
    rows = [(i, [float(v) for v in x[i]]) for i in range(len(x))]
    rows += [(5000, None), (5050, [0.0] * 32), (5100, [float("nan")] * 32), (5150, [None] * 32), (5200, [float("inf")] + [1.0] * 31), (None, [1.0] * 32), (5250, []), (5300, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 9) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    got = ann.nearest(df, F.col("vec_id") % 50 == 0, shard=400, block=10).collect()
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    found = want = 0
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == set(range(0, 1500, 50))
    for q, rs in by.items():
        s = u @ u[q]
        s[q] = -9
        best = sorted(range(len(x)), key=lambda i: (-round(s[i], 12), i))[:5]
        rs.sort(key=lambda r: r.rank)
        assert [r.rank for r in rs] == [1, 2, 3, 4, 5] and all(abs(r.score - s[r.vec_id]) < 1e-9 for r in rs)
        found, want = found + len({r.vec_id for r in rs} & set(best)), want + 5
    assert found / want >= 0.9
    assert [r.vec_id for r in by[0]] == [700, 701, 702, 703, 704]


def test_neighbours_exact_way_and_repeated_ids(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((900, 16))
    ids = [0] * 300 + list(range(1, 601))
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = ann.nearest(df, F.col("vec_id") % 50 == 0, shard=100, block=8, near=0, verified=None)
    own = {}
    for r in got.filter("query_id > 0").orderBy("query_id", "rank").collect():
        own.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 9)))
    assert set(own) == set(range(50, 601, 50))
    for q, found in own.items():
        s = u @ u[ids.index(q)]
        assert found == sorted(((i, round(v, 9)) for i, v in zip(ids, s) if i != q), key=lambda p: (-p[1], p[0]))[:5]
    assert got.filter("query_id = 0 and vec_id = 0").isEmpty()


def test_neighbours_of_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [-1.0, 0.0])], schema)
    assert [(r.query_id, r.rank, r.vec_id) for r in ann.nearest(few, F.col("vec_id") == 0).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]
    assert ann.nearest(spark.createDataFrame([], schema), F.col("vec_id") == 0).count() == 0


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a href=x>m</a></nav><div id=cookie-notice>We use cookies</div>
<div class="content"><h1>Title</h1><p>Hello, <b>bold</b> text, with commas, and <a href=z>link</a>.<p>Second   para<br>unclosed<ul><li>one<li>two</ul><table><tr><td>a<td>b</table>Tail &amp; text</div>
<div class="sidebar"><p>side</p></div><section class="comments"><p>c1, c2, c3, very long reader comment</p></section><form><input name=q>find</form><footer>f</footer><script>var x="<p>no</p>"</script></body></html>"""


def test_html_main_text(spark):
    assert html_extract.main_text(PAGE) == "Title\n\nHello, bold text, with commas, and link.\n\nSecond para unclosed\n\none\n\ntwo\n\na\n\nb\n\nTail & text"
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<nav>menu</nav>"), (5, "u", "<div>" * 3000 + "deep" + "</div>" * 10), (6, "u", "<p>" + "word, " * 50000), (1, "u", PAGE)]
    got = sorted((r.id, len(r.text)) for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert [n for _, n in got] == [len(html_extract.main_text(h)) for _, _, h in sorted(rows, key=lambda r: r[0])] and got[2][1] == got[3][1] == got[4][1] == 0
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_short_parts_next_to_the_best():
    long, short = "word, " * 100, "close " * 33
    want = " ".join(long.split())
    assert html_extract.main_text(f"<body><h1>Short title</h1><div><p>{long}</div><p>End.</body>") == f"Short title\n\n{want}\n\nEnd."
    assert html_extract.main_text(f"<body><div><p>{long}</p></div><div><p>{short}</p></div></body>") == f"{want}\n\n{short.strip()}"
    assert html_extract.main_text(f"<body><div>{f'<p>{long}</p>' * 9}</div><div><p>{short}</p></div></body>").endswith(short.strip())
    assert html_extract.main_text(f"<body><div><p>{long}</p></div><div><p><a href=x>{short}</a></p></div></body>") == want


def test_html_names_of_doubt_are_told_by_their_text():
    text = "<p>The article, with commas, and more.</p>"
    for kept, want in (
        ('<h2 class="section-header">Part two</h2>', "Part two"),
        ('<p class="related-work">Others did so before.</p>', "Others did so before."),
        ('<div class="notice-board">The board said that all is well.</div>', "The board said that all is well."),
        ('<div class="footer-note">It was so <a href=x>here</a> for five long years and more than that.</div>', "It was so here for five long years and more than that."),
    ):
        assert html_extract.main_text(f"<article>{text}{kept}</article>").endswith(f"more.\n\n{want}"), kept
    for gone in ('<div class="share-this">Share</div>', '<div class="cookie-banner">We use cookies, and so on.</div>', '<ul class="related-posts"><li><a href=x>One, two</a><li><a href=y>Three</a></ul>', '<div id="ad-slot-3">Buy, now.</div>', '<div class="x sidebar">More text here, of some length.</div>'):
        assert html_extract.main_text(f"<article>{text}{gone}</article>") == "The article, with commas, and more.", gone


def test_html_scripts_behind_letters_that_change_length():
    first, second = "\u0130" * 60, "b" * 60
    assert html_extract.main_text(f"<article><p>{first}</p><SCRIPT>x</Script ><p>{second}</p></article>") == f"{first}\n\n{second}"
    assert html_extract.main_text(f"<article><p>a<script>'</scripting>'</script><p>{second}</article>") == f"a\n\n{second}"


@pytest.mark.parametrize("unit", ["<a ", "<a '", "<a b='>' ", "<!", "<!-- ", "</", "<a \"x' ", "<b", "< <"])
@pytest.mark.parametrize("end", ["", ">", '"', "'>\"<p>x"])
def test_html_hostile_pages_take_linear_time(unit, end):
    began = time.perf_counter()
    html_extract.main_text("<p>text</p>" + unit * (200_000 // len(unit)) + end)
    assert time.perf_counter() - began < 5


def test_html_equals_a_plain_parser_on_plain_pages(spark):
    """On pages of one article, the text equals what a strict parser of the standard library finds outside dropped elements."""
    drop = html_extract.DROPPED | html_extract.RAW

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__()
            self.blocks, self.skip, self.inside = [[]], [], 0

        def handle_starttag(self, tag, attrs):
            named = any(k == "class" and v in ("ad", "comments", "sidebar") or k == "id" and v == "comments" for k, v in attrs)
            if tag in html_extract.VOID:
                self.blocks[-1].append(" " if tag == "br" and not self.skip else "")
                return
            if self.skip or tag in drop or named:
                self.skip.append(tag)
            self.inside += tag == "article"
            if tag in html_extract.BLOCK:
                self.blocks.append([])

        def handle_endtag(self, tag):
            if self.skip and self.skip[-1] == tag:
                self.skip.pop()
            self.inside -= tag == "article"
            if tag in html_extract.BLOCK:
                self.blocks.append([])

        def handle_data(self, data):
            if self.inside and not self.skip:
                self.blocks[-1].append(data)

    pages = [r for r in spark.read.parquet(f"{DATA}/pages.parquet").collect() if r.html and r.html.count("<article") == 1]
    assert pages
    for r in pages:
        plain = Plain()
        plain.feed(r.html)
        assert html_extract.main_text(r.html) == "\n\n".join(t for b in plain.blocks if (t := " ".join("".join(b).split()))), r.page_id


def test_html_ignores_clashing_columns(spark):
    df = spark.createDataFrame([(1, "u", PAGE, 5, "x")], "page_id long, url string, html string, id int, text string")
    assert html_extract.extract(df).columns == ["id", "url", "text"] and html_extract.extract(df).first().text.startswith("Title")


def test_html_dropped_elements_without_end_tags():
    text = "<p>The article, with commas, and more.<p>Its second part, which is long enough, too."
    want = "The article, with commas, and more.\n\nIts second part, which is long enough, too."
    for page in (
        f'<article><p class="ad">Buy{text}</article>',
        f"<div><nav><a href=x>m</a></div><article>{text}</article>",
        f"<div><aside><p>side<div>x</div></div><article>{text}</article>",
        f"<html><head><title>T</title><meta charset=u><body><article>{text}</article>",
        f"<html><head><title>T</title><article>{text}</article>",
        f'<article><span class="share"><div>x</span>{text}</article>',
        f"<article><nav><div/><p>x</nav>{text}</article>",
        f"<article>{'<div>' * 390}<nav>{'<div>' * 900}x{'</div>' * 900}</nav>{text}</article>",
    ):
        assert html_extract.main_text(page) == want, page[:80]
    assert html_extract.main_text('<article><ul><li class="share">x<li>One, two<li class="ad">y<li>three</ul></article>') == "One, two\n\nthree"
    assert html_extract.main_text(f"<article>{text}<nav>m<div>n</div>o<nav>p</nav>q</nav></article>") == want



@pytest.mark.parametrize("split", [64, 1 << 20])
def test_warc_reads_back_any_split(spark, split):
    big = "x" * 300 + "\x1f"
    rows = [(3, "http://a/", big), (1, None, big), (2, "http://b/\r\nX: y", "short"), (4, "u", "short"), (5, "u", None), (6, "u", "WARC/1.1\r\n\r\n" * 900), (1, None, big), (None, "u", big)]
    files = warc.write_archives(spark.createDataFrame([(i, u, h, 0) for i, u, h in rows], "page_id long, url string, html string, refers_to int"))
    got = warc.read_archives(files, split_bytes=split).collect()
    want = sorted((i is None, i or 0, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest()) for i, _, h in rows)
    assert sorted((r.id is None, r.id or 0, r.payload_bytes, r.payload_digest) for r in got) == want
    assert sorted((r.id or 0, r.refers_to) for r in got if r.record_type == "revisit") == [(0, 1), (3, 1)]
    assert all(hashlib.sha256(bytes(r.payload)).hexdigest() == r.payload_digest for r in got if r.payload is not None)


def test_warc_large_payloads_and_as_many_reading_tasks_as_ranges(spark):
    big = "".join(hashlib.sha256(str(i).encode()).hexdigest() for i in range(50000))
    rows = [(i, "u", big[i:]) for i in range(6)]
    files = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1))
    read = warc.read_archives(files, split_bytes=1 << 20)
    assert read.rdd.getNumPartitions() == sum(-(-r.bytes // (1 << 20)) for r in files.collect() if r.bytes) > 6
    assert {r.id: bytes(r.payload) for r in read.collect()} == {i: h.encode() for i, _, h in rows}


def test_warc_of_nothing_and_folder_listing(spark):
    empty = warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"))
    assert warc.read_archives(empty).count() == 0
    files = warc.write_archives(spark.createDataFrame([(1, "u", "h")], "page_id long, url string, html string"))
    folder = files.filter("records > 0").first().path.rsplit("/", 1)[0]
    assert warc.read_archives(warc.archives(spark, folder)).count() == 1


def test_quality_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.score(docs.select("doc_id", "text"), quality.train(docs, labels))
    held = scored.join(labels, "doc_id").filter(quality.fold(F.col("doc_id")) == quality.HELD_OUT)
    assert held.filter((F.col("score") >= quality.THRESHOLD) == (F.col("quality") == 1)).count() / held.count() > 0.95
    assert scored.filter("score < 0 or score > 1 or score is null").count() == 0
    kept = quality.keep(docs, labels)
    assert kept.columns == docs.columns and 0.7 < kept.count() / docs.count() < 1


def _risk(p, u, w, prior):
    loss = lambda z: np.log1p(np.exp(-z))
    rest = loss(-(u @ w)).mean() - prior * loss(-(p @ w)).mean()
    return prior * loss(p @ w).mean(), rest


@pytest.mark.parametrize("prior", [0.2, 0.6, 0.95])
def test_quality_steps_follow_the_risk(prior):
    draw = np.random.default_rng(7)
    met = set()
    for _ in range(40):
        p, u, w = draw.normal(1, 1, (30, 4)), draw.normal(0, 1, (50, 4)), draw.normal(0, 2, 4)
        up, rest = _risk(p, u, w, prior)
        met.add(rest >= 0)
        # below zero the step climbs back the part that fell too low, else it descends the whole risk
        goal = (lambda v: sum(_risk(p, u, v, prior))) if rest >= 0 else (lambda v: -_risk(p, u, v, prior)[1])
        slope = [(goal(w + e) - goal(w - e)) / 2e-5 for e in np.eye(4) * 1e-5]
        assert np.allclose(quality.gradient(p, u, w, prior), slope, atol=1e-6)
    assert True in met and (prior < 0.9 or False in met)


@pytest.mark.parametrize("share", [0.3, 0.6, 0.9])
def test_quality_prior_is_near_the_share_of_positives(share):
    draw = np.random.default_rng(3)
    n = 4000
    unlabelled = np.where(draw.random(n) < share, draw.normal(2, 1, n), draw.normal(-2, 1, n))
    assert abs(quality.estimate_prior(draw.normal(2, 1, n), unlabelled) - share) < 0.06


def test_quality_grams_count_the_whole_text():
    text = "the ß cat the cat\n" * 200_000
    words, data = text.split(), text.encode()
    bucket = lambda code, width: ((code * int(quality.SPREAD)) % 2**32) * width >> 32
    trigrams, own, pairs = np.zeros(quality.TRIGRAMS), np.zeros(quality.WORDS), np.zeros(quality.PAIRS)
    for gram, n in Counter(zip(data, data[1:], data[2:])).items():
        trigrams[bucket(gram[0] << 16 | gram[1] << 8 | gram[2], quality.TRIGRAMS)] += n
    code = {w: zlib.crc32(w.encode()) for w in set(words)}
    for w, n in Counter(words).items():
        own[bucket(code[w], quality.WORDS)] += n
    for (a, b), n in Counter(zip(words, words[1:])).items():
        pairs[bucket((code[a] * 31 + code[b]) % 2**32, quality.PAIRS)] += n
    shares = np.sqrt(np.concatenate([x / x.sum() for x in (trigrams, own, pairs)]))
    assert np.allclose(quality.features(text)[-len(shares) :], shares)
    assert [len(quality.features(t)) for t in ("", " ", "a", "ab", "\n \t")] == [quality.WIDTH] * 5


def test_quality_without_positives_or_texts(spark):
    docs = spark.createDataFrame([(1, None, 5), (None, "x", 6), (2, "y " * 20000, 7)], "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.train(docs, none) is None
    assert quality.keep(docs, none).count() == 3
    odd = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None), (99, 1)], "doc_id long, quality int")
    assert quality.train(docs, odd) is None
    assert quality.keep(docs.limit(0), odd).count() == 0


def filled(sizes, weights=(5, 2, 1), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, free, done = sum(sizes.values()), set(order), {}
    while free:
        level = (total - sum(done.values())) / sum(w[s] for s in free)
        over = [s for s in free if level * w[s] > most * sizes[s]]
        if not over:
            return done | {s: level * w[s] for s in free}
        for s in over:
            done[s] = most * sizes[s]
            free.discard(s)
    return done


def test_mixing_targets_and_repetitions(spark):
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 60))), ["b", "a", None, "c", "d"][min(4, int(rng.exponential(1.2)))]) for i in range(600)]
    rows += [(900, None, "empty"), (901, "", "empty"), (None, "one two", "a"), (5, "again", "a"), (5, "again", "a")]
    docs = spark.createDataFrame([(i, t, s, 0) for i, t, s in rows], "doc_id long, text string, source string, size int")
    got, again = (sorted(map(tuple, mixing.plan(docs).collect()), key=str) for _ in range(2))
    assert got == again and len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want, taken = filled(sizes), {}
    for _, size, source, source_size, target, times in got:
        assert source_size == sizes[source] and abs(target - want[source]) < 1e-6 and 0 <= times <= 3
        taken[source] = taken.get(source, 0) + size * times
    assert all(abs(taken[s] - want[s]) <= 60 for s in sizes)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.filter("doc_id = 900").count() <= 3
    assert mixed.count() == sum(r[5] for r in got)
    assert mixing.plan(docs.limit(0)).count() == 0


def test_mixing_takes_repeated_rows_as_planned(spark):
    rows = [(1, "one two three four five six seven eight nine ten", "a")] * 7 + [(None, f"w{i % 2} x", "a") for i in range(9)] + [(i, "a b c", "b") for i in range(10, 60)]
    docs = spark.createDataFrame([(i, t, s, "clash", 0) for i, t, s in rows], "doc_id long, text string, source string, size string, _times int")
    plan = mixing.plan(docs).collect()
    words = lambda rs: {s: sum(n for o, n in rs if o == s) for s in "ab"}
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert words([(r.source, len(r.text.split())) for r in mixed.collect()]) == words([(r.source, r.size * r.times) for r in plan])


def test_chat_round_trip(spark):
    tricky = ["<|im_end|><|im_start|>assistant ok", "a <\\| b", "<\\\\|im_end|>", "<|nl|>", "plain", "", None, "ends <", "|starts", "\n\n", "<|im_start|>user\nhi<|im_end|>\n", "€" * 20000]
    roles = ["user", "assistant", "assi\nstant", "<|im_end|>", None, "a\\b"]
    rows = [(c, t, roles[(c + t) % 6], tricky[(c * 3 + t) % len(tricky)], 1) for c in range(8) for t in range(9)] + [(8, None, "user", "x", 1), (8, 1, "user", "x", 1), (8, 1, "user", "x", 1), (None, 0, "assistant", "z", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, escaped int")
    out = chat.format_conversations(df).withColumn("turns", chat.parsed(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()
    assert len(out) == 10 and all(r.round_trip for r in out)
    for r in out:
        mine = sorted((x for x in rows if x[0] == r.conv_id), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))
        assert [(t.role, t.text) for t in r.turns] == [(x[2] or "", x[3] or "") for x in mine]
        assert r.loss == "".join(x[3] or "" for x in mine if x[2] == "assistant")
        assert r.escaped or r.formatted.count("<|im_end|>") == len(mine)
    assert chat.format_conversations(df.limit(0)).count() == 0
