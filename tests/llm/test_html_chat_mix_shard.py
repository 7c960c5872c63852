"""HTML extraction, chat collapse, mixing and sharding."""

import html
import re
import zlib

import pytest
from pyspark.sql import functions as F

from glyphward.llm import queries as q
from glyphward.llm.chat_collapse import collapse_and_render, cut_conversations, dealt, prefix_hashes
from glyphward.llm.html_paths import _Page, extract_main_text, main_text, path_ratios
from glyphward.llm.mixing_ipf import calibrated, cell, marginal_gap, marginal_targets, mix, rake
from glyphward.llm import sharding
from glyphward.llm.sharding import _key, fine_ranges, records, shard_by_bytes, splitters
from glyphward.llm.tables import save

PAGES = [
    (None, ""),
    ("", ""),
    ("<html><script>if (a < b) { '</p>' }</script></html>", ""),
    ("<p>only", "only"),
    ("plain &amp; text", "plain & text"),
    ("<body><header><a href=x>Home</a></header><div id=main-menu><ul><li>a</li></ul></div><div class=post><h2>Title here</h2><p>First para, with &lt;b&gt;.</p><p>Short.</p><div class='advert'>Buy now.</div></div><div id='comments'><p>Nice post, thank you very much indeed.</p></div><form>Enter your mail, please.</form></body>", "Title here\nFirst para, with <b>.\nShort."),
    ("<nav>menu</nav><article><h1>A\n\n  b</h1><p><b>x<br><p>y&nbsp;&nbsp;z</p><aside>no</aside><ul><li>one<li>two</ul></article><footer>f</footer>", "A b\nx\ny z\none\ntwo"),
    ("<article><p>in <!-- <p>not</p> --> text</p><div hidden>secret</div><div role=navigation>nav</div></article>", "in text"),
]


@pytest.mark.parametrize(("page", "want"), PAGES)
def test_pages(page, want):
    assert main_text(page) == want


SKIPPED_PAGES = [
    ("<main><h1>T</h1><video></video><p>long text</p><p>more</p></main>", "T\nlong text\nmore"),
    ("<body><button>Menu</button><main><p>One, two.</p><svg><path d='M0'/><text>no</text></svg><p>Three.</p></main></body>", "One, two.\nThree."),
    ("<select><option>a<option>b</select><article><p>One, two.</p><select><option>c</option></select><p>Three.</p></article>", "One, two.\nThree."),
    ("<svg/><article><p>One, <button><div>no</div></button>two.</p><video><p>no</video><p>Three.</p></article>", "One,\ntwo.\nThree."),
    ("<article><p>One.</p>" + "".join(f"<{t}>no</{t}>" for t in "template math canvas object audio video select option button datalist".split()) + "<p>Two.</p></article>", "One.\nTwo."),
]


@pytest.mark.parametrize(("page", "want"), SKIPPED_PAGES)
def test_skipped_elements_end(page, want):
    assert main_text(page) == want


LONG = "<p>" + "One, two. " * 40 + "</p>"
UNEVEN_PAGES = [
    f"<body><div id=content><section>{LONG * 4}</section><section>{LONG}<p>End.</p></section></div></body>",
    f"<body><article>{LONG * 4}</article><article>{LONG}<p>End.</p></article></body>",
    f"<table><tr><td>{LONG * 4}<td>{LONG}</table>",
    f"<body><div><h1>Title</h1><p>By name</p><div>{LONG * 5}</div></div></body>",
    f"<body><div><h2>Title</h2><div>{LONG * 5}</div></div></body>",
    f"<body><div>{LONG * 4}<h1>Part two</h1></div><div>{LONG}</div></body>",
]


@pytest.mark.parametrize("page", UNEVEN_PAGES)
def test_all_content_stays(page):
    want = [" ".join(x.split()) for x in re.split("<[^>]*>", page)]
    assert main_text(page) == "\n".join(x for x in want if x)
    assert main_text(f"<nav>menu</nav>{page}<footer>f</footer>") == main_text(page)


def test_what_lies_beside_the_content_goes():
    page = f"<body><ul><li><a href=x>Home</a><li><a href=y>Shop</a></ul><div><h1>Title</h1>{LONG * 6}</div><ul><li>x<li>y</ul></body>"
    assert main_text(page) == "\n".join(["Title", *["One, two. " * 39 + "One, two."] * 6])


@pytest.mark.parametrize("mark", ["class='layout has-sidebar'", "class='no-sidebar'", "id='page-with-nav'", "class=post-with-comments", "class='sidebar-right layout'", "id=notice"])
def test_a_name_does_not_hide_the_page(mark):
    inner = f"<h1>Title</h1>{LONG * 3}<div class='share'>Share this.</div><div id=comments><p>Nice post, thanks.</p></div>"
    want = "\n".join(["Title", *["One, two. " * 39 + "One, two."] * 3])
    for page in (f"<body><div {mark}>{inner}</div></body>", f"<section {mark}><article>{inner}</article></section>", f"<div class=widget><div {mark}>{inner}</div></div>"):
        assert main_text(page) == want
    assert main_text(f"<body><div {mark}>{inner}</div><div class=sidebar>{LONG}</div></body>") == want


def test_names_hide_lesser_parts():
    page = f"<body><div class=nav>Home, shop.</div><div>{LONG * 2}</div><div class=sidebar>{LONG}</div><div class=no-ads>{LONG}</div></body>"
    assert main_text(page).count("\n") == 2
    assert main_text("<div class=ad>Buy this, buy that, buy it now.</div><article><p>A b.</p></article>") == "A b."
    assert main_text("<div class=ad>Buy this, buy that, buy it now.</div><div class=sidebar-left><article><p>A b.</p></article></div>") == "A b."
    assert main_text("<div class=ad hidden>Buy.</div>") == ""


REMARKS = ["class=comments", "class='user-comments'", "class='reader-comments'", "id=disqus_thread", "class=postComments", "id=comments-12 class=list", "itemprop=comment", "itemtype='https://schema.org/Comment'"]


@pytest.mark.parametrize("mark", REMARKS)
@pytest.mark.parametrize("number", [2, 300])
def test_comments_go_however_many(mark, number):
    story = f"<h1>Title</h1>{LONG * 3}"
    remarks = f"<section {mark}><h3>What readers say</h3>{LONG * number}</section>"
    want = main_text(story)
    assert want.startswith("Title") and want.count("\n") == 3
    for page in (f"<article>{story}{remarks}</article>", f"<div><div class=story>{story}</div>{remarks}</div>", f"<main><article>{story}</article><div>{remarks}</div></main>"):
        assert main_text(page) == want


def test_comments_that_are_articles():
    remarks = f"<article class=comment>{LONG}</article>" * 5
    assert main_text(f"<main><article>{LONG * 3}</article>{remarks}</main>") == main_text(LONG * 3)
    assert main_text(f"<div class=comments>{LONG * 3}</div>") == main_text(LONG * 3)  # nothing else is there
    assert main_text(f"<main><article>{LONG * 3}</article><div class=relatedPosts>{LONG}</div></main>").count("\n") == 2


def test_page_query(spark, sf_dir):
    got = {r["page_id"]: r for r in q.QUERIES["op7_html_extraction"](spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        article = re.search(r"(?s)<article>(.*?)</article>", r["html"])[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x.replace("<b>", ""))).split()) for x in re.split("</?p>|</?h1>", article)]
        want = "\n".join(b for b in blocks if b)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want) and got[r["page_id"]]["url"] == r["url"]
    empty = spark.createDataFrame([(1, "u", None, "x")], "page_id long, url string, html string, text string")
    assert tuple(extract_main_text(empty).first()) == (1, "u", "", 0) and extract_main_text(empty.limit(0)).isEmpty()


def test_conversations(spark):
    rows = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "yo"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo"), (3, 2, "user", "more"), (4, 0, "user", "hi"), (4, 1, "assistant", "yo"), (4, 2, "user", "more"), (5, 0, "user", "yo"), (6, 0, "user", None), (7, 0, "user", ""), (8, 1, "assistant", "yo"), (8, 0, "user", "other"), (None, 0, "user", "hi"), (5, 0, "user", "yo")]
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, copies string")
    got = {r["conv_id"]: r for r in collapse_and_render(table).collect()}
    assert set(got) == {3, 5, 6, 7, 8} and got[3]["copies"] == 2 and got[3]["n_turns"] == 3
    assert got[8]["text"] == "<|user|>\nother<|end|>\n<|assistant|>\nyo<|end|>\n" and got[6]["text"] == "<|user|>\n<|end|>\n"
    assert collapse_and_render(table.limit(0)).isEmpty()


def test_null_texts_differ_from_all_others(spark):
    rows = [(1, 0, "user", None), (2, 0, "user", "\x00"), (2, 1, "a", "x"), (3, 0, None, "q"), (4, 0, "\x00", "q"), (4, 1, "a", "x"), (5, 0, "user", ""), (6, 0, None, None), (6, 1, "a", "b"), (7, 0, None, None)]
    got = {r["conv_id"] for r in collapse_and_render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {1, 2, 3, 4, 5, 6}


def test_a_long_conversation_and_its_snapshots(spark):
    turns = [(c, i, "user", f"turn {i}") for c, n in ((1, 3000), (2, 2999), (3, 1500), (4, 3000)) for i in range(n)]
    rows = collapse_and_render(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    assert [(r["conv_id"], r["n_turns"], r["copies"], r["text"].count("<|user|>")) for r in rows] == [(1, 3000, 2, 3000)]


def test_conversations_in_many_ranges(spark):
    import random

    rng = random.Random(11)
    logs = {c: [(rng.choice("ua"), rng.choice(("x", "y", None))) for _ in range(n)] for c, n in ((1, 700), (2, 3), (5, 1), (9, 400))}
    logs |= {3: logs[1][:699], 4: logs[1][:350], 6: logs[2][:2], 7: list(logs[1]), 8: logs[1][:350] + logs[9], 10: logs[9][:399] + [("u", "z")]}
    turns = spark.createDataFrame([(c, i // 2, f"{i % 2}{role}", text) for c, log in logs.items() for i, (role, text) in enumerate(log)], "conv_id long, turn long, role string, text string")
    ranged = dealt(turns)
    cut = {r["conv_id"] for r in cut_conversations(ranged).collect()}
    assert cut and cut == {r["conv_id"] for r in ranged.groupBy("conv_id").agg(F.count_distinct("range").alias("n")).where("n > 1").collect()}
    last = {r["conv_id"]: r["place"] for r in prefix_hashes(ranged).where("last").collect()}
    assert last == {c: len(log) for c, log in logs.items()}
    got = {r["conv_id"]: (r["n_turns"], r["copies"]) for r in collapse_and_render(turns).collect()}
    whole = {c: tuple(log) for c, log in logs.items()}
    kept = {c for c, log in whole.items() if not any(o != log and o[: len(log)] == log for o in whole.values())}
    assert got == {c: (len(whole[c]), sum(o == whole[c] for o in whole.values())) for c in kept if c == min(o for o in whole if whole[o] == whole[c])}


def test_raking_reaches_the_marginals(spark):
    cells = [("a", "en", "t"), ("a", "de", "u"), ("b", "en", "u"), ("b", "de", "t"), ("b", "fr", "t"), ("c", "en", "t")]
    table = spark.createDataFrame([(*c, 100 * (i + 1)) for i, c in enumerate(cells)], "source string, lang string, topic string, tokens long")
    targets = {"source": {"a": 0.5, "b": 0.3, "c": 0.2}, "lang": {"en": 0.5, "de": 0.4, "fr": 0.1}, "topic": {"t": 0.6, "u": 0.4}}
    rows = rake(table, targets, keep=0.1).toPandas()
    for d, shares in targets.items():
        for value, share in rows.groupby(d).weight.sum().items():
            assert abs(share - shares[value]) < 1e-3


def plain_rake(cells, keep, rounds):
    """Cell by cell, with capped rates."""
    target = {}
    total = sum(cells.values())
    for k in range(3):
        held = {}
        for c, n in cells.items():
            held[c[k]] = held.get(c[k], 0) + n
        low, high = 0.0, 1e18
        for _ in range(300):
            c = (low + high) / 2
            low, high = (c, high) if sum(min(n, c * n**0.75) for n in held.values()) < keep * total else (low, c)
        target[k] = {v: min(n, high * n**0.75) for v, n in held.items()}
    rate = dict.fromkeys(cells, keep)
    for _ in range(rounds):
        for k in range(3):
            given = {}
            for c, n in cells.items():
                given[c[k]] = given.get(c[k], 0) + n * min(1, rate[c])
            rate = {c: r * target[k][c[k]] / given[c[k]] for c, r in rate.items()}
    return {c: min(1, r) for c, r in rate.items()}, target


@pytest.mark.parametrize("small", [0, 10_000])
def test_raking_with_caps(spark, small):
    import random

    rng = random.Random(3)
    cells = {(f"s{i}", f"l{j}", f"t{k}"): int(10 ** rng.uniform(0, 5)) for i in range(7) for j in range(3) for k in range(4) if rng.random() < 0.7}
    table = spark.createDataFrame([(*c, n) for c, n in cells.items()], "source string, lang string, topic string, tokens long")
    rows = rake(table, None, keep=0.6, rounds=6, looks=1, small=small).collect()
    want, target = plain_rake(cells, 0.6, 6)
    assert len(rows) == len(cells)
    for r in rows:
        assert r["probability"] == pytest.approx(want[r["source"], r["lang"], r["topic"]], rel=1e-6)
    got = marginal_targets(table, None, 0.6).collect()
    for r in got:
        assert r["target"] == pytest.approx(target[("source", "lang", "topic").index(r["dimension"])][r["value"]], rel=1e-6)


def test_marginal_gap_at_the_default_rounds(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    cells = save(docs.withColumn("c", cell(docs)).groupBy("c.source", "c.lang", "c.topic").agg(F.sum("c.tokens").alias("tokens")), "test")
    marginals = marginal_targets(cells, None, 0.5)
    assert marginal_gap(rake(cells, None, 0.5), marginals) < 1e-3
    assert marginals.groupBy("dimension").agg(F.sum("target").alias("t")).agg(F.max("t") - F.min("t")).first()[0] < 1e-3


def test_topic_is_a_parameter(spark):
    docs = spark.createDataFrame([(i, "word " * 9, "s", "en", "x") for i in range(50)], "doc_id long, text string, source string, lang string, topic string")
    assert {r[0] for r in calibrated(docs).select("mix.topic").collect()} == {"short prose"}
    assert {r[0] for r in calibrated(docs, kind=F.concat(F.col("topic"), F.lit("!"))).select("mix.topic").collect()} == {"x!"}
    assert mix(docs, kind=F.col("topic")).columns == docs.columns


def test_mixing(spark):
    docs = spark.createDataFrame([(i, "word " * (1 + i % 50), "big" if i % 3 else "small", "en" if i % 2 else None, 1) for i in range(2000)] + [(None, None, None, None, 1), (7, "x", "big", "en", 1)], "doc_id long, text string, source string, lang string, weight int")
    rows = calibrated(docs, keep=0.5).select("mix.*").toPandas()
    assert len(rows) == 2002 and rows.probability.between(0, 1).all()
    assert abs((rows.tokens * rows.probability).sum() / rows.tokens.sum() - 0.5) < 1e-6
    assert abs(rows[rows.drawn].tokens.sum() / rows.tokens.sum() - 0.5) < 0.06
    kept = mix(docs, keep=1.0)
    assert kept.columns == docs.columns and kept.count() == 2002 and mix(docs.limit(0)).isEmpty()


def check_shards(rows, docs, shards, slack):
    assert sorted(rows.doc_id.fillna(-1)) == sorted(-1 if d is None else d for d, _ in docs)
    text = {d: (t or "").encode() for d, t in docs}
    for r in rows.itertuples():
        key = None if r.doc_id != r.doc_id else r.doc_id
        assert r.size_ == len(text[key]) + 16 and r.text_crc32 == zlib.crc32(text[key])
    for _, part in rows.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    sizes = rows.groupby("shard").size_.sum().reindex(range(shards), fill_value=0)
    assert sizes.max() - sizes.min() <= slack


def test_sharding(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows = q.QUERIES["op9_sharding"](spark, sf_dir).toPandas().rename(columns={"size": "size_"})
    assert set(rows.law) == {"bytes"} and rows.grown_shard.isna().all()
    check_shards(rows, docs, 40, 2.1 * max(len((t or "").encode()) + 16 for _, t in docs))


def test_sharding_hot_group(spark):
    docs = [(i, "the same text") for i in range(1500)] + [(-i, f"text {i} " * (i % 9)) for i in range(1, 2000)] + [(None, None)]
    table = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, size int")
    rows = shard_by_bytes(table, 8).toPandas().rename(columns={"size": "size_"})
    check_shards(rows, docs, 8, 2.5 * 0.017 * rows.size_.sum() / 8 + 300)
    pairs = rows[rows.text_crc32 != zlib.crc32(b"the same text")].groupby("text_crc32").shard.nunique()
    assert (pairs == 1).all()  # small groups of equal texts are whole
    assert shard_by_bytes(table.limit(0), 8).isEmpty()


def plain_shards(docs, shards):
    """By one sort: (doc_id, text, shard), sorted."""
    import hashlib

    rows = sorted((hashlib.md5((t or "").encode()).hexdigest(), -1 << 70 if d is None else d, d, t) for d, t in docs)
    sizes = [len((t or "").encode()) + 16 for *_, t in rows]
    total, groups, out, end = sum(sizes), {}, [], 0
    for (digest, *_), n in zip(rows, sizes):
        groups[digest] = groups.get(digest, 0) + n
    ends = {}
    for (digest, *_), n in zip(rows, sizes):
        end += n
        ends[digest] = end
    end = 0
    for (digest, _, d, t), n in zip(rows, sizes):
        end += n
        middle = ends[digest] - groups[digest] / 2 if groups[digest] <= total / 64 / shards else end - n / 2
        out.append((str(d), t or "", min(shards - 1, int(middle * shards / total))))
    return sorted(out)


def test_equal_rows_without_an_id_are_cut(spark):
    docs = [(None, "all the same text")] * 60_000 + [(i, f"text {i % 700} " * (i % 7)) for i in range(20_000)] + [(3, "twice over")] * 9_000
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    keyed = records(table).withColumn("key", _key())
    keyed = save(keyed, "test")
    total = keyed.agg(F.sum("size")).first()[0]
    cuts, sums, hot = fine_ranges(keyed, total, 8)
    assert len(hot) >= 2 and sums.where(F.col("bytes") > 2 * total / (8 * 16)).isEmpty() and len(cuts) < 3 * 8 * 16
    assert sums.agg(F.sum("bytes")).first()[0] == total
    rows = shard_by_bytes(table, 8).toPandas().rename(columns={"size": "size_"})
    text = {zlib.crc32((t or "").encode()): t or "" for _, t in docs}
    got = sorted((str(None if d != d else int(d)), text[c], s) for d, c, s in zip(rows.doc_id, rows.text_crc32, rows.shard))
    assert got == plain_shards(docs, 8)
    for _, part in rows.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))


def test_overfull_ranges_are_subdivided(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SAMPLES_EACH", 0.4)  # so few that ranges come out uneven
    docs = [(i, f"text {i} " * (1 + i % 5)) for i in range(6000)]
    table = save(records(spark.createDataFrame(docs, "doc_id long, text string")).withColumn("key", _key()), "test")
    total = table.agg(F.sum("size")).first()[0]
    first = splitters(table.withColumn("range", F.lit(0)), total / 64, 17)
    cuts, sums, _ = fine_ranges(table, total, 4)
    assert len(cuts) > len(first) and sums.where((F.col("bytes") > 2 * total / 64) & (F.col("n") > 1)).isEmpty()


def test_pipeline_runs(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns)
    assert 0 < out.select("doc_id").distinct().count() < docs.count()
    assert out.join(docs, "doc_id", "left_anti").isEmpty() and out.where(F.col("length") > 4096).isEmpty()


PARA = "A sentence of some length, with a comma, that goes on for a while. And another one follows it here."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<body><p><a href=/>Home</a></p>{f'<p>{PARA}</p>' * 5}<p>Copyright 2020 by us.</p></body>", [PARA] * 5),
        (f"<body><form action=x><div id=nav><a href=a>One</a> <a href=b>Two</a></div><h1>Title</h1>{f'<p>{PARA}</p>' * 4}<div class=footer>Imprint</div></form></body>", ["Title", *[PARA] * 4]),
        (f"<body><form><div><article><h1>T</h1><p>{PARA}</p></article></div></form></body>", ["T", PARA]),
        (f"<article><h1>T</h1><p>{PARA}</p><h2 id='search'>Search trees</h2><p>{PARA}</p><h2 id='related-work'>Related work</h2><p>{PARA}</p></article>", ["T", PARA, "Search trees", PARA, "Related work", PARA]),
        (f"<article><p>{PARA}</p><div class='share-price'>It rose by 3 %.</div><p>{PARA}</p><section id='menu-of-the-day'><p>Soup, then fish.</p></section></article>", [PARA, "It rose by 3 %.", PARA, "Soup, then fish."]),
        (f"<article><p>{PARA}</p><section id=search><h2>Search</h2><p>{PARA}</p></section></article>", [PARA, "Search", PARA]),
        (f"<main><h1>T</h1><p>{PARA}</p><ul><li>one<li>two<li>three</ul><p>{PARA}</p><div class=share>Share this</div><section class=comments><p>{PARA}</p></section></main>", ["T", PARA, "one", "two", "three", PARA]),
        (f"<body><div class=page><div class=main-menu><a href=x>Home</a></div><div class=text><h1>T</h1><p>{PARA}</p><p>Short.</p><p>{PARA}</p><p>End</p></div><div class=site-footer><p>{PARA}</p></div></div></body>", ["T", PARA, "Short.", PARA, "End"]),
        (f"<article><p>{PARA}</p><p><a href=x>A link alone</a></p><p>{PARA}</p><p>All rights reserved.</p></article>", [PARA, "A link alone", PARA, "All rights reserved."]),
    ],
)
def test_paths_decide(page, want):
    assert main_text(page) == "\n".join(want)


def plain_ratios(blocks, parent):
    """Path by path from the definition."""
    out = {}
    for p in {b.path for b in blocks}:
        groups = [[b for b in blocks if b.path == p], [b for b in blocks if parent[b.path] == parent[p]], [b for b in blocks if parent[b.path] == parent[parent[p]]] if parent[p] else []]
        means = [[sum(f(b.text) for b in g) / len(g) if g else 0 for g in groups] for f in (len, lambda t: sum(c in ".,;:!?…。、" for c in t))]
        length, points = (sum(m) / 3 for m in means)
        out[p] = (length * (1 + points)) ** 0.5
    return out


def test_path_ratios_are_those_of_the_definition(sf_dir):
    import pyarrow.parquet as pq

    pages = pq.read_table(f"{sf_dir}/pages.parquet").column("html").to_pylist()[:20] + [f"<div><p>{PARA}<ul><li>a, b<li><a>c</a></ul><table><tr><td>x<td>{PARA}</table></div>", "<p>a<p>b."]
    for page in pages:
        read = _Page(page)
        got = path_ratios(read.blocks, read.paths)
        for p, ratio in plain_ratios(read.blocks, read.paths.parent).items():
            assert got[p] == pytest.approx(ratio)


@pytest.mark.parametrize(
    "make",
    [
        lambda n: "<div>" * n + PARA + "</div>" * n,
        lambda n: "<blockquote class=a>" * n + PARA,
        lambda n: f"<p>{PARA}</p><button>" + "<blockquote>" * n,
        lambda n: "<p title=\"x>text " * n + PARA,
        lambda n: "<a href='x>text " + "<b a=\"c>d " * n + PARA,
        lambda n: "<a " + "b=\"c\" d='e' " * n + ">" + PARA,
        lambda n: "</ul></p></x>" * n + PARA,
        lambda n: "<!-- " * n + PARA,
        lambda n: f"<ul>{'<li>x</b>' * n}</ul>{PARA}",
        lambda n: "<form class=ad>x" * n + PARA,
        lambda n: "<" * n + PARA,
    ],
)
def test_time_grows_with_the_page(make):
    import time

    def seconds(n):
        page = make(n)
        began = time.perf_counter()
        main_text(page)
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(100_000) < 40 * max(seconds(10_000), 0.02)


PROSE = "<p>This is a long paragraph, with some text, and more of it to read here.</p>" * 4


@pytest.mark.parametrize(
    ("inside", "there", "gone"),
    [
        ("<table>" + "".join(f"<tr><td>cell {i}</td><td>value {i}</td></tr>" for i in range(21)) + "</table>", [f"{x} {i}" for x in ("cell", "value") for i in range(21)], []),
        ("<div class=facts><div><ul><li>One fact</li><li>Two</li><li>Three</li></ul></div></div>", ["One fact", "Two", "Three"], []),
        ("<h2>Sources</h2><ul><li><a href=a>Paper A</a></li><li><a href=b>Paper B</a></li></ul>", ["Sources", "Paper A", "Paper B"], []),
        ("<p style='color:red; display : none'>unseen words</p><p style='display:block'>seen words</p>", ["seen words"], ["unseen"]),
        ("<ul class=share-links><li><a href=a>Tell a friend</a></li></ul><p>End.</p>", ["End."], ["friend"]),
    ],
)
def test_all_of_an_article(inside, there, gone):
    page = f"<body><nav><a href=x>Home</a><a href=y>About</a></nav><article>{PROSE}{inside}</article><footer>© x</footer></body>"
    lines = main_text(page).split("\n")
    assert [x for x in there if x not in lines] == []
    assert not any(x in line for x in [*gone, "Home", "About"] for line in lines)
