"""Packing, fingerprints, extraction, near duplicates, mixing and the pipeline: brute force, round trips and edge cases."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from glyphlake.llm import common, fingerprints, html, mixing, neardup, packing, queries
from glyphlake.sources.tables import staged

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra int"
ODD = [
    (1, None, "en", "s", 0, 1),
    (2, "", None, None, 0, 1),
    (3, " \t\n\x0b\x0c\r ", "en", "s", 7, 1),
    (4, "a", "en", "s", 1, 1),
    (None, "no id here", "en", "s", 10, 1),
    (5, "same same", "en", "s", 9, 1),
    (5, "same same", "en", "s", 9, 1),
    (6, "x" * 20_000 + " " + "word " * 9_000, "de", "s", 65_001, 1),
    (8, "😀 ünïcödé — text", "fr", "t", 16, 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).cache()


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


# Packing


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(TOKENIZER)


@pytest.mark.parametrize("text", ["", "a b", "<|endoftext|> x <|endoftext|>", " " * 5000 + "x", "ab" * 3000, "é\x85 \r\n\n  z", "'S don't I'LL", "퟿\U0001f600" * 10])
def test_ids_are_the_tokenizers(tokenizer, text):
    assert packing.encode(text, TOKENIZER).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aeiou '\n\t0129")), max_size=60))
def test_ids_of_random_texts(text):
    slow = packing._encoders(TOKENIZER, True)[1]
    assert packing.encode(text, TOKENIZER).tolist() == slow.encode(text, add_special_tokens=False).ids


def check_packed(rows, docs, tokenizer, capacity):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by_seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    for i, text in docs.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(-(-len(ids) // capacity)))
        assert sum(r["length"] for r in own) == len(ids)
        assert all(r["length"] == capacity for r in own[1:])
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    return len(by_seq)


def test_packing_of_tables(spark, sf_dir, texts, tokenizer):
    rows = queries.op1_best_fit_packing(spark, sf_dir).collect()
    used = check_packed(rows, texts, tokenizer, 2048)
    assert used <= 1.02 * sum(r["length"] for r in rows) / 2048 + 1


def test_packing_edges(spark, odd, tokenizer):
    rows = packing.pack(packing.pieces(odd.where("doc_id <> 5"), TOKENIZER, 64), 64).collect()
    check_packed(rows, {r[0]: r[1] for r in ODD if r[0] not in (5, None)}, tokenizer, 64)
    assert packing.pack(packing.pieces(odd, TOKENIZER, 64), 64).where("doc_id = 5").count() == 2
    assert packing.pack(packing.pieces(odd.limit(0), TOKENIZER, 64), 64).count() == 0


def test_packing_of_equal_rows(spark, tokenizer):
    """Thousands of equal rows, and null ids: every row is packed once, extra columns of any name stay."""
    docs = spark.createDataFrame([(None if i % 2 else 3, "a text that all rows have") for i in range(4000)], "doc_id long, text string")
    cut = packing.pieces(docs, TOKENIZER, 64).withColumn("row", F.lit("r")).withColumn("cell", F.lit("c"))
    got = packing.pack(cut, 64).collect()
    n = len(tokenizer.encode("a text that all rows have", add_special_tokens=False).ids) + 1
    places = {(r["sequence_id"], r["offset"]) for r in got}
    assert len(got) == len(places) == 4000 and {r["row"] + r["cell"] for r in got} == {"rc"}
    assert len({r["sequence_id"] for r in got}) == -(-4000 // (64 // n))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=60))
def test_plan_is_whole_and_tight(sizes):
    capacity = 60
    counts = {s: sizes.count(s) for s in sizes}
    bins = defaultdict(list)
    ranks = defaultdict(list)
    for s, first, n, at, offset in packing.plan(counts, capacity):
        ranks[s] += range(first, first + n)
        for k in range(n):
            bins[at + k].append((offset, s))
    assert {s: sorted(r) for s, r in ranks.items()} == {s: list(range(n)) for s, n in counts.items()}
    for places in bins.values():
        at = 0
        for offset, s in sorted(places):
            assert offset == at
            at += s
        assert at <= capacity
        assert sum(3 * s > capacity for _, s in places) <= 2
    loads = sorted(sum(s for _, s in p) for p in bins.values())
    assert len(loads) < 2 or loads[0] + loads[1] > capacity or len(loads) <= -(-sum(sizes) // capacity) + 1


# Fingerprints


def brute_digest(text, rank):
    """Windows, entropies and wins one by one."""
    data = text.encode()
    w, n = fingerprints.WINDOW, len(data) - fingerprints.WINDOW + 1
    if n <= 0:
        chosen = []
    else:
        levels = []
        for i in range(n):
            counts = np.bincount(np.frombuffer(data[i : i + w], np.uint8))
            levels.append((int(fingerprints._NLOGN[w]) - int(fingerprints._NLOGN[counts].sum())) * fingerprints.LEVELS // int(fingerprints._NLOGN[w]))
        ranks, wins = [int(rank[x]) for x in levels], [0] * n
        for i in range(n):
            part = ranks[i : i + fingerprints.RIVALS]
            wins[i + part.index(min(part))] += 1
        chosen = [i for i in range(n) if wins[i] >= fingerprints.WINS or i == ranks.index(min(ranks))]
    return chosen


@pytest.mark.parametrize("size", [0, 10, 63, 64, 65, 300, 1200])
def test_selected_windows(size):
    rng = np.random.default_rng(size)
    text = "".join(rng.choice(list("abcdefgh  é"), size))
    rank = rng.permutation(fingerprints.LEVELS + 1).astype(np.int32)
    other = "zq" * 40
    data = np.frombuffer((other + text + other).encode(), np.uint8)
    k = len(text.encode())
    at, bounds = fingerprints.selected(data, np.array([0, 80, 80 + k, 160 + k]), rank)
    assert (at[bounds[1] : bounds[2]] - 80).tolist() == brute_digest(text, rank)


def test_precedence_counts_all_windows(spark):
    texts = ["ab" * 100, "abcdefgh" * 40, "x" * 63, None, ""]
    rank = fingerprints.precedence(spark.createDataFrame([(t,) for t in texts], "text string"))
    seen = np.zeros(fingerprints.LEVELS + 1, int)
    for t in texts:
        data = np.frombuffer((t or "").encode(), np.uint8)
        for i in range(0, len(data) - fingerprints.WINDOW + 1, fingerprints.WINDOW):
            seen[fingerprints.levels(data[i : i + fingerprints.WINDOW])[0]] += 1
    assert (np.diff(seen[np.argsort(rank)]) >= 0).all()
    assert seen[rank == fingerprints.LEVELS] == seen.max()


def test_precedence_counts_windows_at_every_byte(spark):
    """Windows off the multiples of 64, and those that end a text, count; none runs over two texts."""
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("abcdefghijkl é"), n)) for n in (63, 64, 100, 700)] + ["a" * 63 + "b", None, ""]
    seen = np.zeros(fingerprints.LEVELS + 1, int)
    for t in texts:
        data = np.frombuffer((t or "").encode(), np.uint8)
        for i in range(len(data) - fingerprints.WINDOW + 1):
            seen[fingerprints.levels(data[i : i + fingerprints.WINDOW])[0]] += 1
    rank = fingerprints.precedence(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert rank[np.lexsort((np.arange(len(seen)), seen))].tolist() == list(range(len(seen)))


def check_fingerprints(rows, docs):
    """docs: (doc_id, text) in descending order of id."""
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    assert sum(map(len, by.values())) == len(docs)
    prints = {}
    for k, (i, text) in enumerate(docs):
        text, after = text or "", docs[(k + 1) % len(docs)][1] or ""
        expected = fingerprints.edited(text, after)
        cut = len(text) - len(text) // 3
        assert expected == text[:cut] + after[: len(text) // 3]
        digest = hashlib.sha256(expected.encode()).hexdigest()
        own = next(r for r in by[i] if r["n_chars"] == len(text) and r["edited_sha256"] == digest)
        assert prints.setdefault(text, own["fingerprint"]) == own["fingerprint"]
        assert own["near_edited"] == pytest.approx(fingerprints.likeness(fingerprints.read(own["fingerprint"]), fingerprints.read(own["edited_fingerprint"])))
        assert 0 <= own["near_next"] <= 1
    for k, (i, text) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1] or ""
        assert any(r["near_next"] == pytest.approx(fingerprints.likeness(fingerprints.read(r["fingerprint"]), fingerprints.read(prints[after]))) for r in by[i])


def test_fingerprints_of_tables(spark, sf_dir, texts):
    rows = queries.op4_fingerprints(spark, sf_dir).collect()
    check_fingerprints(rows, sorted(texts.items(), reverse=True))


def test_fingerprint_edges(spark, odd):
    rows = fingerprints.fingerprints(odd, slices=3).collect()
    docs = sorted(((r[0], r[1]) for r in ODD if r[0] is not None), key=lambda r: -r[0]) + [(None, "no id here")]
    check_fingerprints(rows, docs)
    one = fingerprints.fingerprints(odd.where("doc_id = 4")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert fingerprints.fingerprints(odd.limit(0)).count() == 0


@pytest.mark.parametrize("slices", [1, 4, 40])
def test_fingerprints_of_hot_ids(spark, slices):
    """An id, and null ids, on most rows are cut into slices by their texts; every row still meets the next one."""
    rng = np.random.default_rng(4)
    make = lambda: "".join(rng.choice(list("abcdefgh "), rng.integers(0, 200)))
    rows = [(i, make()) for i in range(20)] + [(7, make()) for _ in range(60)] + [(None, make()) for _ in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("t", F.xxhash64("text")).cache()
    order = [(r["doc_id"], r["text"]) for r in docs.orderBy(F.desc_nulls_last("doc_id"), F.desc("t")).collect()]
    got = fingerprints.fingerprints(docs.drop("t"), slices=slices).collect()
    want = []
    for k, (i, text) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        want.append((i or -1, len(text), hashlib.sha256(fingerprints.edited(text, after).encode()).hexdigest()))
    assert sorted((r["doc_id"] or -1, r["n_chars"], r["edited_sha256"]) for r in got) == sorted(want)


def test_likeness():
    rank = np.arange(fingerprints.LEVELS + 1, dtype=np.int32)
    rng = np.random.default_rng(5)
    make = lambda t: fingerprints.digests(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]), rank)[0]
    a = "".join(rng.choice(list("abcdefghijklmnop "), 6000))
    b = "".join(rng.choice(list("abcdefghijklmnop "), 6000))
    assert fingerprints.likeness(make(a), make(a)) == 1
    assert fingerprints.likeness(make(a), make(b)) < 0.1
    assert fingerprints.likeness(make(a), make(a[:4500] + b[:1500])) > 0.5
    assert fingerprints.likeness([], []) == 1 and fingerprints.likeness([], make(a)) == 0


# Extraction


def test_extraction_of_tables(spark, sf_dir):
    """On pages whose article is plain, the text between its tags, block by block."""
    import html as entities

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = {r["page_id"]: r for r in queries.op5_html_extraction(spark, sf_dir).collect()}
    assert set(got) == set(pages)
    for i, page in pages.items():
        article = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", article.replace("<b>", "").replace("<br>", " "))
        expected = "\n\n".join(t for b in blocks if (t := " ".join(entities.unescape(b).split())))
        assert got[i]["text"] == expected
        assert got[i]["n_chars"] == len(expected)


PAGE = """<html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body><header>Site</header><nav><ul><li><a href=x>A</a><li><a href=y>B</a></ul></nav>
<div class="cookie-notice">We use cookies</div><main><h1>Head &amp; line</h1><p>One&nbsp;<b>bold</b> text<br>next<p>Two &lt;b&gt; <span class="ad">buy</span>done
<aside>Side</aside><form><p>Name</p></form><section class="comments"><article><p>Reader says</p></article></section></main><footer>&copy; x</footer></body></html>"""


def test_extraction_of_other_markup(spark):
    got = html.main_text(spark.createDataFrame([(1, "http://a/x", PAGE)], "page_id long, url string, html string"), "page_id").first()
    assert got["text"] == "Head & line\n\nOne bold text next\n\nTwo <b> done"


def test_template_text_goes_where_no_article_is_marked(spark):
    rows = [(i, f"http://h/{i}", f"<body><div class=x>Welcome to the site</div><div class=y><p>Story {i} " + "long text " * 20 + f"</p></div><div><a href=q>more links {i}</a></div></body>") for i in range(4)]
    got = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), "page_id").collect()
    for r in got:
        assert r["text"] == (f"Story {r['page_id']} " + "long text " * 20).strip()


def test_extraction_edges(spark):
    rows = [(1, None, None), (2, None, ""), (3, "x", "<p"), (4, "http://h/", "plain only"), (4, "http://h/", "plain only"), (5, "http://H/a", "<article><p>" + "w " * 50_000), (6, "http://h/", "<<<>>> &#x110000; &amp"), (7, "http://h/", "<div title=\"a>b'\" class='c'>q</div")]
    got = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), "page_id", "url").collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r["text"] for r in got}
    assert by[1] == by[2] == by[3] == ""
    assert by[5] == ("w " * 50_000).strip()
    assert html.main_text(spark.createDataFrame([], "page_id long, url string, html string"), "page_id").count() == 0


def test_pages_of_a_host_keep_their_own_article(spark):
    """A page without an article beside pages with one, and copies of one page, which make no template."""
    article = [(i, f"http://h/{i}", f"<body><p>Menu</p><article><p>Story {i}</p></article></body>") for i in range(3)]
    plain = [(3, "http://h/3", "<body><p>Menu</p><div>An old layout</div></body>"), (4, None, "<article><p>one</p></article>"), (5, "no url", "<p>two</p>")]
    copies = [(i, f"http://copies/{i}", f"<body id=n{i}><h1>Title</h1><p>The only text</p></body>") for i in range(6, 10)]
    got = html.main_text(spark.createDataFrame(article + plain + copies, "page_id long, url string, html string"), "page_id").collect()
    own = {i: f"Story {i}" for i in range(3)} | {3: "An old layout", 4: "one", 5: "two"} | {i: "Title\n\nThe only text" for i in range(6, 10)}
    assert {r["page_id"]: r["text"] for r in got} == own


def test_template_text_goes_inside_articles(spark):
    """Text that all different articles of a host share, and links; not in copies of one article, nor on a host of two pages."""
    page = "<article><h2>Story {0}</h2><p>Long text {0}</p><div class=x>Thanks for reading</div><ul><li><a href=q>Other story {0}</a></li></ul></article>"
    rows = [(i, f"http://h/{i}", page.format(i)) for i in range(4)] + [(i, f"http://copies/{i}", page.format(9)) for i in range(4, 8)] + [(i, f"http://two/{i}", page.format(i)) for i in (8, 9)]
    got = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), "page_id").collect()
    text = "Story {0}\n\nLong text {0}"
    whole = text + "\n\nThanks for reading\n\nOther story {0}"
    own = {i: text.format(i) for i in range(4)} | {i: whole.format(9) for i in range(4, 8)} | {i: whole.format(i) for i in (8, 9)}
    assert {r["page_id"]: r["text"] for r in got} == own


def texts_of(spark, rows):
    got = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), "page_id").collect()
    return {r["page_id"]: r["text"] for r in got}


def test_wrappers_decide_pages_without_article(spark, monkeypatch):
    """Slots of equal paths: only their place in the aligned stream of the host tells template text from the story. Of pages whose
    parts differ, the wrapper is one all the same; switched off, the template text stays."""
    def page(i):
        extra = f"<ul><li>Point {i}<li>Another {i}</ul>" if i % 2 else ""
        ad = "<table><tr><td>Offer</td></tr></table>" if i % 3 == 0 else ""
        return f"<body><p>Our motto</p><hr>{ad}<h2>Title {i}</h2><p>Story {i}</p>{extra}<h3>Bye {i}</h3><p>Come back soon</p></body>"

    rows = [(i, f"http://h/{i}", page(i)) for i in range(8)]
    want = {i: "\n\n".join([f"Title {i}", f"Story {i}", *([f"Point {i}", f"Another {i}"] if i % 2 else []), f"Bye {i}"]) for i in range(8)}
    assert texts_of(spark, rows) == want
    monkeypatch.setattr(html, "verdict", lambda w: [[*x[:2], 0] if len(x) > 1 else x for x in w])
    off = html.text_of(html.parse(page(0)), html._Stream(html.verdict(html.wrapper_of(html.parse(page(0))))))
    assert "Our motto" in off and "Come back soon" in off


def test_content_element_is_the_wrappers(spark):
    """No page marks an article; the element classed as content that holds most of the host's text is read."""
    rows = [(i, f"http://h/{i}", f"<body><div class=top><p>Visitor {i}</p></div><div class='post-content'><p>Story {i} " + "long text " * 20 + f"</p></div><div><p>Page {i}</p></div></body>") for i in range(2)]
    assert texts_of(spark, rows) == {i: (f"Story {i} " + "long text " * 20).strip() for i in range(2)}


def test_what_belongs_to_an_article(spark):
    rows = [
        (1, "http://a/1", "<article><header><h1>Title</h1></header><p>Text</p><div class='article-comments'><p>Reader</p></div><footer>Share</footer></article>"),
        (2, "http://b/1", "<article><div class='article-header'><h1>T</h1></div><p class='related-work'>Others did <math><mi>x</mi></math> too</p><div class='related-posts'>More</div></article>"),
        (3, "http://c/1", "<header><h1>Site</h1></header><article><p>One <span class=ad>buy <span>this</span> now</span> two</p><div hidden>no</div><div class=share>s</div></article>"),
        (4, "http://d/1", "<article><p>Mine</p><section id=comments><article><p>Theirs</p></article></section><aside>Side</aside><form><p>Name</p></form></article>"),
    ]
    assert texts_of(spark, rows) == {1: "Title\n\nText", 2: "T\n\nOthers did x too", 3: "One two", 4: "Mine"}


def test_deep_and_long_pages(spark):
    deep = "<div>" * 10_000 + "at the bottom" + "</div>" * 10_000
    unclosed = "<body>" + "<div><p>x" * 5_000 + "</section></span>" * 5_000
    long = "<article>" + "".join(f"<p>Paragraph {i} of very many</p>" for i in range(100_000)) + "</article>"
    varied = "<article>" + "".join(f"<div class=c{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}><p>t{i}</p></div>" for i in range(15_000)) + "</article>"
    got = texts_of(spark, [(1, "http://h/1", deep), (2, "http://h/2", unclosed), (3, "http://h/3", long), (4, "http://h/4", varied), (5, "http://i/5", varied)])
    assert got[1] == "at the bottom"
    assert got[2] == "\n\n".join(["x"] * 5_000)
    assert got[3] == "\n\n".join(f"Paragraph {i} of very many" for i in range(100_000))
    assert got[4] == got[5] == "\n\n".join(f"t{i}" for i in range(15_000))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<ul>", "<li>", "</ul>", "<h2>", "x", "y", "<article>", "</article>", "<nav>", "</nav>", "<br>"]), max_size=25), min_size=1, max_size=4))
def test_alignment_is_whole(pages):
    """Streams are balanced, wrappers know each slot of a page once, and a page meets the wrapper of its host in order."""
    wrapper = None
    for k, parts in enumerate(pages):
        tokens = html.parse("".join(parts))
        own = html.wrapper_of(tokens, k)
        numbers = [n for x in own if x[0] == "#" for n in x[9]]
        assert sorted(numbers) == list(range(sum(x[0] == "#" for x in tokens)))
        wrapper = own if wrapper is None else html.align(wrapper, own)
        depth = 0
        for x in wrapper:
            depth += (x[0] in "<(") - (x[0] in ">)")
            assert depth >= 0
        assert depth == 0
        met = [(i, j) for what, i, j in html._steps(html._Stream(wrapper), html._Stream(own)) if what == "both"]
        assert [j for _, j in met if j >= 0] == sorted({j for _, j in met if j >= 0})
        assert html.regex_of(wrapper).count("#text") == sum(x[0] == "#" for x in wrapper)


def test_wrapper_is_union_free():
    one = html.wrapper_of(html.parse("<ul><li>a<li>b</ul><p>x"))
    two = html.wrapper_of(html.parse("<ul><li>a</ul><h2>h</h2><p>x"))
    assert html.regex_of(one) == "<ul>(<li>#text</>)+</> <p>#text</>"
    assert html.regex_of(html.align(one, two)) == "<ul>(<li>#text</>)+</> (<h2>#text</>)? <p>#text</>"
    turns = html.wrapper_of(html.parse("<dl><dt>a<dd>b<dt>c<dd>d</dl>"))
    assert html.regex_of(turns) == "<dl>((<dt>#text</> <dd>#text</>))+</>"


# Near duplicates


def brute_groups(docs, percent=85):
    sets = {}
    for i, t in docs.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()
    holders = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            holders[x].add(i)
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in sets.items():
        shared = defaultdict(int)
        for x in s:
            for j in holders[x]:
                if j > i:
                    shared[j] += 1
        for j, both in shared.items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_groups_of_tables(spark, sf_dir, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op6_near_dedup(spark, sf_dir).collect()}
    assert got == brute_groups(texts)


def test_chains_and_large_groups(spark, monkeypatch):
    """A chain of texts, each like the next alone, and copies of one text with scattered changes; with few pairs tested at once."""
    rng = np.random.default_rng(2)
    fresh = iter(range(10**6))
    words = [f"w{next(fresh)}" for _ in range(300)]
    docs, n = {}, 0
    for _ in range(12):
        docs[n] = " ".join(words)
        words = words[12:] + [f"w{next(fresh)}" for _ in range(12)]
        n += 1
    base = [f"b{next(fresh)}" for _ in range(200)]
    for _ in range(150):
        own = list(base)
        for k in rng.choice(200, 2, replace=False):
            own[k] = f"c{next(fresh)}"
        docs[n] = " ".join(own)
        n += 1
    docs[n] = "alone in the world of texts"
    monkeypatch.setattr(neardup, "SETTLED", 0.0)
    got = neardup.group(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_groups(docs)


def test_group_edges(spark, odd):
    got = neardup.group(odd).collect()
    assert len(got) == len(ODD)
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert [(r["component_id"], r["kept"]) for r in by[5]] == [(5, True)] * 2
    assert by[None][0]["component_id"] is None and by[None][0]["kept"]
    assert all(by[i][0]["n_shingles"] == 0 and by[i][0]["kept"] for i in (1, 2, 3))
    assert neardup.group(odd.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "one text of some words here"), (1, "another text entirely and more"), (0, "another text entirely and more")], "doc_id long, text string")
    assert sorted(r["component_id"] for r in neardup.group(twice).collect()) == [0, 0, 1]


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(101, 100)], "u long, v long")
    got = {r["node"]: r["comp"] for r in neardup.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_words_of_regular_structure_differ():
    """Words of 1024 letters in Thue-Morse order and its complement collide under any sum modulo a power of two."""
    signs = [bin(i).count("1") % 2 for i in range(1024)]
    one, two = "".join("ab"[s] for s in signs), "".join("ba"[s] for s in signs)
    data = np.frombuffer(f"{one} {two} {one}".encode(), np.uint8)
    a, b, c = neardup.shingles(data, np.array([0, 1024, 2049, 3074]))
    assert a.tolist() != b.tolist() and a.tolist() == c.tolist()


def test_equal_words_have_equal_hashes_anywhere():
    from glyphlake.llm.common import span_hashes, word_bounds

    rng = np.random.default_rng(8)
    text = " ".join("".join(rng.choice(list("abé"), rng.integers(1, 5))) for _ in range(5000))
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = word_bounds(data, np.array([0, len(data)]))
    by_word = defaultdict(set)
    for s, e, h in zip(starts.tolist(), ends.tolist(), span_hashes(data, starts, ends).tolist(), strict=True):
        by_word[data[s:e].tobytes()].add(h)
    assert all(len(x) == 1 for x in by_word.values())
    assert len({next(iter(x)) for x in by_word.values()}) == len(by_word)


def test_a_bucket_dealt_over_tasks(spark, monkeypatch):
    """Many alike but unlinked texts in shared buckets, dealt over several tasks in the last round: no link is lost."""
    rng = np.random.default_rng(11)
    base = [f"b{k}" for k in range(100)]
    docs = {}
    for n in range(120):
        own = list(base)
        for k in rng.choice(100, 4 if n % 3 else 1, replace=False):
            own[k] = f"c{n}x{k}"
        docs[n] = " ".join(own)
    monkeypatch.setattr(neardup, "SPLIT", 7)
    monkeypatch.setattr(neardup, "LEADER_ROUNDS", 0)
    got = neardup.group(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), 85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_groups(docs)


def test_texts_joined_by_id_change_nothing(spark, monkeypatch, sf_dir, texts):
    """The way for more classes than are copied to all tasks."""
    monkeypatch.setattr(neardup, "COPIED", 0)
    some = dict(sorted(texts.items())[:80])
    got = neardup.group(spark.createDataFrame(list(some.items()), "doc_id long, text string"), 80).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_groups(some, 80)


def naive_super_minhash(elements, slots):
    """The textbook loop: a full permutation for each element, draw by draw."""
    out = [None] * slots
    for e in elements:
        p = list(range(slots))
        for j in range(slots):
            r = int(neardup.mix64(np.array([e], np.uint64) + np.uint64(int(neardup._STEP) * (j + 1) % 2**64))[0])
            k = j + (r >> 44) % (slots - j)
            p[j], p[k] = p[k], p[j]
            value = (j << 40) | (r & ((1 << 40) - 1))
            out[p[j]] = value if out[p[j]] is None else min(out[p[j]], value)
    return out


@pytest.mark.parametrize("n", [1, 2, 9, 60])
def test_early_stopping_changes_nothing(n):
    elements = np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64)
    assert neardup.super_minhash(elements, np.zeros(n, np.int64), 1, 16)[0].tolist() == naive_super_minhash(elements, 16)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(40):
        x = rng.integers(0, 2**63, 60).astype(np.uint64)
        a, b = x[:45], x[15:]
        s = neardup.super_minhash(np.concatenate([a, b]), np.repeat([0, 1], 45), 2)
        errors.append((s[0] == s[1]).mean() - 0.5)
    assert abs(np.mean(errors)) < 0.02
    assert np.std(errors) < (0.25 / neardup.SLOTS) ** 0.5


# Mixing


def brute_targets(sizes, share=1.5, most=2.0):
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, out = share * sum(sizes.values()), {}
    todo = set(order)
    while todo:
        total = sum(weight[s] for s in todo)
        over = {s for s in todo if left * weight[s] / total > most * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in todo}
        for s in over:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in over)
        todo -= over
    return out


def test_mix_of_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in docs}
    source = {r["doc_id"]: r["source"] for r in docs}
    sizes = defaultdict(int)
    for i, s in source.items():
        sizes[s] += size[i]
    goals = brute_targets(dict(sizes))
    got = queries.op8_mixing(spark, sf_dir).collect()
    assert {r["doc_id"] for r in got} == set(size)
    taken, longest = defaultdict(int), defaultdict(int)
    for r in got:
        s = source[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], sizes[s])
        assert r["target"] == pytest.approx(goals[s])
        assert r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
        longest[s] = max(longest[s], r["size"])
    for s in sizes:
        assert abs(taken[s] - goals[s]) <= longest[s] / 2 + 1
    assert sorted(map(tuple, got)) == sorted(map(tuple, queries.op8_mixing(spark, sf_dir).collect()))


def test_mix_edges(spark, odd):
    got = mixing.mix(odd, "doc_id").collect()
    assert len(got) == len(ODD)
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    assert mixing.mix(odd.limit(0), "doc_id").count() == 0
    empty = mixing.mix(spark.createDataFrame([(1, None, "a"), (2, "", "b")], "doc_id long, text string, source string"), "doc_id").collect()
    assert [(r["target"], r["taken"]) for r in empty] == [(0.0, 0), (0.0, 0)]


@pytest.mark.parametrize("ids", ["null", "one", "equal"])
def test_mix_of_repeated_ids(spark, ids):
    """Sources of null ids, of one id, and of rows equal in all: each comes within a document of its target."""
    text = lambda i: "a b c d e f g h i j" if ids == "equal" else " ".join(f"w{i}x{k}" for k in range(10))
    rows = [(None if ids == "null" else 7, text(i), s) for s in "abcd" for i in range(100)] + [(1000 + i, text(i), "e") for i in range(100)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("mark", F.monotonically_increasing_id()), "source", "mark").collect()
    goals = brute_targets({s: 1000 for s in "abcde"})
    assert len({r["mark"] for r in got}) == len(got) == 500
    for s in "abcde":
        own = [r for r in got if r["source"] == s]
        assert len(own) == 100 and all(r["target"] == pytest.approx(goals[s]) for r in own)
        assert abs(sum(r["taken"] for r in own) - goals[s]) <= 10
        assert max(r["copies"] for r in own) - min(r["copies"] for r in own) <= 1


def test_targets_of_many_sources(spark):
    rng = np.random.default_rng(0)
    sizes = {f"s{k}": int(x) for k, x in enumerate(rng.pareto(0.5, 300) * 10)}
    got = mixing.targets(spark.createDataFrame([(k, n) for k, n in sizes.items()], "key string, source_size long"), 1.5, 2.0).collect()
    assert {r["key"]: r["target"] for r in got} == pytest.approx(brute_targets(sizes))


# Pipeline


def test_pipeline_stages(spark, sf_dir, tokenizer):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("extra", F.lit(1))
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stage(spark, docs, sf_dir).cache()
        seen[name] = (before, docs)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.dtypes == before.dtypes
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    before, after = seen["near_dedup"]
    groups = brute_groups({r["doc_id"]: r["text"] for r in before.collect()}, 80)
    assert ids(after) == {i for i, (_, c) in groups.items() if c == i}
    before, after = seen["pii"]
    assert ids(before) == ids(after)
    assert after.where(F.col("text").rlike(r"[A-Za-z0-9]@[a-z0-9]+\.")).count() == 0
    before, after = seen["mixing"]
    taken = {r["doc_id"]: r["copies"] for r in mixing.mix(before, "doc_id").collect()}
    assert {r["doc_id"]: r["count"] for r in after.groupBy("doc_id").count().collect()} == {i: n for i, n in taken.items() if n}
    before, after = seen["packing"]
    n = sum(len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1 for r in before.collect())
    assert after.agg(F.sum("length")).first()[0] == n


def test_near_duplicates_go_by_row(spark, sf_dir):
    """Rows of one id are judged by their own texts, and of a group one row stays."""
    near = [" ".join([f"w{k}" for k in range(100)] + [f"e{n}"]) for n in range(2)]
    rows = [(0, "the first text of some words"), (1, "the first text of some words"), (1, "a text that no other row has"), (2, near[0]), (2, near[1]), (3, near[0]), (4, "one apart from all the others"), (4, "unlike the one before it here"), (5, "twice the very same text here"), (5, "twice the very same text here"), (6, None), (6, None), (None, near[0])]
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf_dir).collect()
    left = [(r["doc_id"], r["text"]) for r in got]
    assert len([x for x in left if x[0] == 2]) == 1 and [x for x in left if x[0] == 2][0] in rows
    assert sorted((x for x in left if x[0] != 2), key=str) == sorted([rows[0], rows[2], rows[6], rows[7], rows[8], rows[10], rows[12]], key=str)


def test_repeated_ids_in_every_stage(spark, sf_dir):
    """Stage by stage, rows of repeated and null ids against a count by hand."""
    prose = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(6).collect()
    t = [r["text"] for r in prose]
    rows = [(1, t[0], "s"), (5, t[0], "s"), (5, t[1], "s"), (5, t[1], "s"), (6, t[2] + " mail a@b.de", "s"), (None, t[3], None), (None, t[3], None), (7, None, "s"), (7, "", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    model_keeps = {r["text"] for r in quality_scores(spark, docs, sf_dir) if r["q"] >= corpus_pipeline.LEAST_QUALITY}
    kept = corpus_pipeline.keep_quality(spark, docs, sf_dir).collect()
    assert sorted(map(repr, kept)) == sorted(repr(r) for r in docs.collect() if r["text"] in model_keeps)
    apart = corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in apart.where("text != ''").collect()) == sorted([(1, t[0]), (5, t[1]), (6, rows[4][1]), (0, t[3]), (0, t[3])])
    assert apart.count() == 7
    clean = corpus_pipeline.redact(spark, docs, sf_dir)
    assert clean.count() == len(rows) and clean.where("text like '%a@b.de%'").count() == 0
    mixed = corpus_pipeline.mix_sources(spark, docs, sf_dir)
    copies = mixing.mix(docs, "doc_id", "text").collect()
    assert mixed.count() == sum(r["copies"] for r in copies)
    packed = corpus_pipeline.pack(spark, docs, sf_dir)
    assert packed.where("piece = 0").count() == len(rows)


def quality_scores(spark, docs, sf_dir):
    from glyphlake.llm import quality
    from glyphlake.llm.common import fold_of

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.score(docs, quality.fit(docs, labels, fold_of(F.col("doc_id"), 5) != 0), "text", name="q").collect()


def test_pipeline_of_odd_rows(spark, sf_dir, odd):
    docs = odd
    for name in ("score", "email", "spans", "base", "copies", "size", "target", "kept", "n", "c", "rank", "cell", "length", "piece", "token", "y", "key", "host"):
        docs = docs.withColumn(name, F.lit(name))
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() > 0
    empty = odd.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf_dir)
    assert empty.count() == 0


def test_run_is_the_stages_in_order(spark, sf_dir):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "pii", "mixing", "packing"]
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def moved_rows(df):
    """Rows that the exchanges of df's plan wrote when it was last run, of those that carry texts."""
    out, left = 0, [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        left += [node.children().apply(k) for k in range(node.children().size())]
        if node.nodeName() == "Exchange" and "text#" in node.output().mkString(" "):
            out += node.metrics().apply("shuffleRecordsWritten").value()
    return out


def test_near_duplicates_go_without_moving_the_rest(spark, sf_dir):
    rows = [(k, " ".join(f"w{k}x{j}" for j in range(9))) for k in range(600)]
    docs = spark.createDataFrame(rows + [(1000 + k, rows[k][1]) for k in range(20)], "doc_id int, text string")
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        left = corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir)
        assert sorted(map(tuple, left.collect())) == rows
        assert 20 <= moved_rows(left) < 100
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_without_is_exact_where_bits_are_few(spark, monkeypatch):
    monkeypatch.setattr(common, "MOST_BITS", 1 << 15)
    rows = spark.range(200_000).selectExpr("if(id % 1000 = 7, null, cast(id as int)) as a", "cast(id % 3 as string) as b")
    gone = staged(spark.range(0, 200_000, 2).selectExpr("id as a", "cast(id % 3 as string) as b"), "gone")
    want = [k for k in range(200_000) if k % 2 and k % 1000 != 7]
    got = common.without(rows, gone, "a", "b")
    assert sorted(r["a"] for r in got.where("a is not null").collect()) == want and got.where("a is null").count() == 200
    assert common.without(rows, staged(gone.where("false"), "none"), "a", "b").count() == 200_000
