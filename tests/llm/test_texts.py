import hashlib
import html
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from logtide.llm import bpe, digest, html_text, language, queries
from tests.llm import brute

SMALL = "/root/testdata/sf0.01"


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.fixture(scope="module")
def ranks():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        return bpe.parse_ranks(file.read())


@pytest.fixture(scope="module")
def reference(ranks):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


def test_bpe_pieces(ranks, reference):
    encoder, rng, tokens = bpe.Encoder(ranks, public_tokenizers.PATTERN), random.Random(1), list(ranks)
    for i in range(20_000):
        b = b"".join(rng.choice(tokens) for _ in range(rng.randint(1, 6))) if i % 3 else bytes(rng.choice(b"aab  e.-=xz") for _ in range(rng.randint(1, 60)))
        assert encoder.piece(b.decode("latin-1")) == reference._encode_single_piece(b)


def test_bpe_texts(ranks, reference):
    encoder = bpe.Encoder(ranks, public_tokenizers.PATTERN)
    texts = ["", " ", "\n\n  x", "<|endoftext|>", "it's 12,345.67", "日本語 \u0085 　", "\U0001f600" * 50, "\x1c\x1f a", "ab" * 50_000, " " * 20_000, "don't'll", "‍́é"]
    for text in texts:
        packed = encoder.encode(text)
        assert ids(packed) == reference.encode_ordinary(text), text[:40]


def test_bpe_small_memo(ranks, reference, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_ENTRIES", 3)
    encoder = bpe.Encoder(ranks, public_tokenizers.PATTERN)
    for text in ("the quick brown foxes jumped", "over the lazy unquantifiable dogs") * 3:
        assert ids(encoder.encode(text)) == reference.encode_ordinary(text)


def test_bpe_refuses_odd_ranks():
    with pytest.raises(ValueError):
        bpe.Encoder({b"a": 0, b"b": 3, b"ab": 2, b"abab": 4}, ".+").piece("abababab")


def test_bpe_operator(spark, reference):
    shared = bpe.share_ranks(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    texts = [None, "", "hello hello", "é\n" * 1000]
    df = frame(spark, texts).withColumn("_source", F.lit(1)).withColumn("token_ids", F.lit("old"))
    rows = bpe.decode(bpe.encode(df, shared, public_tokenizers.PATTERN), shared).collect()
    both = bpe.round_trip(df, shared, public_tokenizers.PATTERN).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, both)) and len(rows) == 4
    for r in rows:
        text = texts[r.doc_id] or ""
        assert ids(bytes(r.token_ids)) == reference.encode_ordinary(text) and bytes(r.decoded) == text.encode() and r._source == 1
    assert bpe.encode(df.where("false"), shared, public_tokenizers.PATTERN).count() == 0


def test_bpe_query(spark, reference):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.QUERIES["op1_byte_bpe"](spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = reference.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


# ---- digests ----


def counts_by_definition(data):
    counts = [0] * digest.BUCKETS
    data = data.ljust(5, b"\0") if data else data
    for n in range(4, len(data)):
        for (i, j), odd in zip(digest.PAIRS, digest._ODD, strict=True):
            value = data[n] | data[n - i] << 8 | data[n - j] << 16
            counts[(value * int(odd) & 0xFFFFFFFF) >> 25] += 1
    return counts


def test_bucket_counts(monkeypatch):
    rng = random.Random(2)
    for n in (0, 1, 4, 5, 6, 300):
        data = bytes(rng.randrange(256) for _ in range(n))
        assert digest.bucket_counts(data).tolist() == counts_by_definition(data)
    whole = digest.bucket_counts(data)
    monkeypatch.setattr(digest, "CHUNK", 7)
    assert (digest.bucket_counts(data) == whole).all()


def print_by_definition(data):
    """Checksum, length and quartiles spelt out: a bucket's code is the number of quartiles that its count exceeds."""
    counts = counts_by_definition(data)
    ordered = sorted(counts)
    quartiles = [ordered[i] for i in (31, 63, 95)]
    out = f"{zlib.crc32(data) & 255:02x}{min(255, round(math.log(len(data) + 1, 1.1))):02x}"
    for i in range(0, 128, 4):
        out += f"{sum(sum(c > q for q in quartiles) << 2 * k for k, c in enumerate(counts[i : i + 4])):02x}"
    return out


def difference_by_definition(a, b):
    if a == b:
        return 0
    x, y = bytes.fromhex(a), bytes.fromhex(b)
    apart = abs(x[1] - y[1])
    total = (x[0] != y[0]) + (apart if apart <= 2 else 2 * apart)
    for p, q in zip(x[2:], y[2:], strict=True):
        for k in range(4):
            d = abs((p >> 2 * k & 3) - (q >> 2 * k & 3))
            total += 6 if d == 3 else d
    return total


def test_fingerprint_and_difference():
    rng = random.Random(9)
    words = [bytes(rng.choice(b"abcdefghij") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    texts = [b"", b"x", b"abcd", b"abcde", *[b" ".join(rng.choice(words[k % 40 : k % 40 + 20]) for _ in range(10 * k)) for k in range(1, 25)]]
    prints = [digest.fingerprint(t) for t in texts]
    assert prints == [print_by_definition(t) for t in texts]
    for a in prints:
        for b in prints:
            d = digest.difference(a, b)
            assert d == digest.difference(b, a) == difference_by_definition(a, b) <= digest.MOST
            assert digest.likeness(a, b) == 1 - d / digest.MOST and (d == 0) == (a == b)


def test_long_text_in_chunks():
    """A text of several chunks is counted as the definition says."""
    data = bytes(random.Random(3).choices(b"abcdefgh \n\xc3\xa9", k=2 * digest.CHUNK + 77))
    assert digest.fingerprint(data) == print_by_definition(data)


def check_edits(rows, texts):
    order = sorted(texts)
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(texts)
    for i, k in enumerate(order):
        own, after = texts[k] or "", texts[order[(i + 1) % len(order)]] or ""
        half = len(own) // 2
        edited = own[: len(own) - half] + after[:half]
        r, prints = got[k], [digest.fingerprint(t.encode()) for t in (own, edited, after)]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(own), hashlib.sha256(edited.encode()).hexdigest(), prints[0], prints[1])
        assert (r.near_edited, r.near_next) == (1 - difference_by_definition(prints[0], prints[1]) / digest.MOST, 1 - difference_by_definition(prints[0], prints[2]) / digest.MOST)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 50])
def test_edited_texts(spark, n):
    texts = {7 * i: [None, "", "ab", "é" * 11, "long text " * 300][i % 5] for i in range(n)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("part", F.lit(1)).withColumn("after", F.lit(1))
    check_edits(digest.edit_likeness(df).collect(), texts)


def test_digest_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.QUERIES["op5_quartile_digest"](spark, SMALL).collect()
    check_edits(rows, texts)
    assert sum(r.near_edited > r.near_next for r in rows) > 0.9 * len(rows)
    # Unlike texts are told apart too: the score doesn't end at a bound that many reach.
    assert sum(r.near_next == 0 for r in rows) == 0 and len({r.near_next for r in rows}) > 100
    df = digest.fingerprints(frame(spark, ["a", None]).withColumn("_bytes", F.lit(1)))
    assert df.columns == ["doc_id", "text", "_bytes", "fingerprint"] and df.count() == 2


# ---- pages ----


def article(page):
    body = page[page.find("<article>") :].split("</article>")[0]
    parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"<p>|</p>|</?h1>", body))
    return "\n".join(p for p in parts if p)


def test_pages_query(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    rows = queries.QUERIES["op7_html_text"](spark, SMALL).collect()
    assert len(rows) == len(pages)
    assert all(r.text == article(pages[r.page_id].html) for r in rows) and all(r.n_chars == len(r.text) and r.url == pages[r.page_id].url for r in rows)


PROSE = "It was the best of times, it was the worst of times, and all of the people in the town knew that it would be so for a long while to come, as it had been."


def test_page_rules():
    page = f"""<html><head><title>t</title><script>var a = "<p>{PROSE}</p>";</script></head><body><header class="site"><a href="/">Home</a> of the news</header>
    <nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav><div id="cookie-notice"><p>{PROSE}</p></div>
    <article><h1>A &amp; B</h1><p>{PROSE}<p>Short  one.<p><a href=x>{PROSE}</a></p><p>{PROSE}</p><p>End.</p><form><p>{PROSE}</p></form></article>
    <div class="comments"><p>{PROSE}</p></div><aside><p>{PROSE}</p></aside><!-- <p>{PROSE}</p> --><footer>&copy; {PROSE}</footer></body></html>"""
    assert html_text.main_text(page).split("\n") == ["A & B", PROSE, "Short one.", PROSE, PROSE, "End."]
    plain = f"<body><div class='menu'><a href=a>One</a></div><div><h2>Head</h2><p>{PROSE}</p><p>Short.</p></div><div class=footer>Bye</div>"
    assert html_text.main_text(plain).split("\n") == ["Head", PROSE, "Short."]
    assert html_text.main_text("<p>Just this</p>") == "Just this"
    for nothing in (None, "", "<", "<p", "<!-- x", "<script>x", "</div></p>"):
        assert html_text.main_text(nothing) == "" or nothing == "<"


def test_pages_whole_articles():
    """Classes of the page itself, the word hidden in other attributes, open heads and self-closing elements lose no text."""
    for tag in ("html", "body", "main", "article"):
        assert html_text.main_text(f"<{tag} class='single has-sidebar comments-open cookie-consent'><p>{PROSE}</p></{tag}>") == PROSE
    for attrs in ('style="overflow:hidden"', 'class="overflow-hidden"', 'class="a hidden b"', 'aria-hidden="true"', "data-hidden", "title='x hidden'", "hidden=false", 'data-x="display:none"'):
        assert html_text.main_text(f"<body><div {attrs}><p>{PROSE}</p></div></body>") == PROSE, attrs
    for attrs in ("hidden", 'hidden=""', "class=a HIDDEN", "a='b'hidden", 'hidden="until-found"', 'style="color:red;display : none"', "style=display:none"):
        assert html_text.main_text(f"<body><div {attrs}><p>No. {PROSE}</p></div><p>{PROSE}</p></body>") == PROSE, attrs
    for head in ("<head><title>t</title><meta charset=utf-8>", "<head><title>t</title><script>'<body>'</script><body>", "<head><title>t</head>", "<head><title>t<body>", "<head><style>a{}</head><body>"):
        assert html_text.main_text(f"<html>{head}<p>{PROSE}</p>") == PROSE, head
    for empty in ("<svg class=icon />", "<SVG a='b'/>", "<math/>", "<svg><path/></svg>", "<video-player></video-player>"):
        assert html_text.main_text(f"<body>{empty}<p>{PROSE}</p><svg><text>x</text></svg><p>{PROSE}</p>").split("\n") == [PROSE, PROSE], empty


def test_pages_without_article():
    """Names count as a whole, unclosed buttons, objects and drawings hide nothing, and hints don't leave a page empty."""
    for name in ("ad-free", "related-post-body-text", "no-sidebar", "has-sidebar", "headers", "shared", "noticeable", "commentary"):
        assert html_text.main_text(f"<body><div id=x class='{name}'><p>{PROSE}</p></div></body>") == PROSE, name
    for name in ("cookie-banner", "site-footer", "sidebar", "related-posts", "menuBar", "top_nav", "ad", "box newsletter", "comments-list", "share-links"):
        page = f"<body><div><p>{PROSE}</p></div><div class='{name}'><p>No. {PROSE}</p></div></body>"
        assert html_text.main_text(page) == PROSE, name
    for tag in ("<button>", "<object data=x>", "<iframe src=x>", "<svg class=i>", "<select><option>a", "<video src=x>", "<button>Menu</button>", "<button>a<button>b</button>"):
        assert PROSE in html_text.main_text(f"<body><div>{tag}</div><div><p>{PROSE}</p><p>{PROSE}</p></div></body>").split("\n")[-1], tag
    assert html_text.main_text(f"<body><button>Open<div><p>{PROSE}</p></div><button>x</button><p>{PROSE}</p></body>").endswith(PROSE)
    assert html_text.main_text(f"<body><div class='sidebar menu'><p>{PROSE}</p></div></body>") == PROSE
    assert html_text.main_text(f"<body><div class='content sidebar'><article><p>{PROSE}</p></article></div></body>") == PROSE
    thread = f"<body><article><p>{PROSE}</p></article><div class=comments><article class=comment><p>Nice. {PROSE}</p></article></div></body>"
    assert html_text.main_text(thread) == PROSE
    # Links are counted as they are shown.
    assert html_text.main_text(f"<body><p>{PROSE} <a href=x>{'&amp;' * 20}</a></p></body>") == f"{PROSE} {'&' * 20}"


def test_pages_in_forms():
    """A form, or a container of an odd name, around the page or its prose hides nothing; small forms are furniture."""
    many = f"<p>{PROSE}</p>" * 4
    for page in (
        f"<body><form id=aspnetForm><div class=nav><a href=a>One</a></div><article>{many}</article></form></body>",
        f"<body><form id=aspnetForm><div class=nav><a href=a>One</a></div><div>{many}</div></form></body>",
        f"<body><form><div id=ctl00_sidebar class=sidebar>{many}</div></form><div class=related><p>No. {PROSE}</p></div></body>",
        f"<body><div class='cookie-recipe'><div class=x>{many}</div></div></body>",
        f"<body><nav>{many}</nav></body>",
        f"<body><div class=comments>{many}</div></body>",
        f"<body><div>{many}</div><form><p>No. {PROSE}</p></form></body>",
    ):
        assert html_text.main_text(page).split("\n") == [PROSE] * 4, page[:60]
    assert html_text.main_text(f"<body><div hidden>{many}</div></body>") == ""


def test_pages_readers_and_adverts():
    """What readers write and adverts go, inside the article too, and where the page has no article."""
    for name in ("disqus_thread", "user-comments", "fb-comments", "reader-comments", "responses", "commentlist", "commentForm", "ad-slot", "adsbygoogle", "cookie-law-info-bar", "article-ad", "adbox"):
        for attrs in (f"id='{name}'", f"class='x {name}'"):
            inner = f"<div {attrs}><p>No. {PROSE}</p><article><p>No. {PROSE}</p></article></div>"
            for page in (f"<article><p>{PROSE}</p>{inner}<p>{PROSE}</p></article>", f"<div><p>{PROSE}</p></div>{inner}<div><p>{PROSE}</p></div>"):
                assert html_text.main_text(f"<body>{page}</body>").split("\n") == [PROSE] * 2, (name, page[:30])
    for name in ("ad-free", "address", "commentary", "no-comments", "comments-open", "with-ads", "reply-free"):
        assert html_text.main_text(f"<body><article><div class='{name}'><p>{PROSE}</p></div></article></body>") == PROSE, name
    byline = f"<body><div class=meta>By A. Writer, 12 May</div><article><h1>Head</h1><p>{PROSE}</p></article></body>"
    assert html_text.main_text(byline).split("\n") == ["Head", PROSE]


def test_pages_linked_paragraphs():
    """A paragraph that is a link follows its neighbours, and so does the heading before it; links beside links are a list."""
    link = f"<p><a href=x>{PROSE}</a></p>"
    page = f"<body><article><h1><a href=t>Title</a></h1><p>{PROSE}</p><h2>Head</h2>{link}<p>{PROSE}</p></article></body>"
    assert html_text.main_text(page).split("\n") == ["Title", PROSE, "Head", PROSE, PROSE]
    page = f"<body><article><p>{PROSE}</p><ul><li>{link}<li>{link}<li><a href=y>Short</a></ul></article>{link}</body>"
    assert html_text.main_text(page) == PROSE


def plain_text(tree):
    """The block rules read off the definitions: ``tree`` is (tag, name, children), texts are (words, is a link)."""
    blocks = []

    def walk(node, above):
        tag, name, children = node
        above = [*above, node]
        for child in children:
            if len(child) == 3:
                walk(child, above)
            else:
                blocks.append((child[0], child[1], above))

    walk(tree, [])
    arts = [n for _, _, above in blocks for n in above if n[0] == "article"]
    reader, advert = {"comments", "user-comments"}, {"ad-slot"}

    def kind(node):
        return "element" if node[0] in ("nav", "footer") else "form" if node[0] == "form" else "reader" if node[1] in reader else "advert" if node[1] in advert else "hint" if node[1] == "sidebar" else None

    first = {id(n) for n in around_first_article(tree, [])}
    spared = {n for n in first} if all(kind(n) in (None, "form", "hint") for n in around_first_article(tree, [])) else set()
    stops = [html_text.prose_share(t) for t, _, _ in blocks]
    inside = [any(n[0] == "article" for n in above) for _, _, above in blocks]

    def alone(i):
        text, link, above = blocks[i]
        heading = above[-1][0] == "h2"
        if link:
            beside = any(0 <= j < len(blocks) and blocks[j][1] for j in (i - 1, i + 1))
            return 0 if inside[i] and not beside and (heading or len(text) >= 140 and stops[i] >= 0.12) else -1
        return 0 if len(text) < 140 else 1 if stops[i] >= 0.12 else 0 if stops[i] >= 0.02 or inside[i] else -1

    own = [alone(i) for i in range(len(blocks))]
    sure = [i for i in range(len(blocks)) if own[i] == 1 and all(kind(n) in (None, "form", "hint") or id(n) in spared for n in blocks[i][2])]
    if not any(inside[i] for i in sure):
        total = sum(len(blocks[i][0]) for i in sure)
        for node in {id(n): n for _, _, above in blocks for n in above if kind(n) in ("form", "hint")}.values():
            if sum(len(blocks[i][0]) for i in sure if any(n is node for n in blocks[i][2])) > 0.75 * total:
                spared.add(id(node))
    for left_out in ((), ("form", "hint"), ("form", "hint", "advert", "reader"), ("form", "hint", "advert", "reader", "element"), ()):
        bad = [any(kind(n) and kind(n) not in left_out and id(n) not in spared for n in above) for _, _, above in blocks]
        label = [-1 if bad[i] else own[i] for i in range(len(blocks))]
        if 1 in label:
            break
    out = []
    for i, (text, _, above) in enumerate(blocks):
        near = [next((j for j in way if label[j] and (not inside[i] or True)), None) for way in (range(i - 1, -1, -1), range(i + 1, len(blocks)))]
        if label[i]:
            good = label[i] == 1
        else:
            if inside[i]:
                near = [j if j is not None and inside[j] else None for j in near]
            a, b = near
            if a is None and b is None:
                good = inside[i] or 1 not in label
            elif a is None or b is None:
                good = label[b if a is None else a] == 1
            elif above[-1][0] == "h2":
                good = label[b] == 1
            elif (box(blocks[a][2]) is box(above)) != (box(blocks[b][2]) is box(above)):
                good = label[a if box(blocks[a][2]) is box(above) else b] == 1
            elif label[a] == label[b]:
                good = label[a] == 1
            else:
                good = label[a if i - a < b - i else b] == 1 if i - a != b - i else inside[i]
        out.append(good)
    if not any(out):
        out = [not bad[i] and not link for i, (_, link, _) in enumerate(blocks)]
    return "\n".join(t for (t, _, _), good in zip(blocks, out, strict=True) if good)


def box(above):
    """The innermost container, of which paragraphs and headings are none."""
    return next(n for n in reversed(above) if n[0] not in ("p", "h2"))


def around_first_article(node, above):
    """What stands around the first article."""
    if node[0] == "article":
        return above
    for child in node[2]:
        if len(child) == 3 and (found := around_first_article(child, [*above, node])) is not None:
            return found
    return None if above else []


def test_pages_equal_plain_rules():
    rng = random.Random(11)
    tagless = ["Foo bar baz qux. " * 10, "Only few words", "Foo the bar baz qux quux corge grault garply waldo fred plugh xyzzy thud. " * 3, PROSE, PROSE + " And so on."]

    def grown(depth):
        if depth == 0 or rng.random() < 0.35:
            words = rng.choice(tagless).strip()
            return (rng.choice(["p", "p", "h2"]), "", [(words, rng.random() < 0.2)])
        tag = rng.choice(["div", "div", "section", "article", "form", "nav", "footer", "div"])
        return (tag, rng.choice(["", "", "x", "comments", "user-comments", "ad-slot", "sidebar", "ad-free"]) if tag in ("div", "section") else "", [grown(depth - 1) for _ in range(rng.randint(1, 4))])

    def written(node):
        if len(node) == 2:
            return f"<a href=x>{node[0]}</a>" if node[1] else node[0]
        return f"<{node[0]} class='{node[1]}'>" + "".join(map(written, node[2])) + f"</{node[0]}>"

    texts = set()
    for _ in range(1_500):
        tree = ("div", "", [grown(3) for _ in range(rng.randint(1, 4))])
        page = f"<body>{written(tree)}</body>"
        assert html_text.main_text(page) == plain_text(tree), page
        texts.add(plain_text(tree))
    assert len(texts) > 500


def test_pages_operator(spark):
    """Columns that clash, keys that are null or repeat, and null pages give one row each."""
    rows = [(1, "u", f"<p>{PROSE}</p>"), (1, "u", f"<p>{PROSE}</p>"), (1, "v", None), (None, None, ""), (2, "w", "<p>x</p>" * 20_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("old")).withColumn("n_chars", F.lit("x"))
    out = html_text.extract(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = sorted(((r.page_id, r.url, r.n_chars) for r in out.collect()), key=str)
    assert got == sorted([(1, "u", len(PROSE)), (1, "u", len(PROSE)), (1, "v", 0), (None, None, 0), (2, "w", 39_999)], key=str)
    assert html_text.extract(df.where("false")).count() == 0


def test_pages_raw_long():
    for page in ("<svg>" * 100_000, "<title></head>" * 50_000, "<svg/>" * 100_000, "<script></style>" * 50_000, "<div hidden=' " * 30_000, "<div " + "a hidden= " * 50_000 + ">"):
        html_text.main_text(page)


def test_pages_long_and_broken():
    for page in ("<div>" * 50_000 + "x", "<p>" * 100_000, "<a href='" * 20_000, "<" * 100_000, "&amp;" * 100_000, "<!--" * 50_000, '<a b="' + "x" * 100_000):
        html_text.main_text(page)


# ---- languages ----

WORDS = {"aa": "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor", "bb": "zwei fuchs jagt quer durch hohen wald ueber stock und stein bis nacht"}


def two_languages(spark, n=80):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        lang = "aa" if i % 3 else "bb"
        rows.append((i, " ".join(rng.choice(WORDS[lang].split()) for _ in range(rng.randint(20, 80))), lang))
    rows += [(n, None, "aa"), (n + 1, "", "bb"), (n + 2, "123 ... 456", None), (n + 3, "ZWEI!! FUCHS!! JAGT!! QUER!! DURCH!!", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("_lang", F.lit(1)).withColumn("_key", F.lit(1)), rows


def test_language(spark):
    df, rows = two_languages(spark)
    model = language.train(df)
    assert [m[0] for m in model.dictionaries] == ["aa", "bb"] and all(len(m[1]) <= language.DICTIONARY_BYTES for m in model.dictionaries)
    got = {r.doc_id: r for r in language.classify(df, model).collect()}
    for i, text, lang in rows[:80]:
        assert got[i].lang_pred == lang and 0 <= got[i].score <= 1 and got[i].accepted
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
    assert [got[i].lang_pred for i in (80, 81, 82)] == ["und"] * 3 and got[83].lang_pred == "bb"
    kept = language.accepted_documents(df, model)
    assert kept.columns == df.columns and kept.count() == 81
    assert language.train(df.where("false")) == language.Model() and language.classify(df.where("false"), model).count() == 0
    assert {r.lang_pred for r in language.classify(df, language.Model()).collect()} == {"und"}


def test_language_of_repeated_keys(spark):
    """The sample has one text a place, of the place's own language; rows of one id, and rows without one, are told one by one."""
    rows = [(1, f"{WORDS['aa']} {i}", "aa") for i in range(300)] + [(1, WORDS["bb"], "bb"), (1, None, "bb"), (None, WORDS["bb"] + " never learned", "bb")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(df)
    assert {k: v.decode().strip() for k, v in model.dictionaries} == WORDS
    got = [(r.doc_id, r.lang_pred, r.held_out) for r in language.classify(df, model).collect()]
    assert sorted(got, key=str) == sorted([(1, "aa", False)] * 300 + [(1, "bb", False), (1, "und", False), (None, "bb", False)], key=str)


def test_letters():
    """Numbers that aren't digits, and marks alone, are no letters."""
    for text in ("½ ² Ⅷ ① 12", "\u0301", "_-_", "", " "):
        assert language.letters_only(text) == ""
    assert language.letters_only("Ça-va² हिन्दी_X1y") == "ça va हिन्दी x y"


def test_dictionaries_of_long_texts(spark, monkeypatch):
    """Whole texts are taken while they fit; where none does, the shortest is cut."""
    monkeypatch.setattr(language, "DICTIONARY_BYTES", 60)
    sample = spark.createDataFrame([("aa", 1, "x" * 70), ("aa", 3, "one two"), ("aa", 4, "no"), ("aa", 5, "y" * 50), ("aa", 7, "z" * 52), ("bb", 1, "q" * 90), ("bb", 3, "r" * 80)], "_lang string, _rank int, text string")
    assert language._dictionaries(sample) == {"aa": b"one two " + b"y" * 50 + b" ", "bb": b"r" * 60}


def test_narrow_margin():
    rng = random.Random(8)
    assert language.narrow_margin([]) == 0 and language.narrow_margin([(0.1, -1.0)]) == 0.1 and language.narrow_margin([(0.0, 1.0)]) == 0
    assert language.narrow_margin([(0.01, -0.1)] * 30 + [(0.01, 1.0)] * 2 + [(0.02, -0.1)] * 5 + [(0.02, 1.0)] * 4) == 0.01
    for _ in range(300):
        told = [(rng.randrange(8) / 64, rng.choice([1.0, -1.0, -0.1])) for _ in range(rng.randrange(12))]
        assert language.narrow_margin(told) == brute.narrow_margin(told)


def mixed_language_texts(spark):
    """Clean texts, texts half of one language and half of another, and texts of neither."""
    rng = random.Random(6)
    docs = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").where("length(text) > 1500").select("text").collect()]
    langs = {lang: [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").where(f"lang = '{lang}' AND length(text) > 800").select("text").collect()] for lang in ("en", "de", "fr", "es")}
    mixed = []
    for _ in range(100):
        a, b = (rng.choice(langs[k])[:800] for k in rng.sample(sorted(langs), 2))
        mixed.append(f"{a} {b}")
    foreign = [" ".join("".join(rng.choice("zxqwkvjyпаüłçø") for _ in range(rng.randint(3, 9))) for _ in range(150)) for _ in range(50)]
    return docs[:200], mixed, foreign


def test_language_is_what_brute_force_says(spark):
    """Sizes, ties, the choice and the rejection, for texts of all kinds; blocks make no difference to what is decided."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = language.train(docs)
    clean, mixed, foreign = mixed_language_texts(spark)
    texts = [None, "", "12 ½", "a", "This.", "zz zz", *clean[:40], *mixed[:20], *foreign[:10], " ".join(clean[:60])]
    assert len(texts[-1]) > 4 * language.BLOCK
    rows = {r.doc_id: r for r in language.classify(frame(spark, texts), model).collect()}
    for i, text in enumerate(texts):
        lang, margin, accepted = brute.language(model.dictionaries, text, model.narrow, language.BLOCK)
        pivot = model.narrow or language.USUAL_MARGIN
        assert (rows[i].lang_pred, rows[i].accepted) == (lang or "und", accepted), text
        assert rows[i].score == pytest.approx(margin / (margin + pivot))
    tied = language.Model((("aa", b"same words "), ("bb", b"same words ")), 0.0)
    (r,) = language.classify(frame(spark, ["same words of both"]), tied).collect()
    assert (r.lang_pred, r.score, r.accepted) == ("aa", 0.0, False)


def test_language_rejects_what_it_cannot_tell(spark):
    """Most texts of no learned language and many of two go, nearly all others stay, and those that stay are told rightly."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = language.train(docs)
    told = language.Classifier(model)
    clean, mixed, foreign = mixed_language_texts(spark)
    shares = [sum(told(t)[2] for t in texts) / len(texts) for texts in (clean, mixed, foreign)]
    print("accepted of clean, mixed and foreign texts:", shares, "narrow:", model.narrow)
    assert shares[0] >= 0.99 and shares[1] <= 0.8 and shares[2] <= 0.3


def test_language_query(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = queries.QUERIES["op8_language_id"](spark, SMALL).collect()
    held = [r for r in rows if r.held_out]
    right = [r.lang_pred == docs[r.doc_id].lang for r in held]
    kept = [r.lang_pred == docs[r.doc_id].lang for r in held if r.accepted]
    assert len(rows) == len(docs) and sum(right) >= 0.97 * len(held) and sum(kept) >= 0.99 * len(kept)
    assert 0 < sum(not r.accepted for r in rows) <= 0.03 * len(rows)


def test_edits_of_repeated_and_null_ids(spark):
    """Rows of one id are rows of their own, ordered by their texts' checksums; null ids come first."""
    rows = [(1, "one"), (1, "two"), (1, "two"), (None, "zero"), (2, None)]
    got = digest.edit_likeness(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_chars) for r in got) == [(False, 0, 4), (True, 1, 3), (True, 1, 3), (True, 1, 3), (True, 2, 0)]
