import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chirplake.llm import htmltext, licenses, linededup, mixing, simhash, suffixpieces, tokenrecords, toxicity

CLASH = "doc_id long, text string, source string, row string, mix string, size string, id string, tie string, label string, node string"


def clashing(spark, rows):
    """(doc_id, text, source) rows with more columns, called as the operators call their own."""
    return spark.createDataFrame([(i, t, s, "r", "m", "s", "i", "t", "l", "n") for i, t, s in rows], CLASH)


HARD = [
    (1, "one two three four five\nb\nc\nd", "a"), (2, None, "a"), (3, "", None), (None, "x y z", "b"), (None, None, None),
    (4, " \t\n ", "b"), (5, "one two three four five\nb\nc\nd", "a"), (5, "one two three four five\nb\nc\nd", "a"), (6, "w " * 30_000, "c"), (7, "ünï 漢字 \U0001f600", "c"),
]


# op 1


def brute_targets(sizes, budget=1.5):
    """Resharing by weight until no target is above twice its source."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, target, free = budget * sum(sizes.values()), {}, set(names)
    while free:
        share = {s: (total - sum(target.values())) * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if share[s] > 2 * sizes[s]}
        if not above:
            return target | share
        target |= {s: 2.0 * sizes[s] for s in above}
        free -= above
    return target


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 1000, "c": 50, None: 10}, {"x": 7}, {"a": 5, "b": 5, "c": 5000}, {"a": 0, "b": 0}, {"a": 1, "b": 10, "c": 100, "d": 1000, "e": 10000}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def test_mix(spark):
    rng = random.Random(0)
    docs = [(i, "w " * rng.randint(1, 40), rng.choice("aaaabbc")) for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    plan = mixing.plan_mix(df, mixing.words()).select("row.*", "mix.*").collect()
    taken = {}
    for r in plan:
        assert 0 <= r.copies <= 2
        taken[r.source] = taken.get(r.source, 0) + r.copies * r.size
    for r in plan:
        assert abs(taken[r.source] - r.target) <= 40
    out = [r.doc_id for r in mixing.mix(df).collect()]
    assert len(out) == sum(r.copies for r in plan)
    assert out == [r.doc_id for r in mixing.mix(df.repartition(7)).collect()]


def test_mix_is_a_fair_queue(spark):
    """Against the plain queue: all copies in order of virtual finish time, up to the budget."""
    rng = random.Random(1)
    docs = [(i if i % 50 else None, "w " * rng.choice([0, 1, 5, 30, 200]), rng.choice(["a", "a", "b", "c", None])) for i in range(800)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = mixing.plan_mix(df, mixing.words()).select("row.source", "mix.*").collect()
    queue = []
    for k, r in enumerate(rows):
        queue += [((r.start + r.size + c * r.source_size) / r.target, r.source is None, r.source or "", k) for c in (0, 1) if r.size]
    served, copies, budget = 0, [0] * len(rows), 1.5 * sum(r.size for r in rows)
    for *_, k in sorted(queue):
        served += rows[k].size
        if served > budget:
            break
        copies[k] += 1
    assert copies == [r.copies for r in rows]


def test_mix_hard_rows(spark):
    df = clashing(spark, HARD)
    got = mixing.plan_mix(df, mixing.words()).select("row.doc_id", "mix.*").collect()
    assert len(got) == len(HARD) and all(r.copies == 0 for r in got if not r["size"])
    assert mixing.mix(df).columns == df.columns
    assert mixing.mix(df.limit(0)).count() == 0


# op 3

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></nav>
<div class="cookie-notice"><p>We use cookies on this site, and say so at some length to everyone who reads.</p></div>
<article><h1>Title &amp; more</h1><p>First   paragraph with <b>bold</b> text
that goes on.<p>Short.<div class="ad">Buy this now, it is cheap and good and everyone has it.</div><ul><li>One<li>Two</ul>
<form><p>Sign up <input name=x></form><p>Last &eacute;nd.</article>
<aside>Related stories that are long enough to look like text of an article, but aren't.</aside>
<section id="comments"><p>A reader has a lot to say about all this, and says it here at length.</p></section>
<footer>&copy; someone</footer></body></html>"""


def test_main_text():
    assert htmltext.main_text(PAGE) == "Title & more First paragraph with bold text that goes on. Short. One Two Last énd."
    plain = "<body><div id='menu'><a href=a>a</a> <a href=b>b</a></div><div><p>The text of a page without an article, long enough.</p><p>Tiny.</p></div></body>"
    assert htmltext.main_text(plain) == "The text of a page without an article, long enough. Tiny."
    assert htmltext.main_text(None) == htmltext.main_text("") == htmltext.main_text("<br><p>") == ""
    assert htmltext.main_text("just text") == "just text"
    assert htmltext.main_text("<p>" + "a b " * 200_000 + "</b></p></div>") == ("a b " * 200_000).strip()
    assert htmltext.main_text("<article><p>x<article><div><p>unclosed <!-- c --> y") == "x unclosed y"


@pytest.mark.parametrize("inside", ["<table><tr>%s</table>", "<div>%s</div>", "<section><div>%s</div></section>", "<article>%s</article>"])
def test_short_blocks_of_an_article_stay(inside):
    long = "".join(f"<p>{c * 500}</p>" for c in "abc")
    cells = "".join(f"<td>{i}.</td>" for i in range(8)) + "<div><a href=a>link</a></div>"
    for tag in ("article", "main"):
        text = htmltext.main_text(f"<body><div>menu</div><{tag}>{long}{inside % cells}{long}</{tag}></body>")
        want = [*(c * 500 for c in "abc"), *(f"{i}." for i in range(8)), "link", *(c * 500 for c in "abc")]
        assert text == " ".join(want)


ARTICLE = "<article><p>The text of the article is long enough.</p></article>"
WRAPPERS = ["<div class='page with-sidebar'>%s</div>", "<div class='no-sidebar'>%s</div>", "<div class=hasSidebar>%s</div>", "<form id=f>%s</form>", "<div class='widget'>%s</div>"]


@pytest.mark.parametrize("wrapper", WRAPPERS)
def test_wrappers_of_a_page_do_not_hide_it(wrapper):
    assert htmltext.main_text(f"<body>{wrapper % (ARTICLE + '<div class=sidebar>Aside.</div>')}</body>") == "The text of the article is long enough."


@pytest.mark.parametrize("wrapper", ["<aside>%s</aside>", "<nav>%s</nav>", "<footer>%s</footer>", "<div class=comments>%s</div>", "<div class='main-nav'>%s</div>", "<div id=sidebar>%s</div>", "<div class=ad>%s</div>"])
def test_articles_in_other_parts_stay_out(wrapper):
    other = wrapper % ARTICLE.replace("article is", "teaser is")
    assert htmltext.main_text(f"<body>{ARTICLE}{other}</body>") == "The text of the article is long enough."
    assert htmltext.main_text(f"<body>{other}</body>") == ""


def test_main_in_a_marked_wrapper():
    assert htmltext.main_text(f"<div class='layout sidebar-left'><div class=sidebar>Aside.</div><main>{ARTICLE}<form>Name</form></main></div>") == "The text of the article is long enough."


@pytest.mark.parametrize("name", ["search-results", "post-widget-area", "modal", "newsletter"])
def test_text_in_named_elements_only(name):
    """What is left out for such a name comes back where the page has nothing else; adverts, comments and scripts don't."""
    text = "A text that is long enough to be the main one of this page."
    assert htmltext.main_text(f"<body><div class={name}><p>{text}</p></div><script>x()</script></body>") == text


def test_teasers():
    body = "<p>" + "A paragraph of the body that says a lot. " * 10 + "</p>"
    page = f"<article><p>Teaser.</p></article><div>{body * 4}</div>"
    assert htmltext.main_text(page).startswith("Teaser. A paragraph") and htmltext.main_text(page).count("says a lot") == 40


@pytest.mark.parametrize("html", ["<b>" * 100_000 + "text" + "</i>" * 100_000, "<b>" * 50_000 + "<p>text" * 50_000, "<div>" * 100_000 + "text", "<li>x<i>" * 50_000, "<a>" * 50_000 + "x" * 9 + "</p>" * 50_000])
def test_unclosed_markup_takes_time_in_proportion(html):
    import time

    began = time.process_time()
    assert htmltext.main_text(html)
    assert time.process_time() - began < 20


UNENDED = ["<a ", '<a b="x ', "<p a='", "<!-- ", "</p ", "<!x ", "<?x ", "<![x ", "<a b='\">' ", '<a b=">" ']


@pytest.mark.parametrize("end", ["", ">", "'>", '">', "x>tail"])
@pytest.mark.parametrize("piece", UNENDED)
def test_tags_without_an_end_take_time_in_proportion(piece, end):
    import time

    began = time.process_time()
    htmltext.main_text("<p>before</p>" + piece * (100_000 if piece in UNENDED[:3] else 30_000) + end)
    assert time.process_time() - began < 5


def test_text_after_a_tag_without_an_end():
    assert htmltext.main_text("<p>before</p><p>a <b") == "before a <b"
    assert htmltext.main_text('<p>one</p><a href="x>two</a><p>three</p><p>four</p>').endswith("four")
    assert htmltext.main_text("<p>one</p><!-- open <p>two</p>") == "one two"
    assert htmltext.main_text("<p>one</p><![x[ <p>two</p><![CDATA[three]]>") == "one two"
    assert htmltext.main_text("<article><div class='a' data-x=\"it's > that\" hidden=no>gone</div><p title = y>kept</p></article>") == "kept"


LONG = "The paragraph of this page that is its main text, with enough words to be one. " * 4


@pytest.mark.parametrize("wrapper", ["<form>%s</form>", "<div class=widget-test>%s</div>", "<div class='search page'><section>%s</section></div>"])
@pytest.mark.parametrize("other", ["<div>Copyright Foo</div>", "<p>foot</p>", ""])
def test_hidden_text_against_a_line_elsewhere(wrapper, other):
    assert htmltext.main_text(f"<body>{wrapper % f'<div id=content><p>{LONG}</p></div>'}{other}</body>") == LONG.strip()
    assert LONG.strip() in htmltext.main_text(f"<body>{wrapper % '<p>short</p>'}<div><p>{LONG}</p></div></body>")
    assert "short" not in htmltext.main_text(f"<body>{wrapper % '<p>short</p>'}<div><p>{LONG}</p></div></body>")


@pytest.mark.parametrize("name", ["market-share", "social-policy", "related-work", "notice-of-motion", "searchTheory"])
def test_names_inside_an_article_count_as_a_whole(name):
    for tag in ("div", "section"):
        for attr in ("class", "id"):
            assert htmltext.main_text(f"<article><p>{LONG}</p><{tag} {attr}={name}><p>More.</p></{tag}></article>") == LONG + "More."


@pytest.mark.parametrize("name", ["share", "share-buttons", "related-posts", "social", "ad-slot", "newsletter-signup", "commentList"])
def test_marked_names_inside_an_article(name):
    assert htmltext.main_text(f"<article><p>{LONG}</p><div class={name}><p>More.</p></div></article>") == LONG.strip()


def test_comments_that_are_articles():
    page = f"<main><article><p>{LONG}</p></article><article class=comment><p>reader says</p></article><article id=comment-12>x</article></main>"
    assert htmltext.main_text(page).startswith(LONG.strip()) and "reader" not in htmltext.main_text(page)


def test_unclosed_navigation():
    assert htmltext.main_text(f"<body><nav><a href=a>home</a><ul><li>menu<article><p>{LONG}</p></article></body>") == LONG.strip()
    assert htmltext.main_text(f"<body><nav><a href=a>home</a><article><p>{LONG}</p></article></nav></body>") == ""


@pytest.mark.parametrize("between", [" ", " | ", " &middot; ", "\n"])
def test_links_without_a_name(between):
    menu = between.join(f"<a href={i}>link {i}</a>" for i in range(50))
    assert htmltext.main_text(f"<body><div>{menu}</div><div><p>{LONG}</p><p>{LONG}</p></div><div>{menu}</div></body>") == (LONG * 2).strip()
    assert htmltext.main_text(f"<body><div><p>{LONG}</p><p>See <a href=x>this</a> and <a href=y>that</a>.</p></div></body>") == LONG + "See this and that."


def plain_regions(lines):
    """Ratio, Gaussian filter and threshold as loops."""
    ratio = [max(len(t) - linked, 0) / max(tags, 1) for t, tags, linked, _, _ in lines]
    weight = {d: np.exp(-(d**2) / (2 * htmltext.SIGMA**2)) for d in range(-htmltext.RADIUS, htmltext.RADIUS + 1)}
    smooth = [sum(w * ratio[i + d] for d, w in weight.items() if 0 <= i + d < len(ratio)) / sum(weight.values()) for i in range(len(ratio))]
    mean = sum(smooth) / len(smooth)
    over = [i for i in range(len(ratio)) if smooth[i] > htmltext.SHARE * mean and ratio[i] > 0]
    return {lines[i][3] for i in over or range(len(lines))}


def test_clusters_are_the_plain_ones():
    rng = random.Random(2)
    for _ in range(300):
        lines = [("x" * rng.choice([1, 5, 40, 300]), rng.randint(0, 6), rng.choice([0, 0, 5, 40]), rng.randint(0, 5), False) for _ in range(rng.randint(1, 25))]
        want = plain_regions(lines)
        assert htmltext.clusters(lines, [True] * len(lines)) == want
        assert htmltext.content(lines) == [t for t, _, _, region, _ in lines if region in want]


def test_registered_extraction(spark):
    """The query's rows are those of the parser over each page alone."""
    from chirplake.llm import queries

    sf = "/root/testdata/sf0.001"
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in queries.op3_html_text(spark, sf).collect()}
    assert got == {p.page_id: (p.url, x := htmltext.main_text(p.html), len(x)) for p in pages}


def test_extract(spark):
    df = spark.createDataFrame([(1, PAGE, "x"), (1, PAGE, "x"), (2, None, None)], "page_id long, html string, row string")
    got = htmltext.extract(df).select("row.page_id", "row.row", "text").collect()
    assert len(got) == 3 and [r.text for r in got if r.page_id == 2] == [""]
    assert htmltext.extract(df.limit(0)).count() == 0


# op 4


def brute_groups(prints):
    group = list(range(len(prints)))
    near = [[j for j, q in enumerate(prints) if (p ^ q).bit_count() <= 4] for p in prints]
    while True:
        new = [min(group[j] for j in n) for n in near]
        if new == group:
            return group
        group = new


def plain_print(text):
    import xxhash

    found = (text or "").encode().lower().split()
    shingles = [b" ".join(found[i : i + 4]) for i in range(max(len(found) - 3, 1))] if found else []
    ones = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def test_fingerprints_are_the_plain_ones(spark):
    for text in ("", None, "One", "a b c", "a b c d", "A b\tc\x0bd e", "é " * 10, "x y " * 40_000):
        if text is None or len(text) < 1000:
            assert simhash.fingerprint(text) == plain_print(text)
    (h,) = spark.sql("select xxhash64('a b c d')").first()
    assert simhash.fingerprint("a b c d") == h % 2**64


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    docs = []
    for _ in range(30):
        base = rng.choices(words, k=rng.choice([3, 60, 300]))
        for _ in range(rng.randint(1, 12)):
            own = base.copy()
            for _ in range(rng.randint(0, 2)):
                own[rng.randrange(len(own))] = rng.choice(words)
            docs.append(" ".join(own))
    docs += ["", "  ", docs[0], docs[0]]
    df = spark.createDataFrame([(i * 3, t) for i, t in enumerate(docs)], "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.hex, r.component_id) for r in simhash.near_duplicates(df).select("row.doc_id", simhash.hex16().alias("hex"), "component_id").collect()}
    prints = [plain_print(t) for t in docs]
    groups = brute_groups(prints)
    assert got == {i * 3: (f"{p:016x}", g * 3) for i, (p, g) in enumerate(zip(prints, groups, strict=True))}


def test_every_pair_at_distance_four_is_found(spark, monkeypatch):
    """Links through the grids, with cells split into chunks, are all links."""
    from chirplake.llm import shared

    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    prints = set(base.tolist())
    for b in base.tolist():
        for d in (1, 4, 4, 5, 6):
            prints.add(b ^ int(sum(1 << int(k) for k in rng.choice(64, d, replace=False))))
    one = int(base[0])
    prints |= {one ^ (1 << k) for k in range(64)}
    prints = sorted(prints)
    nodes = spark.createDataFrame([(int(np.array(p, np.uint64).view(np.int64)),) for p in prints], "node long")
    groups = brute_groups(prints)
    for chunk in (2048, 5):
        monkeypatch.setattr(simhash, "hot_cells", lambda rows, chunk=chunk: shared.hot_cells(rows, chunk))
        links = simhash.range_join(nodes, simhash.GRIDS, ["node"], simhash.DISTANCE)
        roots = {r.node % 2**64: r.root for r in shared.components(links).collect()}
        parts = {}
        for p, g in zip(prints, groups, strict=True):
            parts.setdefault(g, set()).add(roots.get(p, p))
        assert all(len(x) == 1 for x in parts.values())
        assert len({next(iter(x)) for x in parts.values()}) == len(parts)


def test_components_with_stars(spark, monkeypatch):
    """Nodes with very many neighbours are joined apart; the components are the same."""
    from chirplake.llm import shared

    rng = random.Random(0)
    links = [(5, k) for k in range(100, 400)] + [(400 + k, 401 + k) for k in range(30)] + [(399, 400)] + [(900, 901), (901, 902)]
    rng.shuffle(links)
    monkeypatch.setattr(shared, "HOT", 8)
    got = {r.node: r.root for r in shared.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys([*range(100, 431), 5], 5), **dict.fromkeys([900, 901, 902], 900)}


def test_near_duplicates_hard_rows(spark):
    df = clashing(spark, HARD)
    got = simhash.near_duplicates(df).select("row.doc_id", "row.size", "component_id", "fp").collect()
    assert len(got) == len(HARD)
    assert {r.component_id for r in got if r.doc_id == 5} == {1} and {r.component_id for r in got if r.fp == 0} == {2}
    assert simhash.near_duplicates(df.limit(0)).count() == 0


# op 5


def test_records_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    path = tokenrecords.default_tokenizer()
    whole = Tokenizer.from_file(path)
    rows = [*HARD, (9, "Don't <|endoftext|> STOP... İ, é. \xa0x", "a"), (-4, "a", "b")]
    df = clashing(spark, rows).repartition(3)
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in tokenrecords.encode_corpus(df, path, f"file://{tmp_path}/r").collect()), key=lambda r: r[1])
    want, start = [], 0
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    index = spark.read.parquet(f"{tmp_path}/r/index").orderBy(F.rand(3))
    ids = {r.doc_id: r.ids for r in tokenrecords.read_records(index, lambda d, x: (d, x.tolist()), "doc_id long, ids array<long>", f"file://{tmp_path}/r").collect()}
    assert ids[9] == [*whole.encode(rows[-2][1], add_special_tokens=False).ids, 2]
    assert not list(tmp_path.rglob("*.tmp"))
    assert tokenrecords.encode_corpus(df.limit(0), path).count() == 0


@pytest.mark.parametrize("change", [{"normalizer": None}, {"pre_tokenizer": None}, {"normalizer": {"type": "Lowercase"}}, {}])
def test_other_tokenizers_get_whole_texts(tmp_path, change):
    """Those that join what blanks part, or read words in another way, give what the library gives; so does the known one."""
    import json

    from tokenizers import Tokenizer

    with open(tokenrecords.default_tokenizer()) as f:
        spec = json.load(f)
    (tmp_path / "t.json").write_text(json.dumps(spec | change))
    mine, lib = tokenrecords.WordEncoder(str(tmp_path / "t.json")), Tokenizer.from_file(str(tmp_path / "t.json"))
    texts = ["the end. of the   line\n", "Ab aB's 12 e\u0301 \xe9 !?", "", None, "of the of the"]
    assert [x.tolist() for x in mine.encode(texts)] == [lib.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert mine.by_words == (not change)


def test_damaged_records():
    record = bytearray(tokenrecords.frame(tokenrecords.serialize(7, np.array([1, 70_000]))))
    doc_id, ids = tokenrecords.deserialize(tokenrecords.unframe(bytes(record)))
    assert doc_id == 7 and ids.tolist() == [1, 70_000]
    for i in range(len(record)):
        bad = record.copy()
        bad[i] ^= 1
        with pytest.raises(ValueError):
            tokenrecords.unframe(bytes(bad))


# op 6


def test_pieces_are_the_library_s(spark):
    import sentencepiece

    path = suffixpieces.default_model()
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(0)
    texts = ["", "a  b", "   ", "x\n\n y", "▁ q", "ab" * 5000, "日本語 \U0001f600", " " * 37 + "a", "ﬁ", "a\x00b", "%%%### ...."]
    texts += ["".join(rng.choice("aabcde  \n.é1%▁ﬁT") for _ in range(rng.randint(0, 40))) for _ in range(500)]
    pieces = list(suffixpieces.model(path).ids)
    texts += ["".join(rng.choice(pieces).replace("▁", " ") for _ in range(rng.randint(1, 9))) for _ in range(500)]
    mine = suffixpieces.model(path).encode(texts)
    assert [m.tolist() for m in mine] == [lib.encode(t) for t in texts]
    assert [suffixpieces.model(path).decode(m) for m in mine] == [lib.decode(m.tolist()) for m in mine]


def test_the_suffix_array_meets_every_distinct_word(monkeypatch):
    """What is indexed is each distinct word of a call, whether met before or not."""
    pieces = suffixpieces.model(suffixpieces.default_model())
    met, plain = [], pieces.occurrences
    monkeypatch.setattr(pieces, "occurrences", lambda text: met.append(len(text)) or plain(text))
    texts = ["the cat and the dog", "the dog"] * 50
    for _ in range(2):
        pieces.encode(texts)
    assert met == [1 + sum(len(w) + 2 for w in ("the", "cat", "and", "dog"))] * 2


def test_pairs_kept_in_few_places(monkeypatch):
    """Pairs that clash in the table of known pairs are worked out anew."""
    import sentencepiece

    monkeypatch.setattr(suffixpieces, "PAIRS_HELD", 8)
    path = suffixpieces.default_model()
    texts = ["several words that share places", "  and\n\nblanks    in rows", "x" * 300 + "ab" * 100, "中文" * 200, "\u0301 \U0001f600"]
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    assert [m.tolist() for m in suffixpieces.Pieces(path).encode(texts)] == [lib.encode(t) for t in texts]


def message(**spec):
    """A model's fields that :func:`suffixpieces.check_kind` reads: trainer's 3, normaliser's 2 to 5."""
    normal = b"".join(bytes([k << 3, spec[n]]) for k, n in ((3, "first"), (4, "extra"), (5, "escape")) if n in spec)
    normal += bytes([2 << 3 | 2, len(spec.get("table", b""))]) + spec.get("table", b"")
    trainer = bytes([3 << 3, spec.get("kind", 2)])
    return bytes([2 << 3 | 2, len(trainer)]) + trainer + bytes([3 << 3 | 2, len(normal)]) + normal


def test_other_models_are_refused():
    suffixpieces.check_kind(message(extra=0))
    for wrong in ({"extra": 0, "kind": 1}, {"extra": 1}, {}, {"extra": 0, "first": 0}, {"extra": 0, "escape": 0}, {"extra": 0, "table": b"x"}):
        with pytest.raises(ValueError):
            suffixpieces.check_kind(message(**wrong))


def test_encode_hard_rows(spark):
    df = clashing(spark, HARD)
    got = suffixpieces.encode(df, suffixpieces.default_model()).select("row.doc_id", "ids", "n_ids", "same").collect()
    assert len(got) == len(HARD) and all(r.same and len(r.ids) == r.n_ids for r in got)
    assert suffixpieces.encode(df.limit(0), suffixpieces.default_model()).count() == 0


# op 8


def test_patience_alignment():
    rng = random.Random(0)
    for _ in range(200):
        a = [rng.choice("abcdefghijk") for _ in range(rng.randint(0, 15))]
        b = [rng.choice("abcdefghijk") for _ in range(rng.randint(0, 15))]
        pairs = licenses.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
    assert len(licenses.patience(list("abcdef"), list("abXdef"))) == 5


def longest_common(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_patience_against_the_longest_common_sequence():
    """Never more than that, and as many where no word comes twice."""
    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.choice("abcdefgh") for _ in range(rng.randint(0, 12))] for _ in range(2))
        assert len(licenses.patience(a, b)) <= longest_common(a, b)
        a, b = (rng.sample("abcdefghijkl", rng.randint(0, 12)) for _ in range(2))
        assert len(licenses.patience(a, b)) == longest_common(a, b)


def test_scan_against_every_place():
    """Texts with an edited template: found where the alignment at some place covers enough, and nowhere else."""
    rng, known = random.Random(4), licenses.Templates()
    for k in range(0, len(known.words), 2):
        for share in (0.05, 0.5):
            words = [w if rng.random() > share else "zz" for w in known.words[k]]
            text = ["before"] * 7 + words + ["after"] * 9
            best = max(len(licenses.patience(text, t)) / len(t) for t, need in zip(known.words, known.needed, strict=True) if need <= set(text))
            assert bool(known.scan(" ".join(text))) == (best >= licenses.COVERAGE)


def test_license_scan(spark):
    known = licenses.Templates()
    for name, _, text in licenses.TEMPLATES:
        for around in ("{}", "word " * 500 + "{} " + "word " * 500, "the license {} under version"):
            hits = known.scan(around.format(text))
            assert [h[0] for h in hits] == [name], (name, hits)
            assert hits[0][1] == 1.0
    assert len(known.scan("released under the mit license. " * 50)) == 50
    assert not known.scan("Released under the Foo License") and not known.scan("under the license of a version")
    edited = licenses.MIT_GRANT.replace("merge, ", "").replace("tort", "wrong")
    assert known.scan(edited)[0][0] == "MIT"
    got = licenses.scan(clashing(spark, [*HARD, (8, licenses.MIT_GRANT, "z")])).select("row.doc_id", "found").collect()
    assert len(got) == len(HARD) + 1 and [len(r.found) for r in got if r.doc_id == 8] == [1]


# op 9


def labelled(spark, n=1200, seed=0):
    rng = random.Random(seed)
    clean = [f"{a}{b}{c}" for a in ("tha", "ren", "ost") for b in ("in", "er", "ou") for c in ("st", "ly", "nd", "ti")]
    docs, labels = [], []
    for i in range(n):
        words, toxic = rng.choices(clean, k=rng.randint(5, 200)), rng.random() < 0.2
        if rng.random() < 0.2:
            words.append("vilely")  # begins like a stem, but is clean
        if toxic:
            for _ in range(1 + len(words) // 40):
                words.insert(rng.randrange(len(words)), rng.choice(["scoundrel", "vilexa", "vilero", "vilumm"]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def plain_rate(text, lexicon):
    """All places, all terms: the longest term at each place counts, unless it begins inside an exception."""
    folded = f" {toxicity.fold(text)} "
    if not folded.strip():
        return 0.0
    terms = {" " + t: w for t, w in lexicon.weights.items()} | {f" {e} ": 0.0 for e in lexicon.exceptions}
    total, clear = 0.0, 0
    for at in range(len(folded)):
        found = [t for t in terms if folded.startswith(t, at)]
        if not found:
            continue
        longest = max(found, key=len)
        if not terms[longest]:
            clear = max(clear, at + len(longest) - 1)
        elif at >= clear:
            total += terms[longest]
    return 100 * total / (len(folded.split()) + 10)


def test_matches_are_the_plain_ones():
    rng = random.Random(6)
    lexicon = toxicity.Lexicon({"bad ": 2.0, "worse": 1.5, "wor ": 0.5}, {"not bad", "worsening", "bad hair day", "bad luck"})
    found = lexicon.automaton()
    words = ["bad", "b4d", "ｂａｄ", "bád", "not", "worse", "worsen", "worsening", "hair", "day", "luck", "fine", "wor"]
    for _ in range(400):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))
        assert toxicity.rate(text, found) == pytest.approx(plain_rate(text, lexicon))


def test_folding_of_letters():
    assert toxicity.fold("Ｂａｄ 𝐛𝐚𝐝 𝓫𝓪𝓭 bäd b̶a̶d bаd") == " ".join(["bad"] * 6)


def test_exception_phrases_are_learned(spark):
    """A word that toxic texts have, but clean ones in a phrase of their own: the phrase is an exception."""
    rng = random.Random(5)
    filler = [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(400):
        text = rng.choices(filler, k=30)
        toxic = i % 4 == 0
        if toxic:
            text[rng.randrange(30)] = "vile"
        elif i % 16 == 1:
            text[10:12] = ["vile", "vortex"]
        docs.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    lexicon = toxicity.learn(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert "vile " in lexicon.weights and "vile vortex" in lexicon.exceptions
    found = lexicon.automaton()
    assert toxicity.rate("w1 vile vortex w2", found) == 0 < toxicity.rate("w1 vile w2", found)


def test_toxicity(spark):
    docs, labels = labelled(spark)
    lexicon = toxicity.learn(docs, labels)
    scored = toxicity.toxicity(docs, lexicon).select("row.doc_id", "score").join(labels, "doc_id").withColumn("held_out", toxicity.held_out()).collect()
    held = [r for r in scored if r.held_out]
    assert len(held) > 200 and all(0 <= r.score <= 1 for r in scored)
    right = sum((r.score >= toxicity.THRESHOLD) == bool(r.toxic) for r in held)
    assert right / len(held) > 0.97, lexicon
    # labels of held-out rows change nothing
    other = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.learn(docs, other).weights == lexicon.weights


def test_folding_and_exceptions():
    lexicon = toxicity.Lexicon({"idiot ": 5.0, "vil": 5.0}, {"vilely", "idiot savant"})
    found = lexicon.automaton()
    hits = lambda t: toxicity.rate(t, found) > 0
    assert hits("you IDIOT!") and hits("1d10t") and hits("іdiоt") and hits("i​diot") and hits("vilest")
    assert not hits("idiots") and not hits("vilely") and not hits("an idiot savant") and not hits("") and not hits(None) and not hits("2010 10:30")
    assert toxicity.rate("idiot", found) > toxicity.rate("idiot " + "word " * 100, found)
    assert not toxicity.Lexicon({}).automaton() and toxicity.rate("x", toxicity.Lexicon({}).automaton()) == 0


def test_toxicity_hard_rows(spark):
    df = clashing(spark, HARD)
    labels = spark.createDataFrame([(1, 0), (1, 1), (None, 1), (2, None)], "doc_id long, toxic int")
    lexicon = toxicity.learn(df, labels)
    got = toxicity.toxicity(df, lexicon).select("row.doc_id", "score").collect()
    assert len(got) == len(HARD) and all(0 <= r.score < toxicity.THRESHOLD for r in got)
    assert toxicity.toxicity(df.limit(0), lexicon).count() == 0


# op 10


def brute_lines(docs):
    """Texts without later windows, document by document."""
    first, out = {}, []
    for key, text in docs:
        lines = text.split("\n")
        full = [(i, l.strip(" \t\r\x0b\x0c")) for i, l in enumerate(lines) if l.strip(" \t\r\x0b\x0c")]
        gone = set()
        for k in range(len(full) - 2):
            window = tuple(l for _, l in full[k : k + 3])
            doc, at = first.setdefault(window, (key, k))
            if (doc, at) != (key, k):
                gone |= {full[k + j][0] for j in range(3) if doc != key or k + j >= at + 3}
        out.append("\n".join(l for i, l in enumerate(lines) if i not in gone))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_line_dedup(spark, seed):
    rng = random.Random(seed)
    docs = []
    for i in range(120):
        lines = [rng.choice(["a", "b", "c ", " d", "", f"own {i} {rng.random()}"]) for _ in range(rng.randint(0, 14))]
        docs.append((i, "\n".join(lines)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.text for r in linededup.dedup_lines(df).select("row.doc_id", "text").collect()}
    assert [got[i] for i, _ in docs] == brute_lines(docs)


def test_line_dedup_hard_rows(spark):
    df = clashing(spark, [*HARD, (8, "z\n" * 40_000, "q")])
    got = {(r.doc_id, r.text) for r in linededup.dedup_lines(df).select("row.doc_id", "text").collect()}
    assert (1, HARD[0][1]) in got and (5, "") in got and (2, None) in got and (3, "") in got and (8, "z\nz\nz\n") in got
    assert linededup.dedup_lines(df).count() == len(HARD) + 1
    assert linededup.dedup_lines(df.limit(0)).count() == 0
