"""Operators on pages and vectors against brute force."""

import base64
import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from recordloom.llm import html_text, vectors, warc
from recordloom.llm.common import components
from tests.llm.conftest import clashing

PAGES = "page_id bigint, url string, html string"

# ── 5 ────────────────────────────────────────────────────────────────

P = "This is a paragraph of the article that holds quite a number of words, so it counts."


@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), ("<p></p>", ""), ("just text", "just text"),
    (f"<nav><a href=x>Home</a></nav><article><h1>T &amp; U</h1><p>{P}<p><b>bo</b>ld<br>line</article><footer>F</footer>",
     f"T & U {P} bold line"),
    (f"<body><div class='sidebar'><p>{P}</p></div><div id=main><p>{P}</p><p>{P}</p></div></body>", f"{P} {P}"),
    (f"<article><p>{P}</p><form>Search</form><script>var a='<p>no</p>'</script><style>p{{}}</style></article>"
     f"<section id='comments'><p>{P}</p></section>", P),
    (f"<main><header><h1>T</h1></header><p>{P}</p><aside>no</aside></main>", f"T {P}"),
    (f"<div><ul><li><a href=a>one</a><li><a href=b>two</a></ul></div><div><p>{P}</p><p>{P}</p><p>{P}</p></div>",
     f"{P} {P} {P}"),
    (f"<!-- <p>no</p> --><article><p>a\n\t b&nbsp;c &#233;&lt;</p><p>{P}", f"a b c é< {P}"),
    (f"<article><p>{P}</p><div class=\"cookie-notice\">We use cookies</div><p hidden>no</p></article", P),
    (f"<article>{'<div>' * 3000}{P}{'</div>' * 3000}</article>", P),
    ("<article><h1>Short</h1><p>One.</p></article><footer><p>" + P + "</p></footer>", "Short One."),
])
def test_main_text(page, want):
    assert html_text.extract(page) == want


def test_density_follows_its_formula():
    root = html_text.parse("<body><div><p>abcd efgh</p><p><a>link</a> text</p></div></body>")
    html_text.measure(root)
    div = root.children[0]
    first, second = div.children
    assert (div.chars, div.tags, div.link_chars, div.link_tags) == (16, 3, 4, 1)
    assert np.isclose(first.density, 8 * np.log(8) / np.log(np.log(np.e + 0.25 * 8)))
    assert np.isclose(second.density, 8 * np.log(2) / np.log(np.log(8 / 4 * 4 + 0.25 * 8 + np.e)))
    assert div.total == first.density + second.density


@pytest.mark.parametrize("nav", ["", "<nav><a href=x>Home</a> <a href=y>News</a></nav>"])
def test_density_decides_without_links_or_telling_names(nav):
    page = f"<body>{nav}<div><div>Buy our socks</div><div><p>{P}</p><p>{P}</p><p>{P}</p></div><div>Only now</div></div>"
    assert html_text.extract(page) == f"{P} {P} {P}"
    root = html_text.parse(page)
    assert all(n.density > 0 for n in html_text.measure(root) if n.chars > 1)


def test_link_share_is_that_of_the_whole_page():
    root = html_text.parse("<nav><a>abcd</a></nav><p>abcd efgh</p>")
    html_text.measure(root)
    assert np.isclose(root.children[1].density, 8 * np.log(8) / np.log(np.log(np.e + 4 / 12 * 8)))


S = "A short one of a few words."


@pytest.mark.parametrize("page, want", [
    # Two sections, of long and of short paragraphs.
    (f"<main><section><h2>A</h2>{f'<p>{P} {P}</p>' * 5}</section><section><h2>B</h2>{f'<p>{P}</p>' * 5}</section></main>",
     " ".join(["A", *[f"{P} {P}"] * 5, "B", *[P] * 5])),
    (f"<div><section>{f'<p>{P}</p>' * 5}</section><section><p>{S}</p></section><div>Buy it</div></div>",
     " ".join([*[P] * 5, S])),
    # Sections that are plain containers.
    (f"<div><div>Buy it</div><div>{f'<p>{P}</p>' * 2}</div><div>{f'<p>{P}</p>' * 5}</div></div>", " ".join([P] * 7)),
    # A list, a table and a quotation beside fewer paragraphs.
    (f"<div><h1>T</h1><p>{P}</p><ul>{f'<li>{P}</li>' * 9}</ul><p>{S}</p></div>", " ".join(["T", P, *[P] * 9, S])),
    (f"<div><p>{P}</p><table>{f'<tr><td>{P}</td></tr>' * 9}</table><p>{S}</p></div>", " ".join([P, *[P] * 9, S])),
    (f"<div><p>{S}</p><blockquote>{f'<p>{P}</p>' * 9}</blockquote></div>", " ".join([S, *[P] * 9])),
    # Further articles, an intro, and text outside any block.
    (f"<main><p>{P}</p><article>{f'<p>{P}</p>' * 6}</article><article>{f'<p>{P}</p>' * 3}</article></main>",
     " ".join([P] * 10)),
    (f"<body>{P} <b>{P}</b> {P}<div>{f'<p>{P}</p>' * 5}</div></body>", " ".join([P] * 8)),
    (f"<body><div>Buy it</div><article><p>{P}</p></article></body>", P),
])
def test_other_branches_that_reach_the_threshold(page, want):
    assert html_text.extract(page) == want


@pytest.mark.parametrize("part, text", [
    ('<h2 id="related-work">Related</h2>', "Related"), ('<h2 id="legal-basis">Law</h2>', "Law"),
    ('<div class="entry-header"><h1>Title</h1></div>', "Title"), ('<div class="side-by-side">Both</div>', "Both"),
    ('<p id="navy">Blue</p>', "Blue"), ('a <span class="search-term">word</span> here', "a word here"),
    ('<a title="the hidden valley" href=x>Valley</a> road', "Valley road"),
    ("<p title='a class=ad b'>Text</p>", "Text"), ('<section id="comments-on-law">Law</section>', "Law"),
    ('<div class="notice">Mind the gap</div>', "Mind the gap"), ('<div class="header"><h1>T</h1></div>', "T"),
    ('<div class="box ad-slot">no</div>', ""), ('<div class=sidebar>no</div>', ""), ("<div class='share'>no</div>", ""),
    ('<section id="comments">no</section>', ""), ('<p title="x" hidden>no</p>', ""), ('<div aria-hidden=TRUE>no</div>', ""),
])
def test_names_take_away_regions_only(part, text):
    assert html_text.extract(f"<article><p>{P}</p>{part}<p>{P}</p></article>") == " ".join(f"{P} {text} {P}".split())


@pytest.mark.parametrize("name", ["footer", "site-header", "main-nav", "legal", "search-form", "cookie-notice", "ads"])
def test_names_outside_the_article(name):
    page = f"<div><p>{P}</p><p>{P}</p></div>"
    assert html_text.extract(f"<body>{page}<div class='x {name}'>{P} {P}</div></body>") == f"{P} {P}"
    assert html_text.extract(f"<body>{page}<div id='{name}'>{P} {P}</div></body>") == f"{P} {P}"


def test_extract_pages(spark):
    rows = [(1, "u", f"<article><p>{P}</p></article>"), (1, "u", None), (None, None, ""), (2, "v", "<p>" + "é " * 60_000)]
    got = html_text.extract_pages(clashing(spark.createDataFrame(rows, PAGES))).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 0), (1, 0), (1, len(P)), (2, 119_999)]
    assert html_text.extract_pages(spark.createDataFrame([], PAGES)).count() == 0


# ── 6 ────────────────────────────────────────────────────────────────


def test_archives_round_trip(spark):
    rng = random.Random(12)
    body = lambda: f"<p>{''.join(rng.choice('abcdé ') for _ in range(rng.randint(0, 900)))}</p>\r\n\r\n"
    rows = [(k, f"http://x/{k}%\n", body()) for k in range(200)] + [(300, None, None), (301, "u", ""), (302, "u", "x" * 10**6)]
    rows += [(k, "u", rows[3][2]) for k in range(400, 420)] + [(None, "u", rows[3][2]), (302, "u", "x" * 10**6)]
    pages = clashing(spark.createDataFrame(rows, PAGES).repartition(3))
    manifest = warc.write_archives(pages, archive_bytes=20_000, sample_bytes=8_000, dictionary_bytes=2_000)
    assert manifest.count() > 3
    got = warc.read_archives(manifest, with_payload=True).collect()
    largest = defaultdict(int)
    for k, _, h in rows:
        largest[h or ""] = max(largest[h or ""], k or 0)
    assert len(got) == len(rows)
    texts = {k: (u, h or "") for k, u, h in rows}
    for r in got:
        url, text = texts[r.page_id]
        data = text.encode()
        assert r.url == url and r.payload_bytes == len(data)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        first = r.page_id is None or r.page_id == largest[text]
        assert (r.record_type, r.refers_to) == (("response", None) if first else ("revisit", largest[text]))
        assert r.payload is None if not first else bytes(r.payload) == data


def test_small_payloads_are_all_responses_and_empty_tables_write_nothing(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], PAGES)
    got = warc.read_archives(warc.write_archives(pages, least_bytes=3)).collect()
    assert {r.page_id: r.refers_to for r in got} == {1: None, 2: None, 3: 4, 4: None}
    assert warc.read_archives(warc.write_archives(pages.filter("false"))).count() == 0


def test_an_archive_names_its_dictionary_first(spark, tmp_path):
    archive = warc.Archive(f"file://{tmp_path}", 500, 1000, 3)
    records = [warc.record_bytes("response", {"k": str(n)}, b"some shared words " * 9 + bytes([n])) for n in range(50)]
    for r in records:
        archive.add(r)
    archive.close()
    with open(archive.path, "rb") as file:
        assert int.from_bytes(file.read(4), "little") == warc.DICTIONARY_FRAME
        size = int.from_bytes(file.read(4), "little")
        file.seek(8 + size)
        assert int.from_bytes(file.read(4), "little") == warc.DATA_FRAME
    assert list(warc.read_archive(f"file://{archive.path}")) == records


# ── 9 ────────────────────────────────────────────────────────────────

VECTORS = "vec_id bigint, embedding array<float>, label int"


def brute_links(rows, threshold):
    unit = {}
    for k, v, label in rows:
        v = None if v is None or label is None or any(x is None for x in v) else np.array(v, np.float32).astype(float)
        if v is not None and len(v) and np.isfinite(v).all() and v.any():
            unit[k] = (label, v / np.linalg.norm(v))
    near = {k: {j for j, (m, w) in unit.items() if j != k and m == label and len(w) == len(v) and v @ w >= threshold}
            for k, (label, v) in unit.items()}
    low = {k: k for k, _, _ in rows}
    while True:
        new = {k: min([low[k], *(low[j] for j in near.get(k, ()))]) for k in low}
        if new == low:
            return {k: (len(near.get(k, ())), low[k]) for k in low}
        low = new


def test_linked_vectors(spark):
    rng = np.random.default_rng(13)
    rows = []
    for label in range(3):
        for c in range(12):  # clusters wide enough to lie across the borders of cells
            centre = rng.normal(size=8)
            for _ in range(20):
                rows.append((len(rows), (centre / np.linalg.norm(centre) + 0.06 * rng.normal(size=8)).tolist(), label))
    same = rows[5][1]
    rows += [(1000 + k, same, 0) for k in range(5)] + [
        (1100, None, 0), (1101, [0.0] * 8, 0), (1102, [float("nan")] * 8, 0), (1103, same, None), (1104, [None, *same[1:]], 0),
        (1105, [1e30 * x for x in same], 0), (1106, same[:4], 0), (1107, [], 0), (1108, [float("inf")] * 8, 0)]
    frame = clashing(spark.createDataFrame(rows, VECTORS))
    for cells in (10_000, 40):
        got = vectors.link_vectors(frame, cell_rows=cells, block_rows=16, sample_rows=100).collect()
        assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute_links(rows, 0.98)
        assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_repeated_and_nameless_vectors(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1)]
    got = vectors.link_vectors(spark.createDataFrame(rows, VECTORS)).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id) for r in got) == [(0, 0, None), (1, 1, 1), (1, 1, 1)]
    assert vectors.link_vectors(spark.createDataFrame([], VECTORS)).count() == 0


def test_components(spark):
    rng = random.Random(14)
    edges = [(k, k + 1) for k in range(0, 200)] + [(500, k) for k in range(501, 560)] + [(7, 7)]
    edges += [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    low = {k: k for e in edges for k in e}
    for _ in range(250):
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    assert got == {k: v for k, v in low.items() if any(k in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# ── 5: names, links, and the formula ─────────────────────────────────


@pytest.mark.parametrize("page, want", [
    (f'<div class="no-sidebar"><article><p>{P}</p><p>{P}</p></article></div>', f"{P} {P}"),
    (f'<div class="content-sidebar-wrap"><main><p>{P}</p></main><div class=sidebar>{P} {P} {P}</div></div>', P),
    (f'<article>{f"<div class=elementor-widget><p>{P}</p></div>" * 3}<div class=sidebar>no</div></article>', f"{P} {P} {P}"),
    (f'<div class="elementor-widget elementor-widget-text-editor"><p>{P}</p><p>{P}</p></div>', f"{P} {P}"),
    (f'<div class="menu"><p>{P}</p><p>{P}</p></div><div>Buy it</div>', f"{P} {P}"),
    (f'<div class="search"><p>{P}</p></div>', P),
    (f"<article><p>{P}</p><ul>{''.join(f'<li><a href=r{n}>Reference number {n}</a></li>' for n in range(5))}</ul></article>",
     " ".join([P, *(f"Reference number {n}" for n in range(5))])),
    (f'<article><p>{P}</p></article><div class="reader-responses"><p>{P}</p><p>{P}</p></div>', P),
    (f'<article><p>{P}</p></article><section id="comments">{f"<p>{P}</p>" * 9}</section>', P),
])
def test_a_name_on_most_of_a_text_says_nothing(page, want):
    assert html_text.extract(page) == want


def slow_measure(node, share):
    """(characters, tags, link characters, link tags) of a subtree by recursion,
    with densities and sums by node."""
    out = {}

    def visible(n):
        return [c for c in n.children if isinstance(c, str) or not c.aside and c.tag not in html_text.RAW]

    def text(n):
        return "".join("".join(c.split()) if isinstance(c, str) else text(c) for c in visible(n))

    def nodes(n):
        return [c for c in visible(n) if not isinstance(c, str)]

    def below(n):
        return [d for c in nodes(n) for d in (c, *below(c))]

    def link_text(n):
        return text(n) if n.tag == "a" else "".join(link_text(c) for c in nodes(n))

    def density(c, t, l, k):
        if not c:
            return 0.0
        inner = (c / max(l, 1)) * (max(t, 1) / max(k, 1))
        base = np.log(max(1.0, c / max(1, c - l) * l + share * c) + np.e)
        return c / max(t, 1) * np.log(inner) / np.log(base) if inner > 1 else 0.0

    def visit(n):
        d = density(len(text(n)), len(below(n)), len(link_text(n)), sum(x.tag == "a" for x in below(n)))
        loose = [c for c in nodes(n) if c.tag in html_text.INLINE]
        own = density(
            sum(len("".join(c.split())) for c in visible(n) if isinstance(c, str)) + sum(len(text(c)) for c in loose),
            sum(1 + len(below(c)) for c in loose), sum(len(link_text(c)) for c in loose),
            sum(x.tag == "a" for c in loose for x in (c, *below(c))))
        total = sum(visit(c) for c in nodes(n) if c.tag not in html_text.INLINE)
        for c in nodes(n):
            if c.tag in html_text.INLINE:
                visit(c)
        out[id(n)] = (d, total + (own if n.tag not in html_text.INLINE else 0.0))
        return d

    visit(node)
    return out


def random_page(rng, depth=0):
    parts = []
    for _ in range(rng.randrange(1, 5)):
        kind = rng.random()
        if kind < 0.35 or depth > 4:
            parts.append("<p>" + " ".join(rng.choice(["word", "longer", "a"]) for _ in range(rng.randrange(1, 30))) + "</p>")
        elif kind < 0.5:
            parts.append("<a href=x>link text</a> ")
        elif kind < 0.6:
            parts.append("loose <b>bold</b> text ")
        else:
            parts.append(f"<div>{random_page(rng, depth + 1)}</div>")
    return "".join(parts)


def test_the_formula_by_recursion():
    rng = random.Random(4)
    for _ in range(60):
        page = f"<body>{random_page(rng)}</body>"
        root = html_text.parse(page)
        nodes = html_text.measure(root)
        want = slow_measure(root, html_text._link_share(root))
        for n in nodes:
            assert np.isclose(n.density, want[id(n)][0]) and np.isclose(n.total, want[id(n)][1])
        best = max(want.values(), key=lambda v: v[1])[1]
        assert np.isclose(max(n.total for n in nodes), best)
        assert html_text.extract(page)


# ── 6: the format ────────────────────────────────────────────────────


def test_records_are_valid_and_urls_are_kept(spark):
    import re

    urls = ["https://a/b%20c", "https://a/b?x=1&y=%25", "line\nbreak", " padded ", None]
    rows = [(k, u, f"<p>{'x' * 50}{k}</p>") for k, u in enumerate(urls)]
    rows += [(10, "u", "same"), (11, "u", "same"), (12, "u", "same"), (12, "u", "same"), (None, "u", "same")]
    manifest = warc.write_archives(spark.createDataFrame(rows, PAGES).repartition(2))
    got = warc.read_archives(manifest).collect()
    assert {r.page_id: r.url for r in got if r.page_id is not None and r.page_id < 10} == dict(enumerate(urls))
    ids = []
    for path in [r.path for r in manifest.collect()]:
        for data in warc.read_archive(path):
            head, block = data.split(b"\r\n\r\n", 1)
            version, *lines = head.decode().split("\r\n")
            fields = dict(re.fullmatch(r"([A-Za-z0-9-]+): (.*)", line).groups() for line in lines)
            assert version == "WARC/1.1" and re.fullmatch(r"<urn:uuid:[0-9a-f-]{36}>", fields["WARC-Record-ID"])
            assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", fields["WARC-Date"])
            assert fields["WARC-Type"] in ("response", "revisit")
            assert int(fields["Content-Length"]) == len(block) - 4 and block.endswith(b"\r\n\r\n")
            assert block.startswith(b"HTTP/1.1 200 OK\r\n")
            assert fields.get("WARC-Target-URI") != "https://a/b%2520c"
            ids.append((fields["WARC-Record-ID"], fields.get("WARC-Refers-To")))
    assert len({i for i, _ in ids}) == len(ids) == len(rows)
    # The id of a row that is there twice names no single record.
    assert all(to is None or to in {i for i, _ in ids} for _, to in ids)
    assert sum(r.record_type == "revisit" for r in got) == 2 and {r.refers_to for r in got} == {None, 12}


# ── 9: repeated ids ──────────────────────────────────────────────────


def brute_rows(rows, threshold):
    """Each row by its place: links, and the smallest id it is joined with."""
    unit = [np.array(v, np.float32).astype(float) for _, v, _ in rows]
    unit = [v / np.linalg.norm(v) for v in unit]
    near = [{j for j in range(len(rows)) if j != i and rows[i][2] == rows[j][2] and unit[i] @ unit[j] >= threshold}
            for i in range(len(rows))]
    low = [r[0] for r in rows]
    while True:
        new = [min([low[i], *(low[j] for j in near[i])]) for i in range(len(rows))]
        if new == low:
            return sorted((r[0], len(n), c) for r, n, c in zip(rows, near, low))
        low = new


def test_ids_that_repeat_do_not_join_labels_or_vectors(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(1, a, 1), (2, a, 1), (1, a, 2), (3, a, 2), (4, a, 2), (7, a, 3), (7, [1.0, 0.01, 0.0], 3), (8, b, 3), (8, b, 3)]
    rng = np.random.default_rng(3)
    for label in (4, 5):
        for c in range(6):
            centre = rng.normal(size=3)
            rows += [(int(rng.integers(100, 130)), (centre + 0.05 * rng.normal(size=3)).tolist(), label) for _ in range(12)]
    for cells in (None, 10):
        got = vectors.link_vectors(spark.createDataFrame(rows, VECTORS), cell_rows=cells).collect()
        assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == brute_rows(rows, 0.98)


def test_labels_of_the_tables_have_several_cells(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    unit = table.selectExpr("cast(label as bigint) as label", "unhex(hex(vec_id)) as key",
                            "transform(embedding, x -> cast(x as double)) as unit")
    found = vectors.fit_cells(unit, None, 4096, 20_000, 3)
    assert len(found) == table.select("label").distinct().count() and min(map(len, found.values())) >= 3
