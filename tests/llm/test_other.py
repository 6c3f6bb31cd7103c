"""Pseudonyms, HTML, exact search, components and the pipeline against brute force and planted cases."""

import hashlib
import importlib
import random
import re
from collections import Counter
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import html_text, jaccard, lines, mixing, nearest, pseudonyms, quality
from tessera.llm.components import components
from tests.llm.helpers import documents, empty, frame, words
from tests.llm.test_documents import brute_lines, brute_links, brute_quality, key

# --- pseudonyms


def permute(values, radix, kind, key):
    s = list(values)
    half = len(s) // 2
    for k in range(pseudonyms.ROUNDS):
        front = k % 2 == 0
        other = ",".join(map(str, s[half:] if front else s[:half]))
        for i in range(len(s)):
            if (i < half) == front:
                d = hashlib.sha256(f"{key}|{kind}|{k}|{i // 8}|{other}".encode()).hexdigest()
                s[i] = (s[i] + int(d[i % 8 * 8 : i % 8 * 8 + 8], 16)) % radix[i]
    return s


def luhn(d):
    return sum(x - 9 * (x > 9) for x in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d)))) % 10


def replaced(spark, *texts, key=pseudonyms.KEY):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [r.text for r in pseudonyms.replace(df, key=key).orderBy("i").collect()]


def test_feistel_equals_plain_python_and_permutes(spark):
    values = [[a, b, c] for a in range(7) for b in range(3) for c in range(5)]
    df = spark.createDataFrame([(v,) for v in values], "v array<long>")
    radix = F.array(*[F.lit(x).cast("long") for x in (7, 3, 5)])
    got = [list(r.x) for r in df.select(pseudonyms.feistel(F.col("v"), radix, "kind", "k").alias("x")).collect()]
    assert sorted(got) == values
    assert got == [permute(v, (7, 3, 5), "kind", "k") for v in values]


def test_formats_stay_and_values_stay_linked(spark):
    a, b, c, d, e = replaced(spark, "pay 4111 1111 1111 1111 now", "4111-1111-1111-1111", "GB82 WEST 1234 5698 7654 32!", "on 1987-03-14", "born 14.03.1987 or 14/03/1987")
    card = re.search(r"\d{4} \d{4} \d{4} \d{4}", a)[0]
    assert card.replace(" ", "-") == b and card != "4111 1111 1111 1111" and card.startswith("4111 11") and luhn(card.replace(" ", "")) == 0
    iban = c[:-1].replace(" ", "")
    assert iban != "GB82WEST12345698765432" and int("".join(str(int(x, 36)) for x in iban[4:] + iban[:4])) % 97 == 1
    y, m, day = re.search(r"(\d{4})-(\d\d)-(\d\d)", d).groups()
    date(int(y), int(m), int(day))
    assert e == f"born {day}.{m}.{y} or {day}/{m}/{y}" and (y, m, day) != ("1987", "03", "14")
    ssn, ip, phone, mail, token = replaced(spark, "123-45-6789", "10.0.0.1", "+1 (017) 555-7713", "Jo.ann7@mail.example.com", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"')
    assert re.fullmatch(r"\d{3}-\d{2}-\d{4}", ssn) and ssn != "123-45-6789"
    assert all(0 <= int(x) <= 255 for x in ip.split(".")) and ip != "10.0.0.1"
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", phone) and phone != "+1 (017) 555-7713"
    assert re.fullmatch(r"[A-Z][a-z]\.[a-z]{3}\d@mail\.example\.com", mail) and mail != "Jo.ann7@mail.example.com"
    assert re.fullmatch(r'token = "[0-9a-f]{40}"', token) and "24be" not in token
    assert replaced(spark, "123-45-6789", key="another") != [ssn]


def test_what_isnt_valid_stays(spark):
    texts = ["4111111111111112", "9807915762804490", "1987-02-30", "31.02.2000", "000-12-3456", "666-12-3456", "999.1.1.1", "GB83 WEST 1234 5698 7654 32", "version 3. and 4.0.", "a@b", "12 34 56", "x" * 50_000, "token of love", "", None]
    assert replaced(spark, *texts) == texts


def test_the_longest_valid_part_is_replaced(spark):
    card, iban = replaced(spark, "4111 1111 1111 1111", "BE68 5390 0754 7034")
    plain = iban.replace(" ", "")
    pairs = [
        ("4111 1111 1111 1111 12/25", card + " 12/25"),
        ("4111 1111 1111 1111 123", card + " 123"),
        ("9999 4111 1111 1111 1111 5", "9999 " + card + " 5"),  # a failed candidate covers its start
        ("AB12 4111 1111 1111 1111", "AB12 " + card),
        ("+4111 1111 1111 1111", "+" + card),
        ("BE68 5390 0754 7034 BIC KREDBEBB", iban + " BIC KREDBEBB"),
        ("BE68539007547034 2024 4111 1111 1111 1111 4111 1111 1111 1111.", f"{plain} 2024 {card} {card}."),
        ("𝒳é 4111 1111 1111 1111 𝒳" * 400, f"𝒳é {card} 𝒳" * 400),
        ("4111 1111 1111 1112 12/25", "4111 1111 1111 1112 12/25"),
    ]
    assert replaced(spark, *[a for a, _ in pairs]) == [b for _, b in pairs]
    phone, alone, both = replaced(spark, "+1 (843) 555-7672 2024-13-45 1215", "+1 (843) 555-7672", "+1 (843) 555-7672 170.106.12.34")
    assert phone == alone + " 2024-13-45 1215" and alone != "+1 (843) 555-7672"
    assert both == f"{alone} {replaced(spark, '170.106.12.34')[0]}"


def test_domains_of_many_labels_and_empty_ones(spark):
    texts = ["a@1" + ".1" * 100_000, "a@b..com", "Jo@b.com..x", "jo.x@mail.example.com.1"]
    got = replaced(spark, *texts)
    assert got[:2] == texts[:2]
    assert re.fullmatch(r"[A-Z][a-z]@b\.com\.\.x", got[2]) and got[2] != texts[2]
    assert re.fullmatch(r"[a-z]{2}\.[a-z]@mail\.example\.com\.1", got[3]) and got[3] != texts[3]


def test_pseudonyms_frame(spark):
    rows = documents() + [(800, "19@mail5.example.com and 19@mail5.example.com", "en", "a", 1, "x", 7, "y", 1.5)]
    out = pseudonyms.replace(frame(spark, rows), counts=True)
    assert out.columns == [*frame(spark).columns, "n_found", "n_replaced", "kinds"]
    got = sorted(((r.doc_id, r.text, r.n_replaced) for r in out.filter("doc_id <> 800 or doc_id is null").collect()), key=key)
    assert got == sorted(((r[0], r[1], 0) for r in documents()), key=key)
    two = out.filter("doc_id = 800").first()
    x, y = two.text.split(" and ")
    assert x == y != "19@mail5.example.com" and (two.n_found, two.n_replaced, two.kinds) == (2, 2, "email")
    assert pseudonyms.replace(empty(spark)).count() == 0


# --- columns named like helper columns

HELPERS = "__m __v __c __n __a __t __w __l __kept __one __d __gone __row __h __k __r __at __bits m v c n a t w l d i h k q gone kept copy at".split()


def test_helper_columns_clash_with_nothing(spark):
    rows = [(i, "a line of some words that all the documents of this small table share\n" + words(random.Random(i // 2), 90 + i), "s", *range(len(HELPERS))) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{h}` int" for h in HELPERS)).cache()
    plain = docs.select("doc_id", "text", "source")
    for apply in (pseudonyms.replace, quality.keep_good, lines.dedup, jaccard.keep_first, mixing.mix):
        got, want = apply(docs), apply(plain)
        assert got.columns[: len(docs.columns)] == docs.columns, apply
        assert sorted(map(tuple, got.select("doc_id", "text").collect())) == sorted(map(tuple, want.select("doc_id", "text").collect())), apply
        assert all(tuple(r)[3 : len(docs.columns)] == tuple(range(len(HELPERS))) for r in got.collect()), apply
    for apply in (quality.judge, jaccard.link, mixing.digest):
        assert sorted(map(tuple, apply(docs).collect())) == sorted(map(tuple, apply(plain).collect())), apply


# --- HTML


def site(spark, pages):
    return {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string, text string, host string")).collect()}


def test_templates_go_and_articles_stay(spark):
    shell = "<html><head><title>t</title></head><body><div><ul><li>Home</li><li>About</li></ul></div>{}<div>All rights reserved by us</div></body></html>"
    pages = [(i, f"http://h.x/{i}", shell.format(f"<div><p>Story {i} is long enough to be content</p><p>Once upon a time</p><p>{words(random.Random(i), 20)}</p></div>"), "c", "c") for i in range(20)]
    pages += [(50, "http://other.x/1", shell.format("<p>alone</p>"), "c", "c"), (51, None, None, "c", "c"), (52, "http://h.x/0", "", "c", "c")]
    got = site(spark, pages)
    assert len(got) == 23 and got[51] == got[52] == ""
    assert all(got[i].startswith(f"Story {i} is") and "Home" not in got[i] and "rights" not in got[i] for i in range(20))
    assert "alone" in got[50] and "rights" in got[50]  # one page doesn't make a template


def test_templates_without_names(spark):
    """Navigation, adverts and footers of plain divisions, each on 10 of 320 pages of a host, with a recount of all hosts."""
    page = "<body><div><a href=/a>Menu {0}</a><a href=/b>More</a></div><div><p>Story {1} on its own</p><p>Once upon a time {3}</p><p>{2}</p></div><div><p>Buy {0} now</p></div><div>Rights of {0}</div></body>"
    rows = [(i, f"http://{'hot' if i < 320 else i % 7}.x/{i}", page.format(i % 32, i, words(random.Random(i), 25), i % 10), "", "") for i in range(340)]
    got = site(spark, rows)
    assert all(got[i] == f"Story {i} on its own\nOnce upon a time {i % 10}\n{words(random.Random(i), 25)}" for i in range(320))

    seen, sizes = {}, Counter()
    for host, html in {(r[1].split("/")[2], r[2]) for r in rows}:
        sizes[host] += 1
        for h, around, alone in html_text.subtrees(html, html_text.parse(html)):
            seen.setdefault((host, h), {}).setdefault(around, set()).add(alone)
    for i, url, html, *_ in rows:
        host, drop = url.split("/")[2], set()
        for (name, h), places in seen.items():
            n, alone = len(places), sum(True in x for x in places.values())
            if name == host and (alone >= 5 or (n >= 5 and n >= 0.2 * sizes[host])):
                drop.add(h)
        root = html_text.parse(html)
        html_text.drop_templates(html, root, frozenset(drop))
        assert got[i] == html_text.text_of(root)


def test_copies_of_a_page_are_not_templates(spark):
    body = "<body><div><p>The same story on every page, word for word.</p></div></body>"
    got = site(spark, [(i, f"http://h.x/{i}", body, "", "") for i in range(30)])
    assert set(got.values()) == {"The same story on every page, word for word."}


def test_paragraphs_of_articles_may_recur(spark):
    pages = [(i, f"//h.x/{i}", f"<nav>menu {i % 2}</nav><article><p>And therhean is the is esndha and this is a line of many pages.</p><p>own {i}</p></article>", "", "") for i in range(30)]
    assert all(t == f"And therhean is the is esndha and this is a line of many pages.\nown {i}" for i, t in site(spark, pages).items())


@pytest.mark.parametrize(
    "page, text",
    [
        ("<p>a &amp; b&nbsp;c &#233;&copy</p>", "a & b c é©"),
        ("<article><h1>T</h1><p><b>x<br><p>y  \n z</p></article><footer>f", "T\nx\ny z"),
        ("<body><header>h</header><nav>n</nav><aside>s</aside><form>f</form><script>if (a<b) '</p>'</script><style>p{}</style><!-- c --><p>k", "k"),
        ("<div class='cookie-notice'>c</div><div class=ad>a</div><div id=comments>r</div><div role='navigation'>m</div><div class=leadership>ok</div>", "ok"),
        ("<main><p>in</p><div class='sidebar'>s</div></main><p>out</p>", "in"),
        ("<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table>", "a\nb\nc\nd\ne"),
        ("text < 3 and <b>bold</b>text</i></p> end", "text < 3 and boldtext end"),
        ("<p title='a > b'>x</p><p hidden>y</p><p style='display:none'>z</p>", "x"),
        ("<article><p>" + "w " * 50_000 + "</p></article>", ("w " * 50_000).strip()),
        ("<div>" * 5000 + "deep" + "</div>" * 5000, "deep"),
        ("<![CDATA[a < b]]>", "a < b"),
        ("", ""),
        ("<script>never closed", ""),
    ],
)
def test_parsing(page, text):
    assert html_text.text_of(html_text.parse(page)) == text


@pytest.mark.parametrize(
    "page, text",
    [
        ("<p><a href='/the-hidden-valley'>link</a> text</p><p title=\"The hidden valley\">q</p><p data-hidden=1 x='class=ad'>r</p>", "link text\nq\nr"),
        ("<p hidden>a</p><p class = 'x ad'>b</p><p CLASS=menu>c</p><p title='t' style='display: none'>d</p><p>k", "k"),
        ("<div class='content-sidebar-wrap'><article><p>long text</p></article><div class=sidebar>s</div></div><p>scrap</p>", "long text"),
        ("<div class='content has-sidebar'><p>text of the page</p></div><div class='post no-comments'>post</div>", "text of the page\npost"),
        ("<div class='content-sidebar-wrap'><p>most of the text of the page</p><div class=main-menu>m</div></div><p>k</p>", "most of the text of the page\nk"),
        ("<article>post</article><div id=comments><article>a far longer comment of a reader</article></div>", "post"),
        ("<div>a longer post of some words</div><div id=comments><article>comment</article></div>", "a longer post of some words"),
        ("<div class=widget><main>in</main></div>x", "in"),
        ("<p class='side-effects'>a</p><section id='related-work'>b</section><div class='search-results'>c</div><h2 id='comments-on-method'>d</h2><h2 id=related>e</h2>", "a\nb\nc\nd\ne"),
        ("<div class='ad-slot-2'>a</div><div class='sidebar_left'>b</div><div id='cookie-notice-overlay'>c</div><div class='comment-list'>d</div><div class='share-buttons'>e</div><p>k", "k"),
        ("<div class='main-menu'>m</div><div class='site-footer'>f</div><div class=related-posts>r</div><p>a page of its own", "a page of its own"),
    ],
)
def test_noise_by_name(page, text):
    assert html_text.text_of(html_text.parse(page)) == text


def test_html_empty_table(spark):
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# --- exact search


def brute_search(rows, queries, k):
    ok = lambda v: v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)
    ints = lambda v: [int(np.floor(64 * float(x))) for x in v]
    c = [(i, ints(v)) for i, v in rows if i is not None and ok(v)]
    out = []
    for q, v in [(i, ints(v)) for i, v in queries if i is not None and ok(v)]:
        s = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in c if i != q and len(w) == len(v))[:k]
        out += [(q, n + 1, i, -x) for n, (x, i) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("spread", [1.0, 0.02, 1e6])
def test_search_equals_brute_force(spark, monkeypatch, spread):
    monkeypatch.setattr(nearest, "BLOCK", 16)
    monkeypatch.setattr(nearest, "PIVOTS", 5)
    monkeypatch.setattr(nearest, "QUERIES", 7)
    rnd = random.Random(6)
    rows = [(i, [float(np.float32(rnd.gauss(0, 1) * spread)) for _ in range(6)]) for i in range(300)]
    rows += [(400 + i, rows[0][1]) for i in range(60)] + [(500 + i, [0.0] * 6) for i in range(30)]
    rows += [(600, None), (601, []), (602, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (603, [float("nan")] * 6), (604, [float("inf")] + [0.0] * 5), (605, [1.0, 2.0]), (610, [2.0, 1.0]), (None, [1.0] * 6), (7, rows[8][1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int").repartition(4)
    some = df.filter("vec_id % 5 = 0")
    got = nearest.search(df, some, 9)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    seen = [(i, v) for i, v in rows]
    want = brute_search(seen, [(i, v) for i, v in seen if i is not None and i % 5 == 0], 9)
    assert sorted(map(tuple, got.collect())) == want


def test_search_with_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK", 4)
    monkeypatch.setattr(nearest, "PIVOTS", 3)
    monkeypatch.setattr(nearest, "QUERIES", 2)
    rnd = random.Random(9)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(3)]) for i in range(40)]
    rows += [rows[20]] * 12 + [(i, rows[20][1]) for i in (41, 42, 42, 42, 43)]  # more rows of one id in a class than k
    rows += [(0, [rnd.gauss(0, 3) for _ in range(3)]) for _ in range(15)]  # an id of many vectors
    rows += [(60, rows[0][1])] * 9 + [(61, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = nearest.search(df, df.filter("vec_id % 20 = 0"), 5)
    assert sorted(map(tuple, got.collect())) == brute_search(rows, [r for r in rows if r[0] % 20 == 0], 5)


def test_search_with_few_rows(spark):
    df = spark.createDataFrame([(20, [1.0]), (21, [0.5]), (40, None)], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, nearest.search(df, df.filter("vec_id % 20 = 0"), 20).collect())) == [(20, 1, 21, 2048)]
    none = df.filter("false")
    assert nearest.search(none, none, 20).count() == 0
    assert nearest.search(df, none, 20).count() == 0


def test_search_refuses_overflow(spark):
    df = spark.createDataFrame([(20, [1e15, 1e15]), (21, [1e15, -1e15])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        nearest.search(df, df.filter("vec_id = 20"), 2).collect()


# --- components


def test_components(spark):
    rnd = random.Random(7)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(40)] + [(rnd.randrange(200, 260), rnd.randrange(200, 260)) for _ in range(45)] + [(5, 5), (None, 3)]
    root = {n: n for e in edges for n in e if None not in e and e[0] != e[1]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- the pipeline


def written(stage, path):
    """The stage with its result written and reread, as the contract has it."""

    def run(spark, docs, sf_dir):
        stage(spark, docs, sf_dir).write.parquet(path)
        return spark.read.parquet(path)

    return run


def test_pipeline_equals_brute_force(spark, tmp_path):
    corpus_pipeline = importlib.import_module("corpus_pipeline")
    from tessera.llm import pieces

    rnd = random.Random(8)
    good = [" ".join(rnd.choice(["the", "of", "and", "stone", "water", "light"]) + str(rnd.randrange(10**5)) * (rnd.random() < 0.7) for _ in range(120)) for _ in range(30)]
    texts = []
    for g in good:
        texts.append(g[:300] + "\nthis line is in all of them\n" + g[300:])
        texts.append(g.replace("stone", "rock", 2))
    texts += [texts[0], None, "", "short", "the of | " * 60]
    rows = [(i, t, "en", rnd.choice(["a", "b", None]), len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = {name: written(f, f"{tmp_path}/{i}") for i, (name, f) in enumerate(corpus_pipeline.STAGES)}
    assert list(stages) == ["quality rules", "line dedup", "near copies", "mixing", "tokens"]

    kept = stages["quality rules"](spark, docs, str(tmp_path))
    keep = {r.doc_id for r in kept.collect()}
    assert keep == set(range(61)) and all(brute_quality(texts[i])[0] >= 50 for i in keep)
    deduped = stages["line dedup"](spark, kept, str(tmp_path))
    after = dict(brute_lines([(i, texts[i]) for i in sorted(keep)]))
    got = {r.doc_id: r for r in deduped.collect()}
    assert {i: r.text for i, r in got.items()} == after and all(r.n_chars == len(r.text) for r in got.values())
    single = stages["near copies"](spark, deduped, str(tmp_path))
    links = brute_links(sorted(after.items()), 5, 80)
    left = {i for i, (n, c) in links.items() if n == 0 or c == i}
    assert {r.doc_id for r in single.collect()} == left and len(left) < len(after)
    mixed = stages["mixing"](spark, single, str(tmp_path))
    assert mixed.columns == docs.columns
    times = Counter(r.doc_id for r in mixed.collect())
    e = pieces._encoder(open(pieces.default_model(), "rb").read())
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, tuple(r.token_ids)) for r in out) == Counter({(i, tuple(e.encode(after[i]))): n for i, n in times.items()})


def test_pipeline_on_an_empty_table(spark, tmp_path):
    corpus_pipeline = importlib.import_module("corpus_pipeline")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
