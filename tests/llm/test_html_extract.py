import math
import random
import statistics

from evigraph.llm import html_extract as he
from evigraph.llm.html_extract import extract, extract_pages, query

ART = "<h1>Title here</h1><p>First &amp; long sentence, with some words.</p>\n<p>Second\n  one &copy; too.</p><p>Ok.</p>"
WANT = "Title here\nFirst & long sentence, with some words.\nSecond one © too.\nOk."


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script>{head}</head><body>{body}</body></html>"


def test_article_among_furniture():
    html = page(
        "<header class=top><p>Site name, motto. And more, words here.</p></header><nav><ul><li><a href=/a>a</a></li></ul></nav><!-- ad 1 --><div class='ad'>Buy, buy. Now, today.</div>"
        "<div id=cookie-notice>We use cookies, ok.</div><aside>Other, text. Really.</aside>"
        f"<article>{ART}</article><section id='comments'><p>Nice post, thanks. Very, good.</p></section><form><p>Search, here.</p></form><footer>&copy; x</footer>"
    )
    assert extract(html) == WANT


def test_no_semantic_tags():
    html = page(
        "<div><div><a href=1>one</a> <a href=2>two</a></div><div class=x>" + ART + "<p>" + "More text, and more. " * 20 + "</p></div><div class='sidebar-left'>Some, side. Text.</div></div>"
    )
    assert extract(html).startswith(WANT)
    assert "one" not in extract(html).split("\n")[0] and "side" not in extract(html)


def test_broken_markup():
    html = "<html><body><nav>menu</nav><article><p><b>Bold start, text.<br><p>Next one, here.</p><p>5 < 6 & 7 > 2, yes.</p><p>tail &am"
    assert extract(html) == "Bold start, text.\nNext one, here.\n5 < 6 & 7 > 2, yes.\ntail &am"
    assert extract("<body><article><p>Some text, here.</p><a href=\"/x") == "Some text, here."
    assert extract("<article><p>One, two.<p") == "One, two."
    assert extract("just plain text, no tags.") == "just plain text, no tags."


def test_inline_and_hidden():
    html = page("<main><p>a <i>b</i>c<span hidden>no</span>, d.</p><div style='display: none'>hid, it.</div><ul><li>x, y.<li>z, w.</ul><article class='comment'><p>me, too.</p></article></main>")
    assert extract(html) == "a bc, d.\nx, y.\nz, w."


def test_edges(spark, tmp_path):
    assert extract(None) == extract("") == extract("<p></p>") == extract("<script>x</script>") == ""
    deep = "<div>" * 20000 + "text, deep." + "</i>" * 20000
    assert extract(deep) == "text, deep."
    long = page("<article>" + "<p>word, word.</p>" * 20000 + "</article>")
    assert extract(long).count("\n") == 19999
    rows = [(1, "u", page(f"<article>{ART}</article>")), (2, None, None), (1, "u", page(f"<article>{ART}</article>")), (None, "", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    df.write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in query(spark, str(tmp_path)).collect())
    assert got == [(0, "", 0), (1, WANT, len(WANT)), (1, WANT, len(WANT)), (2, "", 0)]
    assert extract_pages(df.limit(0)).count() == 0


def test_random_markup_never_fails():
    rnd = random.Random(7)
    parts = ["<p>", "</p>", "<div class=ad>", "</div>", "text, here. ", "&lt;", "&#65;", "<", ">", '"', "<a href='", "<!--", "-->", "<script>", "</script>", "<td>", "<li>", "<b>", "</b>"]
    for _ in range(500):
        extract("".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60))))


PARA = "<p>A paragraph of the article, with a good many words in it, and with marks; it goes on for a while.</p>"


def test_names_of_content_stay():
    for name in ("discussion", "social-history", "promotion-criteria", "notice-period", "related-work"):
        for attr in ("id", "class"):
            html = page(f"<main>{PARA}<section {attr}='{name}'><h2>Part</h2><p>Section {name}, in the text.</p></section>{PARA}</main>")
            assert f"Section {name}, in the text." in extract(html), name
    for name in ("ad-slot", "site-footer", "cookieNotice", "related-posts", "social-share", "share-this", "comments", "comment-list", "adBanner2", "left-sidebar"):
        html = page(f"<main>{PARA}<div class='{name}'><p>Furniture, really. It is.</p></div>{PARA}</main>")
        assert "Furniture" not in extract(html), name


def test_math_stays_and_short_furniture_goes():
    html = page(f"<article>{PARA}<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> hold.</p><div><span>Share this</span></div>{PARA}<h2>Next</h2><ul><li>one</li></ul>{PARA}</article>")
    got = extract(html).split("\n")
    assert "Let x=1 hold." in got and "Share this" not in got and "Next" in got and "one" in got
    assert extract(page(f"<article><div>{'Text of a bare block, with marks. ' * 4}</div>{PARA}</article>")).startswith("Text of a bare block")


def test_scores_equal_a_plain_computation():
    rnd = random.Random(4)
    for _ in range(60):
        body = "".join(rnd.choice([f"<p>{'word, ' * rnd.randint(1, 30)}.</p>", f"<div class=x><b>{'w ' * rnd.randint(1, 9)}</b></div>", "<ul><li>a<li>b.</ul>", "<section><h2>Head</h2><p>Short.</p></section>"]) for _ in range(rnd.randint(1, 12)))
        _, runs = he._read(page(f"<main>{body}</main>"))
        texts = [r[2] for r in runs]
        told = [(e.path, t) for (e, _, _), t in zip(runs, texts)]
        ratio = {}
        for p in {p for p, t in told if t.strip()}:
            mine = [t for q, t in told if q == p and t.strip()]
            ratio[p] = math.sqrt(statistics.fmean(map(len, mine)) * (statistics.fmean(sum(c in ".,;:!?" for c in t) for t in mine) + 0.1))
        fused = he._ratios(runs, texts)
        assert fused.keys() == ratio.keys() and all(abs(fused[p] - ratio[p]) < 1e-9 for p in ratio)
        raw = [ratio[p] if t.strip() else 0 for p, t in told]
        weights = {k: math.exp(-k * k / 2) for k in range(-2, 3)}
        want = [sum(w * (raw[i + k] if 0 <= i + k < len(raw) else 0) for k, w in weights.items()) / sum(weights.values()) if raw[i] else 0 for i in range(len(raw))]
        assert all(abs(a - b) < 1e-9 for a, b in zip(he._scores(runs, texts, fused), want))


def test_ties_and_clashing_columns(spark):
    twin = "<div class='x'><p>Same words, here. Same, again.</p></div>"
    assert extract(page(twin + twin)) == "Same words, here. Same, again.\nSame words, here. Same, again."
    df = spark.createDataFrame([(1, page(f"<main>{PARA}</main>"), "old", 3)], "page_id long, html string, Text string, n_chars int")
    got = extract_pages(df)
    assert got.first()["Text" if "Text" in got.columns else "text"].startswith("A paragraph") and got.first().n_chars == 3 and len(got.columns) == 4
