"""Main text of web pages by tag-path ratios.

A page is read once into elements and text runs (forgiving: unclosed, misnested and cut-off tags are
fine). Every text run has a *tag path*, the names and classes from the root to its element. Per path
the text length and the punctuation are summed and divided by the number of runs; the two ratios are
fused by their geometric mean, smoothed along the page with a Gaussian window, and runs above a share of
the scores' spread are *content*. The smallest element that holds nearly all content mass is the
main element (an ``article`` or ``main`` around it is preferred; of several that hold it the innermost).

The scores also choose among the blocks of the main element. A block of prose markup (paragraphs, headings, list items, cells
and the like) stays, as short ones among long ones are text too; any other block stays if one of its runs lies on a path whose own
ratio, unsmoothed, reaches the threshold and ``FLOOR`` of the mean score. Blocks of mostly links that are not content go where the main element is no ``article`` or ``main``.

Never part of the result: menus, page headers, footers, sidebars, notices, adverts, forms, scripts, styles, hidden parts
and reader comments, told by element, role, or words of class and id. A name tells only where all its words are such words or neutral
ones (``ad-slot``, ``site-footer``): ``social-history`` or ``notice-period`` are names of content.

Character references are decoded; white space inside a block (``br`` included) becomes one space; blocks are
trimmed and joined by one newline in page order; empty blocks vanish. Nothing is capped. Null or
empty html gives an empty text; a page of plain text is one block; repeated rows get equal results; very long pages take time in
proportion. A column named as the result is replaced, others pass through; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import over_texts, table

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""",
    re.S,
)
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_SPACE = re.compile(r"\s+")
_PIECES = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_MARKS = re.compile(r"[.,;:!?、。，！？…]")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
#: A new element of the key ends an open one of the values, up to an element of SCOPE.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "thead", "tbody"}, "body": {"head"}}
SCOPE = frozenset("html body article section main div table td th ul ol dl blockquote aside nav header footer form figure details".split())
DROPPED = frozenset("nav aside footer form button select textarea script style noscript template iframe object svg dialog menu head title canvas audio video datalist search noembed noframes applet map".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form tablist tooltip".split())
HINTS = frozenset(
    "nav navbar navigation menu submenu sidebar aside footer ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors promo promos promotion promoted banner cookie cookies consent gdpr notice notices notification notifications alert alerts popup modal overlay newsletter subscribe subscription signup login signin share sharing sharebar social related recommended recommendations recirculation breadcrumb breadcrumbs pagination pager comment comments commentlist respond disqus reply replies widget widgets toolbar masthead copyright tagcloud toc outbrain taboola paywall skiplink".split()
)
#: These words take the meaning from the hint after them (``has-sidebar``).
TURNED = frozenset("has with no without is not hide show".split())
#: Words that say nothing by themselves; a hint beside any other word is part of a name of content.
NEUTRAL = frozenset(
    "site page main top bottom left right upper lower center middle box block bar strip container wrapper wrap inner outer content body area zone panel module unit slot space holder placeholder list item items link links button buttons btn icon icons image img media section group row col column grid post posts article articles story stories entry news topics videos products reading reads count author meta thread form field input box text title label message policy line first last small large wide narrow full width mini sub new inline sticky fixed floating mobile desktop global primary secondary tertiary user this these our your us the and of for by in on to js wp google dfp display leaderboard skyscraper rectangle mpu tool tools head header".split()
)
#: Elements whose text is prose however short it is.
PROSE = frozenset("h1 h2 h3 h4 h5 h6 p li dt dd td th pre blockquote figcaption caption summary address hgroup math".split())
HEADS = frozenset(("header", "masthead", "banner"))
MAINS = frozenset(("article", "main"))
SPREAD, SIGMA, MASS, LINKS, FLOOR = 0.3, 1.0, 0.9, 0.5, 0.25


class _Element:
    __slots__ = ("name", "parent", "path", "drop", "link", "main", "within", "mass")

    def __init__(self, name, parent, path, drop, link, main, within):
        self.name, self.parent, self.path, self.drop, self.link, self.main, self.within = name, parent, path, drop, link, main, within
        self.mass = 0.0


def _hinted(value: str, inside: bool) -> bool:
    for token in value.split():
        words = [w.lower() for w in _PIECES.findall(token)]
        hint = any((w in HINTS or w == "header" and not inside) and not (k and words[k - 1] in TURNED) for k, w in enumerate(words))
        if hint and all(w in HINTS or w in NEUTRAL or w in TURNED or w in HEADS or len(w) < 3 or w.isdigit() for w in words):
            return True
    return False


def _unwanted(name: str, attrs: dict[str, str], inside: bool) -> bool:
    """Whether an element is page furniture. ``inside``: an article or main is around it."""
    if name in DROPPED or name == "header" and not inside:
        return True
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return True
    if attrs.get("role", "").lower() in ROLES:
        return True
    if name in ("html", "body", "main", "h1"):
        return False
    words = f"{attrs.get('class', '')} {attrs.get('id', '')}"
    if name == "article":
        return bool({"comment", "comments", "reply", "ad", "advert", "promo", "related", "sponsored"} & {w.lower() for w in _PIECES.findall(words)})
    return words != " " and _hinted(words, inside)


def _read(page: str) -> tuple[list[_Element], list[tuple[_Element, int, str]]]:
    """Elements in order of appearance, and text runs as (element, block, raw text)."""
    root = _Element("", None, 0, False, False, False, False)
    elements, runs, stack, open_ = [root], [], [root], defaultdict(int)
    paths: dict[tuple[int, str], int] = {}
    block = pos = 0
    size = len(page)

    def close(depth: int) -> None:
        while len(stack) > depth:
            open_[stack.pop().name] -= 1

    while pos < size:
        at = page.find("<", pos)
        m = _TAG.match(page, at) if at >= 0 else None
        end = at if m else size if at < 0 else at + 1
        if end > pos:
            if not stack[-1].drop:
                runs.append((stack[-1], block, page[pos:end]))
            pos = end
        if not m:
            continue
        pos = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if name in BLOCK:
            block += 1
        if m[1] or m[4]:
            if open_[name] > 0:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].name == name:
                        close(depth)
                        break
            continue
        if name == "br" and not stack[-1].drop:
            runs.append((stack[-1], block, " "))
        if name in BLOCK and open_["p"] > 0:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].name == "p":
                    close(depth)
                    break
                if stack[depth].name in SCOPE:
                    break
        if name in ENDS and any(open_[x] > 0 for x in ENDS[name]):
            last = None
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].name in ENDS[name]:
                    last = depth
                elif stack[depth].name in SCOPE:
                    break
            if last:
                close(last)
        if name in VOID:
            continue
        raw = m[3] if m[2] else m[6]
        attrs = {}
        if raw and not raw.isspace():
            for a in _ATTR.finditer(raw):
                attrs.setdefault(a[1].lower(), a[2] or a[3] or a[4] or "")
        above = stack[-1]
        key = (above.path, f"{name}.{attrs.get('class', '')}")
        path = paths.setdefault(key, len(paths) + 1)
        main = name in MAINS or attrs.get("role", "").lower() in MAINS
        here = _Element(name, above, path, above.drop or _unwanted(name, attrs, above.within), above.link or name == "a", main, above.within or main)
        if name in RAW:
            stop = re.compile(f"</{name}(?=[\\s/>]|\\Z)", re.I).search(page, pos)
            pos = size if not stop else (page.find(">", stop.end()) + 1 or size)
            continue
        elements.append(here)
        stack.append(here)
        open_[name] += 1
    return elements, runs


def _ratios(runs: list[tuple[_Element, int, str]], texts: list[str]) -> dict[int, float]:
    """The fused ratio of each tag path."""
    length, marks, number = defaultdict(int), defaultdict(int), defaultdict(int)
    for (e, _, _), t in zip(runs, texts):
        if t and not t.isspace():
            length[e.path] += len(t)
            marks[e.path] += len(_MARKS.findall(t))
            number[e.path] += 1
    return {p: math.sqrt((length[p] / n) * (marks[p] / n + 0.1)) for p, n in number.items()}


def _scores(runs: list[tuple[_Element, int, str]], texts: list[str], fused: dict[int, float]) -> list[float]:
    """The smoothed ratio of each run."""
    raw = [fused.get(e.path, 0.0) if t and not t.isspace() else 0.0 for (e, _, _), t in zip(runs, texts)]
    kernel = [math.exp(-(k * k) / (2 * SIGMA * SIGMA)) for k in range(-2, 3)]
    scale, n = sum(kernel), len(raw)
    return [sum(w * raw[i + k - 2] for k, w in enumerate(kernel) if 0 <= i + k - 2 < n) / scale if raw[i] else 0.0 for i in range(n)]


def _is_prose(e: _Element, main: _Element) -> bool:
    """Whether prose markup is around a run, inside the main element."""
    while e is not main and e.parent is not None:
        if e.name in PROSE:
            return True
        if e.name in BLOCK:
            return False
        e = e.parent
    return False


def extract(page: str | None) -> str:
    if not page:
        return ""
    elements, runs = _read(page)
    texts = [unescape(r[2]) for r in runs]
    fused = _ratios(runs, texts)
    score = _scores(runs, texts, fused)
    told = [s for s in score if s]
    if not told:
        return ""
    mean = sum(told) / len(told)
    spread = math.sqrt(sum((s - mean) ** 2 for s in told) / len(told))
    least = SPREAD * spread
    content = [s > 0 and s >= least for s in score]
    total = 0.0
    for (e, _, _), t, s, c in zip(runs, texts, score, content):
        if c:
            e.mass += len(t) * s
            total += len(t) * s
    for e in reversed(elements[1:]):  # children come after their parents
        e.parent.mass += e.mass
    held = [e for e in elements if e.mass >= MASS * total and not e.drop]
    inner = held[-1]  # elements that hold that much lie on one line, the innermost last
    mains = [e for e in held if e.main]
    main = mains[-1] if mains else inner
    while not main.main and main.name not in BLOCK and main.parent is not None:
        main = main.parent
    inside: dict[int, bool] = {}
    for e in elements:
        inside[id(e)] = e is main or (e.parent is not None and inside[id(e.parent)])
    blocks: dict[int, list[str]] = {}
    links: dict[int, list[int]] = {}
    chosen: dict[int, bool] = {}
    told_by: dict[int, bool] = {}
    for (e, b, _), t, c in zip(runs, texts, content):
        if inside[id(e)] and not e.drop:
            blocks.setdefault(b, []).append(t)
            n = links.setdefault(b, [0, 0])
            n[0] += len(t.strip()) if e.link else 0
            n[1] += len(t.strip())
            chosen[b] = chosen.get(b, False) or c and not e.link
            if t and not t.isspace():
                told_by[b] = told_by.get(b, False) or fused[e.path] >= max(least, FLOOR * mean) or _is_prose(e, main)
    out = []
    for b, parts in blocks.items():
        if not told_by.get(b, False) or not main.main and not chosen[b] and links[b][0] > LINKS * links[b][1]:
            continue
        text = _SPACE.sub(" ", "".join(parts)).strip()
        if text:
            out.append(text)
    return "\n".join(out)


def extract_pages(df: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """All columns of ``df`` and the main text. One pass, no shuffle; ``text`` replaces a column of that name."""

    run = over_texts(lambda pages: pa.array([extract(p) for p in pages.to_pylist()], pa.string()), "string")
    return df.withColumn(text, run(F.col(f"`{html}`").cast("string")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_pages(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
