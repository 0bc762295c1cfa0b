"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. First every block is judged by itself: by its share of link
text, its length and its density of stop words, in the language that most of the page's stop words are of. Blocks
too short or too mixed to tell then take the label of the nearest decided neighbours in their region: an article
or main element, or all that lies outside of these. Being in such an element is no more than a lean: it settles
what neighbours leave open. Of the regions those count that hold most of the good text. Elements like nav
and what is hidden are left out before; so are elements whose names are those of menus, notices, comments and the like,
unless they hold nearly all of the page's good text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Stop words by language.
STOP_WORDS = {
    "en": "a about after all also an and any are as at be been but by can could do for from had has have he her his how i if in into is it its just like more my no not of on one or our out over she so some than that the their them then there these they this time to up was we were what when which who will with would you your",
    "de": "aber als am an auch auf aus bei bin bis das dass dem den der des die doch durch ein eine einem einen einer eines er es für hat hatte ich ihr im in ist ja kann mit nach nicht noch nur oder sein sich sie sind so über um und uns unter vom von vor war was wie wir wird zu zum zur",
    "fr": "à au aux avec ce ces cette comme dans de des du elle elles en est et été être eux il ils je la le les leur leurs lui ma mais même mes moi mon ne nos notre nous on ou où par pas pour plus qu que qui sa sans se ses si son sont sur ta te tu un une vos votre vous y",
    "es": "a al algo como con cuando de del desde donde el ella ellas ellos en entre era es esa ese eso esta este esto fue ha hay la las le les lo los más me mi muy no nos o para pero por porque que quien se ser si sin sobre son su sus también te tiene todo tu un una uno y ya yo",
}
#: Words of a class, id or role that name what is not the article; those that may also name parts of one.
ASIDE_WORDS = frozenset(
    "ad ads adv advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus dropdown footer gdpr header menu modal nav navbar navigation newsletter notice notification outbrain pager pagination popup promo promoted promotion recommended related reply replies search share sharing sidebar signup skip social sponsor sponsored subscribe subscription taboola teaser toolbar widget".split()
)
LOOSE_WORDS = frozenset("banner header menu notice recommended reply replies search skip teaser toolbar widget".split())
#: Of these, words that are never the article, whatever else the page holds; parts of a name that say what holds
#: such a thing; parts that open or end a name which says no more than
#: whether it is there.
NEVER_WORDS = frozenset("comment comments consent cookie cookies disqus gdpr reply replies".split())
HOLDER_WORDS = frozenset("area bar block blocks body box button buttons column container content form group inner item items link links list main module overlay panel row section slot text thread title top unit wrap wrapper bottom left right".split())
STATE_WORDS = frozenset("has no not with without is hide hides show shows".split())
STATE_ENDS = frozenset("open opened enabled disabled closed active inactive on off image visible free".split())
#: Elements without text of the page, elements that are never the article, elements that open a block, elements without content.
SKIPPED = "script|style|noscript|template|textarea|svg|math|iframe|object|select|canvas|audio|video|title"
ASIDES = frozenset("nav footer aside form button dialog menu".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ARTICLES = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))

#: Characters under which a block is short and over which it is long; densities of stop words; share of link text.
SHORT, LONG, STOP_LOW, STOP_HIGH, LINKS = 70, 140, 0.2, 0.3, 0.3
#: The same inside an article, where figures and quotations link more; share of the best region's good text that another needs to be kept.
ARTICLE_LINKS, REGION = 0.6, 0.5
#: Share of all good text that an element named as an aside must hold to be none.
NEARLY_ALL = 0.9

_TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<({SKIPPED})\b(?:"[^"]*"|'[^']*'|[^>"'])*+>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_EVERY = frozenset(w for words in STOP_WORDS.values() for w in words.split())
_STOPS = {lang: frozenset(words.split()) for lang, words in STOP_WORDS.items()}


class Block:
    __slots__ = ("text", "region", "links", "heading", "words", "label", "named")

    def __init__(self, text: str, region: int, links: int, heading: bool, named: tuple[int, ...] = ()) -> None:
        self.text, self.region, self.links, self.heading, self.named, self.label = text, region, links, heading, named, ""
        self.words = [w.strip(".,;:!?()\"'") for w in text.lower().split()]


#: What an element is: part of the page, an aside by its name, one that no share of text redeems, one by its kind.
PART, NAMED, NEVER, ASIDE = range(4)


def _named(token: str, in_article: bool) -> int:
    """What one name of a class, id or role says: it is an aside's if its first or last part is, but for what holds it."""
    parts = [p for p in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", token).lower()) if p]
    if not parts or len(parts) > 1 and (parts[0] in STATE_WORDS or parts[-1] in STATE_ENDS):
        return PART
    while len(parts) > 1 and parts[-1] in HOLDER_WORDS:
        parts.pop()
    said = [w for w in (parts[0], parts[-1]) if w in ASIDE_WORDS and not (in_article and w in LOOSE_WORDS)]
    return max((NEVER if w in NEVER_WORDS else NAMED for w in said), default=PART)


def _aside(tag: str, attributes: str, in_article: bool) -> int:
    if tag in ASIDES or tag == "header" and not in_article:
        return ASIDE
    if tag in ("html", "body", "main") or not attributes:
        return PART
    most = PART
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value.lower()):
            return ASIDE
        if name in ("class", "id", "role"):
            most = max([most, *(_named(token, in_article) for token in value.split())])
    return most


def blocks(page: str) -> list[Block]:
    """Blocks with text outside of asides; region is 0 outside of articles, else the article's number; named has the numbers of
    the elements around it that are named as asides, those that nothing redeems below 0."""
    found: list[Block] = []
    stack: list[tuple[str, bool, int, tuple[int, ...]]] = []  # tag, aside, region, named
    text: list[str] = []
    links = regions = names = anchor = 0  # anchor: 1 plus the depth at which a link was opened
    aside, region, heading, named = False, 0, False, ()

    def close():
        nonlocal links
        if text:
            whole = " ".join(html.unescape("".join(text)).split())
            if whole:
                found.append(Block(whole, region, links, heading, named))
            text.clear()
        links = 0

    def say(s: str):
        nonlocal links
        if not aside:
            text.append(s)
            if anchor:
                links += len(s.strip())

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        tag = (m[3] or m[6] or "").lower()
        if not tag:
            continue
        ends, attributes = bool(m[2] or m[5]), m[4] or m[7] or ""
        if tag in BLOCKS:
            close()
            heading = tag in HEADINGS and not ends
        elif tag in ("br", "wbr"):
            say(" " if tag == "br" else "")
        if tag in VOID:
            continue
        if tag == "a":  # a link may hold blocks; it ends with the next, or with what it was opened in
            anchor = 1 + len(stack) if not ends and "href" in attributes.lower() else 0
            continue
        if tag not in BLOCKS and not ends and not attributes:
            continue  # inline markup without a name changes nothing
        if ends:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), -1)
            # an inline tag never closes a block, nor a block one that holds an article
            if k >= 0 and (tag in BLOCKS or not any(s[0] in BLOCKS for s in stack[k:])):
                del stack[k:]
        else:
            if tag == "p" or tag in HEADINGS:  # a paragraph ends where the next begins
                while stack and (stack[-1][0] == "p" or stack[-1][0] not in BLOCKS and any(s[0] == "p" for s in stack)):
                    stack.pop()
            if tag in ARTICLES and not region:
                regions += 1
            here = region or (regions if tag in ARTICLES else 0)
            kind = _aside(tag, attributes, bool(region))
            if kind in (NAMED, NEVER):
                names += 1
            own = (*named, names if kind == NAMED else -names) if kind in (NAMED, NEVER) else named
            stack.append((tag, aside or tag == "head" or kind == ASIDE, here, own))
        aside, region, named = stack[-1][1:] if stack else (False, 0, ())
        if anchor > 1 + len(stack):
            anchor = 0
    if at < len(page):
        say(page[at:])
    close()
    return found


def admitted(found: list[Block], stops: frozenset[str]) -> list[Block]:
    """Blocks outside of elements named as asides, or inside of those that hold nearly all good text."""
    if not any(b.named for b in found):
        return found
    good = [len(b.text) if judge(b, stops) == "good" else 0 for b in found]
    held: dict[int, int] = {}
    for b, n in zip(found, good):
        for k in b.named:
            held[k] = held.get(k, 0) + n
    ours = sum(n for b, n in zip(found, good) if all(k > 0 for k in b.named))
    redeemed = {k for k, n in held.items() if k > 0 and n and n >= NEARLY_ALL * ours}
    return [b for b in found if redeemed.issuperset(b.named)]


def language(found: list[Block]) -> frozenset[str]:
    """Stop words of the language that most stop words of the page are of; all of them if none is."""
    hits = [w for b in found for w in b.words if w in _EVERY]
    counts = {lang: sum(w in stops for w in hits) for lang, stops in _STOPS.items()}
    most = max(counts.values())
    return next(_STOPS[lang] for lang, n in counts.items() if n == most) if most else _EVERY


def judge(b: Block, stops: frozenset[str]) -> str:
    """First pass: good, bad, or short or near when the block alone does not tell."""
    if b.links > len(b.text) * (ARTICLE_LINKS if b.region else LINKS):
        return "bad"
    if len(b.text) < SHORT:
        return "bad" if b.links and not b.region else "short"
    density = sum(w in stops for w in b.words) / len(b.words)
    if density >= STOP_HIGH:
        return "good" if len(b.text) >= LONG else "near"
    if density >= STOP_LOW:
        return "near"
    return "short" if b.region else "bad"


def label(found: list[Block], stops: frozenset[str]) -> None:
    """Both passes. What is undecided between a good and a bad neighbour, or has none, is good if it is near good, in an
    article, or a heading right before what is good."""
    first = [judge(b, stops) for b in found]
    n = len(found)
    before, after = [""] * n, [""] * n
    for order, out in ((range(n), before), (range(n - 1, -1, -1), after)):
        last = None
        for i in order:
            out[i] = last[1] if last and last[0] == found[i].region else ""
            if first[i] in ("good", "bad"):
                last = (found[i].region, first[i])
    for i, b in enumerate(found):
        if first[i] in ("good", "bad"):
            b.label = first[i]
            continue
        around = {before[i], after[i]} - {""}
        if around == {"good"} or around == {"bad"}:
            b.label = around.pop()
        else:
            open_ = b.region or first[i] == "near" or b.heading and after[i] == "good"
            b.label = "good" if open_ else "bad"


def regions(found: list[Block]) -> set[int]:
    """The regions whose good text is the page's: the one with most of it, and articles with REGION as much."""
    good: dict[int, int] = {}
    for b in found:
        if b.label == "good":
            good[b.region] = good.get(b.region, 0) + len(b.text)
    articles = max((n for r, n in good.items() if r), default=0)
    outside = good.get(0, 0)
    if outside > articles / REGION or not articles:  # articles are no more than cards beside the story
        return {0} | {r for r, n in good.items() if n >= outside * REGION}
    return {r for r, n in good.items() if r and n >= articles * REGION}


def main_text(page: str | None) -> str:
    every = blocks(page or "")
    stops = language(every)
    found = admitted(every, stops)
    label(found, stops)
    kept = regions(found)
    return "\n\n".join(b.text for b in found if b.label == "good" and b.region in kept)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 500):
            part = b.slice(at, 500)
            texts = [main_text(h) for h in part["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([part["page_id"], part["url"], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of pages (page_id, url, html): page_id, url, text, n_chars (code points).

    Character references are decoded, white space inside a block is one space, blocks are joined in page order
    by an empty line. Null, empty and text-free pages give an empty text; pages of any length are read whole. Page
    ids are carried as they are, null or repeated; other columns are ignored; an empty table gives no rows.
    """
    rows = pages.selectExpr("CAST(page_id AS BIGINT) AS page_id", "CAST(url AS STRING) AS url", "CAST(html AS STRING) AS html")
    return rows.mapInArrow(_run, "page_id long, url string, text string, n_chars long")
