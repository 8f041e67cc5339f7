"""Main text of web pages by two-pass block rules.

The page is cut into blocks at block-level tags. Pass one scores each block by its text and by
where it stands. Text: many link characters count against it, more so if they are nearly all; length with a
high share of stop words counts for it, a low share against it; short blocks count
neither way. Place: an article counts for it, standing beside one against it, a container whose class or id
names boilerplate against it; menus, headers, footers, sidebars, forms and hidden elements are out by their elements. A
positive score is in, a negative one out, zero undecided. Pass two gives an undecided
block the label of its nearest decided neighbours: in if both sides are, out if both are out, and
between different labels the nearer one, the earlier on ties. If no block is in, undecided
ones are in that are not links.

Names: a class or id counts only if all its words are boilerplate or layout words (``main-nav``,
``ad-box``), so ``social-history`` or ``with-sidebar`` say nothing, and a container that holds an article says
nothing either. An article counts only if a third of the page's text or more stands in articles. Where
under one word in ten of a page is a stop word, its language isn't covered, and length decides alone.

Rows don't meet, so nothing is shuffled. A null, empty or textless html gives an empty text;
cut-off tags and comments at the end of a page are dropped, unclosed elements end with the
page, and every row, repeated or with null ids, gives one row. Texts of any length are read whole.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from newsline.plans.storage import table

LINKED, MOSTLY_LINKED = 0.2, 0.9
SHORT, LONG = 70, 200
STOP_LOW, STOP_HIGH, COVERED = 0.08, 0.20, 0.10

# Frequent function words of the languages met; a parameter of extract().
STOP_WORDS = frozenset(
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was were which will with you "
    "au aux avec ce cette dans de des du elle en est et il je la le les leur ne nous on ou par pas pour qu que qui sa se ses son sur un une vous "
    "als auch auf aus bei das dass dem den der des die ein eine einem einen er es für hat ich im ist mit nach nicht sich sie sind und von war wie zu zum zur "
    "al con como del el era esta este ha la las lo los más no para pero por que se sin su sus un una y ya "
    "il di che per con una non sono del della dei nel più ha anche come si da gli le ma alla "
    "em não os as um uma com se na por mais dos como mas foi ao ele das tem à seu sua ou "
    "het een van is dat te op aan met voor er maar om hem dan zou of wat mijn men dit zo door over ze zich bij ook tot je mij uit "
    "w z na do nie to jest jak za po co czy od przez dla przy tak ale który które oraz jego już być może i się że "
    "och det att som på är av för med till den han de om inte men var jag från vi så kan man när "
    "v se na je že s z do o k i za si po ve jako by pro jeho tak ale jsem bylo který "
    "и в не на я что он с как это по но из у за от так же для бы его она "
    "bir bu da de ve ile için çok daha gibi ne o olan olarak ya".split()
)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>|</?[a-zA-Z][^>]*(?:>|\Z)", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
_RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp svg canvas audio video".split())
_OUT = frozenset("nav header footer aside form menu dialog head button select fieldset legend option label input".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES_P = _BLOCKS - {"html", "body", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "option"}
_STRONG = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice alert popup modal overlay "
    "newsletter subscribe subscription signup login comment comments commentlist respond reply replies disqus discussion pagination pager".split()
)
_WEAK = frozenset("promo promotion banner side rail share sharing social related recommended trending widget toolbar search skip".split())
_LAYOUT = frozenset(
    "main top bottom left right center primary secondary global site page body content wrapper wrap container inner outer box block bar list item items area section row col column panel pane group link links button buttons btn icon icons "
    "small large mobile desktop sticky fixed text title post posts article articles story stories form thread unit slot zone module component js".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
_MAIN = frozenset(("article", "main"))
#: What places and texts count.
IN_ARTICLE, BESIDE_ARTICLE, WEAK_NAME, STRONG_NAME, PROSE, NO_PROSE, SOME_LINKS, LINK_TEXT, LINK_ITEM = 2, -3, -3, -9, 2, -1, -1, -2, -3


def _attributes(tag: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(tag)}


def named(value: str) -> int:
    """What class names or an id say of a container: 0, or the score of the worst name."""
    worst = 0
    for name in value.split():
        words = re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name).lower())
        if words and all(w in _STRONG or w in _WEAK or w in _LAYOUT for w in words):
            worst = min(worst, STRONG_NAME if any(w in _STRONG for w in words) else WEAK_NAME if any(w in _WEAK for w in words) else 0)
    return worst


class Block:
    """A block with text: how many of its characters are in links, and where it stands."""

    __slots__ = ("text", "linked", "out", "main", "item", "names")

    def __init__(self, text: str, linked: int, place: tuple) -> None:
        self.text, self.linked = text, linked
        self.out, self.main, self.item, self.names = place


_PAGE = (False, False, False, ())


def _inside(place: tuple, name: str, tag: str, containers: list[list]) -> tuple:
    """The place (out, in an article, in a list item, named containers) of what an element holds."""
    out, main, item, names = place
    own = _attributes(tag) if "=" in tag or "hidden" in tag else {}
    role = own.get("role", "").lower()
    is_main = (name in _MAIN or role == "main") and "comment" not in own.get("class", "").lower()
    if name in _OUT and not (name == "header" and main) or role in _ROLES:
        out = True
    if ("=" in tag or "hidden" in tag) and (own.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", own.get("style", "")) or re.search(r"\shidden(?:\s|/?>|=)", tag)):
        out = True
    score = named(f"{own.get('class', '')} {own.get('id', '')}") if own and not is_main and name not in ("html", "body") else 0
    if score:
        containers.append([score, False])
        names = (*names, len(containers) - 1)
    if is_main:
        for c in names:
            containers[c][1] = True
    return out, main or is_main, item or name == "li", names


def blocks(page: str) -> tuple[list[Block], list[list]]:
    """The blocks with text, and (score, whether it holds an article) of each container with a telling name."""
    out: list[Block] = []
    containers: list[list] = []
    parts: list[str] = []
    stack: list[tuple[str, tuple]] = []
    opened: Counter[str] = Counter()  # of the names on the stack
    linked = at = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, linked, stack[-1][1] if stack else _PAGE))
        parts.clear()
        linked = 0

    def close(name: str) -> None:
        while stack:
            top = stack.pop()[0]
            opened[top] -= 1
            if top == name:
                return

    def add(piece: str) -> None:
        nonlocal linked
        if piece:
            piece = entities.unescape(piece)
            parts.append(piece)
            if opened["a"]:
                linked += len("".join(piece.split()))

    n = len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        tag, at = m[0], m.end()
        found = _NAME.match(tag)
        if not found:
            continue
        if tag[-1] != ">":
            break  # cut off at the end of the page
        name = found[1].lower()
        if name == "br" or name == "hr":
            parts.append(" ")
        if tag[1] == "/":
            if name in _BLOCKS:
                flush()
            if opened[name]:
                close(name)
            continue
        if name in _RAW:
            if not tag.endswith("/>"):
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else n
            parts.append(" " if name in _BLOCKS else "")
            continue
        if name in _BLOCKS:
            flush()
            if name in _CLOSES_P and opened["p"]:
                close("p")
            if name in ("li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == name:
                close(name)
        if name in _VOID or tag.endswith("/>"):
            continue
        stack.append((name, _inside(stack[-1][1] if stack else _PAGE, name, tag, containers)))
        opened[name] += 1
    flush()
    return out, containers


def stop_share(text: str, stop_words: frozenset[str]) -> float:
    own = text.lower().split()
    return sum(w.strip(".,;:!?()\"'«»„“”") in stop_words for w in own) / len(own)


def text_score(block: Block, stops: float | None) -> int:
    """What the block's own text counts; ``stops`` is None where the language isn't covered."""
    density = block.linked / max(1, len(block.text.replace(" ", "")))
    if density > MOSTLY_LINKED:
        return LINK_ITEM if block.item else LINK_TEXT
    if density > LINKED:
        return SOME_LINKS
    if len(block.text) < SHORT:
        return 0
    if stops is None:
        return PROSE if len(block.text) >= LONG else 0
    return PROSE if stops >= STOP_HIGH else NO_PROSE if stops < STOP_LOW else 0


def labels(found: list[Block], containers: list[list], stop_words: frozenset[str]) -> list[bool]:
    """The two passes: True for the blocks of the main text."""
    place = [min((containers[c][0] for c in x.names if not containers[c][1]), default=0) for x in found]
    open_ = [(x, p) for x, p in zip(found, place) if not x.out and p > STRONG_NAME]
    article = 3 * sum(len(x.text) for x, _ in open_ if x.main) >= sum(len(x.text) for x, _ in open_) and any(x.main for x, _ in open_)
    shares = [stop_share(x.text, stop_words) if not x.out and p > STRONG_NAME and len(x.text) >= SHORT else 0.0 for x, p in zip(found, place)]
    words = sum(len(x.text) for x, _ in open_ if len(x.text) >= SHORT)
    covered = sum(s * len(x.text) for x, s in zip(found, shares)) >= COVERED * words
    decided: list[bool | None] = []
    for x, p, s in zip(found, place, shares):
        score = p + text_score(x, s if covered else None) + (0 if not article else IN_ARTICLE if x.main else BESIDE_ARTICLE)
        decided.append(False if x.out or score < 0 else True if score > 0 else None)
    if True not in decided:
        return [d is None and x.linked * 2 <= len(x.text) for x, d in zip(found, decided)]
    known = [i for i, d in enumerate(decided) if d is not None]
    out, nxt = [], 0
    for i, d in enumerate(decided):
        while nxt < len(known) and known[nxt] < i:
            nxt += 1
        if d is not None:
            out.append(d)
            continue
        left, right = known[nxt - 1] if nxt else None, known[nxt] if nxt < len(known) else None
        if left is None or right is None:
            out.append(decided[right if left is None else left])
        else:
            out.append(decided[left] if decided[left] == decided[right] or i - left <= right - i else decided[right])
    return out


def main_text(page: str, stop_words: frozenset[str] = STOP_WORDS) -> str:
    """The blocks of the main text, one a line."""
    found, containers = blocks(page)
    return "\n".join(x.text for x, keep in zip(found, labels(found, containers, stop_words)) if keep)


def extract(pages: DataFrame, stop_words: frozenset[str] = STOP_WORDS) -> DataFrame:
    """(page_id, url, text, n_chars) of (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py() or "", stop_words) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
