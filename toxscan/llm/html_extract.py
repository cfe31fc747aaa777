"""HTML extraction by tree scoring.

The page becomes a tree of elements, built in one pass over its tags with HTML's rules for tags that end by
themselves. Elements that never hold the article (scripts, menus, forms, notices ...) are left out: by tag, or if a whole
class or id names such a thing. Where only a part of the name does (``related-work``), or the id of a heading or of a part
of an article, the element is a suspect: it scores less, and is left out only if it is dense in links or, by its class, short. Each
paragraph scores points for its length and its commas and passes them to its ancestors, less with distance;
a container's points are discounted by its link density. The best container is kept, and with it the siblings
that score near it or are prose themselves. Their blocks are the text.

Edge cases: a null or empty page, or one without text outside boilerplate, gives an empty text; a page cut off in a
tag or a reference keeps what stands before; a page without any scored paragraph gives the blocks of its
body; ties go to the container that comes first; repeated rows give repeated results; an empty table gives an
empty result; other columns are ignored. Nothing is capped: depth and length of a page are not limited.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from toxscan.llm.common import python_ready

# Fixed values of HTML: elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math".split())
BLOCK = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre
section summary table tbody td tfoot th thead tr ul caption""".split())
PARAGRAPHS = frozenset("p pre td blockquote h1 h2 h3 h4 h5 h6 li dd dt figcaption caption th".split())
#: Never part of an article.
LEFT_OUT = frozenset("""head nav footer aside form button select option optgroup input label fieldset legend menu dialog
canvas object embed audio video map""".split()) | RAW
#: Class or id words that name what surrounds an article.
BOILERPLATE = re.compile(
    r"(?:ads?|adverts?|advertisements?|advertising|adsense|banner|breadcrumbs?|comments?|commentlist|cookies?|consent|"
    r"disqus|dropdown|footer|gdpr|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|notification|"
    r"overlay|pager|pagination|popup|promo|promoted|related|recommended|respond|replies|reply|rss|share|sharing|sidebar|sidebars|"
    r"skip|social|sponsor|sponsored|subscribe|subscription|tags?|toolbar|toc|tooltip|widgets?)\Z", re.I)
#: Of these, words that a part of the article may have too, beside a word that names the article.
DOUBTFUL = frozenset("header banner masthead tag tags toc related notice overlay".split())
ARTICLE = re.compile(r"(?:^|[\s_-])(?:article|entry|post|story)(?:$|[\s_-])", re.I)
#: Words that say nothing of their own in a class or id.
NEUTRAL = frozenset("""area bar block body bottom box container content form inner item items left link links list main outer panel
post posts right row section top wrap wrapper""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
#: Where an end tag is left out: an open element of the key ends before a start tag of the value.
_P_ENDERS = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "option", "optgroup", "summary"}
ENDS_BEFORE = {
    "p": _P_ENDERS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"},
    "td": {"td", "th", "tr", "tbody", "tfoot", "thead"}, "th": {"td", "th", "tr", "tbody", "tfoot", "thead"},
    "tr": {"tr", "tbody", "tfoot", "thead"}, "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"},
    "head": {"body"},
}
#: An end that is left out is not looked for beyond these.
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"},
          "thead": {"table"}, "tbody": {"table"}, "p": {"button", "td", "th", "li", "caption", "object"}}

#: Elements whose end may be left out, and that do not stop the search for one.
ENDS_BY_ITSELF = frozenset("p li dd dt td th tr thead tbody tfoot option".split())
MARKS = BLOCK | frozenset(ENDS_BEFORE)
SCOPE_MARKS = MARKS.union(*SCOPES.values())
#: A stray end tag of an inline element does not close these.
WALLS = frozenset("td th table article body".split())

#: A quote opens a value behind "=" only; elsewhere it is a character like others.
_VALUE = r"=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^\s>\"'][^\s>]*)?"
_MARK = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>=]+|{_VALUE})*)(?:>|\Z)"
    r"|</[^a-zA-Z][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?=[\s=/]|\Z)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_COMMAS = re.compile(r"[,،、，·﹐]")

MIN_PARAGRAPH = 25
#: Characters of prose that a sibling needs, and how its sentences end.
PROSE = 80
_STOP = re.compile(r"[.!?。！？]")
SIBLING_SHARE = 0.2
#: A suspect's share of its score, and what leaves it out: link density above, or characters below.
SUSPECT_SHARE = 0.75
SUSPECT_DENSITY = 0.5
SUSPECT_SHORT = 80
#: What the names of an element say: nothing, suspect by its id, suspect by its class, not of the article.
CLEAR, BY_ID, BY_CLASS, OUT = range(4)


def _one_line(text: str) -> str:
    """``text`` with its references decoded and each run of white space as one space."""
    return " ".join(html.unescape(text).split())


class Element:
    """``children``: elements and texts in page order. ``mark``: the nearest element, from this one up, that may end by itself or stops
    the search for one; ``scope``: the same, or one that limits such a search; ``wall``: the nearest container that stray end tags
    do not close. ``within``: how many elements of each tag are open in a wall."""

    __slots__ = ("tag", "parent", "children", "out", "in_link", "suspect", "score", "n_text", "n_link", "mark", "scope", "wall", "within")

    def __init__(self, tag: str, parent: Element | None, out: bool = False, suspect: int = CLEAR):
        self.tag, self.parent, self.out, self.suspect = tag, parent, out, suspect
        self.in_link = tag == "a" or (parent is not None and parent.in_link)
        self.children: list = []
        self.score = 0.0
        self.n_text = self.n_link = 0
        self.mark = self if parent is None or tag in MARKS else parent.mark
        self.scope = self if parent is None or tag in SCOPE_MARKS else parent.scope
        self.wall = self if parent is None or tag in WALLS else parent.wall
        self.within: dict[str, int] | None = {} if self.wall is self else None


def _boilerplate(tag: str, rest: str, in_article: bool) -> int:
    if tag in LEFT_OUT:
        return OUT
    if tag in ("html", "body", "article", "main") or not rest or "=" not in rest and "hidden" not in rest.lower():
        return CLEAR
    names = []
    for m in _ATTRIBUTE.finditer(rest):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and _HIDDEN_STYLE.search(value)):
            return OUT
        if key == "role" and value.lower() in ROLES:
            return OUT
        if key in ("class", "id"):
            names += [(key, name) for name in value.split()]
    said, words = CLEAR, set()
    for key, name in names:
        parts = [w.lower() for w in re.split(r"[_-]+", name) if w]
        hits = {w for w in parts if BOILERPLATE.match(w)}
        if not hits:
            continue
        words |= hits
        if not all(w in hits or w in NEUTRAL for w in parts) or tag in HEADINGS or key == "id" and in_article:
            said = max(said, BY_ID if key == "id" else BY_CLASS)
        else:
            said = OUT
    return CLEAR if words <= DOUBTFUL and ARTICLE.search(" ".join(n for _, n in names)) else said


class Path:
    """The open elements of a page, from the root to ``last``. Every step costs what it opens or closes, however deep the page."""

    def __init__(self):
        self.root = self.last = Element("", None)
        self.open: dict[str, int] = {}

    def enter(self, e: Element) -> None:
        self.last = e
        self.open[e.tag] = self.open.get(e.tag, 0) + 1
        if e.wall is not e:
            e.wall.within[e.tag] = e.wall.within.get(e.tag, 0) + 1

    def leave_to(self, above: Element) -> None:
        e = self.last
        while e is not above:
            self.open[e.tag] -= 1
            if e.wall is not e:
                e.wall.within[e.tag] -= 1
            e = e.parent
        self.last = above

    def in_article(self) -> bool:
        return bool(self.open.get("article") or self.open.get("main"))

    def end(self, tag: str) -> None:
        """An end tag. A stray one closes nothing, and one of an inline element no container."""
        if not (self.open.get(tag) if tag in BLOCK else self.last.wall.within.get(tag)):
            return
        e = self.last
        while e.tag != tag:
            e = e.parent
        self.leave_to(e.parent)

    def make_room(self, tag: str) -> None:
        """Close what a start tag ends by itself."""
        limits = SCOPES.get(tag, ())
        scoped = bool(limits)
        e = self.last.scope if scoped else self.last.mark
        while e is not None:
            if tag in ENDS_BEFORE.get(e.tag, ()):
                self.leave_to(e.parent)
                e = self.last
            elif e.tag in limits or (e.tag in BLOCK and e.tag not in ENDS_BY_ITSELF):
                return
            else:
                e = e.parent
            e = None if e is None else e.scope if scoped else e.mark


def parse(page: str) -> Element:
    """The tree of a page, without what never belongs to the article."""
    path = Path()
    at = 0
    find = _MARK.search
    while True:
        m = find(page, at)
        if m is None:
            _say(path.last, page[at:])
            return path.root
        if m.start() > at:
            _say(path.last, page[at:m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"]:
            path.end(tag)
            continue
        rest = m["rest"]
        path.make_room(tag)
        if tag in RAW and not rest.endswith("/"):
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = close.end() if close else len(page)
            continue
        said = _boilerplate(tag, rest, path.in_article())
        out = path.last.out or said == OUT or (tag == "header" and not path.in_article())
        element = Element(tag, path.last, out, said)
        path.last.children.append(element)
        if tag not in VOID and not (rest.endswith("/") and tag not in BLOCK):
            path.enter(element)


def _say(to: Element, text: str) -> None:
    if text and not to.out:
        to.children.append(text)


def _elements(root: Element) -> list[Element]:
    """All elements that are not left out, parents first."""
    found, todo = [], [root]
    while todo:
        e = todo.pop()
        if e.out:
            continue
        found.append(e)
        todo.extend(c for c in reversed(e.children) if isinstance(c, Element))
    return found


def _own_text(e: Element) -> str:
    """Text of ``e`` outside blocks within it, its inline elements included."""
    parts, todo = [], [iter(e.children)]
    while todo:
        for c in todo[-1]:
            if isinstance(c, str):
                parts.append(c)
            elif not c.out and c.tag not in BLOCK:
                todo.append(iter(c.children))
                break
        else:
            todo.pop()
    return "".join(parts)


def score(root: Element) -> list[Element]:
    """Score the tree; its elements that are not left out, parents first."""
    found, left_out = _elements(root), False
    for e in reversed(found):  # children before parents
        for c in e.children:
            if isinstance(c, str):
                n = len(c) - c.count(" ")
                e.n_text += n
                e.n_link += n if e.in_link else 0
            elif not c.out:
                e.n_text += c.n_text
                e.n_link += c.n_link
        if e.suspect and (e.n_link > SUSPECT_DENSITY * e.n_text or e.suspect == BY_CLASS and e.tag not in HEADINGS and
                          e.n_text < SUSPECT_SHORT):
            e.out = left_out = True
    if left_out:
        found = _elements(root)
    for e in found:
        if e.tag not in PARAGRAPHS and not (e.tag in BLOCK and any(isinstance(c, str) and c.strip() for c in e.children)):
            continue
        text = _one_line(_own_text(e))
        if len(text) < MIN_PARAGRAPH:
            continue
        points = 1 + len(_COMMAS.findall(text)) + len(text) / 100
        points *= 1 - (e.n_link / e.n_text if e.n_text else 0)
        share, above = 1.0, e.parent
        if e.tag not in PARAGRAPHS:
            e.score += points
        while above is not None and share > 1e-4:  # what is left for farther ancestors decides nothing
            above.score += points * share
            share /= 2 if share == 1.0 else 1.5
            above = above.parent
    for e in found:
        e.score *= 1 - (e.n_link / e.n_text if e.n_text else 0)
        e.score *= SUSPECT_SHARE if e.suspect else 1
    return found


def kept(root: Element) -> list[Element]:
    """The best container and the siblings that go with it, in page order."""
    found = score(root)
    holders = [e for e in found if e.tag in ("article", "main", "body", "div", "section", "td", "blockquote", "center", "") or
               e.tag in BLOCK - PARAGRAPHS]
    best = max(holders, key=lambda e: e.score, default=None)
    if best is None or best.score <= 0:
        return [next((e for e in found if e.tag == "body"), root)]
    whole = best
    while whole.parent is not None and whole.tag not in ("article", "main", "body"):
        whole = whole.parent
    if whole.tag in ("article", "main"):  # a part of an article brings the article
        best = whole
    if best.parent is None or best.tag in ("article", "main", "body"):
        return [best]
    return [e for e in best.parent.children if isinstance(e, Element) and not e.out and (e is best or _goes_along(e, best))]


def _goes_along(e: Element, best: Element) -> bool:
    density = e.n_link / e.n_text if e.n_text else 0
    if e.score >= max(3.0, SIBLING_SHARE * best.score) and density < 0.5:
        return True
    if e.tag in PARAGRAPHS:
        return e.n_text > 0 and density < (0.25 if e.n_text > 80 else 0.05)
    # Prose beside the best container, in an element that nothing speaks against, is of the article too.
    return e.tag in BLOCK and not e.suspect and density < 0.25 and _sentences(e)


def _sentences(e: Element) -> bool:
    """Whether ``e`` has a paragraph of prose: some length, and the end of a sentence."""
    for b in blocks(e):
        text = _one_line(b)
        if len(text) >= PROSE and _STOP.search(text):
            return True
    return False


def blocks(e: Element) -> Iterator[str]:
    """Texts of the blocks of ``e`` in page order, as they stand in the page."""
    parts: list[str] = []
    todo = [(e, iter(e.children))]
    while todo:
        holder, children = todo[-1]
        for c in children:
            if isinstance(c, str):
                parts.append(c)
            elif not c.out:
                if c.tag == "br":
                    parts.append(" ")
                if c.tag in BLOCK:
                    yield "".join(parts)
                    parts.clear()
                todo.append((c, iter(c.children)))
                break
        else:
            todo.pop()
            if holder.tag in BLOCK or not todo:
                yield "".join(parts)
                parts.clear()


def main_text(page: str) -> str:
    """The main text of a page."""
    found = (_one_line(b) for e in kept(parse(page)) for b in blocks(e))
    return "\n".join(b for b in found if b)


def extract(df: DataFrame, keep: list[str] = ["page_id", "url"], html_col: str = "html") -> DataFrame:
    """Per row of ``df``: the columns ``keep``, ``text`` and ``n_chars`` (its code points)."""
    python_ready(df.sparkSession)
    picked = df.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)],
                       F.coalesce(F.col(html_col), F.lit("")).alias("_html"))
    schema = T.StructType([*picked.schema.fields[:-1], T.StructField("_text", T.StringType())])

    def texts(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = pa.array((main_text(p.as_py()) for p in batch.column(len(keep))), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], names=schema.names)

    return picked.mapInArrow(texts, schema).select(
        *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], F.col("_text").alias("text"),
        F.length("_text").cast("long").alias("n_chars"))
