"""Main text of web pages from parser events and the density of text per line.

A page is cut into lines at block tags. Each line has a text-to-tag ratio (its characters over the tags in
it); the ratios are smoothed with a Gaussian and split at a threshold taken from their own spread (content
extraction via tag ratios). The lines above the threshold choose the part of the page that holds the text, and
every line of that part which is not marked as something else is kept, however short.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperlode.llm.common import pieces, text_or_empty

#: Elements whose start and end break a line.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre search section summary table "
    "tbody td tfoot th thead title tr ul".split()
)
#: Elements that may hold the text of a page together with other parts.
CONTAINERS = frozenset("html body div section article main center table tbody tr td search".split())
#: Elements that are never part of the text.
OTHER = frozenset(
    "nav footer aside form menu search head title script style noscript template iframe object svg canvas math audio "
    "video button select textarea dialog".split()
)
#: Words in class or id, and roles, that mark something else than the text; inside an article, heads are titles.
_COMMENTS = r"comments?|respond|replies|reply|disqus"
#: Words that name parts of articles as well ("discussion", "share-prices"): they hide only what also looks like something else.
_WEAK = r"discussions?|alerts?|related|recommend\w*|shares?|sharing"
_WORDS = (
    r"ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|" + _COMMENTS + r"|"
    r"cookies?|consent|gdpr|notices?|sidebar|widget|menu|nav|navbar|navigation|breadcrumbs?|footer|"
    r"topbar|toolbar|social|newsletter|subscribe|signup|login|popup|modal|overlay|"
    r"pagination|pager|skip"
)
MARKED = re.compile(rf"(?:^|[\s_-])(?:header|masthead|{_WORDS})(?:$|[\s_-])", re.IGNORECASE)
MARKED_INSIDE = re.compile(rf"(?:^|[\s_-])(?:{_WORDS})(?:$|[\s_-])", re.IGNORECASE)
#: A name that begins with its word ("related-posts") names the element itself; others ("with-sidebar") often a layout.
NAMED = re.compile(rf"(?:^|\s)(?:header|masthead|{_WORDS})(?:$|[\s_-])", re.IGNORECASE)
REMARKS = re.compile(rf"(?:^|[\s_-])(?<!no[_-])(?<!has[_-])(?<!with[_-])(?<!without[_-])(?:{_COMMENTS})(?:$|[\s_-])", re.IGNORECASE)
WEAK_NAME = re.compile(rf"(?:^|[\s_-])(?:{_WEAK})(?:$|[\s_-])", re.IGNORECASE)
WEAK_NAMED = re.compile(rf"(?:^|\s)(?:{_WEAK})(?:$|[\s_-])", re.IGNORECASE)
#: What remarks of readers have: names, times and forms.
SIGNS = re.compile(r"(?:^|[\s_-])(?:author|user|username|avatar|posted|timestamp|comment\w*|reply|replies)(?:$|[\s_-])", re.IGNORECASE)
SIGN_TAGS = frozenset("form textarea time".split())
#: Part of a weakly named element's characters that are links, and the longest plain line, that tell it from an article's part.
LINKED, PLAIN_LINE = 0.2, 60
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements without an end tag end where one of their kind starts, unless an element between them holds it.
_LIST = BLOCKS - {"address", "div", "p"}
ENDED_BY = {
    "li": (frozenset(["li"]), _LIST - {"li"}),
    "dd": (frozenset(["dd", "dt"]), _LIST - {"dd", "dt"}),
    "dt": (frozenset(["dd", "dt"]), _LIST - {"dd", "dt"}),
    "td": (frozenset(["td", "th"]), frozenset(["table"])),
    "th": (frozenset(["td", "th"]), frozenset(["table"])),
    "tr": (frozenset(["td", "th", "tr"]), frozenset(["table"])),
}
PARAGRAPH = (frozenset(["p"]), BLOCKS - {"p"})
#: How much of the dense text a part must hold to be taken for the whole text.
MAJORITY = 0.8
#: What hides: an element that is never text, remarks, an element named as something else, a name or form around others.
#: A weak name is judged when all of the page is read, and is one of the others or nothing from then on.
NEVER, REMARK, NAME, AROUND, WEAK, NOTHING = range(6)


class _Tree:
    """What stands inside what: every part knows the part around it, so that depth costs nothing. -1 is outside of all."""

    def __init__(self) -> None:
        self.around: list[int] = []

    def add(self, around: int) -> int:
        self.around.append(around)
        return len(self.around) - 1

    def sums(self, own: dict[int, int]) -> list[int]:
        """Of each part what it and all parts inside of it hold."""
        out = [own.get(k, 0) for k in range(len(self.around))]
        for k in range(len(out) - 1, -1, -1):
            if self.around[k] >= 0:
                out[self.around[k]] += out[k]
        return out

    def along(self, start, step) -> list:
        """A value of each part from that of the part around it: step(value around, part)."""
        out: list = []
        for k, around in enumerate(self.around):
            out.append(step(out[around] if around >= 0 else start, k))
        return out


class _Lines(HTMLParser):
    """Collects (text, tags, what hides it, container, inside an article) for every line of a page, how many of its characters
    are links, and which lines are headings or nothing but links."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, bool]] = []
        self.linked: list[int] = []
        self.headings: set[int] = set()
        self.heading = False
        self.links: set[int] = set()
        self.link, self.plain, self.in_links = False, False, 0
        # open blocks and elements that hide, each with the state in front of it, and where each kind of them is open
        self.stack: list[tuple[str, int, int, bool]] = []
        self.open: dict[str, list[int]] = {}
        self.path, self.paths, self.kinds = -1, _Tree(), []
        # a shade is a mark inside of other shades; `named` is the same shade without the marks of mere wrappers
        self.hidden, self.shades = -1, _Tree()
        self.mark_of: list[int] = []
        self.named: list[int] = []
        self.soft: list[bool] = []
        self.marks: list[int] = []
        self.weak: dict[int, bool] = {}
        self.signs: dict[int, int] = {}
        self.marked_inside: list[bool] = []
        self.inside = False
        self.tags = 0
        self.parts: list[str] = []

    def _shade(self, mark: int, around: int) -> int:
        named = self.named[around] if around >= 0 else -1
        shade = self.shades.add(around)
        self.mark_of.append(mark)
        self.soft.append(self.marks[mark] in (NAME, AROUND, WEAK) and (around < 0 or self.soft[around]))
        self.named.append(named)
        if self.marks[mark] in (NAME, WEAK):
            self.named[shade] = shade if named == around else self._shade(mark, named)
        return shade

    def _end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            if self.heading:
                self.headings.add(len(self.lines))
            if not self.plain:
                self.links.add(len(self.lines))
            self.lines.append((text, self.tags, self.hidden, self.path, self.inside))
            self.linked.append(min(self.in_links, len(text)))
        self.parts, self.tags, self.plain, self.in_links = [], 0, False, 0

    def _other(self, tag: str, attrs) -> int | None:
        """How an element hides what it holds, if it does."""
        if tag in OTHER:
            return AROUND if tag == "form" else NEVER
        if tag == "header":
            return None if self.inside else NEVER  # inside of an article it holds the title
        if tag in ("html", "body", "main") or tag == "article" and self.hidden < 0:
            return None
        marked, found = MARKED_INSIDE if self.inside else MARKED, []
        for name, value in attrs:
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                return NEVER
            if value and name == "role" and value.lower() in ROLES:
                return NEVER
            if value and name in ("class", "id") and marked.search(value):
                found.append(REMARK if REMARKS.search(value) else NAME if NAMED.search(value) else AROUND)
            elif value and name in ("class", "id") and WEAK_NAME.search(value):
                found.append(WEAK)
        return min(found, default=None)

    def _pop(self, length: int) -> None:
        while len(self.stack) > length:
            tag, self.hidden, self.path, self.inside = self.stack.pop()
            self.open[tag].pop()

    def _end(self, tags: frozenset[str], within: frozenset[str]) -> None:
        """Close the open elements of these tags that no element of `within` holds."""
        if any(self.open.get(tag) for tag in tags):
            held = max((self.open[tag][-1] for tag in within if self.open.get(tag)), default=-1)
            places = (self.open.get(tag, []) for tag in tags)
            self._pop(min((p[at] for p in places if (at := bisect_right(p, held)) < len(p)), default=len(self.stack)))

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in BLOCKS:
            self._end_line()
            self.heading = tag in HEADINGS
            self._end(*PARAGRAPH)
            if tag in ENDED_BY:
                self._end(*ENDED_BY[tag])
        self.tags += 1
        self.link = self.link or tag == "a"
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        if self.hidden >= 0 and (tag in SIGN_TAGS or any(v and n in ("class", "id") and SIGNS.search(v) for n, v in attrs)):
            self.signs[self.hidden] = self.signs.get(self.hidden, 0) + 1
        other = self._other(tag, attrs)
        if other is None and tag not in BLOCKS and tag not in CONTAINERS:
            return
        self.stack.append((tag, self.hidden, self.path, self.inside))
        self.open.setdefault(tag, []).append(len(self.stack) - 1)
        if other is not None:
            mark = len(self.marks)
            self.marks.append(other)
            self.marked_inside.append(self.inside)
            if other == WEAK:
                self.weak[mark] = any(v and n in ("class", "id") and WEAK_NAMED.search(v) for n, v in attrs)
            self.hidden = self._shade(mark, self.hidden)
        elif tag == "main":
            # the main part of a page is shown even if its wrapper is named after a side bar
            self.hidden = -1
        elif tag == "article" and self.hidden >= 0 and self.soft[self.hidden]:
            self.hidden = self.named[self.hidden]
        self.inside = self.inside or tag in ("article", "main")
        if tag in CONTAINERS and other != NEVER:
            self.path = self.paths.add(self.path)
            self.kinds.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self._end_line()
            self.heading = False
        if tag in BLOCKS or tag == "a":
            self.link = False
        self.tags += 1
        if not self.open.get(tag):
            return
        if tag in ENDED_BY or tag == "p":
            self._end(frozenset([tag]), ENDED_BY.get(tag, PARAGRAPH)[1])
            return
        self._pop(self.open[tag][-1])

    def handle_startendtag(self, tag: str, attrs) -> None:
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        else:  # a slash does not close an HTML element, it is ignored
            self.handle_starttag(tag, attrs)

    def handle_data(self, data: str) -> None:
        self.parts.append(data)
        if self.link:
            self.in_links += len(data.strip())
        self.plain = self.plain or not self.link and not data.isspace()

    def finish(self) -> None:
        self.close()
        self._end_line()
        self._judge()

    def _judge(self) -> None:
        """A weakly named element is hidden if a good part of it is links, if it has no line like an article's, if it has
        what remarks have, or if it stands outside of the article of a page that has one."""
        if not self.weak:
            return
        chars: dict[int, int] = {}
        linked: dict[int, int] = {}
        prose: dict[int, int] = {}
        for (text, _, shade, _, _), in_links in zip(self.lines, self.linked):
            chars[shade] = chars.get(shade, 0) + len(text)
            linked[shade] = linked.get(shade, 0) + in_links
            prose[shade] = prose.get(shade, 0) + (len(text) - in_links >= PLAIN_LINE)
        found = [self.shades.sums(x) for x in (chars, linked, prose, self.signs)]
        by_mark = {m: [0, 0, 0, 0] for m in self.weak}
        for shade, mark in enumerate(self.mark_of):
            if mark in by_mark:
                by_mark[mark] = [a + x[shade] for a, x in zip(by_mark[mark], found)]
        article = any(line[4] and line[2] < 0 for line in self.lines)
        for mark, (n, in_links, lines, signs) in by_mark.items():
            beside = article and not self.marked_inside[mark]
            other = in_links >= LINKED * n or not lines or signs or beside
            self.marks[mark] = (REMARK if signs else NAME if self.weak[mark] else AROUND) if other else NOTHING

    def shown(self, free) -> list[bool]:
        """Of each line whether all marks on it are of a kind, or are marks, that `free` says yes to."""
        open_ = self.shades.along(True, lambda around, shade: around and free(self.mark_of[shade]))
        return [line[2] < 0 or open_[line[2]] for line in self.lines]


def smoothed(ratios: np.ndarray, radius: int = 2) -> np.ndarray:
    """Gaussian smoothing along the lines of a page; the ends are weighted by what there is."""
    kernel = np.exp(-0.5 * np.arange(-radius, radius + 1) ** 2)
    weight = np.convolve(np.ones(len(ratios)), kernel)[radius : radius + len(ratios)]
    return np.convolve(ratios, kernel)[radius : radius + len(ratios)] / weight


def _dense(lines, kept: list[bool], links: set[int]) -> list[int]:
    """The kept lines whose smoothed text-to-tag ratio is high, all of them if none is. Lines of links only count by
    their own ratio, so that a short one beside the text does not."""
    ratios = np.array([len(line[0]) / max(1, line[1]) if k else 0.0 for line, k in zip(lines, kept)])
    level = smoothed(ratios)
    least = min(level.std(), level.max())
    dense = [i for i, k in enumerate(kept) if k and level[i] >= least and (i not in links or ratios[i] >= least)]
    return dense or [i for i, k in enumerate(kept) if k]


def _kept(page: _Lines) -> list[bool]:
    """Which lines are shown. An element that holds most of the dense text of a page does not hide it, whatever its name,
    unless another part is an article; if nothing is left then, names hide nothing, and at last remarks are the text."""
    lines, marks = page.lines, page.marks
    if all(m == NOTHING for m in marks):
        return [True] * len(lines)
    text = page.shown(lambda m: marks[m] not in (NEVER, REMARK))
    clear = page.shown(lambda m: marks[m] == NOTHING)
    lifted: set[int] = set()
    if any(t and not c for t, c in zip(text, clear)):
        dense = _dense(lines, text, page.links)
        most = sum(len(lines[i][0]) for i in dense) / 2
        own: dict[int, int] = {}
        for i in dense:
            own[lines[i][2]] = own.get(lines[i][2], 0) + len(lines[i][0])
        held: dict[int, int] = {}
        for shade, n in enumerate(page.shades.sums(own)):
            held[page.mark_of[shade]] = held.get(page.mark_of[shade], 0) + n
        article = any(line[4] and c for line, c in zip(lines, clear))
        lifted = {m for m, n in held.items() if n > most and (page.marked_inside[m] or not article)}
    for free in (lambda m: m in lifted, lambda m: marks[m] in (NAME, AROUND), lambda m: marks[m] != NEVER):
        kept = page.shown(lambda m, free=free: marks[m] == NOTHING or free(m))
        if any(kept):
            break
    return kept


def main_text(html: str) -> str:
    """The text of one page, one block a line."""
    page = _Lines()
    page.feed(html)
    page.finish()
    kept = _kept(page)
    lines = [(text, tags, k, path) for (text, tags, _, path, _), k in zip(page.lines, kept)]
    if not any(kept):
        return ""
    dense = _dense(lines, kept, page.links)
    own: dict[int, int] = {}
    for i in dense:
        own[lines[i][3]] = own.get(lines[i][3], 0) + len(lines[i][0])
    inside = dict(enumerate(page.paths.sums(own)))
    total = sum(len(lines[i][0]) for i in dense)
    # an article that holds nearly all of the dense text, the outermost of them, or else the innermost part that holds
    # every dense line
    articles = [part for part, n in inside.items() if page.kinds[part] in ("article", "main") and n >= MAJORITY * total]
    whole = [part for part, n in inside.items() if n == total]
    chosen = min(articles) if articles else max(whole, default=None)
    # of each container whether it is the chosen one or stands in it; lines outside of all containers have none
    within = page.paths.along(chosen is None, lambda around, part: around or part == chosen)
    held = [within[path] if path >= 0 else chosen is None for *_, path in lines]
    if chosen is None or page.kinds[chosen] in ("html", "body"):
        # the text has no element of its own: it goes from its first dense line to the last line that follows its
        # dense lines without a break
        first, last = dense[0], dense[-1]
        while last + 1 < len(lines) and lines[last + 1][2] and lines[last + 1][3] == lines[last][3]:
            last += 1
    else:
        own_lines = [i for i, h in enumerate(held) if h]
        first, last = own_lines[0], own_lines[-1]
    top = first
    while top - 1 in page.headings and lines[top - 1][2]:
        top -= 1
    return "\n".join(
        text
        for i, (text, _, k, _) in enumerate(lines)
        if k and (top <= i < first or first <= i <= last and held[i])
    )


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page row: page_id, url, text, n_chars (code points).

    A null or empty page, or one without any text, has an empty text. Ids and addresses go through as they are,
    nulls and repeats included; extra columns are ignored. Nothing is shuffled and a page of any length is
    parsed whole.
    """

    @F.arrow_udf(T.StringType())
    def extract(html: pa.Array) -> pa.Array:
        return pa.array([main_text(h) for part in pieces(html) for h in part.to_pylist()], pa.string())

    found = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"),
                         extract(text_or_empty(F.col(html_col))).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
