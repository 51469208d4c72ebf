"""Main text of web pages from streaming parser events and text-to-tag ratios.

The standard library's parser feeds one pass of events; blocks ("lines") are cut at block-level tags.
Each line has a text-to-tag ratio (characters per tag in it); the ratios are smoothed with a Gaussian
along the page and split into two clusters by a threshold moved to the midpoint of the cluster means.
On a page with ``main`` or ``article`` elements the regions are the outermost of them (those in ``main``, when there is one),
and all text of a region is kept if it has a line of the high cluster or is not mostly links. On other pages
the high cluster votes for the container (section, div, ...) that holds the content: the deepest one that holds all
votes (lines that are mostly links have none, and a part of a table, a quote or a centred block is never the container). All
lines of that container are the text, so short paragraphs between long ones stay; lines of the low cluster that are mostly links go.
Elements that are never content (navigation, header, footer, aside, forms, scripts, styles, hidden parts, and elements whose class, id or
role is the name of an advert, notice, menu, sidebar or comments, alone or with words of place: ``site-header``, not
``notice-period``) are left out on the way. A form that holds more text than the rest of the page is the page: only its fields go.

Character references are decoded, white space inside a block becomes one space, blocks are joined by
one newline. Defined cases: NULL or empty html gives an empty text; broken markup never fails (an
unclosed element ends with its parent); a very long page is read whole, in one pass; pages are independent rows, so repeated
pages give equal rows; an empty table gives no rows; columns named as the new ones are replaced, others pass through."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame

from .common import add_columns, table

SIGMA, SHARE = 1.5, 0.85
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIP = frozenset(("script style noscript template nav header footer aside form head title svg iframe object canvas audio video button select "
                  "option textarea dialog menu datalist fieldset").split())
CONTAINER = frozenset("html body main article section div td th table tbody tr center blockquote".split())
PART = frozenset("td th table tbody tr center blockquote".split())
BLOCK = CONTAINER | SKIP | frozenset(("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre hr figure figcaption address details summary caption thead tfoot "
                                      "hgroup search").split())
#: Words of class, id and role attributes that mark what is not the article.
NOT_CONTENT = frozenset((
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar sidebars menu menus nav navbar navigation "
    "breadcrumb breadcrumbs comment comments commentlist respond reply replies disqus cookie cookies consent gdpr notice notices notification alert popup modal "
    "overlay toast newsletter subscribe signup subscription share sharing social related recommended recommendations footer header masthead topbar toolbar "
    "pagination pager widget widgets login search contentinfo complementary toc skip").split())
#: Words that may stand beside them in a name.
BESIDE = frozenset((
    "site page main global top bottom left right primary secondary list lists section box container wrapper wrap area block bar item items form forms link links inner "
    "outer panel unit slot text icon icons button buttons row col column module posts post articles stories thread count field input message").split())
FIELDS = frozenset("label legend input".split())
FIELD_TAGS = FIELDS | frozenset("script style noscript template select option button textarea".split())
STATE = ("with", "has", "no", "is", "js", "without")
NAME = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
WHOLE = ("html", "body", "main")


def not_content(tag: str, attrs, in_form: bool = False) -> bool:
    if tag in SKIP:
        return not (in_form and tag in ("form", "fieldset"))
    if in_form and tag in FIELDS:
        return True
    for k, v in attrs:
        if k == "hidden" or (k == "aria-hidden" and v == "true") or (k == "style" and v and HIDDEN.search(v)):
            return tag not in ("html", "body")
        if k in ("class", "id", "role") and v and tag not in WHOLE:
            for name in v.split():
                words = [w.lower() for w in NAME.split(name) if w]
                if words and words[0] not in STATE and not NOT_CONTENT.isdisjoint(words) and NOT_CONTENT.union(BESIDE).issuperset(words):
                    return True
    return False


class Lines(HTMLParser):
    """Collects (container, text, tags, link characters) per block, content candidates only."""

    def __init__(self, in_form: bool = False):
        super().__init__(convert_charrefs=True)
        self.in_form, self.forms, self.form_chars = in_form, 0, 0      # whether forms are read, open forms, characters in them
        self.parent, self.kind = [-1], ["root"]       # containers seen, by number
        self.stack = [("root", 0, False)]             # open elements: tag, container, not content
        self.lines, self.buf, self.tags, self.links, self.in_link = [], [], 0, 0, 0

    def flush(self):
        if self.buf:
            text = " ".join("".join(self.buf).split())
            if text:
                self.lines.append((self.stack[-1][1], text, self.tags, self.links))
            self.buf = []
        self.tags = self.links = 0

    def handle_starttag(self, tag, attrs):
        block = tag in BLOCK
        if block:
            while len(self.stack) > 1 and self.stack[-1][0] == "p":
                self.flush()
                self.stack.pop()
            self.flush()
            if tag in ("body", "main", "article"):
                while len(self.stack) > 1 and self.stack[-1][0] in ("head", "title", "style"):
                    self.stack.pop()
        self.tags += 1
        if tag in VOID:
            if tag in ("br", "hr", "img", "wbr") and tag != "wbr" and not self.stack[-1][2]:
                self.buf.append(" ")
            return
        top = self.stack[-1]
        out = top[2] or not_content(tag, attrs, self.in_form)
        self.forms += tag == "form"
        if tag == "a":
            self.in_link += 1
        if tag in CONTAINER and not out:
            self.parent.append(top[1])
            self.kind.append(tag)
            self.stack.append((tag, len(self.kind) - 1, False))
        elif tag in CONTAINER or out or tag == "a":
            self.stack.append((tag, top[1], out))

    def handle_startendtag(self, tag, attrs):
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        else:                                # a slash does not close other elements
            self.handle_starttag(tag, attrs)
            if tag in ("svg", "iframe", "object") or tag not in BLOCK:
                self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.flush()
        self.tags += 1
        if tag in VOID:
            return
        if tag == "a" and self.in_link:
            self.in_link -= 1
        self.forms -= tag == "form" and self.forms > 0
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                return
            if tag not in CONTAINER and self.stack[i][0] in CONTAINER:
                return                                 # a stray end tag does not close its surroundings

    def handle_data(self, data):
        if self.forms and self.stack[-1][0] not in FIELD_TAGS:
            self.form_chars += len(data.split())
        if not self.stack[-1][2]:
            self.buf.append(data)
            if self.in_link:
                self.links += len(data)

    def done(self):
        self.close()
        self.flush()
        return self


def smooth(x: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing along the page; at the ends over the lines that are there."""
    r = min(len(x) - 1, int(3 * sigma))
    if r < 1:
        return x
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(x, k, mode="full")[r:-r] / np.convolve(np.ones(len(x)), k, mode="full")[r:-r]


def threshold(x: np.ndarray) -> float:
    """Boundary of two clusters: moved to the midpoint of the cluster means until it rests."""
    t = float(x.mean())
    for _ in range(20):
        hi, lo = x[x >= t], x[x < t]
        if not len(lo) or not len(hi):
            break
        new = (float(hi.mean()) + float(lo.mean())) / 2
        if abs(new - t) < 1e-6:
            break
        t = new
    return t


def _container(p: Lines, size: np.ndarray, high: np.ndarray, share: float) -> int:
    """The deepest container with ``share`` of the characters of the high lines."""
    votes = [0.0] * len(p.kind)
    for (c, *_), v, h in zip(p.lines, size, high):
        if h:
            votes[c] += v
    for c in range(len(votes) - 1, 0, -1):             # children have larger numbers
        votes[p.parent[c]] += votes[c]
    return max((c for c in range(len(votes)) if votes[c] >= share * votes[0]), default=0)


def _regions(p: Lines, size: np.ndarray, links: np.ndarray, high: np.ndarray) -> set[int]:
    """The outermost main or article elements with content of their own (those of ``main``, if there is one)."""
    top = []                                           # per container: the outermost main or article around it, else -1
    for c in range(len(p.kind)):
        above = top[p.parent[c]] if p.parent[c] >= 0 else -1
        top.append(above if above >= 0 else c if p.kind[c] in ("article", "main") else -1)
    of_line = np.array([top[c] for c, *_ in p.lines])
    found = set()
    for r in sorted(set(of_line.tolist()) - {-1}):
        at = of_line == r
        if high[at].any() or links[at].sum() < 0.5 * size[at].sum():
            found.add(r)
    mains = {r for r in found if p.kind[r] == "main"}
    return mains or found


def _kept(p: Lines) -> list[str]:
    size = np.array([len(t) for _, t, _, _ in p.lines], float)
    links = np.array([n for *_, n in p.lines], float)
    ratio = smooth(size / np.array([max(1, n) for _, _, n, _ in p.lines]))
    high = ratio >= threshold(ratio)
    regions = _regions(p, size, links, high)
    whole = bool(regions)
    if not whole:
        held = {0}                                     # the container holds that of most votes, too
        at = best = _container(p, size, high, SHARE)
        while at > 0:
            held.add(at)
            at = p.parent[at]
        text = high & (links < 0.5 * size)
        best = _container(p, size, text if text.any() else high, 1.0)
        while best not in held or p.kind[best] in PART:
            best = p.parent[best]
        regions = {best}
    inside = []
    for c in range(len(p.kind)):
        inside.append(c in regions or (p.parent[c] >= 0 and inside[p.parent[c]]))
    return [t for (c, t, _, n), h, m in zip(p.lines, high, size) if inside[c] and (whole or h or n < 0.5 * m)]


def main_text(html) -> tuple[str, int, int]:
    """(text, lines kept, lines seen)."""
    if not html:
        return "", 0, 0
    p = Lines()
    p.feed(html)
    p.done()
    if p.form_chars > sum(len(t.split()) for _, t, _, _ in p.lines):       # the page stands in a form
        q = Lines(in_form=True)
        q.feed(html)
        q.done()
        p = q if q.lines else p
    if not p.lines:
        return "", 0, 0
    kept = _kept(p)
    return "\n".join(kept), len(kept), len(p.lines)


def _extract(cols):
    got = [main_text(h) for h in cols["html"].to_pylist()]
    return {"text": [t for t, _, _ in got], "n_chars": [len(t) for t, _, _ in got],
            "lines_kept": [k for _, k, _ in got], "lines_seen": [n for _, _, n in got]}


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` with text, n_chars, lines_kept and lines_seen; no shuffle."""
    return add_columns(pages, _extract, "text string, n_chars long, lines_kept long, lines_seen long")


def op8_html_text(spark, sf_dir) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
