r"""Main text of web pages by wrappers inferred for each host.

A page becomes a tree of blocks with text slots; inline tags only join text.  Its union-free regular expression comes
from folding repeated siblings, single (``p+``) or in step (``(dt dd)+``), into one.  The expressions of a host are then
aligned one by one: equal parts merge, a part that only one side has becomes optional, a part repeated on either side
becomes a repetition, text becomes a slot.  Slots gather how often they were seen, whether their text ever differs, and
how much of it is links.

The finished wrapper says for each slot whether it is main text: inside the article (or ``main``, or a block named as
content), and not in a region that is a menu, header, footer, sidebar, notice, advert, form or reader comment by its tag,
role, class or id.  Pages without such a block keep what is in no such region, is not mostly links, and isn't the same
text on all pages of the host.  A page is aligned with its host's wrapper, which has every page's structure in it, and the
main slots are read off in page order.

Wrappers are folded in each task first, then by host in rounds of bounded fan-in, so a host with a third of all pages is
never in one task; a wrapper's size follows the variety of a host's structure, not its pages.  Finished wrappers are files by
host that the tasks read for their own pages: pages are neither shuffled nor joined.

Pages are read in linear time and without limits of length; blocks nested over MAX_DEPTH deep are read as text of the block
around them, in regions of their own, with the same result.  Sequences of siblings are aligned by the same rule at any length.

Edge cases: null or empty html gives empty text; a null url is the host ``""``; repeated rows are pages of their own; other
columns are ignored; an empty table gives an empty result.  White space is what Unicode calls so.
"""

from __future__ import annotations

import html as html_lib
import json
import re
import zlib

import pandas as pd
import pyarrow as pa
import pyarrow.dataset
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_type, map_rows, materialize, new_path, open_fs, read_table, slices

#: Hosts that a worker holds at once, wrappers folded together, hosts in a bucket of finished wrappers.
MAX_HOSTS, FAN, BUCKET_HOSTS = 5000, 64, 500
#: Bits of an alignment held at once; longer sequences are aligned in blocks, with the same result.
ROW_BITS = 1 << 31
#: A slot with one text is the site's if so many different pages have it.
MIN_PAGES = 3
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = {"script", "style", "textarea", "title", "xmp", "noembed"}
DROP_TAGS = set("nav footer aside form script style noscript template svg math iframe object embed button select option textarea input dialog head title menu canvas audio video map xmp noembed fieldset datalist".split())
CLOSES_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Names of regions that are never main text; those in STRICT also end an article inside them.
STRICT = set("comment comments commentlist commentarea disqus respond replies discussion related recommended recommendations sidebar teaser teasers".split())
DROP_WORDS = STRICT | set(
    "ad ads advert adverts advertisement advertisements advertising adsense adslot adbox banner promo promos promotion sponsor sponsored sponsors nav navbar navigation menu menubar sidenav "
    "topbar footer masthead breadcrumb breadcrumbs pagination pager cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay newsletter subscribe "
    "subscription signup login signin paywall share sharing sharebar social follow trending widget widgets toolbar skip searchbox searchform search hidden".split()
)
#: A name with one of these parts lays out a page that has such a region; only the whole name counts then.
LAYOUT = set("with has no without wrap wrapper layout container page content main body col row grid".split())
DROP_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar", "toolbar"}
CONTENT_NAMES = set("article article-body article-content article-text post-content post-body entry-content entry-body story-body story content-body main-content maincontent page-content article__body post__content content main".split())
#: Ids that name a region even on an article or on a part of one, where ids are mostly targets of links.
CLEAR_IDS = set("comment comments commentlist commentarea disqus respond sidebar navbar breadcrumb breadcrumbs pagination".split())
BOXES = {"div", "ul", "ol", "center"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+|(?=>)))?+)*+)>""")
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
#: Tags up to this length are matched at once, others read attribute by attribute; both find the same end.
TAG_CHARS = 2048
_PIECE = re.compile(r"""[\s/]*+(?:[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:(["'])|[^\s>]++)?+)?+)?+""")
#: Blocks nested deeper are read as text of the block around them, in regions of their own.
MAX_DEPTH = 400
_ATTR = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++))?+)?+""")
_NAMED = re.compile("class|id|role|hidden", re.I)
_NUMBER = re.compile(r"&#(?=[0-9]{12})0*+([0-9]*+);?")
_SIGNS = re.compile(r"[^\w.@-]")
_DIGITS = re.compile(r"\d+")
_RAW_END = {t: re.compile(rf"</{t}\b", re.I) for t in RAW}
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


SLOTS = ("#text", "#link")
#: Blocks that say nothing of what they hold: siblings are taken for repetitions only if they hold the same kinds of parts.
PLAIN = {"div", "section", "span", "center", "td"}


class Node:
    """A block of a page; slots, '#link' if most of it is links, hold the text and the length of its links."""

    __slots__ = ("label", "kids", "text", "links", "digest")

    def __init__(self, label: str):
        self.label, self.kids, self.text, self.links, self.digest = label, [], "", 0, 0


def unescape(text: str) -> str:
    """Character references decoded; decimal ones of any length, which Python's integers would refuse."""
    if "&#" in text:
        text = _NUMBER.sub(lambda m: "\ufffd" if len(m[1]) > 7 else f"&#{m[1] or 0};", text)
    return html_lib.unescape(text)


def region(tag: str, attrs: str, inside: bool = False) -> tuple[str, str]:
    """(label, class of region): '' plain, 'drop', 'strict', 'header', 'article', 'main', 'content'.

    Ids of headings and inline tags are targets of links and class nothing; nor do those of articles and, ``inside`` an
    article, of all but plain boxes, unless they are in CLEAR_IDS.
    """
    if not attrs:
        kind = "drop" if tag in DROP_TAGS else tag if tag in ("article", "main", "header") else ""
        return tag, kind
    found: dict[str, str] = {}
    for m in _ATTR.finditer(attrs):
        found.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    names, ids = found.get("class", "").split(), found.get("id", "").split()
    role = found.get("role", "").strip().lower()
    shown = " ".join(sorted(_SIGNS.sub("_", _DIGITS.sub("0", n)) for n in [*names, *ids])) + (f" @{role}" if role else "")
    label = f"{tag}.{shown}" if shown else tag
    kind = ""
    if tag in HEADINGS or tag in INLINE:
        ids = []
    elif tag == "article" or inside and (tag not in BOXES or "section" in names):
        ids = [n for n in ids if n.lower() in CLEAR_IDS]
    names = names + ids
    if tag in DROP_TAGS or role in DROP_ROLES or "hidden" in found:
        kind = "drop"
    elif tag in ("html", "body"):
        kind = ""
    elif tag in ("article", "main"):
        kind = "strict" if any(n.lower() in STRICT or n.lower() in DROP_WORDS for n in names) else tag
    else:
        for n in names:
            low = n.lower()
            parts = [p.lower() for p in _PARTS.findall(n)]
            ends = {low} if LAYOUT & set(parts) else {low, *(parts[:1] + parts[-1:])}
            if ends & STRICT:
                kind = "strict"
                break
            if ends & DROP_WORDS:
                kind = "drop"
        if not kind:
            if tag == "header" or any("header" in (n.lower(), (_PARTS.findall(n) or [""])[-1].lower()) for n in names):
                kind = "header"
            elif role == "main" or found.get("itemprop", "").lower() == "articlebody" or any(n.lower() in CONTENT_NAMES for n in names):
                kind = "content"
    return (f"{label}!{kind}" if kind and kind != tag else label), kind


def kind_of(label: str) -> str:
    """The class of region that a label carries."""
    label = label.partition("[")[0]
    if "!" in label:
        return label.rpartition("!")[2]
    tag = label.partition(".")[0]
    return "drop" if tag in DROP_TAGS else tag if tag in ("article", "main", "header") else ""


def tag_end(source: str, at: int, failed: set[int]) -> int:
    """The '>' that ends the tag whose name ends at ``at``, or -1: quotes count where a value begins.

    ``failed`` holds the places between attributes from which no end was found, so that no page is read more than a few times.
    """
    passed = []
    while at < len(source) and at not in failed:
        if source[at] == ">":
            return at
        passed.append(at)
        m = _PIECE.match(source, at)
        at = m.end()
        if m[1]:
            at = source.find(m[1], at) + 1
            if not at:
                break
    failed.update(passed)
    return -1


def below(regions: tuple[str, ...], tag: str, kind: str) -> tuple[str, ...]:
    """The regions, outermost first, that a block adds to those around it; they do what all blocks between would do."""
    last = regions[-1] if regions else ""
    if last == "strict" or kind == "strict":
        return ("strict",)
    if kind in ("article", "main"):
        return ("article",) if "article" in regions else (kind,)
    if last == "drop":
        return regions
    if kind == "drop" or kind == "header" and last != "header" and last not in HEADINGS or kind == "content" and not regions:
        return (*regions, kind)
    return (*regions, tag) if tag in HEADINGS and last in ("", "header") else regions


def parse(source: str) -> Node:
    root = Node("#page")
    # blocks beyond MAX_DEPTH are in tags and have their regions in under, but no node
    stack, tags, under = [root], ["#page"], []
    places: dict[str, list[int]] = {}
    failed: set[int] = set()
    text: list[str] = []
    link, links = 0, 0
    seen: dict[tuple[str, str, bool], tuple[str, str]] = {}
    articles: list[int] = []

    def flush():
        nonlocal links
        if text:
            whole = " ".join("".join(text).split())
            if whole:
                slot = Node("#link" if 2 * links > sum(map(len, text)) else "#text")
                slot.text, slot.links = whole, links
                around = stack[-1]
                for name in under[-1] if under else ():
                    around.kids.append(Node(f"div!{name}" if name in ("drop", "strict", "content") else name))
                    around = around.kids[-1]
                around.kids.append(slot)
            text.clear()
        links = 0

    def close(n: int):
        flush()
        while len(tags) > n:
            tag = tags.pop()
            places[tag].pop()
            if articles and articles[-1] == len(tags):
                articles.pop()
            if under:
                under.pop()
                continue
            node = stack.pop()
            if tag in PLAIN:
                node.label += "[" + " ".join(sorted({k.label.partition("[")[0] for k in node.kids})) + "]"

    def last(names) -> int:
        """Where the innermost open block of these tags is, else 0."""
        return max((places[t][-1] for t in names if places.get(t)), default=0)

    at, size, gt = 0, len(source), -1

    def say(start: int, end: int):
        nonlocal links
        if end > start:
            piece = source[start:end]
            if "&" in piece:
                piece = unescape(piece)
            text.append(piece)
            if link:
                links += len(piece)

    while at < size:
        lt = source.find("<", at)
        say(at, lt if lt >= 0 else size)
        if lt < 0:
            break
        if source.startswith(("<!--", "<![CDATA["), lt):
            close_with, skip = ("-->", 4) if source[lt + 3] == "-" else ("]]>", 9)
            end = source.find(close_with, lt + skip)
            if skip == 9:
                text.append(source[lt + 9 : end if end >= 0 else size])
            at = end + 3 if end >= 0 else size
            continue
        if gt < lt and gt < size:
            gt = source.find(">", lt)
            gt = size if gt < 0 else gt
        if source.startswith(("<!", "<?"), lt):
            at = gt + 1
            continue
        if gt == size and source.find("<", lt + 1) >= 0:
            text.append("<")  # no tag: none ends any more
            at = lt + 1
            continue
        m = None if failed else _TAG.match(source, lt, min(size, lt + TAG_CHARS))
        if m:
            closing, tag, attrs, at = m[1], m[2], m[3], m.end()
        else:
            m = _NAME.match(source, lt)
            if not m:
                text.append("<")  # no tag
                at = lt + 1
                continue
            end = tag_end(source, m.end(), failed) if gt < size else gt
            end = gt if end < 0 else end
            closing, tag, attrs, at = m[1], m[2], source[m.end() : end], end + 1
        tag, attrs = tag.lower(), attrs.strip().rstrip("/")
        if closing:
            if tag == "a":
                link = 0
            if places.get(tag):
                close(last((tag,)))
            elif tag not in INLINE:
                flush()
            continue
        if tag in RAW:
            stop = _RAW_END[tag].search(source, at)
            end = source.find(">", stop.end()) if stop else -1
            at = end + 1 if end >= 0 else size
            flush()
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in INLINE and not _NAMED.search(attrs):
            link = 1 if tag == "a" else link
            continue
        key = (tag, attrs, bool(articles))
        if key not in seen:
            seen[key] = region(*key)
        label, kind = seen[key]
        if tag in INLINE and kind not in ("drop", "strict"):
            link = 1 if tag == "a" else link
            continue
        if tag in VOID:
            if tag not in INLINE:
                flush()
            continue
        if tag in CLOSES_P and places.get("p"):
            close(last("p"))
        if tag in CLOSES:
            ends, bounds = CLOSES[tag]
            bound = last(bounds)
            while (i := last(ends)) > bound:
                close(i)
                if tag != "tr":
                    break
        flush()
        places.setdefault(tag, []).append(len(tags))
        if kind == "article":
            articles.append(len(tags))
        tags.append(tag)
        if len(stack) < MAX_DEPTH:
            node = Node(label)
            stack[-1].kids.append(node)
            stack.append(node)
        else:
            under.append(below(under[-1] if under else (), tag, kind))
    close(1)
    return root


# == wrappers ==
# A wrapper node is a list [label, optional, repeated, kids]; a slot ["#text" or "#link", optional, repeated, [pages, hash, chars, links]]
# with the smallest digests of the pages that have it, at most MIN_PAGES of them, and hash 0 once texts differ.


def runs(labels: list[str]) -> list[tuple[str, list[list[int]]]]:
    """The sequence with repeats folded: (label, [positions of each repetition]); a group's label is '(a b)'."""
    single: list[tuple[str, list[list[int]]]] = []
    for i, label in enumerate(labels):
        if single and single[-1][0] == label:
            single[-1][1].append([i])
        else:
            single.append((label, [[i]]))
    if len(single) < 4:
        return single
    out, i = [], 0
    while i < len(single):
        for period in (2, 3, 4):
            names = [s[0] for s in single[i : i + period]]
            n = 1
            while len(names) == period and [s[0] for s in single[i + n * period : i + (n + 1) * period]] == names:
                n += 1
            if n > 1:
                out.append(("(" + " ".join(names) + ")", [list(range(i + k * period, i + (k + 1) * period)) for k in range(n)]))
                i += n * period
                break
        else:
            out.append((single[i][0], single[i][1]))
            i += 1
    # groups refer to single runs; give their members back as node positions
    return [(label, reps if not label.startswith("(") else [[single[j][1] for j in rep] for rep in reps]) for label, reps in out]


def skeleton(node: Node, page: int | None = None) -> list:
    if page is None:
        page = digest(node, 0)
    if node.label in SLOTS:
        return [node.label, 0, 0, [[page], node.digest, len(node.text), node.links]]
    kids = [skeleton(k, page) for k in node.kids]
    out = []
    for label, reps in runs([k.label for k in node.kids]):
        if label.startswith("("):
            merged = None
            for rep in reps:
                group = [label, 0, 1, [_join([kids[p[0]] for p in ps]) for ps in rep]]
                merged = merge(merged, group) if merged else group
            out.append(merged)
        else:
            out.append(_join([kids[p[0]] for p in reps]))
    return [node.label, 0, 0, out]


def digest(node: Node, so_far: int) -> int:
    """Sets the digests of all slots; that of the whole page, from theirs."""
    if node.label in SLOTS:
        node.digest = zlib.crc32(node.text.encode()) or 1
        so_far = zlib.crc32(node.digest.to_bytes(4, "big"), so_far)
    for k in node.kids:
        so_far = digest(k, so_far)
    return so_far


def _join(nodes: list[list]) -> list:
    out = nodes[0]
    for n in nodes[1:]:
        out = merge(out, n)
    if len(nodes) > 1:
        out[2] = 1
    return out


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Positions (in a, in b) of a common supersequence, -1 where one side has none."""
    head = 0
    while head < len(a) and head < len(b) and a[head] == b[head]:
        head += 1
    out = [(i, i) for i in range(head)]
    x, y = a[head:], b[head:]
    n, m = len(x), len(y)
    if not n or not m:
        return out + [(head + i, -1) for i in range(n)] + [(-1, head + j) for j in range(m)]
    # The longest common subsequence by bits: in row j, bit n - 1 - i is 0 if x[i] adds to that of x[i:] and y[j:].  Rows are
    # made from the last backwards; of long sequences each KEPT-th is held and those between are made again when needed.
    full, bits = (1 << n) - 1, {}
    for i, label in enumerate(x):
        bits[label] = bits.get(label, 0) | 1 << (n - 1 - i)

    def rows(row: int, last: int, first: int, step: int = 1) -> dict[int, int]:
        """Rows first .. last - 1 and row last itself, every step-th, from row ``last``."""
        made = {last: row}
        for j in range(last - 1, first - 1, -1):
            match = row & bits.get(y[j], 0)
            row = (row + match | row & ~match) & full
            if (last - j) % step == 0 or j == first:
                made[j] = row
        return made

    step = 1 if n * m <= ROW_BITS else max(1, int(m**0.5))
    kept = rows(full, m, 0, step)
    at = sorted(kept)
    own, k = (kept, 0) if step == 1 else ({}, -1)
    i = j = 0
    while i < n or j < m:
        if i < n and j < m and x[i] == y[j]:
            out.append((head + i, head + j))
            i, j = i + 1, j + 1
            continue
        if j not in own:
            k = next(p for p in range(max(k, 0), len(at)) if at[p] >= j)
            lower = at[k - 1] if k else 0
            own = rows(kept[at[k]], at[k], lower)
        if j >= m or i < n and own[j] >> (n - 1 - i) & 1:
            out.append((head + i, -1))
            i += 1
        else:
            out.append((-1, head + j))
            j += 1
    return out


def merge(a: list, b: list) -> list:
    """The least union-free expression over both; a is changed."""
    a[1], a[2] = a[1] | b[1], a[2] | b[2]
    if a[0] in SLOTS:
        s, t = a[3], b[3]
        a[3] = [sorted({*s[0], *t[0]})[:MIN_PAGES], s[1] if s[1] == t[1] else 0, s[2] + t[2], s[3] + t[3]]
        return a
    x, y = a[3], b[3]
    kids = []
    for i, j in align([k[0] for k in x], [k[0] for k in y]):
        if j < 0:
            x[i][1] = 1
            kids.append(x[i])
        elif i < 0:
            y[j][1] = 1
            kids.append(y[j])
        else:
            kids.append(merge(x[i], y[j]))
    a[3] = kids
    return a


def expression(w: list) -> str:
    """The wrapper as a regular expression over tags, for people."""
    mark = {(0, 0): "", (1, 0): "?", (0, 1): "+", (1, 1): "*"}[w[1], w[2]]
    if w[0] in SLOTS:
        return "#" + mark
    inner = " ".join(expression(k) for k in w[3])
    return f"({inner}){mark}" if w[0].startswith("(") else f"<{w[0]}>({inner}){mark}" if inner else f"<{w[0]}>{mark}"


#: Levels of main blocks, best first.
LEVELS = ("article", "main", "content", "")


def finish(w: list) -> list:
    """Slots get the best level at which they are main text, or -1; blocks keep their kids."""
    varies = _varies(w)

    def walk(node: list, level: int, dropped: str, links: bool) -> list:
        label = node[0]
        if label in SLOTS:
            pages, h, chars, link = node[3]
            if dropped:
                keep = -1
            elif level < 3:
                keep = level
            else:
                keep = -1 if varies and h and len(pages) >= MIN_PAGES or 2 * link > chars else 3
            return [label, keep]
        kind = kind_of(label) if not label.startswith("(") else ""
        if kind == "strict":
            dropped = "strict"
        elif kind == "drop":
            dropped = dropped or "drop"
        elif kind in ("article", "main") and dropped != "strict":
            dropped = ""
        if kind == "header":
            dropped = dropped or "header"
        if dropped == "header" and level < 3 and label.partition("[")[0].partition("!")[0].partition(".")[0] in HEADINGS:
            dropped = ""
        if kind in LEVELS[:3] and not dropped:
            level = min(level, LEVELS.index(kind))
        return [label, [walk(k, level, dropped, links) for k in node[3]]]

    return walk(w, 3, "", False)


def _varies(w: list) -> bool:
    return not w[3][1] if w[0] in SLOTS else any(map(_varies, w[3]))


def extract(page: Node, wrapper: list) -> list[str]:
    """The main blocks of a page by its host's finished wrapper."""
    found: list[tuple[int, str]] = []

    def walk(node: Node, w: list):
        if node.label in SLOTS:
            if w[1] >= 0:
                found.append((w[1], node.text))
            return
        folded = runs([k.label for k in node.kids])
        places = [(i, j) for i, j in align([k[0] for k in w[1]], [label for label, _ in folded]) if j >= 0]
        for i, j in places:
            if i < 0:
                raise LookupError
            label, reps = folded[j]
            if label.startswith("("):
                for rep in reps:
                    for part, ps in zip(w[1][i][1], rep):
                        for p in ps:
                            walk(node.kids[p[0]], part)
            else:
                for p in reps:
                    walk(node.kids[p[0]], w[1][i])

    try:
        walk(page, wrapper)
    except LookupError:
        # where labels repeat, the alignment may pick another block than the one the page was merged into
        found.clear()
        walk(page, finish(skeleton(page)))
    best = min((level for level, _ in found), default=3)
    return [text for level, text in found if level == best]


def host_of(url) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def infer(pages: DataFrame) -> DataFrame:
    """From (host, html): one row a host with its finished wrapper as JSON, as a written table."""

    def partial(batches):
        held: dict[str, list] = {}

        def emit():
            return pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([json.dumps(w) for w in held.values()])], names=["host", "wrapper"])

        for b in slices(batches, 256):
            for host, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = skeleton(parse(source or ""))
                held[host] = merge(held[host], w) if host in held else w
            if len(held) > MAX_HOSTS:
                yield emit()
                held.clear()
        if held:
            yield emit()

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        # sorted, so that reruns align in the same order
        parts = sorted(pdf["wrapper"])
        w = json.loads(parts[0])
        for p in parts[1:]:
            w = merge(w, json.loads(p))
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "wrapper": [json.dumps(w)]})

    parts = materialize(pages.mapInArrow(partial, "host string, wrapper string"), "wrappers")
    # a host has at most as many wrappers as there are tasks; each round folds about FAN of them in a task
    most = parts.groupBy("host").count().agg(F.max("count")).first()[0] or 0
    while most > 1:
        salts = -(-most // FAN)
        parts = parts.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(salts))).groupBy("host", "salt").applyInPandas(fold, "host string, wrapper string")
        if salts == 1:
            break
        parts = materialize(parts, "wrappers")
        most = min(salts, parts.groupBy("host").count().agg(F.max("count")).first()[0])

    def done(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([json.dumps(finish(json.loads(w))) for w in b.column(1).to_pylist()])], names=["wrapper_host", "wrapper"])

    return materialize(map_rows(parts, done, "wrapper_host string, wrapper string"), "wrappers")


class Wrappers:
    """Finished wrappers, written by buckets of hosts; a task reads those of its own pages' hosts."""

    def __init__(self, wrappers: DataFrame):
        self.path = new_path(wrappers.sparkSession, "by-host")
        self.buckets = max(1, min(1 << 16, -(-wrappers.count() // BUCKET_HOSTS)))
        placed = wrappers.withColumn("b", F.pmod(F.crc32(F.encode("wrapper_host", "UTF-8")), F.lit(self.buckets)))
        placed.repartition("b").sortWithinPartitions("b", "wrapper_host").write.partitionBy("b").parquet(self.path)
        self.read: dict[str, list] = {}

    def load(self, hosts: list[str]) -> None:
        missing: dict[int, set[str]] = {}
        for h in hosts:
            if h not in self.read:
                missing.setdefault(zlib.crc32(h.encode()) % self.buckets, set()).add(h)
        if not missing:
            return
        if len(self.read) > MAX_HOSTS:
            self.read = {h: self.read[h] for h in hosts if h in self.read}
        fs, root = open_fs(self.path)
        for b, own in missing.items():
            found = pyarrow.dataset.dataset(f"{root}/b={b}", filesystem=fs, format="parquet").to_table(columns=["wrapper_host", "wrapper"], filter=pyarrow.dataset.field("wrapper_host").isin(sorted(own)))
            self.read.update((h, json.loads(w)) for h, w in zip(found["wrapper_host"].to_pylist(), found["wrapper"].to_pylist()))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, blocks): the main blocks of each page as array<string>."""
    pages = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html")).withColumn("host", host_of(F.col("url")))
    wrappers = Wrappers(infer(pages.select("host", "html")))

    def make(b: pa.RecordBatch) -> pa.RecordBatch:
        hosts = b.column(3).to_pylist()
        wrappers.load(hosts)
        out = [extract(parse(source or ""), wrappers.read[host]) for source, host in zip(b.column(2).to_pylist(), hosts)]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.string()))], names=["page_id", "url", "blocks"])

    return map_rows(pages, make, f"page_id {id_type(pages, 'page_id')}, url {id_type(pages, 'url')}, blocks array<string>", 256)


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = main_text(read_table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", F.array_join("blocks", " ").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
