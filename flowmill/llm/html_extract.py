"""HTML extraction by tag-path ratios."""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

# HTML vocabulary.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre
search section summary table tbody td tfoot th thead tr ul""".split())
# Elements whose text is never the article's.
DROPPED = frozenset("""head nav footer aside script style noscript template iframe object embed svg canvas audio
video select textarea input menu dialog title noembed noframes xmp datalist map""".split())
# Elements that may wrap a whole page or stand in the midst of a sentence: the first count like marked
# elements, the second are dropped where they stand by themselves.
FORMS = frozenset(["form", "fieldset"])
CONTROLS = frozenset(["label", "button"])
PROSE = frozenset("p li dd dt td th blockquote figcaption h1 h2 h3 h4 h5 h6 span em strong b i a code kbd label".split())
# Values of class, id and role that mark what surrounds an article: whole ones, or joined by hyphens to words of
# PLACES only (comments-area, ad-container; not has-sidebar, no-comments, related-work).
MARKED = frozenset("""ad ads adv advert adverts advertisement advertising banner banners sponsor sponsored promo promos
promotion nav navbar navigation navi menu menus breadcrumb breadcrumbs header masthead topbar footer foot bottombar
sidebar sidebars side aside rail widget widgets comment comments commentlist reply replies respond discussion disqus
cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup
login share sharing social related recommended recommendations trending toc pagination pager search copyright
complementary contentinfo toolbar skip""".split())
REPLIES = frozenset("comment comments commentlist reply replies respond disqus".split())
# The marks that count on a paragraph, whose class may say how it looks or what it is about.
ADVERTS = frozenset("""ad ads adv advert adverts advertisement advertising sponsor sponsored promo promos promotion""".split())
PLACES = frozenset("""area list body section post posts entry article site page main container wrapper wrap box block inner outer item
items content bar top bottom left right primary secondary global sticky fixed floating group holder region panel pane zone
slot unit row col column title form links link buttons button story stories thread count inline leaderboard mobile desktop
small large mini in up new latest more""".split())
# Marked by themselves, but parts of too many names of ordinary sections; and those that only a whole site has.
ALONE = frozenset("discussion side rail search head foot header footer masthead recommended recommendations copyright".split())
SITES = frozenset(["site", "page", "global"])
# A marked element with a larger share of the page's text is no surrounding of it.
MOST_MARKED = 0.5
# An open element of the first kind ends when one of the second begins.
CLOSED_BY = {"p": BLOCK, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
             "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
             "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "option": frozenset(["option", "optgroup"])}
# Containers of articles; headings; and elements that only group blocks of what they stand in.
CONTAINERS = ("article", "main")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
GROUPS = frozenset("ul ol dl li table thead tbody tfoot tr section header hgroup blockquote figure details".split())
SCOPE = frozenset(["table", "td", "th", "ul", "ol", "dl", "article", "main", "section", "body", "html", "div"])
PUNCTUATION = re.compile(r"[.,;:!?…、。，！？]")
TAG = re.compile(r"/?[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
HIDDEN = re.compile(r"""\bhidden(?=[\s>=/]|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
WORD = re.compile(r"[a-z]+")


def _tag_end(page: str, at: int, last: dict[str, int]) -> int:
    """Index of the '>' that ends the tag at `at`, quoted values skipped; -1 without one. `last` holds
    the last index of each quote, so no search runs to the end of the page in vain."""
    while True:
        close = page.find(">", at)
        if close < 0:
            return -1
        inner = page[at:close]
        if not inner or inner.count('"') % 2 == 0 and "'" not in inner:
            return close
        first = min((i for q in "\"'" if last[q] >= at and 0 <= (i := page.find(q, at, close)) < close), default=-1)
        if first < 0:
            return close
        quote = page[first]
        if page[at:first].rstrip()[-1:] != "=" or first >= last[quote]:
            at = first + 1
            continue
        at = page.find(quote, first + 1) + 1


def _marked_by(value: str, words: frozenset) -> str | None:
    """The word of `words` by which a value marks an element, if it does."""
    if value in words:
        return value
    parts = re.split("[-_]+", value.strip("-_"))
    if len(parts) < 2:
        return None
    hits = [p for p in parts if p in words and (p not in ALONE or not SITES.isdisjoint(parts))]
    return hits[0] if hits and all(p in words or p in PLACES for p in parts) else None


def _mark(tag: str, found: list[tuple[str, str]], inside: bool) -> str | None:
    """The first word that marks an element as something around the article, if any. Ids of sections, unless they
    name replies, and whatever headings have name their subject inside an article."""
    if tag in ("html", "body", "main") or inside and tag in HEADINGS:
        return None
    words = REPLIES if tag == "article" else ADVERTS if inside and tag == "p" else MARKED
    for name, values in found:
        known = words & REPLIES if inside and tag == "section" and name.lower() == "id" else words
        for value in values.strip("\"'").lower().split():
            if word := _marked_by(value, known):
                return word
    return None


def blocks(page: str) -> Iterator[tuple[tuple[str, ...], str, int, tuple[tuple[int, str, bool], ...]]]:
    """(tag path, raw text, characters in links, marks) of every block of text that is not dropped, in
    page order; marks are the (position, value, inside a container) of the marked elements around it."""
    stack: list[tuple[str, str, tuple | None, bool]] = []  # tag, label in the path, marks (None: dropped), in a link
    text: list[str] = []
    links: list[str] = []
    last = {q: page.rfind(q) for q in "\"'"}
    lowered = None
    at, size = 0, len(page)

    def flush():
        joined, linked = "".join(text), sum(len(" ".join(html.unescape(t).split())) for t in links)
        text.clear()
        links.clear()
        path = tuple(label for tag, label, _, _ in stack if tag in BLOCK)
        marked = stack[-1][2] if stack else ()
        return (path, joined, linked, marked) if joined and not joined.isspace() and marked is not None else None

    while at < size:
        opening = page.find("<", at)
        if opening < 0:
            text.append(page[at:])
            break
        text.append(page[at:opening])
        if stack and stack[-1][3]:
            links.append(text[-1])
        if page.startswith("<!--", opening):
            end = page.find("-->", opening + 4)
            at = size if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), opening):
            end = page.find(">", opening)
            at = size if end < 0 else end + 1
            continue
        name = TAG.match(page, opening + 1)
        if not name:
            text.append("<")
            at = opening + 1
            continue
        end = _tag_end(page, name.end(), last)
        if end < 0:  # the page breaks off inside a tag
            break
        at, tag = end + 1, name.group().lower()
        if tag[0] == "/":
            tag = tag[1:]
            if tag in BLOCK and (found := flush()):
                yield found
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    around = stack[i - 1][2] if i else ()
                    if any(t in BLOCK or d != around for t, _, d, _ in stack[i:]) and (found := flush()):
                        yield found
                    del stack[i:]
                    break
                if stack[i][0] in SCOPE and tag not in SCOPE:
                    break
            continue
        if tag == "br":
            text.append("\n")
            continue
        attributes = page[name.end():end]
        if tag in BLOCK:
            if found := flush():
                yield found
            for i in range(len(stack) - 1, -1, -1):
                if tag in CLOSED_BY.get(stack[i][0], ()):
                    del stack[i:]
                    break
                if stack[i][0] in SCOPE:
                    break
        given = ATTRIBUTE.findall(attributes) if attributes else []
        marks = " ".join(v for _, v in given).lower()
        inside = any(t in CONTAINERS for t, *_ in stack)
        around = own = stack[-1][2] if stack else ()
        if tag in DROPPED or tag == "header" and not inside or attributes and tag not in ("html", "body", "main") and HIDDEN.search(
                attributes):
            own = None
        elif tag in CONTROLS and not (stack and stack[-1][0] in PROSE):
            own = None
        elif own is not None and (mark := given and _mark(tag, given, inside) or tag in FORMS and "form"):
            own = (*own, (opening, mark, inside))
        if tag in RAW:
            if lowered is None:
                lowered = page.lower() if page.isascii() else re.sub("[A-Z]", lambda m: m.group().lower(), page)
            end = lowered.find("</" + tag, at)
            at = size if end < 0 else end
            if end >= 0:
                end = page.find(">", end)
                at = size if end < 0 else end + 1
            continue
        if tag in VOID or attributes.endswith("/") and tag not in BLOCK:
            continue
        if own != around and tag not in BLOCK and (found := flush()):
            yield found  # an inline advert inside a block ends the run of text before it
        stack.append((tag, f"{tag}.{'.'.join(sorted(set(WORD.findall(marks))))}" if marks else tag, own if around is not None else None,
                      bool(stack) and stack[-1][3] or tag == "a" and "href" in attributes.lower()))
    if found := flush():
        yield found


def content(page: str, threshold: float = 0.3, window: int = 2) -> list[str]:
    """The article's blocks: those on tag paths whose fused, smoothed ratios pass the threshold.

    Marked elements (MARKED) and forms are left out first, unless nothing else is left, or one holds over MOST_MARKED
    of the page's text, is not marked as replies or advert, and does not stand outside of an unmarked container.

    For every root-to-leaf path, text ratio = characters outside links per block and punctuation ratio =
    marks per block (plus one, so headings count). Both are smoothed along the page: a block takes the
    mean of its path's value and of its neighbours' within the same container, up to `window` blocks
    away. The fused score is the product of their logarithms; paths are kept whose mean score reaches
    `threshold` times the page's text-weighted mean. If the strongest path lies in a container (article,
    main), only paths in containers are content. What stands beside a kept path is content too, so short
    headings and items stay with their paragraphs: text of the same parent, lists, tables and sections
    looked through, unless over half of a block's characters are links and it is no heading.
    """
    read, held = [], Counter()
    for path, raw, linked, marked in blocks(page):
        if text := " ".join(html.unescape(raw).split()):
            read.append((path, text, min(linked, len(text)), marked))
            for mark in marked:
                held[mark] += len(text)
    if not read:
        return []
    most = MOST_MARKED * sum(len(r[1]) for r in read)
    plain = any(not marked and any(label.split(".")[0] in CONTAINERS for label in path) for path, _, _, marked in read)
    dropped = {m for m, size in held.items()
               if size <= most or m[1] in REPLIES or m[1] in ADVERTS or plain and not m[2]}
    found = [r[:3] for r in read if dropped.isdisjoint(r[3])] or [r[:3] for r in read]
    paths: dict[tuple[str, ...], list[float]] = {}
    for path, text, linked in found:
        entry = paths.setdefault(path, [0.0, 0.0, 0.0])
        entry[0] += 1
        entry[1] += len(text) - linked
        entry[2] += len(PUNCTUATION.findall(text)) + 1
    own = [(paths[p][1] / paths[p][0], paths[p][2] / paths[p][0]) for p, _, _ in found]
    total: dict[tuple[str, ...], list[float]] = {}
    for i, (path, text, linked) in enumerate(found):
        near = [own[j] for j in range(max(0, i - window), min(len(found), i + window + 1))
                if found[j][0][:-1] == path[:-1]]
        length, marks = (sum(v[k] for v in near) / len(near) for k in (0, 1))
        score = math.log1p(length) * math.log1p(marks)
        entry = total.setdefault(path, [0.0, 0.0, 0.0])
        entry[0] += score
        entry[1] += 1
        entry[2] += len(text) - linked
    scores = {p: s / n for p, (s, n, _) in total.items()}
    mean = sum(scores[p] * size for p, (_, _, size) in total.items()) / max(1, sum(v[2] for v in total.values()))
    kept = {p for p, s in scores.items() if s >= threshold * mean}
    best = max(kept, key=lambda p: (total[p][2] * scores[p], p))
    tags = {p: [label.split(".")[0] for label in p] for p in paths}
    contained = {p for p in paths if any(t in CONTAINERS for t in tags[p])}
    if best in contained:
        kept &= contained
    parents = {p[:-1] for p in kept}

    def beside(path: tuple[str, ...]) -> bool:
        up = len(path) - 1
        while up > 0 and path[:up] not in parents and tags[path][up - 1] in GROUPS:
            up -= 1
        return path in parents or path[:up] in parents

    near_kept = {p for p in (contained if best in contained else paths) if beside(p)}
    return [t for p, t, linked in found if p in kept or p in near_kept and (
        linked <= len(t) / 2 or not HEADINGS.isdisjoint(tags[p][-1:]))]


def extract(pages: DataFrame, threshold: float = 0.3) -> DataFrame:
    """page_id, url and the article's text of every page, blocks joined by an empty line.

    One pass without a shuffle; a page is parsed in time linear in its length. Null or empty html,
    and pages without an article, give an empty text; null page_id and url are passed on; repeated rows
    give repeated rows; other columns are not read. Of paths that tie for the strongest, the last in order of
    names decides; an empty table gives an empty table.
    """
    kinds = {f.name: f for f in pages.schema.fields}
    schema = T.StructType([kinds["page_id"], kinds["url"], T.StructField("text", T.StringType())])

    def run(batches):
        for batch in batches:
            texts = ["\n\n".join(content(p, threshold)) if p else "" for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())],
                names=["page_id", "url", "text"])

    return pages.select("page_id", "url", "html").mapInArrow(run, schema)
