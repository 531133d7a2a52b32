"""Main texts of web pages by site template removal.

Element subtrees of whole pages are hashed by tag and text and counted per host; those that recur across many
of a host's different articles are its template and go, whatever they are called and wherever they stand. What
is left of a page, as sites have few pages or change their adverts, goes by what HTML itself names as no
article (navigation, footers, asides, forms, scripts, elements classed as adverts, notices, comments and the
like); the article or main element bounds the text, where there is one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, tidy, written
from .html_tree import BLOCK, HEADINGS, Page
from .url_filter import url_parts

#: A subtree is template if so many different articles of its host have it ...
LEAST_PAGES = 3
#: ... and this share of them, where it stands beside the article: sites have several menus and footers by turns.
BESIDE_SHARE = 0.01
#: In the article, or where HTML does not say what the article is, lists, tables and the like need this share ...
SHARE = 0.2
#: ... and running text and what holds it this one, as sites repeat passages, too ...
TEXT_SHARE = 0.5
#: ... and so many articles, where HTML says what the article is.
TEXT_PAGES = 100
#: What a subtree's last two bits say.
BESIDE, IN_ARTICLE, TEXT, NAMED_TEXT = range(4)

_NEVER = frozenset("head script style noscript template title textarea select option button input iframe object embed svg canvas audio video map nav aside footer form menu dialog".split())
_TEXT = HEADINGS | frozenset("p pre blockquote li dt dd td th figcaption".split())
_RUNNING = _TEXT - {"li", "td", "th"}
#: Words that name what is no article, in a class, id or role all of whose words are of this list or the next.
_FOREIGN = frozenset(
    "ad ads advert adverts advertisement adsense adslot adbox sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments commentlist disqus replies responses share sharing social related recommended recommendations "
    "widget toolbar skip login signup signin search searchbox pagination pager copyright complementary contentinfo paywall alert".split()
)
#: Words that only say what sort of a thing it is: an ad-slot is an advert, related-work may be a chapter.
_PLAIN = frozenset(
    "area articles bar block body bottom box button buttons container content div entry footer form group header holder inner inline item items js l large left link links list main middle mobile "
    "more navigation outer page pages panel post posts r rail reader readers user users region right row section side site slot small sticky stories story tool tools top unit wrap wrapper zone".split()
)
#: What a task remembers having passed on; beyond it rows come again, which the count of distinct pages bears.
REMEMBERED = 200_000
_MAIN_NAMES = frozenset("content main article story entry articlebody post".split())
#: Articles within these are not the page's own.
_AROUND = frozenset("comments comment related sidebar".split())
_HEADER = frozenset({"header"})


def _is_foreign(names: tuple[frozenset[str], ...]) -> bool:
    return any(words & _FOREIGN and words - {w for w in words if w.isdigit()} <= _FOREIGN | _PLAIN for words in names)


def _has(names: tuple[frozenset[str], ...], wanted: frozenset[str]) -> bool:
    return any(words & wanted for words in names)


def _roots(page: Page) -> tuple[list[bool], bool]:
    """Which elements hold the article, and whether HTML says so."""
    tags, names, parents = page.tags, page.names, page.parents
    n = len(tags)
    foreign = [False] * n
    for i in range(n):
        p = parents[i]
        foreign[i] = (p >= 0 and foreign[p]) or tags[i] in _NEVER or (tags[i] not in ("html", "body", "main") and _is_foreign(names[i]))
    for wanted in ("article", "main"):
        found = [tags[i] == wanted and not (wanted == "article" and _is_foreign(names[i])) and not _below_never(page, i) for i in range(n)]
        if any(found):
            return found, True
    found = [tags[i] in ("div", "section", "td") and _has(names[i], _MAIN_NAMES) and not foreign[i] for i in range(n)]
    if any(found):
        return found, True
    body = [tags[i] == "body" for i in range(n)]
    return (body, False) if any(body) else ([parents[i] < 0 and not foreign[i] for i in range(n)], False)


def _below_never(page: Page, i: int) -> bool:
    """Inside an element that is no article by its tag, or in comments."""
    p = page.parents[i]
    while p >= 0:
        if page.tags[p] in ("nav", "aside", "footer", "form", "head", "template", "noscript") or _is_foreign(page.names[p]) and _has(page.names[p], _AROUND):
            return True
        p = page.parents[p]
    return False


class Outline:
    """A page's article, and which of its elements HTML itself rules out."""

    __slots__ = ("page", "inside", "named", "dropped", "leads", "identity")

    def __init__(self, page: Page):
        self.page = page
        roots, self.named = _roots(page)
        n = len(page.tags)
        heading = [t in HEADINGS for t in page.tags]
        holds = list(roots)
        for i in range(n - 1, -1, -1):
            p = page.parents[i]
            if p >= 0:
                heading[p] |= heading[i]
                holds[p] |= holds[i]
        #: roots of the article and what holds them
        self.leads = holds
        self.inside, self.dropped = [False] * n, [False] * n
        for i, tag in enumerate(page.tags):
            p = page.parents[i]
            self.inside[i] = roots[i] or (p >= 0 and self.inside[p])
            if roots[i] or tag in ("html", "body"):
                continue
            head = tag == "header" or (_has(page.names[i], _HEADER) and not _has(page.names[i], _MAIN_NAMES))
            # an article's own header keeps its heading; around the article, only what leads to it stays
            self.dropped[i] = tag in _NEVER or (not holds[i] and _is_foreign(page.names[i])) or (head and not holds[i] and not (self.inside[i] and self.named and heading[i]))

    def subtrees(self) -> Iterator[tuple[int, int, int]]:
        """(element, hash, kind) of every block element with text but those that hold the article's root.

        kind: BESIDE the article, IN_ARTICLE without running text, with such TEXT, with it in an article that HTML names.
        At the end identity is what tells the article from others: its running text if a named article has a
        heading or most of the text is running, else all of its text. Neither adverts and menus beside the
        running text nor <time> make another article.
        """
        page, inside, dropped, tags = self.page, self.inside, self.dropped, self.page.tags
        running_kind = NAMED_TEXT if self.named else TEXT
        parts: list[list[str]] = []
        texts: list[bool] = []  # per open element: does it hold running text
        opened: list[tuple[bool, bool]] = []  # is it in the article, and in running text
        running: list[str] = []
        whole: list[str] = []
        heading, skip = False, -1
        for e in page.events:
            if isinstance(e, str):
                if parts and (x := " ".join(e.split())):
                    parts[-1].append(x)
                    if skip < 0 and opened[-1][0]:
                        whole.append(x)
                        if opened[-1][1]:
                            running.append(x)
            elif e >= 0:
                if skip < 0 and dropped[e]:
                    skip = e
                tag = tags[e]
                mine = inside[e] and skip < 0
                parts.append([tag])
                texts.append(False)
                opened.append((mine, tag != "time" and mine and (tag in _RUNNING or (bool(opened) and opened[-1][1]))))
                heading |= mine and tag in HEADINGS
            else:
                i, held, own, in_text = ~e, parts.pop(), texts.pop(), opened.pop()
                if len(held) > 1:
                    tag = tags[i]
                    if tag in BLOCK:
                        h = (xxhash.xxh64_intdigest("\x00".join(held).encode("utf-8", "surrogatepass")) >> 3) << 2  # room for the kind
                    if parts:
                        parts[-1] += [f"\x01{h}"] if tag in BLOCK else held
                    if tag in BLOCK and not self.leads[i]:
                        yield i, h, running_kind if own or in_text[1] or (inside[i] and tag in _TEXT) else IN_ARTICLE if inside[i] else BESIDE
                if texts:
                    texts[-1] |= own or in_text[1]
                if skip == i:
                    skip = -1
        words = " ".join(running)
        everything = " ".join(whole)
        self.identity = words if words and ((self.named and heading) or 2 * len(words) >= len(everything)) else everything

    def template_of(self, known: frozenset[int]) -> list[int]:
        """The elements whose subtrees are known as template."""
        return [i for i, h, kind in self.subtrees() if h + kind in known]

    def text(self, template: frozenset[int] | None = None) -> str:
        gone = self.dropped
        if template:
            gone = list(gone)
            for i in self.template_of(template):
                gone[i] = True
        page, inside, tags = self.page, self.inside, self.page.tags
        skip, depth = -1, 0
        blocks: list[str] = []
        held: list[str] = []

        def flush() -> None:
            if held:
                if x := " ".join("".join(held).split()):
                    blocks.append(x)
                held.clear()

        for e in page.events:
            if isinstance(e, str):
                if skip < 0 and depth:
                    held.append(e)
                continue
            i = e if e >= 0 else ~e
            if skip >= 0:
                if e < 0 and i == skip:
                    skip = -1
            elif e >= 0 and gone[i]:
                skip = i
                if tags[i] in BLOCK:
                    flush()
            else:
                if tags[i] in BLOCK:
                    flush()
                elif tags[i] == "br" and held:
                    held.append(" ")
                if inside[i]:
                    depth += 1 if e >= 0 else -1
        flush()
        return "\n".join(blocks)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per page its article's digest (h 0) and those of its subtrees; a task passes each on once a host and article."""
    seen: set[tuple[str, int, int]] = set()
    for batch in batches:
        out: list[tuple[str, int, int]] = []
        for host, source in zip(batch.column(0).to_pylist(), batch.column(1)):
            source = source.as_py()
            if not source:
                continue
            outline = Outline(Page(source))
            found = {h + kind for _, h, kind in outline.subtrees()}
            own = xxhash.xxh64_intdigest(outline.identity.encode("utf-8", "surrogatepass")) >> 1
            out += [(host, h, own) for h in (0, *found) if (host, h, own) not in seen]
            if len(seen) < REMEMBERED:
                seen.update((host, h, own) for h in found)
        yield pa.record_batch({"host": pa.array([x[0] for x in out], pa.string()), "h": pa.array([x[1] for x in out], pa.int64()), "page": pa.array([x[2] for x in out], pa.int64())})


def site_templates(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, h): the subtrees that recur across a host's different articles.

    Pages with the same article count once, whatever stands around or between its running text; of an
    article that is mostly bare text, lists or tables all text must be equal. Pages without url are those of the empty host.
    """
    seen = pages.select(url_parts(F.col(url_col))[0].alias("host"), F.col(html_col)).mapInArrow(tidy(_hashes), "host string, h long, page long")
    counts = written(seen.groupBy("host", "h").agg(F.count_distinct("page").alias("n")).where((F.col("h") == 0) | (F.col("n") >= LEAST_PAGES)), "subtree-counts")
    total = counts.where("h = 0").select("host", F.col("n").alias("total"))
    kind = F.col("h").bitwiseAND(3)
    share = F.when(kind == BESIDE, BESIDE_SHARE).when(kind == IN_ARTICLE, SHARE).otherwise(TEXT_SHARE)
    often = counts.where((F.col("h") != 0) & (F.col("n") >= F.when(kind == NAMED_TEXT, TEXT_PAGES).otherwise(LEAST_PAGES))).join(total, "host")
    return often.where(F.col("n") >= share * F.col("total")).select("host", "h").distinct()


def _texts(known: dict[str, frozenset[int]] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            templates = batch.column("template").to_pylist() if known is None else [known.get(h) for h in batch.column("host").to_pylist()]
            for source, template in zip(batch.column("html"), templates):
                out.append(Outline(Page(source.as_py() or "")).text(frozenset(template) if template else None))
            yield pa.record_batch({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(out, pa.string())})

    return run


def extract_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text of every row: its article's blocks in page order, one a line.

    Character references are decoded, white space within a block is one space, nothing is cut. A null or
    empty html, or a page without article text, has the empty text. Repeated rows come repeated, null ids
    and urls stay null; extra columns are left out; an empty table gives no rows. Templates go to the
    tasks while there are at most BROADCAST_ROWS; beyond it pages are joined to their host's, which Spark
    splits where one host has very many pages.
    """
    p = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    templates = written(site_templates(p), "site-templates")
    d = p.withColumn("host", url_parts(F.col("url"))[0])
    types = dict(p.dtypes)
    schema = f"page_id {types['page_id']}, url string, text string"
    if templates.count() <= BROADCAST_ROWS:
        known: dict[str, set[int]] = {}
        for host, h in templates.toLocalIterator():
            known.setdefault(host, set()).add(h)
        return d.mapInArrow(tidy(_texts({k: frozenset(v) for k, v in known.items()})), schema)
    per_host = templates.groupBy("host").agg(F.collect_set("h").alias("template"))
    return d.join(per_host.hint("merge"), "host", "left").select("page_id", "url", "html", "host", "template").mapInArrow(tidy(_texts(None)), schema)
