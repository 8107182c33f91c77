"""Main text of web pages, with the templates of their sites removed.

Every page is read into elements. Elements that hold blocks are hashed with all they contain, bottom up, and the
hashes are counted per host in Spark: one that recurs across many different pages of the host belongs to its template
and is deleted from all of them. Elements that are no article by their kind (menus, forms, scripts) or by the names
sites give them (adverts, notices, comments) go as well, however much of the page they make; a name counts if all its
words say so, and never on headings. A form, or an element named as a frame (popup, widget), stays if it holds an article
or if there is no prose outside such. What stays of the page's main part is its text: one line per block, white space
within a block as one space, character references decoded. A page is read in time proportional to its length.

Paragraphs and headings of the main part are never deleted for recurring, nor is an element that holds the article:
articles quote each other. Any other element goes that stands on ``MANY_PAGES`` pages of the host, however many the host
has and whatever its share of the page. Pages of equal content count once, so copies of a page don't make its text a
template. Only elements within the main part are counted, as no others are read.

Nulls and empties: null or empty html gives the empty text; a null url is a host of its own. Rows are extracted one by
one, so repeated page_ids stay repeated.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import arrow, bloom_filter, dropped, perhaps_in, sifted, written

MANY_PAGES = 5  # of a host, with different content

# Elements of HTML by what they mean for reading.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("iframe noembed noframes noscript script style template textarea title xmp".split())
NO_ARTICLE = set("aside button canvas datalist dialog footer form head header iframe menu nav noscript object script select style svg template title video audio".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
HOLDER = set("aside details div dl fieldset figure footer form header menu nav ol section table ul".split())
HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
NEVER_BY_NAME = HEADING | {"html", "body", "main"}
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "body": {"head"},
}
# Words in the names of elements that are not part of an article.
NO_ARTICLE_NAMES = set("""
    ad ads adsense advert advertisement advertising adverts alert banner breadcrumb breadcrumbs comment comments consent
    cookie cookies copyright disclaimer disqus footer gdpr header masthead menu modal nav navbar navigation newsletter
    notice notices outbrain overlay pager pagination paywall popup promo promotion recommended related respond share
    sharing sidebar signup social sponsor sponsored subscribe subscription taboola toolbar widget
""".split())
# Words that say where or of what form such an element is: with one of the above they make a name, others make another thing.
FORM_NAMES = set("""
    area bar block bottom box button buttons center container fixed float global group holder icon icons inner item items left
    link links list main outer panel posts primary right row secondary section site slot sticky top unit wrap wrapper
""".split())
OTHERS_NAMES = set("comment comments disqus recommended related respond".split())  # these hold articles of others
FRAME_NAMES = set("banner header masthead modal overlay paywall popup widget".split())  # these may be put around an article
LISTS = ("ul", "ol", "dl", "table", "select")  # an item closes no item outside its list

_TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:"[^"]*"|'[^']*')|[^>])*+)>""", re.S
)
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")


@lru_cache(1 << 16)
def _names_no_article(name: str) -> bool:
    words = set(_WORD.findall(name))
    return not words.isdisjoint(NO_ARTICLE_NAMES) and words <= NO_ARTICLE_NAMES | FORM_NAMES


@lru_cache(1 << 16)
def _names_frame(name: str) -> bool:
    return set(_WORD.findall(name)) <= FRAME_NAMES | FORM_NAMES


_HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", re.I)


class Page:
    """The elements of a page in order. An item is a text, or the number of an element that begins there.

    ``tag``, ``names``, ``named`` (its names or its being a form tell that it is no article), ``begin`` and ``end`` (the items
    of the element and after it), ``parent``, ``digest``, ``size`` (characters) and ``own`` (it has text that is no heading
    and in no element that is no article by its kind or names) by element; ``prose`` is the ``own`` of the page.
    """

    def __init__(self, html: str):
        self.items: list[str | int] = []
        self.tag: list[str] = []
        self.names: list[str] = []
        self.named: list[bool] = []
        self.begin: list[int] = []
        self.end: list[int] = []
        self.parent: list[int] = []
        self.digest: list[int] = []
        self.size: list[int] = []
        self._open: list[int] = []
        self._depths: dict[str, list[int]] = {}  # of the open elements of a tag
        self._inside: list[list[str]] = [[]]
        self.own: list[bool] = []
        self._sizes: list[int] = [0]
        self._owns: list[bool] = [False]
        self._headings = 0  # that are open
        at, n, last = 0, len(html), html.rfind(">")
        while at < n:
            token = _TOKEN.search(html, at) if at <= last or html.find("<!", at) >= 0 or html.find("<?", at) >= 0 else None
            if token is None:
                self._text(html[at:])
                break
            if token.start() > at:
                self._text(html[at : token.start()])
            at = token.end()
            if token[2] is None:
                continue
            tag = token[2].lower()
            if token[1]:
                if self._depths.get(tag):
                    while self._close() != tag:
                        pass
                continue
            self._make_room(tag)
            self._begin(tag, token[3])
            if tag in RAW:
                over = re.compile(rf"</{re.escape(tag)}[^>]*(?:>|\Z)", re.I).search(html, at)
                at = over.end() if over else n
                self._close()
            elif tag in VOID:
                self._close()
        while self._open:
            self._close()
        self.prose = self._owns[0]

    def _text(self, raw: str) -> None:
        text = unescape(raw) if "&" in raw else raw
        self.items.append(text)
        plain = " ".join(text.split())
        if plain:
            self._inside[-1].append(plain)
            self._sizes[-1] += len(plain)
            self._owns[-1] = self._owns[-1] or not self._headings

    def _make_room(self, tag: str) -> None:
        """Close what can't hold the new element: a paragraph before a block, an item before the next."""
        if tag in CLOSED_BY:
            depth = self._deepest(CLOSED_BY[tag])
            if depth > self._deepest(LISTS):
                self._close_to(depth)
        if tag in BLOCK:
            depth = self._deepest(("p",))
            if depth > self._deepest(HOLDER):
                self._close_to(depth)

    def _deepest(self, tags) -> int:
        """The depth of the last open element of one of ``tags``, or -1."""
        return max((self._depths[t][-1] for t in tags if self._depths.get(t)), default=-1)

    def _close_to(self, depth: int) -> None:
        while len(self._open) > depth:
            self._close()

    def _begin(self, tag: str, attributes: str) -> None:
        number = len(self.tag)
        self.items.append(number)
        names = " ".join(a or b or c for a, b, c in _NAMES.findall(attributes)).lower() if "=" in attributes else ""
        named = tag == "form" or (bool(names) and tag not in NEVER_BY_NAME and any(map(_names_no_article, names.split())))
        self.tag.append(tag), self.names.append(names), self.named.append(named), self.begin.append(len(self.items) - 1), self.end.append(0)
        self.digest.append(0), self.size.append(0), self.own.append(False)
        self.parent.append(self._open[-1] if self._open else -1)
        self._depths.setdefault(tag, []).append(len(self._open))
        self._open.append(number)
        self._headings += tag in HEADING
        self._inside.append([])
        self._sizes.append(0)
        self._owns.append(False)

    def _close(self) -> str:
        number = self._open.pop()
        self._depths[self.tag[number]].pop()
        self._headings -= self.tag[number] in HEADING
        inside, size, own = self._inside.pop(), self._sizes.pop(), self._owns.pop()
        self.end[number] = len(self.items)
        self.size[number] = size
        self.own[number] = own
        whole = f"{self.tag[number]} {self.names[number]}\x00" + "\x01".join(inside)
        digest = self.digest[number] = xxhash.xxh64_intdigest(whole.encode("utf-8", "surrogatepass")) >> 1
        self._inside[-1].append(str(digest))
        self._sizes[-1] += size
        self._owns[-1] = self._owns[-1] or (own and not self._by_kind(number) and not self.named[number])
        return self.tag[number]

    def main(self) -> list[int]:
        """The outermost elements that are the page's main part, else its body, else nothing in particular."""
        n = len(self.tag)
        kind, gone = [self._by_kind(i) for i in range(n)], list(self.named)
        others, hidden = [False] * n, [False] * n  # in elements of others' texts, in elements that are no frames
        for i, p in enumerate(self.parent):
            kind[i] = kind[i] or (p >= 0 and kind[p])
            gone[i] = gone[i] or kind[i] or (p >= 0 and gone[p])
            hidden[i] = (p >= 0 and hidden[p]) or (self.named[i] and not self._is_frame(i))
            others[i] = (p >= 0 and others[p]) or (self.named[i] and not OTHERS_NAMES.isdisjoint(_WORD.findall(self.names[i])))
        for wanted in ("main", "article"):
            if outer := self._outermost([i for i, t in enumerate(self.tag) if t == wanted and not gone[i]]):
                return outer
        # All are in elements with telling names. One alone in frames is the article; others are if there is no prose besides.
        inner = [i for i, t in enumerate(self.tag) if t in ("main", "article") and not kind[i]]
        framed, ours = (self._outermost([i for i in inner if not no[i]]) for no in (hidden, others))
        body = self._outermost([i for i, t in enumerate(self.tag) if t == "body" and not gone[i]])
        if len(framed) == 1:
            return framed
        if any(self.own[i] for i in body) if body else self.prose:
            return body
        return ours or self._outermost([i for i in inner if self.parent[i] < 0 or not others[self.parent[i]]]) or body

    def _outermost(self, found: list[int]) -> list[int]:
        outer, last = [], -1
        for i in found:
            if self.end[i] > last:
                outer.append(i)
                last = self.end[i]
        return outer

    def _by_kind(self, i: int) -> bool:
        return self.tag[i] in NO_ARTICLE and self.tag[i] != "form"

    def _is_frame(self, i: int) -> bool:
        return all(_names_frame(x) for x in self.names[i].split() if _names_no_article(x))

    def _framed(self, main: list[int], article: list[bool]) -> set[int]:
        """Forms and frames that stay: no prose of the main part is outside such, or they hold an article that it is not itself."""
        n, roots = len(self.tag), set(main)
        alive, bare, stay = [False] * n, [False] * n, set()
        all_bare = not (any(self.own[i] for i in main) if main else self.prose)
        for i, p in enumerate(self.parent):
            if i in roots or (not main and p < 0):
                inside, lacking = True, all_bare
            else:
                inside, lacking = p >= 0 and alive[p], p >= 0 and bare[p]
            if i not in roots and inside and (self.named[i] or self._by_kind(i)):
                if self.named[i] and not self._by_kind(i):
                    inside = self._is_frame(i) and ((lacking and self.size[i] > 0) or (article[i] and not self._in_article(i, main)))
                    lacking = not self.own[i]
                    if inside:
                        stay.add(i)
                else:
                    inside = self.tag[i] == "header"
            alive[i], bare[i] = inside, lacking
        return stay

    def _in_article(self, i: int, main: list[int]) -> bool:
        """Whether ``i`` is in a part of ``main`` that is an article itself."""
        at = bisect_right(main, i) - 1
        return at >= 0 and self.tag[main[at]] == "article"

    def content(self, main: list[int]) -> int:
        return xxhash.xxh64_intdigest(" ".join(str(self.digest[i]) for i in main)) >> 1

    def holders(self, main: list[int]) -> set[int]:
        """Digests of the elements of the main part that may be a template: they hold text, but no article."""
        within, article, roots = [not main] * len(self.tag), self._articles(), set(main)
        for i, p in enumerate(self.parent):
            within[i] = within[i] or (p >= 0 and (within[p] or p in roots))
        return {self.digest[i] for i, t in enumerate(self.tag) if within[i] and t in HOLDER and self.size[i] and not article[i]}

    def _articles(self) -> list[bool]:
        """Of every element whether it is or holds an article."""
        out = [t in ("main", "article") for t in self.tag]
        for i in range(len(out) - 1, -1, -1):
            if out[i] and self.parent[i] >= 0:
                out[self.parent[i]] = True
        return out

    def blocks(self, main: list[int], template: set[int]) -> list[str]:
        article = self._articles()
        framed = self._framed(main, article)
        out: list[str] = []
        now: list[str] = []
        ends: list[tuple[int, bool]] = []  # of open elements: the item after them, and whether only headings count there

        def over() -> None:
            block = " ".join("".join(now).split())
            if block:
                out.append(block)
            now.clear()

        roots = [(self.begin[i] + 1, self.end[i]) for i in main] if main else [(0, len(self.items))]
        for at, stop in roots:
            over()
            ends.clear()
            while at < stop:
                while ends and ends[-1][0] <= at:
                    ends.pop()
                    over()
                item = self.items[at]
                at += 1
                if isinstance(item, str):
                    if not (ends and ends[-1][1]):
                        now.append(item)
                    continue
                tag = self.tag[item]
                recurs = tag in HOLDER and self.digest[item] in template and not article[item]
                # A header may hold the title.
                no_article = tag != "header" if self._by_kind(item) else self.named[item] and item not in framed
                if recurs or no_article:
                    if tag in BLOCK:
                        over()
                    at = self.end[item]
                elif tag in BLOCK:
                    over()
                    only = (tag == "header" or bool(ends and ends[-1][1])) and tag not in HEADING
                    ends.append((self.end[item], only))
                elif tag == "br":
                    now.append(" ")
        over()
        return out


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


def _of_host(host: str) -> int:
    """What turns an element's digest into its key on the host, and back."""
    return xxhash.xxh64_intdigest(host.encode("utf-8", "surrogatepass")) >> 1


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per page (key1, key2) and holder of its main part: the page's content, and the holder's key on the host."""
    for batch in batches:
        rows = []
        for key1, key2, url, html in zip(*(batch.column(k).to_pylist() for k in range(4))):
            page = Page(html or "")
            main = page.main()
            host, content = _of_host(host_of(url)), page.content(main)
            rows += [(key1, key2, content, d ^ host) for d in page.holders(main)]
        columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(4)]
        yield pa.RecordBatch.from_arrays(columns, ["key1", "key2", "content", "subtree"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of key1, page_id, url, html and the keys of the page's templates."""
    for batch in batches:
        found = []
        for url, html, template in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4))):
            page, host = Page(html or ""), _of_host(host_of(url))
            found.append("\n".join(page.blocks(page.main(), {t ^ host for t in template or ()})))
        columns = [batch.column(1), batch.column(2), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])


def _not_in(words, run):
    """``run`` on the rows that the Bloom filter keeps out."""

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run(batch.filter(pa.array(~perhaps_in(words, batch.column(0)))) for batch in batches)

    return rest


def templates(pages: DataFrame, many_pages: int = MANY_PAGES) -> DataFrame:
    """``key1``, ``key2``, ``subtrees`` of the pages (key1, key2, url, html) whose main part holds templates of their host.

    A template stands on ``many_pages`` different pages of the host. Pages and templates meet row by row, so no host
    has a list; a page's list is bounded by its elements.
    """
    each = written(arrow(pages.select("key1", "key2", "url", "html"), _subtrees, "key1 long, key2 long, content long, subtree long").distinct(), "subtrees")
    counts = each.select("subtree", "content").distinct().groupBy("subtree").agg(F.count(F.lit(1)).alias("n"))
    many = written(counts.where(F.col("n") >= many_pages).select("subtree"), "templates")
    found = written(each.join(many, "subtree").groupBy("key1", "key2").agg(F.collect_list("subtree").alias("subtrees")), "page-templates")
    dropped(each, many)
    return found


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` of every row of ``pages`` (page_id, url, html)."""
    keys = [F.xxhash64(F.lit(k), "url", "html").alias(f"key{k}") for k in (1, 2)]  # equal rows are one page
    keyed = pages.select(*keys, "page_id", "url", "html")
    known = templates(keyed)
    words = bloom_filter(known.select("key1"))
    columns = "page_id long, url string, text string, n_chars long"
    # Only pages with templates are shuffled to meet them.
    without = keyed.select("key1", "page_id", "url", "html", F.lit(None).cast("array<long>").alias("subtrees"))
    some = sifted(keyed, words).join(known, ["key1", "key2"], "left").select("key1", "page_id", "url", "html", "subtrees")
    return arrow(without, _not_in(words, _texts), columns).unionByName(arrow(some, _texts, columns))
