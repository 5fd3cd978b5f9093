"""Main text of web pages by composite text density.

A tolerant scanner builds the element tree. Elements that are no article text by their kind or name (menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles, reader comments, hidden parts) go first; one that is so by its
class or id alone stays if it holds most of the page's text and no article or main element apart from it does in its place. Each node that stays
gets its composite density: characters per tag, made smaller the more of its text is links; the sum of its children's
densities is its density sum. The search starts at the page's article or main element, if it holds most of the text, else
at the body. From the node of the largest sum the path up to there gives the threshold, the least density on it. Where the
body is searched, side branches below it go if they are containers or mostly links; within an article, if their class or id
is a name of what is no article text (adverts and comments go there in any case). The rest is the text.

Nulls: a null page gives an empty text, a null id stays null. Empty pages and pages without text give "". Repeated rows
each give a row. Of nodes with equal sums the first counts. Long pages are read whole. Unclosed and truncated markup is
closed at the end; a tag cut off by the end is dropped. An empty table gives an empty one. Other columns are ignored,
whatever their names; a name of the result that is among `keep` comes from there.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import common

#: Quotes delimit a value only right behind the equals sign; elsewhere they are characters like others.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*)(>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
SPACE = re.compile(r"\s+")
#: Element kinds of HTML by their role here. Fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg object select".split())
#: Elements of other languages within HTML, which "/>" closes.
SELF_CLOSING = frozenset(("svg", "math"))
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
ENDS_PARAGRAPH = BLOCKS - {"body", "html"}
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
DROPPED = frozenset("nav aside footer form button dialog menu head audio video canvas map".split())
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert alertdialog form".split())
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|sidebar|side|aside|widget\w*|footer|foot|header|masthead|banner|"
    r"cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|comments?|commentlist|disqus|replies|respond|share|sharing|social|related|recommended|"
    r"newsletter|subscribe|signup|login|search|pagination|pager|toolbar|copyright|skip|hidden|sr-only)(?:$|[\s_-])",
    re.I,
)
#: Those of adverts and reader comments, which are no article text inside an article either.
FOREIGN = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|comments?|commentlist|disqus|replies|respond)(?:$|[\s_-])", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
CONTENT_KINDS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
#: Share of the page's characters above which an element isn't dropped for its class or id.
MOST = 0.5
#: Share of the body's characters that an article or main element has to hold to be searched instead.
ARTICLE_SHARE = 0.3
LINK_SHARE = 0.5


def values_of(attributes: str) -> dict[str, str]:
    """An element's attributes; of equal names the first."""
    out: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(attributes):
        out.setdefault(name.lower(), html.unescape(value[1:-1] if value[:1] in ("'", '"') and value[-1:] == value[:1] and len(value) > 1 else value))
    return out


def boilerplate(kind: str, attributes: str, inside: bool) -> bool:
    """Is the element no article text by its kind, role or style? inside: of an article."""
    if kind in DROPPED or kind == "header" and not inside:
        return True
    if not attributes or kind in ("html", "body", "article", "main"):
        return False
    values = values_of(attributes)
    if "hidden" in values or values.get("aria-hidden") == "true" or HIDDEN.search(values.get("style", "")):
        return True
    return values.get("role", "").lower() in ROLES


def named(kind: str, attributes: str, names: re.Pattern) -> int:
    """2 if a class or the id of the element is one of the names, 1 if a part of one is, else 0."""
    if not attributes or kind in ("html", "body", "article", "main"):
        return 0
    values = values_of(attributes)
    held = [values.get(k, "") for k in ("class", "id")]
    return any(map(names.search, held)) + any(names.fullmatch(x) for v in held for x in v.split())


class Tree:
    """The kept elements of a page in order; node 0 holds all. Text pieces and marks between blocks lie in `flow`."""

    def __init__(self, page: str):
        self.kind, self.parent, self.named = [""], [-1], [0]
        self.aside = [False]  # is the element, inside an article, named like what is no article text?
        self.flow: list[tuple[int, str]] = []  # (node, text), or (node, "\n\n") where a block begins or ends
        stack, dropped, articles, at, n = [0], 0, 0, 0, len(page)
        names = [""]  # of the elements on the stack
        skip: list[bool] = [False]

        def close() -> None:
            nonlocal dropped, articles
            node, name, out = stack.pop(), names.pop(), skip.pop()
            dropped -= out
            articles -= name in ("article", "main")
            if name in BLOCKS and not dropped:
                self.flow.append((self.parent[node] if node else 0, "\n\n"))

        def text(piece: str) -> None:
            if piece and not dropped:
                self.flow.append((stack[-1], html.unescape(piece)))

        while at < n:
            m = TOKEN.search(page, at)
            if m is None:
                text(page[at:])
                break
            text(page[at : m.start()])
            at = m.end()
            name = (m[2] or "").lower()
            if not name or not m[4]:
                continue
            if m[1]:
                if name in names[1:]:
                    block = name in BLOCKS
                    for k in range(len(names) - 1, 0, -1):
                        if names[k] == name:
                            while len(names) > k:
                                close()
                            break
                        if not block and names[k] in BLOCKS:
                            break  # an inline end tag doesn't close blocks
                continue
            if name in SELF_CLOSING and m[3].endswith("/"):
                continue
            if name in RAW or name == "math":
                end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                if name == "math":  # inline text, whose tags don't count; without an end tag only the tag itself is left out
                    text(TOKEN.sub("", page[at : at if end is None else end.start()]))
                    at = at if end is None else end.end()
                else:
                    at = n if end is None else end.end()
                continue
            if name in ENDS_PARAGRAPH and "p" in names:
                k = len(names) - 1 - names[::-1].index("p")
                if not any(x in BLOCKS for x in names[k + 1 :]):
                    while len(names) > k:
                        close()
            elif name in CLOSES:
                own, limits = CLOSES[name]
                for k in range(len(names) - 1, 0, -1):
                    if names[k] in limits:
                        break
                    if names[k] in own.split():
                        while len(names) > k:
                            close()
                        break
            if name in VOID:
                if not dropped:
                    self.flow.append((stack[-1], "\n\n" if name == "hr" else " "))
                continue
            if name in BLOCKS and not dropped:
                self.flow.append((stack[-1], "\n\n"))
            elif name in ("td", "th") and not dropped:
                self.flow.append((stack[-1], " "))
            out = boilerplate(name, m[3], articles > 0)
            dropped += out
            articles += name in ("article", "main")
            if dropped:
                stack.append(stack[-1])
            else:
                self.kind.append(name)
                self.parent.append(stack[-1])
                within = articles > (name in ("article", "main"))
                self.named.append(named(name, m[3], FOREIGN if within else NAMES))
                self.aside.append(within and named(name, m[3], NAMES) > 0)
                stack.append(len(self.kind) - 1)
            names.append(name)
            skip.append(out)
            if m[3].endswith("/") and name not in BLOCKS:
                close()
        if any(self.named):
            self.drop_named()

    def drop_named(self) -> None:
        """Drops elements for their class or id, but for one that holds most of the page's text with no article apart from it.

        An article counts if it holds ARTICLE_SHARE of the page's text; where a whole class or id names the element, of the text
        outside such elements."""
        n = len(self.kind)
        chars, bare, last, inside = [0] * n, [0] * n, list(range(n)), [False] * n
        for i in range(1, n):
            inside[i] = inside[self.parent[i]] or self.named[i] > 0
        for node, piece in self.flow:
            if piece != "\n\n":
                size = len(piece) - sum(map(piece.count, " \n\t\r"))
                chars[node] += size
                bare[node] += 0 if inside[node] else size
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            chars[p] += chars[i]
            bare[p] += bare[i]
            last[p] = max(last[p], last[i])
        held = [[a for a in range(n) if self.kind[a] in ("article", "main") and x[a] and x[a] >= ARTICLE_SHARE * x[0]] for x in (chars, bare)]
        out, kept = [False] * n, [0] * n
        for i in range(1, n):
            out[i] = out[self.parent[i]]
            if self.named[i] and not out[i]:
                out[i] = chars[i] <= MOST * chars[0] or any(a > last[i] or i > last[a] for a in held[self.named[i] - 1])
        for i in range(1, n):
            kept[i] = kept[i - 1] + (not out[i])
        self.flow = [(kept[node], piece) for node, piece in self.flow if not out[node]]
        self.parent = [-1, *(kept[self.parent[i]] for i in range(1, n) if not out[i])]
        self.kind = [k for k, gone in zip(self.kind, out) if not gone]
        self.aside = [k for k, gone in zip(self.aside, out) if not gone]

    def measures(self) -> tuple[list[int], list[float], list[float], list[float]]:
        """By node: characters, share of them in links, density, density sum."""
        n = len(self.kind)
        chars, links, tags, link_tags = [0] * n, [0] * n, [1] * n, [k == "a" for k in self.kind]
        for node, piece in self.flow:
            if piece != "\n\n":
                chars[node] += len(piece) - piece.count(" ")
        for i in range(n - 1, 0, -1):
            if self.kind[i] == "a":
                links[i] = chars[i]
            p = self.parent[i]
            chars[p] += chars[i]
            links[p] += links[i]
            tags[p] += tags[i]
            link_tags[p] += link_tags[i]
        overall = links[0] / max(1, chars[0])
        density, sums = [0.0] * n, [0.0] * n
        for i in range(n):
            c, lc = chars[i], links[i]
            if c:
                base = math.log(c / max(1, c - lc) * lc + overall * c + math.e)
                density[i] = c / tags[i] * math.log(max(1.0, c / max(1, lc) * tags[i] / max(1, link_tags[i]))) / max(1e-9, math.log(max(1.0001, base)) if base > math.e else 1.0)
            if i:
                sums[self.parent[i]] += density[i]
        return chars, [lc / max(1, c) for c, lc in zip(chars, links)], density, sums

    def text(self) -> str:
        """The blocks of the main text, joined by an empty line."""
        n = len(self.kind)
        chars, linked, density, sums = self.measures()
        if not chars[0]:
            return ""
        articles = [i for i in range(n) if self.kind[i] in ("article", "main") and chars[i] >= ARTICLE_SHARE * chars[0]]
        scope = max(articles, key=lambda i: (chars[i], -i), default=0)
        inside = [False] * n
        inside[scope] = True
        for i in range(scope + 1, n):
            inside[i] = inside[self.parent[i]]
        best = max((i for i in range(n) if inside[i]), key=lambda i: (sums[i], -i))
        path, i = {scope}, best
        least = density[best]
        while i != scope:
            path.add(i)
            least = min(least, density[i])
            i = self.parent[i]
        kept, below = list(inside), [i == best for i in range(n)]  # below: at or under the node of the largest sum
        for i in range(scope + 1, n):
            p = self.parent[i]
            below[i] = below[i] or below[p]
            if not kept[i] or not kept[p]:
                kept[i] = False
            elif i not in path and density[i] < least and self.kind[i] in BLOCKS and chars[i]:
                if scope:  # within an article links are text, and only names and density together tell what isn't
                    kept[i] = not self.aside[i]
                else:
                    side = p in path and not below[i] and self.kind[i] not in CONTENT_KINDS
                    kept[i] = not side and linked[i] < LINK_SHARE
        parts, blocks = [], []
        for node, piece in self.flow:
            if piece == "\n\n":
                blocks.append("".join(parts))
                parts = []
            elif kept[node]:
                parts.append(piece)
        blocks.append("".join(parts))
        return "\n\n".join(b for b in (SPACE.sub(" ", b).strip() for b in blocks) if b)


def main_text(page: str | None) -> str:
    return Tree(page).text() if page else ""


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns of keep and text, the main text of each page."""
    common.small_batches(pages.sparkSession)
    rows = pages.select(*keep, F.col(html_col).cast("string").alias("__html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*keep, "text"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1])
    return rows.mapInArrow(common.frugal(run), f"{fields}, text string")


def report(pages: DataFrame) -> DataFrame:
    return extract(pages).withColumn("n_chars", F.length("text").cast("long"))
