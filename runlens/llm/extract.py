"""Main text of web pages by scoring the element tree.

A page is read once into blocks (runs of text between block boundaries) under a tree of elements. Every
block passes points for its length and commas to its ancestors, halved at each level and discounted by
the share of link text. The best container wins; siblings that score well are kept with it, and so are those
with few links beside them and headings before them. Forms and
containers with a suspicious name are judged last, by what they hold beside the rest of the page.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style textarea title noscript template iframe svg math select xmp noembed"
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
#: A start tag of the key ends an open element of these names.
ENDS = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]),
}
#: Such an end or a new such item is not searched for beyond these.
FENCES = frozenset("table ul ol dl article main section body html".split())

# Fixed values of this method.
NEVER = frozenset("nav footer aside button menu head".split())
#: Dropped unless they hold the text of the page.
SUSPECT = frozenset("form dialog object".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PRIOR = {"article": 50.0, "main": 30.0, "section": 2.0, "div": 2.0, "td": 1.0, "blockquote": 1.0}
UNLIKELY = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertis\w*|adsense|banner|promo\w*|sponsor\w*|cookies?|consent|gdpr|notices?|"
    r"alerts?|popup|modal|overlay|newsletter|subscri\w*|signup|social|share|sharing|sidebar|side|menu|nav|navbar|"
    r"navigation|breadcrumbs?|footer|masthead|topbar|comments?|commentlist|disqus|respond|repl(?:y|ies)|related|"
    r"recommend\w*|widgets?|pagination|pager|login|toolbar|copyright|disclaimer|teasers?)(?:$|[\s_-])",
    re.I,
)
#: Text of others and words about the page: here an article is no sign of the page's own text.
FOREIGN = re.compile(
    r"(?:^|[\s_-])(?:(?<!has[_-])(?<!with[_-])(?<!no[_-])(?:cookies?|consent|gdpr|comments?|commentlist|disqus|respond|"
    r"repl(?:y|ies)|related|recommend\w*|teasers?|newsletter))(?:$|[\s_-])",
    re.I,
)
#: A suspect holds the text of the page if the rest has so many times less text without links.
OUTWEIGHS = 4
#: Text with a smaller share of links than this reads as text.
LOW_LINK = 0.33
PAGE_HEADER = re.compile(r"(?:^|[\s_-])header(?:$|[\s_-])", re.I)

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"""|<(?:svg|math)(?=[\s/>])(?:[^>"'/]|/(?!>)|"[^"]*"|'[^']*')*+/>"""
    rf"|<(?P<raw>{RAW.replace(' ', '|')})(?=[\s/>])[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"""|<(?P<end>/?)(?P<name>[a-z][a-z0-9:-]*)(?P<rest>(?:[^>"']|"[^"]*"|'[^']*')*+)>"""
    r"|<(?P<end2>/?)(?P<name2>[a-z][a-z0-9:-]*)(?P<rest2>[^>]*)>"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""([a-z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)


class Page:
    """Elements as parallel lists; blocks as (element, text, characters inside links, links)."""

    def __init__(self, source: str) -> None:
        self.tags, self.parents = ["#root"], [-1]
        self.blocks: list[tuple[int, str, int, int]] = []
        self.suspects: dict[int, bool] = {}  # element: whether its text is foreign to the page
        stack = [0]  # open elements
        dropped = 0  # position in the stack of the outermost dropped element, 0 if none
        inside = 0  # open article or main elements
        words: list[str] = []
        linked, links, anchors = 0, 0, 0

        def flush() -> None:
            nonlocal linked, links
            if words:
                text = " ".join(html.unescape("".join(words)).split())
                words.clear()
                if text:
                    at = next(e for e in reversed(stack) if self.tags[e] not in INLINE)
                    self.blocks.append((at, text, linked, links))
            linked, links = 0, 0

        def pop(to: int) -> None:
            nonlocal dropped, inside, anchors
            for e in stack[to:]:
                inside -= self.tags[e] in ("article", "main")
                anchors -= self.tags[e] == "a"
            del stack[to:]
            if dropped >= to:
                dropped = 0

        def close(names: frozenset[str], stop: frozenset[str]) -> None:
            for k in range(len(stack) - 1, 0, -1):
                if self.tags[stack[k]] in names:
                    pop(k)
                    return
                if self.tags[stack[k]] in stop:
                    return

        at = 0
        for found in TOKEN.finditer(source):
            if not dropped and found.start() > at:
                part = source[at : found.start()]
                words.append(part)
                if anchors:
                    linked += len(part.strip())
            at = found.end()
            name = (found["name"] or found["name2"] or "").lower()
            if not name:
                continue
            block = name not in INLINE
            if not block and not dropped and name == "br":
                words.append(" ")
            if block and not dropped:
                flush()
            if found["end"] or found["end2"]:
                close(frozenset([name]), frozenset())
                continue
            if block:
                close(frozenset(["p"]), FENCES | frozenset(["td", "th", "li", "div"]))
            if name in ENDS:
                close(ENDS[name], FENCES)
            if name in VOID:
                continue
            self.tags.append(name)
            self.parents.append(stack[-1])
            stack.append(len(self.tags) - 1)
            rest = found["rest"] if found["name"] else found["rest2"]
            if not dropped:
                if name in NEVER or name == "header" and not inside:
                    dropped = len(stack) - 1
                else:
                    self.suspect(name, rest, inside)
            inside += name in ("article", "main")
            anchors += name == "a"
            links += name == "a" and not dropped
        if not dropped and at < len(source):
            words.append(source[at:])
        flush()

    def suspect(self, name: str, rest: str, inside: int) -> None:
        """Note the newest element if its name, class, id or role speaks against it."""
        new = len(self.tags) - 1
        if name in SUSPECT:
            self.suspects[new] = False
        if not rest.strip() or name in ("html", "body", "article", "main") or name in INLINE:
            return
        told = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(rest)}
        named = f"{told.get('class', '')} {told.get('id', '')}"
        role = told.get("role", "").lower()
        if (
            "hidden" in told
            or told.get("aria-hidden") == "true"
            or role in ROLES and role != "form"
            or re.search(r"display\s*:\s*none", told.get("style", ""), re.I)
            or FOREIGN.search(named)
        ):
            self.suspects[new] = True
        elif role == "form" or UNLIKELY.search(named) or not inside and PAGE_HEADER.search(named):
            self.suspects[new] = False

    def path(self, element: int) -> list[int]:
        path = [element]
        while self.parents[path[-1]] >= 0:
            path.append(self.parents[path[-1]])
        return path

    def drop_suspects(self) -> None:
        """Keep the blocks that lie in no suspect or only in such that hold the text of the page.

        Suspects are judged from the outermost inwards against the text that is kept so far. If nothing would be
        left, names and forms misled and all blocks stay.
        """
        if not self.suspects or not self.blocks:
            return
        paths = [self.path(b[0]) for b in self.blocks]
        within = [[e for e in reversed(p) if e in self.suspects] for p in paths]
        plain = [max(0, len(text) - linked) for _, text, linked, _ in self.blocks]
        own = [k for k, w in enumerate(within) if not any(self.suspects[e] for e in w)]
        best = self.scored([self.blocks[k] for k in own], [paths[k] for k in own])[0] if own else 0
        above_best = set(self.path(best))
        # Elements have larger numbers than their parents, so sums run upwards.
        inner, articles, filled = [0] * len(self.tags), [0] * len(self.tags), [False] * len(self.tags)
        for (e, *_), n in zip(self.blocks, plain):
            inner[e] += n
            filled[e] = True
        for e in range(len(self.tags) - 1, 0, -1):
            above = self.parents[e]
            inner[above] += inner[e]
            filled[above] |= filled[e]
            articles[above] += articles[e] + (filled[e] and self.tags[e] in ("article", "main"))
        waiting: dict[int, list[tuple[int, int]]] = {}  # blocks by the outermost suspect not yet judged
        outer, clear = 0, set()  # kept text, article and main elements with kept text

        def keep(k: int, judged: int) -> None:
            nonlocal outer
            if judged < len(within[k]):
                waiting.setdefault(within[k][judged], []).append((k, judged))
            else:
                kept.append(k)
                outer += plain[k]
                clear.update(e for e in paths[k] if self.tags[e] in ("article", "main"))

        kept: list[int] = []
        for k in range(len(self.blocks)):
            keep(k, 0)
        # A suspect is judged before those inside it: it has the smaller number.
        for s in sorted(self.suspects):
            if s not in waiting:
                continue
            outweighs = inner[s] > OUTWEIGHS * outer
            other = bool(clear.difference(self.path(s)))
            form = self.tags[s] == "form"
            if self.suspects[s]:
                stays = outweighs and not other and articles[s] == 1
            elif other:
                stays = outweighs and s in above_best
            else:
                inset = any(self.tags[e] == "article" and e in clear for e in self.path(s))
                stays = outweighs or not inset and (s in above_best and bool(articles[s] or form) or form and inner[s] > outer)
            if stays:
                for k, judged in waiting.pop(s):
                    keep(k, judged + 1)
        if kept:
            self.blocks = [self.blocks[k] for k in sorted(kept)]

    def scored(self, blocks: list[tuple[int, str, int, int]], paths: list[list[int]]) -> tuple[int, dict, dict, dict]:
        """The best container; points, characters and characters inside links of each element."""
        score: dict[int, float] = {}
        chars: dict[int, int] = {}
        linked: dict[int, int] = {}
        for (_, text, in_links, _), path in zip(blocks, paths):
            points = 1 + text.count(",") + min(len(text) / 100, 3)
            # An element that holds only its own text is a paragraph: its parent is the first container.
            for level, e in enumerate(path[1:] if len(path) > 1 else path):
                score[e] = score.get(e, 0.0) + points / (1 << min(level, 30))
            for e in path:
                chars[e] = chars.get(e, 0) + len(text)
                linked[e] = linked.get(e, 0) + min(in_links, len(text))
        for e in score:
            score[e] = (score[e] + PRIOR.get(self.tags[e], 0.0)) * (1 - linked[e] / chars[e])
        return max(score, key=lambda e: (score[e], -e)), score, chars, linked

    def main_text(self) -> str:
        if not self.blocks:
            return ""
        self.drop_suspects()
        paths = [self.path(b[0]) for b in self.blocks]
        best, score, chars, linked = self.scored(self.blocks, paths)
        kept = {best}
        if best:
            least = max(10.0, score[best] * 0.2)
            for e in chars:
                if self.parents[e] == self.parents[best] and e != best:
                    density = linked[e] / chars[e]
                    if score.get(e, 0.0) >= least or self.tags[e] == "p" and chars[e] > 80 and density < 0.25:
                        kept.add(e)
        kept |= self.neighbours(best, kept, paths, chars, linked)
        menus = {
            e for e in chars
            if self.tags[e] in ("ul", "ol", "table", "div") and e not in kept and linked[e] > 0.66 * chars[e]
            and sum(n for (_, _, _, n), path in zip(self.blocks, paths) if e in path) >= 3
        } if any(linked.values()) else set()
        chosen = []
        for k, ((_, text, _, _), path) in enumerate(zip(self.blocks, paths)):
            if (~k in kept or kept.intersection(path)) and not menus.intersection(path):
                header = next((k for k, e in enumerate(path) if self.tags[e] == "header"), None)
                if header is None or any(self.tags[e] in HEADINGS for e in path[:header]):
                    chosen.append(text)
        return "\n".join(chosen)

    def neighbours(self, best: int, kept: set[int], paths: list[list[int]], chars: dict[int, int], linked: dict[int, int]) -> set[int]:
        """Elements around the best container to keep, and blocks of their own text as ~k.

        Next to a kept part, before and after, parts with few links stay as far as they follow each other, and what
        lies between kept parts. A level that stays whole is followed by the one above, up to the body. Beside an
        article, and above a level that does not stay whole, only headings right before are kept.
        """
        found: set[int] = set()
        whole = self.tags[best] not in ("article", "main")
        cur, first = best, True
        depth = len(self.path(best)) - 1
        while cur:
            above = self.parents[cur]
            depth -= 1
            top = self.tags[above] in ("#root", "html", "body")
            # Parts in order: child elements, and runs of text of the element itself.
            parts: dict[int, tuple[int, int, int]] = {}  # part: characters, characters inside links, last block
            for k, path in enumerate(paths):
                at = len(path) - 1 - depth  # a path ends at the root
                if at < 0 or path[at] != above:
                    continue
                part = path[at - 1] if at else ~k
                if at:
                    parts[part] = chars[part], linked[part], k
                else:
                    _, text, in_links, _ = self.blocks[k]
                    parts[part] = len(text), min(len(text), in_links), k
            order = list(parts)
            low = [parts[x][1] <= LOW_LINK * parts[x][0] for x in order]
            here = [i for i, x in enumerate(order) if x == cur or x in kept]
            if not here:
                break
            spread = whole and (first or not top)
            start, end = here[0], here[-1]
            if spread:
                found.update(order[i] for i in here)
                while start and low[start - 1]:
                    start -= 1
                while end + 1 < len(order) and low[end + 1]:
                    end += 1
                found.update(order[i] for i in range(start, end + 1) if low[i])
            while start and low[start - 1] and self.is_heading(order[start - 1], paths):
                start -= 1
                found.add(order[start])
            if top and len(order) > 1:
                break
            first = first and len(order) == 1
            whole = whole and start == 0 and end + 1 == len(order) and all(x in found or x in kept for x in order)
            cur = above
        return found

    def is_heading(self, part: int, paths: list[list[int]]) -> bool:
        """Whether all blocks of a part are headings."""
        if part < 0:
            return False
        inside = [p for p in paths if part in p]
        return all(any(self.tags[e] in HEADINGS for e in p[: p.index(part) + 1]) for p in inside)


def main_text(source: str | None) -> str:
    """The main text of one page; empty for null or a page without text."""
    return Page(source).main_text() if source else ""


def main_text_column(source: Column) -> Column:
    @F.pandas_udf("string")
    def extracted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(x) for x in batch], dtype="object")

    return extracted(source)


def extract_main_text(pages: DataFrame, source: str = "html") -> DataFrame:
    """Every row with ``text`` and its length in code points, ``n_chars``.

    Null or empty pages give an empty text. Columns of those two names are replaced, others stay.
    Repeated rows are extracted each; pages of any length are read whole.
    """
    return pages.withColumn("text", main_text_column(F.col(source))).withColumn("n_chars", F.length("text").cast("long"))
