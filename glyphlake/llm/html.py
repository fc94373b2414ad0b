"""Operator 5: main text of web pages by wrappers, union-free regular expressions inferred for each host.

A page is read as a stream of tokens: starts and ends of block elements, and text slots. Neighbours that repeat fold into
repeated elements or groups; the streams of a host's pages are then aligned one after another: where they differ, the next
token that both have is searched within the element, and what only one has becomes optional. Every page of a host takes
part: tasks align their own pages first, and only the wrappers, whose size follows the host's markup and not its pages, are
shuffled and aligned further. In the wrapper it shows which slots hold template text (the same on different pages), where
links dominate, and which element holds the text where no page marks one. Each page is aligned once more with its host's wrapper: the slots of
its article, or, where it marks none, of the wrapper's content element, or else all of them, stay but for those that
meet a slot of template text or links. No function here calls itself, so pages may nest elements as deep as they like.
"""

from __future__ import annotations

import html as entities
import json
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphlake.llm.common import staged

# HTML's block elements, those that close an open paragraph or item, void ones and ones whose content is no text.
BLOCK = frozenset("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption address details summary nav header footer aside form fieldset hgroup center menu dialog search".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
# Elements and roles that mark what is not the article, and words of class or id that do: anywhere in a name, or where
# the name has no other word but these and the ones that follow.
APART = frozenset("head nav header footer aside form menu dialog search button label select option fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu sidebar masthead cookie cookies consent gdpr comment comments disqus replies breadcrumb breadcrumbs newsletter subscribe subscription popup modal overlay pagination pager toolbar login signup paywall".split())
ALONE = frozenset("header footer notice notices banner respond share sharing social related recommended widget skip hidden".split())
BESIDE = frozenset("site page top bottom box bar block list links posts articles stories items buttons icons section area container wrapper inner content global fixed sticky to".split())
MAIN = frozenset("content article post entry story main".split())

#: Different pages that must have a text for it to be template text.
PAGES = 3
#: Tokens of neighbours that are aligned to fold them. Beyond, neighbours stay apart, each with all it has.
FOLDED = 4_000
#: Wrappers of a host meet in groups, whose number falls in these steps.
GROUPS = (1024, 32, 1)

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|textarea|svg|iframe|title|object)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<[!?][^>]*(?:>|\Z)|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)


# Kinds of tokens: start of an element, text slot, end, start and end of a group. Marks: repeated, optional.
START, SLOT, END, GROUP, GROUP_END = "<", "#", ">", "(", ")"
REPEATED, OPTIONAL = 1, 2


def _apart(name: str) -> bool:
    """Whether one name of a class or id marks what is not the article."""
    words = re.sub(r"([a-z])([A-Z])", r"\1 \2", re.sub(r"[^A-Za-z]+", " ", name)).lower().split()
    return any(w in WORDS for w in words) or any(w in ALONE for w in words) and all(w in ALONE or w in BESIDE for w in words)


@lru_cache(1 << 16)
def _marks(name: str, rest: str) -> tuple[str, bool]:
    """The key of an element (its name and classes, digits made alike) and whether it is apart from the article."""
    label, apart = "", name in APART
    if "=" in rest or "hidden" in rest:
        for attribute, value in _ATTRIBUTE.findall(rest):
            attribute, value = attribute.lower(), value.strip("\"'")
            if attribute == "class":
                label = re.sub(r"\d+", "9", " ".join(sorted(value.lower().split())))
            if attribute in ("class", "id"):
                apart |= any(map(_apart, value.split()))
            elif attribute == "role":
                apart |= value.lower() in ROLES
            elif attribute == "hidden" or attribute == "aria-hidden" and value.lower() == "true":
                apart = True
            elif attribute == "style":
                apart |= bool(re.search(r"display\s*:\s*none", value, re.I))
    if name in ("html", "body", "main"):
        apart = False
    return f"{name}.{label}" if label else name, apart


def parse(page: str) -> list[tuple]:
    """A page's tokens: (START, key, 0), (SLOT, text, characters of it that are links, place), (END,).

    Elements apart from the article have no content; place is "article" or "main" inside such an element, else empty. A
    header inside these belongs to the article.
    """
    out: list[tuple] = []
    stack: list[tuple[str, bool]] = []  # name, apart or inside what is
    opened: dict[str, int] = defaultdict(int)
    hidden: list[str] = []  # inline elements apart from the article that are open
    run: list[str] = []
    link, linked = False, 0

    def close_run() -> None:
        nonlocal linked
        if run:
            text = " ".join(entities.unescape("".join(run)).split())
            if text and not (stack and stack[-1][1]):
                out.append((SLOT, text, min(linked, len(text)), "article" if opened["article"] else "main" if opened["main"] else ""))
            run.clear()
        linked = 0

    def close() -> None:
        opened[stack.pop()[0]] -= 1
        if not (stack and stack[-1][1]):
            out.append((END,))

    for m in TOKEN.finditer(page):
        text = m["text"]
        if text is not None:
            if not hidden:
                run.append(text)
                linked += len(text) if link else 0
            continue
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        block = name in BLOCK or name == "head"
        if m["end"] or m["end2"]:
            if name == "a":
                link = False
            elif hidden and name == hidden[-1]:
                hidden.pop()
            elif block and opened[name]:
                close_run()
                while stack[-1][0] != name:
                    close()
                close()
                hidden, link = [], False
        elif name in VOID:
            run.append(" ")
        elif block:
            close_run()
            hidden, link = [], False
            if stack and (stack[-1][0] == "p" or name == "body" and stack[-1][0] == "head"):
                close()
            while stack and stack[-1][0] in CLOSES.get(name, ()):
                close()
            key, apart = _marks(name, m["rest"] or "")
            if name == "header" and (opened["article"] or opened["main"]):
                apart = _marks("div", m["rest"] or "")[1]
            inside = bool(stack) and stack[-1][1]
            if not inside:
                out.append((START, key + "!" * apart, 0))
            stack.append((name, apart or inside))
            opened[name] += 1
        elif name == "a":
            link = True
        elif hidden and name == hidden[-1] or _marks(name, m["rest"] or "")[1]:
            hidden.append(name)
    close_run()
    while stack:
        close()
    return out


def candidates(slots: list[tuple], classed: set[int] = frozenset()) -> list[int]:
    """Numbers of the slots of the page's own ``article`` elements, else of ``main``, else of ``classed``, else all."""
    for place in ("article", "main"):
        if own := [i for i, x in enumerate(slots) if x[3] == place]:
            return own
    return sorted(classed) or list(range(len(slots)))


def _page(tokens: list[tuple]) -> int:
    """A number for what the page says: copies of a page have the same, whatever their attributes."""
    slots = [x for x in tokens if x[0] == SLOT]
    text = "\n".join(slots[i][1] for i in candidates(slots))
    return int.from_bytes(blake2b(text.encode(errors="replace"), digest_size=6).digest())


# Tokens of wrappers: [START or GROUP, key, mark], [SLOT, "#", mark, pages, least and greatest hash of the texts, characters, those
# of links, places, numbers of a page's own slots], [END], [GROUP_END].


def _joined(a: list, b: list) -> list:
    """One token for two of a key. A slot's numbers are added to those of the first, which is used no more."""
    if a[0] != SLOT:
        return [a[0], a[1], a[2] | b[2]]
    a[9].extend(b[9])
    pages = a[3] if a[3] == b[3] else sorted({*a[3], *b[3]})[:PAGES]
    return [SLOT, "#", a[2] | b[2], pages, min(a[4], b[4]), max(a[5], b[5]), a[6] + b[6], a[7] + b[7], a[8] | b[8], a[9]]


class _Stream:
    """Tokens with the place of each one's end, its parent, its place among the parent's children, and where keys occur."""

    def __init__(self, tokens: list[list]):
        self.tokens = tokens
        n = len(tokens)
        self.end, self.parent, self.rank = list(range(n)), [-1] * n, [0] * n
        self.at: dict[tuple[int, str], list[int]] = defaultdict(list)
        self.children = [0] * (n + 1)
        path = [-1]
        for i, x in enumerate(tokens):
            if x[0] in (END, GROUP_END):
                self.end[path.pop()] = i
                continue
            parent = path[-1]
            self.parent[i] = parent
            self.rank[i] = self.children[parent]
            self.children[parent] += 1
            self.at[parent, x[1]].append(i)
            if x[0] != SLOT:
                path.append(i)

    def after(self, i: int) -> int:
        """The place behind a token and all inside it."""
        return self.end[i] + 1

    def ahead(self, i: int, to: int, key: str) -> int | None:
        """The next sibling of i with this key, before ``to``."""
        found = self.at.get((self.parent[i], key), ())
        k = bisect_right(found, i)
        return found[k] if k < len(found) and found[k] < to else None

    def run(self, i: int, to: int, group: str) -> int | None:
        """The place behind the siblings from i on whose keys are a group's, if they are."""
        keys = []
        while i < to and len(keys) < 4:
            keys.append(self.tokens[i][1])
            i = self.after(i)
            if "(" + " ".join(keys) + ")" == group:
                return i
        return None


def _steps(one: _Stream, two: _Stream) -> Iterator[tuple[str, int, int]]:
    """The alignment of two streams, in order: ("both", i, j), ("a", i, 0) and ("b", j, 0) for what only one has, ("end", i, j) (-1: none).

    Where keys differ, the nearest place is taken at which one stream has the key that the other stands at, among the siblings.
    A group meets its keys in turn as a group of one.
    """
    a, b = one.tokens, two.tokens
    path = [(len(a), len(b), -1, -1)]  # where the element ends in both, and its end tokens
    i = j = 0
    while path:
        to_a, to_b, end_a, end_b = path[-1]
        if i == to_a and j == to_b:
            path.pop()
            if path:
                yield "end", end_a, end_b
                i, j = i + (end_a >= 0), j + (end_b >= 0)
        elif j == to_b:
            yield "a", i, 0
            i = one.after(i)
        elif i == to_a:
            yield "b", j, 0
            j = two.after(j)
        elif a[i][1] == b[j][1]:
            yield "both", i, j
            if a[i][0] == SLOT:
                i, j = i + 1, j + 1
            else:
                path.append((one.end[i], two.end[j], one.end[i], two.end[j]))
                i, j = i + 1, j + 1
        elif a[i][0] == GROUP and (to := two.run(j, to_b, a[i][1])):
            yield "both", i, -1
            path.append((one.end[i], to, one.end[i], -1))
            i += 1
        elif b[j][0] == GROUP and (to := one.run(i, to_a, b[j][1])):
            yield "both", -1, j
            path.append((to, two.end[j], -1, two.end[j]))
            j += 1
        else:
            in_a, in_b = one.ahead(i, to_a, b[j][1]), two.ahead(j, to_b, a[i][1])
            if in_a is not None and (in_b is None or one.rank[in_a] - one.rank[i] <= two.rank[in_b] - two.rank[j]):
                while i < in_a:
                    yield "a", i, 0
                    i = one.after(i)
            elif in_b is not None:
                while j < in_b:
                    yield "b", j, 0
                    j = two.after(j)
            else:
                yield "a", i, 0
                yield "b", j, 0
                i, j = one.after(i), two.after(j)


def _aligned(a: list[list], b: list[list]) -> list[list]:
    """One stream for two: what only one has becomes optional."""
    one, two, out = _Stream(a), _Stream(b), []
    for what, i, j in _steps(one, two):
        if what == "both":
            out.append(_joined(a[i], b[j]) if i >= 0 and j >= 0 else list(a[i] if i >= 0 else b[j]))
        elif what == "end":
            out.append([a[i][0] if i >= 0 else b[j][0]])
        else:
            source, stream = (a, one) if what == "a" else (b, two)
            part = source[i : stream.after(i)]
            out.append([part[0][0], part[0][1], part[0][2] | OPTIONAL, *part[0][3:]])
            out += part[1:]
    return out


def fold(tokens: list[list]) -> list[list]:
    """Neighbours of one key become one repeated token with what both have inside; two to four keys that take turns, a repeated group."""
    out: list[list] = []
    path: list[tuple[int, list[list]]] = [(-1, [])]  # where an open element starts, and its children: [start, key, structure]

    def structure(start: int) -> int:
        return hash(tuple((x[0], *x[1:3]) for x in out[start + 1 :]))

    def same(p: list, c: list) -> None:
        """Make one of the last two children, of one key."""
        if p[2] == c[2] and 2 * c[0] == p[0] + len(out):
            for k in range(p[0], c[0]):
                if out[k][0] == SLOT:
                    out[k] = _joined(out[k], out[k + c[0] - p[0]])
            del out[c[0] :]
        else:
            out[p[0] :] = _aligned(out[p[0] : c[0]], out[c[0] :])
            p[2] = structure(p[0])
        out[p[0]] = [*out[p[0]][:2], REPEATED, *out[p[0]][3:]]

    def added(kids: list[list]) -> None:
        if len(kids) > 1 and kids[-1][1] == kids[-2][1] and (kids[-1][2] == kids[-2][2] or len(out) - kids[-2][0] <= FOLDED):
            same(kids[-2], kids.pop())
        for k in (2, 3, 4):
            keys = [x[1] for x in kids[-k:]]
            if len(keys) < k or any(x.startswith("(") for x in keys):
                continue
            name = "(" + " ".join(keys) + ")"
            if len(kids) > k and kids[-k - 1][1] == name and len(out) - kids[-k - 1][0] <= FOLDED:
                start, at = kids[-k - 1][0], kids[-k][0]
                out[start + 1 :] = [*_aligned(out[start + 1 : at - 1], out[at:]), [GROUP_END]]
                del kids[-k:]
                kids[-1][2] = structure(start)
                break
            if len(kids) >= 2 * k and [x[1] for x in kids[-2 * k : -k]] == keys and len(out) - kids[-2 * k][0] <= FOLDED:
                start, at = kids[-2 * k][0], kids[-k][0]
                out[start:] = [[GROUP, name, REPEATED], *_aligned(out[start:at], out[at:]), [GROUP_END]]
                del kids[-2 * k :]
                kids.append([start, name, structure(start)])
                break

    for x in tokens:
        if x[0] in (START, GROUP):
            path.append((len(out), []))
            out.append(x)
        elif x[0] == SLOT:
            out.append(x)
            path[-1][1].append([len(out) - 1, "#", 0])
            added(path[-1][1])
        else:
            out.append([x[0]])
            start, kids = path.pop()
            path[-1][1].append([start, out[start][1], hash((out[start][1], *[(k[2], k[1], out[k[0]][2]) for k in kids]))])
            added(path[-1][1])
    return out


def wrapper_of(tokens: list[tuple], page: int | None = None) -> list[list]:
    """A single page's wrapper: its tokens, folded, texts turned into slots that know their numbers on the page."""
    page = _page(tokens) if page is None else page
    out, n = [], 0
    for x in tokens:
        if x[0] == SLOT:
            h = crc32(x[1].encode(errors="replace"))
            out.append([SLOT, "#", 0, [page], h, h, len(x[1]), x[2], 1 if x[3] else 2, [n]])
            n += 1
        else:
            out.append(list(x))
    return fold(out)


def align(a: list[list], b: list[list]) -> list[list]:
    """The wrapper of both wrappers' pages."""
    return fold(_aligned(a, b))


def regex_of(tokens: list[list]) -> str:
    """The wrapper as a union-free regular expression over elements and text slots."""
    path: list[tuple[list, list[str]]] = [([], [])]
    for x in tokens:
        if x[0] in (START, GROUP):
            path.append((x, []))
            continue
        if x[0] == SLOT:
            opener, body = x, "#text"
        else:
            opener, parts = path.pop()
            body = "(" + " ".join(parts) + ")" if opener[0] == GROUP else f"<{opener[1]}>{' '.join(parts)}</>"
        mark = "+" * bool(opener[2] & REPEATED) + "?" * bool(opener[2] & OPTIONAL)
        path[-1][1].append(f"({body}){mark}" if mark else body)
    return " ".join(path[0][1])


def verdict(wrapper: list[list]) -> list[list]:
    """What a host's wrapper says of its pages: the wrapper with a flag at the content element and at the slots that go.

    The content element is the one classed as content that holds most text, half of what stands in no ``article`` or
    ``main`` at least. Slots of template text (the same on PAGES different pages or more) go, and lists of links; inside the
    article and the content element, links on fewer pages stay.
    """
    path: list[list] = [[-1, 0]]  # where an element starts, and its characters that are no links, in no article or main
    weights: list[tuple[int, int, int]] = []
    for i, x in enumerate(wrapper):
        if x[0] in (START, GROUP):
            path.append([i, 0])
        elif x[0] == SLOT:
            path[-1][1] += (x[6] - x[7]) * (x[8] == 2)
        else:
            start, weight = path.pop()
            path[-1][1] += weight
            if weight and wrapper[start][0] == START and set(re.split(r"[^a-z]+", wrapper[start][1].partition(".")[2])) & MAIN:
                weights.append((weight, -start, i))
    heavy = max(weights, default=(0, 0, 0))
    first, last = (-heavy[1], heavy[2]) if heavy[0] and 2 * heavy[0] >= path[0][1] else (-1, -1)
    out = []
    for i, x in enumerate(wrapper):
        if x[0] != SLOT:
            out.append([*x[:2], int(i == first)] if len(x) > 1 else x)
        else:
            many, inside = len(x[3]) >= PAGES, x[8] & 1 or first <= i <= last
            out.append([SLOT, "#", int(many and x[4] == x[5] or (many or not inside) and x[7] > 0.5 * x[6])])
    return out


def text_of(tokens: list[tuple], host: _Stream | None) -> str:
    """The page's candidate texts but for the slots that meet one that goes, in page order, a blank line between blocks."""
    slots = [x for x in tokens if x[0] == SLOT]
    gone, classed = set(), set()
    if host is not None:
        own = wrapper_of(tokens, 0)
        stream = _Stream(own)
        for what, i, j in _steps(host, stream):
            if what == "both" and i >= 0 and j >= 0 and host.tokens[i][2]:
                for x in own[j : stream.after(j)]:
                    if x[0] == SLOT:
                        (gone if host.tokens[i][0] == SLOT else classed).update(x[9])
    return "\n\n".join(slots[i][1] for i in candidates(slots, classed) if i not in gone)


def _host(url: str | None) -> str:
    m = re.match(r"[a-z][a-z0-9+.-]*://([^/?#]*)", url or "", re.I)
    return m[1].lower() if m else ""


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper): each host's wrapper as JSON, from all its pages. Pages without a URL's host share the host ''."""

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[list]] = {}

        def flush() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(list(found), pa.string()), pa.array([json.dumps(w) for w in found.values()], pa.string())], ["host", "wrapper"])
            found.clear()
            return out

        for batch in batches:
            for url, page in zip(batch.column("url").to_pylist(), batch.column("html"), strict=True):
                own = wrapper_of(parse(page.as_py() or ""))
                for x in own:
                    if x[0] == SLOT:
                        x[9] = []
                host = _host(url)
                found[host] = align(found[host], own) if host in found else own
                if len(found) > 4096:
                    yield flush()
        yield flush()

    def together(pdf):
        import pandas as pd

        own: list[list] | None = None
        for w in pdf["wrapper"].sort_values():
            own = json.loads(w) if own is None else align(own, json.loads(w))
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "salt": [pdf["salt"].iloc[0]], "wrapper": [json.dumps(own)]})

    parts = pages.select("url", "html").mapInArrow(per_task, "host string, wrapper string").withColumn("salt", F.spark_partition_id())
    for groups in GROUPS:
        parts = parts.withColumn("salt", F.col("salt") % groups).groupBy("host", "salt").applyInPandas(together, "host string, salt int, wrapper string")
    return parts.select("host", "wrapper")


def main_text(pages: DataFrame, *keep: str) -> DataFrame:
    """(keep..., text, n_chars) of every page's whole html (null: empty), read through its host's wrapper.

    Character references are decoded, white space inside a block becomes one space, blocks are joined by a blank line.
    Pages without text of their own have the empty text, and pages of any length and depth are read whole. Repeated pages are each read, and
    count once as evidence; an empty table gives no rows; columns besides html, url and keep are ignored, and those of keep
    must not bear the names of the result's own.
    """

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [verdict(json.loads(w.as_py())) for w in batch.column("wrapper")]
            # A wrapper in which nothing goes and no element is chosen says nothing.
            yield pa.record_batch([batch.column("host"), pa.array([json.dumps(w) if any(len(x) > 2 and x[2] for x in w) else None for w in found], pa.string())], ["_host", "_wrapper"])

    # Written first, so that the planner knows its size: copied to all tasks where small, else joined by host, hot hosts split.
    kept = staged(wrappers(pages).mapInArrow(decide, "_host string, _wrapper string"), "wrappers")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    joined = pages.select(*keep, "html", host.alias("_host")).join(kept, "_host", "left").select(*keep, "html", "_wrapper")
    types = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = lru_cache(64)(lambda w: _Stream(json.loads(w)) if w else None)
        for batch in batches:
            texts = [text_of(parse(page.as_py() or ""), read(w.as_py())) for page, w in zip(batch.column("html"), batch.column("_wrapper"), strict=True)]
            yield pa.record_batch([*[batch.column(c) for c in keep], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    return joined.mapInArrow(run, f"{types}, text string, n_chars long")
