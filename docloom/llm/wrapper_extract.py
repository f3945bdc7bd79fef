"""HTML extraction by wrappers: union-free regular expressions inferred from pages of one host.

A page is a stream of tags and texts. Runs of equal groups of tokens fold into repeated groups. The
streams of a host are aligned one after another: texts that differ become slots, groups that only one
side has become optional, and groups that one side has more often become repeated. The wrapper tells
template from content; the element that holds most of the slots' text and their main heading, menus
and the like left aside, is the host's article. A page's main text is then read from that element,
without blocks that are the same on the host's pages. Of a single page, or of pages that are mostly
the same, nothing tells template from content; there all text counts.

Pages are folded where they are; of each partition only distinct token streams go on, with sums of
text lengths, so a host with a third of all pages is no larger for its task than any other.
"""

from __future__ import annotations

import html
import itertools
import json
import re
from collections.abc import Collection, Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import attach, cut

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?:svg|iframe)\b(?:"[^"]*"|'[^']*'|[^'">])*/>|<(script|style|noscript|template|textarea|svg|iframe|select|title)\b(?:"[^"]*"|'[^']*'|[^'">])*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][\w:-]*)((?:"[^"]*"|'[^']*'|[^'">])*)>|([^<]+|<)""",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset("address article aside blockquote body br dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that never hold main text.
ASIDE = frozenset("nav header footer aside form menu button dialog head fieldset label input option".split())
#: Layout elements, whose class words say what is beside the text and not what they hold.
LAYOUT = frozenset("html body main article".split())
#: Names of a class, id or role, as a whole, that mark menus, notices, adverts, shares and comments.
ASIDE_WORD = re.compile(r"(?:^|\s)(?:ads?|advert\w*|banner|breadcrumbs?|comments?|commentlist|cookie\w*|consent|disqus|footer|header|masthead|menu|modal|nav\w*|newsletter|notices?|pagination|popup|promo\w*|related|replies|respond|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widget)(?:$|\s)", re.I)
#: A tag that opens closes an open element of these kinds first.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
BODY = 12  # nodes in a repeated group at most; a group within counts as one


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("open" or "close", name, class words) and ("text", text, "") of a page, in order."""
    for m in TOKEN.finditer(page):
        closing, name, attributes, text = m.group(2, 3, 4, 5)
        if text is not None:
            yield "text", text, ""
        elif name is not None:
            said = ""
            if attributes and not closing:
                said = " ".join(a or b or c for _, a, b, c in ATTRIBUTE.findall(attributes))
            yield ("close" if closing else "open"), name.lower(), re.sub(r"\d+", "", said)


class Elements:
    """The open elements while a page's tokens go by."""

    def __init__(self, words: bool = True) -> None:
        self.words = words  # whether class words mark what is aside
        self.stack: list[tuple[str, bool]] = []  # key, whether main text can stand in it
        self.names: list[str] = []

    def see(self, kind: str, name: str, said: str) -> None:
        if kind == "open":
            if name in BLOCK and name not in VOID and "p" in self.names:
                self.close("p")
            for other in CLOSES.get(name, ()):
                if other in self.names and not {"ul", "ol", "table", "dl"} & set(self.names[self._last(other) + 1 :]):
                    self.close(other)
            if name == "body":  # paths begin there, as in stream()
                self.stack, self.names = [("body", True)], ["body"]
            elif name not in VOID:
                fine = (not self.stack or self.stack[-1][1]) and name not in ASIDE and not (self.words and said and name not in LAYOUT and ASIDE_WORD.search(said))
                self.stack.append((f"{name}.{said}" if said else name, fine))
                self.names.append(name)
        elif kind == "close" and name in self.names:
            self.close(name)

    def _last(self, name: str) -> int:
        return len(self.names) - 1 - self.names[::-1].index(name)

    def close(self, name: str) -> None:
        at = self._last(name)
        del self.stack[at:], self.names[at:]

    def path(self) -> tuple[str, ...]:
        return tuple(k for k, _ in self.stack)

    def fine(self) -> bool:
        return not self.stack or self.stack[-1][1]


# A node is ["T", tag], ["X", text or None, characters, pages], ["R", nodes] or ["O", nodes].


def key(node: list) -> str:
    if node[0] == "T":
        return node[1]
    return "#" if node[0] == "X" else f"{node[0]}({' '.join(map(key, node[1]))})"


def stream(page: str, seen: list[tuple[str, str, str]] | None = None) -> list[list]:
    """The nodes of a page from its body on, not yet folded. seen: its tokens, where they are known."""
    out: list[list] = []
    for kind, name, said in tokens(page) if seen is None else seen:
        if kind == "text":
            text = " ".join(html.unescape(name).split())
            if text:
                out.append(["X", text, len(text), 1])
        elif kind == "open" and name == "body":
            out = [["T", "<body>"]]
        else:
            out.append(["T", f"<{'/' if kind == 'close' else ''}{name}{'.' + said if said else ''}>"])
    return out


def united(a: list, b: list) -> list:
    """Two nodes of one key; texts that differ become a slot."""
    if a[0] == "T":
        return a
    if a[0] == "X":
        return ["X", a[1] if a[1] == b[1] else None, a[2] + b[2], a[3] + b[3]]
    return [a[0], [united(x, y) for x, y in zip(a[1], b[1], strict=True)]]


def folded(nodes: list[list], known: dict[tuple[str, ...], int] | None = None) -> list[list]:
    """nodes with every run of equal groups as one repeated group; also single groups known to repeat."""
    known = known or {}
    for size in range(1, BODY + 1):
        keys = [key(n) for n in nodes]
        out: list[list] = []
        i, n = 0, len(nodes)
        while i < n:
            body = keys[i : i + size]
            alone = tuple(body) in known
            if keys[i].startswith("<") and not keys[i].startswith("</") and len(body) == size and (alone or (i + 2 * size <= n and keys[i] == keys[i + size] and body == keys[i + size : i + 2 * size])):
                group, i = nodes[i : i + size], i + size
                while keys[i : i + size] == body:
                    group = [united(x, y) for x, y in zip(group, nodes[i : i + size], strict=True)]
                    i += size
                if out and out[-1][0] == "R" and tuple(map(key, out[-1][1])) == tuple(body):
                    out[-1] = united(out[-1], ["R", group])
                else:
                    out.append(["R", group])
            elif out and keys[i].startswith("R(") and key(out[-1]) == keys[i]:
                out[-1] = united(out[-1], nodes[i])
                i += 1
            else:
                out.append(nodes[i])
                i += 1
        nodes = out
    return nodes


def repeating(nodes: list[list], into: dict[tuple[str, ...], int]) -> dict[tuple[str, ...], int]:
    for n in nodes:
        if n[0] in "RO":
            if n[0] == "R":
                into[tuple(map(key, n[1]))] = 1
            repeating(n[1], into)
    return into


def aligned(a: list[list], b: list[list]) -> list[list]:
    """The wrapper of two wrappers (or folded pages): slots, optional and repeated groups resolve what differs."""
    known = repeating(b, repeating(a, {}))
    a, b = folded(_opened(a, known), known), folded(_opened(b, known), known)
    a, b = _grouped(a, b), _grouped(b, a)
    ka, kb = [_bare(n) for n in a], [_bare(n) for n in b]
    out: list[list] = []
    for what, i, j, k, m in SequenceMatcher(None, ka, kb, autojunk=False).get_opcodes():
        if what == "equal":
            for x, y in zip(a[i:j], b[k:m], strict=True):
                if x[0] != y[0]:  # optional on one side
                    x, y = (x if x[0] == "O" else ["O", [x]]), (y if y[0] == "O" else ["O", [y]])
                out.append(united(x, y))
        else:
            for side in (a[i:j], b[k:m]):
                if side:
                    out += [n if n[0] == "O" else ["O", [n]] for n in side] if any(n[0] == "O" for n in side) else [["O", side]]
    return out


def _grouped(nodes: list[list], other: list[list]) -> list[list]:
    """nodes with runs that are an optional group of other as such a group, the longest first."""
    for body in sorted((tuple(map(key, n[1])) for n in other if n[0] == "O" and len(n[1]) > 1), key=len, reverse=True):
        keys, out, i = [key(n) for n in nodes], [], 0
        while i < len(nodes):
            if tuple(keys[i : i + len(body)]) == body:
                out.append(["O", nodes[i : i + len(body)]])
                i += len(body)
            else:
                out.append(nodes[i])
                i += 1
        nodes = out
    return nodes


def _bare(node: list) -> str:
    """The key, the same for a single node and for that node as an optional group."""
    return key(node[1][0]) if node[0] == "O" and len(node[1]) == 1 else key(node)


def _opened(nodes: list[list], known: dict[tuple[str, ...], int]) -> list[list]:
    """Optional groups that are known to repeat stand as such groups."""
    return [["R", n[1]] if n[0] == "O" and tuple(map(key, n[1])) in known else n for n in nodes]


def expression(nodes: list[list]) -> str:
    """The wrapper as a regular expression over tokens: #PCDATA for slots, ( )? and ( )+ for groups."""
    said = {"R": "( {} )+", "O": "( {} )?"}
    return " ".join(n[1] if n[0] == "T" else (json.dumps(n[1], ensure_ascii=False) if n[1] is not None else "#PCDATA") if n[0] == "X" else said[n[0]].format(expression(n[1])) for n in nodes)


def article(nodes: list[list], slots: bool = True) -> list[str]:
    """Path of the element that holds most of the slots' text: the deepest with nine tenths of it and with their h1, menus and the like left aside.

    Without slots, or of nodes that have none, all text counts.
    """
    mass: dict[bool, dict[tuple[str, ...], float]] = {True: {}, False: {}}
    open_ = Elements()

    def walk(ns: list[list]) -> None:
        for n in ns:
            if n[0] == "T":
                m = re.match(r"<(/?)([\w:-]+)(?:\.(.*))?>$", n[1], re.S)
                open_.see("close" if m[1] else "open", m[2], m[3] or "")
            elif n[0] == "X":
                if open_.fine():
                    of = mass[n[1] is None]
                    of[open_.path()] = of.get(open_.path(), 0) + n[2]
            else:
                walk(n[1])

    walk(nodes)
    held = mass[True]
    if not slots or not held:
        held = {p: mass[True].get(p, 0) + mass[False].get(p, 0) for p in mass[True] | mass[False]}
    total = sum(held.values())
    below: dict[tuple[str, ...], float] = {}
    for path, v in held.items():
        for k in range(1, len(path) + 1):
            below[path[:k]] = below.get(path[:k], 0) + v
    best = max((p for p, v in below.items() if v >= 0.9 * total), key=len, default=())
    for path in held:
        if any(k.split(".")[0] == "h1" for k in path):
            best = tuple(x for x, y in itertools.takewhile(lambda z: z[0] == z[1], zip(best, path, strict=False)))
    # Never a single paragraph: the element around it.
    while best and best[-1].split(".")[0] in ("p", "b", "i", "em", "strong", "span", "a", "h1", "h2", "h3", "li"):
        best = best[:-1]
    return list(best)


def constants(nodes: list[list], least: int = 2) -> list[str]:
    """Texts of the template: the same wherever they stand, on least pages or more, while some slot differs. Texts in repeated groups stand several times on a page and don't count."""
    same, differ = [], False
    todo = [(n, False) for n in nodes]
    while todo:
        n, repeated = todo.pop()
        if n[0] == "X":
            differ |= n[1] is None
            if n[1] is not None and n[3] >= least and not repeated:
                same.append(n[1])
        elif n[0] != "T":
            todo += [(m, repeated or n[0] == "R") for m in n[1]]
    return sorted(set(same)) if differ else []


def main_text(page: str, path: list[str], template: Collection[str] = ()) -> str:
    """Blocks of the page's article joined by line breaks; path is the host's article element, template its constant texts."""
    seen = list(tokens(page))
    for wanted in (path, None):
        blocks, found = _blocks(seen, wanted, template)
        if found and blocks:
            return "\n".join(blocks)
    return "\n".join(_blocks(seen, None, template, words=False)[0])


def _blocks(seen: list[tuple[str, str, str]], path: list[str] | None, template: Collection[str] = (), words: bool = True) -> tuple[list[str], bool]:
    """Blocks of text in the element at path, or in all; whether it is there. Blocks that are template text as a whole are left out."""
    open_, blocks, found = Elements(words), [], path is None
    part: list[str] = []

    def flush() -> None:
        text = " ".join("".join(part).split())
        if text and not (template and (text in template or all(" ".join(t.split()) in template for t in part if t.strip()))):
            blocks.append(text)
        part.clear()

    n = len(path or ())
    for kind, name, said in seen:
        if kind == "text":
            if (path is None or [k for k, _ in open_.stack[:n]] == path) and open_.fine():
                part.append(html.unescape(name))
            continue
        if name in BLOCK:
            flush()
        open_.see(kind, name, said)
        found = found or (len(open_.stack) == n and [k for k, _ in open_.stack] == path)
    flush()
    return blocks, found


def host(url: Column) -> Column:
    """The host of a URL in lower case; empty for null or what has none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _fold_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHAPES: the distinct folded streams of a partition, with their pages and characters of text; and the blocks that all of the host's pages in it share."""
    seen: dict[tuple[str, str], list] = {}
    common: dict[str, set[str]] = {}

    def rows() -> pa.RecordBatch:
        of = [(h, shape, json.dumps(nodes), pages, chars, sorted(common.get(h, ()))) for (h, shape), (nodes, pages, chars) in seen.items()]
        kinds = pa.schema([("host", pa.string()), ("shape", pa.string()), ("nodes", pa.string()), ("pages", pa.int64()), ("chars", pa.int64()), ("common", pa.list_(pa.string()))])
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in of], f.type) for k, f in enumerate(kinds)], schema=kinds)

    for batch in batches:
        for h, page in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True):
            read = list(tokens(page or ""))
            nodes = folded(stream(page or "", read))
            blocks = _blocks(read, None)[0]
            if blocks:
                common[h] = common[h] & set(blocks) if h in common else set(blocks)
            at = (h, " ".join(map(key, nodes)))
            had, pages, chars = seen.get(at, (None, 0, 0))
            seen[at] = [nodes if had is None else [united(x, y) for x, y in zip(had, nodes, strict=True)], pages + bool(blocks), chars + sum(map(len, blocks))]
        if len(seen) > 5000:
            yield rows()
            seen.clear()
            common.clear()
    if seen:
        yield rows()


def _common(frame: pd.DataFrame) -> list[str]:
    """The blocks that all pages share. Rows without pages that have text say nothing of that."""
    sets = [set(c) for c, n in zip(frame.common, frame.pages, strict=True) if n]
    return sorted(set.intersection(*sets)) if sets else []


def _one_shape(frame: pd.DataFrame) -> pd.DataFrame:
    made: list[list] | None = None
    for nodes in map(json.loads, frame.nodes):
        made = nodes if made is None else [united(x, y) for x, y in zip(made, nodes, strict=True)]
    return pd.DataFrame({"host": frame.host[:1], "shape": frame["shape"][:1], "nodes": [json.dumps(made)], "pages": [frame.pages.sum()], "chars": [frame.chars.sum()], "common": [_common(frame)]})


def _one_host(frame: pd.DataFrame) -> pd.DataFrame:
    made: list[list] | None = None
    for nodes in map(json.loads, frame.sort_values("shape").nodes):
        made = nodes if made is None else aligned(made, nodes)
    pages, common = int(frame.pages.sum()), _common(frame)
    # Pages of which most text is the same are copies of each other, and so is their template no template.
    told = pages > 1 and 2 * sum(map(len, common)) * pages < frame.chars.sum()
    template = sorted({*common, *constants(made, max(2, -(-9 * pages // 10)))}) if told else []
    return pd.DataFrame({"host": frame.host[:1], "wrapper": [expression(made)], "path": [article(made, told)], "template": [template]})


SHAPES = "host string, shape string, nodes string, pages long, chars long, common array<string>"


def infer(pages: DataFrame) -> DataFrame:
    """host, wrapper, path, template: one row for each host of pages (host, html)."""
    shapes = pages.select("host", "html").mapInArrow(_fold_pages, SHAPES)
    once = shapes.groupBy("host", "shape").applyInPandas(_one_shape, SHAPES)
    return once.groupBy("host").applyInPandas(_one_host, "host string, wrapper string, path array<string>, template array<string>")


def extract(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """The columns of pages with text and n_chars: the main text of each page.

    A null or empty page has an empty text. Pages whose url is null or has no host share a wrapper. A
    page that lacks its host's article element, or has no text in it, is read from all its elements but
    menus and the like; where class words leave nothing of it, from all but elements such as nav.
    Blocks that all of a host's pages share, or that its wrapper has on nine tenths of them, are left out.
    Repeated rows have equal results; no rows give none; pages of any length are read whole. Columns
    named text or n_chars are replaced.
    """
    pages = pages.drop("text", "n_chars").withColumn("_host", host(F.col(url)))
    wrappers = cut(infer(pages.select(F.col("_host").alias("host"), F.col(page).alias("html"))))
    known = wrappers.select(F.col("host").alias("_host"), F.col("path").alias("_path"), F.col("template").alias("_template"))
    joined = attach(pages, known, ["_host"], wrappers.count(), "left").drop("_host")
    names = joined.columns[:-2]
    at = names.index(page)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(t or "", p or [], frozenset(c or ())) for t, p, c in zip(*(batch.column(k).to_pylist() for k in (at, len(names), len(names) + 1)), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*names, "text", "n_chars"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema[:-2])
    return joined.mapInArrow(run, f"{fields}, text string, n_chars long")
