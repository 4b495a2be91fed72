"""HTML extraction by consensus host paths.

Each page's containers are scored by the text they hold outside links and furniture; the best one votes, with its
generalised tag-class path (digits dropped), for its host. Spark sums the votes, and each page is extracted again
from the elements on its host's winning path, or from its own best container where that path is not on the page.

Defined cases: null or empty html gives ''; a page without a good container gives its whole body without furniture;
a null url counts as the host ''; repeated rows are each extracted; ties between paths go to the smaller path.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMALL = 100_000
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|iframe|svg|object|title)\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>?|<[!?][^>]*>?|[^<]+|<", re.S | re.I)
ATTRS = re.compile(r"(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
SPACE = re.compile(r"\s+")
DIGITS = re.compile(r"\d+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HOLDERS = frozenset("article body div main section td blockquote center".split())
FURNITURE = frozenset("nav aside footer header form button select option fieldset dialog menu head input label".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
NAMES = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|sidebar|side|menu|nav\w*|breadcrumbs?|footer|header|masthead|comments?|disqus|respond|replies|reply|share|sharing|social|related|recommend\w*|more|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|login|form|search|pagination|pager|widget|tags?|meta|byline|toolbar|skip\w*|copyright)(?=$|[\s_-])", re.I)
#: An element of these names ends an open one of those.
CLOSES = {"p": frozenset("p".split()), "li": frozenset(("li", "p")), "td": frozenset(("td", "th", "p")), "th": frozenset(("td", "th", "p")), "tr": frozenset(("tr", "td", "th", "p")), "dt": frozenset(("dt", "dd", "p")), "dd": frozenset(("dt", "dd", "p")), "option": frozenset(("option",))}
STOPS = {"li": frozenset(("ul", "ol", "menu")), "td": frozenset(("table",)), "th": frozenset(("table",)), "tr": frozenset(("table",)), "dt": frozenset(("dl",)), "dd": frozenset(("dl",))}
P_ENDS = BLOCK - {"body", "html"}


class Node:
    """An element: its part of the path, its depth in the path, and the element that holds its text."""

    __slots__ = ("own", "parent", "depth", "holder", "skip", "tag", "text", "linked", "paras")

    def __init__(self, tag, own, parent, skip):
        self.tag, self.own, self.parent, self.skip = tag, own, parent, skip
        self.depth = parent.depth + 1 if parent is not None else 0
        self.holder = self if parent is None or tag in HOLDERS else parent.holder
        self.text = self.linked = self.paras = 0


def path_of(node: Node) -> str:
    parts = []
    while node.parent is not None:
        parts.append(node.own)
        node = node.parent
    return ">".join(reversed(parts))


def parse(page: str) -> tuple[list[Node], list[tuple[Node, str, bool]]]:
    """The containers in page order, and the pieces of text (nearest container, text or a break, in a link)."""
    root = Node("html", "html", None, False)
    nodes, out = [root], []
    stack: list[tuple[str, Node]] = [("html", root)]
    opened: Counter[str] = Counter()  # of the stack but its first: what isn't open needn't be searched for
    for m in TOKEN.finditer(page):
        tag = m[3]
        if tag is None:
            s = m[0]
            if m[1] is None and (s[0] != "<" or s == "<"):
                out.append((stack[-1][1], s, opened["a"] > 0))
            continue
        tag = tag.lower()
        if m[2]:
            if opened[tag]:
                while stack[-1][0] != tag:
                    opened[stack.pop()[0]] -= 1
                opened[stack.pop()[0]] -= 1
            if tag in BLOCK:
                out.append((stack[-1][1], "\n", False))
            continue
        if tag in P_ENDS:
            ends = CLOSES.get(tag, CLOSES["p"])
            stop = STOPS.get(tag, frozenset())
            for i in range(len(stack) - 1, 0, -1) if any(opened[t] for t in ends) else ():
                t = stack[i][0]
                if t in ends:
                    opened.subtract(x[0] for x in stack[i:])
                    del stack[i:]
                elif t in stop or t in HOLDERS or t in FURNITURE:
                    break
        up = stack[-1][1]
        if tag in BLOCK or tag == "br":
            out.append((up, " " if tag == "br" else "\n", False))
        if tag in VOID or m[4].rstrip().endswith("/"):
            continue
        node = up
        if tag in BLOCK or tag in FURNITURE:
            attrs = {k.lower(): v.strip("\"'") for k, v in ATTRS.findall(m[4])} if m[4] else {}
            named = attrs.get("class", "")
            inside = opened["article"] + opened["main"] > 0
            furniture = (tag in FURNITURE and not (tag == "header" and inside)) or attrs.get("role", "").lower() in ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attrs.get("style", ""))
            furniture = furniture or (tag not in ("body", "html", "article", "main") and bool(NAMES.search(named) or NAMES.search(attrs.get("id", ""))))
            own = DIGITS.sub("", tag + "".join(f".{c}" for c in sorted(named.lower().replace(">", "").split()))) if tag not in ("h1", "h2", "h3", "h4", "h5", "h6") else tag
            node = Node(tag, own, up, up.skip or bool(furniture))
            nodes.append(node)
        stack.append((tag, node))
        opened[tag] += 1
    return nodes, out


def best_path(nodes: list[Node], out: list[tuple[Node, str, bool]]) -> tuple[str, float]:
    """The path of the best container and its score: the text it holds outside links, each level up paying a third
    of what it adds, so that the tightest container of the main text wins."""
    for node, s, linked in out:
        n = len(s.strip())
        if n and not node.skip:
            holder = node.holder
            holder.linked += n * linked
            holder.text += n * (not linked)
            holder.paras += node is not holder and n > 40
    total: dict[int, float] = {}
    for node in reversed(nodes):
        if node.skip or node.tag not in HOLDERS and node.parent is not None:
            below = 0.0
        else:
            below = node.text * (1 - node.linked / max(1, node.linked + node.text))
        got = total[id(node)] = total.get(id(node), 0.0) + below
        if node.parent is not None and not node.skip:
            total[id(node.parent)] = total.get(id(node.parent), 0.0) + got * (1.0 if node.tag not in HOLDERS else 0.67)
    bonus = {"article": 1.5, "main": 1.3, "body": 0.9}
    ranked = [(total[id(n)] * bonus.get(n.tag, 1.0), n) for n in nodes if n.tag in HOLDERS and not n.skip]
    score = max((s for s, _ in ranked), default=0.0)
    if score <= 0:
        return "", 0.0
    return max({path_of(n) for s, n in ranked if s == score}, key=lambda p: [-ord(c) for c in p]), score


def text_on(nodes: list[Node], out: list[tuple[Node, str, bool]], path: str) -> str:
    """The blocks of the elements on path, without furniture; of the whole page for ''."""
    inside, parts = {}, path.split(">") if path else []
    along = {id(nodes[0]): True} if nodes else {}  # the path leads through the node
    for node in nodes:  # parents come first
        up = node.parent
        if up is not None:
            along[id(node)] = along[id(up)] and node.depth <= len(parts) and node.own == parts[node.depth - 1]
        here = along[id(node)] and node.depth == len(parts)
        inside[id(node)] = not node.skip and (here or not path or (up is not None and inside[id(up)]))
    blocks, now = [], []
    last = None
    for node, s, _ in out:
        if s == "\n" or node is not last:
            if now:
                blocks.append("".join(now))
                now = []
            last = node
        if s != "\n" and inside[id(node)]:
            now.append(s)
    if now:
        blocks.append("".join(now))
    cleaned = (SPACE.sub(" ", entities.unescape(b)).strip() for b in blocks)
    return "\n".join(b for b in cleaned if b)


def votes(pages: DataFrame) -> DataFrame:
    """host, path, pages, weight: the votes of the pages' best containers, summed."""

    def rows(batches):
        for b in batches:
            got = [best_path(*parse(x.as_py())) if x.is_valid else ("", 0.0) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([p for p, _ in got]), pa.array([s for _, s in got], pa.float64())], ["host", "path", "score"])

    voted = pages.select("host", "html").mapInArrow(rows, "host string, path string, score double").where("path <> ''")
    return voted.groupBy("host", "path").agg(F.count("*").alias("pages"), F.sum(F.log1p("score")).alias("weight"))


def with_host(pages: DataFrame) -> DataFrame:
    return pages.withColumn("host", F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit("")))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, path, text: one row per page."""
    pages = with_host(pages.select("page_id", "url", "html"))
    # round: the sum of logs depends on the order of the rows in its last bits
    win = votes(pages).groupBy("host").agg(F.max_by("path", F.struct(F.round("weight", 3), F.col("pages"), F.col("path"))).alias("path"))
    from .shared import written

    win = written(win, "host-paths")
    joined = pages.join(F.broadcast(win) if win.count() <= SMALL else win, "host", "left")

    def rows(batches):
        for b in batches:
            paths, texts = [], []
            for x, p in zip(b.column(2), b.column(3).to_pylist()):
                nodes, out = parse(x.as_py()) if x.is_valid else ([], [])
                text = text_on(nodes, out, p) if p else ""
                if not text:
                    p, _ = best_path(nodes, out)
                    text = text_on(nodes, out, p)
                paths.append(p)
                texts.append(text)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(paths, pa.string()), pa.array(texts, pa.string())], ["page_id", "url", "path", "text"])

    return joined.select("page_id", "url", "html", "path").mapInArrow(rows, "page_id long, url string, path string, text string")
