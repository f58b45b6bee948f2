"""Main-text extraction by union-free regular-expression inference (page wrappers).

Pages are read as balanced streams of tags and texts.  The streams of a host are aligned into one wrapper: on each level the runs of
equal neighbours are matched by name and by which run of that name it is.  A run of several elements makes a repeated group, a run that
some streams lack an optional group; texts that differ make a slot, and runs whose whole text is the same on all pages are template.
Alignment adds up counts and compares digests, so it is associative and commutative: a host's wrapper is the same however its pages
are dealt over tasks, and it takes time in proportion to the streams.

The wrapper decides what is read from a page: the region with the article (the article or main element with the most varying text, or
the densest block of slots) without its template runs.  Elements that are never article text (menus, forms, scripts) are left out; class
and id names that say so are believed only where the wrapper finds most of the region's varying text outside of them.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from augurline.llm import textops
from augurline.llm.cluster import stored

# Fixed values of HTML and of common page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("head script style noscript template iframe svg math nav header footer aside form button select textarea input dialog object embed audio video canvas menu title".split())
CLOSED_BY_BLOCK = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES = {
    "li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",)),
}
# Parts of class and id names: a name is furniture if all its parts are in these two lists and one in the first.
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsors sponsored promo promos promotion banner banners cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup login comment comments commentlist disqus replies respond sidebar widget widgets menu nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar footer header masthead topbar share sharing social related recommended recommendations tags tagcloud skip search".split()
)
NEUTRAL = frozenset("top bottom left right primary secondary site page box block section area wrap wrapper container inner outer list lists item items link links bar button buttons slot unit row col form title head posts post mini small large mobile desktop global local main id".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.DOTALL)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
PARTS = frozenset("li dt dd tr td th option".split())
DEEPEST = 400
BLANK = " \t\n\r\f\v"


class Node:
    __slots__ = ("children", "name", "noise")

    def __init__(self, name: str, noise: int = 0):
        self.name, self.noise, self.children = name, noise, []


def named_furniture(name: str) -> bool:
    parts = [x for x in re.split(r"[-_]+|(?<=[a-z])(?=[A-Z])", name) if x]
    parts = [x.lower() for x in parts if not x.isdigit()]
    return any(x in FURNITURE for x in parts) and all(x in FURNITURE or x in NEUTRAL for x in parts)


def element(tag: str, raw: str) -> Node:
    """A node named by tag and class; noise is 2 where tag, role or hiding make it page furniture, 1 where only its names say so."""
    of: dict[str, str] = {}
    if raw.strip(" /"):
        for m in ATTRIBUTE.finditer(raw):
            of.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    noise = 0
    if tag in DROPPED or of.get("role", "").lower() in ROLES or "hidden" in of or of.get("aria-hidden") == "true":
        noise = 2
    elif of and tag not in ("body", "html", "article", "main"):
        noise = int(any(map(named_furniture, [*of.get("class", "").split(), *of.get("id", "").split()])))
    return Node(".".join([tag, *sorted(of.get("class", "").lower().split())]) if of else tag, noise)


def tree(html: str) -> Node:
    """The balanced stream of a page as a tree; end tags that are missing or stray are put right, texts are decoded.

    Never raises: broken tags are texts or end with the page.  Elements deeper than DEEPEST are read flat, into the last node above
    them, or into their own if they are noise; a #deep node is where such a block begins or ends.
    """
    root = Node("#root")
    stack, tags, at = [root], ["#root"], 0
    is_open: Counter[str] = Counter()

    def close(depth: int) -> None:
        is_open.subtract(tags[depth:])
        if any(t not in INLINE for t in tags[max(depth, DEEPEST) :]):
            stack[max(depth, DEEPEST) - 1].children.append(Node("#deep"))
        del stack[depth:], tags[depth:]

    while at < len(html):
        m = TAG.search(html, at)
        text = html[at : m.start() if m else len(html)]
        if text.strip(BLANK) or text and stack[-1].children:
            stack[-1].children.append(entities.unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                stack[-1].children.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:
            if is_open[tag]:
                for depth in range(len(tags) - 1, 0, -1):
                    if tags[depth] == tag:
                        close(depth)
                        break
                    if tag in INLINE and (tags[depth] in CLOSED_BY_BLOCK or tags[depth] in ("td", "th", "li", "body")):
                        break
            elif tag == "p":
                stack[-1].children.append(Node("p"))
            continue
        if tag in CLOSED_BY_BLOCK and is_open["p"]:
            for depth in range(len(tags) - 1, 0, -1):
                if tags[depth] == "p":
                    close(depth)
                    break
                if tags[depth] in ("table", "td", "th", "li", "div", "article", "section", "button"):
                    break
        if tag in CLOSES:
            ended, limits = CLOSES[tag]
            ended = ended.split()
            for depth in range(len(tags) - 1, 0, -1) if any(is_open[t] for t in ended) else ():
                if tags[depth] in limits:
                    break
                if tags[depth] in ended:
                    close(depth)
        if tag == "body" and is_open["head"]:
            for depth in range(1, len(tags)):
                if tags[depth] == "head":
                    close(depth)
                    break
        node = element(tag, m[3] or "")
        if len(stack) < DEEPEST or node.noise or tag in VOID or tag in RAW:
            stack[-1].children.append(node)
        elif tag not in INLINE:
            stack[-1].children.append(Node("#deep"))
        if tag in VOID or (m[3] or "").endswith("/") and tag in RAW:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|$)[^>]*>?", re.IGNORECASE).search(html, at)
            body = html[at : end.start() if end else len(html)]
            at = end.end() if end else len(html)
            if tag in ("title", "textarea"):
                node.children.append(entities.unescape(body))
            continue
        flat = len(stack) >= DEEPEST and (stack[-1] is not stack[DEEPEST - 1] or not node.noise)
        stack.append(stack[-1] if flat else node)
        tags.append(tag)
        is_open[tag] += 1
    return root


# A wrapper of a run is a list with these places.  runs and elements count how often the run and its elements occur, longest is the
# most elements of one run, pages the pages that have it; chars sums up its own text, same is that text and whole the digest of all text
# below where all pages agree so far (None where they don't); heads and tails are the digests of the elements that all pages' runs begin
# and end with, the latter from the end; first and last are the lowest and highest place among its siblings; items are the runs below it
# by key.
RUNS, ELEMENTS, LONGEST, PAGES, NOISE, CHARS, SAME, WHOLE, HEADS, TAILS, FIRST, LAST, ITEMS = range(13)


def runs_of(node: Node) -> list[tuple[str, list[Node]]]:
    """The runs of equal neighbours among a node's elements, with a key each: the name, and how many runs of that name came before."""
    out: list[tuple[str, list[Node]]] = []
    seen: Counter[str] = Counter()
    last = None
    for child in node.children:
        if isinstance(child, str):
            continue
        if child.name == last:
            out[-1][1].append(child)
        else:
            last = child.name
            out.append((f"{last}#{seen[last]}", [child]))
            seen[last] += 1
    return out


def digest(parts: list[str]) -> str:
    parts = [p for p in parts if p]
    return parts[0] if len(parts) == 1 else xxhash.xxh64_hexdigest("\x1f".join(parts)) if parts else ""


def shape(nodes: list[Node], place: int = 0) -> list:
    """The wrapper of a run of one page."""
    whole, each = None, []
    for node in nodes:
        items = {key: shape(run, k) for k, (key, run) in enumerate(runs_of(node))}
        plain = " ".join("".join(c for c in node.children if isinstance(c, str)).split())
        same = plain if len(plain) <= 80 else f"#{xxhash.xxh64_hexdigest(plain)}"
        own = [1, 1, 1, 1, node.noise, len(plain), same, digest([same, *(i[WHOLE] for i in items.values())]), [], [], place, place, items]
        each.append(own[WHOLE])
        whole = own if whole is None else merged(whole, own, True)
    whole[RUNS], whole[LONGEST], whole[HEADS], whole[TAILS] = 1, len(nodes), each, each[::-1]
    return whole


def common(a: list[str], b: list[str]) -> list[str]:
    n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a if n == len(a) else a[:n]


def merged(a: list, b: list, beside: bool = False) -> list:
    """Two wrappers of a run in one: of different pages, or of elements beside each other on one page."""
    items = a[ITEMS]
    for key, item in b[ITEMS].items():
        items[key] = merged(items[key], item, beside) if key in items else item
    return [
        a[RUNS] + b[RUNS], a[ELEMENTS] + b[ELEMENTS], max(a[LONGEST], b[LONGEST]), max(a[PAGES], b[PAGES]) if beside else a[PAGES] + b[PAGES], min(a[NOISE], b[NOISE]), a[CHARS] + b[CHARS],
        a[SAME] if a[SAME] == b[SAME] else None, digest([a[WHOLE], b[WHOLE]]) if beside else a[WHOLE] if a[WHOLE] == b[WHOLE] else None,
        [] if beside else common(a[HEADS], b[HEADS]), [] if beside else common(a[TAILS], b[TAILS]), min(a[FIRST], b[FIRST]), max(a[LAST], b[LAST]), items,
    ]


def ordered_items(item: list) -> list[tuple[str, list]]:
    return sorted(item[ITEMS].items(), key=lambda x: (x[1][FIRST], x[1][LAST], x[0]))


def pattern(item: list, key: str = "#root", parent: int = 1) -> str:
    """The wrapper as a regular expression over tags and text slots."""
    name = key.rpartition("#")[0] or key
    times = {(False, False): "", (True, False): "?", (False, True): "+", (True, True): "*"}[item[RUNS] < parent, item[LONGEST] > 1]
    inner = ("#TEXT " if item[SAME] is None else f"{item[SAME]} " if item[SAME] else "") + " ".join(pattern(i, k, item[ELEMENTS]) for k, i in ordered_items(item))
    return f"(<{name}> {inner.strip()} </{name}>){times}"


def weight(item: list, words: bool, every: bool = False) -> int:
    """Characters of texts that vary between pages (or of all texts), outside furniture; words: believe class and id names."""
    if item[NOISE] >= (1 if words else 2) or not every and item[PAGES] > 1 and item[WHOLE] is not None:
        return 0
    own = item[CHARS] if every or item[SAME] is None or item[PAGES] == 1 else 0
    return own + sum(weight(i, words, every) for i in item[ITEMS].values())


def region(item: list, words: bool, every: bool) -> list[str]:
    """The path of keys to the run that holds the article: an article or main element, or the densest block of slots."""
    marked: list[tuple[int, list[str]]] = []
    least = 1 if words else 2

    def look(x: list, path: list[str]) -> None:
        if x[NOISE] >= least:
            return
        if path and tag_of(path[-1]) in ("article", "main"):
            marked.append((weight(x, words, every), path))
            if tag_of(path[-1]) == "article":
                return
        for key, y in ordered_items(x):
            look(y, [*path, key])

    look(item, [])
    articles = [p for p in marked if tag_of(p[1][-1]) == "article"] or marked
    if articles:
        return max(articles, key=lambda p: p[0])[1]
    path: list[str] = []
    while True:
        total = weight(item, words, every)
        found = [(weight(x, words, every), key, x) for key, x in ordered_items(item) if x[NOISE] < least]
        if total == 0 or not found:
            return path
        heaviest, key, below = max(found, key=lambda x: x[0])
        # stop where the text is spread over blocks, or is the element's own, or is a repeated group
        if below[LONGEST] > 1 or heaviest < 0.7 * total or tag_of(key) in INLINE | {"p"}:
            return path
        item = below
        path.append(key)


def tag_of(key: str) -> str:
    return re.split(r"[.#]", key, maxsplit=1)[0]


def templates(item: list, pages: int, words: bool) -> dict:
    """The uppermost runs that have the same text on all pages that have them, most pages of the host: {key: digest or runs below}.

    Of a run that varies, the elements that it begins and ends with on all pages are template as well: their numbers are at key "".
    Items of lists and cells of tables aren't taken apart so.
    """
    found = {}
    for key, x in item[ITEMS].items():
        if x[NOISE] >= (1 if words else 2) or x[WHOLE] == "":
            continue
        often = x[PAGES] >= 3 and 2 * x[PAGES] >= pages
        if x[WHOLE] is not None:
            if often:
                found[key] = x[WHOLE]
        else:
            below = templates(x, pages, words)
            if often and tag_of(key) not in PARTS and (x[HEADS] or x[TAILS]):
                below[""] = [len(x[HEADS]), len(x[TAILS])]
            if below:
                found[key] = below
    return found


def plan(item: list) -> dict:
    """What a wrapper says about its pages: the region's path, the template runs, and whether class and id names are believed."""
    every = item[PAGES] == 1 or weight(item, False) == 0
    path = region(item, True, every)
    inner = item
    for key in path:
        inner = inner[ITEMS][key]
    words = 10 * weight(inner, True, every) >= weight(inner, False, every)
    if not words:
        path = region(item, False, every)
    return {"path": path, "words": words, "templates": {} if every else templates(item, item[PAGES], words)}


def blocks_of(node: Node, item: list, same: dict, words: bool) -> tuple[list[str], list[str]]:
    """The texts of a region, a string for each block: without template runs, and with them."""
    out: list[str] = []
    plain: list[str] = []
    current: list[tuple[str, bool]] = []
    least = 1 if words else 2

    def flush() -> None:
        for texts, kept in ((out, False), (plain, True)):
            if text := " ".join("".join(c for c, template in current if kept or not template).split(None)):
                texts.append(text)
        current.clear()

    def walk(x: Node, item: list, same: dict, template: bool) -> None:
        keys = {id(n): (key, k, len(run) - 1 - k) for key, run in runs_of(x) for k, n in enumerate(run)} if same else {}
        for child in x.children:
            if isinstance(child, str):
                current.append((child, template))
            elif child.noise < least:
                key, before, after = keys.get(id(child), (None, 0, 0))
                below = same.get(key, {})
                inner = item[ITEMS][key] if below else item
                if isinstance(below, dict):
                    heads, tails = below.get("", (0, 0))
                    fixed = template or before < heads or after < tails
                else:
                    fixed, below = template or below == inner[WHOLE], {}
                tag = tag_of(child.name)
                if tag == "br":
                    current.append(("\n", False))
                elif tag in INLINE:
                    walk(child, inner, below, fixed)
                else:
                    flush()
                    walk(child, inner, below, fixed)
                    flush()

    walk(node, item, same, False)
    flush()
    return out, plain


def inside(root: Node, item: list, path: list[str], same: dict, least: int) -> list[tuple[Node, list, dict]]:
    """All elements at a path of names, in page order, with their run's wrapper on this page and the template runs below."""
    now = [(root, item, same)]
    for key in path:
        name, below = key.rpartition("#")[0], []
        for x, of, fixed in now:
            for own, run in runs_of(x):
                if run[0].name == name:
                    down = fixed.get(own, {})
                    below += [(n, of[ITEMS][own], down if isinstance(down, dict) else {}) for n in run if n.noise < least]
        now = below
    return now


def extract(html: str, wrapper: dict | None) -> str:
    """The article of a page by its host's plan, or by that of a wrapper of this page alone where the page lacks the region."""
    root = tree(html)
    item = shape([root])
    for what in (wrapper, None):
        what = what or plan(item)
        found = [blocks_of(x, own, same, what["words"]) for x, own, same in inside(root, item, what["path"], what["templates"], 1 if what["words"] else 2)]
        # a region that is template as a whole is still the article
        if blocks := [b for x, _ in found for b in x] or [b for _, x in found for b in x]:
            return "\n\n".join(blocks)
    return "\n\n".join(blocks_of(root, item, {}, True)[1])


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def infer(pages: DataFrame, parts: int = 64, most: int = 200_000) -> DataFrame:
    """(host, wrapper): one wrapper per host, over all its pages.

    Each task aligns the pages of each host it meets, so a host sends a wrapper per task, or more where a task's wrappers pass `most`
    elements; these are aligned in groups of `parts` places and then together, so that a host with most of all pages meets nowhere as a
    whole.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size, part = 0, TaskContext.get().partitionId()

        def send() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([part] * len(held), pa.int32()), pa.array([json.dumps(w) for w in held.values()])], ["host", "part", "wrapper"])

        for batch in textops.small_batches(batches, "html"):
            for host, html in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
                if not html:
                    continue
                host, own = host_of(host), shape([tree(html)])
                if host in held:
                    held[host] = merged(held[host], own)
                else:
                    held[host] = own
                    size += html.count("<")
                if size > most:
                    yield send()
                    held, size = {}, 0
        if held:
            yield send()

    def together(table: pa.Table) -> pa.Table:
        whole = None
        for chunk in table.column("wrapper").chunks:
            for text in chunk:
                own = json.loads(text.as_py())
                whole = own if whole is None else merged(whole, own)
        return pa.table([table.column("host").combine_chunks()[:1], pa.array([json.dumps(whole)])], ["host", "wrapper"])

    first = pages.mapInArrow(textops.trimmed(local), "host string, part int, wrapper string")
    some = first.groupBy("host", F.expr(f"part % {parts}").alias("group")).applyInArrow(together, "host string, wrapper string")
    return some.groupBy("host").applyInArrow(together, "host string, wrapper string")


def articles(pages: DataFrame, salts: int = 32) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html), from its host's wrapper.

    Null and empty pages have an empty text; null and broken addresses are one host of their own; a page that its host's region
    doesn't fit is read by a wrapper of its own.  Repeated rows stay; other columns are ignored, whatever their names; an empty table
    gives no rows; whole pages are read, however long.
    """
    rows = pages.select("page_id", "url", "html")

    @F.pandas_udf("string")
    def host(urls):
        return urls.map(host_of, na_action=None)

    def plans(table: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in table:
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array([json.dumps(plan(json.loads(w))) for w in batch.column("wrapper").to_pylist()])], ["host", "plan"])

    # Stored, so that Spark knows the size: it broadcasts the plans below its own limit, and else the salted hosts spread their pages.
    found = stored(infer(rows).mapInArrow(textops.trimmed(plans), "host string, plan string"), "wrappers").withColumn("salt", F.explode(F.expr(f"sequence(0L, {salts - 1}L)")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict] = {}
        for batch in textops.small_batches(batches, "html"):
            texts = []
            for page, text in zip(batch.column("html").to_pylist(), batch.column("plan").to_pylist(), strict=True):
                if text and text not in known:
                    if len(known) > 200:
                        known.clear()
                    known[text] = json.loads(text)
                texts.append(extract(page, known[text] if text else None) if page else "")
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = dict(rows.dtypes)["page_id"]
    salted = rows.withColumn("host", host("url")).withColumn("salt", F.expr(f"pmod(xxhash64(page_id), {salts}L)"))
    return salted.join(found, ["host", "salt"], "left").mapInArrow(textops.trimmed(read), f"page_id {kind}, url string, text string, n_chars long")
