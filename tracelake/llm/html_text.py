"""Main text of web pages by consensus of each host's pages.

Every page scores its containers: text counts for the nearest container above
it, text in links against that one, and what a container has left over counts
for all above it too.  The best is the lowest that holds most of the page's
text, or the whole that it is a part of (see :func:`_score`).  A container has a
generalised path of tags and classes without digits.  In Spark the pages of a
host vote, each for the path of its best container; each page
is then read again, and the text under the host's winning path is taken (under
its own best container where it has no such path, or where that path is but a
part of it), with what stands directly in the containers around it up to the
article or main element: a heading, a lead, not another container's text.

The host's pages also tell furniture: a path below the winning one that
``SEEN`` pages or more have with one and the same text, or that is links for
the most part, is left out on all of them.  A host with any number of pages
costs each task one row for a path.

On a page furniture is told by its element, or by a class, id or role that has
no words but those of furniture and of layout: ``comment-list`` is, and
``social-history`` is not.  Names give way where the element holds the page's
main element or first article, within an article also its first heading, and
where it holds nearly all of the page's text; weaker signs (forms, shares,
widgets and the like) to any first heading and to half of the text.

Reading is linear in the page, whatever is broken in it.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialise, pieces

# fixed values: element names of HTML by their role
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article body div main section td blockquote center details".split())
#: Containers that are parts of a text rather than all of it.
PARTS = frozenset("blockquote center details section td".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Nothing under these is text of a page.
HIDDEN = frozenset("head script style noscript template iframe object svg math canvas audio video select textarea button datalist title".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
#: Page furniture by its element.
FURNITURE = frozenset("nav footer aside form menu dialog".split())
#: Page furniture by the words of a class, an id or a role.
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies copyright disclaimer disqus "
    "discussion feedback footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification pagination pager paywall popup promo "
    "promoted promotion reactions reader readers recirc recommended related replies reply respond responses search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toc toolbar widget".split()
)
#: Words of layout that may stand beside those in one name.
LAYOUT_WORDS = frozenset(
    "area aside bar block body bottom box btn button buttons cell col column container content footer global group head icon icons inner item items left links list main message "
    "module outer page panel post posts primary right row secondary section site slot story text thread title top unit user users view wrap wrapper".split()
)
#: Signs of furniture that give way to signs of a main text.
WEAK_WORDS = frozenset("form notice search share sharing social tags widget".split())
#: Words of what readers add to a page.
COMMENT_WORDS = frozenset("comment comments discussion disqus feedback reactions reader readers replies reply respond responses".split())
#: Pages of a host with one text under a path that make it furniture.
SEEN = 3
#: Tags whose end isn't found, after which quotes no longer count in the page.
BROKEN = 8
#: An open element is closed by these openings.
CLOSES = {
    "p": BLOCKS,
    "li": frozenset({"li"}),
    "dt": frozenset({"dt", "dd"}),
    "dd": frozenset({"dt", "dd"}),
    "tr": frozenset({"tr", "tbody", "tfoot"}),
    "td": frozenset({"td", "th", "tr", "tbody", "tfoot"}),
    "th": frozenset({"td", "th", "tr", "tbody", "tfoot"}),
    "option": frozenset({"option", "optgroup"}),
}

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_REST = re.compile(r"""(?:"[^"]*"|'[^']*'|[^'">]++)*+>""", re.S)
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|$)""", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


class Node:
    """An open or closed element: the step of its path, what it stands in, and what it has been scored."""

    __slots__ = ("tag", "step", "parent", "container", "above", "depth", "score", "dropped", "linked", "inside", "head", "named", "outer", "kind", "holds", "size", "page", "match")

    def __init__(self, tag: str, step: str, parent: "Node | None"):
        self.tag, self.step, self.parent = tag, step, parent
        self.container = parent.container if parent else self
        self.dropped, self.linked, self.inside, self.head = (parent.dropped, parent.linked, parent.inside, parent.head) if parent else (False, False, False, False)
        #: Of a container: the next one above it, how many are, its score, whether it has a page's navigation or foot in it.
        self.above, self.depth, self.score, self.page = None, 0, 0.0, False
        #: The nearest furniture by name that it stands in; of that, the next around it, its kind, whether it holds signs of the main text, its text out of links.
        self.named = parent.named if parent else None
        self.outer, self.kind, self.holds, self.size = None, None, False, 0
        #: Steps of a path that its own agree with.
        self.match = 0

    def path(self) -> str:
        steps, x = [], self
        while x.parent is not None:
            steps.append(x.step)
            x = x.parent
        return "".join(f"/{x}" for x in reversed(steps))


def _attributes(raw: str) -> tuple[list[str], list[frozenset[str]], bool]:
    """Words of class, id and role without digits, in all and by name; whether the element is hidden."""
    words: list[str] = []
    names: list[frozenset[str]] = []
    hidden = False
    for name, a, b, c in _ATTR.findall(raw):
        value = (a or b or c).lower()
        if name.lower() in ("class", "id", "role"):
            for one in value.split():
                found = _WORD.findall(one)
                words += found
                names.append(frozenset(found))
        else:
            hidden |= name.lower() == "hidden" or value == "true"
    return words, names, hidden


def _furniture(tag: str, names: list[frozenset[str]], inside: bool) -> str | None:
    """``strong`` or ``weak`` furniture, by its ``name``, a ``head``, or none; ``inside`` an article or main element headers belong to the text."""
    if tag in FURNITURE:
        return "weak" if tag == "form" else "strong"
    if tag == "header" and not inside:
        return "head"
    if tag in ("html", "body", "main"):
        return None
    kind = None
    for words in names:
        told = words & FURNITURE_WORDS
        if inside and "article" not in words:
            told -= {"header"} if len(told) == 1 else set()
        if tag == "article":
            told &= COMMENT_WORDS
        if told and words <= FURNITURE_WORDS | LAYOUT_WORDS:
            if told & COMMENT_WORDS:
                return "strong"
            if kind != "name":
                kind = "weak" if told <= WEAK_WORDS else "name"
    return kind


def _tags(page: str) -> Iterator[tuple[int, int, str | None, bool, str]]:
    """Begin, end, name (null for comments and declarations), whether it closes, and the rest of each tag.

    Quotes in a tag may hold its end.  Where such a tag has none it is text;
    after ``BROKEN`` of these a tag ends at the next ``>``.
    """
    at, broken, last = 0, 0, page.rfind(">")
    while (i := page.find("<", at)) >= 0:
        at = i + 1
        if page.startswith("<!--", i):
            end = page.find("-->", i + 4)
            at = len(page) if end < 0 else end + 3
            yield i, at, None, False, ""
        elif i > last:
            if page.find("<!--", i) < 0:
                return
        elif page[i + 1 : i + 2] in ("!", "?"):
            at = page.index(">", i) + 1
            yield i, at, None, False, ""
        elif m := _NAME.match(page, i):
            rest = _REST.match(page, m.end()) if broken < BROKEN else None
            if rest is None:
                broken += 1
                if broken < BROKEN or (end := page.find(">", m.end())) < 0:
                    continue
                at = end + 1
            else:
                at = rest.end()
            skip = yield i, at, m[2].lower(), bool(m[1]), page[m.end() : at - 1]
            if skip is not None:
                at = skip


def read_page(page: str) -> list[tuple[Node, str | None]]:
    """Runs of text in page order with the element that they stand in, without furniture.

    Each block's beginning and end is a run of its own, ``None`` as text.
    Text of headers outside articles is there, under nodes with ``head``.
    """
    root = Node("", "", None)
    stack, runs, at, headed, articled = [root], [], 0, False, False
    open_: dict[str, int] = {}
    named: list[Node] = []
    tags, skip = _tags(page), None

    def close() -> None:
        open_[stack.pop().tag] -= 1

    while True:
        try:
            i, end, tag, closes, rest = tags.send(skip) if skip is not None else next(tags)
        except StopIteration:
            break
        skip = None
        if i > at and not stack[-1].dropped:
            runs.append((stack[-1], page[at:i]))
        at = end
        if tag is None:
            continue
        if closes:
            if open_.get(tag):
                while stack[-1].tag != tag:
                    close()
                close()
            if tag in BLOCKS:
                runs.append((stack[-1], None))
            continue
        while len(stack) > 1 and tag in CLOSES.get(stack[-1].tag, ()):
            close()
        if tag in BLOCKS:
            if open_.get("p"):
                # an open paragraph under inline elements ends too
                k = len(stack) - 1
                while stack[k].tag != "p" and stack[k].tag not in BLOCKS:
                    k -= 1
                if stack[k].tag == "p":
                    while len(stack) > k:
                        close()
            runs.append((stack[-1], None))
        elif tag == "br" and not stack[-1].dropped:
            runs.append((stack[-1], " "))
        if tag in VOID:
            continue
        top = stack[-1]
        words, names, hidden = _attributes(rest) if len(rest) > 3 else ([], [], False)
        kind = _furniture(tag, names, top.inside)
        node = Node(tag, tag + "".join(f".{w}" for w in words), top)
        node.dropped |= hidden or tag in HIDDEN or kind == "strong"
        node.linked |= tag == "a"
        node.head |= kind == "head"
        if tag in ("nav", "footer"):
            top.container.page = True
        if kind in ("name", "weak"):
            node.kind, node.outer, node.named = kind, top.named, node
            named.append(node)
        if node.named is not None and not node.dropped:
            first = tag == "article" and not articled
            if tag == "main" or first:
                node.named.holds = True
            elif tag == "h1" and not headed and (node.named.kind == "weak" or node.named.inside):
                node.named.holds = True
        articled |= tag == "article" and not node.dropped
        headed |= tag == "h1" and not node.dropped
        node.inside |= tag in ("article", "main")
        if tag in CONTAINERS:
            node.above, node.depth = node.container, node.container.depth + 1
            node.container = node
        if tag in RAW:
            found = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = skip = found.end() if found else len(page)
            continue
        if not rest.endswith("/") or tag in BLOCKS:
            stack.append(node)
            open_[tag] = open_.get(tag, 0) + 1
    if at < len(page) and not stack[-1].dropped:
        runs.append((stack[-1], page[at:]))
    return _without_named(runs, named) if named else runs


def _without_named(runs: list[tuple[Node, str | None]], named: list[Node]) -> list[tuple[Node, str | None]]:
    """Runs without furniture by name that has no sign of the main text, and not most of the page's."""
    total = 0
    for node, text in runs:
        if text is not None and not node.linked:
            size = len(text.strip())
            total += size
            if node.named is not None:
                node.named.size += size
    for x in reversed(named):  # what stands in another one comes after it
        if x.outer is not None:
            x.outer.size += x.size
            x.outer.holds |= x.holds
    gone: set[Node] = set()
    for x in named:
        if x.outer in gone or not x.holds and (2 * x.size <= total if x.kind == "weak" else 10 * x.size <= 9 * total):
            gone.add(x)
    return [x for x in runs if x[0].named not in gone or x[1] is None] if gone else runs


def _score(runs: list[tuple[Node, str]]) -> Node | None:
    """The best container, with all text that it holds as its score.

    Each container's own text, less twice its links', counts for it and for
    all above it if there is any left.  The lowest container with more than
    half of the page's text is where its main text lies; if that is a section,
    a quote, a cell or the like, what encloses it is taken, if it holds more;
    and so is the article around it.
    """
    own: dict[Node, float] = {}
    for node, text in runs:
        if text is not None and not node.head and (size := len(text.strip())):
            own[node.container] = own.get(node.container, 0.0) + (-2.0 * size if node.linked else float(size))
    boxes: set[Node] = set()
    for box, gain in own.items():
        while gain > 0 and box is not None and box not in boxes:
            box.score = max(0.0, own.get(box, 0.0))
            boxes.add(box)
            box = box.above
    if not boxes:
        return None
    total = sum(x.score for x in boxes)
    for box in sorted(boxes, key=lambda x: -x.depth):
        if box.above is not None:
            box.above.score += box.score
    best = max((x for x in boxes if 2 * x.score > total), key=lambda x: x.depth)
    whole = best
    while whole.tag in PARTS:
        whole = whole.above
        if whole.score > best.score:
            best = whole
    whole = best
    while whole is not None and whole.tag != "article":
        whole = whole.above
    return best if whole is None or whole.score <= best.score else whole


def best_path(page: str) -> tuple[str, float] | None:
    best = _score(read_page(page))
    return None if best is None else (best.path(), best.score)


def _told(runs: list[tuple[Node, str | None]], own: str) -> Iterator[tuple[str, int, int, int]]:
    """For each path of containers with text below ``own``: a hash of their text, its length, and that of its links."""
    held, by = _matched(runs, own), {}
    for node, text in runs:
        if text is not None and node in held and not node.head and (text := text.strip()):
            box = by.setdefault(node.container, [[], 0, 0])
            box[0].append(text)
            box[1] += len(text)
            box[2] += len(text) * node.linked
    paths: dict[str, list] = {}
    for box, (parts, n, linked) in by.items():
        if len(path := box.path()) > len(own):
            one = paths.setdefault(path, [[], 0, 0])
            one[0] += parts
            one[1] += n
            one[2] += linked
    for path, (parts, n, linked) in paths.items():
        yield path, int.from_bytes(hashlib.blake2b("\n".join(parts).encode(errors="replace"), digest_size=8).digest(), "little", signed=True), n, linked


def _matched(runs: list[tuple[Node, str | None]], path: str) -> dict[Node, bool]:
    """Nodes of runs that a path's steps lead to (true), or that stand below one (false)."""
    steps = path.split("/")[1:]
    seen: set[Node] = set()
    out: dict[Node, bool] = {}
    for node, _ in runs:
        above, x = [], node
        while x is not None and x not in seen:
            above.append(x)
            x = x.parent
        for x in reversed(above):
            seen.add(x)
            if x.parent is None:
                x.match = 0
            elif x.parent in out:
                out[x] = False
                continue
            else:
                k = x.parent.match
                x.match = k + 1 if 0 <= k < len(steps) and x.step == steps[k] else -1
            if x.match == len(steps):
                out[x] = True
    return out


def _blocks(runs: list[tuple[Node, str | None]], own: str) -> list[str]:
    """Blocks under a path; what stands directly in the containers around it in its article or main element is there if the path is."""
    held = _matched(runs, own)
    tops = [x for x, is_top in held.items() if is_top]
    around: set[Node] = set()
    for x in tops:
        up = x.container if x.container is not x else x.above
        while up is not None and up.inside and up not in around:
            around.add(up)
            up = up.above
    # the head of a whole page isn't its text's
    whole = any(x.container.page or x.container.tag in ("", "body") for x in tops)
    blocks, parts, some = [], [], False
    for node, text in [*runs, (None, None)]:
        if text is not None:
            mine = node in held and not (node.head and whole)
            some |= mine and not node.head and bool(text.strip())
            if mine or node.container in around and not node.head:
                parts.append(text)
        elif parts:
            block = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            parts = []
            if block:
                blocks.append(block)
    return blocks if some else []


def extract(page: str, path: str | None, furniture: list[str] | None = None) -> str:
    """Text under ``path``, or under the page's best container if it has no text there or that path is a part of it.

    The body as a whole is no such container, unless the path's is a section, a
    quote, a cell or the like.  What stands under a path of ``furniture`` is
    left out, unless that is all there is.
    """
    runs = read_page(page)
    if furniture:
        gone = set().union(*(_matched(runs, one) for one in furniture))
        left = [(n, None if n in gone else t) for n, t in runs]
        if any(t and t.strip() and not n.linked for n, t in left):
            runs = left
    best = _score(runs)
    if best is None:
        return ""
    own = best.path()
    if path is not None and path.startswith(own + "/"):
        last = path.rpartition("/")[2].partition(".")[0]
        if best.tag not in ("", "body") or last in PARTS:
            path = own
    found = _blocks(runs, path) if path is not None else []
    return "\n\n".join(found or _blocks(runs, own))


def host_of(url: Column) -> Column:
    """Host of a URL in lower case, without port; empty for null or no host."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def host_paths(pages: DataFrame) -> DataFrame:
    """host, path: the path that is best on most pages; ties by score, then by path."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch.select(["html", "host"])):
                votes = [(h, *v) for h, p in zip(part.column(1).to_pylist(), part.column(0).to_pylist(), strict=True) if p and (v := best_path(p))]
                columns = list(zip(*votes, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.float64())], names=["host", "path", "score"])

    votes = pages.select("html", "host").mapInArrow(vote, "host string, path string, score double")
    sums = votes.groupBy("host", "path").agg(F.sum("score").alias("score"), F.count(F.lit(1)).alias("n"))
    return sums.groupBy("host").agg(F.max_by("path", F.struct("n", "score", "path")).alias("path"))


def host_furniture(pages: DataFrame, winners: DataFrame, seen: int = SEEN) -> DataFrame:
    """host, furniture: paths below the host's winning one whose text is the same on all pages that have it, ``seen`` or more, or links for the most part.

    A path goes with what stands below it; of a host's pages each task gives one row for a path.
    """

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], list] = {}

        def rows() -> pa.RecordBatch:
            columns = list(zip(*((*k, *v) for k, v in held.items()), strict=True)) or [()] * 7
            kinds = [pa.string(), pa.string(), *[pa.int64()] * 5]
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["host", "path", "n", "lo", "hi", "size", "linked"])
            held.clear()
            return out

        for batch in batches:
            for part in pieces(batch):
                for page, host, own in zip(*(part.column(c).to_pylist() for c in ("html", "host", "path")), strict=True):
                    if page and own:
                        for path, digest, size, linked in _told(read_page(page), own):
                            one = held.setdefault((host, path), [0, digest, digest, 0, 0])
                            one[:] = [one[0] + 1, min(one[1], digest), max(one[2], digest), one[3] + size, one[4] + linked]
                if len(held) > 50_000:
                    yield rows()
        yield rows()

    told = pages.join(winners, "host").select("html", "host", "path").mapInArrow(tell, "host string, path string, n bigint, lo bigint, hi bigint, size bigint, linked bigint")
    sums = told.groupBy("host", "path").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("size").alias("size"), F.sum("linked").alias("linked"))
    same = (F.col("lo") == F.col("hi")) | (F.col("linked") * 2 > F.col("size"))
    return sums.where((F.col("n") >= seen) & same).groupBy("host").agg(F.sort_array(F.collect_set("path")).alias("furniture"))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", seen: int = SEEN) -> DataFrame:
    """Per row: id, url, ``path`` (the host's winning one, null if it has none) and ``text``.

    Blocks are joined by an empty line; null or empty html gives an empty
    text; a null url belongs to the host with the empty name.  Repeated rows
    are read each, and count as pages of their host; other columns are left
    out, so none can clash; an empty table gives an empty result.
    """
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"), host_of(F.col(f"`{url_col}`")).alias("host"))
    winners = materialise(host_paths(rows), "host-paths")
    told = materialise(winners.join(host_furniture(rows, winners, seen), "host", "left"), "host-furniture")
    kind = rows.schema["id"].dataType.simpleString()

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                texts = [extract(p, w, f) if p else "" for p, w, f in zip(*(part.column(c).to_pylist() for c in ("html", "path", "furniture")), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("url"), part.column("path"), pa.array(texts, pa.string())], names=["id", "url", "path", "text"])

    joined = rows.join(told, "host", "left").select("html", "id", "url", "path", "furniture")
    out = joined.mapInArrow(take, f"id {kind}, url string, path string, text string")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "path", "text")


def op7_html_text(spark, sf_dir) -> DataFrame:
    out = extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
