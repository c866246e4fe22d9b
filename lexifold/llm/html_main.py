"""Main text of web pages, with the templates of their sites removed.

Every page is parsed into a tree, and every element is hashed with all that is below
it. Spark counts on how many pages of a host each subtree occurs. Subtrees that occur
on many of them are the template of the site and are deleted; so are elements that
say themselves that they are menus, adverts, forms and the like. What is left of the
article, or of the body if there is none, is the text. Inside an article only blocks
that hold no paragraph, heading or other prose are taken for template; prose and
inline elements never are, however often other pages quote them. Pages with the same
markup count as one, so copies of a page make no template of its text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import blake2b
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexifold.llm.common import in_pieces, join_groups, materialise, small_batches

# Elements without content, elements that start a block, and elements that end an open paragraph or item.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td "
    "tfoot th thead tr ul".split()
)
ENDS = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]),
}
SCOPES = frozenset("article body div html main section table ul ol dl select td th".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th tr tbody thead table ul ol dl figure figcaption".split())
PARTS = BLOCK - PROSE  # inside an article only these may be template
# Elements, roles and words of class or id that are no main text.
ASIDE_TAGS = frozenset(
    "aside button canvas dialog embed footer form head iframe input menu nav noscript object script select style svg template textarea".split()
)
ASIDE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
ASIDE_WORDS = frozenset(
    "ad ads adsense advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "disqus feedback footer gdpr login menu modal nav navbar navigation newsletter notice paywall popup promo related "
    "replies respond responses share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
COMMENT_WORDS = frozenset("comment comments disqus feedback replies respond responses".split())
# Elements that are text themselves, which no word hides inside an article.
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th".split())
SPACE = re.compile(r"\s+")
WORD = re.compile(r"[a-z]+")
# Elements that no class or id makes an aside, and first parts of class names that only tell of something else.
OUTER = frozenset("html body main".split())
STATES = frozenset("has hide no not show with without".split())
MARKUP = re.compile(r"<[a-zA-Z/!?]")


#: Bytes of markup that are parsed at a time, and distinct pages with copies that are broadcast at most.
PIECE_BYTES = 4_000_000
COPIED_PAGES = 500_000


@dataclass(frozen=True)
class TemplateRule:
    """A subtree is template if at least ``pages`` pages of the host and a ``share`` of them hold it."""

    pages: int = 5
    share: float = 0.3


@dataclass(slots=True)
class Node:
    tag: str
    kind: str = ""
    aside: bool = False
    main: bool = False
    named: bool = False
    named_inside: bool = False
    prose: bool = False
    below: list = field(default_factory=list)
    hash: int | None = None


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("")
        self.open = [self.root]
        self.mains = 0
        self.outermost: list[list[Node]] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCK:
            self._end(frozenset(["p"]))
        if tag in ENDS:
            self._end(ENDS[tag])
        told = {k: v or "" for k, v in attrs if k in ("class", "id", "role")}
        kind = " ".join(f"{k}={told[k]}" for k in sorted(told))
        role = told.get("role", "").lower()
        node = Node(tag, kind, tag in ASIDE_TAGS or role in ASIDE_ROLES, tag in ("article", "main") or role == "main")
        by_class, by_id = (told.get(k, "").lower().split() for k in ("class", "id"))
        if not (tag in OUTER or role == "main"):
            node.named = any(_names_aside(t) for t in (*by_class, *by_id))
            comments = any(_names_aside(t, COMMENT_WORDS) for t in by_id)
            node.named_inside = tag not in TEXT and (comments or any(map(_names_aside, by_class)))
        if node.main and not self.mains:
            self.outermost.append([*self.open, node])
        self.open[-1].below.append(node)
        if tag in PROSE:
            for n in reversed(self.open):
                if n.prose:
                    break
                n.prose = True
        if tag not in VOID:
            self.open.append(node)
            self.mains += node.main

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth].tag == tag:
                self._close(depth)
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].below.append(data)

    def _close(self, depth: int) -> None:
        self.mains -= sum(n.main for n in self.open[depth:])
        del self.open[depth:]

    def _end(self, tags: frozenset) -> None:
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth].tag in tags:
                self._close(depth)
                return
            if self.open[depth].tag in SCOPES:
                return


def _names_aside(token: str, words: frozenset = ASIDE_WORDS) -> bool:
    """Whether a class or id is an aside word or ends in one, as in ``cookie-notice``, and is not like ``has-sidebar``."""
    parts = WORD.findall(token)
    return bool(parts) and parts[-1] in words and parts[0] not in STATES


def _length(node: Node) -> int:
    """Characters of text below an element, without those of asides."""
    total, todo = 0, [node]
    while todo:
        for n in todo.pop().below:
            if isinstance(n, str):
                total += len(n.strip())
            elif not n.aside:
                todo.append(n)
    return total


def parse(html: str) -> Node:
    """The tree of a page; markup may be broken or cut off anywhere."""
    tree = _Tree()
    tree.feed(html)
    if not MARKUP.match(tree.rawdata):  # else it ends inside a tag or comment
        tree.close()
    if tree.outermost:
        # The longest of the outermost articles is no aside, and neither is what wraps it.
        main = tree.outermost[0] if len(tree.outermost) == 1 else max(tree.outermost, key=lambda chain: _length(chain[-1]))
        for n in main:
            n.named = n.named_inside = False
    return tree.root


def subtree_hash(root: Node) -> int:
    """Hash of an element from its tag, class, id, role and all below it, computed when asked for."""
    todo = [(root, False)]
    while todo:
        node, ready = todo.pop()
        if node.hash is not None:
            continue
        if not ready:
            todo.append((node, True))
            todo += [(n, False) for n in node.below if isinstance(n, Node)]
            continue
        parts = [f"{node.tag} {node.kind}"]
        for n in node.below:
            part = f"#{n.hash}" if isinstance(n, Node) else SPACE.sub(" ", n).strip()
            if part:
                parts.append(part)
        digest = blake2b("\x00".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest()
        node.hash = int.from_bytes(digest, "big", signed=True)
    return root.hash


def _candidates(root: Node) -> set[int]:
    """Hashes of all elements that may be template; only they can be deleted by their hash."""
    found: set[int] = set()
    todo = [(root, False)]
    while todo:
        node, inside = todo.pop()
        for n in node.below:
            if isinstance(n, Node) and n.tag not in VOID:
                if _deletable(n, inside):
                    found.add(subtree_hash(n))
                todo.append((n, inside or n.main))
    return found


def _deletable(node: Node, inside: bool) -> bool:
    if inside and (node.prose or node.tag not in PARTS):
        return False
    return not node.main and node.tag not in ("html", "body") and bool(node.below)


def _is_template(node: Node, inside: bool, template: set[int]) -> bool:
    return bool(template) and _deletable(node, inside) and subtree_hash(node) in template


def _articles(root: Node, template: set[int]) -> list[tuple[Node, bool]]:
    """The outermost articles, else the outermost main parts, else the whole page."""
    found: list[Node] = []
    todo = [root]
    while todo:
        node = todo.pop()
        if node.aside or node.named or _is_template(node, False, template):
            continue
        if node.main:
            found.append(node)
        else:
            todo += [n for n in reversed(node.below) if isinstance(n, Node)]
    return [(n, True) for n in found] or [(root, False)]


def main_text(root: Node, template: set[int]) -> str:
    """Blocks of the article in page order, one per line, without template."""
    blocks: list[str] = []
    words: list[str] = []

    def end() -> None:
        text = SPACE.sub(" ", "".join(words)).strip()
        words.clear()
        if text:
            blocks.append(text)

    for article, inside in _articles(root, template):
        todo: list = [(article, inside, False)]
        while todo:
            node, within, leaving = todo.pop()
            if isinstance(node, str):
                words.append(node)
            elif leaving:
                end()
            elif node.tag == "br":
                words.append(" ")
            elif not (node is not article and (node.aside or (node.named_inside if within else node.named) or (node.tag == "header" and not within) or _is_template(node, within, template))):
                if node.tag in BLOCK:
                    end()
                    todo.append((node, within, True))
                todo += [(n, within or node.main, False) for n in reversed(node.below)]
        end()
    return "\n".join(blocks)


def _host(url: str) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), "^[^:/?#]*:?//([^/?#]*)", 1)), F.lit(""))


def count_subtrees(pages: DataFrame, rule: TemplateRule) -> DataFrame:
    """``(host, n_pages, template)``: per host the hashes of its template, written.

    A template subtree is on a given share of the pages, so a host has only so many
    times more of them than a page has elements. Pages of the same markup count as one:
    each of ``m`` copies counts a part in ``m``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches, 1, PIECE_BYTES):
            hosts, hashes, parts = [], [], []
            for host, html, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = _candidates(parse(html))
                hosts += [host] * len(found)
                hashes += found
                parts += [part] * len(found)
            yield pa.record_batch([pa.array(hosts, pa.string()), pa.array(hashes, pa.int64()), pa.array(parts, pa.float64())], ["host", "hash", "part"])

    sources = pages.select(_host("url").alias("host"), F.coalesce("html", F.lit("")).alias("html")).withColumn("key", F.xxhash64("html"))
    contents = materialise(sources.groupBy("host", "key").agg(F.count(F.lit(1)).alias("m")), "page_contents")
    sizes = materialise(contents.groupBy("host").agg(F.sum("m").alias("n_pages"), F.count(F.lit(1)).alias("n_contents")), "host_sizes")
    copied = contents.filter("m > 1")
    copied = F.broadcast(copied) if copied.count() <= COPIED_PAGES else copied.hint("merge")
    weighed = sources.join(copied, ["host", "key"], "left").select("host", "html", (1 / F.coalesce("m", F.lit(1))).alias("part"))
    seen = weighed.mapInArrow(run, "host string, hash long, part double").groupBy("host", "hash").agg(F.round(F.sum("part"), 3).alias("n"))
    often = seen.filter(F.col("n") >= rule.pages).join(sizes, "host").filter(F.col("n") >= F.col("n_contents") * rule.share)
    templates = often.groupBy("host").agg(F.collect_list("hash").alias("template"))
    return materialise(
        sizes.drop("n_contents").join(templates, "host", "left").withColumn(
            "template", F.coalesce("template", F.expr("cast(array() as array<bigint>)"))
        ),
        "site_templates",
    )


def extract_pages(pages: DataFrame, rule: TemplateRule | None = None) -> DataFrame:
    """One row ``(page_id, url, text, n_chars)`` per row of ``pages``.

    Null or empty html gives an empty text. Pages whose url is null or has no host
    share one host. Repeated rows and pages of the same markup are one page where template
    is counted. Of several outermost articles, all but the longest can be hidden by a class
    or id that names them, or what wraps them, comments or the like. White space in a block
    becomes one blank, blocks are joined by one line end, line breaks inside a block
    are blanks. An empty table gives no rows; other columns are not read.
    """
    rule = rule or TemplateRule()
    hosted = pages.select("page_id", "url", _host("url").alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    with small_batches(pages.sparkSession, 2000):
        templates = count_subtrees(pages, rule)
    size = F.size("template") * 8 + F.octet_length("host") + 40
    joined = join_groups(hosted, templates, ["host"], "n_pages", salt_by="page_id", row_bytes=size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, set[int]] = {}
        for batch in in_pieces(batches, 2, PIECE_BYTES):
            texts = []
            for html, host, template in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist(), batch.column(3), strict=True):
                if host not in known:
                    if len(known) >= 64:
                        known.clear()
                    known[host] = set(template.as_py())
                texts.append(main_text(parse(html), known[host]))
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.select("page_id", "url", "html", "template", "host").mapInArrow(
        run, f"page_id {kind}, url string, text string, n_chars long"
    )
