"""Main text of web pages by a site style tree.

The DOMs of a host's pages are merged: elements with the same path of tags, classes and roles are one node of the
host's tree. A node's importance joins

* its content: every text block is a feature; a block on one page only is important, one spread over all
  pages is not (1 minus the mean of ``log n / log m`` over the node's blocks, n of m pages);
* its presentation: the entropy of the child sequences of its parent (a menu is built alike on all pages).

Hosts with few pages lean on the tree of all hosts: host and corpus importance are averaged with the host's pages
against ``SHRINK`` pages. Branches below ``LEAST`` leave the page. Markup that names its role is prior
knowledge that entropies do not overrule: menus, footers, asides, forms, adverts, notices, comments and the
like have importance 0, and a page that marks its article has importance 0 outside of it and 1 inside.

Pages are parsed in tasks (once for the tree, once for the text). Statistics are counts of (host, path, feature),
combined in the tasks and by partial aggregates, so a host with a third of all pages is no larger group
than its distinct blocks, which are dealt by feature. The unimportant paths of a host return by an equi
join that adaptive execution splits on a hot host.

Defined results: null and empty html have an empty text; a page without url belongs to the host ``''``;
broken markup is read like a browser would, as far as the text goes; repeated rows are judged each.
White space (Unicode) inside a block is one space, blocks are joined by one space.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.llm import words as wd
from evigraph.llm.tables import read
from evigraph.llm.url_reputation import url_parts

LEAST = 0.8     # importance that a branch needs
SHRINK = 200.0   # pages of weight of the tree of all hosts
PRESENTATION = 0.1  # weight of the parent's presentation

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|title|iframe|svg|noembed)\b(?:"[^"]*"|'[^']*'|[^'">])*+>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+|[^>]*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)""",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("tr", "td", "th", "thead")}
SCOPES = frozenset("ul ol dl table div article section main body td th aside nav footer header form blockquote".split())
NOISE_TAGS = frozenset("nav footer aside form button select option dialog menu head object canvas audio video datalist fieldset".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
NOISE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors promo promos promotion cookie cookies consent gdpr notice notices notification notifications alert alerts banner popup modal overlay"
    " nav navbar navigation navi menu menus breadcrumb breadcrumbs masthead topbar header footer sidebar aside widget widgets related recommended recommendations share sharing social comment comments commentlist respond disqus reply replies"
    " newsletter subscribe subscription signup login search form pagination pager toolbar skip".split()
)
NAMED_LIKE_HEADER = frozenset(["header", "masthead"])


class Frame:
    """An open element: its tag, key and path, whether it is noise or (inside) the article, and its children's keys."""

    __slots__ = ("tag", "key", "path", "noise", "article", "children")

    def __init__(self, tag: str, key: str, path: int, noise: bool, article: bool):
        self.tag, self.key, self.path, self.noise, self.article, self.children = tag, key, path, noise, article, []


def _named(attributes: str) -> tuple[frozenset[str], bool]:
    """Words of class, id and role, and whether the element is hidden or has the role of noise."""
    names: set[str] = set()
    noise = False
    for m in ATTRIBUTE.finditer(attributes):
        kind, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if kind == "role":
            noise |= value in NOISE_ROLES
        elif kind == "hidden" or (kind == "aria-hidden" and value == "true"):
            noise = True
        else:
            for name in value.split():
                if not name.startswith(("no-", "has-", "with-", "is-")):
                    names.update(re.split(r"[^a-z0-9]+|\d+", name))
    names.discard("")
    return frozenset(names), noise


def parse(html: str) -> tuple[list[tuple[int, int, str, bool, bool]], list[tuple[int, int]]]:
    """Blocks (path, parent's path, text, noise, article) in page order, and (path, child sequence) of the elements."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    stack = [Frame("", "", 0, False, False)]
    blocks: list[tuple[int, int, str, bool, bool]] = []
    shapes: list[tuple[int, int]] = []
    buffer: list[str] = []
    muted: list[str] = []  # open inline elements that are noise

    def flush() -> None:
        if buffer:
            text = " ".join(unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                top = stack[-1]
                blocks.append((top.path, stack[-2].path if len(stack) > 1 else 0, text, top.noise, top.article))

    def close(depth: int) -> None:
        while len(stack) > depth:
            top = stack.pop()
            if top.children:
                shapes.append((top.path, digest(" ".join(top.children)) >> 1))

    at = 0
    for m in TOKEN.finditer(html):
        if m.start() > at and not muted:
            buffer.append(html[at : m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            if m[1]:
                flush()
            continue
        tag = tag.lower()
        if m[2]:
            if tag in INLINE:
                if muted and muted[-1] == tag:
                    muted.pop()
                continue
            flush()
            muted.clear()
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    close(depth)
                    break
            continue
        if tag in INLINE:
            if muted:
                muted += [tag] if tag == muted[-1] else []
            elif m[4]:
                names, noise = _named(m[4])
                if noise or names & NOISE_NAMES:
                    muted.append(tag)
            continue
        flush()
        if tag in VOID:
            continue
        muted.clear()
        if stack[-1].tag == "p":
            close(len(stack) - 1)
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag in CLOSES.get(tag, ()):
                close(depth)
                break
            if stack[depth].tag in SCOPES and stack[depth].tag not in CLOSES.get(tag, ()):
                break
        parent = stack[-1]
        names, noise = _named(m[4]) if m[4] else (frozenset(), False)
        key = tag + "." + ".".join(sorted(names)) if names else tag
        whole = tag in ("html", "body")
        bad = names & NOISE_NAMES
        if parent.article:
            bad -= NAMED_LIKE_HEADER  # an article's own header holds its title
        noise = parent.noise or (not whole and (noise or tag in NOISE_TAGS or bool(bad) or (tag == "header" and not parent.article)))
        article = not noise and (parent.article or tag in ("article", "main"))
        parent.children.append(key)
        stack.append(Frame(tag, key, digest(f"{parent.path}/{key}") >> 1, noise, article))
    if at < len(html) and not muted:
        buffer.append(html[at:])
    flush()
    close(0)
    return blocks, shapes


def main_text(html: str, unimportant: frozenset[int] | set[int]) -> str:
    """Text of the important branches."""
    blocks, _ = parse(html)
    marked = any(article for *_, article in blocks)
    return " ".join(text for path, _, text, noise, article in blocks if not noise and (article if marked else path not in unimportant))


# --- the tree ---------------------------------------------------------------------------------------


def count_features(pages: DataFrame) -> DataFrame:
    """host, path, parent, kind (0 content, 1 presentation), feature, n: on how many pages a node has a feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in wd.pieces(batches, "html"):
            found: Counter[tuple[str, int, int, int, int]] = Counter()
            for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                blocks, shapes = parse(html or "")
                here = {(host, path, parent, 0, xxhash.xxh3_64_intdigest(text) >> 1) for path, parent, text, noise, _ in blocks if not noise}
                here |= {(host, path, 0, 1, shape) for path, shape in shapes}
                here |= {(host, k[1], k[2], k[3], -1) for k in here}  # the page itself
                found.update(here)
            if found:
                columns = list(zip(*found, strict=True))
                types = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(columns, types, strict=True)], pa.array(list(found.values()), pa.int64())], ["host", "path", "parent", "kind", "feature", "n"])

    counted = pages.select("host", "html").mapInArrow(run, "host string, path long, parent long, kind int, feature long, n long")
    return counted.groupBy("host", "path", "parent", "kind", "feature").agg(F.sum("n").alias("n"))


def _entropies(features: DataFrame, keys: list[str]) -> DataFrame:
    """Per node: m pages; content = 1 - mean of log n / log m over block occurrences; presentation = entropy of the child sequences in base m."""
    logs = F.log("n")
    real = F.col("feature") >= 0
    sums = features.groupBy(*keys, "path", "parent", "kind").agg(
        F.max(F.when(~real, F.col("n"))).alias("m"),
        F.sum(F.when(real, F.col("n"))).alias("total"), F.sum(F.when(real, F.col("n") * logs)).alias("n_logs"),
    )
    base = F.log("m")
    content = 1 - F.col("n_logs") / F.col("total") / base
    presentation = (F.log("total") - F.col("n_logs") / F.col("total")) / base
    value = F.when(F.col("m") <= 1, 1.0).when(F.col("kind") == 0, content).otherwise(F.least(F.lit(1.0), presentation))
    return sums.select(*keys, "path", "parent", "kind", "m", value.alias("value"))


def unimportant_paths(pages: DataFrame, least: float = LEAST) -> DataFrame:
    """host and paths (array<long>) of the nodes below ``least``. ``pages`` has host and html."""
    features = count_features(pages)
    host = _entropies(features, ["host"])
    # The tree of all hosts: the same counts without the host.
    corpus = _entropies(features.groupBy("path", "parent", "kind", "feature").agg(F.sum("n").alias("n")), []).select("path", "parent", "kind", F.col("value").alias("all_value"))
    joined = host.join(corpus, ["path", "parent", "kind"]).withColumn("value", (F.col("m") * F.col("value") + SHRINK * F.col("all_value")) / (F.col("m") + SHRINK))
    shape = joined.filter("kind = 1").select("host", F.col("path").alias("parent"), F.col("value").alias("shape"))
    leaves = joined.filter("kind = 0").join(shape, ["host", "parent"], "left")
    importance = (1 - PRESENTATION) * F.col("value") + PRESENTATION * F.coalesce("shape", "value")
    return leaves.filter(importance < least).groupBy("host").agg(F.collect_set("path").alias("paths"))


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text for every row of ``pages`` (page_id, url, html)."""
    host, _ = url_parts(F.col("url"))
    rows = pages.select("page_id", "url", "html").withColumn("host", host)
    noisy = unimportant_paths(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in wd.pieces(batches, "html"):
            texts = [main_text(h or "", set(p or ())) for h, p in zip(batch.column("html").to_pylist(), batch.column("paths").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    joined = rows.join(noisy, "host", "left").select(F.col("page_id").cast("long").alias("page_id"), "url", "html", "paths")
    return joined.mapInArrow(run, "page_id long, url string, text string")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_text(read(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


QUERIES = {"op3_html_extraction": op3_html_extraction}
