"""Main text of web pages from flat text blocks and a decision tree (operator 3).

A page becomes a flat list of text blocks, cut at block-level tags. A block is described
by its words and link density, those of its neighbours, and a few facts of the tags
around it. A decision tree, trained on the small labelled table of ``labelled_pages``,
says which blocks are content.
"""

from __future__ import annotations

import html as H
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixshard.llm import text as T
from mixshard.llm.labelled_pages import PAGES
from mixshard.session import prepare_session

# Comments, raw-text elements with their content, declarations, tags; quantifiers are
# possessive, so an unclosed construct costs one scan.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|iframe|svg|select|title)\b(?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+>.*?(?:</(?P=raw)\s*+>|\Z)"
    r"|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attr>(?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+)(?:>|\Z)"
    r"|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<attr2>[^>]*+)(?:>|\Z)", re.S | re.I)
_HINT = re.compile(r"""(?:class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[^\W_]+")
_HIDDEN = re.compile(r"""\bhidden\b|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)

# HTML elements
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose end tags may be left out, and so are not tracked as open
LOOSE = set("p li dt dd tr td th thead tbody tfoot option h1 h2 h3 h4 h5 h6 html body head rp rt colgroup caption".split())
BOILER_TAGS = set("nav aside footer form menu button dialog fieldset address".split())

#: Words of class, id and role values that mark what surrounds an article, and the article.
AROUND = set("ad ads advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay "
             "sidebar side widget widgets rail nav navbar navigation menu menus breadcrumb breadcrumbs header masthead topbar footer foot copyright "
             "comment comments commentlist reply replies respond disqus discussion share sharing social follow related recommended recommendations more trending popular "
             "subscribe subscription newsletter signup login search form tags tag pagination pager toolbar skip complementary contentinfo".split())
WITHIN = set("article content main post entry story body text articlebody maincontent".split())

FEATURES = ["words", "links", "words_before", "links_before", "words_after", "links_after", "plain_in_article", "page_has_article", "set_apart", "in_boiler_tag", "around_hint", "within_hint", "heading", "hidden"]


class _Open:
    __slots__ = ("tag", "article", "boiler", "around", "within", "hidden")

    def __init__(self, tag, article, boiler, around, within, hidden):
        self.tag, self.article, self.boiler, self.around, self.within, self.hidden = tag, article, boiler, around, within, hidden


def _facts(tag: str, attr: str, up: _Open) -> _Open:
    words: set[str] = set()
    for m in _HINT.finditer(attr) if attr.strip() else ():
        value = re.sub(r"([a-z])([A-Z])", r"\1 \2", m.group(1) or m.group(2) or m.group(3) or "")
        words.update(w.lower() for w in _WORD.findall(value))
    article = tag in ("article", "main") or up.article
    # a header that opens an article belongs to it; any other heads the page
    boiler = tag in BOILER_TAGS or tag == "header" and not up.article or up.boiler and tag not in ("article", "main")
    # a hint on the article itself does not exclude it
    around = bool(words & AROUND) and tag not in ("article", "main", "html", "body") or up.around and tag not in ("article", "main")
    hidden = up.hidden or bool(attr and _HIDDEN.search(attr))
    return _Open(tag, article, boiler, around, bool(words & WITHIN) or up.within, hidden)


def blocks(page: str) -> list[tuple[str, list[float], bool]]:
    """(text, own features, marked) of each text block in page order; ``marked`` is the
    ``data-main`` attribute of labelled pages."""
    out: list = []
    stack = [_Open("", False, False, False, False, False)]
    part: list[str] = []
    linked = 0  # words inside links in this block
    in_link, heading, marked, marks = False, False, False, []

    def flush():
        nonlocal linked
        if part:
            text = " ".join("".join(part).split())
            if text:
                n, o = len(text.split()), stack[-1]
                out.append((text, [n, min(1.0, linked / n), o.article and not (o.boiler or o.around or o.hidden), o.boiler or o.around or o.hidden, o.boiler, o.around, o.within, heading, o.hidden], marked))
            part.clear()
        linked = 0

    def add(raw: str):
        nonlocal linked
        t = H.unescape(raw)
        part.append(t)
        if in_link:
            linked += len(t.split())

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            add(page[at: m.start()])
        at = m.end()
        if m.group("cdata") is not None:
            add(m.group("cdata"))
            continue
        tag = (m.group("tag") or m.group("tag2") or "").lower()
        if not tag:
            if m.group("raw"):  # scripts, styles and their like end a block
                flush()
            continue
        close, attr = bool(m.group("close") or m.group("close2")), m.group("attr") or m.group("attr2") or ""
        if tag == "a":
            in_link = not close
        if tag in INLINE:
            continue
        flush()
        if tag[0] == "h" and tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            heading = not close
        if tag == "p" or tag in VOID and tag != "br":
            heading = False
        if "data-main" in attr:
            marked, marks = True, [*marks, len(stack)]
        if not close and tag in LOOSE and stack[-1].tag == tag:
            stack.pop()  # its end tag was left out
        hinted = tag in LOOSE and tag not in ("html", "body", "head") and bool(attr and _HINT.search(attr))
        if tag in VOID or not close and tag in LOOSE and not hinted:
            continue
        if not close:
            in_link = False
            if tag in ("article", "main", "footer") and len(stack) > 1 and stack[-1].boiler and stack[-1].tag in BOILER_TAGS | {"header"}:
                stack.pop()  # an end tag is missing
            if not attr.rstrip().endswith("/"):
                stack.append(_facts(tag, attr, stack[-1]))
        else:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            while marks and len(stack) <= marks[-1]:
                marks = marks[:-1]
            marked = bool(marks)
            in_link = False
    if at < len(page):
        add(page[at:])
    flush()
    return out


def features(found: list[tuple[str, list[float], bool]]) -> np.ndarray:
    """One row of FEATURES per block."""
    own = np.array([f for _, f, _ in found], float).reshape(len(found), 9)
    pad = np.zeros((1, 2))
    before, after = np.concatenate([pad, own[:-1, :2]]), np.concatenate([own[1:, :2], pad])
    has = np.full((len(own), 1), own[:, 2].any() if len(own) else 0.0)
    return np.concatenate([own[:, :2], before[: len(own)], after[-len(own):] if len(own) else after[:0], own[:, 2:3], has, own[:, 3:]], axis=1)


class Tree:
    """A decision tree by Gini impurity."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 2):
        self.nodes: list[tuple[int, float, int, int, float]] = []  # feature, threshold, left, right, share
        self._grow(x, y.astype(float), depth, least)

    def _grow(self, x, y, depth, least) -> int:
        me = len(self.nodes)
        self.nodes.append((-1, 0.0, -1, -1, float(y.mean()) if len(y) else 0.0))
        if depth == 0 or len(y) < 2 * least or y.min() == y.max():
            return me
        best = (1e-9, -1, 0.0)
        total = len(y) * 2 * y.mean() * (1 - y.mean())
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, s = x[order, f], np.cumsum(y[order])
            cut = np.flatnonzero(v[1:] > v[:-1]) + 1
            cut = cut[(cut >= least) & (cut <= len(y) - least)]
            if not len(cut):
                continue
            a, b = s[cut - 1] / cut, (s[-1] - s[cut - 1]) / (len(y) - cut)
            gain = total - 2 * (cut * a * (1 - a) + (len(y) - cut) * b * (1 - b))
            i = int(gain.argmax())
            if gain[i] > best[0] + 1e-9:
                best = (float(gain[i]), f, float(v[cut[i] - 1] + v[cut[i]]) / 2)
        if best[1] < 0:
            return me
        low = x[:, best[1]] <= best[2]
        left = self._grow(x[low], y[low], depth - 1, least)
        right = self._grow(x[~low], y[~low], depth - 1, least)
        self.nodes[me] = (best[1], best[2], left, right, self.nodes[me][4])
        return me

    def share(self, x: np.ndarray) -> np.ndarray:
        """Share of content among the training blocks of each row's leaf."""
        out = np.zeros(len(x))
        todo = [(0, np.arange(len(x)))]
        while todo:
            i, rows = todo.pop()
            f, t, left, right, share = self.nodes[i]
            if f < 0 or not len(rows):
                out[rows] = share
                continue
            low = x[rows, f] <= t
            todo += [(left, rows[low]), (right, rows[~low])]
        return out


@lru_cache(maxsize=1)
def trained_tree() -> Tree:
    """The tree of the labelled table."""
    x, y = [], []
    for page in PAGES:
        found = blocks(page)
        x.append(features(found))
        y += [m for _, _, m in found]
    return Tree(np.concatenate(x), np.array(y))


def main_text(page: str | None, tree: Tree | None = None) -> str:
    """Content blocks of one page, joined by one space; empty for null."""
    if not page:
        return ""
    found = blocks(page)
    if not found:
        return ""
    keep = (tree or trained_tree()).share(features(found)) >= 0.5
    return " ".join(t for (t, _, _), k in zip(found, keep) if k)


def extract(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", html_col: str = "html", carry: tuple[str, ...] = ("url",)) -> DataFrame:
    """(id, carried columns, text, n_chars): the main text of every page, from its whole html.

    Null or empty html and pages without content give an empty text; broken markup is read
    as far as it goes; null ids stay null; repeated rows are repeated; columns other than
    ``carry`` are not read; an empty table gives an empty result.
    """
    prepare_session(spark)
    kinds = dict(pages.dtypes)
    schema = ", ".join(["id long", *(f"`{c}` {kinds[c]}" for c in carry), "text string", "n_chars long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = trained_tree()
        for b in T.slices(batches, "__html"):
            i = b.schema.get_field_index("__html")
            texts = [main_text(x, tree) for x in b.column(i).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(b.column(j) for j in range(1, i)), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             names=["id", *carry, "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("id"), *carry, F.col(html_col).alias("__html")).mapInArrow(run, schema)


def q_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every row of ``pages``."""
    return extract(spark, spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumnRenamed("id", "page_id")
