"""HTML extraction by a tree-structured graphical model.

The blocks of a page (elements that are not inline) form a tree. Each is
content or not. Its own features (tag, the tag around it, names in class, id and
role, length and part of the page's text, link share, punctuation) give its potential, and a potential per kind of child
links it to its parent. Sum-product messages go up the tree and down again and
give every block's probability of being content; text of blocks at 1/2 or more
is the page's main text. The weights maximise the likelihood of the labelled
pages in ``labelled_pages``.

Pages are independent, so the job is a single pass over Arrow batches without
a shuffle. The model is a few hundred numbers.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator
from math import exp, log, log1p

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listaro.llm.columns import numbered, restored
from listaro.llm.labelled_pages import pages as labelled_pages
from listaro.staging import read_table

#: Elements that flow inside a block's text.
INLINE = frozenset("a abbr acronym annotation b bdi bdo big cite code data del dfn em font i ins kbd label mark math mfrac mi mn mo mrow msub msup msqrt mtext q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track".split())
#: Elements whose text is never shown as text of the page.
HIDDEN = frozenset("head template noscript svg object canvas audio video map select datalist option button".split())
#: Elements that a head may hold; any other one ends it.
IN_HEAD = frozenset("head base link meta noscript script style template title".split())
#: A page's tree is no deeper, as in browsers: what lies deeper counts as beside.
DEPTH = 512
#: A start tag of the key ends an open element of the values.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tbody": {"tr", "td", "th", "thead", "tbody"}, "thead": {"tr", "td", "th"}, "option": {"option"}, "body": {"head"},
}
#: An element of the key is not ended from inside these.
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "thead": {"table"}}
TAGS = "html body div section article main p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th tbody pre blockquote figure figcaption nav header footer aside form fieldset address details center".split()
TAG_AT = {t: i for i, t in enumerate(TAGS)}
#: Words in class, id and role that tell what a block is for.
NAMES = [
    ("menu", r"nav\w*|menu\w*|topbar|toolbar|breadcrumbs?|pager|pagination|tabs?"),
    ("header", r"header|masthead|logo|branding|top"),
    ("footer", r"footer|colophon|copyright|contentinfo|legal|bottom"),
    ("sidebar", r"side\w*|widget\w*|aside|complementary|rail"),
    ("advert", r"ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|adbox|adslot"),
    ("comment", r"comment\w*|respond|replies|reply|disqus|discussion|reader"),
    ("notice", r"cookies?|consent|notice|gdpr|modal|popup|overlay|dialog|alert|newsletter|subscribe\w*|signup|paywall"),
    ("share", r"share\w*|social|related|recommended|more|tags|meta|byline|author|trending|popular"),
    ("form", r"form|search|login|contact"),
    ("content", r"content|main|article\w*|post|entry|story|text|body|page"),
]
NAME_RES = [(n, re.compile(rf"(?<![a-z0-9])(?:{r})(?![a-z0-9])")) for n, r in NAMES]
KINDS = {**dict.fromkeys("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th tbody pre blockquote figure figcaption".split(), 0), **dict.fromkeys("nav header footer aside form fieldset".split(), 2)}
FEATURES = 2 * (len(TAGS) + 1) + len(NAMES) + 5 + 6 + 4 + 1 + 4
TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?:script|style|textarea|title|xmp|iframe|noembed|noframes)(?=[\s/>]).*?(?:</(?:script|style|textarea|title|xmp|iframe|noembed|noframes)\s*>|\Z)"""
    r"""|<[!?][^>]*>|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*"|'[^']*')*+|[^>]*)>""",
    re.S | re.I,
)
#: What opens a comment, a tag or an element of raw text, and what ends such a comment or element.
UNENDED = re.compile(r"<(?=[a-zA-Z!?/])")
ENDED = re.compile(r"(?:-->|</(?:script|style|textarea|title|xmp|iframe|noembed|noframes)\s*>|\A<[!?](?!--)[^>]*>)\Z", re.I)
NAMED = re.compile(r"""(?:^|\s)(class|id|role|y)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)


class Page:
    """The block tree of a page: parallel lists in page order, and the text runs with their block."""

    __slots__ = ("tags", "parents", "names", "marks", "runs", "links")

    def __init__(self, source: str):
        self.tags, self.parents, self.names, self.marks = ["#page"], [-1], [""], [""]
        self.runs: list[tuple[int, str]] = []
        self.links: list[int] = [0]
        # open_: how many elements of each tag are on the stack, so that none is looked for in vain.
        stack, open_, hidden, in_link, at = [0], Counter(), [], 0, 0
        last_end: dict[str, int] = {}
        limit = source.rfind(">") + 1
        parts: list[str] = []

        def flush() -> None:
            if parts:
                text = " ".join("".join(parts).split())
                if text:
                    self.runs.append((stack[-1], text))
                parts.clear()

        def close(i: int) -> None:
            for block in stack[i:]:
                open_[self.tags[block]] -= 1
            del stack[i:]

        raw = ""
        for token in TOKEN.finditer(source, 0, limit):
            if token.start() > at and not hidden:
                text = source[at : token.start()]
                if "&" in text:
                    text = html_lib.unescape(text)
                parts.append(text)
                if in_link:
                    self.links[stack[-1]] += len(text)
            at = token.end()
            tag = token["tag"]
            if not tag:
                raw = token[0]
                continue
            tag = tag.lower()
            if hidden:
                # Only the end of the hidden element, or what ends an open head, counts here.
                if tag == hidden[-1]:
                    if token["end"]:
                        hidden.pop()
                    elif tag not in ("head", "option"):
                        hidden.append(tag)
                    continue
                if hidden != ["head"] or token["end"] or tag in IN_HEAD:
                    continue
                hidden.clear()
            if tag in HIDDEN:
                if not token["end"] and not token["attrs"].endswith("/"):
                    if tag not in last_end:
                        last_end[tag] = max((m.start() for m in re.finditer(f"</{tag}", source, re.I | re.A)), default=-1)
                    # One that is never closed hides nothing, but for the head, which other elements end.
                    if tag == "head" or last_end[tag] > at:
                        hidden.append(tag)
                continue
            if tag in INLINE:
                if tag == "a":
                    in_link = 0 if token["end"] else 1
                continue
            if tag == "br":
                parts.append(" ")
                continue
            flush()
            if tag in VOID:
                continue
            if token["end"]:
                if open_[tag]:
                    i = len(stack) - 1
                    while self.tags[stack[i]] != tag:
                        i -= 1
                    close(i)
                continue
            if self.tags[stack[-1]] == "p":
                close(len(stack) - 1)
            ended = ENDS.get(tag)
            if ended and any(open_[t] for t in ended):
                scope = SCOPE.get(tag, ())
                for i in range(len(stack) - 1, 0, -1):
                    open_tag = self.tags[stack[i]]
                    if open_tag in scope:
                        break
                    if open_tag in ended:
                        close(i)
                        break
            if len(stack) > DEPTH:
                close(len(stack) - 1)
            found = NAMED.findall(token["attrs"]) if "=" in token["attrs"] else ()
            self.tags.append(tag)
            self.parents.append(stack[-1])
            self.names.append(" ".join(v.strip("\"'").lower() for k, v in found if k.lower() != "y"))
            self.marks.append(next((v.strip("\"'") for k, v in found if k.lower() == "y"), ""))
            self.links.append(0)
            if not token["attrs"].endswith("/"):
                stack.append(len(self.tags) - 1)
                open_[tag] += 1
        # The rest has no tag; a comment, script or tag that never ends takes what follows it along.
        cut_off = at == limit and UNENDED.match(raw) and not ENDED.search(raw)
        if at < len(source) and not hidden and not cut_off:
            parts.append(html_lib.unescape(UNENDED.split(source[at:])[0]))
        flush()

    def features(self) -> list[list[int]]:
        """The numbers of the features of each block."""
        n = len(self.tags)
        size, stops, links = [0] * n, [0] * n, list(self.links)
        own = [0] * n
        for block, text in self.runs:
            size[block] += len(text)
            own[block] += len(text)
            stops[block] += text.count(". ") + text.count(", ") + text.count("? ") + text.endswith((".", "?", "!"))
        for i in range(n - 1, 0, -1):
            p = self.parents[i]
            size[p] += size[i]
            stops[p] += stops[i]
            links[p] += links[i]
        out = []
        for i in range(n):
            got = [TAG_AT.get(self.tags[i], len(TAGS))]
            at = len(TAGS) + 1
            names = self.names[i]
            if names:
                got.extend(at + k for k, (_, r) in enumerate(NAME_RES) if r.search(names))
            at += len(NAMES)
            length = size[i]
            share = links[i] / length if length else 0
            got.append(at + (0 if not length else 1 if share == 0 else 2 if share < 0.2 else 3 if share < 0.5 else 4))
            got.append(at + 5 + (0 if not length else 1 if length < 25 else 2 if length < 80 else 3 if length < 200 else 4 if length < 600 else 5))
            s = stops[i]
            got.append(at + 11 + (0 if not s else 1 if s < 2 else 2 if s < 5 else 3))
            if own[i]:
                got.append(at + 15)
            # What part of the page's text it holds, and what it lies in.
            part = length / size[0] if length else 0
            got.append(at + 16 + (0 if part < 0.1 else 1 if part < 0.5 else 2 if part < 0.9 else 3))
            got.append(at + 20 + (TAG_AT.get(self.tags[self.parents[i]], len(TAGS)) if i else len(TAGS)))
            out.append(got)
        return out


def _message(pair: list[list[float]], odds: float) -> float:
    """Log-odds that a neighbour sends over pair[receiver][sender], given the sender's own log-odds."""
    def soft(a: float, b: float) -> float:
        return a + log1p(exp(b - a)) if a > b else b + log1p(exp(a - b))

    return soft(pair[1][0], pair[1][1] + odds) - soft(pair[0][0], pair[0][1] + odds)


def marginals(page: Page, feats: list[list[int]], model: dict) -> tuple[list[float], list[float], list[float]]:
    """Log-odds of content of each block by sum-product; also the beliefs from below, and from above, for training."""
    weights, pairs, flipped = model["weights"], model["pairs"], model["flipped"]
    n = len(feats)
    below = [sum(weights[f] for f in fs) for fs in feats]
    kinds = [KINDS.get(t, 1) for t in page.tags]
    up = [0.0] * n
    for i in range(n - 1, 0, -1):
        up[i] = _message(pairs[kinds[i]], below[i])
        below[page.parents[i]] += up[i]
    total = list(below)
    above = [0.0] * n
    for i in range(1, n):
        p = page.parents[i]
        above[i] = total[p] - up[i]
        total[i] = below[i] + _message(flipped[kinds[i]], above[i])
    return total, below, above


def _flip(pairs):
    return [[[p[0][0], p[1][0]], [p[0][1], p[1][1]]] for p in pairs]


def labels(page: Page) -> list[int]:
    """The labels of a labelled page's blocks: 1 for content. A page of nothing but text is content itself."""
    label = [int(len(page.tags) == 1)] * len(page.tags)
    for i in range(1, len(label)):
        label[i] = int(page.marks[i]) if page.marks[i] else label[page.parents[i]]
    return label


def train(sources: list[str] | None = None, rounds: int = 80, rate: float = 0.15, l2: float = 0.002) -> dict:
    """Fit on labelled pages (attribute y, see labelled_pages) by Adam on the likelihood of all blocks' labels."""
    data = []
    for source in sources if sources is not None else labelled_pages():
        page = Page(source)
        data.append((page, page.features(), labels(page)))
    size = FEATURES + 12
    theta, m1, m2 = [0.0] * size, [0.0] * size, [0.0] * size
    for step in range(1, rounds + 1):
        model = _model(theta)
        grad = [0.0] * size
        for page, feats, label in data:
            total, below, above = marginals(page, feats, model)
            for i, fs in enumerate(feats):
                miss = label[i] - 1.0 / (1.0 + exp(-max(-40.0, min(40.0, total[i]))))
                for f in fs:
                    grad[f] += miss
                if i:
                    kind = KINDS.get(page.tags[i], 1)
                    pair = model["pairs"][kind]
                    joint = [[exp(min(60.0, pair[a][b] + a * max(-40.0, min(40.0, above[i])) + b * max(-40.0, min(40.0, below[i])))) for b in (0, 1)] for a in (0, 1)]
                    z = sum(map(sum, joint))
                    at = FEATURES + 4 * kind
                    grad[at + 2 * label[page.parents[i]] + label[i]] += 1.0
                    for a in (0, 1):
                        for b in (0, 1):
                            grad[at + 2 * a + b] -= joint[a][b] / z
        for k in range(size):
            g = grad[k] / len(data) - l2 * theta[k]
            m1[k] = 0.9 * m1[k] + 0.1 * g
            m2[k] = 0.999 * m2[k] + 0.001 * g * g
            theta[k] += rate * (m1[k] / (1 - 0.9**step)) / ((m2[k] / (1 - 0.999**step)) ** 0.5 + 1e-8)
    return _model(theta)


def _model(theta: list[float]) -> dict:
    pairs = [[[theta[FEATURES + 4 * k + 2 * a + b] for b in (0, 1)] for a in (0, 1)] for k in range(3)]
    return {"weights": theta[:FEATURES], "pairs": pairs, "flipped": _flip(pairs)}


def main_text(source: str | None, model: dict, least: float = 0.5) -> str:
    """The text of the blocks that are content with a probability of ``least`` or more, joined by one space."""
    if not source:
        return ""
    page = Page(source)
    total, _, _ = marginals(page, page.features(), model)
    bar = log(least / (1 - least))
    return " ".join(text for block, text in page.runs if total[block] >= bar)


def with_main_text(pages: DataFrame, model: dict, html_col: str = "html", name: str = "text") -> DataFrame:
    """``pages`` with the main text in place of the html, and ``n_chars``, its code points.

    Defined cases: null and empty html give an empty text; a page without any
    content block too; broken markup is read as far as it goes, as browsers do,
    in time linear in the page; an element that is never closed hides nothing;
    other columns pass through (columns named as the results are replaced);
    repeated rows get the same text; an empty table gives an empty result.
    """
    kept, new = numbered(pages, (html_col, name, "n_chars"))
    width = len(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), model) for x in batch.column(width)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*batch.schema.names[:-1], "text", "n_chars"]
            )

    rows = pages.select(*[F.col(f"`{c}`").alias(n) for c, n in new.items()], F.col(f"`{html_col}`").cast("string").alias("html"))
    schema = kept.withColumn("text", F.lit("")).withColumn("n_chars", F.lit(0).cast("long")).schema
    return restored(rows.mapInArrow(run, schema), new, F.col("text").alias(name), "n_chars")


def op6_html_extraction(spark, sf_dir: str) -> DataFrame:
    """Every page's main text; the cases are defined as in ``with_main_text``."""
    pages = read_table(spark, f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return with_main_text(pages, train()).select("page_id", "url", "text", "n_chars")
