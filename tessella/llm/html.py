"""HTML extraction by a tree-structured graphical model over DOM nodes.

Each element has a hidden state: no content, content, or the structure around content. A parent and its child share a
potential, an element's observed features give another, and sum-product messages, first from the leaves upward, then from the root
downward, give each element's exact marginal. The potentials are counted on labelled pages.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended

#: Fixed values of the HTML standard: elements without content, those whose content is no markup, and those that stand as blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label map mark meter nobr output picture q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: An element that opens closes an open one of these kinds (up to the scope that holds them).
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
SCOPES = frozenset("table ul ol dl select article section div body html main".split())
#: What the contract counts out, whatever surrounds it.
NEVER = frozenset("script style head title noscript template textarea select option button form svg iframe object canvas nav dialog noembed noframes xmp datalist".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
NAMED = re.compile(r"(?:^|\s)(class|id|role|data-content|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Parts of class names and ids, by what pages use them for; they stand for pages that name their parts, in training.
LOOSE = frozenset("#root html body".split())
CONTAINERS = frozenset("div section article main center table tbody tr td header footer aside nav form ul ol dl".split())
CONTENT_NAMES = "article content main post entry story body text prose".split()
OTHER_NAMES = "ad ads advert advertisement banner sponsor promo nav navbar menu breadcrumb header masthead footer sidebar aside widget related comment comments reply disqus cookie consent notice alert popup modal newsletter subscribe signup share social login search pagination tags copyright legal skip sponsored promoted discussion gdpr toolbar".split()


#: The hidden states.
NONE, CONTENT, STRUCTURE = STATES = (0, 1, 2)


class Page(NamedTuple):
    tags: list[str]
    parents: list[int]
    features: list[list[str]]
    labels: list[int | None]  # as the page marks them
    texts: list[tuple[int, str]]  # (element, text) in page order; a block's edge is (-1, "")


def parse(source: str) -> Page:
    """The elements of a page in order, leniently: unknown closings are passed over and open elements end with the page.

    Text that hangs on the root, html or body itself is an element of its own, ``#text``.
    """
    tags, parents, attributes, texts, stack = ["#root"], [-1], [""], [], [0]
    places: dict[str, list[int]] = {}  # of the open elements of each kind in the stack
    loose = -1  # the open #text
    at, lower = 0, None

    def edge() -> None:
        if texts and texts[-1][0] >= 0:
            texts.append((-1, ""))

    def close(upto: int) -> None:
        while len(stack) > upto:
            tag = tags[stack.pop()]
            places[tag].pop()
            if tag not in INLINE:
                edge()

    def write(text: str) -> None:
        nonlocal loose
        node = stack[-1]
        if tags[node] in LOOSE and not text.isspace():
            if loose < 0:
                loose = len(tags)
                tags.append("#text")
                parents.append(node)
                attributes.append("")
            node = loose
        texts.append((node, text))

    while at < len(source):
        m = TOKEN.search(source, at)
        text = source[at : m.start() if m else len(source)]
        if text:
            write(entities.unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        name = m[2] or m[5]
        if not name:
            if m[0].startswith("<![CDATA["):
                write(m[0][9:].removesuffix("]]>"))
            continue
        name, rest = name.lower(), m[3] if m[2] else m[6]
        if m[1] or m[4]:
            if places.get(name):
                close(places[name][-1])
                loose = -1
            elif name in ("p", "br"):
                edge()
            continue
        if name not in INLINE:
            # a block ends an open paragraph; items and cells end their like
            ends = CLOSES.get(name, set()) | {"p"} if name not in VOID or name == "hr" else set()
            if ends:
                last = max((places[kind][-1] for kind in ends if places.get(kind)), default=0)
                if last > max((places[kind][-1] for kind in SCOPES if places.get(kind)), default=0):
                    close(last)
            edge()
            loose = -1
        node = len(tags)
        tags.append(name)
        parents.append(stack[-1])
        attributes.append(rest)
        if name in RAW:
            lower = lower or source.lower()
            end = lower.find(f"</{name}", at)
            at = len(source) if end < 0 else end
        if name not in VOID and not (rest.endswith("/") and name in ("path", "circle", "rect")):
            places.setdefault(name, []).append(len(stack))
            stack.append(node)
    return _observe(tags, parents, attributes, texts)


def _observe(tags: list[str], parents: list[int], attributes: list[str], texts: list[tuple[int, str]]) -> Page:
    n = len(tags)
    chars, linked, stops, direct = [0] * n, [0] * n, [0] * n, [0] * n
    for node, text in texts:
        if node >= 0:
            chars[node] += len(text)
            stops[node] += text.count(".") + text.count(",")
            direct[node] += 0 if text.isspace() else len(text)
    for i in range(n - 1, 0, -1):
        if tags[i] in INLINE and tags[i] != "a":
            direct[parents[i]] += direct[i]
    for i in range(n - 1, 0, -1):
        if tags[i] == "a":
            linked[i] = chars[i]
        p = parents[i]
        chars[p] += chars[i]
        linked[p] += linked[i]
        stops[p] += stops[i]
    features, labels = [], []
    for i in range(n):
        own = [f"t:{tags[i]}", f"n:{min(8, int(math.log2(chars[i] + 1)))}", f"l:{4 * linked[i] // (chars[i] + 1)}", f"s:{min(3, 50 * stops[i] // (chars[i] + 1))}"]
        if tags[i] in CONTAINERS and direct[i]:
            # how much text a container holds itself, not only in what it holds
            own.append(f"d:{min(8, int(math.log2(direct[i] + 1)))}")
        label = None
        for m in NAMED.finditer(attributes[i]) if attributes[i] else ():
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key == "data-content":
                label = int(value == "1")
            elif key in ("hidden", "aria-hidden"):
                if value.lower() != "false":
                    own.append("hidden")
            else:
                own += {f"c:{x.lower()}" for x in PART.findall(value)}
        features.append(own)
        labels.append(label)
    return Page(tags, parents, features, labels, texts)


def landmarks(page: Page) -> list[int] | None:
    """Labels of a page that marks its own article or main part; None for any other."""
    if not {"article", "main"} & set(page.tags):
        return None
    out = []
    for i, tag in enumerate(page.tags):
        inside = i > 0 and out[page.parents[i]]
        names = {f[2:] for f in page.features[i] if f[:2] == "c:"}
        if tag in NEVER or tag in ("header", "footer", "aside") or names & set(OTHER_NAMES) or "hidden" in page.features[i]:
            out.append(0)
        else:
            out.append(int(tag in ("article", "main") or inside))
        # what lies in a part that is no content stays out
        if i and not inside and tag not in ("article", "main"):
            out[-1] = 0
    return out


def labelled_pages() -> Iterator[str]:
    """Small pages with every element labelled (data-content): for each name that pages give their parts, one with a named main part or none, and loose text."""
    passages = (
        "This is a longer passage of running text, which tells a story; it has several sentences, with commas. It goes on for a while. ",
        "It was so, he said. No, it was not, said she. ",
        "A passage without many stops that goes on and on about how the days went by until the season came to an end. ",
        "He went home, and then he slept well. ",
    )
    for k, good in enumerate(CONTENT_NAMES):
        for j, bad in enumerate(OTHER_NAMES):
            kind = ("div", "section", "aside", "ul", "div", "header", "footer", "div", "p")[(j + k) % 9]
            prose = passages[(j + 2 * k) % 4] * (1, 2, 5)[(j + k) % 3]
            short = passages[(j // 2 + k) % 4] * (1, 3, 6)[j % 3] if (j + k) % 2 == 0 else "Short words here"
            link = f'<a data-content=0 href="/x">Link {j}</a> ' * (j % 4)
            linked = '<p data-content=1><a data-content=1 href="/z">A paragraph that is a link</a></p>' if (j + k) % 2 == 0 else ""
            head, part = f"h{1 + (j + k) % 3}", ("ul", "ol", "blockquote", "pre", "table", "figure")[(j + k) % 6]
            title = f"<{head} data-content=0>Name</{head}>" if j % 3 == 0 else ""
            other = f'<{kind} data-content=0 class="{bad}">{title}<p data-content=0>{link}{short}</p></{kind}>'
            cell = {"ul": "li", "ol": "li", "table": "td", "figure": "figcaption"}.get(part, "span")
            inner = f'<{head} data-content=1>{("A title", "Title of a longer story", "T")[(j + k) % 3]}</{head}><p data-content=1>{prose}<b data-content=1>bold</b> <a data-content=1 href="/y">more</a></p><{part} data-content=1><{cell} data-content=1>One, two.</{cell}></{part}>{linked}<{part} data-content=1>Plain words</{part}><p data-content=1>{prose}</p>'
            box = ("div", "section", "article", "main")[(j + k) % 4]
            own = f"<{box} data-content=1>{inner}{other}</{box}>"
            bodies = f'{other}<{box} data-content=1 class="{good}">{inner}</{box}>', f'<{box} data-content=1 id="{good}">{inner}{other}</{box}>', f"<div data-content=0>{own}{other}</div>", f"{other}{inner}", f"{inner}{other}"
            more = "".join(f'<{kind} data-content=0 class="{name}"><p data-content=0>{short}</p></{kind}>' for name in (OTHER_NAMES[j - 1], OTHER_NAMES[j - 2]))
            for body in (bodies[(j + k) % 5], bodies[1 + (j + k) % 2]):
                yield f"<html data-content=0><head data-content=0></head><body data-content=0>{body}{more}</body></html>"
        # text that stands in containers without a name of use, beside others with links, few words or another's name
        for j, bad in enumerate(OTHER_NAMES):
            prose, short = passages[(j + k) % 4] * (2, 3, 6, 9)[(j + k) % 4], passages[j % 4] if (j + k) % 2 == 0 else ("Go", "Short", "Two words", "Short words here", "Some more short words in a row")[(j + k // 2) % 5]
            box, other = ("div", "div", "section", "div", "td")[(j + k) % 5], ("div", "section", "div", "aside", "footer")[(j + 2 * k) % 5]
            links = "".join(f'<a data-content=0 href="/{i}">Link {i}</a> ' for i in range(2 + j % 5))
            inner = (prose, f"{prose}<br data-content=1>{prose}", f"{prose}<b data-content=1>bold</b> and <i data-content=1>so</i> on. {prose}", f"<h2 data-content=1>A title</h2>{prose}")[(j + k) % 4]
            if j % 3 == 1:
                beside = ("aside", "footer", "aside", "header")[(j + k) % 4]
                inner += f"<{beside} data-content=0>{prose if k % 2 else short}</{beside}>" + ("" if k % 3 else f"<p data-content=1>{prose}</p>")
            own = f'<{box} data-content=1 id="{"abcdefgh"[(j + k) % 8]}{k}">{inner}</{box}>'
            for _ in range((j + k) % 4):
                own = f"<div data-content=0>{own}</div>"
            if box == "td":
                own = f"<table data-content=0><tr data-content=0>{own}</tr></table>"
            # a name of use with another's before it is no content
            named = f'<{other} data-content=0 class="{bad if j % 4 else f"{bad}-{good}"}">{f"<p data-content=0>{short * 3}</p>" if (j + k) % 3 == 1 else short}</{other}>'
            top = f"<div data-content=0>{links}</div>" if j % 2 else f"<header data-content=0>{links}</header>"
            end = f"<footer data-content=0>{short}</footer>" if j % 3 else ""
            yield f"<html data-content=0><body data-content=0>{(top, '', named)[j % 3]}{own}{(named, '', top + named)[(j + k) % 3]}{end}</body></html>"
        # text that hangs on the root or body is content; there is little else on such a page
        prose = passages[k % 4] * (1 + k)
        yield from (prose, "Short words here", f"<body data-content=0>{prose}<p data-content=1>{prose}</p>", f'<body data-content=0>{prose}<nav data-content=0><a data-content=0 href="/x">Link</a></nav>')


def states(page: Page, labels: list[int | None]) -> list[int]:
    """NONE, CONTENT or STRUCTURE of each element: an element without content that holds some is structure; loose text without a label is content."""
    out = [CONTENT if y or (y is None and page.tags[i] == "#text") else NONE for i, y in enumerate(labels)]
    for i in range(len(out) - 1, 0, -1):
        if out[i] != NONE and out[page.parents[i]] == NONE:
            out[page.parents[i]] = STRUCTURE
    return out


class Model(NamedTuple):
    """The likelihood of each feature by state, and the potentials of child given parent (of the root: first)."""

    features: dict[str, tuple[float, ...]]
    edge: tuple  # by the kind of the child, the parent's and the child's state
    first: tuple[float, ...]


def kind_of(tag: str) -> int:
    """Inline elements, those that frame the page, other containers, and the rest have potentials of their own."""
    return 3 if tag in INLINE else 2 if tag in LOOSE else int(tag in CONTAINERS)


def tally(page: Page, states: list[int]) -> Counter:
    """(kind, feature, state) counts of one labelled page."""
    out: Counter = Counter()
    for i, y in enumerate(states):
        if i == 0:
            out["r", "", y] += 1
        else:
            out["e", f"{kind_of(page.tags[i])}{states[page.parents[i]]}", y] += 1
        out["y", "", y] += 1
        for f in page.features[i]:
            out["f", f, y] += 1
    return out


def fit_counts(counts: dict[tuple[str, str, int], float], least: float = 2, extra: float = 0.5) -> Model:
    share = lambda values: tuple(v / sum(values) for v in values)
    total = [counts.get(("y", "", y), 0) + 2 * extra for y in STATES]
    features = {}
    for f in {f for kind, f, _ in counts if kind == "f"}:
        seen = [counts.get(("f", f, y), 0) for y in STATES]
        if sum(seen) >= least:
            # what a state was never seen with is as unlikely in each, however often the state was seen
            features[f] = tuple(seen[y] / total[y] + len(STATES) * extra / sum(total) for y in STATES)
    edge = tuple(tuple(share([counts.get(("e", f"{kind}{parent}", y), 0) + extra for y in STATES]) for parent in STATES) for kind in range(4))
    return Model(features, edge, share([counts.get(("r", "", y), 0) + extra for y in STATES]))


def marginals(page: Page, model: Model) -> list[float]:
    """Probability of content of each element, exactly, by one pass of messages up and one down."""
    n = len(page.tags)
    up = []
    for i in range(n):
        if page.tags[i] in NEVER:
            up.append((1.0, 0.0, 0.0))
            continue
        a, b, c = 1.0, 1.0, 1.0
        for f in page.features[i]:
            if f in model.features:
                x, y, z = model.features[f]
                a, b, c = a * x, b * y, c * z
        s = a + b + c
        up.append((a / s, b / s, c / s))
    edges = [model.edge[kind_of(tag)] for tag in page.tags]
    messages: list[tuple[float, float, float]] = [(1.0, 1.0, 1.0)] * n
    for i in range(n - 1, 0, -1):
        a, b, c = up[i]
        (e00, e01, e02), (e10, e11, e12), (e20, e21, e22) = edges[i]
        m0, m1, m2 = messages[i] = (e00 * a + e01 * b + e02 * c, e10 * a + e11 * b + e12 * c, e20 * a + e21 * b + e22 * c)
        own = page.parents[i]
        x, y, z = up[own][0] * m0, up[own][1] * m1, up[own][2] * m2
        s = (x + y + z) or 1.0
        up[own] = (x / s, y / s, z / s)
    out = [0.0] * n
    down: list[tuple[float, ...]] = [model.first] * n
    for i in range(n):
        if i:
            p = page.parents[i]
            # the parent's belief without what this child told it
            x, y, z = (d * (u / m if m else 0.0) for d, u, m in zip(down[p], up[p], messages[i]))
            (e00, e01, e02), (e10, e11, e12), (e20, e21, e22) = edges[i]
            d0, d1, d2 = x * e00 + y * e10 + z * e20, x * e01 + y * e11 + z * e21, x * e02 + y * e12 + z * e22
            s = (d0 + d1 + d2) or 1.0
            down[i] = (d0 / s, d1 / s, d2 / s)
        a, b, c = (d * u for d, u in zip(down[i], up[i]))
        out[i] = b / (a + b + c) if a + b + c else 0.0
    return out


def main_text(source: str, model: Model) -> str:
    page = parse(source)
    belief = marginals(page, model)
    pieces = [" " if node < 0 else text if belief[node] >= 0.5 else "" for node, text in page.texts]
    return " ".join("".join(pieces).split())


def fit_extractor(pages: DataFrame, *, fit_pages: int = 2000, html_col: str = "html", id_col: str = "page_id") -> Model:
    """Counted on ``labelled_pages`` and on about ``fit_pages`` pages that mark their article or main part, drawn by a hash of the id.

    That bound is on the training sample alone; a table without such pages leaves the labelled ones.
    """
    rows = pages.where(F.col(html_col).rlike("(?i)<(article|main)[\\s>]")).select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))
    n = rows.count()
    draw = F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(1 << 30)) / float(1 << 30)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for source in batch.column(0).to_pylist():
                page = parse(source)
                labels = landmarks(page)
                if labels:
                    total += tally(page, states(page, labels))
        keys = list(total)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.int64()), pa.array([total[k] for k in keys], pa.int64())], names=["kind", "feature", "y", "n"])

    found: Counter = Counter()
    if n:
        sample = rows.where(draw <= min(1.0, fit_pages / n)).select("html").mapInArrow(count, "kind string, feature string, y long, n long")
        for kind, feature, y, k in sample.groupBy("kind", "feature", "y").agg(F.sum("n")).collect():
            found[kind, feature, y] += k
    own: Counter = Counter()
    for source in labelled_pages():
        page = parse(source)
        for key, n in tally(page, states(page, page.labels)).items():
            own[key] += 20 * n
    # names are rare, so labelled pages count twenty times, and either kind of page as much as the other
    scale = sum(v for (kind, _, _), v in own.items() if kind == "y") / max(1, sum(v for (kind, _, _), v in found.items() if kind == "y"))
    return fit_counts({k: own[k] + scale * found[k] for k in own.keys() | found.keys()})


def extract_text(pages: DataFrame, model: Model, *, html_col: str = "html") -> DataFrame:
    """``pages`` with text, the main text, and n_chars, its code points.

    A null or empty html, and one without content, give an empty text and 0. Whole pages are read and nothing is
    shuffled. Input columns named text or n_chars are replaced.
    """
    held = pages.sparkSession.sparkContext.broadcast(model)
    pages = pages.drop("text", "n_chars")
    schema = extended(pages.schema, ("text", "string"), ("n_chars", "long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(source, held.value) if source else "" for source in batch.column(html_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*batch.schema.names, "text", "n_chars"])

    return pages.mapInArrow(run, schema)
