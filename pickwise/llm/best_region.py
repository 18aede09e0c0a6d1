"""Main text of a web page as its maximum-scoring token run.

A page is a sequence of words and tags. Words score above zero, tags below; the weights are log likelihood ratios of lying inside or
outside the content, counted on labelled pages. One linear scan finds the contiguous run with the largest sum. Containers that are
never content (menus, adverts, forms, comments ...) hold no words, wherever they stand.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pickwise.llm.common import bounded_sample

NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9:-]*)")
MARK = re.compile("[>\"']")
# fixed values: elements whose content is never markup, up to their end tag
RAW = frozenset("script style noscript template iframe textarea title svg xmp noembed noframes".split())
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
# fixed values: elements whose text is never article text, and names that mark such containers
DROPPED = frozenset("nav header footer aside form button select option dialog menu head fieldset object canvas label".split())
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|sponsor(?:ed)?|promo|banner|nav(?:bar|igation)?|menu|breadcrumbs?|sidebar|side|footer|masthead|"
    r"cookies?|consent|notice|notices|alert|popup|modal|newsletter|subscribe|signup|share|sharing|social|related|recommend(?:ed|ations)?|"
    r"comments?|comment-list|disqus|replies|reviews?|pagination|pager|widget|toolbar|search|login|legal|copyright|disclaimer)(?:$|[\s_-])",
    re.I,
)
# of elements that hold the article itself, only these names say that they do not
KEPT = frozenset("article main body html".split())
OWN_NAMES = re.compile(r"(?:^|[\s_-])(?:adverts?|advertisement|sponsor(?:ed)?|promo|comments?|repl(?:y|ies))(?:$|[\s_-])", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article blockquote body center dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 hr html li main ol p pre section "
    "summary table tbody td tfoot th thead tr ul caption header footer nav aside form fieldset".split()
)
LABEL_TAGS = frozenset(("article", "main"))
WEIGHTS_ROWS, WEIGHTS_CHARS = 500, 10_000_000
LEAST_WORD, LEAST_TAG = 0.05, -0.01


def tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, closing, attributes) of every tag, comment and declaration, in order; the latter two, and raw elements up to
    their end tag, have no name. A tag ends at the first ``>`` outside quotes, or at the end of the page; a quote that is never closed
    is a plain character. Every place is looked at a bounded number of times."""
    size, open_ended, at = len(page), {"'": False, '"': False}, 0
    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = size if end < 0 else end + 3
            yield start, at, "", False, ""
            continue
        if page.startswith(("<!", "<?"), start):
            end = page.find(">", start)
            at = size if end < 0 else end + 1
            yield start, at, "", False, ""
            continue
        name = NAME.match(page, start + 1)
        at = start + 1
        if not name:
            continue
        end, at = size, name.end()
        while mark := MARK.search(page, at):
            at = mark.end()
            if mark[0] == ">":
                end = mark.start()
                break
            close = -1 if open_ended[mark[0]] else page.find(mark[0], at)
            if close < 0:
                open_ended[mark[0]] = True
            else:
                at = close + 1
        at = min(size, end + 1)
        closing, word = page[start + 1] == "/", name[1].lower()
        if word in RAW and not closing:
            stop = re.compile(rf"</{word}\s*>", re.I).search(page, at)
            at = stop.end() if stop else size
            yield start, at, "", False, ""
        else:
            yield start, at, word, closing, page[name.end() : end]


def tokens(page: str) -> list[tuple[str, str, int]]:
    """(kind, value, article depth): kind "w" holds the raw words of a text run, "t" a tag, "b" a block break.

    Words of dropped containers are left out; an unclosed container ends with its parent or the page. A tag cut off by the end of
    the page counts as a tag.
    """
    out: list[tuple[str, str, int]] = []
    stack: list[tuple[str, bool]] = []
    held: Counter = Counter()  # open elements by name
    dropped = inside = at = 0

    def text(end: int) -> None:
        if end > at and not dropped:
            out.append(("w", page[at:end], inside))

    for start, end, name, closing, attributes in tags(page):
        text(start)
        at = end
        if not name:
            continue
        if closing:
            if held[name]:
                while stack:
                    n, drop = stack.pop()
                    held[n] -= 1
                    dropped -= drop
                    inside -= n in LABEL_TAGS
                    if n == name:
                        break
        elif name not in VOID and not attributes.endswith("/"):
            if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == name:
                dropped -= stack.pop()[1]
                held[name] -= 1
            # an article's own heading block is part of it
            drop = name in DROPPED and not (name == "header" and inside) or _marked(attributes, OWN_NAMES if name in KEPT else NAMES)
            stack.append((name, drop))
            held[name] += 1
            dropped += drop
            inside += name in LABEL_TAGS
        if name in BLOCK:
            out.append(("b", "", inside))
        elif name == "br":
            out.append(("w", " ", inside))
        out.append(("t", "/" * closing + name, inside))
    text(len(page))
    return out


def _marked(attributes: str, names: re.Pattern = NAMES) -> bool:
    if not attributes or attributes.isspace():
        return False
    for key, value in ATTRIBUTE.findall(attributes):
        value = value.strip("\"'")
        key = key.lower()
        if key in ("class", "id"):
            if names.search(value):
                return True
        elif key == "role":
            if value.lower() in ROLES:
                return True
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True
        elif key == "style" and "display:none" in value.replace(" ", "").lower():
            return True
    return False


def counts(page: str) -> tuple[Counter, Counter]:
    """Tokens inside and outside the labelled element; both empty if the page has no label."""
    seq = tokens(page)
    inner, outer = Counter(), Counter()
    if any(d for _, _, d in seq):
        for kind, value, depth in seq:
            if kind == "t":
                (inner if depth else outer)[value] += 1
            elif kind == "w":
                (inner if depth else outer)["w"] += len(value.split())
    return inner, outer


def weights(inner: Counter, outer: Counter) -> dict[str, float]:
    """Log likelihood ratio of each tag, below zero, and of a word ("w"), above zero; "?" is a tag never seen."""
    n_in, n_out = sum(inner.values()) + 1.0, sum(outer.values()) + 1.0
    kinds = len(set(inner) | set(outer)) + 1
    def ratio(t):
        return math.log((inner[t] + 0.5) / (n_in + 0.5 * kinds)) - math.log((outer[t] + 0.5) / (n_out + 0.5 * kinds))

    out = {t: min(LEAST_TAG, ratio(t)) for t in set(inner) | set(outer)}
    out["w"] = max(LEAST_WORD, ratio("w")) if n_in > 1 else 1.0
    out["?"] = -0.5
    return out


def fit(pages: DataFrame, rows: int = WEIGHTS_ROWS, chars: int = WEIGHTS_CHARS) -> dict[str, float]:
    """Weights from pages that mark their content with an article or main element: a sample of at most ``rows`` rows."""
    marked = pages.filter(F.lower("html").rlike("<(article|main)[\\s>]")).select("html")
    sample = bounded_sample(marked, ["html"], F.length("html"), rows, chars)
    inner, outer = Counter(), Counter()
    for r in sample.toLocalIterator():
        a, b = counts(r.html)
        inner += a
        outer += b
    return weights(inner, outer)


def best_run(scores: list[float]) -> tuple[int, int]:
    """[start, end) of the contiguous run with the largest sum; the first and shortest of equals; (0, 0) if none is above zero."""
    best, start, end, total, begin = 0.0, 0, 0, 0.0, 0
    for i, s in enumerate(scores):
        total += s
        if total <= 0:
            total, begin = 0.0, i + 1
        elif total > best:
            best, start, end = total, begin, i + 1
    return start, end


def main_text(page: str | None, weight: dict[str, float]) -> str:
    """Blocks of the best run, one per line; "" for no page or no words."""
    if not page:
        return ""
    seq = tokens(page)
    unseen, word = weight["?"], weight["w"]
    scores = [weight.get(v, unseen) if k == "t" else word * len(v.split()) if k == "w" else 0.0 for k, v, _ in seq]
    start, end = best_run(scores)
    # a run that lies in a content element stands for all of it
    if end > start and any(seq[i][2] for i in range(start, end) if seq[i][0] == "w"):
        while start > 0 and seq[start - 1][2]:
            start -= 1
        while end < len(seq) and seq[end][2]:
            end += 1
    blocks, part = [], []
    for kind, value, _ in seq[start:end]:
        if kind == "w":
            part.append(value)
        elif kind == "b" and part:
            blocks.append("".join(part))
            part = []
    blocks.append("".join(part))
    clean = (" ".join(entities.unescape(b).split()) for b in blocks)
    return "\n".join(b for b in clean if b)


_OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract(pages: DataFrame, weight: dict[str, float] | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html); a map-only job after the fit.

    NULL or empty html gives "" and 0; NULL ids and urls are kept, repeated rows stay, other columns are ignored, and pages of any
    length are read whole. Character references are decoded once; white space inside a block becomes one space.
    """
    weight = fit(pages) if weight is None else weight

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py(), weight) for h in batch["html"]]
            yield pa.RecordBatch.from_arrays(
                [batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=_OUT
            )

    narrow = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return narrow.mapInArrow(run, "page_id long, url string, text string, n_chars long")
