"""Main text of web pages as the maximum-scoring run of tokens.

A page is a sequence of words and tags. Words score positive where the article's words
stand (by the kind of element around them) and tags negative, by log odds counted on
labelled pages: pages that mark their own article. One linear scan finds the contiguous
run with the highest sum; text of the run outside menus, notices, adverts, forms and reader
comments is the result. Where a page marks its article, being inside the mark is one more
weighted feature; pages without a mark are scored by their elements alone.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|select|object|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>", re.S | re.I)
ATTRIBUTE = re.compile(r"(class|id|role|style|itemprop|aria-hidden|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
PIECES = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")

INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q ruby rt s samp small span strike "
             "strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
BLOCKS = {**dict.fromkeys(HEADINGS, "heading"), **dict.fromkeys(("p", "blockquote", "pre"), "prose"), **dict.fromkeys(("li", "dd", "dt"), "item"),
          **dict.fromkeys(("td", "th", "caption"), "cell")}
TAGS = set("a article aside b blockquote body br button dd div dl dt em figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html i "
           "img input label li link main meta nav ol option p pre section span strong table tbody td tfoot th thead title tr u ul".split())
ELEMENT_HINTS = {"nav": "menu", "menu": "menu", "footer": "footer", "header": "header", "aside": "side", "form": "form", "button": "form",
                 "fieldset": "form", "dialog": "notice", "head": "head"}
ROLE_HINTS = {"navigation": "menu", "menu": "menu", "menubar": "menu", "banner": "header", "contentinfo": "footer", "complementary": "side",
              "search": "form", "form": "form", "dialog": "notice", "alertdialog": "notice", "alert": "notice"}
WORD_HINTS = {
    **dict.fromkeys("nav navbar navigation menu breadcrumb breadcrumbs pagination pager".split(), "menu"),
    **dict.fromkeys("footer colophon copyright".split(), "footer"), **dict.fromkeys("header masthead topbar".split(), "header"),
    **dict.fromkeys("sidebar aside widget related recommended recommendations social share sharing".split(), "side"),
    **dict.fromkeys("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion".split(), "advert"),
    **dict.fromkeys("cookie cookies consent gdpr notice popup modal overlay newsletter subscribe banner paywall".split(), "notice"),
    **dict.fromkeys("comment comments disqus replies respond".split(), "comment"),
    **dict.fromkeys("form login signup search".split(), "form")}
#: Elements whose class never makes them boilerplate, since it describes the whole page.
WHOLE = {"html", "body", "main", "article"}


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(raw)} if raw.strip() else {}


def hint_of(name: str, raw: str, in_article: bool) -> str:
    """What kind of boilerplate an element holds; empty for none. An article's own header is part of it."""
    found = ELEMENT_HINTS.get(name, "")
    if not found and raw and name not in WHOLE:
        at = attributes(raw)
        if "hidden" in at or at.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", at.get("style", ""), re.I):
            return "hidden"
        found = ROLE_HINTS.get(at.get("role", "").lower(), "")
        for piece in PIECES.findall(f"{at.get('class', '')} {at.get('id', '')}") if not found else ():
            found = found or WORD_HINTS.get(piece.lower(), "")
    return "" if found == "header" and in_article else found


def is_article(name: str, raw: str) -> bool:
    if name in ("article", "main"):
        return True
    return "articlebody" in raw.lower() and attributes(raw).get("itemprop", "").lower() == "articlebody"


def tokens(page: str) -> Iterator[tuple[str, str, str, bool]]:
    """(kind, feature, text, inside a marked article): kind is w for a run of text with one feature, t for a tag.

    A closing tag closes down to its element and is ignored where none is open; an article that opens
    inside boilerplate closes it, since the boilerplate was left open.
    """
    stack: list[tuple[str, str, bool, str, bool]] = []  # name, hint, in article, block, in link
    hint, inside, block, link, at = "", False, "other", False, 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            yield "w", f"w:{hint}:{int(link)}:{block}", page[at:m.start()], inside
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        shown = name if name in TAGS else "other"
        if m[2]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            yield "t", f"t:{shown}:close", " " if name not in INLINE else "", inside
        else:
            marks = is_article(name, m[4])
            if marks and hint and hint != "comment":
                stack = [s for s in stack if not s[1]]
                hint = ""
            own = hint or hint_of(name, m[4], inside)
            yield "t", f"t:{shown}:{own or 'open'}", " " if name not in INLINE else "", inside
            if name not in VOID and not m[4].endswith("/"):
                stack.append((name, own, inside or (marks and not own), BLOCKS.get(name, block if name in INLINE else "other"), link or name == "a"))
        _, hint, inside, block, link = stack[-1] if stack else ("", "", False, "other", False)
    if at < len(page):
        yield "w", f"w:{hint}:{int(link)}:{block}", page[at:], inside


def count_features(page: str) -> Counter:
    """(feature, inside the article) counts of one page; none if it marks no article."""
    out: Counter = Counter()
    found = list(tokens(page))
    if not any(inside for *_, inside in found):
        return out
    for kind, feature, text, inside in found:
        n = len(text.split()) if kind == "w" else 1
        good = inside and not feature.split(":")[1] if kind == "w" else inside
        if n:
            out[feature, good] += n
            if kind == "w":
                out["m:in" if inside else "m:out", good] += n
    return out


def weights_from(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Log odds that a feature stands inside, smoothed by one; words at most 2 and marks at most 4 to either side; tags are negative."""
    out = {}
    for feature in sorted({f for f, _ in counts}):
        odds = math.log((counts.get((feature, True), 0) + 1) / (counts.get((feature, False), 0) + 1))
        top, low = {"t": (-0.01, -4.0), "m": (4.0, -4.0), "w": (2.0, -2.0)}[feature[0]]
        out[feature] = min(top, max(low, odds))
    return out


def best_run(scores: list[float]) -> tuple[int, int]:
    """(from, to) of the contiguous run with the largest sum, the first of equal ones; empty if none is above zero."""
    best, best_from, best_to, total, since = 0.0, 0, 0, 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, since = 0.0, i
        total += s
        if total > best:
            best, best_from, best_to = total, since, i + 1
    return best_from, best_to


def scored(page: str, weights: dict[str, float]) -> tuple[list[float], list[str]]:
    """The score of every token, and the text it stands for."""
    found = list(tokens(page))
    has_mark = any(inside for *_, inside in found)
    run, scores = [], []
    for kind, feature, text, inside in found:
        if kind == "t":
            scores.append(weights.get(feature, -0.3))
            run.append(text)
            continue
        hint, link = feature.split(":")[1:3]
        n = len(text.split())
        value = weights.get(feature, -2.0 if hint else -0.5 if link == "1" else 1.0)
        if hint:
            value = min(value, -0.5)
        if has_mark:
            value += weights.get("m:in" if inside else "m:out", 4.0 if inside else -4.0)
        scores.append(n * value)
        run.append("" if hint else html.unescape(text) if "&" in text else text)
    return scores, run


def extract(page: str, weights: dict[str, float]) -> str:
    """The text of the best run: white space joined to one space, blocks joined by one space; empty if no run scores above zero."""
    scores, texts = scored(page, weights)
    since, until = best_run(scores)
    return " ".join("".join(texts[since:until]).split())


def learn(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = 2000) -> dict[str, float]:
    """Weights from at most `sample` pages that mark their article, first in hash order of the id."""
    some = pages.filter(F.col(html_col).rlike(r"(?i)<(article|main)\b|articlebody")).select(F.col(id_col).alias("id")).filter(
        "id IS NOT NULL").orderBy(F.xxhash64("id"), "id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for page in batch.column(0):
                total.update(count_features(page.as_py() or ""))
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in total], pa.string()), pa.array([bool(g) for _, g in total], pa.bool_()),
                                          pa.array(list(total.values()), pa.int64())], ["feature", "good", "n"])

    chosen = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).join(F.broadcast(some), "id").select("html")
    rows = chosen.mapInArrow(run, "feature string, good boolean, n long").groupBy("feature", "good").agg(F.sum("n").alias("n")).collect()
    return weights_from({(r["feature"], r["good"]): r["n"] for r in rows})  # a few hundred features whatever the input


def main_text(pages: DataFrame, weights: dict[str, float], id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """(id, url, text, n_chars) of each row of pages, from the whole html.

    Null or empty html, and pages without a run of positive score, give an empty text.
    Repeated rows each have their row; nothing is cut. Other columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(page.as_py() or "", weights) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    rows = pages.select(F.col(id_col), F.col(url_col), F.col(html_col).alias("__html"))
    schema = rows.select(id_col, url_col).schema.add("text", "string").add("n_chars", "long")
    return rows.mapInArrow(run, schema)
