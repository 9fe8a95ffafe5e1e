"""Main-text extraction: boosted trees over DOM elements, decoded so that no kept element lies in a dropped one."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting
from ._common import table, text_slices
from .dom import Page, labels

#: The bounded training sample: pages, the longest page taken, and made-up layouts of each.
SAMPLE_PAGES, SAMPLE_CHARS, LAYOUTS = 60, 60_000, 5

_ARTICLE = re.compile(r"<(article|main)\b[^>]*>(.*?)(?:</\1\s*>|$)", re.S | re.I)


def _layout(article: str, words: list[str], rng: random.Random) -> str:
    """A page around ``article`` with menus, side columns, notices, forms and reader comments, in varying markup."""

    def says(least: int, most: int) -> str:
        return " ".join(rng.choice(words) for _ in range(rng.randint(least, most)))

    def paragraphs(n: int, least: int = 5, most: int = 60) -> str:
        return "".join(f"<p>{says(least, most)}</p>" for _ in range(rng.randint(1, n)))

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{says(1, 4)}</a></li>' for i in range(rng.randint(2, n))) + "</ul>"

    def box(*names: str) -> str:
        tag, name = rng.choice(("div", "section", "div", "aside")), rng.choice(names)
        return f'{tag} {rng.choice(("class", "id"))}="{rng.choice(("", "site-", "page-", "block ", "js-"))}{name}{rng.choice(("", "-box", "-wrap", " inner", "-1"))}"'

    def wrap(opening: str, inner: str) -> str:
        return f"<{opening}>{inner}</{opening.split()[0]}>"

    comments = wrap(box("comments", "comment-list", "disqus", "replies", "discussion", "responses"), f"<h3>{says(1, 3)}</h3>" + "".join(wrap(rng.choice(('div class="comment"', "article class=\"comment\"", "li")), f"<p>{says(5, 50)}</p>") for _ in range(rng.randint(1, 6))))
    parts = {
        "top": rng.choice((f"<header><h2>{says(1, 5)}</h2>{links(4)}</header>", wrap(box("header", "masthead", "topbar"), f"<p>{says(2, 12)}</p>{links(5)}"), "")),
        "menu": rng.choice((wrap("nav", links(9)), wrap(box("menu", "nav", "navigation", "breadcrumb"), links(9)), "")),
        "notice": rng.choice((wrap(box("cookie-notice", "consent", "banner", "notice", "gdpr"), f"<p>{says(8, 40)}</p><button>{says(1, 2)}</button>"), "")),
        "ad": rng.choice((wrap(box("ad", "advert", "promo", "sponsored", "ads"), rng.choice((says(3, 40), paragraphs(2)))), "")),
        "side": rng.choice((wrap("aside", paragraphs(3) + links(6)), wrap(box("sidebar", "widget", "related", "trending", "recommended"), paragraphs(3) + links(6)), "")),
        "form": rng.choice((f'<form action="/s"><label>{says(1, 4)}</label><input name="q"><p>{says(4, 25)}</p><button>{says(1, 2)}</button></form>', wrap(box("newsletter", "subscribe", "signup", "login"), f"<p>{says(5, 30)}</p>"), "")),
        "comments": rng.choice((comments, comments, "")),
        "foot": rng.choice((f"<footer>{says(3, 30)}</footer>", wrap(box("footer", "copyright", "legal"), paragraphs(2)), f"<footer>{paragraphs(2)}{links(5)}</footer>")),
    }
    inside = "".join(parts[k] for k in ("ad", "form", "comments") if rng.random() < 0.25)
    opening = rng.choice(("article", "article", "main", 'div class="content"', 'div id="main"', 'div class="post-body"', 'section class="entry"', 'div class="story-text"', 'div role="main"', "div"))
    opening += " vm-mark=1"
    half = rng.choice((0, len(article)))
    body = wrap(opening, article[:half] + inside + article[half:])
    order = [parts[k] for k in rng.sample(("top", "menu", "notice", "ad"), 4)] + [body] + [parts[k] for k in rng.sample(("side", "form", "comments", "ad"), 4)] + [parts["foot"]]
    inner = "".join(order)
    if rng.random() < 0.5:
        inner = wrap(rng.choice(('div id="wrapper"', "div", 'div class="page"', 'div class="container"')), inner)
    return f"<html><body>{inner}</body></html>"


def learn(pages: DataFrame) -> dict:
    """Boosted trees from SAMPLE_PAGES pages with an article or main element, picked by a fixed hash of page_id, and from
    LAYOUTS made-up pages around each of their articles. Pages of the sample have SAMPLE_CHARS characters at most, and words of
    made-up furniture are the first 20,000 of its articles. The sample alone reaches the driver."""
    usable = pages.where(F.col("html").rlike("(?i)<(article|main)[ >]") & (F.length("html") <= SAMPLE_CHARS))
    # The lowest hashes first, some four times as many as are wanted, so that most partitions send no page to the ranking.
    draw, n = F.xxhash64("page_id", F.lit(5)), usable.count()
    if n > 4 * SAMPLE_PAGES:
        usable = usable.where(draw < F.lit(-(1 << 63) + (4 * SAMPLE_PAGES << 64) // n))
    rows = usable.select("page_id", "html").orderBy(draw, "page_id", "html").limit(SAMPLE_PAGES).collect()
    rng = random.Random(17)
    sources = [r.html for r in rows]
    articles = [m[2] for s in sources if (m := _ARTICLE.search(s))] or ["<h1>One two</h1><p>Three four five six seven eight nine ten, eleven twelve.</p>" * 5]
    words = [w for a in articles for w in re.sub(r"<[^>]*>|&\w+;", " ", a).split()][:20_000] or ["word"]
    made = [_layout(a, words, rng) for a in articles for _ in range(LAYOUTS)]
    read = [Page(s) for s in [*sources, *made]]
    x = np.concatenate([p.features() for p in read])
    y = np.concatenate([labels(p) for p in read])
    own = np.concatenate([[e.own > 0 for e in p.elements] for p in read])
    # The root lies above all and is always kept; elements without words of their own teach what lies around them.
    return boosting.fit(x[own | y], y[own | y].astype(float))


def decode(page: Page, odds: np.ndarray) -> np.ndarray:
    """The consistent choice of highest value: an element can be kept only if its parent is.

    An element's own words weigh in with the log odds of being main text; a subtree of negative value is cut whole.
    """
    n = len(page.elements)
    value = np.array([(np.sqrt(e.own) if e.own else 0.25) for e in page.elements]) * odds
    value[0] = 0.0
    for i in range(n - 1, 0, -1):
        if value[i] > 0:
            value[page.elements[i].parent] += value[i]
    kept = np.zeros(n, bool)
    kept[0] = True
    for i in range(1, n):
        kept[i] = kept[page.elements[i].parent] and value[i] > 0
    kept[0] = odds[0] > 0 and page.elements[0].own > 0
    return kept


def extract(pages: DataFrame, model: dict) -> DataFrame:
    """``pages`` with text (the main text, empty if none) and n_chars; of those names are replaced, other columns stay.

    Each page is read whole and for itself, nothing is shuffled. Null or empty html gives an empty text; html without
    any markup is judged as one block; broken markup is read as far as it goes. Contents of script, style, noscript,
    template, textarea, title and iframe are no text; those of formulas, drawings and objects are. Repeated rows each come back, a very
    long page is read in one task, an element whose value is exactly zero is left out, and an empty table gives no rows.
    """
    added = ("text", "n_chars")
    kept = [c for c in pages.columns if c not in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, sources in text_slices(batch.column(1), 1_000_000):
                read = [Page(s or "") for s in sources]
                odds = boosting.margins(model, np.concatenate([p.features() for p in read]))
                ends = np.cumsum([len(p.elements) for p in read])
                texts = [p.main_text(decode(p, own)) for p, own in zip(read, np.split(odds, ends[:-1]), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["row", *added])

    rows = pages.select(F.struct(*(pages[c] for c in kept)).alias("row"), F.col("html").cast("string").alias("html"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(run, f"row {kind}, text string, n_chars long").select("row.*", *added)


def op9_html(spark, sf_dir: str) -> DataFrame:
    """The main text of every page; see ``extract``."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, learn(pages)).select("page_id", "url", "text", "n_chars")
