"""HTML extraction: boosted trees score DOM nodes, a hierarchical decoding picks the main text.

Every page becomes a tree of block nodes. A node's features are its subtree's text, tag and link densities, its tag
and the parts of its class, id and role names, the same of its ancestors, its depth, and statistics of its siblings.
Boosted trees give each node a probability of main text; the decoding then finds the most likely choice for the whole
tree in which a dropped node's descendants are dropped with it, so ancestors and descendants never contradict. Where a
page marks its main text by ``article`` or ``main``, that counts as evidence of its own beside the trees'.

The trees are fitted on a bounded sample of pages. No labels exist, so the sample's pages teach twice: pages that mark
their main text by ``article`` or ``main`` are used as they are, and their blocks are set into varied layouts (other
containers, wrappers, adverts inside the text, reader comments under it) where the answer is known by construction.

Defined cases: null, empty or text-free html gives empty text, and so do pages whose nodes all look foreign; unclosed,
self-closed and crossed tags are repaired as browsers do; very long pages are read whole; of choices that are equally
likely a node is dropped; rows repeat as they come; extra columns, whatever their names, are ignored; without a single
usable page the layouts hold made-up words. Pages over 100,000 characters take no part in the fit.
"""

from __future__ import annotations

import random
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from recordkeep.llm.boosting import Trees
from recordkeep.llm.dom import WIDTH, Page
from recordkeep.llm.sampling import fit_sample
from recordkeep.llm.tables import table

#: Pages that the trees are fitted on, at most.
FIT_PAGES = 200
LAYOUTS = 8
OWN = 4  # times that a page which marks its main text counts
SAYS = 4.0  # log odds that a page's own marks of its main text, or of foreign parts in it, add to a node
BLOCKS = 14  # of a page's blocks, those that one training layout uses

# How regions are commonly marked up, (tag, class).
MAIN = [("article", ""), ("main", ""), ("article", "post"), ("div", "content"), ("div", "post-body"), ("div", "entry-content"), ("div", "article-text"), ("section", "story"), ("div", "main"), ("div", ""), ("div", ""), ("section", ""), ("div", "text"), ("div", "entry"), ("div", "page body"), ("section", "text")]
REGIONS = {
    "top": [("header", ""), ("div", "header"), ("header", "masthead"), ("div", "banner"), ("div", ""), ("div", "topbar")],
    "menu": [("nav", ""), ("div", "menu"), ("ul", "nav"), ("div", "breadcrumbs"), ("nav", "main-menu"), ("div", ""), ("div", "navigation"), ("div", "nav"), ("div", "toc")],
    "side": [("aside", ""), ("div", "sidebar"), ("div", "widget"), ("aside", "related"), ("div", "right-rail"), ("div", "complementary"), ("div", "widget-area")],
    "ad": [("div", "ad"), ("div", "ads"), ("aside", "advert"), ("div", "sponsored"), ("section", "promo")],
    "notice": [("div", "cookie-notice"), ("div", "alert"), ("section", "consent-popup"), ("div", "notice")],
    "form": [("form", ""), ("form", "subscribe"), ("div", "newsletter"), ("form", "search")],
    "share": [("div", "share"), ("ul", "social"), ("div", "tags"), ("div", "meta")],
    "comments": [("div", "comments"), ("section", "comments"), ("ol", "comment-list"), ("div", "discussion"), ("section", "respond")],
    "bottom": [("footer", ""), ("div", "footer"), ("footer", "copyright"), ("div", "legal"), ("div", ""), ("div", "contentinfo"), ("div", "bottom")],
}
WRAPPERS = ["", "wrapper", "container", "page", "row", "layout", "site"]
MARKED = {"article", "main"}
FOREIGN = {"nav", "header", "footer", "aside", "form"}
FOREIGN_WORDS = {"ad", "ads", "advert", "sidebar", "comments", "comment", "share", "social", "related", "notice", "promo", "menu", "cookie", "newsletter"}


def marked(page: Page) -> np.ndarray | None:
    """Nodes in the page's own ``article`` or ``main``, without foreign parts; null if it has none."""
    inside = np.zeros(len(page.nodes), bool)
    foreign = np.zeros(len(page.nodes), bool)
    for i, n in enumerate(page.nodes[1:], 1):
        foreign[i] = foreign[n.parent] or n.tag in FOREIGN or bool(n.words & FOREIGN_WORDS)
        inside[i] = (inside[n.parent] or n.tag in MARKED) and not foreign[i]
    return inside if inside.any() else None


def told(page: Page, p: np.ndarray) -> np.ndarray:
    """Probabilities with what the page says itself: in its ``article`` or ``main`` a node without foreign marks is likelier, one with them less likely."""
    own = marked(page)
    if own is None:
        return p
    inside = np.zeros(len(page.nodes), bool)
    for i, n in enumerate(page.nodes[1:], 1):
        inside[i] = inside[n.parent] or n.tag in MARKED
    odds = np.log(np.clip(p, 1e-6, 1)) - np.log(np.clip(1 - p, 1e-6, 1)) + np.where(own, SAYS, np.where(inside, -SAYS, 0.0))
    return 1 / (1 + np.exp(-odds))


def layout(blocks: list[str], rng: random.Random) -> tuple[str, str]:
    """A page around ``blocks``, and the class part that marks its main nodes."""
    pool = " ".join(blocks).split()[:400] or [f"word{k}" for k in range(60)]
    some = lambda a, b: " ".join(rng.choice(pool) for _ in range(rng.randint(a, b)))

    def region(kind: str) -> str:
        named = [x for x in REGIONS[kind] if x[0] in FOREIGN]
        tag, name = rng.choice(named if named and rng.random() < 0.4 else REGIONS[kind])
        item = "li" if tag in ("ul", "ol") else rng.choice(["p", "div", "span"])
        if kind == "menu" or kind == "share" or kind == "side" and rng.random() < 0.5:
            links = [f'<a href="#">{some(1, 4)}</a>' for _ in range(rng.randint(2, 9))]
            inner = "".join(f"<li>{x}</li>" for x in links) if item == "li" else f"<ul>{''.join(f'<li>{x}</li>' for x in links)}</ul>" if rng.random() < 0.6 else " ".join(links)
        elif kind == "comments":
            inner = "".join(f"<{item}>{some(1, 2)}<p>{some(4, 60)}.</p></{item}>" for _ in range(rng.randint(1, 5)))
        elif kind == "form":
            inner = f"<p>{some(2, 9)}</p><label>{some(1, 2)}</label><input name=x>"
        elif kind == "top":
            inner = rng.choice([f"<h1>{some(1, 4)}</h1>", f"<div>{some(1, 5)}</div>", ""]) + f'<a href="#">{some(1, 3)}</a>'
        else:
            inner = "".join(f"<{item}>{some(2, 25)}.</{item}>" for _ in range(rng.randint(1, 3))) if rng.random() < 0.6 else some(2, 20) + "."
        return f'<{tag} class="{name}">{inner}</{tag}>' if name else f"<{tag}>{inner}</{tag}>"

    def marked_up(block: str, kind: str) -> str:
        if kind in ("ul", "ol", "table"):
            words = block.split() or ["x"]
            step = max(1, len(words) // rng.randint(1, 6))
            items = [" ".join(words[i : i + step]) for i in range(0, len(words), step)]
            row = "<tr class=zz><td class=zz>{}</td></tr>" if kind == "table" else "<li class=zz>{}</li>"
            return f"<{kind} class=zz>{''.join(row.format(x) for x in items)}</{kind}>"
        if kind in ("h2", "h3", "h4"):
            block = " ".join(block.split()[: rng.randint(1, 9)])
        inner = f"<p class=zz>{block}</p>" if kind in ("blockquote", "section", "figure") and rng.random() < 0.5 else block
        return f"{inner}<br><br>" if kind == "bare" else f"<{kind} class=zz>{inner}</{kind}>"

    tag, name = rng.choice(MAIN)
    style = rng.choice(["p", "p", "p", "div", "div", "bare"])
    parts = [f"<{h} class=zz>{blocks[0][:120]}</{h}>"] if (h := rng.choice(["h1", "h1", "h2", ""])) and blocks else []
    for block in blocks:
        if rng.random() < 0.12:
            parts.append(region(rng.choice(["ad", "ad", "share", "side", "notice", "form"])))
        parts.append(marked_up(block, style if rng.random() < 0.7 else rng.choice(["p", "ul", "ol", "blockquote", "h2", "h3", "h4", "table", "pre", "div", "section", "figure"])))
    if rng.random() < 0.5:
        parts.append(region(rng.choice(["comments", "share", "bottom", "bottom"])))
    how = rng.random()
    if how < 0.14 and len(parts) > 1:  # several containers
        step = max(1, len(parts) // rng.randint(2, 4))
        body = "".join(f'<{tag} class="zz {name}">{"".join(parts[i : i + step])}</{tag}>' for i in range(0, len(parts), step))
    elif how < 0.2 and style != "bare":  # none
        body = "".join(parts)
    elif how < 0.28:  # a table that lays out the page
        menu = f"<td>{region('menu')}</td>" if rng.random() < 0.7 else ""
        side = f"<td>{region('side')}</td>" if rng.random() < 0.4 else ""
        return f'<html><body><table><tr><td>{some(1, 6)} <a href="#">{some(1, 2)}</a></td></tr><tr>{menu}<td class=zz>{"".join(parts)}</td>{side}</tr><tr><td>{some(2, 9)}</td></tr></table></body></html>', "zz"
    else:
        body = f'<{tag} class="zz {name}">{"".join(parts)}</{tag}>'
    if how > 0.94:  # nothing around it, or no container either
        return (body, "zz") if how > 0.97 or style == "bare" else (f"<html><body>{''.join(parts)}</body></html>", "zz")
    after = [region("comments")] if rng.random() < 0.4 else []
    around = [region(k) for k in ("ad", "side", "notice", "form") if rng.random() < 0.35]
    rng.shuffle(around)
    cut = rng.randint(0, len(around))
    body = "".join([*around[:cut], body, *after, *around[cut:]])
    top = "".join(region(k) for k in ("top", "menu") if rng.random() < 0.8)
    bottom = region("bottom") if rng.random() < 0.8 else ""
    at = rng.randint(0, 2)  # wrappers around the middle alone, or around all
    for k in range(rng.randint(0, 3)):
        if k == at:
            body, top, bottom = f"{top}{body}{bottom}", "", ""
        outer = rng.choice(WRAPPERS)
        body = f'<div class="{outer}">{body}</div>' if outer else f"<div>{body}</div>"
    return f"<html><body>{top}{body}{bottom}</body></html>", "zz"


def fit(pages: Iterable[str], layouts: int = LAYOUTS, seed: int = 7) -> Trees:
    rng = random.Random(seed)
    xs, ys, sources = [np.zeros((0, WIDTH), np.float32)], [np.zeros(0, bool)], []
    for source in pages:
        page = Page(source or "")
        truth = marked(page)
        if truth is None:
            continue
        xs += [page.features()] * OWN  # what the pages say themselves outweighs invented layouts
        ys += [truth] * OWN
        sources.append([b.replace("&", "&amp;").replace("<", "&lt;") for b in page.text(truth).split("\n")])
    made = [[" ".join(rng.choice(("lorem", "ipsum", "dolor", "sit", "amet,")) for _ in range(rng.randint(3, 80))) + "." for _ in range(rng.randint(2, 12))] for _ in range(max(0, 40 - len(sources)))]
    for blocks in sources + made:
        for _ in range(layouts):
            first = rng.randrange(max(1, len(blocks) - BLOCKS))
            part = blocks[first : first + rng.choice((1, 1, 2, 3, 5, 8, BLOCKS, BLOCKS))]
            if rng.random() < 0.2:  # short articles
                part = [" ".join(b.split()[: rng.randint(1, 9)]) for b in part[:3]]
            built, mark = layout(part, rng)
            page = Page(built)
            truth = np.array([mark in n.words for n in page.nodes])
            for n in page.nodes:
                n.words = n.words - {mark}
            xs.append(page.features())
            ys.append(truth)
    return Trees().fit(np.concatenate(xs), np.concatenate(ys).astype(float))


def extract(pages: DataFrame, trees: Trees) -> DataFrame:
    """``pages`` (page_id, url, html) -> page_id, url, text."""
    sent = pages.sparkSession.sparkContext.broadcast(trees)  # fixed size: rounds x nodes of a tree

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for at in range(0, batch.num_rows, 64):
                group = [Page(h.as_py() or "") for h in batch.column(2).slice(at, 64)]
                p = sent.value.probability(np.concatenate([g.features() for g in group]))
                for page in group:
                    out.append(page.text(page.decode(told(page, p[: len(page.nodes)]))))
                    p = p[len(page.nodes) :]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    return pages.selectExpr("cast(page_id as long) page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string")


def fit_trees(pages: DataFrame, rows: int = FIT_PAGES) -> Trees:
    return fit(r["html"] for r in fit_sample(pages.select("page_id", "html"), "page_id", rows, "html"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    pages = table(spark, sf_dir, "pages")
    return extract(pages, fit_trees(pages)).selectExpr("page_id", "url", "text", "cast(length(text) as long) n_chars")
