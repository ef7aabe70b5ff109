import random

import numpy as np

from recordkeep.llm.boosting import Trees
from recordkeep.llm.dom import NUMBERS, Page
from recordkeep.llm.html_text import extract, fit, layout, marked


def whole(source):
    page = Page(source)
    return page.text(np.ones(len(page.nodes), bool))


def test_blocks_and_references():
    assert whole("<p>a &amp; b<br>c<p>d\n\t e</p>f<div>g<b>h</b>i</div>") == "a & b c\nd e\nf\nghi"
    assert whole("<ul><li>x<li>y</ul><table><tr><td>1<td>2<tr><td>3</table>") == "x\ny\n1\n2\n3"
    assert whole("<script>if (a</b) '</p>'</script>t<style>p{}</style><!-- no -->u &eacute;&#x41;&nbsp;v") == "t\nu éA v"
    assert whole("a < b <c") == "a < b <c" and whole("") == "" and whole("<p><p> <div>") == ""
    assert whole("<p title='a>b' class=x>q</p>") == "q"
    assert whole('<p title="never closed>q</p><p>r') != "" and whole("<b>" * 3000 + "z") == "z"


def test_decoding_never_contradicts():
    rng = np.random.default_rng(1)
    page = Page("<div><div><p>a<p>b<div>c<p>d</div></div><section><p>e<ul><li>f<li>g</ul></section></div><p>h")
    n = len(page.nodes)
    parents = [x.parent for x in page.nodes]

    def worth(kept, p, started, ended):
        return sum(np.log(p[i]) if kept[i] else np.log(1 - p[i]) for i in range(1, n)) - 1.0 * started - 1.2 * ended

    for _ in range(4):
        p = rng.uniform(0.02, 0.98, n)
        got = page.decode(p)
        best = None
        for code in range(1 << (n - 1)):
            kept = [False, *[bool(code >> k & 1) for k in range(n - 1)]]
            below = [False] * n  # some ancestor is kept
            for i in range(1, n):
                below[i] = kept[parents[i]] or below[parents[i]]
            if any(kept[i] and below[i] and not kept[parents[i]] for i in range(1, n)):
                continue
            started = sum(kept[i] and not kept[parents[i]] for i in range(1, n))
            ended = sum(not kept[i] and kept[parents[i]] for i in range(1, n))
            value = worth(kept, p, started, ended)
            best = value if best is None else max(best, value)
        started = sum(got[i] and not got[parents[i]] for i in range(1, n))
        ended = sum(not got[i] and got[parents[i]] for i in range(1, n))
        assert abs(worth(got, p, started, ended) - best) < 1e-9


def test_trees():
    rng = np.random.default_rng(2)
    x = np.column_stack([rng.normal(size=2000), rng.integers(0, 2, 2000), rng.normal(size=2000)])
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    model = Trees(rounds=20, depth=3).fit(x[:1000], y[:1000])
    assert ((model.probability(x[1000:]) > 0.5) == y[1000:]).mean() > 0.97


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeioln") for _ in range(rng.randrange(2, 9))) for _ in range(n)) + "."


def page(rng, unclosed=False):
    blocks = [words(rng, rng.randrange(1, 90)) for _ in range(rng.randrange(1, 12))]
    body = "".join(f"<p>{b}</p>" for b in blocks)
    nav = "".join(f'<li><a href="/{k}">{words(rng, 1)}</a></li>' for k in range(5))
    close = "" if unclosed else "</article>"
    html = f'<!DOCTYPE html><html><head><title>{blocks[0]}</title></head><body><nav><ul>{nav}</ul></nav><div class="ad">{words(rng, 8)}</div><article>{body}{close}<footer>&copy; {words(rng, 9)}</footer></body></html>'
    return html, "\n".join(blocks)


def test_held_out_pages_and_layouts(spark):
    rng = random.Random(3)
    trees = fit([page(rng)[0] for _ in range(60)])
    cases = [page(rng, k % 4 == 0) for k in range(80)]
    right = sum(p.text(p.decode(trees.probability(p.features()))) == want for p, want in ((Page(h), t) for h, t in cases))
    assert right >= 76
    shared = total = 0
    for _ in range(60):
        source, mark = layout([words(rng, rng.randrange(5, 60)) for _ in range(6)], rng)
        p = Page(source)
        truth = np.array([mark in n.words for n in p.nodes])
        for n in p.nodes:
            n.words = n.words - {mark}
        kept = p.decode(trees.probability(p.features()))
        chars = np.array([n.own for n in p.nodes])
        shared += chars[kept & truth].sum()
        total += max(chars[kept].sum(), chars[truth].sum())
    assert shared / total > 0.85
    rows = [(1, "u", cases[0][0], "x"), (1, "u", cases[0][0], "x"), (2, None, None, "x"), (None, "v", "", "x"), (3, "w", "<script>", "x"), (4, "w", "<nav><a href=x>m</a></nav>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r.page_id, r.url, r.text) for r in extract(df, trees).collect()), key=repr)
    assert [g[2] for g in got if g[0] == 1] == [cases[0][1]] * 2 and all(g[2] == "" for g in got if g[0] != 1)
    assert extract(df.limit(0), fit([], layouts=1)).collect() == []
    assert marked(Page("<div>x</div>")) is None


def test_unclosed_elements_lose_no_text():
    for tag in ("svg", "object", "select", "button", "noscript"):
        assert whole(f"<article><p>a</p><{tag} x=1>b<p>c</p></article><p>d") == "a\nb\nc\nd"
        assert whole(f"<article><p>a<{tag}>b</{tag}></p></article><p>d") == "a\nd"
    assert whole("<p>a<svg viewBox='0 0 1 1'/>b<p>c<svg><path/></svg>d") == "a\nb\nc\nd"
    assert whole("<div><button>x<p>a</div><p>b<button>y</button>c") == "x\na\nb\nc"
    assert whole("<div><svg><svg>x</svg>y</svg>a<object>b<object>c</object></object>d</div>") == "a\nd"
    assert whole("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds<math/>") in ("so x=2 holds", "so x=2\nholds")
    assert whole("<svg>" * 4000 + "z") == "z"


def test_all_siblings_count():
    page = Page("<div>" + "<b>i</b><p>x" * 400 + "</div>")
    row = dict(zip(NUMBERS, page.features()[1], strict=False))
    assert row["p_children"] == 400 and page.features()[2][NUMBERS.index("same")] == 400
