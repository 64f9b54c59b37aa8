"""Main text of web pages: boosted trees judge DOM nodes, hierarchical decoding makes them agree.

The trees are trained on pages that this module writes itself, where it is known which node belongs
to the article; no page of the corpus is needed. Pages vary in layout, markup, class names, order
and damage, so that several kinds of evidence have to be weighed.
"""

from __future__ import annotations

import html as html_
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from crownlake.llm import gbt
from crownlake.llm.common import steps
from crownlake.llm.dom import Page, features, read

#: Pages that the trees are trained on; their number bounds the training set.
TRAINING_PAGES, SEED = 500, 11
_SYLLABLES = "ba ke lo mi tu ran sel vor den pi aul est ing ter on ma no ri sha lek du for wen tal".split()
_HINTS = {
    "article": ["article", "post", "entry-content", "story-body", "content", "main-content", "articleBody", "post-content", "text"],
    "nav": ["nav", "menu", "main-menu", "navbar", "breadcrumbs", "navigation", "nav-links"],
    "header": ["header", "masthead", "site-header", "topbar", "banner"],
    "footer": ["footer", "site-footer", "bottom", "copyright", "legal"],
    "aside": ["sidebar", "related", "widget", "recommended", "related-posts", "teaser"],
    "ad": ["ad", "ads", "advert", "sponsored", "promo", "ad-slot", "advertisement"],
    "notice": ["cookie-notice", "notice", "consent", "gdpr-banner", "popup", "newsletter-modal"],
    "comments": ["comments", "comment-list", "discussion", "replies", "reader-comments"],
    "form": ["search-form", "subscribe", "newsletter", "login", "signup-form"],
    "share": ["share", "social", "share-buttons"],
}


def training_page(r: random.Random) -> tuple[str, str]:
    """A page and the marker that each of its article elements carries as an attribute name."""
    words = ["".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(60)]

    def say(low: int, high: int) -> str:
        out = []
        for _ in range(r.randint(low, high)):
            s = " ".join(r.choice(words) for _ in range(r.randint(3, 18)))
            out.append(s.capitalize() + r.choice([".", ".", ".", "!", "?", ","]))
        return " ".join(out)

    def few(low: int = 1, high: int = 5) -> str:
        return " ".join(r.choice(words) for _ in range(r.randint(low, high)))

    def hint(kind: str, chance: float = 0.85) -> str:
        return f' {r.choice(["class", "class", "id"])}="{r.choice(_HINTS[kind])}"' if r.random() < chance else ""

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{few(1, 1)}">{few(1, 3)}</a></li>' for _ in range(n))

    def boiler(kind: str) -> str:
        if kind == "nav":
            tag = r.choice(["nav", "nav", "div", "ul"])
            return f"<{tag}{hint('nav', 0.4 if tag == 'nav' else 0.95)}>{'<ul>' * (tag != 'ul')}{links(r.randint(3, 12))}{'</ul>' * (tag != 'ul')}</{tag}>"
        if kind == "header":
            return f"<header{hint('header', 0.5)}><a href='/'>{few(1, 3)}</a> <p>{few(2, 7)}</p></header>" if r.random() < 0.6 else f"<div{hint('header', 1)}><h2>{few(1, 3)}</h2><p>{few(2, 8)}</p></div>"
        if kind == "footer":
            tag = r.choice(["footer", "footer", "div"])
            return f"<{tag}{hint('footer', 0.3 if tag == 'footer' else 1)}>&copy; {few(1, 3)} &middot; {say(1, 2)}{'<p>' + say(1, 2) + '</p>' if r.random() < 0.3 else ''}</{tag}>"
        if kind == "aside":
            tag = r.choice(["aside", "div"])
            return f"<{tag}{hint('aside', 0.4 if tag == 'aside' else 1)}><h3>{few(1, 4)}</h3>" + (f"<ul>{links(r.randint(2, 7))}</ul>" if r.random() < 0.6 else f"<p>{say(1, 3)}</p>" * r.randint(1, 3)) + f"</{tag}>"
        if kind == "ad":
            return f"<{(t := r.choice(['div', 'div', 'section', 'aside']))}{hint('ad', 1)}>{r.choice([say(1, 3), '<p>' + say(1, 3) + '</p>', '<a href=x>' + say(1, 1) + '</a>'])}</{t}>"
        if kind == "notice":
            return f"<div{hint('notice', 1)}><p>{say(1, 3)}</p>{'<a href=#>' + few(1, 1) + '</a>' if r.random() < 0.6 else ''}</div>"
        if kind == "comments":
            one = "".join(f'<{(t := r.choice(["div", "li", "article"]))} class="{r.choice(["comment", "reply", "comment-body"])}"><b>{few(1, 2)}</b><p>{say(1, 4)}</p></{t}>' for _ in range(r.randint(1, 6)))
            return f"<{(t := r.choice(['section', 'div', 'ol']))}{hint('comments', 1)}><h3>{few(1, 2)}</h3>{one}</{t}>"
        if kind == "form":
            return f"<form{hint('form', 0.7)}><label>{few(1, 4)}</label><input name=q><p>{say(1, 1)}</p><button>{few(1, 1)}</button></form>"
        return f"<div{hint('share', 1)}>{''.join(f'<a href=x>{few(1, 1)}</a> ' for _ in range(4))}</div>"

    def paragraph() -> str:
        text = say(1, 7)
        if r.random() < 0.2:
            text = text.replace(" ", f' <{(t := r.choice(["a href=/x", "b", "em", "span"]))} zz>{few(1, 3)}</{t.split()[0]}> ', 1)
        kind = r.random()
        if kind < 0.72:
            return f"<p zz>{text}" + "</p>" * (r.random() < 0.8)
        if kind < 0.78:
            return f"<p zz><b zz>{few(2, 9)}.<br>"
        if kind < 0.86:
            return f"<h{(k := r.randint(2, 4))} zz>{few(2, 6)}</h{k}>"
        if kind < 0.92:
            return "<ul zz>" + "".join(f"<li zz>{say(1, 1)}" + "</li>" * (r.random() < 0.7) for _ in range(r.randint(2, 5))) + "</ul>"
        if kind < 0.96:
            return f"<blockquote zz><p zz>{text}</p></blockquote>"
        return f"<table zz><tr zz><td zz>{few()}</td><td zz>{few()}</td></tr></table>"

    inside = [paragraph() for _ in range(r.choice([1, 2, 4, 8, 15]))]
    for kind in ("ad", "aside", "share", "form", "notice", "nav"):
        if r.random() < 0.2:
            inside.insert(r.randint(0, len(inside)), boiler(kind))
    title = f"<h1 zz>{few(2, 9)}</h1>"
    if r.random() < 0.2:
        title = f"<header zz>{title}</header>"
    if r.random() < 0.15:
        inside.append(boiler("comments"))
    tag = r.choice(["article", "article", "article", "main", "div", "div", "section"])
    body = f"<{tag} zz{hint('article', 0.3 if tag in ('article', 'main') else 0.9)}>{title}{''.join(inside)}</{tag}>"
    if r.random() < 0.12:
        body = title * (r.random() < 0.7) + "".join(inside)
    for _ in range(r.choice([0, 0, 1, 2])):
        body = f"<{r.choice(['div', 'main'])} zz{' class=wrap' * (r.random() < 0.5)}>{body}" + (boiler("aside") if r.random() < 0.2 else "") + "</div>"
    busy = r.choice([0.0, 0.3, 0.5, 0.7])
    before = [boiler(k) for k in ("header", "nav", "ad", "notice", "form", "aside", "nav") if r.random() < busy]
    after = [boiler(k) for k in ("comments", "aside", "ad", "share", "form", "notice") if r.random() < busy]
    r.shuffle(before)
    r.shuffle(after)
    if r.random() < min(1, busy + 0.4):
        after.append(boiler("footer"))
    return f"<!DOCTYPE html><html><head><title>{few()}</title></head><body>{''.join(before)}{body}{''.join(after)}{'</body></html>' * (r.random() < 0.8)}", "zz"


def train(pages: int = TRAINING_PAGES, seed: int = SEED) -> gbt.Trees:
    r = random.Random(seed)
    read_pages, truth = [], []
    for _ in range(pages):
        source, mark = training_page(r)
        page = read(source, mark)
        read_pages.append(page)
        truth.append(np.array([1.0, *page.marked[1:]]))
    x, _ = features(read_pages)
    return gbt.fit(x, np.concatenate(truth))


def decode(page: Page, logit: np.ndarray) -> list[bool]:
    """Which nodes to keep: the choice with the highest sum of the kept nodes' log odds in which no
    kept node has a dropped ancestor. A subtree goes if it gains nothing; the page itself stays."""
    gain = np.clip(logit, -6, 6).tolist()
    for node in range(len(gain) - 1, 0, -1):
        if gain[node] > 0:
            gain[page.parent[node]] += gain[node]
    keep = [True] * len(gain)
    for node in range(1, len(gain)):
        keep[node] = gain[node] > 0 and keep[page.parent[node]]
    return keep


def main_text(page: Page, keep: list[bool]) -> str:
    """The kept texts: one line a block, references decoded, white space as single spaces."""
    blocks, now = [], []
    for node, text in page.texts:
        if node < 0:
            if now:
                blocks.append("".join(now))
                now = []
        elif keep[node]:
            now.append(text)
    blocks.append("".join(now))
    lines = (" ".join(html_.unescape(b).split()) for b in blocks)
    return "\n".join(line for line in lines if line)


def extract(trees: gbt.Trees, sources: list[str | None]) -> list[str]:
    pages = [read(s) for s in sources]
    if not pages:
        return []
    x, first = features(pages)
    logit = trees.logits(x)
    return [main_text(p, decode(p, logit[a:b])) for p, a, b in zip(pages, first[:-1], first[1:], strict=True)]


def main_texts(pages: DataFrame, *, keep: list[str] | None = None, trees: gbt.Trees | None = None) -> DataFrame:
    """keep (all columns of pages by default), text and n_chars (code points) of each page's article.

    Only `html` is looked at; null or empty: an empty text. Damaged markup is read as far as it goes.
    Nothing is dropped or capped in kept blocks. Result columns replace columns of their names.
    """
    names = [c for c in (keep or pages.columns) if c not in ("text", "n_chars")]
    base = pages.select(*dict.fromkeys([*names, "html"]))
    schema = StructType(base.select(*names).schema.fields + StructType.fromDDL("text string, n_chars long").fields)
    sent = pages.sparkSession.sparkContext.broadcast(trees or train())

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in steps(batch, "html"):
                texts = extract(sent.value, b.column(b.schema.get_field_index("html")).to_pylist())
                own = [b.column(b.schema.get_field_index(c)) for c in names]
                yield pa.RecordBatch.from_arrays([*own, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*names, "text", "n_chars"])

    return base.mapInArrow(extracted, schema)
