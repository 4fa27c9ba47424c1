"""Main text of web pages by a recurrent block labeller.

A page is a sequence of leaf blocks.  A bidirectional LSTM in numpy reads, for each block, a
hashed vector of its tag path and one of its words, and says for every block, knowing
the whole page, whether it belongs to the main text.  It is trained on made-up pages of
many layouts and on a bounded sample of the given pages whose landmarks (article, main) are plain.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spotrace.llm import samples, words

PATH_SIZE, WORD_SIZE, HIDDEN = 64, 24, 12
NUMBERS = 7
SAMPLE_PAGES = 150  # pages of the table that training reads at most
SAMPLE_CHARS = 20_000  # and their size at most
MADE_UP_PAGES = 350
EPOCHS = 14

# Elements of the HTML standard, by how they bear on blocks (fixed values).
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style template svg iframe head title textarea select canvas".split())
# What may stand in a head; anything else ends it, also where its end tag is left out (fixed values).
IN_HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()
)
CLOSES_SAME = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:=\s*+[^\s\"'<>][^\s<>]*+|\"[^\"]*+\"|'[^']*+'|[^<>\"'=]|=)*+)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)[^>]*+>"  # quotes that do not close
    r"|<[!?][^>]*>",
    re.S | re.I,
)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: int  # characters inside links


def blocks_of(page: str) -> list[Block]:
    """Leaf blocks in page order: runs of text that no block element borders; white space is one space."""
    found: list[Block] = []
    stack: list[tuple[str, str]] = []  # element, and its name with classes
    parts: list[str] = []
    linked = skipped = links = 0

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                found.append(Block(tuple(n for _, n in stack), text, linked))
            parts.clear()
        linked = 0

    def pop(to: int) -> None:
        nonlocal skipped, links
        for name, _ in stack[to:]:
            skipped -= name in SKIPPED
            links -= name == "a"
        del stack[to:]

    def add(text: str) -> None:
        nonlocal linked
        if text and not skipped:
            parts.append(text)
            linked += len(text) if links else 0

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            add(page[at:m.start()])
        at = m.end()
        name, marked = m[3] or m[6], m[4] or ""
        if name is None:
            continue
        name = name.lower()
        if m[2] or m[5]:
            place = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), -1)
            if name not in INLINE:
                close()
            if place >= 0 and (name not in INLINE or not any(s[0] not in INLINE for s in stack[place + 1:])):
                pop(place)
            continue
        if name in INLINE:
            if name == "br":
                add(" ")
        else:
            close()
            ends = "p" if name in CLOSES_P else CLOSES_SAME.get(name, "")
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ends.split():
                    pop(k)
                    break
                if stack[k][0] not in INLINE and not (name in CLOSES_SAME and stack[k][0] == "p"):
                    break
        if name not in IN_HEAD and any(s[0] == "head" for s in stack):
            pop(next(k for k, s in enumerate(stack) if s[0] == "head"))
        if name in VOID or marked.endswith("/") and name not in INLINE and name in SKIPPED:
            continue
        label = name
        if marked:
            marks = [a or b or c for a, b, c in _NAMES.findall(marked)]
            label = " ".join([name, *" ".join(marks).lower().split()])
        stack.append((name, label))
        skipped += name in SKIPPED
        links += name == "a"
    add(page[at:])
    close()
    return found


_PATHS: dict[tuple[str, ...], np.ndarray] = {}


def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    known = _PATHS.get(path)
    if known is None:
        known = np.zeros(PATH_SIZE, np.float32)
        for label in path:
            name, *marks = label.split()
            if name in INLINE:
                continue
            parts = {name, *(f".{w}" for m in marks for w in re.split(r"[-_\d]+", m) if w)}
            for part in parts:
                known[zlib.crc32(part.encode()) % PATH_SIZE] = 1
        if len(_PATHS) > 50_000:
            _PATHS.clear()
        _PATHS[path] = known
    return known


def vectors(pages: list[list[Block]]) -> np.ndarray:
    """Input rows of all blocks of some pages, one after another."""
    blocks = [b for p in pages for b in p]
    if not blocks:
        return np.zeros((0, PATH_SIZE + WORD_SIZE + NUMBERS), np.float32)
    raw = [b.text.encode("utf-8", "replace") for b in blocks]
    offsets = np.cumsum([0, *map(len, raw)])
    data = words.LOWER[np.frombuffer(b"".join(raw), np.uint8)]
    starts, ends, first = words.word_spans(data, offsets)
    count = np.diff(first)
    of = np.repeat(np.arange(len(blocks)), count)
    bucket = (words.hash_spans(data, starts, ends) % np.uint64(WORD_SIZE)).astype(np.int64)
    hashed = np.bincount(of * WORD_SIZE + bucket, minlength=len(blocks) * WORD_SIZE).reshape(len(blocks), WORD_SIZE)
    hashed = hashed / np.maximum(count, 1)[:, None]
    size = np.diff(offsets)
    place = np.concatenate([np.arange(len(p)) / max(len(p), 1) for p in pages])
    alone = np.concatenate([np.full(len(p), 1 / max(len(p), 1)) for p in pages])
    last = data[offsets[1:] - 1]
    numbers = np.column_stack([
        np.log1p(count) / 5, np.log1p(size) / 8, np.array([b.linked for b in blocks]) / np.maximum(size, 1),
        np.isin(last, np.frombuffer(b".!?:\"'", np.uint8)), place, alone,
        np.array([len(b.path) for b in blocks]) / 10,
    ])
    return np.column_stack([np.array([_path_vector(b.path) for b in blocks]), hashed, numbers]).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM with one logistic output for each block."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> Labeller:
        size = PATH_SIZE + WORD_SIZE + NUMBERS
        w = {}
        for d in "fb":
            w["x" + d] = rng.normal(0, 1 / np.sqrt(size), (size, 4 * HIDDEN))
            w["h" + d] = rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN))
            w["c" + d] = np.zeros(4 * HIDDEN)
            w["c" + d][HIDDEN:2 * HIDDEN] = 1  # remember at first
        w["o"] = rng.normal(0, 0.3, 2 * HIDDEN)
        w["oc"] = np.zeros(1)
        return cls({k: v.astype(np.float32) for k, v in w.items()})

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        """States after each block of [page, block, input]; padding leaves the state as it is."""
        n, steps = mask.shape
        given = x @ self.w["x" + d] + self.w["c" + d]
        h = np.zeros((n, HIDDEN), np.float32)
        c = np.zeros((n, HIDDEN), np.float32)
        out = np.zeros((n, steps, HIDDEN), np.float32)
        held = []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = given[:, t] + h @ self.w["h" + d]
            gates = _sigmoid(z[:, :3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN:2 * HIDDEN], gates[:, 2 * HIDDEN:]
            g = np.tanh(z[:, 3 * HIDDEN:])
            live = mask[:, t:t + 1]
            new = f * c + i * g
            squashed = np.tanh(new)
            if keep:
                held.append((t, h, c, i, f, o, g, squashed))
            c = np.where(live, new, c)
            h = np.where(live, o * squashed, h)
            out[:, t] = h
        return out, held

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, mask, d, False)[0] for d in "fb"], 2)
        return both @ self.w["o"] + self.w["oc"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        runs = {d: self._run(x, mask, d, True) for d in "fb"}
        both = np.concatenate([runs[d][0] for d in "fb"], 2)
        error = (_sigmoid(both @ self.w["o"] + self.w["oc"]) - y) * mask / mask.sum()
        out = {"o": np.einsum("nt,nth->h", error, both), "oc": error.sum(keepdims=True).reshape(1)}
        for k, d in enumerate("fb"):
            into = error[:, :, None] * self.w["o"][k * HIDDEN:(k + 1) * HIDDEN]
            dx = np.zeros((*mask.shape, 4 * HIDDEN), np.float32)
            dwh = np.zeros_like(self.w["h" + d])
            dh = np.zeros((len(x), HIDDEN), np.float32)
            dc = np.zeros((len(x), HIDDEN), np.float32)
            for t, h, c, i, f, o, g, squashed in reversed(runs[d][1]):
                live = mask[:, t:t + 1]
                dh = dh + into[:, t]
                inner = dc + dh * o * (1 - squashed**2)
                z = np.concatenate([
                    inner * g * i * (1 - i), inner * c * f * (1 - f), dh * squashed * o * (1 - o), inner * i * (1 - g**2)
                ], 1) * live
                dx[:, t] = z
                dwh += h.T @ z
                dc = np.where(live, inner * f, dc)
                dh = np.where(live, z @ self.w["h" + d].T, dh)
            out["x" + d] = np.einsum("ntd,ntk->dk", x, dx, optimize=True)
            out["h" + d], out["c" + d] = dwh, dx.sum((0, 1))
        return out


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x = np.zeros((len(pages), steps, pages[0].shape[1]), np.float32)
    mask = np.zeros((len(pages), steps), bool)
    for k, p in enumerate(pages):
        x[k, :len(p)], mask[k, :len(p)] = p, True
    return x, mask


def train(pages: list[tuple[np.ndarray, np.ndarray]], seed: int = 7) -> Labeller:
    """Fit to pages of (input rows, 0/1 labels) by Adam on batches of pages of like length."""
    rng = np.random.default_rng(seed)
    model = Labeller.fresh(rng)
    first = {k: np.zeros_like(v) for k, v in model.w.items()}
    second = {k: np.zeros_like(v) for k, v in model.w.items()}
    order = sorted(range(len(pages)), key=lambda k: len(pages[k][0]))
    batches = [order[s:s + 24] for s in range(0, len(order), 24)]
    step = 0
    for _ in range(EPOCHS):
        for b in rng.permutation(len(batches)):
            chosen = [pages[k] for k in batches[b]]
            x, mask = _padded([p for p, _ in chosen])
            y = np.zeros(mask.shape, np.float32)
            for k, (_, labels) in enumerate(chosen):
                y[k, :len(labels)] = labels
            step += 1
            for k, g in model.gradients(x, mask, y).items():
                g = np.clip(g, -1, 1)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                rate = 0.015 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                model.w[k] = (model.w[k] - rate * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
    return model


_OUTSIDE = frozenset(
    "nav aside footer form header dialog menu .ad .ads .advert .advertisement .sponsored .promo .banner .sidebar .menu .nav "
    ".navigation .footer .header .comment .comments .reply .replies .notice .cookie .cookies .consent .related .share "
    ".social .widget .newsletter .subscribe .breadcrumb .breadcrumbs .popup .modal".split()
)


def _parts(path: tuple[str, ...]) -> set[str]:
    found = set()
    for label in path:
        name, *marks = label.split()
        found |= {name, *(f".{w}" for m in marks for w in re.split(r"[-_\d]+", m) if w)}
    return found


def landmark_labels(blocks: list[Block]) -> np.ndarray | None:
    """Labels of a page with an article or main element and something outside it; None for other pages."""
    parts = [_parts(b.path) for b in blocks]
    inside = np.array([bool({"article", "main"} & p) and not _OUTSIDE & p for p in parts], np.float32)
    return inside if 0 < inside.sum() < len(inside) else None


def made_up_page(rng: random.Random) -> tuple[str, set[str]]:
    """A page of a random layout, and the texts of its main blocks."""
    syllables = "an be co da el fi ga ho in ka lu mo ne or pa ri so tu ve wi".split()

    def text(least: int, most: int, stop: str = ".") -> str:
        said = ("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.randint(least, most)))
        return " ".join(said).capitalize() + stop

    main: set[str] = set()
    out: list[str] = []

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{k}">{text(1, 2, "")}</a></li>' for k in range(n)) + "</ul>"

    def kept(tag: str, said: str) -> str:
        main.add(said)
        inner = said
        if rng.random() < 0.2:
            inner = f"<b>{said}<br>" if rng.random() < 0.5 else f"<em>{said}</em>"
        return f"<{tag}>{inner}" + (f"</{tag}>" if rng.random() < 0.8 or tag != "p" else "")

    def maybe(p: float, piece: str) -> None:
        if rng.random() < p:
            out.append(piece)

    maybe(0.4, f'<header class="{rng.choice(["site-header", "top", "header"])}"><h1>{text(1, 3, "")}</h1><p>{text(3, 8)}</p></header>')
    maybe(0.9, f"<nav>{links(rng.randint(2, 9))}</nav>" if rng.random() < 0.7 else f'<div class="menu">{links(rng.randint(2, 9))}</div>')
    maybe(0.3, f'<div class="{rng.choice(["cookie-notice", "notice", "consent banner"])}"><p>{text(5, 20)}</p></div>')
    ad = f'<div class="{rng.choice(["ad", "advert", "sponsored", "ads", "promo"])}">{text(3, 15)}</div>'
    maybe(0.6, ad)
    maybe(0.2, f'<aside class="sidebar"><h3>{text(1, 3, "")}</h3>{links(3)}<p>{text(4, 15)}</p></aside>')
    open_, shut = rng.choice([
        ("<article>", "</article>"), ("<main><article>", "</article></main>"), ("<main>", "</main>"),
        ('<article class="post">', "</article>"), ('<div class="article-body content">', "</div>"), ('<div id="content">', "</div>"),
    ])
    body = [kept("h1", text(3, 10, ""))] if rng.random() < 0.85 else []
    for _ in range(rng.randint(1, 12)):
        kind = rng.random()
        if kind < 0.75:
            body.append(kept("p", text(1, 60)))
        elif kind < 0.83:
            body.append(kept("h2", text(1, 6, "")))
        elif kind < 0.9:
            body.append("<ul>" + "".join(kept("li", text(2, 12)) for _ in range(rng.randint(1, 4))) + "</ul>")
        elif kind < 0.94:
            body.append(kept("blockquote", text(4, 25)))
        else:
            body.append(rng.choice([ad, f'<aside class="related">{links(2)}</aside>', f'<form><p>{text(2, 6)}</p></form>']))
    out.append(open_ + "".join(body) + shut)
    maybe(0.4, f'<{(t := rng.choice(["section", "div"]))} class="{rng.choice(["comments", "comment-list", "replies"])}"><h3>{text(1, 2, "")}</h3>'
          + "".join(f'<p class="comment">{text(3, 40)}</p>' for _ in range(rng.randint(1, 5))) + f"</{t}>")
    maybe(0.3, f'<aside class="{rng.choice(["sidebar", "related", "widget"])}"><p>{text(4, 20)}</p>{links(3)}</aside>')
    maybe(0.3, f'<form class="newsletter"><p>{text(3, 10)}</p><label>{text(1, 2, "")}</label></form>')
    maybe(0.9, f"<footer>{text(2, 14)}</footer>" if rng.random() < 0.7 else f'<div class="footer"><p>{text(2, 14)}</p>{links(2)}</div>')
    return "<html><head><title>x</title></head><body>" + "".join(out), main


def training_pages(pages: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """Made-up pages, and landmark pages of a bounded sample of ``pages`` (smallest hash first)."""
    rng = random.Random(11)
    found = []
    for _ in range(MADE_UP_PAGES):
        page, main = made_up_page(rng)
        blocks = blocks_of(page)
        found.append((blocks, np.array([b.text in main for b in blocks], np.float32)))
    fitting = pages.select(F.col("html").cast("string").alias("html")).where(F.length("html").between(1, SAMPLE_CHARS))
    sample = samples.smallest_hashes(fitting, SAMPLE_PAGES, "html").collect()
    for r in sample:
        blocks = blocks_of(r["html"])
        labels = landmark_labels(blocks) if len(blocks) > 1 else None
        if labels is not None:
            found.append((blocks, labels))
    return [(vectors([b]), y) for b, y in found if len(b)]


def main_texts(pages: list[str], model: Labeller) -> list[str]:
    """The main text of each page; blocks are joined by an empty line."""
    cut = [blocks_of(p) for p in pages]
    rows = vectors(cut)
    ends = np.cumsum([len(b) for b in cut])
    out = [""] * len(pages)
    order = [k for k in np.argsort([len(b) for b in cut], kind="stable").tolist() if cut[k]]
    s = 0
    while s < len(order):
        e = s + 1
        while e < len(order) and (e - s + 1) * len(cut[order[e]]) <= 8_000:
            e += 1
        x, mask = _padded([rows[ends[k] - len(cut[k]):ends[k]] for k in order[s:e]])
        yes = model.logits(x, mask) >= 0
        for at, k in enumerate(order[s:e]):
            out[k] = "\n\n".join(b.text for b, y in zip(cut[k], yes[at]) if y)
        s = e
    return out


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page.

    A null html counts as empty; a page without main blocks has an empty text.  Repeated rows and null keys
    stay as they are; other columns are not read.  Training reads a bounded sample and starts a job.
    """
    model = train(training_pages(pages))
    weights = model.w
    schema = T.StructType([
        T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
        T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()),
    ])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Labeller(weights)
        for batch in batches:
            held = [t or "" for t in batch["html"].tolist()]
            for s, e in words.blocks(np.array([len(t) + 1 for t in held]), 1_000_000) if held else ():
                texts = main_texts(held[s:e], own)
                yield pd.DataFrame({
                    "page_id": batch["page_id"].iloc[s:e].astype("Int64"), "url": batch["url"].iloc[s:e],
                    "text": texts, "n_chars": [len(t) for t in texts],
                })

    taken = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return taken.mapInPandas(run, schema)
