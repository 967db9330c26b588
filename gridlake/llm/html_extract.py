"""Main text of web pages by a recurrent block labeller.

A page is cut into text blocks.  Each block becomes a vector: hashed parts of its tag path (near and far
ancestors apart), hashed words, and a few lengths and shares.  A bidirectional LSTM in numpy reads the whole
page's sequence in both directions, so each block is judged in the context of the document, and labels it as
main text or not.  The network is trained here, on generated labelled pages of many layouts, with fixed seeds,
in some seconds on the driver; its weights (a fixed size) are broadcast.

Defined cases: null or empty html gives an empty text, as does a page without main blocks; broken and unclosed
markup is read as far as it goes; pages of any length and depth are read whole, in linear time, and the network reads
a page of very many blocks in windows, carrying its states from one to the next in both directions; rows are handled one by one, so repeated or
null page_ids and extra columns do no harm; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import itertools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.llm.common import sliced
from gridlake.llm.html_blocks import Block, Element, blocks_of
from gridlake.llm.html_pages import MAIN, OTHER, PageMaker

PATH_DIM, WORD_DIM, STATS = 160, 64, 8
WIDTH = PATH_DIM + WORD_DIM + STATS
HIDDEN = 24
#: Blocks (padding included) that the network reads at once.
BATCH_BLOCKS = 16_384


class _Buckets(dict):
    """Hash buckets of keys; forgets everything when many are held."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, key: str) -> int:
        if len(self) >= 300_000:
            self.clear()
        value = self[key] = zlib.crc32(key.encode()) % self.buckets
        return value


_WORDS, _PARTS = _Buckets(WORD_DIM), _Buckets(PATH_DIM)


def _known(e: Element) -> tuple[int, int, int]:
    """Buckets, as bits, of what stands on the way from the page to an element, and of the element alone: (any place,
    far, near).  An element's parent is known before it, so each is worked out once."""
    todo = []
    while e.known is None:
        todo.append(e)
        if e.parent is None:
            break
        e = e.parent
    for e in reversed(todo):
        if e.parent is None:
            e.known = (0, 0, 0)
            continue
        here, far, near = e.parent.known[0], e.parent.known[1], 0
        for n in (f"<{e.tag}>", *e.names):
            here |= 1 << _PARTS[f"any:{n}"]
            far |= 1 << _PARTS[f"far:{n}"]
            near |= 1 << _PARTS[f"near:{n}"]
        e.known = (here, far, near)
    return todo[0].known if todo else e.known


@functools.lru_cache(maxsize=50_000)
def _places(bits: int) -> list[int]:
    return [k for k in range(PATH_DIM) if bits >> k & 1]


def _path_buckets(e: Element) -> list[int]:
    """Buckets of the tags and names above a block, the nearest two elements marked as near."""
    here, _, near = _known(e)
    if e.parent is not None:
        near |= e.parent.known[2]
        if e.parent.parent is not None:
            near |= e.parent.parent.known[1]
    return _places(here | near)


def vectors(blocks: list[Block], sizes: np.ndarray | None = None, first: int = 0) -> np.ndarray:
    """One row per block of a page, or of its part from block ``first`` on; ``sizes``: characters of all its blocks."""
    x = np.zeros((len(blocks), WIDTH), np.float32)
    if not blocks:
        return x
    for k, b in enumerate(blocks):
        x[k, _path_buckets(b.within)] = 1.0
    texts = [b.text for b in blocks]
    words = [t.lower().split() for t in texts]
    n_words = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.fromiter(map(_WORDS.__getitem__, itertools.chain.from_iterable(words)), np.int64, int(n_words.sum()))
    cells = np.repeat(np.arange(len(blocks)) * WORD_DIM, n_words) + flat
    counts = np.bincount(cells, minlength=len(blocks) * WORD_DIM).reshape(-1, WORD_DIM)
    x[:, PATH_DIM:PATH_DIM + WORD_DIM] = np.sqrt(counts / np.maximum(n_words, 1)[:, None])
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    sizes = n if sizes is None else sizes
    before = int(sizes[:first].sum())
    marks = np.fromiter((t.count(".") + t.count(",") for t in texts), np.int64, len(texts))
    linked = np.fromiter((b.linked for b in blocks), np.int64, len(blocks))
    x[:, PATH_DIM + WORD_DIM:] = np.stack([
        np.log1p(n) / 5, np.log1p(n_words) / 4, linked / n, 10 * marks / n, (before + np.cumsum(n) - n) / sizes.sum(),
        (first + np.arange(len(n))) / len(sizes), [t[-1] in ".!?" for t in texts], np.ones(len(n))], 1)
    return x


@dataclass
class Network:
    """Weights by name: wx, wh, b of both directions (f, b) and the output layer."""

    w: dict[str, np.ndarray]


def _start(seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    w = {}
    for d in "fb":
        w[f"wx{d}"] = rng.normal(0, WIDTH ** -0.5, (WIDTH, 4 * HIDDEN)).astype(np.float32)
        w[f"wh{d}"] = rng.normal(0, HIDDEN ** -0.5, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
        w[f"b{d}"] = np.repeat(np.array([0, 1, 0, 0], np.float32), HIDDEN)  # input, forget, output, candidate
    w["wo"] = rng.normal(0, 0.1, (2 * HIDDEN,)).astype(np.float32)
    w["bo"] = np.zeros(1, np.float32)
    return w


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _forward(x: np.ndarray, mask: np.ndarray, w: dict, d: str, state: tuple | None = None, keep: bool = True) -> tuple[np.ndarray, list, tuple]:
    """Hidden states [time, page, HIDDEN] of one direction, what training needs of each step (if ``keep``), and the
    last state, with which a next part can go on; x is [time, page, WIDTH]; padded steps keep the state."""
    t, n, _ = x.shape
    gates = x.reshape(t * n, -1) @ w[f"wx{d}"] + w[f"b{d}"]
    gates = gates.reshape(t, n, -1)
    h, c = state or (np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32))
    out, steps = np.zeros((t, n, HIDDEN), np.float32), []
    for k in range(t) if d == "f" else range(t - 1, -1, -1):
        a = gates[k] + h @ w[f"wh{d}"]
        s = _sigmoid(a[:, :3 * HIDDEN])
        i, f, o = s[:, :HIDDEN], s[:, HIDDEN:2 * HIDDEN], s[:, 2 * HIDDEN:]
        g = np.tanh(a[:, 3 * HIDDEN:])
        m = mask[k][:, None]
        c_new = f * c + i * g
        tc = np.tanh(c_new)
        h_new = o * tc
        if keep:
            steps.append((k, h, c, i, f, o, g, tc, m))
        h, c = h + m * (h_new - h), c + m * (c_new - c)
        out[k] = h
    return out, steps, (h, c)


def _backward(x: np.ndarray, dout: np.ndarray, steps: list, w: dict, d: str, grad: dict) -> None:
    t, n, _ = x.shape
    dgates = np.zeros((t, n, 4 * HIDDEN), np.float32)
    dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    dwh = np.zeros_like(w[f"wh{d}"])
    for k, h, c, i, f, o, g, tc, m in reversed(steps):
        dh = dh + dout[k]
        on_h, on_c = m * dh, m * dc
        dct = on_c + on_h * o * (1 - tc * tc)
        da = np.concatenate([dct * g * i * (1 - i), dct * c * f * (1 - f), on_h * tc * o * (1 - o), dct * i * (1 - g * g)], 1)
        dgates[k] = da
        dwh += h.T @ da
        dh = (1 - m) * dh + da @ w[f"wh{d}"].T
        dc = (1 - m) * dc + dct * f
    flat = dgates.reshape(t * n, -1)
    grad[f"wx{d}"] = x.reshape(t * n, -1).T @ flat
    grad[f"wh{d}"], grad[f"b{d}"] = dwh, flat.sum(0)


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(map(len, pages))
    x, mask = np.zeros((t, len(pages), WIDTH), np.float32), np.zeros((t, len(pages)), np.float32)
    for k, p in enumerate(pages):
        x[:len(p), k], mask[:len(p), k] = p, 1
    return x, mask


def probabilities(net: Network, pages: list[np.ndarray]) -> list[np.ndarray]:
    """The chance of being main text of every block of every page; pages of like length are read together."""
    out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
    order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
    while order:
        n = max(1, min(len(order), BATCH_BLOCKS // max(1, len(pages[order[-1]]))))
        own, order = order[-n:], order[:-n]
        x, mask = _padded([pages[k] for k in own])
        h = np.concatenate([_forward(x, mask, net.w, d, keep=False)[0] for d in "fb"], 2)
        p = _sigmoid(h @ net.w["wo"] + net.w["bo"])
        for j, k in enumerate(own):
            out[k] = p[:len(pages[k]), j]
    return out


def long_probabilities(net: Network, blocks: list[Block], window: int = BATCH_BLOCKS) -> np.ndarray:
    """The same for one page of any number of blocks: only a window's vectors and states are held, and a number per
    block of what each direction adds to its verdict."""
    sizes = np.fromiter((len(b.text) for b in blocks), np.int64, len(blocks))
    score = np.full(len(blocks), net.w["bo"][0], np.float32)
    starts = list(range(0, len(blocks), window))
    for d, half in (("f", net.w["wo"][:HIDDEN]), ("b", net.w["wo"][HIDDEN:])):
        state = None
        for a in starts if d == "f" else reversed(starts):
            x = vectors(blocks[a:a + window], sizes, a)[:, None, :]
            h, _, state = _forward(x, np.ones(x.shape[:2], np.float32), net.w, d, state, keep=False)
            score[a:a + window] += h[:, 0] @ half
    return _sigmoid(score)


def labelled_pages(count: int, seed: int) -> list[tuple[list[Block], np.ndarray]]:
    maker, out = PageMaker(seed), []
    for _ in range(count):
        blocks = blocks_of(maker.page())
        y = np.array([MAIN in b.text for b in blocks], np.float32)
        for b in blocks:
            b.text = b.text.replace(MAIN, "").replace(OTHER, "").strip() or "-"
        out.append((blocks, y))
    return out


@functools.lru_cache(maxsize=2)
def train(pages: int = 1600, epochs: int = 6, seed: int = 3, rate: float = 0.01) -> Network:
    """The network after ``epochs`` passes of Adam over ``pages`` generated pages."""
    data = [(vectors(b), y) for b, y in labelled_pages(pages, seed) if b]
    w = _start(seed)
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    rng, step = np.random.default_rng(seed), 0
    for _ in range(epochs):
        shuffled = rng.permutation(len(data))
        for at in range(0, len(shuffled), 32):
            own = sorted((data[k] for k in shuffled[at:at + 32]), key=lambda r: len(r[0]))
            x, mask = _padded([v for v, _ in own])
            x[..., :PATH_DIM] *= rng.random((1, len(own), PATH_DIM)) > 0.1  # so that no single hint decides
            y = np.zeros_like(mask)
            for k, (_, v) in enumerate(own):
                y[:len(v), k] = v
            (hf, sf, _), (hb, sb, _) = _forward(x, mask, w, "f"), _forward(x, mask, w, "b")
            h = np.concatenate([hf, hb], 2)
            p = _sigmoid(h @ w["wo"] + w["bo"])
            err = ((p - y) * mask / mask.sum()).astype(np.float32)
            grad = {"wo": np.einsum("tn,tnh->h", err, h), "bo": np.array([err.sum()], np.float32)}
            dh = err[..., None] * w["wo"]
            _backward(x, dh[..., :HIDDEN], sf, w, "f", grad)
            _backward(x, dh[..., HIDDEN:], sb, w, "b", grad)
            step += 1
            for k, g in grad.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                w[k] = w[k] - rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
    return Network({k: v.astype(np.float32) for k, v in w.items()})


def label_blocks(net: Network, html: list[str | None]) -> Iterator[tuple[list[Block], np.ndarray]]:
    """The blocks of each page and which of them are main text; pages go through the network together until they have
    BATCH_BLOCKS blocks, longer ones alone."""
    held: list[list[Block]] = []

    def judged() -> Iterator[tuple[list[Block], np.ndarray]]:
        short = [b for b in held if len(b) <= BATCH_BLOCKS]
        found = iter(probabilities(net, [vectors(b) for b in short]))
        for b in held:
            yield b, (next(found) if len(b) <= BATCH_BLOCKS else long_probabilities(net, b)) >= 0.5

    for page in html:
        held.append(blocks_of(page))
        if sum(map(len, held)) > BATCH_BLOCKS:
            yield from judged()
            held.clear()
    yield from judged()


def extract(pages: DataFrame, net: Network | None = None) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text (main blocks joined by an empty line), n_blocks, n_main."""
    sent = pages.sparkSession.sparkContext.broadcast(net or train())

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, n_blocks, n_main = [], [], []
        for blocks, main in label_blocks(sent.value, batch["html"].to_pylist()):
            texts.append("\n\n".join(b.text for b, own in zip(blocks, main, strict=True) if own))
            n_blocks.append(len(blocks))
            n_main.append(int(main.sum()))
        return pa.RecordBatch.from_arrays(
            [batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array(n_blocks, pa.int64()), pa.array(n_main, pa.int64())],
            ["page_id", "url", "text", "n_blocks", "n_main"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInArrow(sliced(step), "page_id long, url string, text string, n_blocks long, n_main long")
