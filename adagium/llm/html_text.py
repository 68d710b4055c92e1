"""Main text of HTML pages by a recurrent block labeller.

A page is cut into leaf blocks: stretches of text between the borders of
block-level elements, with the path of open elements (names and the words of
class, id and role) above each. A numpy bidirectional LSTM reads the blocks of
the whole page in order; its input is the sum of hashed tag-path vectors, the
mean of hashed word vectors of the whole block text, and a few shape values. A
block is part of the main text if its probability reaches one half.

The model is trained here, on the driver, on generated pages (``TRAIN_PAGES``,
seeded): layouts with and without semantic elements, whose words are random but
for the phrases that mark menus, notices, forms, adverts and comments. It has a
fixed size, is kept in the shared folder for later sessions and is broadcast.
Extraction is one narrow Arrow pass.

Defined cases: null and empty html, and pages without main text, give an empty
text; unclosed and crossing elements follow the usual recovery (a block start
ends an open paragraph, an end tag closes what is open inside it); comments,
scripts, styles, titles, templates, embedded objects and elements that are hidden
(``hidden``, ``display: none``, ``visibility: hidden``) never show text;
character references are decoded once, also without semicolon; repeated pages
are extracted each; an empty table gives no rows. Only named columns are read.
"""

from __future__ import annotations

import html
import re

import numpy as np
from pyspark.sql import DataFrame, functions as F

PAGE = "page_id long, url string, text string, n_chars long, n_blocks int, n_main int"
# Fixed values of the HTML standard: elements that break lines, and those without end tag.
BLOCKS = frozenset(
    "address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = ("script", "style", "title", "template", "noscript", "iframe", "object", "svg", "math", "canvas", "audio", "video", "textarea", "noframes", "noembed", "xmp")
#: An opening element ends these open ones of the same list or table.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("thead", "tbody", "tr", "td", "th")}
HOLDERS = frozenset("ul ol menu dl table select body article section div".split())
TAG = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORD = re.compile(r"[a-z]+")
HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in HIDDEN}


class Cut:
    """The leaf blocks of a page with text, in page order, and the elements opened and closed on the way.

    A block's path is what the first ``at`` events leave open; events are shared
    by all blocks, so a page of any depth takes linear time.
    """

    def __init__(self):
        self.texts: list[str] = []
        self.links: list[float] = []  # share of linked characters
        self.at: list[int] = []
        self.depths: list[int] = []  # path tokens
        self.events: list[tuple[int, str]] = []  # (1 or -1, path token)

    def __len__(self) -> int:
        return len(self.texts)

    def path(self, k: int) -> list[str]:
        """Path tokens of block k."""
        out: list[str] = []
        for sign, token in self.events[: self.at[k]]:
            if sign > 0:
                out.append(token)
            else:
                out.pop()
        return out


def _attributes(text: str) -> tuple[list[str], bool]:
    """Path tokens of an element's class, id and role, and whether it is hidden."""
    tokens, hidden = [], False
    for m in ATTRIBUTE.finditer(text):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id", "role"):
            tokens += [f".{w}" for w in WORD.findall(value.lower())]
        elif key == "hidden" or (key == "style" and HIDES.search(value)):
            hidden = True
    return tokens, hidden


def blocks(page) -> Cut:
    """The leaf blocks of a page."""
    out = Cut()
    if not page:
        return out
    names: list[str] = []  # open elements
    marks: list[tuple[list[str], bool]] = []  # their path tokens, and whether they are hidden
    places: dict[str, list[int]] = {}  # where each name stands among the open elements
    holders: list[int] = []
    pieces: list[str] = []
    linked = depth = hidden = at = 0
    size = len(page)

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.texts.append(text)
                out.links.append(min(1.0, linked / len(text)))
                out.at.append(len(out.events))
                out.depths.append(depth)
            pieces.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw and not hidden:
            raw = html.unescape(raw) if "&" in raw else raw
            pieces.append(raw)
            if places.get("a"):
                linked += len(raw.strip())

    def open_(name: str, tokens: list[str], hides: bool) -> None:
        nonlocal depth, hidden
        places.setdefault(name, []).append(len(names))
        if name in HOLDERS:
            holders.append(len(names))
        names.append(name)
        marks.append((tokens, hides))
        out.events += [(1, t) for t in tokens]
        depth += len(tokens)
        hidden += hides

    def close(to: int) -> None:
        nonlocal depth, hidden
        if any(names[k] in BLOCKS for k in range(to, len(names))):
            flush()
        while len(names) > to:
            name, (tokens, hides) = names.pop(), marks.pop()
            places[name].pop()
            if name in HOLDERS:
                holders.pop()
            out.events += [(-1, t) for t in reversed(tokens)]
            depth -= len(tokens)
            hidden -= hides

    while at < size:
        m = TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            if places.get(name):
                close(places[name][-1])
            elif name in BLOCKS:
                flush()
            continue
        if name in RAW_END:
            end = RAW_END[name].search(page, at)
            if not (m[3] or m[6] or "").rstrip().endswith("/") or name not in ("svg", "math"):
                at = end.end() if end else size
            continue
        if name in BLOCKS:
            if places.get("p"):
                close(places["p"][0])
            flush()
            if name in SIBLINGS:
                while True:
                    top = max(places[x][-1] if places.get(x) else -1 for x in SIBLINGS[name])
                    if top <= (holders[-1] if holders else -1):
                        break
                    close(top)
        if name in VOID:
            if name == "br" and not hidden:
                pieces.append(" ")
            continue
        attributes = m[3] or m[6]
        tokens, hides = _attributes(attributes) if attributes else ([], False)
        open_(name, [name, *tokens], hides)
    flush()
    return out


PATHS, WORDS, PATH_DIM, WORD_DIM, SHAPES, HIDDEN_DIM = 2048, 1 << 16, 16, 8, 6, 20
MIN_PAGES = 8  # words on fewer training pages get no vector
INPUT = PATH_DIM + WORD_DIM + SHAPES
_SLOT: dict[str, int] = {}


def _slot(token: str, size: int) -> int:
    import xxhash

    return xxhash.xxh32_intdigest(token) % size


def _path_slot(token: str) -> int:
    x = _SLOT.get(token)
    if x is None:
        if len(_SLOT) > 100_000:
            _SLOT.clear()
        x = _SLOT[token] = _slot(token, PATHS)
    return x


class Inputs:
    """Hashed inputs of the blocks of several pages, one after the other."""

    def __init__(self, pages: list[Cut]):
        from adagium.llm.vectext import Words

        self.sizes = np.array([len(p) for p in pages])
        n_events = np.array([len(p.events) for p in pages], dtype=np.int64)
        before = np.cumsum(n_events) - n_events
        self.events = np.array([_path_slot(t) for p in pages for _, t in p.events], dtype=np.int64)
        self.signs = np.array([s for p in pages for s, _ in p.events], dtype=np.float64)
        self.page_start = np.repeat(before, self.sizes).astype(np.int64)  # a block's path: the sum of its page's events so far
        self.place = np.array([a for p in pages for a in p.at], dtype=np.int64) + self.page_start
        texts = [t for p in pages for t in p.texts]
        w = Words(texts, lower=True)
        self.words = (w.hashes() % np.uint64(WORDS)).astype(np.int64)
        self.word_of = np.repeat(np.arange(len(texts)), np.diff(w.first))
        n = np.array([len(t) for t in texts], dtype=float)
        ends = np.array([t[-1] in ".!?:;\"”»…。！？" for t in texts], dtype=float)
        digits = np.array([sum(map(t.count, "0123456789")) for t in texts]) / np.maximum(n, 1)
        marks = np.array([any(c in t for c in "©®|·»›") for t in texts], dtype=float)
        depth = np.minimum([d for p in pages for d in p.depths], 64) / 8
        self.told = np.ones(len(texts))  # 0 for blocks whose words are not shown
        self.shapes = np.stack([np.log1p(n) / 6, np.array([x for p in pages for x in p.links]), ends, digits, marks, depth], axis=1) if texts else np.zeros((0, SHAPES))

    def vectors(self, model) -> np.ndarray:
        n, kind = len(self.shapes), model["path"].dtype
        word = np.zeros((n, WORD_DIM), kind)
        sums = np.zeros((len(self.events) + 1, PATH_DIM))
        np.cumsum(model["path"][self.events] * self.signs[:, None], axis=0, out=sums[1:])
        path = (sums[self.place] - sums[self.page_start]).astype(kind)
        if len(self.words):
            lead = np.flatnonzero(np.diff(self.word_of, prepend=-1))
            word[self.word_of[lead]] = np.add.reduceat(model["word"][self.words], lead, axis=0)
            word *= (self.told / np.maximum(np.bincount(self.word_of, minlength=n), 1))[:, None].astype(kind)
        return np.concatenate([path, word, self.shapes.astype(kind)], axis=1)

    def path_gradient(self, g: np.ndarray) -> np.ndarray:
        """Gradient of the path vectors, from that of each block's path sum."""
        at = np.zeros((len(self.events) + 2, PATH_DIM))
        np.add.at(at, self.place, g)
        np.subtract.at(at, self.page_start, g)
        after = np.cumsum(at[::-1], axis=0)[::-1][1:-1] * self.signs[:, None]  # of all that follows an event
        return np.stack([np.bincount(self.events, weights=x, minlength=PATHS) for x in after.T], axis=1)


def new_model(rng) -> dict[str, np.ndarray]:
    m = {"path": rng.normal(0, 0.1, (PATHS, PATH_DIM)), "word": np.zeros((WORDS, WORD_DIM)), "out": rng.normal(0, 0.2, 2 * HIDDEN_DIM), "bias": np.zeros(1)}
    for d in ("f", "b"):
        m[f"w{d}"] = rng.normal(0, 0.25, (INPUT + HIDDEN_DIM, 4 * HIDDEN_DIM))
        m[f"c{d}"] = np.zeros(4 * HIDDEN_DIM)
        m[f"c{d}"][HIDDEN_DIM : 2 * HIDDEN_DIM] = 1  # forget gates start open
    return m


def _sig(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _padded(x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(longest, pages, values) and the mask, from values by block."""
    longest, k = int(sizes.max()), len(sizes)
    page = np.repeat(np.arange(k), sizes)
    place = np.arange(len(x)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out, mask = np.zeros((longest, k, x.shape[1]), x.dtype), np.zeros((longest, k, 1), x.dtype)
    out[place, page], mask[place, page] = x, 1
    return out, mask


def _run(model, x, mask, d: str, keep: bool = False):
    """Hidden states of one direction; the state stands still where the mask is 0."""
    steps, k, _ = x.shape
    h, c = np.zeros((2, k, HIDDEN_DIM), x.dtype)
    out, tape = np.zeros((steps, k, HIDDEN_DIM), x.dtype), []
    n = HIDDEN_DIM
    fixed = x @ model[f"w{d}"][:INPUT] + model[f"c{d}"]
    inner = model[f"w{d}"][INPUT:]
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        z = fixed[t] + h @ inner
        i, f, o, g = _sig(z[:, :n]), _sig(z[:, n : 2 * n]), _sig(z[:, 2 * n : 3 * n]), np.tanh(z[:, 3 * n :])
        new = f * c + i * g
        th = np.tanh(new)
        m = mask[t]
        if keep:
            tape.append((t, h, c, i, f, o, g, th))
        h, c = m * (o * th) + (1 - m) * h, m * new + (1 - m) * c
        out[t] = h
    return out, tape


def probabilities(model, inputs: Inputs) -> np.ndarray:
    """Probability of every block to be main text."""
    sizes, x = inputs.sizes, inputs.vectors(model)
    out = np.zeros(len(x))
    start = np.cumsum(sizes) - sizes
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 0]
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and hi - lo < 256 and sizes[order[hi]] <= max(16, 1.3 * sizes[order[lo]]):
            hi += 1
        own = order[lo:hi]
        at = np.concatenate([np.arange(start[p], start[p] + sizes[p]) for p in own])
        px, mask = _padded(x[at], sizes[own])
        z = _run(model, px, mask, "f")[0] @ model["out"][:HIDDEN_DIM] + _run(model, px, mask, "b")[0] @ model["out"][HIDDEN_DIM:] + model["bias"]
        out[at] = _sig(z).T[mask[:, :, 0].T > 0]
        lo = hi
    return out


def _gradients(model, inputs: Inputs, labels: np.ndarray) -> tuple[dict, float]:
    x = inputs.vectors(model)
    px, mask = _padded(x, inputs.sizes)
    y, _ = _padded(labels[:, None].astype(x.dtype), inputs.sizes)
    n = HIDDEN_DIM
    runs = {d: _run(model, px, mask, d, True) for d in ("f", "b")}
    z = runs["f"][0] @ model["out"][:n] + runs["b"][0] @ model["out"][n:] + model["bias"]
    p = _sig(z)
    total = mask.sum()
    dz = (p - y[:, :, 0]) * mask[:, :, 0] / total
    loss = -(mask[:, :, 0] * (y[:, :, 0] * np.log(p + 1e-12) + (1 - y[:, :, 0]) * np.log(1 - p + 1e-12))).sum() / total
    g = {"out": np.concatenate([(runs[d][0] * dz[:, :, None]).sum(axis=(0, 1)) for d in ("f", "b")]), "bias": np.array([dz.sum()])}
    dx = np.zeros_like(px)
    for d, w_out in (("f", model["out"][:n]), ("b", model["out"][n:])):
        w = model[f"w{d}"]
        gw, gc = np.zeros_like(w), np.zeros(4 * n)
        dh, dc = np.zeros((2, px.shape[1], n), px.dtype)
        for t, h0, c0, i, f, o, gg, th in reversed(runs[d][1]):
            m = mask[t]
            dh = dh + dz[t][:, None] * w_out
            live, lc = dh * m, dc * m
            dcell = lc + live * o * (1 - th * th)
            gates = np.concatenate([dcell * gg * i * (1 - i), dcell * c0 * f * (1 - f), live * th * o * (1 - o), dcell * i * (1 - gg * gg)], axis=1)
            gw[:INPUT] += px[t].T @ gates
            gw[INPUT:] += h0.T @ gates
            gc += gates.sum(axis=0)
            dx[t] += gates @ w[:INPUT].T
            dh = gates @ w[INPUT:].T + dh * (1 - m)
            dc = dcell * f + dc * (1 - m)
        g[f"w{d}"], g[f"c{d}"] = gw, gc
    flat = dx.transpose(1, 0, 2)[mask[:, :, 0].T > 0]
    g["path"], g["word"] = inputs.path_gradient(flat[:, :PATH_DIM]).astype(flat.dtype), np.zeros_like(model["word"])
    share = flat[:, PATH_DIM : PATH_DIM + WORD_DIM] * (inputs.told / np.maximum(np.bincount(inputs.word_of, minlength=len(flat)), 1))[:, None].astype(flat.dtype)
    np.add.at(g["word"], inputs.words, share[inputs.word_of])
    return g, loss


TRAIN_PAGES, EPOCHS = 900, 12


def train_model(pages: int = TRAIN_PAGES, epochs: int = EPOCHS, seed: int = 11) -> dict[str, np.ndarray]:
    """Fit the labeller to generated pages with Adam."""
    from adagium.llm.html_pages import page

    rng = np.random.default_rng(seed)
    made = [page(f"{seed}:{k}") for k in range(pages)]
    cut = [blocks(h) for h, _ in made]
    labels = [np.array([t in main for t in c.texts], dtype=float) for c, (_, main) in zip(cut, made)]
    lengths = np.array([len(c) for c in cut])
    model = {k: v.astype(np.float32) for k, v in new_model(rng).items()}
    pages_of = np.zeros(WORDS, dtype=np.int64)
    for c in cut:
        pages_of[np.unique(Inputs([c]).words)] += 1
    live = np.flatnonzero(pages_of >= MIN_PAGES)
    rows = {k: live if k == "word" else slice(None) for k in model}
    first, second = ({k: np.zeros_like(v[rows[k]]) for k, v in model.items()} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        # Pages of about the same length share a batch: the recurrence takes as many steps as its longest page.
        order = np.argsort(lengths * rng.uniform(0.7, 1.4, len(cut)))
        batches = [order[lo : lo + 35] for lo in range(0, len(order), 35)]
        for k in rng.permutation(len(batches)):
            own = [i for i in batches[k] if len(cut[i])]
            inputs = Inputs([cut[i] for i in own])
            inputs.told = rng.random(len(inputs.shapes)) < 0.5  # half of the blocks must do without words
            g, _ = _gradients(model, inputs, np.concatenate([labels[i] for i in own]))
            step += 1
            rate = 0.02 * (1 - 0.9 * epoch / epochs)
            for k, r in rows.items():
                first[k] = 0.9 * first[k] + 0.1 * g[k][r]
                second[k] = 0.99 * second[k] + 0.01 * g[k][r] ** 2
                model[k][r] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
            model["word"][live] *= 0.998  # words that mark nothing fade
    return {k: v.astype(np.float32) for k, v in model.items()}


def fitted_model(spark) -> dict[str, np.ndarray]:
    """The trained model: read from the shared folder, where the first session to need it writes it."""
    import hashlib
    import uuid

    from adagium.llm import html_pages
    from adagium.llm.common import shared_dir

    code = b"".join(open(f, "rb").read() for f in (__file__, html_pages.__file__))
    name = f"{shared_dir(spark)}/adagium-html-model-{hashlib.sha256(code).hexdigest()[:16]}"
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(name).getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path(name)):
        rows = []
        for k, v in train_model().items():
            live = np.flatnonzero(v.reshape(len(v), -1).any(axis=1))
            rows.append((k, list(v.shape), live.astype(np.int32).tobytes(), v[live].tobytes()))
        temp = f"{name}-{uuid.uuid4().hex}"
        spark.createDataFrame(rows, "name string, shape array<int>, live binary, data binary").coalesce(1).write.parquet(temp)
        if not system.rename(path(temp), path(name)):
            system.delete(path(temp), True)  # another session was first
    model = {}
    for r in spark.read.parquet(name).collect():
        model[r["name"]] = np.zeros(r["shape"], np.float32)
        live = np.frombuffer(r["live"], np.int32)
        model[r["name"]][live] = np.frombuffer(r["data"], np.float32).reshape(len(live), *r["shape"][1:])
    return model


def main_texts(model, pages: list) -> list[tuple[str, int, int]]:
    """(text, blocks, blocks of the main text) of each page."""
    cut = [blocks(p) for p in pages]
    p = probabilities(model, Inputs(cut))
    out, at = [], 0
    for c in cut:
        keep = [t for t, q in zip(c.texts, p[at : at + len(c)].tolist()) if q >= 0.5]
        out.append(("\n\n".join(keep), len(c), len(keep)))
        at += len(c)
    return out


def extract(pages: DataFrame, model: dict | None = None) -> DataFrame:
    """PAGE for every row of pages(page_id, url, html)."""
    if model is None:
        model = fitted_model(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(model)  # a fixed size

    def run(batches):
        import pandas as pd

        for pdf in batches:
            pages_, lo, size = list(pdf["html"]), 0, 0
            for i, h in enumerate(pages_):
                size += len(h or "")
                if size >= 4 << 20 or i - lo >= 511 or i == len(pages_) - 1:
                    rows = main_texts(shared.value, pages_[lo : i + 1])
                    out = pd.DataFrame(rows, columns=["text", "n_blocks", "n_main"])
                    out["n_chars"] = [len(t) for t in out["text"]]
                    out["page_id"], out["url"] = pdf["page_id"].iloc[lo : i + 1].to_numpy(), pdf["url"].iloc[lo : i + 1].to_numpy()
                    yield out[["page_id", "url", "text", "n_chars", "n_blocks", "n_main"]]
                    lo, size = i + 1, 0

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInPandas(run, PAGE)
