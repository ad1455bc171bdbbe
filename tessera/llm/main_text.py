"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks.  Each block is a vector of its tag path (tags,
class and id words of all ancestors, hashed), its words (hashed) and its place
and link share.  A bidirectional LSTM, in NumPy, reads the page's sequence of
blocks and labels each as article or not, with the whole page as context.  It
is trained once a process on generated pages whose labels are known; seeds are
fixed, so runs agree.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import ship

#: fixed values: elements that begin and end a block
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html iframe legend li main menu nav ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead title tr ul button".split()
)
#: fixed values: elements without an end tag
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: fixed values: elements whose content is not text of the page
SILENT = frozenset("script style noscript template svg head title canvas audio video".split())
RAW = frozenset("script style textarea title noscript iframe".split())
#: fixed values: a start tag in the row ends an open tag of the row
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

#: depth beyond which an element takes the place of the one around it (browsers
#: do so at 512); it bounds tag paths, texts are not affected
DEPTH = 128
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTR = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)?(\s*=\s*)?")
_BARE = re.compile(r"[^\s>]*")
_TELLING = frozenset("class id role hidden aria-hidden style".split())

PATH_BUCKETS, WORD_BUCKETS, N_NUMBERS = 512, 64, 8
N_IN = PATH_BUCKETS + WORD_BUCKETS + N_NUMBERS


def _names(attrs: list[tuple[str, str]]) -> list[str]:
    out = []
    for k, v in attrs:
        if k == "hidden" or (k == "aria-hidden" and v == "true") or (k == "style" and re.search(r"display\s*:\s*none", v)):
            out.append("hidden")
        elif k not in ("style", "aria-hidden"):
            out += ["." + x for x in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", v).lower()) if len(x) > 1]
    return out


def _attributes(page: str, at: int) -> tuple[list[tuple[str, str]], int]:
    """Telling attributes of the tag whose name ends at ``at``, and where the
    tag ends: past its >, or -1 where the page ends before.  Linear: a quote
    that is not closed ends the page."""
    out = []
    while True:
        m = _ATTR.match(page, at)
        name, at = m.group(1), m.end()
        if at == len(page):
            return out, -1
        value = ""
        if name and m.group(2):
            if page[at] in "\"'":
                end = page.find(page[at], at + 1)
                if end < 0:
                    return out, -1
                value, at = page[at + 1 : end], end + 1
            else:
                end = _BARE.match(page, at).end()
                value, at = page[at:end], end
        if name and name.lower() in _TELLING:
            out.append((name.lower(), value))
        if not name or (at < len(page) and page[at] == ">"):
            if at < len(page) and page[at] == ">":
                return out, at + 1
            if not name:
                at += 1  # a stray =


def _tokens(page: str):
    """("text", text) and (kind, name, attributes, closed) of tags, in order; one
    pass in linear time.  Comments, declarations and what follows an unfinished
    tag are left out."""
    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", page[at:]
            return
        after = page[lt + 1 : lt + 2]
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 2)  # <!--> is a whole comment
            nxt = end + 3 if end >= 0 else n
        elif page.startswith("<![CDATA[", lt):
            end = page.find("]]>", lt)
            if lt > at:
                yield "text", page[at:lt]
            yield "text", html.escape(page[lt + 9 : end if end >= 0 else n])
            at = end + 3 if end >= 0 else n
            continue
        elif after and after in "!?" or (after == "/" and not _NAME.match(page, lt + 2)):
            end = page.find(">", lt)
            nxt = end + 1 if end >= 0 else n
        elif name := _NAME.match(page, lt + 1 + (after == "/")):
            if lt > at:
                yield "text", page[at:lt]
            attrs, end = ([], name.end() + 1) if page.startswith(">", name.end()) else _attributes(page, name.end())
            if end < 0:
                return
            tag, at = name.group().lower(), end
            if after == "/":
                yield "end", tag
                continue
            yield "start", tag, attrs, page[end - 2] == "/"
            if tag in RAW:
                stop = re.compile(rf"</{tag}(?=[\s/>])", re.I | re.A).search(page, at)
                inner = page[at : stop.start() if stop else n]
                if tag == "textarea":
                    yield "text", inner
                if not stop:
                    return
                at = stop.start()
            continue
        else:
            nxt = lt + 1
            yield "text", page[at:nxt]
            at = nxt
            continue
        if lt > at:
            yield "text", page[at:lt]
        at = nxt


def blocks(page: str) -> list[tuple[list[str], str, float]]:
    """(path tokens, text, share of it in links) of each block with text."""
    out: list[tuple[list[str], str, float]] = []
    stack: list[tuple[str, list[str]]] = []
    still: Counter[str] = Counter()  # open elements by name
    text: list[tuple[str, bool]] = []

    def flush() -> None:
        if text:
            whole = " ".join(html.unescape("".join(t for t, _ in text)).split())
            if whole:
                linked = len("".join(t for t, a in text if a))
                total = len("".join(t for t, _ in text))
                out.append(([x for tag, names in stack for x in (tag, *names)], whole, linked / max(total, 1)))
            text.clear()

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            tag = stack[-1][0]
            if tag in BLOCK:
                flush()
            stack.pop()
            still[tag] -= 1
            still["(silent)"] -= tag in SILENT

    for kind, what, *rest in _tokens(page):
        if kind == "text":
            if not still["(silent)"]:
                text.append((what, still["a"] > 0))
        elif kind == "end":
            if still[what]:
                k = len(stack) - 1
                while stack[k][0] != what:
                    k -= 1
                pop_to(k)
            elif what == "p":
                flush()
        elif what == "br":
            if not still["(silent)"]:
                text.append((" ", False))
        elif what in VOID:
            if what in BLOCK:
                flush()
        else:
            if what in BLOCK:
                flush()
                for k in range(len(stack) - 1, -1, -1):  # an open paragraph ends here
                    if stack[k][0] == "p":
                        pop_to(k)
                        break
                    if stack[k][0] in BLOCK:
                        break
                ends = CLOSES.get(what, ())
                for k in range(len(stack) - 1, -1, -1) if ends else ():
                    if stack[k][0] in ends:
                        pop_to(k)
                        break
                    if stack[k][0] in ("ul", "ol", "dl", "table", "select", "menu"):
                        break
            attrs, closed = rest
            if closed and what not in BLOCK and what not in SILENT:
                continue
            pop_to(DEPTH - 1)
            stack.append((what, _names(attrs)))
            still[what] += 1
            still["(silent)"] += what in SILENT
    flush()
    return out


def _bucket(token: str, n: int) -> int:
    return zlib.crc32(token.encode()) % n


_memo: dict[str, int] = {}


def vectors(page: list[tuple[list[str], str, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Sparse rows (block, column) with weight 1 for path tokens, and dense
    word and number columns."""
    rows, cols = [], []
    dense = np.zeros((len(page), WORD_BUCKETS + N_NUMBERS), np.float32)
    n = len(page)
    for i, (path, text, linked) in enumerate(page):
        tokens = {*path, "last:" + (path[-1] if path else "")}
        for t in tokens:
            b = _memo.get(t)
            if b is None:
                b = _memo[t] = _bucket(t, PATH_BUCKETS)
                if len(_memo) > 100_000:
                    _memo.clear()
            rows.append(i), cols.append(b)
        words = text.split(" ")
        dense[i, :WORD_BUCKETS] = np.bincount([zlib.crc32(w.lower().encode()) % WORD_BUCKETS for w in words], minlength=WORD_BUCKETS) / len(words)
        dense[i, WORD_BUCKETS:] = (np.log1p(len(words)) / 5, linked, i / n, len(path) / 20, text[-1] in ".!?…:\"”»", len(text) / len(words) / 10, words[0][:1] in "©&" or "©" in text, text[:1].isupper())
    return np.array([rows, cols], np.int64).reshape(2, -1), dense


class BlockLabeller:
    """tanh layer, LSTM in each direction, logistic output; Adam."""

    def __init__(self, hidden: int = 16, first: int = 24, seed: int = 5):
        r = np.random.default_rng(seed)
        g = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.h = hidden
        self.p = {"P": g(PATH_BUCKETS, first) * 6, "D": g(WORD_BUCKETS + N_NUMBERS, first), "b": np.zeros(first, np.float32), "o": g(2 * hidden + first), "c": np.zeros(1, np.float32)}
        for d in "fr":
            self.p |= {f"W{d}": g(first, 4 * hidden), f"U{d}": g(hidden, 4 * hidden), f"B{d}": np.zeros(4 * hidden, np.float32)}
            self.p[f"B{d}"][hidden : 2 * hidden] = 1

    @staticmethod
    def _sig(x):
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))

    def _lstm(self, x, mask, d, learn=True):
        """x: (T, B, first), time-ordered for this direction.  Cells and gates
        are kept for learning alone: a page may have very many blocks."""
        p, h = self.p, self.h
        T, B, _ = x.shape
        hs, cell = np.zeros((T + 1, B, h), np.float32), np.zeros((B, h), np.float32)
        cs, gates = (np.zeros((T + 1, B, h), np.float32), np.zeros((T, B, 4 * h), np.float32)) if learn else (None, None)
        for t in range(T):
            a = x[t] @ p[f"W{d}"] + p[f"B{d}"] + hs[t] @ p[f"U{d}"]
            a[:, : 3 * h] = self._sig(a[:, : 3 * h])
            a[:, 3 * h :] = np.tanh(a[:, 3 * h :])
            c = a[:, h : 2 * h] * cell + a[:, :h] * a[:, 3 * h :]
            m = mask[t][:, None]
            cell = np.where(m, c, cell)
            hs[t + 1] = np.where(m, a[:, 2 * h : 3 * h] * np.tanh(c), hs[t])
            if learn:
                cs[t + 1], gates[t] = cell, a
        return hs, cs, gates

    def _lstm_back(self, x, mask, d, cache, dout):
        p, h = self.p, self.h
        hs, cs, gates = cache
        T, B, _ = x.shape
        dh, dc = np.zeros((B, h), np.float32), np.zeros((B, h), np.float32)
        da = np.zeros_like(gates)
        for t in range(T - 1, -1, -1):
            m = mask[t][:, None]
            g = dh + dout[t]
            i, f, o, u = (gates[t][:, k * h : (k + 1) * h] for k in range(4))
            c = f * cs[t] + i * u
            tc = np.tanh(c)
            dct = np.where(m, dc + g * o * (1 - tc * tc), 0)
            da[t] = np.concatenate([dct * u * i * (1 - i), dct * cs[t] * f * (1 - f), np.where(m, g * tc, 0) * o * (1 - o), dct * i * (1 - u * u)], 1)
            dh = np.where(m, da[t] @ p[f"U{d}"].T, dh + dout[t])
            dc = np.where(m, dct * f, dc)
        flat = da.reshape(T * B, -1)
        return {f"W{d}": x.reshape(T * B, -1).T @ flat, f"U{d}": hs[:-1].reshape(T * B, -1).T @ flat, f"B{d}": flat.sum(0)}, da @ p[f"W{d}"].T

    def _inputs(self, pages):
        lens = np.array([len(d) for _, d in pages])
        T, B = int(lens.max()), len(pages)
        first = len(self.p["b"])
        x = np.zeros((T, B, first), np.float32)
        for k, (s, d) in enumerate(pages):
            a = d @ self.p["D"] + self.p["b"]
            order = np.argsort(s[0], kind="stable")
            np.add.at(a, s[0][order], self.p["P"][s[1][order]])
            x[: len(d), k] = np.tanh(a)
        mask = np.arange(T)[:, None] < lens
        return x, mask, lens

    def _outputs(self, x, mask, learn=True):
        f = self._lstm(x, mask, "f", learn)
        r = self._lstm(x[::-1], mask[::-1], "r", learn)
        both = np.concatenate([f[0][1:], r[0][1:][::-1], x], 2)
        return f, r, both, self._sig(both @ self.p["o"] + self.p["c"][0])

    def label(self, pages: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """Probability of article for each block of each page."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i][1])), key=lambda i: len(pages[i][1]))
        a = 0
        while a < len(order):
            b = a + 1
            while b < len(order) and (b - a + 1) * len(pages[order[b]][1]) <= 16384:
                b += 1
            x, mask, lens = self._inputs([pages[i] for i in order[a:b]])
            y = self._outputs(x, mask, False)[-1]
            for k, i in enumerate(order[a:b]):
                out[i] = y[: lens[k], k]
            a = b
        return out

    def fit(self, pages, labels, epochs: int = 10, batch: int = 32, rate: float = 0.01, seed: int = 5) -> "BlockLabeller":
        rng, step = np.random.default_rng(seed), 0
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        q = {k: np.zeros_like(v) for k, v in self.p.items()}
        for _ in range(epochs):
            perm = rng.permutation(len(pages))
            for a in range(0, len(perm), batch):
                part = [pages[i] for i in perm[a : a + batch]]
                x, mask, lens = self._inputs(part)
                f, r, both, y = self._outputs(x, mask)
                want = np.zeros_like(y)
                for k, i in enumerate(perm[a : a + batch]):
                    want[: lens[k], k] = labels[i]
                d = np.where(mask, y - want, 0).astype(np.float32) / mask.sum()
                g = {"o": np.tensordot(d, both, ([0, 1], [0, 1])), "c": np.array([d.sum()])}
                db = d[:, :, None] * self.p["o"]
                h = self.h
                gf, dxf = self._lstm_back(x, mask, "f", f, db[:, :, :h])
                gr, dxr = self._lstm_back(x[::-1], mask[::-1], "r", r, db[::-1, :, h : 2 * h])
                dx = (dxf + dxr[::-1] + db[:, :, 2 * h :]) * (1 - x * x)
                g |= gf | gr | {"b": dx.sum((0, 1)), "P": np.zeros_like(self.p["P"]), "D": np.zeros_like(self.p["D"])}
                for k, (s, dense) in enumerate(part):
                    row = dx[: lens[k], k]
                    np.add.at(g["P"], s[1], row[s[0]])
                    g["D"] += dense.T @ row
                step += 1
                for k, v in g.items():
                    v = v + 1e-5 * self.p[k]
                    m[k] += 0.1 * (v - m[k])
                    q[k] += 0.01 * (v * v - q[k])
                    self.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(q[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self


#: fixed values: class and id words that pages give to what is not the article
OTHER = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs topnav mainmenu toolbar pagination pager skip",
    "header": "header masthead banner site-header topbar branding logo",
    "footer": "footer site-footer bottom copyright colophon legal footnav",
    "aside": "sidebar aside widget related rail secondary recommended trending popular tags archive",
    "ad": "ad ads advert advertisement sponsored promo banner-ad adsbox sponsor advertorial",
    "comments": "comments comment comment-list replies reply respond disqus discussion reader-comments",
    "form": "form newsletter subscribe signup search login contact-form",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay paywall disclaimer",
    "share": "share social sharing follow byline meta author-box print",
}
#: fixed values: class words of the article
ARTICLE = "article post content entry entry-content article-body main story text body-text post-content page-content prose".split()
_TAGS = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "comments": "section", "ad": "div", "notice": "div", "share": "div"}
_SAMPLE = "the of and to in a is that for it was on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more".split()


def _phrase(r, low: int, high: int, stop: bool) -> str:
    pool = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve au ch ung qu eau ción ñ ö".split()
    words = []
    for _ in range(int(r.integers(low, high + 1))):
        words.append(_SAMPLE[int(r.integers(len(_SAMPLE)))] if r.random() < 0.3 else "".join(pool[int(k)] for k in r.integers(0, len(pool), int(r.integers(1, 5)))))
    odd = r.random()  # some texts are lists, shouts or full of signs
    if odd < 0.04:
        words = [w + " |" for w in words]
    elif odd < 0.06:
        words = [w.upper() + "!!" for w in words]
    elif odd < 0.08:
        words = [w + "*#%&"[int(r.integers(4))] * 3 for w in words]
    s = " ".join(words)
    return s[:1].upper() + s[1:] + ("." if stop else "")


def generate(seed: int) -> tuple[str, list[str]]:
    """A page and the texts of its article blocks."""
    r = np.random.default_rng(seed)
    pick = lambda xs: xs[int(r.integers(len(xs)))]
    kept: list[str] = []

    def other(kind: str) -> str:
        name = pick(OTHER[kind].split())
        tag = _TAGS[kind] if r.random() < 0.5 else pick(["div", "section", "ul" if kind == "nav" else "div"])
        attr = "" if tag == _TAGS[kind] not in ("div", "section") and r.random() < 0.5 else f' {pick(["class", "class", "id"])}="{name}{pick(["", "", " box", "-1", " wide"])}"'
        if kind == "nav" or (kind in ("footer", "aside", "header") and r.random() < 0.5):
            items = "".join(f'<li><a href="/{k}">{_phrase(r, 1, 2, False)}</a></li>' for k in range(int(r.integers(1, 8))))
            inner = items if tag == "ul" else f"<ul>{items}</ul>"
        elif kind == "form":
            inner = f"<label>{_phrase(r, 1, 3, False)}</label><input name=q><button>{_phrase(r, 1, 2, False)}</button>" + (f"<p>{_phrase(r, 3, 12, True)}</p>" if r.random() < 0.5 else "")
        elif kind == "footer":
            inner = f"&copy; {pick(['www', 'blog'])}.{_phrase(r, 1, 1, False).lower()}.com &middot; {_phrase(r, 2, 20, True)}"
        elif kind == "comments":
            inner = "".join(f"<{t}>{_phrase(r, 2, 40, True)}</{t}>" for t in [pick(["p", "div", "li"]) for _ in range(int(r.integers(1, 6)))])
        else:
            inner = pick([_phrase(r, 2, 30, True), f"<p>{_phrase(r, 2, 30, True)}</p>", f"<h3>{_phrase(r, 1, 4, False)}</h3><p>{_phrase(r, 3, 30, True)}</p>"])
        return f"<{tag}{attr}>{inner}</{tag}>"

    def para(tag: str = "p", low: int = 2, high: int = 60) -> str:
        t = _phrase(r, low, high, True)
        kept.append(t)
        words = t.split(" ")
        if len(words) > 4 and r.random() < 0.3:
            words[2] = f'<a href="/x">{words[2]}</a>'
        if r.random() < 0.15:
            words[0] = f"<b>{words[0]}" + ("</b>" if r.random() < 0.6 else "")
        end = "" if tag == "p" and r.random() < 0.2 else f"</{tag}>"
        return f"<{tag}>{' '.join(words)}{'<br>' if r.random() < 0.1 else ''}{end}"

    title = _phrase(r, 2, 12, r.random() < 0.5)
    top = [other(pick(["nav", "header", "nav", "ad", "notice", "share", "form"])) for _ in range(int(r.integers(0, 4)))]
    kept.append(title)
    body = [f"<header><h1>{title}</h1></header>" if r.random() < 0.2 else f"<h1>{title}</h1>"]
    for _ in range(int(r.integers(1, 10))):
        x = r.random()
        if x < 0.72:
            body.append(para())
        elif x < 0.80:
            body.append(para(pick(["h2", "h3", "blockquote", "pre"]), 1, 12))
        elif x < 0.86:
            body.append("<ul>" + "".join(para("li", 1, 12) for _ in range(int(r.integers(1, 5)))) + "</ul>")
        elif x < 0.90:
            body.append("<table><tr>" + "".join(para("td", 1, 4) for _ in range(2)) + "</tr></table>")
        else:
            body.append(other(pick(["ad", "aside", "share", "form", "notice", "comments"])))
    tag = "article" if r.random() < 0.6 else pick(["main", "div", "section"])
    attr = f' {pick(["class", "id"])}="{pick(ARTICLE)}"' if tag in ("div", "section") or r.random() < 0.3 else ""
    wrap = f"<{tag}{attr}>{''.join(body)}</{tag}>"
    if r.random() < 0.3:
        wrap = f'<div class="{pick(["container", "wrapper", "page", "row", "layout"])}">{wrap}</div>'
    end = [other(pick(["footer", "comments", "aside", "ad", "form", "nav", "share", "notice"])) for _ in range(int(r.integers(0, 4)))] + [other("footer")]
    return f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var a='<p>';</script></head><body>{''.join(top)}<!-- x -->{wrap}{''.join(end)}" + ("</body></html>" if r.random() < 0.8 else ""), kept


_trained: dict[tuple, BlockLabeller] = {}


def trained(n_pages: int = 900, seed: int = 1000) -> BlockLabeller:
    """The labeller, fitted to ``n_pages`` generated pages once a process."""
    key = (n_pages, seed)
    if key not in _trained:
        xs, ys = [], []
        for k in range(n_pages):
            page, kept = generate(seed + k)
            cut, want, left = blocks(page), [], list(kept)
            for path, text, _ in cut:
                want.append(text in left and not any(x in path for x in ("footer", "nav", "aside", "form")))
                if want[-1]:
                    left.remove(text)
            if cut:
                xs.append(vectors(cut))
                ys.append(np.array(want, np.float32))
        _trained[key] = BlockLabeller().fit(xs, ys)
    return _trained[key]


def extract(pages: list[str | None], model: BlockLabeller) -> list[str]:
    """Main text of each page."""
    cut = [blocks(p) if p else [] for p in pages]
    said = model.label([vectors(c) for c in cut])
    return ["\n".join(text for (_, text, _), y in zip(c, s) if y > 0.5) for c, s in zip(cut, said)]


def _run(model: BlockLabeller):
    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = extract(part.column(2).to_pylist(), model)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def main_text(pages: DataFrame, model: BlockLabeller | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), one row per input row.

    Blocks of the article in page order, white space within a block as one
    space, joined by a newline; nothing else is dropped or cut.  Null, empty
    and blockless pages give an empty text.  Null and repeated ids and null
    URLs pass through; broken markup and missing end tags are read as browsers
    do in the main; very long pages are read whole.  Other columns are ignored.
    """
    ship(pages.sparkSession)
    slim = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return slim.mapInArrow(_run(model or trained()), "page_id bigint, url string, text string, n_chars bigint")
