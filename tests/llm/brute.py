"""Plain versions of the operators, for small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from html.parser import HTMLParser

import numpy as np
import public_tokenizers
import xxhash
from tokenizers import Tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def ids_of(text):
    return Tokenizer.from_file(TOKENIZER).encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def quality(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    hit = set()
    for i in range(len(w) - 7):
        if grams[tuple(w[i:i + 8])] > 1:
            hit.update(range(i, i + 8))
    failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit), failed


def fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    grams = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def simhash(rows):
    fps = [fingerprint(t) for _, t in rows]
    root = groups(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    low = defaultdict(list)
    for r, (d, _) in zip(root, rows):
        if d is not None:
            low[r].append(d)
    return [(d, f"{f:016x}", min(low[r], default=None)) for (d, _), f, r in zip(rows, fps, root)]


def chats(rows):
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def removed_bytes(rows, n=100):
    """``(doc_id, text)`` rows to (n_bytes, n_removed, n_spans, sha) in the order of ``rows``."""
    raw = [(t or "").encode() for _, t in rows]
    first = {}
    for (d, _), b in zip(rows, raw):
        for p in range(len(b) - n + 1):
            k = b[p:p + n]
            first[k] = min(first.get(k, (d, p)), (d, p))
    out = []
    for (d, _), b in zip(rows, raw):
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if first[b[p:p + n]] < (d, p):
                gone[p:p + n] = b"\1" * n
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def removed_words(rows, n=50):
    split = [WORD.findall(t or "") for _, t in rows]
    first = {}
    for (d, _), w in zip(rows, split):
        for p in range(len(w) - n + 1):
            k = tuple(w[p:p + n])
            first[k] = min(first.get(k, d), d)
    out = []
    for (d, _), w in zip(rows, split):
        gone = bytearray(len(w))
        for p in range(len(w) - n + 1):
            if first[tuple(w[p:p + n])] < d:
                gone[p:p + n] = b"\1" * n
        out.append((len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return out


def cosine_links(rows, threshold=0.93):
    """``(vec_id, embedding, label)`` rows to {vec_id: (n_links, component)}."""
    def good(v):
        return v is not None and all(x is not None and np.isfinite(x) for x in v) and any(x for x in v)
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if good(v) else None for _, v, _ in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if rows[i][2] is not None and rows[i][2] == rows[j][2]
             and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold]
    root = groups(len(rows), pairs)
    n = Counter(x for p in pairs for x in p)
    low = defaultdict(list)
    for r, x in zip(root, rows):
        low[r].append(x[0])
    return {x[0]: (n[i], min(low[root[i]])) for i, x in enumerate(rows)}


def planted(doc_id, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def word_runs(w, least=24, times=3):
    """Every lag beside every place; a stretch counts under its smallest period only."""
    out = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i < len(w) - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i < len(w) - q and w[i] == w[i + q]:
                i += 1
            n = i - s + q
            if n >= max(least, times * q) and not any(w[s:s + n - d] == w[s + d:s + n] for d in range(1, q)):
                out.append((s, n, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def periods(doc_id, text):
    w = planted(doc_id, text)
    runs = word_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest()


def hard_negatives(rows, scale=256, every=50, positives=5, negatives=3, low=50, high=95):
    """``rows``: (id, label, vector)."""
    kept = {(i, l, tuple(math.floor(x * scale) for x in v)) for i, l, v in rows if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for a in kept:
        if a[0] % every:
            continue
        score = {r: sum(x * y for x, y in zip(a[2], r[2])) for r in kept if r != a}
        order = sorted(score, key=lambda r: (-score[r], r[0]))
        for p in [r for r in order if r[1] == a[1]][:positives]:
            fit = [r for r in order if r[1] != a[1] and low * score[p] <= 100 * score[r] <= high * score[p]]
            out += [(a[0], p[0], n, r[0], score[p], score[r]) for n, r in enumerate(fit[:negatives], 1)]
    return sorted(out)


class _Article(HTMLParser):
    """The blocks of the article elements, for pages that have them."""

    BLOCKS = {"article", "p", "h1", "h2", "div", "ul", "li", "section", "blockquote", "footer", "aside", "header", "nav"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.out, self.run = 0, [], []

    def flush(self):
        if text := " ".join("".join(self.run).split()):
            self.out.append(text)
        self.run = []

    def handle_starttag(self, tag, attrs):
        if tag in self.BLOCKS:
            self.flush()
        self.inside += tag == "article"
        self.run.append(" " if tag == "br" else "")

    def handle_endtag(self, tag):
        if tag in self.BLOCKS:
            self.flush()
        self.inside -= tag == "article"

    def handle_data(self, data):
        if self.inside:
            self.run.append(data)


def article(page):
    reader = _Article()
    reader.feed(page or "")
    reader.close()
    reader.flush()
    return "\n".join(reader.out)
