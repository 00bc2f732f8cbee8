"""Plain restatements of the contracts, one row at a time."""

from __future__ import annotations

import re
from hashlib import sha256
from zlib import crc32

import xxhash
from tokenizers import Tokenizer

WS = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def low(text):
    return (text or "").translate(AZ)


def digest(text):
    return sha256(text.encode()).hexdigest()


def base_spans(text):
    text, found = text or "", []
    name = "(" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in n) for n in ("password", "passwd", "secret", "token", "api_?key")) + ")"
    for m in re.finditer(name + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 8:
            found.append((m.start(), 0, m.end(), "assign"))
    for m in re.finditer(r"AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 16:
            found.append((m.start(), 1, m.end(), "access"))
    for m in re.finditer(r"[0-9a-f]+", text):
        if len(m[0]) >= 32:
            found.append((m.start(), 2, m.end(), "hex"))
    return sorted(found)


def secrets(text):
    found = base_spans(text)
    n = [sum(f[3] == k for f in found) for k in ("assign", "access", "hex")]
    return (*n, digest(",".join(f"{k}:{s}:{e}" for s, _, e, k in found)))


def exact(rows, pick=max):
    groups = {}
    for doc, text in rows:
        groups.setdefault(low(text), []).append(doc)
    out = []
    for doc, text in rows:
        ids = groups[low(text)]
        known = [x for x in ids if x is not None]
        keep = pick(known) if known else None
        out.append((doc, keep, len(ids), doc == keep, digest(low(text))))
    return out


def fingerprint(text, words=3):
    w = WS.findall(low(text))
    if not w:
        return 0
    grams = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(rows):
    """[(doc_id, fingerprint)] to component ids, by comparing all pairs."""
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 3:
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return [least.get(root(i)) for i in range(len(rows))]


def bpe(texts, path):
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    out = []
    for t in texts:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        out.append((len(ids), digest(" ".join(map(str, ids))), digest(tok.decode(ids, skip_special_tokens=False))))
    return out


def contamination(texts, items, window=13):
    windows = {}
    for item, text in items:
        w = WORD.findall(low(text))
        for k in range(max(1, len(w) - window + 1)) if w else ():
            windows.setdefault(tuple(w[k : k + window]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for t in texts:
        w, hit, found = WORD.findall(low(t)), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= own
        out.append((len(w), len(hit), len(found), digest(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def bucket(doc, n):
    return crc32(("" if doc is None else str(doc)).encode()) % n
