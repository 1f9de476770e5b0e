"""Plain single-process versions of the operators, for comparison on small inputs."""

import hashlib
import re
import zlib

import numpy as np
import xxhash


def shingle_set(text):
    words = [w.decode("utf-8") for w in (text or "").encode().lower().split()]
    if not words:
        return frozenset()
    if len(words) < 5:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def near_components(docs):
    """docs: list of (id, text). {id: (n, component)} by comparing all pairs."""
    sets = {d: shingle_set(t) for d, t in docs}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    by_shingle = {}
    for d in ids:
        for s in sets[d]:
            by_shingle.setdefault(s, []).append(d)
    seen = set()
    for group in by_shingle.values():
        for i, a in enumerate(group):
            for b in group[i + 1 :]:
                if (a, b) in seen:
                    continue
                seen.add((a, b))
                if find(a) == find(b):
                    continue
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def repeated_bytes(docs, width=100):
    """{id: (n_bytes, n_removed, n_spans, sha256 of the rest)}."""
    docs = sorted((d, (t or "").encode()) for d, t in docs)
    first = {}
    out = {}
    for d, b in docs:
        gone = np.zeros(len(b) + 1, dtype=bool)
        for i in range(len(b) - width + 1):
            s = b[i : i + width]
            if first.setdefault(s, (d, i)) != (d, i):
                gone[i : i + width] = True
        rest = bytes(c for c, g in zip(b, gone) if not g)
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(b) else 0
        out[d] = (len(b), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest())
    return out


def pieces(docs, tokenizer):
    out = {}
    for d, t in docs:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        for p, at in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[at : at + 4096], dtype="<u4").tobytes()
            out[d, p] = (at, len(part) // 4, zlib.crc32(part))
    return out


def nearest(vectors, k=20):
    """vectors: list of (id, list or None). {query: [(id, score)]}, ties to smaller ids."""
    good = [(i, np.array(v, dtype=float)) for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in good:
        if q % 20 == 0:
            scored = sorted(((-float((v * w).sum()), i) for i, w in good if i != q))[:k]
            out[q] = [(i, -s) for s, i in scored]
    return out


def fused_languages(model, rows, prior_rows=20.0, odd=0.02):
    """rows: list of (text, declared, suffix, host, domain) with None for what is not known. [(language, confidence, text's own)]."""
    n = len(model.languages)
    logs = [np.array(model.score(t)) for t, *_ in rows]
    post = [np.exp(x - x.max()) / np.exp(x - x.max()).sum() for x in logs]
    clean = [((d or "").strip().lower(), s or "", h or "", m or "") for _, d, s, h, m in rows]
    mass = sum(post, np.zeros(n))
    total = mass.sum()
    overall = (mass + 1 / n) / (total + 1)

    def counts(at, *of):
        return sum((p for p, c in zip(post, clean, strict=True) if tuple(c[i] for i in at) == of), np.zeros(n))

    out = []
    for (text, *_), own, x, (declared, suffix, host, domain) in zip(rows, post, logs, clean, strict=True):
        parent = counts([3], domain) + prior_rows * overall
        parent = parent / parent.sum()
        prior = parent if host == "" else np.maximum(counts([2, 3], host, domain) - own, 0) + prior_rows * parent
        s = x + np.log(prior)
        for at, value in ((0, declared), (1, suffix)):
            if value:
                c = np.maximum(counts([at], value) - own, 0)
                s = s + np.log((c + odd * c.sum()) / (np.maximum(mass - own, 0) + odd * (total - 1) + 1e-9) + 1e-9)
        p = np.exp(s - s.max())
        p = p / p.sum()
        if not (text or "").strip() or not x.any():
            out.append(("und", 0.0, "und"))
        else:
            out.append((model.languages[int(p.argmax())], float(p.max()), model.languages[int(x.argmax())]))
    return out


def mixed(rows, entropy_gain, max_repeats, block_tokens, buckets):
    """rows: (id, source, tokens, bucket, order within the bucket, order of a copy within its block by epoch). {(id, epoch): (block, slot)}
    and the sources' weights, with the exponent by plain bisection."""
    import math

    sums = {}
    for _, source, tokens, *_ in rows:
        sums[source] = sums.get(source, 0) + tokens
    total = sum(sums.values())
    share = {s: t / total for s, t in sums.items()}

    def weights(a):
        z = sum(p**a for p in share.values())
        return {s: p**a / z for s, p in share.items()}

    entropy = lambda w: -sum(x * math.log(x) for x in w.values())

    def bisect(fits, low, high):
        if fits(weights(low)):
            return low
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (low, middle) if fits(weights(middle)) else (middle, high)
        return high

    even, given = entropy(weights(0)), entropy(weights(1))
    target = given + entropy_gain * (even - given)
    a = bisect(lambda w: entropy(w) <= target, 0.0, 8.0)
    if a < 1:
        a = max(a, bisect(lambda w: max(w[s] * total / sums[s] for s in w) <= max_repeats * (1 + 1e-12), a, 1.0))
    w = weights(a)
    blocks = math.ceil(total / block_tokens)
    dealt = {}
    for source in sums:
        at, repeats = 0, w[source] * total / sums[source]
        for i, _, tokens, _, _, shuffles in sorted((r for r in rows if r[1] == source), key=lambda r: (r[3], r[4])):
            copies = math.floor(repeats) + (at < (repeats - math.floor(repeats)) * sums[source])
            for epoch in range(copies):
                block = min(math.floor((epoch * sums[source] + at) / (repeats * sums[source]) * blocks), blocks - 1)
                dealt.setdefault(block, []).append((shuffles[epoch], i, epoch))
            at += tokens
    return {(i, epoch): (b, slot) for b, found in dealt.items() for slot, (_, i, epoch) in enumerate(sorted(found))}, w



def spot_signatures(text, common, chain=2):
    """The set of signatures as word tuples: each common word with the next `chain` words that are not common; texts without
    one have their runs of chain + 1 words."""
    words = re.findall(r"[a-z\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    out = set()
    for i, w in enumerate(words):
        if w in common:
            after = [x for x in words[i + 1 :] if x not in common][:chain]
            if len(after) == chain:
                out.add((w, *after))
    if not out and words:
        out = {tuple(words[i : i + chain + 1]) for i in range(max(1, len(words) - chain))}
    return out


def printed(signatures):
    """Eight hex digits a signature, in order."""
    return "".join(f"{h:08x}" for h in sorted({xxhash.xxh32_intdigest(" ".join(s).encode()) for s in signatures}))


def overlap(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def spot_components(docs, common, percent=75):
    """docs: list of (id, text). {id: (n, class, component)} by comparing all pairs."""
    sets = {d: frozenset(spot_signatures(t, common)) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(s), min((e for e in ids if sets[e] == s), default=d) if s else d, find(d)) for d, s in sets.items()}


def hilbert_place(cell, bits):
    """The curve index of one cell, bit by bit: the quadrant's Gray code rank, after the turns and flips of the quadrants above."""
    d, cell = len(cell), list(cell)
    for b in range(bits - 1, 0, -1):
        for i in range(d):
            if cell[i] >> b & 1:
                cell[0] ^= (1 << b) - 1
            else:
                swap = (cell[0] ^ cell[i]) & ((1 << b) - 1)
                cell[0], cell[i] = cell[0] ^ swap, cell[i] ^ swap
    for i in range(1, d):
        cell[i] ^= cell[i - 1]
    flips = 0
    for b in range(bits - 1, 0, -1):
        if cell[-1] >> b & 1:
            flips ^= (1 << b) - 1
    place = 0
    for b in range(bits - 1, -1, -1):
        for c in cell:
            place = place * 2 + ((c ^ flips) >> b & 1)
    return place
