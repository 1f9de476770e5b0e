"""The match cascade one row at a time, for comparison on small inputs; written from the rules' description."""

import re

from origintrace.rules import tables as R


def norm(v):
    v = (v or "").strip().upper()
    for p in R.NOISE_PREFIXES:
        v = v.removeprefix(p)
    return re.sub("[^A-Z0-9]", "", v)


def fold(k):
    return k.translate(str.maketrans(R.FOLD_FROM, R.FOLD_TO))


def cuts(k):
    return [k[:n] for n in range(len(k) - 1, R.TRUNCATION_FLOOR - 1, -1)]


def readings(k):
    there, back = dict(R.GLYPH_PAIRS), {b: a for a, b in R.GLYPH_PAIRS}
    out = [k]
    for i, ch in enumerate(k):
        out += [k[:i] + t[ch] + k[i + 1 :] for t in (there, back) if ch in t]
    return list(dict.fromkeys(out))[: R.MOST_VARIANTS]


def osa(a, b):
    d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
    for i in range(len(a)):
        for j in range(len(b)):
            best = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                best = min(best, d[i - 2, j - 2] + (a[i] != b[j]))
            d[i, j] = best
    return d[len(a) - 1, len(b) - 1]


def likeness(a, b):
    if not a or not b:
        return 0.0
    if a == b:
        return 100.0
    n = max(len(a), len(b))
    same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return round((1 - osa(a, b) / n) * 75 + same / n * 25, 2)


def label(raw, single=False):
    s = (raw or "").strip()
    structured = s.startswith("[)>") or re.search("[\x1d\x1e\x04]", s)
    if not structured and not single:
        return None
    parts = re.split("[\x1d\x1e\x04]", s[3:] if s.startswith("[)>") else s) if structured else [s]
    out = {}
    for p in (p.strip() for p in parts):
        if p and not re.fullmatch(r"\d\d", p):
            hit = next(((f, p[len(d) :].strip()) for d, f in R.LABEL_FIELDS if p.upper().startswith(d) and len(p) > len(d)), None)
            if hit:
                out.setdefault(*hit)
    return out if "mpn" in out else None


class Catalogue:
    def __init__(self, rows):
        self.rows = sorted(rows, key=lambda r: r["ord"])
        self.keys, self.folds, self.bars, self.qrs = {}, {}, {}, {}
        for r in self.rows:
            if r["search_key"]:
                self.keys.setdefault(r["search_key"], []).append(r)
                self.folds.setdefault(fold(r["search_key"]), []).append(r)
            for codes, c in ((self.bars, "barcode"), (self.qrs, "qr_code")):
                if (r[c] or "").strip():
                    codes[r[c].strip().upper()] = r

    def resolve(self, hits, key, method, score):
        """method, score, component, the key that was found by, and the other rows."""
        known = [h for h in hits if h["is_chinese"] != "UNKNOWN"] or hits
        other = lambda rows: [(h["component_id"], score, method) for h in rows]
        if len({h["is_chinese"] for h in known}) > 1:
            return "conflict", score, None, key, other(known)
        best = max(known, key=lambda h: h["confidence_score"])
        return method, score, best["component_id"], key, other(known[1:])

    def match(self, raw):
        raw = (raw or "").strip()
        key = norm(raw)
        if not key:
            return "none", 0.0, None, "", []
        code = self.bars.get(raw.upper()) or self.qrs.get(raw.upper())
        if code:
            return "exact_code", 100.0, code["component_id"], key, []
        found = label(raw)
        if found:
            inner = self.match(found["mpn"])
            return ("label_mpn", *inner[1:]) if inner[0] == "normalized" else inner
        if key in self.keys:
            return self.resolve(self.keys[key], key, "normalized", 100.0)
        one = label(raw, True)
        if one and norm(one["mpn"]) in self.keys:
            inner = self.match(one["mpn"])
            return ("label_mpn", *inner[1:]) if inner[0] == "normalized" else inner
        for table, probes, method in ((self.keys, cuts(key), "lot_code_stripped"), (self.keys, readings(key)[1:], "ocr_corrected"), (self.folds, [fold(key)], "ocr_folded"), (self.folds, cuts(fold(key)), "ocr_folded_stripped")):
            for p in probes:
                if p in table:
                    return self.resolve(table[p], p if table is self.keys else key, method, R.SCORES[method])
        if len(key) >= R.PREFIX_FLOOR:
            hits = [k for k in self.keys if k.startswith(key) or key.startswith(k)]
            if hits:
                longest = [k for k in hits if len(k) == max(map(len, hits))]
                if len(longest) == 1:
                    return self.resolve(self.keys[longest[0]], key, "prefix", 88.0)
                return "ambiguous_prefix", 0.0, None, key, [(r["component_id"], 85.0, "prefix") for k in longest for r in self.keys[k]][:10]
        grams = lambda k: {k[i : i + 3] for i in range(max(1, len(k) - 2))}
        near = sorted(((len(grams(key) & grams(r["search_key"])), -r["ord"], r) for r in self.rows if grams(key) & grams(r["search_key"])), key=lambda x: x[:2], reverse=True)[: R.FUZZY_SCANNED]
        scored = sorted(((likeness(key, r["search_key"]), r) for _, _, r in near), key=lambda x: -x[0])
        scored = [x for x in scored if x[0] >= R.FUZZY_LEAST]
        five = [(r["component_id"], s, "fuzzy") for s, r in scored[:5]]
        if not scored or scored[0][0] < R.FUZZY_ACCEPT:
            return "none", scored[0][0] if scored else 0.0, None, key, five
        if len(scored) > 1 and scored[1][0] >= scored[0][0] - R.FUZZY_MARGIN:
            return "ambiguous_fuzzy", scored[0][0], None, key, five
        return "fuzzy", scored[0][0], scored[0][1]["component_id"], key, five[1:]


def prefixed(scans, keys):
    """scans: {id: marking}. {id: kind} of those that begin a key or that a key begins; the longest keys count."""
    out = {}
    for i, raw in scans.items():
        read = norm(raw)
        hits = [k for k in keys if k.startswith(read) or read.startswith(k)] if len(read) >= R.PREFIX_FLOOR else []
        if hits:
            out[i] = "ambiguous_prefix" if sum(len(k) == max(map(len, hits)) for k in hits) > 1 else "prefix"
    return out
