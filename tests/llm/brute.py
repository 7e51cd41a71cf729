"""Plain versions of the results, straight from their definitions."""

import hashlib
import re
from collections import Counter

SPACED = re.compile("[^\x20\x09-\x0D]+")
LETTERS = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def quality(text):
    text = text or ""
    w = SPACED.findall(text)
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def contamination(texts, items):
    windows = {}
    for item, text in items:
        w = LETTERS.findall(lower(text))
        if w:
            for i in range(max(1, len(w) - 12)):
                windows.setdefault(tuple(w[i : i + 13]), set()).add(str(item))
    out = []
    for doc, text in texts:
        w, hit, found = LETTERS.findall(lower(text)), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (of := windows.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= of
        out.append((doc, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def near_duplicates(texts, percent=85):
    sets = []
    for _, text in texts:
        w = SPACED.findall(lower(text))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    group = list(range(len(texts)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                group[max(a, b)] = min(a, b)
    least = {}
    for i, (doc, _) in enumerate(texts):
        if doc is not None:
            least[top(i)] = min(doc, least.get(top(i), doc))
    return [(doc, len(sets[i]), least.get(top(i)) if sets[i] else doc) for i, (doc, _) in enumerate(texts)]


def substrings(texts):
    rank = lambda d: float("inf") if d is None else d
    first = {}
    for doc, text in texts:
        w = SPACED.findall(text or "")
        for i in range(len(w) - 12):
            key = tuple(w[i : i + 13])
            first[key] = min(rank(doc), first.get(key, float("inf")))
    out = []
    for doc, text in texts:
        w = SPACED.findall(text or "")
        gone = {i + k for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < rank(doc) for k in range(13)}
        out.append((doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def languages(train, texts):
    """Model, proportions and choice of languages, by plain loops: (language, proportion) of each text."""
    import math

    def grams(text):
        low = bytes(b + 32 if 65 <= b <= 90 else b for b in (" " + text + " ").encode())
        low = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in low)
        found = [low[i : i + 3] for i in range(len(low) - 2) if low[i : i + 2] != b"  " and low[i + 1 : i + 3] != b"  "]
        return Counter((int.from_bytes(g, "little") * 0x9E3779B97F4A7C15 % 2**64) >> 49 for g in found)

    langs = sorted({lang for _, lang in train})
    counts = {lang: Counter() for lang in langs}
    for text, lang in train:
        counts[lang] += grams(text)
    chance = {lang: lambda g, c=counts[lang], z=sum(counts[lang].values()) + 0.5 * 2**15: (c[g] + 0.5) / z for lang in langs}

    def fitted(found, total, chosen):
        share = {k: 1 / len(chosen) for k in chosen}
        for _ in range(30 if len(chosen) > 1 else 0):
            new = dict.fromkeys(chosen, 0.0)
            for g, n in found.items():
                parts = {k: chance[k](g) * share[k] for k in chosen}
                for k in chosen:
                    new[k] += n / total * parts[k] / sum(parts.values())
            done = max(abs(new[k] - share[k]) for k in chosen) < 1e-4
            share = new
            if done:
                break
        return share, sum(n / total * math.log(sum(chance[k](g) * share[k] for k in chosen)) for g, n in found.items())

    out = []
    for text in texts:
        if not any(ch.isalpha() for ch in text or ""):
            out.append(("und", 0.0))
            continue
        found = grams(text)
        total = sum(found.values())
        chosen = [max(langs, key=lambda k: sum(n * math.log(chance[k](g)) for g, n in found.items()))]
        share, best = fitted(found, total, chosen)
        while rest := [k for k in langs if k not in chosen]:
            gain = lambda k: sum(n * math.log(0.9 * sum(chance[c](g) * share[c] for c in chosen) + 0.1 * chance[k](g)) for g, n in found.items())
            more = [*chosen, max(rest, key=gain)]
            new, value = fitted(found, total, more)
            if value - best <= 0.5 * math.log(total) / total:
                break
            chosen, share, best = more, new, value
        out.append(max(share.items(), key=lambda x: x[1]))
    return out


def boilerplate(pages, ratio=0.3, least_pages=3, least_copies=2):
    """(id, lines kept) of pages (id, host, lines)."""
    n, has = Counter(h for _, h, _ in pages), Counter((h, x) for _, h, ls in pages for x in set(ls))
    bad = {(h, x) for (h, x), c in has.items() if n[h] >= least_pages and c >= least_copies and c > ratio * n[h]}
    return [(i, [x for x in ls if (h, x) not in bad]) for i, h, ls in pages]


def mixture(docs, entropy, repetition, block_tokens, seed=7):
    """Copies of documents (id, source, text), with ids of their own."""
    import math

    md5 = lambda *x: hashlib.md5(":".join(map(str, x)).encode()).hexdigest()
    rows = [(i, s, -(-len(t.encode()) // 4), md5(seed, i)) for i, s, t in docs]
    have = Counter()
    for _, s, n, _ in rows:
        have[s] += n
    total, p = sum(have.values()), {s: n / sum(have.values()) for s, n in have.items()}
    spread = lambda a: -sum(w / z * math.log(w / z) for z in [sum(v**a for v in p.values())] for w in [v**a for v in p.values()])
    most = lambda a: max(v**a / v for v in p.values()) / sum(v**a for v in p.values())
    grid = 1 << 20

    def last(fits):
        low, high = 0, grid
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if fits(mid / grid) else (low, mid)
        return low

    aim = math.log(len(p)) * entropy
    by_spread = grid if spread(1) >= aim else last(lambda a: spread(a) >= aim)
    by_repeats = 0 if most(0) <= repetition else last(lambda a: most(a) > repetition) + 1
    alpha = max(by_spread, by_repeats) / grid
    z, out = sum(v**alpha for v in p.values()), {}
    for s, n in have.items():
        goal = math.floor(p[s] ** alpha / z * total + 0.5)
        epochs, rest, blocks = goal // n, goal % n, 1
        while blocks < min(4096, -(-n // block_tokens)):
            blocks *= 2
        own = [r for r in rows if r[1] == s]
        turn = lambda r: md5(seed, s, epochs, int(r[3][:8], 16) % 4096 % blocks)  # noqa: E731, B023
        used, open_ = 0, True
        for t in sorted({turn(r) for r in own}):
            inside = sorted((r for r in own if turn(r) == t), key=lambda r: r[3])
            fits = used + sum(r[2] for r in inside) <= rest
            for r in inside:
                used += r[2]
                out[r[0]] = epochs + (open_ and used <= rest)
            open_ = open_ and fits
    return out
