"""Plain versions of the operators, and a small table of documents with hard cases."""

import hashlib
import math
import re
from collections import Counter, defaultdict

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def documents(n=120, seed=3):
    """(doc_id, text): copies, near copies, a shared passage, nulls, empty, short, odd and long texts."""
    import random

    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgéü") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    prose = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage, base, copy = prose(45), prose(150).split(), prose(80)
    out = []
    for i in range(n):
        kind = i % 12
        text = {
            0: lambda: copy,
            1: lambda: None,
            2: lambda: "",
            3: lambda: prose(rng.randint(1, 4)),
            4: lambda: prose(30) + "\n" + passage + ".\n" + prose(20),
            5: lambda: " ".join(w if rng.random() > 0.015 else "x" + w for w in base),
            6: lambda: "\x00 ** \t 12 " + prose(25).upper() + " ٣ 北京 <|endoftext|> ",
            7: lambda: (prose(12) + " ") * 6,
            8: lambda: "  \n\t ...",
        }.get(kind, lambda: prose(rng.randint(20, 60)))()
        out.append((i, text))
    out.append((n, prose(4000) + " " + passage))
    return out


def decontaminated(docs, items, window=10):
    grams = defaultdict(set)
    for item, text in items:
        w = words(text)
        size = min(window, len(w))
        for i in range(len(w) - size + 1):
            if size:
                grams[tuple(w[i : i + size])].add(item)
    sizes = {len(g) for g in grams}
    out = {}
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                got = grams.get(tuple(w[i : i + n]))
                if got:
                    hit.update(range(i, i + n))
                    found |= got
        out[doc] = (len(w), len(hit), sorted(found))
    return out


def without_repeats(docs, window=20):
    seen, out = set(), {}
    for doc, text in sorted(docs, key=lambda d: d[0]):
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            if g in seen:
                gone[i : i + window] = [True] * window
            seen.add(g)
        out[doc] = (len(w), sum(gone), b" ".join(x for x, y in zip(w, gone, strict=True) if not y).decode())
    return out


def classes(docs, n=5, similarity=0.8):
    sets = {}
    for doc, text in docs:
        w = words(text)
        sets[doc] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    parent, links = {d: d for d in sets}, Counter()

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both >= similarity * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (root(d), links[d]) for d in ids}


def backoff_scores(docs, order=3, backoff=0.4):
    grams = lambda w: Counter(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1))
    split = {d: words(t) for d, t in docs}
    total = Counter()
    for w in split.values():
        total += grams(w)
    everything, out = sum(map(len, split.values())), {}
    for d, w in split.items():
        own, others, score, short = grams(w), everything - len(w), 0.0, 0
        for i in range(len(w)):
            longest = min(i + 1, order)
            for n in range(longest, -1, -1):
                if not n:
                    score += math.log(1 / (others + 1)) + (longest - 1) * math.log(backoff)
                    short += 1
                    break
                g = tuple(w[i - n + 1 : i + 1])
                if total[g] > own[g]:
                    below = others if n == 1 else total[g[:-1]] - own[g[:-1]]
                    score += math.log((total[g] - own[g]) / below) + (longest - n) * math.log(backoff)
                    short += n < longest
                    break
        out[d] = (len(w), score, short)
    return out


def smallest_capacity(sizes, shards):
    def fits(cap):
        used, now = 1, 0
        for s in sizes:
            if s > cap:
                return False
            if now + s > cap:
                used, now = used + 1, 0
            now += s
        return used <= shards

    low, high = 1, sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


def quality_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    twice = Counter(windows)
    covered = {i + k for i, g in enumerate(windows) if twice[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def ranked(docs, items, k=10):
    """(item position, rank, doc, score) by scoring every pair."""
    split = [(d, words(t)) for d, t in docs]
    counts = [(d, Counter(w), len(w)) for d, w in split]
    n_docs, length = sum(n > 0 for *_, n in counts), sum(n for *_, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for i, (_, text) in enumerate(items):
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in set(words(text))}
        found = []
        for d, c, n in counts:
            m = 10 + 90 * n * n_docs // max(length, 1)
            score = sum(w * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, w in weight.items() if t in c)
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(i, r, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(found)[:k], 1)]
    return out


def resampled(docs, target, buckets=10_000, percent=25, least=20, seed=7):
    """(doc, n_features, weight, score, rank) by a sort of all documents."""
    import zlib

    def features(text):
        w = words(text)
        return [zlib.crc32(x.encode()) % buckets for x in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))]]

    mine = [(d, len(words(t)), features(t)) for d, t in docs]
    s, t = Counter(b for *_, f in mine for b in f), Counter(b for _, x in target for b in features(x))
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets))))
    rows = []
    for i, (d, n, f) in enumerate(mine):
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(sha(f"{seed}:{'null' if d is None else d}")[:8], 16)
        rows.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n, i])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[6]))
    for k, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = k
    return [tuple(r[:5]) for r in rows]
