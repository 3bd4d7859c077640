"""Plain versions of operators, over small tables, that share no code with them."""

from collections import Counter, defaultdict

SPACE = " \t\n\v\f\r"


def words_of(text):
    return (text or "").encode("utf-8", "surrogatepass").split()


def line_dedup(rows, min_words, short_words, frequent):
    """{(doc_id, text): text without later repeated runs}, by comparing lines themselves; rows are (doc_id, text)."""
    docs = sorted(set(r for r in rows if r[1]), key=lambda r: (r[0] is None, r[0] or 0))
    units = {r: [(i, x.strip(SPACE)) for i, x in enumerate(r[1].split("\n")) if words_of(x)] for r in docs}
    windows, first, times = defaultdict(list), {}, Counter()
    for r in docs:
        u = units[r]
        for i in range(len(u)):
            n, j = 0, i
            while j < len(u) and n < min_words:
                n += len(words_of(u[j][1]))
                j += 1
            if n >= min_words:
                windows[r].append((i, j, False))
            if short_words <= len(words_of(u[i][1])) < min_words:
                windows[r].append((i, i + 1, True))
        for i, j, short in windows[r]:
            key = (short, *(x for _, x in u[i:j]))
            first.setdefault(key, (r, i))
    for r in rows:
        for i, j, short in windows.get(tuple(r), []):
            times[(short, *(x for _, x in units[tuple(r)][i:j]))] += 1
    out = {}
    for r in docs:
        u, gone = units[r], set()
        for i, j, short in windows[r]:
            key = (short, *(x for _, x in u[i:j]))
            of, at = first[key]
            if (of, at) == (r, i) or short and times[key] < frequent:
                continue
            f, a, b = units[of], i, j
            while a and a + at - i and u[a - 1][1] == f[a - 1 + at - i][1]:
                a -= 1
            while b < len(u) and b + at - i < len(f) and u[b][1] == f[b + at - i][1]:
                b += 1
            gone |= set(range(u[a][0], u[b - 1][0] + 1))
        lines = r[1].split("\n")
        out[r] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def jaccard(rows, k=5, percent=80):
    """{doc_id: (set size, component)} by comparing every two sets that share a shingle; rows are (doc_id, text), ids unique."""
    sets = {}
    for i, text in rows:
        w = [x.lower() for x in words_of(text)]
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    holders, root = defaultdict(list), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in sets.items():
        for shingle in s:
            holders[shingle].append(i)
    for a, b in {(a, b) for some in holders.values() for a in some for b in some if a < b}:
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def fingerprint(text, k, w, few, long, bits):
    """Chosen (hash, position) pairs by looking at every window."""
    import struct

    import xxhash

    signed = lambda h: h - (1 << 64) if h >> 63 else h
    hash_ = lambda data, seed=42: xxhash.xxh64_intdigest(data, seed=seed)
    text = text or ""
    units = [u.decode() for u in text.encode().split()]
    if len(units) < k or len(text) > long * len(units):
        units = list(text)
    # doubling: a hash of two neighbours is that of the second, seeded by that of the first
    level = [signed(hash_(u.encode())) for u in units]
    single, step = level, 1
    while step < k:
        level = [signed(hash_(struct.pack("<q", b), hash_(struct.pack("<q", a)))) for a, b in zip(level, level[step:], strict=False)]
        step *= 2
    marked = [(h >> bits, i) for i, h in enumerate(level)] if len(units) >= k else []
    if len(marked) >= 4 * w:
        return sorted({min(marked[i : i + w], key=lambda m: (m[0], -m[1])) for i in range(len(marked) - w + 1)}, key=lambda m: m[1])
    return marked + ([(h >> bits, i) for i, h in enumerate(single)] if len(units) < few else [])


def likeness(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a or b else 1.0


def viterbi(scores, switch):
    """The greatest total over all paths, by the plain recursion."""
    best = list(scores[0])
    for row in scores[1:]:
        best = [max(b - (switch if i != j else 0) for i, b in enumerate(best)) + row[j] for j in range(len(row))]
    return max(best)


class KneserNey:
    """Interpolated modified Kneser-Ney trigrams over dictionaries; texts are lists of word ids that begin with two 0 and end with 1."""

    def __init__(self, texts, size):
        tri = Counter(tuple(t[i : i + 3]) for t in texts for i in range(len(t) - 2))
        bi = Counter((b, c) for _, b, c in tri)
        one = Counter(c for _, c in bi)
        self.tri, self.bi = self.level(tri), self.level(bi)
        used, total = len(one), sum(one.values())
        self.one = [(max(one[i] - 0.5, 0) + 0.5 * max(1, used) / size) / max(1, total) for i in range(size)]

    @staticmethod
    def level(counts):
        n = [sum(v == i for v in counts.values()) for i in (1, 2, 3, 4)]
        d = [0.5, 0.75, 0.9]
        if min(n) > 0:
            y = n[0] / (n[0] + 2 * n[1])
            d = [min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.05), i - 0.05) for i in (1, 2, 3)]
        total, off = Counter(), defaultdict(float)
        for gram, v in counts.items():
            total[gram[:-1]] += v
            off[gram[:-1]] += d[min(v, 3) - 1]
        return counts, d, total, off

    def share(self, level, gram, lower):
        counts, d, total, off = level
        if not total[gram[:-1]]:
            return lower
        v = counts[gram]
        return ((v - d[min(v, 3) - 1] if v else 0) + off[gram[:-1]] * lower) / total[gram[:-1]]

    def nats(self, t):
        import math

        total = 0.0
        for a, b, c in zip(t, t[1:], t[2:], strict=False):
            total += math.log(max(self.share(self.tri, (a, b, c), self.share(self.bi, (b, c), self.one[c])), 1e-9))
        return -total / (len(t) - 2)
