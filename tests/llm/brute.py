"""Plain versions of the operators, over lists of rows, for small inputs."""

import collections
import hashlib
import math
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def sha(raw):
    return hashlib.sha256(raw).hexdigest()


def exact(rows):
    """(doc_id, text) -> sorted (doc_id, keep_id, group_size, kept, sha)."""
    groups = collections.defaultdict(list)
    for i, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), i is None, i or 0, i))
    out = []
    for bare, members in groups.items():
        members.sort()
        for k, m in enumerate(members):
            out.append((m[3], members[0][3], len(members), k == 0, sha(bare.encode())))
    return out


def jaccard(rows, width, percent):
    sets = []
    for i, text in rows:
        w = words((text or "").translate(LOWER))
        sets.append((i, {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()))
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                up[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(sets):
        r = find(k)
        if i is not None:
            low[r] = min(low.get(r, i), i)
    return [(i, len(s), low.get(find(k)) if s else i) for k, (i, s) in enumerate(sets)]


def byte_repeats(rows, length):
    count, texts = collections.Counter(), []
    for i, text in rows:
        raw = (text or "").encode()
        texts.append((i, raw))
        for k in range(len(raw) - length + 1):
            count[raw[k : k + length]] += 1
    out = []
    for i, raw in texts:
        cover = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            if count[raw[k : k + length]] > 1:
                cover[k : k + length] = b"\1" * length
        out.append((i, len(raw), sum(cover), len(re.findall(b"\1+", bytes(cover))), sha(bytes(a for a, b in zip(raw, cover) if not b))))
    return out


def word_repeats(rows, length):
    first, texts = {}, []
    key = lambda i: math.inf if i is None else i
    for i, text in rows:
        w = words(text)
        texts.append((i, w))
        for k in range(len(w) - length + 1):
            t = tuple(w[k : k + length])
            first[t] = min(first.get(t, math.inf), key(i))
    out = []
    for i, w in texts:
        cover = [False] * len(w)
        for k in range(len(w) - length + 1):
            if first[tuple(w[k : k + length])] < key(i):
                cover[k : k + length] = [True] * length
        out.append((i, len(w), sum(cover), sha(" ".join(a for a, b in zip(w, cover) if not b).encode())))
    return out


def quality_counts(text):
    text = text or ""
    w = words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    windows = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    cover = set()
    for k in range(len(w) - 7):
        if windows[tuple(w[k : k + 8])] > 1:
            cover.update(range(k, k + 8))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(cover)


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """{source: size} -> {source: target}, by resharing what is too much until none is above."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        rest = [s for s in sizes if s not in fixed]
        left = total - sum(fixed.values())
        level = left / sum(weight[s] for s in rest) if rest else 0
        over = [s for s in rest if level * weight[s] > most * sizes[s]]
        if not over:
            return fixed | {s: level * weight[s] for s in rest}
        fixed |= {s: most * sizes[s] for s in over}


def mix(rows, draw, weights=(3, 1, 2), share=1.5, most=2):
    """(doc_id, text, source) and doc_id -> random number: sorted (doc_id, size, copies), source by source in plain order."""
    by = collections.defaultdict(list)
    for i, text, s in rows:
        by[s].append((i, len(words(text))))
    want, out = targets({s: sum(n for _, n in d) for s, d in by.items()}, weights, share, most), []
    for s, docs in by.items():
        total = sum(n for _, n in docs)
        whole = int(want[s] / total) if total else 0
        missing = max(0.0, want[s] - whole * total)
        kind = lambda n: math.floor(math.log2(math.sqrt(n)) * 8) if n else None
        kinds, cut, rate, above = sorted({kind(n) for _, n in docs if n}, reverse=True), None, 0.0, 0
        for k in kinds:
            rest = [n for _, n in docs if n and kind(n) <= k]
            rate = (missing - above) / sum(n * math.sqrt(n) for n in rest)
            own = [n for n in rest if kind(n) == k]
            if rate * math.sqrt(max(own)) <= 1 or above + sum(own) >= missing:
                cut = k
                break
            above += sum(own)
        taken, order = {}, []
        for at, (i, n) in enumerate(docs):
            taken[at] = 0
            if missing > 0 and n and cut is not None:
                if kind(n) > cut:
                    taken[at] = 1
                else:
                    p, u = min(math.sqrt(n) * rate, 1 - 1e-6), draw[i]
                    order.append(((u / (1 - u)) / (p / (1 - p)) if p > 0 else math.inf, i is not None, i or 0, n, at))
        open_ = missing - sum(docs[at][1] for at in taken if taken[at])
        start = 0
        for _, _, _, n, at in sorted(order):
            taken[at] = int(2 * (open_ - start) >= n)
            start += n
        gap = open_ - sum(o[3] for o in order if taken[o[4]])
        start = 0
        for _, _, _, n, at in sorted(order):
            if gap > 0 and not taken[at] and n <= gap:
                taken[at] = int(start + n <= gap)
                start += n
        out += [(i, n, min(most, whole + taken[at])) for at, (i, n) in enumerate(docs)]
    return out


def posteriors(votes, rounds=500, prior=0.85, belief=0.02):
    """EM over documents, one by one: rows of votes (0 bad, 1 good, 2 none) -> P(good) of each."""
    rules = len(votes[0])
    start = [[(0.5, 0.5)] * rules, [(0.02, 0.98)] * rules]
    good, table, weight = prior, start, belief * len(votes)

    def one(v):
        a, b = math.log(1 - good), math.log(good)
        for r, x in enumerate(v):
            if x < 2:
                a, b = a + math.log(table[0][r][x]), b + math.log(table[1][r][x])
        return 1 / (1 + math.exp(min(700, max(-700, a - b))))

    for _ in range(rounds):
        p = [one(v) for v in votes]
        new = []
        for c in (0, 1):
            share, own = [x if c else 1 - x for x in p], []
            for r in range(rules):
                n = [start[c][r][k] * weight + sum(s for s, v in zip(share, votes) if v[r] == k) for k in (0, 1)]
                own.append((n[0] / sum(n), n[1] / sum(n)))
            new.append(own)
        now = min(1 - 1e-3, max(1e-3, (sum(p) + prior * weight) / (len(votes) + weight)))
        done = abs(now - good) < 1e-9 and all(abs(x[0] - y[0]) < 1e-9 for a, b in zip(new, table) for x, y in zip(a, b))
        good, table = now, new
        if done:
            break
    return [one(v) for v in votes]


def votes(text):
    """Votes of the standard rules on a text."""
    n, chars, symbols, dup, repeat = quality_counts(text)
    raw = (text or "").encode()
    letters, lines = sum(65 <= b < 91 or 97 <= b < 123 or 0xC2 <= b < 0xF5 for b in raw), (text or "").count("\n") + 1
    rules = [
        (100 * symbols <= 2 * n, 100 * symbols > 8 * n), (200 * symbols <= chars, 50 * symbols > chars), (100 * letters >= 93 * chars, 100 * letters < 90 * chars),
        (45 * n <= 10 * chars <= 60 * n, 10 * chars < 42 * n or 10 * chars > 65 * n), (dup == 0, 100 * dup > 15 * lines), (repeat == 0, 100 * repeat > 8 * n), (n >= 80, n < 50),
    ]
    return tuple(0 if bad else 1 if good else 2 for good, bad in rules)


def unigram(rows):
    """(doc_id, text) -> (doc_id, held_out, tokens, known, N, base score)."""
    docs = [(i, zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2, [*words((t or "").translate(LOWER)), None]) for i, t in rows]
    c = collections.Counter(w for _, held, x in docs if not held for w in x)
    n, v = sum(c.values()), len(c)
    return [(i, held, len(x), sum(c[w] > 0 for w in x), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in x)) for i, held, x in docs]
