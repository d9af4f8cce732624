"""Plain Python versions of the operators' contracts, for comparison."""

from __future__ import annotations

import hashlib
import html
import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def shingles(text):
    w = WORD.findall((text or "").translate(FOLD))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def near_groups(docs):
    """{doc_id: (n_shingles, component_id)} of [(doc_id, text)], by all pairs that share a shingle."""
    sets = [(d, shingles(t)) for d, t in docs]
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    by = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for x in s:
            by[x].append(i)
    tried = set()
    for rows in by.values():
        for a in range(len(rows)):
            for b in range(a):
                p = (rows[b], rows[a])
                if p not in tried:
                    tried.add(p)
                    x, y = sets[p[0]][1], sets[p[1]][1]
                    if 100 * len(x & y) >= 80 * len(x | y):
                        up[root(p[0])] = root(p[1])
    least = {}
    for i, (d, _) in enumerate(sets):
        least[root(i)] = min(d, least.get(root(i), d))
    return sorted((d, len(s), least[root(i)]) for i, (d, s) in enumerate(sets))


def dedup(docs, size=13):
    first = {}
    cut = [(d, WORD.findall(t or "")) for d, t in docs]
    for d, w in cut:
        for i in range(len(w) - size + 1):
            k = tuple(w[i : i + size])
            first[k] = min(d, first.get(k, d))
    out = []
    for d, w in cut:
        gone = set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < d:
                gone.update(range(i, i + size))
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return sorted(out)


BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile("[0-9a-f]+"), 0, 32),
)


def secrets(text):
    """(n_assign, n_access, n_hex, base_sha256)"""
    spans, n = [], []
    for rank, (kind, pattern, group, least) in enumerate(BASE):
        own = [(m.start(), rank, kind, m.end()) for m in pattern.finditer(text or "") if len(m[group]) >= least]
        n.append(len(own))
        spans += own
    return (*n, sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans))))


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)"""
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = Counter(windows)
    again = {i + j for i, x in enumerate(windows) if seen[x] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again), len(w) < 50 or 100 * len(again) > 50 * len(w)


def js(p, q):
    tp, tq = sum(p), sum(q)
    if not tp or not tq:
        return None
    a, b = [x / tp for x in p], [x / tq for x in q]
    m = [(x + y) / 2 for x, y in zip(a, b)]
    kl = lambda x: sum(u * math.log2(u / v) for u, v in zip(x, m) if u > 0)
    return math.sqrt(max(0.0, (kl(a) + kl(b)) / 2))


def chat(rows):
    """{conv_id: (n_turns, turns_sha256, loss_chars, loss_sha256)} of [(conv_id, turn, role, text)]"""
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t, r or "", x or ""))
    out = {}
    for c, turns in by.items():
        turns.sort(key=lambda x: (x[0], x[1] or 0, x[2].encode(), x[3].encode()))
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for _, _, r, x in turns)), len(loss), sha(loss))
    return out


RULES = (("com", "/en/", "com/en/", "block"), ("example.com", "/en/7", "example.com/en/7", "allow"), ("net", "/de/", "net/de/", "allow"), ("example.net", "/de/8", "example.net/de/8", "block"), ("org", "/es/", "org/es/", "block"))


def url(u):
    """(host, path, rule, verdict of the rule)"""
    if u is None or "://" not in u:
        return "", "", None, None
    rest = u.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate(FOLD)
    best = max(((len(s), s, v) for h, p, s, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)), default=(0, None, None))
    return host, path, best[1], best[2]


def mix(docs, weights=(5, 2, 1), share=1.5, cap=2.0):
    """{source: (size, target)} of [(doc_id, text, source)] by clamping again and again."""
    sizes = defaultdict(int)
    for _, t, s in docs:
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, target = share * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > cap * sizes[s]}
        for s in over or open_:
            target[s] = cap * sizes[s] if over else level * weight[s]
        if not over:
            break
        left -= sum(target[s] for s in over)
        open_ -= over
    return {s: (sizes[s], target[s]) for s in order}


def tree_match(a, b):
    """(score, pairs) of two trees (label, label without id, number, children) by trying every pair of children."""
    if a[1] != b[1]:
        return 0, []
    x, y = a[3], b[3]
    best = [[(0, [])] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x)):
        for j in range(len(y)):
            n, pairs = tree_match(x[i], y[j])
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], (best[i][j][0] + n, best[i][j][1] + pairs), key=lambda z: z[0])
    n, pairs = best[-1][-1]
    return n + 1 + (a[0] == b[0]), [(a[2], b[2]), *pairs]


def wrapper_text(pages, least=3, same=0.8, still=0.1):
    """Main texts of [(host, Page)], whose nodes, names and texts are given: template by counting a host's contents."""
    def tree(page, n=0):
        label = page.labels[n]
        return label, label.split("\t#")[0], n, [tree(page, m) for m in range(n + 1, len(page.labels)) if page.parents[m] == n]

    def own(page):
        texts = defaultdict(list)
        for n, _, t in page.segments:
            if t is not None and t.strip() and not page.off[n]:
                texts[n] += t.split()
        return {n: " ".join(x) for n, x in texts.items()}

    out = []
    hosts = defaultdict(list)
    for h, p in pages:
        hosts[h].append(p)
    plans = {}
    for h, ps in hosts.items():
        count = Counter(p.skeleton() for p in ps)
        first = next(p for p in ps if p.skeleton() == min(count, key=lambda s: (-count[s], s.encode())))
        rows = set()
        for p in ps:
            to = dict(tree_match(tree(p), tree(first))[1])
            rows.add(tuple((to.get(n, -1), t) for n, t in own(p).items()))
        texts = defaultdict(set)
        for r in rows:
            for n, t in r:
                if n >= 0:
                    texts[n].add(t)
        size = {n: sum(map(len, x)) / len(x) * (1 if len(x) >= least else still) for n, x in texts.items()}
        body = max(size, key=lambda n: (size[n], -n), default=None)
        contents = defaultdict(set)
        for r in rows:
            content = dict(reversed(r)).get(body, r)
            for n, t in r:
                if n >= 0:
                    contents[n].add((content, t))
        template = {}
        for n, x in contents.items():
            times = Counter(t for _, t in x)
            t, k = times.most_common(1)[0]
            every = len({c for c, _ in x})
            if every >= least and k >= same * every:
                template[n] = t
        plans[h] = first, template
    for h, p in pages:
        first, template = plans[h]
        to, texts = dict(tree_match(tree(p), tree(first))[1]), own(p)
        fixed = {n for n in texts if template.get(to.get(n)) == texts[n]}
        length, linked = Counter(), Counter()
        for n, link, t in p.segments:
            if t is not None:
                length[n] += len(t.strip())
                linked[n] += link * len(t.strip())
        nodes = range(len(p.labels))
        keep = {n for n in nodes if p.main[n] and not p.off[n]}
        keep = keep - fixed if any(length[n] for n in keep) else {n for n in nodes if not p.off[n] and n not in fixed and linked[n] <= 0.6 * length[n]}
        out.append(" ".join(html.unescape("".join(" " if t is None else t for n, _, t in p.segments if t is None or n in keep)).split()))
    return out
