"""Plain Python versions of what the operators promise."""

import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACES = " \t\n\x0b\x0c\r"


def base(text):
    text = text or ""
    words, places = WORD.findall(text), defaultdict(list)
    for k in range(len(words) - 2):
        places[tuple(words[k : k + 3])].append(k)
    covered = {k + i for v in places.values() if len(v) > 1 for k in v for i in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def quality(rows, documents=20, share=0.05, depleted=0.5):
    """rows: (doc_id, text, host). Per row: (kept, removed words, text without frequent lines).

    Documents of a host with the same set of normalised lines are one."""
    norm = lambda x: " ".join(WORD.findall(x)).lower()
    different = {(h, frozenset(norm(x) for x in (t or "").split("\n") if WORD.search(x))) for _, t, h in rows}
    hosts, counts = Counter(h for h, _ in different), Counter((h, x) for h, lines in different for x in lines)
    out = []
    for _, t, h in rows:
        n, *_, rep = base(t)
        gone = {i for i, x in enumerate((t or "").split("\n")) if counts[h, norm(x)] > documents and counts[h, norm(x)] > share * hosts[h] and WORD.search(x)}
        lost = sum(len(WORD.findall(x)) for i, x in enumerate((t or "").split("\n")) if i in gone)
        failed = n < 50 or 100 * rep > 50 * n
        rest = t if not gone else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)
        out.append((not failed and lost <= depleted * n, lost, rest))
    return out


def dedup_lines(rows):
    """rows: (doc_id, text) in any order, ids unique. {doc_id: (text, lines removed)}."""
    first, windows = {}, {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        lines = [(k, x.strip(SPACES)) for k, x in enumerate((t or "").split("\n"))]
        lines = [x for x in lines if x[1]]
        windows[i] = [(tuple(x for _, x in lines[k : k + 3]), [p for p, _ in lines[k : k + 3]]) for k in range(len(lines) - 2)]
        for said, at in windows[i]:
            first.setdefault(said, (i, at[0]))
    out = {}
    for i, t in rows:
        gone = {p for said, at in windows[i] if first[said] != (i, at[0]) for p in at}
        out[i] = (t if not gone else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone), len(gone))
    return out


def fingerprint(text, shingle=3):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    said = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in said]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, linked):
    """{node: set of nodes it reaches} by union of all linked pairs."""
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    nodes = list(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if linked(a, b):
                root[find(a)] = find(b)
    groups = defaultdict(set)
    for x in nodes:
        groups[find(x)].add(x)
    return {x: groups[find(x)] for x in nodes}


def simhash_groups(rows, threshold=2):
    """rows: (doc_id, text). {doc_id: least id of its component}."""
    of = {i: fingerprint(t) for i, t in rows}
    reach = components(set(of.values()), lambda a, b: (a ^ b).bit_count() <= threshold)
    return {i: min(j for j, g in of.items() if g in reach[f]) for i, f in of.items()}


def targets(sizes, weights=(5, 2, 1), cap=3.0):
    """sizes: {source: size}. The fixed point by repeated sharing."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in full]
        rest, weight = total - sum(full.values()), sum(w[s] for s in free)
        over = {s: cap * sizes[s] for s in free if rest * w[s] / weight > cap * sizes[s] + 1e-9}
        if not over:
            return full | {s: rest * w[s] / weight for s in free}
        full |= over


def shingles(text, n=5):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1)))


def similar_groups(rows, least=0.8):
    """rows: (doc_id, text). {doc_id: least id of its group}, by all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    fps = {i: fingerprint(t) for i, t in rows}
    reach = components(list(sets), lambda a, b: fps[a] == fps[b] or len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]))
    return {i: min(v) for i, v in reach.items()}
