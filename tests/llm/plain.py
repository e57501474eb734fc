"""Plain Python versions of the operators, for small inputs."""

import hashlib
import math
import re
from collections import Counter, defaultdict

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall(text or "")


def measures(text):
    t, w = text or "", words(text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count = Counter(windows)
    covered = {i + k for i, g in enumerate(windows) if count[g] > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if words(x)]
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(t.count(c) for c in "#*$%&|<>"),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines), "n_exclaims": t.count("!"),
    }


def failed(m, later=False):
    """Failure bits of the rules; ``later``: with the rule that production@2 adds."""
    rules = (
        m["n_words"] < 10, 100 * m["n_repeat_words"] > 20 * m["n_words"], m["n_symbols"] > m["n_words"], 100 * m["n_dup_lines"] > 30 * m["n_lines"],
        m["word_chars"] < 2 * m["n_words"], m["word_chars"] > 30 * m["n_words"], m["n_exclaims"] > m["n_words"], later and 10 * m["n_symbols"] > m["n_words"],
    )
    return sum(1 << i for i, r in enumerate(rules) if r)


def shingles(text):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_components(rows, percent=85):
    """doc_id -> (n_shingles, component) for unique ids."""
    sets = {d: shingles(t) for d, t in rows}
    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    common = Counter((a, b) for own in holders.values() for i, a in enumerate(own) for b in own[i + 1 :])
    links = [(a, b) for (a, b), c in common.items() if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c)]
    found = components(sets, links)
    return {d: (len(sets[d]), found[d]) for d in sets}


def mix_targets(sizes, budget=1.5, ceiling=2):
    """source -> target from source -> size, by sharing again until none is above its cap."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    cap = {s: ceiling * sizes[s] for s in order}
    full = set()
    while True:
        rest = sum(weight[s] for s in order if s not in full)
        level = (budget * sum(sizes.values()) - sum(cap[s] for s in full)) / rest if rest else math.inf
        over = {s for s in order if s not in full and level * weight[s] > cap[s]}
        if not over:
            return {s: float(cap[s]) if s in full else min(float(cap[s]), level * weight[s]) for s in order}
        full |= over


def mix_copies(rows):
    """(doc_id, copies) for rows (doc_id, text, source)."""
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    target = mix_targets(sizes)
    out = []
    for d, _, s in rows:
        rate = target[s] / sizes[s] if sizes[s] else 0.0
        u = int(hashlib.md5(f"mix-1:{'' if d is None else d}".encode()).hexdigest()[:13], 16) / 2**52
        out.append((d, math.floor(rate) + (u < rate - math.floor(rate))))
    return out
