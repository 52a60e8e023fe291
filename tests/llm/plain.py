"""The operators over again in plain Python, for small inputs."""

import re
from collections import Counter, defaultdict
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall(text or "")


def shingle_set(text, n):
    w = words((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def component_ids(docs, n, percent):
    """{row number: smallest id} by testing all pairs that share a shingle."""
    sets = [shingle_set(t, n) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for z in s:
            holders[z].append(i)
    for a, b in {p for h in holders.values() for p in combinations(h, 2)}:
        common = len(sets[a] & sets[b])
        if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            root[find(a)] = find(b)
    groups = defaultdict(list)
    for i in range(len(docs)):
        groups[find(i)].append(docs[i][0])
    return [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(docs))], sets


def rule_counts(text):
    w = words(text)
    places = defaultdict(list)
    for i in range(len(w) - 4):
        places[tuple(w[i : i + 5])].append(i)
    covered = {i + k for v in places.values() if len(v) > 1 for i in v for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def base_failed(text):
    n, *_, repeated = rule_counts(text)
    return n < 10 or 100 * repeated > 20 * n


def fresh_lines(docs, size=3):
    """[(lines kept as text, removed lines)] for rows (doc_id, text); equal rows are one document."""
    found = defaultdict(set)
    per_row = []
    for key in docs:
        lines = (key[1] or "").split("\n")
        at = [i for i, x in enumerate(lines) if WORD.search(x)]
        per_row.append((lines, at))
        for k in range(len(at) - size + 1):
            found[tuple(lines[i] for i in at[k : k + size])].add((key[0], key[1], k))
    # documents of one id are only told apart by a text hash, so ties of ids are left out here
    first = {w: min(v, key=lambda x: (x[0] is not None, x[0] or 0, x[2])) for w, v in found.items()}
    out = []
    for key, (lines, at) in zip(docs, per_row, strict=True):
        gone = set()
        for k in range(len(at) - size + 1):
            if first[tuple(lines[i] for i in at[k : k + size])] != (key[0], key[1], k):
                gone |= set(at[k : k + size])
        out.append((None if key[1] is None else "\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone)))
    return out


def best_fit_decreasing(lengths, capacity):
    """How many sequences one-by-one best fit opens."""
    gaps = Counter()
    opened = 0
    for length in sorted(lengths, reverse=True):
        fit = min((g for g in gaps if g >= length and gaps[g]), default=None)
        if fit is None:
            opened, fit = opened + 1, capacity
        else:
            gaps[fit] -= 1
        gaps[fit - length] += 1
    return opened


def url_verdicts(pages, labels, children=20, least=10, own=5, z=1.96, weight=4.0, purity=0.5):
    """(template, verdict) of each (host, path), from pages [(id, host, path)] and labels {id: [good]}."""
    seen = defaultdict(lambda: [0, 0, 0])
    for page_id, host, path in pages:
        marks = labels.get(page_id, [])
        seen[host, path] = [a + b for a, b in zip(seen[host, path], [1, sum(marks), len(marks)])]
    template = {key: () for key in seen}
    for level in range(max((len(path.split("/")) for _, path in seen), default=0)):
        nodes = defaultdict(lambda: defaultdict(list))
        for host, path in seen:
            segments = path.split("/")
            if len(segments) > level:
                nodes[host, template[host, path]][segments[level]].append((host, path))
        for below in nodes.values():
            total = sum(seen[key][0] for keys in below.values() for key in keys)
            varied = len(below) > children or (total >= least and 2 * len(below) > total)
            for segment, keys in below.items():
                named = not varied or sum(seen[key][2] for key in keys) >= own
                for key in keys:
                    template[key] += (segment if named else "*",)
    leaves = defaultdict(lambda: [0, 0])
    for key, (_, good, marks) in seen.items():
        leaves[key[0], template[key]] = [a + b for a, b in zip(leaves[key[0], template[key]], (good, marks))]
    into = {leaf: leaf[1] for leaf in leaves}
    for level in reversed(range(max((len(t) for _, t in leaves), default=0))):
        families = defaultdict(lambda: defaultdict(lambda: [0, 0]))
        for leaf, sums in leaves.items():
            now = into[leaf]
            if len(now) > level:
                family = families[leaf[0], now[:level], now[level + 1 :]]
                family[now[level]] = [a + b for a, b in zip(family[now[level]], sums)]
        names = {}
        for family, branches in families.items():
            order = sorted((g / n, segment, g, n) for segment, (g, n) in branches.items() if n)
            groups = []
            for at, (share, segment, g, n) in enumerate(order):
                if at:
                    before, _, g0, n0 = order[at - 1]
                    pool = (g + g0) / (n + n0)
                    if share - before > z * (pool * (1 - pool) * (1 / n + 1 / n0)) ** 0.5:
                        groups.append([])
                else:
                    groups.append([])
                groups[-1].append(segment)
            for group in map(sorted, groups):
                name = "|".join(group[:children]) + (f"|+{len(group) - children}" if len(group) > children else "")
                names.update({(family, segment): name for segment in group})
        for leaf in leaves:
            now = into[leaf]
            if len(now) > level:
                name = names.get(((leaf[0], now[:level], now[level + 1 :]), now[level]), now[level])
                into[leaf] = (*now[:level], name, *now[level + 1 :])
    sums = defaultdict(lambda: [0, 0])
    for leaf, own_sums in leaves.items():
        now = into[leaf]
        for place in ((), (leaf[0],), (leaf[0], now[:-1], "above"), (leaf[0], now)):
            sums[place] = [a + b for a, b in zip(sums[place], own_sums)]
    base = sums[()][0] / sums[()][1] if sums[()][1] else 1.0
    out = {}
    for key in seen:
        host, now = key[0], into[key[0], template[key]]
        share = base
        for place in ((host,), (host, now[:-1], "above"), (host, now)):
            share = (sums[place][0] + weight * share) / (sums[place][1] + weight)
        out[key] = ("/".join(now), "block" if share < purity else "allow")
    return out
