"""Plain one-machine versions of the operators, for small tables."""
import hashlib


def repeats(rows, width=20):
    """op5: {doc_id: (n_words, n_removed, sha256)}"""
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        words = text.encode().split() if text else []
        gone = [False] * len(words)
        for p in range(len(words) - width + 1):
            key = tuple(words[p:p + width])
            if key in seen:
                gone[p:p + width] = [True] * width
            seen.add(key)
        kept = [w for w, g in zip(words, gone) if not g]
        out[doc_id] = (len(words), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def shingles(text, size):
    words = text.encode().lower().split() if text else []
    if not words:
        return frozenset()
    size = min(size, len(words))
    return frozenset(tuple(words[i:i + size]) for i in range(len(words) - size + 1))


def near(rows, size=2, percent=80):
    """op3: {doc_id: (n_shingles, component_id, kept)}. Compares all pairs that share a rare enough shingle."""
    sets = {d: shingles(t, size) for d, t in rows}
    by, parent = {}, {d: d for d in sets}
    freq = {}
    for s in sets.values():
        for x in s:
            freq[x] = freq.get(x, 0) + 1

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    # any set this similar shares one of the rarest (1 - percent) + 1 shingles
    for d in sorted(sets):
        ranked = sorted(sets[d], key=lambda x: (freq[x], x))
        prefix = ranked[: len(ranked) - -(-len(ranked) * percent // 100) + 1]
        for o in sorted({o for x in prefix for o in by.get(x, ())}):
            common = len(sets[d] & sets[o])
            if 100 * common >= percent * (len(sets[d]) + len(sets[o]) - common):
                a, b = find(d), find(o)
                parent[max(a, b)] = min(a, b)
        for x in prefix:
            by.setdefault(x, []).append(d)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in sets}
