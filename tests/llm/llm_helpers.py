"""Plain versions of what the operators do, for small inputs."""

import re
from collections import Counter, defaultdict


def multiset(text):
    words = "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()
    if len(words) >= 5:
        return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    return Counter([tuple(words)] if words else [])


def similarity(a, b):
    a, b = multiset(a), multiset(b)
    union = sum((a | b).values())
    return sum((a & b).values()) / union if union else 0.0


def brute_classes(rows):
    """doc_id -> least doc_id of its class, by all pairs that share a shingle."""
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    by_text, by_shingle = defaultdict(list), defaultdict(set)
    for i, (_, text) in enumerate(rows):
        by_text[text or ""].append(i)
    for same in by_text.values():
        for i in same[1:]:
            parent[find(i)] = find(same[0])
        for s in multiset(rows[same[0]][1]):
            by_shingle[s].add(same[0])
    pairs = {(i, j) for found in by_shingle.values() for i in found for j in found if i < j}
    for i, j in pairs:
        if similarity(rows[i][1], rows[j][1]) >= 0.8:
            parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    return {rows[i][0]: min(groups[find(i)]) for i in range(len(rows))}


def contained(item, text):
    """Share of an item's distinct five-word shingles (of all its words, if fewer) that the text has."""
    own, other = ([w for w in re.split(r"[\W_]+", (t or "").lower()) if w] for t in (item, text))
    n = min(5, len(own))
    runs = lambda w: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    return len(runs(own) & runs(other)) / len(runs(own)) if own else 0.0
