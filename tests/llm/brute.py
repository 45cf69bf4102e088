"""Plain Python versions of the operators' contracts, over rows of (doc_id, text)."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def base_spans(text):
    """Regular expressions over the whole text, one kind after another."""
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        doubled = [d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
        if 14 <= len(digits) <= 19 and sum(doubled) % 10 == 0:
            found.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append((m.start(), 3, "phone", m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(found)]


def repeat_words(w):
    places = defaultdict(list)
    for i in range(len(w) - 2):
        places[tuple(w[i : i + 3])].append(i)
    return len({i + k for at in places.values() if len(at) > 1 for i in at for k in range(3)})


def substrings(rows, size=13):
    """{(doc_id, text): (words, removed, digest)}"""
    first = {}
    for i, text in rows:
        w = words(text)
        for p in range(len(w) - size + 1):
            key = tuple(w[p : p + size])
            if i is not None:
                first[key] = min(i, first.get(key, i))
    out = {}
    for i, text in rows:
        w, gone = words(text), set()
        for p in range(len(w) - size + 1):
            if i is not None and first[tuple(w[p : p + size])] < i:
                gone.update(range(p, p + size))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out[i, text] = (len(w), len(gone), sha(" ".join(kept)))
    return out


def near(rows, threshold=0.8):
    """[(doc_id, class, links)] by comparing all rows."""
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in (words(t) for _, t in rows)]
    links, label = Counter(), {k: k for k in range(len(rows))}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if None in (rows[a][0], rows[b][0]) or not sets[a]:
                continue
            both = len(sets[a] & sets[b])
            if both >= threshold * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                label[top(a)] = top(b)
    classes = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        classes[top(k)].append(i)
    return sorted(((i, None if i is None else min(classes[top(k)]), links[k]) for k, (i, _) in enumerate(rows)), key=str)


def segments(scores):
    """All maximal scoring segments by their definition: the best one, then left and right of it."""

    def find(a, b):
        best = max(((sum(scores[i:j]), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
        if best[0] <= 0:
            return []
        i, j = best[3:]
        return find(a, i) + [(i, j)] + find(j, b)

    return find(0, len(scores))
