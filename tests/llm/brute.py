"""Plain versions of what the operators compute, for small tables."""

import re

import xxhash

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def shingle_set(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def dropped_lines(docs, near_chars=20):
    """docs: (doc_id, text); the (doc_id, line_no) that repeat an earlier line."""
    norm = lambda x: re.sub("[ \t\r\f\x0b\xa0]+", " ", x).strip(" ").lower()
    lines = sorted({(d, i, norm(x)) for d, t in docs if t is not None for i, x in enumerate(t.split("\n")) if norm(x)})
    out = set()
    for k, (d, i, x) in enumerate(lines):
        if any(x == y or (min(len(x), len(y)) >= near_chars and abs(len(x) - len(y)) < 2 and edit_distance(x, y) <= 1) for _, _, y in lines[:k]):
            out.add((d, i))
    return out


def contamination(text, items, n=10):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UPPER))
    words, hit, found = find(text), set(), set()
    for item, item_text in items:
        w = find(item_text)
        for i in range(max(1, len(w) - n + 1) if w else 0):
            window = w[i : i + n]
            for j in range(len(words) - len(window) + 1):
                if words[j : j + len(window)] == window:
                    hit.update(range(j, j + len(window)))
                    found.add(str(item))
    return len(words), hit, sorted(found)


def repetition(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    repeated = {k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(i, i + 5)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated), n < 10 or 100 * len(repeated) > 20 * n
