"""Plain versions that several tests hold operators against."""

import re


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def low_words(text):
    return plain_words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def components(n, edges):
    parent = list(range(n))

    def top(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        x, y = top(a), top(b)
        parent[max(x, y)] = min(x, y)
    return [top(i) for i in range(n)]
