"""Definitions of near copies and of line dedup, written out for small inputs."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    w = WORD.findall(text or "")
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_classes(rows):
    """(doc_id, text) rows -> links of each row and class ids, by the definition."""
    sets = [shingle_set(t) for _, t in rows]
    at = {}
    for k, s in enumerate(sets):
        for x in s:
            at.setdefault(x, []).append(k)
    links = [set() for _ in rows]
    for k, s in enumerate(sets):
        common = {}
        for x in s:
            for other in at[x]:
                common[other] = common.get(other, 0) + 1
        links[k] = {o for o, c in common.items() if o != k and 5 * c >= 4 * (len(s) + len(sets[o]) - c)}
    label = list(range(len(rows)))

    def find(k):
        while label[k] != k:
            k = label[k]
        return k

    for k, ls in enumerate(links):
        for o in ls:
            a, b = sorted((find(k), find(o)))
            label[b] = a
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(find(k), []).append(k)
    least = {g: min((rows[k][0] for k in ks if rows[k][0] is not None), default=None) for g, ks in groups.items()}
    return [(rows[k][0], least[find(k)], len(links[k])) for k in range(len(rows))]


def brute_lines(rows):
    """Shortened texts by the definition: each line against all earlier ones."""
    lines = []
    for k, (doc, text, place) in enumerate(rows):
        for n, line in enumerate((text or "").split("\n")):
            s = frozenset(WORD.findall(line))
            if s:
                lines.append(((doc is None, doc or 0, place), n, k, s))
    lines.sort(key=lambda x: (x[0], x[1]))
    by_word, gone = {}, set()
    for i, (place, n, k, s) in enumerate(lines):
        common = {}
        for w in s:
            for j in by_word.get(w, ()):
                common[j] = common.get(j, 0) + 1
            by_word.setdefault(w, []).append(i)
        if any(9 * c >= 4 * (len(s) + len(lines[j][3])) and (lines[j][0], lines[j][1]) != (place, n) for j, c in common.items()):
            gone.add((k, n))
    return [None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (k, n) not in gone) for k, (_, t, _) in enumerate(rows)]
