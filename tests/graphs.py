"""Small graphs with worked answers, and brute force to compare with."""

import itertools

EDGES = "src long, dst long, w double, q int, start_date date, end_date date"


def edges(spark, pairs):
    """pairs: (src, dst), (src, dst, w), (src, dst, w, q) or all six."""
    rows = []
    for p in pairs:
        p = tuple(p)
        p += (1.0, 1, None, None)[len(p) - 2 :]
        rows.append(tuple(p))
    return spark.createDataFrame(rows, EDGES)


def nodes(spark, ids, kind=lambda i: "n", deleted=()):
    rows = [(i, kind(i), "2024-01-01 00:00:00" if i in deleted else None) for i in ids]
    return spark.createDataFrame(rows, "id long, kind string, deleted_at string").selectExpr("id", "kind", "cast(deleted_at as timestamp) as deleted_at")


def simple_paths(pairs, start, depth):
    """All simple paths from start over rows (src, dst, *rest), each as a list of rows."""
    out, todo = [], [(start, (start,), ())]
    while todo:
        v, seen, path = todo.pop()
        for e in pairs:
            if e[0] == v and e[1] not in seen and len(path) < depth:
                out.append(path + (e,))
                todo.append((e[1], seen + (e[1],), path + (e,)))
    return out


def reach(pairs, start, depth=99):
    seen, front = {start: 0}, [start]
    for k in range(1, depth + 1):
        front = sorted({b for a, b, *_ in pairs if a in front and b not in seen})
        seen.update({v: k for v in front})
    return seen


def groups(pairs):
    """Nodes that reach each other, as sorted tuples; a self loop makes a group."""
    nodes_ = {x for a, b, *_ in pairs for x in (a, b)}
    below = {v: {u for u in reach([e for e in pairs if e[0] != e[1]], v) if u != v} for v in nodes_}
    out = set()
    for v in nodes_:
        g = {u for u in below[v] if v in below[u]} | {v}
        if len(g) > 1 or any(a == b == v for a, b, *_ in pairs):
            out.add(tuple(sorted(g)))
    return out


def components(pairs):
    label = {x: x for a, b, *_ in pairs for x in (a, b)}
    for _ in range(len(label) + 1):
        for a, b, *_ in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return label


def betweenness(pairs, n):
    nodes_ = sorted({x for a, b, *_ in pairs for x in (a, b)})
    score = dict.fromkeys(nodes_, 0.0)
    for s, t in itertools.permutations(nodes_, 2):
        found = [p for p in simple_paths(pairs, s, n) if p[-1][1] == t]
        if not found:
            continue
        best = min(len(p) for p in found)
        found = [p for p in found if len(p) == best]
        for p in found:
            for e in p[:-1]:
                score[e[1]] += 1 / len(found)
    k = len(nodes_)
    return {v: x / ((k - 1) * (k - 2)) for v, x in score.items()}
