"""Plain versions of distributed algorithms, for tests."""

import numpy as np


def mst_by_hand(rows, min_samples):
    """(weight, lo, hi) of the least spanning tree of mutual reachability, by Prim over the whole matrix."""
    ids = [i for i, _ in rows]
    x = np.array([v for _, v in rows], dtype=np.float64)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = np.sqrt(np.maximum(0, 2 - 2 * np.round(x @ x.T, 12)))
    np.fill_diagonal(d, np.inf)
    core = np.sort(d, axis=1)[:, min(min_samples, len(rows) - 1) - 1]
    w = np.round(np.maximum(np.maximum(core[:, None], core[None, :]), d), 9)
    seen, out = {0}, []
    key = lambda a, b: (float(w[a, b]), min(ids[a], ids[b]), max(ids[a], ids[b]))
    best = {j: (key(0, j), 0) for j in range(1, len(rows))}
    while len(seen) < len(rows):
        j = min(best, key=lambda i: best[i][0])
        out.append(best.pop(j)[0])
        seen.add(j)
        for i in best:
            best[i] = min(best[i], (key(j, i), j))
    return out


def condensed_by_hand(ids, edges, min_size, method, nearest=1e-9):
    """{id: label} from a spanning tree: the whole dendrogram, walked from the top, then excess of mass or leaves."""
    node_of, kids, weight, count = {i: i for i in ids}, {}, {}, {i: 1 for i in ids}
    find = {i: i for i in ids}

    def root(i):
        while find[i] != i:
            i = find[i]
        return i

    for k, (w, a, b) in enumerate(sorted(edges)):
        a, b = root(a), root(b)
        new = ("m", k)
        kids[new], weight[new], count[new] = (node_of[a], node_of[b]), w, count[node_of[a]] + count[node_of[b]]
        find[b] = a
        node_of[a] = new
    top = node_of[root(ids[0])]
    if count[top] < min_size:
        return dict.fromkeys(ids, -1)
    lam = lambda w: 1 / max(w, nearest)
    clusters, falls = [{"birth": 0.0, "kids": [], "mass": 0.0}], {}

    def points(n):
        todo, out = [n], []
        while todo:
            n = todo.pop()
            if n in kids:
                todo += kids[n]
            else:
                out.append(n)
        return out

    todo = [(top, 0)]
    while todo:
        n, c = todo.pop()
        while True:
            here, (a, b) = lam(weight[n]), kids[n]
            big = [x for x in (a, b) if count[x] >= min_size]
            for x in (a, b):
                if x not in big:
                    for p in points(x):
                        falls[p] = c
                        clusters[c]["mass"] += here - clusters[c]["birth"]
            if len(big) == 2:
                clusters[c]["mass"] += sum(count[x] for x in big) * (here - clusters[c]["birth"])
                for x in big:
                    clusters.append({"birth": here, "kids": [], "mass": 0.0})
                    clusters[c]["kids"].append(len(clusters) - 1)
                    todo.append((x, len(clusters) - 1))
                break
            if not big:
                break
            n = big[0]
    order = []
    walk = [0]
    while walk:
        c = walk.pop()
        order.append(c)
        walk += clusters[c]["kids"]
    best, chosen = {}, set()
    for c in reversed(order):
        inside = sum(best[k] for k in clusters[c]["kids"])
        if method == "leaf":
            if not clusters[c]["kids"] and c:
                chosen.add(c)
        elif c and clusters[c]["mass"] >= inside:
            chosen.add(c)
        best[c] = max(clusters[c]["mass"], inside)
    holder = {}
    for c in order:
        holder.setdefault(c, -1)
        for k in clusters[c]["kids"]:
            holder[k] = holder[c] if holder[c] >= 0 else k if k in chosen else -1
    got = {p: holder[c] for p, c in falls.items()}
    first = {}
    for p in sorted(got):
        if got[p] >= 0:
            first.setdefault(got[p], len(first))
    return {i: first.get(got[i], -1) for i in ids}
