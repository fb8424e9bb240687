"""The conversation trie by plain Python, on lists of ``(conv_id, turn, role, text)``."""

import hashlib
import zlib
from collections import defaultdict


def rebuilt(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn, role or "", text or ""))
    ordered = {
        c: [(r, t) for _, r, t in sorted(ts, key=lambda x: (x[0] is not None, x[0] if x[0] is not None else 0, x[1], x[2]))]
        for c, ts in turns.items()
    }
    out = {}
    for c, own in ordered.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = ordered.get(c - int(abs(c) % 5) * (1 if c >= 0 else -1), [])
        out[c] = base[:h] + own[h:]
    return out


def trie(rows):
    convs = rebuilt(rows)
    members = defaultdict(list)
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    nodes = {}
    for prefix, ms in members.items():
        nodes[prefix] = {"conv_id": min(ms), "depth": len(prefix), "n_convs": len(ms)}
    children = defaultdict(list)
    for prefix in nodes:
        if prefix:
            children[prefix[:-1]].append(prefix)

    def subtree(prefix):
        leaves = 0 if children[prefix] else 1
        saved = (nodes[prefix]["n_convs"] - 1) * len(prefix[-1][1].encode()) if prefix else 0
        for child in children[prefix]:
            a, b = subtree(child)
            leaves, saved = leaves + a, saved + b
        return leaves, saved

    out = []
    for prefix, node in nodes.items():
        leaves, saved = subtree(prefix)
        ends = sorted(c for c in members[prefix] if len(convs[c]) == len(prefix))
        out.append(
            (
                node["conv_id"],
                node["depth"],
                nodes[prefix[:-1]]["conv_id"] if prefix else None,
                node["n_convs"],
                len(children[prefix]),
                leaves,
                saved,
                hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
            )
        )
    return sorted(out, key=lambda r: (r[1], r[0]))
