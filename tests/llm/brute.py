"""Brute-force versions for small inputs."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def words_removed(docs, window=50):
    """{row: (doc_id, n_words, n_removed, kept_sha256)} of op8."""
    seen, out = {}, []
    split = [(k, WORD.findall(t or "")) for k, t in docs]
    for k, w in split:
        for i in range(len(w) - window + 1):
            x = tuple(w[i : i + window])
            seen[x] = min(seen.get(x, k), k)
    for k, w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] < k:
                gone.update(range(i, i + window))
        out.append((k, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone).encode())))
    return sorted(out)


def bytes_removed(docs, window=100):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of op5."""
    seen, out = {}, []
    raw = sorted((k, (t or "").encode()) for k, t in docs)
    for k, b in raw:
        for i in range(len(b) - window + 1):
            seen.setdefault(b[i : i + window], (k, i))
    for k, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if seen[b[i : i + window]] < (k, i):
                gone[i : i + window] = b"\1" * window
        n_spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((k, len(b), sum(gone), n_spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return sorted(out)


def jaccard_components(docs, k=5):
    """(doc_id, n_shingles, component_id) of op6."""
    sets = []
    for d, t in docs:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append((d, {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())))
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    index = {}
    for i, (_, s) in enumerate(sets):
        for x in s:
            index.setdefault(x, []).append(i)
    for i, (d, s) in enumerate(sets):
        count = {}
        for x in s:
            for j in index[x]:
                if j < i:
                    count[j] = count.get(j, 0) + 1
        for j, n in count.items():
            if 100 * n >= 75 * (len(s) + len(sets[j][1]) - n):
                a, b = find(d), find(sets[j][0])
                root[max(a, b)] = min(a, b)
    return sorted((d, len(s), find(d)) for d, s in sets)
