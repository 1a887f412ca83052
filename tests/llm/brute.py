"""Plain answers to compare the operators with: small inputs only."""

from __future__ import annotations

import hashlib
import re
import zlib

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LICENSE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def components(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in links:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def fingerprint(text, width=3):
    words = WORD.findall(lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i: i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash(docs, width=3):
    """[(doc_id, text)] to sorted [(doc_id, fingerprint, component_id)]."""
    fps = [fingerprint(t, width) for _, t in docs]
    links = [(i, j) for i in range(len(docs)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    part = components(len(docs), links)
    names = {}
    for (d, _), p in zip(docs, part):
        if d is not None:
            names[p] = min(d, names.get(p, d))
    return sorted(((d, f"{f:016x}", names.get(p)) for (d, _), f, p in zip(docs, fps, part)), key=str)


def substring(docs, window=13):
    """[(doc_id, text)] to sorted [(doc_id, n_words, n_removed, sha256 of the kept words)]."""
    first = {}
    split = [(d, WORD.findall(t or "")) for d, t in docs]
    for d, w in split:
        for i in range(len(w) - window + 1):
            if d is not None:
                key = tuple(w[i: i + window])
                first[key] = min(d, first.get(key, d))
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i: i + window])] < d:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def licenses(docs, table, phrases, confidence):
    """[(doc_id, text)] to sorted op6 rows without the score's rounding."""
    compiled = [(label, priority, re.compile(f"(?<= )(?:{pattern})(?= )", re.ASCII)) for label, priority, _, pattern in table]
    out = []
    for d, t in docs:
        low = lower(t)
        words = LICENSE_WORD.findall(low)
        norm = " " + " ".join(words) + " "
        places = []
        labels = set()
        for phrase, label in phrases.items():
            p = phrase.split()
            at = [i for i in range(len(words) - len(p) + 1) if words[i: i + len(p)] == p]
            places += at
            if at:
                labels.add(label)
        found = [(m.start(), m.end(), priority, i, label) for i, (label, priority, pattern) in enumerate(compiled) for m in pattern.finditer(norm)]
        kept = set()
        for s, e, p, i, label in found:
            worse = False
            for s2, e2, p2, i2, _ in found:
                if (s, e, p, i) == (s2, e2, p2, i2):
                    continue
                within = s2 <= s and e <= e2
                if within and p2 >= p and ((s, e) != (s2, e2) or (p2, -i2) > (p, -i)):
                    worse = True
                if s <= s2 and e2 <= e and p2 > p:
                    worse = True
            if not worse:
                kept.add((label, p))
        doubt = 1.0
        for _, p in kept:
            doubt *= 1 - confidence[p]
        if places:
            doubt *= 1 - confidence[3]
        out.append((d, len(words), len(places), min(places, default=None), max(places, default=None),
                    ",".join(sorted(labels)), ",".join(sorted(labels | {k for k, _ in kept})), round(1 - doubt, 5)))
    return sorted(out, key=str)


def fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4
