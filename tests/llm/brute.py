"""Plain Python versions of the contracts, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = {code: code + 32 for code in range(65, 91)}


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def repeats(texts: list[str | None], span: int) -> list[tuple]:
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + span] for t in raw for i in range(len(t) - span + 1))
    out = []
    for t in raw:
        gone = bytearray(len(t))
        for i in range(len(t) - span + 1):
            if seen[t[i : i + span]] > 1:
                gone[i : i + span] = b"\1" * span
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((len(t), sum(gone), spans, sha(bytes(b for b, g in zip(t, gone) if not g))))
    return out


def tokens(rows: list[tuple[int, str | None]], path: str, end: int) -> list[tuple]:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    out, start = [], 0
    for key, text in sorted(rows):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]
        crc = zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
        out.append((key, start, len(ids), crc))
        start += len(ids)
    return out


def terms(text: str | None) -> list[str]:
    return TERM.findall((text or "").translate(FOLD))


def contamination(rows, items, size: int) -> list[tuple]:
    windows = defaultdict(set)
    for item, text in items:
        words = terms(text)
        for i in range(max(1, len(words) - size + 1) if words else 0):
            windows[tuple(words[i : i + size])].add(str(item))
    lengths = {len(w) for w in windows}
    out = []
    for key, text in rows:
        words, hit, found = terms(text), set(), set()
        for n in lengths:
            for i in range(len(words) - n + 1):
                names = windows.get(tuple(words[i : i + n]))
                if names:
                    found |= names
                    hit.update(range(i, i + n))
        out.append(
            (key, len(words), len(hit), len(found), sha(",".join(sorted(found)).encode()), bool(hit))
        )
    return out


def fingerprint(text: str | None, size: int) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    if not words:
        return 0
    shingles = [words[i : i + size] for i in range(len(words) - size + 1)] or [words]
    h = [xxhash.xxh64_intdigest(" ".join(s), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_duplicates(rows, size: int, bits: int) -> list[tuple]:
    marks = [fingerprint(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (marks[i] ^ marks[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                if rows[a][0] > rows[b][0]:
                    a, b = b, a
                root[b] = a
    return [(rows[i][0], f"{marks[i]:016x}", rows[find(i)][0]) for i in range(len(rows))]


def licenses(rows, phrases) -> list[tuple]:
    out = []
    for key, text in rows:
        words, places, labels = terms(text), [], set()
        for label, phrase in phrases:
            own = phrase.split(" ")
            for i in range(len(words) - len(own) + 1):
                if words[i : i + len(own)] == own:
                    places.append(i)
                    labels.add(label)
        out.append(
            (
                key,
                len(words),
                len(places),
                min(places, default=None),
                max(places, default=None),
                ",".join(sorted(labels)),
            )
        )
    return out


def edits(rows) -> list[tuple]:
    rows = sorted(rows)
    out = []
    for i, (key, text) in enumerate(rows):
        text, following = text or "", rows[(i + 1) % len(rows)][1] or ""
        n = len(text) // 2
        out.append((key, len(text), sha((text[: len(text) - n] + following[:n]).encode())))
    return out


def phrases(rows, limit=2000, support=30, longest=4, absorbed=80) -> list[tuple]:
    """Rows are (lang, text)."""
    counts, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(FOLD)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    counts[lang][tuple(words[i : i + size])] += 1
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= support}
        cover = Counter()
        for longer, a in candidates.items():
            for size in range(2, len(longer)):
                for i in range(len(longer) - size + 1):
                    part = longer[i : i + size]
                    cover[part] = max(cover[part], a)
        found = []
        for p, a in candidates.items():
            if p in cover and 100 * cover[p] >= absorbed * a:
                continue
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:limit], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def negatives(rows, positives=5, limit=10) -> list[tuple]:
    """Rows are (id, vector, label) as the query takes them."""
    used = []
    for key, vector, label in rows:
        if key is None or label is None or vector is None or not all(x is not None and math.isfinite(x) for x in vector):
            continue
        label = (label + 1) % 10 if key % 7 == 0 else label
        used.append((key, [math.floor(256 * x) for x in vector], label))
    out = []
    for i, (anchor, a, label) in enumerate(used):
        if anchor % 100:
            continue
        scores = [
            (-sum(x * y for x, y in zip(a, b)), key, own)
            for j, (key, b, own) in enumerate(used)
            if j != i and len(b) == len(a)
        ]
        scores.sort()
        for p, positive, _ in [x for x in scores if x[2] == label][:positives]:
            near = [x for x in scores if x[2] != label and 30 * -p <= 100 * -x[0] <= 90 * -p]
            for rank, (s, key, _) in enumerate(near[:limit], 1):
                out.append((anchor, positive, rank, key, -p, -s))
    return sorted(out)


def kd_shards(rows, shards: int, whole: float) -> list[int]:
    """The shard of each (key, text)."""
    points = []
    for key, text in rows:
        t = text or ""
        raw = t.encode()
        hashed = 42 if key is None else xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), 42)
        dims = len(raw), len(t), t.count(" "), t.count("\n")
        points.append((len(raw) + 1, dims, xxhash.xxh64_intdigest(raw, 42) >> 2, hashed >> 2))
    total = sum(p[0] for p in points)
    extent = lambda own, d: max(points[i][1][d] for i in own) - min(points[i][1][d] for i in own)
    spread = [max(1, extent(range(len(points)), d)) for d in range(4)] if points else []
    out = [0] * len(points)

    def side(own, keys, target):
        """The rows of ``own`` that go left, by the first of ``keys``."""
        before, left = 0, []
        for value in sorted({keys[0](i) for i in own}):
            here = [i for i in own if keys[0](i) == value]
            weight = sum(points[i][0] for i in here)
            if before + weight >= target:
                if weight > whole * total / shards and len(keys) > 1:
                    return left + side(here, keys[1:], target - before)
                return left + here if before + weight - target < target - before else left
            before += weight
            left += here
        raise AssertionError

    def part(own, first, n):
        if n == 1 or not own:
            for i in own:
                out[i] = first
            return
        d = max(range(4), key=lambda d: extent(own, d) / spread[d])
        target = sum(points[i][0] for i in own) * (n // 2) / n
        left = side(own, [lambda i: points[i][1][d], lambda i: points[i][2], lambda i: points[i][3]], target)
        part(left, first, n // 2)
        part([i for i in own if i not in set(left)], first + n // 2, n - n // 2)

    part(list(range(len(points))), 0, shards)
    return out


def notice_labels(text: str | None, templates, gram: int, near: int, covered: float) -> tuple[set[str], float]:
    """Labels and the best coverage, by diagonals of word k-grams."""
    words, labels, best = terms(text), set(), 0.0
    places = defaultdict(list)
    for i in range(len(words) - gram + 1):
        places[tuple(words[i : i + gram])].append(i)
    for exact, label, own in templates:
        diagonals = defaultdict(set)
        for t in range(len(own) - gram + 1):
            for pos in places.get(tuple(own[t : t + gram]), ()):
                diagonals[pos - t].add(t)
        reach = 0 if exact else min(near, len(own) - 1)
        spans, last = [], None
        for diagonal in sorted(diagonals):
            if last is None or diagonal - last > reach:
                spans.append(set())
            spans[-1] |= diagonals[diagonal]
            last = diagonal
        for span in spans:
            share = len({t + j for t in span for j in range(gram)}) / len(own)
            if share >= (1.0 if exact else covered):
                labels.add(label)
                best = max(best, share)
    return labels, best


def near_items(rows, items, size: int, slop: int) -> list[tuple]:
    """Items with a tile whose words all stand within ``slop`` extra words, for each (key, text)."""
    tiles = defaultdict(set)
    for item, text in items:
        words = terms(text)
        last = max(0, len(words) - size)
        for start in {*range(0, last + 1, size), last} if words else ():
            tiles[tuple(words[start : start + size])].add(str(item))
    out = []
    for key, text in rows:
        words, found = terms(text), set()
        have = Counter(words)
        for tile, names in tiles.items():
            need = Counter(tile)
            if any(have[w] < n for w, n in need.items()):
                continue
            length = len(tile) + slop
            for start in range(max(1, len(words) - length + 1)):
                inside = Counter(words[start : start + length])
                if all(inside[w] >= n for w, n in need.items()):
                    found |= names
                    break
        out.append((key, len(found)))
    return out
