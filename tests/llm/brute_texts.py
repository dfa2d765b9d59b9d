"""Plain Python versions of the corpus operators, and small documents to try them on."""

from __future__ import annotations

import random
import re
import zlib

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def fold(doc_id, parts: int) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % parts


def shingles(text: str | None, width: int) -> set:
    w = words(text)
    return {tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def jaccard_components(rows: list[tuple], width: int = 3, num: int = 90, den: int = 100) -> list[tuple]:
    sets = [shingles(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least: dict[int, list] = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(find(i), []).append(d)
    return [(d, len(s), min((x for x in least[find(i)] if x is not None), default=None))
            for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def vocabulary(rng: random.Random, n: int = 400) -> list[str]:
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randint(2, 9))) for _ in range(n)]


def near_copies(seed: int, groups: int, copies: int, length: int, edits: int) -> list[tuple[int, str]]:
    """Groups of texts that differ from a base in up to ``edits`` words."""
    rng = random.Random(seed)
    vocab, rows = vocabulary(rng), []
    for _ in range(groups):
        base = [rng.choice(vocab) for _ in range(rng.randint(length // 2, length))]
        for _ in range(rng.randint(1, copies)):
            text = list(base)
            for _ in range(rng.randint(0, edits)):
                text[rng.randrange(len(text))] = rng.choice(vocab)
            rows.append((len(rows), " ".join(text)))
    return rows


ODD = [
    (None, "no id here"), (900001, None), (900002, ""), (900003, " \n\t "), (900004, "one"),
    (900004, "one"), (900005, "Two Words"), (900006, "two  words"), (900007, "x " * 30_000), (900008, "É é ß Ž"),
]


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def repeated_lines(rows: list[tuple], edits: int = 2, least: int = 32) -> list[tuple]:
    """(doc_id, n_lines, n_dropped, dropped_lines) with lines compared pair by pair."""
    lines = [(d, k, x.strip(" \t\n\x0b\f\r")) for d, t in rows for k, x in enumerate((t or "").split("\n"))]
    long = sorted({x for _, _, x in lines if len(x) >= least}, key=len)
    root = {x: x for x in long}

    def find(x: str) -> str:
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(long):
        for y in long[i + 1:]:
            if len(y) - len(x) > edits:
                break
            if edit_distance(x, y) <= edits:
                root[find(x)] = find(y)
    first: dict[str, tuple] = {}
    for d, k, x in lines:
        if x in root:
            r = find(x)
            first[r] = min(first.get(r, (True, 0, 0)), (d is None, d or 0, k)) if r in first else (d is None, d or 0, k)
    out, at = [], 0
    for d, t in rows:
        n = len((t or "").split("\n"))
        gone = [k for _, k, x in lines[at:at + n] if x in root and first[find(x)] != (d is None, d or 0, k)]
        at += n
        out.append((d, n, len(gone), ",".join(map(str, gone))))
    return out


def lined(seed: int, docs: int, base_lines: int, edits: int) -> list[tuple[int, str]]:
    """Documents of lines drawn from a few bases, with up to ``edits`` changed characters."""
    rng = random.Random(seed)
    vocab = vocabulary(rng)
    bases = [" ".join(rng.choice(vocab) for _ in range(rng.randint(3, 14))) for _ in range(base_lines)]
    rows = []
    for d in range(docs):
        lines = []
        for _ in range(rng.randint(1, 8)):
            x = list(rng.choice(bases))
            for _ in range(rng.randint(0, edits)):
                at, kind = rng.randrange(len(x)), rng.randrange(3)
                x[at:at + (kind != 1)] = [rng.choice("abcé")] if kind else []
            lines.append(rng.choice(["", " "]) + "".join(x))
        rows.append((d, "\n".join(lines)))
    return rows


def katz(rows: list[tuple], share: int, most: int = 5) -> list[tuple]:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) from plain dictionaries."""
    from collections import Counter, defaultdict
    from math import log10

    texts = [(d, [*words(t), None]) for d, t in rows]
    train = [w for d, w in texts if fold(d, 7) != 2]
    c1 = Counter(x for w in train for x in w)
    n, types = sum(c1.values()), len(c1)

    def discounts(counts) -> list[float]:
        of = Counter(counts)
        d = [1.0] * (most + 1)
        ok = all(of[r] for r in range(1, most + 2))
        if ok:
            cut = (most + 1) * of[most + 1] / of[1]
            for r in range(1, most + 1):
                d[r] = ((r + 1) * of[r + 1] / of[r] / r - cut) / (1 - cut) if cut != 1 else 0
            ok = all(0 < x < 1 for x in d[1:])
        if not ok:
            part = of[1] / (of[1] + 2 * of[2]) if of[1] + of[2] else 0.5
            d = [1.0, *(1 - min(max(part, 0.1), 0.9) / r for r in range(1, most + 1))]
        return d

    d1 = discounts(c1.values())
    seen = {x: (d1[c] if c <= most else 1) * c / n for x, c in c1.items()}
    rest = 1 - sum(seen.values())
    if n and rest <= 0:
        rest, seen = 1 / (n + 1), {x: p * n / (n + 1) for x, p in seen.items()}
    vocab = {x for x, c in c1.items() if c >= n / share}
    cls = lambda x: ("word", x) if x in vocab else "rare"
    p1 = {cls(x): seen[x] for x in vocab}
    p1["rare"] = 1 - sum(p1.values())
    pairs: dict = defaultdict(Counter)
    for w in train:
        for a, b in zip(["begin", *map(cls, w)], map(cls, w), strict=False):
            pairs[a][b] += 1
    d2 = discounts([c for x in pairs.values() for c in x.values()])

    def conditional(h, w) -> float:
        own = pairs.get(h)
        if not own:
            return p1[w]
        total = sum(own.values())
        part = {x: (d2[c] if c <= most else 1) * c / total for x, c in own.items()}
        if all(c > most for c in own.values()):
            part = {x: p * total / (total + 1) for x, p in part.items()}
        free = 1 - sum(p1[x] for x in own)
        if free < 1e-9:
            return part[w] / sum(part.values()) if w in part else 1e-300
        return part[w] if w in part else (1 - sum(part.values())) / free * p1[w]

    out = []
    for d, w in texts:
        base = sum(log10((c1[x] + 1) / (n + types + 1)) for x in w)
        score = 0.0
        for a, x in zip(["begin", *map(cls, w)], w, strict=False):
            score += log10(conditional(a, cls(x)))
            if x not in vocab:
                score += log10((seen[x] if x in c1 else rest) / p1["rare"])
        out.append((d, fold(d, 7) == 2, len(w), sum(x in c1 for x in w), n, base, score))
    return out
