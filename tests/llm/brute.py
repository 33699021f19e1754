"""Plain versions of the operators, straight from their definitions, for small tables."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text: str | None, width: int) -> set[tuple[str, ...]]:
    words = WORD.findall(lower(text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def near_duplicates(rows: list[tuple[int, str | None]], width: int, percent: int) -> dict[int, tuple[int, int]]:
    """doc_id -> (set size, smallest reachable id)."""
    sets = {d: shingles(t, width) for d, t in rows}
    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    both: Counter = Counter()
    for ds in holders.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                both[a, b] += 1
    root = {d: d for d in sets}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for (a, b), n in both.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {d: (len(s), find(d)) for d, s in sets.items()}


def remove_repeats(rows: list[tuple[int, str | None]], length: int) -> dict[int, tuple[int, int, str]]:
    """doc_id -> (words, words removed, kept words joined by a space)."""
    first: dict[tuple, int] = {}
    words = {d: WORD.findall(t or "") for d, t in rows}
    for d in sorted(words):
        for i in range(len(words[d]) - length + 1):
            first.setdefault(tuple(words[d][i : i + length]), d)
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] < d:
                gone.update(range(i, i + length))
        out[d] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


def base_measures(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    found = defaultdict(list)
    for i in range(len(words) - 4):
        found[tuple(words[i : i + 5])].append(i)
    repeated = {j for at in found.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated)


def archive(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, str, str, int | None]]:
    """page_id -> payload bytes, digest, record type, refers_to."""
    last: dict[bytes, int] = {}
    for p, html in rows:
        data = (html or "").encode()
        last[data] = max(p, last.get(data, p))
    out = {}
    for p, html in rows:
        data = (html or "").encode()
        out[p] = (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), *(("response", None) if last[data] == p else ("revisit", last[data])))
    return out


def edits(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, str]]:
    """doc_id -> code points, SHA-256 of the edited text."""
    rows = sorted(((d, t or "") for d, t in rows), reverse=True)
    out = {}
    for (d, t), (_, after) in zip(rows, [*rows[1:], rows[0]], strict=True):
        k = len(t) // 3
        out[d] = (len(t), hashlib.sha256((t[: len(t) - k] + after[:k]).encode()).hexdigest())
    return out


def token_pieces(rows: list[tuple[int, str | None]], path: str, most: int, special: bool = True) -> dict[tuple[int, int], tuple[int, int, int]]:
    """(doc_id, piece) -> start, length, CRC-32 of the ids, by the tokenizers library."""
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(path)
    tool.encode_special_tokens = special
    out = {}
    for d, t in rows:
        ids = [*tool.encode(t or "", add_special_tokens=False).ids, 0]
        lead = len(ids) % most or most
        bounds = [0, *range(min(lead, len(ids)), len(ids) + 1, most)]
        for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            out[d, k] = (a, b - a, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a:b])))
    return out


MASK = (1 << 64) - 1


def scrambled(x: int) -> int:
    """The SplitMix64 finaliser."""
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def parsed(symbols: list[int], base: int, rounds: int = 3) -> list[int]:
    """One level of a locally consistent parsing, symbol by symbol: the names of the phrases."""
    runs: list[list[int]] = []
    for s in symbols:
        if runs and runs[-1][0] == s:
            runs[-1][1] += 1
        else:
            runs.append([s, 1])
    names = [s if n == 1 else scrambled((s * base + n) & MASK) for s, n in runs]
    if not names:
        return []

    def label(own: int, left: int | None) -> int:
        place = 0 if left is None else ((own ^ left) & -(own ^ left)).bit_length() - 1
        return 2 * place + (own >> place & 1)

    labels = [label(x, names[i - 1] if i else None) for i, x in enumerate(names)]
    for _ in range(rounds):
        before = [0, *labels[:-1]]
        labels = [0 if own == left else label(own, left) for own, left in zip(labels, before)]
    starts = [0]
    for i in range(1, len(names)):
        after = labels[i + 1] if i + 1 < len(labels) else 0
        if labels[i] > labels[i - 1] and labels[i] >= after and i > 1:
            starts.append(i)
    out = []
    for a, b in zip(starts, [*starts[1:], len(names)], strict=True):
        total = sum(scrambled(x) * pow(base, k % 64, 1 << 64) for k, x in enumerate(names[a:b])) + b - a
        out.append(scrambled(total & MASK))
    return out


def fingerprint(text: str, base: int, levels: tuple[int, ...], bins: int) -> list[int]:
    names = [scrambled(x + 1000) for x in text.encode()]
    least: dict[int, int] = {}
    for level in range(1, max(levels) + 1):
        names = parsed(names, base)
        if level in levels:
            for x in names:
                y = scrambled((x + level) & MASK)
                least[y >> 57] = min(y, least.get(y >> 57, y))
    return [1 + scrambled(least[k]) % 65535 if k in least else 0 for k in range(bins)]


def ordinal_loss(rows: list[list[int]], grades: list[int], weights: dict[int, float], limits: list[float]) -> float:
    """The mean negative logarithm of P(grade), P(grade <= k) = 1 / (1 + exp(score - limit k))."""
    import math

    def upto(k: int, score: float) -> float:
        return 0.0 if k < 0 else 1.0 if k >= len(limits) else 1 / (1 + math.exp(score - limits[k]))

    total = 0.0
    for slots, y in zip(rows, grades, strict=True):
        score = sum(weights.get(s, 0.0) for s in slots)
        total -= math.log(upto(y, score) - upto(y - 1, score))
    return total / len(rows)
