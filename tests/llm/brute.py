"""Plain versions of the operators' results, one row at a time, and the rows that test them."""

import hashlib
import math
import random
from collections import defaultdict

import xxhash

WHITE = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text string, keep_key string, hi long, n int, lang string, source string"


def awkward(long_words=60_000):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, texts in other scripts."""
    rng = random.Random(3)
    words = "alpha beta gamma delta omega sigma kappa lambda zeta eta theta iota".split()
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = say(60) + "."
    near = [base.replace("alpha", "ALPHA", k % 3) + "\n" + "header line" for k in range(8)]
    out = [(k, t) for k, t in enumerate(near)]
    out += [(100 + k, say(rng.randint(1, 50)) + ".\nShared Footer\n  SHARED footer\t\n" + say(3)) for k in range(14)]
    out += [(200, None), (201, ""), (202, " \t\n\n"), (203, "one"), (204, "one two"), (205, "One two three")]
    out += [(206, "один два три\n中文 文本。 é ü"), (207, "a\x00b <|endoftext|> tail"), (208, "x" * 5000), (209, "<|endoftext|>")]
    out += [(300, "same text"), (301, "same text"), (301, "same text"), (302, "same text"), (None, "same text"), (None, None), (None, "only here")]
    out += [(400, " ".join(f"w{k % 977}" for k in range(long_words)))]
    out += [(5, "another text with the id of a near copy")]
    return [(i, t, None if k % 3 else "x", None if k % 2 else k, None if k % 5 else 1, ("en", "de", None)[k % 3], (f"src{k % 5}", None, "misc")[k % 3]) for k, (i, t) in enumerate(out)]


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def sha(b):
    return hashlib.sha256(b).hexdigest()


def lines(rows, least=10):
    seen, texts = defaultdict(int), []
    for i, t in rows:
        own = [(x, lower(x.strip(WHITE))) for x in (t or "").split("\n")]
        texts.append((i, own))
        for key in {k for _, k in own if k}:
            seen[key] += 1
    return [(i, len(own), sum(seen[k] >= least for _, k in own), sha("\n".join(x for x, k in own if seen[k] < least).encode())) for i, own in texts]


def exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        first = True
        for i in ids:
            kept = i == keep and first
            first = first and not kept
            out.append((i, keep, len(ids), kept, sha(t.encode())))
    return out


def simhash(text, width=3):
    words = lower(text or "").encode().split()
    if not words:
        return 0
    pieces = [b" ".join(words[k : k + width]) for k in range(len(words) - width + 1)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(p, seed=42) for p in pieces]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(prints, radius=2):
    """prints -> the root of each, by pairs."""
    up = list(range(len(prints)))

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                up[find(a)] = find(b)
    return [find(k) for k in range(len(prints))]


def components(rows):
    prints = [simhash(t) for _, t in rows]
    root = roots(prints)
    least = defaultdict(lambda: None)
    for (i, _), r in zip(rows, root, strict=True):
        if i is not None and (least[r] is None or i < least[r]):
            least[r] = i
    return [(i, f"{p:016x}", least[r]) for (i, _), p, r in zip(rows, prints, root, strict=True)]


def spans(rows, sentences=2, min_words=20):
    """Sentences that go, by row: every span of every text, shortest from each start and to each end."""
    import re

    split = [[s for s in re.findall(rb"[^.!?\n]*[.!?]*\s*", (t or "").encode()) if s] for _, t in rows]
    seen = defaultdict(set)
    for r, (i, t) in enumerate(rows):
        words = [s.lower().split() for s in split[r]]
        full = [k for k, w in enumerate(words) if w]
        size = lambda a, b: sum(len(words[k]) for k in full[a:b])  # noqa: E731,B023
        ok = lambda a, b: b - a >= sentences and size(a, b) >= min_words  # noqa: E731,B023
        own = set()
        for a in range(len(full)):
            own |= {(a, b) for b in [next((b for b in range(a + 1, len(full) + 1) if ok(a, b)), None)] if b}
            if size(a, a + 1) >= 2 * min_words:
                own.add((a, a + 1))
        for b in range(1, len(full) + 1):
            own |= {(a, b) for a in [next((a for a in range(b - 1, -1, -1) if ok(a, b)), None)] if a is not None}
        for a, b in own:
            text = b"\n".join(b" ".join(words[k]) for k in full[a:b])
            seen[text].add((math.inf if i is None else i, t or "", full[a], full[b - 1] + 1))
    gone = defaultdict(set)
    for places in seen.values():
        # a document is (doc_id, text); of the same doc_id with other texts either may be first
        first = min(places, key=lambda p: (p[0], p[2]))
        for p in places:
            if p != first:
                gone[p[:2]].update(range(p[2], p[3]))
    return [(i, len(split[r]), len(gone[(math.inf if i is None else i, t or "")]), sha(b"".join(s for k, s in enumerate(split[r]) if k not in gone[(math.inf if i is None else i, t or "")]))) for r, (i, t) in enumerate(rows)]
