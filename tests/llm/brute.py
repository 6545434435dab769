"""The operators' results by plain Python, one row at a time."""

import collections
import hashlib
import itertools
import math
import re
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import xxhash
from tokenizers import Tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LIBRARIES = {}


def library(name):
    if name not in _LIBRARIES:
        _LIBRARIES[name] = Tokenizer.from_file(public_tokenizers.path(name))
    return _LIBRARIES[name]


def ids(name, text):
    return np.array(library(name).encode(text or "", add_special_tokens=False).ids, "<u4")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def quality(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = collections.Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


KINDS = (
    ("assign", re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 8),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile("[0-9a-f]+"), 0, 32),
)


def secrets(text):
    found = [(m.start(), k, m.end()) for k, (_, p, g, least) in enumerate(KINDS) for m in p.finditer(text or "") if len(m[g]) >= least]
    counts = [sum(f[1] == k for f in found) for k in range(3)]
    joined = ",".join(f"{KINDS[k][0]}:{a}:{b}" for a, k, b in sorted(found))
    return (*counts, hashlib.sha256(joined.encode()).hexdigest())


def conversation(turns):
    """turns: (turn, role, text)."""
    turns = sorted((t, r or "", x or "") for t, r, x in turns)
    loss = "".join(x for _, r, x in turns if r == "assistant")
    said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def fingerprint(text, width=4):
    w = WORD.findall(lower(text or ""))
    if not w:
        return 0
    hashes = np.array([xxhash.xxh64_intdigest(" ".join(w[i : i + width]).encode(), seed=42) for i in range(max(1, len(w) - width + 1))], np.uint64)
    return sum(1 << b for b in range(64) if 2 * int((hashes >> np.uint64(b) & np.uint64(1)).sum()) > len(hashes))


def components(fingerprints, bits=4):
    """The smallest index reachable from each index."""
    fps = np.array(fingerprints, np.uint64)
    return joined(len(fps), ((i, int(j)) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= bits)))


def joined(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in pairs:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def proposed(a, b):
    """Whether the bit counts of 32 segments agree in three of eight groups, and at most ten bits differ."""
    counts = lambda x: [(x >> 2 * i & 3).bit_count() for i in range(32)]
    u, v = counts(a), counts(b)
    return (a ^ b).bit_count() <= 10 and sum(u[4 * g : 4 * g + 4] == v[4 * g : 4 * g + 4] for g in range(8)) >= 3


def word_shingles(text):
    w = WORD.findall(lower(text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def similar(a, b):
    return len(a & b) >= 0.8 * len(a | b) - 1e-9


def near_components(texts, all_pairs=False):
    """The components of similar texts that fingerprints propose, or of all similar ones."""
    fps, sets = [fingerprint(t, 2) for t in texts], [word_shingles(t) for t in texts]
    pairs = ((i, j) for i in range(len(texts)) for j in range(i) if (all_pairs or proposed(fps[i], fps[j])) and similar(sets[i], sets[j]))
    return joined(len(texts), pairs)


def words_of(text):
    w, word = [], ""
    for c in (text or "").lower() + " ":
        if unicodedata.category(c)[0] in "LN":
            word += c
        elif word:
            w.append(word)
            word = ""
    return w


def shingles(text):
    w = words_of(text)
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def shared_shingles(item, text):
    """(shared, all) of an item's shingles; one of fewer than five words is looked for as it is."""
    own, held = shingles(item), shingles(text)
    for s in own:
        if len(s.split(" ")) < 5 and f" {s} " in f" {' '.join(words_of(text))} ":
            held.add(s)
    return len(own & held), len(own)


def ngrams(text, buckets):
    """Counts by bucket of n-grams of orders 1 to 3: the text in lower case, all but letters as spaces, a space on either side."""
    if not any(c.isalpha() for c in (text or "").lower()):
        return None
    c = [32, *(ord(x) if x.isalpha() else 32 for x in text.lower()), 32]
    found, word = collections.Counter(), 1 << 32
    for i in range(len(c)):
        one = c[i] * 0x9E3779B1 % word
        grams = [(0, one, c[i] != 32)]
        if i + 1 < len(c):
            two = (one * 0x85EBCA6B + c[i + 1]) % word
            grams.append((1, two, c[i] != 32 or c[i + 1] != 32))
        if i + 2 < len(c):
            grams.append((2, (two * 0xC2B2AE35 + c[i + 2]) % word, c[i + 1] != 32))
        for order, h, counts in grams:
            if counts:
                found[((h + order * 0x27D4EB2F) * 0x9E3779B1 % word) * buckets >> 32] += 1
    return found


def mixture(counts, models, penalty):
    """counts by bucket, models: language -> bucket -> probability. The best shares of every set of languages, by long
    expectation-maximisation; the set with the largest likelihood less penalty."""
    best = (-math.inf, None)
    for n in range(1, len(models) + 1):
        for names in itertools.combinations(sorted(models), n):
            shares = dict.fromkeys(names, 1 / n)
            for _ in range(300 if n > 1 else 0):
                new = dict.fromkeys(names, 0.0)
                for b, k in counts.items():
                    whole = sum(shares[x] * models[x][b] for x in names)
                    for x in names:
                        new[x] += k * shares[x] * models[x][b] / whole
                shares = {x: v / sum(counts.values()) for x, v in new.items()}
            value = sum(k * math.log(sum(shares[x] * models[x][b] for x in names)) for b, k in counts.items()) - penalty * n
            best = max(best, (value, tuple(shares.items())))
    return dict(best[1])


def crc(array):
    return zlib.crc32(array.astype("<u4").tobytes())


def infilled(doc_id, text):
    """(n, form, prefix_chars, middle_chars), and the output."""
    text = text or ""
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)))
    prefix, middle, suffix = ("".join(t) for t in (tokens[:a], tokens[a:b], tokens[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (len(tokens), "plain", None, None), text
    if h4 % 100 < 20:
        return (len(tokens), "spm", len(prefix), len(middle)), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return (len(tokens), "psm", len(prefix), len(middle)), f"<P>{prefix}<S>{suffix}<M>{middle}"


def lloyd(rows, k=8, rounds=10, seed=3):
    """rows: (vec_id, components). vec_id, cluster, distance, cluster_inertia, inertia, digest of each kept row, in whole numbers of Python."""
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) and abs(1024 * x) < 1 << 27 for x in v)]
    drawn = sorted(whole, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [v for _, v in drawn[:k]]
    for r in range(rounds + 1):
        c = np.array(centroids, np.int64)
        own = [min((int(((np.array(v) - x) ** 2).sum()), j) for j, x in enumerate(c)) for _, v in whole]
        if r < rounds:
            for j in range(len(centroids)):
                members = [v for (_, v), (_, o) in zip(whole, own, strict=True) if o == j]
                if members:
                    centroids[j] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    inertia = collections.Counter()
    for d, j in own:
        inertia[j] += d
    return [(i, j, d, inertia[j], inertia.total(), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(whole, own, strict=True)]
