"""Plain versions of the operators, for small inputs."""

import collections
import hashlib
import itertools
import math
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def shingle_set(text, size):
    ws = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not ws:
        return frozenset()
    return frozenset(tuple(ws[i:i + size]) for i in range(max(1, len(ws) - size + 1)))


def components(texts, size, percent):
    """{id: (set size, smallest id reachable)}"""
    sets = {i: shingle_set(t, size) for i, t in texts.items()}
    label = {i: i for i in texts}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                label[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def without_word_repeats(texts, window):
    """{id: (words, removed words, kept words)}"""
    first = {}
    for i in sorted(texts):
        ws = words(texts[i])
        for s in range(len(ws) - window + 1):
            first.setdefault(tuple(ws[s:s + window]), i)
    out = {}
    for i, t in texts.items():
        ws = words(t)
        gone = [False] * len(ws)
        for s in range(len(ws) - window + 1):
            if first[tuple(ws[s:s + window])] < i:
                gone[s:s + window] = [True] * window
        out[i] = (len(ws), sum(gone), [w for w, g in zip(ws, gone) if not g])
    return out


def without_byte_repeats(texts, length):
    """{id: (bytes, removed, spans, sha256 of the rest)}"""
    seen, out = set(), {}
    for i in sorted(texts):
        raw = (texts[i] or "").encode()
        gone = [False] * len(raw)
        for s in range(len(raw) - length + 1):
            piece = raw[s:s + length]
            if piece in seen:
                gone[s:s + length] = [True] * length
            seen.add(piece)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and (s == 0 or not gone[s - 1]) for s, g in enumerate(gone))
        out[i] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def best_pieces(text, scores, unknown):
    """The best score of any segmentation of ``text`` into pieces, by trying every piece at every place."""
    best = [0.0] + [float("-inf")] * len(text)
    for e in range(1, len(text) + 1):
        for s in range(max(0, e - 16), e):
            if text[s:e] in scores:
                best[e] = max(best[e], best[s] + scores[text[s:e]])
        if text[e - 1] not in scores:
            best[e] = max(best[e], best[e - 1] + unknown)
    return best[-1]


def prose(rng, n, words_=None):
    words_ = words_ or ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    return " ".join(rng.choice(words_) for _ in range(n))


def awkward(seed=3):
    """Texts with nulls, blanks, long texts, exact and near copies, chains and shared passages, by id."""
    rng = random.Random(seed)
    base, passage, long_text = prose(rng, 120), prose(rng, 60), prose(rng, 30_000)
    texts = {0: None, 1: "", 2: " \n\t ", 3: "one", 4: "one", 5: "One two", 6: long_text, 7: long_text + " end", 8: "é" * 700, 9: "a" * 5000}
    chain = base.split()
    for i in range(10, 40):                     # every one is near the one before, the ends are far apart
        chain[rng.randrange(len(chain))] = f"new{i}"
        texts[i] = " ".join(chain)
    for i in range(40, 60):
        texts[i] = base.upper() if i % 2 else base
    for i in range(60, 80):
        texts[i] = prose(rng, rng.randint(5, 90)) + " " + passage + "\n" + prose(rng, rng.randint(0, 40))
    for i in range(80, 110):                    # near copies that differ from each other as much as from the base
        ws = base.split()
        for _ in range(rng.randint(1, 3)):
            ws[rng.randrange(len(ws))] = f"edit{rng.randrange(10**6)}"
        texts[i] = " ".join(ws)
    texts |= {110: "x y z " * 400, 111: "日本語 テキスト です " * 30, 112: "tail\x00zero \x1c odd", 113: passage}
    return texts


def clusters(vectors, k, rounds, scale, seed):
    """{id: (cluster, squared distance)}, sums per cluster and final centroids, by plain integer loops."""
    ints = {i: [math.floor(scale * float(x)) for x in v] for i, v in vectors.items()}
    first = sorted(ints, key=lambda i: (hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()))[:k]
    centroids = [list(ints[i]) for i in first]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    nearest = lambda v: min((far(v, c), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for v in ints.values():
            groups.setdefault(nearest(v)[1], []).append(v)
        for n, group in groups.items():
            centroids[n] = [sum(x) // len(group) for x in zip(*group)]
    out = {i: nearest(v)[::-1] for i, v in ints.items()}
    inertia = {}
    for n, d in out.values():
        inertia[n] = inertia.get(n, 0) + d
    return out, inertia, centroids


def alignment(texts, tokens_a, tokens_b):
    """{key: (n_a, n_b, n_groups, n_links, n_best, count_sum, digest)} for [(key, text)]; ``tokens``: text -> [(id, bytes)]."""
    links, shown = {}, {}
    for key, text in texts:
        links[key], shown[key] = [], (0, 0, "")
        if not text:
            continue
        a, b = tokens_a(text), tokens_b(text)
        whole = (" " + text).encode()
        if b"".join(t for _, t in a) != whole or b"".join(t for _, t in b) != whole:
            continue
        ends_a, ends_b = (dict(zip(itertools.accumulate(len(t) for _, t in x), range(1, len(x) + 1))) for x in (a, b))
        groups, i, j = [], 0, 0
        for end in sorted(ends_a.keys() & ends_b.keys()):
            groups.append(",".join(str(t) for t, _ in a[i:ends_a[end]]) + "|" + ",".join(str(t) for t, _ in b[j:ends_b[end]]))
            i, j = ends_a[end], ends_b[end]
            links[key].append((a[i - 1][0], b[j - 1][0]))
        shown[key] = (len(a), len(b), hashlib.sha256(";".join(groups).encode()).hexdigest())
    count = collections.Counter(x for found in links.values() for x in found)
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    return {key: (*shown[key][:2], len(found), len(found), sum(count[x] == best[x[1]] for x in found), sum(count[x] for x in found), shown[key][2])
            for key, found in links.items()}


def letter_grams(text):
    """Three-sign grams with a letter in them; 0 stands between words and around the text."""
    signs = [0]
    for c in (text or "").lower():
        if c.isalpha():
            signs.append(ord(c))
        elif signs[-1]:
            signs.append(0)
    if signs[-1]:
        signs.append(0)
    return [g for g in zip(signs, signs[1:], signs[2:]) if any(g)]


def language_bundle(text, vector, dimensions):
    """The sum over all grams of the product of their letters' vectors, each turned by its distance from the end."""
    out = [0] * dimensions
    for g in letter_grams(text):
        a, b, c = (vector(sign) for sign in g)
        for i in range(dimensions):
            out[i] += a[i - 2] * b[i - 1] * c[i]
    return out


def languages(texts, learned, vector, dimensions):
    """{id: (language, cosine)} for {id: text}; ``learned``: {id: language} of the texts to learn from."""
    bundles = {i: language_bundle(t, vector, dimensions) for i, t in texts.items()}
    prototypes = {}
    for i, lang in learned.items():
        old = prototypes.get(lang, [0] * dimensions)
        prototypes[lang] = [x + y for x, y in zip(old, bundles[i])]
    norm = lambda v: math.sqrt(sum(x * x for x in v))
    out = {}
    for i, v in bundles.items():
        if not letter_grams(texts[i]):
            out[i] = ("und", 0.0)
            continue
        cosine = {k: sum(x * y for x, y in zip(v, p)) / ((norm(v) * norm(p)) or 1) for k, p in prototypes.items()}
        best = max(sorted(cosine), key=cosine.get)
        out[i] = (best, max(0.0, cosine[best]))
    return out
