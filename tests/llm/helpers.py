"""Small tables with every awkward case, and plain versions of the operators."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import regex
import xxhash

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, q int, _d string, _docs string, key string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def rows():
    base = "One two three four five six seven eight nine ten. Eleven twelve thirteen fourteen fifteen sixteen seventeen.\n"
    long = " ".join(f"word{i % 997} and" for i in range(30_000))
    texts = [None, "", " \n\t ", "x", base, base, base.upper(), base * 9, long, "a b\x0bc\x0cd\re", "éa éa\nÄ Ä\n𝒳 𝒴 𝒵 𝒳 𝒴 𝒵", "# $ % & | < >", "\n".join(["menu | home | about"] * 20 + [base])]
    texts += [f"common line\nCOMMON LINE \nown {i}" for i in range(12)]
    texts += [" ".join(f"prose{i}x{j}" for j in range(80)) for i in range(5)]
    out = [(i, t, "en" if i % 3 else None, f"s{i % 3}" if i % 4 else None, len(t or ""), 1, "d", "docs", "k") for i, t in enumerate(texts)]
    return [*out, out[4], out[8], (None, texts[-1], None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def fingerprint(text):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(docs):
    """doc_id -> (hex fingerprint, least doc_id), over rows with a doc_id; all pairs compared."""
    fps = np.array([fingerprint(t) for _, t in docs], np.uint64)
    kinds = sorted(set(fps.tolist()))
    values = np.array(kinds, np.uint64)
    parent = list(range(len(kinds)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, v in enumerate(kinds):
        for j in np.flatnonzero(np.bitwise_count(values ^ np.uint64(v)) <= 2):
            parent[find(int(j))] = find(i)
    least = defaultdict(lambda: float("inf"))
    for (d, _), f in zip(docs, fps.tolist(), strict=True):
        if d is not None:
            r = find(kinds.index(f))
            least[r] = min(least[r], d)
    return sorted((d, f"{f:016x}", least[find(kinds.index(f))]) for (d, _), f in zip(docs, fps.tolist(), strict=True) if d is not None)


def quality(text):
    text = text or ""
    w = WORDS.findall(text)
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def line_dedup(docs, min_docs=10, keep_first=False):
    """docs: (doc_id, text), different; the texts that stay, with counts."""
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    holders, first = defaultdict(set), {}
    for d in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        for p, x in enumerate((d[1] or "").split("\n")):
            holders[key(x)].add(d)
            first.setdefault(key(x), (d, p))
    out = []
    for d in docs:
        lines = (d[1] or "").split("\n")
        gone = [bool(key(x)) and len(holders[key(x)]) >= min_docs and not (keep_first and first[key(x)] == (d, p)) for p, x in enumerate(lines)]
        out.append((d[0], len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)))
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


#: Plain copies of the line rules' word and mark lists.
PHRASES = "all rights reserved|alle rechte vorbehalten|tous droits réservés|todos los derechos reservados|privacy policy|datenschutzerklärung|politique de confidentialité|política de privacidad|terms of use|terms of service|nutzungsbedingungen|conditions d’utilisation|términos de uso|use cookies|cookie policy|verwendet cookies|utilise des cookies|utiliza cookies|enable javascript|lorem ipsum|newsletter|click here to|share this article|skip to content".split("|")


def line_fails(line):
    w = WORDS.findall(line)
    n, bare = len(w), "".join(w)
    separators = sum(c in "|›»•·" for c in line)
    return n > 0 and (
        (n <= 3 and bare[-1] not in ".!?…:;。！？\"'”’»)]")
        or 2 * sum(c in "#*$%&|<>" for c in line) >= n
        or (separators > 0 and n - separators <= 3 * (separators + 1))
        or (n >= 3 and 2 * line.count("!") >= n)
        or (n >= 3 and not regex.search(r"\p{Ll}", line) and bool(regex.search(r"\p{Lu}", line)))
        or (n >= 3 and 2 * len(regex.findall(r"[\p{L}\p{M}\p{N}]", bare)) < len(bare))
        or (n >= 3 and 2 * sum(bool(re.fullmatch(r"[0-9][0-9.,:/%-]*", x)) for x in w) > n)
        or 2 * len(re.findall(r"://|www\.", line)) >= n
        or (n <= 12 and any(p in line.lower() for p in PHRASES))
    )


def clean(text):
    """The text that stays, or None if the document is rejected."""
    n, chars, _, _, repeated = quality(text)
    if n < 50 or 100 * repeated > 50 * n:
        return None
    stay = "\n".join(x for x in text.split("\n") if not line_fails(x))
    return stay if 10 * (chars - len("".join(WORDS.findall(stay)))) <= 3 * chars else None


def near_pairs(texts):
    """Pairs of texts with a five-word similarity of 0.8 or more, all pairs compared."""
    sets = []
    for t in texts:
        w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    return {(i, j) for j, b in enumerate(sets) for i, a in enumerate(sets[:j]) if 5 * len(a & b) >= 4 * len(a | b)}


def near_stage(texts):
    """doc_id -> text: the least doc_id of each component, then long lines but their first occurrence."""
    ids, pairs = sorted(texts), near_pairs([texts[d] for d in sorted(texts)])
    least = list(range(len(ids)))
    while (now := [min([least[i], *(least[a + b - i] for a, b in pairs if i in (a, b))]) for i in range(len(ids))]) != least:
        least = now
    kept = {ids[i]: texts[ids[i]] for i in set(least)}
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(list)
    for d in sorted(kept):
        for p, x in enumerate(kept[d].split("\n")):
            if len(WORDS.findall(x)) > 50:
                holders[key(x)].append((d, p))
    gone = {at for v in holders.values() if len({d for d, _ in v}) > 1 for at in v[1:]}
    return {d: "\n".join(x for p, x in enumerate(t.split("\n")) if (d, p) not in gone) for d, t in kept.items()}


def tokens(text):
    return re.findall(r"\w+", (text or "").lower())


def tiles(item, text, k=5):
    """Greedy tiles, written plainly: the longest first, then by place in the item and in the text."""
    a, b = tokens(item), tokens(text)
    k = min(k, len(a))
    used_a, used_b, out = set(), set(), []
    while k:
        best = (k - 1, 0, 0)
        for p in range(len(a)):
            for t in range(len(b)):
                n = 0
                while p + n < len(a) and t + n < len(b) and a[p + n] == b[t + n] and p + n not in used_a and t + n not in used_b:
                    n += 1
                if n > best[0]:
                    best = (n, p, t)
        n, p, t = best
        if n < k:
            break
        used_a.update(range(p, p + n))
        used_b.update(range(t, t + n))
        out.append((p, t, n))
    return out


def contaminated(text, items):
    """Whether tiles cover 60 % of an item's tokens. Items without a common window have no tile."""
    b = tokens(text)
    for item in items:
        a = tokens(item)
        k = min(5, len(a))
        seen = {tuple(b[i : i + k]) for i in range(len(b) - k + 1)}
        if k and any(tuple(a[i : i + k]) in seen for i in range(len(a) - k + 1)) and 10 * sum(n for _, _, n in tiles(item, text)) >= 6 * len(a):
            return True
    return False


def water(sizes):
    """Targets by resharing what is above, again and again. sizes: in the order of the sources."""
    total, full = sum(sizes), set()
    while True:
        left = total - sum(3 * sizes[i] for i in full)
        weights = {i: (5, 2, 1)[i % 3] for i in range(len(sizes)) if i not in full}
        goal = [3 * s if i in full else left * weights[i] / sum(weights.values()) for i, s in enumerate(sizes)]
        above = {i for i in weights if goal[i] > 3 * sizes[i]}
        if not above:
            return goal
        full |= above


def mixture(texts, source):
    """(doc_id, text) -> copies: a boundary crossed by rate times rank plus offset is a copy."""
    own = defaultdict(list)
    for d, t in texts.items():
        own[source[d]].append((len(WORDS.findall(t)), d))
    names = sorted(own, key=lambda s: (s is None, s or ""))
    out = {}
    for s, goal in zip(names, water([sum(n for n, _ in own[s]) for s in names]), strict=True):
        size = sum(n for n, _ in own[s])
        rate = min(3.0, goal / size) if size else 0.0
        offset = int(hashlib.md5(("mix-1" + (s if s is not None else "\0")).encode()).hexdigest()[:8], 16) / 2**32
        for rank, (_, d) in enumerate(sorted(own[s]), 1):
            copies = min(3, int(rate * rank + offset) - int(rate * (rank - 1) + offset))
            if copies:
                out[d, texts[d]] = copies
    return out
