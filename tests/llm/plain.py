"""The contracts in plain Python, for small inputs: every function takes {doc_id: text or None}."""

import hashlib
import math
import re
import zlib
from collections import Counter

UPPER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
SPACE = " \t\n\x0b\x0c\r"


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def space_words(text, lower=True):
    return re.findall("[^\x20\x09-\x0d]+", ((text or "").translate(UPPER) if lower else text or ""))


def alnum_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(UPPER))


def shingles(text, width=5):
    w = space_words(text)
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def jaccard_classes(docs):
    """{doc_id: (n_shingles, component_id)} by comparing all pairs."""
    sets = {d: shingles(t) for d, t in docs.items()}
    label = {d: d for d in docs}

    def find(d):
        while label[d] != d:
            d = label[d]
        return d

    ids = sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in docs}


def line_key(line):
    return line.strip(SPACE).translate(UPPER)


def line_dedup(docs, min_docs=2):
    """{doc_id: (n_lines, n_dropped, text)}"""
    holders = {}
    for d, t in docs.items():
        for line in (t or "").split("\n"):
            holders.setdefault(line_key(line), set()).add(d)
    out = {}
    for d, t in docs.items():
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(line_key(x)) >= 10 and len(holders[line_key(x)]) >= min_docs and min(holders[line_key(x)]) != d)]
        out[d] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def contamination(docs, items, width=13):
    """{doc_id: (n_words, n_hit, item_ids, contaminated)}"""
    windows = {}
    for i, t in items.items():
        w = alnum_words(t)
        for k in range(max(1, len(w) - width + 1)) if w else ():
            windows.setdefault(tuple(w[k : k + width]), set()).add(str(i))
    out = {}
    for d, t in docs.items():
        w, hit, found = alnum_words(t), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if ids := windows.get(tuple(w[k : k + size])):
                    hit |= set(range(k, k + size))
                    found |= ids
        out[d] = (len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w))
    return out


def suffix_dedup(docs, span=100):
    """{doc_id: (n_bytes, n_removed, n_spans, kept)}"""
    seen, out = set(), {}
    for d in sorted(docs):
        raw = (docs[d] or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - span + 1):
            s = raw[i : i + span]
            if s in seen:
                gone[i : i + span] = b"\x01" * span
            seen.add(s)
        out[d] = (len(raw), sum(gone), len(re.findall(b"\x01+", bytes(gone))), bytes(b for b, g in zip(raw, gone) if not g))
    return out


def quality(docs, hosts):
    """{doc_id: (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_removed_lines)}"""
    voters, sizes, out = {}, Counter(hosts.values()), {}
    for d, t in docs.items():
        for line in (t or "").split("\n"):
            voters.setdefault((hosts[d], line_key(line)), set()).add(d)
    for d, t in docs.items():
        text, w = t or "", space_words(t, lower=False)
        lines = text.split("\n")
        worded = [x for x in lines if x.strip(SPACE)]
        runs = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        twice = {p for i in range(len(w) - 7) if runs[tuple(w[i : i + 8])] > 1 for p in range(i, i + 8)}
        failed = len(w) < 20 or 100 * len(twice) > 30 * len(w)
        n = {x: len(voters[hosts[d], line_key(x)]) for x in lines}
        gone = [x for x in lines if len(line_key(x)) >= 10 and n[x] > 10 and n[x] > 0.01 * sizes[hosts[d]]]
        chars = lambda xs: sum(len(x.strip(SPACE)) for x in xs)
        kept = not failed and chars(lines) - chars(gone) >= 0.3 * chars(lines)
        out[d] = (
            len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(worded) - len(set(worded)), len(twice), failed, kept, len(gone),
        )
    return out


def sentences(text, ends=".!?;:,"):
    """(words, raw text) of each sentence; white space before the first is left to nobody."""
    words = list(re.finditer("[^\x20\x09-\x0d]+", text or ""))
    last = lambda word: (word[0] + word[1:].rstrip("\"')]}\u2019\u201d\u203a\u00bb"))[-1]
    cuts = [i for i, m in enumerate(words) if i == 0 or last(words[i - 1].group()) in ends or "\n" in text[words[i - 1].end() : m.start()]]
    out = []
    for a, b in zip(cuts, [*cuts[1:], len(words)]):
        end = words[b].start() if b < len(words) else len(text)
        out.append((tuple(m.group().translate(UPPER) for m in words[a:b]), words[a].start(), end))
    return out


def span_dedup(docs, least=3, min_words=20):
    """{doc_id: (n_sentences, removed, text)}"""
    seen, out = set(), {}
    for d in sorted(docs):
        parts = sentences(docs[d])
        gone = set()
        size = lambda i, j: sum(len(p[0]) for p in parts[i:j])
        found = set()
        for i in range(len(parts)):
            j = i + least
            while j <= len(parts) and size(i, j) < min_words:
                j += 1
            if j <= len(parts):
                found.add((i, j))
        if size(0, len(parts)) >= min_words:
            i = max(0, len(parts) - least)
            while size(i, len(parts)) < min_words:
                i -= 1
            found.add((i, len(parts)))
        for i, j in sorted(found):
            run = sum((p[0] for p in parts[i:j]), ())
            if run in seen:
                gone |= set(range(i, j))
            seen.add(run)
        text = docs[d] or ""
        for i in sorted(gone, reverse=True):
            text = text[: parts[i][1]] + text[parts[i][2] :]
        out[d] = (len(parts), sorted(gone), text)
    return out


def merkle_leaf(row, text=None):
    """row is (doc_id, text, lang, source, n_chars)."""
    d, t, lang, source, n = row
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d, source, lang, n, t if text is None else text)))


def merkle_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def merkle_path(levels, i):
    out = []
    for nodes in levels[:-1]:
        a = i // 16 * 16
        out.append(("".join(nodes[a:i]), "".join(nodes[i + 1 : a + 16])))
        i //= 16
    return out


def merkle(rows):
    """[(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)]"""
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, merkle_leaf(r)))
    trees = {s: merkle_levels([merkle_leaf(r) for r in by[s]]) for s in sources}
    top = merkle_levels([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for i, r in enumerate(by[s]):
            path = merkle_path(trees[s], i) + merkle_path(top, k)
            leaf = merkle_leaf(r)
            tampered = r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            fold = merkle_leaf(r, r[1].translate(UPPER)) if tampered else leaf
            for left, right in path:
                fold = sha(left + fold + right)
            out.append((r[0], leaf, trees[s][-1][0], top[-1][0], sha("".join(a + b for a, b in path)), fold, fold == top[-1][0]))
    return out


def lm_tokens(text):
    return [*space_words(text), None]


def lm_off(n):
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    off = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.5 * k for k in (1, 2, 3)]
    return [min(max(x, 0.05), k) for k, x in enumerate(off, 1)]


def lm_model(texts):
    """Probability of a word after another (a text's first token stands after 0), counts and sizes, by plain counting."""
    counts, pairs = Counter(), Counter()
    for t in texts:
        w = lm_tokens(t)
        counts.update(w)
        pairs.update(zip([0, *w], w))
    follow, ends = {}, Counter()
    for (a, b), c in pairs.items():
        follow.setdefault(a, Counter())[min(c, 3)] += 1
        ends[b] += 1
    total = Counter()
    for (a, _), c in pairs.items():
        total[a] += c
    d2 = lm_off([sum(c == k for c in pairs.values()) for k in (1, 2, 3, 4)])
    d1 = lm_off([sum(c == k for c in ends.values()) for k in (1, 2, 3, 4)])
    less = lambda c, d: c - d[min(c, 3) - 1] if c else 0.0
    spare = sum(d1[min(c, 3) - 1] for c in ends.values()) / len(pairs) if pairs else 1.0

    def p(a, b):
        word = (less(ends[b], d1) / len(pairs) if pairs else 0.0) + spare / (len(counts) + 1)
        if not total[a]:
            return word
        return less(pairs[a, b], d2) / total[a] + sum(d2[k - 1] * n for k, n in follow[a].items()) / total[a] * word

    return p, counts


def lm_scores(docs, learn):
    """{doc_id: (n_tokens, n_known, train_tokens, base_score, score)}"""
    p, counts = lm_model([docs[d] for d in docs if learn(d)])
    n, v = sum(counts.values()), len(counts)
    out = {}
    for d, t in docs.items():
        w = lm_tokens(t)
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)
        out[d] = (len(w), sum(counts[x] > 0 for x in w), n, base, sum(math.log10(p(a, b)) for a, b in zip([0, *w], w)))
    return out
