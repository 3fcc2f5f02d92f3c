"""Plain versions of the contracts, for small tables."""

import hashlib
import re
import zlib
from collections import defaultdict

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return SPACED.findall(text or "")


def chat(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in convs.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def jaccard(docs):
    """Rows that share a doc_id are one document with several sets."""
    sets = []
    for doc, text in docs:
        w = words((text or "").translate(_LOWER))
        sets.append((doc, frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    known = [(d, s) for d, s in sets if d is not None and s]
    for i, (a, s) in enumerate(known):
        for b, t in known[:i]:
            if 100 * len(s & t) >= 80 * len(s | t):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted(((d, len(s), None if d is None else (find(d) if s else d)) for d, s in sets), key=str)


def rules(text):
    text = text or ""
    w = words(text)
    lines = [line for line in text.split("\n") if words(line)]
    spots = defaultdict(list)
    for i in range(len(w) - 7):
        spots[tuple(w[i : i + 8])].append(i)
    hit = {j for at in spots.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w))


def substring(docs):
    first = {}
    for doc, text in docs:
        w = words(text)
        d = float("inf") if doc is None else doc
        for i in range(len(w) - 12):
            key = tuple(w[i : i + 13])
            first[key] = min(first.get(key, d), d)
    out = []
    for doc, text in docs:
        w = words(text)
        d = float("inf") if doc is None else doc
        gone = {j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < d for j in range(i, i + 13)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def decontam(docs, items):
    windows = defaultdict(set)
    for item, text in items:
        w = ALNUM.findall((text or "").translate(_LOWER))
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i : i + 10])].add(item)
    sizes = {len(k) for k in windows}
    out = []
    for doc, text in docs:
        w = ALNUM.findall((text or "").translate(_LOWER))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def targets(sizes, weights=(5, 2, 1), most=3):
    """source -> target; sources by code point, null last."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = float(sum(sizes.values())), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not full:
            out.update({s: level * weight[s] for s in open_})
            break
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def repair(rows):
    """(conv, turn, role, text) -> conv, gaps, counts, cost, audit, digest: all edits of a row tried in turn."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        said = [" " if x is None else x for x in (conv, turn, role, text)]
        kind = zlib.crc32(f"{said[0]}:{said[1]}".encode()) % 20
        role, text = said[2:]
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        order = (turn is not None, turn or 0, role, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest())
        convs[conv] += [(order, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = []
    for conv, turns in convs.items():
        turns.sort(key=lambda r: r[0])
        faults, seen = [], set()
        for _, _, role, text in turns:
            bare = text.strip(" \t\n\v\f\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        known = [t for _, t, *_ in turns if t is not None]
        initials = [r[:1] or " " for _, _, r, _ in turns]
        # paths as (cost, audit, initials so far), cut where the initials can't be completed
        paths = {(0, "", "")}

        def fits(made):
            return re.fullmatch("(s?(ua)*u?)?", made)

        def grown(paths):
            for _ in range(2):
                paths = paths | {(c + 5, a + "I", m + r) for c, a, m in paths for r in "ua" if fits(m + r)}
            return pruned(paths)

        def pruned(paths):
            best = {}
            for c, a, m in paths:
                key = (m[-1:], not m)
                kept = best.setdefault(key, set())
                kept.add((c, a, m))
            return {p for kept in best.values() for p in sorted(kept)[:12]}

        for i, fault in zip(initials, faults):
            paths = grown(paths)
            more = 5 * (fault == "truncated")
            ahead = {(c + 2, a + "D", m) for c, a, m in paths}
            if fault not in ("blank", "duplicate"):
                ahead |= {(c + more, a + "K", m + i) for c, a, m in paths if i in "sua" and fits(m + i)}
                ahead |= {(c + 1 + more, a + "R", m + r) for c, a, m in paths for r in "ua" if fits(m + r)}
            paths = pruned(ahead)
        cost, audit, made = min(p for p in grown(paths) if re.fullmatch("(s?(ua)+)?", p[2]))
        left, at, said = iter(turns), 0, []
        for edit in audit:
            row = next(left) if edit != "I" else (0, 0, "", "")
            if edit != "D":
                said.append((row[2] if edit == "K" else {"u": "user", "a": "assistant"}[made[at]]) + ":" + row[3])
                at += 1
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()))
    return sorted(out, key=str)


def _sha(said):
    return hashlib.sha256(said.encode()).hexdigest()


def _tree(nodes):
    """Levels from the leaves up to one node."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([_sha("".join(now[i : i + 8])) for i in range(0, len(now), 8)])
    return levels


def manifest(rows):
    """(doc_id, source, lang, n_chars, text) -> doc_id, leaf, subroot, root, proof, folded, verified."""

    def leaf(*values):
        return _sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    groups = defaultdict(list)
    for doc, source, lang, n, text in rows:
        groups[lang].append((doc is not None, doc or 0, leaf(doc, source, lang, n, text), doc, leaf(doc, source, lang, n, text.translate(_LOWER) if text else text)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: _tree([r[2] for r in sorted(groups[g], key=lambda r: r[:3])]) for g in names}
    top = _tree([trees[g][-1][0] for g in names])
    out = []
    for at, g in enumerate(names):
        for i, (_, _, digest, doc, changed) in enumerate(sorted(groups[g], key=lambda r: r[:3])):
            proof, folded = [], changed if doc is not None and zlib.crc32(str(doc).encode()) % 3 == 0 else digest
            for levels, place in ((trees[g], i), (top, at)):
                for level in levels[:-1]:
                    run, k = level[place // 8 * 8 : place // 8 * 8 + 8], place % 8
                    proof += run[:k] + run[k + 1 :]
                    folded = _sha("".join(run[:k] + [folded] + run[k + 1 :]))
                    place //= 8
            out.append((doc, digest, trees[g][-1][0], top[-1][0], _sha("".join(proof)), folded, folded == top[-1][0]))
    return sorted(out, key=str)


words_of = words


def tree(text, words=8):
    """(root, distinct pieces) of a text: pieces in lines, lines in sections."""
    sections, section, pieces = [], "", set()
    for line in text.split("\n"):
        found, now = [], ""
        for space, word in re.findall(r"([\x20\x09\x0B-\x0D]*)([^\x20\x09-\x0D]*)", line):
            if not word:
                now += space
                continue
            now += space
            if now.strip(" \t\v\f\r") and (len(words_of(now)) == words or words_of(now)[-1][-1] in ".!?,;:|"):
                found.append(now)
                now = ""
            now += word
        found += [now] if now else []
        digests = [_sha(p) for p in found]
        pieces |= {d[:12] for d in digests}
        own = _sha("".join(digests))
        section += own
        if not digests or own[0] in "0123":
            sections.append(_sha(section))
            section = ""
    sections += [_sha(section)] if section else []
    return _sha("".join(sections)), pieces


def fingerprints(docs):
    """(doc, text) with distinct doc_ids -> doc, n_chars, digest of the edited text, both roots, both likenesses."""
    docs = sorted(((d, t or "") for d, t in docs), key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)

    def near(a, b):
        (r, x), (s, y) = tree(a), tree(b)
        return 1.0 if r == s else round(2 * len(x & y) / (len(x) + len(y)), 6) if x or y else 0.0

    out = []
    for i, (doc, text) in enumerate(docs):
        after = docs[(i + 1) % len(docs)][1]
        k = len(text) // 3
        edited = text[: len(text) - k] + after[:k]
        out.append((doc, len(text), _sha(edited), tree(text)[0], tree(edited)[0], near(text, edited), near(text, after)))
    return sorted(out, key=str)
