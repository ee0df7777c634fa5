"""The operators' results in plain Python, without their methods: pairwise comparison, dictionaries, whole-text scans."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

EMPTY = hashlib.sha256(b"").hexdigest()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def pieces(docs, capacity=1024):
    """{(doc_id, piece): (start, length, crc)} of (doc_id, text)."""
    import public_tokenizers
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    out = {}
    for doc_id, text in docs:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 2]
        head = len(ids) % capacity or min(len(ids), capacity)
        cuts = [0, *range(head, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            out[doc_id, k] = (a, b - a, zlib.crc32(np.asarray(ids[a:b], dtype="<u4").tobytes()))
    return out


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text or ""))


def contamination(docs, items, window=10):
    """[(doc_id, n_words, n_hit, items)]"""
    owners = defaultdict(set)
    for item, text in items:
        w = bench_words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            owners[tuple(w[i:i + n])].add(str(item))
    sizes = {len(k) for k in owners}
    out = []
    for doc_id, text in docs:
        w, hit, found = bench_words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in owners:
                    hit |= set(range(i, i + n))
                    found |= owners[tuple(w[i:i + n])]
        out.append((doc_id, len(w), len(hit), sorted(found)))
    return out


ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets(text):
    """[(start, kind number, kind, end)]"""
    text = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found)


def blank_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)"""
    words = blank_words(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    repeated = {j for i, w in enumerate(windows) if counts[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if blank_words(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated),
            len(words) < 50 or 100 * len(repeated) > 50 * len(words))


def warc(pages):
    """{page_id: (bytes, digest, type, refers_to)} for distinct ids"""
    payload = {p: (h or "").encode() for p, h in pages}
    first = {}
    for p in sorted(payload):
        first.setdefault(payload[p], p)
    return {p: (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if first[b] == p else "revisit", None if first[b] == p else first[b])
            for p, b in payload.items()}


def chats(turns):
    """{conv_id: (n_turns, turns_sha, loss_chars, loss_sha)} of (conv_id, turn, role, text)"""
    by = defaultdict(list)
    for c, t, r, x in turns:
        by[c].append((t, r or "", x or ""))
    out = {}
    for c, rows in by.items():
        rows.sort()
        loss = "".join(x for _, r, x in rows if r == "assistant")
        out[c] = (len(rows), sha("".join(f"{r}\n{x}\n" for _, r, x in rows)), len(loss), sha(loss))
    return out


def shingle_set(text, size):
    words = blank_words(ascii_lower(text or ""))
    if not words:
        return frozenset()
    size = min(size, len(words))
    return frozenset(tuple(words[i:i + size]) for i in range(len(words) - size + 1))


def near(docs, size=3, percent=85):
    """{doc_id: (n_shingles, component_id)} for distinct ids, from an index of shingles and all pairs that share one"""
    sets = {d: shingle_set(t, size) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    by = defaultdict(list)
    for d in sorted(sets):
        common = Counter(o for s in sets[d] for o in by[s])
        for o, n in common.items():
            if 100 * n >= percent * (len(sets[d]) + len(sets[o]) - n):
                a, b = sorted((find(d), find(o)))
                root[b] = a
        for s in sets[d]:
            by[s].append(d)
    return {d: (len(sets[d]), find(d)) for d in sets}


def lines(docs, min_sites=3, min_words=3, max_share=0.5):
    """{doc_id: (text, removed)} of (doc_id, text, site), distinct ids"""
    sites, first = defaultdict(set), {}
    told = lambda x: x.strip(" \t\r\x0b\x0c")
    for d, t, s in sorted(docs, key=lambda r: r[0]):
        for i, x in enumerate((t or "").split("\n")):
            if len(blank_words(x)) >= min_words:
                sites[told(x)].add(s)
                first.setdefault(told(x), (d, i))
    out = {}
    for d, t, _ in docs:
        all_lines = (t or "").split("\n")
        gone = {i for i, x in enumerate(all_lines) if len(sites.get(told(x), ())) >= min_sites and first[told(x)] != (d, i)}
        share = sum(len(blank_words(all_lines[i])) for i in gone)
        if not gone or share > max_share * len(blank_words(t)):
            out[d] = (t, 0)
        else:
            out[d] = ("\n".join(x for i, x in enumerate(all_lines) if i not in gone), len(gone))
    return out


def negatives(rows, positives=5, count=3, low=50, high=95):
    """[(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)] of (id, label, vector) with whole numbers, every pair scored"""
    out = []
    for i, label, v in rows:
        if i is None or i % 50:
            continue
        scored = sorted(((-sum(map(int.__mul__, v, w)), j, k) for j, k, w in rows if (j, k, w) != (i, label, v)), key=lambda r: r[:2])
        for s, j, _ in [r for r in scored if r[2] == label][:positives]:
            fit = [r for r in scored if r[2] != label and low * -s <= 100 * -r[0] <= high * -s][:count]
            out += [(i, j, n, k, -s, -t) for n, (t, k, _) in enumerate(fit, 1)]
    return out


def damage(rows):
    """(conv_id, turn, role, text) rows after the damage"""
    told = lambda x: " " if x is None else x
    out = []
    for c, t, role, text in rows:
        kind, role, text = zlib.crc32(f"{told(c)}:{told(t)}".encode()) % 20, told(role), told(text)
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(c, t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


STEPS = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
THEN = {"": ("u", "user"), "s": ("u", "user"), "u": ("a", "assistant"), "a": ("u", "user")}


def repair(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, sha) of one conversation's (turn, role, text), in order; the best of all edits"""
    marks, seen = [], set()
    for _, role, text in rows:
        visible = re.findall(r"[^\x20\x09-\x0D]", text)
        marks.append("blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else "")
        seen.add((role, text))
    best = {s: (0, "", ()) if s in ("", "a") else (99, "~", ()) for s in THEN}

    def inserts(best):
        for _ in range(4):
            for s, (to, role) in THEN.items():
                c, audit, told = best[to]
                best[s] = min(best[s], (c + 2, "I" + audit, (f"{role}:", *told)))
        return best
    best = inserts(best)
    for (_, role, text), mark in zip(reversed(rows), reversed(marks)):
        now = {}
        for s, (to, name) in THEN.items():
            ways = [(best[s][0] + 3, "D" + best[s][1], best[s][2])]
            if mark not in ("blank", "duplicate"):
                late = mark == "truncated"
                ways.append((best[to][0] + 2 + late, "R" + best[to][1], (f"{name}:{text}", *best[to][2])))
                if (s, role[:1]) in STEPS:
                    c, audit, told = best[STEPS[s, role[:1]]]
                    ways.append((c + late, "K" + audit, (f"{role}:{text}", *told)))
            now[s] = min(ways)
        best = inserts(now)
    turns = {t for t, _, _ in rows if t is not None}
    wrong = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, told = best[""]
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[marks.count(m) for m in ("blank", "duplicate", "truncated")], wrong, cost, audit, sha("\n".join(told)))


def repairs(rows):
    """{conv_id: repair(...)} of undamaged (conv_id, turn, role, text)"""
    by = {c: [] for c, *_ in rows}
    for c, t, role, text in damage(rows):
        by[c].append((t, role, text))
    return {c: repair(sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))) for c, r in by.items()}


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def personal(text):
    """[(start, kind number, kind, end)]"""
    text = text or ""
    n_digits = lambda x: len(re.sub("[^0-9]", "", x))
    found = [(m.start(), 0, "email", m.end()) for m in EMAIL.finditer(text)]
    found += [(m.start(), 1, "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [(m.start(), 2, "card", m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text)
              if 14 <= n_digits(m[0]) <= 19 and luhn(re.sub("[^0-9]", "", m[0]))]
    found += [(m.start(), 3, "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= n_digits(m[0]) <= 15]
    return sorted(found)
