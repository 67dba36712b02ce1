"""Plain versions of the operators' results, by the rules alone."""

from __future__ import annotations

import collections
import hashlib
import math
import re

import numpy as np
import xxhash

WHITE = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def decontaminate(docs, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = collections.defaultdict(set)
    for i, t in items:
        w = word.findall(lower(t))
        n = min(13, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[j:j + n])].add(str(i))
    sizes = {len(w) for w in windows}
    out = []
    for d, t in docs:
        w = word.findall(lower(t))
        hit, found = set(), set()
        for n in sizes:
            for j in range(len(w) - n + 1):
                if x := windows.get(tuple(w[j:j + n])):
                    hit.update(range(j, j + n))
                    found |= x
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found))), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def simhash_groups(rows):
    """Fingerprint and component of each row."""
    fps = []
    for _, t in rows:
        w = WHITE.findall(lower(t))
        shingles = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    distinct = sorted(set(fps))
    a, group = np.array(distinct, np.uint64), list(range(len(distinct)))
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 2).tolist():
            x, y = group[i], group[j]
            if x != y:
                group = [x if g == y else g for g in group]
    of = dict(zip(distinct, group, strict=True))
    return [(f, of[f]) for f in fps]


def simhash(rows):
    found, least = simhash_groups(rows), {}
    for (d, _), (_, g) in zip(rows, found, strict=True):
        if d is not None:
            least[g] = min(d, least.get(g, d))
    return [(d, f"{f:016x}", least.get(g)) for (d, _), (f, g) in zip(rows, found, strict=True)]


def chunk_dedup(rows, gear):
    def chunks(t):
        b, out, begin = (t or "").encode(), [], 0
        while len(b) - begin > 24:
            end = None
            for p in range(begin + 24, min(len(b), begin + 256)):
                h = 0
                for q in range(p - 16, p):
                    h = (2 * h + int(gear[b[q]])) & 0xFFFF
                if h & 0xF800 == 0 and b[p] & 0xC0 != 0x80:
                    end = p
                    break
            if end is None:
                end = min(len(b), begin + 256)
                while end < len(b) and b[end] & 0xC0 == 0x80:
                    end -= 1
            out.append(b[begin:end])
            begin = end
        return out + [b[begin:]] * (begin < len(b))

    def key(d):
        return math.inf if d is None else d

    cut, least = [chunks(t) for _, t in rows], {}
    for (d, _), c in zip(rows, cut, strict=True):
        for x in c:
            least[x] = min(least.get(x, math.inf), key(d))
    out = []
    for (d, t), c in zip(rows, cut, strict=True):
        seen, flags = set(), []
        for x in c:
            flags.append(x in seen or least[x] < key(d))
            seen.add(x)
        kept, gone, spans, i = [], 0, 0, 0
        while i < len(c):
            j = i
            while j < len(c) and flags[j] == flags[i]:
                j += 1
            run = b"".join(c[i:j])
            if flags[i] and len(run) >= 96:
                gone, spans = gone + len(run), spans + 1
            else:
                kept.append(run)
            i = j
        out.append((d, len((t or "").encode()), len(c), gone, spans, sha(b"".join(kept))))
    return out


def suffix_dedup(rows):
    texts, count = [(t or "").encode() for _, t in rows], collections.Counter()
    for b in texts:
        count.update(b[i:i + 200] for i in range(len(b) - 199))
    out = []
    for (d, _), b in zip(rows, texts, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if count[b[i:i + 200]] > 1:
                gone[i:i + 200] = b"\1" * 200
        spans = sum(x and not (i and gone[i - 1]) for i, x in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, sha(bytes(x for x, y in zip(b, gone, strict=True) if not y))))
    return out


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
       "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
KINDS = [*PII, "term"]


def luhn(number):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(number[::-1])]
    return sum(d if d < 10 else d - 9 for d in doubled) % 10 == 0


def pii_base(t):
    out = []
    for k, (kind, pattern) in enumerate(PII.items()):
        for m in re.finditer(pattern, t or ""):
            number = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind != "ip" or all(len(p.lstrip("0")) < 4 and int(p[-3:]) <= 255 for p in m[0].split(".")),
                    "card": 12 <= len(number) <= 19 and luhn(number), "phone": 9 <= len(number) <= 15}[kind]
            if good:
                out.append((m.start(), k, m.end(), m[0].lower() if kind == "email" else m[0] if kind == "ip" else number))
    return sorted(out)


def pii_spans(rows):
    """(base spans, all spans) of each row, as (start, kind, end)."""
    total, base = len(rows), [pii_base(t) for _, t in rows]
    words = [[(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"\w+", t or "")] for _, t in rows]
    free = [[x for x in w if not any(x[1] > p and x[0] < q for p, _, q, _ in b)] for w, b in zip(words, base, strict=True)]
    seen = collections.Counter(w for x in words for w in {w for _, _, w in x})
    held = collections.Counter(e for b in base for e in {(k, v) for _, k, _, v in b})
    held = {e: n for e, n in held.items() if 1 < n < total}
    terms = [{w for _, _, w in x} for x in free]
    tested = max(total, len(held) * len(set().union(*(t for t, b in zip(terms, base, strict=True) if b))))
    both = collections.Counter((t, e) for ts, b in zip(terms, base, strict=True) for e in {(k, v) for _, k, _, v in b} if e in held
                               for t in ts)

    def apart(x, n, q):
        a = x / n
        return n * (a * math.log(a / q) + ((1 - a) * (math.log(1 - a) - math.log(1 - q)) if a < 1 else 0))

    flagged = {t for (t, e), x in both.items()
               if x > 1 and math.log(total * x / (seen[t] * held[e])) >= .9 * math.log(total / held[e])
               and max(apart(x, held[e], seen[t] / total) if seen[t] < total else 0, apart(x, seen[t], held[e] / total)) >= math.log(tested / .01)}
    return [([x[:3] for x in b], sorted({x[:3] for x in b} | {(s, 4, e) for s, e, w in f if w in flagged}))
            for b, f in zip(base, free, strict=True)]


def told(spans):
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def pii(rows):
    return [(d, *(sum(x[1] == k for x in base) for k in range(4)), sha(told(base)), told(spans))
            for (d, _), (base, spans) in zip(rows, pii_spans(rows), strict=True)]


def sanitised(rows):
    out = []
    for (_, t), (_, spans) in zip(rows, pii_spans(rows), strict=True):
        done, parts = 0, []
        for s, k, e in spans:
            if s >= done:
                parts += [t[done:s], "[NUMBER]" if k == 4 and t[s:e].isdigit() else f"[{KINDS[k].upper()}]"]
            done = max(done, e)
        out.append("".join(parts) + t[done:] if t else t)
    return out


def ways(word, vocab):
    """All segmentations; a character that is no piece stands alone (None)."""
    if not word:
        yield []
    for i in range(1, len(word) + 1):
        if word[:i] in vocab or i == 1:
            yield from ([word[:i] if word[:i] in vocab else None, *rest] for rest in ways(word[i:], vocab))


def log_sum(xs):
    top = max(xs, default=-math.inf)
    return top if top == -math.inf else top + math.log(sum(math.exp(x - top) for x in xs))


def word_sum(word, log_piece):
    """Logarithm of the sum over all segmentations, by the words' ends."""
    sums = [0.0]
    for j in range(1, len(word) + 1):
        sums.append(log_sum([sums[i] + x for i in range(max(0, j - 16), j) if (x := log_piece(word[i:j])) is not None]))
    return sums


def languages(rows, labelled, vocab):
    """(lang_pred, score) of each text: all segmentations, listed for short words and summed up by their ends for others."""
    word = re.compile(r"[^\W\d_]+")
    words = collections.defaultdict(collections.Counter)
    for t, lang in labelled:
        if lang is not None:
            words[lang].update(word.findall((t or "").lower()))
    uses = {k: collections.Counter() for k in words}

    def eighth(p):
        return math.log(1 / 8) if p in vocab or len(p) == 1 else None

    seen = {}
    for w in set().union(*words.values()):
        mine = seen[w] = collections.Counter()
        if len(w) <= 9:
            total = sum(8.0 ** -len(x) for x in ways(w, vocab))
            for x in ways(w, vocab):
                for p in filter(None, x):
                    mine[p] += 8.0 ** -len(x) / total
        else:
            ahead, back = word_sum(w, eighth), word_sum(w[::-1], lambda p: eighth(p[::-1]))[::-1]
            for i in range(len(w)):
                for j in range(i + 1, min(len(w), i + 16) + 1):
                    if w[i:j] in vocab:
                        mine[w[i:j]] += math.exp(ahead[i] + eighth(w[i:j]) + back[j] - back[0])
    for lang, counts in words.items():
        for w, n in counts.items():
            for p, x in seen[w].items():
                uses[lang][p] += n * x
    langs = sorted(k for k in uses if uses[k])
    smooth = {k: {p: round(uses[k][p], 4) + .05 for p in vocab} for k in langs}
    total = {k: sum(smooth[k].values()) for k in langs}
    prob = {k: {p: math.log(x / total[k]) for p, x in smooth[k].items()} for k in langs}
    alone = min([x for k in langs for x in prob[k].values()], default=0) + math.log(.1)
    known = {}
    for _, t in rows:
        found = word.findall((t or "").lower())
        if not found or not langs:
            yield "und", 0.0
            continue
        for w in set(found) - known.keys():
            known[w] = [word_sum(w, lambda p, k=k: prob[k].get(p, alone if len(p) == 1 else None))[-1] for k in langs]
        log = [sum(x) for x in zip(*(known[w] for w in found), strict=True)]
        top = max(log)
        yield langs[log.index(top)], 1 / sum(math.exp((x - top) * min(1, 20 / len(found))) for x in log)


def quality(t):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    t = t or ""
    w = WHITE.findall(t)
    lines = [x for x in t.split("\n") if WHITE.search(x)]
    windows = collections.Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    again = {j for i in range(len(w) - 7) if windows[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again),
            len(w) < 20 or 100 * len(again) > 30 * len(w))


def search(rows, items, k=50):
    """Scores of all documents for all items, one by one."""
    import math
    word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

    def of(t):
        return word.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))

    docs = [(d, collections.Counter(of(t))) for d, t in rows]
    docs = [(d, c, c.total()) for d, c in docs if c]
    n, total = len(docs), sum(x for _, _, x in docs)
    df = collections.Counter(w for _, c, _ in docs for w in c)
    for item, text in set(items):
        found = []
        for d, c, x in docs:
            m = 100 - 50 + (50 * x * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10 ** 9 * c[w]) // (1000 * c[w] + 20 * m))
                        for w in set(of(text)) if c[w])
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        for i, (s, _, _, d) in enumerate(sorted(found)[:k]):
            yield (item, i + 1, d, -s)


def mix_targets(sizes):
    """Target of each source: shares by weight, capped, the excess of the capped shared again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    out, open_, left = {}, set(order), sum(sizes.values())
    while open_:
        share = left / (sum(weight[s] for s in open_) or 1)
        over = {s for s in open_ if 3 * sizes[s] <= weight[s] * share}
        for s in over or open_:
            out[s] = 3 * sizes[s] if over else weight[s] * share
        left -= sum(3 * sizes[s] for s in over)
        open_ = open_ - over if over else set()
    return out


def repair(rows):
    """Faults, and the least (cost, audit) over all ways, from the end backwards."""
    import zlib
    convs, ids = collections.defaultdict(list), {r[0] for r in rows}
    for c, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            convs[c] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for c in ids:
        own = sorted(convs[c], key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, seen = [], set()
        for _, role, text in own:
            bare = text.rstrip(" \t\n\x0b\f\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else None if bare[-1] in ".!?" else "truncated")
            seen.add((role, text))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [role[:1] or " " for _, role, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
        best = {s: (0, "", ()) if s in ("", "a") else (10 ** 9, "", ()) for s in ("", "s", "u", "a")}

        def inserted(best):
            for _ in range(4):
                for s in best:
                    for one, role in (("u", "user"), ("a", "assistant")):
                        if (s, one) in step:
                            cost, audit, out = best[step[s, one]]
                            best[s] = min(best[s], (cost + 2, "I" + audit, ((role, ""),) + out), key=lambda x: x[:2])
            return best

        best = inserted(best)
        for (_, role, text), fault, one in reversed(list(zip(own, faults, initials))):
            now = {}
            for s in best:
                ways = [(best[s][0] + 3, "D" + best[s][1], best[s][2])]
                if fault in (None, "truncated"):
                    extra = fault is not None
                    for to, cost, letter, name in ((one, 0, "K", role), ("u", 2, "R", "user"), ("a", 2, "R", "assistant")):
                        if (s, to) in step:
                            x = best[step[s, to]]
                            ways.append((x[0] + cost + extra, letter + x[1], ((name, text),) + x[2]))
                now[s] = min(ways, key=lambda x: x[:2])
            best = inserted(now)
        cost, audit, out = best[""]
        yield (c, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
               sha("\n".join(f"{r}:{t}" for r, t in out)))
