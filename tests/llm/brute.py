"""Plain-Python forms of the pipeline's stages, row by row and pair by pair."""

import datetime
import hashlib
import math
from collections import Counter, defaultdict

import regex

from telemill.llm import pii, toxicity

# --- pseudonyms ------------------------------------------------------------------------------------------------------


def _round(secret, kind, i, half):
    return hashlib.sha256(f"{secret}|{kind}|{i}|{half}".encode()).hexdigest()


def permuted(a, b, size_a, size_b, secret, kind):
    for i in range(8):
        if i % 2 == 0:
            a = (a + int(_round(secret, kind, i, b)[:14], 16)) % size_a
        else:
            b = (b + int(_round(secret, kind, i, a)[:14], 16)) % size_b
    return a, b


def _digits(text, secret, kind):
    low = len(text) // 2
    high = len(text) - low
    a, b = permuted(int(text[:high]), int(text[high:]), 10**high, 10**low, secret, kind)
    return f"{a:0{high}d}{b:0{low}d}"


def _refilled(pattern, digits):
    rest = iter(digits)
    return "".join(next(rest) if c in "0123456789" else c for c in pattern)


def _only(text):
    return "".join(c for c in text if c in "0123456789")


def _luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10


def _card(m, secret):
    d = _only(m)
    if _luhn(d):
        return m
    body = d[0] + _digits(d[1:-1], secret, "card")
    return _refilled(m, body + next(c for c in "0123456789" if _luhn(body + c) == 0))


def _ssn(m, secret):
    area, group, serial = map(int, m.split("-"))
    areas = [x for x in range(1, 900) if x != 666]
    if area not in areas or not group or not serial:
        return m
    a, b = permuted(areas.index(area), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, secret, "ssn")
    return f"{areas[a]:03d}-{b // 9999 + 1:02d}-{b % 9999 + 1:04d}"


def _phone(m, secret):
    d = _only(m)
    a, b = permuted(int(d[-10:-7]) - 200, (int(d[-7:-4]) - 200) * 10000 + int(d[-4:]), 800, 8_000_000, secret, "phone")
    return _refilled(m, f"{d[:-10]}{a + 200}{b // 10000 + 200}{b % 10000:04d}")


def _any_phone(m, secret):
    d, code = _only(m), len(regex.match(r"\+(\d{1,3})", m)[1])
    return _refilled(m, d[:code] + _digits(d[code:], secret, "number")) if 8 <= len(d) <= 15 else m


def _address(m, secret):
    o = list(map(int, m.split(".")))
    a, b = permuted(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, secret, "ipv4")
    return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"


def _day(*parts):
    try:
        return datetime.date(*map(int, parts))
    except ValueError:
        return None


#: All days from 1800 to 2199, those to the twelfth of a month and those after it; the place of each in its list.
_EVERY = [datetime.date(1800, 1, 1) + datetime.timedelta(days=k) for k in range(146_097)]
_DAYS = [[d for d in _EVERY if (d.day > 12) == late] for late in (False, True)]
_PLACE = {d: k for days in _DAYS for k, d in enumerate(days)}


def _date(m, secret):
    parts, sign = regex.split(r"[-/.]", m), regex.search(r"[-/.]", m)[0]
    iso = len(parts[0]) == 4
    day_first = None if iso else _day(parts[2], parts[1], parts[0])
    day = _day(*parts) if iso else day_first or _day(parts[2], parts[0], parts[1])
    if day not in _PLACE:
        return m
    days, k = _DAYS[day.day > 12], _PLACE[day]
    size_b = 9833 if day.day > 12 else 12
    a, b = permuted(k // size_b, k % size_b, len(days) // size_b, size_b, secret, "date")
    new = days[a * size_b + b]
    if iso:
        return new.isoformat().replace("-", sign)
    both = (new.day, new.month) if day_first else (new.month, new.day)
    full = [p.startswith("0") or min(map(len, parts[:2])) == 2 for p in parts[:2]]
    return sign.join([f"{x:02d}" if f else str(x) for x, f in zip(both, full, strict=True)] + [str(new.year)])


def _mail(m, secret):
    local, domain = m.split("@")
    half = math.ceil(len(local) / 2)
    sides = [local[:half], local[half:]]

    def turned(c, k):
        for base, n in (("a", 26), ("A", 26), ("0", 10)):
            if 0 <= ord(c) - ord(base) < n:
                return chr(ord(base) + (ord(c) - ord(base) + k) % n)
        return c

    for i in range(8):
        pad = _round(secret, "mail", i, sides[1 - i % 2])
        sides[i % 2] = "".join(turned(c, int(pad[j * 2 % 64 :][:2], 16)) for j, c in enumerate(sides[i % 2]))
    return f"{sides[0]}{sides[1]}@{domain}"


_ANY = regex.compile(pii.ANY, regex.ASCII)
_KINDS = [(regex.compile(p, regex.ASCII), f) for p, f in ((pii.IPV4, _address), (pii.DATE, _date), (pii.SSN, _ssn), (pii.PHONE, _phone))]


def pseudonymised(text, secret):
    """(text, number of values replaced)."""
    changed = 0

    def one(match):
        nonlocal changed
        m = match[0]
        f = _mail if "@" in m else next((f for p, f in _KINDS if p.fullmatch(m)), _any_phone if m.startswith("+") else _card)
        new = f(m, secret)
        changed += new != m
        return new

    return _ANY.sub(one, text), changed


# --- the other stages ------------------------------------------------------------------------------------------------


def logit(text, model):
    """Score of the distinct n-grams of a text under a classifier's weights."""
    code, mask, buckets = [ord(c) for c in f" {text.lower()} "], 0xFFFFFFFF, set()
    for n in toxicity.ORDERS:
        for a in range(len(code) - n + 1):
            h = n * 0x3C6EF372 & mask
            for k in range(n):
                h = h + code[a + k] * int(toxicity._MULTIPLIERS[k]) & mask
                h ^= h >> 15
            buckets.add((h * 0x2C1B3C6D & mask) >> (33 - toxicity.BUCKETS.bit_length()))
    return model.intercept + sum(float(model.weights[b]) for b in buckets)


def without_boilerplate(rows, ratio=0.05, least=5):
    """rows (doc_id, text, source) without the lines that are on too many pages of their source."""
    pages, on = Counter(s for _, _, s in rows), Counter()
    for _, text, s in rows:
        on.update({(s, line.strip(" ")) for line in text.split("\n") if line.strip(" ")})
    gone = {k for k, n in on.items() if n >= least and pages[k[0]] >= least and n > pages[k[0]] * ratio}
    return [(i, "\n".join(line for line in text.split("\n") if (s, line.strip(" ")) not in gone), s) for i, text, s in rows]


def words_of(text):
    return text.encode().split()


def near_classes(rows):
    """Smallest doc_id of each row's class of near duplicates, by all pairs."""
    sets = {}
    for i, text, _ in rows:
        w = text.encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def best_fit(items, capacity):
    """Bins of items (length, source, cluster) in their order: the tightest without a conflict, the first to reach that residual."""
    bins, out = [], []
    for at, (n, s, c) in enumerate(items):
        fit = [b for b in bins if b["rest"] >= n and s not in b["s"] and c not in b["c"]]
        b = min(fit, key=lambda b: (b["rest"], b["at"])) if fit else None
        if b is None:
            b = {"k": len(bins), "rest": capacity, "s": set(), "c": set()}
            bins.append(b)
        b["rest"] -= n
        b["at"] = at
        b["s"] |= {s} - {None}
        b["c"] |= {c} - {None}
        out.append(b["k"])
    return out


def packed(rows, capacity):
    """(doc_id, piece, bin, place, length, text) of rows in one shard."""
    cluster = near_classes(rows)
    pieces = []
    for i, text, s in rows:
        starts = [m.start() for m in regex.finditer(r"[^\x20\x09-\x0D]+", text)]
        for p in range(-(-len(starts) // capacity)):
            a, b = p * capacity, min((p + 1) * capacity, len(starts))
            pieces.append((b - a, i, p, s, cluster[i], text[starts[a] if p else 0 : starts[b] if b < len(starts) else None]))
    pieces.sort(key=lambda x: (-x[0], x[1], x[2]))
    out, filled = [], defaultdict(int)
    for (n, i, p, *_, text), k in zip(pieces, best_fit([(n, s, c) for n, _, _, s, c, _ in pieces], capacity), strict=True):
        out.append((i, p, k, filled[k], n, text))
        filled[k] += n
    return out
