"""Personal data: exact patterns for four kinds, and a character-level BiLSTM with a CRF on top.

The patterns find the base spans.  The tagger reads every character of every text and adds spans in
forms that the patterns don't have: keys and tokens (kind ``secret``), phone numbers without their +,
cards with dots, addresses written with (at) and (dot), IPv6; it never changes a base span.

Texts are cut into windows of WINDOW characters that overlap by OVERLAP.  A character's emissions come
from the window in which it is most central; the tags are then decoded once for the whole text, so a
span may cross windows.  That decoding is exact: at a character where "outside" beats each other tag by
more than any transitions can make up, it is the tag of every best path (else that path would gain by
the exchange), so the stretches between such characters are decoded one by one.

The tagger is trained here, with numpy: on spans made from formats (a fixed seed) and on windows of at
most TRAIN_DOCS documents, TRAIN_WINDOWS in all (of those with base spans, the document with the least
hash of its id in each of TRAIN_DOCS buckets of that hash), whose base spans are the labels; windows
with other long runs of digits are left out, as nobody has labelled those.

Defined cases: a null or empty text has no spans; rows are judged one by one, so repeated rows
and null ids give a row each; other columns are ignored; without base spans the tagger learns from made
spans alone; an empty table gives an empty result.  Positions are code points, ends exclusive.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.tables import table

#: Kinds of the base patterns, and all kinds of the tagger.
KINDS = ("email", "ip", "card", "phone")
TAGGED = (*KINDS, "secret")
WINDOW, OVERLAP = 192, 32
TRAIN_DOCS, TRAIN_WINDOWS, MADE, TRAIN_WINDOW = 200, 2000, 2400, 64
HIDDEN, STEPS, BATCH = 12, 900, 64
#: Windows that are read at once; no result depends on it.
AT_ONCE = 512
#: Least mean posterior of a span that the tagger adds.
SURE = 0.9
#: Transition weights stay within this, which bounds what they can make up for.
MOST_TRANSITION = 0.4

# fixed values: the patterns of the four kinds
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _emails(text: str):
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns' matches, by start and then by kind as listed."""
    out = [(a, b, "email") for a, b in _emails(text)]
    if _DIGIT.search(text):
        if text.count(".") >= 3:
            out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(q := p.lstrip("0")) <= 3 and int(q or 0) <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
        if "+" in text:
            out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 10 <= len(_DIGIT.findall(m.group())) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def span_text(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


#: Tags: 0 outside, 1 + k inside kind k.
TAGS = 1 + len(TAGGED)
#: Classes: 0-25 letters whatever their case, 26 digits, then these, other ASCII, the rest, and what is beyond a text.
_MARKS = "@.-+() _%,:/\n#\"'=[]|"
CLASSES = 27 + len(_MARKS) + 3
PAD = CLASSES - 1


def _class_table() -> np.ndarray:
    table = np.full(129, CLASSES - 3, np.uint8)
    table[97:123] = table[65:91] = np.arange(26)
    table[48:58] = 26
    for i, c in enumerate(_MARKS):
        table[ord(c)] = 27 + i
    table[128] = CLASSES - 2
    return table


def classes(text: str) -> np.ndarray:
    """A class for each character."""
    return _class_table()[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 128)]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Tagger:
    """Emissions from two LSTMs (forward and backward) over character classes; transitions of a linear-chain CRF."""

    def __init__(self, seed: int = 5):
        rng = np.random.Generator(np.random.PCG64(seed))
        h = HIDDEN
        self.p = {}
        for d in "fb":
            self.p[f"x{d}"] = rng.normal(0, 0.3, (CLASSES, 4 * h))
            self.p[f"h{d}"] = rng.normal(0, 1 / np.sqrt(h), (h, 4 * h))
            self.p[f"c{d}"] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)])
            self.p[f"o{d}"] = rng.normal(0, 1 / np.sqrt(h), (h, TAGS))
        self.p["bias"] = np.zeros(TAGS)
        self.p["trans"] = np.zeros((TAGS, TAGS))
        # single precision is enough to train with, and twice as fast
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _lstm(self, x, d, keep=None):
        n, t = x.shape
        h = c = np.zeros((n, HIDDEN), np.float32)
        out = np.zeros((n, t, HIDDEN), np.float32)
        for i in range(t) if d == "f" else range(t - 1, -1, -1):
            z = self.p[f"x{d}"][x[:, i]] + h @ self.p[f"h{d}"] + self.p[f"c{d}"]
            g, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            u = np.tanh(z[:, 3 * HIDDEN :])
            before = (h, c)
            c = f * c + g * u
            tc = np.tanh(c)
            h = o * tc
            out[:, i] = h
            if keep is not None:
                keep.append((i, *before, g, f, o, u, tc))
        return out

    def emissions(self, x, keep=None):
        hf, hb = (self._lstm(x, d, None if keep is None else keep.setdefault(d, [])) for d in "fb")
        if keep is not None:
            keep["hf"], keep["hb"] = hf, hb
        return hf @ self.p["of"] + hb @ self.p["ob"] + self.p["bias"]

    def scan(self, x: np.ndarray) -> np.ndarray:
        """The emissions again, in single precision and without what training needs; x: classes, steps first."""
        t, n = x.shape
        x = x.astype(np.intp)
        out = np.zeros((t * n, TAGS), np.float32)
        half = np.repeat(np.array([0.5, 1], np.float32), [3 * HIDDEN, HIDDEN])  # a sigmoid is a tanh of half its argument

        def by_gate(v):
            return np.ascontiguousarray((v * half).astype(np.float32).reshape(-1, 4, HIDDEN).transpose(1, 0, 2))

        # each gate has its own block of memory, which makes the steps between the products one run each
        z, add = np.empty((4, n, HIDDEN), np.float32), np.empty((4, n, HIDDEN), np.float32)
        hs = np.empty((t, n, HIDDEN), np.float32)
        gates = z[:3]
        for d in "fb":
            own, w = by_gate(self.p[f"x{d}"] + self.p[f"c{d}"]), by_gate(self.p[f"h{d}"])
            h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
            for i in range(t) if d == "f" else range(t - 1, -1, -1):
                np.matmul(h, w, out=z)
                # classes are never out of range; without "clip" take copies its result
                np.take(own, x[i], axis=1, out=add, mode="clip")
                z += add
                np.tanh(z, out=z)
                gates *= 0.5
                gates += 0.5
                c *= z[1]
                z[3] *= z[0]
                c += z[3]
                h = hs[i]
                np.tanh(c, out=h)
                h *= z[2]
            out += hs.reshape(t * n, HIDDEN) @ self.p[f"o{d}"].astype(np.float32)
        out += self.p["bias"].astype(np.float32)
        return out.reshape(t, n, TAGS)

    def _forward_backward(self, e):
        n, t, k = e.shape
        a, b = np.zeros_like(e), np.zeros_like(e)
        tr = self.p["trans"]

        def lse(v, axis):
            m = v.max(axis=axis, keepdims=True)
            return np.squeeze(m, axis) + np.log(np.exp(v - m).sum(axis=axis))

        a[:, 0] = e[:, 0]
        for i in range(1, t):
            a[:, i] = e[:, i] + lse(a[:, i - 1, :, None] + tr, 1)
        for i in range(t - 2, -1, -1):
            b[:, i] = lse(tr + (e[:, i + 1] + b[:, i + 1])[:, None, :], 2)
        return a, b, lse(a[:, -1], 1)

    def viterbi(self, e: np.ndarray) -> np.ndarray:
        """The best tags of emissions (n, t, TAGS)."""
        n, t, _ = e.shape
        best, back = e[:, 0], np.zeros(e.shape, np.int64)
        for i in range(1, t):
            s = best[:, :, None] + self.p["trans"]
            back[:, i] = s.argmax(axis=1)
            best = s.max(axis=1) + e[:, i]
        path = np.zeros((n, t), np.int64)
        path[:, -1] = best.argmax(axis=1)
        for i in range(t - 1, 0, -1):
            path[:, i - 1] = back[np.arange(n), i, path[:, i]]
        return path

    def decode(self, e: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tags, posteriors of these tags) of texts whose emissions follow one another; ends: where each text ends.

        Only stretches between characters that are outside in any best path are looked at, in groups of
        about equal length; what is before and after a stretch is such a character, or nothing.
        """
        tr = self.p["trans"]
        makes_up = np.array([max(tr[a, k] + tr[k, b] - tr[a, 0] - tr[0, b] for a in range(TAGS) for b in range(TAGS)) for k in range(TAGS)])
        # a text's first and last character have one transition only
        makes_up = np.maximum(makes_up, np.maximum((tr[:, :] - tr[:, :1]).max(axis=0), (tr - tr[:1]).max(axis=1)))
        open_ = np.zeros(len(e), bool)
        for i in range(0, len(e), 1 << 14):
            part = e[i : i + (1 << 14)]
            for k in range(1, TAGS):
                # a little more than what may be made up for, as these are single precision
                open_[i : i + (1 << 14)] |= part[:, k] + np.float32(makes_up[k] + 1e-3) >= part[:, 0]
        tags, sure = np.zeros(len(e), np.int64), np.ones(len(e))
        first, last = np.zeros(len(e), bool), np.zeros(len(e), bool)
        last[ends[ends > 0] - 1] = True
        first[0:1] = True
        first[1:] = last[:-1]
        starts = np.flatnonzero(open_ & (first | ~np.concatenate([[False], open_[:-1]])))
        stops = np.flatnonzero(open_ & (last | ~np.concatenate([open_[1:], [False]]))) + 1
        order = np.argsort(stops - starts, kind="stable")
        a = 0
        while a < len(order):
            size = int((stops - starts)[order[a]])
            b = a + 1
            while b < len(order) and b - a < 4096 and (stops - starts)[order[b]] <= size + size // 8:
                b += 1
            run = order[a:b]
            t = int((stops - starts)[run].max())
            at = starts[run][:, None] + np.arange(t)
            inside = at < stops[run][:, None]
            own = e[np.minimum(at, len(e) - 1)].astype(np.float64)
            own[:, 0] += np.where(first[starts[run]][:, None], 0, tr[0])
            ends_at = (stops - starts)[run] - 1
            own[np.arange(len(run)), ends_at] += np.where(last[stops[run] - 1][:, None], 0, tr[:, 0])
            # beyond its end a stretch is outside, at no cost
            own[~inside] = -1e9
            own[~inside, 0] = 0
            past = np.zeros((len(run), TAGS))
            past[ends_at < t - 1] = -tr[:, 0]
            own[np.arange(len(run)), ends_at] += past
            beyond = np.where(inside.sum(axis=1) < t, t - 1 - ends_at, 1) - 1
            own[np.arange(len(run)), t - 1, 0] += np.where(inside[:, -1], 0, -tr[0, 0] * beyond)
            path = self.viterbi(own)
            tags[at[inside]] = path[inside]
            some = np.flatnonzero((path > 0).any(axis=1))
            if len(some):
                x, y, z = self._forward_backward(own[some])
                p = np.take_along_axis(np.exp(x + y - z[:, None, None]), path[some][:, :, None], 2)[:, :, 0]
                sure[at[some][inside[some]]] = p[inside[some]]
            a = b
        return tags, sure

    def gradient(self, x, y):
        keep: dict = {}
        e = self.emissions(x, keep)
        a, b, z = self._forward_backward(e)
        n, t, k = e.shape
        de = np.exp(a + b - z[:, None, None])
        tr = self.p["trans"]
        g = {name: np.zeros_like(v) for name, v in self.p.items()}
        for i in range(1, t):
            joint = np.exp(a[:, i - 1, :, None] + tr + (e[:, i] + b[:, i])[:, None, :] - z[:, None, None])
            g["trans"] += joint.sum(axis=0)
            np.subtract.at(g["trans"], (y[:, i - 1], y[:, i]), 1)
        de[np.arange(n)[:, None], np.arange(t), y] -= 1
        g["bias"] = de.sum(axis=(0, 1))
        eye = np.eye(CLASSES, dtype=np.float32)
        for d in "fb":
            hs = keep["h" + d]
            g["o" + d] = np.einsum("nth,ntk->hk", hs, de)
            dhs = de @ self.p["o" + d].T
            dh = dc = np.zeros((n, HIDDEN), np.float32)
            for i, h0, c0, gi, f, o, u, tc in reversed(keep[d]):
                dh = dh + dhs[:, i]
                dc = dc + dh * o * (1 - tc * tc)
                dz = np.concatenate([dc * u * gi * (1 - gi), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * gi * (1 - u * u)], axis=1)
                g["x" + d] += eye[x[:, i]].T @ dz
                g["h" + d] += h0.T @ dz
                g["c" + d] += dz.sum(axis=0)
                dh, dc = dz @ self.p["h" + d].T, dc * f
        return {name: v / n for name, v in g.items()}

    def fit(self, x, y, steps: int = STEPS):
        """Adam over random batches with a fixed seed."""
        rng = np.random.Generator(np.random.PCG64(9))
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        for i in range(1, steps + 1):
            at = rng.integers(0, len(x), BATCH)
            for k, v in self.gradient(x[at], y[at]).items():
                v = np.clip(v, -5, 5)
                m[k], s[k] = 0.9 * m[k] + 0.1 * v, 0.99 * s[k] + 0.01 * v * v
                self.p[k] -= 0.02 * min(1, 2 - 2 * i / (steps + 1)) * (m[k] / (1 - 0.9**i)) / (np.sqrt(s[k] / (1 - 0.99**i)) + 1e-8)
            self.p["trans"] = np.clip(self.p["trans"], -MOST_TRANSITION, MOST_TRANSITION)
        return self


def made_texts(n: int = MADE, seed: int = 21) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Texts with labelled spans in many formats, and texts with numbers that are none."""
    rng = np.random.Generator(np.random.PCG64(seed))
    pick = lambda *xs: xs[int(rng.integers(len(xs)))]
    some = lambda letters, k: "".join(letters[c] for c in rng.integers(0, len(letters), k))
    digits = lambda k: some("0123456789", k)
    hexes = lambda k: some("0123456789abcdef", k)
    mixed = lambda k: some("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k)
    word = lambda: some(pick("etaoinshrdlu", "etaoinshrdlu", "abcdefghijklmnopqrstuvwxyz", "éèêñöüßaeiorst"), int(rng.integers(2, 11)))

    def card() -> str:
        body = pick("4", "5") + digits(14)
        last = next(str(d) for d in range(10) if luhn(body + str(d)))
        d = body + last
        return pick(d, d, f"{d[:4]} {d[4:8]} {d[8:12]} {d[12:]}", f"{d[:4]}-{d[4:8]}-{d[8:12]}-{d[12:]}", f"{d[:4]}.{d[4:8]}.{d[8:12]}.{d[12:]}", f"{d[:4]}/{d[4:8]}/{d[8:12]}/{d[12:]}")

    def secret() -> str:
        k = int(rng.integers(20, 64))
        return pick(hexes(40), hexes(40), hexes(32), hexes(k), mixed(k), mixed(k), f"AKIA{some('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 16)}", f"ghp_{mixed(36)}", f"sk-{mixed(k)}", f"{hexes(8)}-{hexes(4)}-{hexes(4)}-{hexes(4)}-{hexes(12)}")

    name = lambda: f"{word()}{pick('', '.' + digits(2), '_' + word(), '.' + word())}"
    site = lambda: f"{word()}{pick('', digits(1))}.{pick('com', 'org', 'example.com', 'net', 'de')}"
    made = {
        "email": lambda: pick(f"{name()}@{site()}", f"{name()}@{site()}", f"{name()} {pick('(at)', '[at]')} {site()}", f"{word()} (at) {word()} (dot) {pick('com', 'org', 'net')}", f"{name()} @ {site()}"),
        "ip": lambda: pick(".".join(str(v) for v in rng.integers(0, 256, 4)), ".".join(str(v) for v in rng.integers(0, 256, 4)), ":".join(hexes(int(rng.integers(2, 5))) for _ in range(8)), f"{hexes(4)}:{hexes(3)}::{hexes(2)}:{hexes(4)}"),
        "card": card,
        "phone": lambda: pick(f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"+{digits(2)} {digits(3)} {digits(3)} {digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}", f"0{digits(3)} {digits(3)} {digits(4)}"),
        "secret": secret,
    }
    before = {"secret": ("token = \"", "key: ", "password=", "api_key = '", "secret: \"", "token=", "TOKEN = \"", " ", " ")}
    none = (
        lambda: digits(int(rng.integers(1, 5))), lambda: f"{digits(1)}.{digits(1)}.{digits(1)}", lambda: f"{digits(4)}-{digits(2)}-{digits(2)}", lambda: f"${digits(3)}.{digits(2)}",
        lambda: digits(int(rng.integers(20, 30))), lambda: f"{digits(2)}:{digits(2)}:{digits(2)}", lambda: f"@{word()}", lambda: f"{word()}{digits(2)}", lambda: f"{digits(1)},{digits(3)},{digits(3)}",
        lambda: f"{word()} at {word()} dot {word()}", lambda: "".join(word() for _ in range(4)), lambda: f"https://{site()}/{word()}/{digits(4)}", lambda: f"{word()} = \"{word()} {word()}\"", lambda: f"{word()}_{word()}_{word()}",
    )
    out = []
    for i in range(n):
        kind = TAGGED[i % len(TAGGED)] if i % 3 else None
        middle = made[kind]() if kind else pick(*none)()
        lead = pick(*before.get(kind, (" ", " ", "\n", ": ", " (", "*** ", " | ")))
        left = " ".join(word() for _ in range(int(rng.integers(1, 9)))) + lead
        tail = {"\"": "\"", "'": "'", "(": ")"}.get(lead[-1], "") + pick(" ", ". ", ", ", "\n", "%%% ", "!! ", " | ")
        text = left + middle + tail + " ".join(word() for _ in range(int(rng.integers(1, 9))))
        shout = i % 11 == 0
        out.append((text.upper() if shout and len(text.upper()) == len(text) else text, [(len(left), len(left) + len(middle), kind)] if kind else []))
    return out


_LONG_RUN = re.compile(r"[0-9A-Za-z]*[0-9][0-9A-Za-z]*")


def examples(texts) -> tuple[np.ndarray, np.ndarray]:
    """Windows of classes and tags: around each span and number, from a place that depends on where it is."""
    xs, ys = [], []
    for text, spans in texts:
        c, tags = classes(text), np.zeros(len(text), np.int64)
        for a, b, kind in spans:
            tags[a:b] = 1 + TAGGED.index(kind)
        odd = [m.span() for m in _LONG_RUN.finditer(text) if m.end() - m.start() >= 10 and not tags[m.start() : m.end()].any()] if len(text) > 4 * TRAIN_WINDOW else []
        places = range(0, max(1, len(text) - TRAIN_WINDOW // 2), TRAIN_WINDOW // 2) if len(text) <= 4 * TRAIN_WINDOW else [max(0, a - 8 - 7 * (a % 6)) for a, *_ in spans] + [len(text) // 2]
        for w in places:
            if any(a < w + TRAIN_WINDOW and b > w for a, b in odd):
                continue
            x, y = np.full(TRAIN_WINDOW, PAD), np.zeros(TRAIN_WINDOW, np.int64)
            x[: len(c[w : w + TRAIN_WINDOW])] = c[w : w + TRAIN_WINDOW]
            y[: len(tags[w : w + TRAIN_WINDOW])] = tags[w : w + TRAIN_WINDOW]
            xs.append(x)
            ys.append(y)
    return np.array(xs, np.int64).reshape(-1, TRAIN_WINDOW), np.array(ys, np.int64).reshape(-1, TRAIN_WINDOW)


_OBFUSCATED = re.compile(r"[(\[](?:at|AT)[)\]]")


def _plausible(kind: str, s: str) -> bool:
    """What the tagger can't see (it knows a digit, not which) or must not get wrong."""
    digits = "".join(_DIGIT.findall(s))
    n = len(digits)
    if kind == "email":
        return "\n" not in s and 6 <= len(s) <= 320 and (s.count("@") == 1 or len(_OBFUSCATED.findall(s)) == 1) and ("." in s or "dot" in s.lower()) and s[0] not in "@.([" and s[-1] not in "@.("
    if kind == "ip":
        parts = s.split(".")
        v4 = len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
        return v4 or bool(re.fullmatch(r"[0-9a-fA-F:]{7,39}", s)) and s.count(":") >= 3 and n > 0
    if kind == "card":
        return 14 <= n <= 19 and luhn(digits) and n + sum(c in " .-/" for c in s) == len(s)
    if kind == "phone":
        return 9 <= n <= 15 and n + sum(c in " .-()/+" for c in s) == len(s) and n < len(s) and not _DATED.search(s)
    letters = sum(c.isascii() and c.isalpha() for c in s)
    return 16 <= len(s) <= 200 and n >= 3 and letters >= 3 and n + letters + sum(c in "-_+/=" for c in s) == len(s)


_NUMERIC = ("ip", "card", "phone")
_DATED = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}")


def window_places(length: int) -> np.ndarray:
    """Starts of the windows over a text."""
    return np.arange(max(1, -(-(length - OVERLAP) // (WINDOW - OVERLAP)))) * (WINDOW - OVERLAP)


def tagged_spans(texts: list[str], tagger: Tagger) -> list[list[tuple[int, int, str]]]:
    """Spans of each text by the tagger alone."""
    lengths = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lengths)
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    if not len(ends) or not ends[-1]:
        return out
    flat = np.concatenate([classes("".join(texts)), np.full(WINDOW, PAD, np.uint8)])
    places = [window_places(n) if n else np.zeros(0, np.int64) for n in lengths]
    text_of = np.repeat(np.arange(len(texts)), [len(p) for p in places])
    local = np.concatenate(places)
    begin = local + (ends - lengths)[text_of]
    e = np.empty((int(ends[-1]), TAGS), np.float32)
    steps, is_last = np.arange(WINDOW)[:, None], _is_last(text_of)
    for k in range(0, len(begin), AT_ONCE):
        some = slice(k, k + AT_ONCE)
        at, end = begin[some] + steps, ends[text_of[some]]
        inside = at < end
        got = tagger.scan(np.where(inside, flat[np.minimum(at, len(flat) - 1)], PAD))
        # a character belongs to the window in which it is most central
        own = np.flatnonzero(inside & ((steps >= OVERLAP // 2) | (local[some] == 0)) & ((steps < WINDOW - OVERLAP // 2) | (at >= end - OVERLAP // 2) & is_last[some]))
        e[at.ravel()[own]] = got.reshape(-1, TAGS)[own]
    tags, sure = tagger.decode(e, ends)
    inside = np.flatnonzero(tags)
    if len(inside):
        owner = np.searchsorted(ends, inside, "right")
        cut = np.flatnonzero((np.diff(inside) > 1) | (np.diff(tags[inside]) != 0) | (np.diff(owner) != 0)) + 1
        for run in np.split(np.arange(len(inside)), cut):
            a, b, i = int(inside[run[0]]), int(inside[run[-1]]) + 1, int(owner[run[0]])
            kind, start = TAGGED[int(tags[a]) - 1], int(ends[i] - lengths[i])
            text = texts[i]
            # a number that the tags cut is taken whole
            while kind in _NUMERIC and a > start and text[a - start - 1] in "0123456789+":
                a -= 1
            if kind == "phone" and a > start and text[a - start - 1] == "(" and ")" in text[a - start : b - start].split("(")[0]:
                a -= 1
            while kind in _NUMERIC and b < ends[i] and text[b - start] in "0123456789":
                b += 1
            own = text[a - start : b - start]
            trimmed = own.strip(" ,;:\n\"'%*!|") if kind != "phone" else own.strip(" ,;:\n\"'%*!|.-")
            a += own.index(trimmed)
            if trimmed and sure[inside[run]].mean() >= SURE and _plausible(kind, trimmed):
                out[i].append((a - start, a - start + len(trimmed), kind))
    return out


def _is_last(text_of: np.ndarray) -> np.ndarray:
    """Of each window: whether it is its text's last."""
    return np.concatenate([text_of[1:], [-1]]) != text_of


def _least_by_bucket(batches):
    """(bucket, h, text): of the rows with base spans, the one with the least h of each of TRAIN_DOCS buckets."""
    best: dict[int, tuple[int, str]] = {}
    for batch in batches:
        for i, h in enumerate(batch.column(0).to_pylist()):
            b = h % TRAIN_DOCS
            if b not in best or h <= best[b][0]:
                own = (h, batch.column(1)[i].as_py())
                if (b not in best or own < best[b]) and base_spans(own[1]):
                    best[b] = own
    rows = sorted((b, *own) for b, own in best.items())
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["bucket", "h", "text"])


def train(docs: DataFrame, id_col: str, text_col: str) -> Tagger:
    text = F.col(f"`{text_col}`").cast("string")
    # rows without an id, or with the same one, are told apart by their texts
    texts = docs.select(F.xxhash64(F.col(f"`{id_col}`").cast("long"), text).alias("h"), text.alias("text")).where(F.col("text").rlike("[0-9@]"))
    # a bucket a row: every task sends a row a bucket at most, and the buckets are dealt over the tasks that follow
    least = texts.mapInArrow(_least_by_bucket, "bucket long, h long, text string").groupBy("bucket").agg(F.min(F.struct("h", "text")).alias("x"))
    rows = least.orderBy("bucket").limit(TRAIN_DOCS).select("x.text").toLocalIterator()
    real = [(r.text, base_spans(r.text)) for r in rows]
    x, y = examples(made_texts())
    rx, ry = examples(real)
    return Tagger().fit(np.concatenate([x, rx[:TRAIN_WINDOWS]]), np.concatenate([y, ry[:TRAIN_WINDOWS]]))


def _portions(column, most: int = 1 << 20):
    """Texts of a column, about so many characters at a time, one text at least."""
    held, size = [], 0
    for t in column:
        text = t.as_py() or ""
        if held and size + len(text) > most:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, spans) of each row, both array<struct<start, end, kind>>."""
    params = train(docs, id_col, text_col).p
    schema = f"`{id_col}` long, base array<struct<start:int,end:int,kind:string>>, spans array<struct<start:int,end:int,kind:string>>"
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batches):
        tagger = Tagger()
        tagger.p = params
        for batch in batches:
            base, every = [], []
            for texts in _portions(batch.column(1)):
                for text, more in zip(texts, tagged_spans(texts, tagger), strict=True):
                    own = base_spans(text)
                    new = [s for s in more if all(s[1] <= a or s[0] >= b for a, b, _ in own)]
                    base.append(own)
                    every.append(sorted(own + new, key=lambda s: (s[0], TAGGED.index(s[2]))))
            rows = lambda spans: pa.array([[{"start": a, "end": b, "kind": n} for a, b, n in s] for s in spans], kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), rows(base), rows(every)], [id_col, "base", "spans"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    def joined(c):
        return F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    out = find_pii(table(spark, sf_dir, "documents"))
    def count(k):
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")

    added = F.size("spans") - F.size("base")
    secrets = F.size(F.filter("spans", lambda s: s["kind"] == "secret"))
    return out.select(
        "doc_id", *map(count, KINDS), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"),
        added.cast("long").alias("n_added"), secrets.cast("long").alias("n_secret"), F.size("spans").cast("long").alias("n_spans"),
    )


QUERIES = {"op3_pii": query}
ORACLE_SQL: dict[str, str] = {}
