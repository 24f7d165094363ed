"""Personal data and secrets: fixed patterns, and a character-level bidirectional LSTM with a CRF on top, in numpy.

Base spans come from four patterns, scanned leftmost and without overlap in time linear in the text. The network
finds what they can't say: secrets after a key word, mail addresses written out with (at) and (dot), telephone
numbers without a country code, card numbers with other separators. It is trained on labelled spans: windows of a bounded sample
of documents, labelled by the patterns and by key words, and examples written out from templates with words
of those documents, so that a small or clean corpus trains it too.

Every kind holds a digit, an at sign or a bracketed (at) or (dot), and the decoder accepts no span without one. Windows around these
overlap by half; where tags run on to the edge of what is decoded, the next window is decoded too. Candidates are the spans
that a window holds whole, and those of the whole text's tags, where each character takes its tag from the window in which it
stands most central. One is added if it touches no base span, its digits fit its kind, and its posterior
probability, in a window around it, reaches CONFIDENT; of those that overlap the most probable. Base spans always stay.

A null text is empty. Offsets count code points. Rows are independent: repeated rows, ties and null ids give one row each.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, slices

KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")  # the last one has no pattern: the network's alone
MARKS = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>", "secret": "<SECRET>"}
WINDOW, STEP = 96, 48
TRAIN_DOCS, TRAIN_WINDOWS, TRAIN_EXAMPLES = 1500, 1200, 1800  # documents, windows of them, examples from templates
CONFIDENT = 0.9
SLICE = 1 << 20  # bytes of text at a time

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_CHAIN = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORDED = r"[(\[{] ?(?:at|dot) ?[)\]}]"
_TRIGGER = re.compile(rf"[0-9@]|{_WORDED}", re.I)
#: What labels secrets in the training documents; others are found by likeness.
_KEYED = re.compile(r"(?i)\b(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|auth)\b\s*[=:]\s*[\"']?(?=[^\s\"']*[0-9])([^\s\"']{8,})")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) in order of start, then of KINDS."""
    found: list[tuple[int, int, int]] = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, 0, m.end()))
            free = m.end()
        else:
            free = max(free, at + 1)  # the part before an at sign that failed holds no later match's start
        at = text.find("@", max(at + 1, free))
    if _TRIGGER.search(text):
        for m in _CHAIN.finditer(text):
            groups = m[0].split(".")
            place = m.start()
            for k in range(0, len(groups) - 3, 4):
                own = groups[k : k + 4]
                size = sum(map(len, own)) + 3
                if all(len(g.lstrip("0")) <= 3 and int(g[-4:]) <= 255 for g in own):
                    found.append((place, 1, place + size))
                place += size + 1
        for m in _CARD.finditer(text):
            digits = re.sub("[ -]", "", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((m.start(), 3, m.end()))
    return [(a, KINDS[k], b) for a, k, b in sorted(found)]


# ---------------------------------------------------------------- the network

TAGS = 1 + 2 * len(ALL_KINDS)  # outside; begin and inside of each kind
_SYMBOLS = 100
EMBED, HIDDEN = 10, 16
NEVER = -1e4


def _code(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where((c >= 32) & (c < 127), c - 30, np.where(c < 32, 1, 98)).astype(np.uint8)


def allowed() -> np.ndarray:
    """Transitions the CRF may use: inside follows begin or inside of the same kind."""
    ok = np.zeros((TAGS, TAGS))
    for k in range(len(ALL_KINDS)):
        inside = 2 * k + 2
        ok[:, inside] = NEVER
        ok[inside - 1, inside] = ok[inside, inside] = 0
    return ok


class Tagger:
    """Both directions run in one loop: index 0 reads forwards, 1 backwards. Gates stand in the order input, forget, output, candidate."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        w = lambda *s: rng.normal(0, (1 / s[-2]) ** 0.5, s)
        self.p = {
            "emb": rng.normal(0, 0.3, (_SYMBOLS, EMBED)), "x": w(2, EMBED, 4 * HIDDEN), "h": w(2, HIDDEN, 4 * HIDDEN), "b": np.tile(np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN), (2, 1, 1)),
            "out": w(2 * HIDDEN, TAGS), "ob": np.zeros(TAGS), "tr": np.zeros((TAGS, TAGS)),
        }
        self.ok = allowed()

    def cast(self, kind) -> Tagger:
        """A copy in another precision."""
        out = Tagger()
        out.p = {k: v.astype(kind) for k, v in self.p.items()}
        out.ok = self.ok.astype(kind)
        return out

    def lstm(self, codes: np.ndarray, keep: bool = False):
        """codes (batch, time) -> inputs and states (time, 2, batch, .); the second direction's time runs backwards."""
        both = np.stack([codes.T, codes.T[::-1]], 1)
        x = self.p["emb"][both]
        pre = np.matmul(x, self.p["x"]) + self.p["b"]
        t, _, n, _ = pre.shape
        half = np.ones(4 * HIDDEN, pre.dtype)
        half[: 3 * HIDDEN] = 0.5  # a logistic gate is a tanh of half its input
        h = c = np.zeros((2, n, HIDDEN), pre.dtype)
        hs, cs, gs = np.empty((t, 2, n, HIDDEN), pre.dtype), np.empty((t, 2, n, HIDDEN), pre.dtype), np.empty_like(pre) if keep else None
        for s in range(t):
            g = np.tanh((pre[s] + np.matmul(h, self.p["h"])) * half)
            g[..., : 3 * HIDDEN] *= 0.5
            g[..., : 3 * HIDDEN] += 0.5
            c = g[..., HIDDEN : 2 * HIDDEN] * c + g[..., :HIDDEN] * g[..., 3 * HIDDEN :]
            h = g[..., 2 * HIDDEN : 3 * HIDDEN] * np.tanh(c)
            hs[s], cs[s] = h, c
            if keep:
                gs[s] = g
        return both, x, hs, cs, gs

    def lstm_back(self, run, dh_all: np.ndarray, grads: dict[str, np.ndarray]) -> None:
        both, x, hs, cs, gs = run
        t, _, n, _ = gs.shape
        da_all = np.empty_like(gs)
        dh = dc = np.zeros((2, n, HIDDEN), gs.dtype)
        back = self.p["h"].transpose(0, 2, 1)
        for s in range(t - 1, -1, -1):
            i, f, o, z = (gs[s][..., k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
            dh = dh + dh_all[s]
            tc = np.tanh(cs[s])
            dc = dc + dh * o * (1 - tc * tc)
            da = da_all[s]
            da[..., :HIDDEN] = dc * z * i * (1 - i)
            da[..., HIDDEN : 2 * HIDDEN] = dc * (cs[s - 1] if s else 0) * f * (1 - f)
            da[..., 2 * HIDDEN : 3 * HIDDEN] = dh * tc * o * (1 - o)
            da[..., 3 * HIDDEN :] = dc * i * (1 - z * z)
            dh = np.matmul(da, back)
            dc = dc * f
        grads["x"] = np.einsum("tdne,tdng->deg", x, da_all, optimize=True)
        grads["h"] = np.einsum("tdnh,tdng->dhg", hs[:-1], da_all[1:], optimize=True)
        grads["b"] = da_all.sum((0, 2))[:, None, :]
        dx = np.matmul(da_all, self.p["x"].transpose(0, 2, 1))
        grads["emb"] = np.zeros_like(self.p["emb"])
        np.add.at(grads["emb"], both, dx)

    def _scores(self, hs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.concatenate([hs[:, 0], hs[::-1, 1]], 2)
        return h, h @ self.p["out"] + self.p["ob"]

    def emissions(self, codes: np.ndarray) -> np.ndarray:
        """codes (batch, time) -> (batch, time, TAGS)."""
        return self._scores(self.lstm(codes)[2])[1].transpose(1, 0, 2)

    def _start(self) -> np.ndarray:
        return (np.where(np.arange(TAGS) % 2 == 0, NEVER, 0.0) * (np.arange(TAGS) > 0)).astype(self.ok.dtype)

    def _forward(self, e: np.ndarray) -> tuple[np.ndarray, ...]:
        """e (time, batch, TAGS) -> scaled forward probabilities, their scales, emission factors, and the log partition."""
        top = e.max(2, keepdims=True)
        factor, step = np.exp(e - top), np.exp(self.p["tr"] + self.ok)
        a, scale = np.empty_like(e), np.empty_like(top)
        a[0] = factor[0] * np.exp(self._start())
        for s in range(len(e)):
            if s:
                np.matmul(a[s - 1], step, out=a[s])
                a[s] *= factor[s]
            scale[s] = np.maximum(a[s].sum(1, keepdims=True), 1e-30)
            a[s] /= scale[s]
        return a, scale, factor, step, (np.log(scale) + top).sum((0, 2), dtype=np.float64)

    def partition(self, e: np.ndarray) -> np.ndarray:
        """Log partition of each window of e (batch, time, TAGS)."""
        return self._forward(e.transpose(1, 0, 2))[4]

    def loss_gradient(self, codes: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the tag sequences."""
        n, t = codes.shape
        run = self.lstm(codes, True)
        h, e = self._scores(run[2])
        a, scale, factor, step, z = self._forward(e)
        b = np.ones_like(e)
        for s in range(t - 2, -1, -1):
            np.matmul(b[s + 1] * factor[s + 1] / scale[s + 1], step.T, out=b[s])
        gold, rows, tr = tags.T.astype(np.int64), np.arange(n), self.p["tr"] + self.ok
        score = np.take_along_axis(e, gold[:, :, None], 2).sum((0, 2)) + tr[gold[:-1], gold[1:]].sum(0) + self._start()[gold[0]]
        de = a * b
        de[np.arange(t)[:, None], rows[None, :], gold] -= 1
        de /= n
        dtr = step * np.tensordot(a[:-1], (b * factor / scale)[1:], ([0, 1], [0, 1]))
        np.add.at(dtr, (gold[:-1].ravel(), gold[1:].ravel()), -1)
        grads = {"tr": dtr / n, "out": np.tensordot(h, de, ([0, 1], [0, 1])), "ob": de.sum((0, 1))}
        dh = de @ self.p["out"].T
        self.lstm_back(run, np.stack([dh[:, :, :HIDDEN], dh[::-1, :, HIDDEN:]], 1), grads)
        return float((z - score).mean()), grads

    def fit(self, codes: np.ndarray, tags: np.ndarray, steps: int = 500, batch: int = 64, rate: float = 0.02) -> float:
        rng = np.random.default_rng(1)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step, loss = 0, 0.0
        for _ in range(max(1, steps * batch // len(codes))):
            order, loss = rng.permutation(len(codes)), 0.0
            for a in range(0, len(order), batch):
                own = order[a : a + batch]
                cost, g = self.loss_gradient(codes[own], tags[own])
                loss += cost * len(own) / len(order)
                norm = np.sqrt(sum((x * x).sum() for x in g.values()))
                step += 1
                for k in self.p:
                    d = g[k] * min(1.0, 5 / max(norm, 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * d
                    v[k] = 0.99 * v[k] + 0.01 * d * d
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        return loss

    def decode(self, e: np.ndarray) -> np.ndarray:
        """Viterbi tags (batch, time)."""
        n, t, _ = e.shape
        tr = self.p["tr"] + self.ok
        back = np.empty((t, n, TAGS), np.int8)
        a = e[:, 0] + self._start()
        for s in range(1, t):
            w = a[:, :, None] + tr
            back[s] = w.argmax(1)
            a = w.max(1) + e[:, s]
        out = np.empty((n, t), np.int8)
        out[:, -1] = a.argmax(1)
        for s in range(t - 1, 0, -1):
            out[:, s - 1] = back[s][np.arange(n), out[:, s]]
        return out

    def posterior(self, e: np.ndarray, spans: list[tuple[int, int, int]]) -> np.ndarray:
        """Probability, in each window of ``e``, that its (start, end, kind) is exactly a span of the kind."""
        mask = np.zeros_like(e)
        for own, (start, end, kind) in zip(mask, spans, strict=True):
            own[start:end] = NEVER
            own[start, 2 * kind + 1] = 0
            own[start + 1 : end, 2 * kind + 2] = 0
            if end < len(own):
                own[end, 2 * kind + 2] = NEVER
        return np.exp(self.partition(e + mask) - self.partition(e))


def tags_of(spans: list[tuple[int, str, int]], size: int) -> np.ndarray:
    tags = np.zeros(size, np.uint8)
    for a, kind, b in spans:
        k = ALL_KINDS.index(kind)
        if not tags[a:b].any():
            tags[a] = 2 * k + 1
            tags[a + 1 : b] = 2 * k + 2
    return tags


def starts_of(text: str) -> list[int]:
    """Window starts on the grid of STEP around what every span holds."""
    found = set()
    for m in _TRIGGER.finditer(text):
        k = m.start() // STEP
        found |= {k, max(0, k - 1)}
    return [k * STEP for k in sorted(found)]


def _window(codes: np.ndarray, start: int, size: int = WINDOW) -> np.ndarray:
    own = codes[start : start + size]
    return own if len(own) == size else np.concatenate([own, np.zeros(size - len(own), own.dtype)])


# ---------------------------------------------------------------- labelled spans


def labelled(text: str) -> list[tuple[int, str, int]]:
    """Spans of a training document: the patterns', keyed secrets, and card numbers by their shape (digits are checked apart)."""
    shaped = [(m.start(), "card", m.end()) for m in _CARD.finditer(text) if 14 <= sum(c.isdigit() for c in m[0]) <= 19]
    return base_spans(text) + [(m.start(1), "secret", m.end(1)) for m in _KEYED.finditer(text)] + shaped


class _Values:
    """Made-up values: (words before, kind or None, value)."""

    def __init__(self, rng: np.random.Generator):
        self.rng = rng

    def pick(self, *of):
        return of[int(self.rng.integers(len(of)))]

    def digits(self, n: int) -> str:
        return "".join(map(str, self.rng.integers(0, 10, n)))

    def word(self) -> str:
        return "".join(self.rng.choice(list("aeioubcdfglmnprstv"), self.rng.integers(2, 9)))

    def email(self):
        end = self.pick("com", "org", "net", "example.com", "de")
        name = self.word() + self.pick("", ".", "_") + self.pick("", self.word()) + self.pick("", self.digits(2))
        if self.rng.random() < 0.4:
            return "", "email", f"{name}@{self.word()}.{end}"
        left, right = self.pick(("(", ")"), ("[", "]"))
        at, dot = (f"{left}{w}{right}" for w in self.pick(("at", "dot"), ("AT", "DOT"), ("at", "dot")))
        gap = self.pick("", " ")
        return "", "email", f"{name}{gap}{at}{gap}{self.word()}{self.pick('.', f'{gap}{dot}{gap}')}{end.split('.')[-1]}"

    def ip(self):
        return self.pick("", "host ", "from "), "ip", ".".join(str(x) for x in self.rng.integers(0, 256, 4))

    def card(self):
        number = self.digits(15)
        number += self.pick(*(c for c in "0123456789" if luhn(number + c))) if self.rng.random() < 0.7 else self.digits(1)
        by = self.pick("", " ", "-", ".", "")
        return self.pick("", "card ", "no. "), "card", by.join(number[k : k + 4] for k in range(0, 16, 4))

    def phone(self):
        a, b, c = self.digits(3), self.digits(3), self.digits(4)
        shape = self.pick(f"+{self.rng.integers(1, 99)} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"({a}) {b} {c}")
        if self.rng.random() < 0.3:
            return self.pick("tel ", "Tel.: ", "phone ", "call ", "mobile: "), "phone", self.pick(f"0{a} {b}{c}", f"00{self.rng.integers(10, 99)} {a} {b}{c}", f"{a} {b} {c}", f"0{a}/{b}{c}")
        return "", "phone", shape

    def secret(self):
        key = self.pick("token", "secret", "password", "api_key", "apikey", "access_key", "client_secret", "pwd", "auth", "bearer", "private key")
        letters = self.pick("0123456789abcdef", "0123456789abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "0123456789abcdef")
        value = self.pick("", "", "", "sk-", "ghp_") + "".join(self.rng.choice(list(letters), int(self.pick(12, 16, 20, 24, 32, 40, 40, 40, 48))))
        value = value if any(c.isdigit() for c in value) else value + "7"
        return key + self.pick(" = ", "=", ": ", " : ", " is ") , "secret", value

    def nothing(self):
        a = lambda n: self.digits(int(self.rng.integers(1, n)))
        return "", None, self.pick(
            a(9), f"{a(3)}.{a(3)}", f"{self.rng.integers(1900, 2100)}-{self.rng.integers(10, 13)}-{self.rng.integers(10, 29)}", f"{a(3)}/{a(3)}/{self.rng.integers(1900, 2100)}",
            f"{self.rng.integers(0, 24)}:{self.digits(2)}", f"v{a(2)}.{a(2)}.{a(3)}", f"${a(5)}.{self.digits(2)}", f"{a(4)}-{a(4)}", f"commit {self.word()}{a(4)}", f"{self.word()}{a(4)}",
            f"{a(3)}%", f"no. {a(6)}", f"({a(4)})", f"{a(3)},{self.digits(3)}", f"[{a(3)}]", f"{self.word()} @ {self.word()}",
        )


def examples(n: int, seed: int = 8, words: list[str] | None = None) -> list[tuple[str, list[tuple[int, str, int]]]]:
    """Sentences with labelled spans of every kind, and with numbers that are none."""
    rng = np.random.default_rng(seed)
    make = _Values(rng)
    kinds = [make.email, make.ip, make.card, make.phone, make.secret, make.secret, make.nothing, make.nothing, make.nothing]
    out = []
    for i in range(n):
        noise, table, shout = (rng.random() < 0.1 for _ in range(3))
        text, spans = "", []
        count, at = int(rng.integers(5, 16)), int(rng.integers(0, 5))
        for k in range(count):
            if k == at or rng.random() < 0.06:
                before, kind, value = kinds[i % len(kinds)]() if k == at else make.nothing()
                quote = make.pick('"', "'", '"', "") if kind == "secret" else ""
                text += before + quote
                if kind:
                    spans.append((len(text), kind, len(text) + len(value)))
                text += value + quote
            else:
                text += words[int(rng.integers(len(words)))] if words and rng.random() < 0.7 else make.word()
            text += make.pick("!!", "***", "$$$", "###", "%%%") if noise else make.pick(".", ",") if rng.random() < 0.1 else ""
            text += " | " if table else make.pick(" ", " ", " ", " ", "\n")
        shouted = text.upper()
        out.append((shouted if shout and len(shouted) == len(text) else text, spans))
    return out


def windows_of(text: str, spans: list[tuple[int, str, int]]) -> Iterator[tuple[np.ndarray, np.ndarray, str]]:
    """Codes, tags and text of the windows that are decoded."""
    codes, tags = _code(text), tags_of(spans, len(text))
    for start in starts_of(text):
        part = tags[start : start + WINDOW].copy()
        k = 0  # a span that began before the window has no begin in it
        while k < len(part) and part[k] and part[k] % 2 == 0:
            part[k] = 0
            k += 1
        yield _window(codes, start), _window(part, 0), text[start : start + WINDOW]


def train(windows: list[tuple[np.ndarray, np.ndarray]], words: list[str] | None = None, n_examples: int = TRAIN_EXAMPLES) -> Tagger:
    """A tagger from windows (codes, tags) of documents and from examples with their words."""
    own = [w[:2] for text, spans in examples(n_examples, words=words) for w in windows_of(text, spans)] + windows
    model = Tagger().cast(np.float32)
    model.fit(np.stack([w[0] for w in own]), np.stack([w[1] for w in own]))
    return model


# ---------------------------------------------------------------- decoding


def plausible(kind: str, value: str) -> bool:
    """Whether a span's characters can be of its kind at all."""
    digits = "".join(c for c in value if "0" <= c <= "9")
    if kind == "email":
        return "@" in value or re.search(_WORDED, value, re.I) is not None
    if kind == "ip":
        groups = re.findall("[0-9]+", value)
        return len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups)
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return 7 <= len(digits) <= 15 if kind == "phone" else len(value) >= 8 and len(digits) > 0


def _batches(items: list, size: int) -> Iterator[list]:
    for a in range(0, len(items), size):
        yield items[a : a + size]


def added_spans(model: Tagger, texts: list[str], base: list[list[tuple[int, str, int]]], batch: int = 256) -> list[list[tuple[int, str, int]]]:
    """The network's own spans of each text."""
    todo = [(i, s) for i, t in enumerate(texts) for s in starts_of(t)]
    codes = {i: _code(texts[i]) for i in dict(todo)}
    held: dict[int, dict[int, np.ndarray]] = {i: {} for i in codes}
    while todo:
        for part in _batches(todo, batch):
            got = model.decode(model.emissions(np.stack([_window(codes[i], s) for i, s in part])))
            for (i, s), tags in zip(part, got, strict=True):
                held[i][s] = tags[: len(texts[i]) - s]
        # tags that run on to the edge of what is decoded: its neighbour is decoded too
        more = set()
        for i, s in todo:
            if s and held[i][s][0] and s - STEP not in held[i]:
                more.add((i, s - STEP))
            if s + WINDOW < len(texts[i]) and held[i][s][-1] and s + STEP not in held[i]:
                more.add((i, s + STEP))
        todo = sorted(more)
    asked: list[tuple[int, int, int, int]] = []
    for i, own in held.items():
        tags = np.zeros(len(texts[i]), np.int8)
        spans = set()
        for s, got in own.items():
            low = s + STEP // 2 if s - STEP in own else s
            high = s + WINDOW - STEP // 2 if s + STEP in own else s + len(got)
            tags[low:high] = got[low - s : high - s]
            # what a window holds whole counts as it stands; what runs over its edge, as the windows say together
            spans |= {(s + a, s + b, k) for a, b, k in _runs(got) if b < len(got) or s + b == len(texts[i])}
        for a, b, k in sorted(spans | set(_runs(tags))):
            if not any(x < b and a < y for x, _, y in base[i]) and plausible(ALL_KINDS[k], texts[i][a:b]):
                asked.append((i, a, b, k))
    sized: dict[int, list[tuple[int, int, int, int]]] = {}
    for x in asked:
        sized.setdefault(-(-(x[2] - x[1] + STEP) // 64) * 64, []).append(x)
    sure: list[tuple[float, int, int, int, int]] = []
    for size, own in sized.items():
        for part in _batches(own, max(1, batch * WINDOW // size)):
            starts = [max(0, a - (size - (b - a)) // 2) for _, a, b, _ in part]
            e = model.emissions(np.stack([_window(codes[i], s, size) for (i, *_), s in zip(part, starts, strict=True)]))
            found = model.posterior(e, [(a - s, b - s, k) for (_, a, b, k), s in zip(part, starts, strict=True)])
            sure += [(-float(p), *x) for x, p in zip(part, found, strict=True) if p >= CONFIDENT]
    out: list[list[tuple[int, str, int]]] = [[] for _ in texts]
    for _, i, a, b, k in sorted(sure):  # the surest of those that overlap
        if not any(x < b and a < y for x, _, y in out[i]):
            out[i].append((a, ALL_KINDS[k], b))
    return [sorted(x) for x in out]


def _runs(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, kind) of each begin with the insides that follow it."""
    out = []
    for a in np.flatnonzero(tags % 2).tolist():
        stop = np.flatnonzero(tags[a + 1 :] != tags[a] + 1)
        out.append((a, a + 1 + int(stop[0]) if len(stop) else len(tags), (int(tags[a]) - 1) // 2))
    return out


def fit(spark: SparkSession, docs: DataFrame) -> Tagger:
    """A tagger trained on windows of a bounded sample of the documents that hold any, by hashes of text and window."""
    text = F.col("text").cast("string")
    rows = docs.where(text.rlike("(?i)" + _TRIGGER.pattern)).select(text.alias("text")).withColumn("draw", F.xxhash64("text", F.lit(31)))
    total = rows.count()
    bound = (1 << 63) - 1 if total <= TRAIN_DOCS else int(2**64 * (TRAIN_DOCS / total)) - (1 << 63)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                found = [w for t in part.column("text").to_pylist() for w in windows_of(t, labelled(t))]
                yield pa.RecordBatch.from_arrays([pa.array([w[0].tobytes() for w in found], pa.binary()), pa.array([w[1].tobytes() for w in found], pa.binary()), pa.array([w[2] for w in found], pa.string())], names=["codes", "tags", "window"])

    # equal texts have equal draws: one of each, so that copies can't outgrow the bound
    drawn = rows.where(F.col("draw") <= bound).dropDuplicates(["draw"]).select("text")
    found = map_arrow(drawn, cut, "codes binary, tags binary, window string").orderBy(F.xxhash64("window", F.lit(37)), "window", "tags").limit(TRAIN_WINDOWS).collect()
    words = sorted({w for r in found for w in r["window"].split()[1:-1] if not _TRIGGER.search(w)})
    return train([(np.frombuffer(r["codes"], np.uint8), np.frombuffer(r["tags"], np.uint8)) for r in found], words)


def join_spans(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b in sorted(spans, key=lambda s: (s[0], ALL_KINDS.index(s[1]), s[2])))


def find(spark: SparkSession, docs: DataFrame, model: Tagger | None = None) -> DataFrame:
    """The contract's digest of every document."""
    shared = spark.sparkContext.broadcast((model or fit(spark, docs)).cast(np.float32))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                base = [base_spans(t) for t in texts]
                more = added_spans(shared.value, texts, base)
                count = [[sum(s[1] == k for s in own) for own in base] for k in KINDS]
                digest = [hashlib.sha256(join_spans(own).encode()).hexdigest() for own in base]
                spans = [join_spans(own + extra) for own, extra in zip(base, more, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in count), pa.array(digest, pa.string()), pa.array(spans, pa.string())],
                    names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, scan, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")


def masked(text: str, spans: list[tuple[int, str, int]]) -> str:
    """The text with each span's kind in its place; of spans that overlap, the first one's."""
    out, at = [], 0
    for a, kind, b in sorted(spans):
        if a >= at:
            out += [text[at:a], MARKS[kind]]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(spark: SparkSession, docs: DataFrame, model: Tagger | None = None) -> DataFrame:
    """The documents with personal data masked in their text, other columns as they are."""
    shared = spark.sparkContext.broadcast((model or fit(spark, docs)).cast(np.float32))
    at = docs.columns.index("text")

    def mask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at, SLICE):
                own = part.column(at).to_pylist()
                texts = [t or "" for t in own]
                base = [base_spans(t) for t in texts]
                more = added_spans(shared.value, texts, base)
                done = [None if t is None else masked(t, a + b) for t, a, b in zip(own, base, more, strict=True)]
                columns = [pa.array(done, pa.string()) if k == at else part.column(k) for k in range(part.num_columns)]
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    return map_arrow(docs, mask, docs.schema)
