"""Personal data: four fixed patterns, and a character-level bidirectional LSTM with CRF transitions.

The network is trained in numpy from labelled spans. Texts are cut into overlapping windows. Every kind needs a digit or an
@, so windows are run around these, and further outward wherever a span reaches the edge of what was run; what is left
out can't change a span that counts. Every window is decoded by Viterbi, and a character takes its tag from the window
in which it lies farthest from the edges, so that spans are read from one tag sequence over the whole text, whatever the
windows cut. What the network adds must have the form of its kind (digits,
checksum, parts) and not overlap a span of fixed form.

Cases: a null text is empty and has no spans. Positions count code points, end exclusive. Rows are handled one by one, so
repeated ids and rows stay; only id and text are read, so other columns don't matter. An empty table gives an empty result.
Work grows in proportion to a text's length.
"""

from __future__ import annotations

import itertools
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import table, text_batches

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # other, then begin and inside of each kind
WIDTH, STRIDE = 96, 48
EMBED, HIDDEN = 16, 24
#: Windows that go through the network at once.
TOGETHER = 1024
#: Labelled texts that the network is trained on, and passes over them: the bound of the training sample.
SAMPLES, PASSES, BATCH = 2_000, 4, 96

Span = tuple[int, int, int]  # kind, start, end

# The base patterns, in forms that take no more than linear time; see base_spans.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_CUE = re.compile(r"[0-9@]")
_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, sorted. An email's local part is what precedes the @, back to the last email."""
    out: list[Span] = []
    last = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            out.append((0, start, m.end()))
            last = m.end()
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _DIGITS.sub("", m[0])) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_DIGITS.sub("", m[0])) <= 15]
    return sorted(out)


def of_form(kind: int, text: str) -> bool:
    """Whether what the network found has the form of its kind."""
    digits = _DIGITS.sub("", text)
    if kind == 0:
        return bool(re.fullmatch(r"[A-Za-z0-9._%+-]+\s*@\s*[A-Za-z0-9-]+(\s?\.\s?[A-Za-z0-9-]+)+", text))
    if kind == 1:
        parts = re.fullmatch(r"([0-9]{1,3})\s?\.\s?([0-9]{1,3})\s?\.\s?([0-9]{1,3})\s?\.\s?([0-9]{1,3})", text)
        return bool(parts) and all(int(p) <= 255 for p in parts.groups())
    if kind == 2:
        return bool(re.fullmatch(r"[0-9](?:[ .-]?[0-9])+", text)) and 13 <= len(digits) <= 19 and luhn(digits)
    return bool(re.fullmatch(r"\+?[(]?[0-9](?:[ ().-]{0,3}[0-9])+", text)) and 9 <= len(digits) <= 15 and len(re.findall(r"[ ().-]+", text)) >= 2


# ---- labelled spans


def labelled(count: int, seed: int) -> list[tuple[str, list[Span]]]:
    """Invented texts with the spans in them: usual ways to write each kind, amid words and amid numbers that are neither."""
    rng = random.Random(seed)
    pick, num = rng.choice, lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    letters = "abcdefghijklmnopqrstuvwxyz"
    syllables = "an er in on the th ti ou re st nd le ment que eau der sch ung lich ción ado es os ñ é ö ß".split()

    def word() -> str:
        w = "".join(pick(syllables) for _ in range(rng.randrange(1, 5)))
        return pick([w, w, w, w.capitalize(), w + ",", w + ".", w + ".\n"])

    def name() -> str:
        return "".join(pick(letters) for _ in range(rng.randrange(2, 9)))

    def entity(kind: int) -> str:
        if kind == 0:
            local = name() + pick(["", "." + name(), "_" + name(), "." + num(2), num(rng.randrange(1, 4)), "+" + name()])
            domain = pick([name(), name() + num(1) + "." + name(), name() + "-" + name()]) + "." + pick(["com", "org", "net", "de", "fr", "es", "io", "co.uk"])
            return pick([local, local, local.upper()]) + pick(["@", "@", "@", "@", " @ "]) + domain
        if kind == 1:
            return ".".join(str(rng.randrange(256)) for _ in range(4))
        if kind == 2:
            n = pick([16, 16, 16, 15, 19])
            d = pick("3456") + num(n - 2)
            d += next(c for c in "0123456789" if luhn(d + c))
            return d if n == 19 or rng.random() < 0.5 else pick([" ", "-", "."]).join([d[:4], d[4:8], d[8:12], d[12:]] if n == 16 else [d[:4], d[4:10], d[10:]])
        a, b, c = num(3), num(3), num(4)
        return pick([f"+1 ({a}) {b}-{c}", f"+{num(2)} {num(2)} {num(4)} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{num(2)}-{a}-{b}-{c}", f"{a} {b} {c}", f"+1 {a} {b} {c}"])

    def other() -> str:
        code = "".join(pick("0123456789abcdef") for _ in range(rng.randrange(12, 41)))
        return pick([code, f'token = "{code}"', "password=" + code, "AKIA" + "".join(pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)), f"Version {num(1)}.{num(1)}", f"{num(1)}.{num(2)}.{num(1)}", f"{pick(['19', '20'])}{num(2)}", f"20{num(2)}-0{num(1)}-1{num(1)}",
                     f"1{num(1)}:{num(2)}", num(rng.randrange(1, 13)), f"{num(2)},{num(3)}.{num(2)}", f"#{num(5)}", f"{num(2)}%", f"@{name()}", f"{name()}{num(2)}", f"{num(1)}-{num(2)}", f"({num(2)})"])

    out = []
    for _ in range(count):
        parts, spans, size = [], [], 0
        for _ in range(rng.randrange(8, 30)):
            draw = rng.random()
            kind = rng.randrange(len(KINDS)) if draw < 0.16 else None
            s = entity(kind) if kind is not None else other() if draw < 0.28 else word()
            if kind is not None:
                spans.append((kind, size, size + len(s)))
            s += pick([" ", " ", " ", " ", "\n", ", ", ". "]) if kind is not None or draw < 0.28 else " "
            parts.append(s)
            size += len(s)
        out.append(("".join(parts), spans))
    return out


# ---- the network


def codes(text: str) -> np.ndarray:
    """Characters as numbers: 1 to 95 for printable ASCII, 96 other ASCII, 97 letters beyond, 98 the rest."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int32)
    return np.where((c >= 32) & (c < 127), c - 31, np.where(c < 128, 96, np.where((c >= 0xC0) & (c < 0x250), 97, 98))).astype(np.int8)


def starts(length: int) -> range:
    return range(0, max(1, length - WIDTH + STRIDE), STRIDE)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Tagger:
    """Parameters, with a leading axis of two for the directions: embed, wx, wh, b, out, bias, move (tag to tag), first (tag)."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        n = lambda *s: (rng.normal(size=s) / np.sqrt(s[-2])).astype(np.float32)
        self.p = {"embed": n(99, EMBED), "wx": n(2, EMBED, 4 * HIDDEN), "wh": n(2, HIDDEN, 4 * HIDDEN), "b": np.zeros((2, 1, 4 * HIDDEN), np.float32),
                  "out": n(2 * HIDDEN, TAGS), "bias": np.zeros(TAGS, np.float32), "move": np.zeros((TAGS, TAGS), np.float32), "first": np.zeros(TAGS, np.float32)}
        self.p["embed"] *= 4
        self.p["b"][:, :, HIDDEN : 2 * HIDDEN] = 1

    def emissions(self, x: np.ndarray, keep: bool = False):
        """x: windows by characters. -> windows by characters by tags; with keep, also what training needs."""
        p, (n, t) = self.p, x.shape
        into = p["embed"] @ p["wx"] + p["b"]  # 2, characters, gates
        both = np.stack([x, x[:, ::-1]])
        h, c = np.zeros((2, n, HIDDEN), np.float32), np.zeros((2, n, HIDDEN), np.float32)
        hidden, trace = np.zeros((2, t, n, HIDDEN), np.float32), []
        for k in range(t):
            z = np.stack([into[0][both[0, :, k]], into[1][both[1, :, k]]]) + h @ p["wh"]
            gates = _sigmoid(z[..., : 3 * HIDDEN])
            i, f, o = gates[..., :HIDDEN], gates[..., HIDDEN : 2 * HIDDEN], gates[..., 2 * HIDDEN :]
            g = np.tanh(z[..., 3 * HIDDEN :])
            before, c = c, f * c + i * g
            tc = np.tanh(c)
            if keep:
                trace.append((i, f, o, g, before, tc, h))
            h = o * tc
            hidden[:, k] = h
        joined = np.concatenate([hidden[0], hidden[1][::-1]], axis=-1)
        em = joined @ p["out"] + p["bias"]
        return (em, joined, both, trace) if keep else em.transpose(1, 0, 2)

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The likeliest tags of each window."""
        em = self.emissions(x)
        n, t, _ = em.shape
        best, back = em[:, 0] + self.p["first"], np.zeros((t, n, TAGS), np.int8)
        for k in range(1, t):
            s = best[:, :, None] + self.p["move"]
            back[k] = s.argmax(axis=1)
            best = s.max(axis=1) + em[:, k]
        tags = np.zeros((n, t), np.int8)
        tags[:, -1] = best.argmax(axis=1)
        for k in range(t - 1, 0, -1):
            tags[:, k - 1] = back[k][np.arange(n), tags[:, k]]
        return tags

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Negative log-likelihood of the tags y a window, and its gradients."""
        p, (n, t) = self.p, x.shape
        em, joined, both, trace = self.emissions(x, True)
        lse = lambda a, axis: (m := a.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis=axis))
        alpha, beta = np.zeros_like(em), np.zeros_like(em)
        alpha[0] = em[0] + p["first"]
        for k in range(1, t):
            alpha[k] = em[k] + lse(alpha[k - 1][:, :, None] + p["move"], 1)
        for k in range(t - 2, -1, -1):
            beta[k] = lse(p["move"][None] + (em[k + 1] + beta[k + 1])[:, None, :], 2)
        z = lse(alpha[-1], 1)
        d_em = np.exp(alpha + beta - z[None, :, None])
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["first"] = d_em[0].sum(0)
        pair = np.exp(alpha[:-1, :, :, None] + p["move"] + (em[1:] + beta[1:])[:, :, None, :] - z[None, :, None, None])
        g["move"] = pair.sum((0, 1))
        yt = y.T
        loss = z.sum() - em[np.arange(t)[:, None], np.arange(n)[None], yt].sum() - p["first"][yt[0]].sum() - p["move"][yt[:-1], yt[1:]].sum()
        np.add.at(g["first"], yt[0], -1)
        np.add.at(g["move"], (yt[:-1], yt[1:]), -1)
        d_em[np.arange(t)[:, None], np.arange(n)[None], yt] -= 1
        g["bias"] = d_em.sum((0, 1))
        g["out"] = joined.reshape(-1, 2 * HIDDEN).T @ d_em.reshape(-1, TAGS)
        d_joined = d_em @ p["out"].T
        d_hidden = np.stack([d_joined[..., :HIDDEN], d_joined[::-1, :, HIDDEN:]])
        dh, dc = np.zeros((2, n, HIDDEN), np.float32), np.zeros((2, n, HIDDEN), np.float32)
        d_gates = np.zeros((2, n, t, 4 * HIDDEN), np.float32)
        for k in range(t - 1, -1, -1):
            i, f, o, gg, before, tc, h = trace[k]
            dh = dh + d_hidden[:, k]
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate([dc * gg * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - gg * gg)], axis=-1)
            g["wh"] += h.transpose(0, 2, 1) @ dz
            d_gates[:, :, k] = dz
            dh, dc = dz @ p["wh"].transpose(0, 2, 1), dc * f
        at = (both.reshape(2, -1) == np.arange(99)[:, None, None]).astype(np.float32).transpose(1, 0, 2)  # directions, characters, places
        d_into = at @ d_gates.reshape(2, -1, 4 * HIDDEN)
        g["b"] = d_into.sum(1, keepdims=True)
        g["wx"] = p["embed"].T @ d_into
        g["embed"] = (d_into @ p["wx"].transpose(0, 2, 1)).sum(0)
        return float(loss) / n, {k: v / n for k, v in g.items()}


def windows(text: str, spans: list[Span]) -> tuple[np.ndarray, np.ndarray]:
    c, tags = codes(text), np.zeros(len(text), np.int8)
    for kind, a, b in spans:
        tags[a:b] = 2 + 2 * kind
        tags[a] = 1 + 2 * kind
    x, y = np.zeros((len(starts(len(c))), WIDTH), np.int64), np.zeros((len(starts(len(c))), WIDTH), np.int8)
    for k, s in enumerate(starts(len(c))):
        part = c[s : s + WIDTH]
        x[k, : len(part)], y[k, : len(part)] = part, tags[s : s + WIDTH]
    return x, y


def train(sample: list[tuple[str, list[Span]]], passes: int = PASSES, seed: int = 0, rate: float = 0.02) -> Tagger:
    parts = [windows(*s) for s in sample]
    x, y = np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts])
    net, rng = Tagger(seed), np.random.default_rng(seed)
    m, v, t = {k: np.zeros_like(w) for k, w in net.p.items()}, {k: np.zeros_like(w) for k, w in net.p.items()}, 0
    steps = passes * -(-len(x) // BATCH)
    for _ in range(passes):
        order = rng.permutation(len(x))
        for at in range(0, len(x), BATCH):
            _, g = net.gradients(x[order[at : at + BATCH]], y[order[at : at + BATCH]])
            norm = np.sqrt(sum(float((w * w).sum()) for w in g.values()))
            t += 1
            for k, w in g.items():
                w = w * min(1.0, 5.0 / (norm + 1e-9))
                m[k] += 0.1 * (w - m[k])
                v[k] += 0.01 * (w * w - v[k])
                net.p[k] -= (rate * (1 - t / (steps + 1)) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return net


_TRAINED: dict[tuple, Tagger] = {}


def default_tagger() -> Tagger:
    """Trained once in a process."""
    key = (SAMPLES, PASSES)
    if key not in _TRAINED:
        _TRAINED[key] = train(labelled(SAMPLES, 1))
    return _TRAINED[key]


def found_by(net: Tagger, texts: list[str], everywhere: bool = False) -> list[list[Span]]:
    """The network's spans of each text. No more than TOGETHER windows are held at once, however long a text is.

    Windows are run around each digit and @, and then outward for as long as a span reaches the edge of what was run, so
    every span with a digit or @ in it comes out as it would from all windows (everywhere=True)."""
    coded: dict[int, np.ndarray] = {}
    tags: dict[int, np.ndarray] = {}
    ran: dict[int, np.ndarray] = {}
    margin = (WIDTH - STRIDE) // 2

    def ask(k: int, w: int) -> Iterator[tuple[int, int]]:
        if 0 <= w < len(ran[k]) and not ran[k][w]:
            ran[k][w] = True
            yield k, w

    def first() -> Iterator[tuple[int, int]]:
        for k, text in enumerate(texts):
            if not (everywhere and text or _CUE.search(text)):
                continue
            coded[k], tags[k], ran[k] = codes(text), np.zeros(len(text), np.int8), np.zeros(len(starts(len(text))), bool)
            if everywhere:
                ran[k][:] = True
                yield from ((k, w) for w in range(len(ran[k])))
            else:
                for m in _CUE.finditer(text):
                    yield from ask(k, m.start() // STRIDE - 1)
                    yield from ask(k, m.start() // STRIDE)

    todo: Iterator[tuple[int, int]] = first()
    while held := list(itertools.islice(todo, TOGETHER)):
        parts = [coded[k][w * STRIDE : w * STRIDE + WIDTH] for k, w in held]
        decoded = net.decode(np.stack([np.pad(part, (0, WIDTH - len(part))) for part in parts]))
        more: list[tuple[int, int]] = []
        for (k, w), row in zip(held, decoded, strict=True):
            a, b = w * STRIDE + (margin if w else 0), min(len(tags[k]), w * STRIDE + (WIDTH - margin if w < len(ran[k]) - 1 else WIDTH))
            tags[k][a:b] = row[a - w * STRIDE : b - w * STRIDE]
            if row[a - w * STRIDE] and row[a - w * STRIDE] % 2 == 0:  # inside: it began before
                more += ask(k, w - 1)
            if row[b - 1 - w * STRIDE]:
                more += ask(k, w + 1)
        todo = itertools.chain(more, todo)
    out: list[list[Span]] = [[] for _ in texts]
    for k, row in tags.items():
        kind = (row + 1) // 2
        edge = np.flatnonzero(np.r_[True, (kind[1:] != kind[:-1]) | (row[1:] % 2 == 1), True])
        out[k] = [(int(kind[a]) - 1, int(a), int(b)) for a, b in zip(edge[:-1], edge[1:], strict=True) if kind[a]]
    return out


def spans_of(net: Tagger, texts: list[str | None], everywhere: bool = False) -> tuple[list[list[Span]], list[list[Span]]]:
    """Base spans and all spans of each text, sorted by kind and start."""
    whole = [t or "" for t in texts]
    base = [base_spans(t) if _CUE.search(t) else [] for t in whole]
    both = []
    for text, fixed, more in zip(whole, base, found_by(net, whole, everywhere), strict=True):
        new = [s for s in more if of_form(s[0], text[s[1] : s[2]])]
        if new and fixed:
            order = sorted((a, b) for _, a, b in fixed)
            ends = np.maximum.accumulate([b for _, b in order])
            at = np.searchsorted([a for a, _ in order], [s[2] for s in new]) - 1
            new = [s for s, k in zip(new, at, strict=True) if k < 0 or ends[k] <= s[1]]
        both.append(sorted(fixed + new))
    return base, both


def scan(docs: DataFrame, net: Tagger, text_col: str = "text") -> Column:
    """A column of (base, spans): arrays of (kind, start, end)."""
    held = docs.sparkSession.sparkContext.broadcast(net.p)

    @F.pandas_udf("base array<array<int>>, spans array<array<int>>")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = Tagger.__new__(Tagger)
        own.p = held.value
        for texts in parts:
            base, both = spans_of(own, texts.tolist())
            yield pd.DataFrame({"base": [[list(s) for s in b] for b in base], "spans": [[list(s) for s in b] for b in both]})

    return of(F.col(text_col))


def joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x[0] + 1), x[1], x[2])))


def op4_bilstm_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = text_batches(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = docs.withColumn("_f", scan(docs, default_tagger())).select("doc_id", "_f.base", "_f.spans")
    count = lambda k: F.size(F.filter("base", lambda x: x[0] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", *map(count, range(len(KINDS))), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


QUERIES = {"op4_bilstm_crf": op4_bilstm_crf}
#: None: a trained network has no counterpart in SQL. tests/llm/test_pii.py has plain patterns and held-out accuracy.
SQL: dict[str, str] = {}
