"""Personal data by rules and by a character-level bidirectional LSTM with CRF transitions, trained in numpy from labelled spans.

The four kinds have rules, whose matches always stay. The tagger adds spans that the rules miss, such as phone numbers without a plus sign or
addresses spelt out with "(at)" and "dot". It is trained on EXAMPLES texts whose spans are known: spans planted in prose, which is generated
and, for a table of documents, comes from PROSE_ROWS of them, and things that look like spans and are none. Its weights are kept in the
shared folder under a hash of what they were made from, so other sessions find them.

Overlapping windows over the whole of every text are all read, in both directions, and decoded together: where the score of "outside" leads at
every character by more than transitions can make up, the best path is all outside, and only other windows need the search for it. Each
character's tag is that of the window in which it is most central, and spans are read from the joined tags of the whole text.

Defined results: null and empty texts hold nothing. Each row comes out once, also repeated ones. No documents give no rows.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F

from .spark_io import shared_dir

KINDS = ("email", "ip", "card", "phone")
RULES = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
TAGS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
WINDOW, STRIDE, TOGETHER = 1024, 976, 384
#: Characters of a window in training.
LESSON = 96
SYMBOLS = 100  # 0 is what follows a text's end; printable ASCII, newline, other letters, other characters
EMBED, HIDDEN, EXAMPLES, EPOCHS, SEED = 12, 8, 2500, 12, 7
#: Documents whose prose the examples use, and characters of each.
PROSE_ROWS, PROSE_CHARS = 200, 1500


def digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def luhn(s: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(s)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _holds(kind: str, s: str) -> bool:
    """Whether a rule's match is one of the kind."""
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in s.split("."))
    if kind == "card":
        return 16 <= len(d := digits(s)) <= 19 and luhn(d)
    return kind == "email" or 8 <= len(digits(s)) <= 15


def rule_spans(text: str) -> list[tuple[str, int, int]]:
    if "@" not in text and not re.search("[0-9]", text):
        return []
    needs = {"email": "@", "ip": ".", "card": "", "phone": "+"}
    return [(k, m.start(), m.end()) for k in KINDS if needs[k] in text for m in RULES[k].finditer(text) if _holds(k, m.group())]


def _plausible(kind: str, s: str) -> bool:
    """What a span of the tagger must hold: figures for the numeric kinds, an at sign or its name for addresses."""
    n = len(digits(s))
    if kind == "email":
        return bool(re.fullmatch(r"[\w.%+-]+( ?(@|[(\[]at[)\]]) ?| at )[\w-]+(( ?(\.|[(\[]dot[)\]]) ?| dot )[\w-]+)+", s))
    if kind == "ip":
        parts = re.findall("[0-9]+", s)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    return 13 <= n <= 19 and luhn(digits(s)) if kind == "card" else 10 <= n <= 15 and len(re.findall(r"[^0-9+() .-]", s)) == 0


_CODES = np.array([p - 31 if 32 <= p < 127 else 96 if p == 10 else 97 if 0xC0 <= p < 0x2000 else 98 for p in range(0x2001)], np.uint8)


def codes(text: str) -> np.ndarray:
    """Symbols of a text's characters."""
    return _CODES[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), 0x2000)]


def labelled_windows(n: int, seed: int, prose: tuple[str, ...] = ()) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Texts with the spans they hold, between generated words or, where there is prose, half of them between parts of it; about a third hold none, but
    years, prices, dates and versions."""
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[rng.integers(len(x))]
    num = lambda k: "".join(str(rng.integers(10)) for _ in range(k))
    word = lambda: "".join(pick("ba", "re", "ti", "on", "sh", "wh", "er", "in", "ou", "th", "la", "me", "é", "st") for _ in range(rng.integers(1, 4)))

    def card() -> str:
        d = num(15)
        d += next(str(c) for c in range(10) if luhn(d + str(c)))
        return pick("", " ", "-", "/", ".").join(d[i : i + 4] for i in range(0, 16, 4))

    plain = "the to of and or is at in on my our your please write call ring now today this that for with from it was are will number card host address name here there ok".split()

    def between() -> str:
        """Some words, of generated ones and common ones, or as they stand in prose."""
        if prose and rng.random() < 0.5:
            text = prose[rng.integers(len(prose))]
            at = rng.integers(max(1, len(text) - 60))
            return text[at : at + rng.integers(8, 60)].strip() or word()
        return " ".join(pick(word(), pick(*plain)) for _ in range(rng.integers(1, 6)))

    def span() -> tuple[str, str]:
        kind = pick(*KINDS)
        a, b, c = word() + pick("", num(2)), word(), pick("com", "org", "net", "example")
        if kind == "email":
            return kind, pick(f"{a}@{b}.{c}", f"{a}.{word()}@{b}.{c}", f"{a} (at) {b} (dot) {c}", f"{a}(at){b}.{c}", f"{a} @ {b}.{c}", f"{a}[at]{b}[dot]{c}", f"{a} [at] {b} [dot] {c}", f"{a} at {b} dot {c}", f"{a}(at){b}(dot){c}")
        if kind == "ip":
            p = [str(rng.integers(256)) for _ in range(4)]
            return kind, pick(".".join(p), ".".join(p), "[.]".join(p))
        if kind == "card":
            return kind, card()
        x, y, z = num(3), num(3), num(4)
        return kind, pick(f"+{num(1)} {x} {y} {z}", f"+{num(2)}-{x}-{y}{z}", f"({x}) {y}-{z}", f"{x}-{y}-{z}", f"{x}.{y}.{z}", f"{x} {y} {z}", f"00{num(2)} {x} {y} {z}", f"00{num(2)} {x} {num(7)}", f"+{num(1)} ({x}) {y}-{z}")

    def noise() -> str:
        return pick(str(rng.integers(1900, 2100)), f"{num(1)}.{num(2)}", f"{num(4)}-{num(2)}-{num(2)}", f"v{num(1)}.{num(1)}.{num(1)}", f"${num(3)},{num(3)}", f"{num(2)}:{num(2)}", f"{num(3)}%", num(5), f"{word()} at {word()}", f"at {word()} {num(2)}", f"@{word()}", f"#{num(4)}", num(8), f"id {num(9)}", f'token = "{rng.bytes(10).hex()}"')

    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(rng.integers(2, 5)):
            text += between() + pick(" ", " ", ", ", ": ", "\n", " (", " tel: ", " call ", " mail ", " is ", " dial ")
            if rng.random() < 0.5:
                kind, s = span()
                spans.append((kind, len(text), len(text) + len(s)))
                text += s
            elif rng.random() < 0.6:
                text += noise()
            text += pick(" ", ". ", ", ", "\n", ") ")
        out.append((text, spans))
    return out


def _tags(n: int, spans: list[tuple[str, int, int]]) -> np.ndarray:
    tags = np.zeros(n, np.int64)
    for kind, a, b in spans:
        tags[a:b] = TAGS.index(f"I-{kind}")
        tags[a] = TAGS.index(f"B-{kind}")
    return tags


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Tagger:
    """Weights and their gradients. Arrays are [time, batch, ...]; sequences are padded at the end and masked."""

    def __init__(self, embed: int = EMBED, hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.default_rng(seed)
        n = len(TAGS)
        self.w = {"e": rng.normal(0, 0.3, (SYMBOLS, embed)), "o": rng.normal(0, 0.2, (2 * hidden, n)), "ob": np.zeros(n), "t": rng.normal(0, 0.1, (n, n)), "s": np.zeros(n)}
        for d in "fb":
            self.w |= {f"{d}x": rng.normal(0, embed**-0.5, (embed, 4 * hidden)), f"{d}h": rng.normal(0, hidden**-0.5, (hidden, 4 * hidden)), f"{d}b": np.repeat([0.0, 1.0, 0.0, 0.0], hidden)}
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def _run(self, d: str, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, list]:
        h = c = np.zeros((x.shape[1], self.w[f"{d}h"].shape[0]), np.float32)
        out, kept = np.empty((*x.shape[:2], h.shape[1]), np.float32), []
        gates = x @ self.w[f"{d}x"] + self.w[f"{d}b"]
        for t in range(len(x)):
            i, f, o, g = np.split(gates[t] + h @ self.w[f"{d}h"], 4, axis=1)
            i, f, o, g = _sigmoid(i), _sigmoid(f), _sigmoid(o), np.tanh(g)
            m = mask[t][:, None]
            c1 = f * c + i * g
            tc = np.tanh(c1)
            kept.append((h, c, i, f, o, g, tc, m))
            h, c = m * o * tc, m * c1
            out[t] = h
        return out, kept

    def _back(self, d: str, x: np.ndarray, kept: list, dout: np.ndarray, grad: dict) -> np.ndarray:
        dh, dc = np.zeros_like(kept[0][0]), np.zeros_like(kept[0][0])
        dgates = np.empty((*x.shape[:2], 4 * dh.shape[1]), np.float32)
        for t in range(len(x) - 1, -1, -1):
            h, c, i, f, o, g, tc, m = kept[t]
            dh = (dh + dout[t]) * m
            dc = dc * m + dh * o * (1 - tc**2)
            dgates[t] = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g**2)], axis=1)
            grad[f"{d}h"] += h.T @ dgates[t]
            dh, dc = dgates[t] @ self.w[f"{d}h"].T, dc * f
        grad[f"{d}x"] += np.einsum("tbe,tbg->eg", x, dgates, optimize=True)
        grad[f"{d}b"] += dgates.sum((0, 1))
        return dgates @ self.w[f"{d}x"].T

    def scores(self, chars: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, tuple]:
        x = self.w["e"][chars]
        front, kf = self._run("f", x, mask)
        back, kb = self._run("b", x[::-1], mask[::-1])
        h = np.concatenate([front, back[::-1]], axis=2)
        return h @ self.w["o"] + self.w["ob"], (x, h, kf, kb)

    def gradient(self, chars: np.ndarray, mask: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        """Loss and gradients of a batch: the CRF's log likelihood of the tags."""
        score, (x, h, kf, kb) = self.scores(chars, mask)
        steps, batch, n = score.shape
        trans = self.w["t"]
        alpha, beta = np.empty_like(score), np.zeros_like(score)
        top = lambda v, ax: (m := v.max(ax, keepdims=True)).squeeze(ax) + np.log(np.exp(v - m).sum(ax))
        alpha[0] = score[0] + self.w["s"]
        for t in range(1, steps):
            alpha[t] = np.where(mask[t][:, None] > 0, top(alpha[t - 1][:, :, None] + trans, 1) + score[t], alpha[t - 1])
        for t in range(steps - 2, -1, -1):
            beta[t] = np.where(mask[t + 1][:, None] > 0, top(trans + (score[t + 1] + beta[t + 1])[:, None, :], 2), beta[t + 1])
        whole = top(alpha[-1], 1)
        prob = np.exp(alpha + beta - whole[:, None]) * mask[:, :, None]
        gold = np.eye(n, dtype=np.float32)[tags] * mask[:, :, None]
        grad = {k: np.zeros_like(v) for k, v in self.w.items()}
        dscore = (prob - gold).astype(np.float32)
        grad["s"] = dscore[0].sum(0)
        log_gold = (score * gold).sum() + (gold[0] * self.w["s"]).sum()
        for t in range(1, steps):
            m = mask[t][:, None, None]
            pair = np.exp(alpha[t - 1][:, :, None] + trans + (score[t] + beta[t])[:, None, :] - whole[:, None, None]) * m
            real = gold[t - 1][:, :, None] * gold[t][:, None, :]
            grad["t"] += (pair - real).sum(0)
            log_gold += (real * trans).sum()
        grad["o"] = np.einsum("tbh,tbn->hn", h, dscore, optimize=True)
        grad["ob"] = dscore.sum((0, 1))
        dh = dscore @ self.w["o"].T
        half = dh.shape[2] // 2
        dx = self._back("f", x, kf, dh[:, :, :half], grad) + self._back("b", x[::-1], kb, dh[::-1, :, half:], grad)[::-1]
        np.add.at(grad["e"], chars, dx)
        return float(whole.sum() - log_gold) / batch, {k: v / batch for k, v in grad.items()}

    def decode(self, chars: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """The best tags [time, batch]."""
        score, _ = self.scores(chars, mask)
        best, came = score[0] + self.w["s"], np.zeros(score.shape, np.int64)
        for t in range(1, len(score)):
            step = best[:, :, None] + self.w["t"]
            came[t] = step.argmax(1)
            on = mask[t][:, None] > 0
            came[t] = np.where(on, came[t], np.arange(score.shape[2]))
            best = np.where(on, step.max(1) + score[t], best)
        tags = np.empty(score.shape[:2], np.int64)
        tags[-1] = best.argmax(1)
        for t in range(len(score) - 1, 0, -1):
            tags[t - 1] = np.take_along_axis(came[t], tags[t][:, None], 1)[:, 0]
        return tags


def _batch(items: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray]:
    out, mask = np.zeros((length, len(items)), np.int64), np.zeros((length, len(items)), np.float32)
    for k, x in enumerate(items):
        out[: len(x), k], mask[: len(x), k] = x[:length], 1
    return out, mask


def train(examples: list[tuple[str, list]], epochs: int = EPOCHS, seed: int = SEED, size: int = 50, rate: float = 0.012) -> Tagger:
    """Adam over windows of the labelled texts."""
    pieces = []
    for text, spans in examples:
        c, t = codes(text), _tags(len(text), spans)
        pieces += [(c[i : i + LESSON], t[i : i + LESSON]) for i in range(0, max(1, len(c) - LESSON // 2), LESSON)]
    tagger, rng = Tagger(seed=seed), np.random.default_rng(seed)
    m, v = ({k: np.zeros_like(x) for k, x in tagger.w.items()} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        for part in np.array_split(rng.permutation(len(pieces)), max(1, len(pieces) // size)):
            chars, mask = _batch([pieces[i][0] for i in part], LESSON)
            tags, _ = _batch([pieces[i][1] for i in part], LESSON)
            _, grad = tagger.gradient(chars, mask, tags)
            step += 1
            norm = np.sqrt(sum(float((g**2).sum()) for g in grad.values()))
            for k, g in grad.items():
                g = g * min(1.0, 5 / (norm + 1e-9))
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g**2
                pace = rate * (1 - epoch / epochs) + 0.001
                tagger.w[k] -= (pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return tagger


@functools.lru_cache(2)
def trained(prose: tuple[str, ...] = ()) -> Tagger:
    return train(labelled_windows(EXAMPLES, SEED, prose))


class Reader:
    """A tagger's weights laid out for reading many windows side by side: gates as one product, sigmoids as hyperbolic tangents of half their argument."""

    def __init__(self, tagger: Tagger):
        w = tagger.w
        h = w["fh"].shape[0]
        half = np.repeat(np.float32([0.5, 0.5, 0.5, 1.0]), h)[:, None]
        self.hidden, self.sides = h, {}
        for d in "fb":
            gates = (w["e"] @ w[f"{d}x"] + w[f"{d}b"]).T * half
            # behind a text's end no gate lets anything in, so a window that ends early reads as if it ended there
            gates[:h, 0] = -40
            self.sides[d] = np.ascontiguousarray(gates, np.float32), np.ascontiguousarray(w[f"{d}h"].T * half, np.float32)
        self.out, self.bias, self.step, self.start = np.ascontiguousarray(w["o"].T, np.float32), w["ob"], w["t"], w["s"]
        # what a run of other tags can gain by its transitions, against staying outside: once, and for each character after its first
        stay, enter, leave = (float(x) for x in (self.step[0, 0], self.step[0, 1:].max(), self.step[1:, 0].max()))
        begin = float((self.start[1:] - self.start[0]).max())
        self.once, self.each = enter + leave - 2 * stay + 1e-3, float(self.step[1:, 1:].max()) - stay + 1e-3
        # more for runs that begin or end with a window, which enter or leave by no transition
        self.at_begin, self.at_end = max(0.0, begin + stay - enter), max(0.0, stay - leave)

    def _side(self, d: str, chars: np.ndarray) -> np.ndarray:
        """States [hidden, time, window] from the front (f) or the back (b)."""
        steps, width, h = *chars.shape, self.hidden
        gates, back = self.sides[d]
        out, state, cell = np.empty((h, steps, width), np.float32), np.zeros((h, width), np.float32), np.zeros((h, width), np.float32)
        now, more, bent = np.empty((4 * h, width), np.float32), np.empty((4 * h, width), np.float32), np.empty((h, width), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            np.take(gates, chars[t], axis=1, out=now, mode="clip")
            np.dot(back, state, out=more)
            now += more
            np.tanh(now, out=now)
            open_, new = now[: 3 * h], now[3 * h :]
            open_ += 1
            open_ *= 0.5
            cell *= open_[h : 2 * h]
            new *= open_[:h]
            cell += new
            np.tanh(cell, out=bent)
            np.multiply(open_[2 * h :], bent, out=state)
            out[:, t] = state
        return out

    def decode(self, windows: list[np.ndarray]) -> list[tuple[int, int, np.ndarray]]:
        """(window, place, tags) of all stretches in which the best path may be anything but outside.

        A run of other tags on the best path makes up for what it lacks against "outside" at its characters by its transitions, so only characters
        that some run with enough of both may cover are looked at; all others are outside.
        """
        steps = max(map(len, windows))
        chars = np.zeros((steps, len(windows)), np.uint8)
        for k, x in enumerate(windows):
            chars[: len(x), k] = x
        h = self.hidden
        score = np.dot(self.out[:, :h], self._side("f", chars).reshape(h, -1))
        score += np.dot(self.out[:, h:], self._side("b", chars).reshape(h, -1))
        score += self.bias[:, None]
        score = score.reshape(len(TAGS), *chars.shape)
        lengths = np.array([len(w) for w in windows])
        gain = score[1:].max(0) - score[0] + self.each
        gain[0] += self.at_begin
        gain[lengths - 1, np.arange(len(windows))] += self.at_end
        gain[chars == 0] = -1e30
        before, after = gain.copy(), gain.copy()
        for t in range(1, steps):
            before[t] += np.maximum(before[t - 1], 0)
        for t in range(steps - 2, -1, -1):
            after[t] += np.maximum(after[t + 1], 0)
        open_ = ((before + after - gain + self.once - self.each >= 0) & (chars > 0)).T
        edges = np.diff(np.pad(open_, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        (column, first), (_, stop) = np.nonzero(edges == 1), np.nonzero(edges == -1)
        # with the characters around a stretch, which are outside
        lo, hi = np.maximum(first - 1, 0), np.minimum(stop + 1, lengths[column])
        out, order = [], np.argsort(hi - lo, kind="stable")
        for part in np.array_split(order, -(-len(order) // 2048) or 1):
            if len(part):
                place = lo[part] + np.arange((hi - lo)[part].max())[:, None]
                on = place < hi[part]
                tags = self._best(score[:, np.minimum(place, steps - 1), column[part]].transpose(1, 0, 2), on, first[part] == 0, stop[part] == lengths[column[part]])
                out += [(int(column[j]), int(lo[j]), tags[: hi[j] - lo[j], k]) for k, j in enumerate(part)]
        return out

    def _best(self, score: np.ndarray, on: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The best paths of stretches (time, tag, stretch); those that neither begin nor end a window begin and end outside."""
        best = np.where(begins, score[0] + self.start[:, None], np.where(np.arange(len(TAGS))[:, None] == 0, score[0], -np.inf))
        came, same = np.zeros(score.shape, np.uint8), np.arange(score.shape[1], dtype=np.uint8)[:, None]
        for t in range(1, len(score)):
            step = best[:, None] + self.step[:, :, None]
            came[t] = np.where(on[t], step.argmax(0), same)
            best = np.where(on[t], step.max(0) + score[t], best)
        tags = np.empty((len(score), score.shape[2]), np.int64)
        tags[-1] = np.where(ends, best.argmax(0), 0)
        for t in range(len(score) - 1, 0, -1):
            tags[t - 1] = np.take_along_axis(came[t], tags[t][None], 0)[0]
        return tags


def tagger_spans(tagger: Tagger, texts: list[str], together: int = TOGETHER) -> list[list[tuple[str, int, int]]]:
    """Spans of whole texts, from overlapping windows: a character's tag comes from the window in which it is most central."""
    reader, tags, jobs = Reader(tagger), [None] * len(texts), []
    for k, text in enumerate(texts):
        if text:
            c, last = codes(text), max(0, -(-(len(text) - WINDOW) // STRIDE))
            jobs += [(k, i, last, c[i * STRIDE : i * STRIDE + WINDOW]) for i in range(last + 1)]
    # windows of about one length are read together
    jobs.sort(key=lambda j: len(j[3]))
    edge = (WINDOW - STRIDE) // 2
    for first in range(0, len(jobs), together):
        part = jobs[first : first + together]
        for column, place, got in reader.decode([j[3] for j in part]):
            k, i, last, c = part[column]
            lo, hi = max(edge if i else 0, place), min(len(c) if i == last else edge + STRIDE, place + len(got))
            if lo < hi and got.any():
                tags[k] = np.zeros(len(texts[k]), np.int64) if tags[k] is None else tags[k]
                tags[k][i * STRIDE + lo : i * STRIDE + hi] = got[lo - place : hi - place]
    return [_read_spans(t) if t is not None else [] for t in tags]


def _read_spans(tags: np.ndarray) -> list[tuple[str, int, int]]:
    out, at = [], 0
    marked = np.flatnonzero(tags)
    while at < len(marked):
        start = int(marked[at])
        kind = TAGS[tags[start]][2:]
        inside, stop = TAGS.index(f"I-{kind}"), start + 1
        while stop < len(tags) and tags[stop] == inside:
            stop += 1
        out.append((kind, start, stop))
        at = int(np.searchsorted(marked, stop))
    return out


def _completed(text: str, a: int, b: int) -> tuple[int, int]:
    """A span with the whole of the words that it begins and ends in, and an opening bracket whose closing one it holds."""
    while a > 0 and text[a - 1].isalnum() and text[a].isalnum():
        a -= 1
    while b < len(text) and text[b].isalnum() and text[b - 1].isalnum():
        b += 1
    return (a - 1 if a > 0 and text[a - 1] == "(" and text.count(")", a, b) > text.count("(", a, b) else a), b


def all_spans(tagger: Tagger, texts: list[str]) -> Iterator[tuple[list, list]]:
    """(rule spans, all spans) of each text: a span of the tagger counts if it is plausible and touches no span of a rule."""
    for text, extra in zip(texts, tagger_spans(tagger, texts), strict=True):
        base = rule_spans(text)
        extra = {(k, *_completed(text, a, b)) for k, a, b in extra}
        more = [(k, a, b) for k, a, b in extra if _plausible(k, text[a:b]) and not any(a < y and x < b for _, x, y in base)]
        yield base, sorted([*base, *more], key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def _written(spans: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


_OUT = {"doc_id": pa.int64(), "n_email": pa.int64(), "n_ip": pa.int64(), "n_card": pa.int64(), "n_phone": pa.int64(), "base_sha256": pa.string(), "spans": pa.string()}


def _find(tagger: Tagger):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                found = list(all_spans(tagger, [t or "" for t in part.column("text").to_pylist()]))
                counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
                digests = [hashlib.sha256(_written(base).encode()).hexdigest() for base, _ in found]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *counts, pa.array(digests, pa.string()), pa.array([_written(s) for _, s in found], pa.string())], list(_OUT))

    return find


def prose_of(docs: DataFrame, rows: int = PROSE_ROWS) -> tuple[str, ...]:
    """The first PROSE_CHARS characters of `rows` documents (doc_id, text), those with the smallest hashes of their ids, where no rule finds anything."""
    ids = [r[0] for r in docs.where("doc_id is not null").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect()]
    texts = docs.where(F.col("doc_id").isin(ids)).select("doc_id", F.substring("text", 1, PROSE_CHARS).alias("t")).where("t is not null").orderBy("doc_id", "t").limit(2 * rows).collect() if ids else []
    return tuple(r.t for r in texts if not re.search("[0-9@]", r.t))


def tagger_for(docs: DataFrame) -> Tagger:
    """A tagger trained on spans planted in the prose of docs, or the one that was, from the shared folder."""
    spark, prose = docs.sparkSession, prose_of(docs)
    made_from = hashlib.sha256(repr((EMBED, HIDDEN, EXAMPLES, EPOCHS, SEED, prose)).encode()).hexdigest()
    path = f"{shared_dir(spark).rpartition('/')[0]}/veriquill-tagger-{made_from}"
    try:
        kept = spark.read.schema("name string, shape array<int>, w array<float>").parquet(path).collect()
    except AnalysisException:
        kept = []
    tagger = Tagger()
    if {r.name for r in kept} == set(tagger.w):
        tagger.w = {r.name: np.array(r.w, np.float32).reshape(r.shape) for r in kept}
        return tagger
    tagger = trained(prose)
    rows = [(k, list(v.shape), v.ravel().tolist()) for k, v in tagger.w.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, w array<float>").coalesce(1).write.mode("overwrite").parquet(path)
    return tagger


def find_personal_data(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of each row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(_find(tagger or tagger_for(docs)), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
