"""Personal data (operator 10): fixed patterns give the base spans; a linear-chain conditional random field over word shapes, trained from the
small labelled table of `labelled()` and decoded by Viterbi in numpy batches, adds spans that the patterns miss (obfuscated addresses, phone
numbers without a country code or glued to other numbers, cards and addresses with unusual separators or broken over lines).

Base, leftmost non-overlapping in each kind: email, ip (parts at most 255), card (12 to 19 digits, Luhn), phone (9 to 15 digits); a match that fails its
test is dropped and nothing inside it is tried again. The field decides on added spans; besides, a span must pass its kind's numeric test (ip: four numbers up
to 255; card: 12 to 19 digits, Luhn; phone: 7 to 15 digits) and never overlaps a base span. Offsets are code points, end exclusive. Null counts as
empty; a text without spans gives counts 0 and empty lists. Repeated rows are treated alike; an empty table gives an empty result; other columns, whatever
their names, play no part. Texts and words of any length are processed whole, in time linear in their length.

The field's sequences are the runs of words within REACH words of one that holds a digit, an @ or a bracket, or is `dot`; these are what the model is
trained and decoded on. Every other word is outside of all spans by definition, so plain prose costs next to nothing. A word's features are its shape (runs of letters
are one x, digits d each), its shape with runs of digits as one d, the set of its signs, and a few flags; shapes of more than SHAPE signs share one
feature, and more than 20 digits count as 20: what a long word is made of still shows in the other features."""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.common import as_bytes, by_bytes, pieces, text_of, tidily, word_bounds
from quernstone.session import table

REACH, SHAPE = 3, 24
KINDS = ("email", "ip", "card", "phone")
LABELS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_ip = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_card = re.compile(r"[0-9](?:[ -]?[0-9])+")
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_local_chars = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end), sorted."""
    out = []
    at, free = text.find("@"), 0
    while at >= 0:
        a = at
        while a > free and text[a - 1] in _local_chars:
            a -= 1
        m = _domain.match(text, at + 1) if a < at else None
        if m:
            out.append((a, 0, m.end()))
            free = m.end()
            at = text.find("@", free)
        else:
            free = at + 1  # no match can hold this @
            at = text.find("@", free)
    for m in _ip.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _card.finditer(text):
        if m.end() - m.start() >= 12:
            d = _digits(m.group())
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
    for m in _phone.finditer(text):
        if 9 <= len(_digits(m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    out.sort()
    return out


# The field. A word's features come from its shape alone.

_brackets = str.maketrans("", "", "()[]{}<>.,;:'\"!?#$%&*|")
_cues = {"tel": "TEL", "telephone": "TEL", "phone": "TEL", "mobile": "TEL", "call": "TEL", "fax": "TEL", "card": "CARD", "visa": "CARD", "mastercard": "CARD", "email": "MAIL", "mail": "MAIL", "e-mail": "MAIL", "ip": "IP", "host": "IP"}
_tops = "com org net edu gov io info co uk de fr es eu".split()
_ends = frozenset(_tops)


def plain(word: str) -> bool:
    """Whether a word can't be in a span: the test that word_flags makes on bytes."""
    return not re.search(r"[0-9@(\[{]", word) and word not in ("dot", "DOT", "Dot")


def _core(word: str) -> str:
    """word without signs at its ends, but for those that a span may begin or end with."""
    a, b = 0, len(word)
    while a < b and not (word[a].isalnum() or word[a] in "_([{+@"):
        a += 1
    while a < b and not (word[b - 1].isalnum() or word[b - 1] in "_)]}"):
        b -= 1
    return word[a:b]


def features(word: str) -> tuple[str, ...]:
    low = word.lower()
    bare = low.translate(_brackets)
    cue = _cues.get(bare, "")
    if bare in ("at", "dot") or bare == "@":
        return ("SEP" + bare, "SEP" + bare + ("[" if low.strip(".,;:!?") != bare else ""))
    if plain(word):
        return ("PLAIN", "cue" + cue) if cue else ("PLAIN", "end") if bare in _ends else ("PLAIN",)
    core = _core(low)
    shape = re.sub(r"[0-9]", "d", re.sub(r"[^\W\d_]+", "x", core))
    n = shape.count("d")
    short = re.sub(r"d+", "d", shape)
    opens, closes = min((i for i in map(core.find, "([{") if i >= 0), default=-1), max(map(core.rfind, ")]}"))
    made = ["shape:" + (shape if len(shape) <= SHAPE else "long"), "short:" + (short if len(short) <= SHAPE else "long"), "set:" + "".join(sorted(set(short))), f"digits:{min(n, 20)}", f"letters:{'x' in short}", f"brackets:{0 <= opens < closes}"]
    words = re.findall(r"[a-z]+", core)
    made.append(f"at:{'@' in core or 'at' in words}:{'dot' in words}:{words[-1] in _ends if words else ''}")
    if 12 <= n <= 19 and "x" not in short:
        made.append(f"luhn:{luhn(_digits(core))}")
    return (*made, "cue" + cue) if cue else tuple(made)


def word_flags(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which words aren't plain."""
    mark = np.zeros(256, np.uint8)
    mark[[*range(48, 58), *b"@([{"]] = 1
    hits = np.flatnonzero(mark[buf])
    out = np.searchsorted(hits, ends) > np.searchsorted(hits, starts)
    three = np.flatnonzero(ends - starts == 3)
    s = starts[three]
    low = buf[s] | 32
    same = (low == ord("d")) & (((buf[s + 1] == ord("o")) & (buf[s + 2] == ord("t"))) | ((buf[s] == ord("D")) & (buf[s + 1] == ord("O")) & (buf[s + 2] == ord("T"))))
    out[three[same]] = True
    return out


class Model:
    """weights: for each feature, the scores it gives to the labels of the word before, the word itself and the word after it."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.index, self.weights, self.moves, self.memo = index, weights, moves, {}

    def __reduce__(self):
        return Model, (self.index, self.weights, self.moves)

    def scores(self, word: str) -> np.ndarray:
        """Rows 0, 1, 2: what the word adds to the scores of the word before it, its own, and the word after it."""
        got = self.memo.get(word)
        if got is None:
            ids = [self.index[f] for f in features(word) if f in self.index]
            got = self.weights[ids].sum(0) if ids else np.zeros((3, len(LABELS)))
            if len(word) <= 100:
                if len(self.memo) > 20_000:
                    self.memo.clear()
                self.memo[word] = got
        return got

    def emissions(self, runs: list[list[str]]) -> np.ndarray:
        """Of all runs' words, one run after another: each word's scores for each label."""
        number: dict[str, int] = {}
        at = np.array([number.setdefault(w, len(number)) for r in runs for w in r], int)
        if not len(at):
            return np.zeros((0, len(LABELS)))
        table_ = np.stack([self.scores(w) for w in number])
        run = np.repeat(np.arange(len(runs)), [len(r) for r in runs])
        out, same = table_[at, 1], run[1:] == run[:-1]
        out[:-1][same] += table_[at[1:][same], 0]
        out[1:][same] += table_[at[:-1][same], 2]
        return out

    def decode(self, runs: list[list[str]]) -> list[np.ndarray]:
        """Viterbi over runs of words, all of one power of two in length at once. O stands before and after each."""
        out: list[np.ndarray] = [np.empty(0, int)] * len(runs)
        sizes = np.array([len(r) for r in runs], int)
        begin = np.cumsum(sizes) - sizes
        every = np.vstack([self.emissions(runs), np.zeros((1, len(LABELS)))])
        for bit in np.unique(np.ceil(np.log2(np.maximum(sizes, 1)))).tolist():
            own = np.flatnonzero(np.ceil(np.log2(np.maximum(sizes, 1))) == bit)
            at_once = max(1, 100_000 // 2 ** int(bit))
            for o in range(0, len(own), at_once):
                part = own[o : o + at_once]
                n, most, rows = sizes[part], int(sizes[part].max()), np.arange(len(part))
                places = begin[part][:, None] + np.arange(most + 1)
                e = every[np.where(np.arange(most + 1) < n[:, None], places, len(every) - 1)]
                best = np.full((len(part), len(LABELS)), -1e9)
                best[:, 0] = 0
                back = np.zeros((len(part), most + 1, len(LABELS)), np.int8)
                final = np.zeros(len(part), int)
                for t in range(most + 1):
                    step = best[:, :, None] + self.moves[None]
                    back[:, t] = step.argmax(1)
                    best = step.max(1) + e[:, t]
                    at_end = n == t
                    final[at_end] = back[at_end, t, 0]  # the O after the run
                labels = np.zeros((len(part), most + 1), np.int8)
                for t in range(most, -1, -1):
                    now = t < n
                    labels[now, t] = final[now]
                    final[now] = back[rows[now], t, final[now]]
                for x, i in enumerate(part.tolist()):
                    out[i] = labels[x, : n[x]].astype(int)
        return out


def labelled(n: int = 900, seed: int = 11) -> list[tuple[list[str], list[int]]]:
    """The labelled table: n sentences of made-up words in which spans of each kind (and numbers that are none) stand, with a label for each word."""
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[int(rng.integers(len(x)))]
    d = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    w = lambda: "".join(chr(97 + x) for x in rng.integers(0, 26, int(rng.integers(2, 9))))

    def email():
        user = pick(w(), f"{w()}.{w()}", f"{w()}{d(2)}", f"{w()}.{d(2)}", f"{w()}_{w()}", f"{w()}-{d(1)}.{w()}")
        host = pick([w(), pick(*_tops)], [f"{w()}{d(1)}", "example", "com"], [w(), w(), pick(*_tops)], [w(), w()])
        way = int(rng.integers(0, 7))
        if way == 0:
            return [f"{user}@{'.'.join(host)}"]
        if way == 1:  # signs on their own
            return pick([user, "@", ".".join(host)], [f"{user}@", ".".join(host)], [user, f"@{'.'.join(host)}"])
        at, dot = pick(("(at)", "(dot)"), ("[at]", "[dot]"), ("{at}", "{dot}"), ("(at)", "dot"), ("[at]", "."), ("(AT)", "(DOT)"), ("[@]", "[.]"), ("(@)", "(.)"))
        if way == 2:
            return [user, at, *([".".join(host)] if dot == "." else [x for h in host for x in (h, dot)][:-1])]
        if way == 3:
            return [user + at + dot.join(host)]
        if way == 4:
            return [user, at, dot.join(host)]
        host[-1] = pick(*_tops)  # plain words are an address only if they end like one
        return [user, pick("at", "at", "AT", "@"), *[x for h in host for x in (h, pick("dot", "dot", "DOT"))][:-1]] if way == 5 else [user, "at", ".".join(host)]

    def ip():
        p = [str(x) for x in rng.integers(0, 256, 4)]
        return pick([".".join(p)], ["[.]".join(p)], ["(.)".join(p)], ["{.}".join(p)], [p[0] + "." + p[1] + "." + p[2] + "[.]" + p[3]], [p[0] + "[.]" + ".".join(p[1:])], [f"{p[0]}.{p[1]}.", f"{p[2]}.{p[3]}"], [x for h in p for x in (h, ".")][:-1], [x for h in p for x in (h, "dot")][:-1], ["[dot]".join(p)], ["(dot)".join(p)])

    def card():
        body = d(int(pick(15, 15, 15, 14, 12)))
        body += str(next(x for x in range(10) if luhn(body + str(x))))
        q = [body[i : i + 4] for i in range(0, len(body), 4)]
        half = pick("-", ".", "")
        return pick([body], q, ["-".join(q)], [".".join(q)], ["/".join(q)], ["_".join(q)], [half.join(q[:2]) + half, half.join(q[2:])], [half.join(q[:3]) + half, *q[3:]], [body[:8], body[8:]], [x for h in q for x in (h, "-")][:-1])

    def phone():
        a, b, c = d(3), d(3), d(4)
        return pick(["+1", f"({a})", f"{b}-{c}"], [f"({a})", f"{b}-{c}"], [f"{a}-{b}-{c}"], [f"{a}.{b}.{c}"], [f"0{d(2)}-{d(7)}"], [f"1-{a}-{b}-{c}"], [f"({a}){b}-{c}"], [f"00{d(2)}", a, d(7)], ["1", f"({a})", f"{b}-{c}"], ["1", a, f"{b}-{c}"],
                    [f"1.{a}.{b}.{c}"], [f"({a})", f"{b}.{c}"], [a, f"{b}-{c}"], [f"({a})", b, c], ["+1", f"({a})", f"{b}-", c], [f"({a})", f"{b}-", c], [f"{a}/{b}-{c}"], [f"{a}/{b}/{c}"], [f"+{d(2)}", a, b, c], [f"+{d(2)}{d(9)}"], ["00", "1", f"({a})", f"{b}-{c}"])

    def noise():
        return pick([d(8)], ["version", f"{d(1)}.{d(1)}"], [f"{d(1)}."], [w(), "at", w(), "dot", w()], [w(), "at", "the", "dot"], [f"{pick('19', '20')}{d(2)}{pick('-', '-', '.')}{pick('01', '12')}-{d(2)}"], [f"20{d(2)}-{d(2)}-{d(2)}"], [f"{d(2)}/{d(2)}/20{d(2)}"], [d(4)], [f"AKIA{d(2)}{w().upper()}{d(3)}"], [f"password={d(4)}{w()}{d(5)}"], ["token", "=", f'"{d(5)}{w()}{d(6)}"'],
                    ["token", "=", f'"{d(5)}{w()}{d(16)}{w()}{d(4)}"'], [f"{d(3)}{w()}{d(2)}{w()}{d(6)}"], [f"({w()})"], [f"[{d(1)}]"], [f"{d(2)}:{d(2)}"], [f"{d(2)}%"], ["at", w(), w()], ["dot"], ["dot"], ["dot", w()], ["the", "dot", w(), "at"], [f"{d(1)}.{d(1)}.{d(1)}"], [f"({d(4)})"], [w(), "at", w()], [f"{d(3)}-{d(2)}"], [f"https://{w()}.com/{d(3)}"], [f"{d(3)},{d(3)}"], [f"${d(2)}.{d(2)}"],
                    [f"x{d(2)}", f"[{w()}]"], [f"{w()}_{d(2)}"], [f"{w()}@{w()}"], ["@" + w()], [f"CC BY-NC {d(1)}.{d(1)}."], ["Version", f"{d(1)}.{d(1)}."], [f"{w()}", f"at", f"{d(2)}:{d(2)}"], ["1", w(), "2", w()], [f"({w()}", w() + ")"], [d(2), w(), d(2)], [f"{d(2)}-{d(2)}"], [d(1), d(2)])

    made = []
    for _ in range(n):
        words, labels = [], []
        for _ in range(int(rng.integers(1, 5))):
            for _ in range(int(rng.integers(0, 6))):
                words.append((w() if rng.random() < 0.75 else pick("de", "es", "in", "is", "the", "at", "co", "fr", "it", "of", "la", "en", "net", "dot")) + pick("", "", "", "", ",", "."))
                labels.append(0)
            k = int(rng.integers(0, 8))
            if k < 4:
                if rng.random() < 0.2:
                    words.append(("email", "ip", "card", "tel")[k])
                    labels.append(0)
                span = (email, ip, card, phone)[k]()
                labels += [1 + 2 * k] + [2 + 2 * k] * (len(span) - 1)
                span[-1] += pick("", "", "", ".", ",", "!!", "###")
                if rng.random() < 0.1:
                    span[0] = pick("<", '"', "|", "(") + span[0]
            else:
                span = noise()[0].split() if k == 7 and rng.random() < 0.2 else noise()
                labels += [0] * len(span)
                span[-1] += pick("", "", "", ".", "!!", "###")
            words += span
        words.append(w())
        labels.append(0)
        made.append((words, labels))
    return made


def train(rows: list[tuple[list[str], list[int]]], steps: int = 80, rate: float = 0.3, decay: float = 2e-4) -> Model:
    """Maximum likelihood by Adam; forward and backward sums over all sentences at once."""
    rows = [(w[a:b], y[a:b]) for w, y in rows for a, b in _runs(np.array([not plain(x) for x in w]))]
    index: dict[str, int] = {}
    per_word = [[[index.setdefault(f, len(index)) for f in features(w)] for w in words] for words, _ in rows]
    k, most, n = len(LABELS), max(len(r[0]) for r in rows), len(rows)
    sizes = np.array([len(r[0]) for r in rows])
    inside = np.arange(most)[None] < sizes[:, None]
    cell, feat, role = [], [], []  # a word's cell gets feature weights in a role
    for i, words in enumerate(per_word):
        for t, ids in enumerate(words):
            for r, at in ((0, t - 1), (1, t), (2, t + 1)):
                if 0 <= at < len(words):
                    cell += [i * most + at] * len(ids)
                    feat += ids
                    role += [r] * len(ids)
    cell, slot = np.array(cell), np.array(feat) * 3 + np.array(role)
    by_cell, by_slot = np.argsort(cell, kind="stable"), np.argsort(slot, kind="stable")

    def gather(w):
        rows_, first = np.unique(cell[by_cell], return_index=True)
        e = np.zeros((n * most, k))
        e[rows_] = np.add.reduceat(w[slot[by_cell]], first, axis=0)
        return e.reshape(n, most, k)

    def scatter(g):
        rows_, first = np.unique(slot[by_slot], return_index=True)
        out = np.zeros((len(index) * 3, k))
        out[rows_] = np.add.reduceat(g.reshape(n * most, k)[cell[by_slot]], first, axis=0)
        return out

    gold = np.zeros((n, most, k))
    gold_moves = np.zeros((k, k))
    for i, (_, labels) in enumerate(rows):
        gold[i, np.arange(len(labels)), labels] = 1
        np.add.at(gold_moves, ([0, *labels], [*labels, 0]), 1)
    banned = np.array([[b.startswith("I-") and a[2:] != b[2:] for b in LABELS] for a in LABELS])
    weights, moves = np.zeros((len(index) * 3, k)), np.zeros((k, k))
    state = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(moves), np.zeros_like(moves)]

    def total(x, axis):
        m = x.max(axis, keepdims=True)
        return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)

    for step in range(1, steps + 1):
        e = gather(weights)
        mv = np.where(banned, -1e4, moves)
        a = np.empty((n, most, k))
        a[:, 0] = mv[0] + e[:, 0]
        for t in range(1, most):
            a[:, t] = np.where(inside[:, t, None], total(a[:, t - 1, :, None] + mv[None], 1) + e[:, t], a[:, t - 1])
        z = total(a[:, -1] + mv[:, 0], 1)
        b = np.empty((n, most, k))
        b[:, -1] = mv[:, 0]
        for t in range(most - 2, -1, -1):
            b[:, t] = np.where(inside[:, t + 1, None], total(mv[None] + (e[:, t + 1] + b[:, t + 1])[:, None], 2), mv[:, 0])
        p = np.exp(a + b - z[:, None, None]) * inside[:, :, None]
        expected = np.zeros((k, k))
        expected[0] += p[:, 0].sum(0)
        expected[:, 0] += np.exp(a[:, -1] + mv[:, 0] - z[:, None]).sum(0)
        for t in range(1, most):
            expected += (np.exp(a[:, t - 1, :, None] + mv[None] + (e[:, t] + b[:, t])[:, None] - z[:, None, None]) * inside[:, t, None, None]).sum(0)
        grads = [scatter(p - gold) / n + decay * weights, (expected - gold_moves) / n + decay * moves]
        for x, (param, g) in enumerate(zip((weights, moves), grads)):
            m, v = state[2 * x], state[2 * x + 1]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            param -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8) * min(1.0, 40 / step)
    return Model(index, weights.reshape(len(index), 3, k), np.where(banned, -1e4, moves))


@functools.cache
def default_model() -> Model:
    return train(labelled())


_first = (re.compile(r"[A-Za-z0-9._%+-]"), re.compile(r"[0-9]"), re.compile(r"[0-9]"), re.compile(r"[0-9+(]"))


def _holds(kind: int, s: str) -> bool:
    """The numeric test of an added span."""
    d = _digits(s)
    if kind == 1:
        parts = re.findall(r"[0-9]+", s)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 12 <= len(d) <= 19 and luhn(d)
    return kind == 0 or 7 <= len(d) <= 15


def added_spans(text: str, base: list[tuple[int, int, int]], runs: list[tuple[list[tuple[int, int]], np.ndarray]]) -> list[tuple[int, int, int]]:
    """runs: the bounds of a run's words, and their labels."""
    out = []
    for run, labels in runs:
        for t in np.flatnonzero(labels % 2 == 1).tolist():
            end = t + 1
            while end < len(labels) and labels[end] == labels[t] + 1:
                end += 1
            a, b = run[t][0], run[end - 1][1]
            kind = int(labels[t] - 1) // 2
            m = _first[kind].search(text, a, b)
            if not m:
                continue
            a = m.start()
            while b > a and not (text[b - 1].isascii() and text[b - 1].isalnum()):
                b -= 1
            if b > a and _holds(kind, text[a:b]) and not any(x < b and a < y for x, _, y in base):
                out.append((a, kind, b))
    return out


def _runs(flag: np.ndarray, reach: int = REACH) -> list[tuple[int, int]]:
    """Ranges of words within reach of a flagged one."""
    at = np.flatnonzero(flag)
    if not len(at):
        return []
    split = np.flatnonzero(np.diff(at) > 2 * reach)
    los, his = at[np.concatenate([[0], split + 1])], at[np.concatenate([split, [len(at) - 1]])]
    return [(max(0, int(a) - reach), min(len(flag), int(b) + reach + 1)) for a, b in zip(los, his)]


def find(model: Model, texts: list[bytes]) -> Iterator[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """For each text its base spans and all its spans."""
    buf = np.frombuffer(b"".join(texts), np.uint8)
    lens = np.array([len(t) for t in texts], np.int64)
    cuts = np.cumsum(lens)
    starts, ends = word_bounds(buf, cuts)
    flags = word_flags(buf, starts, ends) if len(starts) else np.empty(0, bool)
    first = np.searchsorted(starts, cuts - lens)
    last = np.searchsorted(starts, cuts)
    any_flag = np.concatenate([[0], np.cumsum(flags)])
    found: list[tuple[str, list, list] | None] = []
    words: list[list[str]] = []
    for i, raw in enumerate(texts):
        lo, hi, begin = int(first[i]), int(last[i]), int(cuts[i] - lens[i])
        if any_flag[hi] == any_flag[lo]:
            found.append(None)
            continue
        text = raw.decode()
        s, e = starts[lo:hi] - begin, ends[lo:hi] - begin
        if len(text) != len(raw):
            points = np.concatenate([[0], np.cumsum((buf[begin : begin + lens[i]] & 0xC0) != 0x80)])
            s, e = points[s], points[e]
        bounds = [list(zip(s[a:b].tolist(), e[a:b].tolist())) for a, b in _runs(flags[lo:hi])]
        words += [[text[a:b] for a, b in run] for run in bounds]
        found.append((text, base_spans(text), bounds))
    labels = iter(model.decode(words))
    for x in found:
        if x is None:
            yield [], []
            continue
        text, base, bounds = x
        yield base, sorted(base + added_spans(text, base, [(run, next(labels)) for run in bounds]))


def _join(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


@tidily
def _rows(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = as_bytes(b.column(1))
        counts, sha, spans = [], [], []
        for lo, hi in pieces(texts, 1 << 20):
            for base, every in find(model, texts[lo:hi]):
                counts.append([sum(k == x for _, k, _ in base) for x in range(4)])
                sha.append(hashlib.sha256(_join(base).encode()).hexdigest())
                spans.append(_join(every))
        n = np.array(counts, np.int64).reshape(-1, 4)
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(n[:, x]) for x in range(4)), pa.array(sha, pa.string()), pa.array(spans, pa.string())], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])


def personal_data(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (of base spans), base_sha256, spans: one pass over the texts, nothing shuffled."""
    by_bytes(docs.sparkSession)
    plain_docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return plain_docs.mapInArrow(functools.partial(_rows, model or default_model()), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
