"""Personal data: fixed patterns, and a character-level BiLSTM-CRF trained in numpy.

The patterns give the base spans. The network (character classes in, forward and backward
LSTM, CRF transitions over outside / begin / inside of the four kinds) is trained on
labelled spans in sentences built from seeded templates, written-out forms included ("name
at host dot org"), and adds spans that no base span overlaps. Whole texts are covered by
overlapping windows; their label scores are averaged where windows overlap, and a run of
overlapping windows is decoded as one sequence, so a span on a seam is found once.

Every kind that the network knows holds a digit, an at sign, or a written-out address: "at"
between blanks or in brackets, and a name with a dot, or with "dot" so written, after it. A
window that has none of them can hold no admissible span and is not scored.

Offsets count code points, ends exclusive. Nulls, blanks: a null text counts as empty and
has no spans. Repeated rows are searched each. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import random
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegraph.llm.labelled import map_rows

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits that fails as a first part fails from any later digit too, so runs are entered at their start.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_OPEN, _CLOSE = r"[\[({]\s*", r"\s*[\])}]"
_DOT = rf"(?:\.|\s*{_OPEN}dot{_CLOSE}\s*|\s+dot\s+)"
# Between plain blanks both words are common ("was at home dot matrix"): there the dot is written out and the end is a usual one.
_END = "(?:[a-z]{2}|com|org|net|edu|gov|mil|int|info|biz|name|dev|app)"
_BRACKETED = rf"\s*{_OPEN}dot{_CLOSE}\s*"
_PLAIN = rf"\s+at\s+[\w-]+(?:(?:{_BRACKETED}|\s+dot\s+)[\w-]+)*(?:{_BRACKETED}[\w-]+|\s+dot\s+{_END})\b"
_WRITTEN = re.compile(rf"(?i)[\w.%+-]+(?:\s*{_OPEN}at{_CLOSE}\s*[\w-]+(?:{_DOT}[\w-]+)+|{_PLAIN})")
# Where any match of _WRITTEN has its at, or what a span of another form must hold.
_MARK = re.compile(rf"(?i)[0-9@]|(?:{_OPEN}at{_CLOSE}\s*|\sat\s+)[\w-]+{_DOT}[\w-]")

Span = tuple[str, int, int]


def emails(text: str) -> list[Span]:
    """Leftmost non-overlapping matches, in time linear in the text: each at sign is extended to the left."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            end = found.end()
            out.append(("email", start, end))
        at = text.find("@", max(at + 1, end if found else 0))
    return out


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The fixed patterns' spans, by kind and then by start."""
    out = emails(text) if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:3] or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


# ---- the network ---------------------------------------------------------------------

LABELS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
HIDDEN, CLASSES = 16, 40
WINDOW, OVERLAP = 192, 64
_MARKS = " \n\t@.+-()[]{}<>:;,_%/\\|#*'\"="


def char_class(c: str) -> int:
    """One of CLASSES small integers."""
    k = _MARKS.find(c)
    if k >= 0:
        return k
    if "0" <= c <= "9":
        return 29
    if c in "aotdAOTD":  # the letters of the written-out "at" and "dot"
        return 30 + "aotd".index(c.lower())
    if c.isalpha():
        return 34 if c.islower() else 35
    return 36 if c.isspace() else 37 if unicodedata.category(c).startswith("N") else 38


_ASCII = np.array([char_class(chr(i)) for i in range(128)], np.int64)


def encode_text(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.full(len(codes), 34, np.int64)
    low = codes < 128
    out[low] = _ASCII[codes[low]]
    for c in set(codes[~low].tolist()):
        out[codes == c] = char_class(chr(c))
    return out


def _sig(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _lstm(w: dict[str, np.ndarray], tag: str, x: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """Hidden states (time, batch, HIDDEN) for class ids (time, batch), and what the backward pass needs."""
    h = np.zeros((x.shape[1], HIDDEN))
    c, out, past = h, np.empty((*x.shape, HIDDEN)), []
    inputs = w[f"x{tag}"][x]
    for t in range(len(x)):
        z = inputs[t] + h @ w[f"h{tag}"]
        s = _sig(z[:, : 3 * HIDDEN])
        i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
        before, c = c, f * c + i * g
        th = np.tanh(c)
        if keep:
            past.append((h, before, i, f, o, g, th))
        h = o * th
        out[t] = h
    return out, past


def _lstm_back(w: dict[str, np.ndarray], grad: dict[str, np.ndarray], tag: str, x: np.ndarray, past: list, dout: np.ndarray) -> None:
    dh, dc = np.zeros_like(dout[0]), np.zeros_like(dout[0])
    dz = np.empty((*x.shape, 4 * HIDDEN))
    for t in range(len(x) - 1, -1, -1):
        _, c0, i, f, o, g, th = past[t]
        dh = dh + dout[t]
        dc = dc + dh * o * (1 - th * th)
        dz[t] = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        dh, dc = dz[t] @ w[f"h{tag}"].T, dc * f
    flat = dz.reshape(-1, 4 * HIDDEN)
    grad[f"x{tag}"] += np.eye(CLASSES)[x.reshape(-1)].T @ flat
    grad[f"h{tag}"] += np.concatenate([p[0] for p in past]).T @ flat


def emissions(w: dict[str, np.ndarray], x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
    """Label scores (time, batch, labels)."""
    a, pa_ = _lstm(w, "f", x, keep)
    b, pb_ = _lstm(w, "b", x[::-1], keep)
    both = np.concatenate([a, b[::-1]], axis=2)
    return both @ w["out"] + w["bias"], (both, pa_, pb_)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis))


def _crf_grad(e: np.ndarray, y: np.ndarray, trans: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood and its gradients by forward-backward."""
    t_n, b_n, l_n = e.shape
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = e[0]
    for t in range(1, t_n):
        alpha[t] = e[t] + _lse(alpha[t - 1][:, :, None] + trans[None], 1)
    for t in range(t_n - 2, -1, -1):
        beta[t] = _lse(trans[None] + (e[t + 1] + beta[t + 1])[:, None, :], 2)
    log_z = _lse(alpha[-1], 1)
    de = np.exp(alpha + beta - log_z[None, :, None])
    rows = np.arange(b_n)
    gold = e[np.arange(t_n)[:, None], rows[None], y].sum(0)
    steps = alpha[:-1, :, :, None] + trans + (e[1:] + beta[1:])[:, :, None, :] - log_z[None, :, None, None]
    pairs = y[:-1] * l_n + y[1:]
    dtrans = np.exp(steps).sum((0, 1)) - np.bincount(pairs.reshape(-1), minlength=l_n * l_n).reshape(l_n, l_n)
    gold = gold + trans.reshape(-1)[pairs].sum(0)
    de[np.arange(t_n)[:, None], rows[None], y] -= 1
    return float((log_z - gold).mean()), de / b_n, dtrans / b_n


def viterbi(e: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best label sequence of one run (time, labels); an inside label follows its own kind only."""
    back = np.zeros(e.shape, np.int64)
    score = e[0].copy()
    for t in range(1, len(e)):
        option = score[:, None] + trans
        back[t] = option.argmax(0)
        score = option.max(0) + e[t]
    path = np.zeros(len(e), np.int64)
    path[-1] = score.argmax()
    for t in range(len(e) - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def _barred() -> np.ndarray:
    bar = np.zeros((len(LABELS), len(LABELS)))
    for i, a in enumerate(LABELS):
        for j, b in enumerate(LABELS):
            if b[0] == "I" and (a == "O" or a[2:] != b[2:]):
                bar[i, j] = -1e4
    return bar


BARRED = _barred()


def sample_sentence(rng: random.Random) -> tuple[str, list[Span]]:
    """A sentence from templates with its labelled spans; about one in three holds none."""
    syllables = "er an on ti es la re de ou ñe éa sch in the ing um ver que ción".split()
    word = lambda: "".join(rng.choices(syllables, k=rng.randrange(1, 4)))
    plain = lambda: "".join(c for c in word() if c.isascii()) or "er"
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    text, spans = "", []
    for _ in range(rng.randrange(1, 4)):
        text += " ".join(word() for _ in range(rng.randrange(1, 9))) + rng.choice([" ", ": ", " ", " ("])
        kind = rng.randrange(0, 9)
        at = len(text)
        if kind in (0, 1):
            host = [plain(), *([plain()] if rng.random() < 0.3 else []), str(rng.choice(["com", "org", "net", "de"]))]
            user = plain() + (rng.choice([".", "_", "-"]) + plain() if rng.random() < 0.5 else "") + (digits(2) if rng.random() < 0.5 else "")
            a, d = (("@", "."), (" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" @ ", " . "))[rng.randrange(0, 5)]
            text += user + a + d.join(host)
            spans.append(("email", at, len(text)))
        elif kind == 2:
            sep = rng.choice([".", ".", " . ", "[.]", "(.)"])
            text += sep.join(str(x) for x in (rng.randrange(256) for _ in range(4)))
            spans.append(("ip", at, len(text)))
        elif kind == 3:
            sep = rng.choice([" ", "-", "", ".", "_"])
            body = digits(15)
            body += next(str(k) for k in range(10) if luhn(body + str(k)))
            text += sep.join(body[i : i + 4] for i in range(0, 16, 4))
            spans.append(("card", at, len(text)))
        elif kind == 4:
            sep = rng.choice([" ", "-", ".", "/"])
            head = rng.choice([f"+{digits(2)}{sep}", f"({digits(3)}) ", f"00{digits(2)}{sep}", f"+{digits(1)} ({digits(3)}) ", f"{digits(3)}{sep}"])
            text += head + digits(3) + sep + digits(4)
            spans.append(("phone", at, len(text)))
        elif kind == 5:  # numbers that are no personal data
            text += rng.choice([digits(4), digits(2) + "%", digits(1) + "." + digits(2), "v" + digits(1) + "." + digits(1) + "." + digits(1), digits(4) + "-" + digits(2) + "-" + digits(2), digits(6), "".join(rng.choices("0123456789abcdef", k=40)), "@" + plain(), "$" + digits(3), digits(10)])
        elif kind == 6:  # plain words that are no address
            text += rng.choice([f"{word()} at {word()} {word()}", f"{word()} at {word()}. {word()}", f"{word()} dot {word()}", f"at {word()}, dot {word()}", f"{word()} at {plain()}.{rng.choice(['com', 'org'])}", f"a dot at the {word()}"])
        text += rng.choice([" ", ". ", ", ", ") ", "\n"])
    return text, spans


@lru_cache(maxsize=1)
def train(steps: int = 320, batch: int = 32, length: int = 80, seed: int = 11) -> dict[str, np.ndarray]:
    """Weights after ``steps`` of Adam on seeded labelled sentences."""
    rng, words = np.random.default_rng(seed), random.Random(seed)
    w = {}
    for tag in "fb":
        w[f"x{tag}"] = rng.normal(0, 0.3, (CLASSES, 4 * HIDDEN))
        w[f"x{tag}"][:, HIDDEN : 2 * HIDDEN] += 0.5
        w[f"h{tag}"] = rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN))
    w["out"], w["bias"], w["trans"] = rng.normal(0, 0.3, (2 * HIDDEN, len(LABELS))), np.zeros(len(LABELS)), np.zeros((len(LABELS), len(LABELS)))
    m, v = ({k: np.zeros_like(a) for k, a in w.items()} for _ in range(2))
    for t in range(1, steps + 1):
        xs, ys = np.zeros((length, batch), np.int64), np.zeros((length, batch), np.int64)
        for b in range(batch):
            text, spans = "", []
            while len(text) < length:
                more, own = sample_sentence(words)
                spans += [(k, s + len(text), e + len(text)) for k, s, e in own]
                text += more
            off = int(rng.integers(0, max(1, len(text) - length + 1)))
            y = np.zeros(len(text), np.int64)
            for k, s, e in spans:
                y[s:e] = 2 + 2 * KINDS.index(k)
                y[s] = 1 + 2 * KINDS.index(k)
            y = y[off : off + length]
            if y[0] > 0 and y[0] % 2 == 0:  # a span cut by the window's edge begins there
                y[0] -= 1
            xs[:, b], ys[:, b] = encode_text(text[off : off + length]), y
        e, (both, pa_, pb_) = emissions(w, xs, True)
        _, de, dtrans = _crf_grad(e, ys, w["trans"] + BARRED)
        grad = {k: np.zeros_like(a) for k, a in w.items()}
        grad["trans"], grad["bias"] = dtrans, de.sum((0, 1))
        grad["out"] = np.einsum("tbh,tbl->hl", both, de)
        dboth = de @ w["out"].T
        _lstm_back(w, grad, "f", xs, pa_, dboth[:, :, :HIDDEN])
        _lstm_back(w, grad, "b", xs[::-1], pb_, dboth[::-1, :, HIDDEN:])
        size = np.sqrt(sum((g * g).sum() for g in grad.values()))
        rate = 0.02 * min(1.0, 2 * (1 - t / steps) + 0.05)
        for k in w:
            g = grad[k] * min(1.0, 5 / (size + 1e-9))
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
            w[k] = w[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
    return w


def windows_of(text: str) -> list[tuple[int, int]]:
    """Overlapping windows over the whole text, without those that hold no digit, at sign or written-out address."""
    step = WINDOW - OVERLAP
    marks = [p for m in _MARK.finditer(text) for p in {m.start(), m.end() - 1}]
    last = max(0, -(-(len(text) - WINDOW) // step))
    numbers = sorted({k for p in marks for k in range(max(0, -(-(p - WINDOW + 1) // step)), min(p // step, last) + 1)})
    return [(k * step, min(len(text), k * step + WINDOW)) for k in numbers]


def admissible(kind: str, text: str) -> bool:
    """What a span that the network adds must hold."""
    digits = sum(c in "0123456789" for c in text)
    if kind == "email":
        parts = re.split(r"(?i)\s*(?:@|[\[(]at[\])]|\bat\b)\s*", text)
        if _WRITTEN.fullmatch(text):
            return True
        return len(parts) == 2 and bool(re.fullmatch(r"[\w.%+-]+", parts[0])) and len(re.split(r"(?i)\s*(?:\.|[\[(]dot[\])]|\bdot\b)\s*", parts[1])) > 1 and ("@" in text or digits > 0)
    if kind == "ip":
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts) and not re.search(r"\w", re.sub("[0-9]", "", text))
    if kind == "card":
        return 13 <= digits <= 19 and not re.search("[^0-9 ._-]", text) and luhn(re.sub("[^0-9]", "", text))
    grouped = len(re.findall("[0-9]+", text)) > 2
    return 9 <= digits <= 15 and not re.search("[^0-9 ().+/-]", text) and (text[0] in "+(0" or (grouped and text[0].isdigit()))


def model_spans(texts: list[str], w: dict[str, np.ndarray]) -> list[list[Span]]:
    """Spans that the network finds in each whole text."""
    jobs = [(d, s, e) for d, t in enumerate(texts) for s, e in windows_of(t)]
    if not jobs:
        return [[] for _ in texts]
    codes = {d: encode_text(texts[d]) for d in {j[0] for j in jobs}}
    runs: list[list] = []  # text, start, end, (begin, scores) of each window
    for at in range(0, len(jobs), 512):
        part = jobs[at : at + 512]
        x = np.full((WINDOW, len(part)), 0, np.int64)
        for k, (d, s, e) in enumerate(part):
            x[: e - s, k] = codes[d][s:e]
        scores, _ = emissions(w, x)
        for k, (d, s, e) in enumerate(part):
            own = scores[: e - s, k].astype(np.float32)
            if runs and runs[-1][0] == d and s < runs[-1][2]:
                runs[-1][2] = e
                runs[-1][3].append((s, own))
            else:
                runs.append([d, s, e, [(s, own)]])
    out: list[list[Span]] = [[] for _ in texts]
    trans = w["trans"] + BARRED
    for d, start, stop, held in runs:
        total, seen = np.zeros((stop - start, len(LABELS))), np.zeros(stop - start)
        for s, own in held:
            total[s - start : s - start + len(own)] += own
            seen[s - start : s - start + len(own)] += 1
        path = viterbi(total / seen[:, None], trans)
        t = 0
        while t < len(path):
            if path[t]:
                kind, end = (path[t] - 1) // 2, t + 1
                while end < len(path) and path[end] == 2 + 2 * kind:
                    end += 1
                s, e = start + t, start + end
                body = texts[d][s:e]
                s, e = s + len(body) - len(body.lstrip()), e - len(body) + len(body.rstrip())
                # A written-out address often comes with a word beside it.
                if KINDS[kind] == "email" and not admissible("email", texts[d][s:e]) and (held := _WRITTEN.search(texts[d], s, e)):
                    s, e = held.span()
                if s < e and admissible(KINDS[kind], texts[d][s:e]):
                    out[d].append((KINDS[kind], s, e))
                t = end
            else:
                t += 1
    return out


def all_spans(texts: list[str], w: dict[str, np.ndarray]) -> Iterator[tuple[list[Span], list[Span]]]:
    """For each text its base spans, and these with the network's that none of them overlaps."""
    base = [base_spans(t) for t in texts]
    for own, more in zip(base, model_spans(texts, w)):
        extra = [x for x in more if all(x[2] <= b[1] or b[2] <= x[1] for b in own)]
        yield own, sorted({*own, *extra}, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the counts by kind, the digest of the base spans and all spans."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    weights = train()
    text_of = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e in spans)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for at in range(0, len(pdf), 512):
                for own, full in all_spans(pdf["text"].iloc[at : at + 512].tolist(), weights):
                    rows.append((*(sum(x[0] == k for x in full) for k in KINDS), hashlib.sha256(text_of(own).encode()).hexdigest(), text_of(full)))
            out = pd.DataFrame(rows, columns=[*(f"n_{k}" for k in KINDS), "base_sha256", "spans"])
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield out

    return map_rows(source, run, "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
