"""PII (operator 7): stated patterns, and a character BiLSTM with CRF transitions that adds spans to theirs.

Base spans (email, ip, card, phone) are leftmost non-overlapping matches of fixed patterns; a match that fails its
test is dropped and not retried. The tagger is trained in numpy on labelled spans that a seeded generator writes
(plain and disguised forms, and look-alikes that are no personal data), so every worker and rerun has one model.
Every kind holds a digit or an at sign or the word at in brackets, so the tagger reads the windows around those;
all windows of all texts are read. Overlapping windows are reconciled: emission scores are averaged where windows
overlap, then each stretch of joined windows is decoded by Viterbi, a very long one in overlapping pieces of bounded size. A decoded span is added
when it touches no base span and has a shape its kind can have.

Defined results: null text is empty, with no spans; offsets count code points; repeated rows give repeated results;
other columns are ignored; very long texts are processed in the same windows.
"""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a match can only start where a run of digits does, and takes runs whole: so a long run is read once
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
TRIGGER = re.compile(r"[0-9@]|[\[(] ?at ?[\])]")


def digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str):
    """Matches of EMAIL without its quadratic search: each at sign is tried with the longest local part before it."""
    end, at = 0, text.find("@")
    while at >= 0:
        m = DOMAIN.match(text, at + 1)
        a = at
        while a > end and text[a - 1] < "\x80" and LOCAL_CHAR[ord(text[a - 1])]:
            a -= 1
        if m and a < at:
            yield a, m.end()
            end = m.end()
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)


LOCAL_CHAR = [bool(LOCAL.match(chr(i))) for i in range(128)]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if 13 <= len(d := digits(m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(digits(m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def said(spans: list[tuple[str, int, int]]) -> str:
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (order[s[0]], s[1], s[2])))


# --- the tagger -------------------------------------------------------------------------------------------------

TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
N_TAGS = len(TAGS)


def char_ids(text: str) -> np.ndarray:
    """Letters, digits and each ASCII sign have a class; all else shares one per broad kind."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(x < 128, x, 128).astype(np.int64)


N_CHARS = 129


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Tagger:
    """A bidirectional LSTM over characters, a linear layer to tag scores, and a CRF's transition scores."""

    def __init__(self, embed: int = 12, hidden: int = 20, seed: int = 11):
        rng = np.random.default_rng(seed)
        g = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
        self.hidden = hidden
        self.w = {"emb": g(N_CHARS, embed) * 3, "out": g(2 * hidden, N_TAGS), "ob": np.zeros(N_TAGS, np.float32), "tr": np.zeros((N_TAGS, N_TAGS), np.float32)}
        for d in "fb":
            self.w |= {f"x{d}": g(embed, 4 * hidden), f"h{d}": g(hidden, 4 * hidden), f"b{d}": np.zeros(4 * hidden, np.float32)}
            self.w[f"b{d}"][hidden : 2 * hidden] = 1

    def lstm(self, e: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        n, t, _ = e.shape
        k = self.hidden
        h, c = np.zeros((n, k), np.float32), np.zeros((n, k), np.float32)
        out = np.empty((n, t, k), np.float32)
        x = e @ self.w[f"x{d}"] + self.w[f"b{d}"]
        for i in range(t) if d == "f" else range(t - 1, -1, -1):
            z = x[:, i] + h @ self.w[f"h{d}"]
            s = sigmoid(z[:, : 3 * k])
            gate = np.tanh(z[:, 3 * k :])
            prev = (h, c)
            c = s[:, k : 2 * k] * c + s[:, :k] * gate
            h = s[:, 2 * k :] * np.tanh(c)
            out[:, i] = h
            if keep is not None:
                keep.append((i, s, gate, prev, c))
        return out

    def emissions(self, ids: np.ndarray, keep: dict | None = None) -> np.ndarray:
        e = self.w["emb"][ids]
        steps = {d: [] if keep is not None else None for d in "fb"}
        h = np.concatenate([self.lstm(e, d, steps[d]) for d in "fb"], axis=2)
        if keep is not None:
            keep |= {"e": e, "h": h, "steps": steps}
        return h @ self.w["out"] + self.w["ob"]

    def loss(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        """CRF negative log likelihood per sequence, and its gradient by back-propagation through time."""
        keep: dict = {}
        s = self.emissions(ids, keep).astype(np.float64)
        n, t, y = s.shape
        tr = self.w["tr"].astype(np.float64)
        lse = lambda x, ax: (m := x.max(ax, keepdims=True)).squeeze(ax) + np.log(np.exp(x - m).sum(ax))
        fw, bw = np.empty_like(s), np.zeros_like(s)
        fw[:, 0] = s[:, 0]
        for i in range(1, t):
            fw[:, i] = s[:, i] + lse(fw[:, i - 1][:, :, None] + tr, 1)
        for i in range(t - 2, -1, -1):
            bw[:, i] = lse(tr + (s[:, i + 1] + bw[:, i + 1])[:, None, :], 2)
        z = lse(fw[:, -1], 1)
        r, at = np.arange(n)[:, None], np.arange(t)[None, :]
        total = z.sum() - s[r, at, tags].sum() - tr[tags[:, :-1], tags[:, 1:]].sum()
        ds = np.exp(fw + bw - z[:, None, None])
        ds[r, at, tags] -= 1
        dtr = np.zeros_like(tr)
        for i in range(t - 1):
            dtr += np.exp(fw[:, i][:, :, None] + tr + (s[:, i + 1] + bw[:, i + 1])[:, None, :] - z[:, None, None]).sum(0)
        np.add.at(dtr, (tags[:, :-1], tags[:, 1:]), -1)
        ds = (ds / n).astype(np.float32)
        k = self.hidden
        grad = {"tr": (dtr / n).astype(np.float32), "out": np.einsum("ntk,nty->ky", keep["h"], ds), "ob": ds.sum((0, 1))}
        dh_all, de = ds @ self.w["out"].T, np.zeros_like(keep["e"])
        for j, d in enumerate("fb"):
            dx, dw, dh, dc = np.empty((n, t, 4 * k), np.float32), np.zeros((k, 4 * k), np.float32), np.zeros((n, k), np.float32), np.zeros((n, k), np.float32)
            for i, g, gate, (h0, c0), c in reversed(keep["steps"][d]):
                dh = dh + dh_all[:, i, j * k : (j + 1) * k]
                tc = np.tanh(c)
                dc = dc + dh * g[:, 2 * k :] * (1 - tc * tc)
                dz = np.concatenate([dc * gate, dc * c0, dh * tc], 1) * g * (1 - g)
                dz = np.concatenate([dz, dc * g[:, :k] * (1 - gate * gate)], 1)
                dc = dc * g[:, k : 2 * k]
                dx[:, i] = dz
                dw += h0.T @ dz
                dh = dz @ self.w[f"h{d}"].T
            grad |= {f"h{d}": dw, f"b{d}": dx.sum((0, 1)), f"x{d}": np.einsum("nte,ntk->ek", keep["e"], dx)}
            de += dx @ self.w[f"x{d}"].T
        grad["emb"] = np.zeros_like(self.w["emb"])
        np.add.at(grad["emb"], ids, de)
        return total / n, grad

    def train(self, draw, steps: int, batch: int, rate: float = 0.02) -> list[float]:
        m, v, losses = {}, {}, []
        for i in range(1, steps + 1):
            loss, grad = self.loss(*draw(batch))
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            lr = rate * min(1, 2 * (1 - (i - 1) / steps))
            for k, g in grad.items():
                g = g * min(1, 5 / (norm + 1e-9))
                m[k] = 0.9 * m.get(k, 0) + 0.1 * g
                v[k] = 0.99 * v.get(k, 0) + 0.01 * g * g
                self.w[k] = (self.w[k] - lr * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-8)).astype(np.float32)
            losses.append(loss)
        return losses

    def decode(self, s: np.ndarray) -> np.ndarray:
        """The best tag path of one stretch's scores."""
        t, back = len(s), np.empty(s.shape, np.int64)
        at = s[0]
        for i in range(1, t):
            x = at[:, None] + self.w["tr"]
            back[i] = x.argmax(0)
            at = x.max(0) + s[i]
        out = np.empty(t, np.int64)
        out[-1] = at.argmax()
        for i in range(t - 1, 0, -1):
            out[i - 1] = back[i, out[i]]
        return out


def labelled(rng: np.random.Generator, length: int) -> tuple[str, list[tuple[str, int, int]]]:
    """One training text of the given length with its spans."""
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    num = lambda n: "".join(str(int(x)) for x in rng.integers(0, 10, n))
    low = "abcdefghijklmnopqrstuvwxyz"
    word = lambda a, b: "".join(low[int(x)] for x in rng.integers(0, 26, int(rng.integers(a, b))))
    syllables = ("the", "on", "er", "en", "de", "la", "re", "ti", "an", "st", "è", "ö", "ñ", "ción", "ung", "es")

    def prose() -> str:
        return "".join(pick(syllables) for _ in range(int(rng.integers(1, 5)))) + pick(("", "", "", ",", "."))

    def card() -> str:
        n = int(rng.integers(13, 20))
        body = num(n - 1)
        body += next(c for c in "0123456789" if luhn(body + c))
        sep = pick(("", "", " ", "-"))
        return sep.join(body[i : i + 4] for i in range(0, len(body), 4))

    def item() -> tuple[str | None, str]:
        kind = int(rng.integers(0, 9))
        if kind == 0:
            return "email", f"{word(3, 9)}{pick(('', '.', '_'))}{pick((num(2), word(2, 6)))}@{word(3, 8)}{pick(('', num(1)))}.{pick(('com', 'org', 'net', 'example.com'))}"
        if kind == 1:
            dot = pick((" dot ", " [dot] ", "(dot)", "."))
            return "email", f"{word(3, 9)}{pick(('', '.' + num(2)))}{pick((' [at] ', ' (at) ', '(at)', '[at]', ' @ '))}{word(3, 8)}{dot}{pick(('com', 'org', 'net'))}"
        if kind == 2:
            return "ip", pick((".", ".", ".", "[.]")).join(str(int(x)) for x in rng.integers(0, 256, 4))
        if kind == 3:
            return "card", card()
        if kind == 4:
            return "phone", f"+{pick(('1', '49', '33', '34', '44'))} {pick(('(', ''))}{num(3)}{pick((') ', ' ', '-'))}{num(3)}-{num(4)}"
        if kind == 5:
            return "phone", f"({num(3)}) {num(3)}-{num(4)}"
        if kind == 6:
            return None, pick((f"password={word(3, 6)}{num(4)}{word(2, 5)}{num(6)}", f'token = "{num(6)}{word(2, 5)}{num(9)}{word(3, 6)}"', f"AKIA{word(6, 9).upper()}{num(3)}"))
        if kind == 7:
            return None, pick((f"Version {num(1)}.{num(1)}.", f"version {num(1)}", f"CC BY-NC {num(1)}.{num(1)}", f"{num(4)}", f"v{num(1)}.{num(2)}.{num(1)}", f"{num(2)}:{num(2)}", f"{num(1)},{num(3)},{num(3)}", f"{num(8)}"))
        return None, pick((f"{num(4)}-{num(2)}-{num(2)}", f"@{word(4, 9)}", f"({num(1)})", f"{num(2)}%", f"id={num(11)}", f"https://{word(4, 8)}.com/{num(5)}"))

    text, spans = "", []
    skip = int(rng.integers(0, 20))
    while len(text) < length + skip + 40:
        if rng.random() < 0.28:
            kind, s = item()
            if kind:
                spans.append((kind, len(text), len(text) + len(s)))
            text += s + " "
        else:
            text += prose() + pick((" ", " ", " ", "\n"))
    return text[skip : skip + length], [(k, max(0, a - skip), min(length, b - skip)) for k, a, b in spans if b > skip and a < skip + length]


WINDOW, STRIDE = 64, 32


@functools.cache
def trained(steps: int = 260, batch: int = 64, seed: int = 11) -> Tagger:
    """The tagger, trained once in a process. Its data, order and start are seeded."""
    rng, tagger = np.random.default_rng(seed), Tagger(seed=seed)

    def draw(n: int):
        ids, tags = np.full((n, WINDOW), 32), np.zeros((n, WINDOW), np.int64)
        for r in range(n):
            text, spans = labelled(rng, WINDOW)
            ids[r] = char_ids(text)
            for k, a, b in spans:
                tags[r, a:b] = 2 + 2 * KINDS.index(k)
                tags[r, a] = 1 + 2 * KINDS.index(k)
        return ids, tags

    tagger.train(draw, steps, batch)
    return tagger


def plausible(kind: str, s: str) -> bool:
    """Whether a decoded span has a shape of its kind: a disguised email, address, card or phone number."""
    d = digits(s)
    if kind == "email":
        return bool(re.fullmatch(r"[A-Za-z0-9._%+-]+ ?(@|[\[(] ?at ?[\])]) ?[A-Za-z0-9-]+( ?([\[(] ?dot ?[\])]|\.| dot ) ?[A-Za-z0-9-]+)+", s))
    if kind == "ip":
        parts = re.split(r" ?[\[(]?\.[\])]? ?", s)
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d) and bool(re.fullmatch(r"[0-9][0-9 .-]+[0-9]", s))
    return 9 <= len(d) <= 15 and bool(re.fullmatch(r"[+(]?[0-9][0-9 ().-]+[0-9]", s)) and bool(re.search(r"[ ().-]", s))


def stretches(text: str, triggers):
    """Joined windows: multiples of STRIDE so that each trigger has WINDOW // 2 characters or more on both sides."""
    at, end = None, 0
    for m in triggers:
        p = m.start()
        a = max(0, (p - WINDOW // 2) // STRIDE * STRIDE)
        b = p // STRIDE * STRIDE + STRIDE + WINDOW // 2
        if at is not None and a <= end:
            end = max(end, b)
        else:
            if at is not None:
                yield at, end
            at, end = a, b
    if at is not None:
        yield at, end


PIECE, MARGIN = 32_768, 1_024


def pieces(a: int, b: int):
    """(start, end, from, to): a stretch in pieces of bounded size that overlap by MARGIN on either side; a piece decides the spans that start
    within from and to."""
    for lo in range(a, b, PIECE):
        hi = min(b, lo + PIECE)
        yield max(a, lo - MARGIN), min(b, hi + MARGIN), lo, hi


def tagged(texts: list[str], tagger: Tagger, batch: int = 512) -> list[list[tuple[str, int, int]]]:
    """The spans that the tagger finds in each text."""
    jobs, windows = [], []  # (text, a, b, from, to, first window), (ids)
    found: list[list[tuple[str, int, int]]] = [[] for _ in texts]

    def flush():
        if not windows:
            return
        ids = np.stack(windows)
        s = np.concatenate([tagger.emissions(ids[i : i + batch]) for i in range(0, len(ids), batch)])
        for k, a, b, lo, hi, first in jobs:
            n = (b - a) // STRIDE - WINDOW // STRIDE + 1
            total, seen = np.zeros((b - a, N_TAGS)), np.zeros((b - a, 1))
            for j in range(n):
                total[j * STRIDE : j * STRIDE + WINDOW] += s[first + j]
                seen[j * STRIDE : j * STRIDE + WINDOW] += 1
            path = tagger.decode(total / seen)
            i = 0
            while i < len(path):
                if path[i] % 2 == 1:
                    e = i + 1
                    while e < len(path) and path[e] == path[i] + 1:
                        e += 1
                    if lo <= a + i < hi:
                        found[k].append((KINDS[path[i] // 2], a + i, min(a + e, len(texts[k]))))
                    i = e
                else:
                    i += 1
        jobs.clear()
        windows.clear()

    for k, text in enumerate(texts):
        for whole in stretches(text, TRIGGER.finditer(text)):
            for a, b, lo, hi in pieces(*whole):
                ids = char_ids(text[a:b])
                ids = np.pad(ids, (0, b - a - len(ids)), constant_values=32)
                jobs.append((k, a, b, lo, hi, len(windows)))
                windows.extend(ids[i : i + WINDOW] for i in range(0, b - a - WINDOW + 1, STRIDE))
                if len(windows) >= 4 * batch:
                    flush()
    flush()
    return found


def all_spans(texts: list[str], tagger: Tagger) -> list[tuple[list, list]]:
    """Per text: (base spans, spans that the tagger adds)."""
    out = []
    for text, base, more in zip(texts, map(base_spans, texts), tagged(texts, tagger), strict=True):
        free = [s for s in more if not any(a < s[2] and s[1] < b for _, a, b in base)] if base else more
        out.append((base, [(k, a, b) for k, a, b in free if plausible(k, text[a:b])]))
    return out


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, added for every row of docs (doc_id, text)."""
    tagger = docs.sparkSession.sparkContext.broadcast(trained())

    def run(batches):
        for pdf in batches:
            texts = ["" if t is None else t for t in pdf["text"]]
            found = all_spans(texts, tagger.value)
            base = [b for b, _ in found]
            out = {"doc_id": pdf["doc_id"]}
            out |= {f"n_{k}": [sum(s[0] == k for s in b) for b in base] for k in KINDS}
            out["base_sha256"] = [hashlib.sha256(said(b).encode()).hexdigest() for b in base]
            out["spans"] = [said(b + m) for b, m in found]
            out["added"] = [len(m) for _, m in found]
            yield pd.DataFrame(out)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(run, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, added long")


def redact(docs: DataFrame, text: str = "text", size: str | None = None) -> DataFrame:
    """docs with each span of its text (base or added; joined where they overlap) replaced by <KIND>; size, if named, is
    the column that gets the new length. All columns and rows stay; null text stays null."""
    tagger = docs.sparkSession.sparkContext.broadcast(trained())

    def run(batches):
        for pdf in batches:
            texts = list(pdf[text])
            found = all_spans(["" if t is None else t for t in texts], tagger.value)
            out = []
            for t, (base, more) in zip(texts, found, strict=True):
                parts, at = [], 0
                for k, a, b in sorted(base + more, key=lambda s: (s[1], -s[2])):
                    if a >= at:
                        parts += [t[at:a], f"<{k.upper()}>"]
                    at = max(at, b)
                out.append(t if t is None or not parts else "".join([*parts, t[at:]]))
            pdf[text] = out
            yield pdf

    done = docs.mapInPandas(run, docs.schema)
    return done.withColumn(size, F.length(text).cast(docs.schema[size].dataType)) if size else done
