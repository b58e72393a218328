"""Personal data: a character-level bidirectional LSTM with CRF transitions, in numpy.

Patterns give the base spans (``base_spans``); they always stay.  They also label the training windows of the network,
together with spans written in ways that the patterns do not know (``written_anew``) and, unlabelled, with what looks like
an item and is none (``written_alike``).  The network then reads every whole text: windows of ``WINDOW`` characters that overlap by ``OVERLAP`` are decoded by Viterbi, and one tag per character is
settled globally, each character by the window in which it stands furthest from an edge.  Runs of a tag that do not touch a
base span are added if their numbers can be of the kind (``plausible``: digits, ranges, check digit; one at and a dot in an address);
there is no test of how they are written.

The cell uses x / (1 + |x|) for its squashing functions, which costs a fraction of tanh; both directions of a batch of
windows advance in one matrix product per character.

Training reads a bounded sample (``FIT_DOCS`` documents by a hash of doc_id, at most five windows each) and runs on the
driver; scanning is one narrow job without shuffle.

Cases: null, empty and blank texts have no spans; a text of any length is read window by window; equal texts have equal
spans; a null doc_id stays null; an empty table gives no rows; other columns are not read by ``find_pii`` and come back
unchanged from ``mask_pii`` (but for ``n_chars``, where there is one, which follows the text).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codesift.llm.arrays import bounded_batches, spread

KINDS = ("email", "ip", "card", "phone")

WINDOW = 512
OVERLAP = 64
HIDDEN = 16
EMBED = 6
LABELS = 1 + len(KINDS)

FIT_DOCS = 20_000
FIT_LENGTH = 96
FIT_ROUNDS = 1_000
FIT_BATCH = 64
SEED = 5

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can begin at the first digit of a run only, so long runs of digits stay linear.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    d = [int(x) for x in reversed(digits)]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def _digits(s: str) -> str:
    return "".join(_DIGIT.findall(s))


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Leftmost non-overlapping matches of each kind that pass its test, in code points."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out["email"].append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        out["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out["card"].append(m.span())
        out["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


def plausible(kind: str, s: str) -> bool:
    """Whether an added span can be of its kind: its numbers, and for an address one at and a dot behind it.  How it is
    written is left to the network."""
    d = _digits(s)
    if kind == "ip":
        parts = re.findall("[0-9]+", s)
        return len(parts) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in parts)
    if kind == "card":
        return 16 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 10 <= len(d) <= 15
    parts = re.split(r"@|\bat\b", s.lower())
    return len(parts) == 2 and any(x in parts[1] for x in (".", "dot")) and all(re.search("[0-9a-z]", x) for x in parts)


def symbols(text: str) -> np.ndarray:
    """Characters as small numbers: ASCII by itself, letters beyond it 128, all else 129; padding is 0."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(c < 128, np.maximum(c, 1), np.where((c >= 0xC0) & (c < 0x250), 128, 129)).astype(np.uint8)


N_SYMBOLS = 130


def _squash(x: np.ndarray, tmp: np.ndarray) -> None:
    np.abs(x, out=tmp)
    tmp += 1
    x /= tmp


@dataclass
class Tagger:
    """The network's weights and its two uses, ``loss_and_slopes`` and ``tag``."""

    embed: np.ndarray
    cell: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    trans: np.ndarray

    @classmethod
    def fresh(cls, seed: int = SEED) -> Tagger:
        r = np.random.default_rng(seed)
        draw = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
        cell = draw(2, 4 * HIDDEN, HIDDEN + EMBED + 1, scale=0.3)
        cell[:, HIDDEN: 2 * HIDDEN, -1] = 1.5
        return cls(draw(EMBED, N_SYMBOLS, scale=0.5), cell, draw(2, LABELS, HIDDEN, scale=0.3), np.zeros(LABELS, np.float32), np.zeros((LABELS, LABELS), np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.cell, self.out, self.bias, self.trans]

    def emissions(self, ids: np.ndarray, keep: bool = False):
        """Scores time x label x window of ids (time x window); with ``keep`` also what the way back needs."""
        steps, n = ids.shape
        h2 = HIDDEN
        x = np.take(self.embed, ids, axis=1)
        inp = np.zeros((2, h2 + EMBED + 1, n), np.float32)
        inp[:, -1] = 1
        gates, tmp = np.empty((2, 4 * h2, n), np.float32), np.empty((2, 4 * h2, n), np.float32)
        c, half = np.zeros((2, h2, n), np.float32), np.empty((2, h2, n), np.float32)
        part = np.empty((2, LABELS, n), np.float32)
        em = np.empty((steps, LABELS, n), np.float32)
        em[:] = self.bias[:, None]
        trace = []
        for s in range(steps):
            b = steps - 1 - s
            inp[0, h2:-1] = x[:, s]
            inp[1, h2:-1] = x[:, b]
            np.matmul(self.cell, inp, out=gates)
            _squash(gates, tmp)
            raw = gates.copy() if keep else None
            doors = gates[:, : 3 * h2]
            doors *= 0.5
            doors += 0.5
            before = c.copy() if keep else None
            c *= gates[:, h2: 2 * h2]
            np.multiply(gates[:, :h2], gates[:, 3 * h2:], out=half)
            c += half
            view = c.copy()
            _squash(view, half)
            if keep:
                trace.append((inp.copy(), raw, gates.copy(), before, view.copy()))
            np.multiply(gates[:, 2 * h2: 3 * h2], view, out=inp[:, :h2])
            np.matmul(self.out, inp[:, :h2], out=part)
            em[s] += part[0]
            em[b] += part[1]
            if keep:
                trace[-1] += (inp[:, :h2].copy(),)
        return (em, trace) if keep else em

    def loss_and_slopes(self, ids: np.ndarray, gold: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Negative log-likelihood of the gold tags (time x window) per window, and its slopes."""
        steps, n = ids.shape
        em, trace = self.emissions(ids, True)
        trans = np.where(ALLOWED, self.trans, -1e4)
        alpha = np.empty_like(em)
        alpha[0] = em[0]
        for t in range(1, steps):
            w = alpha[t - 1][:, None] + trans[:, :, None]
            top = w.max(axis=0)
            alpha[t] = em[t] + top + np.log(np.exp(w - top).sum(axis=0))
        top = alpha[-1].max(axis=0)
        z = top + np.log(np.exp(alpha[-1] - top).sum(axis=0))
        beta = np.zeros((LABELS, n), np.float32)
        d_em, d_trans = np.empty_like(em), np.zeros_like(self.trans)
        for t in range(steps - 1, -1, -1):
            d_em[t] = np.exp(alpha[t] + beta - z)
            if t:
                w = trans[:, :, None] + (em[t] + beta)[None]
                d_trans += np.exp(alpha[t - 1][:, None] + w - z).sum(axis=2)
                top = w.max(axis=1)
                beta = top + np.log(np.exp(w - top[:, None]).sum(axis=1))
        at = np.arange(n)
        score = np.zeros(n, np.float32)
        for t in range(steps):
            score += em[t, gold[t], at]
            d_em[t, gold[t], at] -= 1
            if t:
                score += trans[gold[t - 1], gold[t]]
                np.subtract.at(d_trans, (gold[t - 1], gold[t]), 1)
        d_em /= n
        h2 = HIDDEN
        d_out, d_cell, d_x = np.zeros_like(self.out), np.zeros_like(self.cell), np.zeros((EMBED, steps, n), np.float32)
        d_h, d_c = np.zeros((2, h2, n), np.float32), np.zeros((2, h2, n), np.float32)
        for s in range(steps - 1, -1, -1):
            b = steps - 1 - s
            inp, raw, gates, before, view, h = trace[s]
            e = np.stack([d_em[s], d_em[b]])
            d_out += e @ h.transpose(0, 2, 1)
            d_h += self.out.transpose(0, 2, 1) @ e
            i, f, o, g = (gates[:, k * h2: (k + 1) * h2] for k in range(4))
            d_c += d_h * o * (1 - np.abs(view)) ** 2
            d = np.concatenate([d_c * g * 0.5, d_c * before * 0.5, d_h * view * 0.5, d_c * i], axis=1) * (1 - np.abs(raw)) ** 2
            d_cell += d @ inp.transpose(0, 2, 1)
            back = self.cell.transpose(0, 2, 1) @ d
            d_h = back[:, :h2]
            d_x[:, s] += back[0, h2:-1]
            d_x[:, b] += back[1, h2:-1]
            d_c = d_c * f
        d_embed = np.zeros_like(self.embed)
        for k in range(EMBED):
            d_embed[k] = np.bincount(ids.ravel(), d_x[k].ravel(), N_SYMBOLS)
        d_trans = np.where(ALLOWED, d_trans / n, 0)
        return float((z - score).mean()), [d_embed, d_cell, d_out, d_em.sum(axis=(0, 2)), d_trans.astype(np.float32)]

    def tag(self, ids: np.ndarray) -> np.ndarray:
        """Best tags (time x window) of ids (time x window) by Viterbi.  A kind follows itself or no kind, so each kind
        has two ways in, and no kind has one from every label."""
        em = self.emissions(ids)
        steps, _, n = em.shape
        into, stay, leave = self.trans[0, 1:, None], np.diag(self.trans)[1:, None], self.trans[1:, 0, None]
        kept = np.empty((steps, LABELS - 1, n), bool)
        came = np.empty((steps, n), np.uint8)
        none, kind = em[0, 0].copy(), em[0, 1:].copy()
        for t in range(1, steps):
            fresh, same = none + into, kind + stay
            np.greater(same, fresh, out=kept[t])
            out = kind + leave
            best = out.max(axis=0)
            own = none + self.trans[0, 0]
            closed = best > own
            came[t] = np.where(closed, out.argmax(axis=0) + 1, 0) if closed.any() else 0
            kind = np.maximum(same, fresh) + em[t, 1:]
            none = np.maximum(own, best) + em[t, 0]
        tags = np.empty((steps, n), np.uint8)
        state = np.concatenate([none[None], kind]).argmax(axis=0)
        at = np.arange(n)
        for t in range(steps - 1, 0, -1):
            tags[t] = state
            if state.any():
                state = np.where(state > 0, np.where(kept[t, np.maximum(state, 1) - 1, at], state, 0), came[t])
            else:
                state = came[t]
        tags[0] = state
        return tags


ALLOWED = np.eye(LABELS, dtype=bool)
ALLOWED[0] = True
ALLOWED[:, 0] = True


def windows(length: int) -> list[tuple[int, int, int, int]]:
    """Overlapping windows (start, end) that cover a text, the last one ending with it, and the part (from, to) that each
    decides: neighbours part in the middle of their overlap."""
    starts = [*range(0, length - WINDOW, WINDOW - OVERLAP), length - WINDOW] if length > WINDOW else [0]
    marks = [0] + [(a + WINDOW + b) // 2 for a, b in zip(starts, starts[1:])] + [length]
    return [(a, min(a + WINDOW, length), s, e) for a, s, e in zip(starts, marks, marks[1:])]


def tag_texts(net: Tagger, texts: list[str], batch: int = 768) -> list[np.ndarray]:
    """One tag per character of every text, from all its windows."""
    codes = [symbols(t) for t in texts]
    jobs = [(b - a, k, a, b, s, e) for k, c in enumerate(codes) if len(c) for a, b, s, e in windows(len(c))]
    jobs.sort(key=lambda j: j[0])
    out = [np.zeros(len(c), np.uint8) for c in codes]
    for i in range(0, len(jobs), batch):
        part = jobs[i: i + batch]
        ids = np.zeros((part[-1][0], len(part)), np.uint8)
        for col, (n, k, a, b, _, _) in enumerate(part):
            ids[:n, col] = codes[k][a:b]
        tags = net.tag(ids)
        if tags.any():
            for col, (_, k, a, _, s, e) in enumerate(part):
                out[k][s:e] = tags[s - a: e - a, col]
    return out


def added_spans(text: str, tags: np.ndarray, base: dict[str, list[tuple[int, int]]]) -> dict[str, list[tuple[int, int]]]:
    """Runs of a tag that touch no base span and are plausible."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if not tags.any():
        return out
    taken = np.zeros(len(tags) + 1, bool)
    for spans in base.values():
        for s, e in spans:
            taken[s:e] = True
    edges = np.flatnonzero(np.diff(np.concatenate([[0], tags, [0]]).astype(np.int16)))
    for s, e in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if not tags[s]:
            continue
        kind = KINDS[tags[s] - 1]
        while s < e and text[s] in " .,;:\n\t":
            s += 1
        while s < e and text[e - 1] in " .,;:\n\t":
            e -= 1
        if s < e and not taken[s:e].any() and plausible(kind, text[s:e]):
            out[kind].append((s, e))
    return out


def spans_of(net: Tagger, texts: list[str]) -> Iterator[tuple[dict, dict]]:
    """(base spans, all spans) of every text."""
    for text, tags in zip(texts, tag_texts(net, texts)):
        base = base_spans(text)
        more = added_spans(text, tags, base)
        yield base, {k: sorted(base[k] + more[k]) for k in KINDS}


def _pick(r: np.random.Generator, *x: str) -> str:
    return x[r.integers(len(x))]


def _word(r: np.random.Generator, a: int, b: int) -> str:
    return "".join(r.choice(list("abcdefghijklmnopqrstuvwxyz"), r.integers(a, b)))


def _num(r: np.random.Generator, n: int) -> str:
    return "".join(map(str, r.integers(0, 10, n)))


def card_digits(r: np.random.Generator) -> str:
    d = _pick(r, "4", "5", "2") + (_num(r, 1) * 14 if r.random() < 0.15 else _num(r, 14))
    return d + next(str(x) for x in range(10) if luhn(d + str(x)))


def written_anew(kind: str, r: np.random.Generator) -> str:
    """A made-up item of a kind, in ways of writing that the base patterns know and in others."""
    pick, word, num = (lambda *x: _pick(r, *x)), (lambda a, b: _word(r, a, b)), (lambda n: _num(r, n))
    if kind == "email":
        name = word(3, 9) + pick("", ".", "_", "-") + pick("", num(2), word(2, 8))
        name = pick(name, name, name.title(), name.upper())
        at = pick("@", "@", "(at)", "[at]", "{at}", " (at) ", " [at] ", " @ ", " at ", " AT ")
        dot = pick(" dot ", " DOT ", "[dot]", " [dot] ") if at.strip().lower() == "at" or at == " [at] " else pick(".", ".", "[.]", " . ")
        return name + at + word(3, 9) + pick("", num(1)) + dot + pick("", "", word(4, 8) + dot) + pick("com", "org", "net", "de", "io", "edu", "co")
    if kind == "ip":
        return pick(".", ".", "[.]", " . ", " dot ", "[dot]").join(str(x) for x in r.integers(1, 256, 4))
    if kind == "card":
        d = card_digits(r)
        return pick("", " ", "-", ".", "  ", "_", "/").join(d[i: i + 4] for i in range(0, 16, 4))
    area, sep = num(3), pick("-", " ", ".")
    if r.random() < 0.2:
        return pick("00", "+") + pick("49", "44", "33") + sep + num(int(r.integers(2, 5))) + sep + num(int(r.integers(6, 9)))
    return pick("+1 ", "1-", "001 ", "", "", "") + pick(f"({area}) ", f"({area}) ", f"{area}-", f"{area}.", f"{area}/") + num(3) + pick("-", "-", ".", " ") + num(4)


def written_alike(r: np.random.Generator) -> str:
    """Something with digits, points or signs that is none of the kinds."""
    pick, word, num = (lambda *x: _pick(r, *x)), (lambda a, b: _word(r, a, b)), (lambda n: _num(r, n))
    year = str(int(r.integers(1900, 2100)))
    some = int(r.integers(1, 10))
    return (lambda *forms: forms[r.integers(len(forms))]())(
        lambda: pick("-", "/", ".").join((year, num(2), num(2))) + pick("", " ", "T") + pick("", "", f"{num(2)}:{num(2)}"),
        lambda: pick("-", "/", ".").join((num(2), num(2), year)),
        lambda: " ".join(num(int(n)) for n in r.integers(8, 18, int(r.integers(2, 5)))),
        lambda: f"{num(2)}:{num(2)}:{num(2)}",
        lambda: f"{year}-{year}",
        lambda: "v" + ".".join(num(1) for _ in range(int(r.integers(2, 4)))),
        lambda: ".".join(num(1) for _ in range(3)),
        lambda: pick("$", "") + num(some % 3 + 1) + "".join("," + num(3) for _ in range(some % 3 + 1)) + pick("", ".00"),
        lambda: num(some) + "." + num(some),
        lambda: num(some),
        lambda: num(int(r.integers(10, 24))),
        lambda: "".join(r.choice(list("0123456789abcdef"), int(r.integers(6, 40)))),
        lambda: pick("#", "no. ", "id ", "item_") + num(some),
        lambda: "@" + word(3, 9),
        lambda: word(3, 9) + " at " + word(3, 9) + pick(".", " ", ", "),
        lambda: pick("www.", "https://") + word(3, 9) + ".com/" + word(2, 6),
        lambda: word(3, 9) + "." + word(2, 4),
        lambda: " ".join(num(int(n)) for n in r.integers(1, 5, int(r.integers(2, 8)))),
        lambda: f"{num(1)}+{num(1)}={num(2)} ({num(2)}/{num(2)})",
        lambda: f"({pick('a', 'at', 'b', year)}) [{num(1)}]")


CUES = {"email": ("mail", "e-mail:", "write to", "contact", "email is"), "ip": ("from", "host", "ip", "address", "server at"),
        "card": ("card", "card no.", "paid with", "visa", "number"), "phone": ("call", "phone:", "tel.", "fax", "dial")}


def _example(text: str, spans: list[tuple[int, int, int]], centre: int, r: np.random.Generator, alike: bool = False) -> tuple[np.ndarray, np.ndarray, bool]:
    """A training window around ``centre``: symbols and tags, and whether it was made to look like an item."""
    start = max(0, min(centre - int(r.integers(FIT_LENGTH // 5, FIT_LENGTH * 4 // 5)), len(text) - FIT_LENGTH))
    part = symbols(text[start: start + FIT_LENGTH])
    ids, tags = np.zeros(FIT_LENGTH, np.uint8), np.zeros(FIT_LENGTH, np.uint8)
    ids[: len(part)] = part
    for s, e, k in spans:
        tags[max(s - start, 0): max(min(e - start, FIT_LENGTH), 0)] = k
    return ids, tags, alike


def examples_of(text: str, r: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray, bool]]:
    """At most five windows of a text: around base spans, around a made-up item set between two words, around something
    alike that is none, and any."""
    spans = [(s, e, 1 + i) for i, k in enumerate(KINDS) for s, e in base_spans(text)[k]]
    out = [_example(text, spans, spans[int(i)][0], r) for i in r.permutation(len(spans))[:2]]
    at = int(r.integers(0, max(len(text), 1)))
    out.append(_example(text, spans, at, r))
    cut = text.find(" ", at)
    if cut >= 0:
        i = int(r.integers(len(KINDS)))
        before, after = text[max(0, cut - 150): cut + 1], text[cut: cut + 150]
        if not any(base_spans(x)[k] for x in (before, after) for k in KINDS):
            if r.random() < 0.5:
                before += _pick(r, *CUES[KINDS[i]]) + " "
            if r.random() < 0.25:
                before, after = before[-int(r.integers(1, 30)):], after[: int(r.integers(1, 30))]
            before += _pick(r, "", "", "", "(", "<", '"')
            after = _pick(r, "", "", ".", ",", ")", ">", '"', ";") + after
            item = written_anew(KINDS[i], r)
            out.append(_example(before + item + after, [(len(before), len(before) + len(item), i + 1)], len(before), r))
            alike = written_alike(r)
            if not any(base_spans(before + alike + after)[k] for k in KINDS):
                out.append(_example(before + alike + after, [], len(before), r, True))
    return out


EXAMPLE = T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("tags", T.BinaryType())])


def training_windows(docs: DataFrame, sample: int = FIT_DOCS) -> tuple[np.ndarray, np.ndarray]:
    """Windows and tags of about ``sample`` documents, drawn by a hash of doc_id; a fixed share has items."""
    bounded_batches(docs.sparkSession)
    n = docs.count()
    part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text <> ''")
    if n > sample:
        part = part.filter(F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 20)) < int((1 << 20) * sample / n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                r = np.random.default_rng([abs(d or 0), len(t)])
                own = examples_of(t, r)
                # Windows without an item are plenty; one in eight is enough.
                rows += [x for x in own if x[1].any() or x[2] or r.random() < 0.125]
            yield pa.RecordBatch.from_arrays([pa.array([x[i].tobytes() for x in rows], pa.binary()) for i in (0, 1)], EXAMPLE.fieldNames())

    rows = sorted((bytes(r.ids), bytes(r.tags)) for r in part.mapInArrow(run, EXAMPLE).collect())
    r = np.random.default_rng(SEED)
    if len(rows) < 400:
        made = []
        for _ in range(400):
            i = int(r.integers(len(KINDS)))
            item = written_anew(KINDS[i], r)
            ids, tags, _ = _example(f"the {item} and of", [(4, 4 + len(item), i + 1)], 4, r)
            made.append((ids.tobytes(), tags.tobytes()))
        rows += made
    return tuple(np.frombuffer(b"".join(x[i] for x in rows), np.uint8).reshape(-1, FIT_LENGTH) for i in (0, 1))


def fit(ids: np.ndarray, tags: np.ndarray, rounds: int = FIT_ROUNDS, seed: int = SEED) -> Tagger:
    """Adam; three of four windows of a batch hold an item, the kinds drawn evenly."""
    net, r = Tagger.fresh(seed), np.random.default_rng(seed)
    kinds = [np.flatnonzero((tags == k).any(axis=1)) for k in range(1, LABELS)]
    kinds = [k for k in kinds if len(k)]
    blank = np.flatnonzero(~tags.any(axis=1))
    m, v = ([np.zeros_like(p) for p in net.parts()] for _ in range(2))
    for step in range(1, rounds + 1):
        per = FIT_BATCH * 3 // 4 // len(kinds)
        rows = np.concatenate([r.choice(k, per) for k in kinds] + ([r.choice(blank, FIT_BATCH // 4)] if len(blank) else []))
        _, slopes = net.loss_and_slopes(ids[rows].T.astype(np.intp), tags[rows].T.astype(np.intp))
        norm = np.sqrt(sum(float((g * g).sum()) for g in slopes))
        rate = 0.015 * min(1.0, 2 * (1 - step / (rounds + 1)))
        for i, (w, g) in enumerate(zip(net.parts(), slopes)):
            g = g * min(1.0, 5 / max(norm, 1e-9))
            m[i] += 0.1 * (g - m[i])
            v[i] += 0.005 * (g * g - v[i])
            w -= (rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.995**step)) + 1e-7)).astype(np.float32)
    return net


def fit_pii(docs: DataFrame) -> Tagger:
    return fit(*training_windows(docs))


def written(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in KINDS for s, e in spans[k])


FOUND = T.StructType([T.StructField("doc_id", T.LongType()), *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS], T.StructField("base_sha256", T.StringType()),
                      T.StructField("spans", T.StringType()), T.StructField("n_added", T.LongType())])


def find_pii(docs: DataFrame, net: Tagger) -> DataFrame:
    """Per document: spans of each kind, a digest of the base spans, all spans, the number of added ones."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for base, all_ in spans_of(net, [t or "" for t in b.column(1).to_pylist()]):
                more = sum(map(len, all_.values())) - sum(map(len, base.values()))
                rows.append((*(len(all_[k]) for k in KINDS), hashlib.sha256(written(base).encode()).hexdigest(), written(all_), more))
            columns = [b.column(0), *map(list, zip(*rows))] if rows else [[]] * len(FOUND)
            yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, list) else c for c in columns], FOUND.fieldNames())

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, FOUND)


def masked(text: str, spans: dict[str, list[tuple[int, int]]]) -> str:
    """The text with each span replaced by its kind; spans that overlap are one."""
    out, at = [], 0
    for s, e, k in sorted((s, e, k) for k in KINDS for s, e in spans[k]):
        if s >= at:
            out += [text[at:s], f"<{k}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def mask_pii(docs: DataFrame, net: Tagger | None = None) -> DataFrame:
    """The documents with personal data replaced by its kind."""
    net = net or fit_pii(docs)
    bounded_batches(docs.sparkSession)
    names = docs.columns
    at, size = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            clean = [None if t is None else masked(t, all_) for t, (_, all_) in zip(texts, spans_of(net, [t or "" for t in texts]))]
            columns = list(b.columns)
            if size is not None:
                columns[size] = pa.array([n if t == c else len(c) for n, t, c in zip(columns[size].to_pylist(), texts, clean)], columns[size].type)
            columns[at] = pa.array(clean, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, docs.schema)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find_pii(spread(docs), fit_pii(docs))
