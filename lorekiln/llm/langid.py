"""Languages of documents and of their stretches: a bidirectional gated recurrent network over bytes, trained in numpy."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LANGUAGES = ("en", "es", "fr", "pt")
HIDDEN = 16
#: Bounds of the labelled sample: chunks of a language, and windows (of WINDOW bytes) of a language.
SAMPLE_CHUNKS, SAMPLE_WINDOWS, WINDOW = 400, 3_000, 64
STEPS, BATCH, RATE, BATCH_READ = 300, 64, 0.015, 256
#: Position log-probabilities lean on each other: a sentence counts them at this rate, and a change of language costs SWITCH.
RATE_OF_EVIDENCE, SWITCH = 0.12, 6.0
#: Units of more bytes are read in windows, so that a text without stops doesn't set the length of a batch; windows overlap.
LONGEST, OVERLAP = 320, 32
UNIT_END = re.compile(r"[.?!][\"'”»›’)\]]*\s+")
#: No UTF-8 text has this byte, so it fills up a batch.
PADDING = 255


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.clip(x, -60, 60, out=x)
    np.exp(x, out=x)
    x += 1
    np.reciprocal(x, out=x)
    return x


class Network:
    """Two gated recurrent layers, one in each direction, whose joined states label every byte."""

    def __init__(self, n_out: int, hidden: int = HIDDEN, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        u = lambda *s: rng.uniform(-1, 1, s).astype("f4") / np.sqrt(hidden)
        self.p = {}
        for d in "fb":
            self.p |= {f"x{d}": u(257, 3 * hidden), f"u{d}": u(hidden, 3 * hidden), f"c{d}": np.zeros(3 * hidden, "f4")}
        self.p |= {"o": u(2 * hidden, n_out), "q": np.zeros(n_out, "f4")}
        self.h, self.n_out, self._kept, self._buffers = hidden, n_out, None, {}

    def run(self, x: np.ndarray, d: str, keep: bool = False):
        """States (T, B, H) of one direction for bytes x (T, B), 256 for padding at the end."""
        t_all, b, n = x.shape[0], x.shape[1], self.h
        wx, u = self.p[f"x{d}"] + self.p[f"c{d}"], self.p[f"u{d}"]
        h = np.zeros((b, n), "f4")
        hs = np.empty((t_all, b, n), "f4")
        kept = []
        for t in range(t_all):
            a = wx[x[t]]
            g = h @ u
            rz = _sigmoid(a[:, : 2 * n] + g[:, : 2 * n])
            r, z = rz[:, :n], rz[:, n:]
            m = np.tanh(a[:, 2 * n :] + r * g[:, 2 * n :])
            if keep:
                kept.append((h, r, z, m, g[:, 2 * n :]))
            h = m + z * (h - m)
            hs[t] = h
        return (hs, kept) if keep else hs

    @staticmethod
    def _turned(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Each sequence backwards, padding stays at the end; its own inverse."""
        t = np.arange(x.shape[0])[:, None]
        at = np.where(t < lengths, lengths - 1 - t, t)
        return np.take_along_axis(x, at if x.ndim == 2 else at[:, :, None], 0)

    def _tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Input rows by (gate, direction, byte) and recurrent weights by (gate, direction), scaled so that a gate's sigmoid is
        (tanh + 1) / 2; padding keeps the state, so the backward direction may begin with it."""
        if self._kept is None:
            n = self.h
            by_gate = lambda w, k: np.stack([w(d).reshape(-1, 3, n)[:, k] for d in "fb"])
            x = np.stack([c * by_gate(lambda d: self.p[f"x{d}"] + self.p[f"c{d}"], k) for k, c in enumerate((0.5, 0.5, 1.0))])
            x[:, :, PADDING] = 0
            x[1, :, PADDING] = 40
            u = np.stack([0.5 * by_gate(lambda d: self.p[f"u{d}"], k) for k in range(3)])
            self._kept = x.reshape(-1, n).astype("f4"), u.astype("f4")
        return self._kept

    def _room(self, name: str, *shape: int) -> np.ndarray:
        """A buffer that lasts from call to call: fresh memory for every batch costs more than the sums in it."""
        size = int(np.prod(shape))
        if name not in self._buffers or self._buffers[name].size < size:
            self._buffers[name] = np.empty(size, np.intp if name == "at" else "f4")
        return self._buffers[name][:size].reshape(shape)

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        """(languages, T, B) for bytes x (T, B), valid until the next call; both directions step together, gates lie apart, every
        step writes into the same buffers."""
        t_all, b, n, k = x.shape[0], x.shape[1], self.h, self.n_out
        rows, u = self._tables()
        at, hs = self._room("at", t_all, 3, 2, b), self._room("hs", t_all, 2, b, n)
        offset = 257 * np.arange(6).reshape(3, 2, 1)
        np.add(x[:, None], offset[:, 0], out=at[:, :, 0])
        np.add(x[::-1, None], offset[:, 1], out=at[:, :, 1])
        h = np.zeros((2, b, n), "f4")
        a, g = self._room("a", 3, 2, b, n), self._room("g", 3, 2, b, n)
        gates, m, g_gates, g_new = a[:2], a[2], g[:2], g[2]
        for t in range(t_all):
            np.take(rows, at[t], axis=0, out=a, mode="clip")
            np.matmul(h, u, out=g)
            gates += g_gates
            np.tanh(gates, out=gates)
            gates += 1
            g_new *= gates[0]
            m += g_new
            np.tanh(m, out=m)
            h = np.subtract(h, m, out=hs[t])
            h *= gates[1]
            h *= 0.5
            h += m
        o = self.p["o"].T
        s, back = self._room("s", t_all, k, b), self._room("back", t_all, k, b)
        np.matmul(o[:, :n], hs[:, 0].swapaxes(1, 2), out=s)
        np.matmul(o[:, n:], hs[:, 1].swapaxes(1, 2), out=back)
        s += back[::-1]
        s += self.p["q"][:, None]
        s -= s.max(1, keepdims=True)
        np.exp(s, out=back)
        s -= np.log(back.sum(1, keepdims=True))
        return s.swapaxes(0, 1)

    def gradients(self, x: np.ndarray, lengths: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy over all positions, by backpropagation through time."""
        t_all, b = x.shape
        f, kf = self.run(x, "f", True)
        xr = self._turned(x, lengths)
        br, kb = self.run(xr, "b", True)
        back = self._turned(br, lengths)
        both = np.concatenate([f, back], -1)
        s = both @ self.p["o"] + self.p["q"]
        s -= s.max(-1, keepdims=True)
        e = np.exp(s)
        e /= e.sum(-1, keepdims=True)
        e[:, np.arange(b), label] -= 1
        mask = (np.arange(t_all)[:, None] < lengths).astype("f4")
        e *= (mask / mask.sum())[:, :, None]
        out = {"o": both.reshape(-1, 2 * self.h).T @ e.reshape(-1, self.n_out), "q": e.sum((0, 1))}
        dh = e @ self.p["o"].T
        for d, xs, kept, dhs in (("f", x, kf, dh[:, :, : self.h]), ("b", xr, kb, self._turned(dh[:, :, self.h :], lengths))):
            out |= self._through_time(d, xs, kept, dhs)
        return out

    def _through_time(self, d: str, x: np.ndarray, kept: list, dhs: np.ndarray) -> dict[str, np.ndarray]:
        n, u = self.h, self.p[f"u{d}"]
        gu, gc, gx = np.zeros_like(u), np.zeros(3 * n, "f4"), np.zeros((257, 3 * n), "f4")
        dh = np.zeros((x.shape[1], n), "f4")
        das = np.empty((x.shape[0], x.shape[1], 3 * n), "f4")
        for t in range(x.shape[0] - 1, -1, -1):
            h, r, z, m, gm = kept[t]
            dh = dh + dhs[t]
            dm = dh * (1 - z) * (1 - m * m)
            dz = dh * (h - m) * z * (1 - z)
            dr = dm * gm * r * (1 - r)
            da = das[t]
            da[:, :n], da[:, n : 2 * n], da[:, 2 * n :] = dr, dz, dm
            dg = np.concatenate([dr, dz, dm * r], 1)
            gu += h.T @ dg
            dh = dh * z + dg @ u.T
        flat = das.reshape(-1, 3 * n)
        gc += flat.sum(0)
        order = np.argsort(x.ravel(), kind="stable")
        keys = x.ravel()[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        gx[keys[first]] = np.add.reduceat(flat[order], first, axis=0)
        return {f"u{d}": gu, f"c{d}": gc, f"x{d}": gx}


def padded(seqs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes (T, B), filled up at the end, and the lengths."""
    lengths = np.array([len(s) for s in seqs])
    most = max(1, lengths.max(initial=1))
    joined = b"".join([s.ljust(most, b"\xff") for s in seqs])
    return np.frombuffer(joined, np.uint8).reshape(len(seqs), most).T.astype(np.int16), lengths


def train(texts: list[tuple[str, str]], languages: tuple[str, ...] = LANGUAGES, steps: int = STEPS, seed: int = 3) -> Network:
    """A network from (text, language) pairs; at most SAMPLE_WINDOWS windows of each language are used, drawn by seed."""
    rng = np.random.default_rng(seed)
    net = Network(len(languages))
    windows: list[list[bytes]] = [[] for _ in languages]
    for text, lang in texts:
        for _, unit in units(text):
            b = unicodedata.normalize("NFC", unit).encode()
            windows[languages.index(lang)] += [b[i : i + WINDOW] for i in range(0, max(1, len(b) - 8), WINDOW)]
    windows = [[w[i] for i in rng.permutation(len(w))[:SAMPLE_WINDOWS]] for w in windows]
    have = [k for k, w in enumerate(windows) if w]
    if not have:
        return net
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    for step in range(1, steps + 1):
        label = rng.choice(have, BATCH)
        seqs = [windows[k][rng.integers(len(windows[k]))] for k in label]
        x, lengths = padded(seqs)
        grads = net.gradients(x, lengths, label)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        rate = RATE * min(1.0, step / 30) * (0.1 if step > 0.8 * steps else 1.0)
        for k, g in grads.items():
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            net._kept = None
            net.p[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype("f4")
    return net


def units(text: str) -> list[tuple[int, str]]:
    """(offset, unit): what lies between sentence ends and between lines, without blank ones."""
    out, at = [], 0
    for m in UNIT_END.finditer(text):
        out.append((at, text[at : m.start() + 1]))
        at = m.end()
    if text[at:].strip():
        out.append((at, text[at:]))
    return out


def _windows(b: bytes) -> list[tuple[bytes, int, int]]:
    """(window, from, to): what the network reads and which of its positions count; between windows it reads OVERLAP more bytes on
    either side, so that every position is labelled with what stands around it."""
    if len(b) <= LONGEST:
        return [(b, 0, len(b))]
    return [(b[max(0, i - OVERLAP) : i + LONGEST + OVERLAP], min(i, OVERLAP), min(i, OVERLAP) + min(LONGEST, len(b) - i)) for i in range(0, len(b), LONGEST)]


def label_units(net: Network, texts: list[str | None]) -> tuple[list[list[tuple[int, int]]], np.ndarray]:
    """For each text the (offset, end) of its units with letters; and the summed position log-probabilities of all units in order."""
    unit_of, windows, seqs, out, n = [], [], [], [], 0
    for t in texts:
        rows = []
        for at, u in units(t) if t else ():
            if any(map(str.isalpha, u)):
                rows.append((at, at + len(u)))
                for w, a, b in _windows((u if u.isascii() else unicodedata.normalize("NFC", u)).encode()):
                    unit_of.append(n)
                    windows.append((a, b))
                    seqs.append(w)
                n += 1
        out.append(rows)
    scores = np.zeros((n, net.n_out))
    order = np.argsort([len(s) for s in seqs], kind="stable")
    unit_of, counted = np.array(unit_of, int), np.array(windows, int).reshape(-1, 2)
    for lo in range(0, len(order), BATCH_READ):
        part = order[lo : lo + BATCH_READ]
        x, _ = padded([seqs[k] for k in part])
        t = np.arange(x.shape[0])[:, None]
        lp = net.log_probabilities(x)
        lp *= (t >= counted[part, 0]) & (t < counted[part, 1])
        np.add.at(scores, unit_of[part], lp.sum(1).T)
    return out, scores


def best_path(scores: np.ndarray) -> np.ndarray:
    """The languages of a text's units: the evidence of each, and a cost of each change."""
    n, k = scores.shape
    best, back = scores[0].copy(), np.zeros((n, k), int)
    for i in range(1, n):
        move = best.max() - SWITCH
        back[i] = np.where(best >= move, np.arange(k), best.argmax())
        best = np.maximum(best, move) + scores[i]
    path = np.empty(n, int)
    path[-1] = best.argmax()
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i][path[i]]
    return path


def segments_of(net: Network, texts: list[str | None]) -> list[list[tuple[int, int, int, float]]]:
    """For each text its segments (language, start, end, confidence); texts without letters have none."""
    placed, scores = label_units(net, texts)
    scores *= RATE_OF_EVIDENCE
    best, out, at = scores.argmax(1), [], 0
    for rows in placed:
        n = len(rows)
        own, path = scores[at : at + n], best[at : at + n]
        at += n
        if n > 1 and (path != path[0]).any():  # units that agree need no path
            path = best_path(own)
        cuts = [0, *(np.flatnonzero(path[1:] != path[:-1]) + 1).tolist(), n] if n else [0]
        segs = []
        for a, b in zip(cuts, cuts[1:]):
            total = own[a:b].sum(0)
            p = np.exp(total - total.max())
            segs.append((int(path[a]), rows[a][0], rows[b - 1][1], float(p[path[a]] / p.sum())))
        out.append(segs)
    return out


def labelled_sample(chunks: DataFrame, languages: tuple[str, ...] = LANGUAGES, per_language: int = SAMPLE_CHUNKS, seed: int = 3) -> list[tuple[str, str]]:
    """At most ``per_language`` texts of each label, those of smallest hash among a thinned set, from rows whose label and
    folder agree (or whose path has no language's folder)."""
    folder = F.regexp_extract("file_path", r"^([a-z]{2})/", 1)
    good = chunks.where(F.col("text").isNotNull() & F.col("language").isin(*languages) & ((folder == F.col("language")) | (folder == ""))).withColumn("u", F.xxhash64(F.lit(seed), F.col("id")))
    counts = {r["language"]: r["count"] for r in good.groupBy("language").count().collect()}
    thin = F.lit(False)
    for lang, n in counts.items():
        thin = thin | ((F.col("language") == lang) & (F.pmod("u", F.lit(max(1, n // (2 * per_language)))) == 0))
    rows = sorted(good.where(thin).select("u", "text", "language").collect(), key=lambda r: r["u"])
    out = []
    for lang in languages:
        out += [(r["text"], lang) for r in rows if r["language"] == lang][:per_language]
    return out


def segments(chunks: DataFrame, net: Network, languages: tuple[str, ...] = LANGUAGES, key: str = "id", text: str = "text") -> DataFrame:
    """(chunk_id, segment_no, lang, start_char, end_char, confidence, n_segments, doc_lang, doc_confidence) of every text.

    The weights (some 50 kB) go with the function. doc_lang is the language with most of the text, its confidence pools the
    segments'. Null and letterless texts have no row; other columns are ignored; repeated rows give repeated segments.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                rows = []
                for i, segs in zip(part.column(0).to_pylist(), segments_of(net, part.column(1).to_pylist())):
                    if not segs:
                        continue
                    share: dict[int, int] = {}
                    for k, s, e, _ in segs:
                        share[k] = share.get(k, 0) + e - s
                    doc = max(share, key=lambda k: share[k])
                    sure = sum((e - s) * c for k, s, e, c in segs if k == doc) / sum(e - s for _, s, e, _ in segs)
                    rows += [(i, n, languages[k], s, e, c, len(segs), languages[doc], sure) for n, (k, s, e, c) in enumerate(segs)]
                kinds = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.string(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 9, kinds)], names=["chunk_id", "segment_no", "lang", "start_char", "end_char", "confidence", "n_segments", "doc_lang", "doc_confidence"])

    schema = "chunk_id long, segment_no int, lang string, start_char int, end_char int, confidence double, n_segments int, doc_lang string, doc_confidence double"
    return chunks.where(F.col(text).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, schema)
