"""Language of whole texts by a bidirectional gated recurrent network over bytes.

The network reads the bytes of the whole lower-cased text in both directions, across words and lines, and gives
each byte a distribution over languages; a document's distribution is the mean over all of its bytes. A gate is
(1 + s) / 2 and a new state s with s(x) = x / (1 + |x|), which takes a fifth of the time of exponentials.

Texts are read in windows of up to CORE bytes; each starts MARGIN bytes early in both directions, so that a byte's
label depends on MARGIN bytes before and after it at least. Before its first byte and after its last a text is
taken to hold spaces. (Measured inside 300 long held-out texts: margins of 16 and of 200 bytes give the same language
to all; the pooled probabilities differ by 0.002 on average, by 0.13 at most.)

The network is trained here, in numpy, by backpropagation through time and Adam, on windows drawn from all over
the whole texts of a sample of labelled documents, SAMPLE_DOCS of each language.

Defined results: `und` with score 0 for a null text and one without a letter; `und` for all if nothing can
be learnt; a null doc_id is not held out; repeated rows give repeated results; an empty table gives no rows.
Extra columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.batches import whole_row
from tracemill.storage import checkpointed

FOLDS, HELD_OUT = 4, 2
#: Bound of the training sample: documents of each language.
SAMPLE_DOCS = 200
EMBEDDED, HIDDEN, STEPS, BATCH, DRAWN, RATE = 8, 8, 300, 128, (12, 40, 96), 0.02
#: Bytes that a window labels (a text's last window has the least size that fits), bytes read before and after them.
CORES, MARGIN = (32, 96, 224), 16
#: Windows computed at once, and bytes of text held as windows.
TOGETHER, HELD = 1536, 4_000_000
#: Sampled ids that may be broadcast; with more languages they meet their texts by a shuffle.
MOST_BROADCAST = 100_000
#: known_language: a language is told if it has more than this share, so more than all others together.
TOLD = 0.5
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
SPACE = 0x20


def fold(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS


def _squashed(a: np.ndarray, room: np.ndarray) -> None:
    """a becomes a / (1 + |a|)."""
    np.abs(a, out=room)
    room += 1
    np.divide(a, room, out=a)


class Network:
    """Byte embedding, a gated recurrent layer in each direction, a softmax at each position."""

    def __init__(self, classes: int, seed: int = 5):
        r = np.random.default_rng(seed)
        g = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"embed": g(256, EMBEDDED) * 8, "out": g(2 * HIDDEN, classes), "bias": np.zeros(classes, np.float32)}
        for d in "fb":
            self.p |= {f"in_{d}": g(EMBEDDED, 3 * HIDDEN), f"rec_{d}": g(HIDDEN, 3 * HIDDEN), f"off_{d}": np.zeros(3 * HIDDEN, np.float32)}

    def states(self, codes: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States (positions, HIDDEN, batch) of one direction; codes: (positions, batch)."""
        p, n, (length, batch) = self.p, HIDDEN, codes.shape
        table, rec = np.ascontiguousarray((p["embed"] @ p[f"in_{d}"] + p[f"off_{d}"]).T), np.ascontiguousarray(p[f"rec_{d}"].T)
        x, u, room = (np.empty((3 * n, batch), table.dtype) for _ in range(3))
        h, out = np.zeros((n, batch), table.dtype), np.empty((length, n, batch), table.dtype)
        for t in range(length) if d == "f" else range(length - 1, -1, -1):
            np.take(table, codes[t], axis=1, out=x, mode="clip")
            np.matmul(rec, h, out=u)
            gates, new = x[: 2 * n], x[2 * n :]
            gates += u[: 2 * n]
            _squashed(gates, room[: 2 * n])
            gates *= 0.5
            gates += 0.5
            new += gates[n:] * u[2 * n :]
            _squashed(new, room[: n])
            if keep is not None:
                keep.append((t, h.copy(), gates.copy(), new.copy(), u[2 * n :].copy()))
            h -= new
            h *= gates[:n]
            h += new
            out[t] = h
        return out

    def distributions(self, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
        """(classes, batch) at one position."""
        e = self.p["out"][:HIDDEN].T @ forward
        e += self.p["out"][HIDDEN:].T @ backward
        e += self.p["bias"][:, None]
        e -= e.max(axis=0)
        np.exp(e, out=e)
        e /= e.sum(axis=0)
        return e

    def gradients(self, codes: np.ndarray, labels: np.ndarray, margin: int = 0) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over all positions but the margins and its gradients, backwards through time.
        codes: (positions, batch)."""
        p, keep, n, (length, batch) = self.p, {"f": [], "b": []}, HIDDEN, codes.shape
        both = np.concatenate([self.states(codes, d, keep[d]) for d in "fb"], axis=1)
        error = np.stack([self.distributions(s[:n], s[n:]) for s in both])
        core = slice(margin, length - margin)
        loss = float(-np.log(np.maximum(error[core, labels, np.arange(batch)], 1e-12)).mean())
        error[:, labels, np.arange(batch)] -= 1
        error /= (length - 2 * margin) * batch
        error[:margin] = error[length - margin :] = 0
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["out"], g["bias"] = np.einsum("thb,tcb->hc", both, error), error.sum((0, 2))
        back = np.einsum("hc,tcb->thb", p["out"], error)
        for d, at in (("f", 0), ("b", n)):
            dh, rec = np.zeros((n, batch), back.dtype), p[f"rec_{d}"]
            dx = np.empty((length, 3 * n, batch), back.dtype)
            for t, h, gates, new, u in reversed(keep[d]):
                z, r = gates[:n], gates[n:]
                dh = dh + back[t, at : at + n]
                dnew = dh * (1 - z) * (1 - np.abs(new)) ** 2
                dz = dh * (h - new) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
                dr = dnew * u * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
                dx[t] = np.concatenate([dz, dr, dnew])
                du = np.concatenate([dz, dr, dnew * r])
                g[f"rec_{d}"] += h @ du.T
                dh = dh * z + rec @ du
            flat, order = codes.ravel(), np.argsort(codes.ravel(), kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(flat[order]) != 0])
            dtable = np.zeros((256, 3 * n), back.dtype)
            dtable[flat[order][first]] = np.add.reduceat(dx.transpose(0, 2, 1).reshape(-1, 3 * n)[order], first)
            g[f"in_{d}"], g[f"off_{d}"] = p["embed"].T @ dtable, dtable.sum(0)
            g["embed"] += dtable @ p[f"in_{d}"].T
        return loss, g

    def fit(self, texts: list[list[bytes]], steps: int = STEPS, seed: int = 9) -> None:
        """texts: of each class. A step draws classes, then texts, then places of windows evenly; every other step
        reads its windows as short texts, with spaces around them."""
        r, gap = np.random.default_rng(seed), MARGIN + max(DRAWN)
        line, size = _spaced([t for mine in texts for t in mine], gap), np.array([len(t) for mine in texts for t in mine])
        start = gap + np.r_[0, np.cumsum(size + gap)[:-1]]
        many = np.array([len(mine) for mine in texts])
        first = np.cumsum(many) - many
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            labels, drawn = r.integers(0, len(texts), BATCH), DRAWN[step // 2 % len(DRAWN)]
            which = first[labels] + (r.random(BATCH) * many[labels]).astype(np.int64)
            begin = start[which] + np.floor(r.random(BATCH) * np.maximum(size[which] - drawn + 1, 1)).astype(np.int64)
            codes = line[begin[None, :] + np.arange(-MARGIN, drawn + MARGIN)[:, None]].astype(np.intp)
            if step % 2:
                codes[:MARGIN] = codes[-MARGIN:] = SPACE
            _, g = self.gradients(codes, labels, MARGIN)
            rate = RATE * (1 - step / (steps + 1)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k in self.p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] * g[k]
                self.p[k] -= (rate * m[k] / (np.sqrt(v[k]) + 1e-8)).astype(np.float32)


def _spaced(texts: list[bytes], gap: int) -> np.ndarray:
    """All bytes in a row, gap spaces before, between and after the texts."""
    space = b" " * gap
    return np.frombuffer(space + space.join(texts) + space, np.uint8)


class Reader:
    """Sums of a text's position distributions. A text's sums don't depend on what is read with it."""

    def __init__(self, network: Network, classes: int):
        self.network, self.classes = network, classes

    def _pooled(self, line: np.ndarray, begin: np.ndarray, used: np.ndarray, core: int) -> np.ndarray:
        """(windows, classes): distributions summed over the first `used` bytes of windows that begin at `begin`."""
        out = np.zeros((len(begin), self.classes))
        for a in range(0, len(begin), TOGETHER):
            b = begin[a : a + TOGETHER]
            codes = line[b[None, :] + np.arange(-MARGIN, core + MARGIN)[:, None]].astype(np.intp)
            forward, backward = self.network.states(codes[: core + MARGIN], "f"), self.network.states(codes[MARGIN:], "b")
            sums, left = np.zeros((self.classes, len(b))), used[a : a + TOGETHER]
            for t in range(core):
                p = self.network.distributions(forward[MARGIN + t], backward[t])
                sums += p if left.min() > t else p * (left > t)
            out[a : a + TOGETHER] = sums.T
        return out

    def sums(self, texts: list[bytes]) -> np.ndarray:
        """(texts, classes)"""
        gap, out = MARGIN + max(CORES), np.zeros((len(texts), self.classes))
        line, size = _spaced(texts, gap), np.array([len(t) for t in texts])
        start = gap + np.r_[0, np.cumsum(size + gap)[:-1]]
        whole, rest = size // max(CORES), size % max(CORES)
        text = np.repeat(np.arange(len(texts)), whole)
        step = np.arange(len(text)) - np.repeat(np.cumsum(whole) - whole, whole)
        np.add.at(out, text, self._pooled(line, start[text] + step * max(CORES), np.full(len(text), max(CORES)), max(CORES)))
        for least, core in zip((0, *CORES), CORES, strict=False):
            some = np.flatnonzero((rest > least) & (rest <= core))
            out[some] += self._pooled(line, (start + whole * max(CORES))[some], rest[some], core)
        return out

    def texts(self, texts: list[str | None]) -> Iterator[np.ndarray | None]:
        """Mean distribution of each text, None without a letter."""
        coded = [t.lower().encode("utf-8", "surrogatepass") if t and LETTER.search(t) else None for t in texts]
        held: list[bytes] = []
        pending = [0]

        def flush() -> Iterator[np.ndarray]:
            for s in self.sums(held) if held else ():
                yield s / s.sum()
            held.clear()
            pending[0] = 0

        found: list[np.ndarray] = []
        for t in coded:
            if t is not None:
                held.append(t)
                pending[0] += len(t)
                if pending[0] >= HELD:
                    found.extend(flush())
        found.extend(flush())
        rest = iter(found)
        for t in coded:
            yield None if t is None else next(rest)


def training_texts(docs: DataFrame) -> dict[str, list[bytes]]:
    """Whole texts of a sample of the labelled documents outside the held-out fold, by language.

    A hash of the id deals the documents of each language into SAMPLE_DOCS parts; the sample is the first of
    each part by the hash. Only ids are compared, by a minimum that is taken before the shuffle, and only the
    sample reaches the driver: one text an id, the least of repeated ones.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}") & F.col("doc_id").isNotNull() & (fold() != HELD_OUT)).select("doc_id", "lang", "text")
    h = F.xxhash64("doc_id")
    part = F.pmod(h, F.lit(SAMPLE_DOCS)).alias("part")
    first = usable.groupBy("lang", part).agg(F.min(F.struct(h.alias("h"), "doc_id"))["doc_id"].alias("doc_id"))
    chosen = checkpointed(first.select("doc_id", "lang"))  # SAMPLE_DOCS ids a language at most
    chosen = F.broadcast(chosen) if chosen.count() <= MOST_BROADCAST else chosen
    sample = usable.join(chosen, ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    out: dict[str, list[bytes]] = {}
    for lang, _, text in sorted((r["lang"], r["doc_id"], r["text"]) for r in sample.collect()):
        if LETTER.search(text):
            out.setdefault(lang, []).append(text.lower().encode("utf-8", "surrogatepass"))
    return out


def _read(docs: DataFrame, *more: Column | str) -> tuple[DataFrame, list[str]]:
    """docs' columns `more` with held_out, lang_pred, score and letter (whether there is one); learned languages."""
    texts = training_texts(docs)
    names, network = list(texts), Network(max(1, len(texts)))
    if names:
        network.fit(list(texts.values()))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        reader = Reader(network, max(1, len(names)))
        for b in batches:
            if names:
                found = [(UNKNOWN, 0.0, False) if p is None else (names[int(p.argmax())], min(1.0, round(float(p.max()), 6)), True) for p in reader.texts(list(b))]
            else:
                found = [(UNKNOWN, 0.0, bool(t) and bool(LETTER.search(t))) for t in b]
            yield pd.DataFrame(found, columns=["lang", "score", "letter"])

    # so marked, it runs once a row: filters on its result aren't pushed below it
    predict = F.pandas_udf(run, "lang string, score double, letter boolean").asNondeterministic()
    held = F.coalesce(fold() == HELD_OUT, F.lit(False))
    found = docs.select(*more, held.alias("held_out"), predict("text").alias("_found"))
    kept = [m if isinstance(m, str) else F.col("_row") for m in more]
    return found.select(*kept, "held_out", F.col("_found.lang").alias("lang_pred"), F.col("_found.score").alias("score"), F.col("_found.letter").alias("letter")), names


def languages(docs: DataFrame, *more: str) -> DataFrame:
    """docs' columns `more` with held_out, lang_pred and score for each document. Narrow but for training."""
    return _read(docs, *more)[0].drop("letter")


def known_language(docs: DataFrame) -> DataFrame:
    """docs' rows whose language is known. Those without a letter go, those to which no language gives more than TOLD of
    the probability, and those whose label is another learnt language than the one predicted. If nothing can be learnt,
    all with a letter stay."""
    found, names = _read(docs, whole_row(docs).alias("_row"))
    if not names:
        return found.where("letter").select("_row.*")
    label = F.col("_row.lang")
    agrees = label.isNull() | ~label.isin(*names) | (label == F.col("lang_pred"))
    return found.where(F.col("letter") & (F.col("score") > TOLD) & agrees).select("_row.*")
