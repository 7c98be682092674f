"""Language identification (operator 1): a bidirectional gated recurrent network over bytes, in numpy.

Every byte of a text is an input and gets class probabilities; a document's probabilities are the mean over its letters.
A text is read in windows of WINDOW bytes with MARGIN more on either side, in both directions: states start in the
margins, so that every byte is labelled by states that have read MARGIN bytes and more on both sides of it, or all that the
text has there. Windows of many documents go through the network side by side. The cell has a gate z and a candidate c, both from the byte and the state before:
h' = h + z (c - h), z = clip(a/4 + 1/2, 0, 1), c = b / (1 + |b|). Training is backpropagation through time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.llm.common import crc_remainder, gathered, map_texts

#: Labelled bytes of a window, and bytes read before and after them.
WINDOW, MARGIN = 128, 24
HIDDEN = 8
LANES = 1024  # windows side by side
LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 0x80 for b in range(256)])


@dataclass
class Network:
    """gate, cand: [direction, byte, hidden] inputs; u_gate, u_cand: [direction, hidden, hidden]; out: [2 hidden, classes]."""

    languages: list[str]
    gate: np.ndarray
    cand: np.ndarray
    u_gate: np.ndarray
    u_cand: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    NAMES = ("gate", "cand", "u_gate", "u_cand", "out", "bias")

    @classmethod
    def random(cls, languages: list[str], seed: int = 7) -> Network:
        r = np.random.default_rng(seed)
        make = lambda *shape, scale: (r.normal(size=shape) * scale).astype(np.float32)
        k = len(languages)
        return cls(languages, make(2, 256, HIDDEN, scale=0.5), make(2, 256, HIDDEN, scale=0.5), make(2, HIDDEN, HIDDEN, scale=0.3), make(2, HIDDEN, HIDDEN, scale=0.3), make(2 * HIDDEN, k, scale=0.3), np.zeros(k, np.float32))


def run_direction(net: Network, d: int, codes: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States [time, lane, hidden] of direction d over codes [time, lane]; keep gets what the gradient needs."""
    steps, lanes = codes.shape
    states = np.empty((steps, lanes, HIDDEN), np.float32)
    h = np.zeros((lanes, HIDDEN), np.float32)
    gate, cand, ug, uc = net.gate[d], net.cand[d], net.u_gate[d], net.u_cand[d]
    for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
        a = np.take(gate, codes[t], axis=0)
        a += h @ ug
        z = a * np.float32(0.25)
        z += np.float32(0.5)
        np.maximum(z, 0, out=z)
        np.minimum(z, 1, out=z)
        b = np.take(cand, codes[t], axis=0)
        b += h @ uc
        size = np.abs(b)
        size += 1
        b /= size
        if keep is not None:
            keep.append((t, h, z, b, size, a))
        new = b - h
        new *= z
        new += h
        states[t] = h = new
    return states


def class_scores(net: Network, states: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Probabilities [time * lane, classes] at every position."""
    n = states[0].shape[0] * states[0].shape[1]
    s = states[0].reshape(n, HIDDEN) @ net.out[:HIDDEN]
    s += states[1].reshape(n, HIDDEN) @ net.out[HIDDEN:]
    s += net.bias
    s -= s.max(axis=1, keepdims=True)
    np.exp(s, out=s)
    s /= s.sum(axis=1, keepdims=True)
    return s


def gradients(net: Network, codes: np.ndarray, label: np.ndarray, margin: int = 0) -> tuple[float, dict[str, np.ndarray]]:
    """Cross-entropy over the letters of codes [time, lane] inside the margins, with a label for each lane, and its gradients."""
    steps, lanes = codes.shape
    kept: tuple[list, list] = ([], [])
    states = tuple(run_direction(net, d, codes, kept[d]) for d in (0, 1))
    p = class_scores(net, states).reshape(steps, lanes, -1)
    weight = LETTER[codes].astype(np.float32)
    weight[:margin] = weight[steps - margin :] = 0
    weight /= max(1.0, weight.sum())
    chosen = np.take_along_axis(p, np.broadcast_to(label[None, :, None], (steps, lanes, 1)), 2)[..., 0]
    loss = float(-(weight * np.log(chosen + 1e-9)).sum())
    ds = p * weight[..., None]
    ds[:, np.arange(lanes), label] -= weight
    g = {n: np.zeros_like(getattr(net, n)) for n in Network.NAMES}
    g["bias"] = ds.sum((0, 1))
    for d in (0, 1):
        part = slice(d * HIDDEN, (d + 1) * HIDDEN)
        g["out"][part] = np.einsum("tlh,tlk->hk", states[d], ds, optimize=True)
        dh_out = ds @ net.out[part].T
        carried = np.zeros((lanes, HIDDEN), np.float32)
        for t, h, z, c, size, a in reversed(kept[d]):
            dh = dh_out[t] + carried
            da = dh * (c - h) * np.float32(0.25)
            da[(a <= -2) | (a >= 2)] = 0
            db = dh * z / (size * size)
            np.add.at(g["gate"][d], codes[t], da)
            np.add.at(g["cand"][d], codes[t], db)
            g["u_gate"][d] += h.T @ da
            g["u_cand"][d] += h.T @ db
            carried = dh * (1 - z) + da @ net.u_gate[d].T + db @ net.u_cand[d].T
    return loss, g


def windows(raw: bytes) -> np.ndarray:
    """A text's bytes as rows of MARGIN, WINDOW and MARGIN bytes, each WINDOW further on; zero bytes stand around the text."""
    n = -(-len(raw) // WINDOW)
    padded = np.frombuffer(bytes(MARGIN) + raw.ljust(n * WINDOW + MARGIN, b"\0"), np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW + 2 * MARGIN)[::WINDOW] if n else np.zeros((0, WINDOW + 2 * MARGIN), np.uint8)


def train(texts: list[tuple[bytes, str]], steps: int = 220, lanes: int = 96, rate: float = 0.02, seed: int = 7) -> Network:
    """A network from (text, language) pairs by Adam, every language drawn equally often."""
    languages = sorted({lang for _, lang in texts})
    net = Network.random(languages, seed)
    pools = [w[LETTER[w[:, MARGIN : MARGIN + WINDOW]].any(axis=1)] for w in (np.concatenate([windows(t) for t, x in texts if x == lang]) for lang in languages)]
    usable = [k for k, p in enumerate(pools) if len(p)]
    if len(usable) < 2:
        return net
    r = np.random.default_rng(seed)
    m = {n: np.zeros_like(getattr(net, n)) for n in Network.NAMES}
    v = {n: np.zeros_like(getattr(net, n)) for n in Network.NAMES}
    for step in range(1, steps + 1):
        label = np.array(usable)[r.integers(0, len(usable), lanes)]
        codes = np.stack([pools[k][r.integers(0, len(pools[k]))] for k in label]).T.astype(np.intp)
        _, g = gradients(net, codes, label, MARGIN)
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        for n in Network.NAMES:
            x = g[n] * np.float32(min(1.0, 1.0 / (norm + 1e-9)))
            m[n] = 0.9 * m[n] + 0.1 * x
            v[n] = 0.99 * v[n] + 0.01 * x * x
            speed = np.float32(rate * min(1.0, 2 * (1 - step / (steps + 1))))
            getattr(net, n)[...] -= speed * (m[n] / (1 - 0.9**step)) / (np.sqrt(v[n] / (1 - 0.99**step)) + np.float32(1e-7))
    return net


def document_scores(net: Network, texts: list[bytes]) -> np.ndarray:
    """Mean class probabilities over the letters of each text, [text, class]; zeros for a text without one."""
    counts = np.array([-(-len(t) // WINDOW) for t in texts])
    owner = np.repeat(np.arange(len(texts)), counts)
    total, letters = np.zeros((len(texts), len(net.languages))), np.zeros(len(texts))
    if not len(owner) or not net.languages:
        return total
    joined = b"".join([bytes(MARGIN) + t.ljust(n * WINDOW + MARGIN, b"\0") for t, n in zip(texts, counts.tolist(), strict=True)])
    rows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(joined, np.uint8), WINDOW + 2 * MARGIN)
    begin = np.cumsum(counts * WINDOW + 2 * MARGIN) - (counts * WINDOW + 2 * MARGIN)
    first = np.cumsum(counts) - counts
    at = begin[owner] + (np.arange(len(owner)) - first[owner]) * WINDOW
    inside = slice(MARGIN, MARGIN + WINDOW)
    for a in range(0, len(at), LANES):
        codes = np.ascontiguousarray(rows[at[a : a + LANES]].T).astype(np.intp)
        forward, backward = run_direction(net, 0, codes)[inside], run_direction(net, 1, codes)[inside]
        p, weight = class_scores(net, (forward, backward)), LETTER[codes[inside]].astype(np.float32)
        by_window = np.einsum("tl,tlk->lk", weight, p.reshape(*weight.shape, -1))
        np.add.at(total, owner[a : a + LANES], by_window)
        np.add.at(letters, owner[a : a + LANES], weight.sum(axis=0))
    return total / np.maximum(letters, 1)[:, None]


def has_letter(raw: bytes) -> bool:
    """Whether a text holds a letter of any script."""
    return bool(raw) and (any(c in raw for c in b"etaoinsr") or any(map(str.isalpha, raw.decode("utf-8", "replace"))))


def learn_languages(docs: DataFrame, per_language: int = 120, sample_bytes: int = 32 << 20, key: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 5) -> Network:
    """A network from about per_language documents of each language outside the fold of remainder 0, sample_bytes of text.

    Both bounds are parameters. Which documents are drawn depends on hashes of the key and the text alone. Rows without
    text or language are not learned from; a null key counts as the empty text; repeated rows may be drawn together.
    """
    known = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & (crc_remainder(F.col(key), folds) != 0)).select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"))
    counts = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}
    chance = F.pmod(F.xxhash64("key", "text", F.lit(11)), F.lit(1 << 30))
    share = F.lit(0)
    for name, n in counts.items():
        share = F.when(F.col("lang") == name, int(min(1.0, per_language / n) * (1 << 30))).otherwise(share)
    drawn = gathered(known.where(chance < share).select("text", "lang"), F.octet_length("text"), sample_bytes, 11).to_pylist()
    return train(sorted((r["text"].encode("utf-8", "replace"), r["lang"]) for r in drawn))


def identify(docs: DataFrame, net: Network, key: str = "doc_id", text: str = "text", folds: int = 5) -> DataFrame:
    """One row per row of docs: key, held_out, lang_pred, score.

    A null text, or one without a letter, is `und` with score 0. Whole texts are read; equal texts get equal answers;
    an empty table gives an empty one; columns other than key and text are not read. With ties the first language in
    alphabetical order is taken.
    """

    def work(texts: list[bytes]) -> list[list]:
        p = document_scores(net, texts)
        best = p.argmax(axis=1) if p.shape[1] else np.zeros(len(texts), int)
        spoken = [has_letter(t) and bool(net.languages) for t in texts]
        return [[net.languages[b] if s else "und" for b, s in zip(best, spoken, strict=True)], [min(1.0, float(p[i, b])) if s else 0.0 for i, (b, s) in enumerate(zip(best, spoken, strict=True))]]

    made = map_texts(docs, [key], text, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], work)
    return made.select(key, (crc_remainder(F.col(key), folds) == 0).alias("held_out"), "lang_pred", "score")
