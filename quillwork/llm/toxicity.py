"""Toxicity by a bidirectional gated recurrent network with attention, in numpy.

A word's input is an embedding of the word, the mean embedding of its character
n-grams and that of its beginnings; what few documents of the sample have shares
one embedding. Windows of ``WINDOW`` words that overlap cover every text; a
gated recurrent layer reads each window in both directions, attention pools its
states, and a logistic unit scores it. A document has the score of its worst
window.

Only documents are labelled, so training looks for the windows: each round takes
from every document of the sample the window that now scores highest, which is
the evidence in a toxic text and the hardest counter-example in a clean one.
The sample is bounded; every window of every document is scored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import as_bytes, bound_batches, give_back, slices, sql_type

WINDOW, STRIDE = 32, 24
GRAM_BINS = 1 << 18
GRAMS, HEADS = (3, 4, 5), (3, 4, 5, 6, 7)
DIM, HIDDEN, ATTENTION = 8, 8, 8
TABLES = ("word", "gram", "head")
SAMPLE_ROWS = 2000
TEXT_BYTES = 1 << 16
ROUNDS, GUIDED, STEPS, STEP_WINDOWS = 14, 2, 240, 128
HELD, MIN_DOCS, CHANCE, FEW = 5, 5, 4.0, 20
SLOW = np.float32(0.3)  # rate of the embeddings against that of the layers
CHUNK = 2048
SLICE_BYTES = 1 << 20  # a word brings some hundred bytes of inputs
MARKS = b".,;:!?\"'()[]{}"


@dataclass
class Words:
    """Distinct words of a set of texts with their inputs, and the texts as word numbers; number 0 pads.

    ``grams`` are the places of all words' n-grams one after another, word ``i`` has those from ``first[i]`` on;
    ``heads`` those of its beginnings, one row per word. Place 0 is unknown.
    """
    texts: list[np.ndarray]
    word: np.ndarray
    grams: np.ndarray
    first: np.ndarray
    heads: np.ndarray

    def grams_of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams of some words, one after another, and how many each has."""
        count = self.first[numbers + 1] - self.first[numbers]
        return self.grams[np.repeat(self.first[numbers] - (np.cumsum(count) - count), count) + np.arange(count.sum())], count

    def take(self, numbers: np.ndarray) -> Words:
        grams, count = self.grams_of(numbers)
        return Words([], self.word[numbers], grams, np.concatenate([[0], np.cumsum(count)]), self.heads[numbers])


def read_words(texts: list[bytes | None], known: dict[bytes, int] | None = None) -> Words:
    """Words by ``known``, or numbered as they come; n-grams by their hashed places."""
    numbers: dict[bytes, int] = {b"": 0}
    rows = [np.array([numbers.setdefault(w.strip(MARKS) or w, len(numbers)) for w in (t or b"").lower().split()], dtype=np.int32)
            for t in texts]
    flat = np.frombuffer(b"".join([b"<%b>" % w for w in numbers]), dtype=np.uint8).astype(np.uint32)
    sizes = np.array([len(w) + 2 for w in numbers])
    ends = np.cumsum(sizes)
    starts, stop = ends - sizes, np.repeat(ends, sizes)
    word = np.arange(len(numbers)) if known is None else np.fromiter((known.get(w, 0) for w in numbers), np.int64, len(numbers))
    heads = np.zeros((len(numbers), len(HEADS)), dtype=np.int64)
    code, parts, owners = np.zeros(len(flat), dtype=np.uint32), [], []
    for n in range(1, max(*GRAMS, *HEADS) + 1):
        code = code[:max(0, len(flat) - n + 1)] * np.uint32(0x01000193) ^ (flat[n - 1:] + np.uint32(n))
        place = 1 + (((code * np.uint32(0x9E3779B1)) >> np.uint32(8)).astype(np.int64) % (GRAM_BINS - 1))
        if n in GRAMS:
            at = np.flatnonzero(np.arange(len(code)) + n <= stop[:len(code)])
            parts.append(place[at])
            owners.append(np.searchsorted(ends, at, side="right"))
        if n in HEADS:
            has = np.flatnonzero(sizes >= n)
            heads[has, HEADS.index(n)] = place[starts[has]]
    grams, owner = np.concatenate(parts), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return Words(rows, word, grams[order], np.searchsorted(owner[order], np.arange(len(numbers) + 1)), heads)


def windows_of(row: np.ndarray) -> np.ndarray:
    """Word numbers of the overlapping windows of a text; the last one ends with the text, a short text is padded."""
    n = len(row)
    if n <= WINDOW:
        return np.concatenate([row, np.zeros(WINDOW - n, dtype=np.int32)])[None, :]
    starts = np.append(np.arange(0, n - WINDOW, STRIDE), n - WINDOW)
    return row[starts[:, None] + np.arange(WINDOW)[None, :]]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    """Parameters by name. Arrays with a leading 2 have one part per reading direction; gates are reset, keep, new.
    ``words`` numbers the known words; ``places`` numbers the known n-grams and beginnings; number 0 is unknown."""
    p: dict[str, np.ndarray] = field(default_factory=dict)
    words: dict[bytes, int] = field(default_factory=dict)
    places: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def start(cls, sizes: dict[str, int], seed: int = 0) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        return cls({
            **{k: draw(n, DIM, scale=0.05) for k, n in sizes.items()},
            "in": draw(2, len(TABLES) * DIM, 3 * HIDDEN, scale=0.3), "in0": np.zeros((2, 1, 3 * HIDDEN), np.float32),
            "rec": draw(2, HIDDEN, 3 * HIDDEN, scale=0.3), "att": draw(2 * HIDDEN, ATTENTION, scale=0.4),
            "att0": np.zeros(ATTENTION, np.float32), "att1": draw(ATTENTION, scale=0.4),
            "out": draw(2 * HIDDEN, scale=0.4), "out0": np.zeros(1, np.float32)})

    def read(self, texts: list[bytes | None]) -> Words:
        found = read_words(texts, self.words)
        found.grams, found.heads = self.places["gram"][found.grams], self.places["head"][found.heads]
        return found

    def inputs(self, words: Words) -> np.ndarray:
        """Per distinct word: its embedding, the mean one of its character n-grams and the mean one of its beginnings."""
        count = np.diff(words.first)
        chars = np.zeros((len(count), DIM), dtype=np.float32)
        full = np.flatnonzero(count)
        if len(full):
            chars[full] = np.add.reduceat(self.p["gram"][words.grams], words.first[:-1][full], axis=0) / count[full, None]
        return np.concatenate([self.p["word"][words.word], chars, self.p["head"][words.heads].mean(axis=1)], axis=1)

    def projected(self, inputs: np.ndarray) -> np.ndarray:
        """Input part of the gates, both directions; the padding word keeps the state as it is."""
        x = inputs @ self.p["in"] + self.p["in0"]
        x[:, 0, :HIDDEN], x[:, 0, HIDDEN:2 * HIDDEN], x[:, 0, 2 * HIDDEN:] = 0, 40, 0
        return x

    def forward(self, gates: np.ndarray, ids: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logit per window of ``ids``; ``keep`` receives what the way back needs."""
        size, steps, h2 = len(ids), ids.shape[1], 2 * HIDDEN
        state = np.zeros((2, size, HIDDEN), dtype=np.float32)
        states = np.empty((steps, 2, size, HIDDEN), dtype=np.float32)
        rec = self.p["rec"]
        trace = []
        for t in range(steps):
            x = np.stack([gates[0][ids[:, t]], gates[1][ids[:, steps - 1 - t]]])
            g = state @ rec
            rz = sigmoid(x[..., :h2] + g[..., :h2])
            r, z = rz[..., :HIDDEN], rz[..., HIDDEN:]
            new = np.tanh(x[..., h2:] + r * g[..., h2:])
            if keep is not None:
                trace.append((state, r, z, new, g[..., h2:]))
            state = new + z * (state - new)
            states[t] = state
        both = np.concatenate([states[:, 0], states[::-1, 1]], axis=-1)
        hidden = np.tanh(both @ self.p["att"] + self.p["att0"])
        energy = np.where(ids.T == 0, np.float32(-1e9), hidden @ self.p["att1"])
        weight = np.exp(energy - energy.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", weight, both)
        if keep is not None:
            keep.update(trace=trace, both=both, hidden=hidden, weight=weight, pooled=pooled)
        return pooled @ self.p["out"] + self.p["out0"][0]

    def logits(self, words: Words) -> list[np.ndarray]:
        """Logits of all windows per text."""
        gates = self.projected(self.inputs(words))
        parts = [windows_of(r) for r in words.texts]
        if not parts:
            return []
        ids = np.concatenate(parts)
        out = np.concatenate([self.forward(gates, ids[a:a + CHUNK]) for a in range(0, len(ids), CHUNK)])
        out[(ids == 0).all(axis=1)] = -np.inf
        return np.split(out, np.cumsum([len(x) for x in parts])[:-1])

    def gradients(self, words: Words, ids: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Weighted cross entropy of windows and its derivatives."""
        numbers = np.unique(np.append(ids.ravel(), 0))
        words, ids = words.take(numbers), np.searchsorted(numbers, ids)
        inputs = self.inputs(words)
        keep: dict = {}
        logit = self.forward(self.projected(inputs), ids, keep)
        prob = sigmoid(logit)
        loss = float((weight * (np.logaddexp(0, logit) - target * logit)).sum())
        d = ((prob - target) * weight).astype(np.float32)
        p, both, hidden, alpha = self.p, keep["both"], keep["hidden"], keep["weight"]
        grad = {"out": d @ keep["pooled"], "out0": np.array([d.sum()], np.float32)}
        d_pooled = d[:, None] * p["out"]
        d_alpha = np.einsum("bh,tbh->tb", d_pooled, both)
        d_energy = alpha * (d_alpha - (alpha * d_alpha).sum(axis=0))
        d_hidden = d_energy[..., None] * p["att1"] * (1 - hidden ** 2)
        grad["att1"] = np.einsum("tb,tba->a", d_energy, hidden)
        grad["att"] = np.einsum("tbh,tba->ha", both, d_hidden)
        grad["att0"] = d_hidden.sum(axis=(0, 1))
        d_both = alpha[..., None] * d_pooled + d_hidden @ p["att"].T
        steps = len(d_both)
        d_states = np.stack([d_both[..., :HIDDEN], d_both[::-1, :, HIDDEN:]], axis=1)
        d_gates = np.zeros((2, len(inputs), 3 * HIDDEN), dtype=np.float32)
        grad["rec"] = np.zeros_like(p["rec"])
        carry = np.zeros_like(d_states[0])
        turned = p["rec"].transpose(0, 2, 1)
        for t in reversed(range(steps)):
            state, r, z, new, inner = keep["trace"][t]
            dh = d_states[t] + carry
            d_new = dh * (1 - z) * (1 - new ** 2)
            d_z = dh * (state - new) * z * (1 - z)
            d_r = d_new * inner * r * (1 - r)
            d_rec = np.concatenate([d_r, d_z, d_new * r], axis=-1)
            grad["rec"] += state.transpose(0, 2, 1) @ d_rec
            carry = dh * z + d_rec @ turned
            d_in = np.concatenate([d_r, d_z, d_new], axis=-1)
            np.add.at(d_gates[0], ids[:, t], d_in[0])
            np.add.at(d_gates[1], ids[:, steps - 1 - t], d_in[1])
        d_gates[:, 0] = 0
        grad["in"] = inputs.T @ d_gates
        grad["in0"] = d_gates.sum(axis=1, keepdims=True)
        d_inputs = (d_gates @ p["in"].transpose(0, 2, 1)).sum(axis=0)
        used = np.flatnonzero(np.abs(d_inputs).sum(axis=1))
        for name in TABLES:
            grad[name] = np.zeros_like(p[name])
        np.add.at(grad["word"], words.word[used], d_inputs[used, :DIM])
        grams, count = words.grams_of(used)
        np.add.at(grad["gram"], grams, np.repeat(d_inputs[used, DIM:2 * DIM] / np.maximum(count, 1)[:, None], count, axis=0))
        for column in words.heads[used].T:
            np.add.at(grad["head"], column, d_inputs[used, 2 * DIM:] / len(HEADS))
        return loss, grad


def document_counts(words: Words, labels: np.ndarray) -> dict[str, np.ndarray]:
    """Clean and toxic documents with each word, n-gram and beginning."""
    seen = {"word": np.zeros((2, len(words.word))), "gram": np.zeros((2, GRAM_BINS)), "head": np.zeros((2, GRAM_BINS))}
    for row, label in zip(words.texts, labels.tolist()):
        numbers = np.unique(row)
        seen["word"][label, words.word[numbers]] += 1
        seen["gram"][label, np.unique(words.grams_of(numbers)[0])] += 1
        seen["head"][label, np.unique(words.heads[numbers])] += 1
    return seen


def evidence(seen: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How far more often toxic than clean documents have a place: the signed root of the likelihood ratio, without
    what may be chance (``CHANCE``)."""
    total, part = seen.sum(axis=0), sizes / sizes.sum()
    ratio = np.zeros(seen.shape[1])
    for have, all_ in ((seen, total), (sizes[:, None] - seen, sizes.sum() - total)):
        expected = np.maximum(part[:, None] * all_, 1e-9)
        ratio += 2 * (have * np.log(np.maximum(have, 1e-9) / expected)).sum(axis=0)
    root = np.sqrt(np.maximum(ratio, 0)) - CHANCE
    return np.where(seen[1] > part[1] * total, 1, -1) * np.clip(root, 0, 6)


def train_network(texts: list[bytes | None], labels: np.ndarray, prior: float, rounds: int = ROUNDS, seed: int = 0) -> Network:
    """Fit on labelled texts; ``prior`` is the share of toxic texts among all labelled ones.

    One text in ``HELD`` is set aside: those choose the best round and place the decision at one half. Embeddings start from
    the evidence of documents, which also choose the windows of the first rounds. What occurs in fewer than ``MIN_DOCS``
    texts is unknown, so that nothing is learned by heart from one text.
    """
    rng = np.random.default_rng(seed)
    if len(np.unique(labels)) < 2:
        net = Network.start(dict.fromkeys(TABLES, 1), seed)
        net.places = dict.fromkeys(("gram", "head"), np.zeros(GRAM_BINS, dtype=np.int64))
        net.p["out"][:] = 0
        net.p["out0"][:] = 4 if len(labels) and labels[0] else -4
        return net
    aside = np.zeros(len(labels), dtype=bool)
    for label in (0, 1):
        aside[np.flatnonzero(labels == label)[HELD - 1::HELD]] = True
    own_texts, mine = [t for t, out in zip(texts, aside) if not out], labels[~aside]
    words, names = read_words(own_texts), {}
    for text, row in zip(own_texts, words.texts):
        names.update(zip(row.tolist(), [w.strip(MARKS) or w for w in (text or b"").lower().split()]))
    seen, sizes, odds, places = document_counts(words, mine), np.bincount(mine, minlength=2), {}, {}
    for name, counted in seen.items():
        known = np.flatnonzero(counted.sum(axis=0) >= MIN_DOCS)
        known = known[known > 0]
        places[name] = np.zeros(counted.shape[1], dtype=np.int64)
        places[name][known] = np.arange(1, len(known) + 1)
        odds[name] = np.append(0, evidence(counted[:, known], sizes)).astype(np.float32)
    net = Network.start({name: len(x) for name, x in odds.items()}, seed)
    net.words = {names[i]: int(places["word"][i]) for i in np.flatnonzero(places["word"]).tolist()}
    net.places = {name: places[name] for name in ("gram", "head")}
    for name, x in odds.items():
        net.p[name][:, 0] = x
        net.p[name][0] = 0
    words = net.read(own_texts)
    count = np.diff(words.first)
    per_word = odds["word"][words.word] + odds["head"][words.heads].max(axis=1)
    full = np.flatnonzero(count)
    per_word[full] += np.add.reduceat(odds["gram"][words.grams], words.first[:-1][full]) / count[full]
    parts = [windows_of(r) for r in words.texts]
    ids = np.concatenate(parts)
    owner = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
    edges = np.cumsum([0, *(len(x) for x in parts)])
    best = per_word[ids].max(axis=1)
    first, second = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    step = 0
    balance = np.where(mine == 1, 0.5 / mine.sum(), 0.5 / (1 - mine).sum())
    clean = np.flatnonzero(mine[owner] == 0)
    held = np.flatnonzero(aside) if len(np.unique(labels[aside])) == 2 else np.arange(len(labels))
    held_words, kept = net.read([texts[i] for i in held]), None
    rounds = max(rounds, STEPS * STEP_WINDOWS // (2 * len(parts)))
    guided = GUIDED * rounds // ROUNDS
    for turn in range(rounds):
        if turn >= guided and (turn - guided) % 2 == 0:
            gates = net.projected(net.inputs(words))
            best = np.concatenate([net.forward(gates, ids[a:a + CHUNK]) for a in range(0, len(ids), CHUNK)])
        top = np.array([edges[i] + best[edges[i]:edges[i + 1]].argmax() for i in range(len(parts))])
        extra = rng.choice(clean, size=min(len(clean), len(parts)), replace=False)
        chosen = rng.permutation(np.concatenate([top, extra]))
        short = np.zeros(len(ids), dtype=bool)
        short[rng.choice(extra, size=len(extra) // 4, replace=False)] = True
        for a in range(0, len(chosen), STEP_WINDOWS):
            pick = chosen[a:a + STEP_WINDOWS]
            who = owner[pick]
            scale = balance[who]
            # some clean windows are cut to their first words, as texts may be short
            length = np.where(short[pick], rng.integers(1, 9, len(pick)), WINDOW)
            seen_ids = np.where(np.arange(WINDOW) < length[:, None], ids[pick], 0)
            _, grad = net.gradients(words, seen_ids, mine[who].astype(np.float32), (scale / scale.sum()).astype(np.float32))
            step += 1
            rate = 0.01 * min(1.0, 2 * (1 - turn / rounds)) * np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step)
            for k, g in grad.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                change = (rate * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
                net.p[k] -= change * SLOW if k in TABLES else change
            for k in TABLES:
                net.p[k][0] = 0
        if (turn + 1) % max(1, rounds // ROUNDS) == 0:
            scores = np.maximum([x.max() for x in net.logits(held_words)], -1e6)
            wrong, cut = cut_point(scores, labels[held], prior)
            if kept is None or wrong <= kept[0] or labels[held].sum() < FEW:
                kept = wrong, cut, {k: v.copy() for k, v in net.p.items()}
    net.p = kept[2]
    net.p["out0"] -= np.float32(kept[1])
    return net


def cut_point(scores: np.ndarray, labels: np.ndarray, prior: float) -> tuple[float, float]:
    """Least expected error at the given share of label 1, and the middle of the stretch of scores that has it."""
    cost = np.where(labels == 1, prior / max(1, labels.sum()), (1 - prior) / max(1, (1 - labels).sum()))
    order = np.argsort(scores, kind="stable")
    wrong = np.concatenate([[0], np.cumsum(np.where(labels[order] == 1, cost[order], -cost[order]))])
    wrong += cost[labels == 0].sum()
    least = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    low, high = scores[order[max(least[0] - 1, 0)]], scores[order[min(least[-1], len(order) - 1)]]
    return float(wrong.min()), float(low + high) / 2


def _train_task(prior: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, labels = [], []
        for batch in batches:
            texts += as_bytes(batch.column(0))
            labels += batch.column(1).to_pylist()
        net = train_network(texts, np.array(labels, dtype=np.int64), prior)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], ["net"])
        del texts, net
        give_back()
    return run


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          sample_rows: int = SAMPLE_ROWS, text_bytes: int = TEXT_BYTES) -> Network:
    """Fit on about ``sample_rows`` labelled documents, half of them toxic if there are as many.

    They are chosen by a hash of the id, one text of each (ties of ids: that of least hash), none of more than
    ``text_bytes``; so the sample has at most ``sample_rows * text_bytes`` bytes, and one task fits on it. Only the
    network comes to the driver. ``labels`` has one row per id; other rows for the same id must agree.
    """
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("k")).agg(
        F.max(label_col).cast("int").alias("label"))
    sizes = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    rate = lambda label: min(1.0, sample_rows / 2 / max(1, sizes.get(label, 0)))
    turn = F.pmod(F.xxhash64("k", F.lit(5)), F.lit(1 << 20))
    chosen = (known.filter(turn < F.when(F.col("label") == 1, rate(1)).otherwise(rate(0)) * (1 << 20))
              .orderBy(turn, "k").limit(sample_rows + sample_rows // 4))
    total = sum(sizes.values())
    prior = sizes.get(1, 0) / total if total else 0.0
    texts = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).filter(
        F.coalesce(F.octet_length("t"), F.lit(0)) <= text_bytes)
    rows = (texts.join(chosen.hint("broadcast"), "k")  # bounded by sample_rows
            .groupBy("k", "label").agg(F.min(F.struct(F.xxhash64("t").alias("h"), "t")).alias("c"))
            .select("k", F.col("c.t").alias("t"), "label"))
    found = (rows.repartition(1).sortWithinPartitions("k", "t").select("t", "label")
             .mapInArrow(_train_task(prior), "net binary").collect())
    return pickle.loads(found[0]["net"]) if found else train_network([], np.zeros(0, dtype=np.int64), prior)


def _score_task(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net: Network = shared.value
        for batch in slices(batches, size=SLICE_BYTES):
            found = net.logits(net.read(as_bytes(batch.column(1))))
            score = sigmoid(np.array([x.max() for x in found], dtype=np.float64))
            place = [int(x.argmax()) * STRIDE for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array(place, pa.int64())], ["id", "score", "word"])
        give_back()
    return run


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``id_col``, ``score`` from 0 to 1 of its worst window, and ``worst_word``, where that window
    starts (the last window of a text may start earlier).

    Null and blank texts have score 0. Repeated rows each come back. Other columns are not looked
    at. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)
    bound_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(
        _score_task(shared), f"id {sql_type(docs, id_col)}, score double, word bigint").select(
        F.col("id").alias(id_col), "score", F.col("word").alias("worst_word"))


def _filter_task(shared, text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net: Network = shared.value
        for batch in slices(batches, text=text, size=SLICE_BYTES):
            worst = [x.max() for x in net.logits(net.read(as_bytes(batch.column(text))))]
            yield batch.filter(pa.array([bool(sigmoid(float(x)) < 0.5) for x in worst]))
        give_back()
    return run


def filter_clean(docs: DataFrame, net: Network, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that score under one half."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    bound_batches(docs.sparkSession)
    return docs.mapInArrow(_filter_task(shared, docs.columns.index(text_col)), docs.schema)
