"""Language identification by a bidirectional gated recurrent network over bytes.

The network labels every byte of a text; a document's probabilities are the mean over its bytes. It is trained in numpy
by backpropagation through time on a bounded, seeded sample of labelled documents. Whole texts are labelled in spans of
SPAN bytes, all spans of a batch at once, so the work is in proportion to the bytes whatever a document's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headway.llm.common import pieces

UNDETERMINED = "und"
#: Bytes of a text that the network reads from one start state.
SPAN = 256
#: The bound of the training sample: about so many documents a language, so many pieces of each, of so many characters.
SAMPLE_DOCS, SAMPLE_PIECES, SAMPLE_CHARS = 400, 4, 160
HIDDEN, STEPS, BATCH, TRAIN_SPAN, RATE = 16, 360, 128, 80, 0.015


class Network:
    """Two GRUs over bytes, one from each end, and a softmax over the languages at every byte.

    A gate's input weights are a table with a row per byte. Names: x tables, u recurrent weights (both of the reset gate,
    the update gate and the candidate state), b bias of the candidate's recurrent part; f forward, r reverse.
    """

    def __init__(self, n_labels: int, hidden: int = HIDDEN, seed: int = 0):
        rng, h = np.random.default_rng(seed), hidden
        self.hidden = h
        self.w = {}
        for d in "fr":
            self.w |= {f"x{d}": rng.normal(0, 0.3, (3, 256, h)), f"u{d}": rng.normal(0, 1 / np.sqrt(h), (3, h, h)), f"b{d}": np.zeros(h), f"o{d}": rng.normal(0, 1 / np.sqrt(h), (h, n_labels))}
        self.w["o"] = np.zeros(n_labels)
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def scan(self, data: np.ndarray, active: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States (steps, rows, hidden) of one direction over data (steps, rows). active: rows with a byte at each step; they come first."""
        h, steps = self.hidden, len(data)
        x, u, b = (self.w[k + d] for k in "xub")
        states = np.zeros((steps, data.shape[1], h), np.float32)
        state = np.zeros((data.shape[1], h), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            n = active[t]
            old = state[:n]
            gates = np.take(x, data[t, :n], axis=1)
            rec = old @ u
            rz = gates[:2]
            rz += rec[:2]
            rz *= 0.5
            np.tanh(rz, out=rz)
            rz += 1
            rz *= 0.5
            inner = rec[2]
            inner += b
            new = rz[0] * inner
            new += gates[2]
            np.tanh(new, out=new)
            if keep is not None:
                keep.append((t, old.copy(), rz.copy(), inner.copy(), new.copy()))
            now = old - new
            now *= rz[1]
            now += new
            states[t, :n] = now
            if d == "f":
                state = now
            else:
                state[:n] = now
        return states

    def _softmax(self, forward: np.ndarray, reverse: np.ndarray) -> np.ndarray:
        """(labels, steps, rows)."""
        flat = lambda x: x.reshape(-1, self.hidden).T
        out = self.w["of"].T @ flat(forward)
        out += self.w["or"].T @ flat(reverse)
        out += self.w["o"][:, None]
        out -= out.max(0)
        np.exp(out, out=out)
        out /= out.sum(0)
        return out.reshape(-1, *forward.shape[:2])

    def probabilities(self, data: np.ndarray, active: np.ndarray) -> np.ndarray:
        """(labels, steps, rows)."""
        return self._softmax(self.scan(data, active, "f"), self.scan(data, active, "r"))

    def gradients(self, data: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all bytes, and its gradients by backpropagation through time. Every row has all steps."""
        steps, rows = data.shape
        active, h = np.full(steps, rows), self.hidden
        kept = {"f": [], "r": []}
        states = {d: self.scan(data, active, d, kept[d]) for d in "fr"}
        p = self._softmax(states["f"], states["r"])
        loss = -np.log(p[labels, :, np.arange(rows)] + 1e-9).mean()
        p[labels, :, np.arange(rows)] -= 1
        p /= steps * rows
        g = {k: np.zeros_like(v) for k, v in self.w.items()}
        g["o"] = p.sum((1, 2))
        flat = p.reshape(len(p), -1)
        for d in "fr":
            g["o" + d] = states[d].reshape(-1, h).T @ flat.T
            out_grad, u = (flat.T @ self.w["o" + d].T).reshape(steps, rows, h), self.w["u" + d]
            back = np.zeros((rows, h), np.float32)
            for t, old, rz, inner, new in reversed(kept[d]):
                back = back + out_grad[t]
                r, z = rz
                d_new = back * (1 - z) * (1 - new * new)
                side = np.stack([d_new * inner * r * (1 - r), back * (old - new) * z * (1 - z), d_new * r])
                for k, x in enumerate((side[0], side[1], d_new)):
                    np.add.at(g["x" + d][k], data[t], x)
                g["b" + d] += side[2].sum(0)
                g["u" + d] += old.T @ side
                back = back * z + (side @ u.transpose(0, 2, 1)).sum(0)
        return float(loss), g

    def train(self, texts: list[bytes], labels: np.ndarray, steps: int = STEPS, batch: int = BATCH, span: int = TRAIN_SPAN, rate: float = RATE, seed: int = 0) -> float:
        """Adam over random spans of the texts, as many of each label; returns the last losses' mean."""
        rng = np.random.default_rng(seed)
        groups = [np.flatnonzero(labels == k) for k in range(int(labels.max()) + 1)]
        m, v, losses = ({k: np.zeros_like(w) for k, w in self.w.items()} for _ in range(2)), None, []
        m, v = m
        for step in range(1, steps + 1):
            rows, ys = [], []
            for i in range(batch):
                y = i % len(groups)
                text = texts[rng.choice(groups[y])]
                while len(text) < span:
                    text += b" " + text
                at = int(rng.integers(0, len(text) - span + 1))
                rows.append(np.frombuffer(text[at : at + span], np.uint8))
                ys.append(y)
            loss, g = self.gradients(np.ascontiguousarray(np.stack(rows, 1)), np.array(ys))
            losses.append(loss)
            scale = min(1.0, 1 / (np.sqrt(sum(float((x * x).sum()) for x in g.values())) + 1e-9))
            now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, x in g.items():
                x = x * scale
                m[k] += 0.1 * (x - m[k])
                v[k] += 0.01 * (x * x - v[k])
                self.w[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return float(np.mean(losses[-20:]))

    def pooled(self, texts: list[bytes], rows: int = 1024, span: int = SPAN) -> np.ndarray:
        """(texts, labels): mean over each text's bytes; zeros for an empty text."""
        n_labels = len(self.w["o"])
        out = np.zeros((len(texts), n_labels))
        cuts = [(i, at, min(span, len(x) - at)) for i, x in enumerate(texts) for at in range(0, len(x), span)]
        cuts.sort(key=lambda c: -c[2])
        for k in range(0, len(cuts), rows):
            part = cuts[k : k + rows]
            sizes = np.array([c[2] for c in part])
            data = np.zeros((len(part), sizes[0]), np.uint8)
            for j, (i, at, n) in enumerate(part):
                data[j, :n] = np.frombuffer(texts[i], np.uint8, n, at)
            active = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")
            p = self.probabilities(np.ascontiguousarray(data.T), active)
            mask = np.arange(sizes[0])[:, None] < sizes
            np.add.at(out, [c[0] for c in part], (p * mask).sum(1).T)
        return out / np.maximum(1, np.array([len(x) for x in texts])[:, None])


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 3; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def sample(labelled: DataFrame, per_label: int = SAMPLE_DOCS) -> DataFrame:
    """(lang, piece, at): SAMPLE_PIECES pieces of about per_label documents of each language, or of all where there are fewer. Which ones depends on the ids and texts alone."""
    rows = labelled.filter("lang IS NOT NULL AND text IS NOT NULL AND text <> ''").withColumn("at", F.xxhash64(F.lit(1), "doc_id", F.substring("text", 1, 64)))
    counts = rows.groupBy("lang").count().collect()  # a row a language, as many as the model has outputs
    rate = F.lit(0.0)
    for r in counts:
        rate = F.when(F.col("lang") == r.lang, min(1.0, per_label / r["count"])).otherwise(rate)
    chosen = rows.filter(F.pmod("at", F.lit(1 << 30)) < rate * (1 << 30))
    start = lambda k: F.pmod(F.xxhash64(F.lit(2) + k, "at"), F.greatest(F.lit(1), F.length("text") - SAMPLE_CHARS + 1)).cast("int") + 1
    texts = F.transform(F.sequence(F.lit(0), F.lit(SAMPLE_PIECES - 1)), lambda k: F.col("text").substr(start(k), F.lit(SAMPLE_CHARS)))
    return chosen.select("lang", "at", F.posexplode(texts).alias("k", "piece"))


def fit(labelled: DataFrame, seed: int = 0) -> tuple[list[str], Network] | None:
    """Languages in order, and the network trained on the sample; None if nothing is labelled. `labelled`: doc_id, text, lang."""
    rows = sorted((r.lang, r.at, r.k, r.piece) for r in sample(labelled).collect())
    if not rows:
        return None
    langs = sorted({r[0] for r in rows})
    net = Network(len(langs), seed=seed)
    net.train([r[3].encode() for r in rows], np.array([langs.index(r[0]) for r in rows]), seed=seed)
    return langs, net


def predict(docs: DataFrame, model: tuple[list[str], Network] | None, text: str = "text") -> DataFrame:
    """The rows plus lang_pred and score, the pooled probability.

    Null, empty and letterless texts, and all texts without a model: `und`, score 0. Columns of these names are replaced.
    """
    docs = docs.select(*[c for c in docs.columns if c not in ("lang_pred", "score")])
    if model is None:
        return docs.select("*", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    letters = docs.withColumn("_letters", F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, net = shared.value
        for batch in batches:
            for part in pieces(batch, text, 2 << 20):
                seen = part.column("_letters").to_pylist()
                p = net.pooled([x.encode() if ok else b"" for x, ok in zip(part.column(text).to_pylist(), seen)])
                best = p.argmax(1) if len(p) else np.zeros(0, int)
                names = [langs[k] if ok else UNDETERMINED for k, ok in zip(best, seen)]
                score = [min(1.0, round(float(p[i, k]), 5)) if ok else 0.0 for i, (k, ok) in enumerate(zip(best, seen))]
                rest = part.drop_columns(["_letters"])
                yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(names, pa.string()), pa.array(score, pa.float64())], [*rest.schema.names, "lang_pred", "score"])

    return letters.mapInArrow(run, f"{schema}, lang_pred string, score double")


def identify(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The rows plus held_out (fold 1, never learned from), lang_pred and score; learns from the other folds' labelled rows.

    Null texts and those without a letter are UNDETERMINED with score 0, and so is all if nothing is labelled. Rows that
    repeat, and equal texts, are judged alike; a null doc_id belongs to the fold of an empty text. An empty table gives no
    rows. Columns named as those that are added are replaced.
    """
    model = fit(docs.filter(fold(F.col("doc_id")) != 1).select("doc_id", "text", "lang"), seed)
    return predict(docs.withColumn("held_out", fold(F.col("doc_id")) == 1), model)
