"""Language of texts by a linear-chain conditional random field over words.

Each word's score for a language sums learned weights of its affixes and inner n-grams (two to
four bytes, with marks at both ends) and of the word itself (the lexicon), all hashed into one
table; transitions between the languages of neighbouring words are learned along. Training
sequences are spliced from spans of different documents, so that changes of language within a
text are seen. Forward-backward gives each word its probabilities; a text's score for a
language is their mean over its words with letters.

Results by case: null text, or text without a letter, is ``und`` with score 0; of equal means the
language first in order wins; repeated rows get equal results; an empty table gives an empty result;
without a labelled training row everything is ``und``; columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fold

#: Labelled rows that the model learns from, at most: the first by a hash of the id. And how many of their words, in whole spans.
FIT_ROWS, FIT_WORDS = 2000, 600_000
SEQUENCE, EPOCHS, RATE, DECAY = 48, 3, 0.3, 1e-5
HASH_LOG2 = 17
#: Words a task remembers, and padded cells handled at a time.
MEMORY, CELLS = 300_000, 200_000
UNKNOWN = "und"


def core(word: str) -> str:
    """``word`` from its first letter to its last."""
    if word.isalpha():
        return word
    letters = [i for i, c in enumerate(word) if c.isalpha()]
    return word[letters[0] : letters[-1] + 1] if letters else ""


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature slots of all ``words`` in one array, and where each word's begin."""
    raw = [b"\x02" + core(w).encode("utf-8", "surrogatepass") + b"\x03" for w in words]
    size = np.array([len(r) for r in raw])
    flat = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    ends = np.repeat(np.cumsum(size), size)
    owner = np.repeat(np.arange(len(raw)), size)
    slots, owners = [], []
    shift = np.uint64(64 - HASH_LOG2)
    for n in (2, 3, 4):
        value = np.zeros(max(0, len(flat) - n + 1), np.uint64)
        for j in range(n):
            value = value * np.uint64(257) + flat[j : len(flat) - n + 1 + j] + np.uint64(1)
        ok = np.arange(len(value)) + n <= ends[: len(value)]
        slots.append((((value[ok] + np.uint64(n << 40)) * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64))
        owners.append(owner[: len(value)][ok])
    power = (flat + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ** (np.arange(len(flat)) - (ends - np.repeat(size, size)) + 1).astype(np.uint64)
    whole = np.add.reduceat(power, np.cumsum(size) - size) if len(raw) else np.zeros(0, np.uint64)
    slots.append(((whole * np.uint64(0xC2B2AE3D27D4EB4F)) >> shift).astype(np.int64))
    owners.append(np.arange(len(raw)))
    slot, own = np.concatenate(slots), np.concatenate(owners)
    order = np.argsort(own, kind="stable")
    return slot[order], np.searchsorted(own[order], np.arange(len(raw)))


def marginals(emission: np.ndarray, lengths: np.ndarray, transition: np.ndarray, start: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """``(t, probabilities of the tags at t)`` from the last word to the first, for the sequences still that long.

    ``emission``: positive, (words, sequences, tags); ``lengths`` fall, so the long ones come first.
    """
    active = np.searchsorted(-lengths, -np.arange(len(emission)), "left")
    forward = np.empty_like(emission)
    now = start * emission[0]
    forward[0] = now / now.sum(1, keepdims=True)
    for t in range(1, len(emission)):
        n = active[t]
        now = (forward[t - 1, :n] @ transition) * emission[t, :n]
        forward[t, :n] = now / now.sum(1, keepdims=True)
    back = np.ones(emission.shape[1:])
    for t in range(len(emission) - 1, -1, -1):
        if t + 1 < len(emission) and active[t + 1]:
            n = active[t + 1]
            now = (emission[t + 1, :n] * back[:n]) @ transition.T
            back[:n] = now / now.sum(1, keepdims=True)
        both = forward[t, : active[t]] * back[: active[t]]
        yield t, both / both.sum(1, keepdims=True)


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray
    transition: np.ndarray
    start: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        """exp of the words' scores, the best of each word at 1."""
        slot, first = hashes(words)
        score = np.add.reduceat(self.weights[slot], first, axis=0) if len(words) else np.zeros((0, len(self.languages)))
        score[[not any(c.isalpha() for c in w) for w in words]] = 0
        return np.exp(score - score.max(1, keepdims=True)) + 1e-12


class Labeller:
    """Applies a model to batches of texts; remembers the emissions of words met before."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.table = np.zeros((0, len(self.model.languages)))
        self.letters = np.zeros(0, bool)

    def _ids(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.index) > MEMORY:
            self.forget()
        index, out, known = self.index, [], len(self.index)
        for t in texts:
            out.append(np.array([index.setdefault(w, len(index)) for w in words_of(t)], np.int64))
        new = list(index)[known:] if len(index) > known else []
        for i in range(0, len(new), 100_000):
            part = new[i : i + 100_000]
            self.table = np.concatenate([self.table, self.model.emissions(part)])
            self.letters = np.concatenate([self.letters, [any(c.isalpha() for c in w) for w in part]])
        return out

    def means(self, texts: list[str | None]) -> np.ndarray:
        """Mean tag probabilities over the words with letters, a row of zeros where there are none."""
        ids, model = self._ids(texts), self.model
        out = np.zeros((len(texts), len(model.languages)))
        order = sorted((i for i in range(len(ids)) if len(ids[i]) and self.letters[ids[i]].any()), key=lambda i: -len(ids[i]))
        at = 0
        while at < len(order):
            longest = len(ids[order[at]])
            block = order[at : at + max(1, CELLS // longest)]
            at += len(block)
            lengths = np.array([len(ids[i]) for i in block])
            padded = np.zeros((longest, len(block)), np.int64)
            for c, i in enumerate(block):
                padded[: lengths[c], c] = ids[i]
            counted = self.letters[padded]
            total, n = np.zeros((len(block), len(model.languages))), np.zeros(len(block))
            for t, p in marginals(self.table[padded], lengths, model.transition, model.start):
                total[: len(p)] += p * counted[t, : len(p), None]
                n[: len(p)] += counted[t, : len(p)]
            out[block] = total / n[:, None]
        return out

    def words(self, text: str) -> list[tuple[str, str]]:
        """Each word with its most probable language."""
        ids = self._ids([text])[0]
        best = [0] * len(ids)
        if len(ids):
            for t, p in marginals(self.table[ids][:, None], np.array([len(ids)]), self.model.transition, self.model.start):
                best[t] = int(p[0].argmax())
        return [(w, self.model.languages[b]) for w, b in zip(words_of(text), best, strict=True)]


def train(rows: list[tuple[str, str]], seed: int = 7) -> LanguageModel:
    """A model of ``(text, language)`` rows, by stochastic gradient steps on the sequences' likelihood."""
    rng = np.random.default_rng(seed)
    languages = sorted({lang for _, lang in rows})
    tag = {lang: i for i, lang in enumerate(languages)}
    spans: list[tuple[list[str], int]] = []
    for text, lang in rows:
        own, at = words_of(text), 0
        while at < len(own):
            n = int(rng.integers(6, 3 * SEQUENCE // 2))
            spans.append((own[at : at + n], tag[lang]))
            at += n
    rng.shuffle(spans)
    index: dict[str, int] = {}
    ids, tags = [], []
    for span, y in spans:
        ids += [index.setdefault(w, len(index)) for w in span]
        tags += [y] * len(span)
        if len(ids) >= FIT_WORDS:
            break
    pad = -len(ids) % SEQUENCE
    ids, tags = ids + ids[:pad] * (pad <= len(ids)), tags + tags[:pad] * (pad <= len(tags))
    size = len(languages)
    width = SEQUENCE if len(ids) % SEQUENCE == 0 else len(ids)
    x, y = np.array(ids, np.int64).reshape(-1, width), np.array(tags, np.int64).reshape(-1, width)
    slot, first = hashes(list(index))
    last = np.append(first[1:], len(slot))
    model = LanguageModel(languages, np.zeros((1 << HASH_LOG2, size)), np.zeros((size, size)), np.zeros(size))
    grown = [np.full_like(p, 1e-2) for p in (model.weights, model.transition, model.start)]
    for _ in range(EPOCHS):
        for batch in np.array_split(rng.permutation(len(x)), max(1, len(x) // 128)):
            xs, ys = x[batch].T, y[batch].T
            word, back = np.unique(xs, return_inverse=True)
            count = last[word] - first[word]
            where = np.repeat(first[word] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            score = np.add.reduceat(model.weights[slot[where]], np.cumsum(count) - count, axis=0)
            emission = np.exp(score - score.max(1, keepdims=True))[back.reshape(xs.shape)] + 1e-12
            transition, start = np.exp(model.transition), np.exp(model.start)
            p = np.empty_like(emission)
            for t, own in marginals(emission, np.full(len(batch), len(xs)), transition, start):
                p[t] = own
            truth = np.eye(size)[ys]
            # expected transitions: forward messages are recomputed from neighbours of the marginals
            pair = np.zeros((size, size))
            forward = start * emission[0]
            backs = np.ones_like(emission)
            for t in range(len(xs) - 2, -1, -1):
                b = (emission[t + 1] * backs[t + 1]) @ transition.T
                backs[t] = b / b.sum(1, keepdims=True)
            for t in range(1, len(xs)):
                forward = forward / forward.sum(1, keepdims=True)
                joint = forward[:, :, None] * transition * (emission[t] * backs[t])[:, None, :]
                pair += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
                forward = (forward @ transition) * emission[t]
            seen = np.zeros((size, size))
            np.add.at(seen, (ys[:-1].ravel(), ys[1:].ravel()), 1)
            delta = (truth - p).reshape(-1, size)
            by_word = np.stack([np.bincount(back.ravel(), delta[:, k], len(word)) for k in range(size)], 1)
            by_slot = np.stack([np.bincount(slot[where], np.repeat(by_word[:, k], count), 1 << HASH_LOG2) for k in range(size)], 1)
            steps = (by_slot / len(batch) - DECAY * model.weights, (seen - pair) / len(batch) - 1e-2 * model.transition, (truth[0] - p[0]).mean(0) - 1e-2 * model.start)
            for value, total, g in zip((model.weights, model.transition, model.start), grown, steps, strict=True):
                total += g * g
                value += RATE * g / np.sqrt(total)
    return LanguageModel(languages, model.weights, np.exp(model.transition), np.exp(model.start))


def fit_languages(docs: DataFrame, hold: int | None = 2, k: int = 4, fit_rows: int = FIT_ROWS) -> LanguageModel | None:
    """A model from at most ``fit_rows`` labelled rows outside fold ``hold``; ids are chosen before any text is read."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.length("text") > 0))
    rows = rows.where(fold("doc_id", k) != hold) if hold is not None else rows
    # As many rows of each language, so that a language with few is learned as well. A limit on a rank is taken within each
    # task first, so that a language with most of the rows moves no more of them than any other.
    order = [F.xxhash64(F.col("doc_id").cast("string"), F.lit("lang")), F.col("doc_id")]
    languages = max(1, rows.select("lang").distinct().count())
    each, by_lang = max(1, fit_rows // languages), Window.partitionBy("lang")
    chosen = rows.select("lang", "doc_id").distinct().withColumn("rank", F.row_number().over(by_lang.orderBy(*order))).where(F.col("rank") <= each).orderBy("rank", "lang").limit(fit_rows)
    texts = rows.select("lang", "doc_id", "text").join(F.broadcast(chosen.select("lang", "doc_id")), ["lang", "doc_id"], "left_semi")  # fit_rows ids at most
    texts = texts.withColumn("rank", F.row_number().over(by_lang.orderBy(*order, "text"))).where(F.col("rank") <= each)
    taken = [(r["text"], r["lang"]) for r in sorted(texts.collect(), key=lambda r: (r["lang"], r["rank"]))]
    taken = list(dict.fromkeys(x for x in taken if any(c.isalpha() for c in x[0])))
    return train(taken) if taken else None


def predict_languages(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row, from its whole text and nothing else."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value) if shared.value else None
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                texts = part.column(1).to_pylist()
                mean = labeller.means(texts) if labeller else np.zeros((len(texts), 1))
                best = mean.argmax(1)
                score = mean[np.arange(len(texts)), best]
                names = [labeller.model.languages[b] if s > 0 else UNKNOWN for b, s in zip(best, score, strict=True)] if labeller else [UNKNOWN] * len(texts)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(np.minimum(score, 1.0))], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(predicted, "doc_id long, lang_pred string, score double")
