"""Language identification by unigram pieces, with all segmentations summed.

Each language has a probability for every piece of a fixed public vocabulary, fitted by expectation maximisation. The
score of a word is the sum over all its segmentations into pieces (forward algorithm), of a text the product over its
words; the posterior over languages gives the prediction. A word is a whole run of letters, however long. Words of a
batch are worked on together in numpy: one column of letters at a time, for all languages at once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyline.llm import textops as T
from tallyline.llm.tables import give_back, of_worker, small_batches, written

#: Letters of a batch of words (a longer word is a batch of its own), and columns after which sums are brought near 1.
LETTERS, RENEW = 1 << 16, 16
#: Scale per letter, equal for all languages, that keeps products of probabilities near 1.
SCALE = 40.0
#: Probability of a single letter that no piece covers, and of each piece beside its counts.
UNKNOWN, EXTRA = 1e-7, 0.02
#: Words whose scores a worker keeps at most; beyond it they are forgotten and worked out anew.
WORDS = 60_000
_LETTERS = regex.compile(r"\p{L}+").findall


def pieces(path: str) -> list[str]:
    """Ordinary pieces of a sentencepiece vocabulary, by id."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    return [p.id_to_piece(i) for i in range(p.vocab_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i))]


def words(text: str | None) -> list[str]:
    """Runs of letters in lower case, each with the mark of a word's start."""
    return ["▁" + w for w in _LETTERS((text or "").lower())]


class Lattice:
    """Which pieces lie in the words of a batch, by place."""

    def __init__(self, vocabulary: list[str]):
        self.size = len(vocabulary)
        self.most = max(map(len, vocabulary))
        key = np.array([self._key(p) for p in vocabulary], np.uint64)
        self.order = np.argsort(key)
        self.key = key[self.order]

    @staticmethod
    def _codes(words: list[str], width: int) -> np.ndarray:
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        n = np.array([len(w) for w in words])
        out = np.zeros((len(words), width), np.uint64)
        out[np.repeat(np.arange(len(words)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
        return out

    def _key(self, piece: str) -> int:
        codes = self._codes([piece], len(piece))
        h = np.ones_like(codes)
        for n in range(1, len(piece) + 1):
            h = self._longer(h, codes, n)
        return int(h[0, 0])

    @staticmethod
    def _longer(h: np.ndarray, codes: np.ndarray, n: int) -> np.ndarray:
        """Hashes of all runs of n letters in each row, from those of n - 1 (ones, if n is 1)."""
        width = codes.shape[1] - n + 1
        return T.mix(h[:, :width] * T.U64(0x9E3779B97F4A7C15) + codes[:, n - 1 : n - 1 + width])

    def arcs(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Lengths of the words, and ids[n - 1, word, start] of the piece of n letters there (size: none)."""
        lengths = np.array([len(w) for w in batch])
        width = int(lengths.max())
        codes = self._codes(batch, width)
        ids = np.full((min(self.most, width), len(batch), width), self.size, np.int32)
        h = np.ones_like(codes)
        for n in range(1, min(self.most, width) + 1):
            w = width - n + 1
            h = self._longer(h, codes, n)
            at = np.minimum(np.searchsorted(self.key, h), self.size - 1)
            hit = (self.key[at] == h) & (np.arange(w) + n <= lengths[:, None])
            ids[n - 1, :, :w][hit] = self.order[at[hit]]
        return lengths, ids


def batches_of(batch: list[str]) -> Iterator[np.ndarray]:
    """Places of words of like length, about LETTERS letters at a time."""
    size = np.array([len(w) for w in batch])
    order = np.argsort(size, kind="stable")
    at = 0
    while at < len(order):
        n = max(1, LETTERS // int(size[order[min(len(order) - 1, at + LETTERS // int(size[order[at]]))]]))
        yield order[at : at + n]
        at += n


def sums(ids: np.ndarray, prob: np.ndarray, backward: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """total[word, place, language] and offset: total * exp(offset) is the summed probability of all segmentations of the
    letters before a place. Backward, ids are of reversed words: ids[n - 1, word, end] is the piece of n letters that begins there
    in reading direction and lies before that place.

    Every RENEW places the last ones are divided by their largest, so that words of any length keep their sums.
    """
    most, n, width = ids.shape
    total = np.zeros((n, width + 1, prob.shape[1]))
    offset = np.zeros_like(total)
    total[:, 0] = 1
    scale = SCALE ** np.arange(most + 1)
    for end in range(1, width + 1):
        new = total[:, end - 1] * (UNKNOWN * SCALE) * (ids[0, :, end - 1] == len(prob) - 1)[:, None]
        for k in range(1, min(most, end) + 1):
            i = ids[k - 1, :, end - k]
            has = np.flatnonzero(i < len(prob) - 1)
            if len(has):
                new[has] += total[has, end - k] * (prob[i[has]] * scale[k])
        total[:, end] = new
        offset[:, end] = offset[:, end - 1]
        if end % RENEW == 0:
            late = slice(max(0, end - most + 1), end + 1)
            by = np.maximum(total[:, late].max(axis=1), 1e-300)
            total[:, late] /= by[:, None]
            offset[:, late] = (offset[:, end] + np.log(by))[:, None]
    return total, offset


def likelihoods(lattice: Lattice, batch: list[str], prob: np.ndarray) -> np.ndarray:
    """Log of the marginal probability of each word in each language (up to a term equal for all languages)."""
    out = np.empty((len(batch), prob.shape[1]))
    for part in batches_of(batch):
        lengths, ids = lattice.arcs([batch[i] for i in part])
        total, offset = sums(ids, prob)
        end = np.arange(len(part)), lengths
        out[part] = np.log(np.maximum(total[end], 1e-300)) + offset[end]
    return out


def fit(lattice: Lattice, counts: dict[str, int], rounds: int = 2) -> np.ndarray:
    """Probability of each piece by expectation maximisation over weighted words."""
    batch = sorted(counts, key=lambda w: (len(w), w))
    p = np.full((lattice.size + 1, 1), 1 / lattice.size)
    for _ in range(rounds):
        p[-1] = 0
        expected = np.full(lattice.size + 1, EXTRA)
        for part in batches_of(batch):
            weight = np.array([counts[batch[i]] for i in part], float)
            lengths, ids = lattice.arcs([batch[i] for i in part])
            ahead, a = (x[..., 0] for x in sums(ids, p))
            # Words reversed, flush with their ends: a piece of k letters from ``start`` is met from the place after it.
            most, n, width = ids.shape
            back = np.full_like(ids, lattice.size)
            for k in range(1, most + 1):
                place = lengths[:, None] - k - np.arange(width)
                inside = place >= 0
                back[k - 1] = np.where(inside, np.take_along_axis(ids[k - 1], np.maximum(place, 0), axis=1), lattice.size)
            behind, b = (x[..., 0] for x in sums(back, p))
            end = np.arange(n), lengths
            whole = np.log(np.maximum(ahead[end], 1e-300)) + a[end]
            for k in range(1, most + 1):
                start = np.arange(width - k + 1)
                rest = lengths[:, None] - k - start
                inside = rest >= 0
                rest = np.maximum(rest, 0)
                i = ids[k - 1][:, start]
                log = a[:, start] + np.take_along_axis(b, rest, axis=1) - whole[:, None]
                share = ahead[:, start] * np.take_along_axis(behind, rest, axis=1) * np.exp(np.where(inside, log, -np.inf)) * p[i, 0] * SCALE**k * weight[:, None]
                expected += np.bincount(i.ravel(), share.ravel(), lattice.size + 1)
        expected[-1] = 0
        p = (expected / expected.sum())[:, None]
    return p[:, 0]


@dataclass
class Model:
    """A fitted identifier: vocabulary file, languages, and probability of each piece in each language."""

    path: str
    langs: list[str]
    prob: np.ndarray

    @property
    def name(self) -> tuple:
        return self.path, tuple(self.langs), hash(self.prob.tobytes())


def lattice_of(path: str) -> Lattice:
    return of_worker("lattice", path, lambda: Lattice(pieces(path)), keep="word scores")


def sample(labelled: DataFrame, documents_each: int) -> DataFrame:
    """lang, text: ``documents_each`` different texts of each language, the first by a hash of the text, or all of a language
    that has fewer. Rows with null lang or text are left out."""
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    h, digest = F.xxhash64("text").alias("h"), F.sha2("text", 256).alias("digest")
    different = written(rows.select("lang", h, digest).distinct())
    # Ranges of hashes are counted first, so that only the texts up to the range that fills the sample are put in order.
    part = F.shiftright("h", 52).cast("int")
    last, full = {}, {}
    for r in sorted(different.groupBy("lang", part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()):
        if full.get(r.lang, 0) < documents_each:
            full[r.lang], last[r.lang] = full.get(r.lang, 0) + r.n, r.part
    if not last:
        return rows.limit(0)
    ends = different.sparkSession.createDataFrame(sorted(last.items()), "lang string, last int")
    order = Window.partitionBy("lang").orderBy("h", "digest")
    early = different.join(F.broadcast(ends), "lang").where(part <= F.col("last"))
    chosen = written(early.withColumn("n", F.row_number().over(order)).where(F.col("n") <= documents_each).select("lang", "h", "digest"))
    some = rows.withColumn("h", h).join(F.broadcast(chosen.select("lang", "h")), ["lang", "h"], "left_semi").withColumn("digest", digest)
    return some.join(F.broadcast(chosen.select("lang", "digest")), ["lang", "digest"], "left_semi").dropDuplicates(["lang", "digest"]).select("lang", "text")


def train(labelled: DataFrame, path: str, documents_each: int = 300) -> Model:
    """Fits on text and lang of ``labelled``: ``documents_each`` different texts of each language (see ``sample``), all
    their words. Copies of a text count once. Rows with null lang or text are left out; a language without letters in its
    sample is not learned. A language's sample is fitted in one task, languages beside each other.
    """

    def learn(key, texts):
        import pandas as pd  # here, so that workers that only identify do not load it

        counts = Counter(w for t in texts["text"] for w in words(t))
        rows = [(key[0], fit(lattice_of(path), counts).astype("<f8").tobytes())] if counts else []
        return pd.DataFrame(rows, columns=["lang", "prob"], dtype=object)

    fitted = written(sample(labelled, documents_each).groupBy("lang").applyInPandas(learn, "lang string, prob binary"))
    rows = sorted((r.lang, bytes(r.prob)) for r in fitted.collect())  # a row of vocabulary size for each language
    none = np.zeros((0, 0))
    return Model(path, [lang for lang, _ in rows], np.stack([np.frombuffer(p, "<f8") for _, p in rows], axis=1) if rows else none)


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """documents with lang_pred and lang_score (the posterior of lang_pred, 0 to 1).

    Only text is read. ``und`` with score 0 where text is null or has no letter, or the model knows no language.
    Equal scores: the language that sorts first. Whole texts count; rows are independent, so repeated rows and other
    columns stay as they are. An empty table gives an empty result.
    """
    small_batches(documents.sparkSession)
    kept = [c for c in documents.columns if c.lower() not in ("lang_pred", "lang_score")]
    docs = documents.select(kept).withColumn("text", F.col("text").cast("string"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", lang_pred string, lang_score double"
    held = documents.sparkSession.sparkContext.broadcast(model)  # vocabulary size x languages: 8 bytes each

    def run(batches):
        m = held.value
        lattice = lattice_of(m.path)
        scores_of = of_worker("word scores", m.name, lambda: {"at": {}, "table": np.zeros((0, len(m.langs)))}, keep="lattice")
        known, table = scores_of["at"], scores_of["table"]
        for b in (whole.slice(a, 512) for whole in batches for a in range(0, whole.num_rows, 512)):
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            langs, scores = [], []
            for a in range(0, len(texts), 256):
                docs = [Counter(words(t)) for t in texts[a : a + 256]]
                if len(known) > WORDS:
                    known.clear()
                    table = table[:0]
                if m.langs and (new := list({w for d in docs for w in d} - known.keys())):
                    known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
                    table = scores_of["table"] = np.concatenate((table, likelihoods(lattice, new, m.prob)))
                for d in docs:
                    if not d or not m.langs:
                        langs.append("und")
                        scores.append(0.0)
                        continue
                    score = np.array(list(d.values()), float) @ table[[known[w] for w in d]]
                    best = int(np.argmax(score))
                    langs.append(m.langs[best])
                    scores.append(float(1 / np.exp(score - score[best]).sum()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names, "lang_pred", "lang_score"])
        give_back()

    return docs.mapInArrow(run, schema)
