"""Language identification by prediction by partial matching.

Every language has a context tree of variable order over bytes: counts of each byte after
every context of up to ``ORDER`` bytes. A byte is coded in the longest context that has been
seen; with counts c, total n and d distinct followers, a seen byte has probability
c / (n + d), and an unseen one pays the escape d / (n + d) and falls back to the context one
byte shorter, down to a uniform byte (method C, statistics frozen after training). A text's
code length under a language is exact; the shortest one names the language.

Frozen costs make the code length a sum over the text's (ORDER + 1)-grams. The trees are
therefore compiled once into gather tables (trigrams seen -> row, row and next byte ->
costs), which are bounded by the byte alphabet and not by the corpus.

Defined results: null text, or one without a letter, is ``und`` with score 0; rows without
language or text teach nothing; if nothing is learned every text is ``und``; equal code
lengths go to the language first in order; empty tables give empty tables; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrid.llm.common import chunks, id_crc_mod, text_view

#: bytes of context; the tables below are laid out for this order
ORDER = 3
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def grams(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The four bytes ending at each position as one number; a text starts after three zero bytes."""
    n = len(data)
    out = data.astype(np.uint32)
    at = np.arange(n) - np.repeat(offs[:-1], np.diff(offs))
    for back in range(1, ORDER + 1):
        shifted = np.zeros(n, np.uint32)
        shifted[back:] = data[:n - back] if back < n else 0
        shifted[at < back] = 0
        out |= shifted << np.uint32(8 * back)
    return out


def gram_counts(rows: DataFrame) -> DataFrame:
    """(lang, gram, n): how often each gram occurs in texts of each language.

    ``rows`` has _lang and _text. Each task counts its own texts, so what is shuffled is at
    most one row per task, language and gram.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for part in chunks(batches, "_text"):
            data, offs = text_view(part.column("_text"))
            found = grams(data, offs)
            langs = np.array(part.column("_lang").to_pylist(), object)
            names, code = np.unique(langs.astype(str), return_inverse=True)
            of = np.repeat(code, np.diff(offs))
            for i, name in enumerate(names):
                keys, counts = np.unique(found[of == i], return_counts=True)
                old = total.get(name)
                if old is not None:
                    keys, inverse = np.unique(np.concatenate([old[0], keys]), return_inverse=True)
                    counts = np.bincount(inverse, np.concatenate([old[1], counts])).astype(np.int64)
                total[name] = keys, counts
        for name, (keys, counts) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys.astype(np.int64)),
                                              pa.array(counts.astype(np.int64))], ["lang", "gram", "n"])

    return rows.mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Gather tables of the code lengths (bits) of all languages."""

    def __init__(self, langs: list[str], trees: list[tuple[np.ndarray, np.ndarray]]):
        """``trees``: per language the grams seen, ascending, and their counts."""
        self.langs = langs
        alphabet = np.zeros(256, bool)
        alphabet[0] = True
        for keys, _ in trees:
            for back in range(ORDER + 1):
                alphabet[(keys >> (8 * back)) & 255] = True
        # bytes never seen in training share one class
        self.byte_class = np.full(256, int(alphabet.sum()), np.int64)
        self.byte_class[alphabet] = np.arange(int(alphabet.sum()))
        size = self.size = int(alphabet.sum()) + 1
        coded = []
        for keys, counts in trees:
            code = np.zeros(len(keys), np.int64)
            for back in range(ORDER, -1, -1):
                code = code * size + self.byte_class[(keys >> (8 * back)) & 255]
            coded.append((code, counts))
        contexts = np.unique(np.concatenate([np.zeros(0, np.int64), *[c // size for c, _ in coded]]))
        self.context_row = np.full(size**ORDER, -1, np.int32)
        self.context_row[contexts] = np.arange(len(contexts))
        self.short = np.zeros((size**ORDER, len(langs)), np.float32)  # cost of a trigram, for contexts no language has seen
        self.long = np.zeros((len(contexts) * size, len(langs)), np.float32)
        for j, (code, counts) in enumerate(coded):
            cost = np.full(size, 8.0)  # order -1: any of 256 bytes alike
            for order in range(ORDER):
                cost = self._deepen(cost, code % size**(order + 1), counts, size, order)
            self.short[:, j] = cost
            self.long[:, j] = self._top(cost, code, counts, contexts, size)

    @staticmethod
    def _deepen(lower: np.ndarray, code: np.ndarray, counts: np.ndarray, size: int, order: int) -> np.ndarray:
        """Costs of all (context of ``order`` bytes, byte) from those one byte shorter."""
        seen = np.bincount(code, counts, minlength=size**(order + 1)).reshape(-1, size)
        total, kinds = seen.sum(axis=1, keepdims=True), (seen > 0).sum(axis=1, keepdims=True)
        below = np.tile(lower.reshape(-1, size), (seen.shape[0] * size // lower.size, 1))
        with np.errstate(divide="ignore", invalid="ignore"):
            own = -np.log2(seen / (total + kinds))
            escape = -np.log2(kinds / (total + kinds))
        return np.where(seen > 0, own, np.where(total > 0, escape, 0.0) + below).ravel()

    @staticmethod
    def _top(lower: np.ndarray, code: np.ndarray, counts: np.ndarray, contexts: np.ndarray, size: int) -> np.ndarray:
        row = np.searchsorted(contexts, code // size)
        seen = np.bincount(row * size + code % size, counts, minlength=len(contexts) * size).reshape(-1, size)
        total, kinds = seen.sum(axis=1, keepdims=True), (seen > 0).sum(axis=1, keepdims=True)
        below = lower.reshape(-1, size)[contexts % size**(ORDER - 1)]
        with np.errstate(divide="ignore", invalid="ignore"):
            own = -np.log2(seen / (total + kinds))
            escape = -np.log2(kinds / (total + kinds))
        return np.where(seen > 0, own, np.where(total > 0, escape, 0.0) + below).ravel()

    def code_lengths(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Bits of every row of a byte view under every language."""
        n, size = len(offs) - 1, self.size
        out = np.zeros((n, len(self.langs)))
        if not len(data) or not self.langs:
            return out
        found = grams(data, offs)
        cls = self.byte_class
        context = (cls[found >> 24] * size + cls[(found >> 16) & 255]) * size + cls[(found >> 8) & 255]
        byte = cls[found & 255]
        row = self.context_row[context]
        known = row >= 0
        rows = np.flatnonzero(np.diff(offs))
        cost = np.empty(len(data))
        for j in range(len(self.langs)):
            cost[known] = self.long[row[known] * np.int64(size) + byte[known], j]
            cost[~known] = self.short[(context[~known] % size**(ORDER - 1)) * size + byte[~known], j]
            out[rows, j] = np.add.reduceat(cost, offs[:-1][rows])
        return out


def train(docs: DataFrame, learn, text: str = "text", lang: str = "lang") -> Model:
    """Counts over all rows where ``learn`` holds and language and text are there.

    The driver gets one row per language and gram: at most the four-byte sequences that
    occur in text, whatever the number of documents.
    """
    rows = docs.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("_lang"), F.col(text).alias("_text"))
    found = gram_counts(rows).toArrow()
    names = np.array(found.column("lang").to_pylist(), object)
    gram, n = found.column("gram").to_numpy(), found.column("n").to_numpy()
    langs = sorted(set(names.tolist()))
    trees = []
    for name in langs:
        at = np.flatnonzero(names == name)
        at = at[np.argsort(gram[at])]
        trees.append((gram[at], n[at]))
    return Model(langs, trees)


def predict(spark: SparkSession, docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (probability of the language given equal priors, from code lengths per text)."""
    kind = docs.schema[doc_id].dataType.simpleString()
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = shared.value
        for part in chunks(batches, "_text", 2 << 20):
            bits = here.code_lengths(*text_view(part.column("_text")))
            known = np.array([bool(here.langs) and t is not None and _LETTER.search(t) is not None
                              for t in part.column("_text").to_pylist()], bool)
            names, score = [UNKNOWN] * len(known), np.zeros(len(known))
            if here.langs:
                best = bits.argmin(axis=1)
                share = np.exp2(np.clip(bits.min(axis=1, keepdims=True) - bits, -1000, 0)).sum(axis=1)
                score[known] = 1.0 / share[known]
                names = [here.langs[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("_doc"), pa.array(names, pa.string()), pa.array(score)],
                                             ["_doc", "lang_pred", "score"])

    lean = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_text"))
    return lean.mapInArrow(run, f"_doc {kind}, lang_pred string, score double").withColumnRenamed("_doc", doc_id)


def held_out(doc_id: str = "doc_id"):
    return id_crc_mod(doc_id, 4) == 2
