"""Quality classifier from weak labels.

Heuristic labellers vote on every document (1, 0, or no vote). Expectation-maximisation
estimates how accurate each is (ratings, where there are any, are one more labeller, of given
accuracy); each pattern of votes then has a
posterior probability, which serves as the label. A linear scorer over hashed words and
measured rates is fitted to the posteriors of documents with a vote, and scores every document, also those on
which no labeller voted. Two such models run side by side: quality and toxicity.

Votes are counted by pattern (at most 3^labellers rows) over all documents. Each scorer is
fitted on a sample of at most ``SAMPLE`` documents with a vote, half of them of each class,
rated ones first and then those with the least hash of their id, which is the one bounded
sample here; everything else covers all rows.

Defined results: null text has no words, is of low quality and not toxic; a document with
several label rows takes the largest of each label; rows that repeat are scored each on its own;
with no votes, or only one class among them, the scorer returns the prior, which is even where nobody
voted, and what is even is kept; empty tables give empty tables; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrid.llm.common import SubstringHash, chunks, lowered, mix, text_view, word_bounds
from cellgrid.llm.quality_rules import MEASURES, measure_texts
from cellgrid.session import cut_lineage

#: documents each scorer is fitted on, at most
SAMPLE = 20_000
#: how far a rating is trusted; the other labellers' accuracies are estimated
TRUST = 0.999
#: hashed word weights
BUCKETS = 1 << 18
#: words that insult a person; fixed values of this labeller
INSULTS = ("clown", "disgusting", "dumb", "fool", "garbage", "idiot", "imbecile", "jerk", "liar", "loser", "moron",
           "pathetic", "scum", "stupid", "trash", "ugly", "worthless")
#: rates of a text used beside its words
RATES = ("symbols", "bangs", "repeats", "duplicate_lines", "word_length", "shouting", "short", "few",
         "many_symbols", "many_bangs", "many_repeats", "some_repeats")

#: labeller -> vote over the measurements: 1 good or toxic, 0 the opposite, null abstains
QUALITY_VOTES = {
    "symbols": "CASE WHEN 100 * n_symbols > 10 * n_words THEN 0 END",
    "bangs": "CASE WHEN 100 * n_bangs > 30 * n_words THEN 0 END",
    "repeats": "CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 0 END",
    "duplicate_lines": "CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 0 END",
    "length": "CASE WHEN n_words < 4 THEN 0 END",
    "word_length": "CASE WHEN word_chars > 12 * n_words OR word_chars < 2 * n_words THEN 0 END",
    "plain": "CASE WHEN n_words >= 20 AND 100 * n_symbols <= 2 * n_words AND 100 * n_bangs <= 5 * n_words "
             "AND 100 * n_repeat_words <= 20 * n_words THEN 1 END",
    "rated": "quality",
}
TOXIC_VOTES = {
    "any_insult": "CASE WHEN n_insults >= 1 THEN 1 END",
    "several_insults": "CASE WHEN n_insults >= 3 THEN 1 WHEN n_insults = 1 THEN 0 END",
    "insult_rate": "CASE WHEN 100 * n_insults >= n_words AND n_insults > 0 THEN 1 END",
    "rated": "toxic",
}


def _hash_of(word: str) -> int:
    return int(SubstringHash(np.frombuffer(word.encode(), np.uint8)).of(np.array([0]), np.array([len(word.encode())]))[0])


def words_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every word, lower-cased, without marks at its ends."""
    data = lowered(data)
    begins, ends, row = word_bounds(data, offs)
    letter = (data >= 128) | ((data >= 97) & (data <= 122)) | ((data >= 48) & (data <= 57))
    n = len(data)
    here = np.arange(n + 1)
    after = np.append(np.where(letter, here[:n], n), n)
    after = np.minimum.accumulate(after[::-1])[::-1]
    before = np.maximum.accumulate(np.append(0, np.where(letter, here[:n] + 1, 0)))
    a, b = np.minimum(after[begins], ends), np.maximum(before[ends], begins)
    b = np.maximum(a, b)
    return row, SubstringHash(data).of(a, b)


def features(data: np.ndarray, offs: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """(measurements with n_insults, rates by row, row and bucket of the distinct words of each row)."""
    n = len(offs) - 1
    found = measure_texts(data, offs)
    row, key = words_of(data, offs)
    found["n_insults"] = np.bincount(row[np.isin(key, _INSULT_HASHES)], minlength=n)
    words = np.maximum(found["n_words"], 1)
    upper = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    rates = np.stack([
        np.minimum(found["n_symbols"] / words, 1), np.minimum(found["n_bangs"] / words, 1), found["n_repeat_words"] / words,
        found["n_dup_lines"] / np.maximum(found["n_lines"], 1), np.minimum(found["word_chars"] / words / 10, 3),
        (upper[offs[1:]] - upper[offs[:-1]]) / np.maximum(np.diff(offs), 1), found["n_words"] < 50, found["n_words"] < 4,
        found["n_symbols"] > 0.1 * words, found["n_bangs"] > 0.3 * words, found["n_repeat_words"] > 0.5 * words,
        found["n_repeat_words"] > 0.2 * words], axis=1).astype(np.float64)
    bucket = (mix(key) % np.uint64(BUCKETS)).astype(np.int64)
    pair = np.unique(row * np.int64(BUCKETS) + bucket)
    return found, rates, pair // BUCKETS, pair % BUCKETS


_INSULT_HASHES = np.array([_hash_of(w) for w in INSULTS], np.uint64)


def votes(measured: DataFrame, labellers: dict[str, str]) -> Column:
    """One digit per labeller: 0 or 1 as voted, 2 for no vote."""
    return F.concat(*[F.coalesce(F.expr(v).cast("int").cast("string"), F.lit("2")) for v in labellers.values()])


def estimate(patterns: dict[str, int], rounds: int = 500) -> tuple[np.ndarray, float, dict[str, float]]:
    """EM over vote patterns: (chances per labeller, truth and vote; prior of truth 1; posterior of each pattern).

    A labeller's chances of voting 0, 1 or not at all are estimated for each truth, starting
    from its overall share of votes with four in five of them right. The last labeller is the
    ratings: a rated pattern has the posterior ``TRUST``, whatever the others say, which keeps
    labellers that err alike from outvoting the ratings. Ends when no posterior moves by more than 1e-9.
    """
    names = sorted(patterns)
    if not names:
        return np.zeros((0, 2, 3)), 0.5, {}
    table = np.array([[int(c) for c in p] for p in names])
    n = np.array([patterns[p] for p in names], float)
    prior, old = 0.5, np.full(len(names), 0.5)
    chances = np.zeros((table.shape[1], 2, 3))
    for j in range(table.shape[1]):
        silent = (n[table[:, j] == 2].sum() + 1) / (n.sum() + 2)
        right = TRUST if j == table.shape[1] - 1 else 0.8
        chances[j] = [[right * (1 - silent), (1 - right) * (1 - silent), silent],
                      [(1 - right) * (1 - silent), right * (1 - silent), silent]]
    for _ in range(rounds):
        odds = np.full(len(names), np.log(prior / (1 - prior)))
        for j in range(table.shape[1]):
            odds += np.log(chances[j, 1] / chances[j, 0])[table[:, j]]
        posterior = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        rated = table[:, -1] < 2
        posterior[rated] = np.where(table[rated, -1] == 1, TRUST, 1 - TRUST)
        for j in range(table.shape[1] - 1):
            for truth, weight in ((0, 1 - posterior), (1, posterior)):
                share = np.bincount(table[:, j], n * weight, minlength=3) + 1
                chances[j, truth] = share / share.sum()
        prior = float(np.clip(((n * posterior).sum() + 1) / (n.sum() + 2), 1e-6, 1 - 1e-6))
        if np.abs(posterior - old).max() < 1e-9:
            break
        old = posterior
    return chances, prior, dict(zip(names, posterior.tolist(), strict=True))


@dataclass
class Scorer:
    bias: float
    rates: np.ndarray
    words: np.ndarray

    def __call__(self, rates: np.ndarray, row: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        total = self.bias + rates @ self.rates + np.bincount(row, self.words[bucket], minlength=len(rates))
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def fit(rates: np.ndarray, row: np.ndarray, bucket: np.ndarray, target: np.ndarray, prior: float = 0.5) -> Scorer:
    """Logistic regression to soft targets by limited-memory BFGS, each class weighing the same.

    Ends when no slope is above 1e-6, or when no step along the search direction lowers the loss
    any more. Only buckets that occur have weights. Without both classes the scorer is the prior.
    """
    scorer = Scorer(float(np.log(prior / (1 - prior))), np.zeros(rates.shape[1]), np.zeros(BUCKETS))
    if not (target >= 0.5).any() or not (target < 0.5).any():
        return scorer
    mass = np.array([1 - target.mean(), target.mean()])
    weight = (1 - target) / mass[0] + target / mass[1]
    weight /= weight.sum()
    active, bucket = np.unique(bucket, return_inverse=True)
    k = 1 + rates.shape[1]

    def total(x: np.ndarray) -> np.ndarray:
        return x[0] + rates @ x[1:k] + np.bincount(row, x[k:][bucket], minlength=len(rates))

    def loss(x: np.ndarray, z: np.ndarray) -> float:
        return float((weight * (np.logaddexp(0, z) - target * z)).sum()) + 0.5e-5 * float(x[1:] @ x[1:])

    def slope_of(x: np.ndarray, z: np.ndarray) -> np.ndarray:
        slip = weight * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - target)
        slope = np.concatenate([[slip.sum()], rates.T @ slip, np.bincount(bucket, slip[row], minlength=len(active))])
        slope[1:] += 1e-5 * x[1:]
        return slope

    x = np.zeros(k + len(active))
    z = total(x)
    now, slope = loss(x, z), slope_of(x, z)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    while np.abs(slope).max() > 1e-6:
        way, shares = -slope, []
        for s, y, r in reversed(past):
            shares.append(r * (s @ way))
            way = way - shares[-1] * y
        if past:
            s, y, r = past[-1]
            way = way / (r * (y @ y))
        for (s, y, r), share in zip(past, reversed(shares), strict=True):
            way = way + (share - r * (y @ way)) * s
        down = float(slope @ way)
        move, step = total(way), 1.0
        while step > 1e-12 and loss(x + step * way, z + step * move) > now + 1e-4 * step * down:
            step /= 2
        if step <= 1e-12:
            if not past:
                break
            past = []
            continue
        new = x + step * way
        z = z + step * move
        now, turned = loss(new, z), slope_of(new, z)
        s, y = new - x, turned - slope
        if s @ y > 1e-18:
            past = [*past[-9:], (s, y, 1 / float(s @ y))]
        x, slope = new, turned
    scorer.bias, scorer.rates = float(x[0]), x[1:k]
    scorer.words[active] = x[k:]
    return scorer


@dataclass
class Classifier:
    quality: Scorer
    toxic: Scorer
    chances: dict[str, dict[str, list[list[float]]]]


def measured(docs: DataFrame, ratings: DataFrame | None, doc_id: str, text: str) -> DataFrame:
    """_id and measurements of each row, with ``quality`` and ``toxic`` where rated."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "_text"):
            found, _, _, _ = features(*text_view(part.column("_text")))
            yield pa.RecordBatch.from_arrays(
                [part.column("_id"), *(pa.array(found[m].astype(np.int64)) for m in (*MEASURES, "n_insults"))], ["_id", *MEASURES, "n_insults"])

    lean = docs.select(F.col(doc_id).cast("bigint").alias("_id"), F.col(text).alias("_text"))
    out = lean.mapInArrow(run, "_id bigint, " + ", ".join(f"{m} bigint" for m in (*MEASURES, "n_insults")))
    if ratings is None:
        return out.withColumn("quality", F.lit(None).cast("int")).withColumn("toxic", F.lit(None).cast("int"))
    rated = ratings.groupBy(F.col(doc_id).cast("bigint").alias("_id")).agg(
        F.max("quality").cast("int").alias("quality"), F.max("toxic").cast("int").alias("toxic"))
    return out.join(rated, "_id", "left")


def train(docs: DataFrame, ratings: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text",
          sample: int = SAMPLE) -> Classifier:
    """Labeller chances from all documents, scorers from bounded samples of those with a vote."""
    rows = measured(docs, ratings, doc_id, text)
    tagged = cut_lineage(rows.select("_id", votes(rows, QUALITY_VOTES).alias("q"), votes(rows, TOXIC_VOTES).alias("t")))
    counts = {name: {r[0]: r[1] for r in tagged.groupBy(name).count().collect()} for name in ("q", "t")}
    quality, toxic = estimate(counts["q"]), estimate(counts["t"])
    rank = F.pmod(F.xxhash64("_id"), F.lit(1 << 31))
    parts = []
    for name, (_, _, posterior) in (("q", quality), ("t", toxic)):
        for good in (False, True):
            room = sample // 2
            for rated in (True, False):
                mine = [p for p in posterior if set(p) != {"2"} and (posterior[p] >= 0.5) == good and (p[-1] != "2") == rated]
                n = sum(counts[name][p] for p in mine)
                want, room = min(n, room), room - min(n, room)
                if want:
                    # the least hashes, first by a threshold that keeps more than wanted, then exactly
                    share = min(1.0, (1.5 * want + 50) / n)
                    parts.append(tagged.where(F.col("_id").isNotNull() & F.col(name).isin(mine) & (rank < F.lit(int(share * (1 << 31)))))
                                 .dropDuplicates(["_id"]).withColumn("_rank", rank).orderBy("_rank", "_id").limit(want)
                                 .select("_id", *((F.col(x) if x == name else F.lit(None).cast("string")).alias(x) for x in ("q", "t"))))
    chosen = reduce(DataFrame.unionByName, parts, tagged.where(F.lit(False)))
    # at most 2 * sample ids
    chosen = cut_lineage(chosen.groupBy("_id").agg(F.max("q").alias("q"), F.max("t").alias("t")))
    texts = docs.select(F.col(doc_id).cast("bigint").alias("_id"), F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "_text", 2 << 20):
            _, rates, row, bucket = features(*text_view(part.column("_text")))
            ends = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                part.column("q"), part.column("t"), pa.array(list(rates), pa.list_(pa.float64())),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(bucket.astype(np.int32)))], ["q", "t", "rates", "buckets"])

    got = texts.join(F.broadcast(chosen), "_id").select("q", "t", "_text").mapInArrow(
        run, "q string, t string, rates array<double>, buckets array<int>").toArrow()
    lists = got.column("buckets").combine_chunks()
    sizes = np.array([0 if x is None else x for x in pc.list_value_length(lists).to_pylist()], np.int64)
    row, bucket = np.repeat(np.arange(len(sizes)), sizes), lists.flatten().to_numpy().astype(np.int64)
    rates = np.array(got.column("rates").to_pylist(), float).reshape(-1, len(RATES))
    scorers = []
    for name, (_, prior, posterior) in (("q", quality), ("t", toxic)):
        patterns = got.column(name).to_pylist()
        voted = np.array([p is not None for p in patterns], bool)
        place = np.cumsum(voted) - 1
        mine = voted[row]
        target = np.array([posterior[p] for p in patterns if p is not None], float)
        scorers.append(fit(rates[voted], place[row[mine]], bucket[mine], target, prior))
    return Classifier(*scorers, {"quality": dict(zip(QUALITY_VOTES, quality[0].tolist(), strict=False)),
                                 "toxic": dict(zip(TOXIC_VOTES, toxic[0].tolist(), strict=False))})


def classify(spark: SparkSession, docs: DataFrame, model: Classifier, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, quality and toxic (probabilities) and kept (good and not toxic) of every row."""
    kind = docs.schema[doc_id].dataType.simpleString()
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "_text"):
            found, rates, row, bucket = features(*text_view(part.column("_text")))
            empty = found["n_words"] == 0
            quality = np.where(empty, 0.0, shared.value.quality(rates, row, bucket))
            toxic = np.where(empty, 0.0, shared.value.toxic(rates, row, bucket))
            yield pa.RecordBatch.from_arrays([part.column("_doc"), pa.array(quality), pa.array(toxic), pa.array((quality >= 0.5) & (toxic <= 0.5))],
                                             ["_doc", "quality", "toxic", "kept"])

    lean = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_text"))
    return lean.mapInArrow(run, f"_doc {kind}, quality double, toxic double, kept boolean").withColumnRenamed("_doc", doc_id)
