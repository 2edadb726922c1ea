"""Operators on odd rows: nulls, empty and long texts, repeated rows, shared ids, clashing columns, empty tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
import public_tokenizers
import xxhash
from pyspark.sql import functions as F

from cellgrid.llm import (
    byte_bpe,
    class_lm,
    fingerprints,
    language_id,
    line_dedup,
    near_dedup,
    packing,
    quality_classifier,
    quality_rules,
    suffix_dedup,
)

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def key_of(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def test_line_dedup(odd, odd_rows, none):
    held = defaultdict(set)
    for i, t, *_ in odd_rows:
        for line in (t or "").split("\n"):
            if len(key_of(line)) >= 40:
                held[key_of(line)].add(i)
    lost = {k: max(ids, key=lambda x: -1 if x is None else x) for k, ids in held.items() if len(ids) >= 5}
    assert lost
    want = Counter()
    for i, t, *_ in odd_rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key_of(x) not in lost or lost[key_of(x)] == i]
        want[i, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    got = Counter(tuple(r) for r in line_dedup.line_report(odd).collect())
    assert got == want
    out = line_dedup.dedup_lines(odd)
    assert out.columns == odd.columns
    assert Counter((r.doc_id, r.text or "") for r in out.collect()) == Counter((k[0], k[3]) for k in want.elements())
    assert out.where("text is null").count() == odd.where("text is null").count()
    assert line_dedup.line_report(none).count() == 0 == line_dedup.dedup_lines(none).count()


def test_byte_bpe(odd, none):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = byte_bpe.encode(odd, path, pattern)
    back = byte_bpe.decode(coded, path).select("text", "ids", "decoded").collect()
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in back)
    want = Counter((len(r.ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in r.ids)).hexdigest()) for r in back)
    assert Counter((r.n_tokens, r.ids_sha256) for r in byte_bpe.digest(odd, path, pattern).collect()) == want
    assert byte_bpe.digest(none, path, pattern).count() == 0


def test_language_id(spark, odd, none):
    model = language_id.train(odd, ~language_id.held_out())
    got = language_id.predict(spark, odd, model).collect()
    assert len(got) == odd.count() and {r.lang_pred for r in got} <= {"de", "en", "und"}
    assert all(0 <= r.score <= 1 for r in got)
    assert [r.lang_pred for r in got if r.doc_id in (2, 3, 7)] == ["und"] * 3
    empty = language_id.train(none, F.lit(True))
    assert {r.lang_pred for r in language_id.predict(spark, odd, empty).collect()} == {"und"}
    assert language_id.predict(spark, none, model).count() == 0


def test_language_id_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_id.train(docs, ~language_id.held_out())
    both = language_id.predict(spark, docs, model).join(docs, "doc_id").where(language_id.held_out())
    assert both.where("lang_pred = lang").count() / both.count() > 0.95


def test_quality_rules(spark, odd, none):
    rows = quality_rules.ledger(odd).cache()
    assert rows.count() == odd.count()
    kept = quality_rules.keep_documents(odd)
    assert kept.columns == odd.columns
    assert kept.count() == rows.where(~quality_rules.fails(quality_rules.CURRENT)).count() > 0
    found = {r.rule: (r.failed, r.only_this) for r in quality_rules.ablation(rows).collect()}
    bits = [r.fail_bits for r in rows.collect()]
    for i, rule in enumerate(quality_rules.RULES):
        assert found.get(rule, (0, 0)) == (sum(b >> i & 1 for b in bits), sum(b == 1 << i for b in bits))
    assert quality_rules.ledger(none).count() == 0 == quality_rules.keep_documents(none).count()


def removed(texts, span=suffix_dedup.SPAN):
    seen = Counter(t[i:i + span] for t in texts for i in range(len(t) - span + 1))
    out = []
    for t in texts:
        gone = set()
        for i in range(len(t) - span + 1):
            if seen[t[i:i + span]] > 1:
                gone |= set(range(i, i + span))
        spans = sum(1 for g in gone if g - 1 not in gone)
        out.append((len(t), len(gone), spans, bytes(b for i, b in enumerate(t) if i not in gone)))
    return out


def test_suffix_ranges_are_joined_before_occurrences_carry_them(spark):
    r = [(0, 2), (2, 5), (9, 11), (3, 4)]
    rows = [(1, 2, 300, r), (1, 3, 300, []), (2, 2, 300, [(7, 8)])]
    table = spark.createDataFrame(rows, "key bigint, ctx bigint, m int, r array<struct<a:int,b:int>>").coalesce(1)
    got = {(x.key, x.ctx, x.m): [tuple(y) for y in x.r] for x in suffix_dedup._joined_ranges(table).collect()}
    assert got == {(1, 2, 300): [(0, 5), (9, 11)], (1, 3, 300): [], (2, 2, 300): [(7, 8)]}


def test_suffix_dedup_carries_ranges_without_rows_of_their_own(odd):
    plan = suffix_dedup.repeated_ranges(odd)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(r" not in plan


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 1])
def test_suffix_dedup(odd, odd_rows, none, hot, monkeypatch):
    """With ``HOT`` at 1 every shared key goes through all finer levels."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    texts = [(t or "").encode() for _, t, *_ in odd_rows]
    cut = removed(texts)
    want = Counter((r[0], a, b, c, hashlib.sha256(d).hexdigest()) for r, (a, b, c, d) in zip(odd_rows, cut, strict=True))
    assert Counter(tuple(r) for r in suffix_dedup.repeat_report(odd).collect()) == want
    if hot > 1:
        out = suffix_dedup.remove_repeats(odd)
        assert out.columns == odd.columns
        assert Counter((r.doc_id, r.text or "") for r in out.collect()) == Counter(
            (r[0], d.decode("utf-8", "ignore")) for r, (_, _, _, d) in zip(odd_rows, cut, strict=True))
        assert suffix_dedup.repeat_report(none).count() == 0 == suffix_dedup.remove_repeats(none).count()


def shingle_set(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4)) or (Counter([tuple(words)]) if words else Counter())


def similarity(a, b):
    both = set(a) & set(b)
    return sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in set(a) | set(b)) for d in both)


def classes(rows):
    sets = [shingle_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    holders = defaultdict(set)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].add(i)
    for i, j in {(i, j) for h in holders.values() if len(h) < 60 for i in h for j in h if i < j}:
        if top(i) != top(j) and (sets[i] == sets[j] or similarity(sets[i], sets[j]) >= 0.8):
            up[top(j)] = top(i)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[top(i)].append(rows[i][0] or 0)
    return {(-1 if i is None else i, t): min(groups[top(k)]) for k, (i, t) in enumerate(rows)}


def test_near_dedup(odd, odd_rows, none):
    want = classes([r[:2] for r in odd_rows])
    assert len({want[1, odd_rows[0][1]], want[5, odd_rows[0][1]], want[6, odd_rows[8][1]]}) == 1
    got = near_dedup.near_classes(odd).join(odd.select(F.coalesce("doc_id", F.lit(0)).alias("_id"), F.xxhash64("doc_id", "text").alias("_th"), "text").distinct(), ["_id", "_th"])
    for r in got.collect():
        if r.text is not None and WORD.search(r.text):
            assert r._label._id == want[-1 if r._doc is None else r._doc, r.text], r
        else:
            assert (r._label._id, r._label._th) == (r._id, r._th)
    assert near_dedup.near_duplicates(odd).count() == odd.count()
    kept = near_dedup.keep_one(odd)
    assert kept.columns == odd.columns
    assert kept.count() == near_dedup.near_classes(odd).where("_id = _label._id and _th = _label._th").select("_id", "_th").distinct().count()
    assert near_dedup.near_duplicates(none).count() == 0 == near_dedup.keep_one(none).count()


def test_near_dedup_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = classes([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()}
    assert got == {i: c for (i, _), c in want.items()}


def test_near_dedup_of_a_large_group(spark):
    """Copies of one text with many edits each: a link may run over other copies only."""
    import random
    rng = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(300):
        words = list(base)
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    sets = [shingle_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(set(sets[i]) & set(sets[j]))
            if common / (len(sets[i]) + len(sets[j]) - common) >= 0.8:
                a, b = sorted((top(i), top(j)))
                up[b] = a
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == {i: top(i) for i in range(len(rows))}


def test_packing(odd, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.pack_documents(odd, path, capacity=64, ids=True).collect()
    places = defaultdict(list)
    for r in rows:
        assert len(r.ids) == r.length and zlib.crc32(b"".join(x.to_bytes(4, "little") for x in r.ids)) == r.ids_crc32
        assert r.length == 64 or r.ids[-1] == 0
        places[r.sequence_id].append((r.offset, r.length))
    for group in places.values():
        group.sort()
        assert [o for o, _ in group] == [sum(n for _, n in group[:i]) for i in range(len(group))]
        assert sum(n for _, n in group) <= 64
    volume = sum(r.length for r in rows)
    assert len(places) <= 1.05 * volume / 64 + 1
    assert {r.piece for r in rows if r.doc_id in (2, 3)} == {0} and {r.length for r in rows if r.doc_id in (2, 3)} == {1}
    assert packing.pack_documents(none, path).count() == 0


def test_fingerprints(odd, odd_rows, none):
    distinct = {(i, t) for i, t, *_ in odd_rows}
    got = fingerprints.edited_fingerprints(odd)
    names = {r.doc_id: r for r in got.collect()}
    assert got.count() == odd.count()
    for i, follower in ((25, 24), (24, 23), (22, 21), (12, 11), (14, 13)):
        texts = dict((a, b or "") for a, b in distinct)
        text, after = texts[i], texts[follower]
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        assert names[i].n_chars == len(text) and names[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= names[i].near_next <= 1 and 0 <= names[i].near_edited <= 1
    assert names[1].fingerprint == names[5].fingerprint and names[1].fingerprint != names[6].fingerprint
    assert fingerprints.edited_fingerprints(none).count() == 0


def test_fingerprints_add_up(spark):
    rows = [(1, "one two\nthree four"), (2, "three four\none two"), (3, "one two"), (4, "three four"), (5, "")]
    prints = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert prints[1] == prints[2]
    one = spark.createDataFrame([(prints[1], prints[3], prints[4], prints[5])], "w string, a string, b string, z string")
    r = one.select(fingerprints.insert(F.col("a"), F.col("b")).alias("sum"), fingerprints.remove(F.col("w"), F.col("b")).alias("rest"),
                   fingerprints.remove(F.col("a"), F.col("a")).alias("nothing"), fingerprints.likeness(F.col("w"), F.col("w")).alias("same")).first()
    assert (r.sum, r.rest, r.nothing, r.same) == (prints[1], prints[3], prints[5], 1.0)


def test_class_lm(spark, odd, odd_rows, none):
    import math
    texts = odd.where(~class_lm.held_out()).select(F.col("text").alias("_text"))
    model, counts = class_lm.train(texts)
    train = Counter()
    for i, t, *_ in odd_rows:
        if zlib.crc32(str(i if i is not None else "").encode()) % 7 != 2:
            train.update(WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")))
            train[None] += 1
    n, v = sum(train.values()), len(train)
    assert (model.tokens, model.distinct) == (n, v)
    want = Counter()
    for i, t, *_ in odd_rows:
        tokens = [*WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")), None]
        want[i, len(tokens), sum(train[x] > 0 for x in tokens),
             round(sum(math.log10((train[x] + 1) / (n + v + 1)) for x in tokens), 6)] += 1
    got = class_lm.score(spark, odd, model, counts).collect()
    assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    nothing, no_counts = class_lm.train(none.select(F.col("text").alias("_text")))
    assert {r.base_score for r in class_lm.score(spark, odd, nothing, no_counts).collect()} == {0.0}
    assert class_lm.score(spark, none, model, counts).count() == 0


def test_class_lm_beats_the_base_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model, counts = class_lm.train(docs.where(~class_lm.held_out()).select(F.col("text").alias("_text")))
    r = class_lm.score(spark, docs, model, counts).where(class_lm.held_out()).agg(F.sum("base_score"), F.sum("score")).first()
    assert r[1] > r[0]


def test_quality_classifier(spark, odd, none):
    ratings = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (4, 0, None), (None, 1, 1), (10, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality_classifier.train(odd, ratings)
    got = quality_classifier.classify(spark, odd, model).collect()
    assert len(got) == odd.count()
    assert all(not r.kept and r.quality == 0 for r in got if r.doc_id in (2, 3, 7))
    assert quality_classifier.classify(spark, none, quality_classifier.train(none)).count() == 0


def test_quality_classifier_on_held_out_ratings(spark):
    sf = "/root/testdata/sf0.01"
    docs, ratings = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    apart = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    model = quality_classifier.train(docs, ratings.where(~apart))
    scored = quality_classifier.classify(spark, docs, model).withColumnRenamed("quality", "q").withColumnRenamed("toxic", "t")
    got = scored.join(ratings.where(apart), "doc_id").collect()
    assert sum((r.q >= 0.5) == (r.quality == 1) for r in got) / len(got) > 0.95
    assert sum(r.t >= 0.5 and r.toxic == 0 for r in got) <= 0.02 * len(got)
    assert sum(r.t >= 0.5 and r.toxic == 1 for r in got) >= 0.25 * sum(r.toxic == 1 for r in got)


def test_class_lm_clusters_every_frequent_word(spark, monkeypatch):
    """Words with ``LEAST`` occurrences have classes however small their share, whether broadcast, joined or cut into blocks."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = docs.where(~class_lm.held_out()).select(F.col("text").alias("_text"))
    seen = Counter(w for r in texts.collect() for w in WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in r._text or "")))
    frequent = sum(n >= 20 for n in seen.values())

    def scores():
        model, counts = class_lm.train(texts)
        assert model.lexicon.types == 1 + class_lm.SHAPES + frequent == len(model.classes)
        assert counts.where("type is not null").count() == frequent
        return model, {r.doc_id: r.score for r in class_lm.score(spark, docs, model, counts).collect()}

    _, want = scores()
    monkeypatch.setattr(class_lm, "LISTED", 0)
    monkeypatch.setattr(class_lm, "SENT", 2e-3)
    monkeypatch.setattr(class_lm, "BLOCK", 64)
    model, got = scores()
    assert model.lexicon.partial
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_class_lm_exchange_runs_until_nothing_is_gained(spark):
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("text").alias("_text"))
    model, counts = class_lm.train(texts)
    seen = class_lm.exchange(class_lm.bigram_counts(texts, model.lexicon, counts), model.lexicon.types)[2]
    assert seen[-1 - class_lm.PATIENCE] == max(seen) and len(seen) > class_lm.PATIENCE


def test_quality_classifier_keeps_clean_texts_without_votes(spark):
    docs = spark.createDataFrame([(i, "Kind words stand here, number " + str(i)) for i in range(40)], "doc_id long, text string")
    ratings = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality_classifier.classify(spark, docs, quality_classifier.train(docs, ratings)).collect()
    assert all(r.kept for r in got)


def test_quality_classifier_fits_on_rated_rows_of_both_classes(spark):
    """Few rated rows among many documents all enter the bounded sample, though most documents come first by hash."""
    rows = [(i, f"plain text about w{i % 7}") for i in range(2000)]
    rows += [(5000 + i, f"grumble w{i % 7}" if i % 2 else f"sunshine w{i % 7}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ratings = spark.createDataFrame([(5000 + i, 1 - i % 2, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    model = quality_classifier.train(docs, ratings, sample=40)
    got = {r.doc_id: r for r in quality_classifier.classify(spark, docs, model).collect()}
    assert all((got[5000 + i].toxic >= 0.5) == (i % 2 == 1) for i in range(40))
    assert all((got[5000 + i].quality >= 0.5) == (i % 2 == 0) for i in range(40))


def test_quality_classifier_finds_toxic_texts(spark):
    sf = "/root/testdata/sf0.1"
    docs, ratings = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    apart = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    model = quality_classifier.train(docs, ratings.where(~apart))
    scored = quality_classifier.classify(spark, docs, model).withColumnRenamed("quality", "q").withColumnRenamed("toxic", "t")
    got = scored.join(ratings.where(apart), "doc_id").collect()
    assert sum(r.t >= 0.5 and r.toxic == 1 for r in got) >= 0.6 * sum(r.toxic == 1 for r in got)
    assert sum(r.t >= 0.5 and r.toxic == 0 for r in got) <= 0.02 * len(got)


def test_likeness_of_texts_with_very_many_pieces(spark):
    """More than 2^16 equal pieces, and more than 2^17 different ones: lanes are still sums."""
    rows = [(6, "same\n" * 70_000), (5, "same\n" * 35_000 + "other\n" * 35_000),
            (4, "\n".join(f"a{i}" for i in range(140_000))), (3, "\n".join(f"b{i}" for i in range(140_000))),
            (2, "\n".join(f"b{i}" for i in range(126_000))), (1, "same\n" * 70_001)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    near = {r.doc_id: r.near_next for r in fingerprints.edited_fingerprints(docs).collect()}
    assert 0.3 < near[6] < 0.95 and near[4] < 0.5 and near[3] > 0.75 and near[2] < 0.6
    prints = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(docs).collect()}
    one = spark.createDataFrame([(prints[6], prints[1], prints[3], prints[4])], "a string, b string, c string, d string")
    r = one.select(fingerprints.likeness(F.col("a"), F.col("b")).alias("alike"), fingerprints.likeness(F.col("c"), F.col("d")).alias("apart")).first()
    assert 0.99 < r.alike < 1 and r.apart < 0.5


def plain_fingerprint(text):
    """(piece count, piece lanes, paragraph lanes) by loops."""
    mask, seed = 2**32 - 1, xxhash.xxh64_intdigest((1).to_bytes(4, "little"), 42)
    n, lanes, whole = 0, [0] * fingerprints.LANES, [0] * fingerprints.WHOLE
    for line in text.split("\n") if text else []:
        digest = hashlib.sha256(line.encode()).hexdigest()
        whole = [(w + x) & mask for w, x in zip(whole, [1] + [int(digest[i:i + 8], 16) for i in range(0, 64, 8)])]
        words = [m.group() for m in re.finditer(fingerprints.PIECE, line)]
        for piece in words:
            a, b = (xxhash.xxh64_intdigest(piece.encode(), x) for x in (42, seed))
            bits = [h >> i & 1 for low in (0, 32) for h in (a, b) for i in range(low, low + 32)]
            n, lanes = n + 1, [(x + y) & mask for x, y in zip(lanes, bits)]
    return n, lanes, whole


def plain_likeness(a, b):
    if a[:2] == b[:2]:
        return 1.0
    signs = [[2 * x - n for x in lanes] for n, lanes, _ in (a, b)]
    dots = [sum(x * y for x, y in zip(signs[i], signs[j])) for i, j in ((0, 0), (1, 1), (0, 1))]
    return min(1.0, max(0.0, dots[2] / max(dots[:2]))) if max(dots[:2]) else 0.0


def test_fingerprints_against_brute_force(spark):
    """All seven columns, over texts with nulls, blank and repeated lines, and wide characters."""
    half, other, long = "a b c d e f g h", "i j k l m n o p", " ".join(f"w{i * i % 97}" for i in range(300))
    texts = [f"{half} {other}", f"{other}\n{half}", f"{half}\n\n{other}", f"{half}\n{other}", None, "", "\n", "é" * 50 + "\n\u4e2d\u6587 \U0001f600",
             "same\nsame\nother", "same\nother", "  spaced \t line \r", long.replace("3 w", "3\nw"), long]
    rows = list(enumerate(texts, 1))
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    shown = lambda f: "".join(f"{x:08x}" for x in (f[0], *f[1], *f[2]))
    assert len(got) == len(rows)
    for i, text in rows:
        text, after = text or "", texts[i - 2] or ""
        edited = text[:len(text) - len(text) // 2] + after[:len(text) // 2]
        own, edit, follower = (plain_fingerprint(x) for x in (text, edited, after))
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (shown(own), shown(edit))
        assert (r.near_edited, r.near_next) == (plain_likeness(own, edit), plain_likeness(own, follower))
    assert len({got[i].fingerprint for i in (1, 2, 3)}) == 3 and got[2].fingerprint == got[4].fingerprint
    assert len({r.fingerprint for r in got.values()}) == len(texts) - 2  # null and empty agree, and so do the swapped lines
