"""Document fingerprints: a homomorphic multiset hash over paragraphs.

A paragraph is a line, taken whole; an empty text has none. Its vector is its 256-bit hash
as eight lanes of 32 bits, and a one that counts it. A document's paragraph lanes are the
lane-wise sums over its paragraphs modulo 2^32, so documents share them when their
paragraphs are the same multiset, in whatever order.

For likeness the fingerprint also sums finer vectors: a paragraph's pieces of up to eight
words (so that an edit inside a long paragraph moves only its piece), 128 lanes each, 0 or 1
by the bits of two 64-bit hashes, modulo 2^32. Read as signs, these lanes are an unbiased
sketch of the overlap of two multisets of pieces.

A fingerprint is, in hex, the number of pieces, the piece lanes, the number of paragraphs and
the paragraph lanes. All of it is a sum over paragraphs: one is inserted or deleted by adding
or subtracting its vector (``insert`` and ``remove``).

All on DataFrame functions: pieces and paragraphs are exploded and summed by one partial
aggregation that leaves one row per document.

Defined results: null text is empty and has the zero fingerprint; rows equal in id and text
are one document in the order of ids, returned once per row; an id that is null comes last;
ties of ids are ordered by a hash of the text; an empty table gives an empty table; a text of
any length is one row until it is exploded, and its lanes are true sums below 2^32 parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellgrid.llm.common import keyed
from cellgrid.session import cut_lineage

#: words to a piece; pieces never cross a line
PIECE = r"[^\x20\x09-\x0D]+(?:[\x20\x09\x0B-\x0D]+[^\x20\x09-\x0D]+){0,7}"
#: two lanes to a bigint, 32 bits apart, so a sum of up to 2^32 pieces cannot run over
_PAIR = 0x0000000100000001
_HALVES = 32
_LANE = 0xFFFFFFFF
LANES = 4 * _HALVES
#: paragraph count and the eight lanes of a 256-bit hash
WHOLE = 9


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))


def _sums(rows: DataFrame, keys: list[str], text: str, along: tuple[str, ...] = ()) -> DataFrame:
    """Per key: piece count ``_n``, piece lanes ``_lanes`` (two to a bigint, as summed; ``_apart`` takes them apart), paragraph lanes ``_whole``.

    ``along`` names columns that depend on the key and are handed on.
    """
    held = [*keys, *along]
    lines = F.split(F.col(text), "\n")
    each = rows.select(*held, (F.col(text) != "").alias("_some"), F.posexplode(F.array(pieces(F.col(text)), lines)).alias("_kind", "_all"))
    each = each.select(*held, "_some", "_kind", F.explode("_all").alias("_p"))
    piece, line = F.col("_kind") == 0, (F.col("_kind") == 1) & F.col("_some")
    each = each.select(*held, piece.cast("long").alias("_is"), line.cast("long").alias("_line"),
                       F.when(piece, F.xxhash64("_p")).otherwise(F.lit(0)).alias("_a"),
                       F.when(piece, F.xxhash64(F.lit(1), "_p")).otherwise(F.lit(0)).alias("_b"),
                       F.when(line, F.sha2("_p", 256)).alias("_sha_p"))
    digits = [F.conv(F.substring("_sha_p", 8 * i + 1, 8), 16, 10).cast("long") for i in range(WHOLE - 1)]
    sums = each.groupBy(*keys).agg(F.sum("_is").alias("_n"), *[F.first(c).alias(c) for c in along], *[
        F.sum(F.shiftright(F.col(h), i).bitwiseAND(F.lit(_PAIR))).alias(f"{h}{i}") for h in ("_a", "_b") for i in range(_HALVES)],
        F.sum("_line").alias("_w0"), *[F.coalesce(F.sum(d), F.lit(0)).alias(f"_w{i + 1}") for i, d in enumerate(digits)])
    cells = [F.col(f"{h}{i}") for h in ("_a", "_b") for i in range(_HALVES)]
    whole = F.unhex(F.concat(*[_digits(F.col(f"_w{i}")) for i in range(WHOLE)]))
    return sums.select(*keys, *along, "_n", F.array(*cells).alias("_lanes"), whole.alias("_whole"))


def _digits(x: Column) -> Column:
    """8 hex digits of ``x`` modulo 2^32."""
    return F.lpad(F.hex(x.bitwiseAND(F.lit(_LANE))), 8, "0")


def _apart(cells: Column) -> Column:
    """Lane values modulo 2^32, low halves before high halves."""
    return F.concat(F.transform(cells, lambda c: c.bitwiseAND(F.lit(_LANE))),
                    F.transform(cells, lambda c: F.shiftrightunsigned(c, 32)))


def _text_form(n: Column, lanes: Column, whole: Column) -> Column:
    """8 hex digits of the piece count, 8 for each piece lane, then the paragraph lanes' bytes."""
    return F.lower(F.concat(_digits(n), F.array_join(F.transform(lanes, lambda x: F.lpad(F.hex(x), 8, "0")), ""), F.hex(whole)))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``fingerprint``: one row per distinct (id, text)."""
    rows = keyed(docs, doc_id, text).dropDuplicates(["_id", "_th"])
    sums = _sums(rows, ["_id", "_th", "_doc"], "_text")
    return sums.select(F.col("_doc").alias(doc_id), _text_form(F.col("_n"), _apart(F.col("_lanes")), F.col("_whole")).alias("fingerprint"))


def _numbers(fp: Column, first: int = 1, size: int = LANES) -> Column:
    return F.transform(F.sequence(F.lit(first), F.lit(first + size - 1)),
                       lambda i: F.conv(F.substring(fp, i * 8 + 1, F.lit(8)), 16, 10).cast("long"))


def _count(fp: Column) -> Column:
    return F.conv(F.substring(fp, 1, 8), 16, 10).cast("long")


def _combined(fp: Column, part: Column, sign: int) -> Column:
    """All numbers of two fingerprints added, ``sign`` times the second, modulo 2^32."""
    size = 1 + LANES + WHOLE
    return F.lower(F.array_join(F.transform(F.zip_with(
        _numbers(fp, 0, size), _numbers(part, 0, size), lambda a, b: a + sign * b), _digits), ""))


def insert(fp: Column, part: Column) -> Column:
    """Fingerprint of the document with the paragraphs of ``part`` added."""
    return _combined(fp, part, 1)


def remove(fp: Column, part: Column) -> Column:
    """Fingerprint of the document with the paragraphs of ``part`` taken out."""
    return _combined(fp, part, -1)


def _signs(lanes: Column, n: Column) -> Column:
    return F.transform(lanes, lambda x: (2 * x - n).cast("double"))


def likeness_of(lanes_a: Column, n_a: Column, lanes_b: Column, n_b: Column) -> Column:
    """Estimated share of common pieces, 0 to 1; 1 when piece count and piece lanes agree.

    The mean product of two signed lanes estimates the inner product of the piece counts;
    dividing by the larger squared norm bounds it. Lanes are true sums up to 2^32 pieces,
    more than a text can hold.
    """
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    a, b = _signs(lanes_a, n_a), _signs(lanes_b, n_b)
    top = F.greatest(dot(a, a), dot(b, b))
    share = F.when(top > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / top))).otherwise(F.lit(0.0))
    return F.when((n_a == n_b) & (lanes_a == lanes_b), F.lit(1.0)).otherwise(share)


def likeness(fp_a: Column, fp_b: Column) -> Column:
    return likeness_of(_numbers(fp_a), _count(fp_a), _numbers(fp_b), _count(fp_b))


def next_in_order(ids: DataFrame) -> DataFrame:
    """``ids`` with _next_id, _next_th: the following row by descending _doc; the last is followed by the first.

    ``ids`` holds one row per (_id, _th), without texts. It is range-partitioned and written
    once, so that part numbers are fixed; the lead runs inside a part, and a part's last row
    takes the first row of the next part that has rows (one row per part meets in one task).
    """
    order = [F.col("_doc").desc_nulls_last(), F.col("_th")]
    dealt = cut_lineage(ids.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    rank = F.struct(F.col("_doc").isNull(), F.bitwise_not(F.coalesce("_doc", F.lit(0))), F.col("_th"))
    firsts = dealt.groupBy("_part").agg(F.min(F.struct(rank, F.col("_id"), F.col("_th"))).alias("_first"))
    one = Window.orderBy("_part")
    whole = one.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = firsts.select("_part", F.coalesce(F.lead("_first").over(one), F.first("_first").over(whole)).alias("_after"))
    inside = Window.partitionBy("_part").orderBy(*order)
    led = dealt.withColumn("_next", F.lead(F.struct("_id", "_th")).over(inside))
    return led.join(following, "_part").select(
        *ids.columns, F.coalesce("_next._id", "_after._id").alias("_next_id"),
        F.coalesce("_next._th", "_after._th").alias("_next_th"))


def edited_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form, and their likenesses, one row per row of ``docs``.

    The edited text is the text with its last floor(n/2) code points replaced by the first
    as many of the next document. Columns: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next. Whole texts are shuffled once, by identity;
    both readers of that shuffle (the senders of heads and their receivers) share it.
    """
    key = ["_id", "_th"]
    rows = keyed(docs, doc_id, text)
    chain = cut_lineage(next_in_order(
        rows.groupBy(*key, "_doc", F.char_length("_text").alias("_chars")).agg(F.count(F.lit(1)).alias("_copies"))))
    texts = rows.groupBy(*key).agg(F.first("_text").alias("_text"))
    half = F.floor(F.col("_chars") / 2).cast("int")
    wanted = chain.select(F.col("_next_id").alias("_id"), F.col("_next_th").alias("_th"),
                          F.col("_id").alias("_to_id"), F.col("_th").alias("_to_th"), half.alias("_take"))
    heads = texts.join(wanted, key).select(
        F.col("_to_id").alias("_id"), F.col("_to_th").alias("_th"), F.expr("substring(_text, 1, _take)").alias("_head"))
    along = ("_doc", "_chars", "_copies", "_next_id", "_next_th")
    both = texts.join(chain, key).join(heads, key).select(
        *key, *along, "_text", F.concat(F.substring("_text", F.lit(1), F.col("_chars") - half), F.col("_head")).alias("_edited"))
    forms = both.select(*key, *along, F.sha2("_edited", 256).alias("_sha"), F.explode(F.array(
        F.struct(F.lit(0).alias("_form"), F.col("_text")), F.struct(F.lit(1).alias("_form"), F.col("_edited").alias("_text")))).alias("_f"))
    sums = _sums(forms.select(*key, *along, "_sha", "_f.*"), [*key, "_sha", "_form"], "_text", along)

    def of(form: int) -> Column:
        return F.max(F.when(F.col("_form") == form, F.struct("_n", "_lanes", "_whole")))

    marks = cut_lineage(sums.groupBy(*key, "_sha").agg(
        *[F.first(c).alias(c) for c in along], of(0).alias("_own"), of(1).alias("_edit")))
    after = marks.select(F.col("_id").alias("_next_id"), F.col("_th").alias("_next_th"), F.struct("_own._n", "_own._lanes").alias("_after"))
    out = marks.join(after, ["_next_id", "_next_th"])

    def like(a: str, b: str) -> Column:
        return likeness_of(_apart(F.col(f"{a}._lanes")), F.col(f"{a}._n"), _apart(F.col(f"{b}._lanes")), F.col(f"{b}._n"))

    shown = out.select(
        F.col("_doc").alias(doc_id), F.col("_chars").cast("long").alias("n_chars"), F.col("_sha").alias("edited_sha256"),
        _text_form(F.col("_own._n"), _apart(F.col("_own._lanes")), F.col("_own._whole")).alias("fingerprint"),
        _text_form(F.col("_edit._n"), _apart(F.col("_edit._lanes")), F.col("_edit._whole")).alias("edited_fingerprint"),
        like("_own", "_edit").alias("near_edited"), like("_own", "_after").alias("near_next"), "_copies")
    return shown.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).drop("_copy", "_copies")
