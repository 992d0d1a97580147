"""Document fingerprints by winnowing, with DataFrame functions only.

A text is read as tokens: pieces of up to `piece` characters of its words, in lower case, so that white space and case do not
matter and an edit changes only the tokens of one word. Karp-Rabin hashes of every run of `k` tokens are taken (the values of a rolling
hash; as a column expression has no state to roll, the `k` products are written out), and of every `window` consecutive hashes the smallest is selected, the rightmost of equals. A selected hash keeps its position, packed
as hash << 31 | (2^31 - 1 - position), so that the smallest packed value is the smallest, rightmost hash.

Two texts that share a run of at least `k + window - 1` tokens share a selected hash; hashes of runs shorter than `k` are never
compared. A text of fewer than `k` tokens has one hash, of all its tokens; one without tokens (null, empty, blank) has none.

A text is one row: its tokens, hashes and fingerprint are arrays of one task, about a hundred bytes for each token of a very long text.

Rows that repeat are answered row by row; no rows give none. `winnow` keeps all columns of the input, whatever their names, and replaces one
named as its output; `edited_fingerprints` returns its own columns only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, written

_PRIME, _BASE, _TOP = 2**31 - 1, 1_000_003, 2**31 - 1
#: Rows in a bucket of neighbours, cells of ids, and rows of buckets that are sent to all tasks.
_SPAN, _CELLS, _SENT = 256, 256, 500_000
#: A bucket's number: its cell, its place there (24 bits), then `_LEVELS` finer places of `_FINE` bits; ranges of buckets leave out `_RANGE` bits.
_FINE, _LEVELS, _RANGE = 14, 2, 44
_BUCKET = f"shiftleft(shiftleft(CAST(_cell AS BIGINT), 24) + _sub, {_FINE * _LEVELS})"
_NO_ID = -(2**63)


def winnow(df: DataFrame, text: str, out: str, k: int = 4, window: int = 4, piece: int = 4) -> DataFrame:
    """`df` with `out`: the packed selected hashes (array<long>) in order of position, each once."""
    tokens = f"regexp_extract_all(lower(coalesce(`{text}`, '')), '[^\\\\x20\\\\x09-\\\\x0D]{{1,{piece}}}', 0)"
    h, p = fresh(df, "_h"), fresh(df, "_p")
    df = df.withColumn(h, F.expr(f"transform({tokens}, t -> xxhash64(t) & 1073741823)"))
    # sum of token * base^(k-1-i), modulo a prime; each product is below 2^61, so up to four may be added before reducing
    terms = ["x" if i == 0 else f"get(`{h}`, i + {i})" for i in range(k)]
    total = "0L"
    for i, term in enumerate(terms):
        total = f"{total} + {term} * {pow(_BASE, k - 1 - i, _PRIME)}L"
        if i % 3 == 2 and i < k - 1:
            total = f"({total}) % {_PRIME}L"
    packed = f"transform(`{h}`, (x, i) -> shiftleft(({total}) % {_PRIME}L, 31) + ({_TOP}L - i))"
    whole = f"array(shiftleft(xxhash64(`{h}`) & {_TOP}L, 31) + {_TOP}L)"
    df = df.withColumn(p, F.expr(f"CASE WHEN size(`{h}`) = 0 THEN `{h}` WHEN size(`{h}`) < {k} THEN {whole} ELSE slice({packed}, 1, size(`{h}`) - {k - 1}) END"))
    lowest = f"least({', '.join(['x', *(f'get(`{p}`, i + {i})' for i in range(1, window))])})" if window > 1 else "x"
    mins = f"slice(transform(`{p}`, (x, i) -> {lowest}), 1, greatest(1, size(`{p}`) - {window - 1}))"
    return df.withColumn(out, F.expr(f"array_distinct({mins})")).drop(h, p)


def marks(packed: Column) -> Column:
    """array<struct<hash long, pos int>> of packed values: pos counts the tokens before the run."""
    return F.transform(packed, lambda x: F.struct(F.shiftright(x, 31).alias("hash"), (F.lit(_TOP) - x.bitwiseAND(F.lit(_TOP))).cast("int").alias("pos")))


def hashes(packed: Column) -> Column:
    """The distinct hashes of packed values."""
    return F.array_distinct(F.transform(packed, lambda x: F.shiftright(x, 31)))


def printed(packed: Column) -> Column:
    """The fingerprint as text: eight hexadecimal digits for each selected hash, in order of position."""
    return F.array_join(F.transform(packed, lambda x: F.lpad(F.hex(F.shiftright(x, 31)), 8, "0")), "")


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of two columns of distinct hashes; 1 if both are empty."""
    both, total = f"size(array_intersect(`{a}`, `{b}`))", f"size(`{a}`) + size(`{b}`)"
    return F.expr(f"CASE WHEN {total} = 0 THEN 1D ELSE {both} / CAST({total} - {both} AS DOUBLE) END")


def _before(buckets: DataFrame) -> DataFrame:
    """bucket, before: the bucket before each in a circle, found inside ranges of buckets and then between ranges, of which there is one
    for 16 million rows and one for each cell."""
    b = buckets.withColumn("r", F.shiftright("bucket", _RANGE))
    ends = b.groupBy("r").agg(F.max("bucket").alias("end"))
    ends = ends.select("r", F.coalesce(F.lag("end").over(W.orderBy("r")), F.max("end").over(W.partitionBy())).alias("end"))
    inside = b.withColumn("before", F.lag("bucket").over(W.partitionBy("r").orderBy("bucket")))
    return inside.join(ends, "r").select("bucket", F.coalesce("before", "end").alias("before"))


def _with_buckets(rows: DataFrame) -> tuple[DataFrame, int]:
    """`rows` (_id, _t, ...) with bucket: about `_SPAN` neighbours in the order of _id and _t; and their number.

    Quantiles cut the ids into cells, and counts say into how many equal parts of ids a cell is cut; an id with more than a cell's share of
    the rows is a cell of its own, which is cut by _t. Where ids crowd inside a cell, as those of many shards do, `_finer` cuts again. At most
    about 500 numbers pass through the driver."""
    cuts, least, total = rows.agg(F.percentile_approx("_id", [i / _CELLS for i in range(_CELLS)], 10_000), F.min("_id"), F.count("*")).first()
    cuts = cuts or [0]
    bounds = sorted({least or 0, *cuts, *(c + 1 for i, c in enumerate(cuts[1:]) if c == cuts[i] < 2**63 - 1)})
    cell = f"size(filter(array({', '.join(f'{b}L' if b != _NO_ID else f'({b + 1}L - 1L)' for b in bounds)}), b -> b <= _id)) - 1"
    rows = rows.withColumn("_cell", F.expr(cell))
    found = {r[0]: r for r in rows.groupBy("_cell").agg(F.count("*").alias("n"), F.min("_id").alias("lo"), F.max("_id").alias("hi")).collect()}
    start, width, parts = [], [], []
    for i in range(len(bounds)):
        _, n, lo, hi = found.get(i, (i, 0, 0, 0))
        parts.append(max(1, -(-n // _SPAN)))
        start.append(float(lo))
        width.append(max(1.0, (float(hi) - float(lo)) / parts[-1]) if hi > lo else 0.0)
    doubles = lambda v: f"CAST(split('{','.join(map(repr, v))}', ',') AS array<double>)"
    by_id = f"floor((CAST(_id AS DOUBLE) - get({doubles(start)}, _cell)) / get({doubles(width)}, _cell))"
    by_text = f"floor((CAST(_t AS DOUBLE) / 18446744073709551616D + 0.5D) * get({doubles(parts)}, _cell))"
    if any(w == 0 and n > 1 for w, n in zip(width, parts, strict=True)):
        place = f"CASE WHEN get({doubles(width)}, _cell) > 0 THEN {by_id} ELSE {by_text} END"
    else:  # the texts need not be read to know the buckets
        place = f"CASE WHEN get({doubles(width)}, _cell) > 0 THEN {by_id} ELSE 0L END"
    rows = rows.withColumn("_sub", F.expr(place)).withColumn("bucket", F.expr(_BUCKET)).drop("_cell", "_sub")
    for level in range(1, _LEVELS + 1):
        found = _finer(rows, _FINE * (_LEVELS - level))
        if found is None:
            break
        rows = found
    return rows, total


def _finer(rows: DataFrame, bits: int) -> DataFrame | None:
    """`rows` with the buckets of more than `4 * _SPAN` rows cut into equal parts of the ids in them, those of one id by _t, and rows that are equal
    in both dealt round; None if there are none. Parts are told apart at `bits` of the bucket's number."""
    large = written(rows.groupBy("bucket").agg(F.count("*").alias("_n")).filter(F.col("_n") > 4 * _SPAN), "crowded")
    count = large.count()
    if count == 0:
        return None
    sent = F.broadcast if count <= _SENT else (lambda df: df)
    ends = rows.join(sent(large), "bucket").groupBy("bucket").agg(F.count("*").alias("_n"), *(f(c).alias(c + e) for c in ("_id", "_t") for f, e in ((F.min, "lo"), (F.max, "hi"))))
    ends = written(ends.withColumn("_n", F.expr(f"least({2**_FINE - 1}L, ceil(_n / {_SPAN}))")), "crowded-ends")
    exact = lambda c: f"CAST({c} AS DECIMAL(20, 0))"
    share = lambda c: f"CAST({exact(c)} - {exact(c + 'lo')} AS DOUBLE) / (CAST({exact(c + 'hi')} - {exact(c + 'lo')} AS DOUBLE) + 1D)"
    part = f"CAST(floor(_n * CASE WHEN _idhi > _idlo THEN {share('_id')} ELSE {share('_t')} END) AS BIGINT)"
    if ends.filter("_idhi = _idlo and _thi = _tlo").isEmpty():
        dealt = rows
    else:  # any of equal rows may stand for any other, so it does not matter which of them a bucket gets
        dealt, part = rows.withColumn("_m", F.monotonically_increasing_id()), f"CASE WHEN _idhi = _idlo AND _thi = _tlo THEN _m % _n ELSE {part} END"
    out = dealt.join(sent(ends), "bucket", "left")
    return out.withColumn("bucket", F.expr(f"bucket + coalesce(shiftleft({part}, {bits}), 0L)")).select(*rows.columns)


def beside_next(docs: DataFrame) -> tuple[DataFrame, W]:
    """Rows (bucket, guest, doc_id, text) such that each row that is no guest has its next document in its bucket.

    The first document of each bucket is also a guest of the bucket before it (of the last, for the first). Only these
    copies and one row per bucket are needed beside a single shuffle of the documents.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows, total = _with_buckets(rows.withColumns({"_id": F.coalesce("doc_id", F.lit(_NO_ID)), "_t": F.xxhash64("text")}))
    firsts = rows.groupBy("bucket").agg(F.min(F.struct("_id", "_t")).alias("f"))
    firsts = firsts.join(_before(firsts.select("bucket")), "bucket").select("f._id", "f._t", F.col("before").alias("bucket"))
    wanted = firsts.select("_id", "_t").distinct()
    if total <= _SENT * _SPAN:
        wanted = F.broadcast(wanted)
    guests = rows.drop("bucket").join(wanted, ["_id", "_t"]).groupBy("_id", "_t").agg(F.min("text").alias("text")).join(firsts, ["_id", "_t"])
    guests = guests.select("bucket", F.lit(1).alias("guest"), "_id", "_t", F.lit(None).cast("long").alias("doc_id"), "text")
    own = rows.select("bucket", F.lit(0).alias("guest"), "_id", "_t", "doc_id", "text")
    return own.unionByName(guests), W.partitionBy("bucket").orderBy("guest", "_id", "_t", "text")


def edited_fingerprints(docs: DataFrame, k: int = 4, window: int = 4, piece: int = 4) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last quarter is replaced by the next document's beginning.

    Next is the next larger doc_id, after the last the first; a null id counts as the smallest of all ids, -2^63; rows that repeat an id
    follow each other by a hash of their text, and then by text. A document that is alone is its own next. positions are those of the
    fingerprint's hashes: how many tokens stand before each.
    """
    rows, order = beside_next(docs)
    rows = rows.withColumn("next", F.lead("text").over(order))
    rows = winnow(rows, "text", "mark", k, window, piece)
    rows = rows.withColumn("next_mark", F.lead("mark").over(order)).filter("guest = 0")
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    rows = rows.withColumn("edited", F.expr("concat(substring(text, 1, CAST(n_chars - n_chars div 4 AS INT)), substring(next, 1, CAST(n_chars div 4 AS INT)))"))
    rows = rows.select("doc_id", "n_chars", "edited", "mark", hashes(F.col("mark")).alias("a"), hashes(F.col("next_mark")).alias("c"))
    rows = winnow(rows, "edited", "edited_mark", k, window, piece).withColumn("b", hashes(F.col("edited_mark")))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        printed(F.col("mark")).alias("fingerprint"),
        printed(F.col("edited_mark")).alias("edited_fingerprint"),
        likeness("a", "b").alias("near_edited"),
        likeness("a", "c").alias("near_next"),
        F.size("mark").cast("long").alias("n_marks"),
        marks(F.col("mark"))["pos"].alias("positions"),
    )
