"""Line deduplication by a segment-partition edit join, in DataFrame functions only.

A line is removed if an earlier line, of the same document or another, is within
``max_edits`` edits of it (0 edits: an equal line). Earlier means a smaller doc_id, then a
smaller line number. Lines below ``least_chars`` characters (white space at the ends not
counted) are too short for the edit join; they are removed only as repeats of equal lines, and
only from ``least_equal`` characters on (None: ``least_chars``), blank ones never.

Equal lines collapse to their first occurrence: the texts of lines are shuffled here and lie in
buckets from then on. Distinct lines are cut into ``max_edits + 1`` segments; of two lines
within the bound, one segment of the shorter stands unchanged in the longer, shifted by no more
than the edits before and after it allow. So each line is indexed under its segments and probes
the few substrings that lengths up to ``max_edits`` smaller admit; index and probes meet in an
equi-join of key and line number (both 48 bits of hash: what meets by chance is verified like
the rest). Under a key of more than ``COMMON`` lines, pairs are also held to a bound on letter pairs
before the join makes a row: ``k`` edits change at most ``4 * k`` of a line's letter pairs, so they
flip at most as many bits of their parities. Such a key's probes are dealt into blocks of lines; its
pairs are all compared, but only those within the bound leave the join. Only the lines of pairs that
are left get their texts again. Pairs are verified with bit-parallel
edit distance inside a diagonal band of ``2 * max_edits + 1`` bits, between the lines' common ends;
where much lies between them, its start is held to twice the edits first.

Defined results: null and empty texts have no lines to remove; very long texts and lines take
part in full; of equal lines the first stays, and of lines that are near each other and tie in
document and number none can; a null id counts as the smallest; rows that repeat an id and a text
are one document and do not remove each other's lines; rows that repeat only the id are ordered by
the hash of their text; an empty table gives an empty table. Spaces, tabs and carriage returns at
a line's ends do not count. Extra columns, whatever their names, are ignored (``report``,
``removed``) or kept (``apply``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_or_least, scratch, shown_id, text_or_empty, written, written_in_buckets

MAX_EDITS, LEAST_CHARS = 2, 20
_AT = ("doc_id", "text_hash", "line_no")
#: Lines under one key above which the bound on letter pairs is asked for, and lines that a block of its probes has on average.
COMMON, BLOCK = 4, 4096
#: Words of 64 parity bits a line.
PARITIES = 8
#: Characters after the common start that are compared first: of texts within k edits, starts of equal length are within 2k.
HEAD = 32


def let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), 0)


def lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_equal: int | None = None) -> DataFrame:
    """doc_id, text_hash, line_no, line of every line that takes part."""
    # Below the lines: above them, the whole text would be hashed once for each of its lines.
    texts = docs.select(id_or_least().alias("doc_id"), F.xxhash64(text_or_empty()).alias("text_hash"), text_or_empty().alias("text"))
    source = texts.select("doc_id", "text_hash", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    # A trim goes through the whole line, and few lines have anything to trim.
    blank_end = F.lit(False)
    for c in " \t\r":
        blank_end = blank_end | F.startswith("line", F.lit(c)) | F.endswith("line", F.lit(c))
    trimmed = source.withColumn("line", F.when(blank_end, F.btrim("line", F.lit(" \t\r"))).otherwise(F.col("line")))
    equal = F.lit(False) if least_equal is None else (F.char_length("line") >= least_equal) & F.col("line").rlike(r"\S")
    return trimmed.filter((F.char_length("line") >= least_chars) | equal)


def _hashes(line: Column) -> dict[str, Column]:
    return {"h1": F.xxhash64(line), "h2": F.xxhash64(F.lit(7), line)}


def distinct_lines(all_lines: DataFrame) -> DataFrame:
    """Each line once, with 128 bits of hash and the place of its first occurrence."""
    hashed = all_lines.withColumns(_hashes(F.col("line")))
    first = F.min(F.struct(*_AT)).alias("first")
    return hashed.groupBy("h1", "h2").agg(first, F.any_value("line").alias("line")).select("h1", "h2", "first.*", "line")


def _number(h1: Column) -> Column:
    """A line's number in the join: 48 bits of its hash."""
    return F.shiftrightunsigned(h1, 16)


def _segment(length: Column, i: int, k: int) -> tuple[Column, Column]:
    """Start (from 0) and length of segment i of k + 1 near-equal ones."""
    part = lambda j: F.floor((length + j) / (k + 1)).cast("int")
    start = F.lit(0)
    for j in range(i):
        start = start + part(j)
    return start, part(i)


def _key(line: Column, length: Column, i: int, shift: int, k: int) -> Column:
    """Hash of what stands where segment i of a line of ``length`` would stand, shifted."""
    start, size = _segment(length, i, k)
    return F.shiftrightunsigned(F.xxhash64(F.lit(i), length, F.substring(line, start + (shift + 1), size)), 16)


def _by_bytes(line: Column, n: Column, keys) -> Column:
    """The keys of a line of n characters. Where each is one byte, they are cut as bytes, without going through what stands before; the hashes are the same."""
    return F.when(F.octet_length(line) == n, keys(line.cast("binary"))).otherwise(keys(line))


def index_keys(line: Column, n: Column, k: int) -> Column:
    """Keys of a line of n characters."""
    return _by_bytes(line, n, lambda text: F.array(*(_key(text, n, i, 0, k) for i in range(k + 1))))


def probes(sized: DataFrame, k: int) -> DataFrame:
    """number and key for each key under which lines up to k characters shorter are indexed if they are within k edits; ``sized`` has number, line and its length n.

    With two edits, lines of equal length differ by a character that one has before the middle
    segment and one that the other has after it, if no segment stands where it stood. Probed from
    the other line, the middle then stands shifted the other way, or the last segment in its
    place, so one way of shifting is enough.
    """
    places = []
    for delta in range(k + 1):
        for i in range(k + 1):
            for shift in range(max(-i, delta - (k - i)), min(i, delta + k - i) + 1):
                if not (k == 2 and delta == 0 and shift < 0):
                    places.append(F.struct(F.lit(delta).alias("delta"), F.lit(i).alias("i"), F.lit(shift).alias("shift")))
    # The code for one key, run for each place: code for all of them at once is too long to be compiled.
    each = sized.select("number", "line", "n", F.explode(F.array(*places)).alias("place")).select("number", "line", "n", "place.*")
    length = F.col("n") - F.col("delta")
    part = lambda j: F.floor((length + j) / (k + 1)).cast("int")
    start = sum((F.when(F.col("i") > j, part(F.lit(j))).otherwise(0) for j in range(k)), F.col("shift") + 1)
    key = lambda text: F.shiftrightunsigned(F.xxhash64("i", length, F.substring(text, start, part(F.col("i")))), 16)
    return each.select("number", _by_bytes(F.col("line"), F.col("n"), key).alias("key"))


def parities(line: Column) -> Column:
    """``PARITIES`` longs of bits: which letter pairs, dealt by hash, stand in the line an odd number of times."""

    def words(hashes: Column) -> Column:
        bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("bigint"), x.bitwiseAND(F.lit(63)).cast("int"))
        word = lambda x: F.shiftright(x, 6).bitwiseAND(F.lit(PARITIES - 1))
        flip = lambda w: lambda s, x: s.bitwiseXOR(F.when(word(x) == w, bit(x)).otherwise(F.lit(0).cast("bigint")))
        return F.array(*(F.aggregate(hashes, F.lit(0).cast("bigint"), flip(w)) for w in range(PARITIES)))

    pairs = lambda t: F.zip_with(F.slice(t, 1, F.size(t) - 1), F.slice(t, 2, F.size(t) - 1), lambda x, y: F.xxhash64(x, y))
    return let(let(F.split(line, ""), pairs), words)


def candidates(distinct: DataFrame, k: int) -> DataFrame:
    """Numbers a < b of different lines that share a key and, under common keys, may be within k edits by their letter pairs. ``distinct`` lies in buckets of both hashes."""
    number = F.coalesce(_number(F.col("h1")), F.lit(0).cast("bigint"))
    # Both sides move by key once; all that follows reads those exchanges again, so each reader takes all columns and none adds a filter.
    # Lengths are counted below the keys: every key asks for its line's length several times.
    sized = distinct.select(number.alias("number"), "line", F.char_length("line").alias("n"))
    indexed = sized.select(F.col("number").alias("i"), F.explode(index_keys(F.col("line"), F.col("n"), k)).alias("key")).repartition("key")
    probing = probes(sized, k).withColumnRenamed("number", "p").repartition("key")
    lines_of_key = F.count(F.when(F.col("i") >= 0, 1))
    common = indexed.groupBy("key").agg(lines_of_key.alias("m")).filter(F.col("m") > COMMON).hint("shuffle_hash")
    ends = lambda met: met.filter(F.col("i") != F.col("p")).select(F.least("i", "p").alias("a"), F.greatest("i", "p").alias("b"))
    # An anti join would be pushed below the exchange.
    rare = ends(probing.join(common, "key", "left").filter(F.col("m").isNull()).join(indexed, "key"))
    rows = {end: df.join(common, "key").select("key", "m", F.col(end).alias("number")) for end, df in (("p", probing), ("i", indexed))}
    numbers = rows["p"].select("number").union(rows["i"].select("number")).distinct()
    hashes = distinct.select("h1", "h2", number.alias("number")).join(numbers, "number")
    signed = distinct.join(hashes.hint("shuffle_hash"), ["h1", "h2"]).select("number", parities(F.col("line")).alias("bits")).repartition("number")
    blocks = F.ceil(F.col("m") / BLOCK)

    def of(end: str, block: Column) -> DataFrame:
        # Never null: from a null word a filter would be inferred that computes the bits of all lines below the join.
        words = (F.coalesce(F.get("bits", F.lit(w)), F.lit(0).cast("bigint")).alias(f"{end}{w}") for w in range(PARITIES))
        return rows[end].join(signed, "number").select("key", block.alias("block"), F.col("number").alias(end), *words)

    left = of("p", F.pmod(F.xxhash64("number"), blocks))
    right = of("i", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
    flipped = sum((F.bit_count(F.col(f"p{w}").bitwiseXOR(F.col(f"i{w}"))) for w in range(PARITIES)), F.lit(0))
    return rare.union(ends(left.join(right, ["key", "block"]).filter(flipped <= 4 * k))).distinct()


def _common(a: Column, b: Column, of) -> Column:
    """Length of the common prefix (or suffix), by halving steps; ``of(text, done, step)`` is the next stretch."""
    steps = F.array(*(F.lit(1 << s) for s in range(22, -1, -1)))
    most = F.least(F.char_length(a), F.char_length(b))
    return F.aggregate(steps, F.lit(0), lambda done, s: F.when((done + s <= most) & (of(a, done, s) == of(b, done, s)), done + s).otherwise(done))


def edit_distance(a: Column, b: Column, k: int) -> Column:
    """Edits between two texts if they are at most k; else some number above k."""
    la, lb = F.char_length(a), F.char_length(b)
    long, short = F.when(la >= lb, a).otherwise(b), F.when(la >= lb, b).otherwise(a)

    def inner(pair: Column) -> Column:
        x, y = pair["x"], pair["y"]
        head = _common(x, y, lambda t, done, s: F.substring(t, done + 1, s))

        def after(p: Column) -> Column:
            u, v = F.substring(x, p + 1, F.char_length(x)), F.substring(y, p + 1, F.char_length(y))
            tail = lambda w: _common(w["u"], w["v"], lambda t, done, s: F.substring(t, F.char_length(t) - done - s + 1, s))
            cut = lambda w: let(tail(w), lambda q: F.struct(F.substring(w["u"], F.lit(1), F.char_length(w["u"]) - q).alias("u"), F.substring(w["v"], F.lit(1), F.char_length(w["v"]) - q).alias("v")))
            return let(let(F.struct(u.alias("u"), v.alias("v")), cut), middle)

        def middle(w: Column) -> Column:
            start = _banded(F.substring(w["u"], 1, HEAD), F.substring(w["v"], 1, HEAD), 2 * k)
            return F.when((F.char_length(w["v"]) >= 2 * HEAD) & (start > 2 * k), F.lit(k + 1)).otherwise(_banded(w["u"], w["v"], k))

        return let(head, after)

    return F.when(F.abs(la - lb) > k, F.lit(k + 1)).otherwise(let(F.struct(long.alias("x"), short.alias("y")), inner))


def _banded(long: Column, short: Column, k: int) -> Column:
    """Bit t stands for row column - k + t; the distance is followed along the diagonal that ends in the last cell."""
    mask = (1 << (2 * k + 1)) - 1

    def run(w: Column) -> Column:
        x, y = w["x"], w["y"]
        d = F.size(x) - F.size(y)
        band = lambda c: F.bitwise_not(c).bitwiseAND(F.lit(mask))

        def step(s: Column, j: Column) -> Column:
            equal = F.lit(0).cast("bigint")
            for t in range(2 * k + 1):
                row = j - k + t
                equal = equal.bitwiseOR(F.when((row >= 0) & (F.get(x, F.greatest(row, F.lit(0))) == F.get(y, j)), F.lit(1 << t).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
            vp, vn = s["vp"], s["vn"]

            def column(d0: Column) -> Column:
                hp, hn = vn.bitwiseOR(band(d0.bitwiseOR(vp))), d0.bitwiseAND(vp)
                up = F.shiftright(d0, 1)
                off = F.when(d0.bitwiseAND(F.get(F.array(*(F.lit(1 << (k + t)).cast("bigint") for t in range(k + 1))), d)) == 0, 1).otherwise(0)
                return F.struct(
                    hn.bitwiseOR(band(up.bitwiseOR(hp))).alias("vp"), up.bitwiseAND(hp).alias("vn"), (s["n"] + off).alias("n")
                )

            d0 = lambda pm: (pm.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(pm).bitwiseOR(vn).bitwiseAND(F.lit(mask))
            return let(let(equal, d0), column)

        start = F.struct(F.lit(mask - ((1 << k) - 1)).cast("bigint").alias("vp"), F.lit(0).cast("bigint").alias("vn"), d.alias("n"))
        walked = F.aggregate(F.sequence(F.lit(0), F.size(y) - 1), start, step, lambda s: s["n"])
        return F.when(F.size(y) == 0, F.size(x)).otherwise(walked)

    letters = lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, ""))
    return let(F.struct(letters(long).alias("x"), letters(short).alias("y")), run)


def near(distinct: DataFrame, k: int) -> DataFrame:
    """h1, h2 of the lines that have an earlier line within k edits. ``distinct`` lies in buckets of both hashes."""
    pairs = written(candidates(distinct, k), "line-pairs")
    wanted = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "number")
    # From numbers to hashes without the texts, then to the texts where they lie.
    hashes = distinct.select("h1", "h2", _number(F.col("h1")).alias("number")).join(wanted, "number")
    texts = written(distinct.join(hashes.hint("shuffle_hash"), ["h1", "h2"]), "line-texts")
    side = lambda p: texts.select(F.col("number").alias(p), F.struct(*_AT).alias(f"{p}_at"), F.col("line").alias(f"{p}_line"), F.struct("h1", "h2").alias(f"{p}_h"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    close = both.filter(edit_distance(F.col("a_line"), F.col("b_line"), k) <= k)
    return close.select(F.when(F.col("a_at") > F.col("b_at"), F.col("a_h")).otherwise(F.col("b_h")).alias("h")).select("h.*").distinct()


def removed(docs: DataFrame, max_edits: int = MAX_EDITS, least_chars: int = LEAST_CHARS, least_equal: int | None = None) -> DataFrame:
    """Written: doc_id (the smallest long for null), text_hash and the ascending numbers of the lines to remove, for documents that have any."""
    with scratch(docs.sparkSession, "line-dedup") as keep:
        found = lines(docs, least_chars, least_equal)
        distinct = written_in_buckets(distinct_lines(found), "lines", "h1", "h2")
        first = distinct.select("h1", "h2", F.struct(*_AT).alias("first"))
        if max_edits:
            later = near(distinct.filter(F.char_length("line") >= least_chars), max_edits).withColumn("near", F.lit(True))
            first = first.join(later, ["h1", "h2"], "left")
        else:
            first = first.withColumn("near", F.lit(None).cast("boolean"))
        places = found.select(*_AT, *(c.alias(n) for n, c in _hashes(F.col("line")).items()))
        gone = places.join(first, ["h1", "h2"]).filter(F.col("near").isNotNull() | (F.struct(*_AT) != F.col("first")))
        return keep(gone.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("line_no")).alias("removed")), "removed-lines")


def report(docs: DataFrame, max_edits: int = MAX_EDITS, least_chars: int = LEAST_CHARS, least_equal: int | None = None) -> DataFrame:
    """doc_id, n_lines, n_removed, removed for every document; line numbers count from 0."""
    own = docs.select(id_or_least().alias("doc_id"), F.xxhash64(text_or_empty()).alias("text_hash"), F.size(F.split(text_or_empty(), "\n")).alias("n_lines"))
    out = own.join(removed(docs, max_edits, least_chars, least_equal), ["doc_id", "text_hash"], "left")
    gone = F.coalesce("removed", F.array().cast("array<int>"))
    return out.select(shown_id(F.col("doc_id")).alias("doc_id"), F.col("n_lines").cast("long").alias("n_lines"), F.size(gone).cast("long").alias("n_removed"), gone.alias("removed"))


def apply(docs: DataFrame, max_edits: int = MAX_EDITS, least_chars: int = LEAST_CHARS, least_equal: int | None = None) -> DataFrame:
    """``docs`` with the lines taken out of their texts; a document that loses all its lines goes."""
    keyed = docs.withColumns({"_codrel_id": id_or_least(), "_codrel_hash": F.xxhash64(text_or_empty())})
    gone = removed(docs, max_edits, least_chars, least_equal).select(F.col("doc_id").alias("_codrel_id"), F.col("text_hash").alias("_codrel_hash"), F.col("removed").alias("_codrel_removed"))
    joined = keyed.join(gone, ["_codrel_id", "_codrel_hash"], "left")
    parts = F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains("_codrel_removed", i))
    touched = joined.withColumn("_codrel_left", F.when(F.col("_codrel_removed").isNotNull(), F.array_join(parts, "\n")).otherwise(F.col("text")))
    kept = touched.filter(F.col("_codrel_removed").isNull() | (F.trim(F.regexp_replace("_codrel_left", "\n", " ")) != ""))
    return kept.select(*(F.col("_codrel_left").alias(c) if c == "text" else F.char_length("_codrel_left").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))
