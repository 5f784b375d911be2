"""Fuzzy line dedup, in DataFrame functions alone.

Lines are normalised (lower case, white space as one space). A line's SimHash is
the bitwise majority of the hashes of its distinct words without their stops (a
separator between all words would else make unlike lines alike). The 64 bits are
cut into ``radius + keep`` blocks; two lines within the radius agree on at least ``keep`` of them (pigeonhole), so each
line goes under every choice of ``keep`` blocks, and lines are joined on these.
A link needs at most ``radius`` differing bits and an edit similarity (1 -
Levenshtein distance / longer length, of the normalised lines, stops included) of ``similarity``, whatever their length. One occurrence of each
connected group of lines stays: the first by doc_id, then by place.

Equal lines are one node, found by one exchange on the line's hash; all else
reads that table. Only connectivity matters, so dense groups are joined by
comparing each line with the nearest of a few pivots of its buckets, in rounds
with pivots of other components; then, exactly, lines that are near and still in
different components are all compared. Joins on a hot bucket are split by Spark,
and texts are fetched for pairs to be compared only.

Cases: null and empty texts and blank lines have nothing to remove; rows equal
in doc_id and text count as one document (both keep the same lines); a row
without doc_id comes after all others; columns of any name are kept.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epiwatch.llm.common import components, read_table, shared_dir, written

BLANK = " \t\n\x0b\x0c\r"
BLANKS = r"[\x20\x09-\x0D]+"
LAST = 2**63 - 1  # orders rows without doc_id after all others


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


#: Counts of bits are added up side by side: a long has a lane for each of the
#: bits k, k + width, k + 2 width ..., so ``width`` sums count all 64 bits. Narrower
#: lanes for short lines would take another pass over all lines, which costs more than they spare.
WIDTHS = (16,)


def _lanes(width: int) -> int:
    return _signed(sum(1 << k for k in range(0, 64, width)))


def most_words(width: int) -> int:
    """That a lane can count with a bit to spare for the sign."""
    return 2 ** (width - 2) - 1


#: Characters that a fingerprint tells no difference by. Digits are none of them: rows of
#: numbers would share a fingerprint without being alike, and all have to be compared.
STOPS = ".,;:!?\"'()"


def _added(a: str, b: str, c: str, ones: str, twos: str) -> list[Column]:
    """A full adder for each bit of three longs: the sums' ones and twos."""
    unequal = F.col(a).bitwiseXOR(F.col(b))
    return [unequal.bitwiseXOR(F.col(c)).alias(ones), F.col(a).bitwiseAND(F.col(b)).bitwiseOR(unequal.bitwiseAND(F.col(c))).alias(twos)]


def simhashes(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, fp): the bitwise majority of xxhash64(word) over the distinct words of
    ``line``, for rows of distinct ``keys``. Words are counted by sevens: full adders turn seven
    hashes into the ones, twos and fours of their bits' counts, and a group's are summed in lanes
    that can count the line's words; lines of more words than any lane have a sum for each bit."""
    n_words = F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    words = F.array_distinct(F.split(F.regexp_replace("line", f"[{STOPS}]", ""), " "))
    half = F.shiftright("n", 1)

    def of_words(more_than: int, at_most: int | None) -> DataFrame:
        over = [(F.octet_length("line") > n) & (n_words > n) for n in (more_than, at_most) if n]  # the bytes spare most lines the count
        some = lines.where(over[0]) if more_than else lines
        return some.where(~over[-1]) if at_most else some

    def hashed(k: int) -> Column:
        word = F.get("words", F.col("at") + k)
        return F.when(word.isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(word)).alias(f"h{k}")

    def joined(bits: list[Column]) -> Column:
        return reduce(lambda a, b: a.bitwiseOR(b), bits).alias("fp")

    parts, more_than = [], 0
    for width in WIDTHS:
        rows = of_words(more_than, most_words(width)).select(*keys, words.alias("words"))
        rows = rows.select(*keys, "words", F.explode(F.sequence(F.lit(0), F.size("words") - 1, F.lit(7))).alias("at"))
        rows = rows.select(*keys, F.least(F.size("words") - F.col("at"), F.lit(7)).cast("long").alias("n"), *(hashed(k) for k in range(7)))
        rows = rows.select(*keys, "n", "h6", *_added("h0", "h1", "h2", "a1", "a2"), *_added("h3", "h4", "h5", "b1", "b2"))
        rows = rows.select(*keys, "n", "a2", "b2", *_added("a1", "b1", "h6", "ones", "c2"))
        rows = rows.select(*keys, "n", "ones", *_added("a2", "b2", "c2", "twos", "fours"))
        lanes = F.lit(_lanes(width))
        counts = []
        for k in range(width):
            ones, twos, fours = (F.shiftrightunsigned(c, k).bitwiseAND(lanes) for c in ("ones", "twos", "fours"))
            counts.append(F.sum(ones + F.shiftleft(twos, 1) + F.shiftleft(fours, 2)).alias(f"s{k}"))
        sums = rows.groupBy(*keys).agg(F.sum("n").alias("n"), *counts)
        # A lane's count plus `short` reaches 2^(width - 2) where it is over half of n.
        short = (F.lit(most_words(width)) - half) * lanes
        bits = [F.shiftleft(F.shiftrightunsigned(F.col(f"s{k}") + short, width - 2).bitwiseAND(lanes), k) for k in range(width)]
        parts.append(sums.select(*keys, joined(bits)))
        more_than = most_words(width)
    plain = of_words(more_than, None).select(*keys, F.explode(words).alias("word")).select(*keys, F.xxhash64("word").alias("h"))
    plain = plain.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.shiftrightunsigned("h", k).bitwiseAND(F.lit(1))).alias(f"b{k}") for k in range(64)))
    each = [F.when(F.col(f"b{k}") > half, F.lit(_signed(1 << k))).otherwise(F.lit(0).cast("long")) for k in range(64)]
    return reduce(DataFrame.unionByName, parts).unionByName(plain.select(*keys, joined(each)))


def block_masks(radius: int, keep: int) -> list[int]:
    blocks = radius + keep
    edge = [round(64 * i / blocks) for i in range(blocks + 1)]
    return [sum((1 << edge[b + 1]) - (1 << edge[b]) for b in chosen) for chosen in combinations(range(blocks), keep)]


def documents(docs: DataFrame) -> DataFrame:
    """(doc, hash, text): the key of a document is its id and a hash of its text."""
    return docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(docs["text"]).alias("hash"), docs["text"].alias("text"))


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc, hash, pos, line, id) of every line that is not blank; ``line`` is
    normalised, ``id`` its hash."""
    lines = documents(docs).select("doc", "hash", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    # Looked at from the left alone, and before the line is made: a filter on it would make it twice.
    lines = lines.where(F.ltrim("raw", F.lit(BLANK)) != "").select("doc", "hash", "pos", F.lower("raw").alias("line"))
    odd = F.startswith("line", F.lit(" ")) | F.endswith("line", F.lit(" ")) | F.contains("line", F.lit("  "))
    for c in "\t\x0b\x0c\r":
        odd = odd | F.contains("line", F.lit(c))
    lines = lines.withColumn("line", F.when(odd, F.trim(F.regexp_replace("line", BLANKS, " "))).otherwise(F.col("line")))
    return lines.withColumn("id", F.xxhash64("line"))


#: Bits of the filter over wanted lines: 8 MB, whatever the number of lines.
FILTER_BITS = 2**26


def _those_of(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``lines`` whose id is in ``wanted`` (distinct ids). A bit map of fixed size over
    the ids is broadcast and sorts out most other rows before the exact join
    (with more ids it sorts out fewer; the join decides alike)."""
    spot = F.pmod("id", F.lit(FILTER_BITS))
    maps = (wanted.select(F.bitmap_bucket_number(spot).alias("map"), F.bitmap_bit_position(spot).alias("bit"))
            .groupBy("map").agg(F.bitmap_construct_agg("bit").alias("bits")))
    at = F.bitmap_bit_position(spot)
    byte = F.conv(F.hex(F.substring(F.col("bits"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    some = lines.join(F.broadcast(maps), F.bitmap_bucket_number(spot) == F.col("map")).where(hit).select(*lines.columns)
    return some.join(wanted, "id")  # not a semi join, which Spark would move below the filter


def alike(x: str, y: str, similarity: float) -> Column:
    """Whether the edit similarity of two columns is at least ``similarity``, for texts of
    any length. Texts of as many words differ by no more edits than the longer of each
    unequal pair of words has characters; where that is within the limit, as for copies
    with some words replaced, the Levenshtein distance need not be worked out. It costs the
    product of two lengths and memory in proportion to one, so it is taken of what is left without
    the words that both begin and both end with, and of very near texts within a smaller limit."""
    most = f"cast(floor((1 - {similarity}) * greatest(length({x}), length({y})) + 1e-9) as int)"
    words = f"zip_with(split({x}, ' '), split({y}, ' '), (a, b) -> if(a = b, 0, greatest(length(a), length(b))))"
    same = f"length({x}) - length(replace({x}, ' ', '')) = length({y}) - length(replace({y}, ' ', ''))"
    by_word = f"aggregate({words}, 0, (s, v) -> s + v) <= {most}"

    def run(a: str, b: str, most: str) -> str:
        """How many words, ``most`` at most, two lists begin with alike."""
        unequal = f"zip_with(slice({a}, 1, {most}), slice({b}, 1, {most}), (a, b) -> a <> b)"
        return f"cast(coalesce(nullif(array_position({unequal}, true), 0) - 1, {most}) as int)"

    fewer = "least(size(v.x), size(v.y))"
    begin = f"transform(array(named_struct('x', split({x}, ' '), 'y', split({y}, ' '))), v -> struct(v.x, v.y, {run('v.x', 'v.y', fewer)} AS n))"
    ends = run("reverse(v.x)", "reverse(v.y)", f"{fewer} - v.n")
    # Each word with a space after it, so that a word left out takes its space along.
    x_left, y_left = (f"array_join(transform(slice(v.{c}, v.n + 1, size(v.{c}) - v.n - v.m), w -> concat(w, ' ')), '')" for c in "xy")
    left = f"transform(transform({begin}, v -> struct(v.x, v.y, v.n, {ends} AS m)), v -> struct({x_left} AS x, {y_left} AS y, {most} AS most))"
    near = f"exists({left}, v -> (v.most >= 64 AND levenshtein(v.x, v.y, v.most div 64) >= 0) OR levenshtein(v.x, v.y, v.most) >= 0)"
    return F.expr(f"CASE WHEN abs(length({x}) - length({y})) > {most} THEN false WHEN {same} AND {by_word} THEN true ELSE {near} END")


def distinct_lines(docs: DataFrame) -> DataFrame:
    """(id, line, first occurrence, n) of every distinct line that is not blank."""
    return written(lines_of(docs).groupBy("id").agg(F.min("line").alias("line"), F.min(F.struct("doc", "hash", "pos")).alias("first"),
                                                    F.count(F.lit(1)).alias("n")), "lines")


def line_groups(lines: DataFrame, radius: int = 2, keep: int = 2, similarity: float = 0.8, pivots: int = 8, rounds: int = 2) -> DataFrame:
    """(node, root) of the distinct lines (id, line) that have a link.
    ``pivots`` and ``rounds`` spare comparisons and change no result."""
    prints = written(simhashes(lines.select("id", "line"), ["id"]), "prints")
    masks = F.array(*(F.lit(_signed(m)) for m in block_masks(radius, keep)))
    members = (prints.select("id", "fp", F.posexplode(masks).alias("table", "mask"))
               .select(F.xxhash64("table", F.col("fp").bitwiseAND(F.col("mask"))).alias("bucket"), "id"))
    crowd = members.join(members.groupBy("bucket").count().where("count > 1").select("bucket"), "bucket")
    crowd = written(crowd.join(prints, "id"), "crowd")
    texts = written(_those_of(lines.select("id", "line"), crowd.select("id").distinct()).select("id", "line"), "texts")

    def near(a: str, b: str) -> Column:
        return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= radius

    def verified(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) whose texts are alike."""
        both = (pairs.join(texts.select(F.col("id").alias("a"), F.col("line").alias("x")), "a")
                .join(texts.select(F.col("id").alias("b"), F.col("line").alias("y")), "b"))
        return both.where(alike("x", "y", similarity)).select("a", "b")

    # Each line with the nearest pivot of another component in its buckets. Pivots are picked by
    # hashes of lines, which meet large components, and of components, which meet small ones.
    one = F.struct("id", "fp", "root")
    now = crowd.withColumn("root", F.col("id"))
    links = groups = None
    for k in range(rounds):
        order = [F.xxhash64(F.lit(k * pivots + j), F.col("id" if j % 2 else "root")) for j in range(pivots)]
        picks = [F.min(F.struct(o.alias("o"), one.alias("m")))["m"].alias(f"p{j}") for j, o in enumerate(order)]
        chosen = now.groupBy("bucket").agg(*picks).select("bucket", F.array_distinct(F.array(*(f"p{j}" for j in range(pivots)))).alias("p"))
        pairs = now.join(chosen, "bucket").select("id", "fp", "root", F.explode("p").alias("p"))
        pairs = pairs.where((F.col("root") != F.col("p.root")) & near("fp", "p.fp"))
        apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("p.fp")))
        best = pairs.groupBy("id").agg(F.min(F.struct(apart, F.xxhash64("id", "p.id"), F.col("p.id").alias("b")))["b"].alias("b"))
        found = written(verified(best.select(F.col("id").alias("a"), "b")), "links")
        links = found if links is None else links.union(found)
        groups = written(components(links), "groups")
        now = crowd.join(groups.withColumnRenamed("node", "id"), "id", "left").select("bucket", "id", "fp", F.coalesce("root", "id").alias("root"))
        split = now.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("bucket")
        now = written(now.join(split, "bucket"), "now")
        if now.isEmpty():
            return groups

    # Then all pairs of lines that are near and still in different components.
    left, right = (now.select("bucket", F.col("id").alias(x), F.col("fp").alias(f"{x}_fp"), F.col("root").alias(f"{x}_root")) for x in "ab")
    rest = left.join(right, "bucket").where((F.col("a_root") < F.col("b_root")) & near("a_fp", "b_fp")).select("a", "b").distinct()
    return components(links.union(verified(rest)))


def removals(docs: DataFrame, **options) -> DataFrame:
    """(doc, hash, gone): the places of the lines to be removed from each
    document that loses some."""
    shared_dir(docs.sparkSession)
    lines = distinct_lines(docs)
    groups = written(line_groups(lines, **options).withColumnRenamed("node", "id"), "groups")
    lines = lines.select("id", "first", "n")
    # Only lines of a group meet each other; any other line stays where it is first.
    grouped = lines.join(groups, "id").select("id", "root", "first")
    stays = grouped.groupBy("root").agg(F.min("first").alias("stays"))
    alone = lines.where("n > 1").join(groups, "id", "left_anti").select("id", F.col("first").alias("stays"))
    repeated = grouped.join(stays, "root").select("id", "stays").union(alone)
    at = F.struct("doc", "hash", "pos")
    return (lines_of(docs).select("id", "doc", "hash", "pos").join(repeated, "id").where(at != F.col("stays"))
            .groupBy("doc", "hash").agg(F.sort_array(F.collect_set("pos")).alias("gone")))  # a set: repeated rows are one document


def line_dedup(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the removed lines (``n_chars`` counted anew). A document
    all of whose lines that are not blank are removed goes."""
    gone = removals(docs, **options)
    rows = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(docs["text"]).alias("hash"), F.struct(*docs.columns).alias("row"))
    text = F.col("row.text")
    stays = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains("gone", i)), "\n")
    cut = rows.join(gone, ["doc", "hash"], "left").select("row", "gone", F.when(F.col("gone").isNull(), text).otherwise(stays).alias("left"))
    cut = cut.where(F.col("gone").isNull() | F.col("left").rlike(r"[^\x20\x09-\x0D]"))
    new = {"text": F.col("left"), "n_chars": F.when(F.col("gone").isNull(), F.col("row")["n_chars"]).otherwise(F.length("left").cast("long"))}
    return cut.select(*(new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_lines, n_removed, removed): lines that are not blank, and the
    places (from 0, comma-joined) of those removed, of every document."""
    docs = read_table(spark, sf_dir, "documents")
    count = F.size(F.filter(F.split("text", "\n"), lambda x: F.ltrim(x, F.lit(BLANK)) != ""))
    every = documents(docs).select("doc", "hash", F.when(F.col("text").isNull(), 0).otherwise(count).cast("long").alias("n_lines"))
    found = every.join(removals(docs), ["doc", "hash"], "left")
    return found.select(F.when(F.col("doc") != LAST, F.col("doc")).alias("doc_id"), "n_lines", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
                        F.coalesce(F.array_join(F.col("gone").cast("array<string>"), ","), F.lit("")).alias("removed"))
