"""Fuzzy line deduplication in DataFrame functions only.

1. Lines are normalised (lower case, single spaces) and named by a 128-bit hash; equal ones fall together.
2. Pigeonhole blocks: a line has six keys, of its start, its end and both, and from FEW words on two more, of its second and third
   quarter of words (block_keys). Edits that leave one of the blocks alone leave its key, so a similar line has the same.
3. A bucket of lines with a key in common links its members to its least member.
4. Links are confirmed by edit similarity on the whole normalised lines, in characters, or in words above
   LONG characters (unless words are far longer than usual, as in unspaced scripts). Where a bucket still holds
   several components, leaders of it meet all its members, turn by turn, and in the end all members that are
   still in different components are compared, in blocks of bounded size, so a hot bucket is many tasks. Pairs whose
   lengths or sets of neighbouring characters are too far apart for any similar pair don't become rows.
5. Each connected group keeps its first occurrence: least document id, then least line number.

With ``meet="simhash"`` the blocks are pairs of stretches of a 64-bit SimHash of word pairs, and bits within
``distance`` are asked for. That finds few near lines of ordinary length (README), so it isn't the default.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from wavemill.llm._graph import components
from wavemill.llm._store import materialise

DISTANCE, PERCENT, MIN_WORDS = 3, 85, 5
#: Ratio of block lengths, below 1 / 0.85; characters of a block that a short line has if half of it is as long; longest line
#: where one edit at most is allowed; members of a block of a bucket.
STEP, SHORT, TINY, BLOCK = 1.17, 24, 13, 256
#: Lines of more characters are compared by words.
LONG = 300
#: Keys of a line, and words from which on it has those of its inner quarters.
KEYS, FEW = 8, 8
#: Turns in which leaders of a mixed bucket meet its members, at most, and leaders of a bucket; longs of a line's marks.
ROUNDS, LEADERS, LANES = 6, 4, 8


def _odd(line: Column) -> Column:
    """Lines with blanks that normalising takes out."""
    odd = line.startswith(" ") | line.endswith(" ") | F.contains(line, F.lit("  "))
    for c in "\t\r\f\x0b":
        odd = odd | F.contains(line, F.lit(c))
    return odd


def normalised(line: Column) -> Column:
    """Lower case, runs of blanks as one space, none at the ends. Only lines that need it go through a pattern."""
    return F.lower(F.when(_odd(line), F.trim(F.regexp_replace(line, r"[\t\r\f\x0b ]+", " "))).otherwise(line))


def line_table(docs: DataFrame) -> DataFrame:
    """(id, place, line, h1, h2) of each line that isn't blank, normalised; place counts from 0."""
    lines = docs.select("id", F.posexplode_outer(F.split("text", "\n")).alias("place", "line")).select("id", "place", normalised(F.col("line")).alias("line"))
    return lines.where("line <> ''").select("id", "place", "line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def simhashes(lines: DataFrame) -> DataFrame:
    """(h1, h2, least, times, n_words, bits) of each distinct line: least document id, occurrences, and the SimHash of its word pairs."""
    words = lines.select("id", "h1", "h2", F.split("line", " ").alias("w"))
    # The pairs are made and hashed in generated code: an array of pairs, exploded.
    pairs = F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.size("w")).alias("b"))
    rows = words.select("id", "h1", "h2", F.size("w").alias("n"), F.posexplode_outer(pairs).alias("i", "p"))
    rows = rows.select("id", "h1", "h2", "n", "i", F.xxhash64("p.a", F.coalesce("p.b", F.lit(""))).alias("f"))
    lane = F.lit((1 << 32) | 1)
    sums = [F.sum(F.shiftright("f", j).bitwiseAND(lane)).alias(f"s{j}") for j in range(32)]
    flat = rows.groupBy("h1", "h2").agg(F.min("id").alias("least"), F.sum(F.when(F.col("i") == 0, 1).otherwise(0)).alias("times"), F.max("n").alias("n_words"), F.count(F.lit(1)).alias("features"), *sums)
    half = lambda c: 2 * c > F.col("features")
    bits = [F.when(half(F.col(f"s{j}").bitwiseAND(F.lit(0xFFFFFFFF))), F.lit(1 << j)).otherwise(F.lit(0)) for j in range(32)]
    bits += [F.when(half(F.shiftrightunsigned(F.col(f"s{j}"), 32)), F.lit((1 << (32 + j)) - (1 << 64 if j == 31 else 0))).otherwise(F.lit(0)) for j in range(32)]
    return flat.select("h1", "h2", "least", "times", "n_words", reduce(lambda a, b: a.bitwiseOR(b), [b.cast("long") for b in bits]).alias("bits"))


def bucket_keys(bits: str, distance: int) -> Column:
    """A key for each pair of blocks; lines within ``distance`` bits share one at least."""
    blocks = distance + 2
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    part = [F.shiftrightunsigned(bits, cuts[i]).bitwiseAND(F.lit((1 << (cuts[i + 1] - cuts[i])) - 1)) for i in range(blocks)]
    pairs = [(i, j) for i in range(blocks) for j in range(i)]
    return F.array(*[F.shiftleft(F.shiftleft(part[i], cuts[j + 1] - cuts[j]).bitwiseOR(part[j]), 8).bitwiseOR(F.lit(k)) for k, (i, j) in enumerate(pairs)])


def _spelled(line: Column) -> Column:
    """A character for each word, by its hash."""
    return F.array_join(F.transform(F.split(line, " "), lambda w: F.decode(F.unhex(F.lpad(F.hex(F.lit(0x3400) + F.pmod(F.xxhash64(w), F.lit(0xA000))), 4, "0")), "UTF-16BE")), "")


def similar(a: str, b: str, percent: int) -> Column:
    """Edit similarity, 1 - distance / longer length, of at least percent / 100; of columns of one unit, characters or words."""
    la, lb = F.length(a), F.length(b)
    slack = F.floor(F.greatest(la, lb) * (100 - percent) / 100).cast("int")
    # With a limit only a band of the table of edits is filled; beyond it the result is -1. Most pairs need a narrow band.
    within = lambda most: F.call_function("levenshtein", F.col(a), F.col(b), most) >= 0
    narrow, wider = [(slack > most) & within(F.lit(most)) for most in (8, 128)]
    return (F.abs(la - lb) <= slack) & (narrow | wider | within(slack))


def groups(lines: DataFrame, docs: DataFrame, *, distance: int, percent: int, min_words: int) -> tuple[DataFrame, DataFrame]:
    """Distinct lines (see simhashes) and (node, component) of those that are linked; a node is a line's h1."""
    flat = materialise(simhashes(lines), "distinct_lines")
    long = flat.where(F.col("n_words") >= min_words).select("h1", "bits")
    keyed = long.select("h1", "bits", F.explode(bucket_keys("bits", distance)).alias("key"))
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance
    # A bucket of one line is dropped as soon as it is counted, and of one of two only a near pair is made.
    centres = keyed.groupBy("key").agg(F.min("h1").alias("centre"), F.min_by("bits", "h1").alias("head"), F.count(F.lit(1)).alias("size")).where("size > 1").withColumnRenamed("key", "_key")
    met = (F.col("key") == F.col("_key")) & ((F.col("size") > 2) | ((F.col("h1") != F.col("centre")) & near("bits", "head")))
    members = materialise(keyed.join(centres.hint("shuffle_hash"), met).select("key", "centre", "h1", "bits", "size", near("bits", "head").alias("near")), "buckets")
    stars = materialise(members.where("near AND h1 <> centre").select(F.col("centre").alias("a"), F.col("h1").alias("b")).distinct(), "stars")
    # Texts are wanted of lines that are near another: their bucket's centre, or else any member. Half joins make no pairs.
    buckets = members.where("size > 2")
    far = buckets.where("NOT near").select("key", F.col("h1").alias("a"), F.col("bits").alias("abits"))
    rest = buckets.where("h1 <> centre").select(F.col("key").alias("_key"), F.col("h1").alias("b"), F.col("bits").alias("bbits"))
    beside = (F.col("key") == F.col("_key")) & (F.col("a") != F.col("b")) & near("abits", "bbits")
    ends = stars.select(F.col("a").alias("h1")).union(stars.select("b")).union(far.join(rest, beside, "left_semi").select("a")).union(rest.join(far, beside, "left_semi").select("b")).distinct()
    wanted = materialise(ends.join(flat.select("h1", "h2", "least"), "h1"), "wanted")
    homes = docs.join(wanted.select(F.col("least").alias("id")).distinct().hint("shuffle_hash"), "id", "left_semi")
    texts = line_table(homes).select("h1", "h2", "id", "line")
    texts = materialise(texts.join(wanted.withColumnRenamed("least", "id"), ["h1", "h2", "id"], "left_semi").dropDuplicates(["h1"]).select("h1", "line"), "texts")

    def confirmed(pairs: DataFrame) -> DataFrame:
        left = texts.select(F.col("h1").alias("a"), F.col("line").alias("la"))
        right = texts.select(F.col("h1").alias("b"), F.col("line").alias("lb"))
        return pairs.join(left, "a").join(right, "b").where(similar("la", "lb", percent)).select("a", "b")

    links = materialise(confirmed(stars), "links")
    first = components(links)
    named = buckets.join(texts.select("h1"), "h1", "left_semi").join(first.withColumnRenamed("node", "h1"), "h1", "left").withColumn("component", F.coalesce("component", "h1"))
    heart = first.select(F.col("node").alias("centre"), F.col("component").alias("main"))
    named = materialise(named.join(heart, "centre", "left").withColumn("main", F.coalesce("main", "centre")), "named")
    outer = named.where("component <> main").select("key", F.col("h1").alias("a"), F.col("bits").alias("abits"), F.col("component").alias("ac"))
    other = named.select("key", F.col("h1").alias("b"), F.col("bits").alias("bbits"), F.col("component").alias("bc"))
    # Pairs that the stars compared are left out, as are those of one component.
    rest = outer.join(other, "key").where((F.col("ac") != F.col("bc")) & near("abits", "bbits")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rest = rest.join(stars, ["a", "b"], "left_anti")
    return flat, components(links.unionByName(confirmed(rest)))


def _blocks(line: str, down: int) -> dict[str, Column]:
    """Hashes of a line's blocks: its start, its end, and half as much of both. A block is a quarter of the line (more of a short one,
    so that it tells lines apart) in bytes, rounded down to a grid of ratio STEP, ``down`` steps below: lines whose lengths allow
    similarity have a grid length in common. So lines whose differences all lie beside a block share its key."""
    raw, size = F.col(line).cast("binary"), F.octet_length(line)
    level = F.floor(F.log(F.greatest(size / 4.0, F.least(size / 2.0, F.lit(float(SHORT))))) / F.log(F.lit(STEP)))
    part = F.greatest(F.floor(F.pow(F.lit(STEP), level - down)), F.lit(2)).cast("int")
    half = F.shiftright(part, 1)
    start, end = (lambda n: F.substring(raw, F.lit(1), n)), (lambda n: F.substring(raw, size - n + 1, n))
    return {
        "start": F.xxhash64(F.lit(1), start(part)), "end": F.xxhash64(F.lit(2), end(part)), "both": F.xxhash64(F.lit(3), start(half), end(part - half)),
    }


def _inner(line: str) -> list[Column]:
    """Hashes of a line's second and third quarter of words, with the number of words; null below FEW words. Letters that change move no word."""
    n = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1
    upto = lambda text, count: F.call_function("substring_index", text, F.lit(" "), count.cast("int"))
    half, quarter = F.shiftright(n, 1), F.shiftright(n, 2)
    first, last = upto(upto(F.col(line), half), quarter - half), upto(upto(F.col(line), half - n), n - half - quarter)
    return [F.when(n >= FEW, F.xxhash64(F.lit(4 + i), n, words)) for i, words in enumerate((first, last))]


def block_keys(line: str) -> list[Column]:
    """A line's KEYS: start, end and both, at two grid lengths, and _inner."""
    return [_blocks(line, down)[k] for down in (0, 1) for k in ("start", "end", "both")] + _inner(line)


def marked_lines(docs: DataFrame) -> DataFrame:
    """(id, place, h1, h2, n, k0..k7, tiny) of each line that isn't blank: hashes, characters, block_keys, and the line itself up to TINY + 1 characters."""
    keys = [k.alias(f"k{i}") for i, k in enumerate(block_keys("line"))]
    return line_table(docs).select("id", "place", "h1", "h2", F.length("line").alias("n"), *keys, F.when(F.length("line") <= TINY + 1, F.col("line")).alias("tiny"))


def tiny_keys(line: str) -> Column:
    """Hashes of a line and of what is left without one character: lines one edit apart share one."""
    size = F.length(line)
    cut = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.xxhash64(F.lit(0), F.concat(F.substring(line, F.lit(1), i), F.substring(line, i + 2, size))))
    return F.array_distinct(F.array_append(cut, F.xxhash64(F.lit(0), line)))


def _marks(units: str) -> list[Column]:
    """LANES longs, a set of bits: one for each pair of neighbouring characters, by its hash."""
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(units) - 1, F.lit(1))), lambda i: F.pmod(F.xxhash64(F.substring(units, i, F.lit(2))), F.lit(64 * LANES)).cast("int"))
    bit = lambda m: F.call_function("shiftleft", F.lit(1).cast("long"), m.bitwiseAND(F.lit(63)))
    lane = lambda k: F.aggregate(pairs, F.lit(0).cast("long"), lambda s, m: F.when(F.shiftright(m, 6) == k, s.bitwiseOR(bit(m))).otherwise(s))
    return [lane(k).alias(f"m{k}") for k in range(LANES)]


def _marked_members(members: DataFrame, tied: DataFrame, texts: DataFrame) -> DataFrame:
    """(key, h1, component, units, spelled, size, m0..) of members of buckets that hold several components: characters and _marks, in letters and
    in words under keys of their own, as lines may have both; spelled are letters of lines that have words too."""
    named = members.select("key", "h1").join(tied.withColumnRenamed("node", "h1"), "h1", "left").withColumn("component", F.coalesce("component", "h1"))
    mixed = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    named = materialise(named.join(mixed, "key"), "named")
    given = texts.join(named.select("h1").distinct(), "h1").withColumn("both", F.col("words").isNotNull())
    units = given.select("h1", "both", F.explode(F.create_map(F.lit(0), "line", F.lit(1), "words")).alias("unit", "units")).where("units IS NOT NULL")
    units = materialise(units.select("h1", "unit", "units", ((F.col("unit") == 0) & F.col("both")).alias("spelled"), F.length("units").alias("size"), *_marks("units")), "marks")
    return named.join(units, "h1").withColumn("key", F.xxhash64("key", "unit")).drop("unit")


def groups_by_blocks(docs: DataFrame, marked: DataFrame, *, percent: int) -> tuple[DataFrame, DataFrame]:
    """As groups, with lines (marked_lines of docs) that meet by block_keys (up to TINY characters: tiny_keys)."""
    flat = marked.groupBy("h1", "h2").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("times"), F.max("n").alias("n"), *[F.max(f"k{i}").alias(f"k{i}") for i in range(KEYS)])
    flat = materialise(flat, "distinct_lines")
    slack = lambda a, b: F.abs(F.col(a) - F.col(b)) * 100 <= F.greatest(a, b) * (100 - percent)
    keyed = flat.where(F.col("n") > TINY).select("h1", "n", F.posexplode(F.array(*[f"k{i}" for i in range(KEYS)])).alias("kind", "key")).where("key IS NOT NULL")
    tiny = marked.where("tiny IS NOT NULL").select("h1", "n", F.lit(-1).alias("kind"), F.explode(tiny_keys("tiny")).alias("key")).distinct()
    keyed = keyed.withColumn("kind", F.col("kind") % 3).unionByName(tiny).repartition("key")
    centres = keyed.groupBy("key").agg(F.min("h1").alias("centre"), F.min_by("n", "h1").alias("head"), F.count(F.lit(1)).alias("size")).where("size > 1").withColumnRenamed("key", "_key")
    met = (F.col("key") == F.col("_key")) & ((F.col("size") > 2) | ((F.col("h1") != F.col("centre")) & slack("n", "head")))
    members = materialise(keyed.join(centres.hint("shuffle_hash"), met).select("key", "kind", "centre", "h1", "n", "size", slack("n", "head").alias("near")), "buckets")
    stars = materialise(members.where("near AND h1 <> centre").select(F.col("centre").alias("a"), F.col("h1").alias("b")).distinct(), "stars")
    # Texts of lines that have a bucket in common with another, each from its first document.
    wanted = stars.select(F.col("a").alias("h1")).union(stars.select("b")).union(members.where("size > 2").select("h1")).distinct()
    wanted = wanted.join(flat.select("h1", "h2", F.col("least").alias("id")), "h1")
    spots = marked.select("id", "place", "h1", "h2").join(wanted, ["h1", "h2", "id"], "left_semi").groupBy("h1", "id").agg(F.min("place").alias("place"))
    spots = spots.groupBy("id").agg(F.collect_list(F.struct("h1", "place")).alias("spots"))  # as many as a document has lines
    # Named twice, so that it stays a column below the lambda.
    split = docs.join(spots.hint("shuffle_hash"), "id").withColumn("_lines", F.split("text", "\n")).withColumn("_n", F.size("_lines"))
    line_of = lambda s: F.struct(s.h1.alias("h1"), F.when(s.place < F.col("_n"), F.get("_lines", s.place)).alias("line"))
    texts = split.select(F.inline(F.transform("spots", line_of))).select("h1", normalised(F.col("line")).alias("line"))
    # Of rows that share an id, another may have another line at the place.
    texts = texts.where(F.xxhash64("line") == F.col("h1")).dropDuplicates(["h1"])
    # Pairs of long lines are compared by words, each a character: a table of edits grows with the square of a line.
    size = F.length("line")
    long = (size > LONG) & (size < 20 * F.size(F.split("line", " ")))
    in_words, in_letters = F.when(long, _spelled(F.col("line"))).alias("words"), F.when(~long | (size * percent <= LONG * 100), F.col("line")).alias("line")
    texts = materialise(texts.select("h1", in_letters, in_words), "texts")

    def confirmed(pairs: DataFrame) -> DataFrame:
        left = texts.select(F.col("h1").alias("a"), F.col("line").alias("la"), F.col("words").alias("wa"))
        right = texts.select(F.col("h1").alias("b"), F.col("line").alias("lb"), F.col("words").alias("wb"))
        both = F.col("wa").isNotNull() & F.col("wb").isNotNull()
        return pairs.join(left, "a").join(right, "b").where(F.when(both, similar("wa", "wb", percent)).otherwise(similar("la", "lb", percent))).select("a", "b")

    tied = components(materialise(confirmed(stars), "links"))
    open_ = _marked_members(members.where("size > 2"), tied, texts)
    room = F.floor(F.greatest("an", "bn") * (100 - percent) / 100)
    apart = sum((F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in range(LANES)), F.lit(0))
    # An edit takes two pairs of neighbours at most and makes two, so a similar pair always passes the marks.
    alike = (F.col("ac") != F.col("bc")) & ~(F.col("as") & F.col("bs")) & (F.abs(F.col("an") - F.col("bn")) <= room) & (apart <= 4 * room) & similar("au", "bu", percent)
    side = lambda df, s, *more: df.select("key", *more, F.col("h1").alias(s), F.col("component").alias(f"{s}c"), F.col("units").alias(f"{s}u"), F.col("spelled").alias(f"{s}s"), F.col("size").alias(f"{s}n"), *[F.col(f"m{i}").alias(f"{s}{i}") for i in range(LANES)])
    turn, leading = 0, True
    while True:
        # Buckets of one component are done. The largest component's members needn't meet each other.
        parts = open_.groupBy("key", "component").agg(F.count(F.lit(1)).alias("_n"))
        parts = parts.groupBy("key").agg(F.count(F.lit(1)).alias("_parts"), F.sum("_n").alias("all"), F.max_by("component", F.struct("_n", "component")).alias("main")).where("_parts > 1")
        open_ = materialise(open_.join(parts.drop("_parts"), "key"), "open")
        rows = open_.count()
        if not rows:
            return flat, tied
        if leading:
            # LEADERS members of each bucket, others in each turn, meet the rest of it: large components grow at a cost that
            # is linear in the bucket.
            rank = F.xxhash64(F.lit(turn), "h1")
            lead = open_.groupBy("key", F.pmod(rank, F.lit(LEADERS)).alias("_slot")).agg(F.min_by(F.struct("h1", "component", "units", "spelled", "size", *[f"m{i}" for i in range(LANES)]), rank).alias("_l"))
            met = side(lead.select("key", "_l.*"), "a").join(side(open_, "b"), "key").where(alike)
        else:
            # What is still apart meets all of the bucket, in blocks of about BLOCK members, so that a hot bucket is many tasks.
            dealt = open_.withColumn("blocks", F.ceil(F.col("all") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("h1"), "blocks").cast("int"))
            each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
            outer = side(dealt.where("component <> main"), "a", F.col("own").alias("i"), each.alias("j"))
            other = side(dealt, "b", "main", each.alias("i"), F.col("own").alias("j"))
            met = outer.join(other, ["key", "i", "j"]).where(((F.col("bc") == F.col("main")) | (F.col("a") < F.col("b"))) & alike)
        # Links between components, each of the name of one of its lines.
        joined = materialise(met.select(F.least("ac", "bc").alias("a"), F.greatest("ac", "bc").alias("b")).distinct(), "joined")
        links = joined.count()
        if links:
            to = components(joined)
            onto = to.toDF("component", "to")
            tied = tied.join(onto, "component", "left").select("node", F.coalesce("to", "component").alias("component")).unionByName(to.join(tied.select("node"), "node", "left_anti"))
            tied = materialise(tied, "tied")
            open_ = open_.join(onto, "component", "left").withColumn("component", F.coalesce("to", "component")).drop("to")
        if not leading:
            return flat, tied
        open_ = open_.drop("all", "main")
        turn += 1
        leading = turn < ROUNDS and links * 50 > rows


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, distance: int = DISTANCE, percent: int = PERCENT, min_words: int = MIN_WORDS, meet: str = "blocks") -> DataFrame:
    """docs with repeated lines taken out of ``text``, and the columns n_lines and n_removed.

    Lines are parted by newlines. Lines without words stay. A line is a repeat of equal normalised lines and of
    lines of ``percent`` edit similarity that share a key of block_keys, through any chain of links. With
    ``meet="simhash"`` it is one of equal lines and, from ``min_words`` words on, of those within ``distance``
    SimHash bits and ``percent`` edit similarity. Every row of docs is kept, even when no
    line of it is left. Null and empty texts stay as they are. Rows that share an id are one document
    when occurrences are ordered: a line of several such rows is kept in each. A null id keeps all lines.
    Other columns pass through; columns named n_lines and n_removed are replaced.
    """
    base = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    lines = line_table(base)
    if meet not in ("blocks", "simhash"):
        raise ValueError("lines meet by blocks or by simhash")
    if meet == "blocks":
        marked = materialise(marked_lines(base), "marked_lines")
        flat, tied = groups_by_blocks(base, marked, percent=percent)
    else:
        marked = lines
        flat, tied = groups(lines, base, distance=distance, percent=percent, min_words=min_words)
    whole = flat.join(tied.withColumnRenamed("node", "h1"), "h1", "left").withColumn("component", F.coalesce("component", "h1"))
    # Each group's first document, and the group's size in occurrences; groups of one occurrence need nothing.
    group = whole.groupBy("component").agg(F.min("least").alias("home"), F.sum("times").alias("times")).where("times > 1")
    repeated = materialise(whole.join(group.drop("times"), "component").select("h1", "h2", "component", "home"), "repeated")
    seen = materialise(marked.select("id", "place", "h1", "h2").join(repeated, ["h1", "h2"]).select("id", "place", "component", "home"), "seen")
    kept = seen.where("id = home").groupBy("component").agg(F.min("place").alias("place"))
    at_home = seen.where("id = home").join(kept.withColumnRenamed("place", "first"), "component").where("place <> first")
    gone = seen.where("id <> home").select("id", "place").unionByName(at_home.select("id", "place"))
    gone = gone.groupBy("id").agg(F.collect_set("place").alias("gone")).withColumnRenamed("id", "_id").hint("shuffle_hash")
    out = docs.drop("n_lines", "n_removed").join(gone, docs[doc_id] == F.col("_id"), "left").drop("_id")
    # Named twice, so that it stays a column below the lambda.
    out = out.withColumn("_lines", F.split(text, "\n")).withColumn("_n", F.size("_lines"))
    left = F.array_join(F.filter("_lines", lambda line, i: ~F.array_contains("gone", i)), "\n")
    cut = F.col("gone").isNotNull() & F.col(text).isNotNull()
    others = [F.col(f"`{c}`") if c != text else F.when(cut, left).otherwise(F.col(text)).alias(text) for c in docs.columns if c not in ("n_lines", "n_removed")]
    removed = F.when(cut, F.size("gone")).otherwise(F.lit(0))
    return out.select(*others, F.when(F.col(text).isNull(), 0).otherwise(F.col("_n")).cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"))
