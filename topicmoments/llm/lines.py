"""Line dedup: a segment-partition join of lines within a few edits, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicmoments.llm.buckets import bucket_links, fact, flag_count, flags, no_flags
from topicmoments.llm.common import join_measured, join_salted, written
from topicmoments.llm.components import components

#: Edits (insert, delete, replace a character) within which two lines are the same.
EDITS = 2
#: Shorter lines are left alone, unless lines that hold a word are asked for (`near_from`).
MIN_CHARS = 32
#: From this length on EDITS edits leave a similarity of 0.8.
NEAR_FROM = 10
#: A line that holds a word.
WORD = r"[\p{L}\p{N}]"
#: Letters whose numbers are compared before two lines are. An edit changes these by two in all at most.
LETTERS = " abcdefghijklmnopqrstuvwxyz.,"
SALT = 91
#: Bytes of a row group of the lines' keys: a task holds one at a time, and keys do not compress.
KEYS_GROUP = 4 << 20


def line_rows(docs: DataFrame, id_col: str, text_col: str, min_chars: int, words: bool = False) -> DataFrame:
    """(id, t, pos, line, h, g): long enough lines of documents with an id, and two hashes; t is the text's hash.
    With `words` also shorter lines that hold a word."""
    counted = F.char_length("line") >= min_chars
    if words:
        counted = counted | F.col("line").rlike(WORD)
    return (docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
            .filter("id is not null and text is not null")
            .select("id", F.xxhash64("text").alias("t"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
            .filter(counted)
            .withColumns({"h": F.xxhash64("line"), "g": F.xxhash64(F.lit(SALT), "line")}))


def segment_probes(edits: int) -> list[tuple[int, int, int]]:
    """(segment, difference of length, shift) of every substring that a line has to look up.

    A line is cut into `edits` + 1 segments. If a line is within `edits` of another that is longer by
    `difference`, one of the shorter line's segments stands in the longer one, moved by no more than
    the edits that can lie before it and after it allow. The entries without difference and shift are
    the line's own segments, which the index holds.
    """
    return [(i, d, shift) for d in range(edits + 1) for i in range(1, edits + 2)
            for shift in range(max(1 - i, d - (edits + 1 - i)), min(i - 1, d + (edits + 1 - i)) + 1)]


def with_keys(lines: DataFrame, edits: int, min_chars: int = 0) -> DataFrame:
    """Add `keys`, an array of hashes, one for each substring to look up and its place; a line of equal characters may repeat some.
    Lines of fewer than `min_chars` characters have null.

    Lengths become columns first: they are then worked out once and not in each of the keys. So do the line's characters,
    in four bytes each: a substring is then cut out where it stands, and not counted up to from the line's beginning.
    """
    parts = edits + 1
    lines = lines.withColumns({"n": F.char_length("line"), "wide": F.encode("line", "UTF-32")})
    lines = lines.withColumns({f"longer{d}": (F.col("n") - d) % parts for d in range(edits + 1)})
    lines = lines.withColumns({f"base{d}": ((F.col("n") - d - F.col(f"longer{d}")) / parts).cast("int") for d in range(edits + 1)})
    # the last segments, as many as `longer`, have one character more
    lines = lines.withColumns({f"begin{d}_{i}": (i - 1) * F.col(f"base{d}") + F.greatest(F.lit(0), F.lit(i - 1 - parts) + F.col(f"longer{d}")) + 1
                               for d in range(edits + 1) for i in range(1, parts + 1)})
    keys = [F.xxhash64(F.col("n") - d, F.lit(i), F.substr(F.col("wide"), (F.col(f"begin{d}_{i}") + (shift - 1)) * 4 + 1,
                                                         (F.col(f"base{d}") + F.when(F.lit(i) > parts - F.col(f"longer{d}"), 1).otherwise(0)) * 4))
            for i, d, shift in segment_probes(edits)]
    return lines.withColumn("keys", F.when(F.col("n") >= min_chars, F.array(*keys)))


def line_table(docs: DataFrame, id_col: str, text_col: str, edits: int, min_chars: int, near_from: int | None = None) -> DataFrame:
    """`line_rows` without the lines themselves, but with the keys of those that edits are looked for in (null for others).

    Texts are split, and keys worked out, once: the table is written, and all later passes but that for lines that share
    a key read it.
    """
    lines = line_rows(docs, id_col, text_col, min_chars, near_from is not None)
    keyed = with_keys(lines, edits, near_from or 0) if edits else lines.withColumn("keys", F.lit(None).cast("array<bigint>"))
    return written(keyed.select("id", "t", "pos", "h", "g", "keys"), "keyed-lines", KEYS_GROUP)


def within_edits(a: Column, b: Column, edits: int) -> Column:
    """Whether two texts are within `edits` edits: bit-parallel edit distance in a diagonal band.

    Column j of the dynamic programme is held as two words of 2 * edits + 2 bits, whose bits say where the
    value grows or falls from one row of the band to the next. The value is followed along the band's
    lower edge, and along the last row once the band has reached it.
    """
    width = 2 * edits + 2
    mask = (1 << width) - 1
    first = F.char_length(a) >= F.char_length(b)
    longer, shorter = F.when(first, a).otherwise(b), F.when(first, b).otherwise(a)

    def banded(pair: Column) -> Column:
        p, m = pair["p"], pair["m"]

        def matches(char: Column, j: Column) -> Column:
            bits = F.lit(0)
            for k in range(width):
                bits = bits + F.when(F.get(p, j + F.lit(edits - (width - 1) + k)) == char, F.lit(1 << k)).otherwise(F.lit(0))
            return bits

        def step(s: Column, x: Column) -> Column:
            vp, vn, j = s["vp"], s["vn"], s["j"]
            d0 = ((x.bitwiseAND(vp) + vp).bitwiseAND(F.lit(mask)).bitwiseXOR(vp)).bitwiseOR(x).bitwiseOR(vn)
            hp = vn.bitwiseOR(d0.bitwiseOR(vp).bitwiseXOR(F.lit(mask)))
            hn = d0.bitwiseAND(vp)
            half = F.shiftright(d0, 1)
            over = j - (m - F.lit(edits))  # columns since the band reached the last row
            bit = F.greatest(F.lit(width - 2) - over, F.lit(0))
            along = F.when(over < 0, 1 - F.shiftright(d0, width - 1)).otherwise(
                F.call_function("shiftright", hp, bit).bitwiseAND(F.lit(1)) - F.call_function("shiftright", hn, bit).bitwiseAND(F.lit(1)))
            return F.struct(hn.bitwiseOR(half.bitwiseOR(hp).bitwiseXOR(F.lit(mask))).alias("vp"), half.bitwiseAND(hp).alias("vn"),
                            (s["dist"] + along).alias("dist"), (j + 1).alias("j"))

        start = F.struct(F.lit(mask ^ ((1 << (width - edits - 1)) - 1)).alias("vp"), F.lit(0).alias("vn"), F.lit(edits).alias("dist"), F.lit(0).alias("j"))
        return F.aggregate(F.transform(pair["t"], matches), start, step, lambda s: s["dist"]) <= edits

    # an array of one pair, so that the characters are split once and not for each step
    pair = F.array(F.struct(F.split(longer, "").alias("p"), F.split(shorter, "").alias("t"), F.char_length(longer).alias("m")))
    near = F.get(F.transform(pair, banded), F.lit(0))
    return (F.abs(F.char_length(a) - F.char_length(b)) <= edits) & F.when(F.char_length(shorter) > 0, near).otherwise(True)


def triples(line: Column) -> Column:
    """Hashes of the different runs of three characters of a line."""
    def of(chars: Column) -> Column:
        starts = F.when(F.size(chars) >= 3, F.sequence(F.lit(0), F.size(chars) - 3)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(F.get(chars, i), F.get(chars, i + 1), F.get(chars, i + 2)))

    # an array of one array, so that the characters are split once
    return F.array_distinct(F.flatten(F.transform(F.array(F.split(line, "")), of)))


def near_links(docs: DataFrame, table: DataFrame, id_col: str, text_col: str, edits: int, min_chars: int, near_from: int | None = None) -> DataFrame:
    """(a, b): hashes of different lines within `edits` edits, enough of them to connect all such lines. `table` is the documents' `line_table`."""
    lines = line_rows(docs, id_col, text_col, min_chars, near_from is not None).select("h", "line")
    if near_from is not None:
        lines = lines.filter(F.char_length("line") >= near_from)
    keyed = table.filter("keys is not null").select("h", F.explode("keys").alias("key"))
    # copies of one line count once in the least and greatest hash, and are added up before the shuffle
    shared = written(keyed.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high"))
                     .filter("low != high").select("key"), "shared-segments")
    members = written(join_measured(keyed, shared, ["key"], "inner", 60).distinct(), "segment-members")
    counts = [F.char_length("line") - F.char_length(F.translate("line", c, "")) for c in LETTERS]
    texts = (join_measured(lines, members.select("h").distinct(), ["h"], "left_semi", 60)
             .groupBy("h").agg(F.first("line").alias("line")))
    texts = written(texts.select("h", "line", F.char_length("line").alias("size"), *[c.alias(f"c{i}") for i, c in enumerate(counts)]), "lines")
    names = texts.columns[2:]
    rows = written(members.join(texts.drop("line"), "h").withColumnRenamed("h", "id"), "members")

    def near_counts(x: str, y: str) -> Column:
        """An edit changes the length by one at most, and letter counts by two in all."""
        moved = sum((F.abs(fact(x, n) - fact(y, n)) for n in names[1:]), F.lit(0))
        return (F.abs(fact(x, "size") - fact(y, "size")) <= edits) & (moved <= 2 * edits)

    def may(x: str, y: str) -> Column:
        """Moreover it takes three triples of characters at most, and brings three."""
        a, b = fact(x, "seen"), fact(y, "seen")
        changed = flag_count(a["lacks"], b["lacks"], "bitwiseXOR") + flag_count(a["adds"], b["adds"], "bitwiseXOR")
        return near_counts(x, y) & (changed <= 6 * edits)

    def measure(pairs: DataFrame) -> DataFrame:
        both = pairs
        for end in ("a", "b"):
            both = both.join(texts.select(F.col("h").alias(end), F.struct("line", *names).alias(f"x{end}")), end)
        triples_a, triples_b = triples(F.col("xa.line")), triples(F.col("xb.line"))
        both = both.withColumns({"more_a": F.array_except(triples_a, triples_b), "more_b": F.array_except(triples_b, triples_a)})
        near = near_counts("xa", "xb") & (F.size("more_a") + F.size("more_b") <= 6 * edits)
        linked = F.when(near, within_edits(F.col("xa.line"), F.col("xb.line"), edits)).otherwise(False)
        more_a, more_b = flags(F.col("more_a")), flags(F.col("more_b"))
        return both.select("a", "b", linked.alias("linked"), F.struct(more_b.alias("lacks"), more_a.alias("adds")).alias("from_a"),
                           F.struct(more_a.alias("lacks"), more_b.alias("adds")).alias("from_b"))

    return bucket_links(rows, names, -F.col("id"), measure, may,
                        hub_seen=F.struct(no_flags().alias("lacks"), no_flags().alias("adds")))


def line_classes(docs: DataFrame, table: DataFrame, id_col: str, text_col: str, edits: int, min_chars: int, near_from: int | None = None) -> DataFrame:
    """(h, g, n, class, first_id, near) of lines that have a copy or a near copy: how often the line
    stands, the class's number, the smallest id of a document with a line of the class, and whether the class has
    different lines. `table` is the documents' `line_table`."""
    counted = written(table.groupBy("h", "g").agg(F.min("id").alias("first_id"), F.count("*").alias("n")), "line-counts")
    roots = components(near_links(docs, table, id_col, text_col, edits, min_chars, near_from)) if edits else None
    if roots is None:
        return counted.filter("n > 1").select("h", "g", "n", F.col("h").alias("class"), "first_id", F.lit(False).alias("near"))
    roots = written(roots.withColumnRenamed("id", "h"), "line-roots")
    near = join_measured(counted, roots, ["h"], "inner", 60)
    firsts = near.groupBy("root").agg(F.min("first_id").alias("class_first"))
    near = near.join(firsts, "root").select("h", "g", "n", F.col("root").alias("class"), F.col("class_first").alias("first_id"), F.lit(True).alias("near"))
    alone = (join_measured(counted.filter("n > 1"), roots.select("h"), ["h"], "left_anti", 60)
             .select("h", "g", "n", F.col("h").alias("class"), "first_id", F.lit(False).alias("near")))
    return written(near.unionByName(alone), "line-classes")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS,
                    min_chars: int = MIN_CHARS, near_from: int | None = None) -> DataFrame:
    """Documents in a struct column `row`, with their text without repeated lines: row, n_lines, n_dropped,
    n_near, kept_in, text (see `dedupe_lines`)."""
    table = line_table(docs, id_col, text_col, edits, min_chars, near_from)
    classes = line_classes(docs, table, id_col, text_col, edits, min_chars, near_from)
    found = join_salted(table.select("id", "t", "pos", "h", "g"), classes, ["h", "g"], "n",
                        F.xxhash64("id", "pos"), 90).filter("class is not null")
    # a document's rows are placed once; both groupings below keep to that
    grouped = (found.repartition("id", "t").groupBy("id", "t", "class")
               .agg(F.min("pos").alias("first_pos"), F.first("first_id").alias("first_id"), F.first("near").alias("near"),
                    F.collect_set("pos").alias("places")))
    own_first = F.col("first_id") == F.col("id")
    gone = F.when(own_first, F.array_except("places", F.array("first_pos"))).otherwise(F.col("places"))
    drops = (grouped.withColumn("gone", gone).filter(F.size("gone") > 0).groupBy("id", "t")
             .agg(F.flatten(F.collect_list("gone")).alias("gone"),
                  F.sum(F.when(F.col("near"), F.size("gone")).otherwise(0)).alias("n_near"),
                  F.array_sort(F.collect_set("first_id")).alias("kept_in")))
    drops = written(drops, "dropped-lines")
    mean = drops.agg(F.avg(F.size("gone") + F.size("kept_in"))).first()[0] or 0
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[text_col].cast("string").alias("whole"),
                        docs[id_col].cast("long").alias("id")).withColumn("t", F.xxhash64("whole"))
    joined = join_measured(whole, drops, ["id", "t"], "left", int(100 + 12 * mean))
    # arrays of one array, so that a text is split once and not for each line that stays
    split = F.transform(F.array(F.split("whole", "\n")), lambda lines: F.struct(
        lines.alias("lines"), F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone")).alias("left")))
    kept = F.transform(split, lambda t: F.array_join(F.transform(t["left"], lambda i: F.get(t["lines"], i)), "\n"))
    text = F.when(F.col("gone").isNull(), F.col("whole")).otherwise(F.get(kept, F.lit(0)))
    n_lines = F.when(F.col("whole").isNull(), 0).otherwise(F.octet_length("whole") - F.octet_length(F.replace(F.col("whole"), F.lit("\n"), F.lit(""))) + 1).cast("long")
    return joined.select("row", n_lines.alias("n_lines"), F.coalesce(F.size(F.when(F.col("gone").isNotNull(), F.col("gone"))), F.lit(0)).cast("long").alias("n_dropped"),
                         F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                         F.coalesce("kept_in", F.array().cast("array<bigint>")).alias("kept_in"), text.alias("text"))


def dedupe_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS,
                 min_chars: int = MIN_CHARS, near_from: int | None = None) -> DataFrame:
    """Every document without the lines that stand elsewhere first: id, n_lines, n_dropped, n_near, kept_in, text.

    Lines are parted by line feeds; those with fewer than `min_chars` characters always stay. If `near_from` is
    given, lines that hold a letter or a digit count at any length, and edits are looked for from `near_from`
    characters on; only shorter lines without a letter or digit, empty ones too, then always stay. Lines that are
    equal, or linked by steps of at most `edits` edits between lines of the corpus, are a class. Of each class
    the first line stays: in the document with the smallest id, the first one there. n_dropped lines are gone,
    n_near of them from classes of different lines, and kept_in lists the documents that keep theirs (the
    document itself where a line repeats inside it).

    A null text stays null and has no lines; an empty one is one empty line. Documents without an id stay as
    they are, and their lines count nowhere. Equal rows are treated alike, so copies under one id both keep a
    line that is first there. Other columns are not read.
    """
    found = without_repeats(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), "id", "text", edits, min_chars, near_from)
    return found.select(F.col("row.id").alias(id_col), "n_lines", "n_dropped", "n_near", "kept_in", "text")
