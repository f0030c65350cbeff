"""Operator 8: fuzzy line deduplication by MinHash, with DataFrame functions only.

A line's set are its character shingles: SHINGLE characters from each character on, or the whole of a
shorter line. All of them are hashed, each in a row, and dealt into bins; a line's signature are the smallest of its
bins' minima, so one random order over all shingles decides. Two
neighbours in the signature are a band: lines of similarity THRESHOLD share a band with a probability of 0.97 by
simulation, more similar ones with a higher one, wherever in a line the differences lie. A
band's smallest line is the leader of its other lines. Each line is verified with its nearest leader,
links are joined by distributed union-find. Where a leader's lines are then still in several components, each
line meets some of them, the pivots, and is verified with its nearest one; so most near copies are one component.
Then all pairs across components that are left are candidates, whatever the number of lines: they are compared in
tiles. Two filters without error come before a pair's texts are fetched: the sizes, and the distance of parity
sketches, which is never larger than the sets' difference. Candidates are verified by exact Jaccard
similarity of their whole sets, and of each component the first line, by document and place, stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskloom.llm.components import components, extended
from maskloom.llm.shared import broadcast_if_few, forget, fresh_name, saved

#: Characters of a shingle.
SHINGLE = 12
#: Bands of two neighbouring minima, and the minima that they need.
BANDS = 6
MINIMA = BANDS + 1
#: Bins of a signature, a power of two, and shingles of a line that are put into bins at first, by the smallest hashes.
BINS, KEPT = 16, 24
#: Links have a Jaccard similarity of so many hundredths at least.
THRESHOLD = 75
#: Numbers of 64 bits in a sketch, a power of two.
WORDS = 16
#: Lines of a side of a tile, in which pairs across components are compared.
TILE = 1000
#: Pivots of a leader, and rounds in which each line is verified with its nearest candidate before all others.
PIVOTS, NEAREST_ROUNDS = 8, 1
#: White space at the ends of lines.
BLANKS = " \t\n\x0b\f\r"


def normal(line: Column) -> Column:
    """What is compared of a line: its characters in lower case, without white space at the ends."""
    return F.lower(F.btrim(line, F.lit(BLANKS)))


def _shingles(norm: Column) -> Column:
    every = F.regexp_extract_all(norm, F.lit(rf"(?s)(?=(.{{{SHINGLE}}}))."), F.lit(1))
    return F.when(F.length(norm) < SHINGLE, F.array(norm)).otherwise(every)


def shingle_hashes(norm: Column) -> Column:
    """Hashes of the character shingles of a normal line."""
    return F.array_distinct(F.transform(_shingles(norm), lambda s: F.xxhash64(s)))


def _hashed(lines: DataFrame, kept: int | None = None) -> DataFrame:
    """line_id, bound and h, the hash of a shingle: a row for each shingle of lines(line_id, norm), repeats too. With kept
    only hashes up to a bound, which about so many of a line's shingles keep; bound is null where none is needed. A line's
    first row stays, with null for a hash beyond the bound, so that each line has one."""
    # four bytes a character: a shingle is found without walking through the line
    rows = lines.select("line_id", F.encode("norm", "UTF-32").alias("code"))
    rows = rows.withColumn("n", F.greatest(F.octet_length("code") / 4 - (SHINGLE - 1), F.lit(1)).cast("int"))
    bound = F.expr(f"IF(n > {kept}, cast({-(2**63)}d + {2**64}d * {kept} / n AS long), NULL)") if kept else F.lit(None).cast("long")
    rows = rows.select("line_id", "code", bound.alias("bound"), F.explode(F.sequence(F.lit(1), 4 * F.col("n") - 3, F.lit(4))).alias("at"))
    rows = rows.select("line_id", "bound", "at", F.xxhash64(F.substring("code", F.col("at"), F.lit(4 * SHINGLE))).alias("h"))
    rows = rows.filter("bound IS NULL OR h <= bound OR at = 1")
    return rows.select("line_id", "bound", F.expr("IF(bound IS NULL OR h <= bound, h, NULL)").alias("h"))


def _minima(hashed: DataFrame) -> DataFrame:
    """line_id, bound and minima: the smallest hash of each bin that has one, in order."""
    bins = [F.min(F.expr(f"IF(h & {BINS - 1} = {k}, h, NULL)")).alias(f"m{k}") for k in range(BINS)]
    rows = hashed.groupBy("line_id").agg(F.max("bound").alias("bound"), *bins)
    return rows.select("line_id", "bound", F.sort_array(F.array_compact(F.array(*(f"m{k}" for k in range(BINS))))).alias("minima"))


def signatures(lines: DataFrame) -> DataFrame:
    """line_id, bands of lines(line_id, norm), a row for each line_id: each two neighbours of the MINIMA smallest minima,
    null where there are fewer; a set of one shingle has one band."""
    at = lambda k: F.get("minima", F.lit(k))
    pair = lambda k: F.when(at(k + 1).isNotNull(), F.xxhash64(at(k), at(k + 1)))
    bands = F.array(F.xxhash64(at(0), F.coalesce(at(1), F.lit(0))), *(pair(k) for k in range(1, BANDS))).alias("bands")
    # a bin without a hash up to the bound has a larger minimum, so MINIMA bins with one tell the signature
    few = F.col("bound").isNotNull() & (F.size("minima") < MINIMA)
    found = saved(_minima(_hashed(lines, KEPT)).select("line_id", few.alias("few"), bands), "line-bands")
    rest = found.filter("few").select("line_id")
    found = found.filter("NOT few").select("line_id", "bands")
    if rest.isEmpty():
        return found
    # lines that repeat themselves very much
    whole = _minima(_hashed(lines.join(broadcast_if_few(rest), "line_id", "left_semi")))
    return found.union(saved(whole.select("line_id", bands), "line-bands"))


def with_bands(df: DataFrame, norm: str = "norm") -> DataFrame:
    """df with the bands of the column norm, replaced if there."""
    key, line = fresh_name(df, "line_id"), F.col(norm)
    found = signatures(df.select(F.xxhash64(line).alias("line_id"), line.alias("norm"))).withColumnRenamed("line_id", key)
    return df.drop("bands").withColumn(key, F.xxhash64(line)).join(found, key, "left").drop(key)


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, pos, norm, line_id of each line that is not blank."""
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line"))
    # what is filtered is computed once more, so without lower()
    rows = rows.filter(F.btrim("line", F.lit(BLANKS)) != "").select("doc_id", "row_key", "pos", normal(F.col("line")).alias("norm"))
    return rows.withColumn("line_id", F.xxhash64("norm"))


def duplicate_lines(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, row_key, pos, line_id, kept: each line of docs(doc_id, text) that is not blank. row_key tells rows
    with equal doc_id apart. Rows that are equal in both are one document, whose lines count once."""
    found = saved(_lines(docs.select("doc_id", "text")), "lines")
    labels = _components(found, threshold)
    place = F.struct(F.col("doc_id").isNull().alias("without"), F.col("doc_id").alias("doc_id"), F.col("row_key").alias("row_key"), F.col("pos").alias("pos"))
    classes = found.groupBy("line_id").agg(F.count("*").alias("n"), F.min(place).alias("first"))
    classes = saved(classes.join(labels.withColumnRenamed("node", "line_id"), "line_id", "left").filter("n > 1 OR component IS NOT NULL").drop("n"), "line-classes")
    firsts = classes.filter("component IS NOT NULL").groupBy("component").agg(F.min("first").alias("keeper"))
    keepers = classes.join(firsts, "component", "left").select("line_id", F.coalesce("keeper", "first").alias("keeper"))
    # a line that occurs once and links with nothing has no keeper
    return found.join(keepers, "line_id", "left").select("doc_id", "row_key", "pos", "line_id", F.coalesce(place == F.col("keeper"), F.lit(True)).alias("kept"))


def _components(found: DataFrame, threshold: int) -> DataFrame:
    """(node, component) of the line_ids that the links within bands connect."""
    banded = signatures(found).select("line_id", F.explode("bands").alias("band")).filter("band IS NOT NULL")
    leaders = banded.groupBy("band").agg(F.min("line_id").alias("lead"), F.max("line_id").alias("last")).filter("lead <> last").select("band", "lead")
    leaders = saved(leaders, "line-bands")
    stars = saved(banded.join(broadcast_if_few(leaders), "band").filter("lead <> line_id").select("lead", "line_id").distinct(), "line-stars")
    texts = _texts(found, stars.select("line_id").union(stars.select("lead")).distinct())
    sketches = saved(_sketches(texts), "line-sketches")
    one = lambda s: sketches.select(F.col("line_id").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in _SKETCH))
    pairs = stars.select(F.col("lead").alias("a"), F.col("line_id").alias("b")).join(one("a"), "a").join(one("b"), "b").filter(_fits(threshold))
    compared = saved(_nearest(pairs.select("a", "b", _apart().alias("apart"))), "line-nearest")
    labels = components(saved(_links(texts, compared, threshold), "line-links"))
    near = saved(_nearest(_to_pivots(_crowds(stars, sketches, labels), threshold)).join(compared, ["a", "b"], "left_anti"), "line-nearest")
    if not near.isEmpty():
        labels = extended(labels, saved(_links(texts, near, threshold), "line-links"))
    left = saved(_across(_crowds(stars, sketches, labels), threshold).join(compared.union(near), ["a", "b"], "left_anti"), "line-pairs")
    forget(leaders, stars, sketches)
    for k in range(NEAREST_ROUNDS + 1):
        if left.isEmpty():
            break
        # the nearest line of each first: most of the others are then in one component
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b"), "apart"))
        tried = saved(_nearest(both) if k < NEAREST_ROUNDS else left.select("a", "b"), "line-nearest")
        labels = extended(labels, saved(_links(texts, tried, threshold), "line-links"))
        end = lambda s: labels.select(F.col("node").alias(s), F.col("component").alias(f"component_{s}"))  # noqa: B023, E731
        open_ = left.join(end("a"), "a", "left").join(end("b"), "b", "left").filter("coalesce(component_a, a) <> coalesce(component_b, b)")
        left = saved(open_.select("a", "b", "apart").join(tried, ["a", "b"], "left_anti"), "line-pairs")
    return labels


def _texts(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """line_id, norm of the wanted lines, a row for each."""
    wanted = saved(wanted, "line-ends")
    texts = found.select("line_id", "norm").join(broadcast_if_few(wanted), "line_id", "left_semi").groupBy("line_id").agg(F.first("norm").alias("norm"))
    return saved(texts, "line-texts")


def _sketches(texts: DataFrame) -> DataFrame:
    """line_id, size, w0, w1, ...: the size of a set and, for each bit, the parity of the hashes that fall on it. Two
    sketches never differ in more bits than their sets in elements."""
    each = texts.select("line_id", F.explode(shingle_hashes(F.col("norm"))).alias("h"))
    each = each.select("line_id", F.expr(f"h & {WORDS - 1}").alias("word"), F.expr(f"shiftleft(1L, cast(shiftright(h, {WORDS.bit_length() - 1}) & 63 AS int))").alias("bit"))
    return each.groupBy("line_id").agg(F.count("*").alias("size"), *(F.expr(f"bit_xor(IF(word = {k}, bit, 0L))").alias(f"w{k}") for k in range(WORDS)))


_SKETCH = ("size", *(f"w{k}" for k in range(WORDS)))


def _apart() -> Column:
    """In how many bits the sketches of a pair differ."""
    bits = [F.bit_count(F.col(f"w{k}_a").bitwiseXOR(F.col(f"w{k}_b"))) for k in range(WORDS)]
    return sum(bits[1:], bits[0])


def _fits(threshold: int) -> Column:
    """Whether sizes and sketches of a pair allow a link."""
    sizes = 100 * F.least("size_a", "size_b") >= threshold * F.greatest("size_a", "size_b")
    return sizes & ((100 + threshold) * _apart() <= (100 - threshold) * (F.col("size_a") + F.col("size_b")))


def _nearest(pairs: DataFrame) -> DataFrame:
    """Of pairs (a, b, apart) the nearest a of each b, as (a, b) with the smaller one first."""
    nearest = pairs.groupBy("b").agg(F.min(F.struct("apart", "a")).alias("to"))
    return nearest.select(F.least("to.a", "b").alias("a"), F.greatest("to.a", "b").alias("b")).distinct()


def _crowds(stars: DataFrame, sketches: DataFrame, labels: DataFrame) -> DataFrame:
    """lead, home, tiles, line_id, leads, component and sketch of the lines, the leader among them, of each leader whose
    lines are in several components. home: the leader's component; tiles: in how many parts its lines are compared;
    leads: all these leaders of a line, BANDS and itself at most."""
    rows = saved(sketches.join(labels.withColumnRenamed("node", "line_id"), "line_id", "left").withColumn("component", F.coalesce("component", "line_id")), "line-components")
    near = stars.join(rows.select("line_id", "component"), "line_id")
    home = rows.select(F.col("line_id").alias("lead"), F.col("component").alias("home"))
    spans = near.groupBy("lead").agg(F.count("*").alias("n"), F.min("component").alias("least"), F.max("component").alias("most")).join(home, "lead")
    spans = saved(spans.filter("least <> home OR most <> home").select("lead", "home", F.ceil((F.col("n") + 1) / TILE).cast("int").alias("tiles")), "line-spans")
    members = stars.join(spans, "lead").union(spans.select("lead", F.col("lead").alias("line_id"), "home", "tiles"))
    members = members.withColumn("leads", F.collect_list("lead").over(Window.partitionBy("line_id")))
    return saved(members.join(rows, "line_id"), "line-crowds")


def _tile() -> Column:
    return F.pmod(F.xxhash64("line_id"), F.col("tiles")).cast("int")


def _every_tile() -> Column:
    return F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))


def _side(s: str, *more: str) -> list[Column]:
    return [F.col(c).alias(d) for c, d in (("line_id", s), *((c, f"{c}_{s}") for c in (*_SKETCH, "component", *more)))]


def _to_pivots(members: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b, apart) of lines in two components that the sketches allow, a being one of some lines of its leader:
    the smallest of each of so many parts. The pairs grow with the number of lines."""
    chosen = members.filter("line_id <> lead").groupBy("lead", F.pmod(F.xxhash64("line_id"), F.lit(PIVOTS)).alias("part")).agg(F.min("line_id").alias("line_id")).select("lead", "line_id")
    ones = members.join(chosen, ["lead", "line_id"]).select("lead", _every_tile().alias("row"), *_side("a"))
    met = ones.join(members.select("lead", _tile().alias("row"), *_side("b")), ["lead", "row"]).filter("component_a <> component_b").filter(_fits(threshold))
    return met.select("a", "b", _apart().alias("apart"))


def _across(members: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b, apart) of lines of one leader, but in two components, that the sketches allow. The lines outside of
    the leader's component are compared with all its lines, in tiles of about TILE by TILE lines. A pair of several
    leaders is told once, by the smallest of them."""
    ones = members.filter("component <> home").select("lead", _tile().alias("row"), _every_tile().alias("column"), *_side("a", "leads"))
    others = members.select("lead", _tile().alias("column"), _every_tile().alias("row"), *_side("b", "home", "leads"))
    # of two lines outside of the leader's component each meets the other once
    met = ones.join(others, ["lead", "row", "column"]).filter("component_a <> component_b AND (component_b = home_b OR a < b)").filter(_fits(threshold))
    met = met.filter("array_min(array_intersect(leads_a, leads_b)) = lead")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), _apart().alias("apart"))


def _links(texts: DataFrame, pairs: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough. Texts travel to the pairs, as they are much smaller than sets."""
    side = lambda c: texts.select(F.col("line_id").alias(c), F.col("norm").alias(f"norm_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.select("a", "b", shingle_hashes(F.col("norm_a")).alias("one"), shingle_hashes(F.col("norm_b")).alias("other"))
    both = both.select("a", "b", F.size("one").alias("na"), F.size("other").alias("nb"), F.size(F.array_intersect("one", "other")).alias("shared"))
    return both.filter(100 * F.col("shared") >= threshold * (F.col("na") + F.col("nb") - F.col("shared"))).select("a", "b")


def deduplicated(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """docs with text without its duplicate lines, and the columns n_lines and n_removed (replaced if there).

    Every row stays; blank lines stay where they are; a document whose lines are all duplicates keeps an empty
    text or its blank lines. Null text stays null and has no line. An empty table gives an empty result.
    """
    key, gone, parts = (fresh_name(docs, name) for name in ("row_key", "gone", "parts"))
    lost = saved(duplicate_lines(docs, threshold).filter("NOT kept").select("row_key", "pos"), "line-duplicates")
    lost = broadcast_if_few(lost.groupBy(F.col("row_key").alias(key)).agg(F.collect_set("pos").alias(gone)), lost)
    rows = docs.withColumn(key, F.xxhash64("doc_id", "text")).join(lost, key, "left")
    rows = rows.withColumn(parts, F.when(F.col(gone).isNotNull(), F.split(F.col("text"), "\n", -1)))
    left = F.sort_array(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(gone)))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda k: F.get(parts, k)), "\n"))
    n_lines = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1
    counts = {"n_lines": F.coalesce(n_lines, F.lit(0)).cast("long"), "n_removed": F.greatest(F.coalesce(F.size(gone), F.lit(0)), F.lit(0)).cast("long")}
    return rows.withColumns(counts).withColumn("text", text).drop(key, gone, parts)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, text: the documents without their duplicate lines."""
    return deduplicated(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")
