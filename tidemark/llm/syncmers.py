"""Document fingerprints of closed syncmers, in DataFrame expressions alone.

A text is the sequence of the bytes of its lower-cased UTF-8.  Of its runs of RUN bytes,
those are closed syncmers whose smallest inner substring (of INNER bytes; the first of
them on ties) lies at an edge.  Inner substrings are ordered by the ranks of their bytes, the first byte first;
letters that are rare in Latin script come first, so that one run seldom holds the
smallest twice (of the second byte, COARSE ranks count as one).  Whether a run is chosen depends on its own bytes alone, so the same
passage gives the same anchors in any context.  Before its start a text has padding that
is smaller than anything: the runs that reach into it are chosen as well, so that texts
of any length have anchors, made by one rule.

An anchor is the hash of a chosen run, its place the byte at which the smallest inner
substring lies (0 for runs that reach into the padding).  Texts are matched by place in
two ways: shifts() compares anchors at the same place, after one shift for which shared
anchors vote; compare_edited() takes the distance to the next place into the hash, so that
anchors match where what follows lies as far away, wherever they have moved to.

One pass of a regular expression finds the runs: it looks ahead and behind from each
byte, and writes the runs found there beside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, stash

#: Bytes in a run and in its inner substrings; about 2 of RUN - INNER + 1 runs are chosen.
RUN, INNER = 48, 2

#: Ranks of letters and of the blank, smallest first; any other byte has the rank of its bits 3 to 6.
RANKS = ("jqxz", "k", "w", "v", "y", "b", "f", "p", "g", "h", "c", "m", "u", "dlo", "nrs", "aeit ")
#: So many ranks of a second byte count as one.
COARSE = 4
#: In most texts every run has a byte of a rank below this.
COMMON = 13

#: Shared anchors that vote for a shift: those of the lowest hashes, so the same whatever the texts' lengths.
VOTES = 15

#: Gaps that are summed together when places are made from gaps.
SUM_BLOCK = 16

#: Set each found place apart; no byte of a text becomes one of them.
_PLACE, _FIELD = "Ā", "ā"


def rank(byte: int) -> int:
    return next((r for r, letters in enumerate(RANKS) if chr(byte) in letters), byte >> 3 & 15)


def order(inner: bytes) -> tuple[int, int]:
    """Where an inner substring comes in order."""
    return rank(inner[0]), rank(inner[1]) // COARSE


def _bytes(*ranks: int) -> str:
    """A character class of the bytes of these ranks, one by one (regular expressions look those up in a table, ranges they try in turn)."""
    own = [b for b in range(256) if rank(b) in ranks]
    out = [b for b in range(256) if rank(b) not in ranks]
    few = own if len(own) <= len(out) else out
    return "[" + "^" * (few is out) + "".join(chr(b) if b >= 128 or chr(b).isalnum() else f"\\x{b:02x}" for b in few) + "]" if few else "."


def closed_pattern(run: int = RUN, ranks: int = len(RANKS)) -> str:
    """Matches a byte of one of the first ranks at which the smallest two-byte substring of a run lies that begins there (group 1) or ends with it (groups 2 and 3, or 4 and 5).

    For a substring in place (i, j): the other first bytes in the run are of rank i at
    least, and none of rank i is followed by one that comes before j (at the end of a run:
    nor by one that is level with j, as the first of the smallest counts).
    """
    n, top = run - INNER, len(RANKS)
    seconds = [(at, at + COARSE) for at in range(0, top, COARSE)]

    def edge(others: str, lower: str, upto: int) -> str:
        each = []
        for i in range(ranks):
            ties = [f"(?={_bytes(*range(*j))})" + (lower.format(pair=_bytes(i) + _bytes(*range(j[upto]))) if j[upto] else "") for j in seconds]
            each.append(_bytes(i) + others.format(least=_bytes(*range(i, top))) + f"(?:{'|'.join(ties)})")
        return f"(?:{'|'.join(reversed(each))})"

    begins = edge(f"(?={{least}}{{{{{n}}}}}.)", f"(?!.{{{{0,{n - 1}}}}}{{pair}})", 0)
    ends = edge(f"(?<={{least}}{{{{{n}}}}}.)", f"(?<!{{pair}}.{{{{0,{n - 1}}}}})", 1) + f"(?<=(.{{{run - 1}}}))(?=(.))"
    return f"(?s)(?={_bytes(*range(ranks))})(?:(?={begins})(?=(.{{{run}}}))(?:{ends}|.)|{ends})"


def marked(raw: str, run: int = RUN) -> Column:
    """A text of bytes with the runs found at each place written before it.

    Where no run - 1 bytes in a row are of rank COMMON or above, the smallest substring of
    any run begins with a lower rank, so that most bytes need no look around.
    """
    low, high = _bytes(*range(COMMON)), _bytes(*range(COMMON, len(RANKS)))
    bare = F.col(raw).rlike(f"(?s)^(?:{high}{{0,{run - 2}}}+{low})*+{high}{{{run - 1}}}")
    found = (F.regexp_replace(raw, closed_pattern(run, ranks), f"{_PLACE}$1{_FIELD}$2$3$4$5{_FIELD}$0") for ranks in (len(RANKS), COMMON))
    return F.when(bare, next(found)).otherwise(next(found))


def with_anchors(docs: DataFrame, text: str, anchors: str, gaps: str | None, run: int = RUN) -> DataFrame:
    """docs with the anchors of a whole text (array<int>, in order of place) and the bytes from each one's place to the next one's.

    Without a name for the gaps, they go into the hashes.
    A null or empty text has none.  run is 65 at most, so that a byte holds a gap: of
    run - INNER runs in a row at least one is chosen.  Columns are added one at a time: an expression inside a
    lambda would be evaluated again for every element.
    """
    raw, parts = (fresh(docs.columns, name) for name in ("_raw", "_parts"))
    found = docs.withColumn(raw, F.decode(F.lower(F.coalesce(text, F.lit(""))).cast("binary"), "ISO-8859-1"))
    found = found.withColumn(parts, F.transform(F.split(marked(raw, run), _PLACE), lambda x: F.split(x, _FIELD)))
    begun = F.sequence(F.lit(1), F.least(F.char_length(raw), F.lit(run - 1)))
    first = F.transform(begun, lambda i: F.hash(F.left(raw, i)))
    # The first part is what comes before the first place found; each other one: run that begins, run that ends, bytes to the next place.
    later = F.slice(parts, 2, F.size(parts))
    if gaps is None:
        hashes = F.transform(later, lambda p: F.when(p[0] == "", F.array(F.hash(p[1], F.char_length(p[2])))).when(p[1] == "", F.array(F.hash(p[0], F.char_length(p[2])))).otherwise(F.array(F.hash(p[0], F.lit(0)), F.hash(p[1], F.char_length(p[2])))))
        return found.withColumn(anchors, F.when(F.col(raw) != "", F.concat(first, F.flatten(hashes))).otherwise(F.array().cast("array<int>"))).drop(raw, parts)
    hashes = F.transform(later, lambda p: F.when(p[0] == "", F.array(F.hash(p[1]))).when(p[1] == "", F.array(F.hash(p[0]))).otherwise(F.array(F.hash(p[0]), F.hash(p[1]))))
    start = F.concat(F.array_repeat(F.lit(0).cast("byte"), F.size(first) - 1), F.array(F.char_length(F.col(parts)[0][0]).cast("byte")))
    apart = F.transform(later, lambda p: F.when((p[0] == "") | (p[1] == ""), F.array(F.char_length(p[2]).cast("byte"))).otherwise(F.array(F.lit(0).cast("byte"), F.char_length(p[2]).cast("byte"))))
    some = F.col(raw) != ""
    none = F.array().cast("array<int>"), F.array().cast("array<tinyint>")
    return found.withColumns({anchors: F.when(some, F.concat(first, F.flatten(hashes))).otherwise(none[0]), gaps: F.when(some, F.concat(start, F.flatten(apart))).otherwise(none[1])}).drop(raw, parts)


def _sums(numbers: Column, start: Column) -> Column:
    """start, and start plus the sum of the numbers up to each one."""
    return F.aggregate(numbers, F.array(start.cast("int")), lambda found, x: F.array_append(found, F.element_at(found, -1) + x.cast("int")))


def with_places(docs: DataFrame, gaps: str, places: str) -> DataFrame:
    """docs with the places (array<int>) that gaps lead to; blocks of gaps are summed alone and then moved, so that long texts take linear time."""
    blocks, sums = fresh(docs.columns, "_blocks"), fresh(docs.columns, "_sums")
    n = F.size(gaps)
    found = docs.withColumn(blocks, F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), (n - 1).bitwiseAND(-SUM_BLOCK)), F.lit(SUM_BLOCK)), lambda i: F.slice(gaps, i + 1, SUM_BLOCK)))
    totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda s, x: s + x.cast("int")))
    found = found.withColumn(sums, _sums(totals, F.lit(0)))
    moved = F.zip_with(blocks, F.slice(sums, 1, F.size(blocks)), lambda b, at: F.slice(_sums(b, at), 1, F.size(b)))
    return found.withColumn(places, F.flatten(moved)).drop(blocks, sums)


def as_string(hashes: Column) -> Column:
    """Eight hexadecimal digits an anchor, in order; empty without anchors."""
    return F.concat_ws("", F.transform(hashes, lambda h: F.lpad(F.lower(F.hex(h.cast("long").bitwiseAND(0xFFFFFFFF))), 8, "0")))


def likeness(a: Column, b: Column) -> Column:
    """Shared anchors over all anchors of two fingerprints; 1 for two without anchors, 0 for one without."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def with_likeness(docs: DataFrame, a: tuple[str, str], b: tuple[str, str], out: str, shift: str) -> DataFrame:
    """docs with the likeness of two fingerprints, given as (anchors, places), and the shift that it is measured at.

    shift is what shared anchors say most in the middle (the lower median of places in b
    less those in a, of the first occurrences of up to VOTES anchors; null if none is
    shared).  likeness is the number of (place, anchor) that both have, of all they have:
    1 for two without anchors, 0 if no anchor is shared.
    """
    shared, own, other = (fresh(docs.columns, name) for name in ("_shared", "_own", "_other"))
    found = docs.withColumn(shared, F.slice(F.sort_array(F.array_intersect(a[0], b[0])), 1, VOTES))
    votes = F.sort_array(F.transform(shared, lambda h: F.col(b[1])[(F.array_position(b[0], h) - 1).cast("int")] - F.col(a[1])[(F.array_position(a[0], h) - 1).cast("int")]))
    found = found.withColumn(shift, F.when(F.size(shared) > 0, F.element_at(votes, F.greatest(F.lit(1), (F.size(votes) + 1).bitwiseAND(-2) / 2).cast("int"))))

    def placed(side: tuple[str, str], by: Column) -> Column:
        return F.zip_with(side[0], side[1], lambda h, p: F.shiftleft((p + by).cast("long"), 32).bitwiseOR(h.cast("long").bitwiseAND(0xFFFFFFFF)))

    found = found.withColumns({own: placed(a, F.coalesce(shift, F.lit(0))), other: placed(b, F.lit(0))})
    common = F.size(F.array_intersect(own, other))
    every = F.size(F.array_union(own, other))
    return found.withColumn(out, F.when(every == 0, F.lit(1.0)).when(F.col(shift).isNull(), F.lit(0.0)).otherwise(common / every)).drop(shared, own, other)


def fingerprint(docs: DataFrame, run: int = RUN) -> DataFrame:
    """doc_id, places array<int>, anchors array<int>, fingerprint string of every whole text of docs(doc_id, text).

    A null or empty text has no anchors and an empty fingerprint; null ids and repeated
    rows are treated like any other; other columns are ignored.
    """
    found = with_anchors(docs.select(F.col("doc_id").cast("long"), "text"), "text", "anchors", "gaps", run)
    return with_places(found, "gaps", "places").select("doc_id", "places", "anchors", as_string(F.col("anchors")).alias("fingerprint"))


def shifts(pairs: DataFrame) -> DataFrame:
    """How far passages moved: pairs(a, b: struct<places, anchors>, any other columns) with shift and likeness (see with_likeness).

    Columns of pairs that are called shift or likeness are replaced.
    """
    names = {(s, k): fresh(pairs.columns, f"_{s}_{k}") for s in "ab" for k in ("anchors", "places")}
    flat = pairs.withColumns({v: F.col(s)[k] for (s, k), v in names.items()})
    return with_likeness(flat, (names["a", "anchors"], names["a", "places"]), (names["b", "anchors"], names["b", "places"]), "likeness", "shift").drop(*names.values())


def successors(ids: DataFrame) -> DataFrame:
    """doc_id, next_id, prev_id, prev_chars, spread (always 0) over the distinct known ids of ids(doc_id, n_chars), ascending.

    The next of the last is the first.  Ids are range-partitioned; each part orders its
    own, and only the parts' first and last ids meet, one row a part.  The parts are
    written once, so that both readers see the same ones.
    """
    distinct = ids.filter("doc_id is not null").groupBy("doc_id").agg(F.max("n_chars").alias("n_chars"))
    parts = distinct.repartitionByRange("doc_id").withColumn("part", F.spark_partition_id())
    # A part's rows are kept together by its number.
    own = Window.partitionBy("part").orderBy("doc_id")
    placed = stash(parts.select("*", F.lit(0).alias("spread"), F.lead("doc_id").over(own).alias("next_id"), F.lag("doc_id").over(own).alias("prev_id"), F.lag("n_chars").over(own).alias("prev_chars")), "id-order")
    ends = placed.groupBy("part").agg(F.min("doc_id").alias("first_id"), F.max(F.struct("doc_id", "n_chars")).alias("last"))
    around = Window.orderBy("part")
    everywhere = Window.partitionBy()
    ends = ends.select(
        "part",
        F.coalesce(F.lead("first_id").over(around), F.min("first_id").over(everywhere)).alias("after"),
        F.coalesce(F.lag("last").over(around), F.max("last").over(everywhere)).alias("before"),
    )
    # One row for each partition.
    full = placed.join(F.broadcast(ends), "part")
    return full.select("doc_id", "spread", F.coalesce("next_id", "after").alias("next_id"), F.coalesce("prev_id", "before.doc_id").alias("prev_id"), F.coalesce("prev_chars", "before.n_chars").alias("prev_chars"))


def compare_edited(docs: DataFrame, run: int = RUN) -> DataFrame:
    """Fingerprints of every whole text of docs(doc_id, text) and of its edited text, and their likenesses.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as
    many (or all) of the next document's text.  Returns doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint (of anchors with their gaps), near_edited, near_next.

    A null text counts as empty: its fingerprint is the empty string, alike (1) to another
    empty one.  The next document is that of the next known id (after the last: the
    first); of rows that share an id, the one whose beginning is least is next, and each
    of them has its own edited text.  A null id has no next document: its tail is dropped
    and it is compared with the empty text; such rows are dealt by the partition that
    they come from.  A single document follows itself.  Other columns are ignored.
    """
    known = F.col("doc_id").isNotNull()
    # Null ids match nothing, as the spread of known ids is 0.  (That 0 is read from a table: of a literal, Spark would make a filter, and shuffle twice.)
    keys = F.coalesce("doc_id", F.lit(0)).cast("long"), F.when(known, 0).otherwise(F.spark_partition_id() + 1)
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    order = successors(docs.select("doc_id", F.char_length("text").alias("n_chars")))
    # Shuffled once by id, fingerprints with it: both joins below read that exchange.
    made = with_anchors(docs.select(keys[0].alias("key"), keys[1].alias("spread"), "text"), "text", "anchors", None, run).repartition("key", "spread")
    order = order.withColumnRenamed("doc_id", "key")
    heads = made.join(order, ["key", "spread"]).select(F.col("prev_id").alias("key"), "spread", F.struct(F.expr("left(text, cast(prev_chars div 4 as int))").alias("head"), "anchors").alias("next"))
    heads = heads.groupBy("key", "spread").agg(F.min("next").alias("next"))
    both = made.join(heads, ["key", "spread"], "left").withColumn("n_chars", F.char_length("text"))
    own = both.withColumn("cut", F.expr("n_chars - n_chars div 4").cast("int"))
    head = F.coalesce(F.expr("left(next.head, cast(n_chars div 4 as int))"), F.lit(""))
    edited = own.select(F.when(F.col("spread") == 0, F.col("key")).alias("doc_id"), "n_chars", "anchors", F.coalesce("next.anchors", F.array().cast("array<int>")).alias("next_anchors"), F.concat(F.expr("left(text, cut)"), head).alias("edited"))
    found = with_anchors(edited, "edited", "edited_anchors", None, run)
    return found.select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_string(F.col("anchors")).alias("fingerprint"),
        as_string(F.col("edited_anchors")).alias("edited_fingerprint"),
        likeness(F.col("anchors"), F.col("edited_anchors")).alias("near_edited"),
        likeness(F.col("anchors"), F.col("next_anchors")).alias("near_next"),
    )
