"""Mixing sources to target weights by a low-discrepancy schedule.

The words of a source, its documents in the order of a hash, are one stream, cut into blocks of equal length, which are shuffled. The mix is a sequence
of slots of one block each. Slot i has the i-th van der Corput point, mapped through the sources' cumulated targets; so any run of slots holds the
sources in nearly the target's proportions. The k-th slot of a source takes its k-th shuffled block, and begins again once all are taken.
A source gets slots until its target is met exactly: what the sequence gives it beyond is left out, what it lacks comes at the end.

DataFrame functions only. Nothing is ranked or summed up over a whole source in one task: places are worked out within leaves of bounded size
and the leaves' totals are summed up in the same way (``preceding``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, numbered, small

#: Leaves whose totals are summed up in one window, and rows of a leaf as expected.
WIDTH = 1024
#: Copies of a row that one task writes out.
COPIES = 4096


def preceding(rows: DataFrame, keys: list[str], leaf: str, order: list[str], value: str, leaves: int) -> DataFrame:
    """``rows`` and ``before``: the sum of ``value`` over the rows of the same keys that come earlier by (leaf, order).

    Leaves are numbered below ``leaves``; a leaf's rows of one key meet in one task, and the totals of WIDTH leaves do.
    """
    earlier = Window.partitionBy(*keys, leaf).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumn("before", F.coalesce(F.sum(value).over(earlier), F.lit(0)))
    if leaves <= 1:
        return own
    totals = rows.groupBy(*keys, leaf).agg(F.sum(value).alias("total")).withColumn(f"{leaf}_", F.floor(F.col(leaf) / WIDTH))
    upper = preceding(totals, keys, f"{leaf}_", [leaf], "total", -(-leaves // WIDTH)).select(*keys, leaf, F.col("before").alias("base"))
    return own.join(upper, [*keys, leaf]).withColumn("before", F.col("before") + F.col("base")).drop("base")


def hashed(*parts: Column) -> Column:
    """MD5 of the parts, as SQL engines agree on."""
    return F.md5(F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))


def leaf_of(h: Column, leaves: int) -> Column:
    """The leaf of a hash; leaves follow the order of the hashes."""
    return F.floor(F.conv(F.substring(h, 1, 8), 16, 10).cast("long") * leaves / (1 << 32))


def targets(sources: DataFrame, budget: float, most: int) -> DataFrame:
    """``sources`` (weight, source_size) and their ``target``: shares of budget times all sizes by weight, each at most ``most`` times its size.

    Excess is shared out again among those below; each round is one aggregate and stops further sources.
    """
    stop, level, stopped = F.lit(most) * F.col("source_size"), 0.0, -1
    wanted = budget * (sources.agg(F.sum("source_size")).first()[0] or 0)
    while True:
        at_stop = F.col("weight") * F.lit(level) >= stop
        n, full, open_ = sources.agg(F.count(F.when(at_stop, 1)), F.sum(F.when(at_stop, stop)), F.sum(F.when(~at_stop, F.col("weight")))).first()
        if n == stopped or not open_:
            return sources.withColumn("target", F.when(at_stop, stop.cast("double")).otherwise(F.col("weight") * F.lit(level)))
        level, stopped = (wanted - (full or 0)) / open_, n


def radical_inverse(i: Column, bits: int) -> Column:
    """The van der Corput point of ``i`` in base two, below one."""
    return F.conv(F.reverse(F.lpad(F.bin(i), bits, "0")), 2, 10).cast("long") / float(1 << bits)


def slots(sources: DataFrame, block: int) -> DataFrame:
    """(s, slot, turn, room): which block in shuffled order each slot takes, and how many of its words at most."""
    spark = sources.sparkSession
    n_sources, words = sources.agg(F.count("*"), F.sum("goal")).first()
    words = words or 0
    total = -(-words // block)
    open_ = preceding(sources.where("goal > 0").withColumn("leaf", F.floor(F.col("s") / WIDTH)), [], "leaf", ["s"], "goal", -(-n_sources // WIDTH))
    # An as-of join of points to the ranges of the sources: in cells of the line, each source at its beginning there.
    cell = max(1, -(-words // max(1, total // WIDTH)))
    cells = F.sequence(F.floor(F.col("before") / cell), F.floor((F.col("before") + F.col("goal") - 1) / cell))
    begins = open_.select("s", "before", F.explode(cells).alias("cell")).select("cell", F.greatest("before", F.col("cell") * cell).alias("p"), F.lit(-1).cast("long").alias("slot"), "s")
    bits = max(1, (total - 1).bit_length())
    points = spark.range(total).select(F.floor(radical_inverse(F.col("id"), bits) * F.lit(words)).alias("p"), F.col("id").alias("slot"))
    points = points.select(F.floor(F.col("p") / cell).alias("cell"), "p", "slot", F.lit(None).cast("long").alias("s"))
    last = Window.partitionBy("cell").orderBy("p", "slot").rowsBetween(Window.unboundedPreceding, 0)
    dealt = begins.unionByName(points).withColumn("s", F.last("s", ignorenulls=True).over(last)).where("slot >= 0")
    dealt = cut(dealt.select("s", "slot", F.floor(F.col("slot") / WIDTH).alias("leaf"), F.lit(1).alias("one")))
    ranked = preceding(dealt, ["s"], "leaf", ["slot"], "one", -(-total // WIDTH)).select("s", "slot", F.col("before").alias("k"))

    own = sources.where("goal > 0").select("s", "goal", "source_size")
    blocks = F.ceil(F.col("source_size") / block)
    rest = F.col("goal") % F.col("source_size")
    needed = F.floor(F.col("goal") / F.col("source_size")) * blocks + F.ceil(rest / block)
    own = cut(own.select("*", blocks.alias("blocks"), needed.alias("needed")))
    kept = ranked.join(small(own), "s").where("k < needed")
    had = dealt.groupBy("s").agg(F.count("*").alias("had"))
    lacking = own.join(had, "s", "left").withColumn("had", F.coalesce("had", F.lit(0))).where("had < needed")
    lacking = lacking.select("s", "goal", "source_size", "blocks", "needed", F.explode(F.sequence("had", F.col("needed") - 1)).alias("k"))
    lacking = lacking.withColumn("slot", F.lit(total) + F.col("k") * n_sources + F.col("s"))
    turn = F.col("k") % F.col("blocks")
    done = F.floor(F.col("k") / F.col("blocks")) * F.col("source_size") + turn * block
    return kept.unionByName(lacking.select(*kept.columns)).select("s", "slot", turn.alias("turn"), F.least(F.col("goal") - done, F.lit(block)).alias("room"))


class Mix:
    """The mix of a table: its documents with their places in the streams, and its schedule."""

    def __init__(self, docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), budget: float = 1.5, most: int = 2, block: int = 1024, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"):
        """Sources in the order of their code points, null last, have the weights in turn. ``budget`` is a multiple of all words, ``most``
        how often a document is taken at most; a document's size is its number of words, zero for a null text."""
        self.block, self.id_col = block, id_col
        size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
        rows = docs.select(F.col(source_col).alias("source"), F.col(id_col).alias("id"), size.alias("size"))
        # Rows that agree in all of these are told apart by their number only.
        self.units = cut(rows.groupBy("source", "id", "size").agg(F.count("*").alias("n")))
        found = self.units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
        found = numbered(found, "s", F.col("source").asc_nulls_last())
        found = found.withColumn("weight", F.get(F.array(*map(F.lit, weights)), (F.col("s") % len(weights)).cast("int")))
        goal = F.least(F.floor(F.col("target") + 0.5), F.lit(most) * F.col("source_size"))
        self.sources = cut(targets(found, budget, most).withColumn("goal", goal))
        self.small_sources = small(self.sources)
        at = self.small_sources.select(F.col("source").alias("own"), "s")
        units = self.units.join(at, F.col("source").eqNullSafe(F.col("own"))).select("s", "id", "size", "n")
        self.empty = units.where("size = 0")
        units = units.where("size > 0").withColumn("h", hashed(F.col("id"), F.col("size"))).withColumn("words", F.col("size") * F.col("n"))
        leaves = max(1, self.units.count() // WIDTH)
        units = cut(units.withColumn("leaf", leaf_of(F.col("h"), leaves)))
        placed = preceding(units, ["s"], "leaf", ["h", "id", "size"], "words", leaves).select("s", "id", "size", "n", F.col("before").alias("start"))
        self.placed = cut(copies(placed).select("s", "id", "size", (F.col("start") + F.col("copy") * F.col("size")).alias("start")))

    def schedule(self) -> DataFrame:
        """(slot, s, id, size, start, first, length): the mix, in the order of slot and start. ``start`` is where the document begins in its
        source's stream, which names it; ``length`` words are taken from its word ``first`` on."""
        b = self.block
        covered = F.sequence(F.floor(F.col("start") / b), F.floor((F.col("start") + F.col("size") - 1) / b))
        pieces = self.placed.select("*", F.explode(covered).alias("block"))
        low, high = F.greatest(F.col("start"), F.col("block") * b), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * b)
        pieces = pieces.select("*", low.alias("low"), high.alias("high"))
        # Whole blocks are shuffled; what is left at a stream's end comes last.
        own = self.small_sources.select("s", F.floor(F.col("source_size") / b).alias("whole"), "source_size")
        blocks = pieces.where(F.col("low") == F.col("block") * b).select("s", "block").join(own, "s")
        shuffled = blocks.where("block < whole").select("s", "block", hashed(F.col("s"), F.col("block")).alias("h"), F.lit(1).alias("one"))
        n = self.sources.agg(F.sum("source_size")).first()[0] or 0
        leaves = max(1, n // b // WIDTH)
        shuffled = cut(shuffled.withColumn("leaf", leaf_of(F.col("h"), leaves)))
        turns = preceding(shuffled, ["s"], "leaf", ["h", "block"], "one", leaves).select("s", "block", F.col("before").alias("turn"))
        turns = turns.unionByName(blocks.where("block >= whole").select("s", "block", F.col("whole").alias("turn")))
        taken = turns.join(slots(self.sources, b), ["s", "turn"])
        found = pieces.join(taken, ["s", "block"])
        length = F.least(F.col("high"), F.col("block") * b + F.col("room")) - F.col("low")
        return found.select("slot", "s", "id", "size", "start", (F.col("low") - F.col("start")).alias("first"), length.alias("length")).where("length > 0")

    def taken(self) -> DataFrame:
        """(id, size, source_size, target, taken) of every row."""
        keys = ["s", "id", "size", "start"]
        each = self.placed.select(*keys, F.lit(0).cast("long").alias("length")).unionByName(self.schedule().select(*keys, "length"))
        each = each.groupBy(*keys).agg(F.sum("length").alias("taken")).select("s", "id", "size", "taken")
        none = copies(self.empty).select("s", "id", "size", F.lit(0).cast("long").alias("taken"))
        found = each.unionByName(none).join(self.small_sources.select("s", "source_size", "target"), "s")
        return found.select(F.col("id").alias(self.id_col), "size", "source_size", "target", "taken")


def copies(rows: DataFrame) -> DataFrame:
    """``rows`` n times each, with the number of the copy. Where there are many, they are dealt to several tasks."""
    few = rows.where(F.col("n") <= COPIES).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy"))
    parts = rows.where(F.col("n") > COPIES).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES))).alias("part"))
    within = F.sequence(F.col("part") * COPIES, F.least(F.col("n"), (F.col("part") + 1) * COPIES) - 1)
    many = parts.repartition("s", "id", "size", "part").select("*", F.explode(within).alias("copy")).drop("part")
    return few.unionByName(many)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken): how many words the mix takes of every row, repeats counted.

    Rows without words, null texts among them, are there with zeros. Rows that repeat an id are rows of their own; of equal ones any
    may be the one that is taken more often. A null id or source is like any other. Sources without words have the target zero; an empty
    table has no rows. Texts may be of any length, as they are cut into blocks.
    """
    return Mix(docs, **options).taken()


#: DuckDB: the same with windows over whole sources. How much of a source is taken doesn't depend on where its slots lie.
MIXED_SQL = r"""
WITH doc AS (
  SELECT source, doc_id, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
sized AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM doc GROUP BY source),
placed AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS s FROM sized),
weighed AS (SELECT *, [3, 1, 2][CAST(s % 3 AS INTEGER) + 1] AS weight, 2 * source_size AS stop FROM placed),
-- Sources in the order in which they stop; the level once all before one have stopped.
ordered AS (
  SELECT *, row_number() OVER (ORDER BY stop / weight, s) AS k,
         (1.5 * sum(source_size) OVER () - coalesce(sum(stop) OVER (ORDER BY stop / weight, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(weight) OVER (ORDER BY stop / weight, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
final AS (SELECT coalesce(arg_min(level, k) FILTER (WHERE weight * level < stop), 0) AS level FROM ordered),
target AS (
  SELECT source, s, source_size, CAST(least(weight * level, stop) AS DOUBLE) AS target,
         least(CAST(floor(CAST(least(weight * level, stop) AS DOUBLE) + 0.5) AS BIGINT), stop) AS goal
  FROM weighed, final),
goal AS (SELECT *, CAST(ceil(source_size / 1024) AS BIGINT) AS blocks FROM target),
need AS (
  SELECT *, goal // nullif(source_size, 0) * blocks + CAST(ceil(goal % nullif(source_size, 0) / 1024) AS BIGINT) AS needed FROM goal WHERE goal > 0),
turn AS (
  SELECT s, k % blocks AS turn, least(goal - (k // blocks * source_size + k % blocks * 1024), 1024) AS room
  FROM (SELECT need.*, unnest(range(0, needed)) AS k FROM need)),
stream AS (
  SELECT s, doc_id, size, source_size, target,
         CAST(sum(size) OVER (PARTITION BY s ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || size), doc_id, size
                              ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS start,
         row_number() OVER () AS row
  FROM doc JOIN goal ON doc.source IS NOT DISTINCT FROM goal.source),
whole AS (
  SELECT s, b, row_number() OVER (PARTITION BY s ORDER BY md5(s || ':' || b), b) - 1 AS turn
  FROM (SELECT s, unnest(range(0, source_size // 1024)) AS b FROM goal)),
block AS (SELECT * FROM whole UNION ALL SELECT s, source_size // 1024, source_size // 1024 FROM goal WHERE source_size % 1024 > 0),
piece AS (SELECT row, s, start, size, unnest(range(start // 1024, (start + size - 1) // 1024 + 1)) AS b FROM stream WHERE size > 0),
got AS (
  SELECT row, sum(greatest(0, least(start + size, b * 1024 + room, (b + 1) * 1024) - greatest(start, b * 1024))) AS taken
  FROM piece JOIN block USING (s, b) JOIN turn USING (s, turn) GROUP BY row)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM stream LEFT JOIN got USING (row)
"""
