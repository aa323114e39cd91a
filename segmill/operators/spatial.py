"""Boxes and points of a page joined by the cells of a grid: equi-joins on (page, cell), then the exact test.

The grid has levels, each with cells twice as wide as the one before. A box lies in the at most four cells it touches at the level
whose cells are at least as large as it is; a point is looked up at the levels that boxes are on. So neither a large box among small
ones nor many boxes on a page make more rows than there are boxes and points, times the few levels.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from .tables import settled

#: Width of the smallest cells, in points.
BASE = 16.0
SIDES = ("left", "top", "right", "bottom")


def _cell(x: Column, level: Column) -> Column:
    return F.floor(x / (BASE * F.pow(F.lit(2.0), level)))


def _leveled(boxes: DataFrame, left: str, top: str, right: str, bottom: str) -> DataFrame:
    """boxes in each cell they touch at their level: _level, _cx, _cy."""
    side = F.greatest(F.col(right) - F.col(left), F.col(bottom) - F.col(top), F.lit(BASE))
    out = boxes.withColumn("_level", F.greatest(F.ceil(F.log2(side / BASE)), F.lit(0)).cast("int"))
    out = out.withColumn("_cx", F.explode(F.sequence(_cell(F.col(left), F.col("_level")), _cell(F.greatest(left, right), F.col("_level")))))
    return out.withColumn("_cy", F.explode(F.sequence(_cell(F.col(top), F.col("_level")), _cell(F.greatest(top, bottom), F.col("_level")))))


def centres_inside(rows: DataFrame, boxes: DataFrame, keys: list[str]) -> DataFrame:
    """(columns of rows, columns of boxes but keys and sides): each row with each box of equal keys that its centre lies in, edges included.

    Both have left, top, right and bottom, as doubles; those of the result are the rows'. Null or NaN sides lie nowhere. Other names must differ.
    """
    held = boxes.withColumnsRenamed({s: f"_b{s}" for s in SIDES}).where(reduce(lambda a, b: a & b, (F.col(f"_b{s}").isNotNull() & ~F.isnan(f"_b{s}") for s in SIDES)))
    held = _leveled(held, *(f"_b{s}" for s in SIDES))
    levels = sorted(r[0] for r in held.select("_level").distinct().collect())  # as many as sizes have powers of two
    x, y = (F.col("left") + F.col("right")) / 2, (F.col("top") + F.col("bottom")) / 2
    points = rows.where(x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y)).withColumn("_level", F.explode(F.array(*(F.lit(n) for n in levels)).cast("array<int>")))
    points = points.withColumns({"_cx": _cell(x, F.col("_level")), "_cy": _cell(y, F.col("_level"))})
    both = points.join(held, [*keys, "_level", "_cx", "_cy"]).where(G.center_inside(G.box(), G.box("_b")))
    others = [c for c in boxes.columns if c not in SIDES and c not in keys]
    return both.select(*rows.columns, *others)


#: Targets of a key up to which its rows are held against each of them; rows of larger keys look into cells.
FEW = 64


def nearest(rows: DataFrame, targets: DataFrame, keys: list[str], id_col: str, near_col: str, x: str = "left", y: str = "top", first: float = BASE, few: int = FEW) -> DataFrame:
    """(id_col, near_col, d): of each row the target of equal keys with the least |dx| + |dy|, of equally near ones the smallest near_col.

    The targets of a key that has at most `few` go to its rows as one array. Rows of larger keys look into their cell and the eight around it:
    what they find within a cell's width is nearest; rows that find nothing so near look again in cells of twice the width. An id may have
    several rows, with other keys: the nearest of all counts. Targets at one point count once. Rows without a target are left out.
    """
    t = targets.select(*keys, F.col(x).cast("double").alias("_tx"), F.col(y).cast("double").alias("_ty"), near_col).where("_tx is not null and _ty is not null")
    open_ = rows.select(id_col, *keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).where("_x is not null and _y is not null")
    lists = _lists(t, keys, few)
    d = F.abs(F.col("_x") - F.col("_t._tx")) + F.abs(F.col("_y") - F.col("_t._ty"))
    to = lambda p: F.struct((F.abs(F.col("_x") - p["_tx"]) + F.abs(F.col("_y") - p["_ty"])).alias("d"), p[near_col].alias(near_col))
    held = settled(open_.join(lists, keys).withColumn("_m", F.array_min(F.transform("_near", to))).select(id_col, *keys, "_x", "_y", "_m"), "nearest")
    found, width, steps = [held.where("_m is not null").select(id_col, "_m")], first, F.array(F.lit(-1), F.lit(0), F.lit(1))
    open_ = held.where("_m is null").drop("_m")
    if not open_.isEmpty():
        t = t.join(lists.where("_near is null").select(*keys), keys).groupBy(*keys, "_tx", "_ty").agg(F.min(near_col).alias(near_col))
        t = settled(t.select(*keys, F.struct("_tx", "_ty", near_col).alias("_t")), "targets")
    while not open_.isEmpty():
        cell = lambda c, w=width: F.floor(F.col(c) / w)
        looks = open_.withColumn("_dx", F.explode(steps)).withColumn("_dy", F.explode(steps)).withColumns({"_cx": cell("_x") + F.col("_dx"), "_cy": cell("_y") + F.col("_dy")})
        laid = t.withColumns({"_cx": cell("_t._tx"), "_cy": cell("_t._ty")})
        best = looks.join(laid, [*keys, "_cx", "_cy"]).groupBy(id_col, *keys, "_x", "_y").agg(F.min(F.struct(d.alias("d"), F.col(f"_t.{near_col}"))).alias("_m"))
        best = settled(best.where(F.col("_m.d") <= width), "nearest")
        found.append(best.select(id_col, "_m"))
        open_ = settled(open_.join(best.select(id_col, *keys, "_x", "_y"), [id_col, *keys, "_x", "_y"], "left_anti"), "rows")
        width *= 2
    least = reduce(DataFrame.unionByName, found).groupBy(id_col).agg(F.min("_m").alias("_m"))
    return least.select(id_col, f"_m.{near_col}", "_m.d")


def _lists(t: DataFrame, keys: list[str], few: int) -> DataFrame:
    """(keys, _near): the targets of each key, with all columns but the keys, as an array, null where they are more than few."""
    counts = t.groupBy(*keys).agg(F.count("*").alias("_n"))
    small = t.join(counts.where(F.col("_n") <= few).drop("_n"), keys).groupBy(*keys).agg(F.collect_list(F.struct(*(c for c in t.columns if c not in keys))).alias("_near"))
    none = F.lit(None).cast(small.schema["_near"].dataType)
    return small.unionByName(counts.where(F.col("_n") > few).select(*keys, none.alias("_near")))


def openings(rows: DataFrame, targets: DataFrame, length: int, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """rows and targets with a column _gram on which they are equal just where the row's text holds the first `length` characters of the target's.

    Rows get each of their stretches as long as some target's opening (length, or less for shorter texts) once; targets their opening.
    """
    opened = targets.withColumn("_gram", F.left(text, F.lit(length)))
    sizes = sorted(r[0] for r in opened.select(F.length("_gram")).distinct().collect() if r[0] is not None)  # length + 1 at most

    def stretches(size: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1)))
        return F.transform(starts, lambda at: F.substring(F.col(text), at, F.lit(size)))

    grams = F.concat(*map(stretches, sizes)) if sizes else F.array().cast("array<string>")
    whole = F.filter(F.array_distinct(grams), lambda g: F.length(g).isin(sizes or [0]))
    return rows.withColumn("_gram", F.explode(whole)), opened


#: Characters of a text by which those that may be held are looked up.
FIRST = 8


def holding(rows: DataFrame, targets: DataFrame, keys: list[str], text: str = "text", first: int = FIRST) -> tuple[DataFrame, DataFrame]:
    """rows and targets with a column _gram; those of equal keys are equal on it just where the row's text holds the target's, the whole of it.

    Targets get their text, rows each of their stretches that opens like a target of equal keys and is as long as it. Which openings a row has is found
    with a hash in place of its text, so texts don't go along with each of their characters, and targets that open alike are one opening with their lengths.
    """
    hashed = rows.withColumn("_hash", F.xxhash64(text))
    held, opened = openings(hashed, targets, first, text)
    sizes = opened.groupBy(*keys, F.col("_gram").alias("_start")).agg(F.collect_set(F.length(text)).alias("_sizes"))
    starts = held.select(*keys, "_hash", F.col("_gram").alias("_start")).distinct().join(sizes, [*keys, "_start"])  # texts of one hash share starts, some of which one may lack
    places = F.sequence(F.lit(1), F.greatest(F.length(text) - F.length("_start") + 1, F.lit(1)))
    places = F.filter(places, lambda at: F.substring(F.col(text), at, F.length("_start")) == F.col("_start"))
    fitting = lambda at: F.filter("_sizes", lambda n: n <= F.length(text) - at + 1)
    grams = F.flatten(F.transform(places, lambda at: F.transform(fitting(at), lambda n: F.substring(F.col(text), at, n))))
    whole = hashed.join(starts, [*keys, "_hash"]).withColumn("_gram", F.explode(F.array_distinct(grams)))
    return whole.select(*rows.columns, "_gram"), targets.withColumn("_gram", F.col(text))


def nearest_holding(rows: DataFrame, targets: DataFrame, keys: list[str], id_col: str, near_col: str, text: str = "text", x: str = "left", y: str = "top", few: int = FEW) -> DataFrame:
    """(id_col, near_col, d) as of `nearest`, among the targets of equal keys whose text holds the row's, the whole of it, or the other way round.

    The targets of a key that has at most `few` go to its rows as one array, with their texts. Rows of larger keys look for what they hold, and what holds them.
    Where a side is null, so is d; such targets come after all others.
    """
    place = [F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")]
    t = targets.select(*keys, *place, F.col(text).alias("_text"), near_col).where("_text is not null")
    open_ = rows.select(id_col, *keys, *place, F.col(text).alias("_text")).where("_text is not null")
    lists = _lists(t, keys, few)
    alike = F.filter("_near", lambda p: F.contains(F.col("_text"), p["_text"]) | F.contains(p["_text"], F.col("_text")))
    found_at = lambda d, near: F.struct(d.isNull().alias("_off"), d.alias("d"), near.alias(near_col))
    to = lambda p: found_at(F.abs(F.col("_x") - p["_x"]) + F.abs(F.col("_y") - p["_y"]), p[near_col])
    held = open_.join(lists, keys).withColumns({"_many": F.col("_near").isNull(), "_m": F.array_min(F.transform(alike, to))})
    held = settled(held.where("_many or _m is not null").select(id_col, *keys, "_x", "_y", F.when(F.col("_many"), F.col("_text")).alias("_text"), "_many", "_m"), "nearest")
    found, open_ = held.where("not _many").select(id_col, "_m"), held.where("_many").drop("_many", "_m")
    if not open_.isEmpty():
        t = t.join(lists.where("_near is null").select(*keys), keys).groupBy(*keys, "_x", "_y", "_text").agg(F.min(near_col).alias(near_col))
        t = settled(t, "targets")
        (holds, own), (held_by, inner) = holding(open_, t, keys, "_text"), holding(t, open_, keys, "_text")
        way = lambda df, n: df.withColumn("_way", F.lit(n)).drop("_text")
        looks, on = way(holds, 0).unionByName(way(inner, 1)), [*keys, "_way", "_gram"]
        held_by = settled(way(own, 0).unionByName(way(held_by, 1)), "held")
        found = found.unionByName(nearest(looks, held_by, on, id_col, near_col, "_x", "_y").select(id_col, found_at(F.col("d"), F.col(near_col)).alias("_m")))
        if not (open_.where("_x + _y is null").isEmpty() and t.where("_x + _y is null").isEmpty()):
            least = held_by.groupBy(*on).agg(F.min(near_col).alias(near_col))
            found = found.unionByName(looks.join(least, on).select(id_col, found_at(F.lit(None).cast("double"), F.col(near_col)).alias("_m")))
    return found.groupBy(id_col).agg(F.min("_m").alias("_m")).select(id_col, f"_m.{near_col}", "_m.d")
