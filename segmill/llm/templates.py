"""Benchmark decontamination by template windows.

Numbers, quantities, units and names of a text become typed placeholders, so that a question with other values has the same
template. Windows of five template words are hashed and joined with those of the benchmark items; a document that holds at
least 0.8 of an item's windows is matched, if the values in the placeholders agree: an item's value must always stand
for the same value of the document, at one place where the document holds the item, or over all places. DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, written

WORDS = 5
#: Words that may be put in or left out before places count as another alignment.
DRIFT = 4
#: Spelled-out numbers and units that count as such wherever they stand, in English, German, French and Spanish. Words that
#: are articles or common words of another of these languages are left out.
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
NUMBERS += "null zwei drei vier fünf sechs sieben acht neun zehn zwölf dreizehn vierzehn fünfzehn zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend".split()
NUMBERS += "zéro deux trois quatre cinq sept huit neuf dix onze douze treize quatorze quinze seize vingt trente quarante cinquante soixante mille".split()
NUMBERS += "cero dos tres cuatro cinco seis siete ocho nueve diez doce trece catorce quince veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien mil".split()
UNITS = "mm cm km kg mg ml metre metres meter meters kilometre kilometres kilometer kilometers mile miles inch inches foot feet yard yards gram grams kilogram kilograms tonne tonnes litre litres liter liters hour hours minute minutes second seconds day days week weeks month months year years dollar dollars euro euros pound pounds cent cents percent degree degrees volt volts watt watts joule joules newton newtons".split()
UNITS += "zentimeter gramm kilogramm tonnen stunde stunden minuten sekunde sekunden tag tage tagen woche wochen monat monate monaten jahr jahre jahren prozent grad".split()
UNITS += "mètre mètres centimètre centimètres kilomètre kilomètres gramme grammes kilogramme kilogrammes heure heures seconde secondes jour jours semaine semaines mois ans année années degré degrés".split()
UNITS += "metro metros centímetro centímetros kilómetro kilómetros gramo gramos kilogramo kilogramos litro litros hora horas minuto minutos segundo segundos día días semana semanas mes meses año años grado grados".split()
EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”„’‘¿¡…–—"


def _once(x: Column, name: str) -> Column:
    """x as a column of its own: explode(array(x)) gives one row, and keeps the optimiser from writing x out at each of its uses."""
    return F.explode(F.array(x)).alias(name)


def template(rows: DataFrame, *keep: str) -> DataFrame:
    """(keep, plain array<string>, kinds array<string>) of rows(text): each word, and its template word.

    A word is stripped of punctuation at its ends and lower-cased; words of punctuation alone stay as they are. A capitalised
    word is a name unless it opens the text or follows a stop.
    """
    words = F.filter(F.split(F.coalesce("text", F.lit("")), SPACE), lambda w: w != "")
    rows = rows.select(*keep, _once(words, "words"))
    # most words begin and end with a letter of ASCII, which comparisons tell sooner than trimming
    lower = lambda w: (w >= "a") & (w < "{")
    bare = lambda w: (lower(w) | ((w >= "A") & (w < "["))) & F.substring(w, -1, 1).between("a", "z")
    stripped = F.transform("words", lambda w: F.when(bare(w), w).otherwise(F.coalesce(F.nullif(F.btrim(w, F.lit(EDGES)), F.lit("")), w)))
    rows = rows.select(*keep, "words", _once(stripped, "bare"))
    before = F.slice(F.concat(F.array(F.lit(".")), "words"), F.lit(1), F.size("words"))
    named = lambda w, b: F.when(~lower(w) & (w != F.lower(w)) & w.rlike(r"^\p{Lu}\p{Ll}") & ~b.rlike(r"[.!?:][^\p{L}\p{N}]*$"), F.lit("#name")).otherwise(F.lower(w))
    rows = rows.select(*keep, "bare", _once(F.zip_with("bare", before, named), "named"))

    def kind(b: Column) -> Column:
        digit = (b >= "0") & (b < ":")  # the first byte; cheaper than a pattern
        return (
            F.when(digit & b.rlike(r"^[0-9][0-9.,:/]*(?:st|nd|rd|th|%)?$"), F.lit("#number"))
            .when(digit & b.rlike(r"^[0-9][0-9.,]*\p{L}+[0-9]?$"), F.lit("#quantity"))
            .when(b.isin(NUMBERS), F.lit("#number"))
            .when(b.isin(UNITS), F.lit("#unit"))
            .otherwise(b)
        )

    return rows.select(*keep, "bare", _once(F.transform("named", kind), "kinds"))


def _rest(a: str, k: int) -> Column:
    return F.slice(a, F.lit(k + 1), F.greatest(F.size(a) - k, F.lit(0)))


def _most(a: str, k: int) -> Column:
    return F.slice(a, F.lit(1), F.greatest(F.size(a) - k, F.lit(0)))


def _joined(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.xxhash64(x, y))


def _template_windows(typed: DataFrame, *keep: str) -> DataFrame:
    """(keep, windows array<long>): hash of each window of five template words, from those of two, of four, and the last word."""
    rows = typed.select(*keep, _once(F.transform("kinds", lambda k: F.xxhash64(k)), "t"))
    rows = rows.select(*keep, "t", _once(_joined(_most("t", 1), _rest("t", 1)), "two"))
    rows = rows.select(*keep, "t", _once(_joined(_most("two", 2), _rest("two", 2)), "four"))
    return rows.select(*keep, F.when(F.size("t") >= WORDS, _joined(_most("four", 1), _rest("t", 4))).otherwise(F.array().cast("array<long>")).alias("windows"))


def _plain_windows(typed: DataFrame, lengths: list[int], *keep: str) -> DataFrame:
    """(keep, plain array<struct<length, pos, h>>): hash of each window of as many lower-case words as lengths (one to four) say."""
    rows = typed.select(*keep, _once(F.transform("bare", lambda w: F.xxhash64(F.lower(w))), "t"))
    rows = rows.select(*keep, "t", _once(_joined(_most("t", 1), _rest("t", 1)), "two"))
    of = {1: F.col("t"), 2: F.col("two"), 3: _joined(_most("two", 1), _rest("t", 2)), 4: _joined(_most("two", 2), _rest("two", 2))}
    sized = lambda n: F.when(F.size("t") >= n, of[n]).otherwise(F.array().cast("array<long>"))
    each = lambda n: F.transform(sized(n), lambda h, i: F.struct(F.lit(n).alias("length"), i.alias("pos"), F.xxhash64(F.lit(n), h).alias("h")))
    return rows.select(*keep, F.concat(*(each(n) for n in lengths)).alias("plain"))


def item_windows(typed: DataFrame, *keep: str) -> DataFrame:
    """(keep, length, pos, h): windows of template(); a text of fewer than five words, but of one, is one window of its plain words."""
    rows = _template_windows(typed, *keep, "bare").select(*keep, "windows", F.least(F.size("bare"), F.lit(WORDS)).alias("length"), _once(F.transform("bare", lambda w: F.xxhash64(F.lower(w))), "t"))
    a, b, c, d = (F.get("t", F.lit(k)) for k in range(4))
    of = {1: a, 2: F.xxhash64(a, b), 3: F.xxhash64(F.xxhash64(a, b), c), 4: F.xxhash64(F.xxhash64(a, b), F.xxhash64(c, d))}
    short = F.coalesce(*(F.when(F.col("length") == n, F.array(F.xxhash64(F.lit(n), h))) for n, h in of.items()))
    return rows.where("length > 0").select(*keep, "length", F.posexplode(F.when(F.col("length") < WORDS, short).otherwise(F.col("windows"))).alias("pos", "h"))


def text_windows(typed: DataFrame, lengths: list[int], *keep: str) -> DataFrame:
    """(keep, pos, h): windows of five template words, and those of plain words of each of lengths (below five)."""
    if not lengths:
        return _template_windows(typed, *keep).select(*keep, F.posexplode("windows").alias("pos", "h"))
    rows = _plain_windows(_template_windows(typed, *keep, "bare"), lengths, *keep, "windows")
    long = F.transform("windows", lambda h, i: F.struct(F.lit(WORDS).alias("length"), i.alias("pos"), h.alias("h")))
    return rows.select(*keep, F.explode(F.concat(long, "plain")).alias("w")).select(*keep, "w.pos", "w.h")


def slots(typed: DataFrame, *keep: str) -> DataFrame:
    """(keep, at, value): the place and the value of each word that is a placeholder in the template."""
    value = F.zip_with("kinds", "bare", lambda k, w: F.when(k.startswith("#") & (F.length(k) > 1) & (k != F.lower(w)), F.lower(w)))
    rows = typed.select(*keep, _once(value, "v"))
    return rows.select(*keep, F.posexplode("v").alias("at", "value")).where("value is not null")


#: Windows of benchmark items up to this number are broadcast; more are joined by shuffling.
BROADCAST_WINDOWS = 200_000


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(id_col, text_hash, item_col, windows, matched, consistent): pairs of a document and an item of which it holds at least `similarity` of the distinct windows.

    consistent: each value in the item's placeholders stands for one value of the document, in at least `similarity` of the
    matched windows that hold it. That is asked of each alignment (places of the document less places in the item, equal or
    within DRIFT) that holds `similarity` of the item's window places, and of all places together, where a window counts as often as
    both hold it; one that agrees is enough. A window that the item holds several times has all its places, so an item of ten numbers
    isn't held by five numbers in a row. An item of fewer than five words has no template: it is one
    window of its own length of plain words, wherever it stands. Null, empty and blank texts match nothing, on either side. Repeated items match each; repeated
    rows of docs give one row per distinct id and text. Null ids are kept as such. Other columns are ignored.
    """
    items = template(benchmark.select(F.col(item_col).alias("item"), F.xxhash64(text_col).alias("item_hash"), F.col(text_col).alias("text")).distinct(), "item", "item_hash")
    item, doc = ["item", "item_hash"], ["id", "text_hash"]
    same = lambda a, b, names: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in names]
    on = lambda a, b, names: reduce(lambda x, y: x & y, same(a, b, names))
    own = written(item_windows(items, *item).groupBy(*item, "length", "h").agg(F.array_sort(F.collect_list("pos")).alias("places")), "item-windows")
    lengths = sorted(r["length"] for r in own.where(F.col("length") < WORDS).select("length").distinct().collect())  # at most four
    totals = own.groupBy(*item).agg(F.count("*").alias("windows")).alias("b")
    # a match holds at least one of any floor((1 - similarity) * windows) + 1 windows of an item: the rarest are its probes
    rarity = own.groupBy("h").agg(F.count("*").alias("items")).alias("c")
    ranked = own.alias("a").join(totals, on("a", "b", item)).join(rarity, F.col("a.h") == F.col("c.h")).select("a.item", "a.item_hash", "a.h", "b.windows", F.row_number().over(Window.partitionBy("a.item", "a.item_hash").orderBy("c.items", "a.h")).alias("nth"))
    side = written(ranked.withColumn("probe", F.col("nth") <= F.floor((1 - similarity) * F.col("windows") + 1e-9) + 1).drop("nth"), "probes")
    sized = (lambda x: F.broadcast(x)) if side.count() <= BROADCAST_WINDOWS else (lambda x: x)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    places = written(text_windows(template(rows, *doc), lengths, *doc).join(sized(side.select("h").distinct()), "h", "left_semi"), "places")
    windows = written(places.select(*doc, "h").distinct(), "windows")
    pairs = windows.join(sized(side.where("probe")), "h").select(*doc, *item).distinct()
    held = pairs.alias("p").join(side.alias("s"), on("p", "s", item)).select("p.*", "s.h", "s.windows").alias("a").join(windows.alias("w"), on("a", "w", [*doc, "h"])).select("a.*")
    found = written(held.groupBy(*doc, *item, "windows").agg(F.count("h").alias("matched")).where(F.col("matched") >= similarity * F.col("windows")), "matches")
    of = found.drop("matched").alias("f").join(own.alias("o"), on("f", "o", item)).select("f.*", "o.h", "o.places", "o.length").alias("a")
    of = of.join(places.alias("d"), on("a", "d", [*doc, "h"])).select("a.*", "d.pos", F.size("a.places").alias("times"), F.posexplode("a.places").alias("nth", "item_pos"))
    # alignments: (0, shift) has the hits of that shift, (1, shift) those within DRIFT, the nearest of a place; (2, 0) all, by an item's first place
    shift = F.col("pos") - F.col("item_pos")
    near = F.transform(F.sequence(F.lit(-DRIFT), F.lit(DRIFT)), lambda d: F.struct(F.lit(1).alias("kind"), (shift + d).alias("shift"), F.abs(d).alias("off")))
    alone = lambda kind, at: F.array(F.struct(F.lit(kind).alias("kind"), at.alias("shift"), F.lit(0).alias("off")))
    ways = F.concat(alone(0, shift), near, F.when(F.col("nth") == 0, alone(2, F.lit(0))).otherwise(F.slice(alone(2, F.lit(0)), 1, 0)))
    group = [*doc, *item, "kind", "shift"]
    of = of.withColumn("way", F.explode(ways)).select(*doc, *item, "h", "times", "pos", "item_pos", "way.*")
    of = written(of.groupBy(*group, "h", "times", "pos").agg(F.min(F.struct("off", "item_pos"))["item_pos"].alias("item_pos")), "alignments")
    spots = own.groupBy(*item).agg(F.sum(F.size("places")).alias("spots")).alias("s")
    held = of.groupBy(*group, "h", "times").agg(F.count("*").alias("n"), F.size(F.collect_set("item_pos")).alias("own"))
    held = held.groupBy(*group).agg(F.sum(F.when(F.col("kind") == 2, F.least("n", "times")).otherwise(F.col("own"))).alias("held")).alias("a")
    whole = held.join(spots, on("a", "s", item)).where(F.col("held") >= similarity * F.col("spots")).select(*(F.col(f"a.{c}") for c in group))
    of = of.alias("a").join(whole.alias("b"), on("a", "b", group), "left_semi")
    # values of placeholders: of the matched documents and items alone, and a row per placeholder
    held = found.select(*doc).distinct().alias("b")
    texts = rows.alias("a").join(held, on("a", "b", doc), "left_semi").dropDuplicates(doc)
    ours = written(slots(template(texts, *doc), *doc), "document-slots").withColumnsRenamed({"at": "our_at", "value": "ours"}).alias("d")
    theirs = written(slots(items, *item), "item-slots").withColumnRenamed("value", "theirs").alias("i")
    inside = F.col("i.at").between(F.col("a.item_pos"), F.col("a.item_pos") + WORDS - 1)
    values = of.alias("a").join(theirs, on("a", "i", item) & inside).select("a.*", "i.theirs", (F.col("a.pos") + F.col("i.at") - F.col("a.item_pos")).alias("place")).alias("a")
    values = values.join(ours, on("a", "d", doc) & (F.col("a.place") == F.col("d.our_at")), "left").select("a.*", F.coalesce("d.ours", F.lit("")).alias("ours"))
    each = values.groupBy(*group, F.col("theirs").alias("value"), "ours").agg(F.count("*").alias("n"))
    value = each.groupBy(*group, "value").agg(F.sum("n").alias("n"), F.max("n").alias("most"))
    agree = value.groupBy(*group).agg(F.bool_and(F.col("most") >= similarity * F.col("n")).alias("agree"))
    # an alignment without values agrees
    agree = whole.alias("a").join(agree.alias("b"), on("a", "b", group), "left").select("a.*", F.coalesce("b.agree", F.lit(True)).alias("agree"))
    agree = agree.groupBy(*doc, *item).agg(F.bool_or("agree").alias("agree")).alias("b")
    out = found.alias("a").join(agree, on("a", "b", [*doc, *item]), "left")
    return out.select(F.col("a.id").alias(id_col), "a.text_hash", F.col("a.item").alias(item_col), "a.windows", "a.matched", F.coalesce("agree", F.lit(False)).alias("consistent"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that hold an item consistently; all its columns, whatever their names."""
    bad = written(contaminated(docs, benchmark, similarity, id_col, item_col, text_col).where("consistent").select(F.col(id_col).alias("id"), F.col("text_hash").alias("hash")).distinct(), "contaminated")
    on = F.col(f"d.{id_col}").eqNullSafe(F.col("b.id")) & (F.xxhash64(f"d.{text_col}") == F.col("b.hash"))
    return docs.alias("d").join(bad.alias("b"), on, "left_anti")
