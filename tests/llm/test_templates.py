import random
import re

from pyspark.sql import functions as F

from segmill.llm import templates

ITEM = "A train leaves the station at 7 and travels 120 km to see Alice before noon. How long does Alice wait if the train needs 3 hours for the trip?"
SAME = "Some text first. A train leaves the station at 9 and travels 450 km to see Robert before noon. How long does Robert wait if the train needs 5 hours for the trip? And more."
MIXED = "A train leaves the station at 9 and travels 450 km to see Robert before noon. How long does Maria wait if the train needs 5 hours for the trip?"


def brute(docs, items, similarity=0.8):
    """For texts without digits and capitals but at sentence starts: windows of five lower-case words."""
    strip = lambda w: w.strip(templates.EDGES) or w

    def wins(text):
        words = (text or "").split()
        out, before = [], "."
        for w in words:
            b = strip(w)
            kind = "#name" if re.match("[^\\W\\d_a-zà-ÿ][a-zà-ÿß]", b) and b != b.lower() and not re.search(r"[.!?:]\W*$", before) else b.lower()
            kind = "#number" if re.fullmatch(r"[0-9][0-9.,:/]*(?:st|nd|rd|th|%)?", kind) or kind in templates.NUMBERS else "#quantity" if re.fullmatch(r"[0-9][0-9.,]*[^\W\d_]+[0-9]?", kind) else "#unit" if kind in templates.UNITS else kind
            out.append(kind)
            before = w
        return {tuple(out[i : i + 5]) for i in range(max(1, len(out) - 4))} if out else set()

    docs = [(i, wins(t)) for i, t in docs]
    own = [(i, wins(t)) for i, t in items]
    return sorted((d, i, len(b), len(a & b)) for d, a in docs for i, b in own if b and len(a & b) >= similarity * len(b))


def test_documents(spark, documents, small):
    items = spark.read.parquet(f"{small}/benchmark.parquet")
    got = sorted(tuple(r) for r in templates.contaminated(documents, items).select("doc_id", "item_id", "windows", "matched").collect())
    assert got and got == brute([tuple(r) for r in documents.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()])


def test_slots(spark):
    docs = spark.createDataFrame([(1, SAME), (2, MIXED), (3, ITEM), (4, "nothing of the sort")], "doc_id long, text string")
    items = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    got = {r["doc_id"]: r["consistent"] for r in templates.contaminated(docs, items, similarity=0.85).collect()}
    assert got == {1: True, 2: False, 3: True}
    assert sorted(r["doc_id"] for r in templates.decontaminate(docs, items, similarity=0.85).collect()) == [2, 4]


TWICE = "Today Anna has 3 red apples in a bag, and Boris has 4 red apples in a bag. How many apples do they have in all?"


def test_item_with_a_repeated_window(spark):
    other = TWICE.replace("3", "7").replace("4", "9").replace("Anna", "Clara")
    docs = spark.createDataFrame([(1, TWICE), (2, f"Before it. {other} And after it."), (3, MIXED)], "doc_id long, text string")
    items = spark.createDataFrame([(7, TWICE), (8, ITEM)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["consistent"] for r in templates.contaminated(docs, items, similarity=0.85).collect()}
    assert got == {(1, 7): True, (2, 7): True, (3, 8): False}


def test_copy_and_variant(spark):
    longer = ITEM.replace("to see", "over the hills to see")
    rows = [(1, f"{ITEM} {SAME}"), (2, f"{SAME} {ITEM} {MIXED}"), (3, f"{longer} {SAME}"), (4, f"{MIXED} Then. {MIXED}"), (5, f"{TWICE} {TWICE.replace('3', '8').replace('4', '6')}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(7, ITEM), (8, TWICE)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["consistent"] for r in templates.contaminated(docs, items, similarity=0.85).collect()}
    assert got == {(1, 7): True, (2, 7): True, (3, 7): True, (4, 7): False, (5, 8): True}


def test_edges(spark, edge):
    items = spark.createDataFrame([(1, "repeated row"), (2, None), (3, ""), (4, "one"), (None, "a row without an id"), (5, "one")], "item_id long, text string").withColumn("h", F.lit(1))
    got = {(r["doc_id"], r["item_id"]) for r in templates.contaminated(edge, items).collect()}
    assert got == {(10, 1), (6, 4), (6, 5), (None, None)}
    left = templates.decontaminate(edge, items)
    assert left.columns == edge.columns and left.count() == edge.count() - 4
    assert templates.contaminated(edge.limit(0), items).count() == 0 and templates.contaminated(edge, items.limit(0)).count() == 0


def test_short_items_stand_anywhere(spark):
    """Items of fewer than five words are found inside longer texts by their plain words, and nowhere else."""
    items = spark.createDataFrame([(1, "Why so blue?"), (2, "seven"), (3, "of the sort here")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "At last they asked: why so blue? And went."), (2, "why so"), (3, "I saw 7 or 8 cats"), (4, "Seven of them"), (5, "nothing of the sort here, or there"), (6, "why so blue")], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["consistent"] for r in templates.contaminated(docs, items).collect()}
    assert got == {(1, 1): True, (6, 1): True, (4, 2): True, (5, 3): True}


def test_texts_of_numbers(spark):
    """A text of numbers holds a window of placeholders at every place; what is written grows with the text, not with the items."""
    rng = random.Random(4)
    docs = spark.createDataFrame([(1, " ".join(str(rng.randint(0, 999)) for _ in range(20_000))), (2, ITEM)], "doc_id long, text string")
    items = [(i, f"{ITEM} 1 2 3 4 {i} and then some more of item number {'abcdefghij'[i % 10] * (i // 10 + 1)}") for i in range(50)]
    got = templates.contaminated(docs, spark.createDataFrame([*items, (99, ITEM)], "item_id long, text string"))
    assert [(r["doc_id"], r["item_id"], r["consistent"]) for r in got.collect()] == [(2, 99, True)]


def test_clashing_names(spark):
    names = ["id", "hash", "text_hash", "h", "pos", "item", "windows", "_id", "_hash", "b", "d"]
    docs = spark.createDataFrame([(1, ITEM), (2, "clean")], "doc_id long, text string").withColumns({n: F.lit(1) for n in names})
    left = templates.decontaminate(docs, spark.createDataFrame([(7, ITEM)], "item_id long, text string").withColumns({n: F.lit(1) for n in names}))
    assert left.columns == docs.columns and [r["doc_id"] for r in left.collect()] == [2]


def consistent(text, item, similarity=0.8):
    """Whether a text of numbers and plain words holds an item, by all alignments of all places."""
    kinds = lambda t: ["#" if w.isdigit() else w for w in t.split()]
    a, b, x, y = kinds(text), kinds(item), text.split(), item.split()
    wins = lambda k: [tuple(k[i : i + 5]) for i in range(len(k) - 4)]
    ours, theirs = wins(a), wins(b)
    hits = [(p, i) for p, w in enumerate(ours) for i, v in enumerate(theirs) if w == v]

    def agrees(pairs):
        seen = {}
        for p, i in pairs:
            for k in range(5):
                if b[i + k] == "#":
                    seen.setdefault(y[i + k], []).append(x[p + k])
        return all(max(v.count(o) for o in v) >= similarity * len(v) for v in seen.values())

    for s in {p - i for p, i in hits} | {p - i + d for p, i in hits for d in range(-4, 5)}:
        for drift in (0, 4):
            near = {}
            for p, i in hits:
                if abs(p - i - s) <= drift:
                    near[p] = min(near.get(p, (99, 0)), (abs(p - i - s), i))
            pairs = [(p, i) for p, (_, i) in near.items()]
            if len({i for _, i in pairs}) >= similarity * len(theirs) and agrees(pairs):
                return True
    first = {w: i for i, w in reversed(list(enumerate(theirs)))}
    every = [(p, first[w]) for p, w in enumerate(ours) if w in first]
    return sum(min(ours.count(w), theirs.count(w)) for w in set(theirs)) >= similarity * len(theirs) and agrees(every)


def test_windows_that_coincide(spark):
    """Items whose windows are alike ask for as many places as they have."""
    numbers, song = "1 2 3 4 5 6 7 8 9 10", "row row row row row row your boat row row row row row row gently down"
    items = {1: numbers, 2: song, 3: "add 1 to 1 to 1 to 1 to 1 to 1 to 1 and stop"}
    docs = {
        1: "11 12 13 14 15 16", 2: "4 8 15 16 23 42 99 7 5 3", 3: "so 1 2 3 4 5 6 7 8 9 10 it is", 4: "row row row row row row your boat",
        5: song, 6: "then add 7 to 7 to 7 to 7 to 7 to 7 to 7 and stop", 7: "add 1 to 2 to 3 to 4 to 5 to 6 to 7 and stop", 8: "add 1 to 1 to 1 and stop", 9: "1 2 3 4 5 6 7 8", 10: "1 2 1 2 1 2 1 2 1 2 1 2",
    }
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["consistent"] for r in templates.contaminated(d, spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()}
    assert {k for k, v in got.items() if v} == {(i, j) for i, t in docs.items() for j, u in items.items() if consistent(t, u)}
    assert got[1, 1] is False and got[3, 1] and got[5, 2] and got[6, 3]


def test_numbers_and_units_of_other_languages(spark):
    items = [(1, "tengo que andar cuatro kilómetros en dos horas y luego descansar tres minutos antes de seguir"), (2, "il faut marcher quatre kilomètres en deux heures puis attendre trois minutes avant de partir")]
    docs = [(1, items[0][1].replace("cuatro kilómetros", "siete metros").replace("dos", "9")), (2, items[1][1].replace("quatre kilomètres", "8 mètres").replace("trois", "dix"))]
    got = templates.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).where("consistent").collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(1, 1), (2, 2)}
