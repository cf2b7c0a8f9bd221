"""Benchmark decontamination by template canonicalisation, with DataFrame functions only.

Numbers, units after numbers and names inside sentences become typed placeholders. Windows of five template words
are hashed and joined with the windows of the benchmark items. Every place where a window with slots met is kept;
its place in the document less that in the item tells the aligned instance. Over the different slots of an instance,
numbers, units and names each, a value of the item must stand for one value of the document, and values of the item may
not fall together in the document; the best instance of an item counts. So verbatim copies and questions with exchanged
parameters are found, also where templates repeat, and instances whose slots contradict each other don't count.

A window with fewer than two literal words is hashed by its own values, so bare tables of numbers aren't
found as templates.

Defined cases: null texts and texts without a word have no windows; an item of fewer than five words has one window,
all of it, and is met by windows of its own length; an item without a word matches nothing; items given twice under
one id count once; a row is known by its id and its text, so different texts under one id, or without an id, are looked
at one by one, and repeated rows count as one; a null item text is skipped; U+E000 to U+E004, the signs for marks and
placeholders, count as blanks in a text; other columns are ignored."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import size_checked, staged, text_hash

WIDTH = 5
COVERAGE = 0.8
#: The share of an instance's slots of a type whose value in the document no other value of the item has, too.
APART = 0.5
#: Up to this many benchmark windows are broadcast (about 100 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 500_000
MARK, NUMBER, UNIT, NAME, OPENS = "\ue000", "\ue001", "\ue002", "\ue003", "\ue004"
SIGNS = MARK + NUMBER + UNIT + NAME + OPENS
_WORD = r"[\p{L}\p{N}]+"
#: Words of plain text, and words of text with placeholders.
TOKEN, PLACED = rf"[0-9]+(?:[.,][0-9]+)*|{_WORD}", rf"[{NUMBER}{UNIT}{NAME}]|{_WORD}"
#: A capitalised word inside a sentence; the cheap look ahead comes first.
INNER_NAME = r"(?=\p{Lu}\p{Ll})(?<=[\p{Ll}\p{N},;:] )"
#: A capitalised word at any other place, after INNER_NAME is marked.
OPENING = rf"(?=\p{{Lu}}\p{{Ll}})(?<![\p{{L}}\p{{N}}{MARK}])"
_NUMBER = r"(?=[0-9])(?<![\p{L}\p{N}])[0-9]+(?:[.,][0-9]+)*"
NONE, INNER, ALL = range(3)
# Units that may follow a number.
UNITS = "mm cm m km in ft yd mi mg g kg lb oz t ml l cl gal s sec min h hr hrs hours hour minutes minute seconds days day weeks week months month years year hz khz mhz ghz w kw mw kwh v a mah pa kpa bar psi j kj cal kcal c f k usd eur gbp dollars euros cents percent meters metres miles kilometers kilometres grams kilograms pounds ounces liters litres tons".split()
#: A unit right after a number, once numbers are placeholders.
_UNIT = rf"{NUMBER}([^\p{{L}}\p{{N}}{SIGNS}]*+)[{MARK}{OPENS}]?(?:{'|'.join(UNITS)})(?![\p{{L}}\p{{N}}])"
_WINDOWS = "array<struct<pos:int,h:bigint>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _marked(text: Column) -> Column:
    """The lower-cased text with a mark before every capitalised word; signs of its own are blanks."""
    own = F.coalesce(text, F.lit(""))
    clean = F.when(own.rlike(f"[{SIGNS}]"), F.translate(own, SIGNS, " " * len(SIGNS))).otherwise(own)
    return F.lower(F.regexp_replace(F.regexp_replace(clean, INNER_NAME, MARK), OPENING, OPENS))


def _numbered(marked: Column) -> Column:
    """A marked text with placeholders for numbers and for the units after them."""
    return F.when(marked.rlike("[0-9]"), F.regexp_replace(F.regexp_replace(marked, _NUMBER, NUMBER), _UNIT, f"{NUMBER}$1{UNIT}")).otherwise(marked)


def _unmarked(marked: Column) -> Column:
    return F.regexp_replace(marked, f"[{MARK}{OPENS}]", "")


def _plain(marked: Column) -> Column:
    """The words of a marked text. Its templates have as many, at the same places."""
    return F.regexp_extract_all(_unmarked(marked), F.lit(TOKEN), F.lit(0))


def words(text: Column) -> Column:
    """The lower-cased words of a text in order."""
    return _plain(_marked(text))


def _template(numbered: Column, names: int) -> Column:
    """The template words of a marked text with placeholders; `names` says which marked words become names."""
    if names == NONE:
        numbered = _unmarked(numbered)
    elif names == INNER:
        numbered = F.translate(F.regexp_replace(numbered, MARK + _WORD, NAME), OPENS, "")
    else:
        numbered = F.regexp_replace(numbered, f"[{MARK}{OPENS}]{_WORD}", NAME)
    return F.regexp_extract_all(numbered, F.lit(PLACED), F.lit(0))


def _slot(x: Column) -> Column:
    return x.isin(NUMBER, UNIT, NAME)


def _places(template: Column, wanted: Callable[[Column], Column]) -> Column:
    """Where the template has the words that `wanted` holds for."""
    return F.when(F.size(template) > 0, F.filter(F.sequence(F.lit(0), F.size(template) - 1), lambda i: wanted(F.get(template, i)))).otherwise(F.array().cast("array<int>"))


def _steps(template: Column, width: int) -> Column:
    """The places of all windows: every one of `width` words, or the whole of a shorter template."""
    return F.when(F.size(template) > 0, F.sequence(F.lit(0), F.greatest(F.size(template) - width, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def _around(template: Column, at: Column, width: int) -> Column:
    """The places of the windows that hold a word of the places `at`."""
    last = F.greatest(F.size(template) - width, F.lit(0))
    return F.array_distinct(F.flatten(F.transform(at, lambda i: F.sequence(F.greatest(i - width + 1, F.lit(0)), F.least(i, last)))))


def _bare(window: Column) -> Column:
    """Whether a window has fewer than two literal words, and so goes by its own values."""
    return F.size(F.filter(window, lambda x: ~_slot(x))) < 2


def _hashed(found: Column, steps: Column, width: int) -> Column:
    return F.transform(steps, lambda i: F.struct(i.alias("pos"), F.xxhash64(F.slice(found, i + 1, width)).alias("h")))


def _own(marked: Column, template: Column, slots: Column, width: int) -> Column:
    """The bare windows by their own values. They are looked for only where slots stand close enough for one."""
    close = F.exists(F.sequence(F.lit(0), F.size(slots) - 1), lambda k: F.get(slots, k + max(width - 2, 0)) - F.get(slots, k) < width)
    bare = F.filter(_around(template, slots, width), lambda i: _bare(F.slice(template, i + 1, width)))
    found = F.when((F.size(slots) > 0) & ((F.size(template) < width) | F.coalesce(close, F.lit(False))), let(_plain(marked), lambda plain: _hashed(plain, bare, width)))
    return F.coalesce(found, F.array().cast(_WINDOWS))


def windows(table: DataFrame, *keys: str, widths: tuple[int, ...] = (WIDTH,)) -> DataFrame:
    """(keys, pos, h): the template windows of every row of table, of each of `widths` words.

    Templates are made in whole texts, by regular expressions; a window costs a hash. The values of its slots are
    taken later, where it met an item (see `slot_words`). Bare windows appear by their template as well, which no
    item has."""
    none = F.array().cast(_WINDOWS)
    each = lambda one: F.concat(*(one(n) for n in widths))

    def named(template: Column) -> Column:
        return let(_places(template, lambda x: x == NAME), lambda at: each(lambda n: _hashed(template, _around(template, at, n), n)))

    def every(marked: Column) -> Column:
        def placed(numbered: Column) -> Column:
            plain = let(_template(numbered, NONE), lambda t: each(lambda n: _hashed(t, _steps(t, n), n)))
            inner = F.when(numbered.contains(MARK), let(_template(numbered, INNER), named)).otherwise(none)
            slots = lambda t: let(_places(t, _slot), lambda at: F.concat(let(F.filter(at, lambda i: F.get(t, i) == NAME), lambda of: each(lambda n: _hashed(t, _around(t, of, n), n))), each(lambda n: _own(marked, t, at, n))))
            return F.concat(plain, inner, F.when(numbered.rlike(f"[{SIGNS}]"), let(_template(numbered, ALL), slots)).otherwise(none))

        return let(_numbered(marked), placed)

    return table.select(*keys, F.explode(let(_marked(F.col("text")), every)).alias("w")).select(*keys, "w.pos", "w.h")


def item_windows(items: DataFrame) -> DataFrame:
    """item_id, item_pos, h and item_slots (place in the window, type and value; null: none) of the benchmark's windows."""
    none = F.lit(None).cast("array<struct<at:int,type:string,value:string>>")

    def window(template: Column, plain: Column, i: Column) -> Column:
        def made(w: Column) -> Column:
            at = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda j: _slot(F.get(w, j)))
            values = F.transform(at, lambda j: F.struct(j.alias("at"), F.get(w, j).alias("type"), F.get(plain, i + j).alias("value")))
            bare = _bare(w)
            return F.struct(i.alias("item_pos"), F.when(bare, F.xxhash64(F.slice(plain, i + 1, WIDTH))).otherwise(F.xxhash64(w)).alias("h"), F.when(~bare & F.exists(w, _slot), values).otherwise(none).alias("item_slots"))

        return let(F.slice(template, i + 1, WIDTH), made)

    def form(numbered: Column, plain: Column, names: int) -> Column:
        steps = (lambda t: _steps(t, WIDTH)) if names == NONE else (lambda t: _around(t, _places(t, lambda x: x == NAME), WIDTH))
        return let(_template(numbered, names), lambda t: F.transform(steps(t), lambda i: window(t, plain, i)))

    every = let(_marked(F.col("text")), lambda marked: let(_numbered(marked), lambda numbered: let(_plain(marked), lambda plain: F.concat(*(form(numbered, plain, names) for names in (NONE, INNER, ALL))))))
    return items.select("item_id", F.explode(every).alias("w")).select("item_id", "w.*").distinct()


def slot_words(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc, pos and words of the windows `wanted` (doc, pos) of rows (doc, text): each text is cut once."""
    wanted = wanted.groupBy("doc").agg(F.collect_set("pos").alias("at"))
    rows = rows.join(size_checked(staged(wanted.select("doc")), BROADCAST_ROWS), "doc", "left_semi").dropDuplicates(["doc"])
    cut = let(words(F.col("text")), lambda found: F.transform("at", lambda i: F.struct(i.alias("pos"), F.slice(found, i + 1, WIDTH).alias("words"))))
    return rows.join(wanted, "doc").select("doc", F.explode(cut).alias("w")).select("doc", "w.pos", "w.words")


def held_items(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, text_h (see `text_hash`), item_id, n_windows, n_found, coverage and slot_agreement of the rows that hold an item.

    A row holds an item if at least `coverage` of the item's windows are in it, counting windows with slots only where
    the slots agree: in `coverage` of the slots of each type a value of the item has one value in the document, and in APART
    of them that value is no other's."""
    items = benchmark.select("item_id", "text").where(F.col("item_id").isNotNull()).dropDuplicates(["item_id"])
    short = [r["n"] for r in items.select(F.size(words(F.col("text"))).alias("n")).where(f"n between 1 and {WIDTH - 1}").distinct().collect()]  # four numbers at most
    item = staged(item_windows(items))
    size = item.groupBy("item_id").agg(F.countDistinct("item_pos").alias("n_windows"))
    # a struct of the id joins null ids with each other
    rows = docs.select(F.struct("doc_id", text_hash(F.col("text")).alias("text_h")).alias("doc"), "text")
    met = windows(rows, "doc", widths=(WIDTH, *short)).join(size_checked(item, BROADCAST_ROWS), "h")
    # windows without slots count wherever they are
    met = staged(met.select("doc", "item_id", "item_pos", "item_slots", F.when(F.col("item_slots").isNotNull(), F.col("pos")).alias("pos")).distinct())
    places = met.groupBy("doc", "item_id").agg(F.collect_set("item_pos").alias("any"), F.collect_set(F.when(F.col("item_slots").isNull(), F.col("item_pos"))).alias("plain"))
    places = staged(places.join(size_checked(size, BROADCAST_ROWS), "item_id").where(F.size("any") >= coverage * F.col("n_windows")).select("doc", "item_id", "n_windows", "plain"))
    slotted = staged(met.where(F.col("item_slots").isNotNull()).join(places.select("doc", "item_id", "n_windows"), ["doc", "item_id"]))
    pairs = F.transform("item_slots", lambda x: F.struct((F.col("item_pos") + x["at"]).alias("slot"), x["type"].alias("type"), x["value"].alias("theirs"), F.get("words", x["at"]).alias("ours")))
    slotted = slotted.join(slot_words(rows, slotted.select("doc", "pos")), ["doc", "pos"]).select("doc", "item_id", "n_windows", "item_pos", (F.col("pos") - F.col("item_pos")).alias("shift"), pairs.alias("pairs"))
    best = staged(instances(slotted, places, coverage))
    found = places.join(best, ["doc", "item_id"], "left").select("doc.doc_id", "doc.text_h", "item_id", "n_windows", F.greatest(F.size("plain"), F.coalesce("with_slots", F.lit(0))).cast("long").alias("n_found"), F.coalesce("slot_agreement", F.lit(1.0)).alias("slot_agreement"))
    return found.withColumn("coverage", F.col("n_found") / F.col("n_windows")).where(F.col("coverage") >= coverage).select("doc_id", "text_h", "item_id", "n_windows", "n_found", "coverage", "slot_agreement")


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, item_id, n_windows, n_found, coverage and slot_agreement of the rows (id and text) that hold an item."""
    return held_items(docs, benchmark, coverage).drop("text_h")


def instances(slotted: DataFrame, places: DataFrame, coverage: float) -> DataFrame:
    """doc, item_id, with_slots and slot_agreement of the best aligned instance of each item in each document.

    An instance is anchored at a shift. It is tried in two forms: the windows at that very shift, and for each window
    of the item the nearest place within the item's length, which bears words put in or left out. with_slots counts
    the windows found, those without slots among them, and is 0 where no instance's slots agree.

    What is read more than once is staged: as one plan it would be planned again after each of its exchanges, and fill
    the driver's memory."""
    slotted = slotted.groupBy("doc", "item_id", "n_windows", "item_pos", "shift").agg(F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    slotted = staged(slotted.withColumn("near", F.floor(F.col("shift") / F.col("n_windows"))))
    anchors = slotted.select("doc", "item_id", F.col("shift").alias("anchor"), "near").distinct().withColumn("near", F.explode(F.array(*(F.col("near") + k for k in (-1, 0, 1)))))
    away = F.abs(F.col("shift") - F.col("anchor"))
    aligned = slotted.join(anchors, ["doc", "item_id", "near"]).where(away <= F.col("n_windows")).groupBy("doc", "item_id", "anchor", "item_pos").agg(F.min_by("pairs", F.struct(away, "shift")).alias("pairs"), F.min(away).alias("away"))
    aligned = staged(aligned.withColumn("form", F.explode(F.when(F.col("away") == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1))))))
    key = ["doc", "item_id", "anchor", "form"]
    slots = aligned.select(*key, F.explode("pairs").alias("pair")).select(*key, "pair.*").distinct()
    values = staged(slots.groupBy(*key, "type", "theirs", "ours").agg(F.count(F.lit(1)).alias("n")))

    def settled(side: str, name: str) -> DataFrame:
        """By type, the share of the slots that have the value which is most frequent beside their value of a side."""
        most = values.groupBy(*key, "type", side).agg(F.max("n").alias("most"), F.sum("n").alias("all"))
        return most.groupBy(*key, "type").agg((F.sum("most") / F.sum("all")).alias(name))

    agreed = settled("theirs", "agreement").join(settled("ours", "apart"), [*key, "type"]).groupBy(*key).agg(F.min("agreement").alias("slot_agreement"), F.min("apart").alias("apart"))
    made = aligned.groupBy(*key).agg(F.collect_set("item_pos").alias("at")).join(agreed, key).join(places.select("doc", "item_id", "plain"), ["doc", "item_id"])
    n = F.when((F.col("slot_agreement") >= coverage) & (F.col("apart") >= APART), F.size(F.array_union("plain", "at"))).otherwise(0)
    return made.select("doc", "item_id", n.alias("with_slots"), "slot_agreement").groupBy("doc", "item_id").agg(F.max(F.struct("with_slots", "slot_agreement")).alias("best")).select("doc", "item_id", "best.*")
