"""Personal data: base patterns, and bootstrapped contextual extraction of unseen identifiers.

DataFrame functions only. Base entities (email, ip, card, phone) are seeds, whatever their shape. The lexical patterns
around an instance are the word before it, the two words before it, and the words on both sides of it; for an instance
inside a word, what stands before it in the word. Patterns and the values that they surround form a graph:

1. Patterns around at least `SUPPORT` different good values (seeds, and values found so far) are candidates.
2. A scan counts every value that a candidate surrounds. It is admitted if at least `ADMITTED` of them are good, so a
   word that stands before anything is never admitted, however many seeds follow it.
   Sketches of the numbers of values come first, so that no value is shuffled of a candidate that is far from this.
3. Over the graph of the admitted patterns, a pattern's confidence is the shrunk mean score of its values, and a value's
   score is the noisy-or of its patterns; seeds stay at one. Scores are swept until they settle, from the last round's.
   Values of high score are good from then on.
4. Their contexts bring new candidates, until a round admits no pattern or finds no value. What doesn't settle is an error.

Confident patterns mark the values of high score that they surround as identifiers, kind `id`. A pattern must have a
letter, and an identifier a character that is no letter: words of letters alone aren't marked.

Spans count code points, end exclusive. A scan takes time in proportion to the text: a match of a base expression starts
only at the start of a run or where the last match ended, which is where a leftmost match starts anyway, and offsets are
summed in blocks. Contexts, blanks and replacements are cut from pieces of the text, never from the whole of it. Texts are
folded whole, not word by word, and where few patterns or values are looked for, texts that have none aren't taken apart.

Defined cases: a null text counts as empty and has no spans; repeated rows are found one by one and score as one
value; a table without seeds gives base columns alone; other columns of the input are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import size_checked, staged
from .decontamination import let

_RUN = "[A-Za-z0-9._%+-]"
# The base expressions, by kind, in the order in which spans are listed.
BASE = {
    "email": rf"(?:\G|(?<!{_RUN})){_RUN}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
KINDS = [*BASE, "id"]
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_OPEN, _CLOSE = r"(\[<\"'=:", r",;)\]>"
OPENING = "([<\"'=:"
#: A word up to the end of its first token: opening marks, then what stands before closing ones.
TOKEN = rf"^[{_OPEN}]*+([^\s{_OPEN}{_CLOSE}]++)"
#: A token inside a word, after one of the opening marks.
INNER = rf"(?<=[{_OPEN}])[^\s{_OPEN}{_CLOSE}]++"
WORD = r"\S+"
ENDS = "[.!?]+$"
BLANK = "\ue000"
#: A pattern has a letter; an identifier has a character that is none.
LETTER, MARKED = r"\p{L}", r"[^\p{L}]"
#: Characters around a span in which its context is looked for; words over half of it aren't in patterns.
AROUND = 256
SUPPORT = 5
ADMITTED = 0.5
CONFIDENCE = 0.9
#: Scores have settled if none moves by more; sweeps and rounds after which it is an error that they haven't.
TOLERANCE = 1e-3
SWEEPS = 200
ROUNDS = 100
#: A candidate is counted value by value if a sketch of its values is under this many times what it may have.
SKETCHED = 1.5
#: Code points of the pieces that a text is cut into.
PIECE = 1024
#: Matches whose offsets are summed together.
BLOCK = 256
#: Documents with discovered spans are broadcast up to this many; beyond it Spark shuffles.
EXTRA_ROWS = 100_000
#: Patterns, values or seeds are broadcast up to this many (some 10 MB); beyond it Spark shuffles.
PATTERN_ROWS = 200_000
#: Texts are looked through for up to so many patterns, or parts of words, before they are taken apart.
FEW, FEW_PARTS = 1000, 32
#: Candidates are sketched in a 64th of the texts, and those that are left in an eighth; the rest are counted in all.
SHARES = (64, 8)
SPAN = "array<struct<kind:int,start:bigint,end:bigint>>"


def located(text: Column, pattern: str, kind: int, accepted) -> Column:
    """array<struct<kind, start, end, value>> of the matches that `accepted` holds for.

    Offsets are summed inside blocks of matches and then over blocks, since an array that grows by one costs its length."""
    spans = "array<struct<kind:int,start:bigint,end:bigint,value:string>>"
    zipped = F.filter(F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("between")), lambda x: x["found"].isNotNull())

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["between"])
        end = start + F.length(x["found"])
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["found"].alias("value"))
        return F.struct(end.alias("at"), F.when(accepted(x["found"]), F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    def block(part: Column) -> Column:
        return F.aggregate(part, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(spans).alias("spans")), add)

    def joined(blocks: Column) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("starts"))
        starts = F.aggregate(blocks, zero, lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts")), lambda acc: acc["starts"])
        moved = lambda b, at: F.transform(b["spans"], lambda x: F.struct(x["kind"].alias("kind"), (x["start"] + at).alias("start"), (x["end"] + at).alias("end"), x["value"].alias("value")))
        return F.flatten(F.zip_with(blocks, starts, moved))

    def cut(every: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(every) - 1) / BLOCK).cast("int")), lambda k: block(F.slice(every, k * BLOCK + 1, BLOCK)))

    return let(zipped, lambda every: F.when(F.size(every) == 0, F.array().cast(spans)).when(F.size(every) <= BLOCK, block(every)["spans"]).otherwise(let(cut(every), joined)))


def pieces(text: Column) -> Column:
    """The text in pieces of PIECE code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def between(parts: Column, start: Column, end: Column) -> Column:
    """The code points from start to end (exclusive) of a text in pieces; what it costs doesn't depend on the text's length."""
    first, last = F.floor(start / PIECE).cast("int"), F.floor((end - 1) / PIECE).cast("int")
    found = F.substring(F.array_join(F.slice(parts, first + 1, last - first + 1), ""), (start % PIECE + 1).cast("int"), (end - start).cast("int"))
    return F.when(end > start, found).otherwise(F.lit(""))


def greatest_before(values: Column) -> Column:
    """For each of the values (not empty, not negative) the greatest one before it, zero for the first; by blocks."""
    zero = lambda at: F.struct(at.alias("at"), F.array().cast("array<bigint>").alias("out"))
    added = lambda acc, at: F.struct(F.greatest(acc["at"], at).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda k: F.slice(values, k * BLOCK + 1, BLOCK))

    def joined(blocks: Column) -> Column:
        starts = F.aggregate(blocks, zero(F.lit(0).cast("long")), lambda acc, b: added(acc, F.array_max(b)), lambda acc: acc["out"])
        return F.flatten(F.zip_with(blocks, starts, lambda b, at: F.aggregate(b, zero(at), added, lambda acc: acc["out"])))

    return let(blocks, joined)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


ACCEPTED = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
    "card": lambda v: F.length(_digits(v)).between(16, 19) & F.call_function("luhn_check", _digits(v)),
    "phone": lambda v: F.length(_digits(v)).between(8, 15),
}
#: What a text must have for a kind to be looked for at all.
WORTH = {"email": lambda t: t.contains("@"), "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"), "card": lambda t: t.rlike("[0-9](?:[ -]?[0-9]){15}"), "phone": lambda t: t.contains("+")}


def base_spans(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, h (a hash of the text) and one array of spans for each base kind, of every row of docs.

    A span has its value and what stands around it: a side that isn't cut has a blank at its outer end."""
    text = F.coalesce("text", F.lit(""))
    none = F.array().cast("array<struct<kind:int,start:bigint,end:bigint,value:string,before:string,after:string>>")

    def sides(parts: Column, x: Column) -> Column:
        before = between(parts, F.greatest(x["start"] - AROUND, F.lit(0)), x["start"])
        after = between(parts, x["end"], x["end"] + AROUND)
        whole = lambda side: F.when(F.length(side) < AROUND, F.lit(" ")).otherwise(F.lit(""))
        return x.withField("before", F.concat(whole(before), before)).withField("after", F.concat(after, whole(after)))

    def told(spans: Column) -> Column:
        return F.when(F.size(spans) == 0, none).otherwise(let(pieces(text), lambda parts: F.transform(spans, lambda x: sides(parts, x))))

    columns = [F.when(text.rlike("[@0-9]") & WORTH[kind](text), let(located(text, pattern, k, ACCEPTED[kind]), told)).otherwise(none).alias(kind) for k, (kind, pattern) in enumerate(BASE.items())]
    return docs.select(*keep, F.xxhash64(text).alias("h"), *columns)


def _folded(text: Column) -> Column:
    """text in lower case with nines for digits. Words of a folded text are the folded words: no blank comes or goes."""
    return F.regexp_replace(F.lower(text), "[0-9]", "9")


def _short(word: Column) -> Column:
    """The word, or null if there is none or it is too long for a pattern."""
    return F.when(F.length(word).between(1, AROUND // 2), word)


def _patterns(earlier: Column, before: Column, after: Column) -> Column:
    """The patterns around a token, of the folded words around it (null or empty: none); some may be null."""
    earlier, before, after = _short(earlier), _short(before), _short(after)
    return F.array(before, F.concat(earlier, F.lit(" "), before), F.concat(before, F.lit(f" {BLANK} "), after))


def seeds(spans: DataFrame) -> DataFrame:
    """pattern and value of every base span, in each of its contexts."""
    c = spans.select(F.explode(F.concat(*BASE)).alias("c")).select("c.value", _folded(F.col("c.before")).alias("before"), _folded(F.col("c.after")).alias("after"))
    word = lambda side, pattern: F.regexp_extract(side, pattern, 1)
    inside = F.array(_short(word(F.col("before"), r"\s(\S+)$")))
    apart = _patterns(word(F.col("before"), r"\s(\S+)\s+\S+\s+$"), word(F.col("before"), r"\s(\S+)\s+$"), word(F.col("after"), r"^\S*\s+(\S+)\s"))
    return c.select("value", F.explode(F.when(F.col("before").rlike(r"\S$"), inside).otherwise(apart)).alias("pattern")).where(F.col("pattern").rlike(LETTER)).select("pattern", "value").distinct()


def blanked(text: Column) -> Column:
    """text with BLANK for every character of its base spans. Spans of different kinds may overlap."""

    def without(t: Column, spans: Column) -> Column:
        blank = lambda x: F.repeat(F.lit(BLANK), (x["end"] - x["start"]).cast("int"))
        since = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1)["end"])
        joined = lambda parts: F.concat(F.array_join(F.transform(spans, lambda x, i: F.concat(between(parts, since(i), x["start"]), blank(x))), ""), between(parts, F.get(spans, F.size(spans) - 1)["end"], F.length(t)))
        return F.when(F.size(spans) == 0, t).otherwise(let(pieces(t), joined))

    def step(out: Column, k: int, kind: str) -> Column:
        found = located(text, BASE[kind], k, ACCEPTED[kind])
        return let(out, lambda t: F.when(WORTH[kind](text), let(found, lambda spans: without(t, spans))).otherwise(t))

    out = text
    for k, kind in enumerate(BASE):
        out = step(out, k, kind)
    return F.when(text.rlike("[@0-9]"), out).otherwise(text)


def words(docs: DataFrame, patterns: list[str] | None = None) -> DataFrame:
    """h, i, word, earlier, before and after of every word of the texts: its folded neighbours, empty if there are none.

    With patterns, only of words that one of these surrounds or opens."""
    text = F.coalesce("text", F.lit("")).alias("text")
    found = lambda c: F.regexp_extract_all(c, F.lit(WORD), F.lit(0))
    texts = docs.select(text).select(F.xxhash64("text").alias("h"), blanked(F.col("text")).alias("b")).select("h", found(F.col("b")).alias("w"), found(_folded(F.col("b"))).alias("f"))
    if patterns is not None:
        of = lambda k: F.get("f", k)
        heads, openings = {p.split(f" {BLANK} ")[0].split(" ")[-1] for p in patterns}, [_one_sigma(F.lit(p)) for p in patterns if p[-1] in OPENING]
        opened = lambda i: F.exists(F.array(*openings), lambda p: _one_sigma(of(i)).contains(p)) if openings else F.lit(False)
        at = F.when(F.size("f") > 0, F.filter(F.sequence(F.lit(0), F.size("f") - 1), lambda i: of(i - 1).isin(*heads) | opened(i)))
        at = F.filter(at, lambda i: F.exists(_patterns(of(i - 2), of(i - 1), of(i + 1)), lambda p: p.isin(*patterns)) | opened(i))
        each = F.transform(at, lambda i: F.struct(i.alias("i"), F.get("w", i).alias("word"), *(F.coalesce(of(i + k), F.lit("")).alias(name) for k, name in ((-2, "earlier"), (-1, "before"), (1, "after")))))
        return texts.select("h", F.explode(each).alias("x")).select("h", "x.*")
    none, all_but = F.array(F.lit("")), lambda n: F.slice("f", F.lit(1), F.greatest(F.size("f") - n, F.lit(0)))
    each = F.arrays_zip(F.col("w").alias("word"), F.concat(none, none, all_but(2)).alias("earlier"), F.concat(none, all_but(1)).alias("before"), F.slice("f", F.lit(2), F.size("f")).alias("after"))
    return texts.select("h", F.posexplode(each).alias("i", "x")).select("h", "i", "x.*")


def few(rows: DataFrame, most: int) -> list[str] | None:
    """The strings of rows (one column), or None if they are more than `most`."""
    found = [r[0] for r in rows.limit(most + 1).collect()]
    return found if len(found) <= most else None


def _one_sigma(text: Column) -> Column:
    """A folded text whose sigmas are alike: at the end of a word they have another form, and a part of a word ends anywhere."""
    return F.regexp_replace(text, "\u03c2", "\u03c3")


def _in_place(pattern: str) -> str | None:
    """An expression for the pattern's words in their places, in a text in lower case; None if one of them has a BLANK.

    Blanking joins words of a text only inside a card or a phone number, so other texts have the pattern as it is."""
    parts = pattern.split(f" {BLANK} ")
    if len(parts) > 2 or any(BLANK in x for x in parts):
        return None
    quoted = [r"\s+".join("[0-9]".join(rf"\Q{x}\E" if x else "" for x in w.split("9")) for w in part.split(" ")) for part in parts]
    return rf"{quoted[0]}\s+\S" + (rf"++\s+{quoted[1]}(?!\S)" if len(parts) == 2 else "")


def holding(docs: DataFrame, patterns: list[str]) -> DataFrame:
    """docs that may have an instance of one of the patterns.

    A word without BLANK stands in the text itself as well. Few patterns are looked for word by word (see `_in_place`);
    of more, the longest word, or the pattern as a part of the text if it opens a word."""
    openings = [p for p in patterns if p[-1] in OPENING]
    longest = {max((w for w in p.split(" ") if BLANK not in w), key=len, default="") for p in patterns if p[-1] not in OPENING}
    if "" in longest or len(openings) > FEW_PARTS or any(BLANK in p for p in openings):
        return docs
    text = F.coalesce("text", F.lit(""))
    folded = _folded(text)
    has = F.arrays_overlap(F.split(folded, r"\s+", -1), F.array(*map(F.lit, sorted(longest))).cast("array<string>"))
    placed = [_in_place(p) for p in patterns if p[-1] not in OPENING]
    if placed and len(placed) <= FEW_PARTS and None not in placed:
        has = F.lower(text).rlike(rf"(?<!\S)(?:{'|'.join(placed)})") | ((WORTH["card"](text) | WORTH["phone"](text)) & has)
    for p in openings:
        has = has | _one_sigma(folded).contains(_one_sigma(F.lit(p)))
    return docs.where(has)


def _first(word: Column) -> Column:
    """The token that a word opens with, without end marks; empty if there is none."""
    return F.regexp_replace(F.regexp_extract(word, TOKEN, 1), ENDS, "")


def _inner(word: Column) -> Column:
    """array<struct<at, value>> of the tokens inside a word, after an opening mark."""
    token = lambda x: F.struct(x["start"].alias("at"), F.regexp_replace(x["value"], ENDS, "").alias("value"))
    return F.when(word.rlike(INNER), F.transform(located(word, INNER, 0, lambda v: F.lit(True)), token)).otherwise(F.array().cast("array<struct<at:bigint,value:string>>"))


def _named(value: Column) -> Column:
    return (value != "") & ~value.contains(BLANK)


def _inside(word: Column, at: Column) -> Column:
    return _short(_folded(F.left(word, at.cast("int"))))


def instances(docs: DataFrame, known: DataFrame) -> DataFrame:
    """h, i, at, value and pattern of every token of the texts that a known pattern (column pattern) surrounds.

    It starts `at` characters into word i. Base spans are left out: they are instances already."""
    known = size_checked(staged(known.select("pattern").distinct()), PATTERN_ROWS)
    marked = known.where(F.col("pattern").rlike(f"[{_OPEN}]$"))
    head = F.substring_index(F.substring_index("pattern", f" {BLANK} ", 1), " ", -1).alias("head")
    heads = size_checked(staged(known.select(head).distinct()), PATTERN_ROWS)
    patterns = few(known, FEW)
    rows = words(docs) if patterns is None else words(holding(docs, patterns), patterns)
    around = rows.join(heads, F.col("before") == F.col("head"), "left_semi").where(~F.col("word").rlike(f"^[{_OPEN}]"))
    around = around.select("h", "i", "word", F.explode(_patterns(*map(F.col, ("earlier", "before", "after")))).alias("pattern"))
    around = around.join(known, "pattern", "left_semi").select("h", "i", F.lit(0).cast("long").alias("at"), _first(F.col("word")).alias("value"), "pattern")
    if not marked.isEmpty():
        inner = rows.select("h", "i", "word", F.explode(_inner(F.col("word"))).alias("t")).select("h", "i", "t.at", "t.value", _inside(F.col("word"), F.col("t.at")).alias("pattern"))
        around = around.unionByName(inner.join(size_checked(marked, PATTERN_ROWS), "pattern", "left_semi"))
    return around.where(_named(F.col("value")))


def contexts(docs: DataFrame, values: DataFrame) -> DataFrame:
    """The different (pattern, value) of all places where one of the values (column value) stands."""
    first = F.array(F.struct(F.lit(0).cast("long").alias("at"), _first(F.col("word")).alias("value")))
    tokens = F.when(F.col("word").rlike(f"[{_OPEN}]"), F.concat(F.when(F.col("word").rlike(f"^[^{_OPEN}]"), first).otherwise(F.array().cast("array<struct<at:bigint,value:string>>")), _inner(F.col("word")))).otherwise(first)
    parts = few(values.select("value").distinct(), FEW_PARTS)
    if parts is not None:  # values have no blanks for spans, so they stand in the texts
        docs = docs.where(F.exists(F.array(*map(F.lit, parts)).cast("array<string>"), lambda x: F.coalesce("text", F.lit("")).contains(x)))
    found = words(docs).select("word", "earlier", "before", "after", F.explode(tokens).alias("t")).select("*", "t.at", "t.value").join(size_checked(values, PATTERN_ROWS), "value", "left_semi")
    around = _patterns(*map(F.col, ("earlier", "before", "after")))
    found = found.select("value", F.explode(F.when(F.col("at") == 0, around).otherwise(F.array(_inside(F.col("word"), F.col("at"))))).alias("pattern"))
    return found.where(F.col("pattern").rlike(LETTER)).select("pattern", "value").distinct()


def placed(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """h and extra: where the hits (h, i, at, value) are in their texts."""
    text = F.coalesce("text", F.lit(""))
    hits = hits.groupBy("h").agg(F.collect_set(F.struct("i", "at", F.length("value").alias("size"))).alias("hits"))
    rows = docs.select(F.xxhash64(text).alias("h"), text.alias("text")).join(size_checked(staged(hits), EXTRA_ROWS), "h").dropDuplicates(["h"])
    start = lambda found, x: F.get(found, x["i"])["start"] + x["at"]
    spans = let(located(blanked(F.col("text")), WORD, 0, lambda v: F.lit(True)), lambda found: F.transform("hits", lambda x: F.struct(F.lit(len(BASE)).alias("kind"), start(found, x).alias("start"), (start(found, x) + x["size"]).alias("end"))))
    return rows.select("h", F.array_sort(spans).cast(SPAN).alias("extra"))


def scored(edges: DataFrame, known: DataFrame | None = None, sweeps: int = SWEEPS) -> tuple[DataFrame, DataFrame]:
    """(pattern, confidence) and (value, seed, score) over edges (pattern, value, seed), once no score moves any more.

    Sweeps start from known (value, score); other values start at one if they are seeds, at zero if not."""
    scores = edges.groupBy("value").agg(F.max("seed").alias("seed"))
    if known is None:
        scores = scores.withColumn("score", F.col("seed").cast("double"))
    else:
        scores = scores.join(known.select("value", "score"), "value", "left").withColumn("score", F.coalesce("score", F.col("seed").cast("double")))
    def sweep(scores: DataFrame) -> tuple[DataFrame, DataFrame]:
        now = edges.select("pattern", "value").join(scores.select("value", "seed", "score"), "value")
        patterns = now.groupBy("pattern").agg((F.sum("score") / (F.count(F.lit(1)) + 0.25)).alias("confidence"))
        told = now.join(patterns, "pattern").groupBy("value").agg(F.max("seed").alias("seed"), F.max("score").alias("last"), F.sum(F.log1p(-F.least("confidence", F.lit(0.999)))).alias("doubt"))
        return patterns, told.select("value", "seed", "last", F.when(F.col("seed"), 1.0).otherwise(1 - F.exp("doubt")).alias("score"))

    for _ in range(0, sweeps, 3):
        for _ in range(2):
            scores = sweep(scores)[1]
        before = staged(scores)
        patterns, scores = sweep(before)
        scores = staged(scores)
        if (scores.agg(F.max(F.abs(F.col("score") - F.col("last")))).first()[0] or 0) <= TOLERANCE:
            return staged(patterns), scores.drop("last")
    raise RuntimeError(f"scores of patterns did not settle in {sweeps} sweeps")


def promising(docs: DataFrame, many: DataFrame) -> DataFrame:
    """The patterns of many (pattern, n good values) that may be admitted, by sketches of how many values they surround.

    A pattern is admitted if its good values are at least ADMITTED of all; a sketch is wrong by a twentieth, and counts
    here only if it is wrong by a half. What surrounds too many values in a share of the texts does so in all of them, so
    words that stand before anything leave early, and only rarer ones are looked for in every text. What is left after
    the last share surrounds about as many times its good values as there are shares, so its values may be shuffled."""
    for share in SHARES:
        part = docs.where(F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(share)) == 0)
        about = instances(part, many).groupBy("pattern").agg(F.approx_count_distinct("value", 0.05).alias("about"))
        many = staged(many.join(about, "pattern", "left").where(F.coalesce("about", F.lit(0)) <= SKETCHED * F.col("n") / ADMITTED).select("pattern", "n"))
        if many.isEmpty():
            break
    return many.select("pattern")


def bootstrapped(docs: DataFrame, given: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE, rounds: int = ROUNDS) -> DataFrame | None:
    """The instances (h, i, at, value, pattern) of identifiers that bootstrapping from the seeds finds; None if none."""
    given = staged(given)
    good = given.select("value").distinct()
    seen, admitted, edges, scores, firm, sure = given, None, None, None, None, None
    for _ in range(rounds):
        many = seen.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= support)
        if admitted is not None:
            many = many.join(admitted, "pattern", "left_anti")
        many = staged(many)
        if many.isEmpty():
            break
        many = staged(promising(docs, many))
        if many.isEmpty():
            break
        pairs = staged(seen.join(many, "pattern", "left_semi").select("pattern", "value").unionByName(instances(docs, many).select("pattern", "value")).distinct())
        share = pairs.join(size_checked(staged(good.withColumn("good", F.lit(1.0))), PATTERN_ROWS), "value", "left").groupBy("pattern").agg((F.sum(F.coalesce("good", F.lit(0.0))) / F.count(F.lit(1))).alias("share"))
        new = staged(share.where(F.col("share") >= ADMITTED).select("pattern"))
        if new.isEmpty():
            break
        more = pairs.join(size_checked(new, PATTERN_ROWS), "pattern", "left_semi").join(given.withColumn("seed", F.lit(True)), ["pattern", "value"], "left").withColumn("seed", F.coalesce("seed", F.lit(False)))
        admitted, edges = (new, staged(more)) if edges is None else (staged(admitted.union(new)), staged(edges.unionByName(more)))
        patterns, scores = scored(edges, scores)
        firm = staged(patterns.where(F.col("confidence") >= confidence).select("pattern"))
        sure = staged(scores.where(~F.col("seed") & (F.col("score") >= confidence) & F.col("value").rlike(MARKED)).select("value"))
        fresh = staged(sure.join(good, "value", "left_anti"))
        if fresh.isEmpty():
            break
        good = staged(good.union(fresh))
        seen = staged(seen.unionByName(contexts(docs, fresh)).distinct())
    else:
        raise RuntimeError(f"bootstrapping did not settle in {rounds} rounds")
    if sure is None or sure.isEmpty():
        return None
    return instances(docs, firm).join(size_checked(sure, PATTERN_ROWS), "value", "left_semi")


def discovered(docs: DataFrame, spans: DataFrame, confidence: float = CONFIDENCE) -> DataFrame:
    """h and extra: the spans that confident patterns mark beside the base ones, by the hash of the text."""
    hits = bootstrapped(docs, seeds(spans), confidence=confidence)
    if hits is None:
        return docs.sparkSession.createDataFrame([], f"h long, extra {SPAN}")
    return placed(docs, hits)


def personal_data(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, h, the spans of each base kind and extra, of every row of docs."""
    spans = staged(base_spans(docs, keep))
    extra = discovered(docs, spans)
    return spans.join(extra, "h", "left").select(*keep, "h", *BASE, F.coalesce("extra", F.array().cast(SPAN)).alias("extra"))


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def all_spans(with_extra: bool = True) -> Column:
    bare = lambda c: F.transform(c, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return F.concat(*(bare(F.col(k)) for k in BASE), *([bare(F.col("extra"))] if with_extra else []))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_id of every row of docs."""
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in BASE]
    return personal_data(docs).select("doc_id", *counts, F.sha2(_listed(all_spans(False)), 256).alias("base_sha256"), _listed(all_spans()).alias("spans"), F.size("extra").cast("long").alias("n_id"))


def redacted(text: Column, spans: Column) -> Column:
    """text with each span (kind, start, end) replaced by its kind in brackets; spans inside others are merged."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("end"), x["kind"].alias("kind"))))

    def replaced(parts: Column, found: Column) -> Column:
        ends = F.transform(found, lambda x: -x["end"])
        named = lambda till: F.transform(found, lambda x, i: F.when(x["start"] >= F.get(till, i), F.concat(between(parts, F.get(till, i), x["start"]), F.get(names, x["kind"]))).otherwise(F.lit("")))
        return F.concat(let(greatest_before(ends), lambda till: F.array_join(named(till), "")), between(parts, F.array_max(ends), F.length(text)))

    return F.when(F.size(spans) > 0, let(pieces(text), lambda parts: let(ordered, lambda found: replaced(parts, found)))).otherwise(text)
