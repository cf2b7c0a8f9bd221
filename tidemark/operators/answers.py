"""Typed answer spans: people, entities, counts and years that sentences of documents name, and the best one of a question.

Sentences are rows. A sentence gets its relevance once; then every span in it that a pattern or a run of capitals marks is
an element with its place, and what a span is worth follows from the sentence, from what stands around it and from the
distance to the nearest word that tells of a winner. The spans of a document are folded in the order in which they stand,
a later one wins only by a higher score. A document gives one candidate of a kind, a question the best of its documents.

rows: id (unique), query_id, query, place (the document's rank), url, title, text, rank_score, retrieval_score, and
acknowledgements, grounded and memorial where they are known (see `with_evidence`). Empty texts give no candidate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import answers as A
from tidemark.functions import lexicons as L
from tidemark.functions import pages as P
from tidemark.functions import questions as Q
from tidemark.functions import similarity as S
from tidemark.functions import text as T
from tidemark.functions.dialect import SPARK
from tidemark.operators import grounding as G
from tidemark.operators.documents import sections, thanked_people
from tidemark.operators.staging import kept

#: Characters of a document that its sentences are taken from, those of one without a telling sentence, and for a year.
READ, OPENING, YEAR_READ = 8000, 2500, 3500
#: Sentences of a document that spans are looked for in, and the relevance that they need.
SENTENCES, RELEVANT = 6, 0.16
# A run of capitalised words; what a winner, an entity and a count look like; and what they weigh.
_NAME = r"([A-Z][A-Za-z'`.-]+(?:\s+[A-Z][A-Za-z'`.-]+){1,3})"
_THING = r"([A-Z][A-Za-z0-9'`.-]+(?:\s+[A-Z][A-Za-z0-9'`.-]+){0,3})"
WINNERS = (
    rf"\b(?:winner|won by|won|crowned|proclaimed|named|declared)\b.{{0,60}}?\b{_NAME}\b",
    rf"\b{_NAME}\b.{{0,90}}?\b(?:won|was crowned|was proclaimed|was declared|emerged as)\b",
    rf"\b(?:beauty\s+pageant|pageant|contest|festival queen|queen|candidate)\b.{{0,40}}?\b{_NAME}\b",
    rf"\b{_NAME}\b\s+(?:was\s+)?(?:crowned|proclaimed|declared|named)\s+(?:the\s+)?(?:winner|queen|festival queen)\b",
    rf"\bwinner\b.{{0,30}}\b(?:was|is|goes to|went to)\s+{_NAME}\b",
)
ENTITIES = (
    rf"\b{_THING}\b.{{0,60}}\b(?:potential\s+)?(?:antagonist|villain|rival|companion)\b",
    rf"\b(?:potential\s+)?(?:antagonist|villain|rival|character)\b.{{0,60}}\b{_THING}\b",
    rf"\b(?:named|called|known as)\s+{_THING}\b",
)
_MOVES = r"(?:movements|moves|abilities|effects|techniques|attacks)"
COUNTS = (rf"(?i)\b(\d+)\s+(?:different\s+)?{_MOVES}\b", rf"(?i)\b(?:used|has used|performed|wields)\s+(\d+)\s+(?:different\s+)?{_MOVES}\b")
TRIGGERS = r"\b(?:winner|won|crowned|proclaimed|declared|pageant|contest|queen|coronation)\b"
CONTESTS, CROWNED = ("winner", "won", "pageant", "contest"), ("winner", "won", "pageant", "contest", "queen")
RIVALS, SAID, CALLED = ("antagonist", "villain", "rival"), ("named", "called", "crowned", "proclaimed"), ("named", "called", "known as", "companion")
NO_ENTITY = ("the", "this", "that", "her", "his", "their", "its")
LOSSES = r"(?:victims?|dead|killed|died|executed|massacre|battle|attack|tragedy|uprising|revolt)"
PERSON_TYPES, THING_TYPES = ("person_last_name", "person_name"), ("entity_and_count", "entity_name", "count", "generic")
FULL_NAME = ("full name", "first and last name", "first and last names", "first name and last name")


def let(value: Column, body) -> Column:
    """body of value, which is evaluated once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def regex(pattern: str) -> Column:
    return F.lit(("(?U)" if r"\b" in pattern else "") + pattern)


def located(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, end, value>> of a pattern's matches: where each stands, and its group."""
    found = F.arrays_zip(F.regexp_extract_all(text, regex(pattern), F.lit(0)).alias("whole"), F.regexp_extract_all(text, regex(pattern), F.lit(group)).alias("value"), F.split(text, ("(?U)" if r"\b" in pattern else "") + pattern, -1).alias("between"))
    kind = "array<struct<start:int,end:int,value:string>>"

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["between"])
        end = start + F.length(x["whole"])
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value")))).alias("spans"))

    return F.aggregate(F.filter(found, lambda x: x["whole"].isNotNull()), F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("spans")), add, lambda acc: acc["spans"])


def first_match(text: Column, pattern: str) -> Column:
    """array of the first match's struct<start, end, value>; value is its group 1. Empty if there is none."""
    return F.slice(located(text, pattern, 1), 1, 1)


def nearest(place: Column, places: Column) -> Column:
    """The distance from a place to the nearest of others; null if there are none."""
    return F.array_min(F.transform(places, lambda p: F.abs(p - place)))


def wanted(questions: DataFrame) -> DataFrame:
    """questions (id, query) with what they want, their terms, and what the rules on years ask."""
    spark, d = questions.sparkSession, SPARK
    with G.named(questions.select("id", "query")) as q:
        flags = "answer_type, prefers_event_sources, prefers_character_sources, targets_count, targets_person, requires_acknowledgement_section, is_open_domain_browsecomp"
        rows = spark.sql(f"SELECT id, {flags}, {T.years(d, 'query')} AS query_years FROM {Q.intent(d, q)} i")
    return G.asked(questions).join(rows, "id")


def with_sentences(rows: DataFrame, text: str) -> DataFrame:
    """rows with sentence, nth and low for each sentence of a text column, its relevance to the question, and its marks."""
    d = SPARK
    each = rows.select("*", F.posexplode(F.expr(T.sentences(d, text))).alias("nth", "sentence")).withColumns({"low": F.lower("sentence"), "lexical": S.lexical_relevance(F.col("query"), F.col("sentence"))})
    each = each.withColumn("own", F.expr(T.important_terms(d, "low")))
    has = lambda hints: F.expr(d.any_in("low", hints))
    each = each.withColumns({
        "specific": F.expr(f"CAST({T.specificity_overlap(d, 'terms', 'own', 'low')} AS DOUBLE)"), "has_person": F.expr(f"{d.size(T.person_names(d, 'sentence'))} > 0"), "has_winner": has(L.EVENT_WINNER_HINTS),
        "has_character": has(L.CHARACTER_QUERY_HINTS), "has_ability": has(L.ABILITY_QUERY_HINTS), "is_called": has(CALLED), "is_said": has(SAID), "has_number": F.expr(d.matches("sentence", r"\b\d+\b")),
        "is_crowned": has(CROWNED), "is_rival": has(RIVALS), "has_companion": has((*RIVALS, "companion")),
    }).withColumn("at", F.concat_ws(":", "id", "nth"))
    each = kept(each)
    with G.named(each.where("prefers_event_sources").select(F.col("at").alias("id"), F.col("sentence").alias("text"))) as said:
        winners = each.sparkSession.sql(f"SELECT id AS at, winner_score AS told FROM {A.winner_evidence(d, said)} w")
    return each.join(winners, "at", "left").drop("at").withColumn("told", F.coalesce("told", F.lit(0.0)))


def weighed(*rules: tuple[str, float]) -> Column:
    """The sum of the weights of the conditions that hold."""
    return sum((F.when(F.expr(c), w).otherwise(0.0) for c, w in rules), F.lit(0.0))


# What makes a sentence evidence for a person, or for anything else.
PERSON_EVIDENCE = (("has_person", 0.12), ("has_winner", 0.18), ("is_said", 0.08))
THING_EVIDENCE = (("prefers_character_sources AND has_character", 0.18), ("targets_count AND has_ability", 0.18), ("prefers_event_sources AND has_winner", 0.18), ("prefers_event_sources AND has_person", 0.1), ("is_called", 0.07), ("has_number AND targets_count", 0.05), ("has_number AND NOT targets_count", 0.02))


def evidence_texts(rows: DataFrame) -> DataFrame:
    """id and evidence: the sentences that tell most of what is asked, else the text's opening, else the thanks asked for."""
    d = SPARK
    person = F.col("answer_type").isin(*PERSON_TYPES)
    read = F.expr(T.normalize_whitespace(d, f"CASE WHEN answer_type IN ('{PERSON_TYPES[0]}', '{PERSON_TYPES[1]}') THEN concat(title, '. ', left(text, {READ})) ELSE left(text, {READ}) END"))
    base = rows.withColumn("read", read)
    score = F.when(person, F.col("lexical") + 0.12 * F.col("specific") + weighed(*PERSON_EVIDENCE) + 0.2 * F.col("told")).otherwise(F.col("lexical") + 0.14 * F.col("specific") + weighed(*THING_EVIDENCE))
    each = with_sentences(base, "read").select("id", "nth", "sentence", score.alias("score"), (person & F.col("prefers_event_sources") & (F.col("told") >= 0.38)).alias("strong"))
    by_score, by_place = Window.partitionBy("id").orderBy(F.desc("score"), "nth"), Window.partitionBy("id", "strong").orderBy("nth")
    each = each.withColumns({"turn": F.row_number().over(by_score), "strong_turn": F.row_number().over(by_place)})
    item = lambda order, condition: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(condition, F.struct(F.col(order).alias("k"), "sentence")))), lambda x: x["sentence"]), "\n")
    chosen = each.groupBy("id").agg(item("strong_turn", F.col("strong") & (F.col("strong_turn") <= SENTENCES)).alias("strong"), item("turn", (F.col("score") >= RELEVANT) & (F.col("turn") <= SENTENCES)).alias("best"))
    told = base.select("id", "read", "requires_acknowledgement_section", "acknowledgements", "text", person.alias("person")).join(chosen, "id", "left")
    thanks = F.when(F.col("requires_acknowledgement_section") & F.col("person"), F.coalesce(F.nullif("acknowledgements", F.lit("")), F.col("text")))
    return told.select("id", F.coalesce(thanks, F.nullif("strong", F.lit("")), F.nullif("best", F.lit("")), F.left("read", F.lit(OPENING))).alias("evidence"))


CANDIDATE = "struct<score:double,value:string,evidence:string>"
CANDIDATES = "array<struct<score:double,value:string>>"


def fold(sentences: Column, first: str, then: str | None = None, enough: float = 0.6) -> Column:
    """The best span of a document's sentences (structs with sentence and span arrays), in order; a later one must be better.

    A sentence's spans `then` are looked at only while nothing has reached `enough`."""
    better = lambda sentence: lambda best, c: F.when(c["score"] > best["score"], F.struct(c["score"].alias("score"), c["value"].alias("value"), sentence.alias("evidence")).cast(CANDIDATE)).otherwise(best)

    def step(best: Column, s: Column) -> Column:
        now = F.aggregate(s[first], best, better(s["sentence"]))
        if then is None:
            return now
        return let(now, lambda b: F.when(b["score"] >= enough, b).otherwise(F.aggregate(s[then], b, better(s["sentence"]))))

    none = F.struct(F.lit(0.0).alias("score"), F.lit("").alias("value"), F.lit("").alias("evidence")).cast(CANDIDATE)
    return F.aggregate(sentences, none, step)


def person_spans(each: DataFrame) -> DataFrame:
    """Sentences (see `with_sentences`) with the candidates for a person: `explicit` ones by pattern, and all `capitals`."""
    d = SPARK
    text, event = F.col("sentence"), F.col("prefers_event_sources")
    runs = located(text, rf"\b{_NAME}\b", 1)
    long_run = first_match(text, r"\b((?:[A-Z][A-Za-z'`.-]+\s+){4,}[A-Z][A-Za-z'`.-]+)\b")
    each = each.withColumns({"triggers": F.transform(located(F.col("low"), TRIGGERS), lambda x: x["start"]), "runs": runs, "patterned": F.concat(*(first_match(text, p) for p in WINNERS)), "long_run": long_run})
    clean = lambda x: F.regexp_replace(x["value"], r"\s+", " ")

    def usable(x: Column) -> Column:
        follows = F.substring(text, x["end"] + 1, F.length(text)).rlike(r"^\s+[A-Z][A-Za-z'`.-]{2,}(?U:\b)")
        inside = F.exists("long_run", lambda r: (x["start"] >= r["start"]) & (x["end"] <= r["end"]))
        words = F.split(F.lower(clean(x)), " ")
        return ~follows & ~inside & ~F.exists(words, lambda w: w.isin(*L.NO_NAME_TERMS))

    def near(x: Column) -> Column:
        at = F.instr(F.col("low"), F.lower(clean(x))) - 1
        distance = nearest(at, F.col("triggers"))
        return F.when((at < 0) | distance.isNull(), -1.0).when(distance <= 24, 0.12).when(distance <= 48, 0.05).otherwise(-0.05)

    local = F.col("lexical") + 0.12 * F.col("specific") + weighed(("has_winner", 0.2), ("has_person", 0.1), ("asks_contest AND is_crowned", 0.12)) + 0.2 * F.col("told")
    vague = F.col("is_open_domain_browsecomp") & (F.col("lexical") + 0.12 * F.col("specific") < 0.12) & (F.col("specific") < 0.08) & (F.col("told") < 0.38)
    silent = event & ((F.col("told") < 0.32) | vague)
    named = lambda spans: F.filter(F.transform(F.filter(F.col(spans), usable), lambda x: x.withField("value", clean(x))), lambda x: F.length(x["value"]) > 0)
    each = each.withColumns({"local": local, "silent": silent, "patterned": named("patterned"), "runs": named("runs")})
    each = each.withColumns({c: F.expr(d.filter(c, lambda x: T.plausible_person_name(d, f"{x}.value"), "sp")) for c in ("patterned", "runs")})
    with_near = lambda x, base: F.when(event, F.when(~((near(x) < 0) & (F.col("told") < 0.45)), base + near(x))).otherwise(base)
    none = F.array().cast(CANDIDATES)
    scored = lambda spans, base: F.filter(F.transform(F.col(spans), lambda x: F.struct(with_near(x, base).cast("double").alias("score"), x["value"].alias("value"))), lambda c: c["score"].isNotNull())
    return each.withColumns({
        "explicit": F.when(F.col("silent"), none).otherwise(scored("patterned", F.col("local") + 0.18)),
        "capitals": F.when(F.col("silent") | (event & (F.col("told") < 0.4)), none).otherwise(scored("runs", F.col("local") + F.when(F.col("is_crowned"), 0.12).otherwise(0.0))),
    })


def thing_spans(each: DataFrame) -> DataFrame:
    """Sentences with the candidates for an entity and for a count."""
    d = SPARK
    text = F.col("sentence")
    local = F.col("lexical") + weighed(("has_character", 0.18), ("asks_rival AND is_rival", 0.18), ("is_called", 0.07))
    pattern = lambda p, base: F.transform(first_match(text, p), lambda x: F.struct(base.cast("double").alias("score"), F.trim(F.regexp_replace(x["value"], r"\s+", " ")).alias("value")))
    explicit = F.filter(F.concat(*(pattern(p, local + 0.15) for p in ENTITIES)), lambda c: ~F.lower(c["value"]).isin(*NO_ENTITY) & (c["value"] != ""))
    plain = F.transform(F.expr(T.capitalized_entities(d, "sentence")), lambda e: F.struct((local + F.when(F.col("has_companion"), 0.08).otherwise(0.0)).cast("double").alias("score"), e.alias("value")))
    counted = F.col("lexical") + F.when(F.col("has_ability"), 0.18).otherwise(0.0) + 0.15
    return each.withColumns({"entities": F.concat(explicit, plain), "counts": F.concat(*(pattern(p, counted) for p in COUNTS))})


def _clipped(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def _confidence(score: Column, least: float, most: float) -> Column:
    return F.round(F.least(F.lit(most), F.greatest(F.lit(least), score)), 2)


def with_evidence(rows: DataFrame) -> DataFrame:
    """rows with the question's wants, acknowledgements, grounding, event scores and structural figures, where they lack them."""
    out = rows if "acknowledgements" in rows.columns else sections(rows.withColumn("content", F.col("text"))).drop("content", "references").withColumn("acknowledgements", F.coalesce("acknowledgements.text", F.lit("")))
    questions = kept(wanted(rows.select(F.col("query_id").alias("id"), "query").distinct())).withColumnRenamed("id", "query_id")
    marks = kept(G.seen(rows))
    both = out.join(questions, "query_id").join(marks.drop("low", "near", "life"), "id").join(marks.select("id", "low", "near"), "id")
    memorial, grounded = G.rules()
    judged = G.judged_structure(both.withColumns(G.covered("low") | G.covered("near", "near_"))).withColumns({"memorial": F.expr(memorial), "grounded": F.expr(grounded)})
    d = SPARK
    asks = {"asks_contest": d.any_in("low_query", CONTESTS), "asks_rival": d.any_in("low_query", RIVALS), "asks_last": f"NOT {d.any_in('low_query', FULL_NAME)} AND answer_type = '{PERSON_TYPES[0]}'"}
    return judged.drop("low", "near", "life", "groups").withColumns({name: F.expr(sql) for name, sql in asks.items()})


def span_candidates(rows: DataFrame) -> DataFrame:
    """id, kind (person, entity, count), value, evidence and score of the best span of each kind in every document (see `with_evidence`)."""
    said = kept(rows.join(evidence_texts(rows), "id"))
    each = with_sentences(said, "evidence")
    people = person_spans(each.where(F.col("answer_type").isin(*PERSON_TYPES))).select("id", F.struct("nth", "sentence", "explicit", "capitals").alias("s"))
    things = thing_spans(each.where(~F.col("answer_type").isin(*PERSON_TYPES))).select("id", F.struct("nth", "sentence", "entities", "counts").alias("s"))
    ordered = lambda df: df.groupBy("id").agg(F.array_sort(F.collect_list("s")).alias("s"))
    best = lambda df, kind, *spans: ordered(df).select("id", F.lit(kind).alias("kind"), fold(F.col("s"), *spans).alias("c"))
    found = best(people, "person", "explicit", "capitals").union(best(things, "entity", "entities")).union(best(things, "count", "counts"))
    found = found.where(F.col("c.value") != "").select("id", "kind", "c.value", "c.evidence", "c.score")
    # who is thanked is the first that the thanks name
    thanked = said.where(F.col("requires_acknowledgement_section") & F.col("answer_type").isin(*PERSON_TYPES)).select("id", F.get(thanked_people("evidence"), F.lit(0)).alias("t")).where("t IS NOT NULL")
    named = thanked.select("id", F.lit("person").alias("kind"), F.col("t.name").alias("value"), F.col("t.evidence").alias("evidence"), F.lit(0.72).alias("score"))
    return found.join(named.select("id", "kind"), ["id", "kind"], "left_anti").union(named)


def _around(before: str, after: str = "") -> Column:
    """Whether the lowered sentence has the mention's year between two patterns."""
    return F.regexp_like("low", F.concat(F.lit("(?U)" + before + r"\b"), F.col("year"), F.lit(r"\b" + after)))


def year_mentions(rows: DataFrame) -> DataFrame:
    """id, year, sentence, nth, start and score of every year that the sentences of rows (see `with_evidence`) mention."""
    d = SPARK
    base = rows.withColumns({"clean_title": F.expr(T.normalize_whitespace(d, "title")), "read": F.expr(T.normalize_whitespace(d, f"concat({T.normalize_whitespace(d, 'title')}, '. ', left(text, {YEAR_READ}))"))})
    each = with_sentences(base, "read").withColumn("beside", F.lower(F.concat_ws(" ", "clean_title", "sentence")))
    each = each.withColumn("own", F.expr(T.important_terms(d, "beside"))).withColumn("specific", F.expr(f"CAST({T.specificity_overlap(d, 'terms', 'own', 'beside')} AS DOUBLE)"))
    each = each.select("*", F.explode(located(F.col("sentence"), T.YEAR)).alias("m")).withColumns({"year": F.col("m.value"), "start": F.col("m.start")})
    each = each.withColumn("window", F.substring("low", F.greatest(F.col("start") - 48, F.lit(0)) + 1, F.col("m.end") + 48 - F.greatest(F.col("start") - 48, F.lit(0))))
    has = lambda column, hints: F.expr(d.any_in(column, hints))
    on = lambda condition, weight: F.when(condition, weight).otherwise(0.0)
    asked = F.array_contains("query_years", F.col("year"))
    title = F.lower("clean_title")
    born = F.when(_around(r"\bborn in "), -0.65).when(_around(r"\bborn\b.{0,20}"), -0.45).otherwise(0.0)
    score = 0.12 + 0.35 * F.col("lexical") + 0.2 * F.col("specific") + F.when(asked, -0.18).otherwise(0.08)
    score = score + on(has("low", L.YEAR_EVENT_HINTS), 0.08) + on(has("window", L.YEAR_EVENT_HINTS), 0.14) + on(title.contains(F.col("year")) & F.expr(d.any_in("lower(clean_title)", L.YEAR_EVENT_HINTS)), 0.16)
    score = score + on(_around(rf"\b{LOSSES}\b.{{0,24}}") | _around("", rf".{{0,24}}\b{LOSSES}\b"), 0.18) + born
    score = score + on(_around(r"\b(?:built|constructed|erected|unveiled|opened|completed|installed)\b.{0,18}"), -0.42) + on(has("window", L.YEAR_CENSUS_HINTS), -0.56)
    score = score + on(has("window", L.YEAR_BIOGRAPHICAL_HINTS), -0.18) + on(has("window", L.YEAR_CONSTRUCTION_HINTS), -0.18)
    score = score + on(has("window", L.YEAR_AWARD_HINTS) & ~has("window", L.YEAR_EVENT_HINTS), -0.38)
    score = score + on(_around(r"\b(?:began|started|emerged|formed|launched|initiated)\b.{0,18}") & ~has("low", ("victims", "massacre", "killed", "died", "executed")), -0.24)
    score = score + on(F.col("low").contains("broader") & F.col("low").contains("resistance"), -0.08) + on(F.col("low_query").contains("constructed prior to") & has("low", L.YEAR_CONSTRUCTION_HINTS), -0.08)
    return each.select("id", "year", "sentence", "nth", "start", score.alias("score"))


def year_candidates(rows: DataFrame) -> DataFrame:
    """id, value, evidence and score of the best year of each document: none where its structure contradicts the question's, or lacks it."""
    fits = rows.where((F.col("structural_contradictions") == 0) & (~F.col("structural") | (F.col("structural_matches") > 0) | F.col("trusted")) & (~F.col("top_city") | F.col("city_hit")))
    lift = 0.08 * _clipped(F.col("rank_score")) + 0.05 * _clipped(F.col("retrieval_score")) + 0.18 * F.col("structural_score")
    scored = year_mentions(fits).join(fits.select("id", lift.alias("lift")), "id").withColumn("score", F.col("score") + F.col("lift"))
    order = Window.partitionBy("id").orderBy(F.desc("score"), "nth", "start")
    best = scored.withColumn("turn", F.row_number().over(order)).where("turn = 1").withColumn("score", F.round(F.least(F.lit(0.84), F.greatest(F.lit(0.0), F.col("score"))), 2))
    return best.where("score >= 0.26").select("id", F.col("year").alias("value"), F.col("sentence").alias("evidence"), "score")


def event_documents(rows: DataFrame) -> Column:
    """Whether a document may answer who won: it is grounded and tells of a winner or an event, or it tells of one strongly."""
    winner, event = F.col("winner_score"), F.col("event_score")
    strong = (F.col("grounded") & ((winner >= 0.24) | (event >= 0.42))) | ((winner >= 0.48) & (F.col("specificity") >= 0.08))
    return strong | (~F.col("is_open_domain_browsecomp") & (event >= 0.58) & (winner >= 0.34))


def extracted(rows: DataFrame) -> DataFrame:
    """query_id, answer_type, answer, evidence, id, confidence and supporting_person: the best candidate of each question's documents.

    Of equal candidates the one of the better placed document stands. Questions without a candidate have no row."""
    spark, d = rows.sparkSession, SPARK
    rows = kept(with_evidence(rows))
    with G.named(rows.select("id", F.expr(T.normalize_whitespace(d, "concat(title, '. ', left(text, 3000))")).alias("text"))) as texts:
        winners = spark.sql(f"SELECT * FROM {A.winner_evidence(d, texts)} w")
    spans = kept(span_candidates(rows))
    told = rows.join(winners, "id").select("id", "query_id", "answer_type", "place", "rank_score", "event_score", "prefers_event_sources", "asks_last", "targets_count", "targets_person", event_documents(rows).alias("fits"))
    by_kind = lambda kind: spans.where(F.col("kind") == kind).select("id", "value", "evidence", "score")

    lift = 0.1 * _clipped(F.col("rank_score")) + F.when(F.col("prefers_event_sources"), 0.12 * F.col("event_score")).otherwise(0.0)
    people = told.join(by_kind("person"), "id").where(F.col("answer_type").isin(*PERSON_TYPES) & (~F.col("prefers_event_sources") | F.col("fits"))).withColumn("score", F.col("score") + lift)
    name = F.when(F.col("asks_last"), F.element_at(F.split("value", " "), -1)).otherwise(F.col("value"))
    people = people.select("*", name.alias("answer"), _confidence(F.col("score"), 0.4, 0.82).alias("confidence"), F.col("value").alias("supporting_person"), F.lit(0).alias("turn"))

    entity, count = by_kind("entity"), by_kind("count").toDF("id", "n", "n_evidence", "n_score")
    both = told.join(entity, "id").join(count, "id").where((F.col("answer_type") == "entity_and_count") | (F.col("targets_count") & F.col("targets_person") & F.col("answer_type").isin(*THING_TYPES)))
    both = both.withColumn("score", 0.45 * F.col("score") + 0.45 * F.col("n_score") + 0.1 * F.col("rank_score")).withColumn("evidence", F.concat_ws(" ", "evidence", "n_evidence"))
    both = both.select("*", F.concat_ws(", ", "value", "n").alias("answer"), _confidence(F.col("score"), 0.45, 0.78).alias("confidence"), F.col("value").alias("supporting_person"), F.lit(0).alias("turn"))
    things = told.join(entity, "id").where(F.col("answer_type").isin("entity_name", "generic")).select("*", F.col("value").alias("answer"), _confidence(F.col("score"), 0.35, 0.72).alias("confidence"), F.col("value").alias("supporting_person"), F.lit(1).alias("turn"))
    counts = told.join(by_kind("count"), "id").where((F.col("answer_type").isin("count", "generic")) | (F.col("targets_count") & F.col("answer_type").isin(*THING_TYPES)))
    counts = counts.select("*", F.col("value").alias("answer"), _confidence(F.col("score"), 0.35, 0.7).alias("confidence"), F.lit("").alias("supporting_person"), F.lit(2).alias("turn"))
    years = told.join(year_candidates(rows.where("answer_type = 'year'")), "id").select("*", F.col("value").alias("answer"), F.col("score").alias("confidence"), F.lit("").alias("supporting_person"), F.lit(0).alias("turn"))
    columns = ["query_id", "answer_type", "answer", "evidence", "id", "confidence", "supporting_person", "turn", "score", "place"]
    every = people.select(columns)
    for more in (both, things, counts, years, *_stated(rows, told)):
        every = every.unionByName(more.select(columns))
    # a kind that comes earlier stands wherever it has a candidate
    order = Window.partitionBy("query_id").orderBy("turn", F.desc("score"), "place", "id")
    return every.withColumn("nth", F.row_number().over(order)).where("nth = 1").select(columns[:7])


def _stated(rows: DataFrame, told: DataFrame) -> list[DataFrame]:
    """Titles and institutions: the first document that has one."""
    spark, d = rows.sparkSession, SPARK
    with G.named(rows.where("answer_type = 'title'").select("id", "url", "title", "text")) as pages:
        titles = spark.sql(f"SELECT id, title_phrase AS value, title AS evidence FROM {P.title_phrases(d, pages)} t").where("value <> ''")
    place = F.expr(d.at(T.institutions(d, f"concat_ws(' ', title, left(text, {OPENING}))"), 1))
    institutions = rows.where("answer_type = 'institution'").select("id", place.alias("value"), place.alias("evidence")).where("value IS NOT NULL")
    first = lambda df, confidence: told.join(df, "id").select("*", F.col("value").alias("answer"), F.lit(0.0).alias("score"), F.lit(confidence).alias("confidence"), F.lit("").alias("supporting_person"), F.lit(0).alias("turn"))
    return [first(titles, 0.58), first(institutions, 0.56)]
