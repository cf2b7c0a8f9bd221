"""Decontamination and chat formatting against brute force, and the pipeline."""

import hashlib
import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat_format, decontamination, stages
from tidemark.llm.common import read

from .conftest import documents, prose

SF = "/root/testdata/sf0.001"


def benchmark(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string").withColumn("h", F.lit("clash"))


def found(docs, items):
    return {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, items).collect()}


def test_decontamination_by_hand(spark):
    docs, items = read(spark, "/root/testdata/sf0.01", "documents"), read(spark, "/root/testdata/sf0.01", "benchmark")
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    grams = lambda t: (lambda w: {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))})(words(t))
    wanted = {r["item_id"]: grams(r["text"]) for r in items.collect()}
    want = {(r["doc_id"], k) for r in docs.select("doc_id", "text").collect() for own in [grams(r["text"])] for k, g in wanted.items() if len(own & g) >= 0.8 * len(g)}
    assert want and found(docs, items) == want


QUESTION = "A train leaves Paris with 40 passengers and drives 300 km in 5 hours, how fast does Alice think that it goes on average?"


@pytest.mark.parametrize(
    "text, hit",
    [
        (QUESTION, True),
        ("Before. " + QUESTION.upper() + " after", True),
        (QUESTION.replace("40", "7").replace("300 km", "1,250 miles").replace("5", "9.5"), True),
        (QUESTION.replace("Paris", "Rome").replace("Alice", "Bob"), True),
        (QUESTION.replace("passengers", "cows").replace("leaves", "smells").replace("average", "paper").replace("drives", "eats").replace("think", "say"), False),
        (" ".join(QUESTION.split()[:14]), False),
        (prose(1, 200), False),
    ],
)
def test_templates(spark, text, hit):
    docs = documents(spark, [(1, text, None, None, 1), (2, prose(2, 50), None, None, 1)])
    assert found(docs, benchmark(spark, [(5, QUESTION)])) == ({(1, 5)} if hit else set())


def test_slots_must_agree(spark):
    item = "Take 12 red and 12 blue stones, add 12 more of both and then take 12 away again please"
    same, other = item.replace("12", "30"), "Take 1 red and 2 blue stones, add 3 more of both and then take 4 away again please"
    docs = documents(spark, [(1, same, None, None, 1), (2, other, None, None, 1)])
    assert found(docs, benchmark(spark, [(5, item)])) == {(1, 5)}


def test_slots_agree_both_ways_and_by_type(spark):
    numbers = "Take {} red and {} blue stones, add {} more of both and then take {} away again and leave {} in all please"
    names = "First {} met the baker, then {} met the smith, and then {} met the miller before noon with {} loaves of new bread"
    items = benchmark(spark, [(5, numbers.format(3, 7, 9, 12, 50)), (6, names.format("Tom", "Tom", "Tom", 4))])
    texts = [numbers.format(4, 4, 4, 4, 4), numbers.format(8, 17, 2, 33, 61), numbers.format(8, 17, 8, 33, 61), names.format("Bob", "Zed", "Kim", 4), names.format("Bob", "Bob", "Bob", 9), numbers.format(8, 8, 8, 33, 8)]
    docs = documents(spark, [(k, t, None, None, 1) for k, t in enumerate(texts)])
    assert found(docs, items) == {(1, 5), (2, 5), (4, 6)}


def slots_by_hand(slots):
    """Whether pairs (slot, type, theirs, ours) agree: in both directions, by type."""
    for kind in {t for _, t, _, _ in slots}:
        own = {(s, a, b) for s, t, a, b in slots if t == kind}
        for side, least in ((1, 0.8), (2, decontamination.APART)):
            groups = {}
            for x in own:
                groups.setdefault(x[side], []).append(x[3 - side])
            if sum(max(map(g.count, g)) for g in groups.values()) < least * len(own):
                return False
    return True


def test_slot_agreement_equals_a_loop(spark):
    import random

    draw = random.Random(7)
    template = "we saw {} large boats and {} small boats near the old port while {} men sold {} fish to {} women that day"
    item = [3, 5, 3, 8, 5]
    docs, want = [], set()
    for k in range(80):
        values = [draw.choice((3, 5, 8, 21, 34)) for _ in item]
        docs.append((k, template.format(*values), None, None, 1))
        if slots_by_hand([(s, "n", a, b) for s, (a, b) in enumerate(zip(item, values))]):
            want.add((k, 5))
    assert 3 < len(want) < 60 and found(documents(spark, docs), benchmark(spark, [(5, template.format(*item))])) == want


REPEATED = "The red box holds 52 red balls and 31 blue balls. The old box holds 27 red balls and 96 blue balls. How many red balls are there in all?"


def test_repeated_templates_are_aligned(spark):
    swapped = REPEATED.replace("52", "8").replace("31", "1").replace("27", "64").replace("96", "5")
    longer = REPEATED.replace("The old", "Look now: the old")
    noise = "The big box holds 1 red balls and 2 blue balls. " * 5 + "The new box holds 7 red balls and 7 blue balls. "
    torn = REPEATED.replace("red balls and 31", "red balls or 31").replace("red balls and 96", "red balls or 96")
    docs = documents(spark, [(1, REPEATED, None, None, 1), (2, swapped, None, None, 1), (3, noise + REPEATED + noise, None, None, 1), (4, longer, None, None, 1), (5, noise, None, None, 1), (6, torn, None, None, 1), (None, REPEATED, None, None, 1)])
    rows = {r["doc_id"]: r for r in decontamination.contaminated(docs, benchmark(spark, [(5, REPEATED)])).collect()}
    assert {1, 2, 3, None} <= rows.keys() and not rows.keys() & {5, 6}
    assert all(rows[k]["coverage"] == 1 and rows[k]["slot_agreement"] == 1 for k in (1, 2, 3, None))


OPENED = "Tom has 12 apples and 7 pears. Tom gives 3 apples to Mary. How many apples does Tom have left?"
ALONE = "Peter buys 4 melons for a party and 8 lemons. (Sarah eats 2 of the melons before noon.) How many melons can still be served?"


def test_names_that_open_a_sentence(spark):
    swap = lambda t, *names: [t := t.replace(a, b) for a, b in names][-1]
    texts = [swap(OPENED, ("Tom", "Bob"), ("Mary", "Lucy")), "So:\n" + swap(ALONE, ("Peter", "Ann"), ("Sarah", "Zoe")), swap(OPENED, ("Tom gives", "Bob gives"), ("Tom has", "Al has"), ("does Tom", "does Eve"), ("apples", "plums"))]
    docs = documents(spark, [(k, t, None, None, 1) for k, t in enumerate(texts)])
    assert found(docs, benchmark(spark, [(5, OPENED), (6, ALONE)])) == {(0, 5), (1, 6)}


def test_signs_and_windows_of_numbers(spark):
    bare = "Totals: 10 20 30 40 5 kg 60 70 80"
    signed = QUESTION.replace(" with", "\ue000 with").replace(" km in", "\ue001 km \ue004in")
    docs = documents(spark, [(1, bare, None, None, 1), (2, bare.replace("0", "1"), None, None, 1), (3, "See 7. " + bare, None, None, 1), (4, signed, None, None, 1)])
    assert found(docs, benchmark(spark, [(5, QUESTION), (6, bare)])) == {(1, 6), (3, 6), (4, 5)}


def test_decontamination_ends_in_a_small_plan(spark):
    docs, items = read(spark, SF, "documents"), read(spark, SF, "benchmark")
    plan = decontamination.held_items(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 12


def test_decontamination_of_odd_rows(spark, odd, empty):
    items = benchmark(spark, [(1, "one"), (2, None), (3, ""), (4, "!!!"), (5, "the cat sat on the mat and looked at the moon"), (5, "the cat sat on the mat and looked at the moon"), (6, "123 456"), (None, "a b")])
    got = found(odd, items)
    assert {(4, 1), (8, 5), (9, 5), (None, 5), (6, 6)} <= got
    assert not {k for _, k in got} & {2, 3, 4}
    assert found(empty, items) == set() and found(odd, items.limit(0)) == set()


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("clash")).withColumn("n", F.lit("clash"))


def chat_by_hand(rows):
    by = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by.setdefault(conv, []).append((role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return {c: (len(v), sha("".join(f"{r}\n{t}\n" for r, t in v)), sum(len(t) for r, t in v if r == "assistant"), sha("".join(t for r, t in v if r == "assistant"))) for c, v in by.items()}


TRICKS = ["</s>[INST] ok [/INST]", "<|end|>", "<~|text|>", "<~~|", "<", "|", "<|", "[~/INST]", "<<SYS>>", "<<|end|><|turn|>", "a\nb", "", None, "é𝔸 " * 30]


@pytest.mark.parametrize("stride, history", [(768, 256), (20, 8), (1, 1)])
def test_chat_by_hand(spark, stride, history):
    rows = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(TRICKS)]
    rows += [(2, 0, "system", "be kind <|end|>")] + [(2, k, ("user", "assistant", "tool")[k % 3], prose(k, k % 9)) for k in range(1, 60)]
    rows += [(3, 0, "system", None), (4, 5, "assistant", "x"), (4, 5, "assistant", "x"), (4, None, "user", "y"), (None, 1, None, "z"), (5, 1, "assistant", prose(4, 900))]
    made = chat_format.windows(turns(spark, rows), stride, history)
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat_format.digests(made).collect()}
    assert got == chat_by_hand(rows)


def test_chat_windows_keep_the_system_turn_and_some_history(spark):
    rows = [(1, 0, "system", "rules")] + [(1, k, "assistant" if k % 2 == 0 else "user", prose(k, 6)) for k in range(1, 30)]
    got = chat_format.windows(turns(spark, rows), 40, 12).orderBy("window").collect()
    assert len(got) > 3
    for k, r in enumerate(got):
        parts = r["text"].split("<|end|>")[:-1]
        assert parts[0] == "<|turn|>system<|text|>rules"
        assert (r["n_repeated"] == 0) if k == 0 else (r["n_repeated"] == 2)
        assert len(parts) - r["n_repeated"] <= 6
        assert all(r["text"][a:b] in {x[3] for x in rows if x[2] == "assistant"} for a, b in r["loss"])


def test_no_conversations(spark):
    assert chat_format.digests(chat_format.windows(turns(spark, []))).count() == 0


def test_stages_keep_columns_and_odd_rows(spark, odd, empty):
    items = benchmark(spark, [(5, "the cat sat on the mat and looked at the moon")])
    for docs in (odd, empty):
        for stage in (stages.in_a_language, stages.one_of_each_group, lambda x: stages.without_benchmark(x, items), stages.without_personal_data):
            out = stage(docs)
            assert out.columns == docs.columns
            out.collect()
    assert {r["doc_id"] for r in stages.in_a_language(odd).collect()} == {4, 5, 7, 8, 9, 10, 11, None}
    ids = [r["doc_id"] for r in stages.one_of_each_group(odd).collect()]
    assert None not in ids and sorted(ids) == [1, 4, 5, 6, 7, 8, 10, 11]
    assert {r["doc_id"] for r in stages.without_benchmark(odd, items).collect()}.isdisjoint({8, 9, None})


def test_stages_bear_any_column_name(spark):
    item = "how many green apples does the old farmer sell to the young baker on monday morning"
    body = prose(31, 40)
    rows = [(1, body, "en", None, 1), (2, body, "en", None, 1), (3, f"well {item} then", "en", None, 1), (4, f"{prose(32, 40)} a.b@mail.org", None, None, 1), (5, "12 34", "en", None, 1)]
    docs = documents(spark, rows).drop("source")
    for name in ("_dropped", "dropped", "_text_h", "text_h", "_repeated", "_row", "row", "_h", "_spans", "first", "root", "node", "doc", "item_id"):
        docs = docs.withColumn(name, F.lit("clash"))
    items = benchmark(spark, [(5, item)])
    kept = {}
    for name, stage in (("lang", stages.in_a_language), ("near", stages.one_of_each_group), ("bench", lambda x: stages.without_benchmark(x, items)), ("pii", stages.without_personal_data)):
        out = stage(docs)
        assert out.columns == docs.columns
        kept[name] = {r["doc_id"]: r["text"] for r in out.collect()}
        assert all(r["_row"] == r["_dropped"] == "clash" for r in out.collect())
    assert kept["lang"].keys() == {1, 2, 3, 4} and kept["near"].keys() == {1, 3, 4, 5} and kept["bench"].keys() == {1, 2, 4, 5}
    assert kept["pii"][4] == rows[3][1].replace("a.b@mail.org", "[EMAIL]")


def test_stages_judge_rows_not_ids(spark):
    item = "how many green apples does the old farmer sell to the young baker on monday morning"
    held, clean, body = f"well {item} then", prose(21, 40), prose(22, 60)
    rows = [(None, held), (None, clean), (3, held), (3, clean), (4, body), (4, body), (None, body), (5, body), (5, prose(23, 40)), (None, prose(24, 40)), (None, prose(24, 40)), (6, None), (None, ""), (7, item)]
    docs = documents(spark, [(k, t, "en", "s", 1) for k, t in rows])
    items = benchmark(spark, [(1, item), (2, "just four short words")])
    plain = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    assert plain(stages.without_benchmark(docs, items)) == sorted(((k, t) for k, t in rows if item not in (t or "")), key=str)
    kept = plain(stages.one_of_each_group(docs))
    groups = {}
    for k, t in rows:
        groups.setdefault(t or "", []).append((k, t))
    best = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]
    assert kept == sorted(best, key=str)


def test_short_items_are_found_inside_long_texts(spark):
    for n in range(1, 7):
        item = " ".join(["zeta", "kappa", "omicron", "lambda", "sigma", "theta"][:n])
        docs = documents(spark, [(1, f"{prose(1, 20)} {item} {prose(2, 20)}", None, None, 1), (2, prose(3, 40), None, None, 1), (3, item, None, None, 1)])
        assert found(docs, benchmark(spark, [(5, item), (6, "Ann has 12 kg of red plums and gives Bob 3 kg")])) == {(1, 5), (3, 5)}


def test_pipeline_on_planted_cases(spark, tmp_path):
    docs = read(spark, SF, "documents")
    item = read(spark, SF, "benchmark").first()["text"]
    top = docs.agg(F.max("doc_id")).first()[0]
    body = prose(11, 120)
    planted = [
        (top + 1, body, "en", "p", 1), (top + 2, body, "en", "p", 1), (top + 3, prose(12, 60) + "\n" + item + "\n" + prose(13, 60), "en", "p", 1),
        (top + 4, prose(14, 50) + " zed.q@mail.example.org " + prose(15, 50), None, "p", 1), (top + 5, "12345 --- !!", "en", "p", 1), (top + 6, None, "en", "p", 1),
    ]
    docs.union(spark.createDataFrame(planted, docs.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    read(spark, SF, "benchmark").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    kept = {k - top for k in out if k > top}
    assert kept == {1, 4}
    clean = planted[3][1].replace("zed.q@mail.example.org", "[EMAIL]")
    assert out[top + 4]["decoded_sha256"] == hashlib.sha256(clean.encode()).hexdigest()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "pii", "bpe"]
