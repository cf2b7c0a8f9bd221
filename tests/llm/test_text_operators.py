"""BPE, quality rules, SimHash and personal data against brute force."""

import hashlib
import random
import time
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tidemark.llm import bpe, pii, quality_rules, simhash
from tidemark.llm.common import components

from .conftest import documents, prose


@pytest.fixture(scope="module")
def coder():
    return bpe.Coder(bpe.load_ranks(public_tokenizers.path(bpe.VOCABULARY)))


@pytest.fixture(scope="module")
def peer():
    return tiktoken.Encoding("peer", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path(bpe.VOCABULARY)), special_tokens={})


def test_bpe_agrees_with_the_library_on_random_text(coder, peer):
    draw = random.Random(7)
    parts = ["'", "'s", "'re", "'ll", "re", "l", "s", " ", "  ", "\n", "\t", "a", "B", "é", "1", "½", "漢", "!", " ", "　", "\x1c", "𝔸", "🎉", "ⅷ", "́", "<|endoftext|>", "unhappiness", "Straße"]
    batch = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 25))) for _ in range(3000)] + ["ab" * 3000, " " * 400]
    ids = coder.encode(batch)
    assert [x.tolist() for x in ids] == [peer.encode_ordinary(t) for t in batch]
    assert coder.decode(ids) == [t.encode() for t in batch]


def test_bpe_forgets_without_changing_results(coder, peer, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBER", 40)
    for seed in range(6):
        batch = [prose(seed, 60)]
        assert [x.tolist() for x in coder.encode(batch)] == [peer.encode_ordinary(t) for t in batch]


def test_bpe_query_columns(spark, odd, empty, peer):
    path = public_tokenizers.path(bpe.VOCABULARY)
    rows = bpe.encode_decode(odd, path, ("n_tokens", "ids", "ids_sha256", "decoded_sha256")).join(odd.select("doc_id", "text"), "doc_id").collect()
    assert len(rows) == 14  # the repeated row meets itself twice, the null id nothing
    for r in rows:
        ids = peer.encode_ordinary(r["text"] or "")
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    assert bpe.encode_decode(empty, path).count() == 0


def rules_by_hand(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    n = Counter(windows)
    inside = {k + j for k, w in enumerate(windows) if n[w] > 1 for j in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def test_quality_rules_by_hand(spark, odd, empty, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = documents(spark, [(20, "a b\n\na b\n a b\nc | d # e", "en", "z", 1), (21, "p q r s t u " * 4, "en", "z", 1)], False)
    for table in (docs, extra, odd):
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        got = quality_rules.quality_rules(table).collect()
        texts = {}
        for r in table.select("doc_id", "text").collect():
            texts[r["doc_id"]] = r["text"]
        assert len(got) == table.count()
        for r in got:
            want = rules_by_hand(texts[r["doc_id"]])
            assert tuple(r[k] for k in names) == want
            assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
            assert not (r["base_failed"] and r["kept"])
    assert quality_rules.quality_rules(empty).count() == 0


def test_a_failing_host_rejects_its_documents(spark):
    bad = [(k, "short", None, "bad", 1) for k in range(60)] + [(100, prose(1, 80), None, "bad", 1)]
    good = [(200 + k, prose(k, 80), None, "good", 1) for k in range(60)] + [(300, prose(3, 80), None, None, 1)]
    kept = {r["doc_id"] for r in quality_rules.quality_rules(documents(spark, bad + good)).where("kept").collect()}
    assert kept == {200 + k for k in range(60)} | {300}


def fingerprint_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_by_hand(rows):
    prints = {}
    for doc, text in rows:
        prints.setdefault(fingerprint_by_hand(text), []).append(doc)
    keys = np.array(sorted(prints), np.uint64)
    root = {int(k): int(k) for k in keys}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k in keys:
        for other in keys[np.bitwise_count(keys ^ k) <= 3]:
            root[find(int(k))] = find(int(other))
    smallest = {}
    for k, docs in prints.items():
        for d in docs:
            if d is not None:
                smallest[find(k)] = min(smallest.get(find(k), d), d)
    return {(d, f"{k:016x}"): smallest.get(find(k)) for k, docs in prints.items() for d in docs}


def test_simhash_by_hand(spark, odd, empty, sf):
    near = [(1000 + k, prose(5, 90) + " " + prose(k % 7, 1 + k % 4), None, None, 1) for k in range(60)] + [(2000 + k, prose(9, 30), None, None, 1) for k in range(20)]
    for table in (spark.read.parquet(f"{sf}/documents.parquet"), documents(spark, near), odd):
        rows = [(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()]
        got = simhash.simhash_components(table).collect()
        assert len(got) == len(rows)
        assert {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in got} == groups_by_hand(rows)
    assert simhash.simhash_components(empty).count() == 0


@pytest.mark.parametrize("bases, most", [(8, 7), (200, 4), (1, 6)])
def test_buckets_of_any_size_give_the_right_components(bases, most):
    draw = np.random.default_rng(bases)
    fps = set()
    for base in draw.integers(0, 2**63, bases, dtype=np.uint64).tolist():
        for _ in range(640 // bases):
            x = base
            for j in draw.integers(0, 64, draw.integers(0, most)):
                x ^= 1 << int(j)
            fps.add(x)
    fps = np.array(sorted(fps), np.uint64)
    flips = [0] + [1 << k for k in range(32)]
    pairs = [(half ^ f, x) for x in fps.tolist() for half in (x & 0xFFFFFFFF, (x >> 32) | (1 << 32)) for f in flips]
    found, want = simhash._Forest(), simhash._Forest()
    for a, b in simhash.bucket_links(*(np.array(c, np.uint64) for c in zip(*pairs))):
        assert (a ^ b).bit_count() <= 3
        found.link(a, b)
    for x in fps:
        for y in fps[np.bitwise_count(fps ^ x) <= 3]:
            want.link(int(x), int(y))
    assert [found.find(int(x)) for x in fps] == [want.find(int(x)) for x in fps]


def test_components_of_long_chains_and_hubs(spark):
    chain = [(k, k + 1) for k in range(0, 40)]
    hub = [(100, 100 + k) for k in range(1, 60)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain + hub + [(7, 7)], "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(1, 41)}, **{100 + k: 100 for k in range(1, 60)}}


def _luhn(digits):
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0


def base_by_hand(text):
    text = text or ""
    digits = lambda v: re.sub("[^0-9]", "", v)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda v: 16 <= len(digits(v)) <= 19 and _luhn(digits(v))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 8 <= len(digits(v)) <= 15),
    }
    found = {k: [m.span() for m in re.finditer(p, text) if ok(m[0])] for k, (p, ok) in kinds.items()}
    return [len(v) for v in found.values()], ",".join(f"{k}:{a}:{b}" for k, v in found.items() for a, b in v)


PII_TEXTS = [
    "mail a.b@c.de%x@y.z and é𝔸 q@w.e.r.t, @no.pe a@b@c.d",
    "1.2.3.4.5.6.7.8 300.1.1.1 001.002.003.004 1.2.3",
    "4539 1488 0343 6467, 4539148803436467 4539-1488-0343-6468 0000000000000000000",
    "+1 (974) 555-3436 +49 (0) 30.1234567 +1 2 +123456789012345678",
    "9" * 20000 + " " + "a" * 20000 + " " + "1 " * 9000,
    "a@b.c" * 50,
]


def test_personal_data_by_hand(spark, odd, empty, sf):
    made = documents(spark, [(100 + k, t, None, None, 1) for k, t in enumerate(PII_TEXTS)])
    for table in (made, odd, spark.read.parquet(f"{sf}/documents.parquet")):
        texts = {r["doc_id"]: r["text"] for r in table.select("doc_id", "text").collect()}
        got = pii.report(table).collect()
        assert len(got) == table.count()
        for r in got:
            counts, spans = base_by_hand(texts[r["doc_id"]])
            assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == counts
            assert r["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()
            assert set(filter(None, spans.split(","))) <= set(r["spans"].split(","))
    assert pii.report(empty).count() == 0


def test_context_discovers_unseen_identifiers(spark):
    seeds = [(k, f"{prose(k, 6)} passport: 10.200.7.{k + 3} {prose(k + 1, 4)}", None, None, 1) for k in range(8)]
    rest = [(50, f"{prose(3, 5)} passport: X1234567, thanks", None, None, 1), (51, f"{prose(4, 5)} total: 1234567 units", None, None, 1)]
    got = {r["doc_id"]: r for r in pii.report(documents(spark, seeds + rest)).collect()}
    start = rest[0][1].index("X1234567")
    assert got[50]["spans"] == f"id:{start}:{start + 8}" and got[50]["n_id"] == 1
    assert got[51]["n_id"] == 0


def test_base_spans_of_any_shape_are_seeds(spark):
    seeds = [(k, f"{prose(k, 6)} contact: {'abcdefgh'[k]}.x@mail.org {prose(k + 1, 4)}", None, None, 1) for k in range(8)]
    seeds += [(20 + k, f"{prose(k, 6)} call +1 555 123 45{k}7 {prose(k + 1, 4)}", None, None, 1) for k in range(8)]
    rest = [(50, f"é𝔸 {prose(3, 5)}\n contact: zoe_k, thanks", None, None, 1), (51, f"{prose(4, 5)} total: zoe_k2 units", None, None, 1), (None, "call 0800", None, None, 1)]
    got = {r["doc_id"]: r for r in pii.report(documents(spark, seeds + rest)).collect()}
    start = rest[0][1].index("zoe_k")
    assert got[50]["spans"] == f"id:{start}:{start + 5}" and got[None]["spans"] == "id:5:9"
    assert got[51]["n_id"] == 0 and all(r["n_id"] == 0 for k, r in got.items() if k is not None and k < 50)


def test_bootstrapping_admits_new_patterns_and_leaves_common_words(spark):
    first = [(k, f"{prose(k, 6)} member ref {k}.x@mail.org {prose(k + 1, 4)}", None, None, 1) for k in range(20)]
    first += [(20 + k, f"{prose(k, 6)} member ref uid_{k}z {prose(k + 1, 4)}", None, None, 1) for k in range(16)]
    second = [(40 + k, f"{prose(k, 3)} badge uid_{k}z {prose(k + 2, 5)}", None, None, 1) for k in range(16)]
    later = [(60, "lorem ipsum badge q-77 dolor", None, None, 1), (61, "the q-77 was lost", None, None, 1)]
    common = [(100 + k, f"lorem of 10.1.2.{k} and of {prose(k, 1)}{k} of {prose(k, 1)}x{k} sed of {prose(k + 9, 1)}{k}", None, None, 1) for k in range(8)]
    found = {r["doc_id"]: r for r in pii.report(documents(spark, first + second + common)).collect()}
    assert all(found[20 + k]["n_id"] == 1 and found[40 + k]["n_id"] == 1 for k in range(16))
    assert all(found[100 + k]["n_id"] == 0 for k in range(8))  # `of` stands before anything
    more = {r["doc_id"]: r for r in pii.report(documents(spark, first + second + later)).collect()}
    at = later[0][1].index("q-77")
    assert more[60]["spans"] == f"id:{at}:{at + 4}" and more[61]["n_id"] == 0  # `badge` is a pattern of the second round


def test_personal_data_of_long_texts_takes_linear_time(spark):
    took = []
    for n in (4000, 16000):
        text = ":" * n + " 1 " + "+1 555 123 4567, " * n + "a@b.cd " * n
        table = documents(spark, [(1, text, None, None, 1)], False)
        start = time.time()
        r = pii.report(table).first()
        took.append(time.time() - start)
        assert (r["n_phone"], r["n_email"]) == (n, n)
    assert took[1] < 6 * took[0]


def test_redaction(spark):
    text = "é a@b.cd and 10.0.0.1, end"
    df = pii.personal_data(documents(spark, [(1, text, None, None, 1)], False), ("doc_id", "text")).select(pii.redacted(F.col("text"), pii.all_spans()).alias("t"))
    assert df.first()["t"] == "é [EMAIL] and [IP], end"


def redacted_by_hand(text, spans):
    out, at = [], 0
    for start, _, end, name in sorted((a, -b, b, name) for name, a, b in spans):
        if start >= at:
            out += [text[at:start], f"[{name.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def test_redaction_of_many_and_overlapping_spans(spark):
    texts = [*PII_TEXTS, "é𝔸" * 700 + " 4539 1488 0343 6467@x.org 1.2.3.4@b.c " + "+1 555 123 4567, a@b.cd\n" * 700 + "𝔸" * 1500, "1.2.3.4 " * 600, "", "x" * 3000]
    df = pii.personal_data(documents(spark, [(k, t, None, None, 1) for k, t in enumerate(texts)], False), ("doc_id", "text"))
    for r in df.select("doc_id", pii.redacted(F.col("text"), pii.all_spans()).alias("t"), pii._listed(pii.all_spans()).alias("spans"), pii.blanked(F.col("text")).alias("b")).collect():
        spans = [(name, int(a), int(b)) for name, a, b in (x.split(":") for x in r["spans"].split(",") if x)]
        assert r["t"] == redacted_by_hand(texts[r["doc_id"]], spans)
        base = {k for name, a, b in spans if name != "id" for k in range(a, b)}
        assert r["b"] == "".join(pii.BLANK if k in base else c for k, c in enumerate(texts[r["doc_id"]]))


def test_identifiers_after_spans_with_blanks_are_placed(spark):
    seeds = [(k, f"{prose(k, 6)} badge {k}.x@mail.org {prose(k + 1, 4)}", None, None, 1) for k in range(12)]
    late = "call +1 555 123 4567 or +49 30 123 4567 then badge zx_9 and more"
    got = {r["doc_id"]: r for r in pii.report(documents(spark, [*seeds, (50, late, None, None, 1)])).collect()}
    at = late.index("zx_9")
    assert f"id:{at}:{at + 4}" in got[50]["spans"].split(",")


def test_scores_settle_over_a_chain_of_patterns(spark):
    """Each pattern's values are half known by the one before it, so scores must travel over many steps."""
    edges = [("p0", f"s{k}", True) for k in range(40)]
    for step in range(8):
        edges += [(f"p{step}", f"v{step}.{k}", False) for k in range(4)] + [(f"p{step + 1}", f"v{step}.{k}", False) for k in range(4)]
    patterns, scores = pii.scored(spark.createDataFrame(edges, "pattern string, value string, seed boolean"))
    confidence = {r["pattern"]: r["confidence"] for r in patterns.collect()}
    score = {r["value"]: r["score"] for r in scores.collect()}
    values = {v: float(seed) for _, v, seed in edges}
    for _ in range(500):
        mean = {p: sum(values[v] for q, v, _ in edges if q == p) / (sum(q == p for q, _, _ in edges) + 0.25) for p in confidence}
        values = {v: 1.0 if v[0] == "s" else 1 - np.prod([1 - min(mean[p], 0.999) for p, w, _ in edges if w == v]) for v in values}
    assert max(abs(score[v] - values[v]) for v in values) < 0.02 and score["v7.0"] > 0.3
    with pytest.raises(RuntimeError):
        pii.scored(spark.createDataFrame(edges, "pattern string, value string, seed boolean"), sweeps=2)


def test_pii_looks_for_rare_patterns_only_where_they_stand(spark):
    """Words that stand before anything leave in a share of the texts; a scan for the rest takes only texts that have them apart."""
    common = [(k, f"the w{k} the v{k} stays", None, None, 1) for k in range(3000)]
    rare = [(5000 + k, f"Ticket ΟΔΟΣ(R{k}: and ACCOUNT\nQ{k}7 here", None, None, 1) for k in range(6)]
    docs = documents(spark, common + rare)
    many = spark.createDataFrame([("the", 6), ("account", 6), ("οδος(", 6)], "pattern string, n long")
    assert {r[0] for r in pii.promising(docs, many).collect()} == {"account", "οδος("}
    known = many.where("pattern <> 'the'").select("pattern")
    patterns = ["account", "οδος("]
    assert pii.holding(docs, patterns).count() == len(rare)
    assert pii.holding(docs, [*patterns, "the"]).count() == len(common) + len(rare)
    assert pii.words(docs, patterns).count() == 2 * len(rare) and pii.words(docs).count() == 5 * len(common) + 6 * len(rare)
    found = {(r["pattern"], r["value"]) for r in pii.instances(docs, known).collect()}
    assert found == {x for k in range(6) for x in (("account", f"Q{k}7"), ("οδος(", f"R{k}"))}


def test_few_patterns_are_looked_for_in_their_places(spark):
    texts = ["wh id-1, the, end", "The, id-2 wh", "wh +1 202 555 0100 the, x", "wh abc,+1 202 555 0100 the, x", "xwh id-3 the,", "wh id-4\tthe,", "call\nno9 id-5", "no8 a wh", "the, wh"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    patterns = [f"wh {pii.BLANK} the,", "call no9"]
    held = {r["doc_id"] for r in pii.holding(rows, patterns).collect()}
    assert {0, 2, 3, 5, 6} <= held and not held & {1, 4, 7, 8}
    known = spark.createDataFrame([(p,) for p in patterns], "pattern string")
    assert {(r["pattern"], r["value"]) for r in pii.instances(rows, known).collect()} == {(patterns[0], "id-1"), (patterns[0], "abc"), (patterns[0], "id-4"), (patterns[1], "id-5")}
