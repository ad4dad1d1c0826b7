"""Burst tries, quality rules and lexical search against brute force: nulls, ties, copies, empty tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from panelcast.llm import lexical, rules, tries
from pyspark.sql import functions as F

RANDOM = random.Random(11)
WORDS = [a + b for a in ("ta", "re", "mi", "The", "sö") for b in ("n", "r", "sk", "ll", "m")]


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


# --- burst tries

CONVERSATION = "conv_id long, turn long, role string, text string, depth string, n long, path string"
NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute_trie(sequences):
    members = collections.defaultdict(list)
    for c, s in sequences.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    children = collections.Counter(k[:-1] for k in members if k)
    rows = []
    for k, m in members.items():
        under = [x for x in members if x[: len(k)] == k]
        ends = ",".join(map(str, sorted(c for c in m if len(sequences[c]) == len(k))))
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in under if x)
        leaves = sum(not children[x] for x in under)
        parent = min(members[k[:-1]]) if k else None
        rows.append((min(m), len(k), parent, len(m), children[k], leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=str)


def own_turns(rows):
    found = collections.defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            found[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(v)] for c, v in found.items()}


def nodes_of(df):
    return sorted((tuple(r[c] for c in NODE) for r in df.collect()), key=str)


def conversations():
    rows = []
    for c in [*range(140), 205, 307, -3, -101, 1 << 40]:
        for t in range(RANDOM.choice([0, 1, 1, 2, 3, 5, 8])):
            rows.append((c, t, RANDOM.choice(["user", "assistant", None]), RANDOM.choice(["hello", "", None, "näher 😀", "x"])))
    rows += [(500, t, "user", f"turn {t}") for t in range(300)] + [(507, t, "user", f"turn {t}") for t in range(299)]
    rows += [(600 + i, t, "user", "same") for i in range(60) for t in range(4)]
    rows += [(7000, None, "user", "first"), (7000, 0, "user", "second"), (7000, -1, "user", "third"), (None, 0, "user", "nobody")]
    rows += [(7001, 0, "user", "long " * 20_000)]
    return [(*r, "own", 5, "own") for r in rows]


@pytest.mark.parametrize("most", [4096, 40, 1])
def test_trie_of_rebuilt_conversations(spark, most):
    rows = conversations()
    own = own_turns(rows)
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:]
    df = spark.createDataFrame(rows, CONVERSATION).repartition(5)
    assert nodes_of(tries.prefix_trie(tries.rebuilt(df), most)) == brute_trie(rebuilt)


def test_trie_of_conversations_as_they_are(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, CONVERSATION)
    assert nodes_of(tries.prefix_trie(tries.sequences(df), 100)) == brute_trie(own_turns(rows))


def test_trie_of_an_empty_table(spark):
    df = spark.createDataFrame([], CONVERSATION)
    assert tries.prefix_trie(tries.rebuilt(df)).count() == 0


def test_members_of_a_sequence_are_hashed_over_ranges(spark):
    """A sequence that thousands share is many bounded rows, hashed in numeric order."""
    rows = [(i, 0, "user", "same") for i in range(0, 30_000, 7)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = tries.suffixes(tries.sequences(df)).collect()
    listed = ",".join(str(r[0]) for r in rows)
    assert [(r["n"], r["conv_id"], r["ends"]) for r in found] == [(len(rows), 0, hashlib.sha256(listed.encode()).hexdigest())]


def test_chains_burst_at_once(spark):
    """Turns that all suffixes share cost one round, however many they are."""
    rows = [(c, t, "user", f"turn {t}" if t < 200 else f"{c}") for c in range(20) for t in range(201)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    paths = tries.suffixes(tries.sequences(df))
    kept, bursts = tries.burst(paths, 30)
    assert len(bursts) == 1
    assert bursts[0].select("at", "to", "n").collect() == [(0, 200, 20)]


def test_turns_meet_in_one_shuffle_without_texts(spark):
    df = tries.rebuilt(spark.createDataFrame(conversations(), CONVERSATION))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 2  # one for each side of the join, the same exchange
    assert "text" not in df.columns


# --- quality rules

LINES = ["The one of line", "- a bullet", "more text ...", "tan re mi", "", "  "]
TEXTS = [
    None, "", " \n\t", "One", "a b c a b c", "a a a a", "a b a b a", prose(49, 1), prose(50, 2), prose(400, 3),
    " ".join([prose(40, 4)] * 3), "\n".join(RANDOM.choice(LINES) for _ in range(60)), "### $$$ " * 40 + prose(60, 5),
    "x" * 90_000 + " " + prose(20_000, 6), "tan ren " * 9000, "ä ö 😀😀  x\x0by\x1cz", "the of and is " * 30 + prose(100, 7),
]


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    times = collections.Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_stop_words": sum(w in rules.STOP_WORDS for w in words), "n_repeat_words": len(repeated), "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)), "n_bullet_lines": sum(bool(re.match(r"[ \t]*[-*•‣]", x)) for x in lines),
        "n_ellipsis_lines": sum(bool(re.search(r"(\.\.\.|…)[\x20\x09-\x0D]*$", x)) for x in lines),
    }


def brute_failed(counts, table):
    failed = []
    for rule in table:
        part, whole = counts[rule.part] * (100 if rule.whole else 1), counts[rule.whole] if rule.whole else 1
        if (rule.least is not None and part < rule.least * whole) or (rule.most is not None and part > rule.most * whole):
            failed.append(rule.name)
    return failed


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i, t, "own", 3, 0.5) for i, t in enumerate(TEXTS)] + [(1, "", "own", 3, 0.5), (None, prose(60, 8), "x", 1, 0.1)]
    return spark.createDataFrame(rows, "doc_id long, text string, judged string, n_words long, kept double")


def test_rules(texts):
    rows = rules.judge(texts, into="verdict").collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        expected = brute_counts(r["text"])
        verdict = r["verdict"].asDict(recursive=True)
        assert verdict["counts"] == expected, (r["text"] or "")[:80]
        assert verdict["base_failed"] == brute_failed(expected, rules.BASE_RULES)
        assert verdict["failed"] == brute_failed(expected, rules.RULES)


def test_rules_come_from_the_table(texts):
    own = [rules.Rule("long", "n_words", None, None, 100), rules.Rule("chars", "word_chars", "n_words", 200, None)]
    rows = rules.judge(texts, own, [], "verdict").collect()
    for r in rows:
        assert r["verdict"]["failed"] == brute_failed(brute_counts(r["text"]), own)
    assert rules.judge(texts, [], [], "v").where(rules.passes(F.col("v"))).count() == len(rows)


def test_good_documents_keep_their_columns(spark, texts):
    kept = rules.keep_good(texts)
    assert kept.columns == texts.columns
    assert {r["judged"] for r in kept.collect()} <= {"own", "x"}
    assert rules.keep_good(spark.createDataFrame([], texts.schema)).count() == 0


def test_rules_are_one_projection(texts):
    plan = rules.judge(texts)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Python|Arrow|Window|Generate|Aggregate", plan)


# --- lexical search

DOCS = [
    (1, "Alpha beta, alpha GAMMA."), (2, "alpha-beta_alpha gamma"), (3, None), (4, " .,; "), (5, "alphabet betamax"),
    (6, "Ärger ärger ÄRGER İx 漢字 x²"), (7, "delta " * 30_000), (8, "alpha beta alpha gamma"), (8, "alpha beta alpha gamma"),
    (None, "alpha beta alpha gamma"), (9, prose(300, 9)), (10, prose(30, 10)), (11, "alpha " + prose(40, 11)), (12, "beta\x00beta\x7fbeta"),
]
ITEMS = [
    (1, "alpha Beta"), (2, "alpha alpha delta"), (3, None), (4, "..."), (5, "nowhere"), (6, "ärger 漢字 x²"), (7, prose(12, 9)), (7, prose(12, 9)),
    (8, "gamma"), (8, "delta"), (None, "beta tan"), (9, "alphabet " + "zzz " * 2000),
]


def brute_search(docs, items, k=10):
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(upper))
    counted = [(i, collections.Counter(terms(t))) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in counted), sum(sum(c.values()) for _, c in counted)
    df = collections.Counter(t for _, c in counted for t in c)
    wanted = collections.defaultdict(list)
    for i, t in sorted(set(items), key=str):
        wanted[i] += terms(t)
    rows = []
    for item, words in wanted.items():
        scored = []
        for doc, c in counted:
            m = 25 + 75 * sum(c.values()) * n_docs // total if c else 0
            score = 0
            for w in words:
                if c[w]:
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1)))
                    score += weight * (1_000_000_000 * c[w] // (1000 * c[w] + 8 * m))
            if score:
                scored.append((-score, doc is None, doc or 0))
        rows += [(item, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(rows, key=str)


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.createDataFrame([(*d, 1, "x") for d in DOCS], "doc_id long, text string, score int, term string").repartition(4)
    items = spark.createDataFrame([(*i, 1, 2) for i in ITEMS], "item_id long, text string, doc_id int, rank int")
    return docs, items


@pytest.mark.parametrize(("k", "block"), [(10, 4 << 20), (10, 40), (2, 4 << 20)])
def test_search(corpus, k, block):
    rows = lexical.search(*corpus, k=k, block_bytes=block).select("item_id", "rank", "doc_id", "score").collect()
    assert sorted(map(tuple, rows), key=str) == brute_search(DOCS, ITEMS, k)


def test_search_of_text_ids_and_empty_tables(spark, corpus):
    docs, items = corpus
    named = items.withColumn("item_id", F.concat(F.lit("item "), F.col("item_id").cast("string")))
    assert lexical.search(docs, named).where("item_id = 'item 1'").count() == 7
    for a, b in ((docs.limit(0), items), (docs, items.limit(0)), (docs.where("doc_id = 3"), items), (docs, items.where("item_id = 4"))):
        assert lexical.search(a, b).collect() == []


def test_best_rows_keep_ties_by_id():
    import numpy as np

    best = lexical.Best(1, 3)
    for doc in (9, 4, 7, 1, 8):
        best.add(np.array([0]), np.array([5]), doc)
        best.settle()
    best.add(np.array([0]), np.array([6]), 30)
    best.settle()
    assert [x.tolist() for x in best.rows] == [[0, 0, 0], [6, 5, 5], [30, 1, 4]]


def test_terms_are_whole():
    counter = lexical.TermCounter(["alpha", "beta", "al", "ärger"])
    assert counter.of("Alpha alpha-alphabet BETA, ärger") == (5, {0: 2, 1: 1, 3: 1})
    assert counter.of(None) == (0, {})
    assert lexical.TermCounter([]).of("a b") == (2, {})
