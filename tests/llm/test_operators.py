"""Operators on small literal tables, against brute force: nulls, ties, copies, empty tables."""

import collections
import hashlib
import random
import re
import sys
import unicodedata
import zlib

import numpy as np
import pytest
from panelcast.llm import binary, decontaminate, minhash, packing, pii, pivots, quality, substrings, toxicity, warc
from panelcast.llm.components import components
from panelcast.llm.shared import shared_folder
from panelcast.llm.tokens import encoder, tokenizer_path

SCHEMA = "doc_id long, text string, n_words long, score double, hits string, key string, start int"
RANDOM = random.Random(5)
VOCABULARY = [a + b for a in ("ta", "re", "mi", "so", "lu") for b in ("n", "r", "sk", "ll", "m", "p", "dt")]


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


BASE = prose(160, 1)
ROWS = [
    (1, BASE),
    (2, BASE),
    (3, prose(60, 2) + " " + " ".join(BASE.split()[20:100]) + " " + prose(40, 3)),
    (4, None),
    (5, ""),
    (6, " \n "),
    (7, "One"),
    (8, BASE.replace("tan", "TAN", 2) + "\nend."),
    (8, BASE.replace("tan", "TAN", 2) + "\nend."),
    (9, "x" * 70_000 + " " + prose(5000, 4)),
    (10, "la " * 300),
    (11, prose(3000, 6)),
    (None, prose(80, 7)),
    (12, " ".join(w if i % 40 else "new" for i, w in enumerate(BASE.split()))),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 7, 0.5, "x", "y", 3) for i, t in ROWS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ids_of(path, text, end=2):
    found = encoder(path).tokenizer.encode(text or "", add_special_tokens=False).ids if text else []
    return [*found, end]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_encode_as_the_whole_text(name):
    path = tokenizer_path(name)
    odd = ["a  b", "  a b ", "a\n\nb", "\n a", "a's don't 'S", "İstanbul ΑΣ é é", "12 34.5 a1b2", "_a_ b_", "...a.b,", "tab\tx y\x1cz",
           "<|endoftext|> a<|endoftext|>b", "a\x00b c", "漢字 かな", "½ ²", "a.\nB's. c", "a\r\nb", "c.\n d", "x!! y!!", "a b  c"]
    for text in [*odd, *(t for _, t in ROWS if t)]:
        assert np.frombuffer(encoder(path).encode(text), "<u4").tolist() == ids_of(path, text)[:-1]


def _characters():
    """Some characters of every Unicode category, and those that cutting rules treat apart."""
    by_category = collections.defaultdict(list)
    for c in map(chr, range(sys.maxunicode + 1)):
        category = unicodedata.category(c)
        if category not in ("Cs", "Cn", "Co"):
            by_category[category].append(c)
    rng = random.Random(2)
    some = [c for found in by_category.values() for c in rng.sample(found, min(len(found), 40))]
    return some + list("²³¹₂½ⅷİıßſΣςéœ漢ｶ\u0301\u0307\u200d\u00a0\u0085\u2028 \n\t\r\x0b\x1c.,'_-!?aZz09") * 8


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_encode_as_the_whole_text_in_any_script(name):
    path, rng, characters = tokenizer_path(name), random.Random(8), _characters()
    known = ["km²", "x³ CO₂ word²", "İ.", "İ, x", "ǅ.a", "a\u0301.b", "5.5,6", "é.é, è", "don't.", "word.\u0301x"]
    texts = ["".join(rng.choice([rng.choice(characters), rng.choice("abc .,²İ")]) for _ in range(rng.randrange(1, 14))) for _ in range(20_000)]
    encode = encoder(path)
    wrong = [t for t in known + texts if np.frombuffer(encode.encode(t), "<u4").tolist() != ids_of(path, t)[:-1]]
    assert not wrong, (len(wrong), wrong[:5])


def test_token_files(spark, docs, empty):
    folder = shared_folder(spark, "test-tokens")
    binary.write_tokens(docs, folder)
    rows = binary.read_tokens(spark, folder).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == sorted((i for i, _ in ROWS), key=lambda i: -1 if i is None else i)
    at = 0
    texts = dict(ROWS)
    for r in rows:
        assert (r["start"], r["n_tokens"]) == (at, len(r["ids"]))
        assert r["ids"] == ids_of(tokenizer_path("word_bpe_49k.json"), texts[r["doc_id"]])
        at += r["n_tokens"]
    assert "ids" not in binary.read_tokens(spark, folder, ("n_tokens",)).columns
    import glob

    import pyarrow.parquet as pq

    path = max(glob.glob(folder.removeprefix("file:") + "/part-*"), key=lambda p: pq.ParquetFile(p).metadata.num_rows)
    group = pq.ParquetFile(path).metadata.row_group(0)
    column = next(group.column(i) for i in range(group.num_columns) if group.column(i).path_in_schema == "ids.list.element")
    assert "DELTA_BINARY_PACKED" in column.encodings and column.has_column_index and column.has_offset_index
    none = shared_folder(spark, "test-tokens")
    binary.write_tokens(empty, none)
    assert binary.read_tokens(spark, none).count() == 0


def check_packing(rows, capacity):
    held = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def test_packing(docs, empty):
    rows = packing.pack(docs).collect()
    path = tokenizer_path("byte_bpe_50k.json")
    used = check_packing(rows, 1024)
    total = sum(r["length"] for r in rows)
    assert used <= 1 + total // 1024 + 2
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], set()).add((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for doc_id, text in ROWS:
        ids = np.array(ids_of(path, text), "<u4")
        at, found = 0, sorted(by_doc[doc_id])
        assert [p for p, *_ in found] == list(range(len(found)))
        for k, (_, start, length, crc) in enumerate(found):
            assert start == at and (length == 1024 or k == 0)
            assert crc == zlib.crc32(ids[start : start + length].tobytes())
            at += length
        assert at == len(ids)
    assert packing.pack(empty).count() == 0


def fewest(sizes, capacity):
    best = [len(sizes)]

    def place(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(rooms)
            return
        for room in set(rooms):
            if room >= sizes[k]:
                i = rooms.index(room)
                place(k + 1, rooms[:i] + [room - sizes[k]] + rooms[i + 1 :])
        place(k + 1, [*rooms, capacity - sizes[k]])

    place(0, [])
    return best[0]


def test_dominance_reduction_keeps_the_optimum():
    for seed in range(40):
        rng = random.Random(seed)
        sizes = sorted((rng.randint(1, 20) for _ in range(9)), reverse=True)
        counts = {s: sizes.count(s) for s in set(sizes)}
        fixed, left = packing.dominance_reduction(counts, 20)
        rest = sorted((s for s, n in left.items() for _ in range(n)), reverse=True)
        assert sum(n for _, n in fixed) + fewest(rest, 20) == fewest(sizes, 20)
        placed = [s for pattern, n in [*fixed, *packing.best_fit(left, 20)] for s in pattern * n]
        assert sorted(placed) == sorted(sizes)


def test_warc_round_trip(spark):
    page = "<p>" + "long enough " * 20
    rows = [(3, "http://a/", page), (1, None, page), (2, "http://b/\r\nX: y", "short"), (5, "http://c/", "short"), (4, "u", None),
            (None, "n", page), (1, None, page), (6, "w", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 9), (7, "é", "ñ漢" * 50)]
    pages = spark.createDataFrame([(*r, 1, "d") for r in rows], "page_id long, url string, html string, bytes int, digest string")
    folder = shared_folder(spark, "test-warc")
    warc.write_warc(pages, folder)
    got = warc.assemble(warc.read_warc(spark, folder)).collect()
    assert len(got) == len(rows)
    for r in got:
        key = re.fullmatch(r"<urn:page:(.*)>", r["record_id"])[1]
        html = next(h or "" for i, _, h in rows if str(i).replace("None", "null") == key)
        raw = html.encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert r["request"]["record_id"] == f"<urn:request:{key}>" and r["metadata"]["record_id"] == f"<urn:metadata:{key}>"
        assert r["type"] == ("revisit" if key == "3" else "response")
        assert r["refers_to"] == ("<urn:page:1>" if key == "3" else None)
        assert r["payload"] is None if key == "3" else bytes(r["payload"]) == raw
    none = shared_folder(spark, "test-warc")
    warc.write_warc(pages.limit(0), none)
    assert warc.assemble(warc.read_warc(spark, none)).count() == 0


def test_assembly_follows_links_both_ways(spark):
    def row(kind, name, *concurrent):
        return (kind, name, list(concurrent), None, None, None, None, None, None, 0, None)

    records = [row("response", "r1", "q1"), row("request", "q1"), row("metadata", "m2", "r1"), row("metadata", "m1", "r1"),
               row("request", "lost", "gone"), row("revisit", "r2"), row("warcinfo", "i")]
    got = {r["record_id"]: r for r in warc.assemble(spark.createDataFrame(records, warc.RECORDS)).collect()}
    assert set(got) == {"r1", "r2"}
    assert got["r1"]["request"]["record_id"] == "q1" and got["r1"]["metadata"]["record_id"] == "m1"
    assert (got["r1"]["metadata_records"], got["r2"]["request"], got["r2"]["request_records"]) == (2, None, 0)


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(i, 1 if i < 100 else 0, "x") for i in range(200)] + [(1, None, "x")], "doc_id long, quality int, text string")
    good = [(i, prose(50 + i, i)) for i in range(100)]
    bad = [(i, "!! ".join(prose(50, i).upper().split())) for i in range(100, 200)]
    model = quality.fit(spark.createDataFrame(good + bad, "doc_id long, text string"), labels)
    scored = quality.score_quality(docs, model).collect()
    assert len(scored) == len(ROWS) and all(0 <= r["score"] <= 1 for r in scored)
    held = quality.score_quality(spark.createDataFrame([(1, prose(80, 900)), (2, "!! ".join(prose(60, 901).upper().split()))], "doc_id long, text string"), model)
    assert [r["predicted"] for r in held.orderBy("doc_id").collect()] == [1, 0]
    assert quality.score_quality(empty, model).count() == 0
    blank = quality.fit(empty, labels)
    assert {r["score"] for r in quality.score_quality(docs, blank).collect()} == {0.5}
    one_class = quality.fit(spark.createDataFrame(good, "doc_id long, text string"), labels)
    assert {r["score"] for r in quality.score_quality(docs, one_class).collect()} == {1.0}


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.parametrize(("window", "seed", "bucket"), [(50, 20, 200), (50, 20, 1), (5, 3, 200), (4, 4, 2)])
def test_repeated_windows(docs, empty, window, seed, bucket):
    first = {}
    for doc_id, text in ROWS:
        w = words_of(text)
        for i in range(len(w) - window + 1) if doc_id is not None else ():
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, doc_id), doc_id)
    expected = []
    for doc_id, text in ROWS:
        w, gone = words_of(text), set()
        for i in range(len(w) - window + 1) if doc_id is not None else ():
            if first[tuple(w[i : i + window])] < doc_id:
                gone.update(range(i, i + window))
        expected.append((doc_id, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    got = [tuple(r) for r in substrings.remove_repeats(docs, window, seed, bucket).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert substrings.remove_repeats(empty, window, seed, bucket).count() == 0


@pytest.mark.parametrize("limit", [1 << 20, 600])
def test_passages(spark, docs, empty, limit):
    base = BASE.split()
    items = [(1, " ".join(base[30:45])), (2, "ONE!"), (20, None), (3, ""), (None, " ".join(base[0:10])), (1, " ".join(base[30:45])), (4, "la, la. LA")]
    table = spark.createDataFrame([(*i, "z") for i in items], "item_id long, text string, hits string")
    got = decontaminate.find_passages(docs, table, limit).select("doc_id", "text", "hits").collect()
    word = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")
    lower = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")
    for r in got:
        w, hit, found = word.findall(lower(r["text"])), set(), set()
        for item, text in items:
            p = word.findall(lower(text))
            for k in range(max(len(p) - 9, 1)) if p else ():
                part = p[k : k + 10]
                for i in range(len(w) - len(part) + 1):
                    if w[i : i + len(part)] == part:
                        hit.update(range(i, i + len(part)))
                        found.update([] if item is None else [str(item)])
        spans = r["hits"]["spans"]
        assert r["hits"]["n_words"] == len(w) and r["hits"]["items"] == sorted(found)
        assert {p for a, b in zip(spans[::2], spans[1::2], strict=True) for p in range(a, b)} == hit
        places = [m.span() for m in word.finditer(r["text"] or "")]
        assert r["hits"]["chars"] == [x for a, b in zip(spans[::2], spans[1::2], strict=True) for x in (places[a][0], places[b - 1][1])]
    assert decontaminate.find_passages(empty, table).count() == 0
    assert decontaminate.drop_contaminated(docs, table.limit(0)).count() == len(ROWS)
    assert decontaminate.drop_contaminated(docs, table).columns == docs.columns


def test_toxicity(spark, docs, empty):
    rng = random.Random(3)
    insults = ["grumbold", "snarkfid"]
    rows, labels = [], []
    for i in range(240):
        w = prose(40, 1000 + i).split()
        if i % 4 == 0:
            w.insert(rng.randrange(40), rng.choice(insults))
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    probe = ["grumbold", "GRUMBOLD!!", "gru-mbold", "g r u m b o l d", "taresk", "", None]
    tests = [(i, f"{prose(30, 5000 + i)} {t or ''}" if t is not None else None) for i, t in enumerate(probe)]
    got = toxicity.score_toxicity(spark.createDataFrame(tests, "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [r["predicted"] for r in got] == [1, 1, 1, 1, 0, 0, 0]
    scored = toxicity.score_toxicity(docs, model).collect()
    assert len(scored) == len(ROWS) and all(0 <= r["score"] <= 1 for r in scored)
    assert toxicity.score_toxicity(empty, model).count() == 0
    blank = toxicity.fit(empty, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert {r["score"] for r in toxicity.score_toxicity(docs, blank).collect()} == {0.5}


def test_toxicity_of_several_words(spark):
    """One word of a family says nothing, three of them make a document toxic."""
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        w = prose(40, 9000 + i).split()
        for _ in range(3 if i % 4 == 0 else i % 2):
            w.insert(rng.randrange(40), "grumbold" + rng.choice(VOCABULARY))
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(table.where("doc_id < 400"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = toxicity.score_toxicity(table.where("doc_id >= 400"), model).collect()
    truth = dict(labels)
    missed = sum(truth[r["doc_id"]] and not r["predicted"] for r in got)
    false = sum(r["predicted"] and not truth[r["doc_id"]] for r in got)
    assert len(got) == 200 and missed <= 2 and false <= 4


def test_kernel_equals_its_definition():
    def phi(word):
        c, out = toxicity.codes(word), {}
        for i in range(len(c)):
            for j in range(i + 1, len(c)):
                for k in range(j + 1, min(len(c), i + toxicity.SPAN)):
                    if c[i] and c[j] and c[k]:
                        key = (c[i], c[j], c[k])
                        out[key] = out.get(key, 0) + toxicity.DECAY ** (k - i + 1)
        return out

    words = ["banana", "ban-ana", "a", "anab4na", "réé"]
    triples = toxicity.Triples.of(words)
    for i, a in enumerate(words):
        got = triples.kernel(triples.dense(i))
        for j, b in enumerate(words):
            x, y = phi(a), phi(b)
            norm = np.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
            expected = sum(v * y.get(k, 0) for k, v in x.items()) / norm if norm else 0
            assert got[j] == pytest.approx(expected, abs=1e-9)


def reach(n, links):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return [root(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(9)
    links = [(i, i + 1) for i in range(60, 100)] + [(rng.randrange(50), rng.randrange(50)) for _ in range(30)] + [(7, 7)]
    got = components(spark.createDataFrame([*links, (None, 3), (links[0][1], links[0][0])], "a long, b long")).collect()
    expected = reach(101, links)
    assert {r["node"]: r["component"] for r in got} == {i: expected[i] for ab in links for i in ab if ab[0] != ab[1]}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("block", [1024, 7])
def test_vectors(spark, block):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    vectors = [c + rng.normal(size=16) * s for c in centres for s in (0, 0, 0.03, 0.05, 0.06, 0.08, 0.1, 0.12)] + [*rng.normal(size=(200, 16))]
    rows = [(i, [float(x) for x in v], i % 3 if i > 100 else 0) for i, v in enumerate(vectors)]
    n = len(rows)
    rows += [(n, None, 0), (n + 1, [], 0), (n + 2, [0.0] * 16, 0), (n + 3, [float("nan")] * 16, 0), (n + 4, [None] * 16, 0), (n + 5, rows[0][1], None), (n + 6, rows[0][1][:8], 0)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, n_links int")
    usable = {i: pivots.usable(v) for i, v, y in rows if y is not None and pivots.usable(v) is not None}
    label = {i: y for i, _, y in rows}
    links = [(a, b) for a, x in usable.items() for b, y in usable.items() if a < b and label[a] == label[b] and len(x) == len(y)
             and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98]
    expected = reach(n + 7, links)
    got = {r["vec_id"]: r for r in pivots.near_vectors(df, block=block).collect()}
    assert len(got) == len(rows) and len(links) > 100
    for i, r in got.items():
        assert (r["n_links"], r["component_id"]) == (sum(i in ab for ab in links), expected[i])
        assert r["kept"] == (i == expected[i])
    assert pivots.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize(("whole", "block"), [(0, 1024), (0, 200), (4000, 1024)])
def test_vectors_of_a_dense_group(spark, whole, block):
    """A third of all vectors are near copies, a fifth lie loosely around them, the rest are near pairs."""
    rng = np.random.default_rng(4)
    n, size = 3000, 64
    centre = rng.normal(size=size)
    v = rng.normal(size=(n, size))
    v[:1000] = centre + rng.uniform(0.03, 0.12, (1000, 1)) * v[:1000]
    v[1000:1600] = centre + rng.uniform(0.2, 0.6, (600, 1)) * v[1000:1600]
    v[2300:] = v[1600:2300] + 0.1 * v[2300:]
    df = spark.createDataFrame([(i, x.tolist(), "a") for i, x in enumerate(v)], "vec_id long, embedding array<double>, label string")
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    links = unit @ unit.T >= 0.98
    np.fill_diagonal(links, False)
    got = {r["vec_id"]: r["n_links"] for r in pivots.near_vectors(df, whole=whole, block=block).collect()}
    found = np.array([got[i] for i in range(n)])
    expected = links.sum(axis=1)
    assert (found <= expected).all() and expected[:1000].mean() > 900
    least = 1.0 if whole else 0.999
    assert found.sum() >= least * expected.sum() and found[1600:].sum() >= least * expected[1600:].sum()


def test_clusters_larger_than_a_block(spark):
    """Blocks of three sets: heads, then the members outside the largest component, find all links."""
    rng = random.Random(8)
    rows = []
    for k in range(14):
        w = [f"{'wz'[k % 4 == 0]}{i}" for i in range(160)]
        for _ in range(k % 7):
            w[rng.randrange(160)] = f"v{rng.randrange(999)}"
        rows.append((k, " ".join(w)))
    texts = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    clusters = spark.createDataFrame([(k, 0) for k, _ in rows], "node long, component long").coalesce(1)
    got = [(r["a"], r["b"]) for r in minhash.verified_links(texts, clusters, 2, 80, 3).collect()]
    sets = {k: set(zip(t.split(), t.split()[1:], strict=False)) for k, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert reach(14, got) == reach(14, links) and len(set(reach(14, links))) == 2


def test_briefs_count_equal_places():
    rng = np.random.default_rng(3)
    signatures = rng.integers(0, 1 << 32, (20, minhash.SIGNATURE), dtype=np.uint32)
    signatures[1:, :100] = signatures[0, :100]
    m = np.frombuffer(b"".join(map(minhash.brief, signatures)), np.uint64).reshape(20, -1)
    for i in range(20):
        expected = ((signatures[i + 1 :] & 3) == (signatures[i] & 3)).sum(axis=1)
        assert minhash.equal_places(m, i).tolist() == expected.tolist()


def test_near_documents(spark, docs, empty):
    size = 2
    rng = random.Random(8)
    near = []
    for k in range(40):
        w = BASE.split()
        for _ in range(k % 9):
            w[rng.randrange(len(w))] = f"v{rng.randrange(999)}"
        near.append((100 + k, " ".join(w)))
    more = spark.createDataFrame([(*r, 1) for r in near], "doc_id long, text string, component_id int")
    table = docs.select("doc_id", "text").unionByName(more.select("doc_id", "text"))
    sets = {}
    for i, t in [*ROWS, *near]:
        w = words_of(t.lower()) if t else []
        sets[i] = {tuple(w[k : k + size]) for k in range(max(len(w) - size + 1, 1))} if w else set()
    ids = [i for i in sets if i is not None]
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    expected = reach(200, links)
    for r in minhash.near_documents(table, size).collect():
        assert r["n_shingles"] == len(sets[r["doc_id"]])
        assert r["component_id"] == (None if r["doc_id"] is None else expected[r["doc_id"]])
        assert r["kept"] == (r["doc_id"] is None or r["doc_id"] == expected[r["doc_id"]])
    assert minhash.near_documents(empty, size).count() == 0
    kept = minhash.keep_one(docs, size)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted({expected[i] for i, _ in ROWS if i is not None})


def test_chosen_paths_recurse_until_nodes_are_small(spark):
    """Large nodes of copies, of half-similar texts and of texts with frequent words, by leaves of four."""
    rng = random.Random(18)
    kernel = [f"k{i}" for i in range(120)]
    texts = []
    for k in range(160):
        changes = (1, 4, 9, 16)[k % 4]
        w = list(kernel)
        for _ in range(changes):
            w[rng.randrange(len(w))] = f"v{rng.randrange(9999)}"
        texts.append(" ".join(w))
    texts += ["the same opening words stand here " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(12)) for _ in range(120)]
    sets = [{tuple(w[k : k + 2]) for k in range(len(w) - 1)} for w in map(str.split, texts)]
    n = range(len(sets))
    shingler = minhash.ShingleSets(2)
    rows = []
    for i, t in enumerate(texts):
        sig = minhash.signature(shingler.of(t))
        rows.append((i, sig.view(np.int32).tolist(), *np.frombuffer(minhash.brief(sig), np.int64).tolist()))
    schema = "rep long, signature array<int>, b0 long, b1 long, b2 long, b3 long"
    classes = spark.createDataFrame(rows, schema).repartition(3)
    for percent, depth in ((80, None), (95, 2)):
        links = [(a, b) for a in n for b in n if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
        found = minhash.candidate_links(classes, percent, leaf=4, depth=depth).collect()
        joined = reach(len(texts), [(r["a"], r["b"]) for r in found])
        assert links and all(joined[a] == joined[b] for a, b in links)
        # Texts that share frequent words alone are no candidates.
        assert depth or all(joined[i] == i for i in n if i >= 160)
    with pytest.raises(ValueError):
        minhash.candidate_links(classes, 50)


def test_nodes_are_finished_in_one_task(spark, monkeypatch):
    """Levels of a dense group take no shuffle each; nodes above the limit do, with the same components."""
    rng = np.random.default_rng(8)
    centre = rng.integers(0, 1 << 32, minhash.SIGNATURE, dtype=np.uint32)
    other = rng.integers(0, 1 << 32, (600, minhash.SIGNATURE), dtype=np.uint32)
    share = np.r_[np.full(300, 0.12), np.full(200, 0.75), np.full(100, 1.1)][:, None]
    signatures = np.where(rng.random((600, minhash.SIGNATURE)) < share, other, centre)
    rows = [(i, s.view(np.int32).tolist(), *np.frombuffer(minhash.brief(s), np.int64).tolist()) for i, s in enumerate(signatures)]
    classes = spark.createDataFrame(rows, "rep long, signature array<int>, b0 long, b1 long, b2 long, b3 long").repartition(3)
    names = []
    keep = minhash.written
    monkeypatch.setattr(minhash, "written", lambda df, name, *more: names.append(name) or keep(df, name, *more))
    found = [(r["a"], r["b"]) for r in minhash.candidate_links(classes, leaf=20).collect()]
    assert names == ["large-nodes"]
    apart = [(r["a"], r["b"]) for r in minhash.candidate_links(classes, leaf=20, node=150).collect()]
    assert names.count("large-nodes") > 2
    for links in (found, apart):
        joined = reach(600, links)
        assert len({joined[i] for i in range(300)}) == 1
        assert all(joined[i] == i for i in range(500, 600))
    many = np.concatenate([signatures & 255] * 3).astype(np.uint8)
    agree = minhash.leaf_roots(np.frombuffer(b"".join(map(minhash.brief, many)), np.uint64).reshape(len(many), -1), 85)
    near = [(i, j) for i in range(600) for j in range(i) if ((signatures[i] & 3) == (signatures[j] & 3)).sum() >= 85]
    assert agree.tolist() == [reach(600, near)[i % 600] for i in range(len(many))]


def test_keep_one_of_repeated_ids(spark):
    rows = [(1, "b c d e f g", 1), (1, "a c d e f h", 2), (2, None, 3), (2, "x y z v w u", 4), (3, "q", 6), (3, "q", 5), (None, "q", 7)]
    table = spark.createDataFrame(rows, "doc_id long, text string, n long").repartition(4)
    kept = {(r["doc_id"], r["n"]) for r in minhash.keep_one(table).collect()}
    assert kept == {(1, 2), (2, 3), (3, 5), (None, 7)}


def test_components_with_heavy_nodes_split(spark, monkeypatch):
    from panelcast.llm import components as module

    monkeypatch.setattr(module, "NODES", 0)
    edges = [(0, i) for i in range(1, 300)] + [(299, 500), (500, 501), (502, 501), (700, 701)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert got == {**{i: 0 for i in [*range(300), 500, 501, 502]}, 700: 700, 701: 700}


PERSONAL = [
    (1, "Mail Ann.B22@mail7.example.com or ANN.B22@MAIL7.EXAMPLE.COM!! call +1 (411) 555-1507, 411-555-1507."),
    (2, "ip 10.2.33.240 card 4539578763621486 and 4539 5787 6362 1486; Mrs. Anna Bell met Herr Bell, Mr. Anna Bell. Госпожа Анна Иванова"),
    (3, 'token = "34cf1be9225426587b06121cb35ab512e5a1beb5" x'),
    (3, 'token = "34cf1be9225426587b06121cb35ab512e5a1beb5" x'),
    (4, None),
    (5, ""),
    (None, "+1!! (068)!! 555-2748!! end"),
    (7, "version 3. and 2.0 plain, 1234 567-89"),
]


def test_surrogates(spark):
    df = spark.createDataFrame([(*r, 5, "k") for r in PERSONAL], "doc_id long, text string, n_entities int, text_key string")
    rows = pii.replace_personal_data(df)
    assert set(rows.columns) == {"doc_id", "text", "text_key", "n_entities", "entity_types"}
    got = {r["doc_id"]: r for r in rows.collect()}
    assert rows.count() == len(PERSONAL)
    first = got[1]["text"]
    mails = re.findall(r"\S+@[\w.]+", first)
    assert mails[0].upper() == mails[1] and "mail7.example.com" not in first.lower()
    assert re.findall(r"\+1 \((\d{3})\) (\d{3})-(\d{4})", first)[0] == re.findall(r", (\d{3})-(\d{3})-(\d{4})", first)[0]
    second = got[2]["text"]
    card = re.search(r"card (\d{16}) and ((?:\d{4} ){3}\d{4});", second)
    assert card[1] == card[2].replace(" ", "") != "4539578763621486"
    luhn = lambda s: sum(sum(divmod(int(c) * (2 - i % 2), 10)) for i, c in enumerate(s)) % 10
    assert luhn(card[1]) == luhn("4539578763621486")
    assert re.search(r"ip [1-9]\d\.[1-9]\.[1-9]\d\.[12]\d\d ", second)
    names = re.search(r"Mrs\. (\w+na) (\w+) met Herr (\w+), Mr\. (\w+ton) (\w+)\. Госпожа ([А-Яа-я]+на) [А-Яа-я]+$", second)
    assert names[2] == names[3] == names[5] and names[1] != "Anna"
    assert re.fullmatch(r'token = "[0-9a-f]{40}" x', got[3]["text"]) and got[3]["text"] != PERSONAL[2][1]
    assert re.fullmatch(r"\+1!! \(\d{3}\)!! 555-\d{4}!! end", got[None]["text"])
    assert [got[i]["text"] for i in (4, 5, 7)] == [None, "", PERSONAL[-1][1]] and got[7]["n_entities"] == 0
    assert pii.replace_personal_data(df.limit(0)).count() == 0


def test_surrogates_stay_distinct(spark):
    """Nearly all numbers of a small space are taken, so many first draws collide."""
    values = [(f"family{i}",) for i in range(3)] + [(f"{a}.{b}.1.1",) for a in range(1, 10) for b in range(1, 6)]
    ents = spark.createDataFrame([("ip" if "." in v else "family", v) for (v,) in values], "type string, value string")
    got = pii.resolve(ents, "k").collect()
    drawn = {(r["type"], r["surrogate"].lower()) for r in got}
    assert len(drawn) == len(got) == len(values)
    assert not drawn & {("ip" if "." in v else "family", v) for (v,) in values}
    assert {tuple(r) for r in pii.resolve(ents, "k").collect()} == {tuple(r) for r in got}


def test_surrogates_of_exhausted_spaces(spark):
    """Every quad of single digits is real, and more names and short addresses occur than their first spaces hold."""
    quads = "concat_ws('.', id % 9 + 1, floor(id / 9) % 9 + 1, floor(id / 81) % 9 + 1, floor(id / 729) % 9 + 1)"
    ents = (
        spark.range(6561).selectExpr("'ip' AS type", f"{quads} AS value")
        .unionByName(spark.range(80_000).selectExpr("'family' AS type", "concat('name', id) AS value"))
        .unionByName(spark.range(18_000).selectExpr("'email' AS type", "concat(char(19968 + id % 150), '@', char(19968 + floor(id / 150)), '.x') AS value"))
    )
    ents = ents.selectExpr("type", "value").distinct()
    got = pii.resolve(ents, "k").collect()
    drawn = {(r["type"], r["surrogate"].lower()) for r in got}
    assert len(drawn) == len(got) == ents.count() and not drawn & {(r["type"], r["value"]) for r in got}
    assert all(re.fullmatch(pii.PATTERNS["ip"].replace("+", ""), r["surrogate"]) for r in got if r["type"] == "ip")


def test_surrogates_of_whole_names(spark):
    """Names of more than two words, particles, and mentions without a form of address."""
    texts = [
        "Mr John Fitzgerald Kennedy spoke. Kennedy left; KENNEDY's hat, Fitzgerald and John stayed, kennedy did not.",
        "Mrs Anna Bell called. Bell said so, Anna Bell did. Bells rang on Bell-Street. Mr Bell's dog.",
        "Frau Eva von der Tann Mr Bell, Herr Tann.",
        "Bell and Anna are alone here.",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r["text"] for r in pii.replace_personal_data(df).orderBy("doc_id").collect()]
    first = re.fullmatch(r"Mr (\w+ton) (\w+ton) (\w+) spoke\. (\w+) left; (\w+)'s hat, (\w+) and (\w+) stayed, kennedy did not\.", got[0])
    assert first[3] == first[4] == first[5].capitalize() != "Kennedy" and (first[1], first[2]) == (first[7], first[6])
    second = re.fullmatch(r"Mrs (\w+na) (\w+) called\. (\w+) said so, (\w+) (\w+) did\. Bells rang on (\w+)-Street\. Mr (\w+)'s dog\.", got[1])
    assert {second[i] for i in (3, 5, 6, 7)} == {second[2]} and second[1] == second[4]
    third = re.fullmatch(r"Frau (\w+na) von der (\w+) Mr (\w+), Herr (\w+)\.", got[2])
    assert third[2] == third[4] and third[3] == second[2] and got[3] == texts[3]


def test_word_maps_in_small_blocks(monkeypatch):
    """No block of rows of the map is larger than ``MAPPED`` words need, and maps are those of each word alone."""
    through = np.random.default_rng(6).normal(size=(32**3, 8)).astype(np.float32)
    words = ["", "x", "idiot", "i-d1ot", "überaus", *(f"word{i:x}s" for i in range(1500))]
    rows = []
    reduceat = np.add.reduceat

    class Add:
        @staticmethod
        def reduceat(maps, at, axis=0):
            rows.append(len(at))
            return reduceat(maps, at, axis=axis)

    expected = np.concatenate([toxicity._mapped([w], through) for w in words])
    monkeypatch.setattr(toxicity.np, "add", Add)
    got = toxicity._mapped(words, through)
    assert np.array_equal(got, expected) and max(rows) <= 64


def test_letters_spelled_one_by_one_are_never_ruled_out():
    rng = random.Random(66)
    for _ in range(20_000):
        text = "".join(rng.choice("ab éя 1._-*\n\t\u00a0 ") for _ in range(rng.randrange(24)))
        assert not toxicity._SPACED.search(text) or toxicity._LAST_TWO.search(text)


def test_stops_are_found_from_the_stop():
    """As by a look behind at every place, which takes longer: the patterns begin with the stop itself."""
    import re

    from panelcast.llm import tokens

    rng = random.Random(10)
    for _ in range(20_000):
        text = "".join(rng.choice("a1Zé .,\n\0") for _ in range(rng.randrange(12)))
        assert bool(tokens._LONE_STOP.search(text)) == bool(re.search(r"(?<![A-Za-z0-9])[.,]", text))
        assert tokens._OWN_STOP.sub("|\\1", text) == re.sub(r"(?<=[A-Za-z0-9])(?=[.,])", "|", text)
    assert tokens._LONE_STOP.pattern.startswith("[.,]") and tokens._OWN_STOP.pattern.startswith("([.,])")


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_columns_of_texts_have_the_ids_of_whole_texts(name):
    import pyarrow as pa
    from panelcast.llm import tokens

    path, rng, characters = tokenizer_path(name), random.Random(31), _characters()
    marks = ["é", "É.", "ß,", "ÿ", "µ.", "ª", "×", "÷a", "$$", "'s", "_", ".", ",", "...", "\n", "\n\n", "  ", " ", "\0", "\t", "a", "Z1", "<|endoftext|>", "e\u0301."]
    texts = ["".join(rng.choice([rng.choice(marks), rng.choice("abÀéñ .,\n"), rng.choice(characters)][: rng.choice((2, 2, 3))]) for _ in range(rng.randrange(12))) for _ in range(8_000)]
    texts += [None, "", " ", *(t for _, t in ROWS)]
    ids, offsets = encoder(path).encode_column(pa.array(["cut off", *texts], pa.string()).slice(1))
    assert len(offsets) == len(texts) + 1 and offsets[0] == 0 and offsets[-1] == len(ids)
    wrong = [t for t, a, b in zip(texts, offsets[:-1], offsets[1:]) if ids[a:b].tolist() != ids_of(path, t)[:-1]]
    assert not wrong, (len(wrong), wrong[:5])
    batch = pa.record_batch([pa.array(texts, pa.string())], ["text"])
    assert pa.Table.from_batches(list(tokens.text_slices(batch))).column(0).to_pylist() == texts
    assert [x.num_rows for x in tokens.text_slices(batch.slice(0, 0))] == []


def test_often_met_pieces_are_encoded_once(monkeypatch):
    """Rare pieces that fill the memory do not drive out the others, and Latin words need no cutting rule."""
    from panelcast.llm.tokens import PieceEncoder

    small, seen = PieceEncoder(tokenizer_path("byte_bpe_50k.json"), limit=50), collections.Counter()
    encode = small._encode_piece
    monkeypatch.setattr(small, "_encode_piece", lambda piece: seen.update([piece]) or encode(piece))
    for i in range(2_000):
        letters = "".join("abcdefghij"[int(c)] for c in str(i))
        small.encode(f"often été q{letters}")
    assert seen["often"] == 1 and seen[" été"] == 1 and len(seen) == 2_002
    assert len(small.pieces) + len(small.once) <= 104
