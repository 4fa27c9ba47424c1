"""The training-text operators against brute force, round trips and held-out accuracy, and on odd input."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from spotrace.llm import (
    brown_lm, byte_bpe, embedding_dedup, graph, html_extract, near_dedup, packing, quality_gam, quality_rules,
    substring_dedup, url_filter, words,
)
from spotrace.llm import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SMALL = "/root/testdata/sf0.001"
JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("ab ce di fo gu ha mi no".split(), k=rng.randint(1, 4))) for _ in range(n))


ODD_TEXTS = [
    None, "", "   \n\t ", "one", "two words", "a  b\t c\r\nd", "the same line.\nthe same line.\nthe same line.",
    "x" * 5000, prose(1, 3000), "é ñ 日本 \u00a0 \u2003 z", prose(2, 120), prose(2, 120), "!!! ### | | |", "spam " * 300,
    "\x1c odd \x85 spaces", "it's we'll <|endoftext|>",
]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts under clashing column names, with a null and a repeated doc_id."""
    rows = [(k if k != 5 else None, t, "x", 1.5, k, "y", [1], True) for k, t in enumerate(ODD_TEXTS)]
    rows.append(rows[10])
    schema = "doc_id long, text string, score string, n double, id int, key string, bands array<int>, kept boolean"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def no_docs(odd):
    return odd.where("false")


def test_hashes_follow_words_only():
    texts = ["ab cd", "cd  ab", "", "ab"]
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    starts, ends, first = words.word_spans(data, np.cumsum([0, *map(len, raw)]))
    h = words.hash_spans(data, starts, ends)
    assert first.tolist() == [0, 2, 4, 4, 5]
    assert h[0] == h[3] == h[4] and h[1] == h[2] and h[0] != h[1]


# --- encoding and packing ---------------------------------------------------


def test_bpe_equals_library_and_decodes():
    import tiktoken

    with open(RANKS, "rb") as file:
        content = file.read()
    codec = byte_bpe.Codec(byte_bpe.merges_of_ranks(content), public_tokenizers.PATTERN)
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(content), special_tokens={})
    rng = random.Random(3)
    texts = [t or "" for t in ODD_TEXTS] + ["aaaa" * 400, "abcabcb" * 90]
    texts += ["".join(rng.choice("aab '\n\t.,1é sSt\x1c\x85") for _ in range(rng.randrange(30))) for _ in range(400)]
    for text, ids in zip(texts, codec.encode_texts(texts)):
        assert ids.tolist() == library.encode_ordinary(text)
        assert codec.decode(ids.tolist()) == text.encode()


def test_long_and_short_pretokens_agree():
    with open(RANKS, "rb") as file:
        merges = byte_bpe.merges_of_ranks(file.read())
    rng = random.Random(4)
    pieces = ["".join(rng.choice("abthein") for _ in range(rng.randrange(1, 150))).encode() for _ in range(60)]
    ids, of = byte_bpe.encode_short(pieces, merges)
    for k, piece in enumerate(pieces):
        assert ids[of == k].tolist() == byte_bpe.encode_long(piece, merges)


def test_rank_queue_yields_ranks_in_order():
    queue = byte_bpe.RankQueue(50_000)
    ranks = random.Random(5).sample(range(50_000), 300)
    for r in ranks:
        queue.bucket(r).append(r)
    seen = []
    while (r := queue.lowest()) >= 0:
        seen.append(r)
        queue.close(r)
    assert seen == sorted(ranks)


def test_encode_and_decode_tables(odd, no_docs):
    encoded = byte_bpe.encode(odd, RANKS, public_tokenizers.PATTERN)
    got = byte_bpe.decode(encoded, RANKS).collect()
    want = collections.Counter((r["doc_id"], (r["text"] or "").encode()) for r in odd.collect())
    assert collections.Counter((r["doc_id"], bytes(r["bytes"])) for r in got) == want
    digests = byte_bpe.round_trip_digests(odd, RANKS, public_tokenizers.PATTERN).collect()
    assert all(r["n_tokens"] == 0 for r in digests if r["doc_id"] in (0, 1))
    assert {r["decoded_sha256"] for r in digests if r["doc_id"] == 9} == {hashlib.sha256(ODD_TEXTS[9].encode()).hexdigest()}
    assert byte_bpe.encode(no_docs, RANKS, public_tokenizers.PATTERN).count() == 0


def test_sum_of_squares_by_brute_force():
    def plain(lengths, limit):
        bins, out = [], {}
        for at in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
            best = None
            for b, gap in enumerate(bins):
                if gap < lengths[at] or gap == 0:
                    continue
                after = bins[:b] + [gap - lengths[at]] + bins[b + 1:]
                cost = (sum(n * n for g, n in collections.Counter(after).items() if g), gap)
                best = min(best, (cost, b)) if best else (cost, b)
            if best:
                bins[best[1]] -= lengths[at]
                out[at] = best[0]
            else:
                bins.append(limit - lengths[at])
        return sorted(bins)

    rng = np.random.default_rng(6)
    for limit in (10, 37):
        lengths = rng.integers(1, limit + 1, 60)
        sequence, offset = packing.sum_of_squares(lengths, limit)
        used = np.bincount(sequence, lengths)
        assert sorted((limit - used).astype(int).tolist()) == plain(lengths.tolist(), limit)
        for s in np.unique(sequence):
            own = np.flatnonzero(sequence == s)
            own = own[np.argsort(offset[own])]
            assert offset[own].tolist() == np.append(0, np.cumsum(lengths[own])[:-1]).tolist()


def test_packed_documents(odd, no_docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(JSON)
    got = packing.pack_documents(odd, JSON).collect()
    by_doc = collections.defaultdict(list)
    for r in got:
        assert r["length"] == len(r["ids"]) // 4 <= 1024 and r["ids_crc32"] == zlib.crc32(bytes(r["ids"]))
        by_doc[r["doc_id"]].append(r)
    for k, text in enumerate(ODD_TEXTS):
        want = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        mine = sorted(by_doc[k if k != 5 else None], key=lambda r: r["piece"])[:max(1, -(-len(want) // 1024))]
        if k != 10:
            assert [i for r in mine for i in np.frombuffer(bytes(r["ids"]), "<u4").tolist()] == want
            assert [r["start"] for r in mine] == [s for s, _ in packing.cut(len(want), 1024)]
    assert len(by_doc[10]) == 2
    total = sum(r["length"] for r in got)
    assert len({r["sequence_id"] for r in got}) <= math.ceil(total / 1024) + 1
    assert packing.pack_documents(no_docs, JSON).count() == 0


# --- quality ----------------------------------------------------------------


def test_quality_rules_by_brute_force(odd, no_docs):
    got = quality_rules.judge(odd).collect()
    assert len(got) == odd.count() and got[0]["id"] is not None
    for r in got:
        text = next((t for k, t in enumerate(ODD_TEXTS) if k == r["id"]), None) or ""
        w = WORD.findall(text)
        windows = collections.defaultdict(list)
        for i in range(len(w) - 4):
            windows[tuple(w[i:i + 5])].append(i)
        repeated = {p for at in windows.values() if len(at) > 1 for i in at for p in range(i, i + 5)}
        lines = [s for s in text.split("\n") if WORD.search(s)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(w) < 10 or 100 * len(repeated) > 20 * len(w))
    assert quality_rules.judge(no_docs).count() == 0


def test_line_rules(spark):
    good = "This is a plain sentence of ten words, nothing else here."
    bad = ["Home | News | About | Contact | More |", "BUY NOW!! CHEAP!! CLICK!! TODAY!! HURRY!!", "a### b### c*** d%%%",
           "Menu", "All rights reserved.", "WE ARE SHOUTING AT ALL OF YOU."]
    lines = spark.createDataFrame([(s,) for s in [good, "", *bad]], "s string")
    got = [r[0] for r in lines.select(quality_rules.line_passes(F.col("s"))).collect()]
    assert got == [True, True] + [False] * len(bad)
    docs = spark.createDataFrame([
        (1, "\n".join([good, "Another line that says something quite different from before.", bad[0]]), 0), (2, "\n".join([good, *bad, *bad]), 0), (3, None, 0),
    ], "doc_id long, text string, n_chars long")
    kept = quality_rules.clean(docs).collect()
    assert [(r["doc_id"], r["n_chars"]) for r in kept] == [(1, len(kept[0]["text"]))] and "|" not in kept[0]["text"]


def test_quality_model(spark, odd, no_docs):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, len(quality_gam.FEATURES)))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # an interaction that no single feature shows
    model = quality_gam.fit(x[:1000], y[:1000])
    assert (0, 1) in model.pairs or (1, 0) in model.pairs
    assert ((model.score(x[1000:]) > 0.5) == y[1000:]).mean() > 0.9
    labels = spark.createDataFrame([(7, 1, 0), (8, 1, 0), (13, 0, 0), (12, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality_gam.score_documents(odd, labels, F.lit(True)).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    none = quality_gam.score_documents(odd, labels.where("false"), F.lit(True)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality_gam.score_documents(no_docs, labels, F.lit(True)).count() == 0
    assert quality_gam.keep_good(odd, labels, F.lit(True), 0.0).columns == odd.columns


def test_quality_held_out_accuracy(spark):
    got = queries.QUERIES["op3_quality_gam"](spark, "/root/testdata/sf0.01")
    met = got.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out")
    right, n = met.select(F.sum((F.col("predicted") == F.col("quality")).cast("int")), F.count("*")).first()
    assert right / n > 0.95


# --- language model ---------------------------------------------------------


def test_language_model(spark, odd, no_docs):
    train = F.col("doc_id").isNull() | (F.col("doc_id") % 3 != 0)
    got = brown_lm.score_documents(odd, train).collect()
    rows = [(r["doc_id"], WORD.findall((r["text"] or "").translate(LOW)) + [None]) for r in odd.collect()]
    c = collections.Counter(w for d, ws in rows if d is None or d % 3 for w in ws)
    n, v = sum(c.values()), len(c)
    want = collections.Counter(
        (d, len(ws), sum(c[w] > 0 for w in ws), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for d, ws in rows)
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["train_tokens"] == n and r["score"] < 0 for r in got)
    assert brown_lm.score_documents(no_docs, train).count() == 0
    untrained = brown_lm.score_documents(odd, F.lit(False)).collect()
    assert all(r["score"] == r["base_score"] == 0 for r in untrained)


def test_language_model_is_a_distribution(spark):
    docs = spark.createDataFrame([(k, prose(k % 2 * 50 + k // 4, 60)) for k in range(40)], "doc_id long, text string")
    blocks = brown_lm.to_blocks(docs, F.lit(True))
    counted = brown_lm.counted_words(blocks)
    model = brown_lm.fit(blocks, counted)
    word = [(r["hash"], r["c"]) for r in counted.where("first").collect()]
    own = model.classes[np.array([h % brown_lm.TYPES for h, _ in word])]
    emitted = np.array([c - brown_lm.DISCOUNT for _, c in word]) / model.sizes[own]
    for before in (0, 1, int(own[0])):
        step = 10 ** model.steps[before]
        # As many unseen words as seen ones share what is left.
        total = (step[own] * emitted).sum() + step[brown_lm.END] + len(word) * 10 ** model.unknown[before]
        assert abs(total - 1) < 1e-9


def test_classes_belong_to_words(spark):
    """Words whose hashes agree modulo 65,536 have classes by what is before them, not by each other."""
    names = ["w%d" % k for k in range(3000)]
    raw = np.frombuffer("".join(names).encode(), np.uint8)
    ends = np.cumsum([len(n) for n in names])
    of = words.hash_spans(raw, ends - [len(n) for n in names], ends) % np.uint64(1 << 16)
    by = collections.defaultdict(list)
    for name, h in zip(names, of.tolist()):
        by[h].append(name)
    pairs = [p[:2] for p in by.values() if len(p) > 1]
    assert len(pairs) >= 10
    texts = [" ".join(f"after{k % 2} {p[k % 2]}" for p in pairs for _ in range(5)) for k in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    blocks = brown_lm.to_blocks(docs, F.lit(True))
    model = brown_lm.fit(blocks, brown_lm.counted_words(blocks))

    def classes(side):
        own = [n[side].encode() for n in pairs]
        e = np.cumsum([len(n) for n in own])
        h = words.hash_spans(np.frombuffer(b"".join(own), np.uint8), e - [len(n) for n in own], e)
        return model.classes[np.array([int(x) % brown_lm.TYPES for x in h.view(np.int64)])]

    assert not set(classes(0).tolist()) & set(classes(1).tolist())


# --- near duplicates --------------------------------------------------------


def grams(text):
    w = WORD.findall((text or "").translate(LOW))
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])


def groups_of(sets, linked):
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if linked(sets[a], sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def near_copies():
    rng = random.Random(9)
    texts = []
    for base in range(12):
        w = prose(100 + base, rng.randint(6, 200)).split()
        for _ in range(8):
            v = list(w)
            for _ in range(rng.randint(0, max(1, len(v) // 25))):
                v[rng.randrange(len(v))] = "edit%d" % rng.randrange(99)
            texts.append(" ".join(v))
    common = prose(77, 30)
    texts += [common + " " + prose(500 + k, 18) for k in range(70)]  # alike, but not enough
    return texts


def test_near_dedup_by_brute_force(spark):
    texts = near_copies()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in near_dedup.deduplicate(docs).collect()}
    sets = {k: grams(t) for k, t in enumerate(texts)}
    want = groups_of(sets, lambda a, b: a and b and 100 * len(a & b) >= 75 * len(a | b))
    assert {k: r["component_id"] for k, r in got.items()} == want
    assert all(r["kept"] == (want[k] == k) and r["n_shingles"] == len(sets[k]) for k, r in got.items())
    assert {r["doc_id"] for r in near_dedup.keep_first(docs).collect()} == {k for k, c in want.items() if c == k}


def test_rare_shingles_lose_no_pair(spark):
    texts = near_copies()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    left = docs.select(F.lit(1).cast("long").alias("bucket"), F.col("doc_id").alias("id"))
    candidates = near_dedup.full_sets(docs)
    fine = collections.defaultdict(set)
    for r in near_dedup._by_rare_shingles(left, candidates, 75).collect():
        fine[r["bucket"]].add(r["id"])
    together = {(a, b) for ids in fine.values() for a in ids for b in ids}
    sets = {k: grams(t) for k, t in enumerate(texts)}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                assert (a, b) in together


def test_near_misses_take_few_rounds(spark, monkeypatch):
    rng = random.Random(12)
    base = prose(41, 120).split()
    texts = []
    for k in range(90):  # about as alike as the threshold asks for, some more and some less
        v = list(base)
        for i in rng.sample(range(len(v)), 3 + k % 3):
            v[i] = "edit%d" % rng.randrange(10**6)
        texts.append(" ".join(v))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rounds, merge = [], graph.components
    monkeypatch.setattr(near_dedup.graph, "components", lambda *a: rounds.append(1) or merge(*a))
    monkeypatch.setattr(near_dedup, "WHOLE", 50)
    monkeypatch.setattr(near_dedup, "PIVOTS", 1)
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.deduplicate(docs).collect()}
    sets = {k: grams(t) for k, t in enumerate(texts)}
    assert got == groups_of(sets, lambda a, b: 100 * len(a & b) >= 75 * len(a | b))
    assert len(rounds) <= 3


def test_intersections_of_blocks(monkeypatch):
    rng = np.random.default_rng(4)
    one, two = ([np.unique(rng.integers(0, 300, rng.integers(1, 90)).astype("<u8")) for _ in range(n)] for n in (7, 5))
    monkeypatch.setattr(near_dedup, "COLUMNS", 16)
    want = [[len(np.intersect1d(a, b)) for b in two] for a in one]
    assert near_dedup.intersections(one, two).tolist() == want
    assert near_dedup.intersections(one[:1], [np.array([10**9], "<u8")]).tolist() == [[0]]


def test_near_dedup_on_odd_rows(odd, no_docs):
    got = near_dedup.deduplicate(odd).collect()
    assert len(got) == odd.count()
    by = collections.defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert all(r["n_shingles"] == 0 and r["component_id"] == k and r["kept"] for k in (0, 1, 2) for r in by[k])
    assert by[None][0]["component_id"] is None and by[None][0]["kept"]
    assert by[11][0]["component_id"] == 10 and len(by[10]) == 2
    assert near_dedup.deduplicate(no_docs).count() == 0
    assert near_dedup.keep_first(odd).columns == odd.columns


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(10)
    pool = rng.integers(0, 2**63, 4000).astype(np.uint64)
    for common in (0, 1500, 3000):
        a, b = pool[:3000 + (1000 - 1000)], pool[3000 - common:6000 - common][:3000]
        a, b = np.sort(a), np.sort(np.unique(np.append(b, rng.integers(0, 2**63, 3000 - min(3000, len(b))).astype(np.uint64))))
        r = near_dedup.registers_of(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(near_dedup.estimate(r[0], r[1]) - true) < 0.16


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(20)] + [(100, k) for k in range(101, 110)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{k: 0 for k in range(21)}, **{k: 100 for k in range(100, 110)}}
    assert graph.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_embeddings_by_brute_force(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(150, 20))
    x[50:90] = x[:40] + rng.normal(size=(40, 20)) * 0.3
    x[90:120] = x[7]
    rows = [(k, v.tolist(), 0) for k, v in enumerate(x)]
    rows += [(200, None, 0), (201, [0.0] * 20, 0), (202, [float("nan")] * 20, 0), (203, [1.0, None] * 10, 0),
             (204, [float("inf")] * 20, 0), (None, x[3].tolist(), 0), (205, [1.0, 2.0], 0), (206, [2.0, 4.0], 0), (207, [], 0)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id int")
    got = {r["vec_id"]: r for r in embedding_dedup.deduplicate(vectors, tile=32).collect()}
    sets = {k: v for k, v in enumerate(x)}
    cos = lambda a, b: a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.95
    want = groups_of(sets, cos)
    for k in sets:
        assert got[k]["component_id"] == want[k] and got[k]["kept"] == (want[k] == k)
        assert got[k]["n_links"] == sum(cos(x[k], x[j]) for j in sets if j != k)
    assert all(got[k]["n_links"] == 0 and got[k]["kept"] for k in (200, 201, 202, 203, 204, 207))
    assert got[206]["component_id"] == 205 and got[None]["n_links"] == 0
    assert embedding_dedup.deduplicate(vectors.where("false")).count() == 0


def test_compact_windows_cover_every_subsequence():
    rng = np.random.default_rng(12)
    values = rng.integers(0, 2**63, 90).astype(np.uint64)
    values[40:60] = values[40]  # ties
    at, lo, hi = substring_dedup.compact_windows(values, np.array([0, 50, 50, 90]), 8)
    for s, e in ((0, 50), (50, 90)):
        for i in range(s, e - 7):
            for j in range(i + 7, e):
                inside = (lo <= i) & (i <= at) & (at <= j) & (j <= hi)
                assert inside.sum() == 1
                assert values[at[inside]][0] >> np.uint64(28) == values[i:j + 1].min() >> np.uint64(28)


def test_planted_passages(spark, odd, no_docs):
    rng = random.Random(13)
    passage, line = prose(900, 70), prose(901, 12)
    texts = []
    for k in range(60):
        body = [prose(1000 + k, 60)]
        if k % 3:
            body.append(line)  # a common short line is no passage
        if k in (4, 20, 33):
            w = passage.split()
            if k == 33:
                w[35] = "changed"
            body.append(" ".join(w))
        body.append(prose(2000 + k, 40))
        rng.shuffle(body)
        texts.append("\n".join(body))
    docs = spark.createDataFrame([(k, t, len(t)) for k, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    spans = substring_dedup.duplicate_passages(docs)
    got = spans.collect()
    assert {r["doc_id"] for r in got} == {20, 33} and {r["other_doc_id"] for r in got} == {4}
    left = {r["doc_id"]: r for r in substring_dedup.remove_passages(docs, spans).collect()}
    assert len(left) == 60 and all(left[k]["text"] == texts[k] for k in range(60) if k not in (20, 33))
    assert passage in left[4]["text"] and passage[100:200] not in left[20]["text"]
    assert left[20]["n_chars"] == len(left[20]["text"])
    on_odd = substring_dedup.duplicate_passages(odd).collect()
    assert {(r["doc_id"], r["other_doc_id"]) for r in on_odd} == {(11, 10)}
    after = substring_dedup.remove_passages(odd, substring_dedup.duplicate_passages(odd))
    assert after.columns == odd.columns and after.count() == odd.count() - 1
    assert substring_dedup.duplicate_passages(no_docs).count() == 0


# --- pages ------------------------------------------------------------------


def test_passage_whose_shingles_lie_apart_in_earlier_documents(spark):
    words_of = prose(910, 55).split()
    texts = []
    for k in range(12):  # every shingle of the passage, amid words of its own
        texts.append(" ".join(prose(3000 + 100 * k + i, 40) + " " + " ".join(words_of[i:i + 5]) for i in range(51)) + " " + prose(4999 + k, 40))
    texts += [prose(5000 + k, 60) + " " + " ".join(words_of) + " " + prose(6000 + k, 60) for k in range(3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = substring_dedup.duplicate_passages(docs).collect()
    assert {(r["doc_id"], r["other_doc_id"]) for r in got} == {(13, 12), (14, 12)}
    assert all(r["start"] <= 60 and r["end"] >= 115 for r in got)


def test_windows_of_all_functions_find_changed_passages(spark):
    rng = random.Random(14)
    a, b, n = [], [], 150
    for k in range(n):  # one word of 52 changed: shingles are more than 75 % alike
        w = prose(7000 + k, 52).split()
        v = list(w)
        v[rng.randrange(8, 44)] = "changed%d" % k
        a.append((k, " ".join(w)))
        b.append((n + k, " ".join(v)))
    docs = spark.createDataFrame(a + b, "doc_id long, text string")
    keys = [substring_dedup._parted(substring_dedup.windows(docs, k)) for k in range(substring_dedup.FUNCTIONS)]
    assert len(keys) >= 4
    missed = [1.0]
    for made in keys:
        met = {r["doc"] for r in substring_dedup._met(made, 46).where("doc = other + %d" % n).select("doc", "other").collect()}
        missed.append(missed[-1] * (1 - len(met) / n))
    assert missed[-1] < 0.01


def test_outermost_spans_stream_by_document(spark):
    rng = random.Random(3)
    rows = set()
    for _ in range(1500):
        doc, s = rng.randrange(1, 60), rng.randrange(300)
        rows.add((doc, s, s + rng.randrange(50, 120), rng.randrange(doc), 0, 60, 1.0))
    got = substring_dedup._outermost(spark.createDataFrame(sorted(rows), substring_dedup.SPANS))
    want = {r for r in rows if not any(
        q[0] == r[0] and q[3] < r[3] and q[1] <= r[1] and q[2] >= r[2] for q in rows)}
    assert {tuple(r) for r in got.collect()} == want
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().toString()


def test_url_filter_by_brute_force(spark):
    urls = [None, "", "no scheme", "http://Blog.Example.COM/en/1?x=1", "https://www.example.com/en/a#b", "http://x.net/es/1",
            "http://x.net/fr", "http://net/fr/", "http://example.com", "http://a.b.com/", "ftp://É.Org?q://z", "http://notcom/x"]
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)], "page_id long, url string, host string")
    labelled = url_filter.labelled_urls(spark)
    got = {r["page_id"]: r for r in url_filter.filter_urls(pages, labelled).collect()}
    intercept, weights = url_filter.train(labelled)
    for k, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = host.translate(LOW)
        fit = [(h + p, s) for s, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fit, key=lambda f: len(f[0])) if fit else (None, None)
        marked = ("^" + host + "$", "^/" + path)
        g = [zlib.crc32(t[i:i + n].encode()) % url_filter.BUCKETS for t in marked for n in url_filter.SIZES for i in range(len(t) - n + 1)]
        p = 1 / (1 + math.exp(-intercept - sum(weights[j] for j in g) / max(1, len(g))))
        assert (got[k]["host"], got[k]["path"], got[k]["rule"]) == (host, path, rule[0])
        assert abs(got[k]["score"] - p) < 1e-9
        assert got[k]["verdict"] == (rule[1] or ("block" if p >= 0.5 else "allow"))
    scored = url_filter.filter_urls(labelled, labelled, rules=())
    assert scored.where((F.col("verdict") == "block") == (F.col("label") == 1)).count() == len(url_filter.LABELLED)
    assert url_filter.filter_urls(pages.where("false"), labelled).count() == 0


def test_blocks_of_odd_html():
    def texts(page):
        return [b.text for b in html_extract.blocks_of(page)]

    assert texts("") == [] and texts("plain &amp; simple &eacute;") == ["plain & simple é"]
    assert texts("<p>a<p>b<b>c<br>d<p>e") == ["a", "bc d", "e"]
    assert texts("<script>var t='<p>no</p>'</script><!-- no --><style>no") == []
    assert texts("<ul><li>a<li>b</ul>c<table><tr><td>d<td>e</table>") == ["a", "b", "c", "d", "e"]
    assert texts("</p></div>x<div title='a>b'>y</div") == ["x", "y</div"]


def test_extraction(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    odd = spark.createDataFrame([(None, None, None), (-1, "u", ""), (-2, "u", "<p>")], pages.schema)
    got = html_extract.extract(pages.union(odd).withColumn("text", F.lit(1))).collect()
    by = {r["page_id"]: r for r in got}
    assert by[None]["text"] == by[-1]["text"] == by[-2]["text"] == "" and by[-1]["n_chars"] == 0
    for r in pages.collect():
        blocks = html_extract.blocks_of(r["html"])
        want = "\n\n".join(b.text for b, y in zip(blocks, html_extract.landmark_labels(blocks)) if y)
        assert by[r["page_id"]]["text"] == want and by[r["page_id"]]["n_chars"] == len(want)
    assert html_extract.extract(pages.where("false")).count() == 0


def test_labeller_on_unseen_layouts():
    rng = random.Random(11)
    made = [html_extract.made_up_page(rng) for _ in range(html_extract.MADE_UP_PAGES + 60)]
    rows = []
    for page, main in made:
        blocks = html_extract.blocks_of(page)
        rows.append((html_extract.vectors([blocks]), np.array([b.text in main for b in blocks], np.float32)))
    model = html_extract.train(rows[:-60])
    right = total = 0
    for x, y in rows[-60:]:
        right += ((model.logits(x[None], np.ones((1, len(x)), bool))[0] >= 0) == (y > 0)).sum()
        total += len(y)
    assert right / total > 0.97


# --- queries and pipeline ---------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SMALL)
    cols = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)
    assert got == sorted(con.sql(f"SELECT {','.join(cols)} FROM ({queries.SQL[name]})").fetchall(), key=repr)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    good = "\n".join(prose(3000, 40).capitalize() + "." for _ in range(1))
    rows = [(k, "\n".join(prose(k * 10 + j, 30).capitalize() + "." for j in range(4)), "en", "s", 0) for k in range(40)]
    rows += [(40, rows[3][1], "en", "s", 0), (41, "x | y | z | " * 40, "en", "s", 0), (42, None, None, None, None)]
    rows += [(43, rows[5][1].split("\n")[0] + "\n" + rows[5][1].split("\n")[1] + "\n" + good, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k != 41), 0) for k in range(44)], "doc_id long, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet")
    kept = docs
    for (name, stage), want in zip(corpus_pipeline.STAGES[:4], ([41, 42], [], [40], [])):
        before = {r["doc_id"] for r in kept.collect()}
        kept = stage(spark, kept, str(tmp_path)).persist()
        assert kept.columns == docs.columns
        assert before - {r["doc_id"] for r in kept.collect()} == set(want), name
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert texts[43] == good and texts[5] == rows[5][1]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == set(texts)
    assert sum(r["length"] for r in out) == sum(len(r["ids"]) // 4 for r in out)


def thue_morse(n):
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_regular_patterns_do_not_collide(spark):
    one, two = thue_morse(4096)
    raw = np.frombuffer((one + two).encode(), np.uint8)
    h = words.hash_spans(raw, np.array([0, 4096]), np.array([4096, 8192]))
    assert h[0] != h[1]
    docs = spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r["decoded_sha256"] for r in byte_bpe.round_trip_digests(docs, RANKS, public_tokenizers.PATTERN).collect()}
    assert got == {k: hashlib.sha256(t.encode()).hexdigest() for k, t in ((1, one), (2, two))}
    crcs = {r["doc_id"]: r["ids_crc32"] for r in packing.pack_documents(docs, JSON, limit=8192).collect()}
    assert crcs[1] != crcs[2]
    assert near_dedup.deduplicate(docs).where("kept").count() == 2


def test_unknown_words_score_below_prose(spark):
    rng = random.Random(5)
    junk = [" ".join("".join(rng.choices("qxzjkv", k=7)) for _ in range(60)) for _ in range(5)]
    rows = [(k, prose(k // 2, 60)) for k in range(60)] + [(100 + k, t) for k, t in enumerate(junk)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scores = {r["doc_id"]: r["score"] / r["n_tokens"] for r in brown_lm.score_documents(docs, F.col("doc_id") < 100).collect()}
    assert max(v for k, v in scores.items() if k >= 100) < min(v for k, v in scores.items() if k < 100)


def test_pages_without_a_head_end_and_broken_attributes():
    def texts(page):
        return [b.text for b in html_extract.blocks_of(page)]

    assert texts("<html><head><title>t</title><article><p>One two.</p></article>") == ["One two."]
    assert texts("<html><head><meta charset=x><p>One</p></html>") == ["One"]
    assert texts("<body><p data-x=it's>Text</p><p title=\"a'b\">more</p>") == ["Text", "more"]
    assert texts("<p \"open>Text</p>") == ["Text"]
    assert texts("<article><p>a <math><mi>x</mi></math></p><object>b</object><noscript>c</noscript></article>") == ["a x", "b", "c"] or \
        " ".join(texts("<article><p>a <math><mi>x</mi></math></p><object>b</object><noscript>c</noscript></article>")).split() == ["a", "x", "b", "c"]
