"""Corpus operators against brute-force versions on a small table with nulls, ties, copies and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corvida.llm import exact_dedup, fingerprints, lm, minhash, packing, passages, sentencepiece_scan, sharding, suffix_dedup, toxicity
from corvida.llm.catalog import tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, uid long, maybe boolean, sha string, key long"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def words(t):
    return WORD.findall(lower(t or ""))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = text(90)
    out = [text(rng.randint(1, 300)) for _ in range(40)]
    base = text(200)
    out += [base] * 30 + [base.replace(" ", "\n", 3), base.upper()]
    for _ in range(20):  # near copies
        w = base.split()
        for _ in range(3):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        out.append(" ".join(w))
    out += [f"{text(30)} {passage} {text(40)}" for _ in range(12)]
    out += [None, "", " ", "\t\n", "a", "ab ab ab ab ab", "x" * 5000, "hello world " * 900, "ß▁ é́ 日本語 🙂", text(6000)]
    data = [(i, t, "en", "s", len(t or ""), "r", 1, True, "s", 2) for i, t in enumerate(out)]
    data += [data[3], data[3], data[41]]  # repeated rows
    return data


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, empty, rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append(r[0])
    for bits in (1 << 30, 1 << 16):
        got = exact_dedup.duplicate_groups(docs, max_bits=bits).collect()
        assert len(got) == len(rows)
        want = Counter((r[0], min(groups[norm(r[1])]), len(groups[norm(r[1])]), r[0] == min(groups[norm(r[1])]), hashlib.sha256(norm(r[1]).encode()).hexdigest()) for r in rows)
        assert Counter(tuple(r) for r in got) == want
    left = exact_dedup.drop_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(min(g) for g in groups.values())
    assert exact_dedup.duplicate_groups(empty).count() == exact_dedup.drop_duplicates(empty).count() == 0


def test_exact_dedup_null_ids(spark):
    d = spark.createDataFrame([(None, "x y"), (None, "x  y"), (4, "x\ty"), (None, "z"), (None, None)], "doc_id long, text string")
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.duplicate_groups(d).collect()}
    assert got == {(None, 4, 3, False), (4, 4, 3, True), (None, None, 1, True)}
    assert exact_dedup.drop_duplicates(d).count() == 3


def test_packing(docs, empty, rows):
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    got = packing.pack(docs, path, capacity=256, with_ids=True).collect()
    want = Counter()
    for r in rows:
        ids = [*t.encode(r[1] or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 256):
            want[(r[0], k // 256, k, tuple(ids[k : k + 256]))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], tuple(r["ids"])) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        assert r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 256
    assert len(bins) <= 1.03 * sum(r["length"] for r in got) / 256
    assert packing.pack(empty, path).count() == 0


def test_two_fit_beats_greedy():
    plan = packing.plan_bins({6: 1, 5: 1, 4: 1, 3: 1, 2: 1}, 10)
    assert sum(n for _, n in plan) == 2
    done = Counter()
    for b, n in packing.plan_bins({7: 1000, 5: 333, 3: 12345, 2: 7, 1: 1}, 16):
        assert sum(length * k for length, k in b.items()) <= 16
        done.update({length: k * n for length, k in b.items()})
    assert done == {7: 1000, 5: 333, 3: 12345, 2: 7, 1: 1}


def test_sharding(docs, empty, rows):
    got = sharding.shard(docs, shards=6).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    load, slots, tokens = Counter(), defaultdict(list), Counter()
    for r in got:
        load[r["shard"]] += r["size"]
        tokens[r["shard"]] += r["tokens"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    rest = sorted(load.values())[:-1]  # one text is larger than a shard's share
    assert max(rest) - min(rest) <= 0.02 * sum(rest) / 5
    assert sharding.shard(empty).count() == 0


def test_equal_texts_share_a_shard(spark):
    rng = np.random.default_rng(5)
    words = ["ab", "cde", "fghi", "j"]
    texts = [" ".join(rng.choice(words, rng.integers(5, 60))) + f" {i}" for i in range(900)]
    rows = [(i, texts[i]) for i in range(900)] + [(1000 + i, texts[i % 60]) for i in range(300)] + [(2000 + i, texts[77]) for i in range(25)] + [(3000 + i, None if i % 2 else "") for i in range(700)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=12).toPandas()
    homes = got[got["size"] > 8].groupby("text_crc32")["shard"].nunique()
    assert (homes == 1).all()
    assert got[got["size"] == 8]["shard"].nunique() > 1  # more rows than a shard's share, so this group alone is split
    load = got.groupby("shard")[["size", "tokens"]].sum()
    assert len(load) == 12 and np.ptp(load["size"]) <= 0.01 * load["size"].mean()


def test_groups_without_room_by_hand():
    capacity = np.array([100.0, 100.0, 10.0])
    groups = np.array([[60, 1, 1], [60, 1, 1], [60, 1, 1], [30, 1, 11], [250, 1, 1]], float)
    assert sharding.without_room(groups[:3], capacity, 2, 0.05).tolist() == [False, False, True]
    assert sharding.without_room(groups[3:], capacity, 5, 0.05).tolist() == [True, True]


def test_bundles_balance_all_dimensions():
    rng = np.random.default_rng(1)
    v = rng.lognormal(8, 1, (2000, 3)).round()
    s = sharding.place_bundles(v.copy(), 24)
    load = np.stack([np.bincount(s, weights=v[:, k], minlength=24) for k in range(3)], axis=1)
    assert np.ptp(load[:, 0]) <= 2
    assert (load.max(axis=0) / load.mean(axis=0) < 1.15).all()


def test_suffix_dedup(docs, empty, rows):
    for window in (400, 300):
        count, texts = Counter(), [(r[0], (r[1] or "").encode()) for r in rows]
        for _, t in texts:
            count.update(t[i : i + window] for i in range(len(t) - window + 1))
        want = Counter()
        for key, t in texts:
            gone = np.zeros(len(t), bool)
            for i in range(len(t) - window + 1):
                if count[t[i : i + window]] > 1:
                    gone[i : i + window] = True
            spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
            want[(key, len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest())] += 1
        got = suffix_dedup.repeated_bytes(docs, window).drop("spans").collect()
        assert Counter(tuple(r) for r in got) == want
    left = suffix_dedup.drop_repeats(docs)
    assert left.columns == docs.columns and left.count() == len(rows)
    assert all(len(r["text"] or "") == r["n_chars"] for r in left.collect())
    assert suffix_dedup.repeated_bytes(empty).count() == suffix_dedup.drop_repeats(empty).count() == 0


def test_near_dedup(docs, empty, rows):
    sets = {}
    for r in rows:
        w = words(r[1])
        sets[r[0]] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    got = minhash.near_groups(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), root(r["doc_id"]), root(r["doc_id"]) == r["doc_id"])
    left = minhash.drop_near_copies(docs)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {i for i in sets if root(i) == i}
    assert minhash.near_groups(empty).count() == minhash.drop_near_copies(empty).count() == 0


def test_sketch_coordinates_are_full_and_unbiased():
    rng = np.random.default_rng(3)
    pool = rng.integers(1, 1 << 63, 900, dtype=np.uint64)
    a, b = np.sort(pool[:600]), np.sort(pool[300:])
    s = minhash.sketches(np.concatenate((a, b, pool[:1])), np.array([0, 600, 1200, 1201]), 512)
    assert (s != np.iinfo(np.uint64).max).all()
    assert abs((s[0] == s[1]).mean() - 1 / 3) < 0.08


def test_pipeline_near_stage_at_80_percent(spark):
    """The later document of a pair at 0.82 leaves, that of a pair at 0.79 stays."""
    rng = random.Random(15)
    data = []
    for k in range(30):
        w = [f"w{rng.randrange(10**6)}" for _ in range(104)]
        kept = 94 if k < 20 else 92  # 90 or 88 common shingles of 100
        data += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(w[:kept] + [f"e{k}.{i}" for i in range(104 - kept)]))]
    left = corpus_pipeline.near_stage(spark, spark.createDataFrame(data, "doc_id long, text string"), "")
    assert sorted(r["doc_id"] for r in left.collect()) == sorted([*range(0, 40, 2), *range(40, 60)])


def test_fingerprints(docs, empty, spark, rows):
    uniq = {r[0]: r[1] for r in rows}
    d = spark.createDataFrame(sorted(uniq.items()), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_edits(d).collect()}
    ids = sorted(uniq)
    by_text = {}
    for k, i in enumerate(ids):
        t, nx = uniq[i] or "", uniq[ids[(k + 1) % len(ids)]] or ""
        edited = t[: len(t) - len(t) // 2] + nx[: len(t) // 2]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert by_text.setdefault(t, r["fingerprint"]) == r["fingerprint"] and 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if edited == t:
            assert r["near_edited"] == 1.0
    assert got[45]["near_next"] == 1.0
    plan = fingerprints.fingerprint_edits(d)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    assert fingerprints.fingerprint_edits(empty).count() == 0 and fingerprints.fingerprint_edits(docs).count() == len(rows)


def test_sketch_algebra(spark):
    d = spark.createDataFrame([(" ".join(map(str, range(4000))), " ".join(map(str, range(1000, 2000))))], "a string, b string")
    a, b = fingerprints.sketch(F.col("a")), fingerprints.sketch(F.col("b"))
    r = d.select(fingerprints.containment(b, a).alias("inside"), fingerprints.likeness(a, b).alias("like"), fingerprints.likeness(fingerprints.merged(a, b), a).alias("merged")).first()
    assert r["inside"] == 1.0 and abs(r["like"] - 0.25) < 0.06 and r["merged"] == 1.0


def test_lm(docs, empty, rows):
    tok = {r[0]: [*words(r[1]), "\0end"] for r in rows}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tok}
    count = Counter()
    for r in rows:
        if not held[r[0]]:
            count.update(tok[r[0]])
    n, v = sum(count.values()), len(count)
    pairs = Counter()
    for r in rows:
        if not held[r[0]]:
            pairs.update(zip([None, *tok[r[0]]], tok[r[0]]))
    trust = 1 - sum(c == 1 for c in pairs.values()) / n

    def model(t):
        total = 0.0
        for a, w in zip([None, *t], t):
            own = trust if a is not None and count[a] >= 2 else 0.0
            seen = 2 ** int(math.log2(pairs[a, w])) / count[a] if own and pairs[a, w] else 0.0
            total += math.log10(own * min(seen, 1) + (1 - own) * max(count[w], 0.5) / (n + 0.5 * (v + 1)))
        return total

    scores = []
    for table, segment in ((1 << 19, 1024), (20, 1024)):
        got = lm.score_documents(docs, table_words=table, segment_blocks=segment).collect()
        assert len(got) == len(rows)
        for r in got:
            t = tok[r["doc_id"]]
            base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(t), sum(count[w] > 0 for w in t), n)
            assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["score"] < 0
            if table > 20:  # all word counts exact, and a nearly empty filter without false hits
                assert math.isclose(r["score"], model(t), rel_tol=1e-9)
        scores.append(sum(r["score"] - r["base_score"] for r in got if not r["held_out"]))
    assert scores[0] > 0
    assert lm.score_documents(empty).count() == 0


def test_bloom_levels(spark):
    keys = np.random.default_rng(2).integers(1, 1 << 63, 40_000, dtype=np.uint64)
    level = np.arange(40_000) % 7 + 1
    rows = [(int(k), int(v)) for k, v in zip(lm.as_long(keys), level)]
    parts, blocks = lm.build_filter(spark.createDataFrame(rows, "key long, level long"), int(level.sum()))
    bits = np.zeros(blocks * lm.BLOCK_BITS // 8, np.uint8)
    for r in parts.collect():
        at = r["block"] * lm.BLOCK_BITS // 8
        bits[at : at + lm.BLOCK_BITS // 8] = np.frombuffer(r["bits"], np.uint8)
    got = lm.levels(keys, bits, 0, blocks)
    assert (got >= level).all() and (got == level).mean() > 0.97
    halves = np.maximum(*[lm.levels(keys, bits[s : s + lm.BLOCK_BITS // 8], k, blocks) for k, s in ((0, 0), (1, lm.BLOCK_BITS // 8))]) if blocks == 2 else got
    assert (halves == got).all()
    assert (lm.levels(keys + lm.U64(12345), bits, 0, blocks) > 0).mean() < 0.05


def test_toxicity(spark, empty):
    rng = random.Random(9)
    fine = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) for _ in range(200)]
    data, labels = [], []
    for i in range(600):
        w = [rng.choice(fine) for _ in range(rng.randint(5, 60))]
        bad = i % 6 == 0
        if bad:
            for _ in range(2):
                w[rng.randrange(len(w))] = rng.choice(["vilest", "vilestly", "rotzord", "rotzorn"])
        data.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    data += [(1000, None), (1001, ""), (None, "vilest vilest"), (1002, "Vilest. rotzord!")]
    labels += [(None, 1), (5000, 1), (7, None)]
    d, lab = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.document_scores(d, lab).collect()}
    assert len(got) == len(data)
    right = sum(got[i]["predicted"] == t for i, t in labels[:600] if got[i]["held_out"])
    assert right / sum(got[i]["held_out"] for i in range(600)) > 0.97
    assert got[1000]["score"] == got[1001]["score"] < 0.3 < got[1002]["score"]
    text = "Vilest. rotzord!"
    assert [text[s["start"] : s["end"]] for s in got[1002]["spans"]] in (["Vilest. rotzord"], ["Vilest", "rotzord"])
    assert toxicity.drop_toxic(d, lab).columns == d.columns
    assert toxicity.document_scores(d, lab.where("toxic = 0")).where("score <> 0").count() == 0
    assert toxicity.document_scores(empty, lab).count() == 0


def test_forward_backward_by_enumeration():
    rng = np.random.default_rng(4)
    e, t01, t10, t11 = rng.normal(size=9), -0.7, 0.2, 1.1
    first = np.array([0, 4, 4, 9])
    m, _, _ = toxicity.forward_backward(e, first, t01, t10, t11)
    step = {(0, 0): 0.0, (0, 1): t01, (1, 0): t10, (1, 1): t11}
    for a, b in ((0, 4), (4, 9)):
        weight = np.zeros(b - a)
        total = 0.0
        for code in range(1 << (b - a)):
            y = [code >> k & 1 for k in range(b - a)]
            w = math.exp(sum(e[a + k] * y[k] + step[(y[k - 1] if k else 0, y[k])] for k in range(b - a)))
            total += w
            weight += w * np.array(y)
        assert np.allclose(m[a:b], weight / total)


def test_fuzzy_passages(docs, empty, rows):
    got = passages.fuzzy_passages(docs).collect()
    cover = defaultdict(set)
    for r in got:
        cover[r["doc_id"]].update(range(r["start"], r["end"]))
        cover[r["other_id"]].update(range(r["other_start"], r["other_end"]))
        assert r["other_id"] < r["doc_id"] and r["identity"] >= 0.8
    seen = {}
    for i, t in sorted({r[0]: words(r[1]) for r in rows}.items()):
        for k in range(len(t) - 49):
            g = tuple(t[k : k + 50])
            if seen.setdefault(g, i) != i:
                assert len(cover[i] & set(range(k, k + 50))) >= 40
    assert passages.fuzzy_passages(empty).count() == 0


def test_chains_and_alignment():
    at, other = [0, 10, 20, 200, 12], [5, 14, 25, 3, 900]
    assert passages.chains(at, other)[0] == (0, 28, 5, 33)
    rng = random.Random(1)
    for _ in range(50):
        a, b = ([rng.randrange(5) for _ in range(rng.randint(0, 30))] for _ in range(2))
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
        assert passages.common_words(a, b) == d[-1][-1]


def test_fuzzy_passages_keep_every_shared_part(spark):
    """Two documents share a header and a footer around bodies of their own: both parts are reported."""
    rng = random.Random(11)
    text = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    shapes, data = [(60, 50), (60, 100), (100, 200), (200, 400)], []
    for k, (part, gap) in enumerate(shapes):
        head, foot = text(part), text(part)
        data += [(2 * k, f"{head} {text(gap)} {foot}"), (2 * k + 1, f"{head} {text(gap)} {foot}")]
    got = passages.fuzzy_passages(spark.createDataFrame(data, "doc_id long, text string")).collect()
    for k, (part, gap) in enumerate(shapes):
        for begin in (0, part + gap):
            assert any(r["doc_id"] == 2 * k + 1 and r["other_id"] == 2 * k and abs(r["start"] - begin) <= 1 and abs(r["end"] - begin - part) <= 1 for r in got), (part, gap, begin)


def test_fuzzy_passages_with_edits(spark):
    """Passages of 60 words with one edit in ten words, and of 40 to 100 with random edits, are found at 85 percent and more."""
    rng = random.Random(12)
    text = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    data, span = [], {}
    for k in range(60):
        w = text((40, 60, 100)[k % 3])
        e = [f"e{k}.{i}" if (i % 10 == 5 if k < 20 else rng.random() < 0.08) else v for i, v in enumerate(w)]
        if sum(x == y for x, y in zip(w, e)) >= 0.85 * len(w):
            span[2 * k + 1] = (50, 50 + len(w))
            data += [(2 * k, " ".join(text(100) + w + text(100))), (2 * k + 1, " ".join(text(50) + e + text(70)))]
    got = passages.fuzzy_passages(spark.createDataFrame(data, "doc_id long, text string")).collect()
    found = {r["doc_id"] for r in got if r["other_id"] == r["doc_id"] - 1 and min(r["end"], span[r["doc_id"]][1]) - max(r["start"], 50) >= 0.8 * (span[r["doc_id"]][1] - 50)}
    assert len(span) > 50 and len(found) >= 0.95 * len(span)


def test_fuzzy_passages_compare_more_than_the_first(spark):
    """Edited copies of one passage, a passage whose parts stand in earlier documents, and one that repeats in its document."""
    rng = random.Random(13)
    text = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    w = text(60)
    data = [(i, " ".join(text(40) + [f"e{i}.{k}" if rng.random() < 0.08 else v for k, v in enumerate(w)] + text(40))) for i in range(30)]
    p, q = text(50), text(60)
    data += [(40, " ".join(text(20) + p[:30] + text(20))), (41, " ".join(text(20) + p[21:] + text(20)))]
    data += [(42, " ".join(text(20) + p + text(20))), (43, " ".join(text(35) + p + text(20)))]
    data += [(50, " ".join(text(20) + q + text(90) + q + text(20)))]
    got = passages.fuzzy_passages(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert len({r["doc_id"] for r in got if r["doc_id"] < 30 and r["end"] - r["start"] >= 50}) >= 27
    assert any((r["doc_id"], r["other_id"], r["start"], r["end"]) == (43, 42, 35, 85) for r in got)
    assert [(r["other_start"], r["other_end"], r["start"], r["end"]) for r in got if r["doc_id"] == r["other_id"]] == [(20, 80, 170, 230)]


def test_words_share_their_parts():
    """A word that differs from known ones in case and marks only is not encoded anew; ids are those of the whole text."""
    cache = packing.WordCache(tokenizer("word_bpe_49k.json"))
    t = "House, house. ÉTÉ? ab's don't 12. é\u0301a. x<|endoftext|>, ẞ. ΣΑΣ; a.,b"
    assert np.frombuffer(cache.ids(t), "<u4").tolist() == cache.tokenizer.encode(t, add_special_tokens=False).ids
    want, cache.tokenizer = cache.tokenizer.encode("HOUSE. hOUSE, Été? été.", add_special_tokens=False).ids, None
    assert np.frombuffer(cache.ids("HOUSE. hOUSE, Été? été."), "<u4").tolist() == want


def test_words_that_come_once_are_not_kept():
    """The table of a worker holds words from their second time on, whatever the number of words that come once."""
    cache = packing.WordCache(tokenizer("word_bpe_49k.json"))
    once, twice = [f"x{i}y{i * 7919 % 10007}z" for i in range(3000)], ["q1w2", "q3w4"]
    t = " ".join(once + twice)
    cache.ids(t)
    assert len(cache.known) < 200
    assert np.frombuffer(cache.ids(" ".join(twice)), "<u4").tolist() == cache.tokenizer.encode(" ".join(twice), add_special_tokens=False).ids
    assert all(w in cache.known for w in twice) and not any(w in cache.known for w in once[:20])
    before = len(cache.known)
    cache.ids("house")
    cache.ids("house")
    assert len(cache.known) == before + 1  # a part and the word it makes are one entry


def test_near_pairs_in_lots(spark, monkeypatch):
    """The nodes of a hub are confirmed in lots of bounded size; every lot meets the hub."""
    monkeypatch.setattr(minhash, "LOT", 4)
    base = [f"w{i}" for i in range(120)]
    docs = spark.createDataFrame([(i, " ".join(base[: 120 - i])) for i in range(40)], "doc_id long, text string")
    pairs = spark.createDataFrame([(0, i, 116 - i) for i in range(1, 40)], "hub long, node long, n_shingles long")
    assert {tuple(r) for r in minhash.confirmed(pairs, docs, 85).collect()} == {(0, i) for i in range(1, 40) if 100 * (116 - i) >= 85 * 116}


def test_components_of_settled_links_are_found_once(spark, monkeypatch):
    """Where the pivots settle every bucket, their components are the result's, and stars stand still after one pass."""
    runs, passes, real, write = [], [], minhash.components, minhash.written
    monkeypatch.setattr(minhash, "components", lambda edges: runs.append(1) or real(edges))
    base = [f"w{i}" for i in range(120)]
    docs = spark.createDataFrame([(i, " ".join(base[: 120 - i] if i < 5 else [f"v{i}x{k}" for k in range(20)])) for i in range(8)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_groups(docs).collect()}
    assert got == {i: 0 if i < 5 else i for i in range(8)} and len(runs) == 1
    monkeypatch.setattr(minhash, "written", lambda df: passes.append(1) or write(df))
    star = spark.createDataFrame([(3, i) for i in range(4, 40)], "u long, v long")
    assert {tuple(r) for r in real(star).collect()} == {(i, 3) for i in range(3, 40)}
    assert len(passes) == 6  # the links, four tables of a pass, the result


def test_fuzzy_passages_reach_every_occurrence(spark):
    """A passage is found though documents that hold all its seeds in shreds stand first and between its two places."""
    rng = random.Random(15)
    text = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    p = text(60)
    shreds = lambda: [w for k in rng.sample(range(0, 50, 8), 7) for w in text(40) + p[k : k + 16]]
    data = [(i, " ".join(text(20) + p + text(20) if i in (1, 5) else shreds())) for i in range(6)]
    got = passages.fuzzy_passages(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert any((r["doc_id"], r["other_id"], r["start"], r["end"], r["other_start"]) == (5, 1, 20, 80, 20) for r in got)


def test_rows_without_id(spark):
    """op8 leaves rows without an id out; near dedup never drops them."""
    t = " ".join(f"w{i}" for i in range(60))
    d = spark.createDataFrame([(None, t), (None, t + " x"), (1, "a b c d e f")], "doc_id long, text string")
    assert passages.fuzzy_passages(d).count() == 0
    assert minhash.drop_near_copies(d).count() == 3


def test_linked_occurrences(spark):
    """Links of a common seed do not depend on where the sorted rows are cut."""
    rows = sorted({(s, rng.randrange(200), rng.randrange(50)) for rng in [random.Random(14)] for s in [7] * 300 + [8] * 3 + [9] * 120 + list(range(20, 60)) * 2})
    want = set()
    for s in {r[0] for r in rows}:
        own = [r[1:] for r in rows if r[0] == s]
        for i, r in enumerate(own):
            want |= {(r[0], o[0], r[1], o[1]) for o in [own[0], *own[max(0, i - passages.NEAR) : i]] if o != r}
    d = spark.createDataFrame(rows + rows[:50], "seed long, doc_id long, at int").repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for parts, batch in (("1", "10"), ("7", "1"), ("40", "4")):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            assert {tuple(r) for r in passages.linked(d).collect()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before[1])
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_agreements_and_segments():
    rng = random.Random(2)
    for n in (0, 1, 7, 40, 90):
        for _ in range(20):
            a, b = ([rng.randrange(5) for _ in range(rng.randint(0, n))] for _ in range(2))
            path = passages.agreements(a, b)
            assert len(path) == passages.common_words(a, b) and all(a[i] == b[j] for i, j in path)
            assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(path, path[1:]))
    a = [rng.randrange(10**9) for _ in range(9000)]
    assert passages.agreements(a, a[:4000] + a[4100:]) == [(i, i - 100 * (i >= 4100)) for i in range(9000) if not 4000 <= i < 4100]
    path = [(i, i) for i in range(60)] + [(90, 130)] + [(i, i) for i in range(160, 220)]
    assert sorted(passages.segments(path, 32, 0.8)) == [(0, 60, 0, 60, 60), (160, 220, 160, 220, 60)]


def test_sentencepiece_scan(docs, empty, rows):
    model = tokenizer("piece_bpe_32k.model")
    v = sentencepiece_scan.Vocabulary(model)
    best = {}
    for r in rows:
        m = sentencepiece_scan.marked(r[1] or "")
        best[r[0]] = v.forward(m, 0, len(m))[0][-1] if m else 0.0
    want = Counter((r[0], len(r[1] or ""), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows)
    for chunk in (100, 5, 1 << 16):
        got = sentencepiece_scan.round_trip(docs, model, chunk).collect()
        assert Counter((r["doc_id"], r["n_chars"], r["decoded_sha256"]) for r in got) == want
        assert all(math.isclose(r["score"], best[r["doc_id"]], rel_tol=1e-12, abs_tol=1e-6) for r in got)
        texts = sentencepiece_scan.decode(sentencepiece_scan.encode(docs, model, chunk), model)
        assert Counter((r["doc_id"], r["text"]) for r in texts.collect()) == Counter((r[0], r[1] or "") for r in rows)
    assert sentencepiece_scan.round_trip(empty, model).count() == 0


def test_pipeline(spark, docs, empty):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    d = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, sf)
        assert out.columns == d.columns and 0 < out.count() <= d.count(), name
        assert stage(spark, empty.select(*d.columns), sf).count() == 0, name
        d = exact_dedup.written(out)
    packed = corpus_pipeline.STAGES[-1][1](spark, d, sf)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in d.select("doc_id").collect()}
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
