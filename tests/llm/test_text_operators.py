"""Quality, toxicity, near-duplicates, token counts, packing, licences: brute force, exactness and odd inputs."""

import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cairn.llm import licences, near_dedup, packing, quality, token_count, toxicity

ODD = [None, "", " \t\n", "one", "two words", "a b c d e " * 4, "x" * 30_000, "long " * 9_000, "É ç ß 中文 😀  tail", "same text here now", "same text here now", "line\nline\n\nline", "<|endoftext|> it's 12% a|b"]


def frame(spark, texts, first=0):
    rows = [(first + i, t, "clash", 1.5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, fp string, n_tokens double")


def random_texts(n, seed=1):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(300)]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.randint(5, 200))) for _ in range(n)]
    for _ in range(n // 4):
        words = r.choice(texts).split()
        if r.random() < 0.6:
            words[r.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    return texts


# --- SimHash ---


def plain_simhash(text):
    words = (text or "").encode()
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in words).split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    up = list(range(len(prints)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return [root(i) for i in range(len(prints))]


def test_simhash_components_equal_brute_force(spark):
    texts = ODD + random_texts(200)
    prints = [plain_simhash(t) for t in texts]
    want = plain_components(prints)
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in near_dedup.near_duplicates(frame(spark, texts)).collect()}
    assert [got[i][0] for i in range(len(texts))] == prints
    assert [got[i][1] for i in range(len(texts))] == want


@pytest.mark.parametrize("agreeing", [1, 2, 3])
def test_block_masks_lose_no_pair(agreeing):
    masks = [m & (2**64 - 1) for m in near_dedup.block_masks(3, agreeing)]
    r = random.Random(agreeing)
    for _ in range(300):
        a = r.getrandbits(64)
        b = a
        for bit in r.sample(range(64), 3):
            b ^= 1 << bit
        assert any(a & m == b & m for m in masks)


def test_crowded_shards_are_split_without_losing_links(spark):
    r = random.Random(4)
    base = r.getrandbits(64)
    prints = {base}
    while len(prints) < 120:  # all share most bits: every shard is crowded
        x = base
        for bit in r.sample(range(64), r.randint(1, 4)):
            x ^= 1 << bit
        prints.add(x)
    signed = [p - 2**64 if p >> 63 else p for p in sorted(prints)]
    distinct = spark.createDataFrame([(p,) for p in signed], "fp long")
    whole = {tuple(x) for x in near_dedup.connected(near_dedup.links(distinct)).collect()}
    split = {tuple(x) for x in near_dedup.connected(near_dedup.links(distinct, shard_rows=16)).collect()}
    assert whole == split
    roots = plain_components([p & (2**64 - 1) for p in signed])
    groups = Counter(roots)
    assert len(whole) == sum(n - 1 for n in groups.values())


def test_bk_tree_finds_what_a_scan_finds():
    r = np.random.default_rng(2)
    fps = r.integers(0, 2**63, 200, dtype=np.uint64)
    fps[100:] = fps[:100] ^ (np.uint64(1) << r.integers(0, 60, 100).astype(np.uint64))
    every = np.arange(200)
    found = {(n, int(p)) for n, near in near_dedup.bk_links(fps, every, every, 3) for p in near}
    assert found == {(i, j) for i in range(200) for j in range(200) if int(fps[i] ^ fps[j]).bit_count() <= 3}


def test_one_document_of_each_group_stays(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g", "x"), (2, "a b c d e f g", "y"), (2, "a b c d e f g", "y"), (3, "something else entirely here", "z"), (None, "a b c d e f g", "n")], "doc_id long, text string, source string")
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == [(False, 1), (False, 3), (True, None)]
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def five_word_sets(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@pytest.mark.parametrize("shard_shingles", [2_000_000, 500])
def test_stage_drops_edited_copies_from_a_similarity_of_four_fifths(spark, shard_shingles):
    r = random.Random(8)
    texts, pairs = random_texts(40, 6)[:40], []
    for i in range(60):
        words = ["w%d" % r.randrange(5000) for _ in range(r.randint(60, 400))]
        other = list(words)
        for _ in range(r.randint(1, max(1, len(words) // 35))):
            other[r.randrange(len(words))] = "edited%d" % i
        pairs.append((len(texts), len(texts) + 1))
        texts += [" ".join(words), " ".join(other)]
    texts += [None, "", "two words", "Two  words"]
    sets = [five_word_sets(t) for t in texts]
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    between = [like(sets[a], sets[b]) for a, b in pairs]
    assert sum(0.8 <= x < 1 for x in between) > 20 and sum(x < 0.8 for x in between) > 5
    up = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if like(sets[i], sets[j]) >= 0.8:
                up = [min(up[i], up[j]) if x in (up[i], up[j]) else x for x in up]
    got = sorted(x.doc_id for x in near_dedup.keep_one(frame(spark, texts), shard_shingles=shard_shingles).collect())
    assert got == [i for i in range(len(texts)) if up[i] == i]


def test_wide_bk_tree_finds_what_a_scan_finds():
    r = np.random.default_rng(3)
    fps = r.integers(0, 2**63, (300, near_dedup.PRINT), dtype=np.uint64)
    for i in range(100, 300):  # chains of neighbours at all distances
        fps[i] = fps[i - 100] ^ np.packbits(r.random(64 * near_dedup.PRINT) < r.choice([0.01, 0.1, 0.3])).view(np.uint64)
    apart = np.bitwise_count(fps[:, None] ^ fps[None]).sum(axis=2)
    gone = np.zeros(300, bool)
    tree = near_dedup.BKTree(fps)
    for _ in range(4):
        for radius in (0, 20, near_dedup.STAGE_RADIUS, 512):
            for i in range(0, 300, 7):
                assert sorted(tree.near(fps[i], radius).tolist()) == np.flatnonzero((apart[i] <= radius) & ~gone).tolist()
        out = r.permutation(np.flatnonzero(~gone))[:75]
        tree.drop(out)
        gone[out] = True
    assert gone.all() and not tree.near(fps[0], 512).size


def test_stage_links_what_its_bk_trees_find():
    """Pairs at a Jaccard similarity of 0.8 lie within the radius and strangers don't; no link is made beside the trees."""
    r = np.random.default_rng(7)
    new = lambda n: r.integers(0, 2**63, n, dtype=np.uint64)
    apart = []
    for common, a, b in ((4, 0, 1), (8, 1, 1), (8, 0, 2), (16, 2, 2), (80, 10, 10), (400, 0, 100), (4000, 500, 500)):
        for _ in range(60 if common < 1000 else 8):
            same = new(common)
            both = [near_dedup.wide_simhash(np.unique(np.concatenate([same, new(n)]))) for n in (a, b)]
            apart.append(int(near_dedup.bits_apart(both[0][None], both[1])[0]))
    assert max(apart) < near_dedup.STAGE_RADIUS - 10
    strangers = np.array([near_dedup.wide_simhash(new(n)) for n in (5, 9, 40, 41, 300, 301) for _ in range(20)])
    assert min(int(np.delete(near_dedup.bits_apart(strangers, x), i).min()) for i, x in enumerate(strangers)) > near_dedup.STAGE_RADIUS
    sets = [new(50) for _ in range(12)]
    sets += [np.concatenate([x[:46], new(4)]) for x in sets[:6]] + [np.concatenate([sets[0][:40], new(10)])]
    sets = [np.sort(x) for x in sets]
    prints = [near_dedup.wide_simhash(x).tobytes() for x in sets]
    edges = near_dedup.like_edges(list(range(len(sets))), sets, prints)
    assert sorted(tuple(sorted(e)) for e in edges) == [(i, i + 12) for i in range(6)]
    assert near_dedup.like_edges(list(range(len(sets))), sets, prints, radius=20) == []
    # Equal fingerprints of different sets share a node, and all of its sets are held against each other.
    assert sorted(tuple(sorted(e)) for e in near_dedup.like_edges(list(range(len(sets))), sets, [prints[0]] * len(sets))) == [(i, i + 12) for i in range(6)]


def test_links_are_the_same_for_each_number_of_agreeing_blocks(spark):
    texts = random_texts(60, 5)
    got = [sorted(map(tuple, near_dedup.near_duplicates(frame(spark, texts), agreeing=n).collect())) for n in (1, 2, 3)]
    assert got[0] == got[1] == got[2] and len({c for _, _, c in got[0]}) < len(texts)


def test_kept_rows_of_odd_tables(spark):
    """Repeated and null keys, equal rows, columns that clash with the operator's own names, names with dots, maps."""
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, long, 1), (2, long + " tail", 2), (1, "another text altogether, not like it at all", 3), (7, "only a repeated row here in the table", 4), (7, "only a repeated row here in the table", 4), (None, long, 5), (None, "no key and no copy of it anywhere else", 6), (None, None, 7), (9, "", 8), (8, " ", 9)]
    docs = spark.createDataFrame([(k, t, n, n, {"a": n}) for k, t, n in rows], "doc_id long, text string, __n int, `a.b` int, m map<string,int>")
    kept = near_dedup.keep_one(docs.repartition(3))
    assert kept.columns == docs.columns
    want = sorted([(1, 1), (1, 3), (7, 4), (None, 5), (None, 6), (None, 7), (8, 9)], key=str)
    assert sorted(((r.doc_id, r["__n"]) for r in kept.collect()), key=str) == want
    assert sorted(((r.doc_id, r["a.b"]) for r in near_dedup.keep_one(docs.repartition(5)).collect()), key=str) == want
    assert near_dedup.keep_one(docs.limit(0)).count() == 0
    # Of one key and one component the row is chosen by its content, not by where it lies.
    same = spark.createDataFrame([(1, long, i) for i in range(6)], "doc_id long, text string, n int")
    assert len({near_dedup.keep_one(same.repartition(p)).first().n for p in (1, 2, 4)}) == 1


# --- token counts and packing ---


def test_token_counts_equal_the_library(spark):
    texts = ODD + random_texts(60, 3) + ["foo \n<|endoftext|>  bar\t\tx", "tab\tafter  two \n\n three", "'s 'll don't", "\x1c\x85 wide"]
    library = token_count.load(open(token_count.tokenizer_file("byte_bpe_50k.json"), encoding="utf-8").read())
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_count.token_counts(frame(spark, texts)).collect()}
    want = {i: (len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts)}
    assert got == want
    assert token_count.token_counts(frame(spark, texts).limit(0)).count() == 0


def test_packing_loses_nothing_and_pads_nothing(spark):
    texts = ODD + random_texts(300, 5)
    library = token_count.load(open(token_count.tokenizer_file("word_bpe_49k.json"), encoding="utf-8").read())
    pieces = packing.pack_documents(frame(spark, texts).repartition(3)).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for i, t in enumerate(texts):
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        own = sorted(by_doc[i], key=lambda p: p.start)
        assert b"".join(p.ids for p in own) == ids.tobytes()
        assert all(p.doc_tokens == len(ids) and p.length == len(p.ids) // 4 for p in own)
        assert [p.start for p in own] == [sum(q.length for q in own[:k]) for k in range(len(own))]
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == [sum(q.length for q in own[:k]) for k in range(len(own))]
        total = sum(p.length for p in own)
        assert total <= 4096 and total & (total - 1) == 0
    assert packing.pack_documents(frame(spark, texts).limit(0)).count() == 0


def test_packing_digest(spark, small):
    row = packing.op6(spark, small).orderBy("doc_id", "start").first()
    piece = packing.pack_documents(spark.read.parquet(f"{small}/documents.parquet")).orderBy("doc_id", "start").first()
    assert row.ids_crc32 == zlib.crc32(piece.ids)


# --- quality ---


def plain_counts(text):
    text = text or ""
    spaces = " \t\n\x0b\x0c\r"
    words, word = [], ""
    for c in text + " ":
        if c in spaces:
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if any(c not in spaces for c in line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_base_counts_equal_brute_force():
    for t in ODD + random_texts(50, 7) + ["a b c d e f a b c d e", "x\ny\nx\n \nx z", "a a a a a a a", "#$ <|> &&\n&&\n"]:
        assert quality.base_counts(None if t is None else t.encode()) == plain_counts(t), t


def test_quality_keeps_trusted_text_and_rejects_noise(spark):
    r = random.Random(2)
    good = [" ".join(r.choice(("river", "stone", "garden", "quiet", "morning", "walk", "light")) + str(r.randint(0, 30)) for _ in range(40)) for _ in range(150)]
    bad = [" ".join(r.choice(("$$$", "|", "win!!", "click***")) + str(r.randint(0, 30)) for _ in range(40)) for _ in range(50)]
    docs = frame(spark, good + bad + [None, ""])
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(0, 200, 2)] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = {x.doc_id: x.kept for x in quality.judge(docs, quality.fit(docs, labels)).collect()}
    assert all(got[i] for i in range(150)) and not any(got[i] for i in range(150, 202))
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 150
    everyone = quality.judge(docs, quality.fit(docs, labels.filter("quality = 1")))
    assert everyone.filter("kept").count() == 200  # one class only: the base rules alone
    assert quality.judge(docs.limit(0), quality.fit(docs.limit(0), labels)).count() == 0


def test_scores_do_not_depend_on_the_number_of_rows(spark):
    """Rows without a text change neither the model nor a verdict; the number of buckets is a parameter alone."""
    docs = frame(spark, random_texts(40, 3))
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    more = docs.unionByName(spark.range(1000, 3000).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit("c").alias("fp"), F.lit(1.0).alias("n_tokens")))
    one, two = quality.fit(docs, labels), quality.fit(more, labels)
    assert one.bits == two.bits == quality.BITS and np.array_equal(one.ratio, two.ratio) and one.threshold == two.threshold


def test_quality_model_and_scores_equal_brute_force(spark, monkeypatch):
    """Raw counts over all texts, target counts over all trusted texts outside the fold, the ratio and every score; with trusted keys broadcast and shuffled."""
    texts = [*random_texts(60, 9), None, "", "lone"]
    docs = frame(spark, texts).repartition(4)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 60)] + [(7, 0), (None, 1), (1000, 1)], "doc_id long, quality int")
    quality_of = {i: int(i % 3 > 0) for i in range(60)} | {7: 0}
    held = {r.doc_id for r in labels.dropna().select("doc_id", (F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("fold")), F.lit(5)) == 0).alias("h")).filter("h").collect()}
    for bits, shuffled in ((16, False), (20, True)):
        monkeypatch.setattr(quality, "BROADCAST_KEYS", -1 if shuffled else 1 << 21)
        model = quality.fit(docs, labels, bits=bits)
        raw, target = np.zeros(1 << bits), np.zeros(1 << bits)
        for i, t in enumerate(texts):
            np.add.at(raw, quality.buckets((t or "").encode(), bits), 1)
            if quality_of.get(i) and i not in held:
                np.add.at(target, quality.buckets((t or "").encode(), bits), 1)
        prior, weight = (raw + 0.5) / (raw + 0.5).sum(), quality.PRIOR
        ratio = np.log((target + weight * prior) / (target.sum() + weight)) - np.log(prior)
        assert model.bits == bits and np.allclose(model.ratio, ratio, atol=1e-6)
        got = {r.doc_id: (r.quality, r.kept, r.base_failed) for r in quality.judge(docs, model).collect()}
        for i, t in enumerate(texts):
            found = quality.buckets((t or "").encode(), bits)
            want = float(ratio[found].mean()) if len(found) else 0.0
            assert got[i][0] == pytest.approx(want, abs=1e-6)
            assert got[i][1] == (not got[i][2] and got[i][0] >= model.threshold)


def test_threshold_is_the_cheapest():
    scores, trusted = np.array([0.1, 0.2, 0.3, 0.4, 0.4, 0.6]), np.array([False, False, True, False, True, True])
    cut = quality.best_threshold(scores, trusted)
    cost = lambda c: 4 * (trusted & (scores < c)).sum() + (~trusted & (scores >= c)).sum()
    assert cost(cut) == min(cost(c) for c in np.linspace(0, 0.7, 71))
    assert 0.2 < cut <= 0.3


@pytest.mark.parametrize("scores", [200_000, 7])
def test_threshold_of_ranges_equals_that_of_one_array(spark, monkeypatch, scores):
    monkeypatch.setattr(quality, "SCORES", scores)
    r = np.random.default_rng(4)
    rounded = r.normal(size=60).round(1)
    for values, trusted in ((rounded, r.random(60) < 0.5 + rounded / 4), (rounded, rounded < 0), (rounded, rounded >= 0), (rounded, rounded < 9), (np.ones(5), np.arange(5) > 2), (np.zeros(0), np.zeros(0, bool)), (np.arange(40.0), np.arange(40) == 0)):
        rows = spark.createDataFrame([(float(v), bool(t)) for v, t in zip(values, trusted, strict=True)], "score double, trusted boolean")
        assert quality.cheapest_cut(rows.repartition(3)) == quality.best_threshold(values, trusted)


def test_threshold_comes_from_every_labelled_text_of_the_fold(spark):
    """More labels in the fold than the 8,000 that once set the threshold; keys as numbers and as texts."""
    texts = spark.range(60_000).selectExpr("id AS doc_id", "concat(IF(xxhash64(id) % 3 = 0, 'good', 'bad'), pmod(xxhash64(id, 1), 50), ' word', pmod(xxhash64(id, 2), 40), ' tail', pmod(xxhash64(id, 3), 30)) AS text")
    labels = texts.selectExpr("doc_id", "IF((xxhash64(doc_id) % 3 = 0) != (pmod(xxhash64(doc_id, 4), 5) = 0), 1, 0) AS quality")
    model = quality.fit(texts, labels, bits=12)
    rows = texts.join(labels, "doc_id").filter("pmod(xxhash64(CAST(doc_id AS STRING), 'fold'), 5) = 0").toPandas()
    assert len(rows) > 11_000
    want = quality.best_threshold(np.array([model.score(t.encode()) for t in rows.text]), rows.quality.to_numpy() > 0)
    assert np.isfinite(want) and model.threshold == want
    named = lambda f: f.withColumn("doc_id", F.col("doc_id").cast("string"))
    assert quality.fit(named(texts), named(labels), bits=12).threshold == want


# --- toxicity ---


def plain_segments(scores):
    """All maximal scoring segments by their recursive definition: the best, then those left and right of it."""

    def best(a, b):
        top = None
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += scores[j]
                if total > 0 and (top is None or total > top[0] + 1e-12):
                    top = (total, i, j + 1)
        return top

    def parts(a, b):
        top = best(a, b)
        return [] if top is None else [*parts(a, top[1]), top, *parts(top[2], b)]

    return parts(0, len(scores))


def test_segments_equal_the_definition():
    r = random.Random(3)
    for _ in range(150):
        scores = [round(r.uniform(-2, 1.5), 3) for _ in range(r.randint(0, 25))]
        got = [(round(s, 6), a, b) for s, a, b in toxicity.segments(np.array(scores))]
        assert got == [(round(s, 6), a, b) for s, a, b in plain_segments(scores)]


def test_toxic_held_out_accuracy(spark, small):
    sf = small.replace("0.001", "0.01")
    scored = toxicity.op9(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    right = sum(r.predicted == r.toxic for r in scored) / len(scored)
    caught = [r.predicted for r in scored if r.toxic]
    assert right > 0.93 and sum(caught) / len(caught) > 0.5
    false_alarms = sum(r.predicted for r in scored if not r.toxic)
    assert false_alarms <= 0.02 * len(scored)


def test_segments_take_linear_time():
    def took(n, best=9.0):
        scores = np.tile([1.0, -2.0], n // 2)
        for _ in range(3):
            began = time.process_time()
            assert len(toxicity.segments(scores)) == n // 2
            best = min(best, time.process_time() - began)
        return best

    assert took(800_000) < 12 * took(100_000)  # 8, with room for noise; a quadratic scan takes 64


def test_all_passages_of_a_text_count():
    model = toxicity.Model({b"bad": (1000, 1)}, 1.0, decay=1.0, scale=0.1)
    one = [b"bad"] * 5 + [b"unseen"] * 40
    passage = model.passages(model.scores(one * 200))
    assert len(passage) == 200 and [(a, b) for _, a, b in passage] == [(45 * k, 45 * k + 5) for k in range(200)]
    assert model.statistic(model.scores(one * 200)) == sum(s for s, _, _ in passage) > 150 * passage[0][0]


def test_calibration_equals_its_definition(spark):
    """lambda, K and the logistic curve's inputs, once more from whole lists."""
    r = random.Random(2)
    model = toxicity.Model({b"bad": (60, 2), b"odd": (30, 12), b"good": (2, 80)}, 1.0)
    texts = [" ".join(r.choice(("bad", "odd", "good", "other", "good")) for _ in range(r.randint(1, 60))) for _ in range(80)]
    rows = spark.createDataFrame([(bytearray(t.encode()), i % 2) for i, t in enumerate(texts)], "text binary, label int").repartition(3)
    toxicity.chance_law(model, rows.filter("label = 0"))
    scores = [model.scores(t.encode().split()) for i, t in enumerate(texts) if i % 2 == 0]
    every = np.concatenate(scores)
    holds = [float(g) for g in toxicity.GRID if np.exp(g * every).mean() <= 1]
    assert model.decay == max(holds)
    gaps = [model.decay * max((s for s, _, _ in toxicity.segments(x)), default=0.0) - np.log(len(x)) for x in scores]
    assert model.scale == pytest.approx(np.exp(np.mean(gaps) - toxicity.EULER))
    want = [sum(max(0.0, model.decay * s - np.log(model.scale * len(t.split()))) for s, _, _ in toxicity.segments(model.scores(t.encode().split()))) for t in texts]
    assert sorted(x for _, x in toxicity.statistics_of(rows, model)) == pytest.approx(sorted(want))


def test_toxicity_of_odd_input(spark):
    docs = frame(spark, ODD)
    nothing = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    got = toxicity.score(docs, nothing).collect()
    assert len(got) == len(ODD) and len({r.toxicity for r in got}) == 1 and all(r.passages == [] for r in got)
    assert toxicity.keep_civil(docs, spark.createDataFrame([], "doc_id long, toxic int")).columns == docs.columns
    assert toxicity.score(docs.limit(0), nothing).count() == 0


def test_labels_of_the_held_out_third_are_not_learned(spark, small):
    learned = toxicity.learn_split(spark.read.parquet(f"{small}/labels.parquet")).collect()
    assert learned and all(zlib.crc32(str(r.doc_id).encode()) % 3 != 1 for r in learned)


# --- licences ---


def test_licences_are_found_and_nothing_else(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    lines = (("GNU General Public", "gpl"), ("CC BY-NC 4.0", "cc-by-nc"), ("MIT License", "mit"), ("Apache License", "apache"), ("All rights reserved.", "proprietary"))
    got = {r.doc_id: [x.family for x in r.licences] for r in licences.scan(docs).collect()}
    for r in docs.select("doc_id", "text").collect():
        assert sorted(got[r.doc_id]) == sorted(f for line in r.text.split("\n") for s, f in lines if s in line)


def test_licence_classifier():
    model = licences.trained()
    judged = lambda t: model.judge(licences.words(t.encode()))
    assert [judged(t) for t in licences.OTHERS] == [None] * len(licences.OTHERS)
    for family, notices in licences.NOTICES.items():
        assert sum((judged(n) or ("",))[0] == family for n in notices) >= len(notices) - 1, family
    assert judged("RELEASED UNDER THE MIT LICENSE")[0] == "mit"


def test_short_proprietary_notices_are_found(spark):
    short = ["All rights reserved.", "ALL RIGHTS RESERVED", "Copyright (c) 2024 Foo GmbH. All rights reserved.", "© 2021 Acme. All rights reserved."]
    others = ["All rights of way were reserved by the state.", "All seats are reserved.", "The author has all rights to the work."]
    got = {r.doc_id: [x.family for x in r.licences] for r in licences.scan(frame(spark, short + others)).collect()}
    assert [got[i] for i in range(len(short + others))] == [["proprietary"]] * len(short) + [[]] * len(others)


def test_all_five_kinds_of_given_licence_lines_are_found(spark, small):
    docs = spark.read.parquet(small.replace("0.001", "0.01") + "/documents.parquet")
    lines = (("GNU General Public", "gpl"), ("CC BY-NC 4.0", "cc-by-nc"), ("MIT License", "mit"), ("Apache License", "apache"), ("All rights reserved.", "proprietary"))
    got = {r.doc_id: [x.family for x in r.licences] for r in licences.scan(docs).collect()}
    want = {r.doc_id: [f for line in r.text.split("\n") for s, f in lines if s in line] for r in docs.select("doc_id", "text").collect()}
    assert got == want and {f for found in want.values() for f in found} == {f for _, f in lines}


def test_wrapped_notices_and_neighbouring_families(spark):
    wrapped = {
        "bsd": "Some words.\n\nRedistribution and use in source and binary forms, with or\nwithout modification, are permitted provided that the following\nconditions are met.\n\nMore words.",
        "isc": "Permission to use, copy, modify, and distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.",
        "lgpl": "This library is distributed under the GNU Lesser\nGeneral Public License, version 2.1 of the License",
        "epl": "This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0",
        "unlicense": "This is free and unencumbered software released into\nthe public domain.",
        "agpl": "it under the terms of the GNU Affero General Public License as published",
    }
    texts = list(wrapped.values()) + ["The library lies by the river.\nThe public reads there for free.\nPermission is needed on Sundays."]
    got = {r.doc_id: [(x.family, x.paragraph) for x in r.licences] for r in licences.scan(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == [[(f, int(f in ("bsd", "epl")))] for f in wrapped] + [[]]  # the second line names the Eclipse licence by itself


def test_licence_model_equals_its_definition():
    """Probabilities of a softmax over the paragraph's n-grams, similarity as the best share of a template's pairs; no outcome without both."""
    model, r = licences.trained(), random.Random(1)
    notices = [(f, n) for f, ns in licences.NOTICES.items() for n in ns]
    for _ in range(60):
        family, notice = r.choice(notices)
        found = licences.words(" ".join(w for w in notice.split() if r.random() > 0.2).encode())
        z = model.bias.astype(float).copy()
        for n in (1, 2, 3):
            for g in {tuple(found[i : i + n]) for i in range(len(found) - n + 1)}:
                if g in model.index:
                    z += model.weights[model.index[g]]
        p = np.exp(z / model.temperature) / np.exp(z / model.temperature).sum()
        assert np.allclose(p, model.probabilities(found), atol=1e-5)
        share = {f: max(len(set(zip(found, found[1:], strict=False)) & t) / len(t) for t in ts) for f, ts in model.templates.items()} if len(found) > 1 else None
        judged, best = model.judge(found), int(p.argmax())
        if share and best and p[best] >= 0.5 + 1e-6 and share[model.families[best]] >= 0.5 and max(share.values()) <= share[model.families[best]] + licences.CLOSER:
            assert judged[0] == model.families[best] and judged[2] == share[judged[0]]
        elif share:
            assert judged is None or abs(p[best] - 0.5) < 1e-5


def test_probabilities_are_calibrated_on_left_out_notices():
    """No variant of a judged notice was seen in training; the likeliest class is right about as often as its probability says."""
    _, _, labels, folds = licences.examples()
    assert all(licences.left_out(label, i, f) != licences.left_out(label, i, (f + 1) % 3) for label in range(3) for i in range(4) for f in range(3) if licences.left_out(label, i, f))
    bins = licences.reliability(licences.trained().temperature)
    gaps = sum(n * abs(sure - right) for sure, right, n in bins) / len(labels)
    raw = sum(n * abs(sure - right) for sure, right, n in licences.reliability(0.5)) / len(labels)
    assert gaps < 0.12 < raw and set(folds) == {0, 1, 2}


def test_licences_of_odd_input(spark):
    got = {r.doc_id: r for r in licences.scan(frame(spark, [*ODD, "Released under the MIT License.\n" * 3])).collect()}
    assert got[0].n_paragraphs == 0 and got[len(ODD)].n_paragraphs == 3
    assert [x.paragraph for x in got[len(ODD)].licences] == [0, 1, 2]
    assert licences.scan(frame(spark, []).select(F.col("doc_id"), "text")).count() == 0
