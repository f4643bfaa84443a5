"""Each operator against a plain version of its definition, on fixtures small enough for it."""

import collections
import hashlib
import random
import re
import tracemalloc
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessella.llm import embed_join, exact_dedup, graph, minhash, mixing, packing, quality, queries, suffix_dedup, textvec, token_counts, toxicity, warc, zipdir
from tessella.llm.common import table


def union_find(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def texts(spark, data_dir):
    return {r.doc_id: r.text for r in table(spark, data_dir, "documents").select("doc_id", "text").collect()}


# exact copies, near copies, vectors, passages


def test_exact_groups(spark, data_dir, duck, same):
    same(queries.op10_exact_dedup(spark, data_dir).toPandas(), duck.execute(exact_dedup.ORACLE).df())


def test_a_full_filter_changes_nothing(spark, data_dir, duck, same, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MAX_FILTER_BITS", exact_dedup.BITMAP_BITS)
    monkeypatch.setattr(exact_dedup, "BITS_PER_ROW", 1)
    same(queries.op10_exact_dedup(spark, data_dir).toPandas(), duck.execute(exact_dedup.ORACLE).df())


def test_filters_by_part_change_nothing(spark, data_dir, duck, same, monkeypatch):
    """More rows than one filter holds: parts by hash, each with passes of its own."""
    monkeypatch.setattr(exact_dedup, "MAX_FILTER_BITS", exact_dedup.BITMAP_BITS)
    monkeypatch.setattr(exact_dedup, "BITS_PER_ROW", 600)
    same(queries.op10_exact_dedup(spark, data_dir).toPandas(), duck.execute(exact_dedup.ORACLE).df())


def near_truth(found):
    words = {i: re.findall(r"\w+", t.lower()) for i, t in found.items()}
    grams = {i: collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for i, w in words.items()}
    holders = collections.defaultdict(set)
    for i, g in grams.items():
        for x in g:
            holders[x].add(i)
    pairs = {(a, b) for held in holders.values() for a in held for b in held if a < b}
    links = [(a, b) for a, b in pairs if sum((grams[a] & grams[b]).values()) >= 0.8 * sum((grams[a] | grams[b]).values())]
    sequences = collections.defaultdict(list)
    for i, w in words.items():
        if w:
            sequences[tuple(w)].append(i)
    return union_find(found, links + [(s[0], x) for s in sequences.values() for x in s[1:]])


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_near_groups(spark, data_dir, size):
    where = data_dir.replace("sf0.001", size)
    got = {r.doc_id: (r.group_id, r.kept) for r in queries.op2_minhash(spark, where).collect()}
    truth = near_truth(texts(spark, where))
    assert got == {i: (g, g == i) for i, g in truth.items()}


def test_near_groups_in_one_common_passage(spark):
    """Texts around one passage share buckets without being alike; copies of one base are alike, not always each other."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    passage, base = [word() for _ in range(60)], [word() for _ in range(120)]
    found = {}
    for i in range(40):
        found[i] = " ".join([word() for _ in range(30)] + passage + [word() for _ in range(30)])
        copy = list(base)
        for _ in range(2):
            copy[rng.randrange(len(copy))] = word()
        found[100 + i] = " ".join(copy)
    df = spark.createDataFrame(list(found.items()), "doc_id long, text string")
    assert {r.doc_id: r.group_id for r in minhash.near_duplicates(df).collect()} == near_truth(found)


def test_darts_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 40, 300).astype(np.uint64), rng.integers(10, 50, 300).astype(np.uint64)
    items, owner = np.concatenate((a, b)), np.repeat([0, 1], 300)
    k = 4_000
    names = minhash.dart_minhash(*minhash.cells(items, owner), 2, k)
    assert abs((names[0] == names[1]).mean() - minhash.similarity(a, b)) < 4 * (0.25 / k) ** 0.5


@pytest.mark.parametrize("limit", [0, 1_000_000])
def test_components(spark, monkeypatch, limit):
    monkeypatch.setattr(graph, "TASK_LINKS", limit)
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1_000 + i, 1_001 + i) for i in range(30)]
    got = {r.node: r.root for r in graph.connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    links = [(a, b) for a, b in links if a != b]
    assert got == union_find({x for p in links for x in p}, links)


def vector_truth(rows):
    units = {i: np.asarray(v, float) / np.linalg.norm(v) for i, v in rows}
    ids = sorted(units)
    near = np.stack([units[i] for i in ids]) @ np.stack([units[i] for i in ids]).T >= 0.9
    np.fill_diagonal(near, False)
    roots = union_find(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near))])
    return sorted((i, int(n), roots[i], roots[i] == i) for i, n in zip(ids, near.sum(1)))


@pytest.mark.parametrize("tile", [64, 16_384])
def test_near_vectors(spark, tile):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(150, 16))
    close = np.repeat(base[:30], 3, axis=0) + rng.normal(size=(90, 16)) * 0.12
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.concatenate((base, close, base[:5])).astype(np.float32))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, embed_join.near_vectors(df, tile=tile).collect())) == vector_truth(rows)


def test_near_vectors_of_the_table(spark, data_dir):
    found = table(spark, data_dir, "embeddings").select("vec_id", "embedding").collect()
    rows = [(r.vec_id, r.embedding) for r in found if r.embedding and all(x is not None and np.isfinite(x) for x in r.embedding) and any(r.embedding)]
    got = sorted(map(tuple, queries.op3_embed_join(spark, data_dir).collect()))
    linked = {r[0] for r in rows}
    assert [r for r in got if r[0] in linked] == vector_truth(rows) and len(got) == len(found)


def test_vectors_of_one_leading_coordinate(spark):
    """Equal coordinates fill several tiles, and pairs across these are found."""
    rng = np.random.default_rng(3)
    v = np.concatenate((np.eye(8)[rng.integers(0, 8, 60)], rng.choice([-1.0, 0.0, 1.0], (120, 8)) + 1e-9))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, embed_join.near_vectors(df, tile=16).collect())) == vector_truth(list(enumerate(v)))


def test_a_vector_is_shuffled_once_a_tile():
    """A vector without neighbours to rule out went to each pair of tiles four times over, in tiles of 16,384."""
    n, rng = 600_000, np.random.default_rng(1)
    tiles = embed_join.tiles_for(n, 64, 12)
    lead = rng.normal(size=n) / 8
    cuts = sorted(np.quantile(lead, np.arange(1, tiles) / tiles))
    copies = sum(len(at) for at, *_ in embed_join.meetings(np.arange(n), lead, cuts, 2.0))
    assert copies == n * tiles <= 13 * n


@pytest.mark.parametrize("parts", [1, 2])
def test_dense_tiles_need_no_memory_for_pairs(parts):
    """4,000 near copies link in 8 million pairs (128 MB as two arrays); what is kept is a few numbers a vector."""
    rng = np.random.default_rng(7)
    x = (np.ones((4_000, 8)) + rng.normal(size=(4_000, 8)) * 0.01).astype(np.float32)
    x[:2_000] *= np.array([1, -1] * 4, np.float32)  # two groups, each over both tiles
    x = x[rng.permutation(4_000)]
    axes, blocks = embed_join.rotation(embed_join._units(x), 1, 0.2)
    y = (embed_join._units(x) @ axes).astype(np.float32)
    counts = rng.integers(1, 4, 4_000)
    sides = [(np.arange(4_000)[p], counts[p], x[p], y[p]) for p in np.array_split(np.arange(4_000), parts)]
    tracemalloc.start()
    ids, links, root = embed_join.tile_links(0, blocks, sides[0], sides[-1], 0.9)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    group = x[:, 0] * x[:, 1] > 0
    # Within one tile a vector meets its whole group but itself, across two its group in the other tile.
    tile = np.zeros(4_000, int) if parts == 1 else np.arange(4_000) // 2_000
    for v in range(0, 4_000, 97):
        met = (group == group[v]) & ((tile != tile[v]) if parts == 2 else (np.arange(4_000) != v))
        assert links[v] == counts[met].sum() and root[v] == np.flatnonzero(group == group[v])[0]
    assert ids.tolist() == list(range(4_000)) and peak < 60 << 20


def test_odd_vectors(spark):
    odd = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [2.0, 0.0]), (9, []), (10, [1.0, 0.0, 0.0]), (11, [1e200, 1e200]), (12, [1e-200, 1e-200])]
    got = sorted(map(tuple, embed_join.near_vectors(spark.createDataFrame(odd, "vec_id long, embedding array<double>")).collect()))
    assert got == [(1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 2, 1, False), (9, 0, 9, True), (10, 0, 10, True), (11, 1, 11, True), (12, 1, 11, False)]


def test_suffix_arrays():
    rng = random.Random(3)
    for _ in range(400):
        letters = rng.choice([1, 2, 3, 200])
        x = np.array([rng.randrange(letters) for _ in range(rng.randint(0, 40))], np.uint32)
        assert suffix_dedup.suffix_array(x).tolist() == sorted(range(len(x)), key=lambda i: x[i:].tolist())


def passages_truth(found):
    seen, out = set(), []
    for i, t in found:
        b = (t or "").encode()
        edge = np.zeros(len(b) + 1, int)
        hits = [p for p in range(len(b) - 99) if b[p : p + 100] in seen or seen.add(b[p : p + 100])]
        for p in hits:
            edge[p] += 1
            edge[p + 100] -= 1
        cut = np.cumsum(edge)[:-1] > 0
        out.append((i, len(b), int(cut.sum()), int((np.diff(np.append(0, cut.astype(int))) == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~cut].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("bucket", [7, 3_000])
def test_repeated_passages(spark, monkeypatch, bucket):
    monkeypatch.setattr(suffix_dedup, "BUCKET_PARTS", bucket)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 700)
    rng = random.Random(6)
    line = "a passage that many documents share, of well over one hundred bytes so that it counts as repeated text here "
    found = [(i, "".join(rng.choice("abcd ") for _ in range(rng.randint(0, 400)))) for i in range(50)]
    found = [(i, t[:50] + line * (i % 4) + t[50:] if i % 3 == 0 else t) for i, t in found]
    found += [(100, "é" * 150), (101, "a" * 900), (102, "b" * 99 + "é" * 200), (103, "a" * 100), (104, ""), (105, None), (106, "".join(rng.choice("xyz") for _ in range(3_000)))]
    got = suffix_dedup.digests(spark.createDataFrame(found, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == passages_truth(found)


def test_repeated_passages_of_the_documents(spark, data_dir):
    got = sorted(map(tuple, queries.op5_suffix_dedup(spark, data_dir).collect()))
    assert got == passages_truth(sorted(texts(spark, data_dir).items()))


# scores


def auc(scores, truth):
    order = sorted(zip(scores, truth))
    ranks = [i for i, (_, t) in enumerate(order) if t]
    n = len(ranks)
    return (sum(ranks) - n * (n - 1) / 2) / (n * (len(truth) - n))


@pytest.mark.parametrize(("query", "target", "fold"), [("op1_quality", "quality", lambda c: c % 5 == 0), ("op4_toxicity", "toxic", lambda c: c % 3 == 1)])
def test_held_out_scores(spark, query, target, fold):
    path = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in getattr(queries, query)(spark, path).collect()}
    assert all(r.held_out == fold(zlib.crc32(str(i).encode())) for i, r in rows.items())
    assert all(0 <= r.score <= 1 for r in rows.values())
    truth = {r.doc_id: r[target] for r in table(spark, path, "labels").collect() if rows[r.doc_id].held_out}
    assert auc([rows[i].score for i in truth], list(truth.values())) > 0.98
    assert np.mean([rows[i].predicted == t for i, t in truth.items()]) > 0.95


def test_positive_unlabelled_risk_separates():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(1, 1, (4_000, 4)), rng.normal(-1.5, 1, (1_000, 4))
    mixed = np.concatenate((good[2_000:], bad[:500]))
    scorer = quality.Scorer(4)
    scorer.fit(good[:2_000], mixed, 0.8, epochs=60)
    assert scorer.score(good[:500]).mean() > 0.9 and scorer.score(bad[500:]).mean() < 0.2


@pytest.mark.parametrize("prior", [0.2, 0.9])
def test_risk_gradient_is_that_of_the_risk(prior):
    """Against differences of the risk as it is defined, in either of its two cases."""
    rng = np.random.default_rng(2)
    good, mixed = rng.normal(1, 1, (30, 3)), rng.normal(-2, 1, (40, 3))
    scorer = quality.Scorer(3, hidden=4)
    if prior > 0.5:
        scorer.p[3] = np.array([3.0])
    loss = lambda z: np.log1p(np.exp(-z))

    def parts():
        gp, gu = scorer.forward(good)[0], scorer.forward(mixed)[0]
        return prior * np.mean([loss(g) for g in gp]), np.mean([loss(-g) for g in gu]) - prior * np.mean([loss(-g) for g in gp])

    first, second = parts()
    assert (second >= 0) == (prior < 0.5)
    risk = (lambda: sum(parts())) if second >= 0 else (lambda: -parts()[1])
    for p, grad in zip(scorer.p, scorer.risk_gradient(good, mixed, prior), strict=True):
        for at in np.ndindex(p.shape):
            old = p[at]
            p[at] = old + 1e-5
            above = risk()
            p[at] = old - 1e-5
            below = risk()
            p[at] = old
            assert abs((above - below) / 2e-5 - grad[at]) < 1e-6


def test_ftrl_steps_coordinate_by_coordinate():
    """The update of each coordinate as it is published, in plain floats."""
    rng = random.Random(4)
    model, z, n, bias = toxicity.Ftrl(l1=0.5), collections.defaultdict(float), collections.defaultdict(float), [0.0, 0.0]

    def weight(i):
        if abs(z[i]) <= model.l1:
            return 0.0
        return -(z[i] - (model.l1 if z[i] > 0 else -model.l1)) / ((model.beta + n[i] ** 0.5) / model.alpha + model.l2)

    for _ in range(200):
        at, label = sorted(rng.sample(range(30), 6)), rng.randrange(2)
        w, b = {i: weight(i) for i in at}, -bias[0] / ((model.beta + bias[1] ** 0.5) / model.alpha)
        g = 1 / (1 + np.exp(-(sum(w.values()) + b))) - label
        for i in at:
            z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / model.alpha * w[i]
            n[i] += g * g
        bias = [bias[0] + g - ((bias[1] + g * g) ** 0.5 - bias[1] ** 0.5) / model.alpha * b, bias[1] + g * g]
        model.learn(np.array(at), label)
    assert np.allclose(model.weights(np.arange(30)), [weight(i) for i in range(30)], atol=1e-3) and abs(model.bias[0] - bias[0]) < 1e-3
    assert any(weight(i) == 0 for i in range(30)) and any(weight(i) for i in range(30))


def test_ftrl_is_sparse():
    rng = random.Random(1)
    rows = [" ".join(rng.choice("abcdefghijklmnop") for _ in range(20)) + (" awful" if i % 4 == 0 else "") for i in range(800)]
    at, w, b = toxicity.fit(rows, [int(i % 4 == 0) for i in range(800)])
    dense = np.zeros(toxicity.BUCKETS, np.float32)
    dense[at] = w
    got = toxicity.scores(["a b awful c", "a b c", ""], (at, w, b), dense)
    assert got[0] > 0.7 > 0.3 > got[1] and len(at) < 200 and 0 <= got[2] < 0.5


# packing, mixing, counting, archives


def test_packed_pieces(spark, data_dir):
    rows = queries.op6_packing(spark, data_dir).collect()
    bpe = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = texts(spark, data_dir)
    ids = {i: np.array([*bpe.encode(t, add_special_tokens=False).ids, 1], "<u4") for i, t in found.items()}
    at, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        at[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
    for spans, ends in ((at, {i: len(x) for i, x in ids.items()}), (sequences, {})):
        for k, parts in spans.items():
            end = 0
            for start, n in sorted(parts):
                assert start == end
                end += n
            assert end == ends.get(k, end) and (spans is at or end <= 2_048)
    assert set(at) == set(found)
    used = sum(n for parts in sequences.values() for _, n in parts)
    assert used / (2_048 * len(sequences)) > 0.97


def test_tournament_is_first_fit():
    rng = random.Random(8)
    sizes = np.array(sorted((rng.randint(1, 100) for _ in range(300)), reverse=True))
    bins, offsets, free = [], [], []
    for s in sizes.tolist():
        b = next((i for i, f in enumerate(free) if f >= s), len(free))
        if b == len(free):
            free.append(100)
        bins.append(b)
        offsets.append(100 - free[b])
        free[b] -= s
    got = packing.first_fit_decreasing(sizes, 100)
    assert got[0].tolist() == bins and got[1].tolist() == offsets


def test_specials_are_ids():
    encode = packing.byte_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    bpe = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for t in ("", "a<|endoftext|>b", "it's  1234\n\n x   ", "日本 é \U0001f600", "<|endoftext|>"):
        assert encode(t).tolist() == bpe.encode(t, add_special_tokens=False).ids


def test_pfair_deviates_by_less_than_a_block():
    for weights in ({0: 5.0, 1: 3.0, 2: 1.0, 3: 0.5}, {i: 1.0 / (i + 1) for i in range(20)}):
        units = mixing.to_units(weights, 1_000)
        slots = mixing.edf_period(units, 1_000)
        assert sorted(s for x in slots.values() for s in x) == list(range(1_000))
        for k, u in units.items():
            served = np.cumsum(np.isin(np.arange(1_000), slots[k]))
            assert np.abs(served - (np.arange(1_000) + 1) * u / 1_000).max() < 1


def test_pfair_holds_against_the_given_weights():
    for weights in ({0: 1 / 3, **{i: 2 / 57 for i in range(1, 20)}}, {0: 1.0, 1: 1e-4, 2: 2**0.5, 3: 1e-30}):
        n, total = 40_000, sum(weights.values())
        order = np.fromiter(mixing.served({k: n for k in weights}, weights), np.int64, 4 * n)[:n]
        for k, w in weights.items():
            assert np.abs(np.cumsum(order == k) - np.arange(1, n + 1) * (w / total)).max() < 1


def test_mixture_over_many_slots(spark):
    """The whole path: one document a block, and more slots than a row of the schedule holds."""
    weights = {"a": 1 / 3, **{f"s{i}": 2 / 57 for i in range(19)}}
    source = [s for s, w in weights.items() for _ in range(int(w * 30_000))]
    docs = spark.createDataFrame(list(enumerate(source)), "doc_id long, source string")
    rows = mixing.mix(docs, weights, block_docs=1).toPandas().sort_values("slot")
    assert rows["slot"].tolist() == list(range(len(source))) and sorted(rows["doc_id"]) == list(range(len(source)))
    for s, w in weights.items():
        assert np.abs(np.cumsum(rows["source"] == s) - np.arange(1, len(rows) + 1) * w)[:29_000].max() < 1


def test_mixing_query_is_earliest_deadline_first(spark):
    """The query's own weights and blocks: in each slot the released block of the earliest deadline, phase by phase."""
    path = "/root/testdata/sf0.1"
    rows = queries.op7_mixing(spark, path).collect()
    counts = collections.Counter(r.source for r in table(spark, path, "documents").select("source").collect())
    assert collections.Counter(r.source for r in rows) == counts and len({(r.slot, r.in_block) for r in rows}) == len(rows)
    of = {r.slot: r.source for r in rows}
    names = sorted(counts)
    left = {s: -(-counts[s] // 64) for s in names}
    slot = 0
    while any(left.values()):
        live = [s for s in names if left[s]]
        total = sum(Fraction(counts[s] ** 0.5) for s in live)
        share, done, n = {s: Fraction(counts[s] ** 0.5) / total for s in live}, collections.Counter(), 0
        while all(left[s] for s in live):
            ready = [(-(-(done[s] + 1) // share[s]), s) for s in live if done[s] // share[s] <= n]
            s = min(ready)[1]
            assert of[slot] == s
            done[s] += 1
            left[s] -= 1
            n, slot = n + 1, slot + 1
    assert slot == len(of)


def test_many_sources(spark):
    """Sources beyond any number that could have a schedule of their own; each row has a place, every prefix its shares."""
    docs = spark.range(1_200).selectExpr("id AS doc_id", "CAST(id % 300 AS string) AS source", "'t' AS text")
    rows = mixing.mix(docs, block_docs=1).toPandas().sort_values("slot")
    assert rows["slot"].tolist() == list(range(1_200))
    for n in range(1, 1_200, 97):
        served = rows["source"][:n].value_counts().reindex(rows["source"].unique(), fill_value=0)
        assert (abs(served - n / 300) < 1).all()


def test_large_inputs_have_larger_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLOTS", 10)
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 2)
    docs = spark.range(1_000).selectExpr("id AS doc_id", "CAST(id % 3 AS string) AS source", "'t' AS text")
    rows = mixing.mix(docs).collect()
    assert len(rows) == 1_000 and max(r.slot for r in rows) < 13 and max(r.in_block for r in rows) == 99


def test_mixed_order_is_the_mixture(spark):
    """Partition after partition the rows come in the order of mix, with whole rows, odd columns and repeated ids."""
    docs = spark.range(3_000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'a', IF(id % 7 = 0, null, CAST(id % 5 AS string))) AS source", "repeat('t', CAST(id % 50 AS int)) AS text", "id AS `_mix_h`", "id AS slots", "id AS `a.b`")
    got = mixing.mixed_order(docs, block_docs=4).collect()
    assert [r.doc_id for r in got] == [r.doc_id for r in mixing.mix(docs, block_docs=4).orderBy("slot", "in_block").collect()]
    assert all(r["_mix_h"] == r.slots == r["a.b"] == r.doc_id for r in got) and len(got[0]) == 6
    twice = docs.unionByName(docs.where("doc_id < 100")).unionByName(docs.where("doc_id < 40"))
    got = mixing.mixed_order(twice, block_docs=4)
    assert got.columns == docs.columns and sorted(map(str, got.collect())) == sorted(map(str, twice.collect()))
    assert mixing.mixed_order(docs.limit(0)).collect() == [] == mixing.mix(docs.limit(0)).collect()


def test_mixture_of_documents(spark, data_dir):
    weights = {f"src{i}": 1.0 + i for i in range(20)}
    rows = mixing.mix(table(spark, data_dir, "documents"), weights, block_docs=2).collect()
    assert len(rows) == len({r.doc_id for r in rows}) == len({(r.slot, r.in_block) for r in rows}) == 200
    blocks = sorted({(r.slot, r.source) for r in rows})
    assert len(blocks) == 100
    totals = collections.Counter(s for _, s in blocks)
    share, served = {s: w / sum(weights.values()) for s, w in weights.items()}, collections.Counter()
    for n, (_, s) in enumerate(blocks, 1):
        served[s] += 1
        if served[s] == totals[s]:
            break
        assert all(abs(served[x] - n * share[x]) < 1.1 for x in share)  # units of 1/1000 are not quite the weights


def turned(pair, n):
    """A word of two letters in Thue-Morse order, of n letters."""
    word = pair[0]
    while len(word) < n:
        word += word.translate(str.maketrans(pair, pair[::-1]))
    return word


def test_counts_of_words_that_polynomials_confuse():
    path = public_tokenizers.path("word_bpe_49k.json")
    bpe = Tokenizer.from_file(path)
    some = [f"{turned(p, n)} {turned(p[::-1], n)}" for n in (1_024, 2_048) for p in ("ac", "xy", "th", "én", "日本")]
    rng = random.Random(5)
    some += ["".join(chr(rng.choice([rng.randint(0, 0x2FF), rng.randint(0x4E00, 0x9FFF), rng.randint(0x1F300, 0x1F6FF), 32])) for _ in range(rng.randint(0, 200))) for _ in range(1_000)]
    some += ["".join(rng.choice("ab\0é日\U0001f600'!. \t") for _ in range(rng.randint(0, 300))) for _ in range(500)]
    some += ["a" * n for n in range(200)]
    assert token_counts.count_tokens(some, path).tolist() == [len(x.ids) for x in bpe.encode_batch_fast(some, add_special_tokens=False)]


def test_full_tables_of_counts_start_anew(monkeypatch):
    monkeypatch.setattr(token_counts, "MAX_STATES", 50)
    monkeypatch.setattr(token_counts, "MAX_COUNTED", 20)
    path = public_tokenizers.path("word_bpe_49k.json")
    rng = random.Random(9)
    some = [" ".join("".join(rng.choice("etaoinsh") for _ in range(rng.randint(1, 14))) for _ in range(40)) for _ in range(20)]
    compiled = token_counts.Compiled(path)
    monkeypatch.setattr(token_counts, "compiled", lambda _: compiled)
    want = [len(x.ids) for x in Tokenizer.from_file(path).encode_batch_fast(some, add_special_tokens=False)]
    assert [int(token_counts.count_tokens([t], path)[0]) for t in some] == want


def test_one_endless_token_keeps_few_states(monkeypatch):
    monkeypatch.setattr(token_counts, "MAX_STATES", 300)
    path = public_tokenizers.path("word_bpe_49k.json")
    rng = random.Random(4)
    some = ["".join(rng.choice("etaoinshé") for _ in range(20_000)), "ab" * 9_000]
    emission = token_counts.Compiled(path).emission
    want = [len(x.ids) for x in Tokenizer.from_file(path).encode_batch_fast(some, add_special_tokens=False)]
    assert [emission.count(t.encode()) for t in some] == want
    assert len(emission.states) <= 302 and len(emission.steps) <= 300 * token_counts.STEPS_A_STATE + 1


@pytest.mark.parametrize("around", ["{}", "a{}b", "1{}' {}s"])
def test_every_code_point_counts_as_in_the_library(around):
    path = public_tokenizers.path("word_bpe_49k.json")
    some = [around.format(c, c) for c in map(chr, range(0x110000)) if not "\ud800" <= c <= "\udfff"]
    want = [len(x.ids) for x in Tokenizer.from_file(path).encode_batch_fast(some, add_special_tokens=False)]
    got = token_counts.count_tokens(some, path).tolist()
    assert [(ascii(t), a, b) for t, a, b in zip(some, got, want) if a != b] == []


def test_word_hashes_tell_words_apart():
    words = [turned(p, n) for n in (8, 16, 32, 64, 1_024) for p in ("ac", "ca", "én", "né")] + ["a" * n for n in range(1, 40)]
    text = " ".join(words)
    hashes, _ = textvec.words([text])
    assert len(set(hashes.tolist())) == len(set(words)) and (textvec.words([f"x {text}"])[0][1:] == hashes).all()


@pytest.mark.parametrize("lane", [3, 256])
def test_counts_equal_the_library(monkeypatch, lane):
    monkeypatch.setattr(token_counts, "LANE", lane)
    rng = random.Random(1)
    some = ["", "   ", "it's 'tis ''s 'rx 're're 'll'l 'lx 'v've v x'", "<|endoftext|> hi <|startoftext|>x<|endoftext|>", "ΣΑΣ İstanbul ﬁ Å", "'", "'r", "...'s", "日本語 한국어 عربى", "x​y \x1c a　b", "<|̸endoftext|>"]
    some += ["".join(rng.choice("'strevlmda1 .\n!é") for _ in range(rng.randint(0, 600))) for _ in range(60)]
    bpe = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = [len(x.ids) for x in bpe.encode_batch(some, add_special_tokens=False)]
    assert token_counts.count_tokens(some, public_tokenizers.path("word_bpe_49k.json")).tolist() == want


def test_counts_of_the_documents(spark, data_dir):
    bpe = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found = texts(spark, data_dir)
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op8_token_counts(spark, data_dir).collect()}
    want = {i: len(bpe.encode(t, add_special_tokens=False).ids) for i, t in found.items()}
    assert got == {i: (len(found[i].encode()), n, n > 2_048) for i, n in want.items()}


def test_archives(spark, data_dir, duck, same):
    same(queries.op9_warc(spark, data_dir).toPandas(), duck.execute(warc.ORACLE).df())


def test_payloads_come_back(spark, tmp_path):
    rows = [(1, "http://a/ b\r\nX: y", "p" * 2_000), (2, "http://a", "p" * 2_000), (3, None, None), (None, "u", "p" * 2_000), (4, "v", "PK\x05\x06" + "é" * 900), (4, "v", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.read_archives(warc.write_archives(df, f"file://{tmp_path}"), payloads=True).collect()
    found = sorted((str(r.page_id), r.record_type, r.refers_to, r.payload_bytes, bytes(r.payload).decode()) for r in got)
    assert found == sorted([("1", "revisit", 2, 2_000, ""), ("2", "response", None, 2_000, "p" * 2_000), ("3", "response", None, 0, ""), ("None", "revisit", 2, 2_000, ""), ("4", "response", None, 1_804, rows[4][2]), ("4", "response", None, 1, "x")])


def test_one_task_writes_many_packages(spark, tmp_path):
    rows = [(i, f"http://a/{i}", f"page {i} " * 20) for i in range(50)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    manifest = warc.write_archives(df, f"file://{tmp_path}", package_bytes=900)
    assert manifest.count() > 5 and sum(r.records for r in manifest.collect()) == len(rows)
    got = warc.read_archives(manifest, payloads=True).collect()
    assert sorted((r.page_id, bytes(r.payload).decode()) for r in got) == [(i, html) for i, _, html in rows]


def test_zip_directories(tmp_path):
    import io
    import struct
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.comment = b"PK\x05\x06 in a comment"
        z.writestr("a", b"hello")
        z.writestr(zipfile.ZipInfo("b"), b"x" * 10, zipfile.ZIP_DEFLATED)
    raw = out.getvalue()
    found = zipdir.members(io.BytesIO(raw), len(raw))
    f = io.BytesIO(raw)
    assert zipdir.read_range(f, zipdir.data_offset(f, found["a"]), 1, 3) == b"ell"
    with pytest.raises(ValueError):
        zipdir.data_offset(f, found["b"])
    with pytest.raises(ValueError):
        zipdir.members(io.BytesIO(b"no archive at all"), 17)
    # The same archive with a ZIP64 end: directory place and size only in the wide record.
    end = raw.rindex(b"PK\x05\x06", 0, raw.rindex(b"PK\x05\x06"))
    count, size, offset = struct.unpack_from("<HII", raw, end + 10)
    wide = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, count, count, size, offset)
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, end, 1)
    tail = struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    again = raw[:end] + wide + locator + tail
    assert zipdir.members(io.BytesIO(again), len(again)).keys() == {"a", "b"}
