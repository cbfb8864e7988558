import random

from pyspark.sql import functions as F

from lanecost.llm import nearcopies, prefixes, simhash

from .helpers import words
from .test_near_copies import bits
from .test_near_copies_by_shingles import jaccard


def sets_of(texts, size):
    return {k: nearcopies.shingles(t, size).view("int64").tolist() for k, t in enumerate(texts)}


def group(n, most, seed="g"):
    """Near copies of one text with 1 to ``most`` own words each, and strangers."""
    base, out = words(seed, 150, 4_000), []
    for k in range(n):
        rng, own = random.Random(f"{seed}{k}"), list(base)
        for place in rng.sample(range(150), 1 + k % most):
            own[place] = f"e{k}x{place}"
        out.append(" ".join(own[: 150 - k % 7]))
    return out + [" ".join(words(f"s{k}", 40 + k, 300)) for k in range(60)]


def test_all_like_pairs_of_different_components_and_few_others(spark):
    texts = group(300, 60)
    sets = sets_of(texts, 2)
    rows = [(k, h, k % 5 if k < 20 else k) for k, h in sets.items()]
    rows.append((1000, [], 1000))
    got = [(r.a, r.b) for r in prefixes.apart(spark.createDataFrame(rows, "fp long, hashes array<long>, root long"), 0.8).collect()]
    root = {k: r for k, _, r in rows}
    like = {(a, b) for a in sets for b in sets if a < b and root[a] != root[b]
            and 10 * len(set(sets[a]) & set(sets[b])) >= 8 * len(set(sets[a]) | set(sets[b]))}
    assert len(like) > 100 and like <= set(got) and len(got) == len(set(got)) and all(a < b for a, b in got)
    assert len(got) < 4 * len(like) < 300 * 299 / 20
    assert prefixes.apart(spark.createDataFrame([], "fp long, hashes array<long>, root long"), 0.8).count() == 0


def test_texts_like_a_whole_component_do_not_meet_all_of_it(spark):
    """One link joins a text to a component of many texts that are all like it; chains over several components stay whole."""
    rng, base = random.Random(9), [rng_word * 7 + 1 for rng_word in range(200)]
    sets = {k: sorted({*base[: 190 + k % 9], *rng.sample(range(10 ** 6, 10 ** 9), 2), *(5 * 10 ** 5 + x for x in range(k % 4))}) for k in range(120)}
    sets |= {500 + k: sorted({*base[: 150 + k], -1 - k, -2 - k}) for k in range(6)}
    rows = [(k, h, 0 if k < 90 else k) for k, h in sets.items()]
    asked = []

    def confirmed(pairs):
        found = [(r.a, r.b) for r in pairs.collect()]
        asked.append(len(found))
        like = [(a, b) for a, b in found if 10 * len({*sets[a]} & {*sets[b]}) >= 8 * len({*sets[a]} | {*sets[b]})]
        return spark.createDataFrame(like, "a long, b long")

    table = spark.createDataFrame(rows, "fp long, hashes array<long>, root long")
    links = [(r.a, r.b) for r in prefixes.linked(table, 0.8, confirmed).collect()]
    root = {k: r for k, _, r in rows}
    by_all = dict(root)
    for found, of in ((links, root), ([(a, b) for a in sets for b in sets if a < b and 10 * len({*sets[a]} & {*sets[b]}) >= 8 * len({*sets[a]} | {*sets[b]})], by_all)):
        for a, b in found:
            low, high = sorted((of[a], of[b]))
            of.update({k: low for k, r in of.items() if r == high})
    assert root == by_all and len(set(root.values())) < 10
    assert 0 < sum(asked) < prefixes.apart(table, 0.8).count() / 3
    empty = spark.createDataFrame([], "fp long, hashes array<long>, root long")
    assert prefixes.linked(empty, 0.8, confirmed).count() == 0


def test_near_copies_that_are_not_alike_are_not_compared_pair_by_pair(spark, monkeypatch):
    """A large group around one text of which many members differ too much to be linked."""
    asked = []
    verified = nearcopies._verified
    monkeypatch.setattr(nearcopies, "_verified", lambda pairs, *more: asked.append(pairs.count()) or verified(pairs, *more))
    n = 200
    texts = group(n, 9)
    rows = [(k, t) for k, t in enumerate(texts)]
    got = {r.doc_id: r.component_id for r in nearcopies.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    root = {k: k for k in got}
    for a in range(n):  # union by brute force
        for b in range(a):
            if root[a] != root[b] and jaccard(texts[a], texts[b]) >= 0.8:
                low, high = sorted((root[a], root[b]))
                root = {k: low if r == high else r for k, r in root.items()}
    assert got == root and len(set(root.values())) > 60 + n // 5
    assert 0 < asked[1] < n * (n - 1) / 2 / 50


def test_centre_is_the_text_that_meets_most_others(spark):
    rows = [(1, 7, 3, "x"), (1, 8, 3, "y"), (1, 9, 3, "z"), (2, 8, 2, "y"), (2, 9, 2, "z"), (3, 8, 2, "y"), (3, 7, 2, "x")]
    got = prefixes.to_centre(spark.createDataFrame(rows, "key long, fp long, many long, what string"))
    assert {(r.key, r.fp, r.centre.fp, r.centre.what) for r in got.collect()} == {(k, f, 8, "y") for k, f, _, _ in rows}


def test_fingerprints_within_three_bits_share_a_key():
    rng = random.Random(5)
    for _ in range(200):
        a = rng.getrandbits(63)
        b = a
        for bit in rng.sample(range(63), 3):
            b ^= 1 << bit
        assert set(simhash.index_keys(a).tolist()) & set(simhash.index_keys(b).tolist())
    text = " ".join(words(1, 80, 10_000))
    found = [simhash.xxhash.xxh64_intdigest(" ".join(text.split()[i : i + 3]).encode(), 42) for i in range(78)]
    assert simhash.of_hashes(nearcopies.np.array(found, "uint64")) == simhash.fingerprint(text) == bits(text) - (bits(text) >> 63 << 64)
    assert len(set(simhash.index_keys(-1).tolist())) == 10


def test_near_copies_meet_by_fingerprints(spark, monkeypatch):
    """Without a key of MinHash, the multi-index of fingerprints still finds what differs in few bits."""
    monkeypatch.setattr(nearcopies, "keys", lambda hashes: nearcopies.np.zeros(0, nearcopies.np.int64))
    monkeypatch.setattr(nearcopies, "BANDS", 0)
    own = words("fp", 400, 9_000)
    rows = [(1, " ".join(own)), (2, " ".join([*own[:399], "x"])), (3, " ".join(words("other", 400, 9_000))), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", F.col("text"))
    assert {r.doc_id: r.component_id for r in nearcopies.groups(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_texts_of_a_key_meet_however_far_they_are_from_its_centre(spark, monkeypatch):
    """Two pairs and strangers share one key and no other; what is unlike the text in the middle is still compared."""
    monkeypatch.setattr(nearcopies, "keys", lambda hashes: nearcopies.np.array([7], nearcopies.np.int64))
    monkeypatch.setattr(nearcopies, "BANDS", 0)
    bits_of = lambda t: simhash.of_hashes(nearcopies.shingles(t, 5))
    rows = [(100 + k, " ".join(words(f"stranger{k}", 200, 9_000))) for k in range(3)]
    for pair in range(2):
        own = words(f"pair{pair}", 200, 9_000)
        found = None
        for places in range(1, 150):  # at 0.8 or more, and no two blocks of the fingerprint in common
            edited = " ".join("edit" if k in (places, places + 30) else w for k, w in enumerate(own))
            if not {*simhash.index_keys(bits_of(" ".join(own))).tolist()} & {*simhash.index_keys(bits_of(edited)).tolist()}:
                found = edited
        assert found and jaccard(" ".join(own), found) >= 0.8
        rows += [(2 * pair, " ".join(own)), (2 * pair + 1, found)]
    got = {r.doc_id: r.component_id for r in nearcopies.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 100: 100, 101: 101, 102: 102}
