"""Ball k-means, multiset fingerprints and the conversation trie, against SQL and brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerloom.llm import ball_kmeans, multiset_hash, prefix_trie, registry
from tests.test_catalogue import FOLDER, rows_of


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, duck, name):
    ours = rows_of(registry.QUERIES[name](spark, FOLDER).toPandas())
    theirs = rows_of(duck(FOLDER).execute(registry.ORACLES[name]).df())
    assert ours[0] == theirs[0]
    assert ours[1] == theirs[1]


def plain_kmeans(vectors, k, rounds):
    """(cluster, distance) of each (vec_id, components), by comparing everything in Python's whole numbers."""
    first = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in vectors if i is not None)[:k]
    centroids = [list(v) for _, v in first]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in vectors]
        for n in range(len(centroids)):
            mine = [v for (_, v), c in zip(vectors, of) if c == n]
            if mine:
                centroids[n] = [sum(x) // len(mine) for x in zip(*mine)]
    return sorted((-1 if i is None else i, n, d) for (i, v) in vectors for d, n in [nearest(v)])


@pytest.mark.parametrize("seed", range(3))
def test_ball_kmeans_on_a_grid_of_ties(spark, seed):
    rng = np.random.default_rng(seed)
    vectors = [(int(i), [int(x) for x in rng.integers(-3, 4, 2)]) for i in range(120)] + [(500 + i, [2, -1]) for i in range(60)] + [(7, [3, 3]), (7, [3, 3]), (None, [1, 1]), (900, [-ball_kmeans.LARGEST + 1, ball_kmeans.LARGEST - 1])]
    found, _ = ball_kmeans.ball_kmeans(spark.createDataFrame(vectors, "vec_id long, v array<int>").repartition(5), 6, 4)
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance) for r in found.collect()) == plain_kmeans(vectors, 6, 4)


def test_stable_cores_and_annuli_leave_most_comparisons_out():
    centroids = np.array([[0, 0], [100, 0], [0, 1000]])
    balls = ball_kmeans.Balls(centroids, [60, 40, 10], np.array([True, False, False]))
    assert [ring for _, ring in balls.rings] == [[1], [], []] and balls.still == [False, True, True]
    own, distance = balls.assign(np.array([[49, 0], [50, 0], [51, 0], [30, 0]]), np.array([0, 0, 0, 1]), np.array([0, 0, 0, 4900]))
    assert own.tolist() == [0, 0, 1, 1] and distance.tolist() == [2401, 2500, 2401, 4900]


def test_vectors_that_take_no_part(spark):
    rows = [(1, [0.5] * 64, "x"), (2, None, "x"), (3, [0.5] * 63, "x"), (4, [math.nan] + [0.5] * 63, "x"), (5, [math.inf] + [0.5] * 63, "x"), (6, [None] + [0.5] * 63, "x"), (7, [2e5] + [0.5] * 63, "x"), (8, [-0.0004] * 64, "x"), (8, [-0.0004] * 64, "x")]
    docs = spark.createDataFrame(rows, "vec_id int, embedding array<double>, cluster string")
    kept = ball_kmeans.whole_vectors(docs)
    assert sorted((r.vec_id, r.v[0], len(r.v)) for r in kept.collect()) == [(1, 512, 64), (8, -1, 64), (8, -1, 64)]
    out = ball_kmeans.with_inertia(*ball_kmeans.ball_kmeans(kept)).collect()
    assert len(out) == 3 and {r.inertia for r in out} == {0} and {r.vec_id for r in out if r.cluster != min(x.cluster for x in out if x.vec_id == r.vec_id)} == set()
    assert ball_kmeans.with_inertia(*ball_kmeans.ball_kmeans(kept.where("false"))).collect() == []


def plain_trie(rows):
    """(conv_id, depth) to the rest of each node's row, by whole prefixes in a dictionary."""
    own = {}
    said = lambda r, t: hashlib.sha256(f"{len(r)}:{r}{t}".encode()).digest()
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, said(role or "", text or ""), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    members, ends = {}, {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole = (*own.get(c - int(math.fmod(c, 100)), [])[:h], *turns[h:])
        for d in range(len(whole) + 1):
            members.setdefault(whole[:d], []).append(c)
        ends.setdefault(whole, []).append(c)
    children = {n: [m for m in members if len(m) == len(n) + 1 and m[: len(n)] == n] for n in members}
    out = {}
    for n, m in members.items():
        below = [u for u in members if u[: len(n)] == n]
        saved = sum((len(members[u]) - 1) * len(u[-1][1]) for u in below if u)
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(n, [])))).encode()).hexdigest()
        out[min(m), len(n)] = (min(members[n[:-1]]) if n else None, len(m), len(children[n]), sum(not children[u] for u in below), saved, digest)
    return out


def trie_rows(df):
    return {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()}


@pytest.mark.parametrize("seed", range(2))
def test_trie_against_whole_prefixes(spark, monkeypatch, seed):
    monkeypatch.setattr(prefix_trie, "BLOCK", 3)
    rng = np.random.default_rng(seed)
    rows = [(int(c), None if rng.random() < 0.1 else int(rng.integers(0, 5)), [None, "user", "assistant"][rng.integers(3)], [None, "", "ä\U0001f600", "no"][rng.integers(4)]) for c in rng.choice([*range(-3, 6), 100, 101, 102, 103, 200, 205, 399], 120)]
    rows += [(103, 9, "user", "again")] * 17 + [(c, 1, "user", "alike") for c in range(600, 640)] + [(None, 1, "user", "nobody"), (205, None, None, None)]
    rows += [(300, t, "user", "deep" * (t % 2)) for t in range(30)]
    found = prefix_trie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("key", F.lit("clash")).withColumn("d", F.lit(1)).repartition(4))
    assert found.count() == len(trie_rows(found)) and trie_rows(found) == plain_trie(rows)


def test_trie_of_few_rows(spark):
    rows = spark.createDataFrame([(8, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    assert prefix_trie.prefix_trie(rows.where("false")).collect() == []
    # h of 8 is above 0 and its base is absent, so its one turn goes and a member of the root is left
    assert zlib.crc32(b"8") % 6 > 0 and trie_rows(prefix_trie.prefix_trie(rows)) == {(8, 0): (None, 1, 0, 1, 0, hashlib.sha256(b"8").hexdigest())}


def test_digests_from_pieces(spark):
    rows = spark.createDataFrame([("a" if i % 3 else "b", i - 50) for i in range(300)], "key string, conv_id long").repartition(7)
    parts = prefix_trie.pieces(rows, 40)
    assert parts.count() > 20 and max(len(r.piece) for r in parts.collect()) < 50
    for key, sha in prefix_trie.digests(parts).collect():
        assert sha == hashlib.sha256(",".join(str(i - 50) for i in range(300) if ("a" if i % 3 else "b") == key).encode()).hexdigest()


def plain_vector(text):
    """A fingerprint's components, one paragraph at a time: 16 words of SHA-512, 60 counts of bits, the count of pieces."""
    exact, bits, n = [0] * 16, [[0] * 4 for _ in range(15)], 0
    for paragraph in text.split("\n"):
        d = hashlib.sha512(paragraph.encode()).hexdigest()
        exact = [(x + int(d[8 * i : 8 * i + 8], 16)) % 2**32 for i, x in enumerate(exact)]
        for piece in re.findall(r"(?a:(?:[^\s.,;:!?]++[ \t]++){0,3}+\S++)", paragraph):
            h, n = xxhash.xxh64_intdigest(piece.encode(), seed=42), n + 1
            for i in range(15):
                for j in range(4):
                    bits[i][j] += h >> (i + 15 * j) & 1
    return [*exact, *(sum(b << 15 * j for j, b in enumerate(four)) % 2**60 for four in bits), n], [2 * b - n for four in bits for b in four]


def plain_likeness(a, b):
    (va, sa), (vb, sb) = plain_vector(a), plain_vector(b)
    both, apart = sum(x * x for x in sa + sb), sum((x - y) ** 2 for x, y in zip(sa, sb))
    return 1.0 if va == vb else max(0.0, min(1.0, (both - apart) / both)) if both else 0.0


def plain_print(text):
    v = plain_vector(text)[0]
    return "".join(f"{x:0{15 if 16 <= i < 31 else 8}x}" for i, x in enumerate(v))


TEXTS = ["", "a", "one two three four five, six seven.\nnext line here", "next line here\none two three four five, six seven.", "\n\n", "\U0001f600ab\u00e9 \u00e9", "x " * 3000 + "\n" + "y, " * 40, "w" * 5000]


def test_fingerprints_against_plain_sums(spark):
    pairs = [(a, b) for a in TEXTS for b in TEXTS]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", multiset_hash.vector(F.col("a")).alias("va"), multiset_hash.vector(F.col("b")).alias("vb"))
    both = multiset_hash.combined(F.col("va"), F.col("vb"))
    found = df.select("a", "b", "va", multiset_hash.fingerprint(F.col("va")).alias("print"), multiset_hash.likeness(F.col("va"), F.col("vb")).alias("near"), (both == multiset_hash.vector(F.concat("a", F.lit("\n"), "b"))).alias("adds"), (multiset_hash.combined(both, F.col("vb"), -1) == F.col("va")).alias("takes")).collect()
    for r in found:
        assert r.va == plain_vector(r.a)[0] and r.print == plain_print(r.a) and r.adds and r.takes
        assert r.near == pytest.approx(plain_likeness(r.a, r.b), abs=1e-12)
    prints = {t: plain_print(t) for t in TEXTS}
    assert prints[TEXTS[2]] == prints[TEXTS[3]] and len(set(prints.values())) == len(TEXTS) - 1


def test_likeness_follows_what_two_texts_share(spark):
    rng = np.random.default_rng(5)
    lines = [" ".join(map(str, rng.integers(0, 10**6, 4))) for _ in range(3000)]
    rows = [("\n".join(lines[:1000]), "\n".join(lines[1000 - k : 2000 - k]), k / 1000) for k in (0, 250, 500, 750, 1000)]
    out = spark.createDataFrame(rows, "a string, b string, share double").select("share", multiset_hash.likeness(multiset_hash.vector(F.col("a")), multiset_hash.vector(F.col("b"))).alias("near")).collect()
    assert all(abs(r.share - r.near) < 0.3 for r in out) and out[-1].near == 1.0


def test_documents_follow_each_other(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "another under three\n"), (None, "no id"), (40, None), (41, "said twice again"), (41, "said twice again"), (41, "said twice again"), (2**40, "the last one of them")]
    docs = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, key string, need int").repartition(5)
    found = multiset_hash.fingerprints(docs)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    order = sorted(((r[0] is not None, r[0] or 0, hashlib.sha256(f"{'-' if r[0] is None else r[0]}:{r[1] or ''}".encode()).hexdigest()), r[0], r[1] or "") for r in rows)
    want = []
    for (_, i, t), (_, _, after) in zip(order, order[1:] + order[:1]):
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        want.append((i, len(t), sha(edited), plain_print(t), plain_print(edited), round(plain_likeness(t, edited), 9), round(plain_likeness(t, after), 9)))
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in found.collect()) == Counter(want)
    one = multiset_hash.fingerprints(docs.where("doc_id = 2")).first()
    assert one.near_next == 1.0 and one.edited_sha256 == sha(TEXTS[2][: len(TEXTS[2]) - len(TEXTS[2]) // 2] + TEXTS[2][: len(TEXTS[2]) // 2])
    assert multiset_hash.fingerprints(docs.where("false")).collect() == []
