"""Operators 1, 2 and 5: held-out accuracy, recall, and odd rows."""

import random

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.llm import additive_search, learning, rule_ensemble, toxicity

BAD = ["idiot", "moron", "scum", "loser"]


def texts(n, seed):
    rng = random.Random(seed)
    syllables = ["an", "the", "er", "ing", "on", "re", "ti", "of", "ha", "nd"]
    out = []
    for k in range(n):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(20, 80))]
        toxic = k % 3 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(BAD)
        out.append((" ".join(words), int(toxic)))
    return out


def test_toxicity_on_held_out_text():
    scorer = toxicity.Scorer(toxicity.fit(texts(600, 1)))
    held = texts(300, 2)
    right = [(scorer.score(t) >= toxicity.THRESHOLD) == bool(y) for t, y in held]
    assert np.mean(right) > 0.95
    assert 0 <= scorer.score("") <= 1


def test_toxicity_without_labels():
    assert toxicity.Scorer(toxicity.fit([])).score("any") < 0.01
    assert toxicity.Scorer(toxicity.fit([("a", 1)])).score("any") > 0.99


def test_toxicity_query_shape(spark):
    docs = spark.createDataFrame([(k, t, "x") for k, (t, _) in enumerate(texts(40, 3))] + [(None, "a", "x"), (99, None, "x"), (1, "twice", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, y, y) for k, (_, y) in enumerate(texts(40, 3))] + [(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity.score(docs, toxicity.fit_on(docs, labels)).collect()
    assert len(rows) == 43 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert toxicity.score(docs.limit(0), toxicity.fit_on(docs.limit(0), labels)).count() == 0


def test_toxicity_is_fitted_on_whole_texts(spark):
    """What marks toxic text stands behind 20,000 characters of ordinary text."""
    front = " ".join(t for t, y in texts(200, 4) if not y)
    assert len(front) > 20_000
    rows = [(k, f"{front} {t}", y) for k, (t, y) in enumerate(texts(90, 5))]
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit_on(docs, labels)
    scorer = toxicity.Scorer(model)
    assert all(w.encode() in model.toxic for w in BAD)
    assert np.mean([(scorer.score(t) >= 0.5) == bool(y) for _, t, y in rows]) > 0.9


def test_ordinary_base_is_trained_on_whole_texts():
    """Ordinary words behind the 240th of every text reach the base."""
    rng = random.Random(8)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(8))
    front, tail = [word("abcdefghijklm") for _ in range(200)], [word("nopqrstuvwxyz") for _ in range(200)]
    ordinary = [" ".join([*rng.choices(front, k=240), *rng.choices(tail, k=240)]) for _ in range(200)]
    base, _ = toxicity.train_dictionaries(["a b c"] * 10, ordinary)
    assert np.mean([w.encode() in base for w in front]) > 0.9 and np.mean([w.encode() in base for w in tail]) > 0.9


def test_held_out_labels_are_never_used(spark):
    labels = spark.range(300).select(F.col("id").alias("doc_id"), F.lit(1).alias("toxic"))
    used = learning.labelled_ids(labels, "toxic", learning.id_bucket(F.col("doc_id"), 3) != 1, 1000)
    assert used.where(learning.id_bucket(F.col("doc_id"), 3) == 1).count() == 0 and used.count() > 0


def low_quality(k):
    rng = random.Random(k)
    return " ".join(rng.choice(["###", "%%%", "a&&&", "BUY!!", "$$$"]) for _ in range(60))


def test_rule_ensemble_on_held_out_text(spark):
    def data(n, seed):
        good = [(t, 1) for t, _ in texts(n, seed)]
        return good + [(low_quality(seed * 1000 + k), 0) for k in range(n // 4)]

    train, held = data(200, 5), data(100, 6)
    x, y = np.array([rule_ensemble.statistics_of(t) for t, _ in train]), np.array([float(v) for _, v in train])
    ensemble = rule_ensemble.fit(x, y)
    assert 0 < len(ensemble.rules) < 200 and ensemble.text()
    docs = spark.createDataFrame([(k, t, "c") for k, (t, _) in enumerate(held)] + [(None, None, "c"), (0, "", "c")], "doc_id long, text string, s string")
    found = {r.doc_id: r for r in rule_ensemble.score(docs.where("text <> ''"), ensemble).collect()}
    assert np.mean([(found[k].predicted == v) for k, (_, v) in enumerate(held)]) > 0.97
    by_hand = {k: float(learning.sigmoid(rule_ensemble.holds(ensemble.rules, np.array([rule_ensemble.statistics_of(t)])) @ np.array(ensemble.weights) + ensemble.bias)[0]) for k, (t, _) in enumerate(held)}
    assert all(abs(found[k].score - v) < 1e-9 for k, v in by_hand.items())
    kept = rule_ensemble.keep_good(docs, ensemble)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count() + 1
    assert rule_ensemble.score(docs, ensemble).count() == docs.count()


def test_one_class_only():
    e = rule_ensemble.fit(np.zeros((5, len(rule_ensemble.STATISTICS))), np.ones(5))
    assert not e.rules and e.bias > 5


def test_additive_search_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 16))
    rows = [(k, [float(v) for v in r]) for k, r in enumerate(x)] + [(7001, None), (7002, [0.0] * 16), (7003, [float("nan")] * 16), (7004, [None] * 16), (7005, [1.0] * 3), (None, [1.0] * 16), (7006, [])]
    rows += [(8000 + k, [float(v) for v in x[5]]) for k in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = additive_search.search(df, lambda v: v % 100 == 0, k=5, levels=4, codes=32).toPandas()
    ids, all_x = np.array([*range(3000), *range(8000, 8030)]), np.vstack([x, np.repeat(x[5:6], 30, 0)])
    hits = total = 0
    for q, g in found.groupby("query_id"):
        g = g.sort_values("rank")
        s = all_x @ all_x[ids == q][0]
        s[ids == q] = -np.inf
        best = np.lexsort((ids, -s))[:5]
        hits, total = hits + len(set(ids[best]) & set(g.vec_id)), total + 5
        assert g["rank"].tolist() == [1, 2, 3, 4, 5] and q not in set(g.vec_id)
        assert np.allclose(g.score, [s[ids == v][0] for v in g.vec_id])
    assert set(found.query_id) == {*range(0, 3000, 100), 8000} and hits / total >= 0.9
    own = found[found.query_id == 8000].sort_values("rank").vec_id.tolist()
    assert own == [5, 8001, 8002, 8003, 8004]
    assert additive_search.search(df.limit(0), lambda v: v == 0).count() == 0
    few = additive_search.search(df.where("vec_id < 3"), lambda v: v == 0, k=20).collect()
    assert len(few) == 2


def test_labels_meet_any_other_columns(spark):
    """Columns of documents may be called like those of the labelled sample."""
    docs = spark.createDataFrame([(k, t, 0, 1, "c") for k, (t, _) in enumerate(texts(60, 3))], "doc_id long, text string, y int, half int, s string")
    labels = spark.createDataFrame([(k, y, 1 - y, 5) for k, (_, y) in enumerate(texts(60, 3))], "doc_id long, toxic int, quality int, y int")
    assert toxicity.score(docs, toxicity.fit_on(docs, labels)).count() == 60
    ensemble = rule_ensemble.fit_on(docs, labels)
    assert rule_ensemble.score(docs, ensemble).count() == 60
    assert rule_ensemble.keep_good(docs, ensemble).columns == docs.columns


def test_both_dictionaries_are_trained_on_their_class():
    sample = texts(600, 1)
    ordinary, toxic = toxicity.train_dictionaries([t for t, y in sample if y], [t for t, y in sample if not y])
    assert all(w.encode() in toxic for w in BAD) and not any(w.encode() in ordinary for w in BAD)
    assert ordinary[: len(toxicity.ANCHOR) + 4000] == toxic[: len(toxicity.ANCHOR) + 4000]


def test_margins_reach_the_end_of_a_window():
    """A marking word saves as much at the end of a window as in its middle."""
    sample = texts(600, 1)
    scorer = toxicity.Scorer(toxicity.Model(*toxicity.train_dictionaries([t for t, y in sample if y], [t for t, y in sample if not y]), [0.0] * (toxicity.N_FEATURES + 1)))
    assert all(scorer.margins(t)[0] >= 2 for t in ("the on idiot of", "the on of idiot"))


def test_search_counts_an_id_once(spark):
    """Repeated rows, ids with several vectors, and clustered vectors, whose queries visit few cells."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16))
    x = np.repeat(centres, 100, 0) + 0.1 * rng.normal(size=(4000, 16))
    rows = [(k, [float(v) for v in r], "c") for k, r in enumerate(x)]
    df = spark.createDataFrame([*rows, *rows[:50], (3, [9.0] * 16, "c")], "vec_id long, embedding array<float>, cell string")
    found = additive_search.search(df, lambda v: v % 50 == 0, k=10, levels=4, codes=32).toPandas()
    assert (found.groupby("query_id").vec_id.nunique() == 10).all() and not (found.query_id == found.vec_id).any()
    f = x.astype(np.float32).astype(float)
    f[3] = min(f[3].tolist(), [9.0] * 16)
    hits = 0
    for q, g in found.groupby("query_id"):
        s = f @ f[q]
        s[q] = -np.inf
        hits += len(set(np.lexsort((np.arange(4000), -s))[:10]) & set(g.vec_id))
        assert np.allclose(g.score, s[g.vec_id])
    assert found.query_id.nunique() == 80 and hits >= 0.9 * 800
    assert additive_search.cells_to_visit(f, additive_search.fit_cells(f), 10) < 16


def share_found(found, x, ids, queries, k):
    """The least share of a query's k nearest, by score, that was found."""
    shares = []
    for q in queries:
        s = additive_search.exact_scores(x, x[ids == q][0])
        s[ids == q] = -np.inf
        mine = found[found.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == [*range(1, k + 1)] and q not in set(mine.vec_id)
        assert mine.score.tolist() == [s[ids == v][0] for v in mine.vec_id]
        shares.append(len(set(ids[np.lexsort((ids, -s))[:k]]) & set(mine.vec_id)) / k)
    return min(shares)


def test_queries_unlike_the_other_vectors_find_theirs(spark):
    """Tight clusters need few cells; the queries among them have no structure and need many."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(20, 16))[rng.integers(20, size=4000)] + 0.05 * rng.normal(size=(4000, 16))
    x[::50] = rng.normal(size=(80, 16))
    df = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "vec_id long, embedding array<double>")
    found = additive_search.search(df, lambda v: v % 50 == 0, k=10, levels=4, codes=32).toPandas()
    assert found.query_id.nunique() == 80 and share_found(found, x, np.arange(4000), range(0, 4000, 50), 10) >= 0.9


def test_dimensions_are_searched_each_by_itself_and_at_any_scale(spark):
    rng = np.random.default_rng(6)
    sets = {0: rng.normal(size=(1500, 16)) * 1e-25, 2000: rng.normal(size=(600, 12)), 4000: rng.normal(size=(3, 5))}
    df = spark.createDataFrame([(first + k, [float(v) for v in r]) for first, x in sets.items() for k, r in enumerate(x)], "vec_id long, embedding array<double>")
    found = additive_search.search(df, lambda v: v % 50 == 0, k=5, levels=4, codes=32).toPandas()
    assert set(found.query_id) == {*range(0, 1500, 50), *range(2000, 2600, 50), 4000} and (found.query_id == 4000).sum() == 2
    for first in (0, 2000):
        ids = first + np.arange(len(sets[first]))
        assert share_found(found, sets[first], ids, range(first, int(ids[-1]) + 1, 50), 5) >= 0.8


def test_no_cell_holds_more_than_its_bound():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(2000, 8)) * np.exp(rng.normal(size=(2000, 1)))
    book = additive_search.fit_cells(x, 16)
    own, queries = additive_search.own_cell(x, book), additive_search.unit(rng.normal(size=(200, 8)))
    along = (x * book[own]).sum(1)
    across = np.linalg.norm(x - along[:, None] * book[own], axis=1)
    projected = np.outer(along, np.cos(additive_search.ANGLES)) + np.outer(across, np.sin(additive_search.ANGLES))
    bounds = additive_search.cell_bounds(queries, book, np.array([projected[own == c].max(0) for c in range(len(book))]))
    scores = np.array([[(x[own == c] @ q).max() for c in range(len(book))] for q in queries])
    assert (scores <= bounds).all() and (bounds - scores).min() < 1


def test_long_samples_are_trained_on_in_parts():
    from ledgerloom.llm import toxicity as X

    whole = b" ".join(b"word%d" % k for k in range(3000)) + b"y" * 10_000
    parts = X.in_parts(whole, 512)
    assert b"".join(parts) == whole and max(map(len, parts)) <= 512
    assert X.in_parts(b"") == [b""] and X.in_parts(b" short") == [b" short"]
    # one long toxic text marks as much as it would in short ones
    marks = [f"mark{k:03d}ed" for k in range(600)]
    toxic = [" ".join([*marks, "plain words here"])] * 8
    keep = X.kept_grams(X.gram_counts(toxic), X.gram_counts(["plain words here"] * 50), len(toxic), 50)
    held = b" ".join(X.in_parts(X.runs_of(toxic[0], keep)))
    assert len(held) > X.SAMPLE_BYTES and all(m.encode() in held.replace(b"  ", b" ") or m[:4].encode() in held for m in marks)
    assert X.trained([b"few"], 2048, 32, 8) == b"few" and X.trained([b"ab" * 2000, b"c"], 64, 32, 8).endswith(b"c")
