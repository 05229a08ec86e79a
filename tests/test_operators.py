"""Cases by hand and properties of operators that SQL cannot check."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from phrasemine.functions import scratch
from phrasemine.functions import text as X
from phrasemine.operators import alike, annotate, clean, cluster, graph, relate, scoring, state, templates, tokens, vectors
from phrasemine.sources import files
from phrasemine.streaming import rounds


def column(spark, values, f, kind="string"):
    """f of one column, in the order of the values."""
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in d.orderBy("i").select(f(F.col("x"))).collect()]


def test_clean_phrase(spark):
    cases = {"  Best   Running\tShoes ": "best running shoes", "123": None, "": None, "  ": None, "a" * 256: None, "a" * 255: "a" * 255, "ééé a": None, "ab éé": "ab éé", "a   b": "a b", None: None, "x-1": "x-1"}
    assert column(spark, list(cases), X.clean_phrase) == list(cases.values())


def test_clean_seed_and_numbers(spark):
    assert column(spark, [" Shoes ", None, "", "s" * 101], X.clean_seed) == ["shoes", "unknown", "unknown", "unknown"]
    assert column(spark, ["3.9", "x", None, "-2"], lambda c: X.to_long(c, 1)) == [3, 1, 1, -2]


def test_tokens(spark):
    got = column(spark, ["Best E-Mail tool, for 2024!", "the of", "", None], X.tokens)
    assert got[0] == ["best", "e-mail", "mail", "tool"] and got[1] == [] and got[2] == [] and got[3] is None


def test_nine_phrases(spark):
    """Seeds of each n-gram, counted over phrases that share words."""
    p = ["buy running shoes", "best running shoes", "running shoes sale", "trail running shoes", "running watch", "gps running watch", "best watch", "cheap watch", "buy cheap watch"]
    d = spark.createDataFrame([(i, x, "shoes" if "shoes" in x else "watch") for i, x in enumerate(p)], "phrase_id long, phrase string, seed_word string")
    got = {r.word: (r.frequency, r.seeds) for r in tokens.segment_unified(d).collect()}
    assert got["running shoes"] == (4, ["shoes"]) and got["running"] == (6, ["shoes", "watch"]) and got["best"] == (2, ["shoes", "watch"]) and got["cheap watch"] == (2, ["watch"]) and "sale" not in got


def test_size_score_limits(spark):
    got = column(spark, [0, 4, 5, 14, 15, 150, 151, 500, 501], scoring.size_score, "int")
    assert got == pytest.approx([0, 0, 0, 0.45, 1, 1, 0.998, 0.3, 0.3])


def test_spread_score_limits(spark):
    assert column(spark, [0.0, 0.3, 0.7, 1.0], scoring.spread_score, "double") == pytest.approx([0, 0.5, 1, 0.85])


def test_quality_of_extremes(spark):
    rows = [(1, i, "coffee shop near me") for i in range(30)] + [(2, 100, "one"), (3, 200, "a b"), (3, 201, "a b")]
    got = {r.c: r for r in scoring.score_clusters(spark.createDataFrame(rows, "c int, phrase_id long, phrase string"), "c").collect()}
    assert got[2].consistency == 0 and got[1].quality_score > got[3].quality_score > got[2].quality_score and got[2].quality_level == "poor"


def test_similarity(spark):
    d = spark.createDataFrame([("run shoes", "shoes run"), ("abc", "abd"), ("", ""), ("same", "same")], "a string, b string")
    got = [r[0] for r in d.select(scoring.similarity(F.col("a"), F.col("b"), True)).collect()]
    assert got[0] == 1 and got[1] == pytest.approx(2 / 3) and got[3] == 1


@pytest.mark.parametrize("n", [0, 1, 10_000, 100_000])
def test_contains_join_of_many_patterns(spark, n):
    """In one automaton, and in several."""
    r = random.Random(n)
    texts = ["".join(r.choices("abcd ", k=r.randint(0, 14))) for _ in range(500)] + [None, "é中é"]
    pats = sorted({"".join(r.choices("abcd ", k=r.choice([3, 6, 9]))) for _ in range(n)} | ({"中", "é", ""} if n else set()))
    a = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    b = spark.createDataFrame([(p, len(p)) for p in pats], "p string, size int")
    known = set(pats) - {""}
    want = sorted((i, p, len(p)) for i, t in enumerate(texts) for p in {t[x:y] for x in range(len(t or "")) for y in range(x + 1, len(t) + 1)} & known)
    for each in (relate.AUTOMATON, 100_000):
        assert sorted((x.i, x.p, x.size) for x in relate.contains_join(a, b, "t", "p", each=each).collect()) == want


@pytest.mark.parametrize("most", [10_000, 0])
def test_contains_join_ways_agree(spark, most):
    r = random.Random(1)
    texts = [" ".join("".join(r.choices("abc", k=r.randint(1, 4))) for _ in range(r.randint(1, 6))) for _ in range(200)]
    pats = sorted({t[i : i + k] for t in texts[:30] for i, k in ((0, 1), (0, 2), (1, 4), (0, 9))} - {""})
    a = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    b = spark.createDataFrame([(p,) for p in pats], "p string")
    got = sorted((x.i, x.p) for x in relate.contains_join(a, b, "t", "p", most).collect())
    assert got == sorted((i, p) for i, t in enumerate(texts) for p in pats if p in t)


def test_template_regex_and_spans(spark):
    t = spark.createDataFrame([("to fix", "how to fix {X}"), ("vs", "{X} vs {Y}"), ("a.b c", "{X} a.b c")], "anchor string, template_pattern string")
    p = spark.createDataFrame([(1, "how to fix red bike", 5), (2, "red vs blue bike", 6), (3, "xx axb c", 7), (4, "xx a.b c", 8)], "phrase_id long, phrase string, volume long")
    got = {(r.phrase_id, r.template_pattern): r for r in templates.decompose(templates.apply_templates(t, p)).collect()}
    assert set(got) == {(1, "how to fix {X}"), (2, "{X} vs {Y}"), (4, "{X} a.b c")}
    assert got[2, "{X} vs {Y}"].variables == {"X": "red", "Y": "blue bike"}
    assert [tuple(s) for s in got[2, "{X} vs {Y}"].variable_positions] == [(0, 3, "X"), (7, 16, "Y")] and got[1, "how to fix {X}"].prefix == ""


def blobs(spark, spec, dims=10, seed=42):
    r = random.Random(seed)
    rows, i = [], 0
    for c, (n, centre) in enumerate(spec):
        for _ in range(n):
            rows.append((i, [r.gauss(centre[k] if k < len(centre) else 0, 0.2) for k in range(dims)], c))
            i += 1
    return spark.createDataFrame(rows, "phrase_id long, embedding array<float>, cluster_id int")


@pytest.fixture(scope="module")
def three(spark):
    return blobs(spark, [(30, (5,)), (25, (0, 5)), (20, (0, 0, 5))]).cache()


def test_density_clusters_recover_blobs(three):
    got = {r.phrase_id: r.cluster_id for r in cluster.density_clusters(three, 10, 3, 0.5).collect()}
    truth = {r.phrase_id: r.cluster_id for r in three.collect()}
    by = {}
    for p, c in got.items():
        by.setdefault(c, set()).add(truth[p])
    assert sorted(c for c in by if c != -1) == [0, 1, 2] and all(len(v) == 1 for c, v in by.items() if c != -1)
    assert {r.cluster_id for r in cluster.density_clusters(three, 1000, 3, 0.5).collect()} == {-1}


def test_communities_and_modularity(spark, three):
    e = graph.knn_edges(vectors.knn(three, 8), 0.5)
    nodes = three.select(F.col("phrase_id").alias("node"))
    labels = graph.communities(nodes, e)
    one = nodes.withColumn("community", F.lit(1))
    assert graph.modularity(e, labels).first()[0] > 0.5 > graph.modularity(e, one).first()[0] == pytest.approx(0, abs=1e-9)
    pruned = graph.prune(labels, 10).groupBy("community").count().collect()
    ids = sorted(r.community for r in pruned if r.community != -1)
    assert ids == list(range(len(ids))) and all(r["count"] >= 10 for r in pruned if r.community != -1)


def test_components_of_a_chain_and_a_star(spark):
    e = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 200)] + [(500, 500)]
    nodes = spark.createDataFrame([(i,) for i in {x for p in e for x in p} | {999}], "node long")
    got = {r.node: r.component for r in graph.components(nodes, spark.createDataFrame(e, "src long, dst long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[i] == 100 for i in range(100, 300)) and got[500] == 500 and got[999] == 999


def brute_knn(rows, k):
    x = np.array([r.embedding for r in rows], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    d = np.sqrt(np.maximum(0, 2 - 2 * np.round(x @ x.T, 12)))
    np.fill_diagonal(d, np.inf)
    ids = np.array([r.phrase_id for r in rows])
    return {int(ids[i]): [int(ids[j]) for j in sorted(range(len(ids)), key=lambda j: (d[i, j], ids[j]))[:k]] for i in range(len(ids))}


@pytest.mark.parametrize("block", [4096, 20])
def test_knn_is_exact_in_blocks(spark, three, block):
    rows = three.unionByName(three.limit(5).withColumn("phrase_id", F.col("phrase_id") + 900)).collect()  # ties
    d = spark.createDataFrame(rows)
    got = {}
    for r in vectors.knn(d, 5, block=block).orderBy("src", "rank").collect():
        got.setdefault(r.src, []).append(r.dst)
    assert got == brute_knn(rows, 5)
    few = vectors.knn(d, 5, d.where("phrase_id % 20 = 0"), block=block).collect()
    assert {r.src for r in few} == {r.phrase_id for r in rows if r.phrase_id % 20 == 0} and all(got[r.src][r["rank"] - 1] == r.dst for r in few)
    assert vectors.knn(d.limit(0), 5).count() == 0 and vectors.knn(d.limit(1), 5).count() == 0


def test_knn_within_keeps_apart(three):
    truth = {r.phrase_id: r.cluster_id for r in three.collect()}
    near = vectors.knn(three, 30, within="cluster_id").collect()
    assert all(truth[r.src] == truth[r.dst] for r in near) and len(near) == 30 * 29 + 25 * 24 + 20 * 19


def test_knn_cells_recall(spark):
    """20,000 vectors: less than a twentieth of all pairs compared, at least 0.9 of the ten nearest found, for ids divisible by 20."""
    r = np.random.default_rng(3)
    centres = r.normal(size=(400, 32))
    x = centres[r.integers(0, 400, 20_000)] + 0.35 * r.normal(size=(20_000, 32))
    d = spark.createDataFrame(list(enumerate(x.tolist())), "phrase_id long, embedding array<float>").cache()
    asked = d.where("phrase_id % 20 = 0")
    exact = {(e.src, e.dst) for e in vectors.knn(d, 10, asked).collect()}
    found = {(e.src, e.dst) for e in vectors.knn(d, 10, asked, n_cells=200, probes=5).collect()}
    centres_ = vectors.cells(d, 200)
    unit = vectors.normalised(d, "float64")
    per = vectors.in_cells(unit, centres_, 1).groupBy("cell").agg(F.count("*").alias("n"))
    pairs = vectors.in_cells(unit.where("phrase_id % 20 = 0"), centres_, 5).join(per, "cell").agg(F.sum("n")).first()[0]
    assert len(exact & found) / len(exact) >= 0.9 and pairs < 0.05 * 1000 * 20_000


def test_assignment(spark, three):
    new = three.where("phrase_id % 7 = 0")
    got = {r.phrase_id: r.cluster_id for r in vectors.assign(new, three.where("phrase_id % 7 <> 0")).collect()}
    assert got == {r.phrase_id: r.cluster_id for r in new.collect()}
    far = spark.createDataFrame([(1000, [-9.0] * 10)], "phrase_id long, embedding array<float>")
    assert vectors.assign(far, three).first().cluster_id == -1


def test_sub_clusters_find_the_clusters_of_each_parent(spark):
    """10 + 10 + 10 tight clusters and 5 outliers of 384 dimensions in each of two parents, and noise."""
    r = np.random.default_rng(1)
    rows, truth = [], {}
    for parent in (3, 8, -1):
        for k in range(3):
            centre = r.normal(size=384)
            for _ in range(10):
                truth[len(rows)] = (parent, k)
                rows.append((len(rows), (centre + 0.05 * r.normal(size=384)).tolist(), parent))
        for _ in range(5):
            truth[len(rows)] = (parent, None)
            rows.append((len(rows), r.normal(size=384).tolist(), parent))
    v = spark.createDataFrame(rows, "phrase_id long, embedding array<float>, parent int")
    got = {x.phrase_id: x.cluster_id for x in cluster.sub_clusters(v, 5, 2, 0.6).collect()}
    assert len(got) == len(rows)
    by = {}
    for p, (parent, k) in truth.items():
        assert (got[p] == -1) == (k is None or parent == -1) and (got[p] == -1 or got[p] // 10_000 == parent)
        if got[p] != -1:
            by.setdefault((parent, k), set()).add(got[p])
    assert all(len(x) == 1 for x in by.values()) and set().union(*by.values()) == {30000, 30001, 30002, 80000, 80001, 80002}
    assert cluster.sub_clusters(v.limit(0)).count() == 0


def test_split_inconsistent_is_k_means(spark, three):
    """A cluster made of three blobs falls into them; others keep their labels."""
    other = three.selectExpr("phrase_id + 500 as phrase_id", "embedding", "cluster_id + 10 as cluster_id")
    v = three.withColumn("cluster_id", F.lit(4)).unionByName(other)
    labels = v.select("phrase_id", F.col("cluster_id").cast("int").alias("cluster_id"))
    verdicts = spark.createDataFrame([(4, False, 0.9, 3), (10, True, 0.9, 2), (11, True, 0.5, None)], "cluster_id int, consistent boolean, score double, n_parts int")
    got = {x.phrase_id: (x.cluster_id, x.parent) for x in cluster.split_inconsistent(v.select("phrase_id", "embedding"), labels, verdicts).collect()}
    truth = {r.phrase_id: r.cluster_id for r in three.collect()}
    by = {}
    for p, t in truth.items():
        by.setdefault(t, set()).add(got[p])
        assert got[p + 500] == (10 + t, None) if t != 1 else got[p + 500][1] == 11 and got[p + 500][0] > 12
    assert all(len(x) == 1 for x in by.values()) and {c for x in by.values() for c, _ in x} == {13, 14, 15} and len({got[p + 500][0] for p, t in truth.items() if t == 1}) == 2


def test_whole_silhouette_is_brute_force(spark):
    r = random.Random(11)
    rows = [(i, i % 4, [r.gauss(i % 4, 1.0) for _ in range(3)]) for i in range(150)] + [(900, 77, [9.0, 9.0, 9.0]), (901, -1, [0.0] * 3), (902, 1, None)]
    d = spark.createDataFrame(rows, "phrase_id long, cluster_id int, embedding array<double>")
    used, total = [x for x in rows if x[1] != -1 and x[2]], 0.0
    for i, c, e in used:
        to = {}
        for j, k, f in used:
            if i != j:
                to.setdefault(k, []).append(sum((x - y) ** 2 for x, y in zip(e, f)) ** 0.5)
        a, b = sum(to.get(c, [0])) / len(to.get(c, [0])), min(sum(v) / len(v) for k, v in to.items() if k != c)
        total += (b - a) / max(a, b) if c in to else 0
    got = cluster.whole_silhouette(d).first()
    assert got.n == len(used) and abs(got.silhouette - total / len(used)) < 1e-6
    assert cluster.whole_silhouette(d.limit(0)).first().n == 0


def test_validity_prefers_the_truth(three):
    good = cluster.validity(three).first()
    bad = cluster.validity(three.withColumn("cluster_id", (F.col("phrase_id") % 3).cast("int"))).first()
    assert good.silhouette > 0.7 > bad.silhouette and good.davies_bouldin < bad.davies_bouldin and good.calinski_harabasz > bad.calinski_harabasz


def test_greedy_groups_do_not_chain(spark):
    p = spark.createDataFrame([(i,) for i in range(6)], "phrase_id long")
    pairs = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 4)], "a long, b long")
    got = {r.member: r.leader for r in cluster.greedy_groups(p, pairs).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 5}


def _respelled(n, seed):
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("abcdefghijklmnoprstué中", k=r.randint(1, 9))) for _ in range(60)]
    phrases = {"keyboards", "keyboard", "color lamps", "colour lamp", "runningshoe", "runningshoes", "a b", "b a", "a  b", "abcdefghij", "xbcdefghiy", "x", "one two three four five six seven", "one two three four five six seven eight"}
    while len(phrases) < n:
        w = r.choices(vocabulary, k=r.randint(1, 6))
        phrases.add(" ".join(w))
        for _ in range(r.randint(1, 3)):  # letters go, come or change anywhere, words change places
            s = list(" ".join(w))
            k = r.randrange(len(s))
            s[k : k + r.randint(0, 1)] = r.choice(["", "q", "s"])
            w = "".join(s).split() or ["z"]
            r.shuffle(w)
        phrases.add(" ".join(w))
    return sorted(phrases)[:n]


@pytest.mark.parametrize("sorted_words", [True, False])
def test_similar_pairs_are_all_pairs(spark, sorted_words):
    """2,000 respelled phrases: no pair is lost, and each ratio is that of the two strings."""
    from difflib import SequenceMatcher

    phrases = _respelled(2000, 5)
    words = [set(p.split()) for p in phrases]
    forms = [" ".join(sorted(p.split())) if sorted_words else p for p in phrases]
    want = {}
    for j, y in enumerate(forms):
        m = SequenceMatcher(None, "", y)
        for i in range(j):
            score = len(words[i] & words[j]) / len(words[i] | words[j])
            if 2 * min(len(forms[i]), len(y)) >= 0.85 * (len(forms[i]) + len(y)):
                m.set_seq1(forms[i])
                if m.quick_ratio() >= 0.85:
                    score = max(score, m.ratio())
            if score >= 0.85:
                want[i, j] = round(score, 9)
    d = spark.createDataFrame([*enumerate(phrases), (None, "x"), (-1, None)], "phrase_id long, phrase string").withColumn("s", F.lit("clash"))
    got = {(p.a, p.b): round(p.similarity, 9) for p in scoring.similar_pairs(d, 0.85, sorted_words).collect()}
    assert got == want and len(want) > 300
    assert scoring.similar_pairs(d.limit(0), 0.85, sorted_words).isEmpty()


def test_near_strings_of_any_length(spark):
    """Long strings meet in blocks, short ones by segments, and pairs across the limit are not lost."""
    from difflib import SequenceMatcher

    r = random.Random(3)
    made = {"", "a"}
    while len(made) < 240:
        s = r.choices("abcdefg hi", k=r.choice([20, 40, 47, 50, 60, 120, 300]))
        for _ in range(3):
            made.add("".join(s))
            for _ in range(r.randint(1, len(s) // 8)):
                k = r.randrange(len(s))
                s[k : k + r.randint(0, 1)] = r.choice(["", "x", "a"])
    made = sorted(made)
    d = spark.createDataFrame(list(enumerate(made)), "id long, s string")
    ratio = {(i, j): SequenceMatcher(None, made[i], made[j]).ratio() for j in range(len(made)) for i in range(j)}
    for options in ({}, {"longest": 30, "block": 17}):
        got = [(p.a, p.b) for p in alike.near_strings(d, 0.85, **options).collect()]
        assert len(got) == len(set(got)) and {p for p, x in ratio.items() if x >= 0.85} <= set(got)
        assert len(got) < 0.2 * len(ratio)
    assert sum(x >= 0.85 and len(made[i]) <= 48 < len(made[j]) for (i, j), x in ratio.items()) > 2


def test_segments_bound_the_ratio():
    """Strings with too many letters in common for their segments to miss each other, at other ratios than 0.85 too."""
    from difflib import SequenceMatcher

    r = random.Random(9)
    for least in (0.6, 0.75, 0.85, 0.95):
        for _ in range(3000):
            x = "".join(r.choices("abcd", k=r.randint(0, 14)))
            y = list(x)
            for _ in range(r.randint(0, 5)):
                k = r.randint(0, len(y))
                y[k : k + r.randint(0, 1)] = r.choice(["", "a", "e"])
            x, y = sorted((x, "".join(y)), key=len)
            ratio = SequenceMatcher(None, x, y).ratio()
            lcs = alike.common_letters(x, y)
            assert 2 * lcs >= ratio * (len(x) + len(y)) - 1e-9
            if ratio >= least:
                held = {(len(x), k, i, x[a:b]) for k, i, a, b in alike.segment_cuts(len(x), least)}
                assert held & {(m, k, i, y[a:b]) for m, k, i, a, b in alike.probe_cuts(len(y), least)}
                bits = [p & q for p, q in zip(alike.letter_bits(x), alike.letter_bits(y))]
                assert sum((w & (2**64 - 1)).bit_count() for w in bits) <= len(x)


def test_numbering_has_no_gaps(spark):
    d = spark.createDataFrame([(f"w{i:03}",) for i in range(103)], "w string").repartition(5)
    got = sorted((r.batch, r.place, r.w) for r in annotate.numbered_batches(d, "w", 10).collect())
    assert [g[2] for g in got] == [f"w{i:03}" for i in range(103)] and got[-1][:2] == (10, 2)


def test_upserts_are_idempotent(spark):
    cur = spark.createDataFrame([("a", 1, "x"), ("b", 2, None)], "token_text string, in_phrase_count int, notes string").withColumn("token_type", F.lit("intent"))
    new = spark.createDataFrame([("b", 1, "n"), ("c", 5, None)], "token_text string, in_phrase_count int, notes string").withColumn("token_type", F.lit("other"))
    once = state.upsert_tokens(cur, new)
    twice = state.upsert_tokens(once, new)
    rows = lambda d: sorted(map(tuple, d.collect()), key=str)
    assert rows(once) == rows(twice) == [("a", "intent", 1, "x"), ("b", "intent", 2, "n"), ("c", "other", 5, None)]


def test_new_by_key(spark):
    old = spark.createDataFrame([("u1",)], "url string")
    new = spark.createDataFrame([(1, "u1"), (2, "u2"), (3, "u2"), (4, None), (5, None)], "id int, url string")
    assert sorted(r.id for r in relate.new_by_key(new, old, "url", ["id"]).collect()) == [2, 4, 5]


def test_check_table(spark):
    d = spark.range(3).withColumn("phrase", F.lit("x"))
    assert clean.check_table(d, ["phrase"]).first().valid and not clean.check_table(d, ["phrase", "seed"]).first().valid
    assert not clean.check_table(d.limit(0), ["phrase"]).first().valid and not clean.check_table(d, ["phrase"], 2).first().valid


def test_check_table_counts_what_is_beyond_the_most(spark):
    assert tuple(clean.check_table(spark.range(9).withColumn("phrase", F.lit("x")), ["phrase"], 2).first()) == (9, "", False)


def test_file_discovery(spark, tmp_path):
    root = tmp_path / "raw"
    root.mkdir()
    (root / "x_related_list.csv").write_text("﻿phrase,frequency\nshoe rack,3\n", encoding="utf-8")
    got = files.read_keywords(spark, str(root), "related_search").collect()
    assert [(r.phrase, r.source_type, r.frequency, r.volume) for r in got] == [("shoe rack", "related_search", "3", "0")]
    with pytest.raises(FileNotFoundError):
        files.read_keywords(spark, str(root), "semrush")


def test_counts_stream_restarts(spark, tmp_path):
    """Files that come later are merged once, and a restart over the same files changes nothing."""
    d = spark.createDataFrame([(i, f"{w} shoes", "s") for i, w in enumerate(["red", "blue", "red", "green"])], "phrase_id long, phrase string, seed_word string")
    at = str(tmp_path)

    def run():
        s = spark.readStream.schema(d.schema).parquet(f"{at}/in")
        rounds.running_counts(s, f"{at}/out", f"{at}/ck").awaitTermination()
        return {r.word: r.frequency for r in rounds.stored_counts(spark, f"{at}/out").collect()}

    d.where("phrase_id < 2").write.parquet(f"{at}/in")
    assert run()["shoes"] == 2
    d.where("phrase_id >= 2").write.mode("append").parquet(f"{at}/in")
    assert run()["shoes"] == 4 and run() == run() and run()["red shoes"] == 2


def test_watermarked_rollup_drops_late_events(spark, tmp_path):
    from datetime import datetime, timedelta

    day = datetime(2024, 1, 1)
    schema = "provenance_id long, demand_id long, created_at timestamp, event_type string, new_score double"
    at = str(tmp_path)
    for k, hours in enumerate(([0, 1], [80], [2], [200])):  # the third file is later than the watermark
        spark.createDataFrame([(k * 10 + i, 1, day + timedelta(hours=h), "created", 0.5) for i, h in enumerate(hours)], schema).write.mode("append").parquet(f"{at}/in/f={k}")
        s = spark.readStream.schema(schema).parquet(f"{at}/in/*")
        rounds.event_rollup(s).writeStream.outputMode("append").option("checkpointLocation", f"{at}/ck").option("path", f"{at}/out").format("parquet").trigger(availableNow=True).start().awaitTermination()
    got = {r.window_start.day: r.n for r in spark.read.parquet(f"{at}/out").collect()}
    assert got[1] == 2 and got[4] == 1


def test_scratch_tables_go(spark):
    import os

    kept = scratch.stash(spark.range(3), "kept")

    def make():
        scratch.stash(spark.range(5), "inside")
        return scratch.stash(spark.range(4), "inside").where("id > 1")

    out = scratch.settled(spark, make, "out")
    names = lambda: [n for n in os.listdir(scratch.shared_dir(spark)) if "-inside-" in n or n in (kept.stash_path.split("/")[-1], out.stash_path.split("/")[-1])]
    assert sorted(names()) == sorted(d.stash_path.split("/")[-1] for d in (kept, out)) and out.count() == 2
    scratch.clear(spark, kept)
    assert names() == [kept.stash_path.split("/")[-1]]
    scratch.forget(kept)
    assert names() == []


def test_contains_join_of_parts_and_whole_words(spark):
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(["best red shoe tool", "red", "a b c d e", "shoes", ""])], "i int, phrase string")
    patterns = spark.createDataFrame([(p,) for p in ["red shoe tool", "b c d", "ed", "shoe", "a", "", "e", "red"]], "pattern string")
    ways = [sorted((r.i, r.pattern) for r in relate.contains_join(texts, patterns, "phrase", "pattern", most).collect()) for most in (10_000, 1)]
    assert ways[0] == ways[1] == sorted((i, p) for i, t in enumerate(["best red shoe tool", "red", "a b c d e", "shoes", ""]) for p in ["red shoe tool", "b c d", "ed", "shoe", "a", "e", "red"] if p in t)


def test_entry_without_corpus_operators():
    """Their folders may be missing: the other queries stay."""
    import os
    import subprocess
    import sys

    code = "import sys; sys.modules['phrasemine.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 200 and set(e.oracle_sql()) <= set(q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_small_tables_use_all_cores(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(f"{tmp_path}/t")
    d = scratch.spread(spark.read.parquet(f"{tmp_path}/t"))
    assert d.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and d.count() == 1000
    assert scratch.spread(spark.range(0, 1000, 1, 9)).rdd.getNumPartitions() == 9
