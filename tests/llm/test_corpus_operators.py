"""Operators over many rows against brute force or their SQL, and hard rows."""

import itertools
import math
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash

from tendril.llm import budget_mixing, common, embedding_forest, registry, simhash_bk, url_association
from tendril.llm.components import components
from tests.conftest import SF001
from tests.llm.conftest import HARD
from tests.oracle_check import compare, duck


def groups(n, pairs):
    """Smallest index reachable, by plain union."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_matches_its_sql(spark, name):
    assert compare(spark, duck(SF001), name, registry.QUERIES[name], registry.ORACLE[name], SF001)


# ---- components ----------------------------------------------------------------------


def test_components_of_chains_stars_and_loops(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(200, 200), (300, 301), (301, 300)]
    rnd.shuffle(edges)
    df = spark.createDataFrame([*edges, (None, 5), (7, None)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(df, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)}, 300: 300, 301: 300}
    assert components(df.limit(0), "a", "b").count() == 0


def test_spread_join_equals_a_plain_join(spark, monkeypatch):
    """Hot and plain keys, keys without facts, null keys, no rows; facts' names as given."""
    monkeypatch.setattr(common, "HOT_KEYS", 9)
    rows = spark.createDataFrame(
        [("hot", i) for i in range(40)] + [("cold", i) for i in range(5)] + [("none", 1), (None, 2)], "k string, x int"
    )
    facts = spark.createDataFrame([("hot", 7, 40), ("cold", 8, 5), ("unused", 9, 0)], "k string, f int, n long")
    got = common.spread_join(rows, facts, "k", "n", 47)
    want = rows.join(facts.drop("n"), "k")
    assert got.columns == ["k", "x", "f"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert common.spread_join(rows.limit(0), facts.limit(0), "k", "n", 0).count() == 0


def test_components_with_hot_nodes(spark, monkeypatch):
    """A star, a chain hanging from it and random edges, with nodes counted hot from four edges on."""
    monkeypatch.setattr(common, "HOT_KEYS", 45)
    rng = np.random.default_rng(5)
    pairs = [(0, i) for i in range(1, 60)] + [(i, i + 1) for i in range(59, 75)]
    pairs += [(int(a) + 100, int(b) + 100) for a, b in rng.integers(0, 80, (70, 2))]
    root = {x: x for p in pairs for x in p}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()
    touched = {x for a, b in pairs if a != b for x in (a, b)}
    assert sorted((r["node"], r["root"]) for r in got) == sorted((x, root[x]) for x in touched)


def test_hot_groups_and_copies_are_spread(spark, make_docs, monkeypatch):
    """SimHash groups and vector components have the same results with few and many hot keys."""
    rows = [(i, "the same words in every copy of this text") for i in range(20)]
    rows += [(50 + i, f"text number {i} of its own kind {i * i} and more") for i in range(10)]
    docs, schema = make_docs(rows), "vec_id long, embedding array<float>, label int"
    vectors = [(i, [1.0, 0.001 * (i % 9)], 1) for i in range(30)] + [(90, [0.0, 1.0], 1), (91, None, 1)]
    vectors = spark.createDataFrame(vectors, schema)
    plain = [sorted(map(tuple, simhash_bk.simhash_components(docs).collect()))]
    plain.append(sorted(map(tuple, embedding_forest.embedding_components(vectors).collect())))
    monkeypatch.setattr(common, "HOT_KEYS", 4)
    assert sorted(map(tuple, simhash_bk.simhash_components(docs).collect())) == plain[0]
    assert sorted(map(tuple, embedding_forest.embedding_components(vectors).collect())) == plain[1]
    assert [r for r in plain[1] if r[0] < 30] == [(i, 29, 0, i == 0) for i in range(30)]
    assert sorted(r["doc_id"] for r in simhash_bk.drop_near_duplicates(docs).collect())[0] == 0


# ---- SimHash ---------------------------------------------------------------------------


def plain_fingerprint(text, n=4):
    import re

    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    sh = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_bk_tree_finds_all_within_the_radius():
    rng = np.random.default_rng(2)
    centre = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    flips = [np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 9), replace=False))) for _ in range(400)]
    values = np.unique(centre[rng.integers(0, 20, 400)] ^ np.array(flips, np.uint64))
    found = {(int(a), int(v)) for near, v in simhash_bk.BKTree(values).within(values, 4) for a in near}
    want = {(int(a), int(b)) for a in values for b in values if (int(a) ^ int(b)).bit_count() <= 4}
    assert found == want
    empty = simhash_bk.BKTree(values[:0])
    assert empty.within(values, 4) == [] and simhash_bk.BKTree(values).within(values[:0], 4) == []


def test_bk_trees_of_a_shard_are_deep_and_prune(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    prints = docs.select(simhash_bk.fingerprint_column(docs["text"]).alias("fp")).distinct().toPandas()["fp"]
    values = prints.to_numpy().astype(np.int64).view(np.uint64)
    tree = simhash_bk.BKTree(values)
    tree.within(values, 4)
    assert len(tree.pivot) == len(values) > 500  # every fingerprint is a node
    assert sum(bool(c) for c in tree.children) > 100
    assert len(values) < tree.asked < 0.9 * len(values) ** 2


@pytest.mark.parametrize("shards", [1, 100, 10_000, 10_000_000, 1 << 29])
def test_blocks_of_every_size_keep_near_fingerprints_together(shards):
    blocks, same = simhash_bk._blocks(4, shards)
    assert sum(w for _, w in blocks) == 64 and len(blocks) - same == 4
    rng = np.random.default_rng(shards)
    for _ in range(300):
        flipped = set(rng.choice(64, 4, replace=False).tolist())
        untouched = [b for b in blocks if not flipped & set(range(b[0], b[0] + b[1]))]
        assert len(untouched) >= same


def test_of_rows_of_one_id_and_text_the_same_one_stays(spark, make_docs):
    rows = [(3, "one text of five words", lang, f"src{i}") for i, lang in enumerate(["en", "de", None, "fr"] * 3)]
    first = simhash_bk.drop_near_duplicates(make_docs(rows)).collect()
    assert len(first) == 1
    for n in (2, 7):
        again = make_docs(rows[::-1]).repartition(n, "source")
        assert simhash_bk.drop_near_duplicates(again).collect() == first


def check_simhash(rows, got):
    fp = [plain_fingerprint(t) for _, t in rows]
    pairs = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if (fp[i] ^ fp[j]).bit_count() <= 4]
    root = groups(len(rows), pairs)
    for i, (doc_id, _) in enumerate(rows):
        mates = [rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None]
        want = (doc_id, f"{fp[i]:016x}", min(mates, default=None))
        assert want in got, want
    assert len(got) == len(rows)


def test_simhash_equals_brute_force_on_near_copies(spark, make_docs):
    rnd = random.Random(8)
    rows = []
    for g in range(40):
        words = [f"w{rnd.randint(0, 500)}" for _ in range(rnd.choice([3, 40, 300]))]
        for _ in range(rnd.choice([1, 1, 2, 6])):
            own = list(words)
            for _ in range(rnd.choice([0, 1, 3])):
                own[rnd.randrange(len(own))] = f"z{rnd.randint(0, 9)}"
            rows.append((len(rows), " ".join(own).upper() if rnd.random() < 0.3 else "  ".join(own)))
    docs = make_docs(rows)
    check_simhash(rows, [tuple(r) for r in simhash_bk.simhash_components(docs).collect()])
    kept = simhash_bk.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    roots = {r["component_id"] for r in simhash_bk.simhash_components(docs).collect()}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(roots)


def test_simhash_parts_of_a_hot_shard_lose_no_link(spark):
    rng = np.random.default_rng(3)
    near = [int(sum(1 << int(b) for b in rng.choice(64, 2, replace=False))) for _ in range(300)]
    far = [int(x) for x in rng.integers(1, 1 << 62, 50)]
    values = sorted({x - (1 << 64) if x >> 63 else x for x in [0, *near, *far]})
    prints = spark.createDataFrame([(v,) for v in values], "fp long")
    edges = simhash_bk.link_edges(prints, shard_rows=16)
    got = {r["node"]: r["root"] for r in components(edges, "a", "b").collect()}
    bits = [v & ((1 << 64) - 1) for v in values]
    pairs = [(i, j) for i, j in itertools.combinations(range(len(values)), 2) if (bits[i] ^ bits[j]).bit_count() <= 4]
    root = groups(len(values), pairs)
    for i, v in enumerate(values):
        mates = [values[j] for j in range(len(values)) if root[j] == root[i]]
        assert got.get(v, v) == min(mates)


def test_simhash_on_hard_rows(hard_docs, no_docs):
    rows = [(r[0], r[1]) for r in HARD]
    got = [tuple(r) for r in simhash_bk.simhash_components(hard_docs).collect()]
    short = [(d, t if t is None or len(t) < 1000 else t) for d, t in rows]
    check_simhash(short, got)
    assert simhash_bk.simhash_components(no_docs).count() == 0
    kept = [r["doc_id"] for r in simhash_bk.drop_near_duplicates(hard_docs).collect()]
    assert len(kept) == len(set(kept)) and {1, 5, 9} <= set(kept) and not {2, 3, 10} & set(kept)
    assert simhash_bk.drop_near_duplicates(no_docs).count() == 0


# ---- embeddings --------------------------------------------------------------------------


def brute_links(rows, cosine=0.98):
    ok = [
        v is not None and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
        for _, v, lab in rows
    ]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if k else None for (_, v, _), k in zip(rows, ok)]
    return [
        (i, j)
        for i, j in itertools.combinations(range(len(rows)), 2)
        if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine
    ]


def check_embeddings(spark, rows, least=1.0, **how):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr(
        "*", "'x' AS node", "1 AS tree", "2 AS parts"
    )
    got = embedding_forest.embedding_components(df, **how).collect()
    assert len(got) == len(rows)
    pairs = brute_links([(a, None if v is None else [None if x is None else np.float32(x) for x in v], c) for a, v, c in rows])
    links = sum(r["n_links"] for r in got)
    assert least * 2 * len(pairs) <= links <= 2 * len(pairs)
    if least == 1.0:
        root = groups(len(rows), pairs)
        want = sorted((rows[i][0], min(rows[j][0] for j in range(len(rows)) if root[j] == root[i])) for i in range(len(rows)))
        assert sorted((r["vec_id"], r["component_id"]) for r in got) == want
        assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_forest_finds_planted_copies_and_recall(spark):
    rng = np.random.default_rng(5)
    rows = []
    for g in range(300):
        c = rng.normal(size=16)
        for _ in range(rng.choice([1, 1, 2, 5])):
            v = c + rng.normal(size=16) * rng.choice([0.0, 0.03, 0.06])
            rows.append((len(rows), [float(x) for x in v], int(rng.integers(0, 2)) if g % 9 == 0 else g % 3))
    check_embeddings(spark, rows, least=0.97)


def test_trees_search_one_label_each_in_its_own_way(spark):
    rng = np.random.default_rng(11)
    rows = []
    for _ in range(500):
        a, b = rng.normal(size=(2, 16))
        a /= np.linalg.norm(a)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        rows += [(len(rows), a.tolist(), 1), (len(rows) + 1, (0.981 * a + np.sqrt(1 - 0.981**2) * b).tolist(), 1)]
    check_embeddings(spark, rows, least=0.99)


def test_large_groups_are_split_in_rounds(spark, monkeypatch):
    """Rounds go on until a group has two blocks, each from its own sample; no planted link is
    lost, and a vector's copies per tree stay few."""
    monkeypatch.setattr(embedding_forest, "BLOCK", 16)
    monkeypatch.setattr(embedding_forest, "DEPTH", 2)
    rng, rows = np.random.default_rng(3), []
    for _ in range(1500):
        c = rng.normal(size=16)
        rows += [(len(rows), c.tolist(), 1), (len(rows) + 1, (c + rng.normal(size=16) * 0.02).tolist(), 1)]
    df = spark.createDataFrame(rows, "node long, embedding array<float>, label int")
    nodes = df.selectExpr("cast(node as string) AS node", "embedding", "cast(label as string) AS label")
    got = embedding_forest._grouped(nodes, 2, 0.02, 256).select("group", "node", "parts").toPandas()
    assert set(got["node"]) == {str(i) for i in range(len(rows))}
    assert got["group"].str.split(":").str[0].str.count(r"\.").max() >= 3  # rounds after the first
    own = got[got["parts"] == 1].groupby("group").size()
    assert own.max() <= 32 and len(own) > 100
    assert len(got) < 2 * 4 * len(rows)
    check_embeddings(spark, rows, least=0.99)


def test_splits_are_the_same_wherever_they_are_drawn():
    x = embedding_forest.unit(np.random.default_rng(1).normal(size=(2000, 8)))
    at, tried = embedding_forest.fit_splits(x[:500], "0:8:a", 100_000, 0.02)
    assert (at, tried) == embedding_forest.fit_splits(x[:500], "0:8:a", 100_000, 0.02)
    assert (at, tried) != embedding_forest.fit_splits(x[:500], "1:8:a", 100_000, 0.02)
    places = list(embedding_forest.descend(x, "0:8:a", at, tried, 0.02))
    assert set(np.concatenate([rows for _, rows in places])) == set(range(2000))
    one = embedding_forest.unit(np.ones((100, 8)))
    assert embedding_forest.fit_splits(one, "0:8:a", 100_000, 0.02)[1][0] == -1  # nothing to split


def test_dense_group_beyond_a_block_and_exact_copies(spark, monkeypatch):
    monkeypatch.setattr(embedding_forest, "BLOCK", 64)
    rng = np.random.default_rng(6)
    c = rng.normal(size=24)
    rows = [(i, [float(x) for x in c + rng.normal(size=24) * 0.01], 1) for i in range(500)]
    rows += [(500 + i, [float(x) for x in c], 2) for i in range(300)]
    rows += [(800 + i, [float(x) for x in rng.normal(size=24)], 1) for i in range(200)]
    check_embeddings(spark, rows)


def test_unusable_vectors_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    one = [1.0, 2.0]
    rows = [(1, one, 1), (2, one, 1), (3, one, None), (4, None, 1), (5, [0.0, 0.0], 1), (6, [nan, 1.0], 1),
            (7, [inf, 1.0], 1), (8, [None, 1.0], 1), (9, [2.0, 4.0], 1), (10, [1.0, 2.0, 0.0], 1), (11, [], 1)]
    check_embeddings(spark, rows)
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_forest.embedding_components(empty).count() == 0


# ---- URLs ------------------------------------------------------------------------------------


def test_fixed_rules_longest_wins_and_hard_urls(spark):
    rows = [
        (1, "http://WWW.Example.com/en/x?q=1", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
        (2, "https://a.example.com/en/", "a.example.com", "/en/", "example.com/en/", "block"),
        (3, "https://myexample.com/en/", "myexample.com", "/en/", "com/", "allow"),
        (4, "http://x.net/fr/a#b", "x.net", "/fr/a", "net/fr/", "block"),
        (5, "http://x.com", "x.com", "", None, None),
        (6, None, "", "", None, "allow"),
        (7, "no scheme.com/en/", "", "", None, "allow"),
        (8, "", "", "", None, "allow"),
        (8, "", "", "", None, "allow"),
        (9, "a://b://c.com/en/", "b:", "//c.com/en/", None, None),
        (10, "http://" + "z" * 50_000 + ".net/es/", "z" * 50_000 + ".net", "/es/", "net/es/", "block"),
        (11, "http://É.COM/", "É.com", "/", "com/", "allow"),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string").selectExpr("*", "'x' AS host", "'y' AS rule", "1 AS token")
    got = url_association.judge_urls(df).collect()
    assert len(got) == len(rows)
    have = {(r["page_id"], r["host"], r["path"], r["rule"]): r["verdict"] for r in got}
    for i, _, h, p, rule, verdict in rows:
        assert have[(i, h, p, rule)] == verdict or verdict is None
    assert url_association.judge_urls(df.limit(0)).count() == 0


def test_mined_rules_are_pruned_and_generalise(spark):
    rows = [(i, f"http://a{i % 7}.net/{'fr' if i % 2 else 'es'}/casino/{i}") for i in range(60)]
    rows += [(100 + i, f"http://b{i % 7}.com/de/news/{i}") for i in range(60)]
    rows += [(500, "http://x.org/fr/casino/1"), (501, "http://x.org/de/news/2"), (502, "http://x.org/zz/yy")]
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = {r["page_id"]: r for r in url_association.judge_urls(df).collect()}
    assert got[500]["verdict"] == "block" and got[500]["confidence"] == 1.0 and got[500]["combination"] == "p:casino"
    assert got[501]["verdict"] == "allow" and got[501]["combination"] is not None
    assert got[502]["verdict"] == "allow" and got[502]["combination"] is None


def test_urls_without_a_host_single_tokens_and_larger_sets(spark, tmp_path):
    import duckdb

    rows = [f"http://a{i % 7}.net/{'fr' if i % 2 else 'es'}/casino/{i}" for i in range(60)]
    rows += [f"http://b{i % 7}.com/de/news/{i}" for i in range(60)]
    rows += ["file:///fr/casino/1", "http://x.org/casino", "http://x.org/casino", ":///", "://", None, None, "", "mailto:casino"]
    # decided by four tokens together, by no three of them
    four = ["ka", "kb", "kc", "kd"]
    for i in range(16):
        some = "/".join(x for k, x in enumerate(four) if i >> k & 1)
        rows += [f"http://c.net/fr/{some}" if i == 15 else f"http://c.com/zz/{some}"] * 9
    rows += ["http://y.org/" + "/".join(four), "http://y.org/ka/kb"]
    df = spark.createDataFrame([(i % 300, u) for i, u in enumerate(rows)], "page_id long, url string")
    got = url_association.judge_urls(df, support=0.01).collect()
    of = {r["page_id"]: r for r in got}
    by_url = {u: of[i] for i, u in enumerate(rows)}
    assert by_url["file:///fr/casino/1"]["verdict"] == "block" and by_url["http://x.org/casino"]["combination"] == "p:casino"
    path = str(tmp_path / "pages.parquet")
    df.coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{path}/*.parquet')")
    want = con.execute(url_association.oracle()).fetchall()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    tokens = [(list("abcd"), "block")] * 9
    tokens += [([t for t in "abcd" if t != x], "allow") for x in "abcd"] * 3
    found = url_association.mine(spark.createDataFrame(tokens, "tokens array<string>, verdict string"), 0.05, 0.9)
    assert {tuple(r["tokens"]): r["verdict"] for r in found.collect()} == {tuple("abcd"): "block"}


def test_a_hot_url_is_judged_where_it_is(spark, monkeypatch):
    rows = [f"http://a{i % 7}.net/fr/casino/{i}" for i in range(40)] + ["http://x.org/casino"] * 70 + ["http://y.org/q"] * 3
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    plain = sorted(map(str, url_association.judge_urls(df).collect()))
    monkeypatch.setattr(common, "HOT_KEYS", 4)
    assert sorted(map(str, url_association.judge_urls(df).collect())) == plain and "block" in plain[50]


# ---- mixing ------------------------------------------------------------------------------------


def brute_rules(rows, support, confidence):
    """Sets of every size among rows of ten tokens at most, of three at most among the others."""
    counts, short = Counter(), Counter()
    for tokens, verdict in rows:
        for k in range(1, min(len(set(tokens)), 4) + 1):
            own = [(c, verdict) for c in combinations(sorted(set(tokens)), k)]
            counts.update(own)
            if len(set(tokens)) <= 10:
                short.update(own)
    n_short = sum(len(set(t)) <= 10 for t, _ in rows)
    counts = Counter({c: n for c, n in counts.items() if len(c[0]) <= 3 or any(short[c[0], v] >= support * n_short for v in ("allow", "block"))})
    whole = Counter()
    for (c, _), n in counts.items():
        whole[c] += n
    least = math.ceil(support * len(rows))
    rules = {(c, v): n / whole[c] for (c, v), n in counts.items() if n >= least and n / whole[c] >= confidence}
    vain = {(c, v) for c, v in rules for x in c if rules.get((tuple(t for t in c if t != x), v), -1) >= rules[c, v]}
    return {(c, v, counts[c, v]) for c, v in rules if (c, v) not in vain}


def test_a_hot_url_of_many_tokens_is_mined_like_any_other(spark):
    rng = random.Random(5)
    hot = [f"p:t{i:02}" for i in range(30)]
    rows = [(hot, "block")] * 40 + [(hot[:14], "allow")] * 9 + [(rng.sample(hot, 12), "block") for _ in range(12)]
    rows += [(rng.sample(hot[:6] + ["h:com", "h:net"], 4), rng.choice(["allow", "block"])) for _ in range(60)]
    rng.shuffle(rows)
    got = url_association.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.05, 0.8)
    assert {(tuple(r.tokens), r.verdict, r["count"]) for r in got.collect()} == brute_rules(rows, 0.05, 0.8)


def test_urls_of_many_tokens_are_judged_by_rules_of_every_size(spark):
    """Five tokens decide together, no four of them do, in rows of more than ten frequent tokens."""
    deciding, others = [f"d{x}" for x in "abcde"], "/".join(f"t{x}" for x in "abcdefghijkl")
    rows = []
    for i in range(32):
        some = "/".join(x for k, x in enumerate(deciding) if i >> k & 1)
        rows += [f"http://c.{'net/fr' if i == 31 else 'com/zz'}/{others}/{some}"] * 3
    rows += [f"http://y.org/{others}/{'/'.join(deciding)}", f"http://y.org/{others}/{'/'.join(deciding[:4])}"]
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = {r["page_id"]: r for r in url_association.judge_urls(df, 0.02, 0.9).collect()}
    assert (got[96]["verdict"], got[96]["confidence"], got[96]["combination"]) == ("block", 1.0, " ".join(f"p:{x}" for x in deciding))
    assert got[97]["verdict"] == "allow"


@pytest.mark.parametrize(
    "rows, n", [([([f"p:t{i:02}" for i in range(30)], "block")] * 40, 30), ([([], "allow")] * 5, 0)], ids=["all long", "no tokens"]
)
def test_mining_rows_of_one_sort(spark, rows, n):
    assert url_association.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string")).count() == n


def fill(budget, children):
    """Plain water filling: (capacity, weight) per child, real numbers."""
    share, open_ = [0.0] * len(children), set(range(len(children)))
    while open_ and budget > 1e-9:
        per = budget / sum(children[i][1] for i in open_)
        full = {i for i in open_ if children[i][0] - share[i] <= per * children[i][1] + 1e-9}
        if not full:
            for i in open_:
                share[i] += per * children[i][1]
            break
        for i in full:
            budget -= children[i][0] - share[i]
            share[i] = children[i][0]
        open_ -= full
    return share


def test_water_filling_gives_shortages_to_siblings(spark):
    rnd = random.Random(12)
    for _ in range(6):
        kids = [(rnd.randint(0, 1000), rnd.randint(1, 5)) for _ in range(rnd.randint(1, 9))]
        budget = rnd.randint(0, 4000)
        df = spark.createDataFrame(
            [(0, f"n{i}", budget, c, w) for i, (c, w) in enumerate(kids)],
            "root int, node string, budget long, capacity long, weight int",
        ).selectExpr("root", "node", "budget", "capacity", "cast(weight as decimal(10,0)) weight")
        got = {r["node"]: r["share"] for r in budget_mixing.water_fill(df, ["root"], "node").collect()}
        for i, want in enumerate(fill(budget, kids)):
            assert want - 1 <= got[f"n{i}"] <= want + 1e-6


def test_mix_meets_the_budgets_with_seeded_prefixes(spark, make_docs):
    rnd = random.Random(13)
    rows = [(i, "w " * rnd.randint(0, 30), rnd.choice(["en", "de"]), f"src{rnd.choice([0, 0, 0, 1, 2, 3, 4])}") for i in range(600)]
    docs = make_docs(rows)
    plan = {r["doc_id"]: r for r in budget_mixing.epochs(docs).collect()}
    assert len(plan) == len(rows)
    total = sum(r["tokens"] for r in plan.values())
    used = sum(r["tokens"] * r["epochs"] for r in plan.values())
    longest, leaves = 30, len({(r["language"], r["source"]) for r in plan.values()})
    assert 0.9 * total - leaves * (longest + 3) <= used <= 0.9 * total
    assert all(0 <= r["epochs"] <= budget_mixing.MAX_EPOCHS for r in plan.values())
    mixed = budget_mixing.mix(docs)
    assert mixed.columns == docs.columns
    count = {}
    for r in mixed.collect():
        count[r["doc_id"]] = count.get(r["doc_id"], 0) + 1
    assert count == {i: r["epochs"] for i, r in plan.items() if r["epochs"]}


def test_mixing_on_hard_rows(hard_docs, no_docs):
    got = budget_mixing.epochs(hard_docs).collect()
    assert len(got) == len(HARD)
    assert {r["epochs"] for r in got if r["doc_id"] == 5} in ({0}, {1}, {2})
    assert budget_mixing.epochs(no_docs).count() == 0
    assert budget_mixing.mix(no_docs).count() == 0 and budget_mixing.mix(hard_docs).columns == hard_docs.columns


# ---- pipeline --------------------------------------------------------------------------------


def test_pipeline_equals_its_stages_and_round_trips(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    at = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, SF001)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
            assert dict(out.dtypes) == dict(docs.dtypes), name
        at = out
    want = sorted((r["doc_id"], r["n_tokens"]) for r in at.collect())
    got = corpus_pipeline.run(spark, SF001).collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in got) == want and want
    assert all(r["round_trip"] for r in got)


def test_pipeline_stages_on_hard_rows(spark, make_docs):
    import corpus_pipeline

    for rows in (HARD, []):
        docs = make_docs(rows, clash=False)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF001)
            assert out.columns == docs.columns, name
            assert out.count() <= 2 * len(rows)
        last = corpus_pipeline.STAGES[-1][1](spark, docs, SF001).collect()
        assert len(last) == len(rows) and all(r["round_trip"] for r in last)


def test_every_operator_has_one_query():
    names = [n for n in registry.QUERIES if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in registry.QUERIES
