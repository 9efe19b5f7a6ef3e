"""The trained network, vector search, components and the pipeline."""

import random
import zlib

import numpy as np
import pytest

from tidewell.llm import hnsw, toxicity
from tidewell.llm.components import components


# ---- toxicity


def made_docs(n, seed, toxic_words=("moron", "vequno", "vequti", "idiot")):
    r = random.Random(seed)
    base = [f"{a}{b}" for a in ("the", "on", "er", "tion", "st", "wh") for b in ("an", "or", "ed", "ing", "es")]
    rows = []
    for i in range(n):
        words = [r.choice(base) for _ in range(r.randint(5, 150))]
        bad = i % 4 == 0
        if bad:
            for _ in range(r.randint(2, 5)):
                words[r.randrange(len(words))] = r.choice(toxic_words)
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_gradients_match_differences():
    net = toxicity.Network(1)
    words = ["a", "bcd", "efgh"]
    ids = np.zeros((3, toxicity.WINDOW), np.int64)
    ids[0, :3], ids[1, :2], ids[2, :5] = (1, 2, 3), (3, 3), (2, 1, 2, 3, 1)
    y = np.array([1, 0, 1], np.float32)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)

    def loss():
        z = net.logits(net.project(net.inputs(words)[0].astype(np.float64)), ids)
        return float(np.mean(np.log1p(np.exp(-np.where(y > 0, z, -z)))))

    g = net.step(words, ids, y)
    slots = toxicity.word_slots(words)
    for k, place in (("query", 3), ("out", 5), ("bias", 0), ("xf", (2, 4)), ("hb", (1, 9)), ("cf", 17), ("hf", (3, 20)), ("word", (slots[1], 2))):
        old, eps = net.p[k][place], 1e-2
        net.p[k][place] = old + eps
        up = loss()
        net.p[k][place] = old - eps
        down = loss()
        net.p[k][place] = old
        assert g[k][place] == pytest.approx((up - down) / (2 * eps), abs=2e-3, rel=0.05)


def test_windows_cover_every_word():
    for n in (0, 1, 31, 32, 33, 48, 49, 200):
        ids, owner = toxicity.windows([np.arange(1, n + 1), np.array([7])])
        assert set(ids[owner == 0].ravel().tolist()) - {0} == set(range(1, n + 1))
        assert (owner == 1).sum() == 1


def test_toxicity_holds_on_rows_not_learnt_from(spark):
    rows = made_docs(900, 3)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(5000, None), (5001, ""), (None, "idiot moron")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x for x in toxicity.scored(docs, labels).collect()}
    assert len(got) == 903 and all(0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.5) for x in got.values())
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] for i, _ in held)
    assert sum(got[i]["predicted"] == y for i, y in held) / len(held) > 0.97
    assert got[5000]["score"] == got[5001]["score"] < 0.5 and got[None]["held_out"] is None
    left = {x["doc_id"] for x in toxicity.accepted(docs, labels).collect()}
    assert left == {i for i, x in got.items() if not x["predicted"]}


def test_toxicity_without_both_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {x["predicted"] for x in toxicity.scored(docs, none).collect()} == {0}
    assert toxicity.accepted(docs, none).count() == 2


# ---- vectors


def brute(vectors):
    ok = [v is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and np.any(v) for _, v in vectors]
    links = {i: set() for i, _ in vectors}
    for a, (i, v) in enumerate(vectors):
        for b, (j, w) in enumerate(vectors):
            if a != b and ok[a] and ok[b] and len(v) == len(w) and np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= 0.95:
                links[i].add(j)
    root = {i: i for i in links}
    changed = True
    while changed:
        changed = False
        for i in links:
            low = min([root[i], *(root[j] for j in links[i])])
            if low < root[i]:
                root[i], changed = low, True
    return {i: (len(links[i]), root[i], root[i] == i) for i in links}


def test_vectors_match_brute_force(spark):
    r = np.random.default_rng(2)
    centres = r.standard_normal((30, 16))
    vectors = []
    for i in range(500):
        v = centres[i % 30] + r.standard_normal(16) * r.choice([0.02, 0.15, 1.0])
        vectors.append((i, v.astype(np.float32).astype(float).tolist()))
    vectors += [(900, vectors[0][1]), (901, vectors[0][1]), (902, None), (903, [0.0] * 16), (904, [float("nan")] * 16), (905, []), (906, [1.0, 2.0]), (907, [2.0, 4.0]), (908, [None] + [1.0] * 15), (909, [float("inf")] * 16)]
    table = spark.createDataFrame([(i, v, 0, 1) for i, v in vectors], "vec_id long, embedding array<float>, label int, node int")
    got = {x["vec_id"]: (x["n_links"], x["component_id"], x["kept"]) for x in hnsw.near_duplicates(table).collect()}
    want = brute(vectors)
    found, there = sum(g[0] for g in got.values()), sum(w[0] for w in want.values())
    assert found >= 0.98 * there and all(got[i][0] <= want[i][0] for i in want)
    assert sum(got[i] == want[i] for i in want) >= 0.97 * len(want)
    assert all(got[i] == (0, i, True) for i in (902, 903, 904, 905, 908, 909)) and got[906] == (1, 906, True) and got[907][1] == 906
    assert hnsw.near_duplicates(table.where("false")).count() == 0


def test_graph_recall_and_wide_groups():
    r = np.random.default_rng(4)
    tight = r.standard_normal(32) + r.standard_normal((700, 32)) * 0.05  # one group wider than any beam to begin with
    x = hnsw._unit(np.concatenate((tight, r.standard_normal((2500, 32)))))
    graph = hnsw.Graph(x.astype(np.float32))
    beam = hnsw.audited_beam(graph, x, 0.95)
    truth = {(i, j) for i, j in zip(*np.nonzero(x @ x.T >= 0.95), strict=True)}
    found = [p for a, b in hnsw.pairs_within(graph, x, x, 0.95, beam) for p in zip(a.tolist(), b.tolist(), strict=True)]
    assert len(found) == len(set(found)) and set(found) <= truth and len(found) >= 0.98 * len(truth)


def test_queries_with_full_beams_meet_the_whole_shard(monkeypatch):
    monkeypatch.setattr(hnsw, "WIDEST", 100)
    r = np.random.default_rng(5)
    x = hnsw._unit(np.concatenate((r.standard_normal(16) + r.standard_normal((900, 16)) * 0.02, r.standard_normal((900, 16)))))
    graph = hnsw.Graph(x.astype(np.float32))
    found = [p for a, b in hnsw.pairs_within(graph, x, x, 0.95, 24) for p in zip(a.tolist(), b.tolist(), strict=True)]
    assert len(found) == len(set(found)) and {p for p in found if p[0] < 900} == {(i, j) for i, j in zip(*np.nonzero(x @ x.T >= 0.95), strict=True) if i < 900}


def test_audit_sees_few_links():
    r = np.random.default_rng(7)
    x = r.standard_normal((2000, 32))
    x[:10] = x[10:20] + r.standard_normal((10, 32)) * 0.02
    x = hnsw._unit(x)

    class Shy(hnsw.Graph):
        """Narrow beams find the query itself alone."""

        def search(self, q, beam):
            ids, sims = super().search(q, beam)
            if beam < 90:
                ids[:, 1:], sims[:, 1:] = -1, -np.inf
            return ids, sims

    shy = Shy(x.astype(np.float32))
    assert hnsw.audited_beam(shy, x, 0.95) == 96


def test_links_count_for_both_ends(spark, monkeypatch):
    r = np.random.default_rng(6)
    centres = r.standard_normal((40, 16))
    vectors = [(i, (centres[i % 40] + r.standard_normal(16) * 0.08).tolist()) for i in range(160)] + [(200 + i, (centres[0] + r.standard_normal(16) * 0.02).tolist()) for i in range(60)]
    vectors += [(300, vectors[0][1]), (301, vectors[3][1])]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    whole = hnsw.pairs_within

    def one_sided(graph, exact, q, threshold, beam, wide=None):
        """As if searches of vectors that are not wide found a link from one side only."""
        wide = np.zeros(len(q), bool) if wide is None else wide
        sure = wide.copy()
        for a, b in whole(graph, exact, q, threshold, beam, wide):
            ok = sure[a] | (q[a, 0] <= exact[b, 0])
            yield a[ok], b[ok]

    monkeypatch.setattr(hnsw, "pairs_within", one_sided)
    monkeypatch.setattr(hnsw, "audited_beam", lambda *a, **k: hnsw.BEAM)
    want = brute(vectors)
    for least in (5, 64):  # with and without wide vectors
        monkeypatch.setattr(hnsw, "WIDE", least)
        assert {x["vec_id"]: (x["n_links"], x["component_id"], x["kept"]) for x in hnsw.near_duplicates(table).collect()} == want


# ---- components


def test_components_of_random_graphs(spark):
    r = random.Random(1)
    pairs = [(r.randrange(400), r.randrange(400)) for _ in range(250)] + [(k, k + 1) for k in range(1000, 1100)] + [(5, None), (7, 7), (2000, 2001), (2000, 2001)]
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in pairs:
        if v is not None and u != v:
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
    want = {x: find(x) for x in list(root)}
    assert got == {x: w for x, w in want.items() if x != w}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---- pipeline


def test_pipeline_stages_do_their_work(spark, tmp_path):
    import corpus_pipeline as cp

    rows = made_docs(240, 5)
    passage = " ".join(f"bench{i}" for i in range(14))
    r = random.Random(2)
    clean = [[f"clean{r.randrange(3000)}" for _ in range(90)] for _ in range(3)]
    extra = [
        (1000, " ".join(clean[0])),
        (1001, " ".join(clean[0])),
        (1002, "before words here\n" + passage + "\nafter words there"),
        (1003, " ".join(clean[1]) + "\nshared line of text number one"),
        (1004, " ".join(clean[2]) + "\nshared line of text number onE"),
        (1005, None),
    ]
    docs = [(i, t) for i, t, _ in rows] + extra
    at = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")

    now, seen = spark.read.parquet(f"{at}/documents.parquet"), {}
    for name, stage in cp.STAGES:
        now = stage(spark, now, at)
        if name != "packing":
            assert now.columns == cp.COLUMNS
            now.write.parquet(f"{at}/{name}")
            now = spark.read.parquet(f"{at}/{name}")
            seen[name] = {x["doc_id"]: x for x in now.collect()}
    toxic = {i for i, _, y in rows if y}
    assert len(toxic & set(seen["toxicity"])) <= 2 and {i for i, _ in extra} <= set(seen["toxicity"])
    assert set(seen["line_dedup"]) == set(seen["toxicity"])
    assert seen["line_dedup"][1001]["text"] == "" and "shared" in seen["line_dedup"][1003]["text"] and "shared" not in seen["line_dedup"][1004]["text"]
    assert seen["line_dedup"][1004]["n_chars"] == len(seen["line_dedup"][1004]["text"])
    assert 1000 in seen["simhash_near_dedup"]
    assert {1001, 1005} & set(seen["simhash_near_dedup"]) == {1001}  # both empty by now: one group
    assert "bench3" not in seen["decontamination"][1002]["text"] and "before words" in seen["decontamination"][1002]["text"]
    pieces = now.collect()
    assert {x["doc_id"] for x in pieces} == set(seen["decontamination"])
    whole = cp.run(spark, at).collect()
    key = lambda x: (x["doc_id"], x["piece"], x["start"], x["length"], x["ids_crc32"])
    assert sorted(map(key, whole)) == sorted(map(key, pieces))


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 11)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
