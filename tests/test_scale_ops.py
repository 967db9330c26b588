"""Operators whose plan was shaped for scale, checked against brute force on small inputs."""

import itertools
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from gridlake.operators import budget as bo
from gridlake.operators import index as ix
from gridlake.operators import links, paging
from gridlake.operators import search as sr
from gridlake.sources.tables import number_rows
from gridlake.streaming import hotkeys, metrics


def test_number_rows_sparse_keys(spark):
    rnd = random.Random(1)
    keys = rnd.sample(range(-10**9, 10**9), 500)
    df = spark.createDataFrame([(k, f"v{k}") for k in keys], "k long, v string")
    got = {r["k"]: r["row"] for r in number_rows(df, ["k"], partitions=7).collect()}
    assert got == {k: i + 1 for i, k in enumerate(sorted(keys))}


def test_range_count_matches_brute_force(spark):
    rnd = random.Random(2)
    ranges = [(i, rnd.uniform(0, 100), rnd.uniform(0, 30)) for i in range(60)]
    ranges = [(i, lo, lo + w) for i, lo, w in ranges]
    vals = [round(rnd.uniform(-5, 140), 1) for _ in range(3000)] + [50.0] * 500  # a hot value
    r = spark.createDataFrame(ranges, "id int, lo double, hi double")
    v = spark.createDataFrame([(x,) for x in vals], "x double")
    got = {row["id"]: row["n"] for row in sr.range_count(r, v, ["id"], "lo", "hi", "x").collect()}
    want = {i: sum(lo <= x < hi for x in vals) for i, lo, hi in ranges}
    assert got == {k: n for k, n in want.items() if n}


def test_rect_join_matches_brute_force(spark):
    rnd = random.Random(3)
    cells = [("wb", "s", 0, r, c) for r in range(1, 60) for c in range(1, 30) if rnd.random() < 0.6]
    rects = [(i, rnd.randint(0, 25), rnd.randint(0, 50), rnd.randint(1, 12), rnd.randint(1, 25)) for i in range(30)]
    cdf = spark.createDataFrame(cells, "workbook string, sheet string, sheet_idx int, row long, col int")
    rdf = spark.createDataFrame(rects, "q int, x int, y int, w int, h int")
    got = sorted((r["q"], r["row"], r["col"]) for r in sr.rect_join(rdf, cdf, tile_rows=7, tile_cols=4).collect())
    want = sorted((q, r, c) for q, x, y, w, h in rects for _, _, _, r, c in cells if x <= c - 1 < x + w and y <= r - 1 < y + h)
    assert got == want


def test_batch_text_search_matches_brute_force(spark):
    rnd = random.Random(4)
    vocab = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "theta"]
    docs = [(i, " ".join(rnd.choices(vocab, weights=[30, 10, 5, 3, 2, 1, 1], k=rnd.randint(1, 8)))) for i in range(300)]
    qs = [(j, " ".join(rnd.sample(vocab, rnd.randint(1, 3)))) for j in range(40)] + [(99, "nothing here")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame(qs, "query_id long, text string")
    post = ix.build_postings(d, "text", ["doc_id"])
    got = sorted(tuple(r) for r in sr.batch_text_search(q, post, "query_id", "text", ["doc_id"]).collect())
    want = sorted((j, i) for j, qt in qs for i, dt in docs if set(qt.split()) <= set(dt.split()) and qt != "nothing here")
    assert got == want


def test_search_text_single_query(spark):
    d = spark.createDataFrame([(1, "cold widget"), (2, "cold"), (3, "Widget COLD x")], "doc_id long, text string")
    post = ix.build_postings(d, "text", ["doc_id"])
    assert sorted(r["doc_id"] for r in sr.search_text(post, "COLD widget", ["doc_id"]).collect()) == [1, 3]
    assert sr.search_text(post, "a an the", ["doc_id"]).count() == 0


def test_similar_sets_matches_brute_force(spark):
    rnd = random.Random(5)
    sets = {f"s{i}": set(rnd.sample(range(25), rnd.randint(1, 10))) for i in range(40)}
    sets["dup1"] = {1, 2, 3}
    sets["dup2"] = {1, 2, 3}
    rows = [(s, t) for s, ts in sets.items() for t in ts]
    df = spark.createDataFrame(rows, "s string, t int")
    for th in (0.3, 0.5, 0.8):
        got = {(r["a"], r["b"]): r["k"] for r in links.similar_sets(df, "s", "t", th).collect()}
        want = {}
        for a, b in itertools.combinations(sorted(sets), 2):
            k = len(sets[a] & sets[b])
            if k / len(sets[a] | sets[b]) >= th:
                want[(a, b)] = k
        assert got == want, th


def simulate_hot(times, ttl, hot_ttl, promote_after):
    out, count, cur_ttl, last = [], 0, ttl, None
    for t in times:
        if last is None or (t - last).total_seconds() > cur_ttl:
            count, cur_ttl, hit, promo = 1, ttl, False, False
        else:
            count += 1
            hit, promo = True, False
            if count > promote_after and cur_ttl == ttl:
                cur_ttl, promo = hot_ttl, True
        out.append((hit, promo))
        last = t
    return out


def test_hot_keys_closed_form_matches_state_machine(spark):
    rnd = random.Random(6)
    rows, base = [], datetime(2024, 1, 1)
    for key in ("a", "b", "c"):
        t = base
        for i in range(400):
            t += timedelta(seconds=rnd.choice([5, 60, 250, 299, 300, 301, 450, 599, 600, 601, 900, 3000]))
            rows.append((key, t, i))
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, id long")
    acc = hotkeys.hot_key_accesses(df, ["k"], "ts", "id", 300, 600, 3, bucket_seconds=1800)
    got = {(r["k"], r["id"]): (r["hit"], r["promotion"]) for r in acc.collect()}
    for key in ("a", "b", "c"):
        seq = sorted((t, i) for k, t, i in rows if k == key)
        sim = simulate_hot([t for t, _ in seq], 300, 600, 3)
        assert [got[(key, i)] for _, i in seq] == sim


def test_gap_sessions_across_buckets(spark):
    rnd = random.Random(7)
    rows, t = [], datetime(2024, 1, 1)
    for i in range(500):
        t += timedelta(minutes=rnd.choice([1, 5, 30, 59, 60, 61, 200]))
        rows.append((1, t, i))
    df = spark.createDataFrame(rows, "u long, ts timestamp_ntz, id long")
    got = sorted((r["first_ts"], r["n"]) for r in metrics.session_summary(
        metrics.gap_sessions(df, ["u"], "ts", "id", 3600, bucket_seconds=7200), ["u"]).collect())
    want, start, n, prev = [], None, 0, None
    for _, ts, _ in rows:
        if prev is None or (ts - prev).total_seconds() >= 3600:
            if start is not None:
                want.append((start, n))
            start, n = ts, 0
        n += 1
        prev = ts
    want.append((start, n))
    assert got == sorted(want)


def test_truncate_items_reference_rules(spark):
    texts = ["a" * 40, "b" * 40, "c" * 200, "d" * 40, "e" * 40]  # 10, 10, 50, 10, 10 tokens
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "g int, i int, text string")
    out = sorted(bo.truncate_items(df, ["g"], ["i"], "text", 40).collect(), key=lambda r: r["pos"])
    assert [r["text"] for r in out[:2]] == texts[:2]
    assert out[2]["text"] == "c" * 80 + "... [truncated]"  # 20 tokens left -> 80 characters
    assert out[3]["is_summary"] and out[3]["_truncated_items"] == 2 and out[3]["_total_items"] == 5


def test_truncate_fields_priority_and_order(spark):
    fields = [("metadata", "m" * 40), ("summary", "s" * 400), ("index", "i" * 40), ("zeta", "z" * 40),
              ("alpha", "a" * 40), ("beta", "b" * 400)]
    df = spark.createDataFrame([(1, f, v) for f, v in fields], "g int, field string, value string")
    out = {r["field"]: r for r in bo.truncate_fields(df, ["g"], target=60).collect()}
    assert set(out) == {"metadata", "index", "alpha", "beta", "_truncated"}  # summary skipped (too big)
    assert out["beta"]["value"] == "b" * 120 + "... [truncated]"  # 60-10-10-10 = 30 tokens left
    assert out["_truncated"]["_original_size"] == 6 and out["_truncated"]["_included_fields"] == 4


def test_keyset_pages_cover_all_rows(spark):
    df = spark.createDataFrame([(i, float(i % 7)) for i in range(95)], "k long, v double")
    order = [("v", False), ("k", True)]
    seen, cursor = [], None
    while True:
        page = paging.keyset_page(df, order, 20, after=cursor)
        rows = page.collect()
        if not rows:
            break
        seen += [r["k"] for r in rows]
        cursor = paging.last_key(page, order)
    want = [k for k, _ in sorted(((i, float(i % 7)) for i in range(95)), key=lambda x: (-x[1], x[0]))]
    assert seen == want
    hm = paging.with_has_more(df, order, 95).select("has_more").distinct().collect()
    assert [r[0] for r in hm] == [False]
    hm2 = paging.with_has_more(df, order, 95, mode="at_least").select("has_more").distinct().collect()
    assert [r[0] for r in hm2] == [True]


def test_budget_scans_across_buckets(spark):
    rnd = random.Random(8)
    rows = [(g, i, "x" * rnd.randint(0, 60)) for g in range(5) for i in range(rnd.randint(1, 40))]
    df = spark.createDataFrame(rows, "g int, i int, text string")
    got = {(r["g"], r["i"]): (r["cum_tokens"], r["kept"])
           for r in bo.running_budget(df.withColumn("tok", F.ceil(F.length("text") / 4)), ["g"], ["i"], "tok", 50,
                                      bucket_width=3).collect()}
    out = {(r["g"], r["pos"], r["is_summary"]): r for r in bo.truncate_items(df, ["g"], ["i"], "text", 50, bucket_width=3).collect()}
    for g in range(5):
        items = [t for gg, _, t in rows if gg == g]
        cum, first_over = 0, None
        for i, t in enumerate(items):
            cum += -(-len(t) // 4)
            assert got[(g, i)] == (cum, cum <= 50)
            if cum > 50 and first_over is None:
                first_over = i
        kept = [k for k in out if k[0] == g and not k[2]]
        limit = len(items) if first_over is None else first_over + 1
        assert {k[1] for k in kept} <= set(range(limit)) and {k[1] for k in kept} >= set(range(min(limit, first_over or limit)))
        if first_over is not None and first_over < len(items) - 1:
            assert out[(g, first_over + 1, True)]["_truncated_items"] == len(items) - first_over - 1


def _cycle_nodes(edges):
    """Brute force: nodes left after peeling sources and sinks one at a time."""
    e = set(edges)
    while True:
        srcs = {a for a, _ in e}
        dsts = {b for _, b in e}
        keep = {(a, b) for a, b in e if a in dsts and b in srcs}
        if keep == e:
            return {a for a, _ in e}
        e = keep


def test_cyclic_core_long_chains_and_cycles(spark):
    rnd = random.Random(9)
    edges = [(i, i + 1) for i in range(0, 300)]                 # a long chain into ...
    edges += [(300, 301), (301, 302), (302, 300)]              # ... a 3-cycle
    edges += [(302, 400 + i) for i in range(1)] + [(400 + i, 401 + i) for i in range(150)]  # a long tail out of it
    edges += [(1000 + i, 1000 + (2 * i + 1) % 97) for i in range(200)]  # a functional graph with several cycles
    edges += [(rnd.randrange(2000, 2060), rnd.randrange(2000, 2060)) for _ in range(90)]  # a random dense part
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {r["node"] for r in links.cyclic_core(df).collect()}
    assert got == _cycle_nodes(edges)


def test_key_points_corner_follows_first_row_length(spark):
    from gridlake.operators import profile

    cells = spark.createDataFrame([("wb", "S", 0, 1, 3, "h"), ("wb", "S", 0, 7, 1, "x"), ("wb", "T", 1, 2, 1, "y")],
                                  "workbook string, sheet string, sheet_idx int, row long, col int, value string")
    got = sorted((r["sheet"], r["ref"], r["role"]) for r in profile.key_points(cells).collect())
    assert got == sorted([("S", "A1", "corner"), ("S", "A1", "header"), ("S", "B1", "header"), ("S", "C1", "header")]
                         + [("S", f"A{i}", "first_col") for i in range(1, 6)]
                         + [("T", "A1", "first_col"), ("T", "A2", "first_col")])
