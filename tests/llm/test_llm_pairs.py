"""Jaccard join, components, decontamination: against plain Python on the driver's documents and on odd rows."""

import random
from collections import Counter, defaultdict

import pytest

from gridlake.llm import decontaminate, jaccard_join
from gridlake.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def components_of(nodes, edges):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def brute_jaccard(rows, size=5, percent=80):
    sets = {}
    for doc_id, text in rows:
        w = (text or "").encode().lower().split()
        sets[doc_id] = {tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    having = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            having[x].append(i)
    edges = []
    for i, s in sets.items():
        for j, k in Counter(j for x in s for j in having[x] if j < i).items():
            if 100 * k >= percent * (len(s) + len(sets[j]) - k):
                edges.append((i, j))
    return {i: (len(sets[i]), c) for i, c in components_of(sets, edges).items()}


def test_jaccard_join_matches_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in
           jaccard_join.jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()}
    assert got == brute_jaccard(rows)


def test_jaccard_join_on_drifting_and_star_shaped_groups(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    rows, base = [], [rng.choice(words) for _ in range(90)]
    for k in range(60):  # a star: each copy is edited from the base
        own = list(base)
        for _ in range(rng.randint(0, 6)):
            own[rng.randrange(len(own))] = f"x{rng.random()}"
        rows.append((len(rows), " ".join(own)))
    chain = [rng.choice(words) for _ in range(70)]
    for k in range(40):  # a chain: each copy is edited from the one before
        chain[rng.randrange(len(chain))] = f"y{k}"
        rows.append((len(rows), " ".join(chain)))
    line = " ".join(f"common{k}" for k in range(20))
    for k in range(60):  # a passage that many documents share
        rows.append((len(rows), line + " " + " ".join(rng.choice(words) + str(k) for _ in range(rng.randint(1, 30)))))
    rows += [(len(rows), "A b\tC d"), (len(rows) + 1, "a B c D"), (len(rows) + 2, "a b c"), (len(rows) + 3, ""), (len(rows) + 4, " \n")]
    rng.shuffle(rows)
    for rounds in (0, 2):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in
               jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), hub_rounds=rounds).collect()}
        assert got == brute_jaccard(rows)


def test_jaccard_join_odd_rows(spark):
    text = " ".join(f"a{k}" for k in range(30))
    other = " ".join(f"b{k}" for k in range(30))
    rows = [(5, text, 1), (5, text, 1), (3, text + " tail", 2), (None, text, 3), (None, None, 4), (8, None, 5), (9, "", 6),
            (7, other, 7), (7, text, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(df).collect()), key=str)
    assert got == sorted([(5, 26, 3), (5, 26, 3), (3, 27, 3), (None, 26, None), (None, 0, None), (8, 0, 8), (9, 0, 9),
                          (7, 26, 3), (7, 26, 3)], key=str)
    kept = jaccard_join.first_of_each_component(df)
    assert kept.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["3", "None", "None", "8", "9"])
    assert jaccard_join.jaccard_components(df.limit(0)).collect() == []
    assert jaccard_join.first_of_each_component(df.limit(0)).collect() == []


def test_connected_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a != b]
    want = components_of({x for e in real for x in e}, real)
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def brute_hits(text, items, size=13):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = decontaminate.WORD.findall((text or "").translate(low))
    hit, ids = set(), set()
    for item_id, item in items:
        w = decontaminate.WORD.findall((item or "").translate(low))
        for win in ([w[k:k + size] for k in range(max(1, len(w) - size + 1))] if w else []):
            for k in range(len(words) - len(win) + 1):
                if words[k:k + len(win)] == win:
                    hit.update(range(k, k + len(win)))
                    ids.add(item_id)
    return words, hit, ids


@pytest.mark.parametrize("max_nodes", [1 << 20, 400])
def test_decontamination_matches_brute_force(spark, max_nodes):
    rng = random.Random(2)
    words = ["Ab", "c", "dé", "x1", "Zz", "日本"]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 12, 13, 14, 40])))) for k in range(30)]
    items += [(100, None), (101, "--- !!"), (102, items[3][1])]
    long_items = [t for _, t in items if t and len(t.split()) >= 12]
    docs = []
    for k in range(60):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))
        docs.append((k, text + rng.choice([" ", "\n", "... "]) + rng.choice(long_items).replace(" ", rng.choice([" ", ", ", "\t"])) + " end"))
    docs += [(90, None), (91, ""), (None, items[3][1]), (92, "c" + items[3][1]), (92, items[3][1])]
    df = spark.createDataFrame([(i, t, i) for i, t in docs], "doc_id long, text string, items long")
    bench = spark.createDataFrame(items + [items[0]], "item_id long, text string")
    got = sorted(str((r["doc_id"], r["n_words"], r["n_hit"], sorted(r["items"]), r["contaminated"]))
                 for r in decontaminate.find_contamination(df, bench, max_nodes=max_nodes).collect())
    want = []
    for doc_id, text in docs:
        w, hit, ids = brute_hits(text, items)
        want.append(str((doc_id, len(w), len(hit), sorted(ids), len(hit) > 0 and 20 * len(hit) >= len(w))))
    assert got == sorted(want)
    kept = decontaminate.drop_contaminated(df, bench, max_nodes=max_nodes)
    assert kept.columns == df.columns and kept.count() == sum("False" in x for x in want)


def test_decontamination_spans_and_empty_tables(spark):
    item = " ".join(f"q{k}" for k in range(13))
    text = "Prefix, É! " + item.upper().replace(" ", " - ") + "; tail"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    r = decontaminate.find_contamination(df, bench).first()
    (a, b), = decontaminate.hit_spans(text, r["firsts"], r["lasts"])
    assert (r["starts"], r["ends"]) == ([a], [b]) and text[a:b] == item.upper().replace(" ", " - ")
    assert decontaminate.find_contamination(df, bench.limit(0)).first()["n_hit"] == 0
    assert decontaminate.find_contamination(df.limit(0), bench).collect() == []


def test_one_node_per_word_of_a_window():
    rng = random.Random(6)
    items = [(k, " ".join(f"word{rng.randrange(5000)}" for _ in range(60))) for k in range(400)]
    windows = decontaminate.Windows(items, 13)
    assert windows.automaton.get_stats()["nodes_count"] <= 13 * 60 * 400
    text = " ".join(["q"] * 30 + items[7][1].split()[5:30] + ["q"] * 30 + items[9][1].split()[:12])
    assert windows.scan(decontaminate.words_of(text)) == ([(30, 55)], {7})
    assert decontaminate.Windows([(1, None), (2, "?")], 13).scan([b"a"]) == ([], set())


def test_first_of_each_component_of_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {i for i, (n, c) in brute_jaccard([(r["doc_id"], r["text"]) for r in docs.collect()]).items() if not n or i == c}
    twice = docs.unionByName(docs.where("doc_id % 3 = 0")).withColumn("_id", docs["doc_id"] * 0)
    for df in (docs, twice):
        kept = jaccard_join.first_of_each_component(df)
        assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(want)
