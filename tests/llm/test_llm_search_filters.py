"""URL filter, lexical search, filter audit: against plain Python on the driver's tables and on odd rows."""

import math
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlake.llm import filter_audit, lexical_search, url_filter

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RULES = "host string, path string, verdict string"


def brute_url(url, rules, words):
    rest = (url or "").partition("://")[2]
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host):])[0]
    host = host.translate(LOW)
    fits = [(len(h) + len(p), len(h), v == "block", h + p) for h, p, v in rules if None not in (h, p, v) and host
            for h in [h.translate(LOW)] if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        _, _, blocks, rule = max(fits)
        return host, path, rule, "block" if blocks else "allow"
    return host, path, None, "block" if set(re.split("[^0-9a-z]+", host)) & set(words) - {""} else "allow"


@pytest.mark.parametrize(("share", "max_bytes"), [(None, 1 << 20), (0.5, 40)])
def test_urls_match_brute_force(spark, share, max_bytes):
    rng = random.Random(3)
    hosts = ["com", "example.com", "www.Example.com", "a.b.example.com", "net", "x.net", "free-bets.org", "bets.x.net", "b", "évil.org", "a..net"]
    paths = ["", "/", "/en/", "/en", "/english/x", "/es/1", "/fr/2?q=/es/", "/EN/", "/en/deep/er"]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '#x', '?a://b', '/z'])}" for _ in range(300)]
    urls += [None, "", "no scheme", "://", "http://", "http:///en/", "x://y://z.net/es/", "http://a.com?x/en/", "http://" + "l." * 3000 + "net/es/" + "p" * 5000]
    rules = url_filter.RULES + [(f"h{k}.net", "/en", "block") for k in range(40)] + [
        ("net", "/es/", "allow"), ("x.net", "/en", "allow"), ("b.example.com", "/en/d", "block"), (None, "/", "block"), ("org", None, "block"), ("X.net", "", "block")]
    words = ["bets", "évil", "x9", "b"]
    pages = spark.createDataFrame([(k % 200 if k else None, u, "h", "v") for k, u in enumerate(urls)],
                                  "page_id long, url string, host string, verdict string")
    got = url_filter.judge_urls(pages, spark.createDataFrame(rules, RULES), spark.createDataFrame([(w,) for w in [*words, None, "bets"]], "word string"),
                                share, max_bytes).collect()
    assert Counter(tuple(r) for r in got) == Counter((k % 200 if k else None, *brute_url(u, rules, words)) for k, u in enumerate(urls))


def test_cascade_is_exact_with_many_levels(spark):
    universe = spark.range(4_000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.where("hash(key) % 7 = 0").unionByName(spark.createDataFrame([("elsewhere",), (None,)], "key string"))
    cascade = url_filter.build_cascade(listed.unionByName(listed), universe.unionByName(universe), 4_000, share=0.4)
    assert len(cascade.levels) >= 4
    bad = universe.where(cascade.contains(F.col("key")) != (F.expr("hash(key) % 7 = 0")))
    assert bad.count() == 0
    small = url_filter.build_cascade(listed, universe, 4_000)
    assert universe.where(small.contains(F.col("key"))).count() == listed.where("key like 'k%'").count()
    assert url_filter.build_cascade(listed.limit(0), universe, 5).levels == []


def test_urls_of_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    none, no_words = spark.createDataFrame([], RULES), spark.createDataFrame([], "word string")
    assert [tuple(r) for r in url_filter.judge_urls(pages, none, no_words).collect()] == [(1, "a.com", "/x", None, "allow")]
    rules = spark.createDataFrame(url_filter.RULES, RULES)
    assert url_filter.judge_urls(pages.limit(0), rules, no_words).collect() == []
    nodes = url_filter.judge_urls(pages, rules, no_words)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in nodes and "Python" not in nodes and "Arrow" not in nodes


TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_search(docs, items, k=10):
    """docs: rows (doc_id, text); items: rows (item_id, text)."""
    terms = lambda t: TERM.findall((t or "").translate(LOW))
    counts = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    wanted = defaultdict(Counter)
    for i, t in set(items):
        wanted[i].update(terms(t))
    out = []
    for item, q in wanted.items():
        found = []
        for doc_id, c in counts:
            m = 100 - 75 + 75 * c.total() * n_docs // max(total, 1)
            score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                        for t, times in q.items() if t in c)
            if score > 0:
                found.append((-score, doc_id is not None, doc_id or 0))
        out += [(item, rank + 1, d if has else None, -s) for rank, (s, has, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_search_matches_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    want = brute_search([(r["doc_id"], r["text"]) for r in docs.collect()], [tuple(r) for r in bench.select("item_id", "text").collect()])
    assert rows_of(lexical_search.search(docs, bench)) == want
    assert rows_of(lexical_search.search(docs.repartition(5), bench, block_bytes=2000, chunk_entries=400, depth=1)) == want


def test_search_of_odd_rows(spark):
    rng = random.Random(8)
    words = ["Ab", "c", "dé", "x1", "Zz", "日本"] + [f"r{k}" for k in range(30)]
    docs = [(k % 150, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 40])))) for k in range(300)]
    docs += [(7, "tie one"), (5, "tie one"), (None, "tie one"), (5, "tie one"), (900, None), (901, "... !"), (902, "c " * 60_000 + "Zz")]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 9])))) for k in range(12)]
    items += [(50, "TIE-one tie"), (51, None), (52, "?"), (None, "ab x1"), (60, "c"), (60, "r3 r3"), (60, "c"), (61, "absent words")]
    d = spark.createDataFrame([(i, t, 0, i) for i, t in docs], "doc_id long, text string, score int, item_id long")
    b = spark.createDataFrame([(i, t, i) for i, t in items], "item_id long, text string, doc_id long")
    for k in (10, 3):
        assert rows_of(lexical_search.search(d, b, k, chunk_entries=50, depth=2)) == brute_search(docs, items, k)
    assert rows_of(lexical_search.search(d.limit(0), b)) == [] == rows_of(lexical_search.search(d, b.limit(0)))


def test_nra_reads_no_more_than_it_needs():
    rng = np.random.default_rng(1)
    n = rng.integers(50, 500, 5000)
    sizes = np.full(5000, 2)
    lists = lexical_search.ImpactLists(n, np.tile([0, 1], 5000), rng.integers(1, 60, 10_000), sizes, 5000, int(n.sum()))
    all_scores = sum(np.bincount(lists[t][0], lists[t][1] * w, 5000).astype(np.int64) for t, w in ((0, 3), (1, 5)))
    docs, scores = lexical_search.nra(lists, [(0, 3), (1, 5)], 10, 0, 16)
    best = np.sort(all_scores)[-10:]
    assert sorted(scores)[-10:] == best.tolist() and (all_scores[docs] == scores).all() and len(docs) < 100

    class Seen(lexical_search.ImpactLists):
        def __init__(self):
            self.n = 4

        def __getitem__(self, term):
            return np.arange(4), np.array([9, 1, 1, 0])

    assert lexical_search.nra(Seen(), [(0, 2)], 1, 0, 1)[0].tolist() == [0]
    assert lexical_search.nra(Seen(), [(0, 2)], 2, 0, 1)[0].tolist() == [0, 1, 2]
    assert lexical_search.nra(Seen(), [(0, 2)], 1, 19, 1)[0].tolist() == []


def brute_audit(docs, labels):
    first = {}
    for doc_id, text, _ in docs:
        if doc_id is not None:
            first[text or ""] = min(first.get(text or "", doc_id), doc_id)
    counts = defaultdict(list)
    for doc_id, text, source in docs:
        t = text or ""
        w = t.encode().split()
        fails = {x for x, bad in zip("ABCDE", (
            len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)),
            doc_id is not None and first[t] < doc_id), strict=True) if bad}
        own = [r for r in labels if r[0] == doc_id and doc_id is not None]
        counts[source or ""].append((fails, any(q == 1 for _, q, _ in own), any(x == 1 for _, _, x in own)))
    out, shapley = [], Counter()
    for part, found in counts.items():
        for order in permutations("ABCDE"):
            left = found
            for step, f in enumerate(order):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                shapley[part, f] += len(gone)
                out.append([part, "".join(order), step + 1, len(left), len(gone), sum(f in x[0] for x in found) - len(gone),
                            sum(x[0] == {f} for x in found), sum(x[1] for x in gone), sum(x[2] for x in gone), f])
    return sorted((*r[:-1], shapley[r[0], r[-1]]) for r in out)


def test_audit_matches_brute_force(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = sorted(tuple(r) for r in filter_audit.audit(docs, labels).collect())
    assert got == brute_audit([tuple(r) for r in docs.select("doc_id", "text", "source").collect()],
                              [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])


def test_audit_of_odd_rows(spark):
    rng = random.Random(5)
    texts = [None, "", " \n", "A" * 5, "x $ y", " ".join(f"w{k}" for k in range(60)), "same " * 70, "É" * 40 + "AB", "w\x0bx " * 200_000]
    docs = [(rng.choice([None, *range(30)]), rng.choice(texts[:-1]), rng.choice([None, "", "s", "t"])) for _ in range(120)]
    docs += [(1, texts[-1], "t"), (0, texts[-1], None)]
    labels = [(k, rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for k in [*range(20), *range(10), None]]
    d = spark.createDataFrame([(i, t, s, 0, "m") for i, t, s in docs], "doc_id long, text string, source string, part int, mask string")
    label = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert sorted(tuple(r) for r in filter_audit.audit(d, label).collect()) == brute_audit(docs, labels)
    assert filter_audit.audit(d.limit(0), label).collect() == []
    assert sorted(tuple(r) for r in filter_audit.audit(d, label.limit(0)).collect()) == brute_audit(docs, [])


def test_lattice_counts_every_order():
    edges = {(s, f): p for s, f, p in filter_audit.lattice(4)}
    through = Counter()
    for order in permutations(range(4)):
        state = 0
        for f in order:
            through[state, f] += 1
            state |= 1 << f
    assert edges == dict(through)
