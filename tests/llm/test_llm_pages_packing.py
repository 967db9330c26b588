"""HTML extraction, WARC archives, packing and the pipeline."""

import base64
import gzip
import hashlib
import json
import math
import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

import corpus_pipeline
from gridlake.llm import html_extract, packing, warc
from gridlake.llm.html_blocks import blocks_of


def texts(page):
    return [b.text for b in blocks_of(page)]


def test_blocks():
    assert texts(None) == texts("") == texts("<p> \n </p>") == []
    assert texts("a<p>b <b>c</b>d<br>e\n f</p>g") == ["a", "b cd e f", "g"]
    assert texts("<script>var t='</p>';if(a<b){}</script><style>p{}</style><!-- <p>x</p> --><title>t</title><p>y") == ["y"]
    assert texts("<ul><li>a<li>b</ul><p><b>c<br><p>d &amp; &eacute;&nbsp;&#x41;") == ["a", "b", "c", "d & é A"]
    assert texts("<p>1 < 2 and <a title='x>y' href=\"z>\">l</a></p><SCRIPT>x</script >t") == ["1 < 2 and l", "t"]
    assert texts("<table><tr><td>a<td>b<tr><td>c</table><textarea>no</textarea>d<![CDATA[x]]><p") == ["a", "b", "c", "d"]
    deep = blocks_of('<div class="sideBar top-menu" id=x1><p>q <a href=/>zz</a></p></div>')[0]
    assert deep.path == (("div", ("side", "bar", "top", "menu", "x")), ("p", ())) and deep.linked == 2
    assert len(texts("<p>w</p>" * 20_000)) == 20_000
    assert texts('<p title="' + "x" * 10_000 + "<p>y") == ["y"]


def test_hidden_elements_end_with_their_parent():
    article = "<article><h1>t</h1><p>x</p></article>"
    for name in ("svg", "object", "video", "audio", "canvas", "template", "select", "button"):
        more = f"<p>y</p><{name}>no</{name}><p>z</p>"
        for start in (f"<{name} a='b'/>", f"<{name} a=b />", f"<{name}>", f"<{name.upper()} a=b>"):
            assert texts(f"<body><div>{start}</div>{article}{more}</body>") == ["t", "x", "y", "z"]
            assert texts(f"<body>{start}{article}{more}") == ["t", "x", "y", "z"]
            assert texts(f"<body><article><p>{start}a<p>x</article>{more}</body>") == ["a", "x", "y", "z"]
        assert texts(f"<p>a<{name}>no<{name}>no<p>no</{name}>no<ul><li>no</ul></{name}>b</p>{article}") == ["a b", "t", "x"]
        assert texts(f"<{name}>no<p>no<li>no</{name.upper()} >b") == ["b"]
        assert texts(f"<{name}><div>a</div><script></{name}></script></div><b>c</b>") == ["a", "c"]
        assert len(texts(f"<{name}><p>w</p>" * 20_000)) == 20_000
    assert texts("<object data=/a/>no</object><svg a=b/>c</svg>") == ["c"]
    assert texts("<svg><path d='M0'/><svg/><title>no</title><g>no</g></svg><p>x") == ["x"]


def test_labeller_on_held_out_pages_and_tables(spark, sf_dir):
    net = html_extract.train()
    data = html_extract.labelled_pages(150, seed=1234)
    p = html_extract.probabilities(net, [html_extract.vectors(b) for b, _ in data])
    right = np.concatenate([(a >= 0.5) == (y == 1) for a, (_, y) in zip(p, data, strict=True)])
    assert right.mean() > 0.97
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).collect()}
    same = 0
    for r in rows:
        want = "\n\n".join(b.text for b in blocks_of(r["html"]) if any(t == "article" for t, _ in b.path))
        same += got[r["page_id"]] == want
    assert same >= 0.99 * len(rows)


def test_extract_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None, 1), (None, "u", "", 2), (1, None, None, 1)], "page_id long, url string, html string, text int")
    out = html_extract.extract(df).collect()
    assert [(r["page_id"], r["url"], r["text"]) for r in out] == [(1, None, ""), (None, "u", ""), (1, None, "")]
    assert html_extract.extract(df.limit(0)).collect() == []


def test_network_reads_padding_and_order_alike():
    net = html_extract.train()
    pages = [html_extract.vectors(b) for b, _ in html_extract.labelled_pages(20, seed=5)]
    alone = [html_extract.probabilities(net, [x])[0] for x in pages]
    for a, b in zip(alone, html_extract.probabilities(net, pages), strict=True):
        assert np.allclose(a, b, atol=1e-5)


def test_warc_round_trip(spark, tmp_path):
    long = "<p>" + "é" * 200
    rows = [(5, "http://a/b c?x=%20é", long), (3, None, long), (9, "u", long), (1, "u", "short"), (2, "u", "short"), (4, "u", None),
            (6, "u", ""), (None, "n", long), (7, "u", "x\r\n\r\ny" * 40), (8, "u", "WARC/1.1\r\n\r\n" * 30), (3, None, long)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, offset int")
    folder = f"{tmp_path}/an é dir"
    index = warc.archive_pages(df, folder)
    got = warc.read_records(index).collect()
    assert len(got) == len(rows) and all(r["digest_ok"] for r in got)
    by = {}
    for r in got:
        by.setdefault(r["page_id"], []).append(r)
    for page_id, url, text in rows:
        raw = (text or "").encode()
        for r in by[page_id]:
            assert (r["payload_bytes"], r["payload_digest"], r["url"]) == (len(raw), hashlib.sha256(raw).hexdigest(), url)
            revisit = text == long and page_id != 3
            assert (r["record_type"], r["refers_to"]) == (("revisit", 3) if revisit else ("response", None))
            assert r["payload"] == (None if revisit else raw)
    side = [json.loads(x) for f in (tmp_path / "an é dir" / "members").glob("*.idx") for x in f.read_text().splitlines()]
    assert len(side) == len(rows)
    for s in side[:3]:  # each record is a member of its own
        with open(s["archive"], "rb") as f:
            f.seek(s["offset"])
            assert gzip.decompress(f.read(s["length"])).startswith(b"WARC/1.1\r\n")


def test_deep_and_long_pages_take_linear_time():
    import time

    def seconds(page):
        began = time.perf_counter()
        blocks = blocks_of(page)
        html_extract.vectors(blocks[-50:], np.ones(len(blocks), np.int64), len(blocks) - 50)
        return len(blocks), time.perf_counter() - began

    for unit in ("<div>x", "<title>x<p>y", "<p>x", "<b>x<i>", "<li>x<td>", "<div><select>x"):
        n = 150_000 // len(unit)
        small, large = seconds(unit * n), seconds(unit * (6 * n))
        assert large[1] < 20 * max(small[1], 0.05), unit
    assert seconds("<div>x" * 170_000)[0] == 170_000


def plain_chances(net, x):
    """The bidirectional LSTM by single numbers."""
    size, sig = html_extract.HIDDEN, lambda v: 1 / (1 + math.exp(-v))
    score = [float(net.w["bo"][0])] * len(x)
    for half, d in enumerate("fb"):
        wx, wh, bias = (net.w[f"{n}{d}"].astype(float) for n in ("wx", "wh", "b"))
        h, c = [0.0] * size, [0.0] * size
        for k in range(len(x)) if d == "f" else reversed(range(len(x))):
            gate = [bias[j] + sum(x[k][i] * wx[i][j] for i in range(len(x[k])) if x[k][i]) + sum(h[i] * wh[i][j] for i in range(size)) for j in range(4 * size)]
            for j in range(size):
                c[j] = sig(gate[size + j]) * c[j] + sig(gate[j]) * math.tanh(gate[3 * size + j])
            h = [sig(gate[2 * size + j]) * math.tanh(c[j]) for j in range(size)]
            score[k] += sum(h[j] * float(net.w["wo"][half * size + j]) for j in range(size))
    return [sig(v) for v in score]


def test_network_matches_plain_numbers_and_windows():
    net = html_extract.train(pages=60, epochs=1)
    pages = [b for b, _ in html_extract.labelled_pages(6, seed=12)]
    together = html_extract.probabilities(net, [html_extract.vectors(b) for b in pages])
    for blocks, found in zip(pages, together, strict=True):
        assert np.allclose(found, html_extract.long_probabilities(net, blocks, window=7), atol=1e-4)
    assert np.allclose(together[0], plain_chances(net, html_extract.vectors(pages[0]).tolist()), atol=1e-3)


def test_warc_of_very_long_urls(spark, tmp_path):
    rows = [(1, "http://a/" + "% é" * 700_000, "x"), (2, "u", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.read_records(warc.archive_pages(df, f"{tmp_path}/long")).collect()
    assert sorted((r["page_id"], r["url"], r["payload"].decode()) for r in got) == rows


def test_warc_of_an_empty_table_and_of_damaged_files(spark, tmp_path):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_records(warc.archive_pages(empty, f"{tmp_path}/none")).collect() == []
    head, http = warc.record_head(1, "u", 5, "d", None)
    record = head + http + b"hello\r\n\r\n"
    whole, cut = tmp_path / "whole.gz", tmp_path / "cut.gz"
    whole.write_bytes(gzip.compress(record) + gzip.compress(record + record))  # several members are one stream, too
    cut.write_bytes(gzip.compress(record + record[:-20]))
    files = spark.createDataFrame([(str(whole),), (str(cut),), (str(tmp_path / "absent.gz"),)], "archive string")
    index = warc.normalise(files, f"{tmp_path}/out")
    assert index.where("error is null").count() == 4 and index.where("error is not null").count() == 2
    assert {bytes(r["payload"]) for r in warc.read_records(index).collect()} == {b"hello"}


PLAIN = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def foreign(kind, body, **fields):
    lines = ["WARC/1.0", f"WARC-Type: {kind}", *[f"{k.replace('_', '-')}: {v}" for k, v in fields.items()], f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def test_warc_of_another_writer(spark, tmp_path):
    sha1 = "sha1:" + base64.b32encode(hashlib.sha1(b"hello").digest()).decode()
    records = [foreign("warcinfo", b"software: x\r\n", WARC_Record_ID="<urn:uuid:1>"),
               foreign("request", b"GET / HTTP/1.1\r\n\r\n", WARC_Record_ID="<urn:uuid:2>", WARC_Target_URI="http://a/"),
               foreign("response", b"HTTP/1.1 200 OK\r\nX: y\r\n\r\nhello", WARC_Record_ID="<urn:uuid:3>", WARC_Target_URI="http://a/%zz", WARC_Payload_Digest=sha1),
               foreign("response", b"HTTP/1.1 200 OK\r\n\r\nhello", WARC_Payload_Digest="sha1:WRONG"),
               foreign("revisit", b"", WARC_Record_ID="<urn:uuid:5>", WARC_Payload_Digest=sha1, WARC_Refers_To="<urn:uuid:3>"),
               foreign("resource", b"raw", WARC_Record_ID="<urn:uuid:6>", WARC_Payload_Digest="md5:00"), foreign("metadata", b"")]
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(b"".join(records)))
    index = warc.normalise(spark.createDataFrame([(str(tmp_path / "a.warc.gz"),)], "archive string"), f"{tmp_path}/out")
    got = sorted((tuple(r[c] for c in ("record_id", "record_type", "page_id", "url", "payload_bytes", "digest_ok", "refers_to_id", "payload"))
                  for r in warc.read_records(index).collect()), key=str)
    hello = hashlib.sha256(b"hello").hexdigest()
    assert got == sorted([
        ("<urn:uuid:1>", "warcinfo", None, None, 13, None, None, b"software: x\r\n"),
        ("<urn:uuid:2>", "request", None, "http://a/", 18, None, None, b"GET / HTTP/1.1\r\n\r\n"),
        ("<urn:uuid:3>", "response", None, "http://a/%zz", 5, True, None, b"hello"), (None, "response", None, None, 5, False, None, b"hello"),
        ("<urn:uuid:5>", "revisit", None, None, None, None, "<urn:uuid:3>", None),
        ("<urn:uuid:6>", "resource", None, None, 3, None, None, b"raw"), (None, "metadata", None, None, 0, None, None, b"")], key=str)
    assert {r["payload_digest"] for r in warc.read_records(index).where("record_type = 'response'").collect()} == {hello}


def test_every_archive_is_a_task(spark, tmp_path):
    for k in range(20):
        (tmp_path / f"{k}.warc.gz").write_bytes(gzip.compress(foreign("resource", b"%d" % k, WARC_Record_ID=f"<urn:page:{k}>") * 3))
    files = spark.createDataFrame([(str(f),) for f in tmp_path.glob("*.gz")], "archive string")
    index = warc.normalise(files, f"{tmp_path}/out")
    dealt = warc.dealt(files)
    assert dealt.rdd.getNumPartitions() == 20 and set(dealt.rdd.glom().map(len).collect()) == {1}
    spread = warc.read_records(index, part_bytes=100)
    assert sorted(r["payload"] for r in spread.collect()) == sorted(b"%d" % k for k in range(20) for _ in range(3))
    assert spread.rdd.getNumPartitions() > 20


def whole_ids(text):
    """Ids of the library as it is, and the end id."""
    return [*PLAIN.encode(text or "", add_special_tokens=False).ids, 2]


def check_packing(rows, got, capacity=1024):
    want = []
    for doc_id, text in rows:
        ids = whole_ids(text)
        for k, (start, n) in enumerate(packing._spans(len(ids), capacity)):
            want.append((doc_id, k, start, n, zlib.crc32(np.array(ids[start:start + n], "<u4").tobytes())))
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])) for r in got)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    return len(by), sum(r["length"] for r in got) / capacity


def test_packing_is_whole_and_tight(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = packing.pack(packing.token_pieces(docs)).collect()
    bins, least = check_packing([(r["doc_id"], r["text"]) for r in docs.collect()], got)
    assert bins <= least * 1.015 + 2


def test_packing_odd_rows(spark):
    texts = [None, "", " ", "a  b", "\n\nx", "tab\tbed", "x " * 3000, "<|endoftext|>", "a <|endoftext|> b", "it's 'so'", "x" * 1023 + " y"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "a"), (None, "a"), (3, "a  b")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, length int")
    check_packing(rows, packing.pack(packing.token_pieces(df)).collect())
    check_packing(rows, packing.pack(packing.token_pieces(df, capacity=16), 16, bucket_rows=40).collect(), 16)
    assert packing.pack(packing.token_pieces(df.limit(0))).collect() == []
    ids = packing.sequences(packing.pack(packing.token_pieces(df, with_ids=True))).collect()
    assert sum(len(r["ids"]) for r in ids) == sum(len(whole_ids(t)) for _, t in rows)


def test_word_encoder_equals_the_library():
    encoder, rng = packing.WordEncoder("byte_bpe_50k.json", limit=50), random.Random(8)
    parts = ["a", "b", " ", "'s", "t", "\n", "\t", "1", "23", ".", ",", "!", "é", "<|endoftext|>", "_", "ñ", "'re", "日本", "Word", " ", "ǅ"]
    assert whole_ids("a <|endoftext|> b") == [64, 220, 50256, 275, 2]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 20)))
        assert encoder(t) == np.array(whole_ids(t)[:-1], "<u4").tobytes()


class Counted:
    """A tokenizer that counts the characters it is given."""

    def __init__(self, tokenizer):
        self.own, self.chars = tokenizer, 0

    def encode(self, text, **k):
        self.chars += len(text)
        return self.own.encode(text, **k)

    def encode_batch_fast(self, texts, **k):
        self.chars += sum(map(len, texts))
        return self.own.encode_batch_fast(texts, **k)


def test_repeated_parts_reach_the_library_once():
    """Also those of texts with runs of white space, which used to be encoded whole, again and again."""
    encoder = packing.WordEncoder("byte_bpe_50k.json")
    text = "one  two\n\nthree (four)\tfive; naïve Ωμέγα words, 1234 times \u00a0 'so'"
    want = np.array(whole_ids(text)[:-1], "<u4").tobytes()
    encoder.tokenizer = Counted(encoder.tokenizer)
    assert all(encoder(text) == want for _ in range(100))
    assert encoder.tokenizer.chars <= len(text)


def test_texts_encoded_together_equal_the_library():
    """White space of all kinds, controls, contractions and marks, over many small groups of texts and resets of the known parts."""
    rng = random.Random(9)
    parts = ["a", " ", " ", "'s", "'", "''", "s", "\n", "\t", "\r\n", "7", ".", "(", "é", "日本", "Word", " word", "\x1c", "\x85", "\u00a0", "\u2003",
             "\u200b", "\u3000", "\u180e", "”", "\x00", "\ufeff", "\U0001f600", "<|endoftext|>", "ſ", "Ωμ", "  ", "\n\n"]
    texts = [None if k % 50 == 0 else "".join(rng.choice(parts) for _ in range(rng.randint(0, 16))) for k in range(6000)]
    encoder = packing.WordEncoder("byte_bpe_50k.json", limit=3000, most=500)
    column = pa.record_batch({"text": pa.array(["not read", *texts])}).slice(1)
    got = []
    for group in encoder.together(column, 0):
        ids, ends = encoder.encode(group.column(0), (2,))
        assert len(group) == 1 or sum(len((t or "").encode()) for t in group.column(0).to_pylist()) <= 3000
        got += [x.tolist() for x in np.split(ids, ends)[:-1]]
    assert got == [whole_ids(t) for t in texts]
    assert len(encoder.known) < 2000


def test_memory_of_known_parts_is_bounded():
    """300,000 different words: what the encoder keeps of them, in Python and in Arrow, stays under 16 MB."""
    rng = random.Random(4)
    lines = [" ".join("".join(rng.choices("abcdefghijklmnop", k=9)) for _ in range(1000)) for _ in range(300)]
    encoder = packing.WordEncoder("byte_bpe_50k.json")
    encoder(lines[0])
    before = pa.total_allocated_bytes()
    tracemalloc.start()
    for line in lines:
        encoder(line)
    held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before
    tracemalloc.stop()
    assert held < 16 << 20


def brute_sum_of_squares(lengths, capacity):
    gaps, out = [], []
    for s in lengths:
        best = None
        for b in [k for k, g in enumerate(gaps) if g >= s] or [None]:
            own = list(gaps)
            if b is None:
                own.append(capacity - s)
            else:
                own[b] -= s
            total = sum(own.count(g) ** 2 for g in set(own) if g > 0)
            left = capacity if b is None else gaps[b]
            if best is None or (total, left) < best[:2]:
                best = (total, left, own)
        gaps = best[2]
        out.append(best[0])
    return out, len(gaps)


def test_sum_of_squares_rule():
    rng = random.Random(3)
    for _ in range(40):
        lengths = [rng.randint(1, 12) for _ in range(30)]
        where, offset = packing.sum_of_squares(np.array(lengths), 12)
        gaps, sums = {}, []
        for b, s in zip(where, lengths, strict=True):
            gaps[b] = gaps.get(b, 12) - s
            own = list(gaps.values())
            sums.append(sum(own.count(g) ** 2 for g in set(own) if g > 0))
        want, bins = brute_sum_of_squares(lengths, 12)
        assert sums == want and bins == len(gaps)


def test_pipeline(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "jaccard join", "decontamination", "secret scan", "best-fit packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows, sizes = docs, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        rows = spark.createDataFrame(stage(spark, rows, sf_dir).collect(), docs.schema)
        assert rows.columns == docs.columns
        sizes.append(rows.count())
    assert docs.count() > sizes[0] > sizes[1] >= sizes[2] == sizes[3] > 0.6 * docs.count()
    got = corpus_pipeline.run(spark, sf_dir).collect()
    check_packing([(r["doc_id"], r["text"]) for r in rows.collect()], got)


def test_pipeline_on_odd_rows(spark, sf_dir):
    """Null texts go at the first stage, repeated rows and copies at the second; other columns, also of the stages' own
    names, stay until the last."""
    rng = random.Random(12)
    words = [f"{a}{b}{c}" for a in ("ver", "mon", "tal", "ris") for b in ("a", "e", "o") for c in ("n", "st", "ndo", "l", "re")]
    texts = [" ".join(rng.choice(words) + ("." if k % 9 == 8 else "") for k in range(80)) for _ in range(12)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, texts[3]), (40, texts[5]), (41, texts[6] + " extra"), (None, texts[7]), (50, None), (51, ""), (None, None)]
    names = ["kept", "n_words", "component_id", "items", "spans", "piece", "_id", "n_chars"]
    df = spark.createDataFrame([(i, t, *[k] * 7, len(t or "")) for k, (i, t) in enumerate(rows)],
                               "doc_id long, text string, " + ", ".join(f"{n} long" for n in names))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, sf_dir)
        assert out.columns == df.columns
        df = spark.createDataFrame(out.collect(), df.schema)
    left = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert sorted(i for i, _ in left if i is not None) == list(range(12))
    assert [t for i, t in left if i is None] == [texts[7]]
    check_packing(left, corpus_pipeline.STAGES[-1][1](spark, df, sf_dir).collect())


def test_pipeline_on_an_empty_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, sf_dir)
        assert rows.collect() == []
        rows = spark.createDataFrame([], rows.schema)
