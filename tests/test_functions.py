"""Scalar Column functions: A1 codec, parsing, tokenising, truncation, cursors, globs."""

import base64
import json

from pyspark.sql import functions as F

from gridlake.functions import a1, budget, cursor, values
from gridlake.operators.search import glob_to_like


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_col_letters_known_points(spark):
    for n, s in [(1, "A"), (26, "Z"), (27, "AA"), (52, "AZ"), (702, "ZZ"), (703, "AAA"), (16384, "XFD")]:
        assert one(spark, a1.col_letters(F.lit(n))) == s


def test_a1_round_trip_all_columns(spark):
    df = spark.range(1, 16385).select(F.col("id").alias("n"))
    back = df.select("n", a1.ref_col(a1.cell_ref(F.col("n"), F.lit(7))).alias("c"),
                     a1.ref_row(a1.cell_ref(F.col("n"), F.lit(7))).alias("r"))
    assert back.filter((F.col("c") != F.col("n")) | (F.col("r") != 7)).count() == 0


def test_parse_location(spark):
    assert one(spark, a1.parse_location(F.lit("Data!B7"))).asDict() == {"sheet": "Data", "ref": "B7", "row": 7, "col": 2}
    assert one(spark, a1.parse_location(F.lit("no_sheet"))) is None
    assert one(spark, a1.parse_location(F.lit("a!b!C1"))) is None


def test_tokenize_rules(spark):
    t = one(spark, values.tokenize(F.lit("The  Cold widget, and an ox  ABC")))
    assert t == ["cold", "widget,", "abc"]  # stop words and <= 2-byte words dropped, punctuation kept


def test_parse_number_rejects_words(spark):
    for text, want in [("12", 12.0), (" -3.5 ", -3.5), ("1e3", 1000.0), ("NaN", None), ("Infinity", None),
                       ("1d", None), ("12abc", None), ("", None)]:
        assert one(spark, values.parse_number(F.lit(text))) == want, text


def test_parse_money_modes(spark):
    cases = [("1 234,56", 1234.56, 1234.56), ("1 234,56", 1234.56, 1234.56), ("12abc", None, 12.0),
             ("-3", -3.0, -3.0), ("", None, None)]
    for text, strict, prefix in cases:
        assert one(spark, values.parse_money(F.lit(text))) == strict, text
        assert one(spark, values.parse_money(F.lit(text), "prefix")) == prefix, text


def test_name_prefix(spark):
    for name, want in [("2024_Store 1", "2024"), ("Total 5", "Total"), ("_x", "_x"), (" y", " y"), ("plain", "plain")]:
        assert one(spark, values.name_prefix(F.lit(name))) == want


def test_truncate_text_rules(spark):
    short = "word " * 10
    assert one(spark, budget.truncate_text(F.lit(short), 100)) == short
    long_text = ("abcd " * 200).strip()
    out = one(spark, budget.truncate_text(F.lit(long_text), 100))
    assert out.endswith("... [truncated]") and len(out) <= 400 + len("... [truncated]")
    assert not out[: -len("... [truncated]")].endswith(" ")
    nospace = "x" * 1000
    assert one(spark, budget.truncate_text(F.lit(nospace), 100)) == "x" * 400 + "... [truncated]"


def test_cursor_round_trip_and_errors(spark):
    enc = one(spark, cursor.encode_cursor(F.lit("chunk_0_49"), F.lit(50), F.lit("abc"), F.lit(1000)))
    payload = json.loads(base64.urlsafe_b64decode(enc))
    assert payload == {"chunk_id": "chunk_0_49", "offset": 50, "version": 1, "checksum": "abc", "ts": 1000}
    dec = one(spark, cursor.decode_cursor(F.lit(enc), F.lit(1000 + 3600)))
    assert dec["error"] is None and dec["chunk_id"] == "chunk_0_49" and dec["offset"] == 50
    assert one(spark, cursor.decode_cursor(F.lit(enc), F.lit(1000 + 25 * 3600)))["error"] == "expired"
    assert one(spark, cursor.decode_cursor(F.lit(""), F.lit(0)))["error"] == "empty"
    assert one(spark, cursor.decode_cursor(F.lit("%%%"), F.lit(0)))["error"] == "format"
    v2 = one(spark, cursor.encode_cursor(F.lit("c"), F.lit(0), F.lit(""), F.lit(0), version=2))
    assert one(spark, cursor.decode_cursor(F.lit(v2), F.lit(0)))["error"] == "version"
    assert one(spark, cursor.checksum_matches(cursor.decode_cursor(F.lit(enc), F.lit(1000)), F.lit("abc")))


def test_glob_to_like_escapes():
    assert glob_to_like("c*d w?dget") == "c%d w_dget"
    assert glob_to_like("100%_x*") == "100\\%\\_x%"


def test_model_limits_default(spark):
    df = spark.createDataFrame([("sonnet-4-beta",), ("nope",)], "model string")
    got = {r["model"]: r["safe_buffer"] for r in budget.with_model_limits(df).collect()}
    assert got == {"sonnet-4-beta": 950000, "nope": 180000}


def test_rects_intersect(spark):
    from gridlake.operators.search import rects_intersect

    cases = [((0, 0, 10, 10), (5, 5, 10, 10), True), ((0, 0, 10, 10), (10, 0, 5, 5), False),
             ((0, 0, 10, 10), (2, 2, 1, 1), True), ((0, 0, 1, 1), (0, 1, 1, 1), False)]
    for a, b, want in cases:
        assert one(spark, rects_intersect(*[F.lit(x) for x in a + b])) is want, (a, b)


def test_bpe_counter_is_optional():
    import pytest

    try:
        budget.bpe_token_count()
    except Exception:  # noqa: BLE001 - no vocabulary offline: the estimate is the default
        pytest.skip("BPE vocabulary not available")


def test_query_tokens_match_column_tokenizer(spark):
    from gridlake.operators.search import query_tokens

    for q in ["The  Cold widget, and an ox ABC", "Ünïcode ÉTÉ été\tx\nyy zzz", "a b", "Brand#17 brand#17 ΣΑΣ"]:
        col = one(spark, F.array_distinct(values.tokenize(F.lit(q))))
        assert query_tokens(None, q) == col, q


def test_compare_predicates(spark):
    from gridlake.operators.search import compare

    df = spark.createDataFrame([(x,) for x in range(10)], "v int")
    count = lambda *a: df.filter(compare("v", *a)).count()
    assert [count("=", 3), count("<>", 3), count("<", 3), count("<=", 3), count(">", 3), count(">=", 3),
            count("between", 2, 5)] == [1, 9, 3, 4, 6, 7, 4]


def test_location_text_and_ordered_numeric(spark):
    from gridlake.operators.search import search_numeric, with_location_text

    cells = spark.createDataFrame([("wb", "Data", 7, 2, "B7", 5.0), ("wb", "Data", 1, 1, "A1", 2.0),
                                   ("wb", "Calc", 3, 1, "A3", 5.0)],
                                  "workbook string, sheet string, row long, col int, ref string, num double")
    got = [(r["location"], r["num"]) for r in with_location_text(search_numeric(cells, 1, 10, ordered=True)).collect()]
    assert got == [("Data!A1", 2.0), ("Calc!A3", 5.0), ("Data!B7", 5.0)]


def test_json_tokens(spark):
    got = one(spark, budget.json_tokens(F.struct(F.lit("abcd").alias("k"))))
    assert got == -(-len('{"v":{"k":"abcd"}}') // 4)
