import itertools

from pyspark.sql import functions as F

from quillon.functions import registry, text, tokens
from quillon.operators import store

VOCABULARY = [("▁", 5, -3.0), ("▁a", 6, -1.0), ("a", 7, -2.0), ("b", 8, -2.0), ("ab", 9, -2.5), ("▁ab", 10, -4.5), ("c", 11, -9.0)]


def brute(text):
    known = {p: (i, s) for p, i, s in VOCABULARY}
    best = None
    for cuts in itertools.product((0, 1), repeat=max(0, len(text) - 1)):
        at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(text)]
        parts = [text[i:j] for i, j in itertools.pairwise(at)]
        if all(p in known or len(p) == 1 for p in parts):
            s = sum(known[p][1] if p in known else -100.0 for p in parts)
            best = max(best or s, s)
    return best


def test_best_segmentation(spark):
    known = {p: (i, s) for p, i, s in VOCABULARY}
    score = {i: s for _, i, s in VOCABULARY} | {3: -100.0}
    for text in ("▁ab", "▁abab▁ba", "▁aab▁c▁x", "▁b"):
        assert abs(sum(score[i] for i in tokens.segment(text, known, 3, 3)) - brute(text)) < 1e-9
    v = spark.createDataFrame(VOCABULARY, "piece string, id int, score double")
    rows = spark.createDataFrame([("a  b",), ("",), (None,)], "t string")
    got = [r["x"] for r in rows.select(tokens.unigram_ids("t", v, size=6).alias("x")).collect()]
    assert got == [[0, 6, 5, 8, 2, 1], [0, 2, 1, 1, 1, 1], [0, 2, 1, 1, 1, 1]]
    long = spark.createDataFrame([("a " * 50,)], "t string").select(tokens.unigram_ids("t", v, size=8).alias("x")).head()["x"]
    assert len(long) == 8 and long[-1] == 2


def test_sql_functions(spark):
    registry.register(spark)
    r = spark.sql("SELECT dot(array(1D, 2D), array(3D, 4D)) AS d, cosine(array(1D), array(0D)) AS c, l2_normalize(array(3D, 4D)) AS n, filename_key('01 - Song (Live) [x]') AS f, nfc('é') AS u").head()
    assert (r["d"], r["c"], r["n"], r["f"], r["u"]) == (11.0, None, [0.6, 0.8], "song", "é")
    m = spark.sql("SELECT vec_mean(v) AS m FROM VALUES (array(1D, 3D)), (array(3D, 5D)) AS t(v)").head()["m"]
    assert m == [2.0, 4.0]
    assert [x["variant"] for x in spark.sql("SELECT * FROM artist_parts('a; b')").collect()] == ["a; b", "a", "b"]


def test_table_function_of_artists_equals_the_column(spark):
    registry.register(spark)
    names = ["a; b", " A & B / C ", "x, y", "J.J. and K", "", "  ", "unknown artist", "R&B", ";;", None, "it's 'so'"]
    d = spark.createDataFrame([(i, a) for i, a in enumerate(names)], "id int, a string")
    of_sql = spark.sql("SELECT id, variant FROM {d}, LATERAL artist_variants(a)", d=d).collect()
    of_column = d.select("id", F.explode(text.artist_variants("a")).alias("variant")).collect()
    assert sorted(map(tuple, of_sql)) == sorted(map(tuple, of_column)) and len(of_sql) > 20


def test_settings(spark):
    s = spark.createDataFrame([("k", "7"), ("bad", "x"), ("neg", "-3")], "key string, value string")
    assert [store.positive_setting(None, s, k, 5) for k in ("k", "bad", "neg", "none")] == [7, 5, 5, 5] and store.positive_setting(9, s, "k", 5) == 9
    assert s.where(F.col("key") == "k").count() == 1
