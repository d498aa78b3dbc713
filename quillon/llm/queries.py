"""The queries opN_<name> over the driver's tables: thin, with the operators' production parameters."""

from __future__ import annotations

from quillon.llm.common import WORD, small_batches
from quillon.session import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(f=None, *, sql: str | None = None):
    """Register a query under its function's name, with its SQL if it has one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add(f) if f else add


def documents(spark, sf_dir):
    small_batches(spark)
    return table(spark, sf_dir, "documents")


@query
def op7_quality_rules(spark, sf_dir):
    from quillon.llm import quality

    docs = documents(spark, sf_dir)
    ratios = quality.fit(docs, quality.trusted_ids(table(spark, sf_dir, "labels")))
    return quality.score(docs, ratios)


#: Rules of op3 as (host, path, verdict).
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]

_URL_SQL = f"""
    WITH cut AS (
      SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    p AS (
      SELECT page_id, lower(regexp_extract(rest, '^([^/?#]*)', 1)) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
    r(rh, rp, v) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
    hit AS (
      SELECT page_id, rh || rp AS rule, v,
             row_number() OVER (PARTITION BY page_id ORDER BY length(rh) + length(rp) DESC, length(rh) DESC) AS n
      FROM p JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
    SELECT p.page_id, p.host, p.path, h.rule AS rule, coalesce(h.v, 'allow') AS verdict
    FROM p LEFT JOIN hit h ON p.page_id = h.page_id AND h.n = 1"""


@query(sql=_URL_SQL)
def op3_url_filters(spark, sf_dir):
    from quillon.llm import urls

    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge(table(spark, sf_dir, "pages"), rules)


@query
def op5_byte_level_bpe(spark, sf_dir):
    from quillon.llm import bpe

    return bpe.round_trip(documents(spark, sf_dir))


@query
def op8_secret_scans(spark, sf_dir):
    from pyspark.sql import functions as F

    from quillon.llm import secrets

    found = secrets.scan(documents(spark, sf_dir))
    of = lambda k: F.size(F.filter("base", lambda c: c.kind == k)).cast("long")
    order = lambda a, b: F.when(a.start != b.start, a.start - b.start).otherwise(a.kind - b.kind)
    return found.select(
        "doc_id",
        of(0).alias("n_assign"),
        of(1).alias("n_access"),
        of(2).alias("n_hex"),
        F.sha2(secrets.span_text(F.col("base")), 256).alias("base_sha256"),
        secrets.span_text(F.array_sort(F.concat("base", "added"), order)).alias("spans"),
        "n_live",
        "n_copied",
    )


@query
def op10_mixing_sources(spark, sf_dir):
    from pyspark.sql import functions as F

    from quillon.llm import mixture

    p = mixture.plan(documents(spark, sf_dir))
    shards = F.transform("draws", lambda x: x["shard"]).alias("shards")
    return p.select("doc_id", "source", "size", "source_size", "target", (F.size("draws") * F.col("size")).cast("long").alias("taken"), shards)


@query
def op1_language_id(spark, sf_dir):
    from pyspark.sql import functions as F

    from quillon.llm import langid

    docs = documents(spark, sf_dir)
    held_out = F.coalesce(langid.remainder(4) == 2, F.lit(False))
    found = langid.predict(docs, langid.fit(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op2_document_fingerprints(spark, sf_dir):
    from quillon.llm import fingerprints

    return fingerprints.probe(documents(spark, sf_dir))


_JACCARD_SQL = r"""
    WITH RECURSIVE w AS (
      SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
      FROM documents),
    s AS (
      SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
             ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    e AS (SELECT i.a, i.b FROM i JOIN n x ON i.a = x.doc_id JOIN n y ON i.b = y.doc_id WHERE 100 * k >= 80 * (x.n + y.n - k)),
    r(a, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON r.a = e.a)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id
    FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT a, min(c) AS c FROM r GROUP BY a) m ON m.a = d.doc_id"""


@query(sql=_JACCARD_SQL)
def op4_ngram_jaccard_join(spark, sf_dir):
    from quillon.llm import jaccard

    return jaccard.classes(documents(spark, sf_dir))


@query
def op6_lm_scoring(spark, sf_dir):
    from pyspark.sql import functions as F

    from quillon.llm import ngram_lm

    held_out = F.coalesce(ngram_lm.remainder(7) == 2, F.lit(False))
    return ngram_lm.score(documents(spark, sf_dir), ~held_out)


@query
def op9_substring_dedup(spark, sf_dir):
    from pyspark.sql import functions as F

    from quillon.llm import passages

    found = passages.repeated(documents(spark, sf_dir))

    def seen_from(x, y):
        names = {f"doc_{x}": "doc_id", f"start_{x}": "start", f"end_{x}": "end", f"doc_{y}": "other_doc_id", f"start_{y}": "other_start", f"end_{y}": "other_end"}
        return F.struct(*[F.col(a).alias(b) for a, b in names.items()], "n_same", "kind")

    # each passage as a row of either document
    return found.select(F.explode(F.array(seen_from("a", "b"), seen_from("b", "a"))).alias("x")).select("x.*")


_FIM_SQL = r"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w, sha256('1:' || doc_id) AS h FROM documents),
    u AS (SELECT *, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
    c AS (SELECT *, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS i, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS j,
                 CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
    p AS (SELECT *, list_sum([length(x) for x in w[1:i]])::BIGINT AS x, list_sum([length(x) for x in w[i + 1:j]])::BIGINT AS y FROM c),
    q AS (SELECT *, coalesce(x, 0) AS a, coalesce(y, 0) AS b FROM p),
    o AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b) AS mid, substr(t, a + b + 1) AS suf FROM q)
    SELECT doc_id, len(w)::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
           sha256(t) AS restored_sha256
    FROM o"""


@query(sql=_FIM_SQL)
def op11_fill_in_middle(spark, sf_dir):
    from pyspark.sql import functions as F

    from quillon.llm import fim

    made = fim.rearrange(documents(spark, sf_dir))
    restored = fim.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


def _license_sql() -> str:
    from quillon.llm import licenses

    listed = ", ".join(f"('{a}', '{b}')" for a, b in licenses.TEMPLATES)
    phrases = ", ".join(f"('{a}', '{b}')" for a, b in licenses.PHRASES)
    cut = r"list_filter(regexp_split_to_array(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    return f"""
    WITH d AS (SELECT doc_id, {cut.format("text")} AS w FROM documents),
    phrase(p, label) AS (VALUES {phrases}),
    ph AS (SELECT string_split(p, ' ') AS p, label FROM phrase),
    pos AS (SELECT doc_id, w, unnest(range(len(w)))::BIGINT AS i FROM d),
    place AS (SELECT doc_id, label, i FROM pos JOIN ph ON w[i + 1] = p[1] AND w[i + 1:i + len(p)] = p),
    base AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS l FROM place GROUP BY doc_id),
    template(label, text) AS (VALUES {listed}),
    t AS (SELECT label, list_distinct({cut.format("text")}) AS t, (2 ** ceil(log2(1.25 * len({cut.format("text")}))))::BIGINT AS s FROM template),
    blocks AS (SELECT doc_id, s, list_distinct(w[k * s + 1:k * s + 2 * s]) AS b FROM (
      SELECT doc_id, w, s, unnest(range((len(w) + s - 1) // s)) AS k FROM d, (SELECT DISTINCT s FROM t))),
    hit AS (SELECT doc_id, label, len(list_intersect(t, b)) / len(t) AS score FROM blocks JOIN t USING (s) WHERE len(b) * 10 >= 9 * len(t) AND 10 * len(list_intersect(t, b)) >= 9 * len(t)),
    held AS (SELECT doc_id, list(DISTINCT label) AS l, max(score) AS score FROM hit GROUP BY doc_id)
    SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
           coalesce(array_to_string(list_sort(base.l), ','), '') AS base_labels,
           array_to_string(list_sort(list_distinct(list_concat(coalesce(base.l, []), coalesce(held.l, [])))), ',') AS labels,
           round(greatest(coalesce(held.score, 0), CASE WHEN n_base > 0 THEN 1 ELSE 0 END), 9)::DOUBLE AS score
    FROM d LEFT JOIN base USING (doc_id) LEFT JOIN held USING (doc_id)"""


@query(sql=_license_sql())
def op12_license_scans(spark, sf_dir):
    from pyspark.sql import functions as F

    from quillon.llm import licenses

    templates = spark.createDataFrame(licenses.TEMPLATES, "label string, text string")
    found = licenses.scan(table(spark, sf_dir, "documents"), templates)
    named, held = F.col("places.label"), F.col("matches.label")
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    score = F.greatest(F.coalesce(F.array_max("matches.score"), F.lit(0.0)), F.when(F.size("places") > 0, 1.0).otherwise(0.0))
    starts = F.col("places.start")
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(named).alias("base_labels"), joined(F.concat(named, held)).alias("labels"), F.round(score, 9).alias("score"),
    )


@query
def op13_periodic_runs(spark, sf_dir):
    from pyspark.sql import functions as F

    from quillon.llm import periodic

    found = periodic.find(_repeating(documents(spark, sf_dir)))
    by_length = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    found = found.withColumn("best", by_length)
    length, period = F.col("best.length"), -F.col("best.period")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def _repeating(docs):
    """doc_id and text of all documents, of which a tenth repeats its words from word ``a`` on with the period ``p``."""
    from pyspark.sql import functions as F

    d = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h"))
    d = d.withColumn("words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))
    n, g, a, p = F.size("words"), F.floor(F.col("h") / 10), F.col("a"), F.col("p")
    d = d.withColumn("a", F.when(n > 0, g % n)).withColumn("p", 1 + F.floor((n - a) / (3 + g % 8)))
    at = lambda i: F.get("words", F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))
    text = F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), at), " ")).otherwise(F.col("text"))
    return d.select("doc_id", text.alias("text"))
